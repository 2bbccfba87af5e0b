"""Encoding against a public encoder of the same vocabulary, text by text."""

import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import chars, tokens
from millrace.llm.queries import TOKENIZERS

FILE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

EDGES = [
    "\u1c89\u1c8a x", "a\U00013461", "1\U00010d41",     "", " ", "  ", "\n", "a", " a", "  a", "a ", "a  ", "a\n", " \n x", "\t\tx", "x 　y", "'s", " 's", "''s", "--'s", "x's", "x'st", "it's'll", "\n's", "'", "a'", "'l", "'ll", "'r", "'re", "'S", "don't we'd", "'ve've",
    "<|endoftext|>", "<|endoftext|>'s", "1234'm", "٣٤ x²½Ⅷ", "漢字かな交じり文。次の文", "é é", "👍🏽👨‍👩‍👧", "​﻿", "\x00\x1c\x85", "a b", "ſtart Straße", "a\r\nb\r\n\r\nc", "-" * 700, "ab" * 400, "字" * 300, " " * 1000 + "x",
]


@pytest.fixture(scope="module")
def bpe():
    with open(FILE, "rb") as f:
        return tokens.ByteBpe.of_file(f.read())


@pytest.fixture(scope="module")
def public():
    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def agree(bpe, public, texts):
    ids, at = bpe.encode(texts)
    assert len(at) == len(texts) + 1
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == public.encode_ordinary(t), repr(t[:80])


def test_edges(bpe, public):
    agree(bpe, public, EDGES)
    for t in EDGES:
        agree(bpe, public, [t])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("'strevmld \n\t-a1漢é"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=40), max_size=6))
def test_any_text(texts):
    with open(FILE, "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    agree(tokens._loaded(data), _public(ranks), texts)


def _public(ranks, held=[]):  # noqa: B006
    if not held:
        held.append(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return held[0]


@pytest.mark.parametrize("alphabet", ["etaoin", "a", "ab", "ACGT", "-=", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "漢字かな交", "éü"])
def test_long_words_take_the_same_merges(bpe, public, alphabet):
    rnd, n = random.Random(5), tokens.SEGMENT
    agree(bpe, public, ["".join(rnd.choice(alphabet) for _ in range(size)) for size in (n - 1, n, n + 1, 2 * n, 2 * n + 1, 5000, 3, 700)])


@pytest.mark.parametrize("pattern", ["abc", "ab", "the", "xyzzy", "-=-", "aab", "漢", "éa", "abcdefg"])
def test_words_of_one_repeated_pattern(bpe, public, pattern):
    agree(bpe, public, [t for n in (1, 50, 333, 2001) for t in (pattern * n, "q" + pattern * n, pattern * n + "z", "q" * 5 + pattern * n + "re" * 40)])


def test_ids_give_the_text_back(bpe, public):
    text = "".join(EDGES)
    ids, _ = bpe.encode([text])
    assert public.decode(ids.tolist()) == text


def test_corpus_rows_nulls_and_extra_columns(spark, public):
    data = [(i, t, "x") for i, t in enumerate(EDGES)] + [(900, None, None), (None, "null key", "y"), (900, "twice", None)]
    df = spark.createDataFrame(data, "doc_id BIGINT, text STRING, ids STRING").repartition(3)
    got = [(r.doc_id, r.ids) for r in tokens.encode_corpus(df, FILE).collect()]
    want = [(i, public.encode_ordinary(t or "")) for i, t, _ in data]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert tokens.encode_corpus(df.limit(0), FILE).count() == 0


def test_whole_documents(spark, folder, public):
    df = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: public.encode_ordinary(r.text or "") for r in df.collect()}
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df, FILE).collect()}
    assert got == want


def test_blocks_cover_all_texts():
    texts = ["a" * n for n in (0, 5, 3, 100, 0, 1)]
    cuts = chars.blocks(texts, 8)
    assert [i for a, b in cuts for i in range(a, b)] == list(range(6))
    assert chars.blocks([], 8) == []


def test_classes_are_those_of_the_pattern():
    """A piece that is a token as a whole stays whole: so the public pattern tells each character's class."""
    points = [*range(0xD800), *range(0xE000, 0x12000), *range(0x13000, 0x14400), *range(0x1E000, 0x1F900)]
    ranks = {bytes([i]): i for i in range(256)}
    for cp in points:
        for before in "aa", "11", "  ":
            ranks.setdefault((before + chr(cp)).encode(), len(ranks))
    public = tiktoken.Encoding("classes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = lambda t: len(public.encode_ordinary(t)) == 1
    table = chars.pattern_table()
    for cp in points:
        c = chr(cp)
        kind = chars.LETTER if whole("aa" + c) else chars.NUMBER if whole("11" + c) else chars.SPACE if whole("  " + c) else chars.OTHER
        assert table[cp] == kind, hex(cp)


def test_a_long_text_is_cut_between_words(spark, bpe, public, monkeypatch):
    rnd = random.Random(8)
    text = "".join(rnd.choice(["word", " ", "  ", "\n", "'s", "12", "--", "漢字", "\t "]) for _ in range(3000))
    assert "".join(tokens.cut_words(text, 50)) == text and len(tokens.cut_words(text, 50)) > 20
    monkeypatch.setattr(tokens, "BLOCK", 50)
    ids, at = bpe.encode_long(text)
    assert ids.tolist() == public.encode_ordinary(text) and at.tolist() == [0, len(ids)]
    assert bpe.encode_long("")[0].tolist() == []


@pytest.mark.parametrize("letters", ["漢字、かな。", "ab", "ab'sre!?", "a1-"])
def test_a_long_text_without_blanks_is_cut_too(bpe, public, monkeypatch, letters):
    rnd = random.Random(6)
    text = "".join(rnd.choice(letters) for _ in range(4000))
    parts = tokens.cut_words(text, 100, 64)
    assert "".join(parts) == text and (len(parts) > 20) == (letters != "ab")
    monkeypatch.setattr(tokens, "BLOCK", 100)
    assert bpe.encode_long(text)[0].tolist() == public.encode_ordinary(text)


def test_overlapping_parts_hold_every_window():
    texts = ["", "abcdefghijklmnopqrstuvwxyz", "xy", "0123456789"]
    parts = [p for block in chars.overlapping(texts, 4, 3) for p in block]
    for i, t in enumerate(texts):
        begins = [at + k for o, at, part in parts if o == i for k in range(min(4, len(part) - 3))]
        assert begins == list(range(len(t) - 3)) and all(t[at : at + len(part)] == part for o, at, part in parts if o == i)
