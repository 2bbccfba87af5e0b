"""Leaked passages against brute force, exact and with edits."""

import random
import unicodedata

import numpy as np
import pytest

from millrace.llm import leakage


def reduced(t):
    return "".join(c for c in unicodedata.normalize("NFKC", t).lower() if unicodedata.category(c)[0] in "LN")


def brute(docs, items, span):
    windows = {}
    for i, t in items:
        r = reduced(t or "")
        for k in range(len(r) - span + 1):
            windows.setdefault(r[k : k + span], set()).add(i)
    out = set()
    for d, t in docs:
        r = reduced(t or "")
        for k in range(len(r) - span + 1):
            out |= {(d, i) for i in windows.get(r[k : k + span], ())}
    return out


def distance(a, b):
    """Least edit distance of a to any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_myers_equals_dynamic_programming():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(lo, 30))) for lo in (1, 0))
        assert leakage.myers([*map(ord, a)], [*map(ord, b)]) == distance(a, b)


def test_reduction():
    texts = ["Ａb-Ｃ① ﬁ Ⅷ", "", "ΟΔΟΣ ΟΔΟΣ", "İx", "éé", "!?"]
    points, starts = leakage.reduce_texts(texts)
    assert ["".join(map(chr, points[a:b])) for a, b in zip(starts, starts[1:], strict=False)] == [reduced(t) for t in texts]


def test_window_hashes_do_not_depend_on_the_place():
    rnd = np.random.default_rng(2)
    a = rnd.integers(1, 0x10FFFF, 5000, dtype=np.uint32)
    b = np.concatenate([rnd.integers(1, 99, 777, dtype=np.uint32), a])
    for size in (1, 7, 40, 100, 400):
        assert (leakage.window_hashes(a, size) == leakage.window_hashes(b, size)[777:]).all()
    assert len(leakage.window_hashes(a[:5], 6)) == 0


@pytest.fixture(scope="module")
def planted():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(rnd.randrange(5, 60)))) for i in range(40)] + [(98, None), (99, ""), (97, "short")]
    items.append((41, items[3][1]))
    docs = []
    for d in range(120):
        base = [word() for _ in range(rnd.randrange(0, 80))]
        if d % 3 == 0:
            text = rnd.choice(items[:40])[1]
            a = rnd.randrange(len(text))
            piece = text[a : a + rnd.randrange(60, 200)]
            piece = {0: piece.upper(), 1: piece.replace(" ", "\n-"), 2: "".join(chr(ord(c) + 0xFEE0) if c != " " else c for c in piece)}[d % 9 // 3]
            base.insert(rnd.randrange(len(base) + 1), piece)
        docs.append((d, " ".join(base)))
    docs += [(200, None), (201, ""), (202, items[0][1]), (203, "".join(t or "" for _, t in items))]
    return docs, items


def test_pairs_equal_brute_force(spark, planted):
    docs, items = planted
    d = spark.createDataFrame([(*x, "e") for x in docs], "doc_id BIGINT, text STRING, edits STRING").repartition(3)
    i = spark.createDataFrame([*items, items[0]], "item_id BIGINT, text STRING")
    found = leakage.find_leaks(d, i, 80, 0)
    got = [(r.doc_id, r.item_id) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items, 80) and got
    assert leakage.find_leaks(d.limit(0), i).count() == leakage.find_leaks(d, i.limit(0)).count() == 0


def test_items_in_blocks_give_the_same(spark, planted, monkeypatch):
    docs, items = planted
    monkeypatch.setattr(leakage, "ITEM_CHARS", 500)
    d, i = spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, text STRING")
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, i, 80, 0).collect()} == brute(docs, items, 80)


def test_edits_within_the_budget_are_found():
    rnd = random.Random(6)
    item = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(150))
    pieces = leakage.Pieces.of([1], [item], 80, 3)
    for errors in range(6):
        text = list(item[30:110])
        for at in sorted(rnd.sample(range(5, 75, 6), errors), reverse=True):
            kind = rnd.randrange(3)
            text[at : at + (kind != 0)] = [] if kind == 1 else ["#" if kind == 2 else "Z"][:1]
        text = "".join(text).replace("#", "Q")
        found = pieces.find(["x" * 50 + text + "y" * 50])
        least = min(distance(item[k : k + 80], reduced(text)) for k in range(71))
        assert bool(found) == (least <= 3)
        if found:
            assert found[0][2] <= 3
    with pytest.raises(ValueError):
        leakage.Pieces.of([1], [item], 80, 40)


def test_whole_tables_equal_brute_force(spark, folder):
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "eval_item"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 80)
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(docs, items).collect()} == want


def test_long_texts_are_searched_in_parts(planted, monkeypatch):
    docs, items = planted
    docs = [(d, t) for d, t in docs if t]
    whole = [*docs, (900, " ".join(t for _, t in docs))]
    kept = [(i, t) for i, t in items if t]
    pieces = leakage.Pieces.of([i for i, _ in kept], [t for _, t in kept], 80, 0)
    want = pieces.find([t for _, t in whole])
    monkeypatch.setattr(leakage, "BLOCK", 100)
    assert pieces.find([t for _, t in whole]) == want
    assert {(whole[t][0], pieces.item_ids[i]) for t, i, _ in want} == brute(whole, kept, 80)


@pytest.mark.parametrize("edits", [1, 4])
def test_pairs_with_edits_equal_dynamic_programming(edits):
    rnd = random.Random(edits)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    items = [(i, word(rnd.randrange(30, 60))) for i in range(6)]
    docs = []
    for d in range(40):
        t = list(items[d % 6][1][rnd.randrange(10) :])
        for _ in range(rnd.randrange(0, 9)):
            at = rnd.randrange(len(t))
            t[at : at + 1] = rnd.choice([[], ["q"], [t[at], "q"]])
        docs.append((d, word(rnd.randrange(0, 9)) + "".join(t) + word(rnd.randrange(0, 9))))
    pieces = leakage.Pieces.of([i for i, _ in items], [t for _, t in items], 30, edits)
    got = {(docs[t][0], pieces.item_ids[i]) for t, i, _ in pieces.find([t for _, t in docs])}
    want = {(d, i) for d, t in docs for i, u in items if min(distance(u[k : k + 30], t) for k in range(len(u) - 29)) <= edits}
    assert got == want and 5 < len(want) < len(docs) * len(items) / 2
