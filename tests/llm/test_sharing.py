"""Shared spans against brute force; chains against all chains."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import sharing


def brute(docs, span):
    seen = defaultdict(set)
    for d, t in docs:
        for k in range(len(t or "") - span + 1):
            seen[t[k : k + span]].add(d)
    out = set()
    for d, t in docs:
        held = sorted(k for k in range(len(t or "") - span + 1) if len(seen[t[k : k + span]]) > 1)
        spans = []
        for k in held:
            if spans and k <= spans[-1][1]:
                spans[-1][1] = k + span
            else:
                spans.append([k, k + span])
        out |= {(d, a, b) for a, b in spans}
    return out


def corpus(seed):
    rnd = random.Random(seed)
    noise = lambda n: "".join(rnd.choice("abcdefgh éü漢🙂") for _ in range(n))
    boiler, passages = noise(70), [noise(rnd.randrange(30, 200)) for _ in range(8)]
    docs = []
    for d in range(90):
        parts = [noise(rnd.randrange(0, 120))]
        if d % 3 == 0:
            parts += [boiler, noise(rnd.randrange(0, 20))]
        for p in rnd.sample(passages, rnd.randrange(0, 3)):
            a = rnd.randrange(len(p) // 2)
            parts += [p[a : a + rnd.randrange(20, 200)], noise(rnd.randrange(0, 9))]
        docs.append((d, "".join(parts)))
    whole = noise(150)
    docs += [(500 + i, whole) for i in range(25)] + [(600, whole + "x"), (700, None), (701, ""), (702, "z" * 300), (703, "z" * 130), (704, noise(39)), (705, passages[0] * 3)]
    return docs


@pytest.mark.parametrize(("span", "seed", "paired"), [(40, 12, 16), (40, 40, 2), (60, 20, 4), (40, 1, 3)])
def test_spans_equal_brute_force(spark, span, seed, paired):
    docs = corpus(span + paired)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id BIGINT, text STRING, h STRING, pos INT").repartition(4)
    got = [tuple(r) for r in sharing.shared_spans(df, span, seed=seed, paired=paired).select("doc_id", "span_start", "span_end").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, span)


def test_no_text_and_one_text(spark):
    df = spark.createDataFrame([(1, "a" * 50)], "doc_id BIGINT, text STRING")
    assert sharing.shared_spans(df, 20, seed=5).count() == sharing.shared_spans(df.limit(0), 20, seed=5).count() == 0


def test_keys_of_text(spark):
    df = spark.createDataFrame([("a", "x" + "abcdefghij" * 3), ("b", "abcdefghij" * 3), (None, "abcdefghij" * 3)], "doc_id STRING, text STRING")
    got = {tuple(r) for r in sharing.shared_spans(df, 20, seed=5).select("doc_id", "span_start", "span_end").collect()}
    assert got == {("a", 1, 31), ("b", 0, 30)}


def test_every_window_selects_a_seed_by_its_text_alone():
    rnd = np.random.default_rng(3)
    points = rnd.integers(97, 101, 3000, dtype=np.uint32)
    points[1000:1400] = points[:400]
    starts = np.array([0, 700, 700, 705, 3000])
    hashes, least, inside, at = sharing.sketch(points, starts, 50, 10)
    chosen = set(at.tolist())
    for w in np.flatnonzero(inside):
        seeds = hashes[w : w + 41]
        assert seeds.min() == least[w] and all(w + k in chosen for k in np.flatnonzero(seeds == seeds.min()))
    assert all(any(s <= k and k + 10 <= e for s, e in itertools.pairwise(starts)) for k in at)


@pytest.mark.parametrize("width", [1, 2, 5, 30])
def test_sliding_extremes(width):
    v = np.random.default_rng(1).integers(0, 2**63, 30, dtype=np.uint64)
    for pick, plain in ((np.minimum, min), (np.maximum, max)):
        assert sharing.sliding(v, width, pick).tolist() == [plain(v[i : i + width]) for i in range(31 - width)]
    assert len(sharing.sliding(v, 31, np.minimum)) == 0


def score(path, cost):
    total = sum(m[2] for m in path)
    for p, q in itertools.pairwise(path):
        total -= cost * (q[0] - p[0] - p[2] + q[1] - p[1] - p[2])
    return total


def test_the_best_chain_is_found():
    rnd = random.Random(9)
    for _ in range(60):
        matches = list({(rnd.randrange(60), rnd.randrange(60), rnd.randrange(1, 9)) for _ in range(rnd.randrange(1, 8))})
        best = 0
        for n in range(1, len(matches) + 1):
            for path in itertools.combinations(sorted(matches), n):
                if all(p[0] + p[2] <= q[0] and p[1] + p[2] <= q[1] for p, q in itertools.pairwise(path)):
                    best = max(best, score(path, 0.1))
        chains = sharing.chain(matches, 0.1)
        assert sorted(m for c in chains for m in c) == sorted(matches)
        assert abs(score(chains[0], 0.1) - best) < 1e-9


def test_edit_distance():
    for a, b, want in (("kitten", "sitting", 3), ("", "abc", 3), ("abc", "", 3), ("abc", "abc", 0), ("flaw", "lawn", 2)):
        assert sharing.edit_distance(*(np.array([*map(ord, x)], dtype=np.uint32) for x in (a, b))) == want


def test_edits_are_summed_up_to_a_bound():
    rnd = random.Random(2)
    points = lambda: np.array([rnd.randrange(4) for _ in range(rnd.randrange(12))], dtype=np.uint32)
    for _ in range(300):
        gaps = [(points(), points()) for _ in range(rnd.randrange(4))]
        total = sum(sharing.edit_distance(a, b) for a, b in gaps)
        for most in range(total + 3):
            assert sharing.edits_within(gaps, most) == (total if total <= most else None)


def test_altered_passages_are_found(spark):
    rnd = random.Random(12)
    noise = lambda n: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
    passage = noise(600)
    altered = passage[:150] + "XX" + passage[152:300] + passage[303:450] + "YYY" + passage[450:]
    docs = [(1, noise(200) + passage + noise(100)), (2, noise(50) + altered + noise(70)), (3, noise(800))]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    (r,) = sharing.fuzzy_passages(df).collect()
    assert (r.a, r.b) == (1, 2) and abs(r.a_start - 200) < 5 and abs(r.a_end - 800) < 5 and abs(r.b_start - 50) < 5 and 6 <= r.edits <= 9


def test_altered_passages_of_many_texts_are_found(spark):
    rnd = random.Random(13)
    noise = lambda n: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
    passage = noise(400)
    docs = [(d, noise(d) + passage[:190] + f"<{d:02}>" + passage[194:]) for d in range(20)]
    docs += [(30, docs[3][1]), (-1, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(3)
    got = sharing.fuzzy_passages(df, window=150, seed=50).collect()
    texts = dict(docs)
    assert {d for r in got for d in (r.a, r.b)} == {*range(20), -1} - {3}
    assert len(got) < 21 * 20 / 2 and all(r.edits <= 4 for r in got)
    whole = {key for r in got for start, end, key in ((r.a_start, r.a_end, r.a), (r.b_start, r.b_end, r.b)) if abs(start - (len(texts[key]) - 400)) <= 3 and end == len(texts[key])}
    assert whole == {*range(20), -1} - {3}


@pytest.mark.parametrize("group", [4, 100_000])
def test_periodic_texts_and_split_groups(spark, monkeypatch, group):
    monkeypatch.setattr(sharing, "GROUP", group)
    rnd = random.Random(4)
    noise = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    boiler = noise(60)
    docs = [(i, noise(rnd.randrange(30)) + boiler + noise(rnd.randrange(30))) for i in range(40)]
    docs += [(100 + i, "z" * (60 + 37 * i) + noise(5)) for i in range(3)] + [(200 + i, "xyw" * (30 + 11 * i)) for i in range(3)] + [(300, "z" * 45 + "y" + "z" * 300)]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(3)
    got = [tuple(r) for r in sharing.shared_spans(df, 40, seed=12, paired=3).select("doc_id", "span_start", "span_end").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, 40)


def test_a_text_with_many_pairs_is_repeated(spark, monkeypatch):
    monkeypatch.setattr(sharing, "PER_COPY", 4)
    docs = corpus(77)
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(4)
    got = {tuple(r) for r in sharing.shared_spans(df, 40, seed=12, paired=5).select("doc_id", "span_start", "span_end").collect()}
    assert got == brute(docs, 40)


def test_long_texts_are_sampled_in_parts():
    rnd = np.random.default_rng(5)
    text = "".join(map(chr, rnd.integers(97, 100, 2000)))
    whole, starts = sharing.code_points([text])
    *_, want = sharing.sketch(whole, starts, 50, 10)
    got = set()
    for block in sharing.overlapping([text], 130, 49):
        points, cuts = sharing.code_points([p for *_, p in block])
        *_, at = sharing.sketch(points, cuts, 50, 10)
        got |= {int(k - cuts[w] + block[w][1]) for k in at for w in [np.searchsorted(cuts, k, "right") - 1]}
    assert got == set(want.tolist())


@pytest.mark.parametrize("paired", [2, 16])
def test_texts_are_read_twice_at_most(spark, paired):
    docs = corpus(31)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(4).mapInArrow(count, "doc_id BIGINT, text STRING")
    got = {tuple(r) for r in sharing.shared_spans(df, 40, seed=12, paired=paired).select("doc_id", "span_start", "span_end").collect()}
    assert got == brute(docs, 40)
    assert read.value <= 2 * len(docs)  # for the seeds, and for the texts that share any


def test_picked_seeds_are_those_of_the_definition(monkeypatch):
    rnd = np.random.default_rng(11)
    for trial in range(200):
        n = int(rnd.integers(0, 900))
        points = rnd.integers(97, 97 + int(rnd.integers(1, 5)), n, dtype=np.uint32)
        if trial % 3 == 0 and n > 300:
            points[200:260] = points[:60]
        starts = np.concatenate([[0], np.sort(rnd.integers(0, n + 1, int(rnd.integers(0, 6)))), [n]]).astype(np.int64)
        seed = int(rnd.integers(1, 30))
        span = seed + int(rnd.integers(0, 120))
        monkeypatch.setattr(sharing, "TILE", int(rnd.integers(1, 200)))
        hashes, _, inside, at = sharing.sketch(points, starts, span, seed)
        found, part, least, low, high = sharing.picked(points, starts, span, seed)
        assert found.tolist() == at.tolist() and (hashes[found] == least).all()
        assert all(starts[p] <= x and x + seed <= starts[p + 1] for x, p in zip(found, part, strict=True))
        windows = [(s, x) for x, a, b in zip(found.tolist(), low.tolist(), high.tolist(), strict=True) for s in range(a, b + 1)]
        assert windows == [(s, s + int(np.argmin(hashes[s : s + span - seed + 1]))) for s in np.flatnonzero(inside).tolist()]


def test_alignments_over_their_bound_end_above_it():
    rnd = random.Random(6)
    for _ in range(300):
        a = [rnd.randrange(3) for _ in range(rnd.randrange(200))]
        b = [x for x in a if rnd.random() < 0.8] if rnd.random() < 0.5 else [rnd.randrange(3) for _ in range(rnd.randrange(200))]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, over = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(over[j] + (x != y), over[j + 1] + 1, row[j] + 1))
        most, sides = rnd.randrange(90), (np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32))
        assert sharing.edit_distance(*sides) == row[-1]
        assert sharing.edit_distance(*sides, most) == row[-1] if row[-1] <= most else sharing.edit_distance(*sides, most) > most


@pytest.mark.parametrize("group", [4, 100_000])
def test_groups_of_windows_go_over_batches(spark, monkeypatch, group):
    monkeypatch.setattr(sharing, "GROUP", group)
    docs = corpus(53)
    df = spark.createDataFrame([(None if d == 700 else f"k{d}", t) for d, t in docs], "doc_id STRING, text STRING").repartition(3)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, 7)
    try:
        got = [tuple(r) for r in sharing.shared_spans(df, 40, seed=12, paired=2).select("doc_id", "span_start", "span_end").collect()]
    finally:
        spark.conf.set(setting, before)
    assert len(got) == len(set(got)) and set(got) == brute([(f"k{d}", t) for d, t in docs], 40)
