"""Long spans shared between records: sampled k-mer seeds, collinear chains, aligned passages."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.chars import code_points, overlapping, texts_of
from millrace.llm.leakage import window_hashes
from millrace.operators.heavy import join_listed, leave_out
from millrace.operators.sieve import Sieve, key_hash
from millrace.session import stash

BLOCK = 1_000_000
#: Characters that are hashed at a time: the arrays stay in a core's cache.
TILE = 16_384
#: Length of a seed.
SEED = 100
#: Texts of a seed with more occurrences than this are not all paired: each is linked to one partner for every window that it shares.
PAIRED = 16
#: Rows in which one group of equal windows looks for partners at a time.
GROUP = 100_000
#: Pairs of one text that one copy of it serves.
PER_COPY = 256
#: Cost of a character between two chained matches, in matched characters.
GAP_COST = 0.05
#: Rounds of an alignment between looks at its bound.
ROUNDS = 64
#: Most edits of an aligned passage, as a share of its length.
SHARE = 0.1


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Least (np.minimum) or greatest (np.maximum) of every ``width`` consecutive values, from runs over blocks in both directions."""
    n = len(values)
    if n < width:
        return np.empty(0, dtype=values.dtype)
    padded = np.empty(-(-n // width) * width, dtype=np.uint64)
    padded[:n], padded[n:] = values, values[-1]
    grid = padded.reshape(-1, width)
    ahead = pick.accumulate(grid, axis=1).ravel()
    behind = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: n - width + 1], ahead[width - 1 : n])


def sketch(points: np.ndarray, starts: np.ndarray, span: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all seeds, the least seed hash of every window, whether a window lies in one text, and the selected positions.

    A seed is selected where it is the least (ties all) of the seeds in some
    window of ``span`` characters of its text. Which seeds a window selects
    depends on its characters alone, so two equal windows select equal seeds at
    equal offsets: the sample loses no shared window. This is the definition; ``picked`` finds the same faster.
    """
    hashes = window_hashes(points, seed)
    width = span - seed + 1
    least = sliding(hashes, width, np.minimum)
    inside = np.arange(len(least)) + span <= np.repeat(starts[1:], np.diff(starts))[: len(least)]
    if not len(least):
        return hashes, least, inside, np.empty(0, dtype=np.int64)
    edge = np.zeros(width - 1, dtype=np.uint64)
    greatest = sliding(np.concatenate([edge, np.where(inside, least, np.uint64(0)), edge]), width, np.maximum)
    return hashes, least, inside, np.flatnonzero((greatest == hashes) & (greatest > 0))


def hashes_of(points: np.ndarray, size: int) -> np.ndarray:
    """``window_hashes``, tile by tile."""
    out = np.empty(max(0, len(points) - size + 1), dtype=np.uint64)
    for at in range(0, len(out), TILE):
        out[at : at + TILE] = window_hashes(points[at : at + TILE + size - 1], size)
    return out


def _nearest(before: np.ndarray, part: np.ndarray, place: np.ndarray, width: int, passes: np.ufunc) -> np.ndarray:
    """Where the nearest earlier row of the same part is over which a row does not pass, by jumps; -1, or a row of another part or ``width`` away, if none is nearer."""
    found = np.arange(len(before)) - 1
    todo = np.arange(1, len(before))
    while len(todo):
        p = found[todo]
        on = (p >= 0) & (part[p] == part[todo]) & (place[todo] - place[p] < width) & passes(before[p], before[todo])
        todo = todo[on]
        found[todo] = found[p[on]]
    return found


def picked(points: np.ndarray, starts: np.ndarray, span: int, seed: int) -> tuple[np.ndarray, ...]:
    """The positions that ``sketch`` selects, their text and hash, and the first and the last window of which each is the first least seed (last < first: of none).

    Of the seeds around a selected one, at least half a window on one side is
    not less. By the least of whole blocks this leaves few candidates. Each window's least seed is one of them, so
    which windows a candidate is the least of follows from the nearest less ones.
    """
    hashes, width = hashes_of(points, seed), span - seed + 1
    half, n = width // 2, len(hashes)
    step = max(1, half // 5)
    whole = (half - step + 1) // step
    grid = np.full((-(-n // step), step), np.iinfo(np.uint64).max)
    grid.reshape(-1)[:n] = hashes
    bar = np.full(len(grid), 0 if whole else np.iinfo(np.uint64).max, dtype=np.uint64)
    if 0 < whole < len(grid):
        floor = grid.min(axis=1)
        run = np.minimum.reduce([floor[k : len(grid) - whole + 1 + k] for k in range(whole)])
        bar[: -whole] = run[1:]
        bar[whole:] = np.maximum(bar[whole:], run[:-1])
    at = np.flatnonzero((grid <= bar[:, None]).reshape(-1)[:n])
    part = np.searchsorted(starts, at, "right") - 1
    good = at + seed <= starts[part + 1]
    at, part = at[good], part[good]
    least = hashes[at]

    def side(least: np.ndarray, part: np.ndarray, place: np.ndarray, passes: np.ufunc, edge: np.ndarray) -> np.ndarray:
        p = _nearest(least, part, place, width, passes)
        return np.where((p >= 0) & (part[p] == part), place[p] + 1, edge)

    begin = side(least, part, at, np.greater_equal, starts[part])
    first = side(least, part, at, np.greater, starts[part])
    end = -side(least[::-1], part[::-1], -at[::-1], np.greater_equal, -(starts[part + 1] - seed)[::-1])[::-1] + 1
    good = end - begin >= width
    at, part, least, first, end = at[good], part[good], least[good], first[good], end[good]
    return at, part, least, np.maximum(first, at - width + 1), np.minimum(at, end - width)


def sketches(documents: DataFrame, key: str, text: str, span: int, seed: int) -> DataFrame:
    """Of every text of at least ``span`` characters a row with its length and 128-bit content hash, and a row per selected seed: seed hash h and position pos."""
    kind = documents.schema[key].dataType.simpleString()
    layout = [("length", pa.int32()), ("content", pa.binary()), ("h", pa.int64()), ("pos", pa.int32())]

    def rows(keys: pa.Array, **given: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, *(given.get(n, pa.nulls(len(keys), t)) for n, t in layout)], names=[key, *(n for n, _ in layout)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            content = pa.array([hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts], pa.binary())
            yield rows(batch.column(0), length=pa.array([len(t) for t in texts], pa.int32()), content=content)
            for block in overlapping(texts, BLOCK, span - 1):
                points, starts = code_points([part for *_, part in block])
                at, which, hashes, *_ = picked(points, starts, span, seed)
                owner, offset = (np.array([x[i] for x in block], dtype=np.int64) for i in (0, 1))
                place = at - starts[which] + offset[which]
                yield rows(batch.column(0).take(pa.array(owner[which])), h=pa.array(hashes.view(np.int64)), pos=pa.array(place.astype(np.int32)))

    kept = documents.where(F.col(key).isNotNull() & (F.length(text) >= span)).select(F.col(key), F.col(text))
    return kept.mapInArrow(run, f"`{key}` {kind}, length int, content binary, h bigint, pos int")


class Fenwick:
    """Greatest value so far over prefixes of a range."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def update(self, i: int, value: float, who: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, who)
            i += i & -i

    def query(self, i: int) -> tuple[float, int]:
        """Best of positions below ``i``."""
        found = (float("-inf"), -1)
        while i > 0:
            if self.best[i][0] > found[0]:
                found = self.best[i]
            i -= i & -i
        return found


def chain(matches: list[tuple[int, int, int]], cost: float = GAP_COST) -> list[list[tuple[int, int, int]]]:
    """Cut matches (a, b, length) into collinear chains, best first.

    A match may follow one that ends before it on both sides; a chain's score is
    its matched characters less ``cost`` for every character skipped on either side. With a
    cost linear in both coordinates the best predecessor is the greatest prefix
    value over b in a Fenwick tree while ends are swept along a. Every match is in exactly one chain.
    """
    if len(matches) == 1:
        return [matches]
    order = sorted(range(len(matches)), key=lambda i: matches[i])
    ends = sorted(range(len(matches)), key=lambda i: matches[i][0] + matches[i][2])
    columns = sorted({b + n for _, b, n in matches})
    tree, score, before, done = Fenwick(len(columns)), [0.0] * len(matches), [-1] * len(matches), 0
    for i in order:
        a, b, n = matches[i]
        while done < len(ends) and matches[ends[done]][0] + matches[ends[done]][2] <= a:
            j = ends[done]
            x, y, m = matches[j]
            tree.update(bisect.bisect_left(columns, y + m), score[j] + cost * (x + m + y + m), j)
            done += 1
        value, who = tree.query(bisect.bisect_right(columns, b))
        gain = value - cost * (a + b)
        score[i], before[i] = (n + gain, who) if who >= 0 and gain > 0 else (float(n), -1)
    free, chains = [True] * len(matches), []
    for i in sorted(range(len(matches)), key=lambda i: -score[i]):
        path, j = [], i
        while j >= 0 and free[j]:
            free[j] = False
            path.append(matches[j])
            j = before[j]
        if path:
            chains.append(path[::-1])
    return chains


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading characters of two arrays agree."""
    n, at, step = min(len(a), len(b)), 0, 512
    while at < n:
        to = min(n, at + step)
        differ = a[at:to] != b[at:to]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, step = to, step * 4
    return n


def exact_matches(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int]], seed: int) -> list[tuple[int, int, int]]:
    """Maximal exact matches through the anchors, each once; a false anchor (hash collision) gives none."""
    out, reach, diagonal = [], 0, None
    for d, p in sorted((x - y, x) for x, y in anchors):
        if d == diagonal and p + seed <= reach:
            continue
        diagonal = d
        q = p - d
        right = _agree(a[p:], b[q:])
        if right < seed:
            continue
        left = _agree(a[:p][::-1], b[:q][::-1])
        reach = p + right
        out.append((p - left, q - left, left + right))
    return out


def edit_distance(a: np.ndarray, b: np.ndarray, most: int | None = None) -> int:
    """Edit distance of two short stretches (bit-parallel over one word of any width, a round per character of the shorter); more than ``most`` may end early with any value above it."""
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    peq: dict[int, int] = {}
    get = peq.get
    for i, c in enumerate(a.tolist()):
        peq[c] = get(c, 0) | 1 << i
    full, codes = (1 << len(a)) - 1, b.tolist()
    pv, mv = full, 0
    for at in range(0, len(codes), ROUNDS):
        # bits beyond the word have no effect on those below, and go at the end of a run of rounds
        for c in codes[at : at + ROUNDS]:
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = (mv | (full ^ (xh | pv))) << 1 | 1
            pv = (pv & xh) << 1 | (full ^ (xv | ph))
            mv = ph & xv
        pv, mv = pv & full, mv & full
        done = min(at + ROUNDS, len(codes))
        score = done + pv.bit_count() - mv.bit_count()
        least = score - (len(codes) - done)  # each round takes off one at most
        if most is not None and least > most:
            return least
    return score


def edits_within(gaps: list[tuple[np.ndarray, np.ndarray]], most: int) -> int | None:
    """Sum of the edit distances of stretches, or None if it is more than ``most``.

    Where lower bounds alone exceed ``most`` nothing is aligned, and no longer than the distances summed so far leave room.
    """
    bounds = [_least_edits(a, b) for a, b in gaps]
    left = most - sum(bounds)
    for (a, b), bound in sorted(zip(gaps, bounds, strict=True), key=lambda x: len(x[0][0]) * len(x[0][1])):
        if left < 0:
            return None
        left -= edit_distance(a, b, left + bound) - bound
    return most - left if left >= 0 else None


def _least_edits(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edit distance: an edit changes at most three neighbouring triples of characters on each side."""
    if not len(a) or not len(b):
        return max(len(a), len(b))
    short = abs(len(a) - len(b))
    if min(len(a), len(b)) < 3:
        return short
    code = lambda x: (x[:-2].astype(np.uint64) << np.uint64(42)) ^ (x[1:-1].astype(np.uint64) << np.uint64(21)) ^ x[2:]
    both = np.concatenate([code(a), code(b)])
    order = np.argsort(both)
    signs = np.where(order < len(a) - 2, 1, -1)
    cuts = np.flatnonzero(np.diff(both[order], prepend=both[order[0]] + np.uint64(1)))
    apart = int(np.abs(np.add.reduceat(signs, cuts)).sum())
    return max(short, -(-apart // 6))


def passages(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int]], seed: int, cost: float = GAP_COST, share: float = SHARE) -> list[tuple[int, int, int, int, int | None, list]]:
    """Aligned passages of two texts: a_start, a_end, b_start, b_end, edits, exact matches.

    The anchors' maximal exact matches are chained; in each chain the stretches
    between consecutive matches are aligned, and the passage's edits are their sum; None if they are more than ``share`` of its longer side.
    """
    out = []
    for path in chain(exact_matches(a, b, anchors, seed), cost):
        first, last = path[0], path[-1]
        sides = first[0], last[0] + last[2], first[1], last[1] + last[2]
        gaps = [(a[p[0] + p[2] : q[0]], b[p[1] + p[2] : q[1]]) for p, q in zip(path, path[1:], strict=False)]
        out.append((*sides, edits_within(gaps, int(share * max(sides[1] - sides[0], sides[3] - sides[2]))), path))
    return out


def packed_texts(documents: DataFrame, key: str, text: str, span: int, wanted: DataFrame, marked: DataFrame) -> DataFrame:
    """key and compressed text of the texts that ``wanted`` (distinct keys, written already) may hold; ``marked`` tells of which ``marked`` may hold them.

    Filters of bounded size leave most other texts out before they are
    compressed and shuffled; a join must follow for the few that pass wrongly.
    """
    kind = documents.schema[key].dataType.simpleString()
    sent, mark = (Sieve.of(x, key, x.count()).send(documents) for x in (wanted, marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            hashes = batch.column(2).to_numpy()
            at = np.flatnonzero(sent.value.holds(hashes))
            kept = batch.take(pa.array(at))
            packed = [pack.compress(t.encode("utf-8", "surrogatepass")) for t in texts_of(kept.column(1))]
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(packed, pa.binary()), pa.array(mark.value.holds(hashes[at]))], names=[key, "packed", "marked"])

    kept = documents.where(F.col(key).isNotNull() & (F.length(text) >= span)).select(F.col(key), F.col(text), key_hash(F.col(key)))
    return kept.mapInArrow(run, f"`{key}` {kind}, packed binary, marked boolean")


def _unpack(packed: bytes, by=zstandard.ZstdDecompressor()) -> str:
    return by.decompress(packed).decode("utf-8", "surrogatepass")


def _points(packed: bytes) -> np.ndarray:
    return np.frombuffer(_unpack(packed).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _anchors(seeds: DataFrame, key: str) -> DataFrame:
    """Common seeds of two texts each (a, b, x, y), from seeds of few occurrences."""
    groups = seeds.groupBy("h").agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("d"), F.col("pos").alias("p")))).alias("g"))
    met = groups.select(F.explode("g").alias("u"), "g").select("u", F.explode("g").alias("v")).where(F.col("u.d") < F.col("v.d"))
    return met.select(F.col("u.d").alias("a"), F.col("v.d").alias("b"), F.col("u.p").alias("x"), F.col("v.p").alias("y"))


def _aligned(pairs: DataFrame, packed: DataFrame, key: str, seed: int, emit, schema: str, share: float = SHARE) -> DataFrame:
    """Bring both texts to each pair (a, b, anchors; written already) and run ``emit`` on its passages.

    A text with very many pairs (as ``a``) is repeated, so that its pairs spread over tasks.
    """
    counts = stash(pairs.groupBy("a").agg(F.count("*").alias("n")), "hubs")
    copies = F.ceil(F.col("n") / PER_COPY).cast("int")
    salted = join_listed(pairs, counts, "a", pairs.count()).withColumn("salt", F.pmod(F.xxhash64("b"), copies).cast("int")).drop("n")
    theirs = packed.select(F.col(key).alias("b"), F.col("packed").alias("packed_b"))
    ours = packed.select(F.col(key).alias("a"), F.col("packed").alias("packed_a")).join(counts, "a").select("a", "packed_a", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
    met = salted.join(theirs, "b").join(ours, ["a", "salt"]).select("a", "b", "anchors", "packed_a", "packed_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, points = None, None
        for batch in batches:
            rows = []
            anchors = batch.column(2)
            flat = anchors.flatten()
            xs, ys = (f.to_pylist() for f in flat.flatten())
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in anchors])]).tolist()
            ids_a, ids_b, packs_a, packs_b = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4)
            for i, (a, b) in enumerate(zip(ids_a, ids_b, strict=True)):
                if a != last:
                    last, points = a, _points(packs_a[i].as_py())
                here = list(zip(xs[cuts[i] : cuts[i + 1]], ys[cuts[i] : cuts[i + 1]], strict=True))
                rows += emit(a, b, passages(points, _points(packs_b[i].as_py()), here, seed, share=share))
            yield from emit.batches(rows)

    return met.mapInArrow(run, schema)


class _ExactRuns:
    """Both sides' exact matches of at least ``span`` characters in the passages."""

    def __init__(self, key: str, span: int, kind: pa.DataType):
        self.key, self.span, self.kind = key, span, kind

    def __call__(self, a, b, found) -> list[tuple]:
        out = []
        for *_, path in found:
            for x, y, n in path:
                if n >= self.span:
                    out += [(a, x, x + n), (b, y, y + n)]
        return out

    def batches(self, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, begins, ends = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, self.kind), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], names=[self.key, "s", "e"])


class _Passages:
    """Passages of at least ``least`` characters on both sides whose edits are within the share."""

    def __init__(self, least: int, kind: pa.DataType):
        self.least, self.kind = least, kind

    def __call__(self, a, b, found) -> list[tuple]:
        return [(a, b, *p[:5]) for p in found if min(p[1] - p[0], p[3] - p[2]) >= self.least and p[4] is not None]

    def batches(self, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(columns[i], self.kind if i < 2 else pa.int32()) for i in range(7)], names=["a", "b", "a_start", "a_end", "b_start", "b_end", "edits"])


def _windows(hot: DataFrame, packed: DataFrame, key: str, kind: str, span: int, seed: int) -> DataFrame:
    """Windows whose least seed is one of ``hot`` (key, h, n): key, h, hash w, first place s, ``echo``, bucket and split.

    h and w together are 128 bits that depend on the window's characters. Of equal windows of one
    text the first has a row; the stretches that the others cover are its ``echo`` (pairs of 32-bit start and end). Windows of a seed with
    more than GROUP occurrences are split over buckets of about GROUP rows by a hash of the key.
    """
    parts = F.ceil(F.col("n") / GROUP).cast("int")
    hot = hot.select(key, F.struct("h", F.pmod(F.xxhash64(key), parts).cast("int").alias("bucket"), (parts > 1).alias("split")).alias("seed"))
    met = hot.groupBy(key).agg(F.collect_set("seed").alias("seeds")).join(packed, key).select(key, "seeds", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = [_unpack(p) for p in batch.column(2).to_pylist()], batch.column(1).to_pylist()
            for block in overlapping(texts, BLOCK, span - 1):
                points, starts = code_points([part for *_, part in block])
                seeds, part, least, low, high = picked(points, starts, span, seed)
                owner, offset = (np.array([x[i] for x in block], dtype=np.int64) for i in (0, 1))
                # the seeds wanted of each part, as (part, h)
                held = [(i, x["h"], x["bucket"], x["split"]) for i, o in enumerate(owner.tolist()) for x in wanted[o]]
                of, h, bucket, split = (np.array(c) for c in zip(*held, strict=True))
                order = np.lexsort((h, of))
                of, h, bucket, split = of[order], h[order].astype(np.int64), bucket[order], split[order]
                spot = _rank(np.stack([of, h], axis=1), np.stack([part, least.view(np.int64)], axis=1))
                good = (spot >= 0) & (low <= high)
                many = (high - low + 1)[good]
                begin = np.cumsum(many) - many
                at = np.repeat(low[good] - begin, many) + np.arange(many.sum())
                part, spot = np.repeat(part[good], many), np.repeat(spot[good], many)
                w = hashes_of(points, span)[at].view(np.int64)
                order = np.argsort(w, kind="stable")  # the windows of a part stand together and in order, and so do its equal ones
                at, part, spot, w = at[order], part[order], spot[order], w[order]
                first = np.ones(len(at), dtype=bool)
                first[1:] = (spot[1:] != spot[:-1]) | (w[1:] != w[:-1])
                place = (at - starts[part] + offset[part]).astype(np.int32)
                lead = np.flatnonzero(first)
                again = np.flatnonzero(~first)
                fresh = np.ones(len(again), dtype=bool)
                fresh[1:] = (np.diff(again) > 1) | (np.diff(place[again]) > span)
                begins = again[fresh]
                ends = np.concatenate([again[:-1][fresh[1:]], again[-1:]])
                runs = np.stack([place[begins], place[ends] + np.int32(span)], axis=1)
                cuts = (8 * np.searchsorted(begins, np.append(lead, len(at)))).astype(np.int32)
                echo = pa.Array.from_buffers(pa.binary(), len(lead), [None, pa.py_buffer(cuts), pa.py_buffer(runs.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner[part[lead]])), pa.array(h[spot[lead]]), pa.array(w[lead]), pa.array(place[lead]), echo, pa.array(bucket[spot[lead]].astype(np.int32)), pa.array(split[spot[lead]].astype(bool))],
                    names=[key, "h", "w", "s", "echo", "bucket", "split"],
                )

    return met.mapInArrow(run, f"`{key}` {kind}, h bigint, w bigint, s int, echo binary, bucket int, split boolean")


def _rank(rows: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Where in ``rows`` (two columns, sorted, each once) each sought row is, or -1."""
    if not len(rows) or not len(sought):
        return np.full(len(sought), -1, dtype=np.int64)
    both, inverse = np.unique(np.concatenate([rows[:, 1], sought[:, 1]]), return_inverse=True)
    code = lambda first, second: first * len(both) + second
    have, want = code(rows[:, 0], inverse[: len(rows)]), code(sought[:, 0], inverse[len(rows) :])
    spot = np.minimum(np.searchsorted(have, want), len(have) - 1)
    return np.where(have[spot] == want, spot, -1)


def _linked(windows: DataFrame, key: str, kind: str, span: int, by: list[str], again: bool) -> DataFrame:
    """Links of windows that another text holds too, as (a, b, off, at, s): window ``s`` of text b is window s + off of text a; ``at`` is the stretch of span + 1 characters that s lies in.

    Each group of equal windows, which is of bounded size, links its members to its least one, and members of the same text as that
    to its last one; the least one's link is that of the last. One shuffle and one sort, by w alone, serve, and each window is made once. An echo
    is a row without b: from at to off in text a. With ``again`` also the windows of split seeds that found no partner, and the least of each group, as rows without a.
    """
    columns = [key, "h", "w", "s", "echo", *["bucket", "split"] * again]
    rows = windows.select(columns).repartition(*by).sortWithinPartitions("w")
    layout = [("a", kind), ("b", kind), ("off", "int"), ("at", "int"), ("s", "int"), *[("h", "bigint"), ("w", "bigint"), ("echo", "binary")] * again]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}

    def rows_of(n: int, **given: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(n, kinds.get(k, pa.string()))) for c, k in layout], names=[c for c, _ in layout])

    def link(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_batches(held)
        if not again:
            size = np.diff(_leads(t, ["w"]), append=t.num_rows)
            t = t.filter(pa.array(np.repeat(size > 1, size)))
            if not t.num_rows:
                return
        rank = np.empty(t.num_rows, dtype=np.int64)
        rank[pc.sort_indices(t.column(key)).to_numpy()] = np.arange(t.num_rows)
        t = t.take(pa.array(np.lexsort((rank, *(t.column(c).to_numpy() for c in by)))))
        lead = _leads(t, by)
        size = np.diff(lead, append=t.num_rows)
        last = lead + size - 1
        keys, s, echo = t.column(key), t.column("s").to_numpy(), t.column("echo")
        shared = pc.not_equal(keys.take(pa.array(lead)), keys.take(pa.array(last))).to_numpy(zero_copy_only=False)
        if again:
            alone = np.repeat(~shared, size)
            alone[lead] = True
            more = t.filter(pa.array(alone & t.column("split").to_numpy(zero_copy_only=False)))
            yield rows_of(more.num_rows, b=more.column(key), **{c: more.column(c) for c in ("s", "h", "w", "echo")})
        lead, last, size = lead[shared], last[shared], size[shared]
        row = np.arange(size.sum()) + np.repeat(lead - np.cumsum(size) + size, size)
        lead, last = np.repeat(lead, size), np.repeat(last, size)
        mine = keys.take(pa.array(row))
        partner = np.where(pc.equal(mine, keys.take(pa.array(lead))).to_numpy(zero_copy_only=False), last, lead)
        linked = row != lead
        own, partner = row[linked], partner[linked]
        yield rows_of(len(own), a=keys.take(pa.array(partner)), b=mine.filter(pa.array(linked)), off=pa.array(s[partner] - s[own]), at=pa.array(s[own] // np.int32(span + 1)), s=pa.array(s[own]))
        many = pc.binary_length(echo).to_numpy()[row] // 8
        if many.any():
            begin, end = np.frombuffer(b"".join(echo.take(pa.array(row)).to_pylist()), dtype=np.int32).reshape(-1, 2).T
            yield rows_of(len(begin), a=mine.take(pa.array(np.repeat(np.arange(len(row)), many))), off=pa.array(end), at=pa.array(begin), s=pa.array(begin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the group that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = int(_leads(batch, ["w"])[-1])
            if cut or held and held[-1].column("w")[-1] != batch.column("w")[0]:
                yield from link([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from link(held)

    return rows.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in layout))


def _leads(rows: pa.RecordBatch, by: list[str]) -> np.ndarray:
    """First rows of the groups of sorted rows."""
    group = np.stack([rows.column(c).to_numpy() for c in by])
    return np.flatnonzero(np.append(True, (group[:, 1:] != group[:, :-1]).any(axis=0)))


def _links(windows: DataFrame, key: str, kind: str, span: int, split: bool) -> DataFrame:
    """Per diagonal and stretch the first link (a, b, off, at, y) of windows that another text holds too, and their echoes (a, null, off, at, y).

    Where buckets split a seed, those who found no partner and the least of each group within a bucket meet again over all buckets.
    """
    found = _linked(windows, key, kind, span, ["w", "h", *["bucket"] * split], split)
    if split:
        near = stash(found, "near")
        alone = near.where("a IS NULL").select(F.col("b").alias(key), "h", "w", "s", "echo")
        found = near.where("a IS NOT NULL").select("a", "b", "off", "at", "s").unionByName(_linked(alone, key, kind, span, ["w", "h"], False))
    return found.groupBy("a", "b", "off", "at").agg(F.min("s").alias("y"))


class TextPairs:
    """Pairs of texts that share windows of ``span`` characters, with anchors; copies of whole texts apart.

    ``copies`` (key, length, first): texts that equal another as a whole; only the first goes on.
    ``pairs`` (a, b, anchors): enough pairs that every window that a text shares with another one stands in a common
    stretch around an anchor of one of its pairs. ``echoes`` (key, s, e): stretches that repeat, inside a text, a window that it shares.
    """

    def __init__(self, documents: DataFrame, span: int, key: str, text: str, seed: int, paired: int):
        self.kind = documents.schema[key].dataType.simpleString()
        rows = stash(sketches(documents, key, text, span, seed), "sketch")
        contents = rows.where("content IS NOT NULL").select(key, "length", "content")
        classes = contents.groupBy("content").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
        self.copies = stash(contents.join(classes, "content").select(key, "length", "first"), "copies")
        later = self.copies.where(F.col(key) != F.col("first")).select(key)
        seeds = leave_out(rows.where("h IS NOT NULL").select(key, "h", "pos"), later, key)
        counts = seeds.groupBy("h").agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        counts = stash(counts.where("lo <> hi").select("h", "n"), "counts")
        shared = stash(join_listed(seeds, counts, "h", rows.count()), "shared")
        cold, hot = shared.where(F.col("n") <= paired), shared.where(F.col("n") > paired).select(key, "h", "n").distinct()
        wanted = stash(shared.groupBy(key).agg((F.max("n") > paired).alias("hot")), "wanted")
        texts = stash(packed_texts(documents, key, text, span, wanted, wanted.where("hot")), "packed")
        self.packed = texts.select(key, "packed")
        most = counts.agg(F.max("n")).first()[0] or 0
        # windows on one diagonal that begin within span characters of each other lie in one common stretch
        links = stash(_links(_windows(hot, texts.where("marked"), key, self.kind, span, seed), key, self.kind, span, most > GROUP), "links")
        self.echoes = links.where("b IS NULL").select(F.col("a").alias(key), F.col("at").alias("s"), F.col("off").alias("e"))
        near = links.where("b IS NOT NULL").select("a", "b", (F.col("y") + F.col("off")).cast("int").alias("x"), "y")
        self.pairs = stash(_anchors(cold, key).unionByName(near).groupBy("a", "b").agg(F.collect_list(F.struct("x", "y")).alias("anchors")), "pairs")


def shared_spans(documents: DataFrame, span: int = 400, key: str = "doc_id", text: str = "text", seed: int = SEED, paired: int = PAIRED) -> DataFrame:
    """Maximal stretches of each text made of windows of ``span`` characters that another text holds too.

    Result: key, span_start, span_end (code points, end exclusive), distinct.

    Texts equal as a whole are one class: its members are shared from end to end
    and only one of them goes on. Seeds are sampled so that equal windows select
    equal seeds. The texts of a seed with at most ``paired`` occurrences are all paired. Of a
    seed with more (a boilerplate, a third of all texts) no group is paired out: each
    window of which it is the least seed is linked to one equal window of another text, which gives as many pairs as
    members. Every pair's matches are extended, chained and aligned, and the exact matches
    of at least ``span`` characters are spans of both texts: so all spans are verified on the texts, but for
    repeats of a shared window within one text, which two 64-bit hashes tell. Keys
    above a share of the rows do not go through one task.

    Rows with a null key, and null, empty or short texts, have no span. The key
    must be unique. Other columns are not read.
    """
    arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(documents.schema[key].dataType.simpleString(), pa.string())
    found = TextPairs(documents, span, key, text, seed, paired)
    matched = _aligned(found.pairs, found.packed, key, seed, _ExactRuns(key, span, arrow), f"`{key}` {found.kind}, s int, e int")
    whole = found.copies.select(key, F.lit(0).alias("s"), F.col("length").alias("e"))
    return merge_spans(matched.unionByName(found.echoes).unionByName(whole), key)


def merge_spans(spans: DataFrame, key: str) -> DataFrame:
    """Unite spans (key, s, e) that overlap or touch: key, span_start, span_end. Of spans with one start the longest counts, before the shuffle."""
    along = Window.partitionBy(key).orderBy("s", "e")
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("s") > F.max("e").over(past), F.lit(True)).cast("int")
    marked = spans.groupBy(key, "s").agg(F.max("e").alias("e")).withColumn("fresh", fresh)
    grouped = marked.withColumn("island", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "island").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end")).drop("island")


def fuzzy_passages(documents: DataFrame, least: int = 200, share: float = SHARE, key: str = "doc_id", text: str = "text", window: int = 150, seed: int = 50, paired: int = PAIRED) -> DataFrame:
    """Pairs of texts with passages that agree up to edits: a, b, their ranges and the edits.

    Passages are chains of exact seed matches with the stretches between them
    aligned; at least ``least`` characters long, edits at most ``share`` of the length. Pairs are found as in
    ``shared_spans``, by exact common windows of ``window`` characters: of texts equal as a whole only the least key stands here
    (the others are its class), and of a passage with a seed of more than ``paired`` occurrences a text is linked to one
    partner for each window, not to all. So every text with a passage that holds such an exact window comes out with a partner.
    A passage begins and ends with an exact match.
    """
    arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(documents.schema[key].dataType.simpleString(), pa.string())
    found = TextPairs(documents, window, key, text, seed, paired)
    schema = f"a {found.kind}, b {found.kind}, a_start int, a_end int, b_start int, b_end int, edits int"
    return _aligned(found.pairs, found.packed, key, seed, _Passages(least, arrow), schema, share)
