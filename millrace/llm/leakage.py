"""Evaluation texts inside a training corpus: pigeonhole pieces, exact hits, Myers verification."""

from __future__ import annotations

import functools
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.chars import NUMBER, blocks, class_table, code_points, texts_of

BLOCK = 2_000_000
#: Characters of evaluation items held at once; a larger set is taken in blocks, each a scan of the corpus.
ITEM_CHARS = 16_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def reduce_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits (categories L and N) of the NFKC, lower-cased texts, as code points, and where each text starts."""
    points, starts = code_points([unicodedata.normalize("NFKC", t).lower() for t in texts])
    keep = class_table()[points] <= NUMBER
    kept = np.zeros(len(points) + 1, dtype=np.int64)
    np.cumsum(keep, out=kept[1:])
    return points[keep], kept[starts]


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE, and of its inverse, modulo 2^64."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, dtype=np.uint64)]), dtype=np.uint64) for b in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))))


def window_hashes(points: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every stretch of ``size`` code points, equal for equal stretches wherever they stand.

    Differences of prefix sums of a polynomial, times the inverse power of the place.
    """
    n = len(points) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    length = 1 << 16
    while length < len(points):
        length *= 2
    powers, inverse = _powers(length)
    with np.errstate(over="ignore"):
        terms = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        terms ^= terms >> np.uint64(32)
        terms *= powers[: len(terms)]
        sums = np.cumsum(terms, dtype=np.uint64)
        out = sums[size - 1 :].copy()
        out[1:] -= sums[: n - 1]
        out *= inverse[:n]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(29)
    return out


def myers(pattern: list[int], text: list[int]) -> int:
    """Least edit distance of ``pattern`` to any stretch of ``text`` (bit-parallel, one word of any width)."""
    m = len(pattern)
    peq: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        best = min(best, score)
    return best


@dataclass
class Pieces:
    """Pieces of all items: any ``span`` consecutive characters of an item hold ``edits`` + 1 whole pieces."""

    span: int
    edits: int
    size: int
    item_ids: list
    points: np.ndarray
    starts: np.ndarray
    hashes: np.ndarray = field(default=None)
    item: np.ndarray = field(default=None)
    at: np.ndarray = field(default=None)
    sieve: np.ndarray = field(default=None)

    @classmethod
    def of(cls, ids: list, texts: list[str], span: int, edits: int) -> Pieces:
        """Cut the reduced items into pieces of (span + 1) // (edits + 2) characters."""
        size = (span + 1) // (edits + 2)
        if size < 4:
            raise ValueError(f"{edits} edits leave pieces of {size} characters in a span of {span}")
        points, starts = reduce_texts(texts)
        made = cls(span, edits, size, ids, points, starts)
        lengths = np.diff(starts)
        long = np.flatnonzero(lengths >= span)
        tiles = [(i, k) for i in long for k in range(0, lengths[i] - size + 1, size)]
        item = np.array([i for i, _ in tiles], dtype=np.int64)
        at = np.array([starts[i] + k for i, k in tiles], dtype=np.int64)
        hashes = window_hashes(points, size)[at] if len(at) else np.empty(0, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        made.hashes, made.item, made.at = hashes[order], item[order], at[order]
        made.sieve = np.zeros(1 << 20, dtype=bool)
        made.sieve[(made.hashes >> np.uint64(44)).astype(np.int64)] = True
        return made

    def find(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, edits) of every text that holds ``span`` characters of an item within the error budget; edits is the least found first."""
        if not len(self.hashes):
            return []
        points, starts = reduce_texts(texts)
        most, overlap = BLOCK, self.span + 2 * self.edits
        found: dict[tuple[int, int], int] = {}
        for text in np.flatnonzero(np.diff(starts) > most + overlap):
            for at in range(int(starts[text]), int(starts[text + 1]) - overlap, most):
                part = points[at : min(at + most + overlap, int(starts[text + 1]))]
                for _, i, e in self._find(part, np.array([0, len(part)], dtype=np.int64)):
                    found[int(text), i] = min(e, found.get((int(text), i), e))
        short = np.diff(starts) <= most + overlap
        if short.all():
            return self._find(points, starts)
        for text in np.flatnonzero(short):
            part = points[starts[text] : starts[text + 1]]
            found |= {(int(text), i): e for _, i, e in self._find(part, np.array([0, len(part)], dtype=np.int64))}
        return [(t, i, e) for (t, i), e in sorted(found.items())]

    def _find(self, points: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        hashes = window_hashes(points, self.size)
        spots = np.flatnonzero(self.sieve[(hashes >> np.uint64(44)).astype(np.int64)])
        low, high = np.searchsorted(self.hashes, hashes[spots], "left"), np.searchsorted(self.hashes, hashes[spots], "right")
        n = high - low
        spots, low, n = spots[n > 0], low[n > 0], n[n > 0]
        text = np.searchsorted(starts, spots, "right") - 1
        inside = spots + self.size <= starts[text + 1]
        spots, low, n, text = spots[inside], low[inside], n[inside], text[inside]
        piece = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        spots, text = np.repeat(spots, n), np.repeat(text, n)
        item, at = self.item[piece], self.at[piece]
        same = np.ones(len(spots), dtype=bool)
        for k in range(self.size):
            same &= points[spots + k] == self.points[at + k]
        spots, text, item, at = spots[same], text[same], item[same], at[same]
        left = self._reach(points, spots, starts[text], at, self.starts[item], -1)
        right = self._reach(points, spots + self.size - 1, starts[text + 1], at + self.size - 1, self.starts[item + 1], 1)
        whole = left + self.size + right >= self.span
        found: dict[tuple[int, int], int] = {}
        for k in np.flatnonzero(whole):
            pair = int(text[k]), int(item[k])
            if pair not in found:
                begin = int(at[k] - min(left[k], self.span - self.size))
                edits = self._edits(points, starts, int(spots[k]), int(text[k]), int(at[k]), begin)
                if edits <= self.edits:
                    found[pair] = edits
        if self.edits:
            rest = np.flatnonzero(~whole)
            room = self.span - self.size
            before = self._profile(points, spots[rest], starts[text[rest]], at[rest], self.starts[item[rest]], -1)
            after = self._profile(points, spots[rest] + self.size - 1, starts[text[rest] + 1], at[rest] + self.size - 1, self.starts[item[rest] + 1], 1)
            total = before + after[:, ::-1]
            for k in np.flatnonzero(total.min(axis=1) <= self.edits):
                hit = rest[k]
                pair = int(text[hit]), int(item[hit])
                begin = int(at[hit]) - int(total[k].argmin())
                if begin + room >= 0 and found.get(pair, self.edits + 1) > total[k].min():
                    found[pair] = self._edits(points, starts, int(spots[hit]), int(text[hit]), int(at[hit]), begin)
        return [(t, i, e) for (t, i), e in sorted(found.items())]

    def _profile(self, points, here, here_end, there, there_end, step: int) -> np.ndarray:
        """Per hit and x = 0 .. span - size: least edits to align the next x item characters beyond the hit, at most edits + 1.

        A band of 2 * edits + 1 diagonals, one character of all hits at a time. Two
        such profiles, of both sides of a piece, tell the windows worth verifying.
        """
        k, room, none = self.edits, self.span - self.size, self.edits + 1
        out = np.full((len(here), room + 1), none, dtype=np.int16)
        band = np.full((2 * k + 1, len(here)), none, dtype=np.int16)
        far = (here_end - here) * step - (step > 0)
        for b in range(k + 1):
            band[k + b] = np.where(b <= far, b, none)
        out[:, 0] = 0
        wide = (there_end - there) * step - (step > 0)
        for x in range(1, room + 1):
            fresh = np.full_like(band, none)
            ok = x <= wide
            char = self.points[np.where(ok, there + step * x, 0)]
            for b in range(-k, k + 1):
                inside = ok & (x + b >= 1) & (x + b <= far)
                other = points[np.where(inside, here + step * (x + b), 0)]
                best = np.where(inside, band[k + b] + (char != other), none)
                if b < k:
                    best = np.minimum(best, np.where(ok & (x + b >= 0) & (x + b <= far), band[k + b + 1] + 1, none))
                if b > -k:
                    best = np.minimum(best, np.where(inside, fresh[k + b - 1] + 1, none))
                fresh[k + b] = np.minimum(best, none)
            band = fresh
            out[:, x] = band.min(axis=0)
        return out

    def _reach(self, points, here, here_end, there, there_end, step: int) -> np.ndarray:
        """How many characters agree beyond a hit, in one direction, up to what a span can need."""
        reach = np.zeros(len(here), dtype=np.int64)
        alive = np.arange(len(here))
        for k in range(1, self.span - self.size + 1):
            if not len(alive):
                break
            a, b = here[alive] + step * k, there[alive] + step * k
            ok = (a >= here_end[alive]) & (b >= there_end[alive]) if step < 0 else (a < here_end[alive]) & (b < there_end[alive])
            alive, a, b = alive[ok], a[ok], b[ok]
            alive = alive[points[a] == self.points[b]]
            reach[alive] = k
        return reach

    def _edits(self, points, starts, spot: int, text: int, at: int, begin: int) -> int:
        """Myers distance of the item's window at ``begin`` to the text around a hit."""
        low = max(int(starts[text]), spot - (at - begin) - self.edits)
        high = min(int(starts[text + 1]), spot - (at - begin) + self.span + self.edits)
        return myers(self.points[begin : begin + self.span].tolist(), points[low:high].tolist())


def _item_blocks(items: DataFrame, key: str, text: str) -> Iterator[tuple[list, list[str]]]:
    """Items in blocks of at most ITEM_CHARS characters, streamed to the driver."""
    ids, texts, held = [], [], 0
    for row in items.select(key, text).dropna().dropDuplicates().toLocalIterator():
        if ids and held + len(row[1]) > ITEM_CHARS:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        held += len(row[1])
    yield ids, texts


def find_leaks(documents: DataFrame, items: DataFrame, span: int = 80, edits: int = 0, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """Documents that hold ``span`` characters of an evaluation item, within ``edits`` edits.

    Result: doc_key, item_key, edits, each pair once. Both texts are reduced by
    NFKC, lower case and keeping letters and digits. Items are cut into pieces
    such that any window of ``span`` characters holds one more whole piece than
    errors are allowed: so one piece of a leaked window stands in the document
    unaltered (pigeonhole). Piece hits come from one pass of window hashes over
    the whole text; each hit's window is verified by Myers' bit-parallel distance.
    With ``edits`` 0 this is exactly: the texts share ``span`` consecutive characters.

    The item set goes to every task in blocks of ITEM_CHARS characters: an
    evaluation set of any size is searched, a scan per block. The corpus isn't
    shuffled; only found pairs are. A null or empty text on either side, or an
    item shorter than ``span``, has no case. Repeated rows count once.
    """
    spark = documents.sparkSession
    doc_kind, item_kind = documents.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    corpus = documents.select(F.col(doc_key), F.col(text)).where(F.length(text) > 0)
    result = None
    for ids, texts in _item_blocks(items, item_key, text):
        sent = spark.sparkContext.broadcast(Pieces.of(ids, texts, span, edits))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            pieces = sent.value
            for batch in batches:
                docs = texts_of(batch.column(1))
                for a, b in blocks(docs, BLOCK):
                    found = pieces.find(docs[a:b])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([a + t for t, _, _ in found], pa.int64())), pa.array([pieces.item_ids[i] for _, i, _ in found], item_arrow), pa.array([e for _, _, e in found], pa.int32())],
                        names=[doc_key, item_key, "edits"],
                    )

        item_arrow = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()
        part = corpus.mapInArrow(run, f"`{doc_key}` {doc_kind}, `{item_key}` {item_kind}, edits int")
        result = part if result is None else result.union(part)
    return result.groupBy(doc_key, item_key).agg(F.min("edits").alias("edits"))
