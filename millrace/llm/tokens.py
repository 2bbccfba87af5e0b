"""Encoding of a corpus with a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.chars import SPACE, blocks, code_points, pattern_table, texts_of

NONE = np.int32(2**31 - 1)
#: Characters worked on at once; bounds a task's memory whatever the batch holds.
BLOCK = 2_000_000
#: Bytes of a matrix row: a longer word takes several rows, and the seams between them are mended.
SEGMENT = 64
#: Largest vocabulary file that is sent to every task.
LARGEST_VOCABULARY = 64 << 20
CELLS = 4_000_000


class ByteBpe:
    """A rank-file vocabulary with a hashed table from pairs of ids to the id of their union."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.bits = max(10, int(np.ceil(np.log2(len(pairs) + 1))) + 2)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int32)
        keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        values = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        slots, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            _, first = np.unique(slots, return_index=True)
            first = first[self.keys[slots[first]] == -1]
            self.keys[slots[first]], self.ranks[slots[first]] = keys[first], values[first]
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & ((1 << self.bits) - 1)

    @classmethod
    def of_file(cls, data: bytes) -> ByteBpe:
        """From the content of a rank file: a line per token, its bytes in base64 and its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())})

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each pair's union, or NONE."""
        shape, keys = left.shape, (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        slots = self._slot(keys)
        found = np.where(self.keys[slots] == keys, self.ranks[slots], NONE)
        open_ = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slots = (self._slot(keys[open_]) if _ == 0 else slots) + 1 & ((1 << self.bits) - 1)
            held = self.keys[slots]
            hit = held == keys[open_]
            found[open_[hit]] = self.ranks[slots[hit]]
            go = ~hit & (held != -1)
            open_, slots = open_[go], slots[go]
        return found.reshape(shape)

    def _merge_rows(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of padded rows (padding -1) after all merges, and their lengths.

        Every round each row merges its leftmost pair of least rank; rows
        without a pair leave the matrix, and columns that no row needs are cut.
        """
        out, out_len = np.full_like(ids, -1), lengths.copy()
        rows = np.arange(len(ids))
        ranks = np.full((len(ids), max(ids.shape[1] - 1, 0)), NONE, dtype=np.int32)
        if ids.shape[1] > 1:
            inside = ids[:, 1:] >= 0
            ranks[inside] = self.lookup(ids[:, :-1][inside], ids[:, 1:][inside])
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), dtype=np.int64)
            least = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            done = least == NONE
            if done.any():
                out[rows[done], : ids.shape[1]] = ids[done]
                out_len[rows[done]] = lengths[done]
                go = ~done
                rows, ids, ranks, lengths, at, least = rows[go], ids[go], ranks[go], lengths[go], at[go], least[go]
                if not len(rows):
                    break
            n, width = len(rows), int(lengths.max())
            each = np.arange(n)
            ids[each, at] = least
            columns = np.arange(width - 1)
            shift = columns[None, :] + (columns[None, :] > at[:, None])
            ids = np.take_along_axis(ids[:, :width], shift, axis=1)
            lengths = lengths - 1
            ids[columns[None, :] >= lengths[:, None]] = -1
            if width <= 2:
                ranks = np.full((n, 0), NONE, dtype=np.int32)
                continue
            kept = columns[:-1]
            ranks = np.take_along_axis(ranks[:, : width - 1], kept[None, :] + (kept[None, :] > at[:, None]), axis=1)
            ranks[kept[None, :] >= lengths[:, None] - 1] = NONE
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < lengths - 1))
                ranks[ok, side[ok]] = self.lookup(ids[ok, side[ok]], ids[ok, side[ok] + 1])
        return out, out_len

    def _merge_repeats(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_merge_rows``, for wide rows: a round merges all places of each row's least pair that come next in turn.

        Places follow each other from the left as long as no pair that they make is of the same or a
        lesser rank; the first one that makes such a pair ends the row's round. So the merges are
        the same and in the same order, and a row of one repeated pattern takes few rounds.
        """
        out, out_len = np.full_like(ids, -1), lengths.copy()
        rows = np.arange(len(ids))
        while len(rows):
            n, width = ids.shape
            ranks = np.full((n, max(width - 1, 0)), NONE, dtype=np.int32)
            inside = ids[:, 1:] >= 0
            ranks[inside] = self.lookup(ids[:, :-1][inside], ids[:, 1:][inside])
            least = ranks.min(axis=1) if width > 1 else np.full(n, NONE)
            done = least == NONE
            out[rows[done], :width], out_len[rows[done]] = ids[done], lengths[done]
            go = ~done
            rows, ids, ranks, lengths, least = rows[go], ids[go], ranks[go], lengths[go], least[go]
            if not len(rows):
                break
            hit = ranks == least[:, None]
            columns = np.arange(width - 1)
            gap = np.maximum.accumulate(np.where(hit, -1, columns[None, :]), axis=1)
            row, at = np.nonzero(hit & ((columns[None, :] - gap) % 2 == 1))
            same = np.zeros(len(row), dtype=bool)
            same[1:] = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + 2)
            made, worst = least[row], np.zeros(len(row), dtype=bool)
            for ok, left, right in (
                (at > 0, np.where(same, made, ids[row, np.maximum(at - 1, 0)]), made),
                (at + 2 < lengths[row], made, ids[row, np.minimum(at + 2, width - 1)]),
            ):
                k = np.flatnonzero(ok)
                worst[k] |= self.lookup(left[k], right[k]) <= made[k]
            bad = np.full(len(rows), width)
            np.minimum.at(bad, row[worst], at[worst])
            go = at <= bad[row]
            row, at, made = row[go], at[go], made[go]
            ids[row, at] = made
            ids[row, at + 1] = -1
            kept = ids >= 0
            lengths = kept.sum(axis=1)
            packed = np.full((len(rows), int(lengths.max())), -1, dtype=np.int32)
            packed[np.arange(packed.shape[1])[None, :] < lengths[:, None]] = ids[kept]
            ids = packed
        return out, out_len

    def _encode_rows(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches of bytes one after the other, and how many each has: padded matrices by length."""
        counts, parts = np.ones(len(sizes), dtype=np.int64), []
        edges = [0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, SEGMENT]
        while len(sizes) and edges[-1] < sizes.max():
            edges.append(edges[-1] * 2)
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            chosen = np.flatnonzero((sizes > low) & (sizes <= high))
            for k in range(0, len(chosen), max(1, CELLS // high)):
                words = chosen[k : k + max(1, CELLS // high)]
                cells = np.arange(high)[None, :]
                inside = cells < sizes[words][:, None]
                ids = np.full((len(words), high), -1, dtype=np.int32)
                ids[inside] = self.byte_id[data[(begins[words][:, None] + cells)[inside]]]
                ids, n = (self._merge_rows if high <= SEGMENT else self._merge_repeats)(ids, sizes[words].astype(np.int64))
                counts[words] = n
                parts.append((words, ids[ids >= 0], n))
        starts = np.zeros(len(sizes) + 1, dtype=np.int64)
        np.cumsum(counts, out=starts[1:])
        flat = np.empty(starts[-1], dtype=np.int32)
        for words, ids, n in parts:
            flat[_ranges(starts[words], n)] = ids
        return flat, counts

    def _mend(self, data: np.ndarray, begin: int, ids: np.ndarray, seams: np.ndarray, walls: np.ndarray) -> np.ndarray:
        """Ids of words that were encoded in several rows: ``seams`` are the indices of tokens that begin a row inside a word.

        If no merge crosses a place, the merges on its sides do not know of each other. So two encoded
        stretches together are their ids in turn just if their two tokens beside the seam, encoded as one
        stretch, stay these two. Where they do not, some tokens on both sides (twice as many each time, up to ``walls``,
        the places between words) are encoded anew as one stretch, which has at most two seams.
        ``begin`` is the byte at which the first token begins. The result's tokens cover the same bytes.
        """
        reach = 2
        while len(seams):
            at = begin + np.concatenate([[0], np.cumsum(self.sizes[ids])])
            pairs, which = np.unique(ids[seams - 1].astype(np.int64) << 32 | ids[seams], return_inverse=True)
            first = np.zeros(len(pairs), dtype=np.int64)
            first[which] = np.arange(len(seams))
            left = at[seams[first] - 1]
            size = at[seams[first] + 1] - left
            made, counts = self._encode_rows(data, left, size)
            heads = np.concatenate([[0], np.cumsum(counts)[:-1]])
            holds = (counts == 2) & (made[heads] == pairs >> 32)
            seams = seams[~holds[which]]
            if not len(seams):
                break
            wall = np.searchsorted(walls, seams, "right")
            low, high = np.maximum(seams - reach, walls[wall - 1]), np.minimum(seams + reach, walls[wall])
            fresh = np.concatenate([[True], low[1:] >= high[:-1]])
            # windows that overlap are one
            low, high = low[fresh], np.concatenate([high[:-1][fresh[1:]], high[-1:]])
            made, counts = self._encode_rows(data, at[low], at[high] - at[low])
            grown = counts - (high - low)
            keep = np.ones(len(ids), dtype=bool)
            keep[_ranges(low, high - low)] = False
            moved = np.concatenate([[0], np.cumsum(grown)])
            out = np.empty(len(ids) + int(grown.sum()), dtype=np.int32)
            after = np.searchsorted(high, np.flatnonzero(keep), "right")
            out[np.flatnonzero(keep) + moved[after]] = ids[keep]
            starts = low + moved[:-1]
            out[_ranges(starts, counts)] = made
            edge = np.unique(np.concatenate([starts, starts + counts]))
            walls = walls + moved[np.searchsorted(high, walls, "right")]
            ids, seams, reach = out, np.setdiff1d(edge, walls), reach * 2
        return ids

    def encode_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and where each word's ids start."""
        sizes = np.diff(offsets)
        rows = np.maximum(1, -(-sizes // SEGMENT))
        word = np.repeat(np.arange(len(sizes)), rows)
        place = _ranges(np.zeros(len(sizes), dtype=np.int64), rows)
        begins = offsets[word] + place * SEGMENT
        flat, counts = self._encode_rows(data, begins, np.minimum(offsets[word + 1] - begins, SEGMENT))
        heads = np.concatenate([[0], np.cumsum(counts)])
        if len(word) > len(sizes):
            flat = self._mend(data, int(offsets[0]), flat, heads[:-1][place > 0], np.concatenate([heads[:-1][place == 0], heads[-1:]]))
        starts = np.zeros(len(sizes) + 1, dtype=np.int64)
        if len(word) > len(sizes):
            starts[1:] = np.searchsorted(np.cumsum(self.sizes[flat]), offsets[1:] - offsets[0], "left") + 1
        else:
            starts[1:] = heads[1:]
        return flat, starts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids start."""
        points, starts = code_points(texts)
        if not len(points):
            return np.empty(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        begins = word_starts(points, starts)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        ends = np.cumsum(width)
        byte_at = np.concatenate([(ends - width)[begins], ends[-1:]])
        data = "".join(texts).encode("utf-8", "surrogatepass")
        words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(byte_at.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        kinds, which = words.dictionary, words.indices.to_numpy()
        held, spots = kinds.buffers()[2], np.frombuffer(kinds.buffers()[1], dtype=np.int64)[kinds.offset : kinds.offset + len(kinds) + 1]
        flat, at = self.encode_words(np.frombuffer(held, dtype=np.uint8), spots)
        counts = np.diff(at)[which]
        out = np.zeros(len(which) + 1, dtype=np.int64)
        np.cumsum(counts, out=out[1:])
        ids = flat[_ranges(at[which], counts)]
        return ids, out[np.searchsorted(begins, starts)]

    def encode_long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of one text that may be very long: in parts cut between words."""
        ids = np.concatenate([self.encode([part])[0] for part in cut_words(text, BLOCK)])
        return ids, np.array([0, len(ids)], dtype=np.int64)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + counts[i] - 1, for all i in turn."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def word_starts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the words begin into which texts are split before merging.

    A word is a run of letters, of numbers or of other characters with at most
    one blank before it; a contraction's ending ('s 't 'm 'd 're 've 'll); or
    white space, without its last character where other text follows.
    """
    kind = pattern_table()[points]
    n = len(points)
    begin = np.empty(n, dtype=bool)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    bounds = starts[(starts > 0) & (starts < n)]
    begin[bounds] = True
    ends_text = np.zeros(n, dtype=bool)
    ends_text[bounds - 1] = True
    ends_text[n - 1] = True
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~ends_text[:-1])
    begin[last] = True
    begin[last[points[last] == 0x20] + 1] = False
    quote = np.flatnonzero((points == 0x27) & begin)
    quote = quote[quote + 1 < n]
    quote = quote[~ends_text[quote]]
    one = points[quote + 1]
    two = np.where((quote + 2 < n) & ~ends_text[np.minimum(quote + 1, n - 1)], points[np.minimum(quote + 2, n - 1)], 0)
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for chosen, size in ((quote[single], 2), (quote[double & ~single], 3)):
        begin[chosen + 1] = False
        following = chosen + size
        begin[following[following < n]] = True
    return np.flatnonzero(begin)


def cut_words(text: str, most: int, window: int = 4096) -> list[str]:
    """A text in parts of about ``most`` characters, each beginning at a word that follows no white space.

    Whether a word begins depends on the characters next to a place only, so the words of a window tell.
    """
    parts, begin, edge = [], 0, 8
    seek = most
    while begin + seek < len(text):
        low, high = max(begin, begin + seek - edge), min(len(text), begin + seek + window)
        points, starts = code_points([text[low:high]])
        found = word_starts(points, starts)
        found = found[(found >= edge) & (found < len(points) - edge)]
        found = found[pattern_table()[points[found - 1]] != SPACE]
        if not len(found):
            seek += window - 2 * edge
            continue
        parts.append(text[begin : low + int(found[0])])
        begin, seek = low + int(found[0]), most
    parts.append(text[begin:])
    return parts


@functools.lru_cache(maxsize=4)
def _loaded(data: bytes) -> ByteBpe:
    return ByteBpe.of_file(data)


def encode_corpus(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every text: ``key`` and ``ids`` (array<int>).

    ``vocabulary`` is the path of a rank file, read on the driver and sent to
    every task (refused beyond LARGEST_VOCABULARY). No special tokens: strings
    that look like them are ordinary text. An empty or null text gives an empty
    list; texts of any length are encoded whole; each input row gives one row.
    Nothing is shuffled: scan, encode by batch, done.

    In a block of texts the words are found by array operations, each distinct
    word is encoded once, in padded matrices by length, and the ids are gathered. Words of any length
    are encoded so: one of more than SEGMENT bytes takes several rows, whose seams are mended. A text of more than
    BLOCK characters is taken in parts that begin at words, so memory is bounded by BLOCK or the longest single word.
    """
    if os.path.getsize(vocabulary) > LARGEST_VOCABULARY:
        raise ValueError(f"{vocabulary} is larger than {LARGEST_VOCABULARY} bytes")
    with open(vocabulary, "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(sent.value)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in blocks(texts, BLOCK):
                ids, at = bpe.encode(texts[a:b]) if b - a > 1 else bpe.encode_long(texts[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
