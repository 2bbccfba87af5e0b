"""Per-character tables and code-point arrays of many texts at once."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa

# The code points of Unicode's White_Space property.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Letters and numbers that Unicode 16 added to 15.1, as ranges; public tokenizers know them, Python 3.13 does not.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


@functools.cache
def class_table() -> np.ndarray:
    """The class of every code point: letter (L), number (N), white space, other."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    first = {"L": LETTER, "N": NUMBER}
    for cp in range(0x110000):
        if (c := first.get(unicodedata.category(chr(cp))[0])) is not None:
            table[cp] = c
    table[WHITE_SPACE] = SPACE
    return table


@functools.cache
def pattern_table() -> np.ndarray:
    """The classes as public tokenizers' patterns see them."""
    table = class_table().copy()
    for kind, ranges in ((LETTER, LETTERS_16), (NUMBER, NUMBERS_16)):
        for a, b in ranges:
            table[a : b + 1] = kind
    return table


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null becomes the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in one array, and where each text starts (one more entry than texts)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), out=starts[1:])
    return points, starts


def blocks(texts: list[str], most: int) -> list[tuple[int, int]]:
    """Cut a list of texts into ranges of at most ``most`` characters (a longer text stands alone)."""
    out, begin, held = [], 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            out.append((begin, i))
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        out.append((begin, len(texts)))
    return out


def overlapping(texts: list[str], most: int, overlap: int) -> list[list[tuple[int, int, str]]]:
    """Texts in blocks of bounded size as (text, offset, part): a text of more than ``most`` characters gives several parts.

    Consecutive parts share ``overlap`` characters, so every window of up to
    ``overlap`` + 1 characters lies in a part, and begins in the first ``most`` of just one.
    """
    out, block, held = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - overlap, 1), most):
            part = t[at : at + most + overlap]
            if held and held + len(part) > most + overlap:
                out.append(block)
                block, held = [], 0
            block.append((i, at, part))
            held += len(part)
    if block:
        out.append(block)
    return out


