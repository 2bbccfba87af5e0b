"""Splitting SQL scripts into statements."""

from __future__ import annotations

import re

_PIECE = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^'"`;/-]+|.""", re.S)


def statements(text: str) -> list[str]:
    """The statements of a script: cut at semicolons outside literals and comments; empty ones are left out."""
    out, held, real = [], [], False
    for piece in _PIECE.findall(text):
        if piece == ";":
            if real:
                out.append("".join(held).strip())
            held, real = [], False
            continue
        held.append(piece)
        real = real or not piece.startswith(("--", "/*")) and bool(piece.strip())
    if real:
        out.append("".join(held).strip())
    return out
