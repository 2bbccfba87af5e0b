"""All queries of the core and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType

from millrace.queries import acceleration, aggregates, commands, files, relational, scalars, statistics, streams, udfs, upkeep, windows

MODULES: list[ModuleType] = [upkeep, relational, windows, aggregates, scalars, statistics, udfs, files, commands, acceleration, streams]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for module in MODULES:
        part = getattr(module, attribute)
        if clash := out.keys() & part.keys():
            raise ValueError(f"query names used twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict[str, Callable]:
    """Query callables by name."""
    return _merged("QUERIES")


def oracles() -> dict[str, str]:
    """SQL twins by name."""
    return _merged("ORACLES")
