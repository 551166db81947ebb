"""Progress of a run over several columns or files, told as each one ends.

The engine has no stream operators: a table is profiled by one query. What can be told step by step is
the sequence of files, so follow() runs a step per file and reports (number, total, name).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any


def follow(names: Iterable[str], step: Callable[[str], Any], told: Callable[[int, int, str], None] | None = None) -> Iterator[tuple[str, Any]]:
    names = list(names)
    for i, name in enumerate(names, 1):
        result = step(name)
        if told:
            told(i, len(names), name)
        yield name, result
