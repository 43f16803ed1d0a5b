"""Names for helper columns, and expressions that are computed once."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column has it, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``; inside ``body`` the value is a variable, so a lambda in it does not compute the value for every element."""
    return F.get(F.transform(F.array(value), body), 0)
