"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strings(values: Iterable[str] = ()) -> Column:
    """A constant ARRAY<STRING>; without values the empty one."""
    return F.array(*map(F.lit, values)).cast("array<string>")


def listed(values: Column) -> Column:
    """A null list is the empty one."""
    return F.coalesce(values, strings())


def before(values: Column, stop: Callable[[Column], Column]) -> Column:
    """What stands before the first element for which ``stop`` holds; all of it where none does."""
    at = F.array_position(F.transform(values, lambda v: F.coalesce(stop(v), F.lit(False))), True).cast("int")
    return F.when(at > 0, F.slice(values, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(values)


def any_of(words: Iterable[str]) -> str:
    """An alternation of literal words, longest first; of none, what never matches."""
    escaped = [w.replace("\\", "\\\\").replace(".", r"\.").replace("(", r"\(").replace(")", r"\)").replace("+", r"\+") for w in sorted(words, key=lambda w: (-len(w), w))]
    return "|".join(escaped) or r"(?!)"


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, with as many underscores as it takes to be none of ``taken``."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name
