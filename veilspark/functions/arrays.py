"""Column functions over arrays: bound values, and scans that carry a state along an array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a scan appends one by one before it closes a block, and blocks before it closes a group of them.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks(items: Column, size: int = BLOCK) -> Column:
    """``items`` cut into arrays of ``size`` at most; an empty array is one empty block."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(size)), lambda k: F.slice(items, k + 1, size))


def scan(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What ``step`` puts out along ``items``: step(state, item) gives the next state and an array of ``kind`` to add.

    Arrays can't grow in place: whatever adds to one copies it whole. So outputs are added within blocks, blocks within groups and groups to a
    list, and no array that is added to is long.
    """
    none, lists = F.expr(f"cast(array() as array<{kind}>)"), F.expr(f"cast(array() as array<array<{kind}>>)")

    def begun(state: Column, out: Column) -> Column:
        return F.struct(state.alias("s"), out.alias("o"))

    def one(a: Column, x: Column) -> Column:
        state, out = step(a["s"], x)
        return let(begun(state, out), lambda r: begun(r["s"], F.concat(a["o"], r["o"])))

    def block(a: Column, b: Column) -> Column:
        inner = F.aggregate(b, begun(a["s"], none), one)
        return let(inner, lambda r: begun(r["s"], F.array_append(a["o"], r["o"])))

    def group(a: Column, g: Column) -> Column:
        inner = F.aggregate(g, begun(a["s"], lists), block, lambda z: begun(z["s"], F.flatten(z["o"])))
        return let(inner, lambda r: begun(r["s"], F.array_append(a["o"], r["o"])))

    # bound, or every block would work its items out again
    groups = let(items, lambda v: let(blocks(v), lambda b: blocks(b)))
    return F.aggregate(groups, begun(start, lists), group, lambda a: F.flatten(a["o"]))
