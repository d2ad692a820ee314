"""Set operations on paths per task. Inputs are arrays of strings; null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def paths(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.expr("cast(array() as array<string>)"))


def snapshot_scope(allow: Column, new: Column, tracked: Column, handoff: Column) -> Column:
    """What a new task takes fingerprints of: tracked paths that are allowed, new ones, the hand-off."""
    return F.array_sort(F.array_union(F.array_union(F.array_intersect(allow, tracked), new), F.array(handoff)))


def joined(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def differing(over: Column, a: Column, b: Column) -> Column:
    """Paths whose fingerprints differ between two maps; absent equals absent."""
    return F.filter(over, lambda p: ~F.try_element_at(a, p).eqNullSafe(F.try_element_at(b, p)))
