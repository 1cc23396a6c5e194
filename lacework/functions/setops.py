"""Set operations on sorted arrays of vertex ids, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersect(a: Column, b: Column) -> Column:
    """The ids in both, in the order of a."""
    return F.array_intersect(a, b)


def intersect_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("long")


def difference(a: Column, b: Column) -> Column:
    """The ids of a that aren't in b."""
    return F.array_except(a, b)


def bounded_intersect(a: Column, b: Column, upper: Column) -> Column:
    """The ids in both that are below upper."""
    return F.filter(F.array_intersect(a, b), lambda x: x < upper)


def bounded_difference(a: Column, b: Column, upper: Column) -> Column:
    """The ids of a below upper that aren't in b."""
    return F.filter(F.array_except(a, b), lambda x: x < upper)


def count_below(a: Column, upper: Column) -> Column:
    """How many ids are below upper."""
    return F.size(F.filter(a, lambda x: x < upper)).cast("long")


def count_up_to(a: Column, lower: Column) -> Column:
    """How many ids are at most lower: what is left behind when only larger ids may follow."""
    return F.size(F.filter(a, lambda x: x <= lower)).cast("long")
