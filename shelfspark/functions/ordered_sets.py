"""Ordered-set algebra on arrays: members keep their first-seen order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered(items: Column) -> Column:
    return F.array_distinct(items)


def add(items: Column, member: Column) -> Column:
    return F.array_union(items, F.array(member))


def discard(items: Column, member: Column) -> Column:
    return F.array_remove(ordered(items), member)


def union(left: Column, right: Column) -> Column:
    return F.array_union(left, right)


def intersection(left: Column, right: Column) -> Column:
    return F.array_intersect(left, right)


def difference(left: Column, right: Column) -> Column:
    return F.array_except(left, right)


def symmetric_difference(left: Column, right: Column) -> Column:
    return F.concat(F.array_except(left, right), F.array_except(right, left))


def is_subset(left: Column, right: Column) -> Column:
    return F.size(F.array_except(left, right)) == 0


def is_superset(left: Column, right: Column) -> Column:
    return is_subset(right, left)


def is_proper_subset(left: Column, right: Column) -> Column:
    """Contained, and not the same list of members in the same order."""
    return is_subset(left, right) & (ordered(left) != ordered(right))


def is_proper_superset(left: Column, right: Column) -> Column:
    return is_proper_subset(right, left)
