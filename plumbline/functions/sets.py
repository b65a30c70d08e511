"""Sets of sources as sorted arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays; two empty sets are equal: 1."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(1.0))


def subset(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_except(a, b)) == 0


def same(a: Column | str, b: Column | str) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def parse_ranges(x: Column | str) -> Column:
    """`1-3,7` as an array of whole numbers, sorted and distinct."""
    part = lambda p: F.split(F.trim(p), "-")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(x, ","), lambda p: F.sequence(F.get(part(p), F.lit(0)).cast("int"), F.element_at(part(p), -1).cast("int"))))))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON of a struct with its keys sorted and no blanks (F25): equal documents give equal text, and so equal hashes."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
