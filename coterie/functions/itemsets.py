"""Column functions over itemsets: canonical arrays, their text, immediate subsets, containment.

A set is its sorted array of items without repeats, and sets are grouped and joined by
that array. The text of a set joins its items by blanks; it is for reading alone, as
items may hold blanks themselves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands between the items in the text of a set.
SEPARATOR = " "


def text(items: Column) -> Column:
    """What is shown of a set: its items in their order, joined."""
    return F.array_join(items.cast("array<string>"), SEPARATOR)


def without_one(items: Column) -> Column:
    """All subsets of a sorted array that lack one item, sorted like it."""
    return F.transform(F.sequence(F.lit(0), F.size(items) - 1), lambda i: F.filter(items, lambda x, j: j != i))


def contains_all(items: Column, wanted: Column) -> Column:
    return F.size(F.array_except(wanted, items)) == 0


def contains_any(items: Column, wanted: Column) -> Column:
    return F.arrays_overlap(items, wanted)


def prefixes(items: Column) -> Column:
    """All non-empty prefixes of an array; an empty array has none."""
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(1), F.size(items)), lambda k: F.slice(items, 1, k))).otherwise(F.array().cast("array<array<string>>"))


def subsets(items: Column, most: int = 20) -> Column:
    """All non-empty subsets of an array of at most `most` items; a longer one raises."""
    n = F.size(items)
    mask = F.sequence(F.lit(1).cast("long"), F.pow(F.lit(2.0), n).cast("long") - 1)
    every = F.transform(mask, lambda m: F.filter(items, lambda x, j: F.pmod(F.floor(m / F.pow(F.lit(2.0), j)), F.lit(2)) == 1))
    fits = F.assert_true(n <= most, F.lit(f"a power set of more than {most} items was asked for"))
    return F.when(n == 0, F.array().cast("array<array<string>>")).when(fits.isNull(), every)
