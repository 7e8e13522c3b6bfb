"""Joins of places with intervals, and of intervals with each other, by nested bins.

The bins of level ``k`` are ``RADIX ** k`` places long, each within one of the next level.  An interval is the union of a few bins, at most
``2 * (RADIX - 1)`` of each level, whatever its length; a place lies in one bin of each level.  So a place and an interval that holds it meet
in exactly one bin: the join is an equi-join on key, level and bin.  Places are sent to as many levels as the longest interval needs, the
logarithm of its length in the shortest bins.  These are as long as leaves few of a key's places together in one, whatever the unit and
wherever the places crowd; only an interval's two end bins can hold places beside it, which a test of both ends drops.

Intervals are closed at both ends; one that ends before it starts holds nothing, and a null start, end, place or key meets nothing.
Any number of intervals may hold a place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits by which a level's bins are longer than the last one's.
BITS = 2
RADIX = 1 << BITS
#: Longer bins wouldn't be 64-bit numbers; of the longest ones an interval has 16 at most.
MOST_LEVELS = 31
#: So many places may share a shortest bin with an average place.
MOST_TOGETHER = 4


def _levels(found: DataFrame, start: str, end: str) -> int:
    """How many levels intervals of these lengths need."""
    # as decimals, since a length may be beyond 64 bits
    length = F.col(end).cast("decimal(20)") - F.col(start).cast("decimal(20)") + 1
    longest = int(found.agg(F.max(length)).first()[0] or 1)
    return min(MOST_LEVELS, max(1, -(-(max(1, longest).bit_length() + 1) // BITS)))


def _shortest_bits(rows: DataFrame, keys: list[str], place: str) -> int:
    """The shortest bins are 2 to this power places long: as a key's places lie apart on average, less where they crowd."""
    at = rows.select(*keys, F.col(place).cast("bigint").alias("_at")).filter(F.col("_at").isNotNull())
    of_key = at.groupBy(*keys).agg(F.count("*").alias("n"), (F.max("_at").cast("decimal(20)") - F.min("_at").cast("decimal(20)")).alias("width"))
    n, width = of_key.agg(F.sum("n"), F.sum("width")).first()
    bits = min(BITS * MOST_LEVELS, max(1, int(width or 0) // max(1, n or 0)).bit_length() - 1)
    while bits > 0:
        together = at.groupBy(*keys, F.shiftright("_at", bits).alias("_bin")).agg(F.count("*").cast("double").alias("n"))
        mates = together.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0
        if mates <= MOST_TOGETHER:
            break
        bits = max(0, bits - max(2, int(mates / MOST_TOGETHER).bit_length()))
    return bits


def _shifted(c: Column, level: int) -> Column:
    return F.shiftright(c, BITS * level) if level else c


def _at_level(level: int):
    return lambda b: F.struct(F.lit(level).alias("_level"), b.alias("_bin"))


def _own_bins(start: Column, end: Column, levels: int) -> Column:
    """Array of ``level, bin``: the bins that make the interval up, none within another."""
    # bins from first[k] to last[k] lie within the interval as a whole; those within bins of the next level are left to it
    first = [F.when(start == _shifted(start, k) * RADIX**k, _shifted(start, k)).otherwise(_shifted(start, k) + 1) if k else start for k in range(levels)]
    last = [F.when(end == _shifted(end, k) * RADIX**k + (RADIX**k - 1), _shifted(end, k)).otherwise(_shifted(end, k) - 1) if k else end for k in range(levels)]
    none = F.array().cast("array<bigint>")
    sides = []
    for k in range(levels):
        left, right = last[k], last[k] + 1
        if k + 1 < levels:
            above = first[k + 1] <= last[k + 1]
            left = F.when(above, first[k + 1] * RADIX - 1).otherwise(left)
            right = F.when(above, last[k + 1] * RADIX + RADIX).otherwise(right)
        some = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(none)
        bins = F.concat(some(first[k], left), some(right, last[k]))
        sides.append(F.transform(bins, _at_level(k)))
    return F.when(start <= end, F.concat(*sides))


def _place_bins(place: Column, levels: int) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("_level"), _shifted(place, k).alias("_bin")) for k in range(levels)))


def places_in(rows: DataFrame, found: DataFrame, keys: list[str], place: str, start: str, end: str) -> DataFrame:
    """Each row with each interval of its key that holds its place: the rows' columns and those of ``found``."""
    bits = _shortest_bits(rows, keys, place)
    short = lambda c: F.shiftright(F.col(c).cast("bigint"), bits) if bits else F.col(c).cast("bigint")
    levels = _levels(found.select(short(start).alias(start), short(end).alias(end)), start, end)
    spread = rows.withColumn("_at", F.explode(_place_bins(short(place), levels))).filter(F.col(place).isNotNull())
    binned = found.withColumn("_at", F.explode(_own_bins(short(start), short(end), levels)))
    level_and_bin = lambda df: df.select("*", "_at._level", "_at._bin").drop("_at")
    # a side whose file is small can be many rows here: never broadcast by its file's size
    held = level_and_bin(spread).alias("_row").hint("merge").join(level_and_bin(binned).alias("_held_by"), [*keys, "_level", "_bin"])
    at = F.col(f"_row.{place}").cast("bigint")
    if bits:
        held = held.filter((F.col(f"_held_by.{start}").cast("bigint") <= at) & (at <= F.col(f"_held_by.{end}").cast("bigint")))
    return held.drop("_level", "_bin")


def overlapping(one: DataFrame, two: DataFrame, keys: list[str], start: str, end: str, prefix: str = "other_") -> DataFrame:
    """Each interval of ``one`` with each of ``two`` that has a place in common with it; ``two``'s columns get the prefix.

    Of two overlapping intervals one holds the other's start: both do only where they start together, which counts once.
    """
    names = {c: f"{prefix}{c}" for c in two.columns if c not in keys}
    other = two.toDF(*(names.get(c, c) for c in two.columns)).filter(F.col(names[start]) <= F.col(names[end]))
    own = one.filter(F.col(start) <= F.col(end))
    columns = [*one.columns, *names.values()]
    late = places_in(other, own, keys, names[start], start, end).select(*columns)
    early = places_in(own, other, keys, start, names[start], names[end]).filter(F.col(start) > F.col(names[start])).select(*columns)
    return late.unionByName(early)
