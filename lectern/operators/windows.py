"""Operators on ordered rows: context, navigation, spans, budgets, islands, neighborhoods.

Every window is partitioned by the key whose order it needs, and keys are works or conversations, never the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import intervals
from lectern.operators.numbering import row_numbers


def navigation(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The rows with the previous and next ``value`` in each key's order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.select("*", F.lag(value).over(w).alias(f"prev_{value}"), F.lead(value).over(w).alias(f"next_{value}"))


def around(rows: DataFrame, keys: list[str], order: list[str], is_anchor: Column, radius: int) -> DataFrame:
    """The rows within ``radius`` places of the key's first anchor row, with their ``offset`` from it."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumn("_rn", F.row_number().over(w.orderBy(*order)))
    at = F.min(F.when(is_anchor, F.col("_rn"))).over(w)
    placed = numbered.withColumn("offset", (F.col("_rn") - at).cast("bigint"))
    return placed.filter(F.abs("offset") <= radius).drop("_rn")


def context(rows: DataFrame, keys: list[str], order: list[str], item: Column, k: int) -> DataFrame:
    """The rows with arrays of the ``k`` items before and after each."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.select(
        "*",
        F.collect_list(item).over(w.rowsBetween(-k, -1)).alias("before"),
        F.collect_list(item).over(w.rowsBetween(1, k)).alias("after"),
    )


def spans(rows: DataFrame, keys: list[str], place: str, starts: Column) -> DataFrame:
    """For each start row the span up to the place before the next start, or to the key's last place."""
    w = Window.partitionBy(*keys)
    last = rows.withColumn("_last", F.max(place).over(w)).filter(starts)
    end = F.coalesce(F.lead(place).over(w.orderBy(place)) - 1, F.col("_last"))
    return last.select(*keys, F.col(place).alias("span_start"), end.alias("span_end"))


def in_spans(rows: DataFrame, found: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Rows with the spans that hold them, or nulls: a join by nested bins, so spans of any length take a few rows."""
    held = intervals.places_in(rows, found, keys, place, "span_start", "span_end").select(*rows.columns, "span_start", "span_end")
    rest = rows.join(held.select(*keys, place).distinct(), [*keys, place], "left_anti")
    empty = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("span_start", "span_end")]
    return held.unionByName(rest.select(*rows.columns, *empty))


def budget_prefix(rows: DataFrame, keys: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """Each key's first rows whose sizes sum up to the budget; always the first row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    used = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.select("*", used.alias("used"), F.row_number().over(w).alias("rn"))
    return out.filter((F.col("rn") == 1) | (F.col("used") <= budget))


def budget_around(rows: DataFrame, key: str, place: str, size: str, anchor: int, budget: int) -> DataFrame:
    """Greedy growth from the first row at the anchor place, one row before, one after, in turn, while the budget holds; a side that
    doesn't fit ends.

    The k-th row before comes at step 2k - 1 and the k-th after at 2k.  While both sides grow, a step's total is that of all
    steps so far, a running sum; the side that first doesn't fit ends at its step, and from there on the other one's running
    sum goes on beside what the ended side has.  So it takes a few windows over a key and no step-by-step walk.
    """
    per_key = Window.partitionBy(key)
    at = F.min(F.when(F.col(place) == anchor, F.col("_rn"))).over(per_key)
    numbered = rows.select(key, place, size).withColumn("_rn", F.row_number().over(per_key.orderBy(place)))
    off = numbered.withColumn("_d", F.col("_rn") - at).filter(F.col("_d").isNotNull())
    off = off.withColumn("_step", F.when(F.col("_d") < 0, -2 * F.col("_d") - 1).otherwise(2 * F.col("_d")))
    before = F.col("_d") < 0
    total = F.sum(size).over(per_key.orderBy("_step").rowsBetween(Window.unboundedPreceding, 0))
    own = F.sum(F.when(F.col("_d") != 0, F.col(size))).over(Window.partitionBy(key, before).orderBy("_step").rowsBetween(Window.unboundedPreceding, 0))
    summed = off.select("*", total.alias("_total"), own.alias("_own"), before.alias("_before"))
    # a side ends at the first step that doesn't fit, or at the step after its last row
    last = lambda side: F.coalesce(F.max(F.when(side & (F.col("_d") != 0), F.col("_step"))).over(per_key), F.lit(0))
    ends = summed.select(
        "*",
        F.min(F.when((F.col("_total") > budget) & (F.col("_d") != 0), F.col("_step"))).over(per_key).alias("_over"),
        last(F.col("_before")).alias("_last_b"),
        last(~F.col("_before")).alias("_last_a"),
        F.max(F.when(F.col("_d") == 0, F.col(size))).over(per_key).alias("_first"),
    )
    end_b = F.when(F.col("_last_b") == 0, 1).otherwise(F.col("_last_b") + 2)
    end_a = F.col("_last_a") + 2
    # the first side that ends, by the budget or by its rows: its step, and whether it is the one before
    stop = F.least(F.coalesce(F.col("_over"), end_b), end_b, end_a)
    marked = ends.withColumn("_stop", stop)
    done = marked.withColumn("_ended_before", F.col("_stop") % 2 == 1)
    # what the ended side has by then, and the other side's rows beside it
    fixed = F.coalesce(F.max(F.when((F.col("_before") == F.col("_ended_before")) & (F.col("_d") != 0) & (F.col("_step") < F.col("_stop")), F.col("_own"))).over(per_key), F.lit(0))
    chosen = done.withColumn("_fixed", fixed)
    ended_side = F.col("_before") == F.col("_ended_before")
    fits = F.when(F.col("_d") == 0, True).when(ended_side, F.col("_step") < F.col("_stop")).otherwise(
        (F.col("_step") < F.col("_stop")) | (F.col("_first") + F.col("_fixed") + F.col("_own") <= budget)
    )
    return chosen.filter(fits).select(key, place, size)


def islands(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbouring values: value, number of rows, first and last place of the order's first column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = rows.withColumn("_change", change).withColumn("island", F.sum("_change").over(w))
    return marked.groupBy(*keys, "island", value).agg(
        F.count("*").alias("n_rows"), F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at")
    )


def neighborhood(rows: DataFrame, order: list[str], anchor: tuple, radius: int) -> DataFrame:
    """The ``radius`` rows before the anchor key and as many from it on, with their ``position`` (from -radius).

    Keys compare as structs, column by column; each side is a top-k, which needs no sort of the table.
    """
    key = F.struct(*order)
    at = F.struct(*(F.lit(v).alias(c) for c, v in zip(order, anchor, strict=True)))
    below = rows.filter(key < at).orderBy(*(F.desc(c) for c in order)).limit(radius)
    above = rows.filter(key >= at).orderBy(*order).limit(radius + 1)
    n = F.row_number()
    down, up = Window.orderBy(*(F.desc(c) for c in order)), Window.orderBy(*order)
    return below.withColumn("position", -n.over(down).cast("bigint")).unionByName(
        above.withColumn("position", (n.over(up) - 1).cast("bigint"))
    )


def best_rows(rows: DataFrame, keys: list[str], order: list, k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key in an order, with their ``rank``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def interleave(rows: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Round robin over the sources: each row's ``turn`` within its source; sort by turn and source to read it.

    A source may hold most rows, so turns are numbered by ranges instead of one window for each source.
    """
    return row_numbers(rows, [source], order, "turn")


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def cursor_offset(cursor: str | None) -> int:
    """The offset in a cursor; anything else than a natural number is the start."""
    return int(cursor) if cursor and cursor.isdigit() else 0
