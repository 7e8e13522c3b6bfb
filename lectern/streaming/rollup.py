"""Request rollups and limits, over batches and streams alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.dml import merge_counts


def minute_rollup(events: DataFrame, ts: str, keys: list[str], cost: Column, flags: dict[str, Column], seconds: int = 60) -> DataFrame:
    """Counts, cost and flags of each tumbling window and key, and a bit for each second of it that had an event.

    All aggregates combine before the shuffle, so a hot key sends one row from each task.
    """
    t = F.unix_timestamp(F.col(ts).cast("timestamp"))
    start = (F.floor(t / seconds) * seconds).cast("bigint")
    bit = F.when(t - start < 60, F.call_function("shiftleft", F.lit(1).cast("bigint"), (t - start).cast("int"))).otherwise(0)
    rows = events.select(start.alias("window_start"), *keys, cost.alias("_cost"), bit.alias("_bit"), *(c.alias(k) for k, c in flags.items()))
    return rows.groupBy("window_start", *keys).agg(
        F.count("*").alias("requests"),
        F.sum("_cost").alias("cost"),
        *(F.count_if(k).alias(k) for k in flags),
        F.bit_or("_bit").alias("second_bits"),
    )


def watermarked_rollup(stream: DataFrame, ts: str, keys: list[str], cost: Column, width: str = "60 seconds", delay: str = "10 minutes") -> DataFrame:
    """The rollup as a stateful stream: a window is given out once no event may come for it any more; later events are dropped.

    ``minute_rollup`` with ``merge_into`` adds late events to their window instead, as long as they come.
    """
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    grouped = timed.groupBy(F.window("_ts", width), *keys).agg(F.count("*").alias("requests"), F.sum(cost).alias("cost"))
    return grouped.select(F.unix_timestamp("window.start").alias("window_start"), *keys, "requests", "cost")


def merge_into(keys: list[str], sums: list[str], bits: list[str], read: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None]):
    """A ``foreachBatch`` function that adds a batch's rollup to a stored one.

    ``write`` gets the batch id too: a store that remembers the last id takes a batch that is sent again only once.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        now = read()
        write(batch if now is None else merge_counts(now, batch, keys, sums, bits), batch_id)

    return merge


def limit_windows(events: DataFrame, key: str, ts: str, width_s: int) -> DataFrame:
    """The rows with ``window_start``: a key's first window opens at its first event, the next at the first event at least
    ``width_s`` seconds after the last one opened.

    A pause of that length opens a window whatever came before, so a key's events are first cut at such pauses (a JVM window, which
    spills), and the pieces are dealt out, sorted and walked through in Arrow batches; only the open window's start is carried
    from batch to batch.
    """
    import numpy as np
    import pyarrow as pa

    width = width_s * 1_000_000
    w = Window.partitionBy(key).orderBy("_t")
    begins = F.coalesce(F.col("_t") - F.lag("_t").over(w) >= width, F.lit(True))
    timed = events.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_first", F.row_number().over(w) == 1)
    pieces = timed.withColumn("_begins", F.col("_first") | begins).drop("_first")
    pieces = pieces.withColumn("_piece", F.sum(F.col("_begins").cast("int")).over(w))
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # of equal times the one that begins the piece comes first
    dealt = pieces.repartition(n, key, "_piece").sortWithinPartitions(key, "_piece", "_t", F.desc("_begins"))
    out = events.withColumn("window_start", F.lit(0).cast("bigint"))
    names = events.columns

    def walk(batches):
        open_at = 0
        for batch in batches:
            t = batch.column("_t").to_numpy()
            starts = np.empty(len(t), np.int64)
            begins = np.flatnonzero(batch.column("_begins").to_numpy(zero_copy_only=False))
            for k, (a, b) in enumerate(zip([0, *begins], [*begins, len(t)], strict=True)):
                at = a
                if k and at < b:  # before the first beginning, the last batch's window goes on
                    open_at = int(t[a])
                while at < b:
                    to = a + int(np.searchsorted(t[a:b], open_at + width, side="left"))
                    if to > at:
                        starts[at:to] = open_at
                        at = to
                    if at < b:
                        open_at = int(t[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(starts)], names=[*names, "window_start"])

    return dealt.mapInArrow(walk, out.schema)


def over_limit(rows: DataFrame, key: str, ts: str, cost: Column, limit: int) -> DataFrame:
    """The rows with the cost used in their window so far (each at least 1) and whether that is over the limit."""
    w = Window.partitionBy(key, "window_start").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.greatest(cost, F.lit(1))).over(w)
    return rows.withColumn("used", used).withColumn("limited", F.col("used") > limit)
