"""Changes to keyed tables as DataFrames: the result is the new table, to be written beside the old one and swapped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(rows: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """The row of each key with the largest values of ``newest``, compared one after the other (null is smallest).

    An aggregate, so each task sends at most one row of a key.
    """
    best = F.max_by(F.struct(*rows.columns), F.struct(*newest)).alias("_row")
    return rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(best).select("_row.*")


def replace_by_key(table: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with an incoming key go, the incoming rows come."""
    return table.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def upsert_keeping(table: DataFrame, incoming: DataFrame, keys: list[str], kept: str) -> DataFrame:
    """Upsert in which a row that was there keeps its value of ``kept``."""
    old = table.select(*keys, F.col(kept).alias("_old"))
    fresh = incoming.join(old, keys, "left").withColumn(kept, F.coalesce("_old", kept)).drop("_old")
    return replace_by_key(table, fresh.select(*table.columns), keys)


def delete_cascade(tables: dict[str, DataFrame], ids: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the given ids."""
    return {name: t.join(ids.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def supersede(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows that no new row has the keys of."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti")


def overlay_changes(table: DataFrame, overlays: DataFrame, key: str, field: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """``key, kept columns of the table's rows, old, new, ord``: where accepted overlays (``key, value, ord``) differ from the table as it is."""
    return (
        table.join(overlays, key)
        .filter(~F.col(field).eqNullSafe(F.col("value")))
        .select(key, *kept, F.col(field).alias("old"), F.col("value").alias("new"), "ord")
    )


def apply_overlays(table: DataFrame, overlays: DataFrame, key: str, field: str) -> DataFrame:
    """The table with each key's last overlay in the field."""
    last = overlays.groupBy(key).agg(F.max_by("value", "ord").alias("_value"))
    return table.join(last, key, "left").withColumn(field, F.coalesce("_value", field)).select(*table.columns)


def tiered_lookup(wanted: DataFrame, cache: DataFrame, keys: list[str], tier: Column, newest: list[Column]) -> DataFrame:
    """For each wanted row the cached row of the best tier (null: no match), the newest of equals."""
    joined = wanted.join(cache, keys).withColumn("tier", tier).filter(F.col("tier").isNotNull())
    w = Window.partitionBy(*wanted.columns).orderBy("tier", *newest)
    return joined.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def merge_counts(table: DataFrame, delta: DataFrame, keys: list[str], sums: list[str], bits: list[str] = []) -> DataFrame:  # noqa: B006
    """Additive upsert: sums add up, bit sets are joined."""
    both = table.select(*keys, *sums, *bits).unionByName(delta.select(*keys, *sums, *bits))
    return both.groupBy(*keys).agg(
        *(F.sum(c).cast("bigint").alias(c) for c in sums), *(F.bit_or(c).alias(c) for c in bits)
    )
