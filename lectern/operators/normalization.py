"""A table of normalized queries, kept by deltas.

A query's candidates are stored with the normalizer's version and the day.  ``refresh`` finds what isn't there, is of another version or too old,
normalizes that alone and gives the delta; ``merged`` puts it into the table.  ``answers`` joins requests with the table and ranks each one's
candidates: those that other tools than the local one give first, then by how often their lemma is known, then as the normalizer gave them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import stable_id

CANDIDATES = "array<struct<lemma:string,source:string>>"
STORED = f"query_key string, query string, language string, candidates {CANDIDATES}, normalizer_version string, day int"
#: The source of candidates that no tool has confirmed.
LOCAL = "local"


def query_key(query: Column, language: Column) -> Column:
    """Equal for spellings that differ in case and white space."""
    low = F.trim(F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), r"\s+", " "))
    return stable_id("query:", F.coalesce(language, F.lit("")), low)


def refresh(requests: DataFrame, stored: DataFrame, normalize: Callable[[DataFrame], DataFrame], version: str, day: int, keep_days: int) -> DataFrame:
    """New rows of the table for requests (``query, language``) that it has no good row for.

    ``normalize`` gets ``query_key, query, language``, each key once, and returns ``query_key, candidates``; a key that it gives nothing for has
    no candidates, which is known from then on.
    """
    keyed = requests.select(query_key(F.col("query"), F.col("language")).alias("query_key"), "query", "language")
    wanted = keyed.groupBy("query_key").agg(F.min("query").alias("query"), F.min("language").alias("language"))
    good = stored.filter((F.col("normalizer_version") == version) & (F.col("day") > day - keep_days))
    stale = wanted.join(good.select("query_key"), "query_key", "left_anti")
    made = normalize(stale).select("query_key", F.col("candidates").cast(CANDIDATES).alias("candidates"))
    none = F.array().cast(CANDIDATES)
    told = stale.join(made, "query_key", "left").withColumn("candidates", F.coalesce("candidates", none))
    return told.select("query_key", "query", "language", "candidates", F.lit(version).alias("normalizer_version"), F.lit(day).alias("day"))


def merged(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """The table with a delta's rows in the place of older ones."""
    return stored.join(delta.select("query_key"), "query_key", "left_anti").select(*delta.columns).unionByName(delta)


def answers(requests: DataFrame, table: DataFrame, known: DataFrame) -> DataFrame:
    """``query, language, rank, lemma, source`` of each distinct request; ``known`` has ``lemma, times``."""
    asked = requests.select("query", "language").distinct().withColumn("query_key", query_key(F.col("query"), F.col("language")))
    each = asked.join(table.select("query_key", F.posexplode("candidates").alias("place", "c")), "query_key").select("query", "language", "place", "c.*")
    times = known.groupBy("lemma").agg(F.sum("times").alias("times"))
    weighed = each.join(times, "lemma", "left")
    order = Window.partitionBy("query", "language").orderBy((F.col("source") == LOCAL).asc(), F.desc(F.coalesce("times", F.lit(0))), "place")
    return weighed.withColumn("rank", F.row_number().over(order)).select("query", "language", "rank", "lemma", "source")
