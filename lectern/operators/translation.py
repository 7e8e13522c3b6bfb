"""Cached translations of dictionary entries, and what claims gain from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["source_lexicon", "entry_id", "occurrence"]


def project(entries: DataFrame, cache: DataFrame, language: str, model: str) -> DataFrame:
    """Entries (KEYS, ``source_text``) with the newest good translation of their very text."""
    good = cache.filter((F.col("status") == "ok") & (F.col("target_lang") == language) & (F.col("model") == model))
    newest = good.groupBy(*KEYS, "source_text_hash").agg(F.max_by("translated_text", F.struct("updated_at", "translation_id")).alias("translated_text"))
    keyed = entries.withColumn("source_text_hash", F.sha2("source_text", 256))
    return keyed.join(newest, [*KEYS, "source_text_hash"], "left")


def missing(projected: DataFrame) -> DataFrame:
    """What an injected translator would have to do."""
    return projected.filter(F.col("translated_text").isNull() & (F.trim(F.coalesce("source_text", F.lit(""))) != ""))


def status_counts(projected: DataFrame) -> DataFrame:
    blank = F.trim(F.coalesce("source_text", F.lit(""))) == ""
    return projected.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("translated_text").isNotNull()).alias("hits"),
        F.count_if(F.col("translated_text").isNull() & ~blank).alias("missing"),
        F.count_if(blank).alias("empty"),
    )


def merge_translated(buckets: DataFrame, witnesses: DataFrame) -> DataFrame:
    """Buckets (``bucket_id``) with ``behind``: the one translated bucket that all their witnesses map to, if there is one.

    ``witnesses``: ``bucket_id, derived_bucket`` - null where a witness has no translation.
    """
    told = witnesses.groupBy("bucket_id").agg(
        F.count("*").alias("n"), F.count("derived_bucket").alias("mapped"), F.countDistinct("derived_bucket").alias("kinds"), F.min("derived_bucket").alias("to")
    )
    whole = (F.col("kinds") == 1) & (F.col("mapped") == F.col("n"))
    return buckets.join(told.select("bucket_id", F.when(whole, F.col("to")).alias("behind")), "bucket_id", "left")


def retry_generation(rejections: DataFrame, keys: list[str]) -> DataFrame:
    """How often each key was rejected: the generation its next translation is cached under."""
    return rejections.groupBy(*keys).agg(F.count("*").alias("generation"))
