"""Passages as rows of tokens, compounds as rows of parts, and concepts of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import normalize_gloss


def tokenize(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, token_no, surface, normalized, n_parts``: words in order without the marks around them."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    placed = rows.select(*keys, F.posexplode(F.filter(bare, lambda w: w != "")).alias("token_no", "surface"))
    parts = F.size(F.split("surface", "[-‐]"))
    return placed.select(*keys, "token_no", "surface", normalize_gloss(F.col("surface")).alias("normalized"), parts.alias("n_parts"))


def compound_parts(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each part of a hyphenated token, in order; tokens in one part give none."""
    parts = F.filter(F.split("surface", "[-‐]"), lambda p: p != "")
    return tokens.filter("n_parts > 1").select(*keys, "token_no", F.posexplode(parts).alias("part_no", "part"))


def contained_relations(contained: DataFrame) -> DataFrame:
    """Both directions of each containment: ``source_id, target_id, relation_type``."""
    pair = lambda a, b, kind: F.struct(F.col(a).alias("source_id"), F.col(b).alias("target_id"), F.lit(kind).alias("relation_type"))
    both = F.array(pair("parent_work_id", "contained_work_id", "contains"), pair("contained_work_id", "parent_work_id", "contained_in"))
    return contained.select(F.inline(both))


def concepts_of(features: DataFrame, keys: list[str], concepts: DataFrame) -> DataFrame:
    """Concept ids of a ``features`` map by a table ``feature, value, concept_id``."""
    each = features.select(*keys, F.explode("features").alias("feature", "value"))
    found = each.join(concepts, ["feature", "value"])
    return found.groupBy(*keys).agg(F.array_sort(F.collect_set("concept_id")).alias("concept_ids"))


def merge_answers(rows: DataFrame, answers: DataFrame, key: str, order: Column) -> DataFrame:
    """Rows with the best answer that batches of an outside classifier gave for their key; ``answered`` tells whether there is one."""
    columns = [c for c in answers.columns if c != key]
    best = answers.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_a"))
    return rows.join(best, key, "left").select("*", F.col("_a").isNotNull().alias("answered"), *(F.col("_a")[c].alias(f"answer_{c}") for c in columns)).drop("_a")
