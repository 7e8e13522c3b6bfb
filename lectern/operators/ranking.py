"""Sort keys for listings of senses, lemmas and candidates.  Each is a column, so a ranking is one ``orderBy`` or window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def preference_rank(value: Column, preferred: list[str]) -> Column:
    """Place of a value in a list of preferences; after all of them if it isn't there."""
    return F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(p) for p in preferred)), value), F.lit(0)), F.lit(len(preferred) + 1))


def overlap_rank(keys: Column, preferred: list[list[str]]) -> Column:
    """The first list of preferred keys that shares one with an array of keys."""
    hits = F.array(*(F.arrays_overlap(keys, F.array(*(F.lit(k) for k in p))) for p in preferred))
    return F.coalesce(F.nullif(F.array_position(hits, True), F.lit(0)), F.lit(len(preferred) + 1))


def rule_score(text: Column, rules: list[tuple[str, int]]) -> Column:
    """Sum of the points of the patterns that a text has."""
    total = F.lit(0)
    for pattern, points in rules:
        total = total + F.when(text.rlike(pattern), points).otherwise(0)
    return total


#: What learners are served worst by: cross references, sources without a gloss, abbreviations.
LEARNER_RULES = [(r"(?i)^(see|cf\.|vide)\b", 40), (r"(?i)\bid\.|\bibid\b", 15), (r"^\W*$", 60), (r"\d{2,}", 5), (r"(?i)\b(comp|var)\.", 10)]


def candidate_key(text: Column, candidate: Column) -> list[Column]:
    """Exact first, then a common start, then by edit distance, difference of lengths and the candidate itself."""
    a, b = F.lower(text), F.lower(candidate)
    return [(a != b).cast("int"), (~b.startswith(a)).cast("int"), F.levenshtein(a, b), F.abs(F.char_length(a) - F.char_length(b)), candidate]


def anchor_score(item: Column, query: str) -> Column:
    """How well an item fits a query as the place to open a list at."""
    low = F.lower(item)
    return F.greatest(
        F.when(item == query, 130).otherwise(0),
        F.when(low == query.lower(), 120).otherwise(0),
        F.when(low.startswith(query.lower()), 85).otherwise(0),
        F.when(low.contains(query.lower()), 60).otherwise(10),
    )


def explained(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows with a struct of their sort key's parts, to order by and to show."""
    return df.withColumn("ranking", F.struct(*(c.alias(k) for k, c in keys.items())))


def escalations(rows: DataFrame, key: str, order: str, reasons: dict[str, Column], priorities: dict[str, int], limit: int) -> DataFrame:
    """The first row of each key that has a reason, the highest priority first: a top-k report."""
    told = F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in reasons.items())), lambda r: r.isNotNull())
    points = F.create_map(*(F.lit(x) for kv in priorities.items() for x in kv))
    marked = rows.withColumn("reasons", told).filter(F.size("reasons") > 0)
    best = marked.groupBy(key).agg(F.min_by(F.struct(*marked.columns), order).alias("r")).select("r.*")
    scored = best.withColumn("priority", F.array_max(F.transform("reasons", lambda r: F.coalesce(points[r], F.lit(0)))))
    return scored.orderBy(F.desc("priority"), order).limit(limit)


def best_anchors(rows: DataFrame, keys: list[str], item: str, query: str, tie: str) -> DataFrame:
    """Of each key the row that fits a query best as the place to open a list at, with its ``score``."""
    scored = rows.withColumn("score", anchor_score(F.col(item), query))
    best = F.min_by(F.struct(item, tie, "score"), F.struct(-F.col("score"), F.col(tie))).alias("b")
    return scored.groupBy(*keys).agg(best).select(*keys, "b.*")


def exact_first(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose text begins with a prefix, and their ``exact_rank``: 0 for the prefix itself."""
    found = rows.filter(F.col(column).startswith(prefix))
    return found.withColumn("exact_rank", F.when(F.col(column) == prefix, 0).otherwise(1))


def needs(rows: DataFrame, keys: list[str], rules: dict[str, tuple[int, Column]]) -> DataFrame:
    """``keys, need, priority``: a row for each rule that holds."""
    made = F.array(*(F.when(c, F.struct(F.lit(name).alias("need"), F.lit(p).alias("priority"))) for name, (p, c) in rules.items()))
    return rows.select(*keys, F.inline(F.filter(made, lambda x: x.isNotNull())))


def reviewed(rows: DataFrame, keys: list[str], ambiguous: Column, local: Column, external: Column) -> DataFrame:
    """The rule reviewer: what is ambiguous goes to review, what local and external evidence both have is accepted."""
    agreed = ~ambiguous & local & external
    return rows.select(*keys, F.when(agreed, "accept").otherwise("needs_review").alias("status"), F.when(agreed, "high").otherwise("low").alias("confidence"))
