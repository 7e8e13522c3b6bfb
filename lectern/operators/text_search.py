"""Ranked, phrase and fuzzy search over postings.

Searches over texts as they are; ``lectern.operators.search`` searches a stored index.  Scores are BM25 with ``K1`` and ``B``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.storage import cut

K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def postings(docs: DataFrame, key: str, text: str, only: list[str] | None = None) -> DataFrame:
    """``key, term, tf, doc_length``; with ``only`` just for these terms, dropped before any shuffle."""
    own = docs.select(key, F.explode(F.array(terms(F.col(text)))).alias("_terms"))
    own = own.select(key, F.size("_terms").cast("bigint").alias("doc_length"), F.explode("_terms").alias("term"))
    if only is not None:
        own = own.filter(F.col("term").isin(only))
    return own.groupBy(key, "term", "doc_length").agg(F.count("*").alias("tf"))


def statistics(docs: DataFrame, text: str) -> DataFrame:
    """One row: ``n_docs, mean_length``."""
    return docs.agg(
        F.count("*").alias("n_docs"), F.avg(F.size(terms(F.col(text))).cast("double")).alias("mean_length")
    )


def _equals(word: str):
    return lambda x: x == word


def bm25_score(tf: Column, df: Column, length: Column, n: Column, mean: Column) -> Column:
    """What one term adds to a document's score."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def bm25(docs: DataFrame, key: str, text: str, query: list[str]) -> DataFrame:
    """``key, score`` of every document with a query term, without an index: texts are cut into terms once."""
    query = list(dict.fromkeys(query))
    own = docs.select(key, F.explode(F.array(terms(F.col(text)))).alias("_t"))
    held = [F.size(F.filter("_t", _equals(q))).cast("bigint").alias(f"_{i}") for i, q in enumerate(query)]
    counted = cut(own.select(key, F.size("_t").cast("bigint").alias("_n"), *held))
    whole = counted.agg(
        F.count("*").alias("n"), F.avg(F.col("_n").cast("double")).alias("mean"), *(F.count_if(F.col(f"_{i}") > 0).alias(f"df{i}") for i in range(len(query)))
    ).first()
    value = lambda name: F.lit(whole[name])
    some, score = F.lit(False), F.lit(0.0)
    for i in range(len(query)):
        has = F.col(f"_{i}") > 0
        some = some | has
        score = score + F.when(has, bm25_score(F.col(f"_{i}"), value(f"df{i}"), F.col("_n"), value("n"), value("mean"))).otherwise(0.0)
    return counted.filter(some).select(key, score.alias("score"))


def phrase_hits(docs: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """``key, hits``: places where the words stand one after the other, by shifted positions."""
    placed = docs.select(key, F.posexplode(terms(F.col(text))).alias("pos", "term")).filter(F.col("term").isin(words))
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(words)))
    starts = placed.withColumn("x", F.explode(F.filter(wanted, lambda x: x["w"] == F.col("term")))).select(
        key, (F.col("pos") - F.col("x.i")).alias("start")
    )
    full = starts.groupBy(key, "start").agg(F.count("*").alias("n")).filter(F.col("n") == len(words))
    return full.groupBy(key).agg(F.count("*").alias("hits"))


def fuzzy_hits(docs: DataFrame, key: str, text: str, candidates: list[str]) -> DataFrame:
    """``key, matched, rank``: the first of the candidates, in their order, that each document holds."""
    ranks = F.array(*(F.lit(c) for c in candidates))
    held = F.filter(ranks, lambda c: F.array_contains(F.col("_terms"), c))
    own = docs.select(key, F.explode(F.array(terms(F.col(text)))).alias("_terms")).select(key, F.get(held, 0).alias("matched"))
    return own.filter(F.col("matched").isNotNull()).withColumn(
        "rank", F.array_position(ranks, F.col("matched")).cast("bigint")
    )


def near_terms(docs: DataFrame, key: str, text: str, word: str, distance: int) -> DataFrame:
    """``term, distance, df``: the corpus's terms within an edit distance of a word."""
    low, high = len(word) - distance, len(word) + distance
    own = docs.select(key, F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))
    own = own.filter(F.length("term").between(low, high) & (F.levenshtein("term", F.lit(word)) <= distance))
    found = own.groupBy("term").agg(F.count("*").alias("df"))
    return found.withColumn("distance", F.levenshtein("term", F.lit(word)).cast("bigint"))


def index_issues(meta: DataFrame, expected: dict[str, str]) -> DataFrame:
    """A row for each expected key whose stored value is missing or another."""
    spark = meta.sparkSession
    wanted = spark.createDataFrame(list(expected.items()), "key string, expected string")
    return wanted.join(meta, "key", "left").filter(~F.col("value").eqNullSafe(F.col("expected")))


def attach_context(hits: DataFrame, segments: DataFrame, keys: list[str], place: str, item: str, k: int) -> DataFrame:
    """Hits with up to ``k`` items before and after, by strictly smaller and larger places.

    Only keys with a hit are looked at; distinct places are numbered, and a frame holds those of ``k`` places, not a whole work.
    """
    own = segments.select(*keys, place, item).join(hits.select(*keys).distinct(), keys, "left_semi")
    numbered = own.withColumn("_no", F.dense_rank().over(Window.partitionBy(*keys).orderBy(place)))
    order = Window.partitionBy(*keys).orderBy("_no")
    sides = numbered.select(
        *keys,
        place,
        F.collect_list(item).over(order.rangeBetween(-k, -1)).alias("_b"),
        F.collect_list(item).over(order.rangeBetween(1, k)).alias("_a"),
    )
    n = F.size("_b")
    near = sides.withColumn("before", F.slice("_b", F.greatest(n - k + 1, F.lit(1)), F.least(n, F.lit(k)))).withColumn(
        "after", F.slice("_a", 1, k)
    )
    return hits.join(near.drop("_a", "_b").dropDuplicates([*keys, place]), [*keys, place])
