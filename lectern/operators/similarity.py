"""Similarity of short texts: joins on tokens, and the clusters they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import cosine, dice, jaccard, normalize_gloss, tokens
from lectern.operators.graph import components
from lectern.storage import cut


#: Thresholds of the two modes, and which source speaks first for a cluster.
MODES = {"open": 0.25, "skeptic": 0.5}
SOURCE_PRIORITY = {
    "dico": 1, "gaffiot": 1, "georges_1913": 1, "cdsl": 2, "mw": 2, "ap90": 3, "whitaker": 4, "whitakers": 4,
    "diogenes": 5, "lsj": 5, "lewis_short": 5, "heritage": 6, "cltk": 7,
}


def representatives(members: DataFrame, cluster: str, tool: str, sense: str, key: str) -> DataFrame:
    """``cluster, representative``: of each cluster the member with the first source, then tool, sense and key."""
    known = F.create_map(*(F.lit(x) for kv in SOURCE_PRIORITY.items() for x in kv))
    order = F.struct(F.coalesce(known[F.col(tool)], F.lit(100)), tool, sense, key)
    return members.groupBy(cluster).agg(F.min_by(key, order).alias("representative"))


METRICS = {"jaccard": jaccard, "dice": dice, "cosine": cosine}


def text_classes(items: DataFrame, key: str, text: str, bags: bool = False) -> DataFrame:
    """``id, tokens, rep``: the items with a token, and the least id of those with the same tokens (with ``bags``, as often)."""
    own = tokens(F.col(text))
    own = F.array_sort(own if bags else F.array_distinct(own))
    rows = items.select(F.col(key).alias("id"), own.alias("tokens")).filter(F.size("tokens") > 0)
    reps = rows.groupBy("tokens").agg(F.min("id").alias("rep"))
    return rows.join(reps, "tokens").select("id", "tokens", "rep")


def similar_pairs(items: DataFrame, key: str, text: str, threshold: float, metric: str = "jaccard") -> DataFrame:
    """``a, b, score``: pairs (a < b) whose tokens have a similarity of at least ``threshold``; of items with the same tokens the
    one with the least key stands for all in these pairs, and the others have one pair with it.

    An exact prefix join: with tokens ordered from the rarest, what two sets share has to have a certain mass, so they share a token that
    comes before the last ones which haven't that much together.  Only those few rare tokens are join keys and
    frequent ones never are, and only pairs that meet there are compared.  Mass is the number of tokens, for ``cosine`` the squares of
    their counts.
    """
    rows = cut(text_classes(items, key, text, metric == "cosine"))
    sets = rows.filter("id = rep").select("id", "tokens")
    each = sets.select("id", F.explode("tokens").alias("token")).groupBy("id", "token").agg(F.count("*").alias("c"))
    mass = F.col("c") * F.col("c") if metric == "cosine" else F.lit(1)
    counts = each.groupBy("token").agg(F.count("*").alias("n"))
    ranked = each.join(counts, "token").select("id", "token", "n", mass.cast("double").alias("mass"))
    rarest = Window.partitionBy("id").orderBy("n", "token")
    after = F.sum("mass").over(rarest.rowsBetween(0, Window.unboundedFollowing))
    whole = F.sum("mass").over(Window.partitionBy("id"))
    share = {"jaccard": threshold, "dice": threshold / (2 - threshold), "cosine": threshold * threshold}[metric]
    keyed = ranked.select("id", "token", whole.alias("n"), after.alias("after")).filter(F.col("after") >= share * F.col("n") - 1e-9)
    left, right = keyed.alias("l"), keyed.alias("r")
    met = (F.col("l.token") == F.col("r.token")) & (F.col("l.id") < F.col("r.id"))
    if metric != "cosine":  # a set can't share more than it has
        met = met & (F.col("l.n") >= share * F.col("r.n") - 1e-9) & (F.col("r.n") >= share * F.col("l.n") - 1e-9)
    pairs = left.join(right, met).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    a = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x"))
    b = sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    scored = pairs.join(a, "a").join(b, "b").select("a", "b", METRICS[metric](F.col("x"), F.col("y")).alias("score"))
    copies = rows.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))
    return scored.filter(F.col("score") >= threshold).unionByName(copies.filter(F.lit(threshold <= 1)))


def similarity_buckets(witnesses: DataFrame, mode: str = "open", metric: str = "jaccard") -> DataFrame:
    """Buckets of one language's witnesses (``language, witness_id, tool, sense, gloss, normalized``) that are connected by similar glosses:
    id, the first witness's glosses, members in order of their sources, label and note."""
    threshold = MODES[mode]
    roots = clusters(witnesses, "witness_id", similar_pairs(witnesses, "witness_id", "normalized", threshold, metric))
    known = F.create_map(*(F.lit(x) for kv in SOURCE_PRIORITY.items() for x in kv))
    order = F.struct(F.coalesce(known[F.col("tool")], F.lit(100)).alias("p"), "tool", "sense", "witness_id")
    found = witnesses.join(roots, "witness_id").groupBy("language", "cluster").agg(
        F.min_by(F.struct("normalized", "gloss"), order).alias("first"),
        F.array_sort(F.collect_list(order)).alias("ordered"),
        F.array_sort(F.collect_list("witness_id")).alias("ids"),
    )
    material = F.concat_ws("\x1f", "language", F.array_join("ids", "\x1f"))
    return found.select(
        "language",
        F.concat(F.lit("bucket:sim:"), F.substring(F.sha2(material, 256), 1, 16)).alias("bucket_id"),
        F.col("first.normalized").alias("normalized"),
        F.col("first.gloss").alias("display"),
        F.col("ordered")["witness_id"].alias("members"),
        F.when(F.size("ids") > 1, "similarity-multi-witness").otherwise("similarity-single-witness").alias("label"),
        F.lit(f"similarity:{mode}:{metric}:{threshold:g}").alias("note"),
    )


def clusters(items: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """``key, cluster``: the smallest key that each item reaches over the pairs."""
    roots = components(pairs, "a", "b")
    return items.select(F.col(key)).join(roots.withColumnRenamed("node", key), key, "left").select(
        key, F.coalesce("root", key).alias("cluster")
    )


def exact_buckets(items: DataFrame, key: str, text: str) -> DataFrame:
    """Items by normalized text: members in order, the first one's text, and how many they are."""
    own = items.withColumn("bucket", normalize_gloss(F.col(text)))
    found = own.groupBy("bucket").agg(
        F.count("*").alias("size"), F.min(key).alias("first_key"), F.min_by(text, key).alias("display"),
        F.array_sort(F.collect_list(key)).alias("members"),
    )
    return found.withColumn("label", F.when(F.col("size") > 1, "multi-witness").otherwise("single-witness"))
