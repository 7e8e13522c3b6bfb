"""Evidence graphs: claims hold triples (subject, predicate, object); senses are read from them and reduced to buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.references import split_glosses
from lectern.functions.text import anchor, normalize_gloss, stable_id

TRIPLES = "array<struct<subject:string,predicate:string,object:string,metadata:struct<evidence:map<string,string>>>>"


def claim_triples(claims: DataFrame) -> DataFrame:
    """A row for each triple of a claim's JSON value, with its place; what isn't a list of triples gives none."""
    parsed = F.from_json("value", f"struct<triples:{TRIPLES}>")["triples"]
    return claims.select("claim_id", "tool", F.posexplode(parsed).alias("ord", "t")).select("claim_id", "tool", "ord", "t.*")


def witness_senses(triples: DataFrame) -> DataFrame:
    """Witnesses: has_sense joined with gloss in the same claim, the last has_sense of a sense winning, each once."""
    senses = (
        triples.filter("predicate = 'has_sense'")
        .groupBy("claim_id", F.col("object").alias("sense"))
        .agg(F.max_by("subject", "ord").alias("lexeme"))
    )
    glosses = triples.filter("predicate = 'gloss'").select("claim_id", "tool", F.col("subject").alias("sense"), F.col("object").alias("gloss"), "ord")
    joined = glosses.join(senses, ["claim_id", "sense"]).withColumn("normalized", normalize_gloss(F.col("gloss")))
    found = joined.groupBy("claim_id", "tool", "sense", "lexeme", "normalized").agg(F.min_by("gloss", "ord").alias("gloss"))
    return found.withColumn("witness_id", stable_id("wsu:", F.col("lexeme"), F.col("sense"), F.col("normalized"), F.col("claim_id")))


def reduce_exact(witnesses: DataFrame, language: str) -> DataFrame:
    """Sense buckets by normalized gloss: witnesses, claims, the first witness's gloss, and how well they are attested."""
    found = witnesses.groupBy("normalized").agg(
        F.count("*").alias("size"),
        F.countDistinct("claim_id").alias("claims"),
        F.min_by("gloss", F.struct("claim_id", "sense")).alias("display"),
        F.array_sort(F.collect_set("witness_id")).alias("witnesses"),
    )
    many = F.col("size") > 1
    return found.select(
        "*",
        F.when(many, "multi-witness").otherwise("single-witness").alias("label"),
        F.when(many, F.array().cast("array<string>")).otherwise(F.array(F.lit("provisional"))).alias("notes"),
        stable_id("bucket:", F.lit(language), F.col("normalized")).alias("bucket_id"),
    )


def interpretations(triples: DataFrame) -> DataFrame:
    """form -> has_interpretation -> interpretation -> realizes_lexeme -> lexeme."""
    a = triples.filter("predicate = 'has_interpretation'").select(F.col("subject").alias("form"), F.col("object").alias("i"))
    b = triples.filter("predicate = 'realizes_lexeme'").select(F.col("subject").alias("i"), F.col("object").alias("lexeme"))
    features = (
        triples.filter("predicate LIKE 'has_%' AND predicate <> 'has_interpretation'")
        .groupBy(F.col("subject").alias("i"))
        .agg(F.sort_array(F.collect_set(F.concat_ws("=", F.expr("substring(predicate, 5)"), "object"))).alias("features"))
    )
    return a.join(b, "i").join(features, "i", "left").select("form", "lexeme", "features").distinct()


def merge_evidence(base: str, more: str):
    """Map of evidence in which existing keys win and empty values go."""
    kept = lambda m: F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))
    x, y = kept(F.col(base)), kept(F.col(more))
    fresh = F.map_filter(y, lambda k, v: ~F.map_contains_key(x, k))
    return F.map_concat(x, fresh)


def validation_issues(checks: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``issue, item``: the union of named checks, each a frame of failing rows and the column that names them."""
    out = None
    for name, (rows, item) in checks.items():
        part = rows.select(F.lit(name).alias("issue"), F.col(item).cast("string").alias("item"))
        out = part if out is None else out.unionByName(part)
    return out


def entry_claims(entries: DataFrame, tool: str) -> DataFrame:
    """Claims of dictionary entries (``entry_id, lemma, gloss``): the lemma's lexeme has a sense for each gloss, as JSON triples."""
    lex = anchor("lex", F.col("lemma"))

    def sense(i):
        return F.concat(F.lit("sense:"), F.col("_lex"), F.lit("#"), F.col("entry_id").cast("string"), F.lit("."), (i + 1).cast("string"))

    def triple(s, p, o):
        return F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))

    glosses = entries.withColumn("_lex", lex).withColumn("_gs", split_glosses(F.col("gloss")))
    links = F.transform("_gs", lambda g, i: triple(F.col("_lex"), "has_sense", sense(i)))
    told = F.transform("_gs", lambda g, i: triple(sense(i), "gloss", g))
    claim = stable_id("claim-", F.lit(tool), F.col("entry_id"))
    return glosses.filter(F.size("_gs") > 0).select(
        claim.alias("claim_id"), F.lit(tool).alias("tool"), F.to_json(F.struct(F.concat(links, told).alias("triples"))).alias("value")
    )


def word_context(asked: DataFrame, entries: DataFrame, hits: DataFrame, indexed: DataFrame) -> DataFrame:
    """What is known of words (``language, word``): numbers of dictionary entries and of passages, and a status that tells a word
    without passages from a language that the index doesn't have."""
    lexical = entries.groupBy("language", "word").agg(F.count("*").alias("entries"))
    found = hits.groupBy("language", "word").agg(F.count("*").alias("passages"))
    known = indexed.select("language").distinct().withColumn("_indexed", F.lit(True))
    joined = asked.join(lexical, ["language", "word"], "left").join(found, ["language", "word"], "left").join(known, "language", "left")
    status = F.when(F.col("_indexed").isNull(), "index_unavailable").when(F.col("passages").isNull(), "no_hits").otherwise("hits")
    return joined.select(
        "language", "word", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("passages", F.lit(0)).alias("passages"), status.alias("status")
    )
