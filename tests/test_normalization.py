from pyspark.sql import functions as F

from lectern.operators import normalization as N


def test_only_stale_queries_are_normalized_again(spark):
    requests = spark.createDataFrame([("Arma  virum", "lat"), ("arma virum", "lat"), ("new", "lat"), ("old", "lat"), ("other", "lat"), ("arma virum", "grc"), (None, None), ("none", "lat")], "query string, language string")
    key = N.query_key(F.col("query"), F.col("language"))
    rows = [("arma virum", "lat", "v2", 99), ("old", "lat", "v2", 60), ("other", "lat", "v1", 99)]
    stored = spark.createDataFrame(rows, "query string, language string, normalizer_version string, day int").select(
        key.alias("query_key"), "query", "language", F.array(F.struct(F.lit("kept").alias("lemma"), F.lit("tool").alias("source"))).alias("candidates"), "normalizer_version", "day"
    )
    seen = []

    def normalize(stale):
        seen.append(sorted((r["query"] or "", r["language"] or "") for r in stale.collect()))
        made = F.array(F.struct(F.lit("a").alias("lemma"), F.lit("local").alias("source")), F.struct(F.lit("b").alias("lemma"), F.lit("tool").alias("source")), F.struct(F.lit("c").alias("lemma"), F.lit("tool").alias("source")))
        return stale.filter("query <> 'none'").select("query_key", made.alias("candidates"))

    delta = N.refresh(requests, stored, normalize, "v2", 100, 30)
    assert seen == [[("", ""), ("arma virum", "grc"), ("new", "lat"), ("none", "lat"), ("old", "lat"), ("other", "lat")]]
    table = N.merged(stored, delta)
    assert table.count() == 7 and table.filter("normalizer_version = 'v2'").count() == 7
    assert N.refresh(requests, table, lambda stale: stale.select("query_key", F.lit(None).alias("candidates")), "v2", 100, 30).count() == 0
    known = spark.createDataFrame([("c", 5), ("b", 2), ("a", 99)], "lemma string, times int")
    ranked = {(r["query"], r["rank"]): r["lemma"] for r in N.answers(requests, table, known).filter("language = 'lat'").collect()}
    assert ranked == {("Arma  virum", 1): "kept", ("arma virum", 1): "kept", **{(q, i + 1): x for q in ("new", "old", "other") for i, x in enumerate("cba")}}
