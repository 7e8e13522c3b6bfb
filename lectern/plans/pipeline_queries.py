"""Queries of the staged evidence pipeline, exports and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import ranking, stages
from lectern.plans.registry import Registry
from lectern.sources.sinks import table_digest
from lectern.storage import read_table

R = Registry()


def _registry() -> stages.HandlerRegistry:
    registry = stages.HandlerRegistry()
    for tool in ("click", "view", "error"):

        @registry.register(tool, "extract", "v1")
        def extract(rows: DataFrame) -> DataFrame:
            return rows.select("input_id", F.get_json_object("payload", "$.k").alias("payload"))

        @registry.register(tool, "derive", "v2")
        def derive(rows: DataFrame) -> DataFrame:
            k = F.col("payload").cast("int")
            return rows.select("input_id", F.when(k >= 10, F.concat(F.lit("bin:"), (k.cast("bigint") - k % 10).cast("string"))).alias("payload"))

        @registry.register(tool, "claim", "v1")
        def claim(rows: DataFrame, tool: str = tool) -> DataFrame:
            return rows.select("input_id", F.concat(F.lit(f"{tool} has "), F.col("payload")).alias("payload"))

    return registry


@R.query(
    """WITH x AS (SELECT event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE event_type IN ('click', 'view', 'error'))
SELECT concat(event_type, ' has bin:', CAST(k - k % 10 AS STRING)) AS claim, count(*) AS n FROM x WHERE k >= 10 GROUP BY 1"""
)
def staged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("effect_id"), F.col("event_type").alias("tool"), F.col("props").alias("payload")
    )
    none = spark.createDataFrame([], stages.EFFECTS)
    found = stages.run_plan(raw, {s: none for s in ("extract", "derive", "claim")}, _registry())
    return found["claim"].groupBy(F.col("payload").alias("claim")).agg(F.count("*").alias("n"))


@R.query(
    """SELECT c_name AS query, concat(tool, ':', lower(c_mktsegment)) AS language, concat('/', tool, '/', c_name) AS endpoint FROM customer,
  (VALUES ('dict'), ('morph')) t(tool)"""
)
def planned_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read_table(spark, sf_dir, "customer").select(F.col("c_name").alias("query"), F.lower("c_mktsegment").alias("language"))
    tools = F.explode(F.array(F.lit("dict"), F.lit("morph")))
    templates = customers.select("language").distinct().withColumn("tool", tools)
    templates = templates.select(
        "language", "tool", F.lit("fetch").alias("stage"), F.concat(F.lit("/"), "tool", F.lit("/{query}")).alias("endpoint"), F.lit(1).alias("priority")
    )
    calls = stages.plan_calls(customers, templates)
    return calls.select("query", F.concat("tool", F.lit(":"), "language").alias("language"), "endpoint")


@R.query(
    """WITH n AS (SELECT doc_id, lang, source, length(text) AS n, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, need, priority FROM (
  SELECT doc_id, 'missing-label' AS need, 1 AS priority FROM n WHERE quality IS NULL
  UNION ALL SELECT doc_id, 'short', 2 FROM n WHERE n < 200 UNION ALL SELECT doc_id, 'review', 3 FROM n WHERE quality = 0 OR toxic = 1)"""
)
def research_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    joined = docs.select("doc_id", F.char_length("text").alias("n")).join(labels, "doc_id", "left")
    rules = {
        "missing-label": (1, F.col("quality").isNull()),
        "short": (2, F.col("n") < 200),
        "review": (3, F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))),
    }
    return ranking.needs(joined, ["doc_id"], rules)


@R.query(
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'needs_review' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey < 10 THEN 'accept' ELSE 'needs_review' END AS status,
  CASE WHEN c_acctbal >= 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey < 10 THEN 'high' ELSE 'low' END AS confidence FROM customer"""
)
def overlay_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "customer")
    return ranking.reviewed(rows, ["c_custkey"], F.col("c_acctbal") < 0, F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_nationkey") < 10)


def _digest_sql(name: str, columns: str) -> str:
    told = ", ".join(f"coalesce(CAST({c} AS STRING), chr(0))" for c in columns.split())
    return f"SELECT '{name}' AS name, count(*) AS rows, CAST(sum(CAST(concat('0x', substr(sha256(concat_ws(chr(31), {told})), 1, 15)) AS BIGINT)) AS STRING) AS checksum FROM {name}"


_BUNDLED = {"region": "r_name r_regionkey", "nation": "n_name n_nationkey n_regionkey", "part": "p_brand p_name p_partkey p_size p_type"}


@R.query(" UNION ALL ".join(_digest_sql(n, c) for n, c in _BUNDLED.items()))
def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts and order-free checksums of the tables that a bundle would hold."""
    out = None
    for name, columns in _BUNDLED.items():
        row = table_digest(read_table(spark, sf_dir, name).select(*columns.split()), name)
        out = row if out is None else out.unionByName(row)
    return out


@R.query(
    """SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value > 10) AS hits, count(*) FILTER (WHERE value <= 1) AS missing,
  round(avg(CASE WHEN value > 5 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM events GROUP BY 1"""
)
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("total"), F.count_if(v > 10).alias("hits"), F.count_if(v <= 1).alias("missing"),
        F.round(F.avg((v > 5).cast("double")), 6).alias("pass_rate"),
    )


@R.query(
    """WITH p AS (SELECT event_id, user_id, ts, CAST(floor(value) AS INT) % 3 AS section FROM events),
f AS (SELECT user_id, section, min(ts) AS started FROM p GROUP BY 1, 2)
SELECT user_id, section, epoch_us(started) AS started, epoch_us(lead(started) OVER (PARTITION BY user_id ORDER BY started)) AS next_started FROM f"""
)
def encounter_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each (user, section) opens a span, which ends where the next one opens."""
    from pyspark.sql import Window

    events = read_table(spark, sf_dir, "events").withColumn("section", F.floor("value").cast("int") % 3)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first = events.groupBy("user_id", "section").agg(F.min(us).alias("started"))
    return first.withColumn("next_started", F.lead("started").over(Window.partitionBy("user_id").orderBy("started")))


@R.query(
    """WITH t AS (SELECT * FROM (VALUES ('thing'), ('ther'), ('queue')) v(term)), m AS (SELECT page_id, term, len(regexp_extract_all(lower(html), term)) AS n FROM pages, t)
SELECT page_id, term, CAST(n AS BIGINT) AS mentions FROM m WHERE n > 0"""
)
def concept_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms are a short fixed list: each page looks for all of them, nothing is joined."""
    terms = ["thing", "ther", "queue"]
    low = F.lower("html")
    counts = F.array(*(F.struct(F.lit(t).alias("term"), F.regexp_count(low, F.lit(t)).cast("bigint").alias("mentions")) for t in terms))
    found = read_table(spark, sf_dir, "pages").select("page_id", F.inline(counts))
    return found.filter("mentions > 0")


@R.query("SELECT p_partkey, p_size, CASE p_size WHEN 4 THEN 'IV' WHEN 9 THEN 'IX' WHEN 14 THEN 'XIV' WHEN 40 THEN 'XL' WHEN 49 THEN 'XLIX' END AS roman, CASE WHEN p_size IN (4, 9, 14, 40, 49) THEN p_size END AS value FROM part")
def roman_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    romans = {4: "IV", 9: "IX", 14: "XIV", 40: "XL", 49: "XLIX"}
    pick = None
    for n, r in romans.items():
        pick = F.when(F.col("p_size") == n, r) if pick is None else pick.when(F.col("p_size") == n, r)
    return read_table(spark, sf_dir, "part").select("p_partkey", "p_size", pick.alias("roman"), X.roman_to_int(pick).alias("value"))
