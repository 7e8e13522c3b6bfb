"""Queries of plans of calls in three languages, and of their runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import call_graph, graph, normalization
from lectern.operators.stages import HandlerRegistry
from lectern.plans.registry import Registry
from lectern.storage import cut, read_table

R = Registry()

#: Tools that aren't there, and dictionaries that have an entry for some words only.
_NO_HANDLER = ["extract.cltk.lexicon", "claim.whitakers", "fetch.spacy"]
_SOME_WORDS = ["fetch.gaffiot", "fetch.bailly", "fetch.dico", "fetch.heritage"]


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's name is a request: Sanskrit, Latin or Greek, some in another form than their lemma."""
    name = F.lower("c_name")
    key = F.col("c_custkey")
    return read_table(spark, sf_dir, "customer").select(
        key.cast("string").alias("query_id"),
        F.element_at(F.array(F.lit("san"), F.lit("lat"), F.lit("grc"), F.lit("eng")), (key % 4 + 1).cast("int")).alias("language"),
        F.col("c_name").alias("surface"),
        F.when(key % 8 < 4, F.replace(name, F.lit("customer#"), F.lit("c"))).otherwise(name).alias("lemma"),
        F.array(name, F.replace(name, F.lit("u"), F.lit("ū")), F.when(key % 5 == 0, F.lit("")).otherwise(name)).alias("spellings"),
    )


_SQL_TEMPLATES = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in row) + ")" for row in call_graph.template_rows(call_graph.CHAINS))
_CALLS = f"""t AS (SELECT * FROM (VALUES {_SQL_TEMPLATES}) v(language, chain, place, tool, stage, kind, priority, required, source)),
q AS (SELECT CAST(c_custkey AS STRING) AS query_id, ['san', 'lat', 'grc', 'eng'][c_custkey % 4 + 1] AS language, lower(c_name) AS surface, c_acctbal,
  CASE WHEN c_custkey % 8 < 4 THEN replace(lower(c_name), 'customer#', 'c') ELSE lower(c_name) END AS lemma FROM customer),
a AS (SELECT q.*, 'lemma' AS kind, 1 AS k, lemma AS asked FROM q UNION ALL SELECT q.*, 'surface', 1, surface FROM q WHERE surface <> lemma
  UNION ALL SELECT q.*, 'spellings', 1, surface FROM q UNION ALL SELECT q.*, 'spellings', 2, replace(surface, 'u', 'ū') FROM q),
c AS (SELECT query_id, language, chain || '-' || stage || '-' || k AS call_id, tool, stage, asked, priority, NOT (required AND k = 1) AS optional,
  CASE WHEN source IN ('fetch', 'extract', 'derive') THEN chain || '-' || source || '-' || k ELSE source END AS source, c_acctbal FROM a JOIN t USING (language, kind))"""


@R.query(f"WITH {_CALLS} SELECT query_id, language, call_id, tool, stage, asked, priority, optional, source FROM c")
def planned_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_graph.plan_graph(_requests(spark, sf_dir))


def _registry(spark: SparkSession, sf_dir: str) -> HandlerRegistry:
    """Fetches answer with the customer's segment; extracts and claims tell it on, derivations find two facts in it."""
    customers = read_table(spark, sf_dir, "customer")
    names = F.array(F.lower("c_name"), F.replace(F.lower("c_name"), F.lit("customer#"), F.lit("c")), F.replace(F.lower("c_name"), F.lit("u"), F.lit("ū")))
    tools = sorted({t for c in call_graph.CHAINS for t in c.tools.split()} - set(_NO_HANDLER))
    registry = HandlerRegistry()
    for tool in tools:
        stage = tool.split(".")[0]
        if tool == "fetch.cts_index":
            # asked what the citation's derivation gave
            registry.register(tool, stage, "v1")(lambda rows: rows.filter(F.col("payload").endswith(":1")))
        elif stage == "fetch":
            own = customers.filter("c_acctbal > 0") if tool in _SOME_WORDS else customers
            table = own.select(F.lit(tool).alias("tool"), F.explode(names).alias("asked"), F.lower("c_mktsegment").alias("payload"))
            registry.register(tool, stage, "v1")(call_graph.responses(table, tool))
        elif stage == "derive":
            two = F.explode(F.array(F.concat("payload", F.lit(":1")), F.concat("payload", F.lit(":2")))).alias("payload")
            registry.register(tool, stage, "v1")(lambda rows, two=two: rows.select("input_id", two))
        else:
            registry.register(tool, stage, "v1")(lambda rows, tool=tool: rows.select("input_id", F.concat(F.lit(tool + " "), "payload").alias("payload")))
    return registry


_NONE = ", ".join(f"'{t}'" for t in _NO_HANDLER)
_SOME = ", ".join(f"'{t}'" for t in _SOME_WORDS)
#: A call's state follows from its source's: how many payloads that gave, and how many it makes of them.
_RUN = f"""WITH RECURSIVE {_CALLS},
s AS (SELECT query_id, language, call_id, tool, stage, CASE WHEN tool IN ({_NONE}) THEN 'missing_handler_' || stage END AS reason, optional, 1 AS round,
    CASE WHEN tool IN ({_NONE}) OR tool IN ({_SOME}) AND c_acctbal <= 0 THEN 0 ELSE 1 END AS made FROM c WHERE source IS NULL
  UNION ALL SELECT c.query_id, c.language, c.call_id, c.tool, c.stage, CASE WHEN c.tool IN ({_NONE}) THEN 'missing_handler_' || c.stage WHEN s.made = 0 THEN 'missing_source_' || c.stage END, c.optional, s.round + 1,
    CASE WHEN c.tool IN ({_NONE}) THEN 0 WHEN c.stage = 'derive' THEN 2 * s.made WHEN c.tool = 'fetch.cts_index' THEN s.made // 2 ELSE s.made END FROM s JOIN c ON c.query_id = s.query_id AND c.source = s.call_id)"""


@R.query(
    f"""{_RUN} SELECT language, tool, stage, CASE WHEN reason IS NULL THEN 'done' WHEN optional THEN 'skipped' ELSE 'failed' END AS status, reason, round, count(*) AS calls, CAST(sum(made) AS BIGINT) AS payloads
FROM s GROUP BY ALL"""
)
def graph_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by how they went, in which round, and what they gave; tools that aren't there and empty answers are told on."""
    calls = call_graph.plan_graph(_requests(spark, sf_dir))
    states, outputs = call_graph.run_graph(calls, _registry(spark, sf_dir))
    made = outputs.groupBy("query_id", "call_id").agg(F.count("*").alias("n"))
    told = states.join(calls.select("query_id", "call_id", "language"), ["query_id", "call_id"]).join(made, ["query_id", "call_id"], "left")
    return told.groupBy("language", "tool", "stage", "status", "reason", "round").agg(F.count("*").alias("calls"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("payloads"))


@R.query(
    f"""{_RUN} SELECT query_id, bool_or(reason IS NOT NULL AND NOT optional) AS failed, count(*) FILTER (WHERE reason IS NULL) AS done,
  count(*) FILTER (WHERE reason IS NOT NULL AND optional) AS skipped, max(round) AS rounds FROM s GROUP BY 1"""
)
def graph_plan_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_graph.plan_states(call_graph.run_graph(call_graph.plan_graph(_requests(spark, sf_dir)), _registry(spark, sf_dir))[0])


#: Orders of a customer are linked in order; some links lead nowhere or are missing, and every seventh customer's last order links to the first.
_LINKED = """o AS (SELECT o_orderkey AS node, o_custkey, lead(o_orderkey) OVER w AS after, first_value(o_orderkey) OVER w AS opening FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
l AS (SELECT node, CASE WHEN node % 29 = 3 THEN NULL WHEN node % 31 = 5 THEN -node WHEN after IS NULL AND o_custkey % 7 = 0 THEN opening ELSE after END AS next FROM o)"""


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), "o_custkey", F.lead("o_orderkey").over(w).alias("after"), F.first("o_orderkey").over(w).alias("opening"))
    node = F.col("node")
    last = F.when(F.col("after").isNull() & (F.col("o_custkey") % 7 == 0), F.col("opening")).otherwise(F.col("after"))
    return orders.select("node", F.when(node % 29 == 3, None).when(node % 31 == 5, -node).otherwise(last).alias("next"))


@R.query(
    f"""WITH RECURSIVE {_LINKED}, s AS (SELECT node AS seed, 0 AS step, node FROM l WHERE node % 5 = 0
  UNION ALL SELECT s.seed, s.step + 1, n.node FROM s JOIN l ON l.node = s.node JOIN l n ON n.node = l.next WHERE s.step < 6 AND n.node <> s.seed) SELECT seed, step, node FROM s"""
)
def linked_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From some entries six steps on along their links, over circles and up to gaps."""
    rows = _linked(spark, sf_dir)
    return graph.walks(cut(graph.chains(rows, "node", "next")), rows.filter("node % 5 = 0"), "node", 6)


#: Parts' names are asked for; of the stored answers some are of an older version (size 0 of 4), some too old (1), and some good (2).
_ASKED = """p AS (SELECT DISTINCT upper(p_name) AS query, ['san', 'lat', 'grc'][length(p_name) % 3 + 1] AS language, lower(p_name) AS low, length(p_name) % 4 AS k FROM part),
k AS (SELECT low AS lemma, count(*) AS times FROM (SELECT lower(p_name) AS low FROM part) GROUP BY 1),
c AS (SELECT query, language, UNNEST(CASE WHEN k = 2 THEN [struct_pack(lemma := 'stored ' || low, source := 'tool', place := 0)] ELSE [struct_pack(lemma := replace(low, 'e', 'ae'), source := 'tool', place := 0),
  struct_pack(lemma := low, source := 'tool', place := 1), struct_pack(lemma := low || 'us', source := 'local', place := 2)] END) AS c FROM p)"""


@R.query(
    f"""WITH {_ASKED} SELECT query, language, c.lemma AS lemma, c.source AS source,
  CAST(row_number() OVER (PARTITION BY query, language ORDER BY c.source = 'local', coalesce(times, 0) DESC, c.place) AS INT) AS rank FROM c LEFT JOIN k ON k.lemma = c.lemma"""
)
def stored_normalizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered from a table of normalizations, in which only what is unknown or stale was normalized again."""
    low = F.lower("p_name")
    parts = read_table(spark, sf_dir, "part").select(F.upper("p_name").alias("query"), F.element_at(F.array(F.lit("san"), F.lit("lat"), F.lit("grc")), (F.length("p_name") % 3 + 1).cast("int")).alias("language"), low.alias("low"))
    kind = F.length("low") % 4
    one = lambda lemma, source: F.struct(lemma.alias("lemma"), F.lit(source).alias("source"))
    stored = parts.distinct().filter(kind < 3).select(
        normalization.query_key(F.col("query"), F.col("language")).alias("query_key"), "query", "language", F.array(one(F.concat(F.lit("stored "), "low"), "tool")).alias("candidates"),
        F.when(kind == 0, "v1").otherwise("v2").alias("normalizer_version"), F.when(kind == 1, 10).otherwise(90).alias("day"),
    )

    def normalize(rows: DataFrame) -> DataFrame:
        lemma = F.lower("query")
        return rows.select("query_key", F.array(one(F.replace(lemma, F.lit("e"), F.lit("ae")), "tool"), one(lemma, "tool"), one(F.concat(lemma, F.lit("us")), "local")).alias("candidates"))

    delta = cut(normalization.refresh(parts, stored, normalize, "v2", 100, 30))
    known = parts.select(F.col("low").alias("lemma"), F.lit(1).alias("times"))
    return normalization.answers(parts, normalization.merged(stored, delta), known)
