"""Catalog queries over the analog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import catalog, dml
from lectern.plans.analogs import table, with_tables
from lectern.plans.registry import Registry
from lectern.storage import read_table

R = Registry()
IDENTITY = """CASE WHEN trim(coalesce(author_id, '')) <> '' THEN author_id
  WHEN trim(coalesce(author, '')) <> '' AND lower(trim(author)) <> 'unknown' THEN author END"""


@R.query(
    with_tables(
        "works",
        "artifacts",
        sql="""SELECT collection_id, count(*) AS work_count, CAST(coalesce(sum(s), 0) AS BIGINT) AS segment_count,
  CAST(coalesce(sum(t), 0) AS BIGINT) AS word_count, 'whitespace_tokens' AS word_count_method
FROM works LEFT JOIN (SELECT work_id, sum(segment_count) s, sum(token_count) t FROM artifacts GROUP BY 1) m USING (work_id)
GROUP BY 1""",
    )
)
def collections_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_collections(table(spark, sf_dir, "works"), table(spark, sf_dir, "artifacts"))


@R.query(
    with_tables(
        "works",
        "artifacts",
        "aliases",
        sql="""SELECT *, 'whitespace_tokens' AS word_count_method FROM (SELECT count(DISTINCT collection_id) AS collection_count, count(*) AS work_count FROM works),
(SELECT count(*) AS artifact_count, CAST(sum(segment_count) AS BIGINT) AS segment_count, CAST(sum(token_count) AS BIGINT) AS word_count FROM artifacts),
(SELECT count(*) AS alias_count FROM aliases), (SELECT count(*) AS source_file_count FROM supplier), (SELECT count(*) AS metadata_count FROM orders)""",
    )
)
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = (table(spark, sf_dir, t) for t in ("works", "artifacts", "aliases"))
    return catalog.summary(*own, read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "orders"))


_SHOW = ["work_id", "collection_id", "language", "title", "author"]


@R.query(
    with_tables(
        "works",
        sql="""SELECT work_id, collection_id, language, title, author FROM works
WHERE language = 'fr' AND lower(author) LIKE '%brand#1%' AND NOT lower(author) LIKE 'pseudo-%'""",
    )
)
def works_filter_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_works(table(spark, sf_dir, "works"), language="fr", author="Brand#1").select(*_SHOW)


@R.query(
    with_tables(
        "works",
        "classifications",
        sql="""SELECT work_id, title, popularity_score, row_number() OVER (
  ORDER BY popularity_score IS NULL, popularity_score DESC, language, author, title, work_id) - 11 AS place
FROM works LEFT JOIN classifications USING (work_id)
ORDER BY popularity_score IS NULL, popularity_score DESC, language, author, title, work_id LIMIT 50 OFFSET 10""",
    )
)
def works_popularity_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of 50 works from the tenth on, by popularity, with each one's place on the page."""
    from pyspark.sql import Window

    page = catalog.list_works(
        table(spark, sf_dir, "works"), table(spark, sf_dir, "classifications"), sort="popularity", limit=50, offset=10
    )
    order = [F.col("popularity_score").isNull(), F.desc("popularity_score"), "language", "author", "title", "work_id"]
    place = F.row_number().over(Window.orderBy(*order)).cast("bigint") - 1
    return page.select("work_id", "title", "popularity_score", place.alias("place"))


@R.query(
    with_tables(
        "works",
        "classifications",
        sql="""SELECT work_id, title, scope FROM works JOIN classifications USING (work_id)
WHERE lower(discovery_group_id) = 'economy' AND list_contains(string_split(lower(discovery_tags), '|'), 'blue')
AND lower(scope) LIKE '%brand#2%'""",
    )
)
def works_by_group_tag_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.list_works(
        table(spark, sf_dir, "works"), table(spark, sf_dir, "classifications"), group="Economy", tag="Blue", scope="brand#2"
    )
    return found.select("work_id", "title", "scope")


@R.query(
    with_tables(
        "works",
        "aliases",
        sql="""SELECT work_id, title FROM works w WHERE lower(title) LIKE '%nation_1%' OR lower(author) LIKE '%nation_1%'
OR lower(canonical_text_id) LIKE '%nation_1%' OR EXISTS (SELECT 1 FROM aliases a WHERE a.target = w.work_id AND lower(alias) LIKE '%nation_1%')""",
    )
)
def works_exists_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.list_works(table(spark, sf_dir, "works"), aliases=table(spark, sf_dir, "aliases"), query="Nation_1")
    return found.select("work_id", "title")


@R.query(
    with_tables(
        "works",
        "attributions",
        sql="""SELECT DISTINCT w.work_id, w.author FROM works w WHERE (lower(author) LIKE '%agent 1%' AND NOT lower(author) LIKE 'pseudo-%')
OR EXISTS (SELECT 1 FROM attributions a WHERE a.status = 'accepted' AND lower(a.agent) LIKE '%agent 1%'
  AND a.collection_id = w.collection_id AND ((a.match_field = 'work_id' AND a.match_value = w.work_id)
  OR (a.match_field = 'source_id' AND a.match_value = w.source_id) OR (a.match_field = 'cts_work_urn' AND a.match_value = w.cts_work_urn)
  OR (a.match_field = 'author' AND a.match_value = w.author)))""",
    )
)
def or_join_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.list_works(
        table(spark, sf_dir, "works"), attributions=table(spark, sf_dir, "attributions"), attributed_to="Agent 1"
    )
    return found.select("work_id", "author")


@R.query(with_tables("works", sql="SELECT author_id, author, language, collection_id, count(*) AS work_count FROM works GROUP BY ALL"))
def author_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_authors(table(spark, sf_dir, "works"))


@R.query(
    with_tables(
        "works",
        "artifacts",
        "classifications",
        sql=""", m AS (SELECT work_id, CAST(sum(token_count) AS BIGINT) AS words FROM artifacts GROUP BY 1),
j AS (SELECT w.*, m.words, coalesce(c.global_popularity_score, c.popularity_score, c.group_popularity_score, 0) AS score
  FROM works w LEFT JOIN m USING (work_id) LEFT JOIN classifications c USING (work_id)),
t AS (SELECT author, title, row_number() OVER (PARTITION BY author ORDER BY max(score) DESC, max(coalesce(words, 0)) DESC, title) AS rn
  FROM j GROUP BY author, title)
SELECT author, count(DISTINCT work_id) AS work_count, CAST(coalesce(sum(words), 0) AS BIGINT) AS word_count,
  (SELECT string_agg(title, ' | ' ORDER BY rn) FROM t WHERE t.author = j.author AND rn <= 8) AS titles
FROM j GROUP BY author""",
    )
)
def author_summary_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.author_summaries(
        table(spark, sf_dir, "works"), table(spark, sf_dir, "artifacts"), table(spark, sf_dir, "classifications")
    )


@R.query(
    """SELECT CASE WHEN regexp_matches(upper(substr(trim(c_name), 1, 1)), '^[A-Z]$') THEN upper(substr(trim(c_name), 1, 1)) ELSE '#' END AS section,
count(DISTINCT c_name) AS author_count FROM (SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT c_mktsegment FROM customer
UNION ALL SELECT o_orderpriority FROM orders) GROUP BY 1"""
)
def author_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = None
    for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("customer", "c_mktsegment"), ("orders", "o_orderpriority")):
        part = read_table(spark, sf_dir, t).select(F.col(c).alias("author"))
        names = part if names is None else names.unionByName(part)
    return catalog.author_sections(names)


_LISTS = {"display_values", "work_ids", "authors", "author_ids", "titles"}


def _joined(df: DataFrame) -> DataFrame:
    return df.select(*(F.array_join(c, ",").alias(c) if c in _LISTS else c for c in df.columns))


@R.query(
    with_tables(
        "works",
        sql="""SELECT 'title' AS kind, language, lower(trim(title)) AS duplicate_key, min(trim(title)) AS display, count(*) AS work_count,
  count(DISTINCT trim(author)) AS author_count, string_agg(DISTINCT trim(title), ',' ORDER BY trim(title)) AS display_values,
  string_agg(work_id, ',' ORDER BY author, title, work_id) AS work_ids, string_agg(author, ',' ORDER BY author, title, work_id) AS authors,
  CASE WHEN count(DISTINCT trim(author)) > 1 THEN 'preserve_title_disambiguate_by_author' ELSE 'review_possible_edition_or_import_duplicate' END AS suggested_policy
FROM works WHERE length(trim(title)) > 0 GROUP BY language, lower(trim(title)) HAVING count(*) > 1""",
    )
)
def duplicate_titles_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(catalog.duplicate_titles(table(spark, sf_dir, "works")))


@R.query(
    with_tables(
        "works",
        sql="""SELECT 'author' AS kind, language, lower(trim(author)) AS duplicate_key, min(trim(author)) AS display, count(*) AS work_count,
  count(DISTINCT coalesce(author_id, '')) AS authority_count, string_agg(DISTINCT trim(author), ',' ORDER BY trim(author)) AS display_values,
  string_agg(DISTINCT coalesce(author_id, ''), ',' ORDER BY coalesce(author_id, '')) AS author_ids, string_agg(work_id, ',' ORDER BY author, title, work_id) AS work_ids,
  string_agg(title, ',' ORDER BY author, title, work_id) AS titles, 'review_authority_collision' AS suggested_policy
FROM works WHERE length(trim(author)) > 0 GROUP BY language, lower(trim(author)) HAVING count(DISTINCT coalesce(author_id, '')) > 1""",
    )
)
def duplicate_authors_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(catalog.duplicate_authors(table(spark, sf_dir, "works")))


@R.query(
    with_tables(
        "works",
        sql="""SELECT trim(canonical_text_id) AS id, count(DISTINCT work_id) AS work_count,
  string_agg(DISTINCT collection_id, ', ' ORDER BY collection_id) AS collections, string_agg(DISTINCT title, ' | ' ORDER BY title) AS titles,
  string_agg(DISTINCT work_id, ' | ' ORDER BY work_id) AS work_ids
FROM works WHERE trim(coalesce(canonical_text_id, '')) <> '' GROUP BY 1 HAVING count(DISTINCT work_id) > 1""",
    )
)
def duplicate_canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.duplicate_canonical_ids(table(spark, sf_dir, "works"))


@R.query(
    with_tables(
        "works",
        "classifications",
        sql=f"""SELECT discovery_group_id AS id, count(DISTINCT work_id) AS work_count, count(DISTINCT {IDENTITY}) AS author_count,
  max(popularity_score) AS max_score, min(position) AS position
FROM works JOIN classifications USING (work_id) JOIN (SELECT lower(p_type) AS id, min(p_partkey) AS position FROM part GROUP BY 1) x ON x.id = discovery_group_id
WHERE trim(coalesce(discovery_group_id, '')) <> '' GROUP BY 1""",
    )
)
def discovery_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    taxonomy = read_table(spark, sf_dir, "part").groupBy(F.lower("p_type").alias("id")).agg(F.min("p_partkey").alias("position"))
    return catalog.discovery_groups(table(spark, sf_dir, "works"), table(spark, sf_dir, "classifications"), taxonomy)


@R.query(
    with_tables(
        "works",
        "classifications",
        sql=f"""SELECT tag, count(DISTINCT work_id) AS work_count, count(DISTINCT {IDENTITY}) AS author_count, max(popularity_score) AS max_score
FROM (SELECT *, unnest(list_distinct(string_split(discovery_tags, '|'))) AS tag FROM works JOIN classifications USING (work_id)) GROUP BY 1""",
    )
)
def discovery_tags_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.discovery_tags(table(spark, sf_dir, "works"), table(spark, sf_dir, "classifications"))


@R.query(
    with_tables(
        "works",
        "artifacts",
        "classifications",
        sql=f"""SELECT language, count(*) AS work_count, count(DISTINCT {IDENTITY}) AS author_count,
  CAST(coalesce(sum(words), 0) AS BIGINT) AS word_count, count(c.work_id) AS classified_count,
  CAST(coalesce(sum(CASE WHEN trim(coalesce(c.discovery_group_id, '')) <> '' THEN 1 WHEN c.work_id IS NOT NULL THEN 0 END), 0) AS BIGINT) AS discoverable_count,
  count(c.work_id) = count(*) AS complete
FROM works LEFT JOIN (SELECT work_id, sum(token_count) AS words FROM artifacts GROUP BY 1) m USING (work_id)
LEFT JOIN classifications c USING (work_id) GROUP BY 1""",
    )
)
def coverage_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.coverage(*(table(spark, sf_dir, t) for t in ("works", "artifacts", "classifications")))


@R.query(
    with_tables(
        "works",
        "classifications",
        sql="""SELECT * FROM (SELECT discovery_group_id, work_id, title, row_number() OVER (PARTITION BY discovery_group_id
  ORDER BY group_popularity_score IS NULL, group_popularity_score DESC, popularity_score IS NULL, popularity_score DESC, title, work_id) AS rank
FROM works JOIN classifications USING (work_id) WHERE trim(coalesce(discovery_group_id, '')) <> '') WHERE rank <= 5""",
    )
)
def shelf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.shelves(table(spark, sf_dir, "works"), table(spark, sf_dir, "classifications"), 5)
    return found.select("discovery_group_id", "work_id", "title", F.col("rank").cast("bigint").alias("rank"))


_EDITIONS = "SELECT DISTINCT CAST(l_partkey AS STRING) AS work_id, l_linestatus AS edition_id FROM lineitem"
_FILES = "SELECT concat('src', CAST(s_nationkey AS STRING)) AS source_id, CAST(s_acctbal AS BIGINT) AS size_bytes FROM supplier"


@R.query(
    with_tables(
        "works",
        "artifacts",
        sql=f""", editions AS ({_EDITIONS}), files AS (SELECT source_id, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM
  (SELECT concat('src', CAST(s_nationkey AS STRING)) AS source_id, CAST(trunc(s_acctbal) AS BIGINT) AS size_bytes FROM supplier) GROUP BY 1),
m AS (SELECT work_id, edition_id, count(*) AS artifact_count, CAST(sum(token_count) AS BIGINT) AS word_count,
  string_agg(DISTINCT adapter, ', ' ORDER BY adapter) AS adapters FROM artifacts GROUP BY 1, 2),
s AS (SELECT CAST(o_custkey AS STRING) AS work_id, count(*) AS witness_count FROM orders GROUP BY 1)
SELECT work_id, edition_id, source_id, coalesce(artifact_count, 0) AS artifact_count, coalesce(word_count, 0) AS word_count, adapters,
  coalesce(file_count, 0) AS file_count, coalesce(size_bytes, 0) AS size_bytes, coalesce(witness_count, 0) AS witness_count
FROM works LEFT JOIN editions USING (work_id) LEFT JOIN m USING (work_id, edition_id) LEFT JOIN files USING (source_id) LEFT JOIN s USING (work_id)""",
    )
)
def source_index_5way(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    editions = lines.select(F.col("l_partkey").cast("string").alias("work_id"), F.col("l_linestatus").alias("edition_id")).distinct()
    files = read_table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("src"), F.col("s_nationkey").cast("string")).alias("source_id"), F.col("s_acctbal").cast("bigint").alias("size_bytes")
    )
    witnesses = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("work_id"))
    return catalog.source_index(table(spark, sf_dir, "works"), editions, table(spark, sf_dir, "artifacts"), files, witnesses)


@R.query(
    with_tables(
        "works",
        "aliases",
        sql=""", refs AS (SELECT n_name AS ref FROM nation UNION ALL SELECT lower(n_name) FROM nation UNION ALL SELECT CAST(p_partkey AS STRING) FROM part
  UNION ALL SELECT concat('urn:', CAST(p_partkey AS STRING)) FROM part UNION ALL SELECT concat('alias of ', s_name) FROM supplier),
known AS (SELECT 0 AS way, alias AS ref, target AS work_id FROM aliases UNION ALL SELECT 1, work_id, work_id FROM works
  UNION ALL SELECT 2, cts_work_urn, work_id FROM works UNION ALL SELECT 3, source_id, work_id FROM works UNION ALL SELECT 4, canonical_text_id, work_id FROM works)
SELECT ref, arg_min(work_id, (way, work_id)) AS work_id FROM refs JOIN known USING (ref) GROUP BY ref""",
    )
)
def resolve_work_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, part, supplier = (read_table(spark, sf_dir, t) for t in ("nation", "part", "supplier"))
    key = F.col("p_partkey").cast("string")
    refs = (
        nation.select(F.inline(F.array(F.struct(F.col("n_name").alias("ref")), F.struct(F.lower("n_name").alias("ref")))))
        .unionByName(part.select(F.inline(F.array(F.struct(key.alias("ref")), F.struct(F.concat(F.lit("urn:"), key).alias("ref"))))))
        .unionByName(supplier.select(F.concat(F.lit("alias of "), F.col("s_name")).alias("ref")))
    )
    return catalog.resolve_refs(refs, table(spark, sf_dir, "works"), table(spark, sf_dir, "aliases"))


@R.query(
    with_tables(
        "aliases",
        sql="SELECT language, alias, string_agg(DISTINCT target, ',' ORDER BY target) AS targets FROM aliases GROUP BY 1, 2 HAVING count(DISTINCT target) > 1",
    )
)
def alias_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.alias_conflicts(table(spark, sf_dir, "aliases")).withColumn("targets", F.array_join("targets", ","))


@R.query(
    with_tables(
        "aliases",
        sql="SELECT alias, language, kind, target FROM aliases WHERE alias IN (SELECT alias FROM aliases GROUP BY 1 HAVING count(DISTINCT target) = 1)",
    )
)
def unambiguous_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.unambiguous_aliases(table(spark, sf_dir, "aliases"))


@R.query(
    with_tables(
        "works",
        "aliases",
        sql="""SELECT target, alias, language, kind FROM aliases a WHERE NOT EXISTS (SELECT 1 FROM works w WHERE w.work_id = a.target)
AND NOT EXISTS (SELECT 1 FROM works w WHERE w.cts_work_urn = a.target) AND NOT EXISTS (SELECT 1 FROM works w WHERE w.canonical_text_id = a.target)""",
    )
)
def alias_anti3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.alias_target_issues(table(spark, sf_dir, "aliases"), table(spark, sf_dir, "works"))


@R.query(
    with_tables(
        "attributions",
        sql="""SELECT collection_id, match_field, match_value, relation_type, agent, min(evidence_citation) AS citation,
  arg_min(evidence_label, evidence_citation) AS label, count(*) AS evidence_count FROM attributions GROUP BY 1, 2, 3, 4, 5""",
    )
)
def argmin_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.attribution_groups(table(spark, sf_dir, "attributions"))


@R.query(
    """SELECT doc_id, lang, source FROM documents d WHERE source = 'src0'
AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.source <> 'src0' AND o.lang = d.lang AND md5(o.text) = md5(d.text))"""
)
def supersede_self_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("digest", F.md5("text"))
    old, new = docs.filter("source = 'src0'"), docs.filter("source <> 'src0'")
    return dml.supersede(old, new, ["lang", "digest"]).select("doc_id", "lang", "source")


@R.query(
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1"""
)
def keep_latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    found = dml.keep_latest(events, ["user_id", "event_type"], ["ts", "event_id"])
    return found.select("user_id", "event_type", "event_id", "value")


@R.query(
    """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, 'SUPPLIER' FROM supplier"""
)
def keyed_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"),
        F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"),
        F.col("s_acctbal").alias("c_acctbal"),
        F.lit("SUPPLIER").alias("c_mktsegment"),
    )
    return dml.replace_by_key(read_table(spark, sf_dir, "customer"), supplier, ["c_custkey"])


@R.query(
    """SELECT c_custkey, c_name, coalesce(CASE WHEN n_regionkey = 1 THEN concat('REGION ', n_name) END,
CASE WHEN c_nationkey % 2 = 0 THEN 'EVEN' END, c_mktsegment) AS c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def overlay_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "nation")
    even = nation.filter("n_nationkey % 2 = 0").select("n_nationkey", F.lit("EVEN").alias("value"), F.lit(1).alias("ord"))
    named = nation.filter("n_regionkey = 1").select(
        "n_nationkey", F.concat(F.lit("REGION "), F.col("n_name")).alias("value"), F.lit(2).alias("ord")
    )
    overlays = even.unionByName(named).withColumnRenamed("n_nationkey", "c_nationkey")
    return dml.apply_overlays(customer, overlays, "c_nationkey", "c_mktsegment").select("c_custkey", "c_name", "c_mktsegment")


@R.query(
    """SELECT c_nationkey, c_custkey, c_mktsegment AS old, 'EVEN' AS new FROM customer WHERE c_nationkey % 2 = 0 AND c_mktsegment <> 'EVEN'"""
)
def overlay_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer")
    overlays = read_table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(
        F.col("n_nationkey").alias("c_nationkey"), F.lit("EVEN").alias("value"), F.lit(1).alias("ord")
    )
    changes = dml.overlay_changes(customer, overlays, "c_nationkey", "c_mktsegment", kept=("c_custkey",))
    return changes.filter("old IS NOT NULL").select("c_nationkey", "c_custkey", "old", "new")


@R.query(
    """WITH wanted AS (SELECT DISTINCT user_id, event_type FROM events), t AS (SELECT w.user_id, w.event_type, e.event_id, e.value,
  CASE WHEN e.event_type = w.event_type AND value > 5 THEN 1 WHEN value > 5 THEN 2 WHEN e.event_type = w.event_type THEN 3 END AS tier, ts
  FROM wanted w JOIN events e USING (user_id))
SELECT user_id, event_type, event_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY tier, ts DESC, event_id DESC) rn
FROM t WHERE tier IS NOT NULL) WHERE rn = 1"""
)
def cache_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    wanted = events.select("user_id", "event_type").distinct()
    cache = events.select("user_id", "event_id", "value", "ts", F.col("event_type").alias("kind"))
    same, good = F.col("kind") == F.col("event_type"), F.col("value") > 5
    tier = F.when(same & good, 1).when(good, 2).when(same, 3)
    found = dml.tiered_lookup(wanted, cache, ["user_id"], tier, [F.desc("ts"), F.desc("event_id")])
    return found.select("user_id", "event_type", "event_id", "tier")


@R.query(
    """SELECT o_orderpriority AS k, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY 1
UNION ALL SELECT c_mktsegment, count(*) FROM customer WHERE c_nationkey <> 3 GROUP BY 1"""
)
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "key")
    orders = read_table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "key")
    left = dml.delete_cascade({"orders": orders, "customer": customer}, customer.filter("c_nationkey = 3"), "key")
    count = lambda t, c: left[t].groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n"))
    return count("orders", "o_orderpriority").unionByName(count("customer", "c_mktsegment"))


@R.query(
    """SELECT l_partkey, CAST(sum(q) AS BIGINT) AS quantity, count(*) AS lines, bit_or(b) AS bits FROM
(SELECT l_partkey, CAST(l_quantity AS BIGINT) AS q, CAST(1 AS BIGINT) << l_linenumber AS b FROM lineitem) GROUP BY 1"""
)
def additive_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    one = lambda df: df.groupBy("l_partkey").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"),
        F.count("*").alias("lines"),
        F.bit_or(F.expr("shiftleft(CAST(1 AS BIGINT), l_linenumber)")).alias("bits"),
    )
    first, second = one(lines.filter("l_returnflag = 'A'")), one(lines.filter("l_returnflag <> 'A'"))
    return dml.merge_counts(first, second, ["l_partkey"], ["quantity", "lines"], ["bits"])
