"""Queries of what is written: tables in the store, exports and bundles, each read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import catalog, dml, tokens, translation
from lectern.plans.analogs import table, with_tables
from lectern.plans.registry import Registry
from lectern.sources import sinks
from lectern.sources.store import TableStore
from lectern.storage import cut, delete_folder, read_table, shared_dir

R = Registry()


def _store(spark: SparkSession) -> TableStore:
    return TableStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


def _done(store: TableStore, found: DataFrame) -> DataFrame:
    """The result, and the store goes."""
    out = cut(found)
    delete_folder(store.spark, store.folder)
    return out


def _s(c: str) -> Column:
    return F.col(c).cast("string")


@R.query(
    with_tables(
        "works",
        sql="""SELECT work_id, CASE WHEN CAST(work_id AS INT) % 10 = 3 THEN concat(title, ' 2') ELSE title END AS title, language FROM works WHERE CAST(work_id AS INT) % 7 <> 0
UNION ALL SELECT concat('x', CAST(n_nationkey AS STRING)), n_name, 'en' FROM nation""",
    )
)
def registered_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All works, then some of them anew and some more, then some go."""
    store, works = _store(spark), table(spark, sf_dir, "works")
    number = F.col("work_id").cast("int")
    store.replace("works", works)
    again = works.filter(number % 10 == 3).withColumn("title", F.concat("title", F.lit(" 2")))
    more = read_table(spark, sf_dir, "nation").select(F.concat(F.lit("x"), _s("n_nationkey")).alias("work_id"), F.col("n_name").alias("title"), F.lit("en").alias("language"))
    store.replace_keys("works", again.unionByName(more, allowMissingColumns=True), ["work_id"])
    store.delete_works(works.filter(number % 7 == 0).select("work_id"))
    return _done(store, store.read("works").select("work_id", "title", "language"))


@R.query(
    """SELECT CASE WHEN conv_id % 5 = 2 THEN concat('new ', CAST(turn AS STRING)) ELSE CAST(turn AS STRING) END AS citation_path, CAST(conv_id AS STRING) AS work_id, CAST(turn AS INT) AS sort_key
FROM conversations WHERE conv_id % 5 <> 2 OR turn < 2"""
)
def registered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole works of segments are replaced by shorter ones."""
    store, segments = _store(spark), table(spark, sf_dir, "segments")
    store.replace("segments", segments)
    some = segments.filter("CAST(work_id AS INT) % 5 = 2 AND sort_key < 2").withColumn("citation_path", F.concat(F.lit("new "), "citation_path"))
    store.replace_keys("segments", some, ["work_id"])
    return _done(store, store.read("segments").select("citation_path", "work_id", "sort_key"))


@R.query(
    """SELECT CAST(conv_id AS STRING) AS work_id, concat('1.', CAST(turn AS STRING)) AS reference, count(*) AS n FROM conversations WHERE conv_id % 4 <> 1 GROUP BY 1, 2
UNION ALL SELECT CAST(conv_id AS STRING), '9.9', count(DISTINCT conv_id) FROM conversations WHERE conv_id % 4 = 1 GROUP BY 1"""
)
def registered_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of some works are replaced; those of others, also of works that have none any more, stay or go with their work."""
    store, turns = _store(spark), read_table(spark, sf_dir, "conversations")
    own = turns.select(_s("conv_id").alias("work_id"), F.concat(F.lit("1."), _s("turn")).alias("reference"))
    store.replace("citation_references", own)
    fresh = turns.filter("conv_id % 4 = 1").select(_s("conv_id").alias("work_id"), F.lit("9.9").alias("reference")).distinct()
    store.replace_keys("citation_references", fresh, ["work_id"])
    return _done(store, store.read("citation_references").groupBy("work_id", "reference").agg(F.count("*").alias("n")))


@R.query(with_tables("aliases", sql="SELECT alias, language, kind, target, 2 AS times FROM aliases ORDER BY alias, target"))
def registered_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replace, and an append of the same, which is kept twice; listed in order."""
    store, aliases = _store(spark), table(spark, sf_dir, "aliases")
    store.replace("aliases", aliases)
    store.append("aliases", aliases)
    listed = catalog.list_rows(store.read("aliases").groupBy("alias", "language", "kind", "target").agg(F.count("*").cast("int").alias("times")), ["alias", "target"])
    return _done(store, listed)


_OVERLAYS = """o AS (SELECT p_type AS collection_id, 'work_id' AS match_field, CAST(p_partkey AS STRING) AS match_value, CASE s_suppkey % 3 WHEN 0 THEN 'language' ELSE 'title' END AS field,
  concat('fixed ', s_name) AS value, CASE WHEN s_suppkey % 2 = 0 THEN 'accepted' ELSE 'proposed' END AS status, s_name AS note FROM supplier JOIN part ON s_suppkey = p_partkey)"""


def _overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read_table(spark, sf_dir, "supplier").join(read_table(spark, sf_dir, "part"), F.col("s_suppkey") == F.col("p_partkey"))
    return both.select(
        F.col("p_type").alias("collection_id"), F.lit("work_id").alias("match_field"), _s("p_partkey").alias("match_value"),
        F.when(F.col("s_suppkey") % 3 == 0, "language").otherwise("title").alias("field"), F.concat(F.lit("fixed "), "s_name").alias("value"),
        F.when(F.col("s_suppkey") % 2 == 0, "accepted").otherwise("proposed").alias("status"), F.col("s_name").alias("note"),
    )


@R.query(f"WITH {_OVERLAYS} SELECT collection_id, match_value, field, value, note FROM o WHERE status = 'accepted' AND field = 'title' ORDER BY collection_id, match_value LIMIT 200")
def listed_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing by status and field: its first 200 rows."""
    store = _store(spark)
    store.replace("metadata_overlays", _overlays(spark, sf_dir))
    rows = catalog.list_rows(store.read("metadata_overlays"), ["collection_id", "match_value"], 200, status="accepted", field="title", match_value=None)
    return _done(store, rows.select("collection_id", "match_value", "field", "value", "note"))


@R.query(with_tables("works", sql="SELECT work_id, coalesce(value, title) AS title FROM works LEFT JOIN o ON match_value = work_id AND status = 'accepted' AND field = 'title'").replace("WITH ", f"WITH {_OVERLAYS}, ", 1))
def applied_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark)
    store.change({"works": store.replaced("works", table(spark, sf_dir, "works")), "metadata_overlays": store.replaced("metadata_overlays", _overlays(spark, sf_dir))})
    store.apply_overlays("title")
    return _done(store, store.read("works").select("work_id", "title"))


_SPOKEN = """w AS (SELECT CAST(conv_id AS STRING) AS work_id, max(turn) AS n FROM conversations GROUP BY 1),
l AS (SELECT work_id, CASE WHEN n % 5 = 0 THEN 'grc' WHEN n % 3 = 0 THEN 'lat' ELSE 'en' END AS language FROM w WHERE n % 7 <> 6)"""


@R.query(
    f"""WITH {_SPOKEN} SELECT 'works' AS kind, work_id AS key, language FROM l UNION ALL SELECT 'editions', 'e' || work_id, language FROM l UNION ALL SELECT 'aliases', 'a' || work_id, language FROM l
UNION ALL SELECT 'addresses', 'urn:' || conv_id || '.' || turn, NULL FROM conversations WHERE CAST(conv_id AS STRING) IN (SELECT work_id FROM l)"""
)
def works_with_all_theirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages that sources and words tell go on to editions and aliases; works go with all that is theirs."""
    store = _store(spark)
    turns = read_table(spark, sf_dir, "conversations").select(_s("conv_id").alias("work_id"), "turn")
    works = turns.groupBy("work_id").agg(F.max("turn").alias("n"))
    english = F.lit("en").alias("language")
    segment = F.concat_ws(".", "work_id", _s("turn"))
    store.change(
        {
            "works": store.replaced("works", works.select("work_id", english)),
            "editions": store.replaced("editions", works.select(F.concat(F.lit("e"), "work_id").alias("edition_id"), "work_id", english)),
            "aliases": store.replaced("aliases", works.select(F.concat(F.lit("a"), "work_id").alias("alias"), F.col("work_id").alias("target"), english)),
            "segments": store.replaced("segments", turns.select(segment.alias("segment_id"), "work_id")),
            "addresses": store.replaced("addresses", turns.select(F.concat(F.lit("urn:"), segment).alias("address"), segment.alias("segment_id"))),
        }
    )
    hits = works.filter("n % 3 = 0").select("work_id", F.lit("lat").alias("language"), F.lit(9).alias("hits"))
    told = works.filter("n % 5 = 0").select("work_id", F.lit("grc").alias("language"), F.lit(1).alias("rank"))
    store.repair_languages(hits, 5, told=told)
    store.delete_works(works.filter("n % 7 = 6"))
    out = None
    for kind, key in (("works", "work_id"), ("editions", "edition_id"), ("aliases", "alias"), ("addresses", "address")):
        rows = store.read(kind)
        own = rows.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col("language") if "language" in rows.columns and kind != "addresses" else F.lit(None).cast("string").alias("language"))
        out = own if out is None else out.unionByName(own)
    return _done(store, out)


@R.query(with_tables("attributions", sql="SELECT match_field, match_value, relation_type, agent, status FROM attributions WHERE status = 'accepted'"))
def registered_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, rows = _store(spark), table(spark, sf_dir, "attributions")
    store.replace("metadata_attributions", rows.limit(1))
    store.replace("metadata_attributions", rows)
    return _done(store, store.read("metadata_attributions").filter("status = 'accepted'").select("match_field", "match_value", "relation_type", "agent", "status"))


_CONTAINED = "c AS (SELECT concat('w', CAST(l_orderkey AS STRING)) AS parent_work_id, concat('w', CAST(l_partkey AS STRING)) AS contained_work_id FROM lineitem)"


@R.query(
    f"""WITH {_CONTAINED}, r AS (SELECT DISTINCT parent_work_id AS source_id, contained_work_id AS target_id, 'contains' AS relation_type FROM c
UNION ALL SELECT DISTINCT contained_work_id, parent_work_id, 'contained_in' FROM c) SELECT * FROM r WHERE relation_type = 'contained_in' ORDER BY source_id, target_id LIMIT 300"""
)
def listed_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contained works and the relations that follow from them, in one commit; the first 300 of one direction."""
    store = _store(spark)
    rows = read_table(spark, sf_dir, "lineitem")
    contained = rows.select(F.concat(F.lit("w"), _s("l_orderkey")).alias("parent_work_id"), F.concat(F.lit("w"), _s("l_partkey")).alias("contained_work_id")).distinct()
    relations = tokens.contained_relations(contained)
    store.change({"contained_works": store.replaced("contained_works", contained), "work_relations": store.replaced("work_relations", relations)})
    found = catalog.list_rows(store.read("work_relations"), ["source_id", "target_id"], 300, relation_type="contained_in")
    return _done(store, found.select("source_id", "target_id", "relation_type"))


@R.query(
    with_tables(
        "works",
        sql="""SELECT canonical_text_id, work_id, coalesce(cts_work_urn, source_id) AS witness_id, coalesce(cts_work_urn, '') AS source_urn, concat('/', work_id, '.xml') AS source_path, 'accepted' AS status
FROM works WHERE collection_id = 'PROMO' OR language = 'de'""",
    )
)
def listed_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Witnesses of the registered works, replaced once and appended to once."""
    store, works = _store(spark), table(spark, sf_dir, "works")
    editions = works.select(F.concat("work_id", F.lit("e")).alias("edition_id"), "work_id", F.concat(F.lit("/"), "work_id", F.lit(".xml")).alias("source_path"))
    found = catalog.source_witnesses(works, editions)
    promo = F.col("collection_id") == "PROMO"
    store.replace("source_witnesses", found.filter(promo))
    store.append("source_witnesses", found.filter(~promo & (F.col("language") == "de")))
    rows = catalog.list_rows(store.read("source_witnesses"), ["canonical_text_id", "witness_id"])
    return _done(store, rows.select("canonical_text_id", "work_id", "witness_id", "source_urn", "source_path", "status"))


@R.query(
    """SELECT concat('c', CAST(c_nationkey AS STRING)) AS work_id, c_custkey AS node, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 1 END AS level,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS ordinal FROM customer"""
)
def registered_map_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a work map, replaced; read with their place in the map."""
    from pyspark.sql import Window

    store = _store(spark)
    nodes = read_table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), _s("c_nationkey")).alias("work_id"), _s("c_custkey").alias("node_id"), F.when(F.col("c_custkey") % 10 == 0, 0).otherwise(1).alias("level"), F.col("c_custkey").cast("int").alias("ordinal")
    )
    store.replace("work_map_nodes", nodes.filter("level = 0"))
    store.replace("work_map_nodes", nodes)
    place = F.row_number().over(Window.partitionBy("work_id").orderBy("ordinal")).cast("bigint")
    return _done(store, store.read("work_map_nodes").select("work_id", F.col("node_id").cast("bigint").alias("node"), "level", place.alias("ordinal")))


@R.query(
    """SELECT concat('w', CAST(o_custkey AS STRING)) AS work_id, o_orderstatus AS division, count(*) AS n, max(o_orderpriority) AS value FROM orders GROUP BY 1, 2"""
)
def registered_divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Division metadata, a row for each piece of evidence: replaced by one part, appended with the rest."""
    store, orders = _store(spark), read_table(spark, sf_dir, "orders")
    rows = orders.select(
        F.concat(F.lit("w"), _s("o_custkey")).alias("work_id"), F.col("o_orderstatus").alias("division"), F.lit("priority").alias("field"),
        F.col("o_orderpriority").alias("value"), _s("o_orderkey").alias("evidence_citation"), (F.col("o_orderkey") % 2 == 0).alias("even"),
    )
    store.replace("division_metadata", rows.filter("even"))
    store.append("division_metadata", rows.filter("NOT even"))
    found = store.read("division_metadata").groupBy("work_id", "division").agg(F.count("*").alias("n"), F.max("value").alias("value"))
    return _done(store, found)


@R.query(
    """SELECT CAST(l_orderkey AS STRING) AS work_id, CASE WHEN l_orderkey % 3 = 0 THEN concat(CAST(l_linenumber AS STRING), '.', CAST(l_partkey AS STRING))
  ELSE concat(CAST(l_linenumber AS STRING), '.', CAST(l_suppkey AS STRING), '.', CAST(l_partkey AS STRING)) END AS citation FROM lineitem"""
)
def projected_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with an accepted citation map have their references projected."""
    store, lines = _store(spark), read_table(spark, sf_dir, "lineitem")
    work = _s("l_orderkey").alias("work_id")
    rule = F.lit("book.chapter.section>book.section").alias("rule")
    maps = lines.select(work, rule, F.when(F.col("l_orderkey") % 3 == 0, "accepted").otherwise("proposed").alias("status")).distinct()
    store.replace("citation_maps", maps)
    refs = lines.select(work, F.concat_ws(".", _s("l_linenumber"), _s("l_suppkey"), _s("l_partkey")).alias("citation"))
    return _done(store, catalog.projected_references(refs, store.read("citation_maps")))


@R.query(
    with_tables(
        "works",
        sql="""SELECT work_id, CASE WHEN CAST(work_id AS INT) % 2 = 0 THEN 'by id' ELSE 'by urn' END AS category FROM works
WHERE CAST(work_id AS INT) % 2 = 0 OR cts_work_urn IS NOT NULL""",
    )
)
def registered_classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of three kinds are resolved to works; a merge replaces those it has."""
    store, works = _store(spark), table(spark, sf_dir, "works")
    even = F.col("work_id").cast("int") % 2 == 0
    refs = works.select(F.when(even, F.col("work_id")).otherwise(F.coalesce("cts_work_urn", F.lit("nothing"))).alias("ref"), F.when(even, "by id").otherwise("by urn").alias("category"))
    store.replace("work_classifications", works.select("work_id", F.lit("old").alias("category")).filter(even))
    store.replace_keys("work_classifications", catalog.resolved_classifications(refs, works), ["work_id"])
    return _done(store, store.read("work_classifications").select("work_id", "category"))


@R.query(
    with_tables(
        "works",
        sql="""SELECT DISTINCT author_id, language, CASE WHEN language = 'de' THEN 'group' ELSE 'person' END AS agent_kind FROM works WHERE author_id <> '' AND language IN ('de', 'fr')""",
    )
)
def registered_author_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifications of authors that the catalog has, merged by author and language."""
    store, works = _store(spark), table(spark, sf_dir, "works")
    known = works.filter("author_id <> ''").select("author_id", "language").distinct()
    rows = known.filter("language IN ('de', 'fr')").withColumn("agent_kind", F.lit("person"))
    unknown = known.withColumn("author_id", F.concat("author_id", F.lit("?"))).withColumn("agent_kind", F.lit("person"))
    store.replace("author_classifications", catalog.known_authors(rows.unionByName(unknown), works))
    store.replace_keys("author_classifications", rows.filter("language = 'de'").withColumn("agent_kind", F.lit("group")), ["author_id", "language"])
    return _done(store, store.read("author_classifications").select("author_id", "language", "agent_kind"))


@R.query(
    """SELECT n_name AS collection_id, concat('/', CAST(s_suppkey AS STRING)) AS source_path, CASE WHEN s_suppkey % 4 = 0 THEN 'changed' ELSE 'ok' END AS file_status FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE s_suppkey % 4 = 0 OR s_nationkey % 2 = 0 ORDER BY collection_id, source_path"""
)
def listed_source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files by path: a second registration replaces the paths it has."""
    store = _store(spark)
    files = read_table(spark, sf_dir, "supplier").join(read_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = files.select(F.col("n_name").alias("collection_id"), F.concat(F.lit("/"), _s("s_suppkey")).alias("source_path"), F.lit("ok").alias("file_status"), "s_suppkey", "s_nationkey")
    store.replace("source_files", rows.filter("s_nationkey % 2 = 0"))
    store.replace_keys("source_files", rows.filter("s_suppkey % 4 = 0").withColumn("file_status", F.lit("changed")), ["source_path"])
    return _done(store, catalog.list_rows(store.read("source_files"), ["collection_id", "source_path"]).select("collection_id", "source_path", "file_status"))


@R.query(
    """SELECT concat('/', CAST(n_regionkey AS STRING)) AS source_path, n_name AS subject_id, 'name' AS key, n_name AS value FROM nation WHERE n_regionkey <> 1
UNION ALL SELECT '/1', 'all', 'count', CAST(count(*) AS STRING) FROM nation WHERE n_regionkey = 1"""
)
def listed_source_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and value rows by path: all rows of an incoming path go."""
    store, nation = _store(spark), read_table(spark, sf_dir, "nation")
    path = F.concat(F.lit("/"), _s("n_regionkey")).alias("source_path")
    store.replace("source_metadata", nation.select(path, F.col("n_name").alias("subject_id"), F.lit("name").alias("key"), F.col("n_name").alias("value")))
    fresh = nation.filter("n_regionkey = 1").groupBy(path).agg(F.count("*").cast("string").alias("value"))
    store.replace_keys("source_metadata", fresh.select("source_path", F.lit("all").alias("subject_id"), F.lit("count").alias("key"), "value"), ["source_path"])
    return _done(store, catalog.list_rows(store.read("source_metadata"), ["source_path", "subject_id"]).select("source_path", "subject_id", "key", "value"))


_HASH = "substr(sha256(text), 1, 8)"


@R.query(
    f"""SELECT concat('t', CAST(doc_id AS STRING)) AS translation_id, CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE 'first' END AS status, 'day 1' AS created_at,
  CASE WHEN doc_id % 3 = 0 THEN 'day 2' ELSE 'day 1' END AS updated_at, {_HASH} AS source_text_hash FROM documents WHERE NOT (source = 'src3' AND doc_id % 3 = 0)"""
)
def kept_creation_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations written again keep when they were made; then those of one lexicon and status are cleared."""
    store, docs = _store(spark), read_table(spark, sf_dir, "documents")

    def rows(d: DataFrame, status: str, day: str) -> DataFrame:
        return d.select(
            F.concat(F.lit("t"), _s("doc_id")).alias("translation_id"), F.col("source").alias("source_lexicon"), F.substring(F.sha2("text", 256), 1, 8).alias("source_text_hash"),
            F.lit(status).alias("status"), F.lit(day).alias("created_at"), F.lit(day).alias("updated_at"),
        )

    store.replace("translations", rows(docs, "first", "day 1"))
    now = store.read("translations")
    fresh = rows(docs.filter("doc_id % 3 = 0"), "second", "day 2").select(*(F.col(c) if c in ("translation_id", "source_lexicon", "source_text_hash", "status", "created_at", "updated_at") else F.lit(None).alias(c) for c in now.columns))
    store.replace("translations", dml.upsert_keeping(now, fresh, ["translation_id"], "created_at"))
    gone = store.read("translations").filter("source_lexicon = 'src3' AND status = 'second'")
    store.delete_keys("translations", gone, ["translation_id"])
    return _done(store, store.read("translations").select("translation_id", "status", "created_at", "updated_at", "source_text_hash"))


@R.query("SELECT user_id, event_type, count(*) AS rejections FROM events WHERE value < 3 GROUP BY 1, 2")
def rejection_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rejections each key has: the generation that a cache entry must be newer than."""
    rejected = read_table(spark, sf_dir, "events").filter("value < 3")
    found = translation.retry_generation(rejected, ["user_id", "event_type"])
    kept = [c for c in found.columns if c not in ("user_id", "event_type")]
    return found.select("user_id", "event_type", F.col(kept[0]).cast("bigint").alias("rejections"))


@R.query(
    """SELECT substr(sha256(concat_ws(chr(31), lang, CAST(doc_id AS STRING))), 1, 12) AS key, doc_id, lang, length(text) AS chars FROM documents WHERE length(text) BETWEEN 200 AND 900"""
)
def restored_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of cards, written as a snapshot of JSON lines and restored from it; cards whose key isn't that of their content go."""
    folder = f"{shared_dir(spark)}/pool-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents").filter("char_length(text) BETWEEN 200 AND 900")
    key = lambda: X.stable_id("", F.col("lang"), F.col("doc_id"), digits=12)
    cards = docs.select(key().alias("key"), "doc_id", "lang", F.char_length("text").cast("bigint").alias("chars"))
    broken = cards.limit(3).withColumn("lang", F.lit("??"))
    sinks.write_json(cards.unionByName(broken), folder)
    back = spark.read.schema("key string, doc_id bigint, lang string, chars bigint").json(folder)
    out = cut(back.filter(F.col("key") == key()))
    delete_folder(spark, folder)
    return out


@R.query(with_tables("works", sql="SELECT collection_id, count(*) AS works, min(title) AS first_title, max(work_id) AS last_id FROM works GROUP BY 1"))
def exported_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source index as delimited text, a folder for each collection, read back."""
    folder = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    sinks.write_delimited(table(spark, sf_dir, "works").select("work_id", "title", "collection_id"), folder, by=["collection_id"])
    back = spark.read.option("header", True).option("sep", "\t").schema("work_id string, title string, collection_id string").csv(folder)
    out = cut(back.groupBy("collection_id").agg(F.count("*").alias("works"), F.min("title").alias("first_title"), F.max("work_id").alias("last_id")))
    delete_folder(spark, folder)
    return out


@R.query("SELECT * FROM (VALUES ('nation', 'row-count'), ('region', 'checksum')) v(name, issue)")
def bundle_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle in which one table then loses a row and one has a value changed."""
    folder = f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}"
    tables = {n: read_table(spark, sf_dir, n) for n in ("nation", "region", "supplier")}
    sinks.write_bundle(tables, folder)
    tables["nation"].filter("n_nationkey <> 3").write.mode("overwrite").parquet(f"{folder}/nation")
    tables["region"].withColumn("r_name", F.when(F.col("r_regionkey") == 1, "other").otherwise(F.col("r_name"))).write.mode("overwrite").parquet(f"{folder}/region")
    out = cut(sinks.bundle_issues(spark, folder))
    delete_folder(spark, folder)
    return out


@R.query(
    """WITH e AS (SELECT p_name AS key, arg_max(p_partkey, p_partkey) AS entry_no, arg_max(p_type, p_partkey) AS body FROM part GROUP BY 1)
SELECT key, entry_no, body, unnest(string_split(key, ' ')) AS block, generate_subscripts(string_split(key, ' '), 1) AS block_no FROM e"""
)
def dictionary_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries, the last of each key, and their blocks, written as two tables and joined back."""
    folder = f"{shared_dir(spark)}/entries-{uuid.uuid4().hex}"
    entries = dml.keep_latest(read_table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.col("p_partkey").alias("entry_no"), F.col("p_type").alias("body")), ["key"], ["entry_no"])
    sinks.write_table(entries, f"{folder}/entries")
    blocks = spark.read.parquet(f"{folder}/entries").select("key", F.posexplode(F.split("key", " ")).alias("block_no", "block"))
    sinks.write_table(blocks.withColumn("block_no", (F.col("block_no") + 1).cast("bigint")), f"{folder}/blocks")
    out = cut(spark.read.parquet(f"{folder}/entries").join(spark.read.parquet(f"{folder}/blocks"), "key").select("key", "entry_no", "body", "block", "block_no"))
    delete_folder(spark, folder)
    return out


@R.query(
    """SELECT 'unknown-author' AS issue, CAST(c_custkey AS STRING) AS item FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 200 WHERE s_suppkey IS NULL
UNION ALL SELECT 'unknown-work', CAST(o_orderkey AS STRING) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"""
)
def foreign_key_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a build whose author or work isn't there: anti joins that have to be empty."""
    from lectern.operators import evidence

    customer, orders = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders")
    authors = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"))
    lost = customer.withColumn("a", F.col("c_custkey") % 200).join(authors, "a", "left_anti")
    stray = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return evidence.validation_issues({"unknown-author": (lost, "c_custkey"), "unknown-work": (stray, "o_orderkey")})


@R.query(with_tables("classifications", sql="SELECT category, count(*) AS n, count(popularity_score) AS scored FROM classifications GROUP BY 1"))
def classification_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifications as CSV, read back by schema: empty cells are null."""
    from lectern.sources.text_formats import read_table_text

    folder = f"{shared_dir(spark)}/classes-{uuid.uuid4().hex}"
    sinks.write_delimited(table(spark, sf_dir, "classifications").select("work_id", "category", "popularity_score"), folder, ",")
    back = read_table_text(spark, folder, "work_id string, category string, popularity_score int")
    out = cut(back.groupBy("category").agg(F.count("*").alias("n"), F.count("popularity_score").alias("scored")))
    delete_folder(spark, folder)
    return out
