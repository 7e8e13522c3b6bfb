"""The catalog's tables as they are read from the synthetic ones, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.storage import read_table

#: Both engines read the same definitions: a table is a name and a SQL statement over the synthetic tables.
WORKS = """
  SELECT CAST(p_partkey AS STRING) AS work_id, p_type AS collection_id,
         CASE p_size % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END AS language,
         p_name AS title,
         CASE WHEN p_size = 7 THEN 'unknown' WHEN p_size = 9 THEN concat('pseudo-', p_brand) ELSE p_brand END AS author,
         CASE WHEN p_size % 5 = 0 THEN '' ELSE lower(concat(p_brand, '/', p_type)) END AS author_id,
         concat('src', CAST(p_size AS STRING)) AS source_id,
         CASE WHEN p_size % 3 = 0 THEN NULL ELSE concat('urn:', CAST(p_partkey AS STRING)) END AS cts_work_urn,
         concat(replace(p_name, ' ', '-'), '.', p_type, '.', p_brand) AS canonical_text_id
  FROM part"""
ARTIFACTS = """
  SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS artifact_id,
         CAST(l_partkey AS STRING) AS work_id, l_linestatus AS edition_id, l_returnflag AS adapter,
         l_linenumber AS segment_count, CAST(l_quantity AS INT) AS token_count
  FROM lineitem"""
CLASSIFICATIONS = """
  SELECT CAST(p_partkey AS STRING) AS work_id,
         CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size END AS popularity_score,
         CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size * 2 END AS global_popularity_score,
         CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 10 END AS group_popularity_score,
         p_type AS category, p_brand AS scope,
         CASE WHEN p_size % 11 = 0 THEN '' ELSE lower(p_type) END AS discovery_group_id,
         replace(p_name, ' ', '|') AS discovery_tags
  FROM part WHERE p_size <> 13"""
ALIASES = """
  SELECT concat('alias of ', s_name) AS alias, 'en' AS language, 'name' AS kind,
         CASE WHEN s_nationkey % 5 = 0 THEN 'nowhere' ELSE CAST(s_suppkey AS STRING) END AS target
  FROM supplier
  UNION ALL
  SELECT lower(n_name) AS alias, 'en' AS language, 'place' AS kind, CAST(s_suppkey AS STRING) AS target
  FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
ATTRIBUTIONS = """
  SELECT p_type AS collection_id, CASE WHEN s_suppkey % 2 = 0 THEN 'work_id' ELSE 'author' END AS match_field,
         CASE WHEN s_suppkey % 2 = 0 THEN CAST(p_partkey AS STRING) ELSE p_brand END AS match_value,
         CASE WHEN s_nationkey % 2 = 0 THEN 'author' ELSE 'traditional' END AS relation_type,
         concat('Agent ', CAST(s_nationkey AS STRING)) AS agent,
         CASE WHEN s_suppkey % 3 = 0 THEN 'accepted' ELSE 'proposed' END AS status,
         concat('cit ', CAST(s_suppkey AS STRING)) AS evidence_citation, s_name AS evidence_label
  FROM supplier JOIN part ON s_suppkey = p_partkey"""
SEGMENTS = """
  SELECT concat(CAST(conv_id AS STRING), '.', CAST(turn AS STRING)) AS segment_id, CAST(conv_id AS STRING) AS work_id,
         role AS segment_kind, CAST(turn AS STRING) AS citation_path, text, CAST(turn AS INT) AS sort_key
  FROM conversations"""
TABLES = {
    "works": (WORKS, ["part"]),
    "artifacts": (ARTIFACTS, ["lineitem"]),
    "classifications": (CLASSIFICATIONS, ["part"]),
    "aliases": (ALIASES, ["supplier", "nation"]),
    "attributions": (ATTRIBUTIONS, ["supplier", "part"]),
    "segments": (SEGMENTS, ["conversations"]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    statement, sources = TABLES[name]
    return spark.sql(
        _placed(statement, sources), **{s: read_table(spark, sf_dir, s) for s in sources}
    )


def _placed(statement: str, sources: list[str]) -> str:
    for s in sources:
        statement = statement.replace(f"FROM {s}", f"FROM {{{s}}}").replace(f"JOIN {s} ", f"JOIN {{{s}}} AS {s} ")
    return statement


def with_tables(*names: str, sql: str) -> str:
    """A statement with the analog tables it reads as common table expressions."""
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n][0]})" for n in names) + "\n" + sql
