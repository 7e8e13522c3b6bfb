"""Schemas of the reading catalog's tables, and how frames are made to fit them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EVIDENCE = "evidence_source_type string, evidence_citation string, evidence_label string, evidence_retrieved_at string"

#: Column names and types are fixed values: they are the catalog's interchange format.
TABLES = {
    "works": "work_id string, collection_id string, language string, title string, author string, author_id string, "
    "source_id string, cts_work_urn string, canonical_text_id string",
    "editions": "edition_id string, work_id string, label string, language string, source_path string, cts_edition_urn string",
    "artifacts": "artifact_id string, work_id string, edition_id string, artifact_path string, source_path string, "
    "adapter string, source_hash string, segment_count int, token_count int",
    "aliases": "alias string, language string, kind string, target string, display string, source_file string, sources string",
    "source_files": "collection_id string, source_path string, file_role string, file_status string, source_id string, "
    "source_hash string, size_bytes bigint",
    "source_metadata": "collection_id string, subject_kind string, subject_id string, key string, value string, source_path string",
    "work_relations": "source_id string, target_id string, relation_type string, status string, confidence string, "
    "note string, source_file string",
    "metadata_overlays": "collection_id string, match_field string, match_value string, field string, value string, "
    f"status string, confidence string, note string, source_file string, {_EVIDENCE}",
    "metadata_attributions": "collection_id string, match_field string, match_value string, relation_type string, "
    f"agent string, status string, confidence string, note string, source_file string, {_EVIDENCE}",
    "work_classifications": "work_id string, category string, period string, authorship_status string, "
    "popularity_score int, scope string, discovery_group_id string, discovery_tags string, "
    "global_popularity_score int, group_popularity_score int",
    "author_classifications": "author_id string, language string, agent_kind string, historicity string, period string",
    "source_witnesses": "canonical_text_id string, work_id string, collection_id string, language string, witness_id string, "
    "source_id string, source_urn string, source_path string, status string, confidence string, note string",
    "contained_works": "parent_work_id string, contained_work_id string, title string, range_start string, range_end string, "
    "status string, source_file string",
    "work_map_nodes": "work_id string, node_id string, parent_node_id string, label string, level int, ordinal int, "
    "range_start string, range_end string",
    "division_metadata": "work_id string, division string, field string, value string, status string, evidence_citation string",
    "citation_maps": "work_id string, from_scheme string, to_scheme string, rule string, status string",
    "citation_references": "work_id string, segment_id string, reference string, normalized_ref string, scheme string",
    "translations": "translation_id string, source_lexicon string, entry_id string, occurrence int, source_text_hash string, "
    "translated_text string, status string, created_at string, updated_at string",
    "segments": "segment_id string, work_id string, edition_id string, segment_kind string, citation_path string, "
    "text string, source_text string, normalized_text string, sort_key int",
    "addresses": "address string, segment_id string, address_kind string, citation_path string",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order: a missing one is null, one of another type is cast, others are dropped."""
    kinds = dict(df.dtypes)
    columns = []
    for f in schema(table).fields:
        value = F.col(f.name) if f.name in kinds else F.lit(None)
        columns.append(value.cast(f.dataType).alias(f.name))
    return df.select(*columns)
