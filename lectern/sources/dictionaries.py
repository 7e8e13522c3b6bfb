"""Readers of dictionary entries: XML and HTML entries, fixed-width word lists, cross references."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.scripts import plain_key
from lectern.sources.text_formats import repair_xml

ENTRY = "entry_no bigint, key string, key_normalized string, second_key string, hom int, body string, plain_text string, page_ref string, error string"


def parse_entry(raw: str) -> tuple:
    """(key, second key, homonym, body, plain text, page) of an entry's XML."""
    try:
        root = ET.fromstring(raw)
    except ET.ParseError:
        root = ET.fromstring(repair_xml(raw))
    first = lambda tag: next((e for e in root.iter() if e.tag.rpartition("}")[2] == tag), None)
    text = lambda e: None if e is None else " ".join("".join(e.itertext()).split())
    key, second, hom, body, page = (first(t) for t in ("key1", "key2", "hom", "body", "pc"))
    number = re.search(r"\d+", text(hom) or "")
    return text(key), text(second), int(number[0]) if number else None, None if body is None else ET.tostring(body, encoding="unicode"), text(body), text(page)


def read_entries(raw: DataFrame, number: str, data: str) -> DataFrame:
    """Entries from rows of a number and XML; a row that can't be parsed has its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for n, x in zip(batch[number], batch[data], strict=True):
                try:
                    key, second, hom, body, plain, page = parse_entry(x or "")
                    rows.append((n, key, plain_key(key or ""), second, hom, body, plain, page, None))
                except ET.ParseError as e:
                    rows.append((n, None, None, None, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ENTRY.split(", ")]).astype({"hom": "Int32", "entry_no": "Int64"})

    return raw.select(F.col(number).cast("bigint").alias(number), data).mapInPandas(run, ENTRY)


def headwords(entries: DataFrame) -> DataFrame:
    """A row for each search key of an entry: its key and, where it differs, its second key."""
    keys = F.array(
        F.struct(F.col("key").alias("search_key"), F.lit(True).alias("is_primary")),
        F.struct(F.col("second_key").alias("search_key"), F.lit(False).alias("is_primary")),
    )
    rows = entries.select("entry_no", "hom", "key", F.inline(keys))
    return rows.filter(F.col("search_key").isNotNull() & (F.col("is_primary") | (F.col("search_key") != F.col("key")))).drop("key")


def numbered_occurrences(entries: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Entries with their occurrence number among those of the same key."""
    from pyspark.sql import Window

    return entries.withColumn("occurrence", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def unique_entries(entries: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """The first of entries whose text is the same, with its hash."""
    hashed = entries.withColumn("entry_hash", F.sha2(F.coalesce(text, F.lit("")), 256))
    best = F.min_by(F.struct(*hashed.columns), order).alias("r")
    return hashed.groupBy(F.col(key).alias("_k"), F.col("entry_hash").alias("_h")).agg(best).select("r.*")


def resolve_references(entries: DataFrame, key: str, text: str) -> DataFrame:
    """Entries with the keys that their text refers to (``see key``) and that exist."""
    found = entries.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"(?i)\bsee (\w+)"), F.lit(1))).alias("target"))
    known = entries.select(F.col(key).alias("target")).distinct()
    return found.join(known, "target", "left_semi").groupBy(key).agg(F.array_sort(F.collect_set("target")).alias("references"))


def book_sources(paths: DataFrame, preferences: list[str]) -> DataFrame:
    """One path of each work (the folder before the file): that whose name has the first preferred mark."""
    rank = F.lit(len(preferences))
    for i, mark in reversed(list(enumerate(preferences))):
        rank = F.when(F.col("path").contains(mark), i).otherwise(rank)
    work = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return paths.groupBy(work.alias("work")).agg(F.min_by("path", F.struct(rank, F.col("path"))).alias("path"), F.count("*").alias("candidates"))
