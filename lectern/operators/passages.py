"""Pages of a book: sections, encounters, tables of contents, concept mentions and plans for summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import stable_id

#: Patterns of a page's first lines, in order of precedence.
SECTIONS = [("contents", r"(?i)^\W*(table of )?contents\b"), ("index", r"(?i)^\W*index\b"), ("preface", r"(?i)^\W*(preface|introduction)\b")]


def section_of(text: Column) -> Column:
    out = None
    for name, pattern in SECTIONS:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("body")


def encounters(pages: DataFrame, book: str, page: str, label: Column) -> DataFrame:
    """A span for each label: from its first page to the page before the next label's first, or the book's last page."""
    marked = pages.withColumn("_label", label)
    last = pages.groupBy(book).agg(F.max(page).alias("_last"))
    first = marked.filter(F.col("_label") != "").groupBy(book, "_label").agg(F.min(page).alias("page_start"))
    following = F.lead("page_start").over(Window.partitionBy(book).orderBy("page_start", "_label"))
    ends = first.withColumn("_next", following).join(last, book)
    end = F.greatest("page_start", F.coalesce(F.col("_next") - 1, F.col("_last")))
    return ends.select(book, F.col("_label").alias("label"), "page_start", end.alias("page_end"))


def mentions(pages: DataFrame, keys: list[str], text: str, terms: list[str], width: int) -> DataFrame:
    """Every place of each term, with ``width`` characters on either side; the terms are a short list and travel in the plan."""
    found = None
    for term in terms:
        pattern = rf"(?i)(.{{0,{width}}}\b{term}\b.{{0,{width}}})"
        own = pages.select(*keys, F.lit(term).alias("term"), F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("context"))
        found = own if found is None else found.unionByName(own)
    return found


def contents_entries(pages: DataFrame, book: str, page: str, text: str) -> DataFrame:
    """Lines ``title .... page`` of contents pages in order."""
    line = F.posexplode(F.split(text, "\n")).alias("line_no", "line")
    lines = pages.filter(section_of(F.col(text)) == "contents").select(book, page, line)
    part = lambda i: F.regexp_extract("line", r"^\s*(.+?)[\s.]{2,}(\d+)\s*$", i)
    entries = lines.select(book, page, "line_no", part(1).alias("title"), part(2).alias("_to")).filter("_to <> ''")
    return entries.withColumn("to_page", F.col("_to").cast("int")).drop("_to")


def summary_plan(units: DataFrame, key: list[str], text: str, model: str) -> DataFrame:
    """One planned summary for each unit, with a hash of its input, so that unchanged units needn't be done again."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    return units.select(*key, digest.alias("input_hash"), stable_id("plan-", *(F.col(k) for k in key), digest, F.lit(model)).alias("plan_id"))


def split_pages(rows: DataFrame, keys: list[str], text: str, mark: str = "\f") -> DataFrame:
    """``keys, page_no, page``: a text's parts between page marks, in order from 1."""
    return rows.select(*keys, F.posexplode(F.split(text, mark)).alias("n", "page")).select(*keys, (F.col("n") + 1).cast("bigint").alias("page_no"), "page")
