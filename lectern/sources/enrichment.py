"""Readers of what comes beside the texts: inventories, chapter lists, catalog pages, database files, scanned pages, and staged imports."""

from __future__ import annotations

import re
import sqlite3
import tempfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import stable_id
from lectern.operators import scans
from lectern.sources.text_formats import _local, repair_xml

_XML_NS = "{http://www.w3.org/XML/1998/namespace}"


def _trees(files: DataFrame, schema: str, rows_of) -> DataFrame:
    """Rows that ``rows_of`` gives for the root of each file's XML; files that can't be parsed give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    root = ET.fromstring(content or "")
                except ET.ParseError:
                    try:
                        root = ET.fromstring(repair_xml(content or ""))
                    except ET.ParseError:
                        continue
                rows += [(path, *r) for r in rows_of(root)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def _text(node: ET.Element | None) -> str | None:
    return None if node is None else " ".join("".join(node.itertext()).split()) or None


def inventories(files: DataFrame) -> DataFrame:
    """``path, kind, urn, group_urn, title, language`` of text groups, works, editions and translations of inventories."""

    def rows(root: ET.Element) -> Iterator[tuple]:
        def walk(node: ET.Element, group: str | None) -> Iterator[tuple]:
            for e in [node] if node is root else node:
                kind = _local(e.tag)
                if kind in ("textgroup", "work", "edition", "translation"):
                    title = next((_text(c) for c in e if _local(c.tag) in ("groupname", "title", "label")), None)
                    yield kind, e.get("urn"), group or e.get("groupUrn") or e.get("workUrn"), title, e.get(f"{_XML_NS}lang")
                    yield from walk(e, e.get("urn")) if e is not node else _below(e)
                elif e is not node:
                    yield from walk(e, group)

        def _below(e: ET.Element) -> Iterator[tuple]:
            for c in e:
                if _local(c.tag) in ("work", "edition", "translation"):
                    title = next((_text(x) for x in c if _local(x.tag) in ("title", "label")), None)
                    yield _local(c.tag), c.get("urn"), e.get("urn"), title, c.get(f"{_XML_NS}lang")
                    yield from _below(c)

        if _local(root.tag) in ("textgroup", "work"):
            yield from walk(root, None)
        else:
            for e in root.iter():
                if _local(e.tag) == "textgroup":
                    title = next((_text(c) for c in e if _local(c.tag) in ("groupname", "title")), None)
                    yield "textgroup", e.get("urn"), None, title, None
                    yield from _below(e)

    return _trees(files, "path string, kind string, urn string, group_urn string, title string, language string", rows)


def chapter_infos(files: DataFrame) -> DataFrame:
    """``path, subject_id, key, value``: attributes and child elements of each chapter of a list."""

    def rows(root: ET.Element) -> Iterator[tuple]:
        for e in root.iter():
            if _local(e.tag) == "chapter":
                subject = e.get("id") or _text(next((c for c in e if _local(c.tag) == "id"), None))
                yield from ((subject, k, v) for k, v in e.items() if k != "id" and v)
                yield from ((subject, _local(c.tag), _text(c)) for c in e if _local(c.tag) != "id" and _text(c))

    return _trees(files, "path string, subject_id string, key string, value string", rows)


def catalog_results(files: DataFrame) -> DataFrame:
    """``path, subject, item_no, title, url, author`` of a catalog page in Markdown: below ``# subject`` items ``1. [title](url)`` with
    ``Author:`` lines under them."""
    text = F.col("content")
    subject = F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))
    items = F.regexp_extract_all(text, F.lit(r"(?ms)^(\d+\.\s+\[.*?)(?=^\d+\.\s+\[|\z)"), F.lit(1))
    each = files.select("path", subject.alias("subject"), F.explode(items).alias("i"))
    part = lambda pattern: F.nullif(F.trim(F.regexp_extract("i", pattern, 1)), F.lit(""))
    return each.select(
        "path", "subject", part(r"^(\d+)\.").cast("int").alias("item_no"), part(r"^\d+\.\s+\[([^\]]*)\]").alias("title"),
        part(r"\]\(([^)]*)\)").alias("url"), part(r"(?m)^\s*Author:\s*(.+)$").alias("author"),
    )


def subject_facets(files: DataFrame) -> DataFrame:
    """``path, subject, works`` of ``* [subject](url) 12`` lines."""
    found = F.regexp_extract_all("content", F.lit(r"(?m)^\*\s+(\[[^\]]+\]\([^)]*\)\s+[\d,]+)\s*$"), F.lit(1))
    each = files.select("path", F.explode(found).alias("f"))
    return each.select("path", F.regexp_extract("f", r"^\[([^\]]+)\]", 1).alias("subject"), F.replace(F.regexp_extract("f", r"([\d,]+)$", 1), F.lit(","), F.lit("")).cast("bigint").alias("works"))


def database_rows(files: DataFrame, query: str, schema: str) -> DataFrame:
    """A query's rows from each SQLite file (``path, content`` binary), as any path that Spark reads may hold one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with tempfile.NamedTemporaryFile(suffix=".db") as f:  # of this task only, read before it goes
                    f.write(bytes(content))
                    f.flush()
                    db = sqlite3.connect(f"file:{f.name}?mode=ro&immutable=1", uri=True)
                    try:
                        yield pd.read_sql_query(query, db)
                    finally:
                        db.close()

    return files.select("content").mapInPandas(run, schema)


def database_files(groups: DataFrame, key: str, columns: list[str], table: str) -> DataFrame:
    """``key, content``: a SQLite file of each group's rows, for exchange; a group is small."""
    kinds = {"string": "TEXT", "bigint": "INTEGER", "int": "INTEGER", "double": "REAL"}
    own = dict(groups.dtypes)
    made = ", ".join(f"{c} {kinds[own[c]]}" for c in columns)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        with tempfile.NamedTemporaryFile(suffix=".db") as f:
            db = sqlite3.connect(f.name)
            db.execute(f"CREATE TABLE {table} ({made})")
            db.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(columns))})", part[columns].astype(object).values.tolist())
            db.commit()
            db.close()
            return pd.DataFrame({"path": [str(part[key].iloc[0])], "content": [open(f.name, "rb").read()]})

    return groups.groupBy(key).applyInPandas(build, "path string, content binary")


def scanned_lines(files: DataFrame) -> DataFrame:
    """``path, page, top, left, text`` of scanned pages as XML (``<page number><text top left>``)."""

    def rows(root: ET.Element) -> Iterator[tuple]:
        for page in root.iter("page"):
            for line in page.iter("text"):
                if _text(line):
                    yield int(page.get("number", 0)), int(line.get("top", 0)), int(line.get("left", 0)), _text(line)

    return _trees(files, "path string, page int, top int, left int, text string", rows)


def _in_reading_order(lines: DataFrame, middle: int) -> DataFrame:
    """Lines of pages of two columns, left before right, with their places over all pages of a book."""
    return scans.placed(lines.withColumn("_right", F.col("left") >= middle), ["path"], ["page", "_right", "top", "left"])


def _joined(lines: Column) -> Column:
    """Lines as one text; a word that a line's end has cut is one word."""
    return F.replace(F.regexp_replace(F.array_join(lines, "\n"), r"(\p{L})-\n(\p{Ll})", "$1$2"), F.lit("\n"), F.lit(" "))


def column_entries(lines: DataFrame, middle: int, head: Column) -> DataFrame:
    """``path, entry_no, page, text``: entries of pages of two columns, read left before right, also over page breaks; ``head`` tells an entry's
    first line.  A book's lines are counted part by part, so no task needs a whole book."""
    numbered = scans.counts(_in_reading_order(lines, middle), ["path"], {"entry_no": head.cast("int")})
    found = numbered.filter("entry_no > 0").groupBy("path", "entry_no").agg(F.array_sort(F.collect_list(F.struct("_n", "page", "text"))).alias("ls"))
    return found.select("path", "entry_no", F.get("ls", F.lit(0))["page"].alias("page"), _joined(F.col("ls")["text"]).alias("text"))


#: Marks of an entry's senses, from the highest level.
SENSE_MARKS = [r"^([IVX]+)\.?\s", r"^([A-H])\.?\s", r"^(\d+)[.)]?\s"]
_LEVELS = len(SENSE_MARKS)
#: States: outside, in an entry before its senses, in a sense of each level; symbols: other lines, a head, a mark of each level.
_SENSES = [[0, 1, *[0] * _LEVELS]] + [[s, 1, *range(2, 2 + _LEVELS)] for s in range(1, 2 + _LEVELS)]


def column_senses(lines: DataFrame, middle: int, head: Column) -> DataFrame:
    """``path, entry_no, block_no, level, mark, page, text``: the parts of scanned entries, nested by the marks that begin them, over columns and pages.

    ``level`` is 1 for what stands before the first mark, and 2, 3, 4 for senses; lines before the first entry belong to none.
    """
    marks = [F.regexp_extract("text", m, 1) for m in SENSE_MARKS]
    symbol = F.when(head, 1)
    for k, m in enumerate(marks):
        symbol = symbol.when(m != "", k + 2)
    rows = lines.withColumn("_symbol", symbol.otherwise(0))
    at = scans.states(_in_reading_order(rows, middle), ["path"], "_symbol", _SENSES, name="level")
    numbered = scans.counts(at, ["path"], {"entry_no": (F.col("_symbol") == 1).cast("int"), "block_no": ((F.col("_symbol") > 0) & (F.col("level") > 0)).cast("int")})
    own = numbered.filter("level > 0").withColumn("mark", F.when(F.col("_symbol") > 1, F.coalesce(*(F.nullif(m, F.lit("")) for m in marks))))
    found = own.groupBy("path", "entry_no", "block_no", "level").agg(F.array_sort(F.collect_list(F.struct("_n", "page", "mark", "text"))).alias("ls"))
    first = F.get("ls", F.lit(0))
    return found.select("path", "entry_no", "block_no", "level", first["mark"].alias("mark"), first["page"].alias("page"), _joined(F.col("ls")["text"]).alias("text"))


def linked_entries(files: DataFrame) -> DataFrame:
    """``path, key, body, prev, next`` of local dictionary XML (``<entry key prev next>``)."""

    def rows(root: ET.Element) -> Iterator[tuple]:
        for e in root.iter():
            if _local(e.tag) in ("entry", "entryFree", "div2"):
                yield e.get("key") or e.get("id"), _text(e), e.get("prev"), e.get("next")

    return _trees(files, "path string, key string, body string, prev string, next string", rows)


def stage_pages(pages: DataFrame, key: str, title: str, text: str, source: str, shortest: int) -> DataFrame:
    """Pages for an import: a stable id, the text without markup, its length and what is wrong with it, in order of importance."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"<[^>]*>|\{\{[^}]*\}\}|\[\[(?:[^|\]]*\|)?|\]\]", " "), r"\s+", " "))
    own = pages.select(F.col(key).cast("string").alias("source_key"), F.col(title).alias("title"), bare.alias("text"))
    checks = {"empty": F.col("text") == "", "short": F.char_length("text") < shortest, "untitled": F.coalesce("title", F.lit("")) == ""}
    flags = F.filter(F.array(*(F.when(c, k) for k, c in checks.items())), lambda x: x.isNotNull())
    return own.select(stable_id("stage:", F.lit(source), F.col("source_key")).alias("stage_id"), F.lit(source).alias("source"), "*", F.char_length("text").cast("bigint").alias("chars"), flags.alias("flags"))


def import_staged(staged: DataFrame, collection: str, language: str) -> DataFrame:
    """Rows of a reader (see ``catalog_readers``) from staged pages without a flag: a page is a work, its sentences are segments."""
    sentences = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return staged.filter(F.size("flags") == 0).select(
        F.concat(F.lit(f"{collection}/"), "source_key").alias("path"), F.lit(None).cast("string").alias("urn"), "title", F.lit(None).cast("string").alias("author"),
        F.lit(language).alias("language"), F.posexplode(sentences).alias("n", "text"), "stage_id",
    ).select(
        "path", "urn", "title", "author", "language", (F.col("n") + 1).cast("string").alias("citation"), F.lit("sentence").alias("kind"), (F.col("n") + 1).cast("int").alias("place"),
        "text", F.col("stage_id").alias("native_ref"), F.lit(None).cast("string").alias("error"),
    )


def number_key(text: str) -> str:
    """A dictionary number's letter and digits, without leading zeros."""
    m = re.match(r"\s*([A-Za-z]?)0*(\d+)", text or "")
    return f"{m[1].upper()}{m[2]}" if m else ""
