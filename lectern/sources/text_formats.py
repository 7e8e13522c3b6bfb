"""Readers of the text formats that corpora and dictionaries come in.

Each reads whole files (``binaryFile`` or ``wholetext``) or lines with Spark's readers and parses them in Arrow batches with the
standard library, so any path that Spark reads will do.  A file that can't be parsed gives a row with its error, never a failed job.
"""

from __future__ import annotations

import html
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = "path string, work_title string, author string, citation string, sort_key int, text string, error string"


def whole_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, content``: files as text, also those in folders below."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("content"))


def _segments(files: DataFrame, parse: Callable[[str], Iterable[tuple]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path, *r, None) for r in parse(content or "")]
                except (ET.ParseError, ValueError, KeyError) as e:
                    rows.append((path, None, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "work_title", "author", "citation", "sort_key", "text", "error"]).astype(
                {"sort_key": "Int32"}
            )

    return files.mapInPandas(run, SEGMENTS)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


_BARE_AMP = re.compile(r"&(?!#?\w+;)")


def repair_xml(text: str) -> str:
    """Named entities as characters and bare ampersands escaped; the five of XML stay."""
    known = {"amp", "lt", "gt", "quot", "apos"}
    text = re.sub(r"&(\w+);", lambda m: m[0] if m[1] in known else html.escape(html.unescape(m[0])), text)
    return _BARE_AMP.sub("&amp;", text)


def parse_tei(text: str) -> Iterator[tuple]:
    """(title, author, citation, sort key, text) of each innermost unit: numbered lines, paragraphs or text parts."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        root = ET.fromstring(repair_xml(text))
    head = {k: " ".join("".join(e.itertext()).split()) for k in ("title", "author") for e in root.iter() if _local(e.tag) == k}
    count = 0

    def walk(node: ET.Element, path: tuple[str, ...]) -> Iterator[tuple]:
        nonlocal count
        for child in node:
            tag, n = _local(child.tag), child.get("n")
            if tag in ("l", "p", "seg", "ab"):
                count += 1
                own = (*path, n) if n else (*path, str(count)) if tag != "p" or not path else path
                yield head.get("title"), head.get("author"), ".".join(own), count, " ".join("".join(child.itertext()).split())
            elif tag == "div":
                part = child.get("type") in ("textpart", None) or child.get("subtype") is not None
                yield from walk(child, (*path, n) if n and part and child.get("type") != "edition" else path)
            else:
                yield from walk(child, path)

    for body in (e for e in root.iter() if _local(e.tag) == "body"):
        yield from walk(body, ())


def read_tei(spark: SparkSession, path: str) -> DataFrame:
    return _segments(whole_files(spark, path, "*.xml"), parse_tei)


def parse_conllu(text: str) -> Iterator[tuple]:
    """Sentences of a CoNLL-U file; ``# text`` if it is given, else the forms; ``sent_id`` as citation."""
    title = author = None
    number = 0
    for block in re.split(r"\n\s*\n", text):
        meta: dict[str, str] = {}
        forms = []
        for line in block.splitlines():
            if m := re.match(r"##\s*(\w+):\s*(.*)", line):
                title = m[2] if m[1] in ("text", "title") else title
                author = m[2] if m[1] == "author" else author
            elif m := re.match(r"#\s*([\w:]+)\s*=\s*(.*)", line):
                meta[m[1]] = m[2].strip()
            elif line.strip() and not line.startswith("#"):
                columns = line.split("\t")
                if len(columns) >= 2 and columns[0].isdigit():
                    forms.append(columns[1])
        if forms or "text" in meta:
            number += 1
            yield title, author, meta.get("sent_id", str(number)), number, meta.get("text") or " ".join(forms)


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    return _segments(whole_files(spark, path, "*.conllu"), parse_conllu)


def parse_plain(text: str) -> Iterator[tuple]:
    """A segment for each line with text; ``key: value`` lines before the first blank line are metadata."""
    lines = text.splitlines()
    meta, body = {}, 0
    for i, line in enumerate(lines):
        if m := re.match(r"(title|author|edition)\s*:\s*(.*)", line, re.IGNORECASE):
            meta[m[1].lower()] = m[2].strip()
            body = i + 1
        else:
            break
    number = 0
    for line in lines[body:]:
        if line.strip():
            number += 1
            m = re.match(r"\s*([\d.]+)[\s|/]+(.*)", line)
            yield meta.get("title"), meta.get("author"), m[1].rstrip(".") if m else str(number), number, (m[2] if m else line).strip()


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    return _segments(whole_files(spark, path, "*.txt"), parse_plain)


def parse_verse_json(text: str) -> Iterator[tuple]:
    """Lines of words from ``{"text", "author", "lines": [[{"w": ...}]]}``."""
    data = json.loads(text)
    for i, line in enumerate(data.get("lines") or [], 1):
        yield data.get("text"), data.get("author"), str(i), i, " ".join(str(w.get("w", "")) for w in line)


def read_verse_json(spark: SparkSession, path: str) -> DataFrame:
    return _segments(whole_files(spark, path, "*.json"), parse_verse_json)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by schema; lines that don't parse keep their text in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_table_text(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    """CSV or TSV with a header, by schema."""
    return spark.read.schema(schema).option("header", True).option("sep", separator).option("multiLine", True).option("escape", '"').csv(path)


def read_markdown_table(lines: DataFrame, names: list[str]) -> DataFrame:
    """Rows of a pipe table from ``value`` lines; the head and its rule are left out."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda t: F.trim(t))
    rows = lines.filter(F.trim("value").startswith("|") & ~F.col("value").rlike(r"^\s*\|[\s:|-]+\|?\s*$")).select(cells.alias("c"))
    body = rows.filter(F.lower(F.get("c", 0)) != names[0].lower())
    return body.select(*(F.get("c", i).alias(n) for i, n in enumerate(names)))


def read_fixed_width(lines: DataFrame, fields: dict[str, tuple[int, int]]) -> DataFrame:
    """Columns by (first place from 1, width) of ``value`` lines."""
    return lines.select(*(F.trim(F.substring("value", at, width)).alias(n) for n, (at, width) in fields.items()))


class _Page(HTMLParser):
    """Title, links, headings and visible text of a page."""

    HIDDEN = ("script", "style", "noscript", "template")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.links: list[str] = []
        self.title: list[str] = []
        self.raw_title: str | None = None
        self.lang: str | None = None
        self.stack: list[str] = []
        self.title_from = 0

    def read(self, text: str) -> None:
        self.text = text
        self.feed(text)
        self.close()

    def place(self) -> int:
        """Where in the text the parser is."""
        line, column = self.getpos()
        at = 0
        for _ in range(line - 1):
            at = self.text.index("\n", at) + 1
        return at + column

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag == "html":
            self.lang = own.get("lang")
        if tag == "a" and own.get("href"):
            self.links.append(own["href"])
        if tag == "title" and self.raw_title is None:
            self.title_from = self.place() + len(self.get_starttag_text())
        if tag in self.HIDDEN or tag == "title":
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag == "title" and self.raw_title is None and self.title_from:
            self.raw_title = self.text[self.title_from : self.place()]
        if self.stack and self.stack[-1] == tag:
            self.stack.pop()

    def handle_data(self, data):
        if self.stack and self.stack[-1] == "title":
            self.title.append(data)
        elif not self.stack and data.strip():
            self.parts.append(data)


def parse_html(pages: DataFrame, key: str, source: str) -> DataFrame:
    """``key, title, raw_title, lang, n_links, body_text``; the raw title is the first one as it's written, with its character references."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch[key], batch[source], strict=True):
                page = _Page()
                page.read(text or "")
                rows.append((k, "".join(page.title), page.raw_title, page.lang, len(page.links), " ".join(" ".join(page.parts).split())))
            yield pd.DataFrame(rows, columns=[key, "title", "raw_title", "lang", "n_links", "body_text"])

    return pages.select(key, source).mapInPandas(run, f"{key} {kind}, title string, raw_title string, lang string, n_links bigint, body_text string")


def read_curated(spark: SparkSession, path: str, schema: str, pattern: str = "*") -> DataFrame:
    """Records of curated JSON or YAML files, one list or mapping in each; YAML needs the optional ``yaml`` library.

    Curated lists are small; nested lists stay arrays, to be unrolled with ``explode``.
    """

    def load(content: str) -> list:
        try:
            data = json.loads(content)
        except ValueError:
            import yaml

            data = yaml.safe_load(content)
        return data if isinstance(data, list) else [data] if data else []

    lines = F.udf(lambda c: [json.dumps(r, ensure_ascii=False, default=str) for r in load(c)], "array<string>")
    rows = whole_files(spark, path, pattern).select("path", F.explode(lines("content")).alias("line"))
    return rows.select("path", F.from_json("line", schema).alias("r")).select("path", "r.*")
