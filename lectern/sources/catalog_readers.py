"""Readers that make the catalog's tables: works, editions, artifacts, segments and addresses.

A file, or a group of files, is a work.  Parsers go through one file at a time in Arrow batches and give a row for each segment with
what the file says of its work; everything beyond the single file - which files are one work, the order of its segments, ids, counts
and addresses - is made of these rows by joins and aggregates.  A file that can't be parsed gives a row with its error.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import slug, stable_id
from lectern.sources.text_formats import _local, parse_plain, repair_xml

READ = "path string, urn string, title string, author string, language string, citation string, kind string, place int, text string, native_ref string, error string"
_NAMES = [c.split(" ")[0] for c in READ.split(", ")]


@dataclass
class Said:
    """What a file says of its work."""

    urn: str | None = None
    title: str | None = None
    author: str | None = None
    language: str | None = None


#: A segment: citation, kind, text, and the reference that the file itself gives it.
Segment = tuple[str, str, str, str | None]
Parser = Callable[[str], tuple[Said, Iterator[Segment]]]


def read(files: DataFrame, parse: Parser) -> DataFrame:
    """Rows of ``READ`` from ``path, content``; empty segments are left out, places count from 1 within a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    said, segments = parse(content or "")
                    kept = [s for s in segments if s[2]]
                    rows += [(path, said.urn, said.title, said.author, said.language, c, k, i, t, n, None) for i, (c, k, t, n) in enumerate(kept, 1)]
                except (ET.ParseError, ValueError, KeyError, TypeError, AttributeError) as e:
                    rows.append((path, *[None] * 9, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=_NAMES).astype({"place": "Int32"})

    return files.select("path", "content").mapInPandas(run, READ)


def _words(node: ET.Element) -> str:
    return " ".join("".join(node.itertext()).split())


def _root(text: str) -> ET.Element:
    try:
        return ET.fromstring(text)
    except ET.ParseError:
        return ET.fromstring(repair_xml(text))


def _first(root: ET.Element, tag: str) -> str | None:
    return next((_words(e) for e in root.iter() if _local(e.tag) == tag and _words(e)), None)


def tei(text: str) -> tuple[Said, Iterator[Segment]]:
    """Numbered lines and paragraphs below text parts, cited by the numbers on the way to them."""
    root = _root(text)
    edition = next((e for e in root.iter() if _local(e.tag) == "div" and e.get("type") in ("edition", "translation")), None)
    urn = edition.get("n") if edition is not None and (edition.get("n") or "").startswith("urn:") else None
    language = next((v for e in root.iter() if _local(e.tag) in ("text", "div") for k, v in e.items() if _local(k) == "lang"), None)

    def walk(node: ET.Element, path: tuple[str, ...], counts: list[int]) -> Iterator[Segment]:
        for child in node:
            tag, n = _local(child.tag), child.get("n")
            if tag in ("l", "p", "seg", "ab"):
                counts[0] += 1
                yield ".".join((*path, n or str(counts[0]))), "line" if tag == "l" else "paragraph", _words(child), child.get("corresp")
            else:
                part = tag == "div" and child.get("type") not in ("edition", "translation") and n
                yield from walk(child, (*path, n) if part else path, [0] if part else counts)

    bodies = [e for e in root.iter() if _local(e.tag) == "body"]
    return Said(urn, _first(root, "title"), _first(root, "author"), language), (s for b in bodies for s in walk(b, (), [0]))


def paragraphs_tei(text: str) -> tuple[Said, Iterator[Segment]]:
    """All paragraphs in order, numbered; an author that the header lacks is told from the title."""
    root = _root(text)
    title = _first(root, "title")
    found = (_words(e) for b in root.iter() if _local(b.tag) == "body" for e in b.iter() if _local(e.tag) == "p")
    return Said(None, title, resolved_author(_first(root, "author"), title, _first(root, "sourceDesc")), "lat"), (
        (str(i), "paragraph", t, None) for i, t in enumerate((t for t in found if t), 1)
    )


#: How titles and sources call an author whom they don't name, and what is shown for it.
UNNAMED = {"incerti auctoris": "Uncertain author", "anonymus": "Anonymous", "anonymi ": "Anonymous", "anonymous": "Anonymous"}
NOBODY = "Unattributed"


def resolved_author(*told: str | None) -> str:
    """The header's author, else what the title and the source (in this order) say in place of one."""
    author, *others = told
    low = " ".join(filter(None, others)).lower() + " "
    return author or next((shown for mark, shown in UNNAMED.items() if mark in low), NOBODY)


def verse_json(text: str) -> tuple[Said, Iterator[Segment]]:
    """``{"title", "author", "verses": [{"ref", "text"}]}`` or a list of verses."""
    data = json.loads(text)
    verses = data if isinstance(data, list) else data.get("verses") or data.get("lines") or []
    head = {} if isinstance(data, list) else data

    def each() -> Iterator[Segment]:
        for i, v in enumerate(verses, 1):
            if isinstance(v, dict):
                yield str(v.get("ref") or i), "verse", str(v.get("text") or "").strip(), v.get("ref")
            else:
                yield str(i), "verse", str(v).strip(), None

    return Said(head.get("urn"), head.get("title"), head.get("author"), head.get("language", "san")), each()


def plain(text: str) -> tuple[Said, Iterator[Segment]]:
    """Lines with text, after ``title:`` and ``author:`` lines."""
    rows = list(parse_plain(text))
    said = Said(None, rows[0][0], rows[0][1]) if rows else Said()
    return said, ((c, "line", t, None) for _, _, c, _, t in rows)


_NUMBER = re.compile(r"^\s*(?P<code>[A-Za-z]{0,8}[_ ]?\d+(?:[.,]\d+)*)(?P<part>[a-z]?)\s*[|:)\t ]\s*(?P<text>.*)$")


def numbered(text: str) -> tuple[Said, Iterator[Segment]]:
    """Lines that begin with their citation; lines without one go on with the segment before."""
    found: list[list[str]] = []
    for line in text.splitlines():
        if m := _NUMBER.match(line):
            code = re.sub(r"^[A-Za-z]+[_ ]?", "", m["code"]).replace(",", ".")
            found.append([code + m["part"], m["text"].strip(), m["code"] + m["part"]])
        elif found and line.strip():
            found[-1][1] = f"{found[-1][1]} {line.strip()}".strip()
    return Said(), ((c, "verse", t, n) for c, t, n in found)


def conllu(text: str) -> tuple[Said, Iterator[Segment]]:
    """Sentences with their ids; ``## text`` and ``## chapter`` say what they belong to, and chapter and ``sent_counter`` cite them."""
    said, chapter, out = Said(language="san"), None, []
    for number, block in enumerate(re.split(r"\n\s*\n", text), 1):
        own: dict[str, str] = {}
        forms = []
        for line in block.splitlines():
            if m := re.match(r"##\s*([\w ]+?)\s*:\s*(.*)", line):
                key, value = m[1].strip().lower(), m[2].strip()
                said.title = value if key == "text" else said.title
                said.author = value if key == "author" else said.author
                said.urn = value if key == "text_id" else said.urn
                chapter = value if key == "chapter" else chapter
            elif m := re.match(r"#\s*([\w:]+)\s*=\s*(.*)", line):
                own[m[1]] = m[2].strip()
            elif line.strip() and line.split("\t")[0].isdigit():
                forms.append(line.split("\t")[1])
        if forms or "text" in own:
            place = own.get("sent_counter") or str(number)
            out.append((f"{chapter}.{place}" if chapter else place, "sentence", own.get("text") or " ".join(forms), own.get("sent_id")))
    return said, iter(out)


# legacy text dumps: fixed values of a public format.  A byte from 0x80 on is a bookmark: the high half names a level (z innermost), the
# low half says how its value follows.
LEVELS = {0x8: "z", 0x9: "y", 0xA: "x", 0xB: "w", 0xC: "v", 0xD: "n"}
_ORDER = "nvwxyz"
BLOCK = 8192


def decode_dump(raw: bytes) -> Iterator[tuple[dict[str, str], str]]:
    """(level -> value, text) of each line of a dump: a line goes on until the next bookmark.

    0: the value goes up by one; 1-7: it is that number; 8 a byte's 7 bits, 9 these and a letter, 10 these and a string; 11 14 bits, 12 these and
    a letter, 13 these and a string; 14 the number stays, with a letter; 15 a string.  Levels below the changed one begin at 1 again.
    0xE0 on are descriptors (an author's and a work's number among them), 0xF0 is the end of a file, 0xFE of a block, 0xFF of a string.
    """
    state: dict[str, tuple[int, str]] = {}
    at, held, n = 0, bytearray(), len(raw)

    def string() -> str:
        nonlocal at
        end = raw.find(b"\xff", at)
        end = n if end < 0 else end
        out = bytes(b & 0x7F for b in raw[at:end]).decode("ascii", "ignore")
        at = end + 1
        return out

    def told() -> dict[str, str]:
        return {k: f"{v or ''}{s}" for k, (v, s) in state.items() if v or s}

    while at < n:
        b = raw[at]
        if b < 0x80:
            if b:
                held.append(b)
            at += 1
            continue
        if held.strip():
            yield told(), held.decode("ascii", "ignore").strip()
        held = bytearray()
        at += 1
        high, low = b >> 4, b & 0xF
        if b == 0xFE:
            at = -(-at // BLOCK) * BLOCK
            continue
        if high == 0xF:
            if b == 0xF0:
                break
            continue
        if high == 0xE:
            level = {0: "author", 1: "work", 2: "abbreviation", 4: "author_abbreviation"}.get(raw[at] & 0x7F, "other") if at < n else "other"
            at += 1
        else:
            level = LEVELS[high]
        number, letters = state.get(level, (0, ""))
        if low == 0:
            number, letters = number + 1, ""
        elif low < 8:
            number, letters = low, ""
        elif low in (8, 9, 10):
            number, letters = raw[at] & 0x7F, ""
            at += 1
        elif low in (11, 12, 13):
            number, letters = (raw[at] & 0x7F) << 7 | raw[at + 1] & 0x7F, ""
            at += 2
        elif low == 15:
            number, letters = 0, string()
        if low in (9, 12, 14):
            letters = chr(raw[at] & 0x7F)
            at += 1
        elif low in (10, 13):
            letters = string()
        state[level] = (number, letters)
        if level in _ORDER:
            for lower in _ORDER[_ORDER.index(level) + 1 :]:
                if lower in state:
                    state[lower] = (1, "")
        elif level == "work":
            for k in _ORDER:
                state.pop(k, None)
    if held.strip():
        yield told(), held.decode("ascii", "ignore").strip()


DUMP = "path string, work string, citation string, place int, text string, error string"


def read_dumps(files: DataFrame, greek: bool = False) -> DataFrame:
    """Rows of ``DUMP`` from ``path, content`` (binary): lines in order with the number of their work and their citation; with ``greek``
    their text is read as beta code."""
    from lectern.functions.scripts import beta_to_greek

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                try:
                    for i, (levels, text) in enumerate(decode_dump(bytes(raw)), 1):
                        citation = ".".join(levels[k] for k in _ORDER if k in levels)
                        rows.append((path, levels.get("work"), citation, i, beta_to_greek(text) if greek else text, None))
                except (IndexError, KeyError) as e:
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in DUMP.split(", ")]).astype({"place": "Int32"})

    return files.select("path", "content").mapInPandas(run, DUMP)


def decode_index(raw: bytes) -> list[dict[str, str | int]]:
    """Works of an index of a dump: number, name, first block, the author's id and name, labels of the levels.

    1 and 2 open an author and a work, with the length of what follows and the first block (two bytes each); 16 names one of them: its level, a
    length and text; 17 labels a level alike; 0 ends.  Other records have a length of two bytes.
    """
    works: list[dict[str, str | int]] = []
    author: dict[str, str] = {}
    now: dict = author
    at = 0
    while at < len(raw) and raw[at]:
        kind = raw[at]
        if kind in (1, 2):
            if kind == 1:
                author = {"author_id": "", "author": ""}
                now = author
            else:
                now = {"block": raw[at + 3] << 8 | raw[at + 4], "work": "", "title": "", "levels": "", "author_id": author.get("author_id", ""), "author": author.get("author", "")}
                works.append(now)
            at += 5
            if at < len(raw) and raw[at] >> 4 == 0xE:  # the number as a string bookmark
                end = raw.find(b"\xff", at)
                now["author_id" if kind == 1 else "work"] = bytes(b & 0x7F for b in raw[at + 2 : end]).decode("ascii", "ignore")
                at = end + 1
        elif kind in (16, 17):
            size = raw[at + 2]
            text = raw[at + 3 : at + 3 + size].decode("latin-1")
            if kind == 16:
                now["author" if raw[at + 1] == 0 else "title"] = text
            else:
                now["levels"] = f"{now.get('levels', '')}{',' if now.get('levels') else ''}{text}"
            at += 3 + size
        else:
            at += 3 + (raw[at + 1] << 8 | raw[at + 2] if at + 2 < len(raw) else 0)
    return works


INDEX = "path string, work string, title string, block int, author_id string, author string, levels string"


def read_indexes(files: DataFrame) -> DataFrame:
    """Rows of ``INDEX`` from ``path, content`` (binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in INDEX.split(", ")]
        for batch in batches:
            rows = [(path, *(w[k] for k in names[1:])) for path, raw in zip(batch["path"], batch["content"], strict=True) for w in decode_index(bytes(raw))]
            yield pd.DataFrame(rows, columns=names).astype({"block": "Int32"})

    return files.select("path", "content").mapInPandas(run, INDEX)


def split_works(lines: DataFrame, works: DataFrame, stem: Column) -> DataFrame:
    """Lines of dumps with the title and author that their index gives their work; ``stem`` joins a dump's and an index's path."""
    keyed = works.select(stem.alias("stem"), "work", "title", "author_id", "author")
    return lines.withColumn("stem", stem).join(keyed, ["stem", "work"])


#: An author's record in such a table, and the mark of a language's letter.
AUTHOR_RECORD = r"^\s*([A-Z]{3})([A-Za-z0-9]{4})\s+([^\u0083]+)"
LANGUAGE_MARK = r"\u0083([A-Za-z])"


def author_table(files: DataFrame, languages: dict[str, str]) -> DataFrame:
    """``path, author_id, key, value`` of author tables (binary): records between 0xFF, each an id, a name, and a language's letter after 0x83;
    a record with a star sets the language of those after it that have no letter."""
    records = files.select("path", F.posexplode(F.split(F.decode("content", "ISO-8859-1"), "\u00ff")).alias("no", "record"))
    known = F.create_map(*(F.lit(x) for kv in languages.items() for x in kv))
    letter = F.nullif(F.regexp_extract("record", LANGUAGE_MARK, 1), F.lit(""))
    head = F.col("record").startswith("*")
    marked = records.select("*", letter.alias("letter"), F.when(head, known[letter]).alias("set"))
    before = Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    own = marked.withColumn("language", F.when(F.col("letter").isNull(), F.last("set", ignorenulls=True).over(before)).otherwise(known[F.col("letter")]))
    part = lambda i: F.regexp_extract("record", AUTHOR_RECORD, i)
    authors = own.filter(~head & F.col("record").rlike(AUTHOR_RECORD)).select(
        "path", F.lower(F.concat(part(1), part(2))).alias("author_id"), F.trim(F.regexp_replace(part(3), r"\s+", " ")).alias("name"), "language"
    )
    said = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("name", "language")))
    return authors.select("path", "author_id", F.inline(said)).filter("value <> ''")


# from rows to tables


def stem(path: Column) -> Column:
    """A file's name without its ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)


def natural(path: Column) -> Column:
    """A path as parts that sort as people number files: 2 before 10."""
    parts = F.regexp_extract_all(path, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 24, "0")).otherwise(p))


def with_fallback_urn(rows: DataFrame, namespace: str, name: Column | None = None) -> DataFrame:
    """Rows whose file gives no urn have one made of the file's name."""
    made = F.concat(F.lit(f"urn:cts:{namespace}:"), slug(stem(F.col("path")) if name is None else name))
    return rows.withColumn("urn", F.coalesce("urn", made))


def one_work(rows: DataFrame, work: Column) -> DataFrame:
    """Rows of several files as one work: ``work`` names it, and its segments are numbered in the files' natural order; what
    the first file that says anything of the work says holds for it."""
    keyed = rows.filter("error IS NULL").withColumn("work_key", work)
    order = F.struct(natural(F.col("path")), F.col("place"))
    said = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("urn", "title", "author", "language")]
    head = keyed.groupBy("work_key").agg(*said)
    placed = keyed.drop("urn", "title", "author", "language").withColumn("place", F.row_number().over(Window.partitionBy("work_key").orderBy(natural(F.col("path")), "place")))
    return placed.join(head, "work_key")


def catalog_tables(rows: DataFrame, collection: str, adapter: str) -> dict[str, DataFrame]:
    """The catalog's tables from a reader's rows; a work is known by its key, its urn or its path, in this order."""
    good = rows.filter("error IS NULL")
    key = F.coalesce(F.col("work_key") if "work_key" in rows.columns else F.lit(None), F.col("urn"), F.col("path"))
    work = stable_id("work:", F.lit(collection), key)
    own = good.select("*", work.alias("work_id"), F.lit(collection).alias("collection_id"))
    own = own.withColumn("segment_id", F.concat("work_id", F.lit(":"), F.col("place").cast("string")))
    address = F.concat(F.coalesce("urn", F.concat(F.lit("urn:ctsv2:"), "work_id")), F.lit(":"), "citation")
    by_work = own.groupBy("work_id", "collection_id").agg(
        F.min("urn").alias("cts_work_urn"), F.min("title").alias("title"), F.min("author").alias("author"), F.min("language").alias("language"),
        F.min("path").alias("source_path"), F.count("*").cast("int").alias("segment_count"),
        F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).cast("int").alias("token_count"),
    )
    edition = F.concat("work_id", F.lit(":e")).alias("edition_id")
    return {
        "works": by_work.select("work_id", "collection_id", "language", F.coalesce("title", stem(F.col("source_path"))).alias("title"), "author", "cts_work_urn", stem(F.col("source_path")).alias("source_id")),
        "editions": by_work.select(edition, "work_id", F.lit(adapter).alias("label"), "language", "source_path", F.col("cts_work_urn").alias("cts_edition_urn")),
        "artifacts": by_work.select(F.concat("work_id", F.lit(":a")).alias("artifact_id"), "work_id", edition, "source_path", F.lit(adapter).alias("adapter"), "segment_count", "token_count"),
        "segments": own.select("segment_id", "work_id", F.col("kind").alias("segment_kind"), F.col("citation").alias("citation_path"), "text", F.col("place").alias("sort_key")),
        "addresses": own.select(address.alias("address"), "segment_id", F.lit("cts").alias("address_kind"), F.col("citation").alias("citation_path")).unionByName(
            own.filter("native_ref IS NOT NULL").select(F.concat(F.lit("native:"), "native_ref").alias("address"), "segment_id", F.lit("native").alias("address_kind"), F.col("citation").alias("citation_path"))
        ),
    }
