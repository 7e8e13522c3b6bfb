"""TEI files whose citations are marked by milestones that cut across elements, read as events in bounded memory.

A file is read as lines, so it may be split over tasks until here; its lines come back in order to one task, as XML can't be understood
from its middle, and are fed to an event parser.  Neither the file nor a tree of it is ever held: only what is open, the segment that
grows, and a frame of ``FRAME`` finished ones.

Numbered divisions open levels and close them.  A ``milestone`` sets its unit's level, whatever elements it stands in, ends the
deeper ones and holds until another one or the end of the division that it stands in; so does a numbered ``lb``, as a line.
``pb`` and ``cb`` don't cut: a segment's native reference is the page and column that it begins on.
"""

from __future__ import annotations

import re
import xml.parsers.expat as expat
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.catalog_readers import READ
from lectern.sources.text_formats import repair_xml

#: Levels of units, from the highest; a unit of another name goes below all that hold.
LEVELS = {"book": 0, "chapter": 1, "section": 2, "line": 3}
#: Divisions that are the text itself, not parts of it.
WHOLE = {"edition", "translation"}
FRAME = 5000
#: Elements whose text is a segment, and those that are no text of the work.
_TEXT, _ASIDE = {"p", "ab", "seg", "l"}, {"teiHeader"}
_DIV = re.compile(r"div\d*")


class Events:
    """One file's events: feed it text, take its segments (citation, kind, text, native reference)."""

    def __init__(self):
        self.said: dict[str, str | None] = {"urn": None, "title": None, "author": None, "language": None}
        self.segments: list[tuple[str, str, str, str | None]] = []
        self.count = 0
        self._open: list[tuple[str, list[str], list[str] | None]] = []
        self._parts: list[str] = []  # of the divisions
        self._active: list[str] = []  # of the milestones within them
        self._kind: str | None = None
        self._page = self._column = ""
        self._head: tuple[str, list[str]] | None = None
        self._text: list[str] | None = None
        self._depth = self._aside = 0
        self._native: str | None = None
        self._line: tuple[list[str], str] | None = None
        self._parser = expat.ParserCreate()
        self._parser.buffer_text = True
        self._parser.StartElementHandler = self._start
        self._parser.EndElementHandler = self._end
        self._parser.CharacterDataHandler = self._characters

    def feed(self, text: str, last: bool = False) -> None:
        """Read on; ``expat.ExpatError`` where it is no XML."""
        self._parser.Parse((repair_xml(text) if "&" in text else text).encode(), last)

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        tag = tag.rpartition(":")[2]
        number = attributes.get("n", "").strip()
        language = next((v for k, v in attributes.items() if k.rpartition(":")[2] == "lang"), None)
        if tag in ("text", "div") and language and not self.said["language"]:
            self.said["language"] = language
        before = None
        if tag in _ASIDE:
            self._aside += 1
        elif self._aside:
            if tag in ("title", "author") and not self.said[tag]:
                self._head = (tag, [])
        elif _DIV.fullmatch(tag):
            if number.startswith("urn:"):
                self.said["urn"] = self.said["urn"] or number
            elif number and attributes.get("type") not in WHOLE:
                before = self._active
                self._parts = [*self._parts, number]
                self._active, self._kind = self._parts, attributes.get("subtype")
        elif tag == "milestone" or tag == "lb" and number:
            self._milestone("line" if tag == "lb" else attributes.get("unit", "").strip(), number)
        elif tag in ("lb", "pb", "cb"):
            self._break(tag, number, attributes.get("break") == "no")
        elif tag in _TEXT:
            self._depth += 1
            if self._depth == 1:
                self._text, self._native = [], self._place()
                self._line = ([*self._parts, number], "line") if tag == "l" and number else None
        self._open.append((tag, self._parts, before))

    def _end(self, tag: str) -> None:
        tag, parts, before = self._open.pop()
        if self._head and tag == self._head[0]:
            self.said[tag] = " ".join("".join(self._head[1]).split()) or None
            self._head = None
        if tag in _ASIDE:
            self._aside -= 1
        elif tag in _TEXT and not self._aside:
            self._depth -= 1
            if not self._depth:
                self._emit()
                self._text = self._line = None
        if before is not None:
            self._parts, self._active, self._kind = parts[:-1], before, None

    def _characters(self, text: str) -> None:
        if self._head:
            self._head[1].append(text)
        elif self._text is not None:
            self._text.append(text)

    def _milestone(self, unit: str, number: str) -> None:
        self._emit()
        if number:
            level = LEVELS.get(unit)
            if level is None:
                own = [*self._active, number]
            else:
                # places of levels that nothing has numbered are empty
                held = [*self._active[: level + 1], *[""] * (level + 1 - len(self._active))]
                own = [*held[:level], number]
            self._active = own
            self._kind = unit or self._kind
        self._native = self._place()

    def _break(self, tag: str, number: str, joined: bool) -> None:
        if tag == "pb":
            self._page, self._column = number, ""
        elif tag == "cb":
            self._column = number
        if self._text is not None:
            if not joined:
                self._text.append(" ")
            if not "".join(self._text).strip():
                self._native = self._place()

    def _place(self) -> str | None:
        return ":".join(filter(None, (self._page, self._column))) or None

    def _emit(self) -> None:
        if self._text is None:
            return
        text = " ".join("".join(self._text).split())
        self._text = []
        if text:
            self.count += 1
            parts, kind = self._line or (self._active, self._kind or ("section" if self._active else "paragraph"))
            self.segments.append((".".join(filter(None, parts)) or str(self.count), kind, text, self._native))
        self._native = self._place()


def file_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``path, block, line_no, value``: the lines of a folder's files; blocks and numbers grow in a file's order."""
    lines = spark.read.option("recursiveFileLookup", True).text(folder)
    at = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    return lines.select(*at, F.monotonically_increasing_id().alias("line_no"), "value")


def read_milestones(lines: DataFrame) -> DataFrame:
    """Rows as the catalog's readers give them, from ``path, block, line_no, value`` lines.

    A file that isn't XML from some place on gives its segments to there and a row with the error; one without a line gives none.
    """
    names = [c.split(" ")[0] for c in READ.split(", ")]
    kinds = [pa.int32() if c.endswith(" int") else pa.string() for c in READ.split(", ")]

    def frames(path: str, events: Events, place: int, error: str | None = None) -> Iterator[pa.RecordBatch]:
        said = [events.said[k] for k in ("urn", "title", "author", "language")]
        rows = [(path, *said, c, k, place + i, t, n, None) for i, (c, k, t, n) in enumerate(events.segments, 1)]
        events.segments.clear()
        if error is not None:
            rows.append((path, *[None] * 9, error[:200]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = events = None
        place = 0

        def ended() -> Iterator[pa.RecordBatch]:
            error = None
            try:
                events.feed("", True)
            except expat.ExpatError as e:
                error = f"ExpatError: {e}"
            yield from frames(path, events, place, error)

        for batch in batches:
            for own, line in zip(batch.column("path"), batch.column("value"), strict=True):
                own = own.as_py()
                if own != path:
                    if events is not None:
                        yield from ended()
                    path, events, place = own, Events(), 0
                if events is None:  # the rest of a file that has failed
                    continue
                try:
                    events.feed((line.as_py() or "") + "\n")
                except expat.ExpatError as e:
                    yield from frames(path, events, place, f"ExpatError: {e}")
                    events = None
                    continue
                if len(events.segments) >= FRAME:
                    yield from frames(path, events, place)
                    place = events.count
        if events is not None:
            yield from ended()

    dealt = lines.repartition("path").sortWithinPartitions("path", "block", "line_no")
    return dealt.select("path", "value").mapInArrow(run, READ)
