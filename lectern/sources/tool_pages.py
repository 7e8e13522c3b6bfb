"""Tools' own HTML pages as answers: lexicon pages with nested definitions, and pages of analyses by colour.

Pages are walked through as events.  A definition's level is how far it is set in; what is set in further is within it, so a path of
numbers tells where each stands: ``00`` is what stands before all definitions, ``01:00`` the first one within the first.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.claims import COLORS

_SPACE = re.compile(r"\s+")
_INDENT = re.compile(r"padding-left:\s*(\d+)")
_CITED = "origjump"
#: What a lexicon page says where it hasn't the word, and how a page of analyses begins.
NO_MATCH, ANALYSIS = "Could not find dictionary headword", "Perseus an"
_VOID = {"br", "hr", "img", "input", "link", "meta", "col"}


def _clean(parts: list[str]) -> str:
    return _SPACE.sub(" ", "".join(parts)).strip()


class LexiconPage(HTMLParser):
    """Chunks between rules: ``kind`` (match, fuzzy, analysis), the term, its blocks, and the lines of an analysis."""

    def __init__(self, text: str):
        super().__init__()
        self.no_match = False
        self.chunks: list[dict] = []
        self._open: list[tuple[str, list | None]] = []  # tags, and the list that their text goes to
        self._begin()
        self.feed(text)
        self.close()
        self._finish()

    def _begin(self) -> None:
        self.now = {"term": [], "title": [], "lines": [], "root": [], "blocks": []}
        self._levels: list[tuple[int, int]] = [(0, 0)]  # indents that are open, with the number of their last definition

    def _finish(self) -> None:
        now = self.now
        told = _clean(now["root"])
        self.no_match |= NO_MATCH in told
        if _clean(now["title"]).startswith(ANALYSIS):
            self.chunks.append({"kind": "analysis", "lines": [line for line in map(_clean, now["lines"]) if line]})
        elif _clean(now["term"]) or now["blocks"]:
            blocks = [{"path": b["path"], "text": _clean(b["text"]).rstrip(","), "citations": [{"ref": r, "text": _clean(t)} for r, t in b["citations"]]} for b in now["blocks"]]
            self.chunks.append({"kind": "fuzzy" if self.no_match else "match", "term": _clean(now["term"]), "blocks": blocks})
        self._begin()

    def handle_starttag(self, tag: str, attributes) -> None:
        have = dict(attributes)
        if tag == "hr":
            self._finish()
        if tag in _VOID:
            return
        target = None
        classes = (have.get("class") or "").split()
        if tag == "h1":
            target = self.now["title"]
        elif tag == "h2":
            target = self.now["term"]
        elif tag in ("li", "p"):
            self.now["lines"].append([])
            target = self.now["lines"][-1]
        elif tag == "div" and have.get("id") == "sense":
            found = _INDENT.search(have.get("style") or "")
            self.now["blocks"].append({"path": self._path(int(found[1]) if found else 0), "text": [], "citations": []})
            target = self.now["blocks"][-1]["text"]
        elif _CITED in classes and self.now["blocks"]:
            self.now["blocks"][-1]["citations"].append((" ".join(c for c in classes if c != _CITED).lower(), []))
        self._open.append((tag, target))

    def _path(self, indent: int) -> str:
        while len(self._levels) > 1 and self._levels[-1][0] > indent:
            self._levels.pop()
        if self._levels[-1][0] < indent:
            self._levels.append((indent, 0))
        else:
            self._levels[-1] = (self._levels[-1][0], self._levels[-1][1] + 1)
        return ":".join(f"{n:02d}" for _, n in self._levels)

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self._open) - 1, -1, -1) if self._open[k][0] == tag), None)
        if at is not None:
            del self._open[at:]  # tags that were left open end with it

    def handle_data(self, data: str) -> None:
        target = next((t for _, t in reversed(self._open) if t is not None), self.now["root"])
        target.append(data)
        if self.now["blocks"] and self.now["blocks"][-1]["citations"] and self._open and self._open[-1][0] == "span":
            self.now["blocks"][-1]["citations"][-1][1].append(data)


def _analysis(line: str) -> dict | None:
    """``stem, stem (gloss): tag tag`` taken apart."""
    stems, sign, tags = line.partition(":")
    if not sign:
        return None
    glosses = [re.sub(r"\d+", "", g).strip() for part in re.findall(r"\((.*?)\)", stems) for g in part.split(",")]
    forms = [re.sub(r"\d+", "", s).strip() for s in re.sub(r"\(.*?\)", " ", stems).split(",")]
    told = list(dict.fromkeys(re.sub(r"[()]", "", tags).replace("/", " ").split()))
    return {"forms": [f for f in forms if f], "senses": [g for g in glosses if g], "pos": told[0] if told else None, "features": told[1:]}


def lexicon_answer(text: str) -> dict:
    """A page as the answer that claims are made of."""
    page = LexiconPage(text)
    chunks, lemmas = [], []
    for c in page.chunks:
        if c["kind"] == "analysis":
            found = [a for a in map(_analysis, c["lines"]) if a]
            chunks += [{"kind": "analysis", **a} for a in found]
            lemmas += [f for a in found for f in a["forms"][:1]]
        else:
            term = re.sub(r"[,(].*", "", c["term"]).strip()
            cited = [x["text"] for b in c["blocks"] for x in b["citations"]]
            chunks.append({"kind": c["kind"], "reference": term, "senses": [b["text"] for b in c["blocks"] if b["text"]], "citations": cited})
            lemmas.append(term)
    return {"lemmas": list(dict.fromkeys(x for x in lemmas if x)), "no_match": page.no_match, "chunks": chunks}


class AnalysisPage(HTMLParser):
    """Tables whose class is a colour, with a word and what it can be: ``[ lemma ]{ tag tag }``."""

    _TAGS = re.compile(r"\[\s*([^\]]+?)\s*\]\s*\{\s*([^}]*?)\s*\}")

    def __init__(self, text: str):
        super().__init__()
        self.analyses: list[dict] = []
        self._tables: list[dict | None] = []
        self._word = False
        self.feed(text)
        self.close()

    def handle_starttag(self, tag: str, attributes) -> None:
        kind = dict(attributes).get("class") or ""
        if tag == "table":
            color = kind.removesuffix("_back")
            self._tables.append({"color": color, "word": [], "text": []} if color in COLORS else None)
        self._word = tag == "th" or self._word and tag != "td"

    def handle_endtag(self, tag: str) -> None:
        if tag == "th":
            self._word = False
        if tag == "table" and self._tables:
            table = self._tables.pop()
            if table:
                for lemma, tags in self._TAGS.findall("".join(table["text"])):
                    variants = [{"tags": " ".join(v.split())} for v in tags.split("|") if v.strip()]
                    self.analyses.append({"word": _clean(table["word"]), "color": table["color"], "lemma": lemma, "variants": variants})

    def handle_data(self, data: str) -> None:
        table = next((t for t in reversed(self._tables) if t), None)
        if table:
            table["word" if self._word else "text"].append(data)


def analysis_answer(text: str) -> dict:
    found = AnalysisPage(text).analyses
    return {"lemma": found[0]["lemma"] if found else None, "analyses": [{k: a[k] for k in ("word", "color", "variants")} for a in found]}


def page_answers(answers: DataFrame, read: Callable[[str], dict]) -> DataFrame:
    """``call_id, payload`` (JSON) of ``call_id, html`` pages; null pages have none."""
    kind = dict(answers.dtypes)["call_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                payloads = [None if t is None else json.dumps(read(t), ensure_ascii=False) for t in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("call_id"), pa.array(payloads, pa.string())], names=["call_id", "payload"])

    return answers.select("call_id", "html").mapInArrow(run, f"call_id {kind}, payload string").filter("payload IS NOT NULL")


_BLOCKS = "chunks array<struct<kind:string,term:string,blocks:array<struct<path:string,text:string,citations:array<struct<ref:string,text:string>>>>>>"


def lexicon_blocks(answers: DataFrame) -> DataFrame:
    """``call_id, kind, term, path, text, citations`` (array of ``ref, text``): each definition of lexicon pages with its place among the others."""
    pages = page_answers(answers, lambda t: {"chunks": [c for c in LexiconPage(t).chunks if c["kind"] != "analysis"]})
    each = pages.select("call_id", F.inline(F.from_json("payload", f"struct<{_BLOCKS}>")["chunks"]))
    return each.select("call_id", "kind", "term", F.inline("blocks"))
