"""Grammars of dictionary entries, as tables, and a parser that follows them.

A grammar maps a rule's name to an expression: a ``Word`` (a pattern, named if it is kept), another rule's name, or a tuple
that begins with ``seq``, ``or`` (the first that fits), ``many`` (none or more) or ``opt``.  A rule's result at a place is kept, so no
place is tried twice, and the farthest place that anything failed at is where a malformed entry's error is.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Word(NamedTuple):
    pattern: re.Pattern
    name: str = ""


class Node(NamedTuple):
    name: str
    text: str
    inside: tuple


def word(pattern: str, name: str = "") -> Word:
    return Word(re.compile(pattern, re.S), name)


_BLANK = re.compile(r"\s*")


class Grammar:
    """Rules whose names begin with an upper-case letter make nodes of their own; ``Entry`` is the first."""

    def __init__(self, rules: dict):
        self.rules = rules

    def parse(self, text: str) -> tuple[tuple[Node, ...], int | None]:
        """The entry's nodes, and None; or what was read, and the place where no rule goes on."""
        known: dict[tuple[str, int], tuple | None] = {}
        farthest = 0

        def match(rule, at: int):
            nonlocal farthest
            if isinstance(rule, Word):
                at = _BLANK.match(text, at).end()
                found = rule.pattern.match(text, at)
                if found is None:
                    farthest = max(farthest, at)
                    return None
                return found.end(), (Node(rule.name, found[0].strip(), ()),) if rule.name else ()
            if isinstance(rule, str):
                if (rule, at) not in known:
                    found = match(self.rules[rule], at)
                    if found and rule[0].isupper():
                        found = found[0], (Node(rule, text[at : found[0]].strip(), found[1]),)
                    known[rule, at] = found
                return known[rule, at]
            kind, *parts = rule
            if kind == "or":
                return next(filter(None, (match(p, at) for p in parts)), None)
            nodes: tuple = ()
            if kind == "seq":
                for p in parts:
                    found = match(p, at)
                    if found is None:
                        return None
                    at, nodes = found[0], nodes + found[1]
                return at, nodes
            each = []
            while found := match(parts[0], at):
                if found[0] == at:
                    break
                at = found[0]
                each.extend(found[1])
                if kind == "opt":
                    break
            return at, tuple(each)

        found = match("Entry", 0)
        if found is None:
            return (), farthest
        end = _BLANK.match(text, found[0]).end()
        return found[1][0].inside, None if end == len(text) else max(farthest, end)


def _either(words: str) -> str:
    return "|".join(sorted(words.split(), key=len, reverse=True))


# Marks of grammar, kinds of words, and usage in the dictionaries' entries.
MARKERS = "mfn adj adv pron part pn m f n v ind"
KINDS = (
    "preposition conjunction interjection participle adjective adverb pronoun verb noun prep conj interj part adj adv pron v"
)
GENDERS = r"m\.\s*or\s*f\.|f\.\s*or\s*m\.|m\.\s*f\.|f\.\s*m\."
ARTICLES = "ὁ ἡ τό"
USAGE = ["fig", "poet", "lit", "propr", "sens propre", "au fig", "par ext", "en part", "spécialt", "t. de", "terme de", "poét", "litt", "fam", "méd", "phil", "gram", "astr", "myth"]
ROMAN = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV"

_L = "A-Za-zÀ-ɏͰ-Ͽἀ-῿Ḁ-ỿ"
_MARKER = word(rf"(?:{_either(MARKERS)})\.", "marker")
_LEVELS = {"roman": rf"(?:{_either(ROMAN)})\.", "letter": r"[A-HJ-Z]\.", "number": r"\d+\.", "greek": r"[α-ω]\."}
_LEVEL = rf"(?:{'|'.join(_LEVELS.values())})(?=\s)"
_CITED = r"[A-Z][a-z]+\.?(?:\s*;\s*[A-Z][a-z]+\.?)*"
#: Abbreviations at the end of a sense.
_CITES = rf"{_CITED}(?=\s*$|\s+{_LEVEL})"

#: Numbered senses within lettered ones within Roman ones; a level may be left out.
_SENSE = {
    "senses": ("many", "roman"),
    "roman": ("or", "Roman", "letter"),
    "letter": ("or", "Letter", "number"),
    "number": ("or", "Number", "Greek"),
    "Roman": ("seq", word(_LEVELS["roman"] + r"(?=\s|$)", "level"), ("opt", "said"), ("many", "letter")),
    "Letter": ("seq", word(_LEVELS["letter"] + r"(?=\s|$)", "level"), ("opt", "said"), ("many", "number")),
    "Number": ("seq", word(_LEVELS["number"] + r"(?=\s|$)", "level"), ("opt", "said"), ("many", "Greek")),
    "Greek": ("seq", word(_LEVELS["greek"] + r"(?=\s|$)", "level"), ("opt", "said")),
    "said": ("seq", ("opt", ("seq", word(r"[a-z]+(?=\.,)", "qualifier"), word(r"\.,"))), ("opt", word(rf"(?!{_LEVEL})(?:(?!{_CITES})(?!\s{_LEVEL}).)+", "gloss")), ("opt", word(_CITES, "cited"))),
}

GRAMMARS = {
    # lupus, -i, m. (√lup) I. a wolf A. lit., a wolf Cic.; Hor.
    "diogenes": Grammar(
        {
            "Entry": ("seq", word(rf"[{_L}]+", "headword"), ("many", ("seq", word(","), "form")), ("opt", word("[.,]")), ("opt", "root"), "senses"),
            "form": (
                "or",
                word(rf"{GENDERS}|[mfn](?![{_L}])|{_either(ARTICLES)}", "gender"),
                word(rf"(?:{_either(KINDS)})(?![{_L}])", "pos"),
                word(rf"-[{_L}]+|[{_L}]{{2,}}|[iī](?![{_L}])", "part"),
            ),
            "root": ("seq", word(r"\("), ("opt", word("√|&#8730;")), word(rf"[{_L}]+", "root"), ("many", word(rf"[{_L}]+")), word(r"\)")),
            **_SENSE,
        }
    ),
    # 1. agni m. fire; cf. agnika; RV.; &c.
    "cdsl": Grammar(
        {"Entry": ("seq", ("opt", word(r"\d+\.", "number")), word(rf"(?!(?:{_either(MARKERS)})\.)[{_L}#._-]+", "headword"), ("many", _MARKER), ("opt", word(".+", "body")))}
    ),
    # dharma [ dharman ] m. n. loi, condition | devoir [ Mah. ] ; cf. svadharma
    "dico": Grammar(
        {
            "Entry": ("or", ("seq", word(rf"(?!(?:{_either(MARKERS)})\.)[{_L}._#-]+", "headword"), ("opt", "bracket"), "told"), "told"),
            "told": ("seq", ("many", _MARKER), "text", ("many", ("seq", word(r"\|"), "text"))),
            "bracket": ("seq", word(r"\["), word(r"[^\[\]]+", "bracketed"), word(r"\]")),
            "text": word(r"(?:[^|\[\]]|\[[^|\[\]]*\])+", "text"),
        }
    ),
    # lupus, i, m. 1 loup : lupus est Cic. Off. 1, 20 2 mors : ...
    "gaffiot": Grammar(
        {
            "Entry": ("or", ("seq", ("opt", word(r"(?!\d+\)?\s)(?:(?!\s\d+\)?\s+[^:;|\d]+:).)+(?=\s\d)", "preamble")), "Sense", ("many", "Sense")), word(".+", "text")),
            "Sense": ("seq", word(r"\d+(?=\)?\s)", "level"), ("opt", word(r"\)")), word(r"[^:;|]+(?=:)", "gloss"), word(":"), ("opt", word(r"(?!\d+\)?\s+[^:;|\d]+:)(?:(?!\s\d+\)?\s+[^:;|\d]+:).)+", "example"))),
        }
    ),
    # fig., amour (voir amor); passion
    "french": Grammar(
        {
            "Entry": ("seq", ("opt", "Gloss"), ("many", ("seq", word(r"[,;\n¶]|\\n"), ("opt", "Gloss")))),
            "Gloss": ("seq", ("opt", "usage"), ("opt", word(r"[^,;(¶\n]+", "text")), ("opt", "see")),
            "usage": ("seq", word(rf"(?:{'|'.join(sorted(USAGE, key=len, reverse=True))})(?![{_L}])", "qualifier"), ("opt", word(r"\.")), ("opt", word(","))),
            "see": ("seq", word(r"\("), word(r"(?:voir|cf|v)\b\.?"), ("opt", word(r"[^()]+", "cross")), word(r"\)")),
        }
    ),
}

_SENSE_TYPE = pa.struct([("path", pa.string()), ("level", pa.string()), ("qualifier", pa.string()), ("gloss", pa.string()), ("citations", pa.list_(pa.string()))])
_TEXTS = "headword bracketed_form preamble pos gender root definition_text continuation_text".split()
_LISTS = "grammar_markers principal_parts source_references cross_references".split()
#: What an entry's parse gives; ``error_at`` is the place (from 0) where a malformed entry's rules end.
ENTRY = (
    "parsed boolean, error_at int, "
    + ", ".join(f"{c} string" for c in _TEXTS)
    + ", "
    + ", ".join(f"{c} array<string>" for c in _LISTS)
    + ", senses array<struct<path: string, level: string, qualifier: string, gloss: string, citations: array<string>>>"
)

_CROSS = re.compile(r"^\s*(?:cf\.|see|v\.|voir)\s+", re.I)
_PLACE = re.compile(r"[A-Z][A-Za-z]*\.(?:\s+[A-Z]?[a-z]*\.)*\s+\d+(?:,\s*\d+)*")


def _abbreviations(text: str) -> bool:
    """Whether a part is nothing but abbreviated sources: ``RV. i, 1`` isn't, ``RV.; &c.`` is."""
    return all(t == "&c." or t.endswith(".") for t in text.replace(",", " ").split())


def _without_parentheses(text: str) -> str:
    """A definition without what stands in parentheses before it."""
    text = text.strip(" ,")
    while text.startswith("("):
        text = text[text.find(")") + 1 :].strip(" ,") if ")" in text else ""
    return text


def _cdsl(found: dict, body: str) -> None:
    parts = [p.strip() for p in body.split(";") if p.strip()]
    cross = [p for p in parts if _CROSS.match(p)]
    rest = [p for p in parts if not _CROSS.match(p)]
    sources = [p for p in rest if _abbreviations(p)]
    told = next(filter(None, (_without_parentheses(p) for p in rest if not _abbreviations(p))), None)
    found |= {"definition_text": told, "source_references": sources, "cross_references": cross}


def _dico(found: dict, texts: list[str]) -> None:
    first, *more = texts
    found |= {"definition_text": first, "continuation_text": " | ".join(more) or None}
    whole = ";".join(texts)
    found["source_references"] = [x.strip() for x in re.findall(r"\[([^\]]*)\]", whole) if x.strip()]
    found["cross_references"] = [_CROSS.sub("", p).strip() for p in whole.split(";") if _CROSS.match(p)]


def _senses(nodes: Iterable[Node], above: str = "") -> Iterator[dict]:
    """A node's senses and those within it, each with the levels that lead to it."""
    for node in nodes:
        if not node.name[:1].isupper():
            continue
        told = {n.name: n.text for n in node.inside}
        level = told["level"].rstrip(".")
        path = f"{above}.{level}" if above else level
        cited = told.get("cited", "")
        yield {
            "path": path,
            "level": level,
            "qualifier": told.get("qualifier"),
            "gloss": told.get("gloss", "").rstrip(" ,;") or None,
            "citations": [c.strip().rstrip(".") for c in cited.split(";") if c.strip()] if cited else _PLACE.findall(told.get("example", "")),
        }
        yield from _senses(node.inside, path)


def parse_entry(source: str, text: str | None) -> dict:
    """An entry's parts by its source's grammar; those of a malformed one are empty but for the place of the error."""
    found: dict = {"parsed": False, "error_at": 0}
    if text is None or source not in GRAMMARS:
        return found
    nodes, error = GRAMMARS[source].parse(text)
    if error is not None or not text.strip():
        return {"parsed": False, "error_at": error or 0}
    one = {n.name: n.text for n in reversed(nodes)}
    each = lambda name: [n.text for n in nodes if n.name == name]
    found = {"parsed": True, "error_at": None, "headword": one.get("headword"), "bracketed_form": one.get("bracketed"), "preamble": one.get("preamble")}
    found |= {"pos": one.get("pos"), "gender": one.get("gender"), "root": one.get("root"), "grammar_markers": each("marker"), "principal_parts": each("part")}
    found["senses"] = [] if source == "french" else list(_senses(nodes))
    if source == "cdsl":
        _cdsl(found, one.get("body", ""))
    elif source == "dico":
        _dico(found, each("text"))
    elif source == "french":
        found["senses"] = french_glosses(text)[0]
    else:
        found["definition_text"] = one.get("text") or next((s["gloss"] for s in found["senses"]), None)
        found["source_references"] = list(dict.fromkeys(c for s in found["senses"] for c in s["citations"]))
    return found


def french_glosses(text: str | None) -> tuple[list[dict], int | None]:
    """Glosses with their usage and what they refer to (in ``citations``), and None; where the grammar fails, the parts between
    separators, and its place."""
    nodes, error = GRAMMARS["french"].parse(text or "")
    if error is not None:
        parts = [p.strip() for p in re.split(r"[,;\n¶]", text)]
        return [{"gloss": p} for p in parts if p], error
    out = []
    for node in nodes:
        told = {n.name: n.text for n in node.inside}
        if told.get("text"):
            out.append({"gloss": told["text"], "qualifier": told.get("qualifier"), "citations": [told["cross"]] if told.get("cross") else []})
    return out, None


def parse_entries(rows: DataFrame, keys: list[str], text: str, source: str) -> DataFrame:
    """``keys`` and the columns of ``ENTRY``, of entries whose dictionary ``source`` (a column) names: ``cdsl, dico, gaffiot, diogenes, french``.

    A null or empty text and an unknown dictionary are malformed at 0.  A French gloss list that its grammar doesn't take isn't parsed,
    but has its parts between separators as senses.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), ENTRY])
    types = {"parsed": pa.bool_(), "error_at": pa.int32(), **dict.fromkeys(_TEXTS, pa.string()), **dict.fromkeys(_LISTS, pa.list_(pa.string())), "senses": pa.list_(_SENSE_TYPE)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = []
                for kind, told in zip(part.column("_source").to_pylist(), part.column("_text").to_pylist(), strict=True):
                    entry = parse_entry(kind, told)
                    if kind == "french" and not entry["parsed"] and told:
                        entry["senses"] = french_glosses(told)[0]
                    found.append(entry)
                columns = [pa.array([f.get(c, [] if c in _LISTS or c == "senses" else None) for f in found], t) for c, t in types.items()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *columns], names=[*keys, *types])

    chosen = rows.select(*keys, F.col(source).alias("_source"), F.col(text).cast("string").alias("_text"))
    return chosen.mapInArrow(run, schema)
