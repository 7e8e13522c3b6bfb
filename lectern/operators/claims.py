"""Claims of each tool as triples: what a tool's answer says, by its own shape, as rows ``call_id, tool, ord, subject, predicate, object``.

Every tool has a schema for its answers and an expression that makes an array of triples of one answer; all of it is built-in expressions over
the answer's row.  Words are anchored by their normalized spelling: ``lex:`` with a part of speech where there is one, ``form:``, and
``sense:`` of a lexeme with the hash of its gloss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.references import MORPH_CODES, REFERENCE_MARKS, _either, split_glosses
from lectern.functions.text import normalize_gloss

#: Schemas of the tools' answers.
PAYLOADS = {
    "diogenes": "lemmas array<string>, no_match boolean, chunks array<struct<kind:string,forms:array<string>,pos:string,features:array<string>,reference:string,senses:array<string>,citations:array<string>>>",
    "whitakers": "wordlist array<struct<lemma:string,variants:array<string>,pos:string,declension:string,conjugation:string,senses:array<string>,terms:array<struct<term:string,case:string,number:string,gender:string,person:string,tense:string,voice:string,mood:string>>>>",
    "heritage": "lemma string, analyses array<struct<word:string,color:string,variants:array<map<string,string>>>>",
    "cltk": "lemma string, word string, ipa string, lines array<string>",
    "spacy": "tokens array<struct<text:string,lemma:string,pos:string,morph:map<string,string>>>",
}
_TRIPLES = "array<struct<subject:string,predicate:string,object:string>>"
#: Names of features as a parser of sentences gives them, and as predicates have them.
SENTENCE_FEATURES = {"Case": "case", "Number": "number", "Gender": "gender", "Person": "person", "Tense": "tense", "Voice": "voice", "Mood": "mood", "Degree": "degree"}
#: What the colours of an analysis stand for.
COLORS = {
    "blue": "noun or adjective", "light_blue": "pronoun", "deep_sky": "pronoun", "cyan": "final compound member", "red": "finite verb", "carmin": "finite verb",
    "yellow": "compound stem", "mauve": "indeclinable", "lavender": "preverb or preposition", "green": "vocative", "lawngreen": "vocative",
    "orange": "periphrastic or cvi stem", "magenta": "phonetic or sandhi", "salmon": "special infinitive", "grey": "unknown morphology", "gray": "unknown morphology",
    "beige": "general background", "pink": "annotation",
}


def word(c: Column) -> Column:
    """A word as anchors spell it."""
    return F.regexp_replace(normalize_gloss(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N} -]", "")


def lex(lemma: Column, pos: Column | None = None) -> Column:
    return F.concat(F.lit("lex:"), word(lemma), F.lit("") if pos is None else F.coalesce(F.concat(F.lit("#"), pos), F.lit("")))


def form(c: Column) -> Column:
    return F.concat(F.lit("form:"), word(c))


def sense(of: Column, gloss: Column) -> Column:
    return F.concat(F.lit("sense:"), of, F.lit("#"), F.substring(F.sha2(normalize_gloss(gloss), 256), 1, 8))


def triple(s: Column, p: str | Column, o: Column) -> Column:
    return F.struct(s.alias("subject"), (F.lit(p) if isinstance(p, str) else p).alias("predicate"), o.cast("string").alias("object"))


def _some(c: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _all(parts: Column) -> Column:
    return F.flatten(parts).cast(_TRIPLES)


def _senses(of: Column, glosses: Column) -> Column:
    """has_sense and gloss of each gloss that isn't blank."""
    kept = F.filter(_some(glosses), lambda g: F.trim(g) != "")
    return F.flatten(F.transform(kept, lambda g: F.array(triple(of, "has_sense", sense(of, g)), triple(sense(of, g), "gloss", F.trim(g)))))


def _told(rows: list[Column]) -> Column:
    """Those triples that have an object."""
    return F.filter(F.array(*rows), lambda t: t["object"].isNotNull() & (t["object"] != ""))


def _diogenes(p: Column) -> Column:
    first = lex(F.get(F.filter(_some(p["lemmas"]), lambda x: word(x) != ""), F.lit(0)))
    names = F.create_map(*(F.lit(x) for k, (f, v) in MORPH_CODES.items() for x in (k, f"has_{f}={v}")))

    def chunk(c: Column) -> Column:
        own = lambda f: F.concat(
            F.array(triple(form(f), "inflection_of", first), triple(form(f), "has_form", f)),
            _told([triple(form(f), "has_pos", c["pos"])]),
            F.transform(
                F.filter(F.transform(_some(c["features"]), lambda x: names[F.lower(x)]), lambda x: x.isNotNull()),
                lambda x: triple(form(f), F.substring_index(x, "=", 1), F.substring_index(x, "=", -1)),
            ),
        )
        analysis = F.flatten(F.transform(_some(c["forms"]), own))
        cited = F.transform(_some(c["citations"]), lambda x: triple(first, "has_citation", x))
        meaning = F.concat(_senses(first, c["senses"]), cited)
        shown = (c["kind"] == "match") | ((c["kind"] == "fuzzy") & ~F.coalesce(p["no_match"], F.lit(False)))
        none = F.array().cast(_TRIPLES)
        return F.when(c["kind"] == "analysis", analysis.cast(_TRIPLES)).when(shown, meaning.cast(_TRIPLES)).otherwise(none)

    return F.when(first.isNotNull(), _all(F.transform(p["chunks"], chunk)))


def _whitakers(p: Column) -> Column:
    def entry(w: Column, i: Column) -> Column:
        own = lex(w["lemma"], w["pos"])

        def term(t: Column, k: Column) -> Column:
            interp = F.concat(F.lit("interp:"), word(t["term"]), F.lit("/"), word(w["lemma"]), F.lit("/"), (i + 1).cast("string"), F.lit("."), (k + 1).cast("string"))
            told = [triple(interp, f"has_{f}", t[f]) for f in ("case", "number", "gender", "person", "tense", "voice", "mood")]
            return F.concat(F.array(triple(form(t["term"]), "has_interpretation", interp), triple(interp, "realizes_lexeme", own)), _told(told))

        head = _told([triple(own, "has_pos", w["pos"]), triple(own, "has_declension", w["declension"]), triple(own, "has_conjugation", w["conjugation"])])
        variants = F.transform(F.filter(_some(w["variants"]), lambda v: (word(v) != word(w["lemma"])) & (word(v) != "")), lambda v: triple(own, "variant_form", word(v)))
        terms = F.flatten(F.transform(F.coalesce(w["terms"], F.array()), term))
        return F.when(word(w["lemma"]) != "", F.concat(head, variants, _senses(own, w["senses"]), terms).cast(_TRIPLES)).otherwise(F.array().cast(_TRIPLES))

    return _all(F.transform(p["wordlist"], entry))


def _heritage(p: Column) -> Column:
    colors = F.create_map(*(F.lit(x) for kv in COLORS.items() for x in kv))

    def analysis(a: Column) -> Column:
        said = lambda v: F.to_json(F.struct(p["lemma"].alias("lemma"), a["word"].alias("form"), F.map_concat(F.map_filter(v, lambda k, x: k != "pos"), F.map_filter(
            F.create_map(F.lit("pos"), F.coalesce(v["pos"], colors[a["color"]])), lambda k, x: x.isNotNull())).alias("features")))
        return F.transform(a["variants"], lambda v: triple(form(a["word"]), "has_morphology", said(v)))

    return _all(F.transform(p["analyses"], analysis))


def _cltk(p: Column) -> Column:
    own, w = lex(p["lemma"]), word(p["word"])
    differs = (w != word(p["lemma"])) & (w != "")
    shown = F.when(differs, F.array(triple(form(p["word"]), "inflection_of", own), triple(form(p["word"]), "has_form", p["word"]))).otherwise(F.array().cast(_TRIPLES))
    return F.when(word(p["lemma"]) != "", F.concat(shown, _told([triple(own, "has_pronunciation", p["ipa"])]), _senses(own, p["lines"])).cast(_TRIPLES))


def _spacy(p: Column) -> Column:
    names = F.create_map(*(F.lit(x) for k, f in SENTENCE_FEATURES.items() for x in (k, f"has_{f}")))

    def token(t: Column) -> Column:
        own = lex(t["lemma"])
        known = F.filter(F.map_entries(t["morph"]), lambda e: names[e["key"]].isNotNull())
        told = F.transform(F.array_sort(known), lambda e: triple(form(t["text"]), names[e["key"]], F.lower(e["value"])))
        head = F.array(triple(form(t["text"]), "inflection_of", own), triple(form(t["text"]), "has_form", t["text"]))
        rows = F.concat(head, _told([triple(form(t["text"]), "has_pos", F.lower(t["pos"]))]), F.coalesce(told, F.array().cast(_TRIPLES)))
        return F.when((word(t["text"]) != "") & (word(t["lemma"]) != ""), rows.cast(_TRIPLES)).otherwise(F.array().cast(_TRIPLES))

    return _all(F.transform(p["tokens"], token))


MAKERS = {"diogenes": _diogenes, "whitakers": _whitakers, "heritage": _heritage, "cltk": _cltk, "spacy": _spacy}


def tool_triples(answers: DataFrame, tool: str) -> DataFrame:
    """The triples of ``call_id, payload`` (JSON); an answer that isn't of the tool's shape gives none."""
    made = MAKERS[tool](F.from_json("payload", f"struct<{PAYLOADS[tool]}>"))
    rows = answers.select("call_id", F.posexplode(made).alias("ord", "t"))
    return rows.select("call_id", F.lit(tool).alias("tool"), "ord", "t.subject", "t.predicate", "t.object")


#: How each dictionary's entries begin: headword, marks of grammar, the rest.
ENTRY_HEADS = {
    "cdsl": r"^\s*(\S+)\s+((?:m|f|n|mfn|ind|cl)\.(?:\s*(?:m|f|n)\.)*)?\s*(.*)$",
    "dico": r"^\s*(\S+)\s+((?:m|f|n|a|adv|v)\.(?:\[\d+\])?)?\s*(.*)$",
    "gaffiot": r"^\s*([^\s,]+)(?:,\s*([^:]*?))?\s*:\s*(.*)$",
    "diogenes": r"^\s*([^\s,]+)(?:,\s*([^:]{0,40}?))?\s*[:,]\s*(.*)$",
}


def parse_entries(rows: DataFrame, keys: list[str], text: str, source: str) -> DataFrame:
    """``keys, parsed, headword, grammar, glosses, refs``: a dictionary entry by its source's grammar."""
    head = ENTRY_HEADS[source]
    part = lambda i: F.nullif(F.trim(F.regexp_extract(F.col(text), head, i)), F.lit(""))
    body = F.coalesce(part(3), F.lit(""))
    mark = rf"\b(?:{_either(REFERENCE_MARKS)})\s+([^;,.]+)"
    glosses = split_glosses(F.regexp_replace(body, rf"[;,]?\s*{mark}", ""))
    refs = F.transform(F.regexp_extract_all(body, F.lit(mark), F.lit(1)), lambda r: F.trim(r))
    good = F.col(text).rlike(head)
    return rows.select(*keys, good.alias("parsed"), part(1).alias("headword"), part(2).alias("grammar"), F.when(good, glosses).alias("glosses"), F.when(good, refs).alias("refs"))
