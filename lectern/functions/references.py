"""Citations, text identifiers and author identifiers as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import roman_to_int, slug


def normalize_citation(c: Column) -> Column:
    """Words and numbers of a citation, Roman numerals in capitals as numbers, joined by dots."""
    parts = F.filter(F.split(c, r"[^0-9A-Za-z]+"), lambda p: p != "")
    number = lambda p: F.when(p == F.upper(p), roman_to_int(p).cast("string"))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(number(p), F.lower(p))), ".")


def text_id(language: Column, title: Column, incipit: Column) -> Column:
    return F.concat_ws(".", language, slug(title), slug(incipit))


def segment_address(text: Column, citation: Column) -> Column:
    return F.concat(F.lit("urn:ctsv2:"), text, F.lit(":"), citation)


def parse_address(c: Column) -> Column:
    """Struct of text id and citation; nulls if it isn't an address."""
    part = lambda i: F.nullif(F.regexp_extract(c, r"^urn:ctsv2:([^:]+)(?::(.+))?$", i), F.lit(""))
    return F.struct(part(1).alias("text_id"), part(2).alias("citation"))


def urn_prefixes(c: Column) -> Column:
    """A urn and what is left when its last parts go, the longest first: keys to look its metadata up by."""
    parts = F.split(c, ":")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), ":"))


def compact_author_id(c: Column) -> Column:
    """The letters and digits that catalogs number authors by, at an id's end; null if there are none."""
    return F.nullif(F.regexp_extract(c, r"(?:^|[:/.])((?:phi|tlg|stoa)\d+[A-Za-z]?)$", 1), F.lit(""))


def canonical_author_id(language: Column, source_id: Column, name: Column) -> Column:
    compact = compact_author_id(source_id)
    return F.coalesce(compact, F.concat_ws(":", language, F.nullif(slug(name), F.lit(""))))


def author_name(c: Column) -> Column:
    """``Last, First`` as ``First Last``; years and brackets go."""
    bare = F.trim(F.regexp_replace(c, r"[\[\(].*?[\]\)]|,?\s*\d{3,4}\??\s*[-–]\s*\d{0,4}\??", ""))
    two = F.split(bare, r"\s*,\s*")
    return F.when(F.size(two) == 2, F.concat_ws(" ", F.get(two, 1), F.get(two, 0))).otherwise(bare)


def lemma_keys(lemma: Column, folded: Column | None = None) -> Column:
    """Keys under which spellings of one lemma meet, each once.

    They are the lemma and what stands before its tag, and for either the letters and digits of its accent-free form (``folded``;
    the lemma itself where none is given) as they are, with long vowels and z reduced, and with f for r; a last h may go.
    """
    raw = F.regexp_replace(F.lower(lemma), "^lex:", "")
    plain = raw if folded is None else F.regexp_replace(F.lower(folded), "^lex:", "")

    def spellings(x: Column) -> list[Column]:
        compact = F.regexp_replace(x, "[^a-z0-9]+", "")
        short = compact
        for long, vowel in (("aa", "a"), ("ii", "i"), ("uu", "u"), ("z", "s")):
            short = F.replace(short, F.lit(long), F.lit(vowel))
        return [compact, short, F.translate(compact, "f", "r")]

    head = lambda x: F.substring_index(x, "#", 1)
    keys = F.array(raw, head(raw), *spellings(plain), *spellings(head(plain)))
    trimmed = F.transform(F.filter(keys, lambda k: k.rlike(".[hḥ]$")), lambda k: F.substring(k, F.lit(1), F.char_length(k) - 1))
    return F.array_distinct(F.filter(F.concat(keys, trimmed), lambda k: k != ""))


def morph_features(c: Column, codes: dict[str, tuple[str, str]]) -> Column:
    """Map of features from a blank-separated code, by a table of code -> (feature, value)."""
    known = F.create_map(*(F.lit(x) for k, (f, v) in codes.items() for x in (k, f"{f}={v}")))
    told = F.filter(F.transform(F.split(F.lower(F.trim(c)), r"[\s,;]+"), lambda p: known[p]), lambda x: x.isNotNull())
    pairs = F.transform(F.array_distinct(told), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring_index(x, "=", -1).alias("v")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return F.map_from_entries(first)


#: Parts of morphology codes.
MORPH_CODES = {
    "masc": ("gender", "masculine"), "fem": ("gender", "feminine"), "neut": ("gender", "neuter"),
    "nom": ("case", "nominative"), "gen": ("case", "genitive"), "dat": ("case", "dative"), "acc": ("case", "accusative"),
    "abl": ("case", "ablative"), "voc": ("case", "vocative"), "loc": ("case", "locative"), "ins": ("case", "instrumental"),
    "sg": ("number", "singular"), "pl": ("number", "plural"), "dual": ("number", "dual"),
    "1st": ("person", "first"), "2nd": ("person", "second"), "3rd": ("person", "third"),
    "pres": ("tense", "present"), "imperf": ("tense", "imperfect"), "fut": ("tense", "future"), "aor": ("tense", "aorist"),
    "perf": ("tense", "perfect"), "plup": ("tense", "pluperfect"),
    "ind": ("mood", "indicative"), "subj": ("mood", "subjunctive"), "opt": ("mood", "optative"), "imperat": ("mood", "imperative"),
    "inf": ("mood", "infinitive"), "part": ("mood", "participle"),
    "act": ("voice", "active"), "pass": ("voice", "passive"), "mid": ("voice", "middle"),
}


def split_glosses(c: Column) -> Column:
    """The senses of a gloss: cut at semicolons and numbers, trimmed, each once."""
    parts = F.transform(F.split(c, r"\s*(?:;|\b\d+[.)])\s*"), lambda p: F.trim(F.regexp_replace(p, r"^[,.:\s]+|[,.:\s]+$", "")))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def compact_gloss(c: Column, most_chars: int, most_items: int) -> Column:
    """The first senses that fit, joined by semicolons; always the first."""
    items = F.slice(split_glosses(c), 1, most_items)
    fits = F.filter(
        items,
        lambda x, i: (i == 0) | (F.char_length(F.array_join(F.slice(items, 1, i + 1), "; ")) <= most_chars),
    )
    return F.array_join(fits, "; ")


def english_glosses(c: Column) -> Column:
    """The glosses of a translated entry: cut at commas, semicolons, line ends and pilcrows, trimmed, none empty."""
    return F.filter(F.transform(F.split(c, "[,;\n¶]"), lambda g: F.trim(g, F.lit(" \t\r"))), lambda g: g != "")


#: Marks of usage in French glosses, and what begins a reference in entries.
QUALIFIERS = ("fig.", "poét.", "litt.", "fam.", "méd.", "phil.", "gram.", "astr.", "myth.")
REFERENCE_MARKS = ("cf.", "v.", "voir", "see")


def _either(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(".", "\\.") for w in words)


def french_glosses(c: Column) -> Column:
    """Array of struct of ``text``, ``qualifier`` (a mark of usage before it) and ``cross_ref`` (what ``v.`` or ``voir`` refers to); parts
    that are only one of these two give none."""
    head, reference = rf"^\s*({_either(QUALIFIERS)})\s*", rf"(?:^|\s)(?:{_either(REFERENCE_MARKS)})\s+(\S.*)$"
    filled = lambda x: F.nullif(x, F.lit(""))

    def one(part: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(part, head, ""), reference, "")
        return F.struct(
            F.trim(bare, F.lit(" \t\r\n")).alias("text"),
            filled(F.regexp_extract(part, head, 1)).alias("qualifier"),
            filled(F.trim(F.regexp_extract(part, reference, 1))).alias("cross_ref"),
        )

    return F.filter(F.transform(F.split(c, "[,;\n¶]"), one), lambda g: g["text"] != "")


def parse_morph(c: Column) -> Column:
    """Struct of ``forms``, ``pos`` and ``features`` of ``form, form: pos feature feature``; nulls where there is no colon or nothing after it."""
    told = F.trim(F.substring_index(c, ":", -1))
    tags = F.filter(F.split(F.trim(F.regexp_replace(c, "^[^:]*:", "")), r"\s+"), lambda t: t != "")
    good = c.contains(":") & (F.size(tags) > 0) & told.isNotNull()
    forms = F.transform(F.split(F.substring_index(c, ":", 1), ","), lambda f: F.trim(f))
    return F.struct(F.when(good, forms).alias("forms"), F.when(good, F.get(tags, F.lit(0))).alias("pos"), F.when(good, F.slice(tags, F.lit(2), F.greatest(F.size(tags), F.lit(1)))).alias("features"))


def source_segments(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, segment_no, kind, segment``: an entry's parts between semicolons in order; what a mark of reference begins is one, without the mark."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p != "")
    mark = rf"^(?:{_either(REFERENCE_MARKS)})\s+"
    placed = rows.select(*keys, F.posexplode(parts).alias("segment_no", "segment"))
    return placed.select(*keys, "segment_no", F.when(F.col("segment").rlike(mark), "reference").otherwise("gloss").alias("kind"), F.regexp_replace("segment", mark, "").alias("segment"))


def analyze_entries(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, glosses, refs, segments``: an entry's glosses and references in order, and how many parts it has."""
    found = source_segments(rows, keys, text).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("segment_no", "kind", "segment"))).alias("s"))
    of = lambda kind: F.transform(F.filter("s", lambda x: x["kind"] == kind), lambda x: x["segment"])
    return found.select(*keys, of("gloss").alias("glosses"), of("reference").alias("refs"), F.size("s").cast("bigint").alias("segments"))
