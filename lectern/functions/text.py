"""Column expressions for text: normalization, tokens, keys and similarity.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that similarity ignores.
STOP_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "with")


def blank(c: Column) -> Column:
    """Null or only white space."""
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def normalize_gloss(c: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def token_text(c: Column) -> Column:
    """ASCII words in lower case with one blank between."""
    return F.trim(F.regexp_replace(F.lower(c), "[^0-9a-z]+", " "))


def tokens(c: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words of ``token_text`` in order, repeats included, without stop words."""
    words = F.split(token_text(c), " ")
    stop = F.array(*(F.lit(w) for w in stop_words)) if stop_words else F.array().cast("array<string>")
    return F.filter(words, lambda w: (w != "") & ~F.array_contains(stop, w))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")).cast("bigint")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / union)


def dice(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(2 * both / (F.size(x) + F.size(y)))


def cosine(a: Column, b: Column) -> Column:
    """Of token counts."""
    count = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    total = lambda kinds, f: F.aggregate(kinds, F.lit(0.0), lambda acc, w: acc + f(w))
    x, y = F.array_distinct(a), F.array_distinct(b)
    dot = total(F.array_intersect(x, y), lambda w: (count(a, w) * count(b, w)).cast("double"))
    norm = lambda kinds, ws: F.sqrt(total(kinds, lambda w: F.pow(count(ws, w).cast("double"), 2)))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(dot / (norm(x, a) * norm(y, b)))


def latin_fold(c: Column) -> Column:
    """One spelling for j/i and v/u."""
    return F.translate(F.lower(c), "jv", "iu")


def spelling_variants(c: Column) -> Column:
    """The spellings of a word with i/j and u/v exchanged either way, each once."""
    low = F.lower(c)
    return F.array_distinct(
        F.array(low, F.translate(low, "jv", "iu"), F.translate(low, "iu", "jv"), F.translate(low, "v", "u"), F.translate(low, "u", "v"))
    )


def contains_greek(c: Column) -> Column:
    return c.rlike("[\\u0370-\\u03ff\\u1f00-\\u1fff]")


def slug(c: Column) -> Column:
    """Lower-case ASCII letters and digits with hyphens between."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def section_key(c: Column) -> Column:
    """First letter in upper case; # for what isn't a letter."""
    first = F.upper(F.substring(F.trim(c), 1, 1))
    return F.when(first.rlike("^[A-Z]$"), first).otherwise("#")


def tag_list(c: Column) -> Column:
    """Tags of a |-separated text: trimmed, without empty ones, each once, in order."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda t: F.trim(t))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def shorten(c: Column, most: int) -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def stable_id(prefix: str, *parts: Column, digits: int = 16) -> Column:
    """A prefix and the first hexadecimal digits of the SHA-256 of the parts, joined by the unit separator."""
    told = F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(told, 256), 1, digits))


def seeded_order(seed: str, *parts: Column) -> Column:
    """A pseudo-random sort key that any engine with SHA-256 computes alike."""
    return F.sha2(F.concat_ws("\x1f", F.lit(seed), *(p.cast("string") for p in parts)), 256)


def roman_to_int(c: Column) -> Column:
    """Value of a Roman numeral (subtractive); null for anything else."""
    values = F.create_map(*(F.lit(x) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in kv))
    digits = F.transform(F.regexp_extract_all(F.upper(c), F.lit("(.)"), F.lit(1)), lambda d: values[d])
    step = lambda acc, v: F.struct(
        F.when(v < acc["last"], acc["sum"] - v).otherwise(acc["sum"] + v).alias("sum"), v.alias("last")
    )
    total = F.aggregate(F.reverse(digits), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), step, lambda a: a["sum"])
    return F.when(F.upper(c).rlike("^[IVXLCDM]+$"), total)


def citation_key(c: Column) -> Column:
    """A dotted citation as numbers, which compare in reading order."""
    return F.transform(F.split(c, r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"\d+", 0).try_cast("int"), F.lit(0)))


def project_citation(c: Column) -> Column:
    """book.chapter.section as book.section; others as they are."""
    p = F.split(c, r"\.")
    return F.when(F.size(p) == 3, F.concat_ws(".", F.get(p, 0), F.get(p, 2))).otherwise(c)


def anchor(kind: str, c: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), normalize_gloss(c))


def parse_anchor(c: Column) -> Column:
    """Struct of kind, body and tag of ``kind:body#tag``."""
    pattern = r"^([a-z]+):([^#]*)(?:#(.*))?$"
    part = lambda i: F.regexp_extract(c, pattern, i)
    return F.struct(part(1).alias("kind"), part(2).alias("body"), F.nullif(part(3), F.lit("")).alias("tag"))


def time_bucket(seconds: Column, width: int) -> Column:
    """The start of the bucket of ``width`` seconds that a time in seconds falls into."""
    return (F.floor(seconds / width) * width).cast("bigint")
