"""Normalization across scripts.  Unicode decomposition has no built-in expression, so these are Arrow UDFs over whole columns; a
plain ASCII column should take ``lectern.functions.text`` instead."""

from __future__ import annotations

import itertools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Transliteration of Sanskrit sounds, one ASCII letter each, in the order of the alphabet.
SLP1_TO_IAST = dict(
    zip(
        "a A i I u U f F x X e E o O M H k K g G N c C j J Y w W q Q R t T d D n p P b B m y r l v S z s h".split(),
        "a ā i ī u ū ṛ ṝ ḷ ḹ e ai o au ṃ ḥ k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n p ph b bh m y r l v ś ṣ s h".split(),
        strict=True,
    )
)
#: The same sounds in Velthuis's ASCII spelling.
SLP1_TO_VELTHUIS = dict(
    zip(
        SLP1_TO_IAST,
        'a aa i ii u uu .r .rr .l .ll e ai o au .m .h k kh g gh "n c ch j jh ~n .t .th .d .dh .n t th d dh n p ph b bh m y r l v "s .s s h'.split(),
        strict=True,
    )
)
#: Greek beta code letters and diacritics.
BETA_LETTERS = dict(zip("abgdezhqiklmncoprstufxyw", "αβγδεζηθικλμνξοπρστυφχψω", strict=True))
BETA_MARKS = {")": "̓", "(": "̔", "/": "́", "\\": "̀", "=": "͂", "|": "ͅ", "+": "̈"}


def strip_marks(text: str) -> str:
    """Without combining marks."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))


def search_text(text: str, language: str | None = None, folded: bool = True) -> str:
    """Compatibility form, case-folded, word characters only; with ``folded`` also one spelling for each language's variants."""
    out = unicodedata.normalize("NFKC", text or "").casefold()
    if folded:
        out = strip_marks(out)
        if language == "lat":
            out = out.replace("j", "i").replace("v", "u")
    return " ".join(re.findall(r"[\w'’]+", out))


def beta_to_greek(text: str) -> str:
    """Beta code as Greek: ``*`` makes a capital, marks follow their letter (or the star), a sigma at a word's end is final."""
    out: list[str] = []
    capital, held = False, ""
    for c in text.lower():
        if c == "*":
            capital = True
        elif c in BETA_MARKS and capital and not (out and held):
            held += BETA_MARKS[c]
        elif c in BETA_MARKS:
            out.append(BETA_MARKS[c])
        elif c in BETA_LETTERS:
            letter = BETA_LETTERS[c].upper() if capital else BETA_LETTERS[c]
            out += [letter, *held]
            capital, held = False, ""
        else:
            out.append(c)
            capital, held = False, ""
    greek = unicodedata.normalize("NFC", "".join(out))
    return re.sub(r"σ(?!\w)", "ς", greek)


def slp1_to_iast(text: str) -> str:
    return "".join(SLP1_TO_IAST.get(c, c) for c in text)


def slp1_to_velthuis(text: str) -> str:
    return "".join(SLP1_TO_VELTHUIS.get(c, c) for c in text)


def velthuis_to_slp1(text: str) -> str:
    """Longest match first."""
    out, at = [], 0
    known = {v: k for k, v in SLP1_TO_VELTHUIS.items()}
    while at < len(text):
        for n in (3, 2, 1):
            if text[at : at + n] in known and len(text[at : at + n]) == n:
                out.append(known[text[at : at + n]])
                at += n
                break
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


_IAST = sorted(((v, k) for k, v in SLP1_TO_IAST.items()), key=lambda x: -len(x[0]))


def iast_to_slp1(text: str) -> str:
    """Longest match first, so that ``ai`` and aspirates are one sound."""
    out, at, text = [], 0, unicodedata.normalize("NFC", text.lower())
    while at < len(text):
        for iast, slp in _IAST:
            if text.startswith(iast, at):
                out.append(slp)
                at += len(iast)
                break
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def native_order(slp1: str) -> str:
    """A key that sorts in the order of the alphabet: three digits for each sound, 999 and the code point for others."""
    rank = {k: i for i, k in enumerate(SLP1_TO_IAST)}
    return ".".join(f"{rank[c]:03d}" if c in rank else f"999{ord(c):04d}" for c in slp1)


def plain_key(text: str) -> str:
    """ASCII letters only, long sounds and marks reduced."""
    return re.sub(r"[^a-z0-9]+", "", strip_marks((text or "").lower()))


def expand_variants(text: str, choices: dict[str, list[str]], most: int = 64) -> list[str]:
    """Spellings of a text in which each part of ``choices`` may stand for any of its values; at most ``most``, in order of generation.

    The bound is the feature: a search asks for a limited number of spellings.
    """
    parts = re.split("(" + "|".join(re.escape(k) for k in sorted(choices, key=len, reverse=True)) + ")", text) if choices else [text]
    slots = [choices.get(p, [p]) for p in parts if p]
    return list(dict.fromkeys("".join(p) for p in itertools.islice(itertools.product(*slots), most)))


def variants_column(choices: dict[str, list[str]], c: Column, most: int = 64) -> Column:
    """The spellings of a column as arrays."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: expand_variants(t, choices, most), na_action="ignore")

    return run(c)


def _column(f):
    """The function as an Arrow UDF from text to text; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def on_column(f, c: Column) -> Column:
    return _column(f)(c)


def normalized_triple(c: Column, language: str | None = None) -> Column:
    """Struct of search, folded and token text of a column."""

    @F.pandas_udf("search string, folded string, tokens string")
    def run(s: pd.Series) -> pd.DataFrame:
        s = s.fillna("")
        search = s.map(lambda t: search_text(t, language, folded=False))
        folded = s.map(lambda t: search_text(t, language))
        return pd.DataFrame({"search": search, "folded": folded, "tokens": folded.str.replace(r"[^0-9a-z]+", " ", regex=True).str.strip()})

    return run(c)


def hmac_hex(secret: bytes, c: Column, digits: int = 24) -> Column:
    """First hexadecimal digits of the HMAC-SHA-256 of a column."""
    import hashlib
    import hmac

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: hmac.new(secret, str(t).encode(), hashlib.sha256).hexdigest()[:digits], na_action="ignore")

    return run(c)
