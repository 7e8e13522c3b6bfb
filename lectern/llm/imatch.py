"""Document fingerprints by I-Match, with DataFrame and SQL functions only.

A corpus pass counts in how many distinct texts each term (a lower-cased word without surrounding punctuation, as a 64-bit
hash) stands.  Terms whose document share is within a band - neither boilerplate nor noise, an inverse document frequency
between ``log(1/HIGH)`` and ``log(1/LOW)`` - make the lexicon, whatever their number.  It has at most (mean distinct terms of a text) / ``LOW``
terms, however large the corpus is.  Up to ``MAX_CONSTANT`` terms it travels with the plan, as a table of ``SLOTS`` short lists by the hash's low
bits; beyond that the texts' terms are joined with it by shuffling.  Both ways give the same hashes.

A document's distinct lexicon terms are sorted and hashed as a whole and for several randomised subsets of the lexicon, in
levels of falling density (``RATES``): for a text of any length some level holds a few of its terms, which outlive
small edits.  The fingerprint lists the subsets' hashes.  Its likeness to another is the largest share, over the levels, of
subsets whose hashes agree among those that either text has terms in.

For edits across documents, ``with_next`` brings the following document's columns to each row by one shuffle of the rows: ids are cut
into ranges at every ``RANGE_ROWS``-th or so, drawn by hash, and the first document of a range is also sent to the range before.

Defined results: null is an empty text; texts without a lexicon term are hashed as a whole in every subset; very long texts are read
whole; equal texts have equal fingerprints; copies of a text are counted once and returned each; equal ids are ordered by the text's hash;
a null doc_id comes after all others; an empty table gives no row; other columns are carried, whatever their names.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import set_aside
from lectern.storage import cut

LOW, HIGH = 0.002, 0.05
MAX_CONSTANT = 400_000
#: Texts with copies whose numbers of rows are broadcast, 16 bytes each; more are joined by shuffling the texts.
BROADCAST_COPIES = 1_000_000
SLOTS_LOG2 = 15
#: A subset of a level keeps one of so many lexicon terms; subsets of each level.
RATES = (4, 16, 64, 256)
DRAWS = 16
#: Subsets of a level that either text must have terms in for the level to count.
LEAST_TOLD = 3
#: Likeness from which texts are taken for near: README says how many edited texts and how many unlike ones reach it.
NEAR = 0.25
#: Ids of one range, about; beyond its square in rows, ranges grow with the root of the rows.
RANGE_ROWS = 1000


def _terms(text: Column) -> Column:
    """Distinct term hashes of a text."""
    words = F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """``term, documents``: the terms within the band, counted over all distinct texts.

    The rows of a text that has n copies weigh 1/n each, so their sums are whole numbers but for rounding, which is undone.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = cut(texts.groupBy("text_hash").agg(F.count("*").alias("rows")))
    many = rows.filter("rows > 1")
    # texts that have copies are few against all texts, so these needn't be shuffled to be weighed
    many = F.broadcast(many) if many.count() <= BROADCAST_COPIES else many
    weighed = texts.join(many, "text_hash", "left").select("text", (1 / F.coalesce("rows", F.lit(1))).alias("weight"))
    counts = (
        weighed.select(F.explode(_terms(F.col("text"))).alias("term"), "weight")
        .groupBy("term")
        .agg(F.round(F.sum("weight")).cast("bigint").alias("documents"))
    )
    total = rows.agg(F.count("*").alias("n")).scalar()
    share = F.col("documents") / total
    return counts.filter((share >= low) & (share <= high))


def _table(terms: DataFrame) -> DataFrame:
    """One row: the lexicon as an array of 2**SLOTS_LOG2 arrays of terms."""
    slot = F.col("term").bitwiseAND(F.lit((1 << SLOTS_LOG2) - 1)).cast("int")
    lists = terms.groupBy(slot.alias("slot")).agg(F.collect_list("term").alias("own"))
    every = terms.sparkSession.range(1 << SLOTS_LOG2).select(F.col("id").cast("int").alias("slot"))
    full = every.join(lists, "slot", "left").select(
        F.struct("slot", F.coalesce("own", F.array().cast("array<bigint>")).alias("own")).alias("s")
    )
    return full.agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["own"]).alias("table"))


@dataclass(frozen=True)
class Lexicon:
    """A lexicon's terms, and where they are few, the same as a constant for expressions."""

    terms: DataFrame
    table: Column | None


def prepare(docs: DataFrame, low: float = LOW, high: float = HIGH) -> Lexicon:
    """The lexicon of a corpus; at most MAX_CONSTANT numbers pass the driver.

    Higher-order functions take no subquery, and a joined column would be copied to each row.
    """
    terms = cut(lexicon(docs, low, high).select("term"))
    if terms.count() > MAX_CONSTANT:
        return Lexicon(terms, None)
    table = _table(terms).first()["table"]
    return Lexicon(terms, F.from_json(F.lit(json.dumps(table, separators=(",", ":"))), "array<array<bigint>>"))


def with_hashes(rows: DataFrame, text: str, found: Lexicon, name: str = "hashes") -> DataFrame:
    """The rows with one more column, the hashes of each subset of the terms in the column ``text``: an array, with null for
    a subset that the text has no term in."""
    whole = F.coalesce(F.col(text), F.lit(""))
    if found.table is not None:

        def known(t: Column) -> Column:
            return F.array_contains(F.get(found.table, t.bitwiseAND(F.lit((1 << SLOTS_LOG2) - 1)).cast("int")), t)

        return rows.select("*", _subset_hashes(F.sort_array(F.filter(_terms(whole), known)), whole).alias(name))
    own, names = set_aside(rows)
    whole = F.coalesce(F.col(names[text]), F.lit(""))
    keyed = own.select("*", F.xxhash64(whole).alias("k"), F.xxhash64(F.lit(1), whole).alias("l"))
    each = keyed.select("k", "l", F.explode(_terms(whole)).alias("term")).join(found.terms, "term")
    kept = each.groupBy("k", "l").agg(F.collect_set("term").alias("terms"))
    terms = F.coalesce(F.sort_array("terms"), F.array().cast("array<bigint>"))
    out = keyed.join(kept, ["k", "l"], "left")
    return out.select(*(F.col(c).alias(k) for k, c in names.items()), _subset_hashes(terms, whole).alias(name))


def _subset_hashes(own: Column, text: Column) -> Column:
    """The hash of each subset of a text's sorted lexicon terms."""

    def draw(terms: Column, seed: Column) -> Column:
        """The hashes of one draw's levels; each level chooses from the terms of the one before."""

        def level(chosen: Column, rates: tuple[int, ...]) -> Column:
            mix = lambda t: F.xxhash64(t, seed).bitwiseAND(F.lit(rates[0] - 1)) == 0

            def go_on(c: Column) -> Column:
                own = F.array(F.when(F.size(c) > 0, F.xxhash64(c)))
                return F.concat(own, level(c, rates[1:])) if rates[1:] else own

            return _with(F.filter(chosen, mix), go_on)

        return level(terms, RATES)

    def hashed(terms: Column) -> Column:
        drawn = F.transform(F.sequence(F.lit(1), F.lit(DRAWS)), lambda seed: draw(terms, seed))
        every = F.concat(F.array(F.xxhash64(terms)), F.flatten(drawn))
        whole = F.array_repeat(F.xxhash64(F.lit("whole"), text), 1 + DRAWS * len(RATES))
        return F.when(F.size(terms) > 0, every).otherwise(whole)

    return _with(own, hashed)


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fingerprint(hashes: Column) -> Column:
    """The subset hashes as one string."""
    return F.array_join(F.transform(hashes, lambda h: F.coalesce(F.lower(F.hex(h)), F.lit("-"))), ".")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two arrays of subset hashes: 1 for equal ones, else the best level's share of agreeing subsets."""
    levels = []
    for k in range(len(RATES)):
        at = F.sequence(F.lit(1 + k), F.lit(k + DRAWS * len(RATES)), F.lit(len(RATES)))
        agree = F.size(F.filter(at, lambda i: F.get(a, i) == F.get(b, i)))
        told = F.size(F.filter(at, lambda i: F.coalesce(F.get(a, i), F.get(b, i)).isNotNull()))
        levels.append(F.when(told >= LEAST_TOLD, agree / told).otherwise(F.lit(0.0)))
    return F.when(F.get(a, F.lit(0)) == F.get(b, F.lit(0)), F.lit(1.0)).otherwise(F.greatest(*levels))


def with_next(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The rows with further columns: as ``name`` the column ``columns[name]`` of the next row by doc_id, the first after the last.

    A range begins at a doc_id whose hash says so, so their number and sizes follow the rows: about RANGE_ROWS ids in each, more
    where the ranges are more than that.
    """
    rows, names = set_aside(docs)
    key, text = F.col(names["doc_id"]), F.col(names["text"])
    n, least = rows.agg(F.count("*"), F.min(key)).first()
    every = max(RANGE_ROWS, math.isqrt(n) // 4)
    drawn = rows.filter(key.isNotNull() & (F.pmod(F.xxhash64(key), F.lit(every)) == 0)).select(key).distinct()
    bounds = sorted({r[0] for r in drawn.collect()} | ({least} - {None}))
    table = F.from_json(F.lit(json.dumps(bounds, separators=(",", ":"))), "array<bigint>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))), F.lit(0))
    below = F.aggregate(
        steps,
        F.lit(0),
        lambda lo, s: F.when(F.coalesce(F.get(table, lo + s - 1) <= key, F.lit(False)), lo + s).otherwise(lo),
    )
    count = F.lit(max(1, len(bounds)))
    place = F.when(key.isNull(), count - 1).otherwise(F.greatest(below - 1, F.lit(0)))
    first = F.coalesce(F.get(table, place) == key, F.lit(False))
    own = F.struct(place.alias("range"), F.lit(False).alias("copy"), F.lit(False).alias("around"))
    copy = F.struct(((place + count - 1) % count).alias("range"), F.lit(True).alias("copy"), (place == 0).alias("around"))
    sent = rows.withColumn("to", F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own))))
    # where all ids are null there is one range, which closes with its own first row
    window = Window.partitionBy("to.range").orderBy("to.around", key.isNull(), key, F.xxhash64(text))
    last = F.lead(F.lit(1)).over(window).isNull()
    own_or_first = lambda c: F.when(last, F.first(c).over(window)).otherwise(F.lead(c).over(window))
    nexts = (own_or_first(names[c]).alias(f"n{i}") for i, c in enumerate(columns.values()))
    out = sent.select(*names.values(), "to.copy", *nexts).filter("NOT copy").drop("copy")
    return out.toDF(*names, *columns)
