"""Analyses of forms from triples: three ways through the evidence, one ranking; and what a paradigm is asked for.

Triples have ``query, ord, subject, predicate, object, source``; a query's triples are one evidence graph, and ``ord`` is their order in it.
Where a subject has a feature several times the last one holds.  All ways are joins and aggregates by query and anchor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Predicates that give a feature, named after it.
FEATURE_PREDICATES = (
    "has_pos has_case has_number has_gender has_person has_tense has_voice has_mood has_degree has_declension has_conjugation".split()
)
#: What a case says of a word's part in a sentence.
CASE_TO_RELATION = {
    "nominative": "subject", "accusative": "direct_object", "dative": "recipient_or_goal", "ablative": "source_or_separation",
    "genitive": "possession_or_association", "locative": "location", "instrumental": "instrument_or_means", "vocative": "address",
}
NOMINAL, VERBAL = ("case", "number", "gender"), ("person", "number", "tense", "voice", "mood")
_MAP = "map<string,string>"


def lexeme(anchor: Column) -> Column:
    """A lexeme's lemma: its anchor without prefix and tag."""
    return F.substring_index(F.regexp_replace(anchor, "^lex:", ""), "#", 1)


def features(triples: DataFrame) -> DataFrame:
    """``query, subject, features``."""
    own = triples.filter(F.col("predicate").isin(FEATURE_PREDICATES))
    last = own.groupBy("query", "subject", "predicate").agg(F.max_by("object", "ord").alias("value"))
    entry = F.struct(F.expr("substring(predicate, 5)").alias("k"), "value")
    return last.groupBy("query", "subject").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("features"))


def _over(base: Column, more: Column) -> Column:
    """Both maps, the second before the first."""
    empty = F.create_map().cast(_MAP)
    x, y = F.coalesce(base, empty), F.coalesce(more, empty)
    return F.map_concat(F.map_filter(x, lambda k, v: ~F.map_contains_key(y, k)), y)


def from_objects(triples: DataFrame) -> DataFrame:
    """Whole analyses: ``has_morphology`` with an object of lemma, form and features."""
    parsed = F.from_json("object", f"lemma string, form string, features {_MAP}")
    own = triples.filter("predicate = 'has_morphology'").select("query", "ord", "source", parsed.alias("o"))
    kept = F.map_filter(F.coalesce("o.features", F.create_map().cast(_MAP)), lambda k, v: v.isNotNull())
    found = own.select("query", "ord", "source", F.coalesce(F.nullif(F.trim("o.form"), F.lit("")), "query").alias("observed"), F.trim("o.lemma").alias("lemma"), kept.alias("features"))
    return found.filter("lemma <> ''").withColumn("way", F.lit(0))


def from_interpretations(triples: DataFrame) -> DataFrame:
    """form -> has_interpretation -> interpretation -> realizes_lexeme -> lexeme; the interpretation's features before the lexeme's."""
    link = triples.filter("predicate = 'has_interpretation'").select("query", "ord", F.col("subject").alias("form"), F.col("object").alias("interp"), F.col("source").alias("link_source"))
    first = triples.groupBy("query", F.col("subject").alias("interp")).agg(
        F.min_by("source", "ord").alias("own_source"), F.min_by("object", F.when(F.col("predicate") == "realizes_lexeme", F.col("ord"))).alias("lex")
    )
    known = features(triples)
    of = lambda c, name: known.select("query", F.col("subject").alias(c), F.col("features").alias(name))
    found = link.join(first, ["query", "interp"]).filter(lexeme(F.col("lex")) != "")
    found = found.join(of("lex", "of_lex"), ["query", "lex"], "left").join(of("interp", "of_interp"), ["query", "interp"], "left")
    return found.select(
        "query", "ord", F.coalesce("own_source", "link_source").alias("source"), _observed("form"), lexeme(F.col("lex")).alias("lemma"), _over(F.col("of_lex"), F.col("of_interp")).alias("features"), F.lit(1).alias("way")
    )


def _observed(form: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(form, "^form:", ""), F.lit("")), "query").alias("observed")


def from_direct_forms(triples: DataFrame) -> DataFrame:
    """form -> inflection_of -> lexeme, with the form as it is shown; only forms that have a feature, their own before the lexeme's."""
    forms = triples.filter("subject LIKE 'form:%' AND (predicate = 'inflection_of' OR (predicate = 'has_form' AND object <> ''))")
    is_link = F.col("predicate") == "inflection_of"
    at = forms.groupBy("query", F.col("subject").alias("form")).agg(
        F.max_by("object", F.when(is_link, F.col("ord"))).alias("lex"),
        F.max_by("object", F.when(~is_link, F.col("ord"))).alias("shown"),
        F.min_by("source", "ord").alias("source"),
        F.min(F.when(is_link, F.col("ord"))).alias("ord"),
    )
    known = features(triples)
    of = lambda c, name: known.select("query", F.col("subject").alias(c), F.col("features").alias(name))
    found = at.filter("lex IS NOT NULL").join(of("lex", "of_lex"), ["query", "lex"], "left").join(of("form", "of_form"), ["query", "form"], "left")
    told = found.select(
        "query", "ord", "source", F.coalesce(F.col("shown"), _observed("form")).alias("observed"), lexeme(F.col("lex")).alias("lemma"), _over(F.col("of_lex"), F.col("of_form")).alias("features"), F.lit(2).alias("way")
    )
    return told.filter(F.size("features") > 0)


def _has(names: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.map_contains_key("features", n)
    return out


def candidates(triples: DataFrame) -> DataFrame:
    """The analyses of all three ways, ranked within each query: ``query, rank, observed, lemma, source, pos, features, relation, confidence,
    reasons``.  Well determined ones come first, then those of the very form, then by what speaks for them, by lemma, and in their order."""
    found = from_objects(triples)
    names = found.columns
    for way in (from_interpretations(triples), from_direct_forms(triples)):
        found = found.unionByName(way.select(*names))
    nominal, verbal = _has(NOMINAL), _has(VERBAL)
    reasons = F.filter(
        F.array(
            F.when(F.col("observed") != "", "observed-form"), F.when(F.col("lemma") != "", "lemma"),
            F.when(nominal, "case-number-gender"), F.when(verbal, "person-number-tense-voice-mood"),
        ),
        lambda x: x.isNotNull(),
    )
    relations = F.create_map(*(F.lit(x) for kv in CASE_TO_RELATION.items() for x in kv))
    told = found.select(
        "*",
        reasons.alias("reasons"),
        F.when(_has(("case", "number")) | verbal, "high").otherwise("medium").alias("confidence"),
        relations[F.col("features")["case"]].alias("relation"),
        F.col("features")["pos"].alias("pos"),
    )
    order = [F.when(F.col("confidence") == "high", 0).otherwise(1), F.when(F.col("observed") == F.col("query"), 0).otherwise(1), F.when(nominal | verbal, 0).otherwise(1), -F.size("reasons"), "lemma", "way", "ord"]
    ranked = told.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    return ranked.select("query", "rank", "observed", "lemma", "source", "pos", "features", "relation", "confidence", "reasons")


#: What paradigm a part of speech has.
PARADIGMS = {"noun": "declension", "adjective": "declension", "pronoun": "declension", "participle": "declension", "verb": "conjugation"}


def paradigm_requests(queries: DataFrame, found: DataFrame) -> DataFrame:
    """``query, place, lemma, pos, kind, confidence, reason``: the paradigms that a form's analyses ask for, each lemma and part of speech once.

    Where several lemmas are equally well attested none of them is sure; a form without grammatical evidence asks for its own.
    """
    kinds = F.create_map(*(F.lit(x) for kv in PARADIGMS.items() for x in kv))
    each = found.groupBy("query", "lemma", F.coalesce("pos", F.lit("unknown")).alias("pos")).agg(F.min("rank").alias("rank"), F.min("confidence").alias("confidence"))
    best = each.groupBy("query").agg(F.min("confidence").alias("top"))  # high sorts before medium
    lemmas = each.join(best, "query").filter("confidence = top").groupBy("query").agg(F.countDistinct("lemma").alias("lemmas"), F.min("top").alias("top"))
    joined = queries.select("query").distinct().join(each, "query", "left").join(lemmas, "query", "left")
    unsure = (F.col("lemmas") > 1) & (F.col("confidence") == F.col("top"))
    kind = F.coalesce(kinds[F.col("pos")], F.lit("unknown"))
    return joined.select(
        "query",
        F.row_number().over(Window.partitionBy("query").orderBy("rank", "pos")).alias("place"),
        F.coalesce("lemma", "query").alias("lemma"),
        F.coalesce("pos", F.lit("unknown")).alias("pos"),
        kind.alias("kind"),
        F.when(F.col("lemma").isNull() | unsure, "low").otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("lemma").isNull(), "no_grammar_evidence").when(unsure, "ambiguous").alias("reason"),
    )


def words_of_day(words: DataFrame, probes: DataFrame, seed: str, k: int, excluded: list[str]) -> DataFrame:
    """``language, place, word, bucket``: the first ``k`` words of each language in an order that a seed gives, among those that a probe has
    found something for and that aren't excluded, one of each bucket of meaning."""
    from lectern.functions.text import seeded_order

    told = probes.filter("hits > 0").select("language", "word", "bucket").distinct()
    open_ = words.join(told, ["language", "word"]).filter(~F.lower("word").isin([w.lower() for w in excluded]))
    order = seeded_order(seed, F.col("language"), F.col("word"))
    first = open_.groupBy("language", "bucket").agg(F.min(F.struct(order.alias("o"), "word")).alias("b"))
    placed = first.select("language", "bucket", F.col("b.word").alias("word"), F.row_number().over(Window.partitionBy("language").orderBy("b.o", "bucket")).alias("place"))
    return placed.filter(F.col("place") <= k).select("language", "place", "word", "bucket")
