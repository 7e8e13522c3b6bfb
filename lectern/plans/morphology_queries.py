"""Queries of analyses, paradigms, tools' claims, entry grammars and the word of the day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import claims, morphology
from lectern.plans.registry import Registry
from lectern.storage import read_table

R = Registry()


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier a graph with an analysis of each way; the third way has a feature for some nations only."""
    n, q = F.col("s_nationkey").cast("string"), F.concat(F.lit("q"), F.col("s_suppkey").cast("string"))
    said = F.to_json(F.struct(F.concat(F.lit("a"), n).alias("lemma"), q.alias("form"), F.create_map(*(F.lit(x) for x in "case nominative number singular gender m pos noun".split())).alias("features")))
    b, c = F.concat(F.lit("lex:b"), n, F.lit("#noun")), F.concat(F.lit("lex:c"), n)
    own = F.concat(F.lit("form:"), q)
    even, third = F.col("s_nationkey") % 2 == 0, F.col("s_nationkey") % 3 == 0
    rows = [
        (F.lit("form:x"), "has_morphology", said, "t0", None),
        (F.lit("form:f"), "has_interpretation", F.lit("interp:1"), "t1", None),
        (F.lit("interp:1"), "realizes_lexeme", b, "t1b", None),
        (F.lit("interp:1"), "has_case", F.lit("dative"), "t1b", None),
        (b, "has_number", F.lit("plural"), "t1c", None),
        (b, "has_case", F.lit("nominative"), "t1c", None),
        (own, "inflection_of", F.lit("lex:other"), "t2", None),
        (own, "inflection_of", c, "t2b", None),
        (own, "has_form", q, "t2b", None),
        (c, "has_pos", F.lit("verb"), "t3", even),
        (own, "has_tense", F.lit("present"), "t3", third),
        (F.lit("form:bare"), "has_interpretation", F.lit("interp:2"), "t4", None),
    ]

    def made(i: int, s: Column, p: str, o: Column, source: str, test: Column | None) -> Column:
        row = F.struct(F.lit(i).alias("ord"), s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), F.lit(source).alias("source"))
        return row if test is None else F.when(test, row)

    each = F.filter(F.array(*(made(i, *r) for i, r in enumerate(rows))), lambda x: x.isNotNull())
    return read_table(spark, sf_dir, "supplier").select(q.alias("query"), F.inline(each))


def _map_text(c: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


_ANALYSES = """a AS (SELECT concat('q', CAST(s_suppkey AS STRING)) AS query, 1 AS rank, concat('q', CAST(s_suppkey AS STRING)) AS observed, concat('a', CAST(s_nationkey AS STRING)) AS lemma, 't0' AS source, 'noun' AS pos,
    'case=nominative;gender=m;number=singular;pos=noun' AS features, 'subject' AS relation, 'high' AS confidence, 'observed-form,lemma,case-number-gender' AS reasons FROM supplier
  UNION ALL SELECT concat('q', CAST(s_suppkey AS STRING)), 2, 'f', concat('b', CAST(s_nationkey AS STRING)), 't1b', NULL, 'case=dative;number=plural', 'recipient_or_goal', 'high', 'observed-form,lemma' FROM supplier
  UNION ALL SELECT concat('q', CAST(s_suppkey AS STRING)), 3, concat('q', CAST(s_suppkey AS STRING)), concat('c', CAST(s_nationkey AS STRING)), 't2', CASE WHEN s_nationkey % 2 = 0 THEN 'verb' END,
    concat_ws(';', CASE WHEN s_nationkey % 2 = 0 THEN 'pos=verb' END, CASE WHEN s_nationkey % 3 = 0 THEN 'tense=present' END), NULL, 'medium', 'observed-form,lemma' FROM supplier WHERE s_nationkey % 2 = 0 OR s_nationkey % 3 = 0)"""


@R.query(f"WITH {_ANALYSES} SELECT * FROM a")
def analysis_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses from objects, interpretations and direct forms, ranked in each graph."""
    found = morphology.candidates(_triples(spark, sf_dir))
    return found.select("query", "rank", "observed", "lemma", "source", "pos", _map_text("features").alias("features"), "relation", "confidence", F.array_join("reasons", ",").alias("reasons"))


@R.query(f"WITH {_ANALYSES} SELECT query, lemma, features FROM a WHERE rank = 3")
def direct_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk from a form over what it is an inflection of."""
    return morphology.from_direct_forms(_triples(spark, sf_dir)).select("query", "lemma", _map_text("features").alias("features"))


@R.query(
    f"""WITH {_ANALYSES} SELECT query, rank AS place, lemma, coalesce(pos, 'unknown') AS pos, CASE pos WHEN 'noun' THEN 'declension' WHEN 'verb' THEN 'conjugation' ELSE 'unknown' END AS kind,
  CASE WHEN rank < 3 THEN 'low' ELSE 'medium' END AS confidence, CASE WHEN rank < 3 THEN 'ambiguous' END AS reason FROM a
UNION ALL SELECT n_name, 1, n_name, 'unknown', 'unknown', 'low', 'no_grammar_evidence' FROM nation"""
)
def paradigm_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What paradigms forms ask for; forms without evidence ask for their own."""
    triples = _triples(spark, sf_dir)
    asked = triples.select("query").distinct().unionByName(read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("query")))
    return morphology.paradigm_requests(asked, morphology.candidates(triples))


@R.query(
    """WITH w AS (SELECT DISTINCT CASE p_size % 2 WHEN 0 THEN 'en' ELSE 'de' END AS language, p_name AS word, p_type AS bucket FROM part WHERE p_size > 5 AND lower(p_name) <> 'green gear'),
f AS (SELECT language, bucket, min(concat(sha256(concat_ws(chr(31), 'day 1', language, word)), '|', word)) AS b FROM w GROUP BY 1, 2)
SELECT language, row_number() OVER (PARTITION BY language ORDER BY b, bucket) AS place, split_part(b, '|', 2) AS word, bucket FROM f QUALIFY place <= 3"""
)
def words_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words of each language for a day, in an order that its seed gives."""
    part = read_table(spark, sf_dir, "part").withColumn("language", F.when(F.col("p_size") % 2 == 0, "en").otherwise("de"))
    words = part.select("language", F.col("p_name").alias("word")).distinct()
    probes = part.select("language", F.col("p_name").alias("word"), F.greatest(F.col("p_size") - 5, F.lit(0)).alias("hits"), F.col("p_type").alias("bucket"))
    return morphology.words_of_day(words, probes, "day 1", 3, ["Green Gear"])


# claims of tools

_P = "SELECT CAST(p_partkey AS STRING) AS call_id, concat('lex:', lower(p_name)) AS lex, concat('form:', lower(regexp_replace(p_brand, '[^A-Za-z0-9 -]', '', 'g'))) AS form, * FROM part"
_SENSE = "concat('sense:', lex, '#', substr(sha256(lower(p_type)), 1, 8))"


def _answers(spark: SparkSession, sf_dir: str, payload: Column) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("call_id"), F.to_json(payload).alias("payload"))


def _told(spark: SparkSession, sf_dir: str, tool: str, payload: Column) -> DataFrame:
    return claims.tool_triples(_answers(spark, sf_dir, payload), tool).select("call_id", "subject", "predicate", "object")


def _struct(**parts: Column) -> Column:
    return F.struct(*(c.alias(k) for k, c in parts.items()))


@R.query(
    f"""WITH p AS ({_P}) SELECT call_id, unnest([form, form, form, form, form, lex, {_SENSE}, lex]) AS subject,
  unnest(['inflection_of', 'has_form', 'has_pos', 'has_case', 'has_number', 'has_sense', 'gloss', 'has_citation']) AS predicate,
  unnest([lex, p_brand, 'noun', 'nominative', 'singular', {_SENSE}, p_type, concat('c', call_id)]) AS object FROM p"""
)
def diogenes_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    text = lambda *xs: F.array(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    chunk = lambda kind, forms=none, pos=F.lit(None).cast("string"), features=none, senses=none, citations=none: _struct(kind=F.lit(kind), forms=forms, pos=pos, features=features, senses=senses, citations=citations)
    chunks = F.array(
        chunk("analysis", text(F.col("p_brand")), F.lit("noun"), text("nom", "sg", "zzz")),
        chunk("match", senses=text(F.col("p_type"), " "), citations=text(F.concat(F.lit("c"), F.col("p_partkey").cast("string")))),
        chunk("fuzzy", senses=text("not shown")),
        chunk("other", senses=text("nor this")),
    )
    return _told(spark, sf_dir, "diogenes", _struct(lemmas=text("", F.col("p_name")), no_match=F.lit(True), chunks=chunks))


@R.query(
    f"""WITH p AS (SELECT concat('lex:', lower(p_name), '#N') AS l, concat('interp:', substr(form, 6), '/', lower(p_name), '/1.1') AS interp, * FROM ({_P})),
s AS (SELECT *, concat('sense:', l, '#', substr(sha256(lower(p_type)), 1, 8)) AS sense FROM p)
SELECT call_id, unnest([l, l, l, l, sense, form, interp, interp, interp]) AS subject, unnest(['has_pos', 'has_declension', 'variant_form', 'has_sense', 'gloss', 'has_interpretation', 'realizes_lexeme', 'has_case', 'has_number']) AS predicate,
  unnest(['N', CAST(p_size AS STRING), 'other form', sense, p_type, interp, l, 'genitive', 'plural']) AS object FROM s"""
)
def whitakers_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    term = _struct(term=F.col("p_brand"), case=F.lit("genitive"), number=F.lit("plural"))
    words = F.array(
        _struct(lemma=F.col("p_name"), variants=F.array(F.upper("p_name"), F.lit("Other form")), pos=F.lit("N"), declension=F.col("p_size").cast("string"), senses=F.array("p_type"), terms=F.array(term)),
        _struct(lemma=F.lit(""), variants=F.array(F.lit("x")), pos=F.lit("N"), declension=F.lit("1"), senses=F.array(F.lit("y")), terms=F.array(term)),
    )
    return _told(spark, sf_dir, "whitakers", _struct(wordlist=words))


@R.query(
    f"""WITH p AS ({_P}) SELECT call_id, form AS subject, 'has_morphology' AS predicate, p_name AS lemma, p_brand AS form, unnest(['1', '2']) AS person, unnest(['finite verb', 'given']) AS pos FROM p"""
)
def heritage_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses kept as objects; the colour tells the part of speech where the analysis doesn't."""
    variants = F.array(F.create_map(F.lit("person"), F.lit("1")), F.create_map(F.lit("person"), F.lit("2"), F.lit("pos"), F.lit("given")))
    payload = _struct(lemma=F.col("p_name"), analyses=F.array(_struct(word=F.col("p_brand"), color=F.lit("carmin"), variants=variants)))
    found = claims.tool_triples(_answers(spark, sf_dir, payload), "heritage")
    o = F.from_json("object", "lemma string, form string, features map<string,string>").alias("o")
    return found.select("call_id", "subject", "predicate", o).select("call_id", "subject", "predicate", "o.lemma", "o.form", F.col("o.features")["person"].alias("person"), F.col("o.features")["pos"].alias("pos"))


@R.query(
    f"""WITH p AS ({_P}) SELECT call_id, unnest([form, form, lex, lex, {_SENSE}]) AS subject, unnest(['inflection_of', 'has_form', 'has_pronunciation', 'has_sense', 'gloss']) AS predicate,
  unnest([lex, p_brand, 'ipa', {_SENSE}, p_type]) AS object FROM p"""
)
def cltk_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir, "cltk", _struct(lemma=F.col("p_name"), word=F.col("p_brand"), ipa=F.lit("ipa"), lines=F.array(F.col("p_type"), F.lit("  "))))


@R.query(
    f"""WITH p AS ({_P}) SELECT call_id, unnest([form, form, form, form, form]) AS subject, unnest(['inflection_of', 'has_form', 'has_pos', 'has_case', 'has_number']) AS predicate,
  unnest([lex, p_brand, 'noun', 'nom', 'sing']) AS object FROM p"""
)
def spacy_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    morph = F.create_map(*(F.lit(x) for x in ("Case", "Nom", "Number", "Sing", "Unknown", "Z")))
    tokens = F.array(_struct(text=F.col("p_brand"), lemma=F.col("p_name"), pos=F.lit("NOUN"), morph=morph), _struct(text=F.lit("!"), lemma=F.lit("!"), pos=F.lit("PUNCT"), morph=morph))
    return _told(spark, sf_dir, "spacy", _struct(tokens=tokens))


@R.query(
    """WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS w, lower(p_type) AS t, split_part(p_name, ' ', 2) AS o FROM part)
SELECT p_partkey, 'cdsl' AS source, w AS headword, 'm.' AS grammar, t || '|second sense' AS glosses, o AS refs FROM p
UNION ALL SELECT p_partkey, 'dico', w, 'f.', t || '|autre', o FROM p
UNION ALL SELECT p_partkey, 'gaffiot', w, 'ae, f.', t || '|fin', '' FROM p
UNION ALL SELECT p_partkey, 'diogenes', w, NULL, t, '' FROM p"""
)
def entry_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of four dictionaries, each by its own grammar."""
    part = read_table(spark, sf_dir, "part")
    w, o, t = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1), F.lower("p_type")
    texts = {
        "cdsl": F.concat(w, F.lit(" m. "), t, F.lit("; second sense; cf. "), o),
        "dico": F.concat(w, F.lit(" f. "), t, F.lit("; autre; v. "), o, F.lit(".")),
        "gaffiot": F.concat(w, F.lit(", ae, f. : 1) "), t, F.lit(" 2) fin")),
        "diogenes": F.concat(w, F.lit(": "), t),
    }
    out = None
    for source, text in texts.items():
        found = claims.parse_entries(part.select("p_partkey", text.alias("text")), ["p_partkey"], "text", source).filter("parsed")
        rows = found.select("p_partkey", F.lit(source).alias("source"), "headword", "grammar", F.array_join("glosses", "|").alias("glosses"), F.array_join("refs", "|").alias("refs"))
        out = rows if out is None else out.unionByName(rows)
    return out


@R.query(
    """WITH p AS (SELECT CAST(p_partkey AS STRING) AS call_id, split_part(p_name, ' ', 1) AS w, split_part(p_name, ' ', 2) AS g FROM part),
s AS (SELECT *, concat('lex:', w, '#N') AS l, concat('form:', w, 'us') AS f, concat('interp:', w, 'us/', w, '/1.1') AS i FROM p), t AS (SELECT *, concat('sense:', l, '#', substr(sha256(g), 1, 8)) AS sense FROM s)
SELECT call_id, unnest([l, l, l, l, sense, f, i, i, i, i]) AS subject, unnest(['has_pos', 'has_declension', 'variant_form', 'has_sense', 'gloss', 'has_interpretation', 'realizes_lexeme', 'has_case', 'has_number', 'has_gender']) AS predicate,
  unnest(['N', '2', concat(w, 'i'), sense, g, i, l, 'nominative', 'singular', 'masculine']) AS object FROM t"""
)
def word_list_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims from a command-line tool's own lines: an analysis, an entry and its senses."""
    from lectern.sources import tool_answers

    w, g = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    text = F.concat(w, F.lit(".us   N      2 1 NOM S M\n"), w, F.lit(", "), w, F.lit("i  N (2nd) M   [XXXBO]\n"), g, F.lit(";\n*\n"))
    answers = read_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("call_id"), text.alias("text"))
    return claims.tool_triples(tool_answers.word_list_answers(answers), "whitakers").select("call_id", "subject", "predicate", "object")
