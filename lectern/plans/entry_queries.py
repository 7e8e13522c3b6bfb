"""Queries of dictionary entries that are parsed by grammars; shapes vary by row, malformed ones included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import grammars
from lectern.operators import claims
from lectern.plans.registry import Registry
from lectern.sources import tool_pages
from lectern.storage import read_table, spread

R = Registry()

_PARTS = "p AS (SELECT p_partkey, p_size AS n, split_part(p_name, ' ', 1) AS w, split_part(p_name, ' ', 2) AS o, lower(p_type) AS t, lower(p_brand) AS b FROM part)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.split("p_name", " ")
    return spread(read_table(spark, sf_dir, "part")).select(
        "p_partkey", F.col("p_size").alias("n"), F.get(name, F.lit(0)).alias("w"), F.get(name, F.lit(1)).alias("o"), F.lower("p_type").alias("t"), F.lower("p_brand").alias("b")
    )


def _line(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _when(test: Column, *parts: str | Column) -> Column:
    return F.when(test, _line(*parts)).otherwise("")


@R.query(
    f"""WITH {_PARTS}, a AS (SELECT *, CASE WHEN n % 2 = 0 THEN 'I.A.1' ELSE 'I.1' END AS deep FROM p)
SELECT p_partkey, 'I' AS path, NULL AS qualifier, t AS gloss, '' AS citations FROM a UNION ALL SELECT p_partkey, 'I.A', 'lit', o, '' FROM a WHERE n % 2 = 0
UNION ALL SELECT p_partkey, deep, NULL, b, '' FROM a WHERE n % 3 = 0 UNION ALL SELECT p_partkey, deep || '.α', NULL, 'within', 'Verg' FROM a WHERE n % 3 = 0
UNION ALL SELECT p_partkey, 'II', NULL, o, 'Cic|Hor' FROM a WHERE n % 7 > 0"""
)
def nested_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senses of entries at up to four levels, by their paths, with usage and citations."""
    w, o, t, b, n = (F.col(c) for c in "wotbn")
    text = _line(
        w, ", -i, m. (√", w, ") I. ", t, _when(n % 2 == 0, " A. lit., ", o), _when(n % 3 == 0, " 1. ", b, " α. within Verg."), _when(n % 7 > 0, " II. ", o, " Cic.; Hor.")
    )
    rows = _parts(spark, sf_dir).select("p_partkey", F.lit("diogenes").alias("source"), text.alias("text"))
    found = grammars.parse_entries(rows, ["p_partkey"], "text", "source").select("p_partkey", F.explode("senses").alias("s"))
    return found.select("p_partkey", "s.path", "s.qualifier", "s.gloss", F.array_join("s.citations", "|").alias("citations"))


@R.query(
    f"""WITH {_PARTS}, e AS (
  SELECT p_partkey, 'cdsl' AS source, n % 5 > 0 AS parsed, 0 AS place, w AS headword, NULL AS bracketed_form, 'm.' AS markers, t AS definition_text, NULL AS continuation_text, 'RV.|&c.' AS refs, 'cf. ' || o AS cross_refs FROM p
  UNION ALL SELECT p_partkey, 'dico', n % 5 > 0, length(w) + length(o) + length(t) + 19, w, o, 'm.|f.', t, 'autre [ Mah. ] ; v. ' || o, 'Mah.', o FROM p
  UNION ALL SELECT p_partkey, 'gaffiot', true, NULL, NULL, NULL, '', CASE WHEN n % 2 = 0 THEN t ELSE w || ' ' || t END, NULL, CASE WHEN n % 2 = 0 THEN 'Cic. Off. 1, 20' ELSE '' END, '' FROM p
  UNION ALL SELECT p_partkey, 'diogenes', n % 5 > 0, length(w) + 1, w, NULL, '', CASE WHEN n % 2 = 0 THEN o END, NULL, CASE WHEN n % 2 = 0 THEN 'Ov' ELSE '' END, '' FROM p
  UNION ALL SELECT p_partkey, 'another', false, 0, NULL, NULL, '', NULL, NULL, '', '' FROM p)
SELECT p_partkey, source, parsed, CASE WHEN NOT parsed THEN place END AS error_at, CASE WHEN parsed THEN headword END AS headword, CASE WHEN parsed THEN bracketed_form END AS bracketed_form,
  CASE WHEN parsed THEN markers ELSE '' END AS markers, CASE WHEN parsed THEN definition_text END AS definition_text, CASE WHEN parsed THEN continuation_text END AS continuation_text,
  CASE WHEN parsed THEN refs ELSE '' END AS refs, CASE WHEN parsed THEN cross_refs ELSE '' END AS cross_refs FROM e"""
)
def parsed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of four dictionaries; every fifth is malformed, and where its error is."""
    parts = _parts(spark, sf_dir)
    w, o, t, n = (F.col(c) for c in "wotn")
    broken = n % 5 == 0
    texts = {
        "cdsl": _line(_when(broken, "; "), _when(n % 2 == 0, "1. "), w, " m. (", o, ") ", t, "; cf. ", o, "; RV.; &c."),
        "dico": _line(w, " [ ", o, F.when(broken, "").otherwise(" ]"), " m. f. ", t, " | autre [ Mah. ] ; v. ", o),
        "gaffiot": F.when(n % 2 == 0, _line(w, ", i, m. 1 ", t, " : ex Cic. Off. 1, 20 2 fin : ", o)).otherwise(_line(w, " ", t)),
        "diogenes": _line(w, F.when(broken, " @").otherwise(","), " -ae, f.", _when(n % 2 == 0, " I. ", o, " Ov.")),
        "another": t,
    }
    each = F.array(*(F.struct(F.lit(s).alias("source"), x.alias("text")) for s, x in texts.items()))
    rows = parts.select("p_partkey", F.inline(each))
    found = grammars.parse_entries(rows, ["p_partkey", "source"], "text", "source")
    joined = lambda c, name: F.array_join(c, "|").alias(name)
    return found.select(
        "p_partkey", "source", "parsed", "error_at", "headword", "bracketed_form", joined("grammar_markers", "markers"), "definition_text", "continuation_text",
        joined("source_references", "refs"), joined("cross_references", "cross_refs"),
    )


@R.query(
    f"""WITH {_PARTS} SELECT p_partkey, n % 4 <> 2 AS parsed, CASE WHEN n % 4 = 2 THEN length(w) + 2 END AS error_at,
  CASE n % 4 WHEN 0 THEN w || '|' || t || '|fin' WHEN 1 THEN w || '|' || t WHEN 2 THEN w || ' (latin)|' || t ELSE w || '|' || t END AS glosses,
  CASE n % 4 WHEN 0 THEN 'fig|-|-' WHEN 1 THEN '-|-' WHEN 2 THEN '-|-' ELSE 'poet|-' END AS qualifiers, CASE WHEN n % 4 IN (0, 3) THEN o ELSE '' END AS refs FROM p"""
)
def parsed_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French glosses with their usage and references; a parenthesis that refers to nothing breaks the grammar, and the parts stay."""
    w, o, t, n = (F.col(c) for c in "wotn")
    text = (
        F.when(n % 4 == 0, _line("fig., ", w, ", ", t, " (voir ", o, "); fin"))
        .when(n % 4 == 1, _line(w, " ¶ ", t))
        .when(n % 4 == 2, _line(w, " (latin), ", t))
        .otherwise(_line("poet ", w, "; ; ", t, " (cf. ", o, ")"))
    )
    rows = _parts(spark, sf_dir).select("p_partkey", F.lit("french").alias("source"), text.alias("text"))
    found = grammars.parse_entries(rows, ["p_partkey"], "text", "source")
    told = lambda f: F.array_join(F.transform("senses", f), "|")
    refs = F.array_join(F.flatten(F.transform("senses", lambda s: F.coalesce(s["citations"], F.array().cast("array<string>")))), "|")
    return found.select(
        "p_partkey", "parsed", "error_at", told(lambda s: s["gloss"]).alias("glosses"), told(lambda s: F.coalesce(s["qualifier"], F.lit("-"))).alias("qualifiers"), refs.alias("refs")
    )


def _lexicon_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one to five definitions at up to three levels, some with citations, some of another word, some with analyses before."""
    w, o, t, b, n = (F.col(c) for c in "wotbn")
    sense = lambda indent, *parts: _line(f'<div id="sense" style="padding-left: {indent}px;">', *parts, "</div>\n")
    cited = _line(' <span class="origjump Perseus:abo:', F.col("p_partkey").cast("string"), '">', b, "</span>")
    html = _line(
        F.when(n % 4 == 1, _line("<h1>Perseus analysis</h1><ul><li>", w, "1, ", o, " (a <b>thing</b>): noun masc/fem sg</li><li>no analysis</li></ul><hr/>")).otherwise(""),
        F.when(n % 5 == 0, _line('<div class="logeion-link"><span>Could not find dictionary headword</span></div><hr />')).otherwise(""),
        "<h2><span>", w, "</span>, -i, m.</h2><p>(a warning)</p>",
        sense(0, "I. ", t, F.when(n % 2 == 0, cited).otherwise("")),
        F.when(n % 3 > 0, sense(20, "A. <i>", o, "</i> &amp; more,")).otherwise(""),
        F.when(n % 3 == 2, F.concat(sense(40, "1. deep"), sense(40, "2. deeper<br>still"))).otherwise(""),
        sense(0, "II. last<b> open"),
    )
    return _parts(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("call_id"), html.alias("html"))


@R.query(
    f"""WITH {_PARTS}, d AS (SELECT *, CASE WHEN n % 5 = 0 THEN 'fuzzy' ELSE 'match' END AS kind FROM p)
SELECT CAST(p_partkey AS STRING) AS call_id, kind, path, text, refs FROM (
  SELECT p_partkey, kind, '01' AS path, 'I. ' || t || CASE WHEN n % 2 = 0 THEN ' ' || b ELSE '' END AS text, CASE WHEN n % 2 = 0 THEN 'perseus:abo:' || p_partkey || '=' || b ELSE '' END AS refs FROM d
  UNION ALL SELECT p_partkey, kind, '01:00', 'A. ' || o || ' & more', '' FROM d WHERE n % 3 > 0 UNION ALL SELECT p_partkey, kind, '01:00:00', '1. deep', '' FROM d WHERE n % 3 = 2
  UNION ALL SELECT p_partkey, kind, '01:00:01', '2. deeperstill', '' FROM d WHERE n % 3 = 2 UNION ALL SELECT p_partkey, kind, '02', 'II. last open', '' FROM d)"""
)
def lexicon_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested definitions of lexicon pages by their paths, with the places they cite."""
    found = tool_pages.lexicon_blocks(_lexicon_pages(spark, sf_dir))
    refs = F.array_join(F.transform("citations", lambda c: F.concat(c["ref"], F.lit("="), c["text"])), "|")
    return found.select("call_id", "kind", "path", "text", refs.alias("refs"))


@R.query(
    f"""WITH {_PARTS}, a AS (SELECT *, 2 + CASE n % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS senses, CASE WHEN n % 4 = 1 THEN 1 ELSE 0 END AS analyses FROM p)
SELECT predicate, CAST(sum(k) AS BIGINT) AS triples FROM (
  SELECT 'has_sense' AS predicate, CASE WHEN n % 5 = 0 THEN 0 ELSE senses END AS k FROM a UNION ALL SELECT 'has_citation', CASE WHEN n % 5 <> 0 AND n % 2 = 0 THEN 1 ELSE 0 END FROM a) GROUP BY 1 HAVING sum(k) > 0"""
)
def lexicon_page_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims from lexicon pages, counted by predicate; pages of another word give no sense."""
    answers = tool_pages.page_answers(_lexicon_pages(spark, sf_dir), tool_pages.lexicon_answer)
    found = claims.tool_triples(answers, "diogenes").filter("predicate IN ('has_sense', 'has_citation')")
    return found.groupBy("predicate").agg(F.count("*").alias("triples"))
