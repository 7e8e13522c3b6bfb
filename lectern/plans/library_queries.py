"""Queries of normalization, identifiers, ranking, passages, dictionaries and translations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import references, scripts
from lectern.functions import text as X
from lectern.operators import evidence, passages, ranking, text_search, tokens, translation
from lectern.plans.registry import Registry
from lectern.sources import dictionaries
from lectern.storage import read_table, spread

R = Registry()


@R.query("SELECT doc_id, md5(strip_accents(lower(text))) AS folded_md5 FROM documents")
def accent_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.md5(scripts.on_column(scripts.strip_marks, F.lower("text"))).alias("folded_md5"))


@R.query("SELECT p_partkey, concat_ws('.', lower(p_type), trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-')) AS text_id FROM part")
def text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = references.text_id(F.lower("p_type"), F.col("p_name"), F.col("p_brand"))
    return read_table(spark, sf_dir, "part").select("p_partkey", made.alias("text_id"))


@R.query(
    """WITH a AS (SELECT p_partkey, concat('urn:ctsv2:', replace(p_name, ' ', '-'), ':', CAST(p_size AS STRING), '.', CAST(p_partkey AS STRING)) AS address FROM part)
SELECT p_partkey, split_part(address, ':', 3) AS text_id, split_part(address, ':', 4) AS citation FROM a"""
)
def parsed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    citation = F.concat_ws(".", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))
    address = references.segment_address(F.replace("p_name", F.lit(" "), F.lit("-")), citation)
    rows = read_table(spark, sf_dir, "part").select("p_partkey", references.parse_address(address).alias("a"))
    return rows.select("p_partkey", "a.text_id", "a.citation")


@R.query(
    """WITH w AS (SELECT p_partkey, p_name, lower(p_name) AS b FROM part)
SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN b = 'green gear' THEN 0 ELSE 1 END, CASE WHEN starts_with(b, 'green gear') THEN 0 ELSE 1 END, levenshtein('green gear', b),
  abs(length(b) - 10), p_name, p_partkey) AS place FROM w QUALIFY place <= 100"""
)
def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best candidates for a word: a top-k report."""
    part = read_table(spark, sf_dir, "part")
    order = [*ranking.candidate_key(F.lit("green gear"), F.col("p_name")), F.col("p_partkey")]
    best = part.orderBy(*order).limit(100)
    return best.select("p_partkey", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place"))


@R.query(
    """SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 1 WHEN 'PROMO' THEN 2 ELSE 3 END AS source_rank,
  CASE WHEN regexp_matches(p_name, '^red') THEN 40 ELSE 0 END + CASE WHEN regexp_matches(p_name, 'ring$') THEN 5 ELSE 0 END AS quality FROM part"""
)
def ranking_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("^red", 40), ("ring$", 5)]
    return read_table(spark, sf_dir, "part").select(
        "p_partkey",
        ranking.preference_rank(F.col("p_type"), ["STANDARD", "PROMO"]).cast("int").alias("source_rank"),
        ranking.rule_score(F.col("p_name"), rules).alias("quality"),
    )


@R.query(
    """WITH m AS (SELECT *, CASE WHEN c_acctbal < 0 THEN 3 WHEN c_mktsegment = 'FURNITURE' THEN 1 END AS priority FROM customer)
SELECT c_nationkey, c_custkey, priority FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) rn FROM m WHERE priority IS NOT NULL) WHERE rn = 1
ORDER BY priority DESC, c_custkey LIMIT 15"""
)
def escalation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen first escalations."""
    reasons = {"debt": F.col("c_acctbal") < 0, "segment": F.col("c_mktsegment") == "FURNITURE"}
    found = ranking.escalations(read_table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", reasons, {"debt": 3, "segment": 1}, 15)
    return found.select("c_nationkey", "c_custkey", "priority")


@R.query(
    """WITH f AS (SELECT conv_id, role AS label, min(turn) AS page_start FROM conversations GROUP BY 1, 2), l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1)
SELECT conv_id, label, page_start, greatest(page_start, coalesce(lead(page_start) OVER (PARTITION BY conv_id ORDER BY page_start, label) - 1, last)) AS page_end FROM f JOIN l USING (conv_id)"""
)
def encounter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.encounters(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role"))


@R.query(
    """SELECT doc_id, 'thing' AS term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\bthing\\b')) FROM documents) GROUP BY 1
UNION ALL SELECT doc_id, 'ther', count(*) FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\bther\\b')) FROM documents) GROUP BY 1"""
)
def term_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.mentions(spread(read_table(spark, sf_dir, "documents")), ["doc_id"], "text", ["thing", "ther"], 0)
    return found.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@R.query("SELECT page_id, sha256(html) AS input_hash, concat('plan-', substr(sha256(concat_ws(chr(31), CAST(page_id AS STRING), sha256(html), 'model-1')), 1, 16)) AS plan_id FROM pages")
def summary_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.summary_plan(read_table(spark, sf_dir, "pages"), ["page_id"], "html", "model-1")


@R.query(
    """SELECT p_partkey AS entry_no, p_name AS search_key, true AS is_primary FROM part UNION ALL SELECT p_partkey, split_part(p_name, ' ', 1), false FROM part WHERE split_part(p_name, ' ', 1) <> p_name"""
)
def dictionary_headwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("entry_no"), F.lit(None).cast("int").alias("hom"), F.col("p_name").alias("key"), F.substring_index("p_name", " ", 1).alias("second_key")
    )
    return dictionaries.headwords(entries).select("entry_no", "search_key", "is_primary")


@R.query("SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_brand, p_partkey) AS occurrence FROM part")
def entry_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dictionaries.numbered_occurrences(read_table(spark, sf_dir, "part"), "p_name", ["p_brand", "p_partkey"])
    return found.select("p_partkey", "p_name", F.col("occurrence").cast("bigint").alias("occurrence"))


@R.query("SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY lang, sha256(text)")
def unique_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionaries.unique_entries(read_table(spark, sf_dir, "documents"), "lang", "text", "doc_id").select("doc_id", "lang")


@R.query(
    """WITH u AS (SELECT regexp_extract(url, '^(.*)/[^/]*$', 1) AS work, url, CASE WHEN contains(url, '#top') THEN 0 WHEN contains(url, '?') THEN 1 ELSE 2 END AS rank FROM pages)
SELECT work, arg_min(url, (rank, url)) AS path, count(*) AS candidates FROM u GROUP BY 1"""
)
def source_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionaries.book_sources(read_table(spark, sf_dir, "pages").select(F.col("url").alias("path")), ["#top", "?"])


@R.query(
    """WITH k AS (SELECT DISTINCT p_name AS urn FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part),
q AS (SELECT p_partkey, concat(replace(p_name, ' ', ':'), ':', CAST(p_partkey AS STRING)) AS ref FROM part)
SELECT p_partkey, arg_max(replace(urn, ' ', ':'), length(urn)) AS best FROM q JOIN k ON starts_with(concat(ref, ':'), concat(replace(urn, ' ', ':'), ':')) GROUP BY 1"""
)
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reference's longest known prefix: prefixes are unrolled, so the prefix join is an equi-join."""
    part = read_table(spark, sf_dir, "part")
    known = part.select(F.explode(F.array(F.replace("p_name", F.lit(" "), F.lit(":")), F.substring_index("p_name", " ", 1))).alias("urn")).distinct()
    ref = F.concat_ws(":", F.replace("p_name", F.lit(" "), F.lit(":")), F.col("p_partkey").cast("string"))
    asked = part.select("p_partkey", F.explode(references.urn_prefixes(ref)).alias("urn"))
    return asked.join(known, "urn").groupBy("p_partkey").agg(F.max_by("urn", F.length("urn")).alias("best"))


@R.query(
    """WITH d AS (SELECT DISTINCT conv_id, (turn // 3) * 3 AS s, (turn // 3) * 3 + 2 AS e FROM conversations)
SELECT c.conv_id, c.turn, d.s AS start_turn FROM conversations c JOIN d ON d.conv_id = c.conv_id AND c.turn BETWEEN d.s AND d.e"""
)
def current_divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divisions that hold a citation, compared as arrays of numbers."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn")
    start = F.floor(F.col("turn") / 3) * 3
    divisions = turns.select("conv_id", start.alias("start_turn")).distinct()
    at = lambda c: X.citation_key(F.concat(F.lit("1."), F.col(c).cast("string")))
    end = X.citation_key(F.concat(F.lit("1."), (F.col("start_turn") + 2).cast("string")))
    return turns.join(divisions, "conv_id").filter((at("start_turn") <= at("turn")) & (at("turn") <= end)).select("conv_id", "turn", "start_turn")


_CACHE = """cache AS (SELECT CAST(event_id AS STRING) AS translation_id, event_type AS source_lexicon, CAST(user_id AS STRING) AS entry_id, 1 AS occurrence,
  CASE WHEN value > 2 THEN 'ok' ELSE 'error' END AS status, props AS translated_text, epoch_us(ts) AS updated_at, CASE WHEN value > 8 THEN 'v2' ELSE 'v1' END AS text FROM events),
entries AS (SELECT DISTINCT event_type AS source_lexicon, CAST(user_id AS STRING) AS entry_id, CASE WHEN user_id % 3 = 0 THEN 'v2' WHEN user_id % 7 = 0 THEN '' ELSE 'v1' END AS source_text FROM events)"""


def _translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    lexicon, entry = F.col("event_type").alias("source_lexicon"), F.col("user_id").cast("string").alias("entry_id")
    cache = events.select(
        F.col("event_id").cast("string").alias("translation_id"), lexicon, entry, F.lit(1).alias("occurrence"), F.lit("en").alias("target_lang"), F.lit("m").alias("model"),
        F.when(F.col("value") > 2, "ok").otherwise("error").alias("status"), F.col("props").alias("translated_text"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("updated_at"), F.sha2(F.when(F.col("value") > 8, "v2").otherwise("v1"), 256).alias("source_text_hash"),
    )
    text = F.when(F.col("user_id") % 3 == 0, "v2").when(F.col("user_id") % 7 == 0, "").otherwise("v1")
    entries = events.select(lexicon, entry, F.lit(1).alias("occurrence"), text.alias("source_text")).distinct()
    return translation.project(entries, cache, "en", "m")


@R.query(
    f"""WITH {_CACHE}, n AS (SELECT source_lexicon, entry_id, text, arg_max(translated_text, (updated_at, translation_id)) AS translated_text FROM cache WHERE status = 'ok' GROUP BY 1, 2, 3)
SELECT e.source_lexicon, e.entry_id, n.translated_text FROM entries e LEFT JOIN n ON n.source_lexicon = e.source_lexicon AND n.entry_id = e.entry_id AND n.text = e.source_text"""
)
def translation_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _translations(spark, sf_dir).select("source_lexicon", "entry_id", "translated_text")


@R.query(
    f"""WITH {_CACHE}, n AS (SELECT DISTINCT source_lexicon, entry_id, text FROM cache WHERE status = 'ok')
SELECT count(*) AS total, count(n.text) AS hits, count(*) FILTER (WHERE n.text IS NULL AND trim(source_text) <> '') AS missing, count(*) FILTER (WHERE trim(source_text) = '') AS empty
FROM entries e LEFT JOIN n ON n.source_lexicon = e.source_lexicon AND n.entry_id = e.entry_id AND n.text = e.source_text"""
)
def translation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translation.status_counts(_translations(spark, sf_dir))


@R.query(
    """WITH s AS (SELECT p_partkey, lower(p_name) AS n FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct([n, translate(n, 'jv', 'iu'), translate(n, 'iu', 'jv'), translate(n, 'v', 'u'), translate(n, 'u', 'v')])), ',') AS variants FROM s"""
)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling; sorted, as the order of a list of distinct values isn't fixed in SQL."""
    names = X.spelling_variants(F.col("p_name"))
    return read_table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(names), ",").alias("variants"))


@R.query(
    """SELECT s_suppkey, count(*) AS parts, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, CAST(min(l_linenumber) AS INT) AS first_line FROM supplier
JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1"""
)
def witness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read_table(spark, sf_dir, "supplier").join(read_table(spark, sf_dir, "lineitem"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("s_suppkey").agg(
        F.count("*").alias("parts"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.min("l_linenumber").alias("first_line")
    )


@R.query(
    """WITH g AS (SELECT p_partkey, p_name, unnest([p_name, lower(p_brand)]) AS gloss, generate_subscripts([1, 2], 1) AS i FROM part)
SELECT gloss AS normalized, count(*) AS size, count(DISTINCT p_partkey) AS claims FROM g GROUP BY 1"""
)
def entry_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary entries to claims, claims to witnesses, witnesses to sense buckets."""
    entries = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("lemma"), F.concat_ws("; ", "p_name", "p_brand").alias("gloss")
    )
    claims = evidence.entry_claims(entries, "dictionary")
    found = evidence.reduce_exact(evidence.witness_senses(evidence.claim_triples(claims)), "lat")
    return found.select("normalized", "size", "claims")


@R.query(
    """WITH q AS (SELECT DISTINCT lang AS language, word FROM documents, (VALUES ('thing'), ('blue'), ('zzz')) v(word) UNION ALL SELECT 'grc', 'thing'),
h AS (SELECT lang AS language, word, count(*) AS passages FROM (SELECT lang, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+'))) AS word FROM documents) GROUP BY 1, 2),
e AS (SELECT word, count(*) AS entries FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1)
SELECT q.language, q.word, coalesce(CASE WHEN q.language = 'en' THEN e.entries END, 0) AS entries, coalesce(h.passages, 0) AS passages,
  CASE WHEN q.language NOT IN (SELECT lang FROM documents) THEN 'index_unavailable' WHEN h.passages IS NULL THEN 'no_hits' ELSE 'hits' END AS status
FROM q LEFT JOIN h ON h.language = q.language AND h.word = q.word LEFT JOIN e ON e.word = q.word"""
)
def word_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents"))
    words = ["thing", "blue", "zzz"]
    asked = docs.select(F.col("lang").alias("language")).distinct().withColumn("word", F.explode(F.array(*(F.lit(w) for w in words))))
    asked = asked.unionByName(spark.createDataFrame([("grc", "thing")], "language string, word string"))
    entries = read_table(spark, sf_dir, "part").select(F.lit("en").alias("language"), F.explode(F.split("p_name", " ")).alias("word"))
    hits = text_search.postings(docs.withColumnRenamed("lang", "language").withColumn("k", F.struct("language", "doc_id")), "k", "text", words)
    hits = hits.select(F.col("k.language").alias("language"), F.col("term").alias("word"))
    return evidence.word_context(asked, entries, hits, docs.select(F.col("lang").alias("language")))


@R.query(
    """WITH w AS (SELECT conv_id, turn, list_filter(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda x: regexp_replace(x, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')), lambda x: x <> '') AS ws FROM conversations)
SELECT conv_id, turn, len(ws) AS tokens, ws[1] AS first_token, ws[len(ws)] AS last_token FROM w WHERE len(ws) > 0"""
)
def passage_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.tokenize(read_table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")
    return found.groupBy("conv_id", "turn").agg(
        F.count("*").alias("tokens"), F.min_by("surface", "token_no").alias("first_token"), F.max_by("surface", "token_no").alias("last_token")
    )


@R.query(
    """SELECT n_nationkey AS source_id, n_regionkey + 1000 AS target_id, 'contained_in' AS relation_type FROM nation
UNION ALL SELECT n_regionkey + 1000, n_nationkey, 'contains' FROM nation"""
)
def contained_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("contained_work_id"), (F.col("n_regionkey") + 1000).alias("parent_work_id"))
    return tokens.contained_relations(pairs)


@R.query(
    """SELECT p_partkey, quality AS answer_quality, quality IS NOT NULL AS answered FROM part LEFT JOIN labels ON p_partkey = doc_id"""
)
def merged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("p_partkey"), "quality")
    return tokens.merge_answers(read_table(spark, sf_dir, "part").select("p_partkey"), answers, "p_partkey", F.col("quality"))
