"""Queries of lookups, filters, orders and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import references, scripts
from lectern.functions import text as X
from lectern.operators import catalog, passages, tokens
from lectern.plans.analogs import table, with_tables
from lectern.plans.registry import Registry
from lectern.storage import read_table, spread

R = Registry()


# orders of the catalog


def _first(spark: SparkSession, sf_dir: str, sort: str) -> DataFrame:
    works, classes = table(spark, sf_dir, "works"), table(spark, sf_dir, "classifications")
    joined = works.join(classes.drop("scope"), "work_id", "left")
    return joined.orderBy(*catalog.SORTS[sort]()).limit(80).select("work_id")


_JOINED = "FROM works LEFT JOIN classifications USING (work_id)"


@R.query(with_tables("works", "classifications", sql=f"SELECT work_id {_JOINED} ORDER BY language, author, title, work_id LIMIT 80"))
def first_by_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eighty works in catalog order."""
    return _first(spark, sf_dir, "catalog")


@R.query(with_tables("works", "classifications", sql=f"SELECT work_id {_JOINED} ORDER BY global_popularity_score IS NULL, global_popularity_score DESC, popularity_score IS NULL, popularity_score DESC, language, title, work_id LIMIT 80"))
def first_by_global_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(spark, sf_dir, "global")


@R.query(with_tables("works", "classifications", sql=f"SELECT work_id {_JOINED} ORDER BY group_popularity_score IS NULL, group_popularity_score DESC, popularity_score IS NULL, popularity_score DESC, language, title, work_id LIMIT 80"))
def first_by_group_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(spark, sf_dir, "group")


@R.query(
    with_tables(
        "works", "classifications",
        sql="SELECT work_id, row_number() OVER (PARTITION BY scope ORDER BY popularity_score IS NULL, popularity_score DESC, title, work_id) AS place FROM works JOIN classifications USING (work_id) QUALIFY place <= 5",
    )
)
def first_by_scope_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five first works of each scope."""
    from lectern.operators.windows import best_rows

    joined = table(spark, sf_dir, "works").join(table(spark, sf_dir, "classifications"), "work_id")
    order = [F.col("popularity_score").isNull(), F.col("popularity_score").desc(), "title", "work_id"]
    return best_rows(joined, ["scope"], order, 5).select("work_id", F.col("rank").cast("bigint").alias("place"))


# filters


@R.query(
    with_tables(
        "works",
        sql="""SELECT author_id, language, count(*) AS works, min(author) AS author FROM works WHERE author_id <> '' AND upper(substr(trim(author), 1, 1)) = 'B'
AND (contains(lower(author), '3') OR contains(lower(author_id), '3')) GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 50 OFFSET 5""",
    )
)
def author_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of authors by section and by a text that any field may hold, accents aside."""
    works = table(spark, sf_dir, "works").filter("author_id <> ''")
    found = catalog.author_index(works, section="B", query="3", fields=["author", "author_id"])
    return found.orderBy("author_id", "language").offset(5).limit(50)


@R.query(
    with_tables(
        "works",
        sql="SELECT work_id FROM works WHERE contains(strip_accents(lower(title)), 'gear') OR contains(strip_accents(lower(author)), 'gear') OR contains(strip_accents(lower(canonical_text_id)), 'gear') OR contains(strip_accents(lower(title)), 'ring')",
    )
)
def author_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any of some spellings in any of some fields."""
    works = table(spark, sf_dir, "works")
    title_or_any = catalog.any_field_has(["title", "author", "canonical_text_id"], ["gear"]) | catalog.any_field_has(["title"], ["ring"])
    return works.filter(title_or_any).select("work_id")


@R.query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 're') OR starts_with(p_name, 'r_') OR starts_with(p_name, 'Sm') OR substr(p_name, 1, 2) = 'bl'")
def prefix_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal prefixes, in either script: no character is a wildcard."""
    return read_table(spark, sf_dir, "part").filter(catalog.any_prefix(F.col("p_name"), ["re", "r_", "Sm", "bl"])).select("p_partkey", "p_name")


@R.query("SELECT p_partkey FROM part WHERE p_type IN ('STANDARD', 'PROMO') AND p_size >= 10 AND p_brand IS NOT NULL AND length(p_name) BETWEEN 5 AND 12")
def candidate_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "part")
    return catalog.pruned(rows, {"p_type": ["STANDARD", "PROMO"]}, {"p_size": (10, None)}, F.char_length("p_name").between(5, 12) & F.col("p_brand").isNotNull()).select("p_partkey")


@R.query(
    """SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '1') AND c_mktsegment = 'BUILDING' ORDER BY c_mktsegment, c_custkey LIMIT 25"""
)
def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets by text, language and status: the first 25."""
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("status"))
    found = catalog.list_rows(rows.filter(F.lower("c_name").contains("1")), ["status", "c_custkey"], 25, status="BUILDING")
    return found.select("c_custkey", "c_name")


@R.query(
    """WITH s AS (SELECT page_id, 'sec' || CAST(page_id % 3 AS STRING) AS section FROM pages WHERE page_id % 4 <> 1)
SELECT p.page_id, section FROM pages p LEFT JOIN s USING (page_id) WHERE contains(lower(html), '100%') OR contains(lower(html), '<p>') ORDER BY p.page_id LIMIT 40"""
)
def page_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that hold a text, with their sections: the first 40."""
    pages = read_table(spark, sf_dir, "pages")
    sections = pages.filter("page_id % 4 <> 1").select("page_id", F.concat(F.lit("sec"), (F.col("page_id") % 3).cast("string")).alias("section"))
    held = F.lower("html").contains("100%") | F.lower("html").contains("<p>")
    return pages.filter(held).select("page_id").join(sections, "page_id", "left").orderBy("page_id").limit(40)


@R.query(
    """SELECT doc_id, 'thing' AS term, length(text) - length(replace(lower(text), 'thing', 'thin')) AS n FROM documents WHERE contains(lower(text), 'thing') ORDER BY n DESC, doc_id LIMIT 30"""
)
def concept_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of one normalized term, most first: the thirty best."""
    docs = spread(read_table(spark, sf_dir, "documents"))
    found = docs.select("doc_id", F.lit("thing").alias("term"), F.regexp_count(F.lower("text"), F.lit("thing")).cast("bigint").alias("n")).filter("n > 0")
    return found.orderBy(F.desc("n"), "doc_id").limit(30)


# citations


@R.query("SELECT concat(CAST(l_orderkey AS STRING), '.', CAST(l_linenumber AS STRING)) AS segment, l_partkey FROM lineitem WHERE l_orderkey = 7 AND l_linenumber IN (1, 2, 3) UNION ALL SELECT concat(CAST(l_orderkey AS STRING), '.', CAST(l_linenumber AS STRING)), l_partkey FROM lineitem WHERE l_orderkey = 96 AND l_linenumber = 1")
def citation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by work and citation path: asked pairs are joined, so both columns are keys."""
    segments = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("work_id"), F.col("l_linenumber").alias("path"), "l_partkey")
    asked = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (96, 1)], "work_id bigint, path int")
    return segments.join(asked, ["work_id", "path"], "left_semi").select(F.concat_ws(".", F.col("work_id").cast("string"), F.col("path").cast("string")).alias("segment"), "l_partkey")


_ROMAN = "CASE p_size % 10 WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' WHEN 5 THEN 'V' WHEN 6 THEN 'VI' WHEN 7 THEN 'VII' WHEN 8 THEN 'VIII' WHEN 9 THEN 'IX' ELSE 'X' END"


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    romans = F.array(*(F.lit(r) for r in "X I II III IV V VI VII VIII IX".split()))
    part = read_table(spark, sf_dir, "part")
    reference = F.concat(F.lit("Book "), F.element_at(romans, F.col("p_size") % 10 + 1), F.lit(", "), F.col("p_partkey").cast("string"))
    return part.select("p_partkey", reference.alias("reference"), references.normalize_citation(reference).alias("key"))


@R.query(
    f"""SELECT p_partkey, concat('Book ', {_ROMAN}, ', ', CAST(p_partkey AS STRING)) AS reference FROM part WHERE (p_size % 10 = 4 AND p_partkey = 14) OR (p_size % 10 = 0 AND p_partkey % 50 = 0)"""
)
def reference_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that mean the same as those asked for, however they are written."""
    cited = _cited(spark, sf_dir)
    ids = read_table(spark, sf_dir, "part").filter("p_partkey % 50 = 0").select(F.concat(F.lit("BOOK X. "), F.col("p_partkey").cast("string")).alias("r"))
    asked = ids.unionByName(spark.createDataFrame([("book IV 14",)], "r string")).select(references.normalize_citation(F.col("r")).alias("key")).distinct()
    return cited.join(asked, "key", "left_semi").select("p_partkey", "reference")


@R.query(f"SELECT {_ROMAN} AS numeral, count(*) AS works, min(p_partkey) AS first_work FROM part WHERE p_size % 10 IN (3, 9) GROUP BY 1")
def traditional_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct traditional references whose key matches one that is asked for."""
    romans = F.array(*(F.lit(r) for r in "X I II III IV V VI VII VIII IX".split()))
    rows = read_table(spark, sf_dir, "part").select("p_partkey", F.element_at(romans, F.col("p_size") % 10 + 1).alias("numeral"))
    keyed = rows.groupBy("numeral").agg(F.count("*").alias("works"), F.min("p_partkey").alias("first_work"))
    return keyed.filter(references.normalize_citation(F.col("numeral")).isin("3", "9"))


@R.query("SELECT p_partkey FROM part WHERE p_size = 12 OR list_contains([lower(p_brand), replace(lower(p_name), ' ', '.'), CAST(p_size AS STRING)], '12')")
def structure_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items any of whose keys is the reference's."""
    keys = F.array(*(references.normalize_citation(c) for c in (F.col("p_brand"), F.col("p_name"), F.col("p_size").cast("string"))))
    return read_table(spark, sf_dir, "part").filter(F.array_contains(keys, "12")).select("p_partkey")


# keys of words


@R.query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS key FROM part")
def plain_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", scripts.on_column(scripts.plain_key, F.col("p_name")).alias("key"))


@R.query(
    """SELECT p_partkey, list_sort(list_distinct([lower(p_name), replace(replace(lower(p_name), 'j', 'i'), 'v', 'u'), regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g')])) AS keys FROM part"""
)
def query_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All the keys that a query is looked up by."""
    low = F.lower("p_name")
    keys = F.array(low, X.latin_fold(F.col("p_name")), F.regexp_replace(low, "[^a-z0-9]+", ""))
    return read_table(spark, sf_dir, "part").select("p_partkey", F.array_sort(F.array_distinct(keys)).alias("keys"))


@R.query(
    """WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM part), s AS (SELECT word, length(word) - length(replace(word, 'a', '')) AS n FROM w)
SELECT word, least(pow(2, n), 16) AS spellings, word AS first_spelling, CASE WHEN n BETWEEN 1 AND 4 THEN replace(word, 'a', 'A') ELSE CASE n WHEN 0 THEN word END END AS last_spelling FROM s"""
)
def bounded_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of a plain word with long and short vowels: sixteen at most, which is the feature."""
    words = read_table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", 1).alias("word")).distinct()
    made = words.select("word", scripts.variants_column({"a": ["a", "A"]}, F.col("word"), 16).alias("v"))
    return made.select("word", F.size("v").cast("double").alias("spellings"), F.get("v", F.lit(0)).alias("first_spelling"), F.element_at("v", -1).alias("last_spelling"))


_ALPHABET = "a A i I u U f F x X e E o O M H k K g G N c C j J Y w W q Q R t T d D n p P b B m y r l v S z s h"


@R.query(
    f"""WITH l AS (SELECT unnest(string_split('{_ALPHABET}', ' ')) AS c, generate_subscripts(string_split('{_ALPHABET}', ' '), 1) - 1 AS rank), w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM part),
u AS (SELECT word, unnest(string_split(word, '')) AS c, generate_subscripts(string_split(word, ''), 1) AS i FROM w)
SELECT word, string_agg(CASE WHEN rank IS NULL THEN concat('999', lpad(CAST(unicode(u.c) AS STRING), 4, '0')) ELSE lpad(CAST(rank AS STRING), 3, '0') END, '.' ORDER BY i) AS key FROM u LEFT JOIN l ON l.c = u.c GROUP BY 1"""
)
def native_order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read_table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", 1).alias("word")).distinct()
    return words.select("word", scripts.on_column(scripts.native_order, F.col("word")).alias("key"))


@R.query("SELECT p_partkey, concat('lex:', substr(sha256(concat_ws(chr(31), 'en', lower(p_name), p_brand)), 1, 16)) AS lexeme_id FROM part")
def lexeme_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = X.stable_id("lex:", F.lit("en"), F.lower("p_name"), F.col("p_brand"))
    return read_table(spark, sf_dir, "part").select("p_partkey", made.alias("lexeme_id"))


@R.query(
    """WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM part)
SELECT word, replace(replace(replace(replace(replace(word, 'w', 'ṭ'), 'q', 'ḍ'), 'x', 'ḷ'), 'f', 'ṛ'), 'z', 'ṣ') AS iast,
  replace(replace(replace(replace(replace(word, 'w', '.t'), 'q', '.d'), 'x', '.l'), 'f', '.r'), 'z', '.s') AS velthuis, true AS back FROM w"""
)
def sanskrit_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words read as one letter for each sound, in two other spellings, and whether one of them leads back."""
    words = read_table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", 1).alias("word")).distinct()
    made = words.select("word", scripts.on_column(scripts.slp1_to_iast, F.col("word")).alias("iast"), scripts.on_column(scripts.slp1_to_velthuis, F.col("word")).alias("velthuis"))
    return made.withColumn("back", scripts.on_column(_back_and_forth, F.col("word")) == "yes")


def _back_and_forth(word: str) -> str:
    once = scripts.slp1_to_velthuis(word)
    return "yes" if scripts.slp1_to_velthuis(scripts.velthuis_to_slp1(once)) == once else "no"


@R.query(
    """WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM part)
SELECT word, regexp_replace(translate(word, 'abgdezhqiklmncoprstufxyw', 'αβγδεζηθικλμνξοπρστυφχψω'), 'σ$', 'ς') AS greek FROM w"""
)
def greek_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read_table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", 1).alias("word")).distinct()
    return words.select("word", scripts.on_column(scripts.beta_to_greek, F.col("word")).alias("greek"))


# glosses and codes


_GLOSS = "concat('1) ', p_name, '; ', lower(p_type), ' 2. ', p_brand, '; ', p_name)"


@R.query(f"SELECT p_partkey, CASE WHEN length(p_name) + 2 + length(p_type) <= 20 THEN concat(p_name, '; ', lower(p_type)) ELSE p_name END AS compact FROM part")
def compact_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first senses of a gloss that fit in twenty characters, two at most."""
    gloss = F.concat(F.lit("1) "), "p_name", F.lit("; "), F.lower("p_type"), F.lit(" 2. "), "p_brand", F.lit("; "), "p_name")
    return read_table(spark, sf_dir, "part").select("p_partkey", references.compact_gloss(gloss, 20, 2).alias("compact"))


@R.query(
    """SELECT p_partkey, unnest(['gloss', 'gloss', 'reference', 'gloss']) AS kind, unnest([p_name, lower(p_type), p_brand, 'end']) AS segment, unnest([0, 1, 2, 3]) AS segment_no FROM part"""
)
def gloss_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gloss's parts with their kind: what begins with ``cf.`` is a reference."""
    text = F.concat("p_name", F.lit("; "), F.lower("p_type"), F.lit("; cf. "), "p_brand", F.lit(";  end "))
    return references.source_segments(read_table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), ["p_partkey"], "text")


@R.query(
    """SELECT p_partkey, [p_name, lower(p_type), 'end'] AS glosses, [p_brand] AS refs, 4 AS segments FROM part"""
)
def entry_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry's glosses, references and number of segments."""
    text = F.concat("p_name", F.lit("; "), F.lower("p_type"), F.lit("; cf. "), "p_brand", F.lit(";  end "))
    return references.analyze_entries(read_table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), ["p_partkey"], "text")


@R.query(
    """SELECT p_partkey, list_filter(list_transform(string_split(replace(replace(concat(p_name, ', ', p_type, '; ', p_brand, chr(10), ' , end'), chr(10), ','), ';', ','), ','), lambda x: trim(x)), lambda x: x <> '') AS glosses FROM part"""
)
def english_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit(", "), "p_type", F.lit("; "), "p_brand", F.lit("\n , end"))
    return read_table(spark, sf_dir, "part").select("p_partkey", references.english_glosses(text).alias("glosses"))


@R.query(
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN [p_name, lower(p_type), 'fin'] ELSE [lower(p_type), 'fin'] END AS glosses,
  CASE WHEN p_size % 2 = 0 THEN [NULL, NULL, 'poét.'] ELSE [NULL, 'poét.'] END AS qualifiers FROM part"""
)
def french_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glosses without their qualifiers (``fig.``) and cross references (``v. x``); a part that is nothing else gives none."""
    head = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.lit("v. autre"))
    text = F.concat(head, F.lit(", "), F.lower("p_type"), F.lit("; poét. fin"))
    return read_table(spark, sf_dir, "part").select("p_partkey", references.french_glosses(text).alias("g")).select(
        "p_partkey", F.col("g.text").alias("glosses"), F.col("g.qualifier").alias("qualifiers")
    )


@R.query(
    """SELECT p_partkey, [p_brand, p_name] AS forms, 'noun' AS pos, CASE WHEN p_size % 2 = 0 THEN ['masc', 'nom', 'sg'] ELSE ['fem', 'gen', 'pl'] END AS features,
  CASE WHEN p_size % 2 = 0 THEN 'nominative' ELSE 'genitive' END AS grammatical_case FROM part"""
)
def morph_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``forms: part of speech and features`` taken apart, and its features by name."""
    code = F.when(F.col("p_size") % 2 == 0, "noun masc nom sg").otherwise("noun fem gen pl")
    text = F.concat("p_brand", F.lit(", "), "p_name", F.lit(": "), code)
    rows = read_table(spark, sf_dir, "part").select("p_partkey", references.parse_morph(text).alias("m"))
    named = references.morph_features(F.array_join("m.features", " "), references.MORPH_CODES)["case"]
    return rows.select("p_partkey", "m.forms", "m.pos", "m.features", named.alias("grammatical_case"))


@R.query("SELECT doc_id, CASE WHEN length(text) > 40 THEN concat(rtrim(substr(text, 1, 39)), '…') ELSE text END AS short FROM documents")
def shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents")).select("doc_id", X.shorten(F.col("text"), 40).alias("short"))


@R.query(
    """SELECT p_partkey, list_sort([CASE WHEN p_size % 2 = 0 THEN 'case-1' ELSE 'case-2' END, 'number-' || CAST(p_size % 3 AS STRING)]) AS concept_ids FROM part"""
)
def feature_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept ids, and with another table the codes of a course, of a map of features."""
    features = F.create_map(F.lit("case"), (F.col("p_size") % 2).cast("string"), F.lit("number"), (F.col("p_size") % 3).cast("string"), F.lit("mood"), F.lit("none"))
    known = [("case", "0", "case-1"), ("case", "1", "case-2"), *(("number", str(i), f"number-{i}") for i in range(3))]
    concepts = spark.createDataFrame(known, "feature string, value string, concept_id string")
    return tokens.concepts_of(read_table(spark, sf_dir, "part").select("p_partkey", features.alias("features")), ["p_partkey"], concepts)


@R.query("SELECT event_id, CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS bucket, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return read_table(spark, sf_dir, "events").select("event_id", X.time_bucket(seconds, 60).alias("bucket"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@R.query("SELECT DISTINCT user_id, 24 AS digits, true AS stable FROM events")
def principal_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed hashes of principals: the same for one principal, of 24 digits; their values are held against the standard library in the tests."""
    events = read_table(spark, sf_dir, "events").select("user_id", scripts.hmac_hex(b"secret", F.col("user_id").cast("string")).alias("h"))
    return events.groupBy("user_id").agg(F.max(F.length("h")).alias("digits"), (F.min("h") == F.max("h")).alias("stable"))


@R.query(
    with_tables(
        "works",
        sql="""SELECT work_id, CASE WHEN CAST(work_id AS INT) % 3 = 0 THEN 'only-here' ELSE 'only-there' END AS side FROM works WHERE CAST(work_id AS INT) % 3 = 0 AND CAST(work_id AS INT) % 2 = 1
UNION ALL SELECT work_id, 'only-there' FROM works WHERE CAST(work_id AS INT) % 3 <> 0 AND CAST(work_id AS INT) % 2 = 0""",
    )
)
def import_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What either of two lists lacks."""
    works = table(spark, sf_dir, "works").select("work_id")
    number = F.col("work_id").cast("int")
    return catalog.set_differences(works.filter(number % 3 == 0), works.filter(number % 2 == 0), "work_id")


@R.query("SELECT source AS name, count(*) AS entries, count(DISTINCT lang) AS languages, sum(length(text)) AS chars, max(doc_id) AS last_id FROM documents GROUP BY 1")
def source_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents"))
    return docs.groupBy(F.col("source").alias("name")).agg(
        F.count("*").alias("entries"), F.countDistinct("lang").alias("languages"), F.sum(F.char_length("text")).alias("chars"), F.max("doc_id").alias("last_id")
    )


@R.query("SELECT doc_id, greatest(1, length(text) - length(replace(text, chr(10), '')) + 1) AS pages FROM documents")
def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text split at a mark into numbered pages, counted."""
    docs = spread(read_table(spark, sf_dir, "documents"))
    return passages.split_pages(docs, ["doc_id"], "text", "\n").groupBy("doc_id").agg(F.count("*").alias("pages"))
