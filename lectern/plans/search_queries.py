"""Queries of the stored search index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import search as S
from lectern.plans.registry import Registry
from lectern.storage import delete_folder, read_table, shared_dir

R = Registry()

#: The indexes built in this session: what each was built from, and its folder.
_BUILT: dict[tuple[str, str, str], tuple[str, str]] = {}


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a work, its turns are segments."""
    turns = read_table(spark, sf_dir, "conversations")
    work = F.concat(F.lit("w"), F.col("conv_id").cast("string"))
    segments = turns.select(
        work.alias("work_id"),
        F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("segment_id"),
        F.col("role").alias("segment_kind"),
        F.col("turn").cast("string").alias("citation_path"),
        F.col("turn").cast("int").alias("sort_key"),
        "text",
    )
    conv = turns.select("conv_id").distinct()
    language = F.element_at(F.array(*(F.lit(x) for x in ("en", "de", "fr"))), (F.col("conv_id") % 3 + 1).cast("int"))
    works = conv.select(
        work.alias("work_id"),
        F.concat(F.lit("c"), (F.col("conv_id") % 4).cast("string")).alias("collection_id"),
        language.alias("language"),
        F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("title"),
        F.concat(F.lit("a"), (F.col("conv_id") % 7).cast("string")).alias("author_id"),
    )
    classes = conv.select(
        work.alias("work_id"),
        F.concat(F.lit("g"), (F.col("conv_id") % 2).cast("string")).alias("group_id"),
        F.concat(F.lit("talk|t"), (F.col("conv_id") % 5).cast("string")).alias("tags"),
        (F.col("conv_id") % 10).cast("int").alias("popularity_score"),
    )
    artifacts = conv.select(
        work.alias("work_id"), F.concat(F.lit("art"), F.col("conv_id").cast("string")).alias("artifact_id"), F.lit("chat").alias("adapter")
    )
    return S.search_rows(segments, works, artifacts, classes)


def _second_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second corpus: records of two kinds in one table, the text of pages and what was said of them."""
    pages = read_table(spark, sf_dir, "pages").select(
        F.lit("page").alias("work_id"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("segment_id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text")
    )
    place = F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    said = read_table(spark, sf_dir, "conversations").select(F.lit("encounter").alias("work_id"), F.concat(F.lit("e"), place).alias("segment_id"), "text")
    kinds = F.broadcast(spark.createDataFrame([("encounter",), ("page",)], "work_id string"))  # two rows, and all pages are of one
    # only its words are searched: a field without a text has no postings
    none = F.lit(None).cast("string")
    return S.search_rows(said.unionByName(pages), kinds).withColumns({"search_text": none, "folded_text": none})


def _build(spark: SparkSession, sf_dir: str, folder: str) -> None:
    S.build_index(_rows(spark, sf_dir), folder)


def _build_second(spark: SparkSession, sf_dir: str, folder: str) -> None:
    S.build_index(_second_rows(spark, sf_dir), folder)


def _build_grown(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """An empty index to which three parts of the rows are added, the first comes again, and what systems said is deleted."""
    rows = _rows(spark, sf_dir)
    S.build_index(rows.limit(0), folder)
    for part in (["c0"], ["c1", "c2"], ["c3"], ["c0"]):
        index = S.append(rows.filter(F.col("collection_id").isin(part)), folder)
    S.delete(index, index.rows.filter("segment_kind = 'system'"))


def _build_merged(spark: SparkSession, sf_dir: str, folder: str) -> None:
    _build_grown(spark, sf_dir, folder)
    S.merge(S.Index(spark, folder))


_BUILDERS = {"segments": _build, "second": _build_second, "grown": _build_grown, "merged": _build_merged}


def _state(spark: SparkSession, sf_dir: str) -> str:
    """What tells another state of the tables: their files, with sizes and times."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    told = []
    for table in ("conversations", "pages"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
        told += [f"{x.getPath()} {x.getLen()} {x.getModificationTime()}" for x in path.getFileSystem(conf).listStatus(path)]
    return "\n".join(told)


def _index(spark: SparkSession, sf_dir: str, name: str = "segments") -> S.Index:
    """The index of a folder's tables, built once in a session for each state of them; an older state's goes."""
    key, state = (spark.sparkContext.applicationId, sf_dir, name), _state(spark, sf_dir)
    if key not in _BUILT or _BUILT[key][0] != state:
        if key in _BUILT:
            delete_folder(spark, _BUILT[key][1])
        folder = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
        _BUILDERS[name](spark, sf_dir, folder)
        _BUILT[key] = (state, folder)
    return S.Index(spark, _BUILT[key][1])


_LOW = "trim(regexp_replace(lower(coalesce(text, '')), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"
_ROWS = f"""r AS (SELECT concat('w', CAST(conv_id AS STRING)) AS work_id, concat(CAST(conv_id AS STRING), '.', CAST(turn AS STRING)) AS segment_id, conv_id, turn, role, text,
  concat('c', CAST(conv_id % 4 AS STRING)) AS collection_id, CASE conv_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END AS language, concat('Talk ', CAST(conv_id AS STRING)) AS title,
  concat('g', CAST(conv_id % 2 AS STRING)) AS group_id, concat('t', CAST(conv_id % 5 AS STRING)) AS tag, {_LOW} AS search_text, strip_accents({_LOW}) AS folded_text,
  trim(regexp_replace(strip_accents({_LOW}), '[^0-9a-z]+', ' ', 'g')) AS token_text FROM conversations)"""
_WORDS = "list_filter(string_split({}, ' '), lambda x: x <> '')"
_TOKENS = _WORDS.format("token_text")
_SCORED = """, s AS (SELECT count(*) AS n, sum(len({t})) / count(*) AS mean FROM r),
p AS (SELECT segment_id, term, count(*) AS tf, min(dl) AS dl FROM (SELECT segment_id, len({t}) AS dl, unnest({t}) AS term FROM r) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1)""".replace("{t}", _TOKENS)
_SCORES = _ROWS + _SCORED
#: Without what was deleted.
_LEFT_ROWS = _ROWS[:-1] + " WHERE role IS DISTINCT FROM 'system')"
_LEFT_SCORES = _LEFT_ROWS + _SCORED
_SCORE = "sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)))"
_ORDER = "round(score, 9) DESC, language, title, turn, segment_id"


@R.query(
    f"""WITH {_ROWS} SELECT concat('row:', substr(sha256(concat_ws(chr(31), work_id, segment_id)), 1, 16)) AS row_key, work_id, segment_id, collection_id, language, title, role AS segment_kind,
  CAST(turn AS INT) AS sort_key, group_id, concat('art', CAST(conv_id AS STRING)) AS artifact_id, 'talk,' || tag AS tags, md5(search_text) AS search_md5, md5(folded_text) AS folded_md5,
  md5(token_text) AS token_md5, len({_TOKENS}) AS n_words, length(text) AS n_chars, CAST(NULL AS STRING) AS author FROM r"""
)
def search_rows_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).rows.select(
        "row_key", "work_id", "segment_id", "collection_id", "language", "title", "segment_kind", "sort_key", "group_id", "artifact_id",
        F.array_join("tag_list", ",").alias("tags"), F.md5("search_text").alias("search_md5"), F.md5("folded_text").alias("folded_md5"),
        F.md5("token_text").alias("token_md5"), "n_words", "n_chars", "author",
    )


@R.query(
    f"""WITH {_ROWS}, w AS (SELECT 'search' AS field, segment_id, unnest({_WORDS.format("search_text")}) AS term FROM r
  UNION ALL SELECT 'folded', segment_id, unnest({_WORDS.format("folded_text")}) FROM r UNION ALL SELECT 'tokens', segment_id, unnest({_TOKENS}) FROM r)
SELECT field, count(DISTINCT (segment_id, term)) AS postings, count(DISTINCT term) AS terms, count(*) AS tokens FROM w GROUP BY 1"""
)
def search_index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).counts()


@R.query(
    """SELECT 'normalizer_version' AS key, 'another' AS expected, 'lower-fold-1' AS value UNION ALL SELECT 'catalog', 'here', NULL
  UNION ALL SELECT 'rows', CAST((SELECT count(*) FROM pages) AS STRING), CAST(count(*) AS STRING) FROM conversations HAVING count(*) <> (SELECT count(*) FROM pages)"""
)
def search_index_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index lacks that a search expects: another normalizer's version, a setting that isn't there, and another table's rows."""
    other = read_table(spark, sf_dir, "pages").count()
    return _index(spark, sf_dir).issues(normalizer_version="another", catalog="here", rows=str(other)).select("key", "expected", "value")


@R.query(
    """SELECT concat('w', CAST(conv_id AS STRING)) AS work_id, count(DISTINCT turn) AS expected, count(*) FILTER (WHERE role <> 'system') AS found
FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'system') > 0"""
)
def search_stale_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of which an index that has grown holds another number of segments than the table."""
    return _index(spark, sf_dir, "grown").stale_works(_rows(spark, sf_dir).select("work_id", "segment_id"))


def _page(hits: DataFrame) -> DataFrame:
    return hits.select("segment_id", F.round("score", 6).alias("score"), "place", "matched")


@R.query(
    f"""WITH {_SCORES}, h AS (SELECT segment_id, {_SCORE} AS score FROM p JOIN f USING (term), s WHERE term IN ('the', 'thing', 'eau') GROUP BY 1)
SELECT segment_id, round(score, 6) AS score, row_number() OVER (ORDER BY {_ORDER}) AS place, 'the thing eau' AS matched FROM h JOIN r USING (segment_id) ORDER BY place LIMIT 30"""
)
def search_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty best hits: a top-k report."""
    return _page(S.search(_index(spark, sf_dir), "The thing, eau", limit=30))


@R.query(
    f"""WITH {_SCORES}, h AS (SELECT segment_id, {_SCORE} AS score FROM p JOIN f USING (term), s WHERE term IN ('the', 'of') GROUP BY 1)
SELECT segment_id, round(score, 6) AS score, row_number() OVER (ORDER BY {_ORDER}) AS place, 'the of' AS matched FROM h JOIN r USING (segment_id)
WHERE language = 'en' AND collection_id = 'c2' AND group_id = 'g0' AND tag IN ('t0', 't1') AND tag = 't1' ORDER BY place LIMIT 40"""
)
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters come before scores: the forty best of those that pass."""
    filters = {"language": "en", "collection_id": "c2", "group": "g0", "tag": "t1"}
    return _page(S.search(_index(spark, sf_dir), "the of", filters=filters, limit=40))


@R.query(
    f"""WITH {_SCORES}, q AS (SELECT segment_id FROM r WHERE concat(' ', token_text, ' ') LIKE '% of the %'),
h AS (SELECT segment_id, {_SCORE} AS score FROM p JOIN f USING (term) JOIN q USING (segment_id), s WHERE term IN ('of', 'the') GROUP BY 1)
SELECT segment_id, round(score, 6) AS score, row_number() OVER (ORDER BY {_ORDER}) AS place, 'of the' AS matched FROM h JOIN r USING (segment_id) ORDER BY place LIMIT 50"""
)
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(S.search(_index(spark, sf_dir), "of the", mode="phrase", limit=50))


@R.query(
    f"""WITH {_SCORES}, h AS (SELECT segment_id, {_SCORE} AS score FROM p JOIN f USING (term), s WHERE term IN ('of', 'the', 'and') GROUP BY 1 HAVING count(*) = 3)
SELECT segment_id, round(score, 6) AS score, row_number() OVER (ORDER BY {_ORDER}) AS place, 'of the and' AS matched FROM h JOIN r USING (segment_id) ORDER BY place LIMIT 50"""
)
def search_all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(S.search(_index(spark, sf_dir), "of the and", mode="all", limit=50))


@R.query(
    f"""WITH {_SCORES}, c AS (SELECT * FROM (VALUES (0, 'vn'), (1, 'un'), (2, 'thing'), (3, 'le')) v(rank, term)),
m AS (SELECT segment_id, arg_min(term, rank) AS matched FROM p JOIN c USING (term) GROUP BY 1),
h AS (SELECT segment_id, {_SCORE} AS score FROM p JOIN f USING (term) JOIN c USING (term), s GROUP BY 1)
SELECT segment_id, round(score, 6) AS score, row_number() OVER (ORDER BY {_ORDER}) AS place, matched FROM h JOIN m USING (segment_id) JOIN r USING (segment_id) ORDER BY place LIMIT 60"""
)
def search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of a word and a concept's other names, in the order they are tried."""
    return _page(S.search(_index(spark, sf_dir), "vn", mode="fuzzy", aliases={"vn": ["thing", "le"]}, limit=60))


@R.query(
    f"""WITH {_SCORES}, h AS (SELECT segment_id, {_SCORE} AS score FROM p JOIN f USING (term), s WHERE term IN ('thing') GROUP BY 1),
t AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS place FROM h JOIN r USING (segment_id) ORDER BY place LIMIT 15 OFFSET 5)
SELECT segment_id, place, (SELECT coalesce(string_agg(md5(x.text), ',' ORDER BY x.turn), '') FROM r x WHERE x.conv_id = t.conv_id AND x.turn < t.turn AND x.turn >= t.turn - 2) AS before,
  (SELECT coalesce(string_agg(md5(x.text), ',' ORDER BY x.turn), '') FROM r x WHERE x.conv_id = t.conv_id AND x.turn > t.turn AND x.turn <= t.turn + 2) AS after FROM t"""
)
def search_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second page of hits, each with the two turns before and after it."""
    hits = S.search(_index(spark, sf_dir), "thing", context=2, limit=15, offset=5)
    told = lambda c: F.array_join(F.transform(c, lambda t: F.md5(t)), ",").alias(c)
    return hits.select("segment_id", "place", told("before"), told("after"))


@R.query(
    f"""WITH {_LEFT_SCORES}, h AS (SELECT segment_id, {_SCORE} AS score FROM p JOIN f USING (term), s WHERE term IN ('thing', 'eau', 'of') GROUP BY 1)
SELECT segment_id, round(score, 6) AS score, row_number() OVER (ORDER BY {_ORDER}) AS place, 'thing eau of' AS matched FROM h JOIN r USING (segment_id) ORDER BY place LIMIT 45"""
)
def search_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of several batches scores as one of what holds."""
    return _page(S.search(_index(spark, sf_dir, "grown"), "thing eau of", limit=45))


@R.query(
    f"""WITH {_LEFT_ROWS}, w AS (SELECT 'search' AS field, segment_id, unnest({_WORDS.format("search_text")}) AS term FROM r
  UNION ALL SELECT 'folded', segment_id, unnest({_WORDS.format("folded_text")}) FROM r UNION ALL SELECT 'tokens', segment_id, unnest({_TOKENS}) FROM r)
SELECT field, count(DISTINCT (segment_id, term)) AS postings, count(DISTINCT term) AS terms, count(*) AS tokens FROM w GROUP BY 1"""
)
def search_appended_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, "grown").counts()


@R.query(
    f"""WITH {_LEFT_SCORES}, q AS (SELECT segment_id FROM r WHERE concat(' ', token_text, ' ') LIKE '% in the %'),
h AS (SELECT segment_id, {_SCORE} AS score FROM p JOIN f USING (term) JOIN q USING (segment_id), s WHERE term IN ('in', 'the') GROUP BY 1)
SELECT segment_id, round(score, 6) AS score, row_number() OVER (ORDER BY {_ORDER}) AS place, 'in the' AS matched FROM h JOIN r USING (segment_id) ORDER BY place LIMIT 50"""
)
def search_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase in an index whose batches were merged."""
    return _page(S.search(_index(spark, sf_dir, "merged"), "in the", mode="phrase", limit=50))


@R.query(
    """WITH x AS (SELECT 'page' AS kind, concat('p', CAST(page_id AS STRING)) AS segment_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages
  UNION ALL SELECT 'encounter', concat('e', CAST(conv_id AS STRING), '.', CAST(turn AS STRING)), text FROM conversations),
d AS (SELECT kind, segment_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^0-9a-z]+'), lambda w: w <> '') AS ts FROM x), s AS (SELECT count(*) AS n, sum(len(ts)) / count(*) AS mean FROM d),
p AS (SELECT segment_id, kind, term, count(*) AS tf, min(dl) AS dl FROM (SELECT segment_id, kind, len(ts) AS dl, unnest(ts) AS term FROM d) WHERE term IN ('example', 'the') GROUP BY 1, 2, 3),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
SELECT kind, segment_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM p JOIN f USING (term), s GROUP BY 1, 2"""
)
def second_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in an index of two kinds of records; a page of them is in order of kind and score."""
    index = _index(spark, sf_dir, "second")
    found = S.matches(index, "example the").join(index.rows.select("row_key", "work_id", "segment_id"), "row_key")
    return found.select(F.col("work_id").alias("kind"), "segment_id", F.round("score", 6).alias("score"))
