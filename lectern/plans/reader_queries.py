"""Queries of the readers: files in each format are made of the tables, written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import scripts
from lectern.plans.registry import Registry
from lectern.operators import scans
from lectern.sources import catalog_readers as C
from lectern.sources import milestones
from lectern.sources import enrichment as E
from lectern.sources import sinks, text_formats
from lectern.storage import cut, delete_folder, read_table, shared_dir

R = Registry()


def _written(rows: DataFrame, use) -> DataFrame:
    """What ``use`` makes of the files of ``name, content`` rows, a file for each; the files go."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    rows.write.partitionBy("name").text(folder)
    out = cut(use(text_formats.whole_files(spark, folder, "part-*")))
    delete_folder(spark, folder)
    return out


def _lined(rows: DataFrame, use) -> DataFrame:
    """The same over ``value`` lines, in one folder, for readers of lines."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    rows.write.text(folder)
    out = cut(use(folder))
    delete_folder(spark, folder)
    return out


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each nation that has customers: its names and its customers in order."""
    customers = read_table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("cs"))
    nations = read_table(spark, sf_dir, "nation").join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.join(customers, F.col("n_nationkey") == F.col("c_nationkey")).withColumn("name", F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")))


def _each(row) -> Column:
    return F.array_join(F.transform("cs", row), "\n")


def _number(i: Column) -> Column:
    return (i + 1).cast("string")


_ROWS = """c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""
_DIR = r"name=([^/]+)/"


def _name() -> Column:
    return F.regexp_extract("path", _DIR, 1)


def _work_segments(tables: dict[str, DataFrame]) -> DataFrame:
    """Works with their segments, as the catalog's tables have them."""
    works, segments, artifacts = tables["works"], tables["segments"], tables["artifacts"].select("work_id", "segment_count")
    return works.join(segments, "work_id").join(artifacts, "work_id").select("cts_work_urn", "title", "author", "language", "citation_path", "segment_kind", "sort_key", "text", "segment_count")


def _tei(malformed: bool) -> Column:
    mark = " &eacute; & co" if malformed else ""
    return F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>'), "n_name", F.lit("</title><author>"), "r_name",
        F.lit('</author></titleStmt></fileDesc></teiHeader><text xml:lang="lat"><body><div type="edition"'),
        F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(' n="urn:cts:given:'), F.col("n_nationkey").cast("string"), F.lit('"'))).otherwise(""),
        F.lit('><div type="textpart" subtype="book" n="1">'),
        _each(lambda c, i: F.concat(F.lit('<l n="'), _number(i), F.lit('">'), c["c_name"], F.lit(f"  {mark}</l>"))),
        F.lit("</div></div></body></text></TEI>"),
    )


_TEI = """SELECT CASE WHEN n_nationkey % 2 = 0 THEN concat('urn:cts:given:', CAST(n_nationkey AS STRING)) ELSE concat('urn:cts:made:n-', CAST(n_nationkey AS STRING)) END AS cts_work_urn,
  n_name AS title, r_name AS author, 'lat' AS language, concat('1.', CAST(i AS STRING)) AS citation_path, 'line' AS segment_kind, CAST(i AS INT) AS sort_key, {} AS text,
  CAST(count(*) OVER (PARTITION BY c_nationkey) AS INT) AS segment_count FROM c"""


@R.query(f"WITH {_ROWS} {_TEI.format('c_name')}")
def tei_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TEI files as works, editions, artifacts and segments; files without a urn get one from their name."""
    rows = _nations(spark, sf_dir).select("name", _tei(False).alias("content"))
    read = lambda files: _work_segments(C.catalog_tables(C.with_fallback_urn(C.read(files, C.tei), "made", _name()), "tei", "tei"))
    return _written(rows, read)


@R.query(f"WITH {_ROWS} {_TEI.format(chr(39).join(['concat(c_name, ', ' é & co', ')']))}")
def malformed_tei(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with named entities and bare ampersands, which aren't XML."""
    rows = _nations(spark, sf_dir).select("name", _tei(True).alias("content"))
    read = lambda files: _work_segments(C.catalog_tables(C.with_fallback_urn(C.read(files, C.tei), "made", _name()), "tei", "tei"))
    return _written(rows, read)


#: Customers are dealt out to files by their numbers, so there are as many files as customers ask for.
_BLOCK = 60


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each block of customers: its number and its customers in order."""
    block = F.floor(F.col("c_custkey") / _BLOCK).cast("bigint").alias("block")
    own = read_table(spark, sf_dir, "customer").groupBy(block).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("cs"))
    return own.withColumn("name", F.concat(F.lit("b-"), F.col("block").cast("string")))


_BLOCK_ROWS = f"""b AS (SELECT *, c_custkey // {_BLOCK} AS block, row_number() OVER (PARTITION BY c_custkey // {_BLOCK} ORDER BY c_custkey) AS i FROM customer)"""


def _milestone_tei() -> Column:
    """Chapters of ten customers and a section for each; paragraphs end after every seventh, pages after every 25th."""

    def one(c: Column, k: Column) -> Column:
        i = k + 1
        number = lambda x: x.cast("string")
        chapter = F.when(k % 10 == 0, F.concat(F.lit('<milestone unit="chapter" n="'), number(F.floor(k / 10) + 1), F.lit('"/>\n'))).otherwise("")
        page = F.when(i % 25 == 0, F.concat(F.lit('<pb n="'), number(F.floor(i / 25)), F.lit('"/>'))).otherwise("")
        paragraph = F.when(i % 7 == 0, F.lit("</p>\n<p>more ")).otherwise("")
        name = F.concat(F.substring(c["c_name"], F.lit(1), F.lit(4)), F.lit('<lb break="no"/>\n<hi>'), F.substring(c["c_name"], F.lit(5), F.length(c["c_name"])), F.lit("</hi>"))
        return F.concat(chapter, F.lit('<milestone unit="section" n="'), number(k % 10 + 1), F.lit('"/>'), F.replace(name, F.lit("\n"), F.lit("")), page, F.lit("\n"), paragraph)

    return F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title>Block '), F.col("block").cast("string"), F.lit('</title><author>A &amp; &eacute;</author></teiHeader>\n<text xml:lang="lat">'),
        F.lit('<body><div type="edition" n="urn:cts:block:'), F.col("block").cast("string"), F.lit('"><div type="textpart" subtype="book" n="1">\n<p>'),
        F.array_join(F.transform("cs", one), ""), F.lit("</p>\n"), F.when(F.col("block") % 3 == 2, "</div></body>").otherwise("</div></div></body></text></TEI>"),
    )


_MILESTONES = f"""{_BLOCK_ROWS}, m AS (SELECT *, concat('urn:cts:block:', block) AS urn, concat('1.', (i - 1) // 10 + 1, '.', (i - 1) % 10 + 1) AS citation_path FROM b),
s AS (SELECT block, urn, i, 0 AS part, citation_path, c_name AS text, (i - 1) // 25 AS page FROM m UNION ALL SELECT block, urn, i, 1, citation_path, 'more', i // 25 FROM m WHERE i % 7 = 0),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY block ORDER BY i, part) AS INT) AS sort_key FROM s)"""


def _milestone_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir).select("name", _milestone_tei().alias("content"))
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    rows.write.partitionBy("name").text(folder)
    found = cut(milestones.read_milestones(milestones.file_lines(spark, folder)))
    delete_folder(spark, folder)
    return found


@R.query(
    f"""WITH {_MILESTONES} SELECT urn AS cts_work_urn, concat('Block ', block) AS title, 'A & é' AS author, 'lat' AS language, citation_path, 'section' AS segment_kind, sort_key, text,
  CAST(count(*) OVER (PARTITION BY block) AS INT) AS segment_count FROM p"""
)
def milestone_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of files whose sections are marked by milestones across paragraphs; every third file breaks off and keeps what it had."""
    return _work_segments(C.catalog_tables(_milestone_rows(spark, sf_dir), "tei", "milestones"))


@R.query(
    f"""WITH {_MILESTONES}, w AS (SELECT DISTINCT block, urn FROM p) SELECT 'edition' AS kind, urn AS label, NULL AS citation_path, CAST(block AS STRING) AS detail FROM w
UNION ALL SELECT 'cts', concat(urn, ':', citation_path), citation_path, NULL FROM p UNION ALL SELECT 'native', concat('native:', page), citation_path, NULL FROM p WHERE page > 0
UNION ALL SELECT 'error', NULL, NULL, 'ExpatError' FROM w WHERE block % 3 = 2"""
)
def milestone_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions, the segments' addresses by citation and by page, and the files that aren't XML to their end."""
    rows = _milestone_rows(spark, sf_dir)
    tables = C.catalog_tables(rows, "tei", "milestones")
    none = F.lit(None).cast("string")
    block = F.regexp_extract("source_path", "name=b-([0-9]+)/", 1)
    editions = tables["editions"].select(F.lit("edition").alias("kind"), F.col("cts_edition_urn").alias("label"), none.alias("citation_path"), block.alias("detail"))
    addresses = tables["addresses"].select("address_kind", "address", "citation_path", none)
    errors = rows.filter("error IS NOT NULL").select(F.lit("error"), none, none, F.substring_index("error", ":", 1))
    return editions.union(addresses).union(errors)


@R.query(
    f"""WITH {_ROWS} SELECT n_name AS title, CASE n_nationkey % 4 WHEN 0 THEN r_name WHEN 1 THEN 'Anonymous' WHEN 2 THEN 'Uncertain author' ELSE 'Unattributed' END AS author, CAST(i AS STRING) AS citation,
  c_name AS text FROM c"""
)
def paragraph_tei(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of paragraphs whose author the header, the title or the source tells, or none."""
    author = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("<author>"), "r_name", F.lit("</author>"))).otherwise("")
    source = F.element_at(F.array(F.lit(""), F.lit("codex anonymus"), F.lit("Incerti auctoris liber"), F.lit("codex")), F.col("n_nationkey") % 4 + 1)
    content = F.concat(
        F.lit("<TEI><teiHeader><title>"), "n_name", F.lit("</title>"), author, F.lit("<sourceDesc>"), source, F.lit("</sourceDesc></teiHeader><text><body>"),
        _each(lambda c, i: F.concat(F.lit("<p> "), c["c_name"], F.lit(" </p><p/>"))), F.lit("</body></text></TEI>"),
    )
    rows = _nations(spark, sf_dir).select("name", content.alias("content"))
    return _written(rows, lambda files: C.read(files, C.paragraphs_tei).select("title", "author", "citation", "text"))


@R.query(f"WITH {_ROWS} SELECT n_name AS title, r_name AS author, concat('v', CAST(i AS STRING)) AS citation, CAST(i AS INT) AS place, c_name AS text, concat('native:v', CAST(i AS STRING)) AS address FROM c")
def verse_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON files of verses, with the references that they give themselves as addresses."""
    verses = F.transform("cs", lambda c, i: F.struct(F.concat(F.lit("v"), _number(i)).alias("ref"), c["c_name"].alias("text")))
    content = F.to_json(F.struct(F.col("n_name").alias("title"), F.col("r_name").alias("author"), verses.alias("verses")))
    rows = _nations(spark, sf_dir).select("name", content.alias("content"))

    def read(files: DataFrame) -> DataFrame:
        t = C.catalog_tables(C.read(files, C.verse_json), "verses", "json")
        native = t["addresses"].filter("address_kind = 'native'").select("segment_id", "address")
        found = t["segments"].join(t["works"].select("work_id", "title", "author"), "work_id").join(native, "segment_id")
        return found.select("title", "author", F.col("citation_path").alias("citation"), F.col("sort_key").alias("place"), "text", "address")

    return _written(rows, read)


@R.query(f"WITH {_ROWS} SELECT n_name AS title, r_name AS author, CAST(i AS INT) AS place, c_name AS text FROM c")
def plain_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit("title: "), "n_name", F.lit("\nauthor: "), "r_name", F.lit("\n\n"))
    rows = _nations(spark, sf_dir).select("name", F.concat(head, _each(lambda c: F.concat(c["c_name"], F.lit("\n")))).alias("content"))
    return _written(rows, lambda files: C.read(files, C.plain).select("title", "author", "place", "text"))


@R.query(
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, c_custkey) AS i FROM customer JOIN nation ON n_nationkey = c_nationkey),
f AS (SELECT n_regionkey, arg_min(n_name, n_nationkey) AS title FROM c GROUP BY 1)
SELECT concat('region ', CAST(n_regionkey AS STRING)) AS work, title, CAST(i AS INT) AS place, c_name AS text FROM c JOIN f USING (n_regionkey)"""
)
def plain_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a region are one work, in their natural order: the second before the tenth."""
    head = F.concat(F.lit("title: "), "n_name", F.lit("\n\n"))
    nations = _nations(spark, sf_dir).withColumn("name", F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("-"), F.col("n_nationkey").cast("string")))
    rows = nations.select("name", F.concat(head, _each(lambda c: c["c_name"])).alias("content"))
    work = F.concat(F.lit("region "), F.regexp_extract("path", r"name=r(\d+)-", 1))
    return _written(rows, lambda files: C.one_work(C.read(files, C.plain).withColumn("path", F.regexp_extract("path", r"(name=[^/]+)", 1)), work).select(F.col("work_key").alias("work"), "title", "place", "text"))


@R.query(f"WITH {_ROWS} SELECT concat('n-', CAST(n_nationkey AS STRING)) AS name, concat('1.', CAST(i AS STRING), 'a') AS citation, concat(c_name, ' goes on') AS text, concat('VS_1,', CAST(i AS STRING), 'a') AS native_ref FROM c")
def numbered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their citation before them; a line without one goes on with the last."""
    line = lambda c, i: F.concat(F.lit("VS_1,"), _number(i), F.lit("a | "), c["c_name"], F.lit("\n   goes on"))
    rows = _nations(spark, sf_dir).select("name", _each(line).alias("content"))
    return _written(rows, lambda files: C.read(files, C.numbered).select(_name().alias("name"), "citation", "text", "native_ref"))


def _conllu(title: Column, chapter: Column) -> Column:
    sentence = lambda c, i: F.concat(
        F.lit("# sent_id = s"), c["c_custkey"].cast("string"), F.lit("\n# sent_counter = "), _number(i), F.lit("\n1\t"),
        F.lit("the\tthe\tDET\n2-3\tx\n2\t"), c["c_name"], F.lit("\tx\tNOUN\n"),
    )
    return F.concat(F.lit("## text: "), title, F.lit("\n## chapter: "), chapter, F.lit("\n"), F.array_join(F.transform("cs", sentence), "\n"))


@R.query(f"WITH {_ROWS} SELECT n_name AS title, concat('7.', CAST(i AS STRING)) AS citation, concat('the ', c_name) AS text, concat('s', CAST(c_custkey AS STRING)) AS native_ref FROM c")
def conllu_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated sentences, cited by chapter and counter, with their own ids."""
    rows = _nations(spark, sf_dir).select("name", _conllu(F.col("n_name"), F.lit("7")).alias("content"))
    return _written(rows, lambda files: C.read(files, C.conllu).select("title", "citation", "text", "native_ref"))


@R.query(
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, c_custkey) AS place FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT r_name AS title, concat(CAST(n_nationkey AS STRING), '.', CAST(i AS STRING)) AS citation, CAST(place AS INT) AS place, count(*) OVER (PARTITION BY n_regionkey) AS segments FROM c"""
)
def conllu_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of one text are one work."""
    rows = _nations(spark, sf_dir).select("name", _conllu(F.col("r_name"), F.col("n_nationkey").cast("string")).alias("content"))

    def read(files: DataFrame) -> DataFrame:
        own = C.read(files, C.conllu).withColumn("path", F.regexp_extract("path", r"(name=[^/]+)", 1))
        t = C.catalog_tables(C.one_work(own, F.col("title")), "chapters", "conllu")
        found = t["segments"].join(t["works"].select("work_id", "title"), "work_id").join(t["artifacts"].select("work_id", "segment_count"), "work_id")
        return found.select("title", F.col("citation_path").alias("citation"), F.col("sort_key").alias("place"), F.col("segment_count").cast("bigint").alias("segments"))

    return _written(rows, read)


# legacy files are binary, so they come as frames


def _byte(c: Column) -> Column:
    return F.unhex(F.lpad(F.hex(c), 2, "0"))


def _ascii(c: Column) -> Column:
    return F.encode(c, "US-ASCII")


def _dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump for each region: a work for each nation (its number as a string), a line for each customer, cited by book and line."""
    letters = F.translate(F.lower("c_name"), "#0123456789 ", "abgdezhqikl ")
    customers = read_table(spark, sf_dir, "customer").withColumn("beta", letters)
    lines = customers.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "beta"))).alias("cs"))
    nations = read_table(spark, sf_dir, "nation").join(lines, F.col("n_nationkey") == F.col("c_nationkey"))
    # 0xEF 0x81 string 0xFF: the work; 0x98: a book by 7 bits; 0x81: line 1, then 0x80: one more
    line = lambda c, i: F.concat(F.when(i == 0, F.unhex(F.lit("81"))).otherwise(F.unhex(F.lit("80"))), _ascii(c["beta"]))
    body = F.aggregate(F.transform("cs", line), F.unhex(F.lit("")), lambda a, x: F.concat(a, x))
    number = F.lpad(F.col("n_nationkey").cast("string"), 3, "0")
    high = F.aggregate(F.transform(F.split(number, ""), lambda d: _byte(F.ascii(d) + 128)), F.unhex(F.lit("")), lambda a, x: F.concat(a, x))
    work = F.concat(F.unhex(F.lit("EF81")), high, F.unhex(F.lit("FF98")), _byte(F.lit(133)), body)
    grouped = nations.select("n_regionkey", F.struct("n_nationkey", work.alias("w")).alias("s")).groupBy("n_regionkey").agg(F.array_sort(F.collect_list("s")).alias("ws"))
    whole = F.aggregate(F.transform("ws", lambda s: s["w"]), F.unhex(F.lit("")), lambda a, x: F.concat(a, x))
    return grouped.select(F.concat(F.lit("/d/reg"), F.col("n_regionkey").cast("string"), F.lit(".txt")).alias("path"), F.concat(whole, F.unhex(F.lit("F0"))).alias("content"))


_DUMPED = """c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, c_custkey) AS place,
  regexp_replace(translate(translate(lower(c_name), '#0123456789 ', 'abgdezhqikl '), 'abgdezhqiklmncoprstufxyw', 'αβγδεζηθικλμνξοπρστυφχψω'), 'σ( |$)', 'ς\\1', 'g') AS greek FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


@R.query(f"WITH {_DUMPED} SELECT lpad(CAST(n_nationkey AS STRING), 3, '0') AS work, concat('5.', CAST(i AS STRING)) AS citation, CAST(place AS INT) AS place, greek AS text FROM c")
def dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy dumps: bookmark bytes make citations, beta code makes Greek."""
    return C.read_dumps(_dumps(spark, sf_dir), greek=True).select("work", "citation", "place", "text")


def _indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of each region's dump: one author, a work for each nation."""
    two = lambda n: F.unhex(F.lpad(F.hex(n), 4, "0"))
    title = F.concat(F.unhex(F.lit("1001")), _byte(F.char_length("n_name")), _ascii(F.col("n_name")))
    digits = F.split(F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), "")
    number = F.concat(F.unhex(F.lit("EF81")), F.aggregate(F.transform(digits, lambda d: _byte(F.ascii(d) + 128)), F.unhex(F.lit("")), lambda a, x: F.concat(a, x)), F.unhex(F.lit("FF")))
    work = F.concat(F.unhex(F.lit("020000")), two(F.col("n_nationkey").cast("long")), number, title, F.unhex(F.lit("110004")), _ascii(F.lit("line")))
    nations = read_table(spark, sf_dir, "nation").join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    works = nations.groupBy("n_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", work.alias("w")))).alias("ws"))
    author = F.concat(F.unhex(F.lit("0100000000EF80")), _byte(F.col("n_regionkey").cast("long") + 176), F.unhex(F.lit("FF1000")), _byte(F.char_length("r_name")), _ascii(F.col("r_name")))
    whole = F.aggregate(F.transform("ws", lambda s: s["w"]), author, lambda a, x: F.concat(a, x))
    return works.select(F.concat(F.lit("/i/reg"), F.col("n_regionkey").cast("string"), F.lit(".idt")).alias("path"), F.concat(whole, F.unhex(F.lit("00"))).alias("content"))


@R.query("SELECT concat('reg', CAST(n_regionkey AS STRING)) AS stem, lpad(CAST(n_nationkey AS STRING), 3, '0') AS work, n_name AS title, n_nationkey AS block, CAST(n_regionkey AS STRING) AS author_id, r_name AS author, 'line' AS levels FROM nation JOIN region ON r_regionkey = n_regionkey")
def index_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works, authors, blocks and levels of legacy indexes."""
    return C.read_indexes(_indexes(spark, sf_dir)).select(C.stem(F.col("path")).alias("stem"), "work", "title", "block", "author_id", "author", "levels")


@R.query(f"WITH {_DUMPED} SELECT n_name AS title, r_name AS author, concat('5.', CAST(i AS STRING)) AS citation, greek AS text FROM c JOIN region ON r_regionkey = n_regionkey")
def dump_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dumps split into the works of their index."""
    lines, works = C.read_dumps(_dumps(spark, sf_dir), greek=True), C.read_indexes(_indexes(spark, sf_dir))
    return C.split_works(lines, works, C.stem(F.col("path"))).select("title", "author", "citation", "text")


@R.query(
    """SELECT concat('tlg', lpad(CAST(n_nationkey AS STRING), 4, '0')) AS author_id, 'name' AS key, n_name AS value FROM nation
UNION ALL SELECT concat('tlg', lpad(CAST(n_nationkey AS STRING), 4, '0')), 'language', CASE WHEN n_nationkey % 3 = 0 THEN 'lat' ELSE 'grc' END FROM nation"""
)
def author_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and languages of legacy author tables."""
    number = F.lpad(F.col("n_nationkey").cast("string"), 4, "0")
    entry = F.concat(_ascii(F.concat(F.lit("TLG"), number, F.lit(" "), "n_name")), F.when(F.col("n_nationkey") % 3 == 0, F.unhex(F.lit("836C"))).otherwise(F.unhex(F.lit(""))), F.unhex(F.lit("FF")))
    rows = read_table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", entry.alias("e")))).alias("es"))
    head = F.concat(_ascii(F.lit("*TLG Greek")), F.unhex(F.lit("8367FF")))
    files = rows.select(F.col("n_regionkey").cast("string").alias("path"), F.aggregate(F.transform("es", lambda s: s["e"]), head, lambda a, x: F.concat(a, x)).alias("content"))
    return C.author_table(files, {"g": "grc", "l": "lat"}).select("author_id", "key", "value")


# what comes beside the texts


@R.query("SELECT CAST(p_partkey AS STRING) AS text_id, p_name AS title, CAST(p_size AS STRING) AS chapters FROM part")
def corpus_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipe table with its head and rule."""
    rows = read_table(spark, sf_dir, "part").select(F.concat(F.lit("| "), F.col("p_partkey").cast("string"), F.lit(" | "), "p_name", F.lit(" |"), F.col("p_size").cast("string"), F.lit(" |")).alias("value"))
    head = spark.createDataFrame([("| text_id | title | chapters |",), ("|---|:--|--:|",)], "value string")
    return _lined(head.unionByName(rows), lambda at: text_formats.read_markdown_table(spark.read.text(at), ["text_id", "title", "chapters"]))


@R.query(f"WITH {_ROWS} SELECT CAST(c_custkey AS STRING) AS subject_id, unnest(['book', 'title']) AS key, unnest([n_name, c_name]) AS value FROM c")
def chapter_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapter = lambda c: F.concat(F.lit('<chapter id="'), c["c_custkey"].cast("string"), F.lit('" book="'), F.col("n_name"), F.lit('"><title>'), c["c_name"], F.lit("</title><note/></chapter>"))
    rows = _nations(spark, sf_dir).select("name", F.concat(F.lit("<chapters>"), _each(chapter), F.lit("</chapters>")).alias("content"))
    return _written(rows, lambda files: E.chapter_infos(files).select("subject_id", "key", "value"))


#: So many items stand on a catalog page.
_PAGE = 4000


@R.query(f"WITH {_ROWS} SELECT n_name AS subject, CAST(i AS INT) AS item_no, c_name AS title, concat('http://x/', CAST(c_custkey AS STRING)) AS url, CASE WHEN i % 2 = 1 THEN r_name END AS author FROM c")
def catalog_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a long list goes on over pages, as each is read by one task
    at = lambda i: i + F.col("page") * _PAGE
    item = lambda c, i: F.concat(_number(at(i)), F.lit(". ["), c["c_name"], F.lit("](http://x/"), c["c_custkey"].cast("string"), F.lit(")\n"), F.when(at(i) % 2 == 0, F.concat(F.lit("   Author: "), F.col("r_name"), F.lit("\n"))).otherwise(""))
    numbers = F.sequence(F.lit(0), F.floor((F.size("cs") - 1) / _PAGE).cast("int"))
    lists = _nations(spark, sf_dir).select("name", "n_name", "r_name", F.posexplode(F.transform(numbers, lambda k: F.slice("cs", k * _PAGE + 1, _PAGE))).alias("page", "cs"))
    lists = lists.withColumn("name", F.concat("name", F.lit("-"), F.col("page").cast("string"))).repartition("name")
    rows = lists.select("name", F.concat(F.lit("# "), "n_name", F.lit("\n\nResults\n\n"), _each(item)).alias("content"))
    return _written(rows, lambda files: E.catalog_results(files).select("subject", "item_no", "title", "url", "author"))


@R.query("SELECT n_name AS subject, (n_nationkey + 1) * 1001 AS works FROM nation")
def subject_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("* ["), "n_name", F.lit("](http://x) "), F.format_number((F.col("n_nationkey") + 1) * 1001, 0))
    rows = read_table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("name")).agg(F.array_join(F.collect_list(line), "\n").alias("content"))
    return _written(rows, lambda files: E.subject_facets(files).select("subject", "works"))


@R.query(
    """SELECT 'textgroup' AS kind, concat('urn:', CAST(n_nationkey AS STRING)) AS urn, NULL AS group_urn, n_name AS title, NULL AS language FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)
UNION ALL SELECT 'work', concat('urn:', CAST(c_nationkey AS STRING), '.', CAST(c_custkey AS STRING)), concat('urn:', CAST(c_nationkey AS STRING)), c_name, 'grc' FROM customer
UNION ALL SELECT 'edition', concat('urn:', CAST(c_nationkey AS STRING), '.', CAST(c_custkey AS STRING), '.e'), concat('urn:', CAST(c_nationkey AS STRING), '.', CAST(c_custkey AS STRING)), 'first', NULL FROM customer"""
)
def inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text groups, works and editions of inventories."""
    urn = F.concat(F.lit("urn:"), F.col("n_nationkey").cast("string"))
    work = lambda c: F.concat(
        F.lit('<ti:work urn="'), urn, F.lit("."), c["c_custkey"].cast("string"), F.lit('" xml:lang="grc"><ti:title>'), c["c_name"], F.lit('</ti:title><ti:edition urn="'),
        urn, F.lit("."), c["c_custkey"].cast("string"), F.lit('.e"><ti:label>first</ti:label></ti:edition></ti:work>'),
    )
    content = F.concat(F.lit('<ti:TextInventory xmlns:ti="http://chs.harvard.edu/xmlns/cts"><ti:textgroup urn="'), urn, F.lit('"><ti:groupname>'), "n_name", F.lit("</ti:groupname>"), _each(work), F.lit("</ti:textgroup></ti:TextInventory>"))
    rows = _nations(spark, sf_dir).select("name", content.alias("content"))
    return _written(rows, lambda files: E.inventories(files).select("kind", "urn", "group_urn", "title", "language"))


@R.query("SELECT p_partkey AS number, p_name AS lemma, p_type AS description FROM part WHERE p_size > 3")
def database_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQLite files of entries, a file for each brand, read back by a query."""
    groups = read_table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("number"), F.col("p_name").alias("lemma"), F.col("p_type").alias("description"), F.col("p_size").cast("bigint").alias("size"))
    files = cut(E.database_files(groups, "p_brand", ["number", "lemma", "description", "size"], "entries"))
    return E.database_rows(files, "SELECT number, lemma, description FROM entries WHERE size > 3 ORDER BY number", "number bigint, lemma string, description string")


@R.query("SELECT p_partkey AS number, p_name AS lemma, p_type AS gloss FROM part")
def dictionary_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    sinks.write_delimited(read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("number"), F.col("p_name").alias("lemma"), F.col("p_type").alias("gloss")), folder, ",")
    out = cut(text_formats.read_table_text(spark, folder, "number bigint, lemma string, gloss string"))
    delete_folder(spark, folder)
    return out


@R.query("SELECT rpad(p_brand, 12, ' ') AS padded, p_brand AS stem, CAST(p_size AS STRING) AS code, p_name AS meaning FROM part")
def fixed_width_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word list of fixed columns."""
    line = F.concat(F.rpad("p_brand", 12, " "), F.lpad(F.col("p_size").cast("string"), 4, " "), F.lit("  "), "p_name")
    fields = {"stem": (1, 12), "code": (13, 4), "meaning": (19, 60)}
    found = _lined(read_table(spark, sf_dir, "part").select(line.alias("value")), lambda at: text_formats.read_fixed_width(spark.read.text(at), fields))
    return found.select(F.rpad("stem", 12, " ").alias("padded"), "stem", "code", "meaning")


@R.query("SELECT p_partkey AS page, p_name AS text, p_size % 5 = 0 AS broken FROM part")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines by schema; lines that don't parse are kept as they are."""
    whole = F.to_json(F.struct(F.col("p_partkey").alias("page"), F.col("p_name").alias("text")))
    line = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("{broken "), F.col("p_partkey").cast("string"), F.lit(" "), "p_name")).otherwise(whole)
    found = _lined(read_table(spark, sf_dir, "part").select(line.alias("value")), lambda at: text_formats.read_jsonl(spark, at, "page bigint, text string").select("*"))
    lost = F.regexp_extract("_corrupt", r"^\{broken (\d+) (.*)$", 1)
    return found.select(
        F.coalesce("page", F.nullif(lost, F.lit("")).cast("bigint")).alias("page"), F.coalesce("text", F.regexp_extract("_corrupt", r"^\{broken (\d+) (.*)$", 2)).alias("text"), F.col("_corrupt").isNotNull().alias("broken")
    )


@R.query("SELECT n_name AS alias, unnest(['a', 'b']) AS kind, concat(CAST(n_nationkey AS STRING), unnest(['a', 'b'])) AS target FROM nation")
def curated_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated records with nested lists, a file for each region, unrolled."""
    target = lambda k: F.struct(F.lit(k).alias("kind"), F.concat(F.col("n_nationkey").cast("string"), F.lit(k)).alias("target"))
    record = F.struct(F.col("n_name").alias("alias"), F.array(target("a"), target("b")).alias("targets"))
    rows = read_table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("name")).agg(F.to_json(F.collect_list(record)).alias("content"))
    folder = f"{shared_dir(spark)}/curated-{uuid.uuid4().hex}"
    rows.write.partitionBy("name").text(folder)
    got = text_formats.read_curated(spark, folder, "alias string, targets array<struct<kind:string,target:string>>", "part-*")
    out = cut(got.select("alias", F.inline("targets")))
    delete_folder(spark, folder)
    return out


_WHITE = "[ \\t\\n\\x0b\\f\\r]+"


@R.query(
    f"""WITH m AS (SELECT doc_id, concat('<b>', substr(coalesce(text, ''), 1, 4), '</b> {{{{cite|x}}}} ', coalesce(text, ''), ' [[Page ', lang, '|shown]] and [[Other]]<br/>') AS text FROM documents),
t AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(text, '<[^>]*>|\\{{\\{{[^}}]*\\}}\\}}|\\[\\[([^|\\]]*\\|)?|\\]\\]', ' ', 'g'), '{_WHITE}', ' ', 'g')) AS bare FROM m)
SELECT concat('s', CAST(doc_id AS STRING)) AS source_key, substr(text, 4, 4) AS title, md5(bare) AS text_md5, length(bare) AS chars,
  concat_ws(',', CASE WHEN bare = '' THEN 'empty' END, CASE WHEN length(bare) < 100 THEN 'short' END, CASE WHEN substr(text, 4, 4) = '' THEN 'untitled' END) AS flags FROM t"""
)
def staged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with markup, cleaned and staged for an import with what is wrong with them, written as JSON lines and read back."""
    own = F.coalesce("text", F.lit(""))
    marked = F.concat(F.lit("<b>"), F.substring(own, 1, 4), F.lit("</b> {{cite|x}} "), own, F.lit(" [[Page "), "lang", F.lit("|shown]] and [[Other]]<br/>"))
    docs = read_table(spark, sf_dir, "documents").select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("k"), marked.alias("text"))
    staged = E.stage_pages(docs.select("k", F.substring("text", 4, 4).alias("t"), "text"), "k", "t", "text", "pilot", 100)
    folder = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    sinks.write_json(staged, folder)
    out = cut(spark.read.schema(staged.schema).json(folder).select("source_key", "title", F.md5("text").alias("text_md5"), "chars", F.array_join("flags", ",").alias("flags")))
    delete_folder(spark, folder)
    return out


@R.query(
    f"""WITH t AS (SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS title, trim(regexp_replace(coalesce(text, ''), '{_WHITE}', ' ', 'g')) AS text FROM conversations),
s AS (SELECT title, list_filter(string_split(regexp_replace(text, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS ss FROM t WHERE length(text) >= 28)
SELECT title, CAST(i AS STRING) AS citation_path, md5(trim(ss[i])) AS text_md5, CAST(len(ss) AS INT) AS segments FROM s, unnest(range(1, len(ss) + 1)) AS x(i)"""
)
def imported_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged pages without a flag as works of sentences, of the whole texts."""
    turns = read_table(spark, sf_dir, "conversations")
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    pages = turns.select(key.alias("k"), key.alias("t"), F.col("text").alias("x"))
    t = C.catalog_tables(E.import_staged(E.stage_pages(pages, "k", "t", "x", "pilot", 28), "pilot", "en"), "pilot", "staged")
    found = t["segments"].join(t["works"].select("work_id", "title"), "work_id").join(t["artifacts"].select("work_id", F.col("segment_count").alias("segments")), "work_id")
    return found.select("title", "citation_path", F.md5("text").alias("text_md5"), "segments")


@R.query(f"WITH {_ROWS} SELECT n_name AS book, CAST(i AS INT) AS entry_no, CAST((i - 1) // 6 + 1 AS INT) AS page, concat(c_name, ' means something long') AS text FROM c")
def scanned_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned pages of two columns, six entries a page: lines become entries, hyphens at line ends go."""

    def line(c: Column, i: Column) -> Column:
        page, slot = F.floor(i / 6) + 1, i % 6
        left, top = F.when(slot < 3, 10).otherwise(400), (slot % 3) * 40
        tag = lambda dy, text: F.concat(F.lit('<text top="'), (top + dy).cast("string"), F.lit('" left="'), left.cast("string"), F.lit('">'), text, F.lit("</text>"))
        return F.struct(page.alias("page"), F.concat(tag(0, F.concat(c["c_name"], F.lit(" means some-"))), tag(10, F.lit("thing <i>long</i>"))).alias("x"))

    pages = _nations(spark, sf_dir).select("name", F.inline(F.transform("cs", line)))
    by_page = pages.groupBy("name", "page").agg(F.array_join(F.collect_list("x"), "").alias("x"))
    page = F.concat(F.lit('<page number="'), F.col("page").cast("string"), F.lit('">'), "x", F.lit("</page>"))
    rows = by_page.groupBy("name").agg(F.concat(F.lit("<pdf2xml>"), F.array_join(F.collect_list(page), ""), F.lit("</pdf2xml>")).alias("content"))
    names = read_table(spark, sf_dir, "nation").select(F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("book"))

    def read(files: DataFrame) -> DataFrame:
        entries = E.column_entries(E.scanned_lines(files), 300, F.col("text").contains(" means "))
        return entries.select(_name().alias("name"), F.col("entry_no").cast("int").alias("entry_no"), "page", "text").join(names, "name").select("book", "entry_no", "page", "text")

    return _written(rows, read)


@R.query(
    """WITH b AS (SELECT *, CAST(c_custkey // 60 AS STRING) AS path, c_custkey % 3 AS k, c_custkey * 10 AS place FROM customer),
r AS (SELECT path, c_custkey, 0 AS i, 1 AS level, NULL AS mark, place // 14 AS page, concat(c_name, ' means', CASE WHEN k = 0 THEN ' something longer' ELSE '' END) AS text FROM b
  UNION ALL SELECT path, c_custkey, 1, 2, 'I', (place + 1) // 14, 'I. first of all' FROM b WHERE k = 1 UNION ALL SELECT path, c_custkey, 2, 4, '1', (place + 3) // 14, '1. within' FROM b WHERE k = 1
  UNION ALL SELECT path, c_custkey, 3, 2, 'II', (place + 4) // 14, 'II. second' FROM b WHERE k = 1 UNION ALL SELECT path, c_custkey, 1, 3, 'B', (place + 1) // 14, 'B. letter' FROM b WHERE k = 2)
SELECT path, dense_rank() OVER (PARTITION BY path ORDER BY c_custkey) AS entry_no, row_number() OVER (PARTITION BY path ORDER BY c_custkey, i) AS block_no, level, mark, page, text FROM r"""
)
def scanned_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested senses of scanned entries that go over columns and pages."""
    lit = lambda *xs: F.array(*(F.lit(x) for x in xs))
    k = F.col("c_custkey") % 3
    more = F.when(k == 0, lit("some-", "thing longer")).when(k == 1, lit("I. first", "of all", "1. within", "II. second")).otherwise(lit("B. letter"))
    lines = read_table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(F.concat(F.array(F.concat("c_name", F.lit(" means"))), more)).alias("i", "text"))
    at = F.col("c_custkey") * 10 + F.col("i")
    left = F.when(at % 14 < 7, 10).otherwise(400)
    rows = lines.select(F.floor(F.col("c_custkey") / 60).cast("string").alias("path"), F.floor(at / 14).alias("page"), (at % 7 * 10).cast("int").alias("top"), left.alias("left"), "text")
    return E.column_senses(rows, 300, F.col("text").endswith(" means"))


@R.query(
    """SELECT p_brand AS book, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS entry_no, CAST(p_partkey AS STRING) AS number,
  CASE WHEN p_size % 7 <> 0 AND p_size % 3 > 0 THEN concat(p_name, ' ', lower(p_type), CASE WHEN p_size % 3 = 2 THEN ' and more' ELSE '' END) ELSE p_name END AS title, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS STRING) END AS page FROM part"""
)
def toc_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of contents with titles over one to three lines, running heads between them, and titles that another one interrupts."""
    size = F.col("p_size")
    line = lambda *cs: F.concat(*(F.lit(c) if c[:2] != "p_" else F.col(c).cast("string") for c in cs))
    head, end = line("p_partkey", ". ", "p_name"), line(" .... ", "p_size")
    lines = (
        F.when(size % 7 == 0, F.array(head))
        .when(size % 3 == 0, F.array(F.concat(head, end), F.lit("running head")))
        .when(size % 3 == 1, F.array(head, F.concat(F.lower("p_type"), end), F.lit("CONTENTS 12")))
        .otherwise(F.array(head, F.lower("p_type"), F.concat(F.lit("and more"), end)))
    )
    rows = read_table(spark, sf_dir, "part").select(F.col("p_brand").alias("book"), "p_partkey", F.posexplode(lines).alias("line", "text"))
    return scans.toc_entries(rows, ["book"], ["p_partkey", "line"], "text", r"^(\d+)\.\s", r"\s*\.{2,}\s*(\d+)")


@R.query(f"WITH {_ROWS} SELECT c_name AS key, concat(c_name, ' body') AS body, CASE WHEN i > 1 THEN CAST(i - 1 AS STRING) END AS prev, CAST(i + 1 AS STRING) AS next FROM c")
def linked_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary entries in XML, with the entries before and after them."""

    def entry(c: Column, i: Column) -> Column:
        prev = F.when(i > 0, F.concat(F.lit(' prev="'), i.cast("string"), F.lit('"'))).otherwise("")
        return F.concat(F.lit('<entry key="'), c["c_name"], F.lit('"'), prev, F.lit(' next="'), (i + 2).cast("string"), F.lit('"><b>'), c["c_name"], F.lit("</b> body</entry>"))

    rows = _nations(spark, sf_dir).select("name", F.concat(F.lit("<d>"), _each(entry), F.lit("</d>")).alias("content"))
    return _written(rows, lambda files: E.linked_entries(files).select("key", "body", "prev", "next"))


@R.query("SELECT 'H' || CAST(p_partkey AS STRING) AS number, p_name AS lemma, lower(p_type) AS gloss FROM part")
def numbered_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon in XML by numbers with leading zeros."""
    digits = F.col("p_partkey").cast("string")
    padded = F.concat(F.repeat(F.lit("0"), 6 - F.length(digits)), digits)  # lpad would cut longer numbers
    entry = F.concat(F.lit('<entry id="h'), padded, F.lit('"><key1>'), "p_name", F.lit("</key1><body>"), F.lower("p_type"), F.lit("</body></entry>"))
    raw = read_table(spark, sf_dir, "part").select("p_partkey", entry.alias("data"))
    from lectern.sources import dictionaries

    found = dictionaries.read_entries(raw, "p_partkey", "data").join(raw.select(F.col("p_partkey").alias("entry_no"), "data").hint("merge"), "entry_no")
    number = scripts.on_column(E.number_key, F.regexp_extract("data", 'id="([^"]+)"', 1))
    return found.select(number.alias("number"), F.col("key").alias("lemma"), F.col("plain_text").alias("gloss"))
