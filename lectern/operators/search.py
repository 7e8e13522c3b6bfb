"""A stored search index over segments, and searches in it.

An index is a folder of batches, each written once and never changed.  A batch has ``rows``, a search row for each segment (what it is, where it
stands, three normalized texts), in buckets of its work; ``postings``, a row for each term and segment, with the places of the term and
a number for what the segment can be filtered by (``facets`` has each set once), once for all fields in which it is the same; and ``blocks``, which sum the
postings of a term in a shard of the segments up: how many there are, the largest frequency and the least length.  Rows come together by
shards, and no posting is shuffled: each file of postings has some shards' in order of the term, each row of ``blocks`` a stretch of such a file.  ``commits`` tell which batches hold, with their counts, and
``tombstones`` which of their rows don't: a row that comes again replaces the older one, and rows can be deleted.  ``merge`` writes what
holds as one batch.  A commit is one rename, and of two writers at once the later one is refused, so readers see whole batches only.

A search reads commits, the blocks of its terms, and their postings; it filters before it scores, so no filter costs a hit.  Scores are BM25
against the counts of all rows that hold, whatever the batches.  A page is found from the shards that can score highest; others are read only if their
bound reaches the page's last score; texts are read for the page alone, from its works' buckets.  Modes: ``words`` (any of the query's terms),
``all`` (every one), ``phrase`` (one after the other), ``fuzzy`` (the first of some candidate spellings that stands whole in a segment).
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import scripts
from lectern.functions import text as X
from lectern.operators.text_search import B, K1, attach_context, index_issues
from lectern.storage import cut, delete_folder

SCHEMA_VERSION, NORMALIZER_VERSION = "4", "lower-fold-1"
#: Fields and what each holds: the text in lower case, without marks, and its ASCII words alone.
FIELDS = {"search": "search_text", "folded": "folded_text", "tokens": "token_text"}
ROW = (
    "segment_id work_id edition_id artifact_id collection_id language title author author_id source_id canonical_text_id cts_work_urn "
    "adapter segment_kind citation_path sort_key text group_id tags popularity_score global_popularity_score"
).split()
#: Columns of rows that aren't strings.
_INTS = ("sort_key", "popularity_score", "global_popularity_score")
#: Columns that postings can be filtered by; rows are by any.
FACETS = "language collection_id author_id source_id adapter segment_kind group_id".split()

_ROW_TYPES = ", ".join(f"{c} {'int' if c in _INTS else 'string'}" for c in ROW)
ROWS = f"{_ROW_TYPES}, search_text string, folded_text string, token_text string, tag_list array<string>, n_words bigint, n_chars bigint, row_key string"
POSTINGS = "term string, shard int, row_key string, work_id string, tf bigint, places array<int>, length bigint, facet bigint"
FACET_SETS = "facet bigint, facets array<string>"
BLOCKS = "field string, term string, shard int, n bigint, max_tf bigint, min_length bigint, tokens bigint"
TOMBSTONES = "of string, row_key string, search bigint, folded bigint, tokens bigint"
COMMITS = (
    "version bigint, step int, action string, batch string, row_buckets int, term_buckets int, shards int, n_docs bigint, "
    "search bigint, folded bigint, tokens bigint, schema_version string, normalizer_version string"
)
#: A bucket or shard for so many rows, up to the most; a part of the postings for so many words.
BUCKET_ROWS, PART_WORDS, SHARD_ROWS = 100_000, 2_000_000, 4096
MOST_BUCKETS, MOST_SHARDS = 1024, 256
#: Fewer postings than these are scored at once; pages that end in more ties are ordered by a join.
PRUNED_FROM, TIES = 100_000, 1000


def search_rows(segments: DataFrame, works: DataFrame, artifacts: DataFrame | None = None, classifications: DataFrame | None = None) -> DataFrame:
    """A row for each segment of a known work: the columns of ``ROW`` (null where no table has one), three normalized texts,
    their numbers of words and of code points, and a stable key."""
    side = lambda t, taken: t.select("work_id", *(c for c in ROW if c in t.columns and c not in taken))
    out = segments.join(side(works, segments.columns), "work_id")
    for table in (artifacts, classifications):
        if table is not None:
            found = side(table, out.columns)
            first = F.min(F.struct(*(c for c in found.columns if c != "work_id"))).alias("_s")  # one of each work
            out = out.join(found.groupBy("work_id").agg(first).select("work_id", "_s.*"), "work_id", "left")
    out = out.select(*((F.col(c) if c in out.columns else F.lit(None)).cast("int" if c in _INTS else "string").alias(c) for c in ROW))
    low = X.normalize_gloss(F.coalesce("text", F.lit("")))
    out = out.withColumn("search_text", low)
    out = out.withColumn("folded_text", scripts.on_column(scripts.strip_marks, F.col("search_text")))
    out = out.withColumn("token_text", F.trim(F.regexp_replace("folded_text", "[^0-9a-z]+", " ")))
    return out.withColumns(
        {
            "tag_list": X.tag_list(F.col("tags")),
            "n_words": F.size(words(F.col("token_text"))).cast("bigint"),
            "n_chars": F.char_length("text").cast("bigint"),
            "row_key": X.stable_id("row:", F.col("work_id"), F.col("segment_id")),
        }
    )


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def _facets() -> Column:
    plain = F.array(*(F.concat(F.lit(f"{c}="), F.col(c)) for c in FACETS))
    tags = F.transform(F.coalesce("tag_list", F.array().cast("array<string>")), lambda t: F.concat(F.lit("tag="), t))
    return F.concat(F.array_compact(plain), tags)


_COUNTED = "field string, term string, row_key string, work_id string, facet bigint, tf bigint, places array<int>, length bigint"


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of each row, once for all fields (their names, comma-joined) where its places and the length are the same; as a row has
    all its words, nothing has to be shuffled to count them."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            fields, terms, rows, places, ends, lengths = [], [], [], [], [0], []
            for k, texts in enumerate(zip(*(part.column(c).to_pylist() for c in FIELDS.values()), strict=True)):
                # term and number of words -> the places, and the fields where it has these
                merged: dict[tuple[str, int], list[tuple[list[int], str]]] = {}
                for f, text in zip(FIELDS, texts, strict=True):
                    found: dict[str, list[int]] = {}
                    words_ = [w for w in (text or "").split(" ") if w]
                    for place, w in enumerate(words_):
                        found.setdefault(w, []).append(place)
                    for w, own in found.items():
                        kinds = merged.setdefault((w, len(words_)), [])
                        same = next((i for i, (p, _) in enumerate(kinds) if p == own), None)
                        if same is None:
                            kinds.append((own, f))
                        else:
                            kinds[same] = own, f"{kinds[same][1]},{f}"
                for (w, length), kinds in merged.items():
                    for own, where in kinds:
                        fields.append(where)
                        terms.append(w)
                        rows.append(k)
                        lengths.append(length)
                        places += own
                        ends.append(len(places))
            index = pa.array(rows, pa.int64())
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
            carried = [part.column(c).take(index) for c in ("row_key", "work_id", "facet")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(fields, pa.string()), pa.array(terms, pa.string()), *carried, pc.list_value_length(listed).cast(pa.int64()), listed, pa.array(lengths, pa.int64())],
                names=[c.split(" ")[0] for c in _COUNTED.split(", ")],
            )


def _shard(shards: int) -> Column:
    return (F.crc32(F.col("row_key").cast("binary")) % shards).cast("int")


def _countable(rows: DataFrame) -> DataFrame:
    return rows.select("row_key", "work_id", F.xxhash64(_facets()).alias("facet"), *FIELDS.values())


def _of_one_field(df: DataFrame) -> DataFrame:
    """A row for each field of a row that stands for several."""
    return df.withColumn("field", F.explode(F.split("field", ",")))


def _having(field: str) -> list[str]:
    """The values of ``field`` in postings and blocks that include a field."""
    found = [""]
    for f in FIELDS:
        found += [f"{x},{f}" if x else f for x in found]
    return [x for x in found if field in x.split(",")]


def postings(rows: DataFrame, shards: int = 1) -> DataFrame:
    """``field`` and the columns of ``POSTINGS``."""
    return _of_one_field(_countable(rows).mapInArrow(_counted, _COUNTED)).withColumn("shard", _shard(shards))


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of postings in order: one of each field, term and shard of a stretch; what stands in two has two, which readers sum up."""
    for batch in batches:
        found = pa.Table.from_batches([batch]).group_by(["field", "term", "shard"]).aggregate([("tf", "count"), ("tf", "max"), ("length", "min"), ("tf", "sum")])
        columns = [found.column(c) for c in ("field", "term", "shard", "tf_count", "tf_max", "length_min", "tf_sum")]
        yield from pa.table(columns, names=[c.split(" ")[0] for c in BLOCKS.split(", ")]).to_batches()


def _bucket(c: Column, buckets: int) -> Column:
    return (F.crc32(c.cast("binary")) % buckets).cast("int")


def _bucket_of(value: str, buckets: int) -> int:
    return zlib.crc32(value.encode()) % buckets


def _parts(n: int, each: int, most: int) -> int:
    return max(1, min(most, -(-n // each)))


class Index:
    """An index's tables as of its newest commit."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        names = self._commit_names()
        paths = [f"{self.folder}/commits/{n}" for n in names]
        found = spark.read.schema(COMMITS).parquet(*paths).collect() if paths else []
        found.sort(key=lambda r: (r["version"], r["step"]))
        self.version = max((int(n[1:]) for n in names), default=0)
        self.commits: list[Row] = []
        for r in found:
            self.commits = [] if r["action"] == "clear" else [*self.commits, r]
        self.batches = {r["batch"]: r for r in self.commits if r["action"] == "add"}
        self.n_docs = sum(r["n_docs"] for r in self.commits)
        self.totals = {f: sum(r[f] for r in self.commits) for f in FIELDS}

    def _commit_names(self) -> list[str]:
        path, files = _path(self.spark, f"{self.folder}/commits")
        return sorted(x.getPath().getName() for x in files.listStatus(path) if x.getPath().getName().startswith("v")) if files.exists(path) else []

    def _table(self, name: str, schema: str, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], f"{schema}, batch string")
        reader = self.spark.read.schema(f"{schema}, batch string").option("basePath", f"{self.folder}/{name}")
        return reader.parquet(*(f"{self.folder}/{name}/batch={b}" for b in batches))

    @property
    def tombstones(self) -> DataFrame | None:
        own = [r["batch"] for r in self.commits if r["action"] == "delete"]
        return self._table("tombstones", TOMBSTONES, own).drop("batch").withColumnRenamed("of", "batch") if own else None

    def _holding(self, df: DataFrame) -> DataFrame:
        gone = self.tombstones
        return df if gone is None else df.join(gone, ["batch", "row_key"], "left_anti")

    @property
    def rows(self) -> DataFrame:
        return self._holding(self._table("rows", f"{ROWS}, bucket int", list(self.batches)))

    def _all_postings(self) -> DataFrame:
        return self._table("postings", f"{POSTINGS}, field string, bucket int", list(self.batches))

    @property
    def postings(self) -> DataFrame:
        return self._holding(_of_one_field(self._all_postings()))

    @property
    def facets(self) -> DataFrame:
        return self._table("facets", FACET_SETS, list(self.batches))

    @property
    def blocks(self) -> DataFrame:
        return _of_one_field(self._table("blocks", BLOCKS, list(self.batches)))

    def blocks_of(self, field: str, terms: list[str]) -> DataFrame:
        """``batch, shard, term, n, max_tf, min_length, tokens`` of some terms."""
        own = self._table("blocks", BLOCKS, list(self.batches)).filter(F.col("field").isin(_having(field)) & F.col("term").isin(terms)).groupBy("batch", "shard", "term")
        return own.agg(*(f(c).cast("bigint").alias(c) for c, f in (("n", F.sum), ("max_tf", F.max), ("min_length", F.min), ("tokens", F.sum))))

    @property
    def meta(self) -> DataFrame:
        """``key, value``: the versions of the batches that hold (an empty index has the current ones), and its counts."""
        versions = {k: sorted({r[k] for r in self.batches.values()}) or [v] for k, v in (("schema_version", SCHEMA_VERSION), ("normalizer_version", NORMALIZER_VERSION))}
        told = {k: ",".join(v) for k, v in versions.items()} | {"fields": ",".join(FIELDS), "rows": str(self.n_docs)}
        return self.spark.createDataFrame(list(told.items()), "key string, value string")

    def issues(self, **expected: str) -> DataFrame:
        """``key, expected, value`` where a version or setting isn't the one that searches expect."""
        return index_issues(self.meta, {"schema_version": SCHEMA_VERSION, "normalizer_version": NORMALIZER_VERSION, **expected})

    def stale_works(self, segments: DataFrame) -> DataFrame:
        """``work_id, expected, found``: works of which the index has another number of segments than a table (``work_id, segment_id``) has."""
        own = self.rows.groupBy("work_id").agg(F.count("*").alias("found"))
        want = segments.groupBy("work_id").agg(F.countDistinct("segment_id").alias("expected"))
        both = want.join(own, "work_id", "full").select("work_id", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("expected", "found")))
        return both.filter("expected <> found")

    def counts(self) -> DataFrame:
        """``field, postings, terms, tokens``: what the blocks say, less what the deleted rows have."""
        each = self.blocks.select("field", "term", "n", "tokens")
        gone = self.tombstones
        if gone is not None:
            rows = self._table("rows", f"{ROWS}, bucket int", list(self.batches)).join(gone.select("batch", "row_key").distinct(), ["batch", "row_key"], "left_semi")
            less = _of_one_field(_countable(rows).mapInArrow(_counted, _COUNTED).select("field", "term", "tf"))
            each = each.unionByName(less.select("field", "term", F.lit(-1).cast("bigint").alias("n"), (-F.col("tf")).alias("tokens")))
        each = each.groupBy("field", "term").agg(F.sum("n").cast("bigint").alias("n"), F.sum("tokens").cast("bigint").alias("tokens")).filter("n > 0")
        return each.groupBy("field").agg(F.sum("n").alias("postings"), F.count("*").alias("terms"), F.sum("tokens").cast("bigint").alias("tokens"))

    def _in_buckets(self, values: list[str], setting: str, batches: list[str] | None = None) -> Column:
        """The buckets of some values, batch by batch: a test of partition columns."""
        test = F.lit(False)
        for batch, r in self.batches.items():
            if batches is None or batch in batches:
                test = test | (F.col("batch") == batch) & F.col("bucket").isin(sorted({_bucket_of(v, r[setting]) for v in values}))
        return test

    def _all_of_terms(self, field: str, terms: list[str]) -> DataFrame:
        test = F.col("field").isin(_having(field)) & self._in_buckets(terms, "term_buckets") & F.col("term").isin(terms)
        return self._all_postings().filter(test).withColumn("field", F.lit(field))

    def of_terms(self, field: str, terms: list[str], shards: list[tuple[str, int]] | None = None) -> DataFrame:
        """The postings of some terms, of some (batch, shard)s; other fields' and terms' parts aren't read."""
        found = self._all_of_terms(field, terms)
        if shards is not None:
            by_batch: dict[str, list[int]] = {}
            for batch, shard in shards:
                by_batch.setdefault(batch, []).append(shard)
            test = F.lit(False)
            for batch, own in by_batch.items():
                test = test | (F.col("batch") == batch) & F.col("shard").isin(own)
            found = found.filter(test)
        return self._holding(found)

    def of_works(self, works: list[str]) -> DataFrame:
        """The rows of some works; other buckets aren't read."""
        return self._holding(self._table("rows", f"{ROWS}, bucket int", list(self.batches)).filter(self._in_buckets(works, "row_buckets") & F.col("work_id").isin(works)))


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _commit(index: Index, rows: list[dict]) -> None:
    """Make the next version; another writer's that came first is an error, and nothing has changed."""
    spark, version = index.spark, index.version + 1
    names = [c.split(" ")[0] for c in COMMITS.split(", ")]
    told = [tuple({**r, "version": version, "step": k}.get(n) for n in names) for k, r in enumerate(rows)]
    staged = f"{index.folder}/staged-{uuid.uuid4().hex}"
    spark.createDataFrame(told, COMMITS).coalesce(1).write.parquet(staged)
    target, files = _path(spark, f"{index.folder}/commits/v{version:010d}")
    source, _ = _path(spark, staged)
    files.mkdirs(target.getParent())
    refused = files.exists(target) or not files.rename(source, target)
    inside, _ = _path(spark, f"{index.folder}/commits/v{version:010d}/{source.getName()}")
    if refused or files.exists(inside):  # a rename onto a folder moves into it
        files.delete(inside if files.exists(inside) else source, True)
        raise RuntimeError(f"{index.folder}: version {version} was committed by another writer")


def _write_batch(index: Index, rows: DataFrame) -> dict:
    """Write a batch that doesn't hold yet, and return its commit."""
    spark, folder, batch = index.spark, index.folder, uuid.uuid4().hex
    names = [f.split(" ")[0] for f in ROWS.split(", ")]
    rows = rows.select(*names)
    n = rows.select("row_key").count()
    row_buckets, shards = _parts(n, BUCKET_ROWS, MOST_BUCKETS), _parts(n, SHARD_ROWS, MOST_SHARDS)
    dealt = rows.withColumn("bucket", _bucket(F.col("work_id"), row_buckets)).hint("rebalance", "bucket")
    dealt.sortWithinPartitions("bucket", "work_id", "sort_key").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/rows/batch={batch}")
    own = index._table("rows", f"{ROWS}, bucket int", [batch])
    lengths = own.agg(F.count("*").alias("n_docs"), *(F.coalesce(F.sum(F.size(words(F.col(c)))), F.lit(0)).cast("bigint").alias(f) for f, c in FIELDS.items())).first()
    if lengths["n_docs"] and own.groupBy("row_key").count().filter("count > 1").isEmpty() is False:
        delete_folder(spark, f"{folder}/rows/batch={batch}")
        order = ["text", *(c for c in names if c not in ("text", "row_key"))]
        return _write_batch(index, rows.groupBy("row_key").agg(F.max(F.struct(*order)).alias("r")).select("r.*", "row_key"))
    # rows of a shard come together, or of a part of it where one is more than a task's; their postings stay where they are
    parts = -(-sum(lengths[f] for f in FIELDS) // PART_WORDS) or 1
    part = (F.crc32(F.reverse("row_key").cast("binary")) % max(1, -(-2 * parts // shards) if parts > shards else 1)).cast("int")
    dealt = _countable(own).withColumn("shard", _shard(shards)).repartition(parts, "shard", part)
    found = dealt.drop("shard").mapInArrow(_counted, _COUNTED).withColumns({"shard": _shard(shards), "bucket": F.lit(0)})
    found.sortWithinPartitions("field", "bucket", "term", "shard").write.option("compression", "zstd").partitionBy("field", "bucket").parquet(f"{folder}/postings/batch={batch}")
    sets = own.select(_facets().alias("facets")).distinct().select(F.xxhash64("facets").alias("facet"), "facets")
    sets.hint("rebalance").write.parquet(f"{folder}/facets/batch={batch}")
    written = index._table("postings", f"{POSTINGS}, field string, bucket int", [batch]).select("field", "term", "shard", "tf", "length")
    written.mapInArrow(_summed, BLOCKS).sortWithinPartitions("field", "term").write.option("compression", "zstd").parquet(f"{folder}/blocks/batch={batch}")
    versions = {"schema_version": SCHEMA_VERSION, "normalizer_version": NORMALIZER_VERSION}
    return {"action": "add", "batch": batch, "row_buckets": row_buckets, "term_buckets": 1, "shards": shards, **lengths.asDict(), **versions}


def _write_tombstones(index: Index, gone: DataFrame) -> list[dict]:
    """Write what no longer holds (``batch, row_key`` and three lengths), and return its commit, if there is any."""
    batch = uuid.uuid4().hex
    path = f"{index.folder}/tombstones/batch={batch}"
    gone.select(F.col("batch").alias("of"), "row_key", *FIELDS).write.parquet(path)
    told = index._table("tombstones", TOMBSTONES, [batch]).agg(F.count("*").alias("n_docs"), *(F.sum(f).alias(f) for f in FIELDS)).first()
    if not told["n_docs"]:
        delete_folder(index.spark, path)
        return []
    return [{"action": "delete", "batch": batch, **{k: -v for k, v in told.asDict().items()}}]


def _with_lengths(rows: DataFrame) -> DataFrame:
    return rows.select("batch", "row_key", *(F.size(words(F.col(c))).cast("bigint").alias(f) for f, c in FIELDS.items()))


def append(rows: DataFrame, folder: str) -> Index:
    """Add search rows to an index, new or old; a row whose key is there replaces the older one, and of equal keys in
    ``rows`` the one with the greatest text is taken."""
    index = Index(rows.sparkSession, folder)
    added = _write_batch(index, rows)
    gone = []
    if index.batches:
        new = index._table("rows", f"{ROWS}, bucket int", [added["batch"]]).select("row_key")
        gone = _write_tombstones(index, _with_lengths(index.rows.join(new, "row_key", "left_semi")))
    _commit(index, [*gone, added])
    return Index(rows.sparkSession, folder)


def delete(index: Index, keys: DataFrame, column: str = "row_key") -> Index:
    """Delete the rows whose ``column`` is one of a frame's."""
    gone = _write_tombstones(index, _with_lengths(index.rows.join(keys.select(column).distinct(), column, "left_semi")))
    if gone:
        _commit(index, gone)
    return Index(index.spark, index.folder)


def merge(index: Index) -> Index:
    """Write what holds as one batch, without tombstones; the older batches' folders stay for readers of older versions."""
    added = _write_batch(index, index.rows)
    _commit(index, [{"action": "clear"}, added])
    return Index(index.spark, index.folder)


def build_index(rows: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Write search rows as an index: a new one, in the place of another (``overwrite``) or added to it (``append``)."""
    index = Index(rows.sparkSession, folder)
    if index.version and mode == "errorifexists":
        raise FileExistsError(folder)
    if mode == "overwrite":
        _commit(index, [{"action": "clear"}, _write_batch(index, rows)])
    else:
        append(rows, folder)


def query_terms(text: str, field: str = "tokens") -> list[str]:
    """A query's terms, normalized as the field is."""
    low = " ".join(text.lower().split())
    if field != "search":
        low = scripts.strip_marks(low)
    if field == "tokens":
        low = "".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" else " " for c in low)
    return low.split()


def query_candidates(text: str, language: str | None = None, field: str = "tokens", aliases: dict[str, list[str]] | None = None, most: int = 32) -> list[list[str]]:
    """Spellings of a query as lists of terms, each once, in the order they are tried: as it is, with the language's letter
    variants, transliterated, and the other names of a concept.  At most ``most`` are tried, which is the feature."""
    out = [text]
    low = text.lower()
    if language in (None, "lat"):
        out += scripts.expand_variants(low, {"i": ["i", "j"], "j": ["j", "i"], "u": ["u", "v"], "v": ["v", "u"]}, most)
    if language == "grc":
        out.append(scripts.beta_to_greek(text))
    if language == "san":
        out += [scripts.slp1_to_iast(text), scripts.iast_to_slp1(text)]
    out += (aliases or {}).get(low, [])
    found = dict.fromkeys(tuple(query_terms(t, field)) for t in out)
    return [list(t) for t in found if t][:most]


def _less(n: int):
    return lambda place: place - n


class Query:
    """What is looked for: distinct terms, how they have to stand, and what each weighs in an index."""

    def __init__(self, index: Index, text: str, mode: str, field: str, filters: dict[str, str], aliases: dict[str, list[str]] | None):
        self.index, self.mode, self.field, self.filters = index, mode, field, filters
        fuzzy = mode == "fuzzy"
        self.asked = [] if fuzzy else query_terms(text, field)
        self.candidates = query_candidates(text, filters.get("language"), field, aliases) if fuzzy else []
        self.terms = list(dict.fromkeys([*self.asked, *(t for c in self.candidates for t in c)]))
        blocks = index.blocks_of(field, self.terms).collect() if self.terms and index.batches else []
        self.blocks: dict[tuple[str, int], dict[str, Row]] = {}
        held = dict.fromkeys(self.terms, 0)
        for r in blocks:  # of the query's terms: MOST_SHARDS of a batch at most
            self.blocks.setdefault((r["batch"], r["shard"]), {})[r["term"]] = r
            held[r["term"]] += r["n"]
        if index.tombstones is not None and blocks:
            found = index._all_of_terms(field, self.terms)
            for r in found.join(index.tombstones, ["batch", "row_key"], "left_semi").groupBy("term").count().collect():
                held[r["term"]] -= r["count"]
        n = index.n_docs
        self.weights = {t: math.log(1 + (n - df + 0.5) / (df + 0.5)) for t, df in held.items()}
        self.mean = index.totals[field] / n if n else 1.0

    def _possible(self, there: dict[str, Row]) -> bool:
        if self.mode == "fuzzy":
            return any(all(t in there for t in c) for c in self.candidates)
        return self.mode == "words" or all(t in there for t in self.terms)

    def bounds(self) -> dict[tuple[str, int], float]:
        """What no row of a shard scores more than."""
        norm = lambda r: K1 * (1 - B + B * r["min_length"] / self.mean)
        one = lambda r: self.weights[r["term"]] * r["max_tf"] * (K1 + 1) / (r["max_tf"] + norm(r))
        return {k: sum(map(one, there.values())) * (1 + 1e-9) for k, there in self.blocks.items() if self._possible(there)}

    def hits(self, shards: list[tuple[str, int]] | None = None) -> DataFrame:
        """``batch, row_key, work_id, score, matched`` of all rows that are found in some shards."""
        found = self.index.of_terms(self.field, self.terms, shards)
        sets = None
        for key, value in self.filters.items():
            name = "group_id" if key == "group" else key
            if name in FACETS or name == "tag":
                sets = (self.index.facets if sets is None else sets).filter(F.array_contains("facets", f"{name}={value}"))
            elif name == "work_id":
                found = found.filter(F.col("work_id") == value)
            else:
                found = found.join(self.index.rows.filter(F.col(name) == value).select("batch", "row_key"), ["batch", "row_key"], "left_semi")
        if sets is not None:
            found = found.join(sets.select("facet").distinct(), "facet", "left_semi")
        own = found.groupBy("batch", "row_key", "work_id")
        norm = K1 * (1 - B + B * F.col("length") / F.lit(self.mean))
        part = F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
        # a column for each term, so that scores are summed in the same order for all rows
        parts = [F.max(F.when(F.col("term") == t, part * F.lit(w))).alias(f"p{i}") for i, (t, w) in enumerate(self.weights.items())]
        places = [F.max(F.when(F.col("term") == t, F.col("places"))).alias(f"at{i}") for i, t in enumerate(self.terms)] if self.mode == "phrase" else []
        found = own.agg(*parts, *places)
        number = {t: i for i, t in enumerate(self.terms)}
        score = F.lit(0.0)
        for i in range(len(self.terms)):
            score = score + F.coalesce(f"p{i}", F.lit(0.0))
        has = lambda terms: _every([F.col(f"p{number[t]}").isNotNull() for t in terms])
        if self.mode in ("all", "phrase"):
            found = found.filter(has(self.terms))
        if self.mode == "phrase":
            starts = None
            for k, t in enumerate(self.asked):
                own_places = F.transform(f"at{number[t]}", _less(k))
                starts = own_places if starts is None else F.array_intersect(starts, own_places)
            found = found.filter(F.size(starts) > 0)
        matched = F.lit(" ".join(self.asked))
        if self.mode == "fuzzy":
            matched = F.coalesce(*(F.when(has(c), F.lit(" ".join(c))) for c in self.candidates))
            found = found.filter(matched.isNotNull())
        return found.select("batch", "row_key", "work_id", score.alias("score"), matched.alias("matched"))

    def first(self, k: int) -> list[Row] | None:
        """The rows that score at least as much as the ``k``-th best; None if there are over ``TIES`` more."""
        bounds = self.bounds()
        best = sorted(bounds, key=lambda s: -bounds[s])
        sizes = {s: sum(r["n"] for r in self.blocks[s].values()) for s in best}
        read = best
        if sum(sizes.values()) > PRUNED_FROM:
            read, total = [], 0
            for s in best:
                if total >= max(PRUNED_FROM // 4, 20 * k):
                    break
                read.append(s)
                total += sizes[s]
            top = self.hits(read).select("score").orderBy(F.desc("score")).limit(k).collect()
            least = top[-1]["score"] if len(top) == k else 0.0
            read = [s for s in best if bounds[s] >= least]
        if not read:
            return []
        found = self.hits(read).orderBy(F.desc("score")).limit(k + TIES + 1).collect()
        if len(found) <= k:
            return found
        least = found[k - 1]["score"]
        return None if found[-1]["score"] == least and len(found) > k + TIES else [r for r in found if r["score"] >= least]


def _every(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


HITS = "batch string, row_key string, work_id string, score double, matched string"


def matches(index: Index, text: str, mode: str = "words", field: str = "tokens", language: str | None = None, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """``row_key, score, matched``: all segments that a query finds; ``language`` chooses the spellings of ``fuzzy``."""
    query = Query(index, text, mode, field, {}, aliases)
    if mode == "fuzzy" and language is not None:
        query = Query(index, text, mode, field, {"language": language}, aliases)
        query.filters = {}
    found = query.hits() if query.blocks else index.spark.createDataFrame([], HITS)
    return found.select("row_key", "score", "matched")


def search(
    index: Index,
    text: str,
    mode: str = "words",
    field: str = "tokens",
    filters: dict[str, str] | None = None,
    aliases: dict[str, list[str]] | None = None,
    context: int = 0,
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    """A page of hits, best first: search rows with ``score``, ``matched``, ``place`` (from 1), and with ``context`` the texts before and
    after in the same work.  Ties are in order of language, title, place in the work and segment."""
    query = Query(index, text, mode, field, filters or {}, aliases)
    found = query.first(offset + limit) if query.blocks else []
    order = [F.desc("score"), "language", "title", "sort_key", "segment_id"]
    if found is None:  # more ties than a page's: their order is the rows'
        hits = index.rows.drop("work_id", "text", *FIELDS.values()).join(query.hits(list(query.bounds())), ["batch", "row_key"])
        keys = hits.orderBy(*order).limit(offset + limit).select("batch", "row_key", "work_id", "score", "matched").collect()
    else:
        keys = found
    works = sorted({r["work_id"] for r in keys})
    page = index.of_works(works) if works else index.rows.limit(0)
    hits = page.join(F.broadcast(index.spark.createDataFrame(keys, HITS).drop("work_id")), ["batch", "row_key"])  # a page and its ties
    best = hits.orderBy(*order).offset(offset).limit(limit)
    best = best.withColumn("place", (F.row_number().over(Window.orderBy(*order)) + offset).cast("bigint")).drop("batch", "bucket")
    if not context:
        return best
    best = cut(best)  # a page, which is read twice
    return attach_context(best, page.select("work_id", "sort_key", "text"), ["work_id"], "sort_key", "text", context)
