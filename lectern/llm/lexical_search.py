"""Ranked lexical search: documents scored one at a time by a k-way heap merge over doc_id-sorted compressed postings.

A shard is a run of an input partition's documents, at most ``SHARD_DOCS`` of them or ``SHARD_TOKENS`` words, so no text is
shuffled and no shard grows with the table.  Its documents are sorted by doc_id and numbered; a term's postings are the
numbers' differences and the term frequencies as variable-length bytes.  ``build_index`` keeps every term, or only given
ones when the queries are known beforehand; its rows are a table like any other and can be stored.

``search`` takes the items in blocks of about ``ITEM_BYTES``; a block's terms filter the index, and the counts of all shards
give the weights.  In each shard and for each item a heap holds the next place of each posting list, so documents come up in
ascending order, and a second heap keeps the ``k`` best, the worst first.  Lists that together can't lift a document over the worst of
the k leave the merge and are only looked up for documents that the others bring, and not even that once the rest can't reach it: this
loses no result, as a later document with an equal score never comes first.  The shards' results are merged by a window that
Spark limits before it shuffles.

Scores are 64-bit integers but for a term's weight, ``floor(1000 * ln((2N + 2) / (2df + 1)))`` in doubles.

Defined results: a null or empty text and one without a term match nothing and don't count among the N documents; texts of any
length are read whole, in parts; repeated rows are documents of their own; equal scores stand by ascending doc_id, a null one last;
repeated items are ranked each, a null item_id is an item like any other; items without a term, or an empty table, give no
row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import release_caches, slices

K = 10
SHARD_DOCS, SHARD_TOKENS = 1 << 14, 1 << 22
#: Bytes of a text whose words are held at once.
PART_BYTES = 1 << 20
#: Bytes of items whose terms and weights are sent to the tasks at once.
ITEM_BYTES = 4 << 20

#: A-Z become a-z, other ASCII but digits and a-z become blanks; bytes of other characters stay.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def term_parts(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of about ``PART_BYTES``."""
    text = text.translate(FOLD)
    at = 0
    while at < len(text):
        to = len(text) if len(text) - at <= PART_BYTES else text.find(b" ", at + PART_BYTES)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


def pack_lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Each list of non-negative numbers as variable-length bytes; ``ends`` are the lists' ends within ``values``."""
    v = values.astype(np.uint64)
    sizes = np.ones(len(v), np.int64)
    for k in range(1, 10):
        sizes += v >= np.uint64(1 << 7 * k)
    stops = np.cumsum(sizes)
    out = np.zeros(int(stops[-1]) if len(v) else 0, np.uint8)
    for k in range(int(sizes.max(initial=0))):
        own = np.flatnonzero(sizes > k)
        more = np.where(sizes[own] > k + 1, 128, 0)
        out[stops[own] - sizes[own] + k] = (v[own] >> np.uint64(7 * k) & np.uint64(127)).astype(np.int64) | more
    offsets = np.concatenate(([0], stops[ends - 1] if len(v) else np.zeros(len(ends), np.int64))).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), buffers)


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    stops = np.flatnonzero(b < 128)
    starts = np.concatenate(([0], stops[:-1] + 1))
    shifts = 7 * (np.arange(len(b)) - np.repeat(starts, stops - starts + 1))
    return np.add.reduceat((b & 127).astype(np.uint64) << shifts.astype(np.uint64), starts).astype(np.int64)


class Shard:
    """Counts of the terms of documents that are added one by one."""

    def __init__(self, known: dict[bytes, int] | None):
        self.known = known
        self.terms: defaultdict[bytes, int] = defaultdict()
        self.terms.default_factory = self.terms.__len__
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        n = 0
        for words in term_parts(text):
            n += len(words)
            if self.known is None:
                found = np.fromiter(map(self.terms.__getitem__, words), np.int64, len(words))
            else:
                found = np.array([x for x in map(self.known.get, words) if x is not None], np.int64)
            keys, counts = np.unique(found, return_counts=True)
            self.keys.append(keys << 32 | len(self.ids))
            self.counts.append(counts)
        if n:
            self.ids.append(doc_id)
            self.lengths.append(n)
            self.tokens += n

    @property
    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.tokens >= SHARD_TOKENS

    def rows(self, number: int) -> pa.RecordBatch | None:
        """A row for each term, and one without a term for the documents."""
        if not self.ids:
            return None
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        keys = np.concatenate(self.keys)
        keys = keys >> 32 << 32 | place[keys & 0xFFFFFFFF]
        sort = np.argsort(keys, kind="stable")
        keys, counts = keys[sort], np.concatenate(self.counts)[sort]
        if len(keys):  # parts of one long text
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys, counts = keys[first], np.add.reduceat(counts, first)
        terms, places = keys >> 32, keys & 0xFFFFFFFF
        begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(terms)), bool), terms[1:] != terms[:-1])))
        ends = np.append(begins[1:], len(terms))[: len(begins)]
        gaps = places.copy()
        gaps[1:] -= places[:-1]
        gaps[begins] = places[begins]
        names = list(self.terms if self.known is None else self.known)
        lengths = np.array(self.lengths, np.int64)[order]
        ids = pa.array([self.ids[i] for i in order], pa.int64())
        table = pa.RecordBatch.from_arrays([ids, pa.array(lengths)], names=["doc_id", "length"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(table)
        total = np.add.reduceat(counts, begins) if len(begins) else np.zeros(0, np.int64)
        binary = pa.large_binary()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(begins) + 1, number, np.int64)),
                pa.array([*(names[i] for i in terms[begins].tolist()), None], pa.binary()),
                pa.array(np.append(ends - begins, len(order))),
                pa.array(np.append(total, lengths.sum())),
                pa.chunked_array([pack_lists(gaps, ends), pa.array([sink.getvalue().to_pybytes()], binary)]).combine_chunks(),
                pa.chunked_array([pack_lists(counts, ends), pa.array([None], binary)]).combine_chunks(),
            ],
            names=["shard", "term", "n_docs", "n_tokens", "places", "counts"],
        )


#: places: of a term's documents, or the documents themselves; counts: the term's in each of them.
INDEX = "shard bigint, term binary, n_docs bigint, n_tokens bigint, places binary, counts binary"


def build_index(docs: DataFrame, terms: list[bytes] | None = None) -> DataFrame:
    """Postings of ``doc_id, text`` by shards, of all terms or of some."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        known = None if terms is None else {t: i for i, t in enumerate(terms)}
        number = TaskContext.get().partitionId() << 32
        schema = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("places", pa.binary()), ("counts", pa.binary())])
        shard = Shard(known)
        for part in slices(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                data = text.as_buffer()
                if data is not None:
                    shard.add(doc_id, data.to_pybytes())
                if shard.full:
                    yield shard.rows(number).cast(schema)
                    number, shard = number + 1, Shard(known)
        last = shard.rows(number)
        if last is not None:
            yield last.cast(schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, INDEX)


def weight(n_docs: int, n_with: int) -> int:
    return math.floor(1000 * math.log((2.0 * n_docs + 2.0) / (2.0 * n_with + 1.0)))


def impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_tokens: int) -> np.ndarray:
    """What a term's occurrences count for in texts of these lengths, before its weight."""
    if 75 * int(lengths.max(initial=0)) * n_docs >= 1 << 62:
        lengths, counts = lengths.astype(object), counts.astype(object)
    m = 25 + 75 * lengths * n_docs // n_tokens
    return (1_000_000_000 * counts // (1000 * counts + 8 * m)).astype(np.int64)


List = tuple[int, list[int], list[int], int]


def best(lists: list[List], k: int) -> list[tuple[int, int]]:
    """The ``k`` best (score, place), best first, equal scores by place.

    A list is a weight, ascending places, an impact for each, and the largest impact.
    """
    lists = sorted((x for x in lists if x[0] > 0 and x[1]), key=lambda x: x[0] * x[3])
    n = len(lists)
    reach = [0]  # of the first lists together
    for x in lists:
        reach.append(reach[-1] + x[0] * x[3])
    at = [0] * n
    ahead = [x[1][0] << 32 | i for i, x in enumerate(lists)]
    heapq.heapify(ahead)
    kept: list[tuple[int, int]] = []
    least, aside = 0, 0  # a result has to score more; lists below ``aside`` have left the merge
    while ahead:
        place = ahead[0] >> 32
        score = 0
        while ahead and ahead[0] >> 32 == place:
            i = ahead[0] & 0xFFFFFFFF
            w, places, worth, _ = lists[i]
            score += w * worth[at[i]]
            at[i] += 1
            if at[i] < len(places):
                heapq.heapreplace(ahead, places[at[i]] << 32 | i)
            else:
                heapq.heappop(ahead)
        j = aside
        while j and score + reach[j] > least:
            j -= 1
            w, places, worth, _ = lists[j]
            at[j] = p = bisect_left(places, place, at[j])
            if p < len(places) and places[p] == place:
                score += w * worth[p]
        if score <= least:
            continue
        if len(kept) < k:
            heapq.heappush(kept, (score, -place))
        else:
            heapq.heapreplace(kept, (score, -place))
        if len(kept) == k and kept[0][0] > least:
            least = kept[0][0]
            if aside < n and reach[aside + 1] <= least:
                while aside < n and reach[aside + 1] <= least:
                    aside += 1
                ahead = [x for x in ahead if x & 0xFFFFFFFF >= aside]
                heapq.heapify(ahead)
    return [(s, -p) for s, p in sorted(kept, reverse=True)]


def _of_shard(weighed: list[list[tuple[bytes, int]]], n_docs: int, n_tokens: int, k: int, block: int):
    """A function from a shard's index rows to each item's best documents there."""

    def run(table: pa.Table) -> pa.Table:
        rows = {}
        docs = None
        for term, places, counts in zip(*(table.column(c).to_pylist() for c in ("term", "places", "counts")), strict=True):
            if term is None:
                docs = pa.ipc.open_stream(places).read_all()
            else:
                rows[term] = (places, counts)
        lengths = docs.column("length").to_numpy()
        read: dict[bytes, tuple[list[int], list[int], int]] = {}

        def postings(term: bytes) -> tuple[list[int], list[int], int]:
            if term not in read:
                places = np.cumsum(unpack(rows[term][0]))
                worth = impacts(unpack(rows[term][1]), lengths[places], n_docs, n_tokens)
                read[term] = (places.tolist(), worth.tolist(), int(worth.max()))
            return read[term]

        item, place, score = [], [], []
        for number, terms in enumerate(weighed):
            for s, p in best([(w, *postings(t)) for t, w in terms if t in rows], k):
                item.append(number)
                place.append(p)
                score.append(s)
        ids = docs.column("doc_id").combine_chunks().take(pa.array(place, pa.int64()))
        return pa.table({"block": pa.array([block] * len(item), pa.int32()), "item": pa.array(item, pa.int32()), "doc_id": ids.cast(pa.int64()), "score": pa.array(score, pa.int64())})

    return run


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, Counter]]]:
    """The items' ids and terms, in blocks that hold about ``ITEM_BYTES`` of text each."""
    rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // ITEM_BYTES)
    for k in range(n):
        chosen = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        found = [(r["item_id"], Counter(t for part in term_parts(r["text"].encode()) for t in part)) for r in chosen.collect()]
        yield [x for x in found if x[1]]


def asked_terms(items: DataFrame) -> list[bytes] | None:
    """The terms of the items, if they are one block."""
    blocks = list(zip(item_blocks(items), range(2), strict=False))
    return sorted({t for found, _ in blocks for _, terms in found for t in terms}) if len(blocks) < 2 else None


def search(index: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's ``k`` best documents (``item_id, text``) by a ``build_index`` that is stored, as it's read
    three times and a shard's rows have to stay together."""
    spark = index.sparkSession
    known = index.filter("term IS NULL").agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    item_type = dict(items.dtypes)["item_id"]
    out = None
    for block, found in enumerate(item_blocks(items)):
        if not found or not known[0]:
            continue
        terms = sorted({t for _, counts in found for t in counts})
        # a block has at most ITEM_BYTES of terms; the null is the documents' rows
        asked = F.broadcast(spark.createDataFrame([(None,), *((bytearray(t),) for t in terms)], "asked binary"))
        own = index.join(asked, F.col("term").eqNullSafe(F.col("asked")), "left_semi")
        with_term = {bytes(r["term"]): r["n"] for r in own.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n_docs").alias("n")).collect()}
        weights = {t: weight(known[0], n) for t, n in with_term.items()}
        weighed = [[(t, c * weights[t]) for t, c in counts.items() if t in weights] for _, counts in found]
        results = own.groupBy("shard").applyInArrow(_of_shard(weighed, known[0], known[1], k, block), "block int, item int, doc_id bigint, score bigint")
        ids = spark.createDataFrame([(block, i, item) for i, (item, _) in enumerate(found)], f"block int, item int, item_id {item_type}")
        order = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = results.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ranked = ranked.join(F.broadcast(ids), ["block", "item"]).select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id bigint, score bigint") if out is None else out
