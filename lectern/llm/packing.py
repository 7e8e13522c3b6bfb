"""Packing of tokenized documents by shortest-pack-first over the length histogram.

Documents become pieces of at most ``capacity`` ids.  Only the histogram of piece lengths (at most ``capacity`` rows, whatever
the size of the corpus) reaches the driver, where lengths are placed longest first, each into the shortest pack that has
room; packs of one pattern are counted, never listed.  The patterns go back as intervals of ranks: the r-th piece of a length
takes the r-th place for this length, so documents meet their sequences in one join by length and rank.

Ranks come from a salted numbering (length, salt), so one length that a third of all pieces have is spread over as many
groups of about ``SALT_ROWS`` as it needs; the patterns' intervals are cut at blocks of as many ranks, so that the join has no larger
key either.  Equal pieces may change places with each other, nothing else depends on the order of rows.

Defined results: null text is an empty text, which still has its end id; very long texts are read whole and cut into pieces; a repeated
row is packed again; pieces with equal keys are ordered by all their columns; null ids are kept; an empty table gives no piece;
other columns, whatever their names, are carried, but for ``sequence_id`` and ``offset``, which give way to the operator's.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import hold_cache, quiet_threads, set_aside, slices

CAPACITY = 4096
#: Pieces of one numbered group, about.
SALT_ROWS = 20_000
#: Cached words of one Python worker; a full cache keeps those that came again, results don't depend on it.
CACHE_WORDS = 480_000
#: Marks that may follow a plain word, and plain words that are encoded at once.
MARKS = ".,;:!?"
LINE = 256


class WordIds:
    """Ids of whole texts from a ``tokenizers`` file whose pre-tokenizer never joins text across a blank.

    Blanks (space, tab, newline, return) end a pre-token there, so a text's ids are those of its blank-separated
    words.  Each distinct word is encoded once by the library and kept; all else is array work.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        quiet_threads()
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a pre-token
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.hits = np.zeros(1 << 16, np.int32)  # slices that a word stood in
        self.used = 0

    def _shrink(self) -> None:
        """Keep the words that came again, at most half a cache of them."""
        n = len(self.slot)
        keep = np.flatnonzero(self.hits[:n] > 1)
        if len(keep) > CACHE_WORDS // 2:
            keep = np.sort(np.argsort(self.hits[:n], kind="stable")[-(CACHE_WORDS // 2) :])
        words, sizes, ends = list(self.slot), self.length[keep], np.cumsum(self.length[keep])
        ids = self.flat[np.repeat(self.start[keep] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        self._clear()
        self._store([words[i] for i in keep.tolist()], ids, sizes)

    @staticmethod
    def _pre_tokens(word: str) -> int:
        """1 for letters, 2 for letters and one ASCII mark after them, 0 for what only the library knows."""
        core = word[:-1] if word[-1:] in MARKS else word
        plain = core.isascii() or (unicodedata.is_normalized("NFC", word) and core.lower().isalpha())
        return (1 + (core is not word)) * (core.isalpha() and plain)

    def _learn(self, words: list[str]) -> None:
        """Encode new words: plain ones in long lines, whose ids are told apart by the pre-tokens' ends."""
        pre = [self._pre_tokens(w) for w in words]
        plain = [(w, n) for w, n in zip(words, pre, strict=True) if n]
        lines = [plain[at : at + LINE] for at in range(0, len(plain), LINE)]
        encoded = self.library.encode_batch_fast([" ".join(w for w, _ in x) for x in lines], add_special_tokens=False)
        odd = [w for w, n in zip(words, pre, strict=True) if not n]
        for line, e in zip(lines, encoded, strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            after = np.cumsum([n for _, n in line])
            if len(ends) == after[-1] and ends[-1] == len(ids):
                self._store([w for w, _ in line], ids, np.diff(ends[after - 1], prepend=0))
            else:
                odd += [w for w, _ in line]
        if odd:
            ids = [e.ids for e in self.library.encode_batch_fast(odd, add_special_tokens=False)]
            self._store(odd, np.array([x for e in ids for x in e], np.uint32), np.array([len(e) for e in ids]))

    def _store(self, words: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        at = len(self.slot)
        while at + len(words) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
            self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[at : at + len(words)] = self.used + np.cumsum(n) - n
        self.length[at : at + len(words)] = n
        self.used += len(ids)
        self.slot.update(zip(words, range(at, at + len(words)), strict=True))

    def _slots(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each word, and the number of words of each text."""
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        for blank in "\n\t\r":
            texts = pc.replace_substring(texts, blank, " ")
        # fewer distinct words, the same ids: the library lowers case after composing marks, and a mark after letters
        # is a pre-token of its own
        lower = pc.ascii_lower(texts)
        marked = pc.match_substring_regex(texts, "[\u0300-\u036f]")
        texts = pc.if_else(marked, texts, lower) if pc.any(marked).as_py() else lower
        texts = pc.replace_substring_regex(texts, "([a-z])([.,]) ", "\\1 \\2 ")
        words = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = pc.list_flatten(words).dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.slot) + len(names) > CACHE_WORDS:
            self._shrink()
        if new := [w for w in names if w not in self.slot]:
            self._learn(new)
        known = np.fromiter((self.slot[w] for w in names), np.int64, len(names))
        self.hits[known] += 1
        return known[coded.indices.to_numpy(zero_copy_only=False)], counts

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        slots, words = self._slots(texts)
        sums = np.concatenate([[0], np.cumsum(self.length[slots])])
        ends = np.cumsum(words)
        return sums[ends] - sums[ends - words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of each text."""
        slots, words = self._slots(texts)
        n = self.length[slots]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(self.start[slots] - (ends - n), n) + np.arange(total)
        sums = np.concatenate([[0], ends])
        by_text = np.cumsum(words)
        return self.flat[place], sums[by_text] - sums[by_text - words]


_KNOWN: dict[str, WordIds] = {}


def word_ids(path: str, *beside: str) -> WordIds:
    """This Python worker's encoder for a file; later tasks of the worker go on with its words."""
    if path not in _KNOWN:
        _KNOWN[path] = WordIds(path)
    hold_cache("words", _KNOWN.clear, *beside)
    return _KNOWN[path]


PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint"


def token_pieces(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, start, length, ids`` (little-endian unsigned 32-bit) ``, doc_tokens``: a row for each piece.

    A document's ids, ``end_id`` last, are cut after every ``capacity`` ids.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for part in slices(batches):
            ids, counts = words.encode(part.column("text"))
            raw = ids.astype("<u4").tobytes()
            end = np.array([end_id], "<u4").tobytes()
            rows: list[tuple] = []
            at = 0
            for doc, n in zip(part.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                own = raw[4 * at : 4 * (at + n)] + end
                at += n
                rows += [
                    (doc, s, min(capacity, n + 1 - s), own[4 * s : 4 * (s + capacity)], n + 1)
                    for s in range(0, n + 1, capacity)
                ]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def histogram_packing(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, longest first) and how many packs have each.

    Lengths are taken longest first.  The packs with most room are filled first; as all packs of a pattern look alike,
    a length with n pieces changes the counts of patterns, not single packs.
    """
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    done: list[tuple[tuple[int, ...], int]] = []
    widest = 0  # no pack has more room
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while widest and not room.get(widest):
                widest -= 1
            if widest >= length:
                pattern, count = room[widest].pop()
                free, times, use = widest, 1, min(left, count)
                if count > use:
                    room[free].append((pattern, count - use))
            else:  # nothing has room: a new pack has most, so it takes this length until it is full
                pattern, free = (), capacity
                times = min(capacity // length, left)
                use = left // times
            left -= use * times
            free -= length * times
            if free:
                room.setdefault(free, []).append((pattern + (length,) * times, use))
                widest = max(widest, free)
            else:
                done.append((pattern + (length,) * times, use))
    return done + [x for size in sorted(room) for x in room[size]]


def rank_intervals(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, places in each sequence, first offset) of each use."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in dict.fromkeys(pattern):
            times = pattern.count(length)
            first = taken.get(length, 0)
            taken[length] = first + count * times
            rows.append((length, first, taken[length], sequence, times, offset))
            offset += length * times
        sequence += count
    return rows


#: Rows of rank_intervals, cut at blocks, that are broadcast; a longer list is joined by shuffling.
BROADCAST_INTERVALS = 200_000


def pack(pieces: DataFrame, capacity: int = CAPACITY, salt_rows: int = SALT_ROWS, key: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.  ``pieces`` is read three times: cut its lineage before.

    Its columns may be any, with a ``length`` from 1 to ``capacity``; ``key`` orders pieces of equal length.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    own, names = set_aside(pieces)
    length, order = names["length"], [names[k] for k in key]
    found = own.groupBy(length).count().collect()  # at most `capacity` rows
    histogram = {r[0]: r[1] for r in found}
    rows = rank_intervals(histogram_packing(histogram, capacity))
    places = spark.createDataFrame(
        rows or [],
        "place_length bigint, first bigint, after bigint, sequence bigint, times bigint, place bigint",
    )
    blocks = F.sequence(F.floor(F.col("first") / salt_rows), F.floor((F.col("after") - 1) / salt_rows))
    places = places.select("*", F.explode(blocks).alias("place_block"))
    if sum(after // salt_rows - first // salt_rows + 1 for _, first, after, *_ in rows) <= BROADCAST_INTERVALS:
        places = F.broadcast(places)
    salts = max(1, -(-max(histogram.values(), default=0) // salt_rows))
    salted = own.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sizes = salted.groupBy(length, "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy(length).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(length).alias("start_length"),
        F.col("salt").alias("start_salt"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
    )
    group = Window.partitionBy(length, "salt").orderBy(*order, F.xxhash64(*names.values()))
    numbered = salted.withColumn("row", F.row_number().over(group) - 1)
    ranked = numbered.join(starts, (F.col(length) == F.col("start_length")) & (F.col("salt") == F.col("start_salt")))
    ranked = ranked.withColumn("rank", F.col("row") + F.col("before"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / salt_rows))
    k = F.col("rank") - F.col("first")
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after"))
    same = (F.col(length) == F.col("place_length")) & (F.col("block") == F.col("place_block"))
    return ranked.join(places, same & inside).select(
        *(F.col(c).alias(name) for name, c in names.items()),
        (F.col("sequence") + F.floor(k / F.col("times")).cast("bigint")).alias("sequence_id"),
        (F.col("place") + (k % F.col("times")) * F.col(length)).alias("offset"),
    )
