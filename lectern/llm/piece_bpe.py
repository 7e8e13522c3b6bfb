"""SentencePiece encoding and decoding with a score-ordered agenda.

A merge-type vocabulary joins, again and again, the adjacent pair of symbols whose joined piece scores best (the leftmost
of equal ones).  As its pieces hold blanks only at their start, a text's segments - a run of blanks with what follows, or
a newline - merge independently, and each distinct segment is encoded once.  Short segments go through the agenda together:
each round finds every segment's best pair by a minimum over ranks, joins it, and looks up only the two new
pairs.  Long segments have an agenda of their own, a heap.  Symbols without a piece become their UTF-8 bytes' pieces.

In each Arrow slice every ``check``-th text (by default each) is encoded by the sentencepiece library too, and every text is
decoded by it; a difference stops the job.

Defined results: null is an empty text, with the end id only; very long texts are encoded whole; repeated rows are encoded each;
a null doc_id is kept; an empty table gives no row; other columns, whatever their names, are ignored;
strings of control pieces (``</s>``) inside a text are ordinary characters, as in the library.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import hold_cache, slices

BLANK = "▁"
#: Longest segment of the common agenda; cached segments of a worker.
SHORT = 40
CACHE_SEGMENTS = 600_000
#: Texts with runs of blanks, where a segment starts with several, or with blank signs or the mark that cuts other texts.
ODD = "^ |  |▁|\\x01"
_NORMAL, _CONTROL, _BYTE = 1, 3, 6
_NONE = 1 << 30
#: Symbols of characters that no piece holds: this plus the code point.
_OUTSIDE = 1 << 18


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            n = {1: 8, 5: 4}.get(kind)
            if n is None:
                n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class PieceEncoder:
    """Encoder for a model file of the merge type with byte fallback and the identity normalizer."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = f.read()
        pieces: list[tuple[str, float, int]] = []
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                score = struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0]
                pieces.append((own[1].decode(), score, own.get(3, _NORMAL)))
        self.n_pieces = len(pieces)
        self.end_id = self.library.eos_id()
        self.byte_ids = np.zeros(256, np.int64)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == _BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        normal = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == _NORMAL}
        if any(BLANK in p.lstrip(BLANK) or "\n" in p and len(p) > 1 for p in normal):
            raise ValueError("a piece holds a blank or newline inside: segments wouldn't be independent")
        symbols = dict(normal)  # and single characters that only longer pieces hold
        for p in normal:
            for c in p:
                symbols.setdefault(c, len(pieces) + len(symbols))
        self.char = np.arange(0x110000, dtype=np.int64) + _OUTSIDE
        self.chars = {}
        for s, i in symbols.items():
            if len(s) == 1:
                self.char[ord(s)] = i
                self.chars[i] = s
        scores = sorted({-pieces[i][1] for p, i in normal.items() if len(p) > 1})
        rank_of = {s: r for r, s in enumerate(scores)}
        pairs: dict[int, tuple[int, int]] = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 21 | b] = (rank_of[-pieces[i][1]], i)
        self.pairs = pairs
        bits = (8 * len(pairs)).bit_length()
        self.shift = np.uint64(64 - bits)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        values = np.array(list(pairs.values()), np.int64).reshape(-1, 2)
        self.keys = np.full((1 << bits) + 64, -1, np.int64)
        self.rank = np.full(len(self.keys), _NONE, np.int64)
        self.joined = np.zeros(len(self.keys), np.int64)
        self.probes = 1
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):  # open addressing: the first to a free slot has it, the others go on to the next
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            won = np.zeros(len(left), bool)
            won[first] = True
            won &= free
            self.keys[at[won]] = keys[left[won]]
            self.rank[at[won]], self.joined[at[won]] = values[left[won]].T
            left, at = left[~won], at[~won] + 1
            self.probes += bool(len(left))
        self._clear()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NONE: none) and joined symbol of pairs."""
        keys = a << 21 | b
        at = self._slot(keys)
        rank, joined = np.full(len(keys), _NONE, np.int64), np.zeros(len(keys), np.int64)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            held = self.keys[at]
            hit = held == keys[open_]
            rank[open_[hit]], joined[open_[hit]] = self.rank[at[hit]], self.joined[at[hit]]
            on = ~hit & (held != -1)
            open_, at = open_[on], at[on] + 1
            if not len(open_):
                break
        return rank, joined

    def _agenda(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all segments in a row, and how many each has."""
        sym = self.char[np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4")]
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        who = np.arange(len(segments))
        rank, joined = np.full(len(sym), _NONE, np.int64), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], joined[:-1] = self._look(sym[:-1], sym[1:])
        rank[np.cumsum(size) - 1] = _NONE
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(size):
            start = np.cumsum(size) - size
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), start)
            live = best >> 32 < _NONE
            if not live.all():
                keep = np.repeat(live, size)
                out.append((who[~live], size[~live], sym[~keep]))
                shift = np.cumsum(~keep)  # symbols gone before each
                at = (best[live] & 0xFFFFFFFF).astype(np.int64)
                at -= shift[at]
                sym, rank, joined, who, size = sym[keep], rank[keep], joined[keep], who[live], size[live]
                start = np.cumsum(size) - size
            else:
                at = (best & 0xFFFFFFFF).astype(np.int64)
            if not len(size):
                break
            sym[at] = joined[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, rank, joined = sym[keep], rank[keep], joined[keep]
            at -= np.arange(len(at))
            size = size - 1
            end = np.cumsum(size)
            rank[at] = _NONE
            right = at[at + 1 < end]
            left = at[at > end - size] - 1
            fresh = np.concatenate([right, left])
            rank[fresh], joined[fresh] = self._look(sym[fresh], sym[fresh + 1])
        if not out:
            return sym, size
        who, size, sym = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(who, kind="stable")
        start = (np.cumsum(size) - size)[order]
        size = size[order]
        end = np.cumsum(size)
        return sym[np.repeat(start - (end - size), size) + np.arange(len(sym))], size

    def _heap(self, segment: str) -> list[int]:
        """The agenda of one long segment."""
        sym = [int(self.char[ord(c)]) for c in segment]
        n = len(sym)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (found := self.pairs.get(sym[i] << 21 | sym[j])):
                heapq.heappush(heap, (found[0], i, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, a, b, joined = heapq.heappop(heap)
            j = after[i]
            if j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], sym[j] = joined, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -2
            push(before[i], i)
            push(i, after[i])
        return [s for s in sym if s >= 0]

    def _ids(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols to ids: those that are no pieces become bytes."""
        odd = np.flatnonzero(symbols >= self.n_pieces)
        if not len(odd):
            return symbols, sizes
        text = lambda s: self.chars.get(s) or chr(s - _OUTSIDE)
        spelled = [self.byte_ids[list(text(int(s)).encode())] for s in symbols[odd]]
        parts, at = [], 0
        for k, ids in zip(odd.tolist(), spelled, strict=True):
            parts += [symbols[at:k], ids]
            at = k + 1
        segment = np.repeat(np.arange(len(sizes)), sizes)[odd]
        more = np.bincount(segment, [len(x) - 1 for x in spelled], len(sizes)).astype(np.int64)
        return np.concatenate([*parts, symbols[at:]]), sizes + more

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _learn(self, segments: list[str]) -> None:
        short = [s for s in segments if len(s) <= SHORT]
        ids, sizes = self._ids(*self._agenda(short)) if short else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self._store(short, ids, sizes)
        for s in segments:
            if len(s) > SHORT:
                symbols = np.array(self._heap(s), np.int64)
                self._store([s], *self._ids(symbols, np.array([len(symbols)])))

    def _store(self, segments: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        at = len(self.slot)
        while at + len(segments) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[at : at + len(segments)] = self.used + np.cumsum(sizes) - sizes
        self.length[at : at + len(segments)] = sizes
        self.used += len(ids)
        self.slot.update(zip(segments, range(at, at + len(segments)), strict=True))

    def _segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Segments of all texts, and how many each text has."""
        import pyarrow.compute as pc

        plain = pc.invert(pc.match_substring_regex(texts, ODD))
        if not pc.all(plain).as_py() or not len(texts):
            cut = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n").findall
            lists = [cut((BLANK + t).replace(" ", BLANK)) if t else [] for t in texts.to_pylist()]
            return pa.array([s for x in lists for s in x], pa.string()), np.array([len(x) for x in lists], np.int64)
        marked = pc.replace_substring(texts, " ", "\x01" + BLANK)
        marked = pc.replace_substring(marked, "\n", "\x01\n\x01")
        lists = pc.split_pattern(marked, "\x01")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(lists)
        # the first segment of a text gets the blank that the library puts before it
        first = np.zeros(len(flat), bool)
        first[np.cumsum(counts) - counts] = True
        heads = pc.binary_join_element_wise(BLANK, pc.filter(flat, pa.array(first)), "")
        heads = pc.if_else(pc.equal(texts, ""), "", heads)
        return pc.replace_with_mask(flat, pa.array(first), heads), counts

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, without an end id."""
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD)
        if pc.any(odd).as_py() and not pc.all(odd).as_py():  # such texts are cut by another way
            at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            rest = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
            out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
            for rows in (at, rest):
                for i, ids in zip(rows.tolist(), self.encode(texts.take(pa.array(rows))), strict=True):
                    out[i] = ids
            return out
        flat, counts = self._segments(texts)
        coded = flat.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.slot) + len(names) > CACHE_SEGMENTS:
            self._clear()
        if new := [s for s in names if s not in self.slot]:
            if "" in new:
                new.remove("")
                self._store([""], np.zeros(0, np.int32), np.zeros(1, np.int64))
            if new:
                self._learn(new)
        known = np.fromiter(map(self.slot.__getitem__, names), np.int64, len(names))
        slots = known[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.int64)
        n = self.length[slots]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.start[slots] - (ends - n), n) + np.arange(int(n.sum()))]
        sums = np.concatenate([[0], ends])
        return np.split(ids, sums[np.cumsum(counts)][:-1]) if len(counts) else []

    def checked(self, texts: pa.Array, check: int = 1) -> tuple[list[list[int]], list[str]]:
        """Ids with the end id, and the library's decoding of them; every ``check``-th text is held against its ids."""
        found = [[*x.tolist(), self.end_id] for x in self.encode(texts)]
        for i in range(0, len(found), check):
            if self.library.encode(texts[i].as_py() or "", num_threads=1) != found[i][:-1]:
                raise ValueError("the agenda's ids differ from the library's")
        return found, self.library.decode(found, num_threads=1)


_KNOWN: dict[str, PieceEncoder] = {}


def encoder(path: str, *beside: str) -> PieceEncoder:
    """This Python worker's encoder for a file."""
    if path not in _KNOWN:
        _KNOWN[path] = PieceEncoder(path)
    hold_cache("pieces", _KNOWN.clear, *beside)
    return _KNOWN[path]


Derive = Callable[[list[list[int]], list[str]], list[pa.Array]]


def encode_documents(
    docs: DataFrame,
    path: str,
    derive: Derive | None = None,
    columns: str = "ids array<int>, decoded string",
    check: int = 1,
) -> DataFrame:
    """``doc_id`` and the ids (end id last) and decoded text of each row, or what ``derive`` makes of them."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for part in slices(batches):
            ids, decoded = own.checked(part.column("text"), check)
            made = derive(ids, decoded) if derive else [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, {columns}")
