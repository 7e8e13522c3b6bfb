"""SimHash near-dedup at a similarity of word shingles: banded fingerprints that meet in the middle between Hamming balls.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is ``4/5`` or more; groups are connected
over such pairs.  At that similarity the bits of two SimHash fingerprints differ with a chance of 0.15 each, about ten of 64, far beyond any
ball that can be emitted.  So a text has ``BANDS`` shorter fingerprints.  A band's 64 bits are ``BITS`` SimHash bits of its own, the
majority over the shingles, beside a hash of ``MINIMA`` least shingle hashes, which is never varied: it keeps unlike texts apart
however many there are, where a few bits could not.  Every fingerprint emits all variants within one bit, half the radius of two;
variants are shuffled, those that only one fingerprint emitted go, and pairs that collide are verified on their shingle sets.

A band makes a pair at similarity s a candidate with the chance ``s**5`` that the minima agree times that of at most two differing
bits among 8; ``chance`` computes it: over all bands 0.9960 at 0.8, 0.9998 at 0.85.  Candidates whose sketches - the last bits of ``SKETCH`` least
hashes - differ in more than ``FAR`` bits aren't compared; at 0.8 that leaves out one pair of 100,000, which is in these figures.

Texts of equal words are one node.  What two sets share, no third need have: shingles that only one of all colliding nodes has bound from above what it can
share with any, and nodes and pairs that can't reach the similarity any more are left out by that.  Among the nodes that share a variant, each is
compared with its neighbour and with the one whose shingles are most common, over more and more variants (``SHARES``), which connects a large
group of near copies by a few comparisons for each member; after that all pairs that different components have
in a common group, that weren't compared and that can reach the similarity are.  So every candidate pair is compared, out of reach, or
already connected.

Defined results: words are as in ``simhash.shingle_hashes``; null, empty and blank texts are copies of each other; a text of under five words
is one shingle; very long texts are read whole; repeated rows count as documents of their own but only one of a group is kept; of a
group's documents with equal least doc_id, the one with the least text hash stays; a null doc_id is the largest in its group;
an empty table gives no row; all other columns are carried, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import release_caches, slices
from lectern.llm.simhash import SEED, column_sums, keep_documents, shingle_hashes, signed
from lectern.operators.graph import components
from lectern.storage import Cuts

WORDS = 5
BANDS, MINIMA, BITS = 16, 5, 8
#: Bits of the sketch, a multiple of 64, and how many of them may differ.
SKETCH, FAR = 256, 48
#: Texts to be compared whose ids are broadcast, 16 bytes each, so that the documents needn't be shuffled; more are joined by shuffling.
BROADCAST_NODES = 1_000_000
#: Steps before all pairs that are left: each looks at one of so many variants.
SHARES = (16, 1)
_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 32, SKETCH, dtype=np.uint32)
_ODD = _RNG.integers(0, 1 << 32, SKETCH, dtype=np.uint32) | np.uint32(1)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, MINIMA), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
#: SimHash bits come from so many further hashes of a shingle, 64 from each.
_FURTHER = -(-BANDS * BITS // 64)
_STEP = _RNG.integers(0, 1 << 63, _FURTHER, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
#: Shingles hashed at once.
_BLOCK = 1024


def chance(similarity: float) -> float:
    """The chance that a pair of this similarity is a candidate; sets of equal size are assumed."""
    differs = math.acos(2 * similarity / (1 + similarity)) / math.pi
    near = sum(math.comb(BITS, k) * differs**k * (1 - differs) ** (BITS - k) for k in range(3))
    odd = (1 - similarity) / 2
    close = sum(math.comb(SKETCH, k) * odd**k * (1 - odd) ** (SKETCH - k) for k in range(FAR + 1))
    return (1 - (1 - similarity**MINIMA * near) ** BANDS) * close


def band_prints(hashes: np.ndarray) -> np.ndarray:
    """The band fingerprints of a set of distinct shingle hashes (uint64), then its sketch; no shingle gives fingerprints of its own."""
    low = (hashes ^ hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(SKETCH, (1 << 32) - 1, np.uint32)
    counts = np.zeros(64 * _FURTHER, np.int64)
    for at in range(0, len(low), _BLOCK):
        x = low[at : at + _BLOCK, None] ^ _XOR
        x *= _ODD
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(least, x.min(axis=0), out=least)
        h = hashes[at : at + _BLOCK, None] * _STEP
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        bits = np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64) if len(bits) < 256 else column_sums(bits)
    mixed = (least[: BANDS * MINIMA].reshape(BANDS, MINIMA).astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    exact = (mixed * _MIX[:, ::-1]).sum(axis=1, dtype=np.uint64)
    exact ^= exact >> np.uint64(31)
    majority = (counts[: BANDS * BITS] * 2 > len(hashes)).reshape(BANDS, BITS)
    prints = exact << np.uint64(BITS) | (majority @ (1 << np.arange(BITS))).astype(np.uint64)
    return np.concatenate([prints, np.packbits(least & np.uint32(1)).view(np.uint64)])


def _prints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, node, bands``; the node is a hash of the text's words; the sketch follows the bands."""
    import xxhash

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for part in slices(batches):
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            nodes = [xxhash.xxh64_intdigest(b" ".join(t.lower().split()), SEED) for t in texts]
            bands = np.zeros((len(texts), BANDS + SKETCH // 64), np.uint64)
            for i, t in enumerate(texts):
                bands[i] = band_prints(np.unique(np.array(shingle_hashes(t, WORDS), np.uint64)))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), bands.shape[1])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("text_hash"),
                    pa.array(np.array(nodes, np.uint64).view(np.int64)),
                    lists.cast(pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "node", "bands"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, node bigint, bands array<bigint>")


def ball(print_: Column) -> Column:
    """A band fingerprint's variants within one bit, each with the change that makes it."""
    flips = F.array(*(F.lit(signed(x)).cast("bigint") for x in [0, *(1 << i for i in range(BITS))]))
    return F.transform(flips, lambda x: F.struct(print_.bitwiseXOR(x).alias("variant"), x.alias("flip")))


def _colliding(distinct: DataFrame) -> DataFrame:
    """``variant, node``: the nodes of each variant that several emitted.

    Where all of them have one fingerprint they meet at all its variants; only the fingerprint itself stays then.
    """
    emitted = distinct.select("node", F.explode(F.slice("first.bands", 1, BANDS)).alias("print")).select("node", F.inline(ball(F.col("print"))))
    group, print_ = Window.partitionBy("variant"), F.col("variant").bitwiseXOR(F.col("flip"))
    met = emitted.select(
        "variant",
        "node",
        "flip",
        F.min("node").over(group).alias("lo"),
        F.max("node").over(group).alias("hi"),
        F.min(print_).over(group).alias("lo_print"),
        F.max(print_).over(group).alias("hi_print"),
    )
    return met.filter("lo < hi AND (flip = 0 OR lo_print < hi_print)").select("variant", "node")


def _sets(texts: DataFrame) -> DataFrame:
    """``node, own, short``: the distinct shingle hashes of ``node, text``, and the distinct last 16 bits of these."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for part in slices(batches):
            own = [
                np.unique(np.array(shingle_hashes((t or "").encode(), WORDS), np.uint64)).view(np.int64)
                for t in part.column("text").to_pylist()
            ]
            short = [np.unique(x.astype(np.int16)) for x in own]
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), pa.array(own, pa.list_(pa.int64())), pa.array(short, pa.list_(pa.int16()))],
                names=["node", "own", "short"],
            )

    return texts.mapInArrow(run, "node bigint, own array<bigint>, short array<smallint>")


def _reach(sets: DataFrame) -> DataFrame:
    """``node, n, r``: the size of a node's set, and how many of its shingles other nodes have too.

    Nodes that can't share four fifths of their shingles with any other are left out.
    """
    each = sets.select("node", F.explode("own").alias("shingle"))
    alone = each.groupBy("shingle").agg(F.count("*").alias("nodes"), F.min("node").alias("node")).filter("nodes = 1")
    less = alone.groupBy("node").agg(F.count("*").alias("alone"))
    found = sets.select("node", F.size("own").alias("n")).join(less, "node", "left")
    return found.select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("r")).filter("5 * r >= 4 * n")


def _within(r: Column, other_r: Column, n: Column, other_n: Column) -> Column:
    """Whether two sets can have a similarity of 4/5, by what they share with any other."""
    return 9 * F.least(r, other_r) >= 4 * (n + other_n)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets have a similarity of 4/5 or more.

    Most pairs that aren't similar are told by the short hashes: what two sets share is at most as many values as their short
    hashes share, and the values that one of them has lost by shortening.
    """
    size = F.size("own").alias("n")
    one, two = (sets.select(F.col("node").alias(k), F.struct("short", size).alias(f"s{k}")) for k in "ab")
    most = F.size(F.array_intersect("sa.short", "sb.short")) + F.col("sa.n") - F.size("sa.short")
    able = pairs.join(one, "a").join(two, "b").filter(9 * most >= 4 * (F.col("sa.n") + F.col("sb.n"))).select("a", "b")
    one, two = (sets.select(F.col("node").alias(k), F.col("own").alias(f"own_{k}")) for k in "ab")
    both = F.size(F.array_intersect("own_a", "own_b"))
    return (
        able.join(one, "a").join(two, "b").filter(9 * both >= 4 * (F.size("own_a") + F.size("own_b"))).select("a", "b")
    )


def _neighbours(members: DataFrame, order: int) -> DataFrame:
    """``a, b``: each member of a variant's group with the next one and with the most common one, if they aren't connected yet."""
    group = Window.partitionBy("variant")
    own = F.struct("node", "root", "n", "r")
    top = F.max(F.struct(F.col("r") / F.greatest("n", F.lit(1)), "n", "node", "root", "r")).over(group)
    after = members.select(
        "node", "root", "n", "r", F.lead(own).over(group.orderBy(F.xxhash64("node", F.lit(order)), "node")).alias("next"), top.alias("top")
    )
    tops = F.struct("top.node", "top.root", "top.n", "top.r")
    able = lambda o: (F.col("root") != o["root"]) & _within(F.col("r"), o["r"], F.col("n"), o["n"])
    return _pairs(after.select("node", F.explode(F.filter(F.array("next", tops), able)["node"]).alias("other")))


def _close(bands: Column, other: Column) -> Column:
    """Whether sketches differ in few bits."""
    differ = (F.bit_count(F.get(bands, F.lit(k)).bitwiseXOR(F.get(other, F.lit(k)))) for k in range(BANDS, BANDS + SKETCH // 64))
    return sum(differ, F.lit(0)) <= FAR


def _first_meeting(bands: Column, other: Column) -> Column:
    """The first variant at which two nodes meet: of the first band in which at most two bits differ."""

    def meeting(x: Column, y: Column) -> Column:
        differ = x.bitwiseXOR(y)
        low = differ.bitwiseAND(-differ)
        met = (F.shiftrightunsigned(differ, BITS) == 0) & (F.bit_count(differ) <= 2)
        return F.when(met, F.least(x.bitwiseXOR(low), y.bitwiseXOR(low)))

    own = lambda c: F.slice(c, 1, BANDS)
    return F.get(F.array_compact(F.zip_with(own(bands), own(other), meeting)), F.lit(0))


def _crossing(members: DataFrame) -> DataFrame:
    """``a, b``: all pairs of a variant's group that are not connected yet; the largest component is on one side only.

    A pair that meets at several variants is taken at the first of them.
    """
    counted = members.withColumn("count", F.count("*").over(Window.partitionBy("variant", "root")))
    top = F.max(F.struct("count", "root")).over(Window.partitionBy("variant"))
    left = counted.withColumn("top", top["root"]).filter("root <> top").drop("top", "count")
    right = members.select(*(F.col(c).alias("other" if c == "node" else f"other_{c}") for c in members.columns))
    able = (F.col("root") != F.col("other_root")) & _within(*(F.col(c) for c in ("r", "other_r", "n", "other_n")))
    able = able & _close(F.col("bands"), F.col("other_bands")) & (F.col("variant") == _first_meeting(F.col("bands"), F.col("other_bands")))
    return _pairs(left.join(right, (left["variant"] == right["other_variant"]) & able))


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _open(shared: DataFrame, roots: DataFrame | None, share: int) -> DataFrame:
    """The members, with their ``root``, of the groups that are in several components, of one of ``share`` variants."""
    some = shared if share == 1 else shared.filter(F.pmod(F.xxhash64("variant"), F.lit(share)) == 0)
    if roots is None:
        return some.withColumn("root", F.col("node"))
    members = some.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    group = Window.partitionBy("variant")
    ends = members.select("*", F.min("root").over(group).alias("lo"), F.max("root").over(group).alias("hi"))
    return ends.filter("lo < hi").drop("lo", "hi")


def classes(docs: DataFrame, prints: DataFrame, cut: Cuts) -> DataFrame:
    """``component_id, text_hash``: the first document of each group.  ``prints`` has the columns of ``_prints``."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "bands")
    distinct = cut(prints.groupBy("node").agg(F.min(order).alias("first")))
    shared = cut(_colliding(distinct))
    nodes = shared.select("node").distinct().join(distinct, "node")
    chosen = cut(nodes.select("node", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash")))
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_NODES else chosen
    texts = docs.select("doc_id", "text").withColumn("_text_hash", F.xxhash64("text")).join(
        chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    )
    # rows that are repeated are the same text; equal sets of a node are one row
    sets = cut(_sets(texts.select("node", "text")).dropDuplicates(["node"]))
    reach = _reach(sets).join(distinct.select("node", "first.bands"), "node")
    shared = cut(shared.join(reach, "node"))
    links = compared = roots = None
    for step, share in enumerate([*SHARES, 1]):
        members = _open(shared, roots, share)
        pairs = _neighbours(members, step) if step < len(SHARES) else _crossing(members)
        pairs = cut(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"))
        if compared is not None and pairs.isEmpty():
            continue
        found = cut(similar(pairs, sets))
        compared = pairs if compared is None else compared.unionByName(pairs)
        if links is not None and found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        roots = cut(components(links))
    tied = distinct.join(roots, "node")
    least = tied.groupBy("root").agg(F.min("first").alias("first")).select("first")
    every = least.unionByName(distinct.join(roots, "node", "left_anti").select("first"))
    return every.select(F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("text_hash"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """The documents, one of each group of near copies: that with the smallest doc_id; all its columns."""
    cuts = Cuts()
    prints = cuts(_prints(docs))
    return keep_documents(docs, prints, classes(docs, prints, cuts), cuts)
