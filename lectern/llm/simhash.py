"""SimHash near-duplicates by meeting in the middle between Hamming balls.

A document's 64-bit fingerprint is the majority of the bits of its word shingles' XXH64.  Fingerprints link at ``RADIUS`` = 3
or fewer differing bits.  Two of them at distance 2 meet in a point one bit from either; three bits have no middle, so
each fingerprint is taken four times, each time with another block of 16 bits set aside, and emits all variants within one bit
of the other 48 (4 x 49 variants instead of the 2,081 within two bits of all 64).  Of any three differing bits,
one stands alone in its block, and two are left for the balls, or all three share a block, and the other bits agree.
Variants are shuffled and sorted; only within the few that collide are fingerprints compared and verified, and each
group of colliding fingerprints gives a spanning tree of verified links, never all its pairs.

Copies share a fingerprint, so all this runs on distinct fingerprints; the members of one variant are at most
49 x 65,536 by construction, however many documents there are.

The argument holds for radii up to 3; larger ones are refused.

Defined results: null or blank text has fingerprint zero and links like any other; very long texts are read whole; repeated rows count as
documents of their own but only one of a group is kept; of a group's documents with equal least doc_id, the one with
the least text hash stays; a null doc_id is the largest in its group; an empty table gives no row; other columns,
whatever their names, are carried by ``near_dedup`` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import release_caches, slices
from lectern.operators.graph import components
from lectern.storage import Cuts, cut

RADIUS = 3
BLOCKS, WIDTH = 4, 16
SEED = 42
#: Shingles whose bits are counted at once.
COUNTED = 1 << 17
FULL = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """Unsigned XXH64 of each shingle, repeats included."""
    import xxhash

    w = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not w:
        return []
    if len(w) < words:
        return [xxhash.xxh64_intdigest(b" ".join(w), SEED)]
    parts = zip(*(w[k:] for k in range(words)), strict=False)
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(SEED)))


def fingerprints_of(texts: list[str | None], words: int = 3) -> np.ndarray:
    """Unsigned fingerprints; a bit is set if it is in over half of the hashes."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        hashes = np.array(shingle_hashes((text or "").encode(), words), "<u8")
        if not len(hashes):
            continue
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), COUNTED):
            bits = np.unpackbits(hashes[at : at + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64) if len(bits) < 256 else column_sums(bits)
        out[i] = np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out


def column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of 0/1 columns; eight columns are added at a time as the bytes of one 64-bit number."""
    wide = np.ascontiguousarray(bits).view("<u8")
    total = np.zeros(bits.shape[1], np.int64)
    whole = len(wide) // 255 * 255
    if whole:
        total += wide[:whole].reshape(-1, 255, wide.shape[1]).sum(axis=1).view(np.uint8).sum(axis=0, dtype=np.int64)
    return total + bits[whole:].sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, text_hash, fingerprint`` (both hashes as signed 64-bit)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for part in slices(batches):
            values = fingerprints_of(part.column("text").to_pylist(), words).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(values)],
                names=["doc_id", "text_hash", "fingerprint"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, fingerprint bigint")


def ball_variants(fingerprint: Column) -> Column:
    """Array of the variants within one bit, once with each block set aside (its place holds the block's number)."""
    arrays = []
    for block in range(BLOCKS):
        shift = WIDTH * block
        aside = ((1 << WIDTH) - 1) << shift
        tag = (block + 1) << shift
        flips = [tag] + [tag ^ (1 << i) for i in range(64) if not aside >> i & 1]
        kept = fingerprint.bitwiseAND(F.lit(signed(FULL ^ aside)))
        changes = F.array(*(F.lit(signed(x)).cast("bigint") for x in flips))
        arrays.append(F.transform(changes, kept.bitwiseXOR))
    return F.concat(*arrays)


def _find(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def linked_pairs(variant: int, members: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Verified pairs (unsigned) among the fingerprints that emitted a variant.

    Few members are compared with each other.  Many are looked up by the 16 bits set aside: members that agree there, or
    differ in one bit, are within the radius because either is within one bit of the variant elsewhere; those that
    agree with the variant everywhere else may differ there in as many bits as the radius has.
    """
    if len(members) <= 48:
        return [
            (x, y) for i, x in enumerate(members) for y in members[i + 1 :] if (x ^ y).bit_count() <= radius
        ]
    for block in range(BLOCKS):
        shift = WIDTH * block
        aside = ((1 << WIDTH) - 1) << shift
        off = [((x ^ variant) & (FULL ^ aside)).bit_count() for x in members]
        if variant >> shift & 0xFFFF == block + 1 and max(off) <= 1:
            break
    else:  # variants of two blocks that happen to be equal numbers
        return [(x, y) for i, x in enumerate(members) for y in members[i + 1 :] if (x ^ y).bit_count() <= radius]
    first: dict[int, int] = {}
    exact: dict[int, int] = {}
    found = []
    for x, d in zip(members, off, strict=True):
        v = x >> shift & 0xFFFF
        if first.setdefault(v, x) != x:
            found.append((first[v], x))
        if not d:
            exact[v] = x
    for v, x in first.items():
        found += [(x, first[v ^ 1 << i]) for i in range(WIDTH) if v < v ^ 1 << i and v ^ 1 << i in first]
    if len(exact) > 1:
        spread = [1 << i | 1 << j | 1 << k for i in range(WIDTH) for j in range(i, WIDTH) for k in range(j, WIDTH)]
        if len(exact) > len(spread):
            found += [(x, exact[v ^ m]) for v, x in exact.items() for m in set(spread) if v < v ^ m and v ^ m in exact]
        else:
            own = list(exact.values())
            found += [(x, y) for i, x in enumerate(own) for y in own[i + 1 :] if (x ^ y).bit_count() <= radius]
    return [(x, y) for x, y in found if (x ^ y).bit_count() <= radius]


#: Fingerprints whose links one task keeps to leave out links that follow from others; more are written out and begun anew.
FOREST = 500_000


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: verified links between distinct fingerprints that connect all fingerprints within the radius."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius {radius}: the blocks find all links up to {RADIUS} differing bits")
    emitted = distinct.select("fingerprint", F.explode(ball_variants(F.col("fingerprint"))).alias("variant"))
    n = int(emitted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = emitted.repartition(n, "variant").sortWithinPartitions("variant")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def give(found: list[tuple[int, int]]) -> pa.RecordBatch:
            new = []
            for x, y in found:
                if (p := _find(parent, x)) != (q := _find(parent, y)):
                    parent[p] = q
                    new.append((signed(x), signed(y)))
            if len(parent) > FOREST:
                parent.clear()
            a, b = zip(*new, strict=True) if new else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []  # parts of the last variant, which may go on in the next batch
        join = lambda: [np.concatenate(x) for x in zip(*held, strict=True)]
        for batch in batches:
            v, f = batch.column("variant").to_numpy(), batch.column("fingerprint").to_numpy()
            if not len(v):
                continue
            cut_at = int(np.searchsorted(v, v[-1], side="left"))
            if held and (cut_at or held[-1][0][-1] != v[-1]):
                held.append((v[:cut_at], f[:cut_at]))
                yield give(collisions(*join(), radius))
                held = []
            elif cut_at:
                yield give(collisions(v[:cut_at], f[:cut_at], radius))
            held.append((v[cut_at:], f[cut_at:]))
        if held:
            yield give(collisions(*join(), radius))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def collisions(variants: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Verified pairs from sorted variants and the fingerprints that emitted them."""
    if len(variants) < 2:
        return []
    same = variants[1:] == variants[:-1]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2] + 1
    bits = values.view(np.uint64)
    two = ends - starts == 2
    x, y = bits[starts[two]], bits[starts[two] + 1]
    near = (np.bitwise_count(x ^ y) <= radius) & (x != y)
    found = list(zip(x[near].tolist(), y[near].tolist(), strict=True))
    for s, e in zip(starts[~two].tolist(), ends[~two].tolist(), strict=True):
        members = sorted(set(bits[s:e].tolist()))
        found += linked_pairs(int(variants[s]) & FULL, members, radius)
    return found


def classes(prints: DataFrame, radius: int = RADIUS, cut: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """``fingerprint, component_id, text_hash``: for each distinct fingerprint, the smallest doc_id that it reaches, and that
    document's text hash.  ``prints`` has the columns of ``fingerprints`` and is read twice."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    distinct = cut(prints.groupBy("fingerprint").agg(F.min(order).alias("first")))
    roots = components(links(distinct, radius)).withColumnRenamed("node", "fingerprint")
    tied = distinct.join(roots, "fingerprint")
    least = tied.groupBy("root").agg(F.min("first").alias("least"))
    alone = distinct.join(roots, "fingerprint", "left_anti").select("fingerprint", F.col("first").alias("least"))
    every = tied.join(least, "root").select("fingerprint", "least").unionByName(alone)
    return every.select(
        "fingerprint", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("text_hash")
    )


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint`` (16 hexadecimal digits) ``, component_id``: a row for each document."""
    prints = cut(fingerprints(docs, words))
    found = classes(prints, radius).drop("text_hash")
    return prints.join(found, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_dedup(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """The documents, one of each group: that with the smallest doc_id; all its columns."""
    cuts = Cuts()
    prints = cuts(fingerprints(docs, words))
    return keep_documents(docs, prints, classes(prints, radius, cuts), cuts)


def keep_documents(docs: DataFrame, prints: DataFrame, firsts: DataFrame, cuts: Cuts) -> DataFrame:
    """The documents that ``firsts`` names by ``component_id, text_hash``, each once; ``cuts`` go."""
    # a group may have a row for each of its fingerprints, all with the same document
    kept = firsts.select(F.col("component_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    copies = prints.groupBy("doc_id", "text_hash").count().filter("count > 1").drop("count")
    kept = kept.join(
        copies.select("doc_id", "text_hash", F.lit(True).alias("_repeated")),
        F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")),
        "left",
    ).select("_id", "_hash", "_repeated")
    kept = cut(kept)
    cuts.drop()
    row = docs.select(F.struct("*").alias("row"))  # the documents' own columns may have any names
    found = row.join(
        kept, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("_hash"))
    )
    once = found.filter("_repeated IS NULL").select("row.*")
    again = found.filter("_repeated").dropDuplicates(["_id", "_hash"]).select("row.*")
    return once.unionByName(again)
