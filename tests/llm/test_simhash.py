import random
import re

import numpy as np
import pytest
import xxhash

from lectern.llm import queries, simhash
from tests.llm.fixtures import AWKWARD, assert_values_stay, docs, with_extras


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """Smallest id of everything reachable over links of at most three bits."""
    values = sorted(set(prints.values()))
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for d, v in prints.items():
        least[find(v)] = min(d, least.get(find(v), d))
    return {d: least[find(v)] for d, v in prints.items()}


def spread(rng, n):
    """Fingerprints at all small distances of each other: pairs, chains, dense balls, and copies."""
    out = []
    while len(out) < n:
        base = rng.getrandbits(64)
        out.append(base)
        for _ in range(rng.choice([0, 1, 3, 40])):
            base = rng.choice(out[-5:])
            for b in rng.sample(range(64), rng.randint(0, 5)):
                base ^= 1 << b
            out.append(base)
        low = rng.randrange(61)
        out.append(out[-1] ^ 0b111 << low)  # three bits that stand together
    return out[:n]


def test_links_connect_what_is_near(spark):
    rng = random.Random(4)
    values = spread(rng, 700) + [rng.getrandbits(4) << 20 | rng.getrandbits(8) for _ in range(300)] + [0, (1 << 64) - 1]
    prints = dict(enumerate(values))
    rows = [(d, d, v - (1 << 64) if v >> 63 else v) for d, v in prints.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, text_hash bigint, fingerprint bigint")
    found = {r["fingerprint"] & (1 << 64) - 1: r["component_id"] for r in simhash.classes(df).collect()}
    expected = plain_classes(prints)
    assert all(found[v] == expected[d] for d, v in prints.items())


def test_many_members_of_one_variant():
    rng = random.Random(1)
    variant = rng.getrandbits(64) & ~0xFFFF | 1
    members = set()
    while len(members) < 600:
        v = variant & ~0xFFFF | rng.getrandbits(16)
        members.add(v ^ (1 << rng.randrange(16, 64)) if rng.random() < 0.6 else v)
    members = sorted(members)
    parent = {m: m for m in members}
    for a, b in simhash.linked_pairs(variant, members):
        assert (a ^ b).bit_count() <= 3
        parent[simhash._find(parent, a)] = simhash._find(parent, b)
    index = {m: i for i, m in enumerate(members)}
    for m in members:  # equal or one bit apart in the block: linked
        for other in [m ^ 1 << k for k in range(16)]:
            if other in index:
                assert simhash._find(parent, m) == simhash._find(parent, other)


def test_a_wider_radius_is_refused(spark):
    prints = spark.createDataFrame([(1, 1, 5), (2, 2, 7)], "doc_id bigint, text_hash bigint, fingerprint bigint")
    with pytest.raises(ValueError):
        simhash.classes(prints, 4)
    assert {r["component_id"] for r in simhash.classes(prints, 1).collect()} == {1}
    assert {r["component_id"] for r in simhash.classes(prints, 0).collect()} == {1, 2}


def test_a_variant_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i, i, v) for i, v in enumerate([0x123 << 20 ^ 1 << k for k in range(19)] + [0x9 << 40])]
        prints = spark.createDataFrame(rows, "doc_id bigint, text_hash bigint, fingerprint bigint")
        assert sorted(r["component_id"] for r in simhash.classes(prints).collect()) == [0] * 19 + [19]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_column_sums():
    bits = np.random.default_rng(0).integers(0, 2, (1000, 64)).astype(np.uint8)
    assert (simhash.column_sums(bits) == bits.sum(axis=0)).all()


def test_awkward_documents(spark):
    df = with_extras(docs(spark, AWKWARD))
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(AWKWARD)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in AWKWARD:
        assert by_id[i]["fingerprint"] == f"{plain_fingerprint(t):016x}"
    assert by_id[3]["component_id"] == by_id[2]["component_id"] == by_id[4]["component_id"] == 2
    kept = simhash.near_dedup(df)
    assert_values_stay(df, kept)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert ids == [(False, 1), (False, 2), (False, 5), (False, 6), (False, 7), (False, 8), (True, 0)]
    empty = docs(spark, [])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.near_dedup(empty).count() == 0


def test_query_and_near_copies(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    expected = plain_classes(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, sf_dir).collect()}
    assert got == {d: (f"{v:016x}", expected[d]) for d, v in prints.items()}


def test_a_group_of_near_copies_leaves_one_row(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[:i] + ["changed"] + words[i + 1 :])) for i in range(1, 60)] + [(100, "another text altogether " * 9)]
    prints = {d: plain_fingerprint(t) for d, t in rows}
    expected = sorted({c for c in plain_classes(prints).values()})
    assert len(set(prints.values())) > len(expected)
    assert sorted(r["doc_id"] for r in simhash.near_dedup(docs(spark, rows)).collect()) == expected
