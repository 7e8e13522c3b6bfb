import random

import numpy as np

from lectern.llm import simhash_bands
from tests.llm.fixtures import AWKWARD, assert_values_stay, docs, with_extras


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(rows):
    """Smallest id of each component over pairs at similarity 0.8 or more, blank texts being one."""
    sets = {i: plain_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return sorted({find(i) for i in ids})


def test_against_all_pairs(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    for g in range(20):  # groups at all similarities around the bound, and chains of edits
        own = rng.choices(words, k=rng.randint(60, 400))
        for k in range(6):
            if g % 2 or k == 0:
                text = list(own)
            for at in rng.sample(range(len(text)), rng.randint(0, len(text) // 40)):
                text[at] = rng.choice(words)
            rows.append((10_000 + 10 * g + k, " ".join(text)))
    expected = plain_kept(rows)
    got = simhash_bands.near_dedup(docs(spark, rows))
    assert sorted(r["doc_id"] for r in got.collect()) == expected


def test_pairs_that_neighbours_leave_are_compared(spark, monkeypatch):
    monkeypatch.setattr(simhash_bands, "SHARES", ())
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*words, *(f"own{i}x{k}" for k in range(10))])) for i in range(30)] + [(99, "something else")]
    got = simhash_bands.near_dedup(docs(spark, rows))
    assert sorted(r["doc_id"] for r in got.collect()) == plain_kept(rows) == [0, 99]


def test_a_star_of_near_copies(spark):
    """Copies with a few own changes each: near the first text, but not near each other; and some that are near none."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 120):
        text = list(base)
        for at in rng.sample(range(150), 3 if k % 3 else 6):
            text[at] = f"own{k}x{at}"
        rows.append((k, " ".join(text)))
    got = simhash_bands.near_dedup(docs(spark, rows))
    assert sorted(r["doc_id"] for r in got.collect()) == plain_kept(rows)


def test_band_prints_are_majorities_beside_minima():
    rng = np.random.default_rng(3)
    own = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    prints = simhash_bands.band_prints(own)
    assert (prints == simhash_bands.band_prints(own[::-1])).all() and len(set(prints.tolist())) == simhash_bands.BANDS + simhash_bands.SKETCH // 64
    alone = [simhash_bands.band_prints(own[i : i + 1]) for i in range(0, 200)]
    low = (1 << simhash_bands.BITS) - 1
    part = simhash_bands.band_prints(own[:200]) & np.uint64(low)
    for band in range(simhash_bands.BANDS):
        for bit in range(simhash_bands.BITS):
            votes = sum(int(a[band]) >> bit & 1 for a in alone)
            assert int(part[band]) >> bit & 1 == (2 * votes > len(alone))


def test_share_of_candidates_is_as_computed():
    rng = np.random.default_rng(5)
    low, met, n = np.uint64((1 << simhash_bands.BITS) - 1), 0, 400
    for _ in range(n):  # pairs of 300 shingles at similarity 0.8
        own = np.unique(rng.integers(0, 1 << 63, 333, dtype=np.uint64))
        a, b = simhash_bands.band_prints(own[:300]), simhash_bands.band_prints(own[33:])
        k = simhash_bands.BANDS
        near = ((a & ~low == b & ~low) & (np.bitwise_count(a ^ b) <= 2))[:k].any()
        met += bool(near and np.bitwise_count(a[k:] ^ b[k:]).sum() <= simhash_bands.FAR)
    assert simhash_bands.chance(0.8) > 0.996 and met >= 0.985 * n


def test_awkward_documents(spark):
    df = with_extras(docs(spark, AWKWARD))
    kept = simhash_bands.near_dedup(df)
    assert_values_stay(df, kept)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert ids == [(False, 1), (False, 2), (False, 5), (False, 6), (False, 7), (False, 8), (True, 0)]
    assert simhash_bands.near_dedup(docs(spark, [])).count() == 0
