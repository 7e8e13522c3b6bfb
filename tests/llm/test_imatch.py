import functools
import hashlib
import re
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from lectern.llm import imatch, queries
from tests.llm.fixtures import AWKWARD, assert_values_stay, docs, with_extras


def test_lexicon_is_the_band_of_document_counts(spark):
    rows = [(i, " ".join(w for k, w in enumerate(["all", "half", "third", "tenth"]) if i % [1, 2, 3, 10][k] == 0) + f" own{i}") for i in range(60)]
    terms = imatch.lexicon(docs(spark, rows), 0.08, 0.5)
    hashes = {r["h"]: r["w"] for r in spark.createDataFrame([(w,) for w in ("all", "half", "third", "tenth")], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    assert {hashes[r["term"]]: r["documents"] for r in terms.collect()} == {"half": 30, "third": 20, "tenth": 6}


def h64(raw, seed=42):
    return xxhash.xxh64_intdigest(raw, seed)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def long_(x, seed=42):
    return h64(struct.pack("<q", x), seed)


def plain_terms(text):
    return {signed(h64(w.encode())) for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if w}


def plain_lexicon(texts, low=imatch.LOW, high=imatch.HIGH):
    counts = Counter(t for x in set(texts) for t in plain_terms(x))
    return {t for t, n in counts.items() if low <= n / len(set(texts)) <= high}


def plain_hashes(text, lexicon):
    chain = lambda ts: signed(functools.reduce(lambda s, t: long_(t, s), ts, 42))
    terms = sorted(plain_terms(text) & lexicon)
    if not terms:
        return [signed(h64(text.encode(), h64(b"whole")))] * (1 + imatch.DRAWS * len(imatch.RATES))
    out = [chain(terms)]
    for d in range(imatch.DRAWS):
        chosen = terms
        for rate in imatch.RATES:
            chosen = [t for t in chosen if h64(struct.pack("<i", 1 + d), long_(t)) % rate == 0]
            out.append(chain(chosen) if chosen else None)
    return out


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    best = 0.0
    for k in range(len(imatch.RATES)):
        pairs = [(a[1 + d * len(imatch.RATES) + k], b[1 + d * len(imatch.RATES) + k]) for d in range(imatch.DRAWS)]
        told = [p for p in pairs if p != (None, None)]
        if len(told) >= imatch.LEAST_TOLD:
            best = max(best, sum(x == y for x, y in told) / len(told))
    return best


def plain_fingerprint(hashes):
    return ".".join("-" if x is None else f"{x & (1 << 64) - 1:x}" for x in hashes)


def test_both_ways_to_the_lexicon_give_the_same(spark, monkeypatch):
    words = [f"w{i % 37}x{i % 11}" for i in range(3000)]
    rows = [(i, " ".join(words[(i * 13) % 2000 : (i * 13) % 2000 + 150])) for i in range(200)] + AWKWARD
    df = with_extras(docs(spark, rows))
    few = imatch.prepare(df, 0.01, 0.5)
    monkeypatch.setattr(imatch, "MAX_CONSTANT", 0)
    many = imatch.prepare(df, 0.01, 0.5)
    assert few.table is not None and many.table is None
    own = lambda x: sorted((repr(r["doc_id"]), r["hashes_"]) for r in imatch.with_hashes(df, "text", x, "hashes_").select("doc_id", "hashes_").collect())
    assert own(few) == own(many)
    lexicon = plain_lexicon([t or "" for _, t in rows], 0.01, 0.5)
    assert own(few) == sorted((repr(i), plain_hashes(t or "", lexicon)) for i, t in rows)
    assert_values_stay(df, imatch.with_hashes(df, "text", many, "hashes_"))


def test_equal_and_edited_texts(spark):
    words = [f"w{i % 37}x{i % 11}" for i in range(3000)]
    rows = [(i, " ".join(words[(i * 13) % 2000 : (i * 13) % 2000 + 150])) for i in range(200)]
    found = imatch.prepare(docs(spark, rows), 0.01, 0.5)
    told = spark.createDataFrame([(rows[0][1], rows[0][1] + " unseenword"), (rows[0][1], rows[1][1]), ("", "a"), ("", "")], "a string, b string")
    both = imatch.with_hashes(imatch.with_hashes(told, "a", found, "p"), "b", found, "q")
    got = [r[0] for r in both.select(imatch.likeness(F.col("p"), F.col("q"))).collect()]
    assert got[0] == 1.0 and got[1] < 1.0 and got[2] == 0.0 and got[3] == 1.0


def plain_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    return [(a, b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True)]


def test_next_document(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 7)
    rows = [(i * 3, f"text {i}") for i in range(100)]
    got = imatch.with_next(docs(spark, rows), {"n": "text"})
    assert {(r["doc_id"], r["n"]) for r in got.collect()} == {(a[0], n) for a, n in plain_next(rows)}
    one = imatch.with_next(docs(spark, rows[:1]), {"n": "text"}).collect()
    assert [(r["doc_id"], r["n"]) for r in one] == [(0, "text 0")]
    assert imatch.with_next(docs(spark, []), {"n": "text"}).count() == 0
    nulls = [(None, "p"), (1, "q"), (2, "r")]
    got = {(r["doc_id"], r["n"]) for r in imatch.with_next(docs(spark, nulls), {"n": "text"}).collect()}
    assert got == {(1, "r"), (2, "p"), (None, "q")}
    assert [r["n"] for r in imatch.with_next(docs(spark, [(None, "p")] * 3), {"n": "text"}).collect()] == ["p"] * 3
    unknown = {(r["doc_id"], r["n"]) for r in imatch.with_next(docs(spark, [(1, "a"), (2, None), (3, "c")]), {"n": "text"}).collect()}
    assert unknown == {(1, None), (2, "c"), (3, "a")}


def test_awkward_documents(spark):
    df = with_extras(docs(spark, AWKWARD))
    out = imatch.with_hashes(df, "text", imatch.prepare(df), "hashes_")
    assert out.filter("hashes_ IS NOT NULL").count() == len(AWKWARD)
    after = imatch.with_next(out, {"next_text_": "text"})
    assert_values_stay(df, after)
    assert after.count() == len(AWKWARD)
    assert imatch.prepare(docs(spark, [])).table is not None


def test_query(spark, sf_dir):
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    lexicon = plain_lexicon([t for _, t in rows])
    got = {r["doc_id"]: r for r in queries.op2_imatch(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for (i, t), n in plain_next(rows):
        q = len(t) // 4
        edited = t[: len(t) - q] + n[:q]
        own, other, following = (plain_hashes(x, lexicon) for x in (t, edited, n))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (plain_fingerprint(own), plain_fingerprint(other))
        assert (r["near_edited"], r["near_next"]) == (plain_likeness(own, other), plain_likeness(own, following))
    share = lambda c: sum(r[c] >= imatch.NEAR for r in got.values()) / len(got)
    assert share("near_edited") >= 0.85 and share("near_next") <= 0.02


def test_a_text_with_a_third_of_the_rows_keeps_its_terms(spark):
    words = [f"w{i}" for i in range(2000)]
    rows = [(i, " ".join(words[(i * 37) % 1900 : (i * 37) % 1900 + 100])) for i in range(200)]
    hot = rows + [(1000 + i, rows[0][1]) for i in range(100)]
    count = lambda r: {x["term"]: x["documents"] for x in imatch.lexicon(docs(spark, r), 0.002, 0.2).collect()}
    found = count(hot)
    assert found == count(rows) and len(found) > 1000
