import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import lexical_search, queries
from lectern.storage import cut
from tests.compare import oracle_rows, spark_rows
from tests.llm.fixtures import AWKWARD, docs, with_extras

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERMS.findall(re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))


def plain_search(documents, items, k=10):
    """Every document scored for every item."""
    counted = [(d, Counter(plain_terms(t))) for d, t in documents if plain_terms(t)]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    with_term = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counted:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            score = 0
            for t in plain_terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * with_term[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def invented(rng, n, words=40):
    vocabulary = [f"w{i}" for i in range(60)]
    chances = [1 / (i + 1) for i in range(60)]
    return [(i, " ".join(rng.choices(vocabulary, chances, k=rng.randint(0, words)))) for i in range(n)]


def test_words_as_in_the_pattern():
    for text in ["A b-C_d é9É½ x y \x7f\x00z", "", "İ ı K", "日本語、です 😀", "_", "a" * 3000]:
        assert [t.decode() for part in lexical_search.term_parts(text.encode()) for t in part] == plain_terms(text)
    text = "abc, " * 700_000
    parts = list(lexical_search.term_parts(text.encode()))
    assert len(parts) > 2 and sum(map(len, parts)) == 700_000 and {t for p in parts for t in p} == {b"abc"}


def test_packed_lists():
    rng = random.Random(1)
    lists = [[rng.choice([0, 1, 127, 128, 2**20, 2**40, 2**62]) for _ in range(rng.randint(1, 30))] for _ in range(50)]
    packed = lexical_search.pack_lists(np.array([x for one in lists for x in one]), np.cumsum([len(x) for x in lists]))
    assert [lexical_search.unpack(b).tolist() for b in packed.to_pylist()] == lists


@pytest.mark.parametrize("seed", range(30))
def test_the_merge_loses_nothing(seed):
    rng = random.Random(seed)
    lists = []
    for _ in range(rng.randint(1, 9)):
        places = sorted(rng.sample(range(300), rng.randint(0, 200)))
        worth = [rng.randint(1, rng.choice([2, 1000])) for _ in places]
        lists.append((rng.choice([0, 1, 2, 50, 1000]), places, worth, max(worth, default=0)))
    scores = Counter()
    for w, places, worth, _ in lists:
        for p, x in zip(places, worth, strict=True):
            scores[p] += w * x
    for k in (1, 3, 10, 400):
        expected = sorted(((s, p) for p, s in scores.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]
        assert lexical_search.best(lists, k) == expected


def test_impacts_beyond_64_bits():
    lengths, counts = np.array([1, 10**9]), np.array([1, 10**8])
    n_docs, total = 10**9, 2 * 10**9
    expected = [10**9 * c // (1000 * c + 8 * (25 + 75 * n * n_docs // total)) for n, c in zip(lengths.tolist(), counts.tolist(), strict=True)]
    assert lexical_search.impacts(counts, lengths, n_docs, total).tolist() == expected


def test_against_all_scores(spark, monkeypatch):
    rng = random.Random(7)
    documents = invented(rng, 400)
    documents += [(1000 + i, documents[5][1]) for i in range(40)] + [(3, documents[3][1]), (None, documents[7][1])]
    rng.shuffle(documents)
    items = [(i, t) for i, (_, t) in enumerate(invented(rng, 25, 12))] + [(None, "w3 w3 W9"), (2, "w50"), (2, "w50"), (77, ""), (78, None), (79, "absent")]
    texts, asked = docs(spark, documents).repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    expected = plain_search(documents, items)
    index = cut(lexical_search.build_index(texts))
    assert found(lexical_search.search(index, asked)) == expected
    known = lexical_search.asked_terms(asked)
    assert b"absent" in known and found(lexical_search.search(cut(lexical_search.build_index(texts, known)), asked)) == expected
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 150)
    assert lexical_search.asked_terms(asked) is None
    assert found(lexical_search.search(index, asked)) == expected
    assert found(lexical_search.search(index, asked, 3)) == [r for r in expected if r[1] <= 3]


def test_small_shards(monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 7)
    rng = random.Random(2)
    shard = lexical_search.Shard(None)
    for i, text in invented(rng, 7):
        shard.add(6 - i, text.encode())
    rows = shard.rows(4).to_pylist()
    assert shard.full or len(shard.ids) < 7
    assert rows[-1]["term"] is None and rows[-1]["n_docs"] == len(shard.ids)
    for r in rows[:-1]:
        places = np.cumsum(lexical_search.unpack(r["places"]))
        assert len(places) == r["n_docs"] and (np.diff(places) > 0).all()
        assert lexical_search.unpack(r["counts"]).sum() == r["n_tokens"]


def test_awkward_documents_and_items(spark):
    documents = with_extras(docs(spark, AWKWARD))
    items = spark.createDataFrame([(1, "the fox WORD école x 日本語"), (2, None), (3, " ")], "item_id bigint, text string").withColumn("rank", F.lit(5))
    got = found(lexical_search.search(lexical_search.build_index(documents), items))
    assert got == plain_search(AWKWARD, [(1, "the fox WORD école x 日本語")])
    none = documents.limit(0)
    assert lexical_search.search(lexical_search.build_index(none), items).collect() == []
    assert lexical_search.search(lexical_search.build_index(documents), items.limit(0)).collect() == []


def test_query_equals_sql(spark, sf_dir):
    assert spark_rows(queries.op11_lexical_search(spark, sf_dir)) == oracle_rows(queries.ORACLES["op11_lexical_search"], sf_dir)
