import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import search as S
from lectern.storage import delete_folder

SEGMENTS = "work_id string, segment_id string, sort_key int, text string"
WORDS = [f"w{i}" for i in range(25)]


def invented(rng, n):
    return [(f"k{i % 9}", f"{i}", i, " ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(25)], k=rng.randint(0, 30)))) for i in range(n)]


def rows_of(spark, segments):
    works = [(f"k{i}", ["lat", "grc", "san"][i % 3], f"T{i % 4}") for i in range(9)]
    return S.search_rows(spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(works, "work_id string, language string, title string"))


def plain_search(segments, asked, want="words"):
    """Segments and scores by BM25 over all of them."""
    texts = {s: t.split() for _, s, _, t in segments}
    mean = sum(map(len, texts.values())) / len(texts)
    scores = {}
    for s, ws in texts.items():
        score = 0.0
        for t in dict.fromkeys(asked):
            df = sum(t in x for x in texts.values())
            tf = ws.count(t)
            score += math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean)) if tf else 0
        whole = all(t in ws for t in asked)
        phrase = any(ws[i : i + len(asked)] == asked for i in range(len(ws)))
        if score and (want == "words" or want == "all" and whole or want == "phrase" and phrase):
            scores[s] = round(score, 6)
    return scores


def found(df):
    return {r["segment_id"]: round(r["score"], 6) for r in df.collect()}


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """An index in five batches with replaced and deleted rows, and the segments that are left."""
    rng = random.Random(3)
    segments, folder = invented(rng, 240), str(tmp_path_factory.mktemp("grown"))
    older = [(w, s, k, "w0 w1 w2 old") for w, s, k, _ in segments[:30]]
    S.build_index(rows_of(spark, []), folder)
    S.append(rows_of(spark, older), folder)
    for part in (segments[:90], segments[90:200], segments[200:]):
        index = S.append(rows_of(spark, part), folder)
    keys = index.rows.filter("sort_key % 10 = 4")
    index = S.delete(index, keys)
    return index, [s for s in segments if s[2] % 10 != 4]


@pytest.mark.parametrize("mode", ["words", "all", "phrase"])
def test_batches_score_as_one_index(spark, grown, mode):
    index, left = grown
    assert index.n_docs == len(left) == index.rows.count() and len(index.batches) == 5
    for asked in (["w0"], ["w3", "w1"], ["w24"], ["w0", "w1", "w2"], ["old"]):
        assert found(S.search(index, " ".join(asked), mode=mode, limit=500)) == plain_search(left, asked, mode)


def test_merged_and_counts(spark, grown, tmp_path):
    index, left = grown
    S.build_index(rows_of(spark, left), str(tmp_path / "one"))
    one = S.Index(spark, str(tmp_path / "one"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(index.counts()) == rows(one.counts()) and index.totals == one.totals
    pages = [rows(S.search(i, "w2 w7", limit=12, offset=5).select("place", "segment_id", F.round("score", 9))) for i in (index, one)]
    assert pages[0] == pages[1]
    with pytest.raises(FileExistsError):
        S.build_index(rows_of(spark, left), one.folder)
    S.build_index(rows_of(spark, left[:7]), one.folder, "overwrite")
    S.build_index(rows_of(spark, left[5:]), one.folder, "append")
    merged = S.merge(S.delete(S.Index(spark, one.folder), spark.createDataFrame([("k1",)], "work_id string"), "work_id"))
    assert len(merged.batches) == 1 and merged.tombstones is None
    assert found(S.search(merged, "w0", limit=500)) == plain_search([s for s in left if s[0] != "k1"], ["w0"])
    assert S.delete(merged, spark.createDataFrame([("none",)], "row_key string")).version == merged.version


def test_pruned_pages_are_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "SHARD_ROWS", 10)
    segments = invented(random.Random(9), 300)
    segments += [("k2", f"t{i}", 1000 + i, "w20 w21") for i in range(25)]
    S.build_index(rows_of(spark, segments), str(tmp_path / "i"))
    index = S.Index(spark, str(tmp_path / "i"))
    page = lambda: [(r["place"], r["segment_id"], round(r["score"], 9)) for r in S.search(index, "w5 w20 w0", limit=8, offset=4, filters={"language": "san"}).collect()]
    whole = page()
    monkeypatch.setattr(S, "PRUNED_FROM", 40)
    assert page() == whole
    read = []
    monkeypatch.setattr(S.Query, "hits", lambda self, shards=None, hits=S.Query.hits: read.append(shards) or hits(self, shards))
    assert page() == whole and len(read) == 2 and len(read[0]) < len(read[1]) <= 33
    few = [(r["place"], r["segment_id"]) for r in S.search(index, "w24 w23", limit=3).collect()]
    assert len(read[-1]) < len(S.Query(index, "w24 w23", "words", "tokens", {}, None).blocks) and len(few) == 3
    monkeypatch.setattr(S, "TIES", 2)
    assert page() == whole
    tied = S.search(index, "w20 w21", mode="phrase", limit=30).collect()
    assert S.Query(index, "w20 w21", "phrase", "tokens", {}, None).first(3) is None
    assert [r["segment_id"] for r in tied if r["segment_id"].startswith("t")][:3] == ["t0", "t1", "t2"]
    assert [r["segment_id"] for r in S.search(index, "w20 w21", mode="phrase", limit=3).collect()] == [r["segment_id"] for r in tied[:3]]


def test_texts_are_read_for_the_page_alone(spark, grown, tmp_path):
    segments = invented(random.Random(1), 50)
    S.build_index(rows_of(spark, segments), str(tmp_path / "i"))
    index = S.Index(spark, str(tmp_path / "i"))
    delete_folder(spark, f"{index.folder}/rows")
    for mode in ("words", "all", "phrase", "fuzzy"):
        assert S.Query(index, "w0 w1", mode, "tokens", {"language": "lat", "work_id": "k0"}, None).first(5)
    plan = S.search(grown[0], "w0", limit=3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan


def test_an_empty_index(spark, tmp_path):
    S.build_index(rows_of(spark, []), str(tmp_path / "i"))
    index = S.Index(spark, str(tmp_path / "i"))
    assert index.issues().count() == 0 and index.counts().count() == 0 and index.rows.count() == 0
    for mode in ("words", "all", "phrase", "fuzzy"):
        assert S.search(index, "arma", mode=mode, context=1).count() == 0
        assert S.matches(index, "arma", mode).count() == 0
    assert S.Index(spark, str(tmp_path / "never")).version == 0
    assert S.search(S.merge(index), "arma").count() == 0


def test_two_writers_and_equal_keys(spark, tmp_path):
    folder = str(tmp_path / "i")
    segments = [("k0", "1", 1, "alpha"), ("k0", "1", 1, "beta"), ("k0", "2", 2, None)]
    first = S.append(rows_of(spark, segments), folder)
    assert first.n_docs == 2 and S.matches(first, "beta").count() == 1 and S.matches(first, "alpha").count() == 0
    late = S.Index(spark, folder)
    S.append(rows_of(spark, [("k1", "9", 1, "gamma")]), folder)
    with pytest.raises(RuntimeError):
        S.delete(late, spark.createDataFrame([("k0",)], "work_id string"), "work_id")
    now = S.Index(spark, folder)
    assert now.n_docs == 3 and now.version == 2
    assert {r["work_id"]: (r["expected"], r["found"]) for r in now.stale_works(spark.createDataFrame([("k0", "1"), ("k5", "1")], "work_id string, segment_id string")).collect()} == {
        "k0": (1, 2), "k1": (0, 1), "k5": (1, 0),
    }
    assert S.search(now, "gamma", filters={"title": "T1"}).count() == 1 and S.search(now, "gamma", filters={"title": "T0"}).count() == 0


def test_postings_are_written_without_a_shuffle_and_once_for_equal_fields(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "SHARD_ROWS", 5)
    monkeypatch.setattr(S, "PART_WORDS", 40)
    texts = ["the same, w%d été" % (i % 7) for i in range(60)]
    segments = spark.createDataFrame([(f"w{i % 3}", f"s{i}", t) for i, t in enumerate(texts)], "work_id string, segment_id string, text string")
    works = spark.createDataFrame([(f"w{i}",) for i in range(3)], "work_id string")
    index = S.append(S.search_rows(segments, works), str(tmp_path / "i"))
    stored = index._all_postings().filter("term IN ('the', 'same', 'same,', 'été')").groupBy("term", "field").count().collect()
    assert {(r["term"], r["field"], r["count"]) for r in stored} == {
        ("the", "search,folded,tokens", 60), ("same,", "search,folded", 60), ("same", "tokens", 60), ("été", "search", 60),
    }
    assert {r["term"]: r["n"] for r in index.blocks_of("tokens", ["the", "w3"]).groupBy("term").sum("n").withColumnRenamed("sum(n)", "n").collect()} == {"the": 60, "w3": 9}
    # what deleted rows have is taken off the blocks, without joining postings
    index = S.delete(index, spark.createDataFrame([("w1",)], "work_id string"), "work_id")
    left = [t for i, t in enumerate(texts) if i % 3 != 1]
    got = {r["field"]: (r["postings"], r["terms"], r["tokens"]) for r in index.counts().collect()}
    assert got == {f: (160, 10, 160) for f in S.FIELDS} and len(left) == 40
    assert not any("/postings/" in f for f in index.counts().inputFiles())
