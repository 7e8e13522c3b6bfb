import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import packing, queries
from lectern.llm.common import tokenizer_path
from tests.llm.fixtures import AWKWARD, docs, with_extras

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abeH.,'s \n\t\ṟ́éÉİΣ5½_-日<|>endoftext"), max_size=40), max_size=6))
def test_word_ids_equal_the_library(library, texts):
    words = packing.word_ids(PATH)
    ids, counts = words.encode(pa.array(texts, pa.string()))
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == [x for e in expected for x in e]
    assert words.counts(pa.array(texts, pa.string())).tolist() == counts.tolist()


def test_full_cache_keeps_what_came_again(library, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 12)
    words = packing.WordIds(PATH)
    for k in range(12):
        texts = ["often seen words " + " ".join(f"rare{k}x{i}" for i in range(6)), "", "often"]
        ids, counts = words.encode(pa.array(texts))
        expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [x for e in expected for x in e] and counts.tolist() == [len(e) for e in expected]
    assert "often" in words.slot and len(words.slot) < 40


def test_pieces_and_packs(spark, library):
    rows = AWKWARD + [(100 + i, f"some words number {i} " * (i % 9)) for i in range(60)]
    pieces = packing.token_pieces(with_extras(docs(spark, rows)), PATH, capacity=64).cache()
    by_doc = {}
    for r in pieces.collect():
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    expected = {}
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        expected.setdefault((i, len(ids)), []).append(ids)
    assert by_doc.keys() == expected.keys()
    for key, lists in expected.items():
        got = sorted(by_doc[key], key=lambda r: r["start"])
        again = len(lists)
        ids = [x for r in got[::again] for x in np.frombuffer(r["ids"], "<u4").tolist()]
        assert ids == lists[0] and all(r["length"] <= 64 for r in got)
    slim = pieces.drop("ids")
    placed = packing.pack(slim, capacity=64, salt_rows=3).collect()
    assert len(placed) == slim.count()
    sequences = {}
    for r in placed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(sequences) == list(range(len(sequences)))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 200), max_size=20))
def test_histogram_packing_places_everything(histogram):
    patterns = packing.histogram_packing(histogram, 32)
    placed = {}
    for pattern, count in patterns:
        assert 0 < sum(pattern) <= 32 and count > 0
        for n in pattern:
            placed[n] = placed.get(n, 0) + count
    assert placed == histogram
    tokens = sum(k * v for k, v in histogram.items())
    assert sum(c for _, c in patterns) <= 2 * -(-tokens // 32) + 1


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_hot_length_and_clashing_columns(spark, monkeypatch, broadcast):
    monkeypatch.setattr(packing, "BROADCAST_INTERVALS", broadcast)
    rows = [(i, 0, 16 if i % 3 else 1 + i % 15, i * 10) for i in range(900)] + [(7, 0, 5, 1), (7, 0, 5, 2), (7, 0, 5, 1), (None, 0, 3, 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, start bigint, length bigint, block bigint")
    for name in "salt row rank before n first after sequence times place _salt _row c0 c1".split():
        df = df.withColumn(name, F.col("block") + 1)
    out = packing.pack(df.withColumn("sequence_id", F.lit(-1)).withColumn("offset", F.lit(-1)), capacity=16, salt_rows=10)
    assert out.columns == [*df.columns, "sequence_id", "offset"]
    got = out.collect()
    assert sorted(map(repr, (tuple(r)[: len(df.columns)] for r in got))) == sorted(map(repr, map(tuple, df.collect())))
    taken = [(r["sequence_id"], at) for r in got for at in range(r["offset"], r["offset"] + r["length"])]
    assert len(taken) == len(set(taken)) and max(at for _, at in taken) < 16
    assert sorted(map(repr, map(tuple, packing.pack(df, 16, 10).collect()))) == sorted(map(repr, map(tuple, packing.pack(df.repartition(3), 16, 10).collect())))


def test_empty_table(spark):
    pieces = packing.token_pieces(docs(spark, []), PATH).drop("ids")
    assert packing.pack(pieces).count() == 0


def test_query_over_the_whole_table(spark, sf_dir, library):
    got = queries.op7_packing(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert by_doc.keys() == texts.keys()
    tokens = 0
    for i, parts in by_doc.items():
        ids = np.array([*library.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            own = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(own.tobytes()))
            at += r["length"]
        assert at == len(ids)
        tokens += at
    sequences = {r["sequence_id"] for r in got}
    assert tokens / (4096 * len(sequences)) > 0.97
