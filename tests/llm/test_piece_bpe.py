import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import piece_bpe, queries
from lectern.llm.common import tokenizer_path
from tests.llm.fixtures import AWKWARD, docs, with_extras

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return piece_bpe.PieceEncoder(PATH)


def same(encoder, texts):
    got = [x.tolist() for x in encoder.encode(pa.array(texts, pa.string()))]
    assert got == [encoder.library.encode(t or "") for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="ab \n▁\x01<s>/é日", max_size=60)), max_size=6))
def test_ids_equal_the_library(encoder, texts):
    same(encoder, [t for t in texts if t is None or not any(0xD800 <= ord(c) < 0xE000 or c == "\0" for c in t)])


def test_long_segments_take_the_heap(encoder):
    same(encoder, ["the" * 400 + " thing" * 50, "a" * 3000, "▁" * 500 + "b", " " * 100, "x" * piece_bpe.SHORT + "y"])


def test_full_cache_starts_anew(encoder, monkeypatch):
    monkeypatch.setattr(piece_bpe, "CACHE_SEGMENTS", 5)
    for k in range(4):
        same(encoder, [f"w{k}{i} and more" for i in range(6)])


def test_operator(spark, encoder):
    out = piece_bpe.encode_documents(with_extras(docs(spark, AWKWARD)), PATH).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"], r["decoded"]) for r in out)
    expected = []
    for i, t in AWKWARD:
        ids = [*encoder.library.encode(t or ""), 2]
        expected.append((i is None, i or 0, ids, encoder.library.decode(ids)))
    assert got == sorted(expected)
    assert piece_bpe.encode_documents(docs(spark, []), PATH).count() == 0


def test_query(spark, sf_dir, encoder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in queries.op5_piece_bpe(spark, sf_dir).collect():
        ids = [*encoder.library.encode(texts[r["doc_id"]] or ""), 2]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), digest(" ".join(map(str, ids))))
        assert r["decoded_sha256"] == digest(encoder.library.decode(ids))


def test_every_text_is_held_against_the_library(monkeypatch):
    own = piece_bpe.PieceEncoder(tokenizer_path("piece_bpe_32k.model"))
    texts = pa.array(["one text", "another text", "a third"])
    own.checked(texts)
    right = own.encode
    for wrong in range(3):
        monkeypatch.setattr(own, "encode", lambda t, k=wrong: [x[:-1] if i == k else x for i, x in enumerate(right(t))])
        with pytest.raises(ValueError, match="differ"):
            own.checked(texts)
