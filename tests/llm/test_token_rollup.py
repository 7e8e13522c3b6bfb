import shutil

from lectern.llm import packing, piece_bpe, queries
from lectern.llm.common import tokenizer_path
from lectern.llm.token_rollup import Rollup, token_counts
from tests.llm.fixtures import AWKWARD, docs, with_extras

CHANGES = "op string, source string, lang string, tokenizer string, version string, tokens bigint, old_tokens bigint"


def totals(rollup):
    return sorted((tuple(r) for r in rollup.totals().collect()), key=repr)


def test_signed_batches_commit_once(spark, tmp_path):
    rollup = Rollup(spark, str(tmp_path / "r"))
    assert totals(rollup) == []
    rows = lambda *x: spark.createDataFrame(list(x), CHANGES)
    first = rows(("insert", "a", "en", "t", "1", 5, None), ("insert", "a", "en", "t", "1", 7, None), ("insert", None, "en", "t", "1", 3, None))
    assert rollup.apply("b1", first) and not rollup.apply("b1", first)
    assert totals(rollup) == [("a", "en", "t", "1", 2, 12), (None, "en", "t", "1", 1, 3)]
    assert rollup.apply("b2", rows(("delete", None, "en", "t", "1", 3, None), ("revise", "a", "en", "t", "1", 9, 5)))
    assert totals(rollup) == [("a", "en", "t", "1", 2, 16)]
    assert rollup.apply("b3", rows()) and rollup.committed("b3")
    assert rollup.apply("b4", rows(("insert", "z", None, "t", None, None, None)))
    assert totals(rollup) == [("a", "en", "t", "1", 2, 16), ("z", None, "t", None, 1, 0)]
    assert totals(Rollup(spark, str(tmp_path / "r"))) == totals(rollup)
    staged = list((tmp_path / "r" / "staging").glob("*"))
    assert staged == []
    before = totals(rollup)
    assert rollup.compact() and not rollup.compact() and totals(rollup) == before
    assert list((tmp_path / "r" / "deltas").glob("batch*")) == []
    assert not rollup.apply("b1", first) and totals(rollup) == before
    assert rollup.apply("b/5 ü", rows(("insert", "a", "en", "t", "1", 1, None))) and not rollup.apply("b/5 ü", first)
    assert totals(rollup)[0] == ("a", "en", "t", "1", 3, 17) and rollup.compact() and totals(rollup)[0] == ("a", "en", "t", "1", 3, 17)
    for k in range(4):
        assert rollup.apply(f"c{k}", rows(("revise", "a", "en", "t", "1", 5, 3), (None, "a", "en", "t", "1", 5, 3), ("other", "a", "en", "t", "1", 5, 3)))
        assert rollup.compact()
    assert totals(rollup)[0] == ("a", "en", "t", "1", 3, 25) and len(list((tmp_path / "r" / "snapshots").glob("0*"))) == 2
    rollup.drop()
    assert totals(rollup) == []


def test_a_compaction_that_was_lost_halfway(spark, tmp_path):
    rollup = Rollup(spark, str(tmp_path / "r"))
    row = spark.createDataFrame([("insert", "a", "en", "t", "1", 5, None)], CHANGES)
    assert rollup.apply("x", row)
    kept = tmp_path / "kept"
    shutil.copytree(tmp_path / "r" / "deltas", kept)
    assert rollup.compact()
    shutil.rmtree(tmp_path / "r" / "deltas")
    shutil.copytree(kept, tmp_path / "r" / "deltas")  # its driver was lost before it could delete what it had folded
    assert totals(rollup) == [("a", "en", "t", "1", 1, 5)] and not rollup.apply("x", row)
    (tmp_path / "r" / "staging" / "lost").mkdir(parents=True)
    rollup.clean()
    assert (tmp_path / "r" / "staging" / "lost").exists()
    rollup.clean(hours=-1)
    assert not (tmp_path / "r" / "staging" / "lost").exists()
    assert not rollup.compact() and list((tmp_path / "r" / "deltas").glob("batch*")) == []
    assert totals(rollup) == [("a", "en", "t", "1", 1, 5)]


def test_counts_of_awkward_documents(spark):
    words, pieces = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")
    got = token_counts(with_extras(docs(spark, AWKWARD)), words, pieces).collect()
    w, p = packing.word_ids(words), piece_bpe.encoder(pieces)
    n = lambda t: (len(w.library.encode(t or "", add_special_tokens=False).ids), len(p.library.encode(t or "")))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["word_tokens"], r["piece_tokens"]) for r in got) == sorted(
        (i is None, i or 0, *n(t)) for i, t in AWKWARD
    )
    assert token_counts(docs(spark, []), words, pieces).count() == 0


def test_query_equals_a_recount(spark, sf_dir):
    w, p = packing.word_ids(tokenizer_path("word_bpe_49k.json")), piece_bpe.encoder(tokenizer_path("piece_bpe_32k.model"))
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    expected = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        quality, toxic = labels.get(r["doc_id"], (None, None))
        if quality == 0:
            continue
        text = r["text"] or ""
        for name, n in (("word_bpe_49k", len(w.library.encode(text, add_special_tokens=False).ids)), ("piece_bpe_32k", len(p.library.encode(text)))):
            key = (r["source"], r["lang"], name, "2" if quality == 1 and toxic == 0 else "1")
            d, t = expected.get(key, (0, 0))
            expected[key] = (d + 1, t + n + (quality == 1))
    got = {(r["source"], r["lang"], r["tokenizer"], r["version"]): (r["documents"], r["tokens"]) for r in queries.op8_token_rollup(spark, sf_dir).collect()}
    assert got == expected
