import corpus_pipeline
from tests.llm.fixtures import AWKWARD, assert_values_stay, docs, with_extras
from tests.llm.test_simhash_bands import plain_kept


def test_stages_one_by_one(spark, sf_dir):
    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = before.columns
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        found[name] = after = stage(spark, before, sf_dir).cache()
        if name != "packing":
            assert after.columns == columns
            listed = [r["doc_id"] for r in after.collect()]
            ids = set(listed)
            assert len(ids) == len(listed)
            assert ids <= {r["doc_id"] for r in before.collect()}
        if name == "near_duplicates":
            assert sorted(ids) == plain_kept([(r["doc_id"], r["text"]) for r in before.collect()])
        before = after
    assert {r["doc_id"] for r in found["packing"].collect()} == {r["doc_id"] for r in found["secrets"].collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = {i for i, t in labels.items() if t == 0}
    kept = {r["doc_id"] for r in found["toxicity"].collect()}
    assert len(clean & kept) >= 0.98 * len(clean)


#: Ids of the awkward documents that a stage keeps, each with how often; None: the stage's model decides.
KEPT = {
    "quality": [],
    "near_duplicates": [None, 1, 2, 5, 6, 7, 8],
    "secrets": [None, 1, 1, 2, 3, 4, 5, 6, 7, 8],
    "packing": [None, 1, 1, 2, 3, 4, 5, 6, 7, 8],
}


def test_awkward_documents_pass_every_stage(spark, sf_dir):
    order = lambda ids: sorted(ids, key=lambda i: (i is not None, i or 0))
    for name, stage in corpus_pipeline.STAGES:
        before = with_extras(docs(spark, AWKWARD))
        out = stage(spark, before, sf_dir)
        if name != "packing":
            assert_values_stay(before, out)
        ids = [r["doc_id"] for r in out.select("doc_id").distinct().collect()] if name == "packing" else [r["doc_id"] for r in out.collect()]
        if name in KEPT:
            assert order(ids) == order(set(KEPT[name]) if name == "packing" else KEPT[name]), name
        else:
            assert set(ids) <= {i for i, _ in AWKWARD}
        assert stage(spark, docs(spark, []), sf_dir).count() == 0, name


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
