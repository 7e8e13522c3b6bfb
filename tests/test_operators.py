"""Operators on small frames: changes, stages, schemas, search, text functions."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import text as X
from lectern.operators import catalog, dml, evidence, search, similarity, stages, text_search, windows
from lectern.operators.graph import components
from lectern.operators.numbering import row_numbers


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_conform_adds_casts_and_drops(spark):
    df = spark.createDataFrame([("w", "3", "x")], "work_id string, segment_count string, extra string")
    out = schemas.conform(df, "artifacts")
    assert out.schema == schemas.schema("artifacts") or [f.dataType for f in out.schema] == [f.dataType for f in schemas.schema("artifacts")]
    assert out.first()["segment_count"] == 3 and out.first()["adapter"] is None


def test_catalog_on_empty_tables(spark):
    t = {n: schemas.empty(spark, n) for n in ("works", "artifacts", "work_classifications", "aliases", "source_files", "source_metadata")}
    assert catalog.list_collections(t["works"], t["artifacts"]).count() == 0
    assert catalog.list_works(t["works"], t["work_classifications"], t["aliases"], query="x", group="g").count() == 0
    assert catalog.summary(*(t[n] for n in ("works", "artifacts", "aliases", "source_files", "source_metadata"))).first()["work_count"] == 0
    assert catalog.duplicate_titles(t["works"]).count() == 0


def test_pseudo_authors_only_when_asked_for(spark):
    works = schemas.conform(spark.createDataFrame([("1", "Pseudo-Plato"), ("2", "Plato")], "work_id string, author string"), "works")
    assert [r["work_id"] for r in catalog.list_works(works, author="plato").collect()] == ["2"]
    assert [r["work_id"] for r in catalog.list_works(works, author="pseudo-p").collect()] == ["1"]


def test_upsert_keeps_created(spark):
    table = spark.createDataFrame([("a", 1, 10), ("b", 2, 11)], "k string, v int, created int")
    new = spark.createDataFrame([("a", 5, 99), ("c", 6, 98)], "k string, v int, created int")
    assert rows(dml.upsert_keeping(table, new, ["k"], "created")) == [("a", 5, 10), ("b", 2, 11), ("c", 6, 98)]


def test_components_of_a_path_a_star_and_a_ring(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    ring = [(200 + i, 200 + (i + 1) % 7) for i in range(7)]
    found = dict(rows(components(spark.createDataFrame(path + star + ring, "a bigint, b bigint"))))
    assert {found[i] for i in range(41)} == {0} and {found[100 + i] for i in range(30)} == {100} and {found[200 + i] for i in range(7)} == {200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_similar_pairs_equal_brute_force(spark):
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    items = [(i, " ".join(w for j, w in enumerate(words) if (i * 7 + 3) >> j & 1)) for i in range(40)]
    sets = {i: set(t.split()) for i, t in items}
    for t in (0.25, 0.5, 1.0):
        expected = sorted(
            (a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t
        )
        got = similarity.similar_pairs(spark.createDataFrame(items, "id int, text string"), "id", "text", t)
        assert rows(got, "a", "b") == expected


def test_stages_reuse_current_versions(spark):
    calls = []

    def registry(version):
        r = stages.HandlerRegistry()

        @r.register("t", "extract", version)
        def extract(df):
            calls.append(df.count())
            return df.select("input_id", F.upper("payload").alias("payload"))

        return r

    raw = spark.createDataFrame([("1", "t", "a"), ("2", "t", "b"), ("3", "t", None)], "effect_id string, tool string, payload string")
    none = spark.createDataFrame([], stages.EFFECTS)
    first = stages.run_stage(raw, none, registry("v1"), "extract")
    stored = spark.createDataFrame(first.collect(), stages.EFFECTS)
    assert rows(first, "input_id", "payload") == [("1", "A"), ("2", "B")]
    again = stages.run_stage(raw, stored, registry("v1"), "extract")
    assert rows(again) == rows(stored)
    newer = stages.run_stage(raw, stored, registry("v2"), "extract")
    assert {r["handler_version"] for r in newer.collect()} == {"v2"}
    assert calls == [2, 0, 2]


def test_witnesses_take_the_last_link(spark):
    value = '{"triples":[{"subject":"lex:a","predicate":"has_sense","object":"s"},{"subject":"lex:b","predicate":"has_sense","object":"s"},{"subject":"s","predicate":"gloss","object":" Wolf  "}]}'
    claims = spark.createDataFrame([("c1", "t", value), ("c2", "t", "not json"), ("c3", "t", None)], "claim_id string, tool string, value string")
    found = evidence.witness_senses(evidence.claim_triples(claims)).collect()
    assert [(r["lexeme"], r["normalized"]) for r in found] == [("lex:b", "wolf")]


def test_merge_evidence_keeps_existing(spark):
    df = spark.createDataFrame([Row(a={"x": "1", "y": ""}, b={"x": "2", "y": "3", "z": ""})])
    assert df.select(evidence.merge_evidence("a", "b").alias("m")).first()["m"] == {"x": "1", "y": "3"}


def test_phrase_and_fuzzy_hits(spark):
    docs = spark.createDataFrame([(1, "a b a b c"), (2, "b a"), (3, None), (4, "")], "id int, text string")
    assert rows(text_search.phrase_hits(docs, "id", "text", ["a", "b"])) == [(1, 2)]
    assert rows(text_search.phrase_hits(docs, "id", "text", ["a", "b", "a"])) == [(1, 1)]
    assert rows(text_search.fuzzy_hits(docs, "id", "text", ["c", "a"])) == [(1, "c", 1), (2, "a", 2)]


def test_index_issues(spark):
    meta = spark.createDataFrame([("schema", "1"), ("normalizer", "old")], "key string, value string")
    found = text_search.index_issues(meta, {"schema": "1", "normalizer": search.NORMALIZER_VERSION, "rows": "5"})
    assert rows(found, "key") == [("normalizer",), ("rows",)]


def test_text_functions(spark):
    df = spark.createDataFrame([("Jvlivs", "1.2.3", "XLIX", "lex:rex#noun", " a | b||a "), (None, "2.1", "ABC", "form:x", None)], "w string, c string, r string, a string, t string")
    out = df.select(
        X.latin_fold(F.col("w")).alias("fold"),
        X.project_citation(F.col("c")).alias("c"),
        X.citation_key(F.col("c")).alias("key"),
        X.roman_to_int(F.col("r")).alias("n"),
        X.parse_anchor(F.col("a")).alias("a"),
        X.tag_list(F.col("t")).alias("t"),
    ).collect()
    assert out[0]["fold"] == "iulius" and out[0]["c"] == "1.3" and out[0]["key"] == [1, 2, 3] and out[0]["n"] == 49
    assert (out[0]["a"]["kind"], out[0]["a"]["body"], out[0]["a"]["tag"]) == ("lex", "rex", "noun") and out[0]["t"] == ["a", "b"]
    assert out[1]["n"] is None and out[1]["t"] == [] and out[1]["a"]["tag"] is None


def test_cosine_dice_jaccard(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "c"]), ([], ["a"])], "x array<string>, y array<string>")
    got = df.select(X.cosine(F.col("x"), F.col("y")), X.dice(F.col("x"), F.col("y")), X.jaccard(F.col("x"), F.col("y"))).collect()
    assert [round(v, 6) for v in got[0]] == [round(2 / (5**0.5 * 2**0.5), 6), 0.5, round(1 / 3, 6)] and list(got[1]) == [0, 0, 0]


def test_cursor_offset():
    assert [windows.cursor_offset(c) for c in ("12", "x", None, "-3", "")] == [12, 0, 0, 0, 0]


def test_representatives_follow_source_priority(spark):
    df = spark.createDataFrame([("c", "lsj", "s1", 1), ("c", "mw", "s2", 2), ("c", "mw", "s1", 3), ("d", "other", "s", 4)], "cluster string, tool string, sense string, id int")
    assert rows(similarity.representatives(df, "cluster", "tool", "sense", "id")) == [("c", 3), ("d", 4)]


def test_row_numbers_of_a_large_key(spark):
    data = [("hot", i * 37 % 1009) for i in range(1009)] + [("b", 5), ("b", 1), (None, 2), (None, 1)]
    got = row_numbers(spark.createDataFrame(data, "k string, v int"), ["k"], ["v"]).collect()
    assert {(r["k"], r["v"], r["number"]) for r in got if r["k"] == "hot"} == {("hot", v, v + 1) for v in range(1009)}
    assert {(r["k"], r["v"]): r["number"] for r in got if r["k"] != "hot"} == {("b", 1): 1, ("b", 5): 2, (None, 1): 1, (None, 2): 2}
    assert row_numbers(spark.createDataFrame([], "k string, v int"), ["k"], ["v"]).count() == 0
