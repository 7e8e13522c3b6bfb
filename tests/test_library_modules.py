"""Scripts, references, ranking, passages, translations, dictionaries and the table store on small frames."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lectern import storage
from lectern.functions import references, scripts
from lectern.operators import passages, ranking, tokens, translation
from lectern.plans.cache import ExpiringCache
from lectern.sources import dictionaries
from lectern.sources.store import TableStore


def test_scripts():
    assert scripts.beta_to_greek("*mh=nin a)/eide qea/ lo/gos") == "Μῆνιν ἄειδε θεά λόγος"
    for word in ("kṛṣṇa", "bhairava", "jñāna", "ṛṣi", "aiśvarya"):
        assert scripts.slp1_to_iast(scripts.iast_to_slp1(word)) == word
    keys = [scripts.native_order(w) for w in ("a", "A", "k", "K", "h", "?")]
    assert keys == sorted(keys)
    assert scripts.search_text("Jūlius  Vērus!", "lat") == "iulius uerus" and scripts.search_text("ΛΌΓΟΣ", folded=False) == "λόγοσ"


def test_script_columns(spark):
    df = spark.createDataFrame([("Éa J",), (None,)], "x string")
    got = df.select(scripts.on_column(scripts.strip_marks, F.col("x")).alias("s"), scripts.normalized_triple(F.col("x"), "lat").alias("t"), scripts.hmac_hex(b"k", F.col("x")).alias("h")).collect()
    assert got[0]["s"] == "Ea J" and got[0]["t"]["folded"] == "ea i" and got[0]["t"]["search"] == "éa j" and len(got[0]["h"]) == 24
    assert got[1]["s"] is None and got[1]["t"]["search"] == "" and got[1]["h"] is None


def test_references(spark):
    df = spark.createDataFrame([("Hom. Il. XIV 3", "urn:cts:x:tlg0012.tlg001:1", "urn:ctsv2:lat.a.b:1.2", "Homer, Old (800-700)", "x/tlg0012"), (None, None, "none", "Plain", None)], "c string, u string, a string, n string, i string")
    got = df.select(
        references.normalize_citation(F.col("c")).alias("c"), references.urn_prefixes(F.col("u")).alias("u"), references.parse_address(F.col("a")).alias("a"),
        references.author_name(F.col("n")).alias("n"), references.canonical_author_id(F.lit("grc"), F.col("i"), F.col("n")).alias("i"),
    ).collect()
    assert got[0]["c"] == "hom.il.14.3" and got[0]["u"][0].endswith(":1") and len(got[0]["u"]) == 5 and got[0]["a"]["citation"] == "1.2"
    assert got[0]["n"] == "Old Homer" and got[0]["i"] == "tlg0012" and got[1]["i"] == "grc:plain" and got[1]["a"]["text_id"] is None


def test_morphology_and_glosses(spark):
    df = spark.createDataFrame([("masc nom sg, nom", "1) wolf; 2) a tap; wolf"), ("??", "")], "m string, g string")
    got = df.select(
        references.morph_features(F.col("m"), references.MORPH_CODES).alias("mm"), references.split_glosses(F.col("g")).alias("gg"),
        references.compact_gloss(F.col("g"), 6, 3).alias("s"), references.lemma_keys(F.lit("Ag-nih 2")).alias("k"),
    ).collect()
    assert got[0]["mm"] == {"gender": "masculine", "case": "nominative", "number": "singular"} and got[1]["mm"] == {}
    assert got[0]["gg"] == ["wolf", "a tap"] and got[0]["s"] == "wolf" and got[1]["gg"] == [] and "agnih2" in got[0]["k"]


def test_ranking(spark):
    df = spark.createDataFrame([(1, "see rex", "b"), (2, "king", "z"), (3, "king of 44", "a")], "id int, gloss string, source string")
    keys = {"source": ranking.preference_rank(F.col("source"), ["a", "b"]), "quality": ranking.rule_score(F.col("gloss"), ranking.LEARNER_RULES)}
    assert [r["id"] for r in ranking.explained(df, keys).orderBy("ranking").collect()] == [3, 1, 2]
    assert [r["gloss"] for r in df.orderBy(*ranking.candidate_key(F.lit("king"), F.col("gloss"))).collect()][:2] == ["king", "king of 44"]
    assert df.select(ranking.overlap_rank(F.array("source"), [["x"], ["b", "z"]])).collect()[0][0] == 2
    out = ranking.escalations(df, "source", "id", {"ref": F.col("gloss").startswith("see"), "num": F.col("gloss").rlike(r"\d")}, {"ref": 1, "num": 5}, 5)
    assert [(r["id"], r["priority"]) for r in out.collect()] == [(3, 5), (1, 1)]


def test_passages(spark):
    pages = spark.createDataFrame(
        [("b", 1, "CONTENTS\nFirst .... 2\nSecond thing .. 4\nno page", ""), ("b", 2, "Here amo and amo", "E1"), ("b", 3, "more", "E1"), ("b", 4, "Amo x", "E2"), ("b", 5, "end", "")],
        "book string, page int, text string, label string",
    )
    assert [r["s"] for r in pages.select(passages.section_of(F.col("text")).alias("s")).collect()] == ["contents"] + ["body"] * 4
    assert sorted(tuple(r) for r in passages.encounters(pages, "book", "page", F.col("label")).collect()) == [("b", "E1", 2, 3), ("b", "E2", 4, 5)]
    assert [(r["title"], r["to_page"]) for r in passages.contents_entries(pages, "book", "page", "text").collect()] == [("First", 2), ("Second thing", 4)]
    assert passages.mentions(pages, ["page"], "text", ["amo"], 2).count() == 3
    plan = passages.summary_plan(pages, ["book", "page"], "text", "m")
    assert plan.select("plan_id").distinct().count() == 5


def test_translation(spark):
    entries = spark.createDataFrame([("d", "1", 1, "rex"), ("d", "2", 1, "lex"), ("d", "3", 1, " ")], "source_lexicon string, entry_id string, occurrence int, source_text string")
    row = lambda e, text, status, at: (f"t{at}", "d", e, 1, text, "en", "m", status, f"T{at}", float(at))
    cache = spark.createDataFrame(
        [row("1", "rex", "ok", 1), row("1", "rex", "ok", 2), row("1", "old", "ok", 3), row("2", "lex", "error", 4)],
        "translation_id string, source_lexicon string, entry_id string, occurrence int, text string, target_lang string, model string, status string, translated_text string, updated_at double",
    ).withColumn("source_text_hash", F.sha2("text", 256))
    found = translation.project(entries, cache, "en", "m")
    assert {(r["entry_id"], r["translated_text"]) for r in found.collect()} == {("1", "T2"), ("2", None), ("3", None)}
    assert [r["entry_id"] for r in translation.missing(found).collect()] == ["2"] and tuple(translation.status_counts(found).first()) == (3, 1, 1, 1)
    buckets = spark.createDataFrame([("x",), ("y",), ("z",)], "bucket_id string")
    witnesses = spark.createDataFrame([("x", "p"), ("x", "p"), ("y", "p"), ("y", None), ("z", "p"), ("z", "q")], "bucket_id string, derived_bucket string")
    assert {(r["bucket_id"], r["behind"]) for r in translation.merge_translated(buckets, witnesses).collect()} == {("x", "p"), ("y", None), ("z", None)}


def test_dictionaries(spark):
    xml = "<H1><h><key1>agni</key1><key2>ag-ni</key2><hom>2</hom></h><body>fire &amp; <s>x</s>; see deva</body><tail><pc>5,1</pc></tail></H1>"
    raw = spark.createDataFrame([(1, xml), (2, "<bad"), (3, xml.replace("ag-ni", "agni").replace("agni", "deva"))], "n int, x string")
    entries = dictionaries.read_entries(raw, "n", "x").cache()
    one = entries.filter("entry_no = 1").first()
    assert (one["key"], one["second_key"], one["hom"], one["plain_text"], one["page_ref"]) == ("agni", "ag-ni", 2, "fire & x; see deva", "5,1")
    assert entries.filter("error IS NOT NULL").count() == 1
    good = entries.filter("error IS NULL")
    assert sorted(r["search_key"] for r in dictionaries.headwords(good).collect()) == ["ag-ni", "agni", "deva"]
    assert {(r["key"], tuple(r["references"])) for r in dictionaries.resolve_references(good, "key", "plain_text").collect()} == {("agni", ("deva",)), ("deva", ("deva",))}
    again = dictionaries.unique_entries(good.unionByName(good), "key", "plain_text", "entry_no")
    assert again.count() == 2
    paths = spark.createDataFrame([("w/a-eng.xml",), ("w/a-lat.xml",), ("v/b.xml",)], "path string")
    assert {r["path"] for r in dictionaries.book_sources(paths, ["-lat", "-eng"]).collect()} == {"w/a-lat.xml", "v/b.xml"}


def test_table_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    works = lambda *rows: spark.createDataFrame([(i, lang, t, o) for i, lang, t, o in rows], "work_id string, language string, title string, ord int")
    artifacts = spark.createDataFrame([("a1", "1"), ("a2", "2")], "artifact_id string, work_id string")
    assert store.version() == 0 and store.read("works").count() == 0
    store.register_works(works(("1", "en", "old", 1), ("1", "en", "new", 2), ("2", "de", "x", 1)), artifacts, "ord")
    assert {(r["work_id"], r["title"]) for r in store.read("works").collect()} == {("1", "new"), ("2", "x")}
    store.register_works(works(("2", "de", "y", 1)), artifacts.filter("work_id = '2'"))
    assert {(r["work_id"], r["title"]) for r in store.read("works").collect()} == {("1", "new"), ("2", "y")} and store.read("artifacts").count() == 2
    overlay = spark.createDataFrame([("work_id", "1", "title", "fixed", "accepted"), ("work_id", "2", "title", "no", "proposed")], "match_field string, match_value string, field string, value string, status string")
    store.append("metadata_overlays", overlay)
    assert [(r["old"], r["new"]) for r in store.apply_overlays("title", dry_run=True).collect()] == [("new", "fixed")]
    store.apply_overlays("title")
    assert store.apply_overlays("title", dry_run=True).count() == 0
    hits = spark.createDataFrame([("1", "la", 9), ("1", "en", 2), ("2", "la", 1)], "work_id string, language string, hits int")
    assert store.repair_languages(hits, 5).count() >= 0
    assert {(r["work_id"], r["language"]) for r in store.read("works").collect()} == {("1", "la"), ("2", "de")}
    store.delete_works(spark.createDataFrame([("1",)], "work_id string"))
    assert [r["work_id"] for r in store.read("works").collect()] == ["2"] and [r["work_id"] for r in store.read("artifacts").collect()] == ["2"]
    assert store.read("works", 1).count() == 2 and store.tables() == ["artifacts", "metadata_overlays", "works"]
    with pytest.raises(RuntimeError):
        stale = TableStore(spark, str(tmp_path / "s"))
        stale.version = lambda: 0
        stale.replace("works", works(("9", "x", "y", 1)))
    assert [r["work_id"] for r in store.read("works").collect()] == ["2"]


def test_a_change_rewrites_only_its_buckets(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    rows = spark.range(500).select(F.col("id").cast("string").alias("work_id"), F.lit("t").alias("title"))
    store.replace("works", rows)
    first = store.manifest()["works"]
    store.replace_keys("works", spark.createDataFrame([("7", "new"), ("1000", "more")], "work_id string, title string"), ["work_id"])
    second = store.manifest()["works"]
    assert 1 <= sum(first[b] != second[b] for b in first) <= 2
    assert store.read("works").count() == 501 and store.read("works").filter("title = 'new'").count() == 1
    for k in range(20):
        store.append("works", spark.createDataFrame([("7", f"again {k}")], "work_id string, title string"))
    assert store.read("works").count() == 521 and max(len(p) for p in store.manifest()["works"].values()) <= 18
    assert store.vacuum(1) > 0 and store.versions() == [store.version()] and store.read("works").count() == 521
    assert TableStore(spark, str(tmp_path / "empty")).vacuum() == 0


def test_tokens_compounds_and_concepts(spark):
    df = spark.createDataFrame([(1, "«Rāja-putra», eva!  ... x"), (2, None)], "id int, text string")
    found = tokens.tokenize(df, ["id"], "text")
    assert [(r["surface"], r["n_parts"]) for r in found.orderBy("token_no").collect()] == [("Rāja-putra", 2), ("eva", 1), ("x", 1)]
    assert [(r["part_no"], r["part"]) for r in tokens.compound_parts(found, ["id"]).orderBy("part_no").collect()] == [(0, "Rāja"), (1, "putra")]
    features = spark.createDataFrame([(1, {"case": "genitive", "number": "plural"})], "id int, features map<string,string>")
    concepts = spark.createDataFrame([("case", "genitive", "c1"), ("number", "plural", "c0"), ("case", "dative", "c9")], "feature string, value string, concept_id string")
    assert tokens.concepts_of(features, ["id"], concepts).first()["concept_ids"] == ["c0", "c1"]


def test_variants_and_lemma_keys(spark):
    assert scripts.expand_variants("sita", {"s": ["s", "ś"], "i": ["i", "ī"]}) == ["sita", "sīta", "śita", "śīta"]
    assert len(scripts.expand_variants("a" * 20, {"a": ["a", "ā"]}, 64)) == 64
    df = spark.createDataFrame([("lex:Kfzna#noun",), ("raamah",)], "x string")
    got = [r[0] for r in df.select(references.lemma_keys(F.col("x"))).collect()]
    assert {"kfzna#noun", "kfzna", "kfsna", "krzna"} <= set(got[0]) and {"raamah", "ramah", "raama", "rama"} <= set(got[1])
    told = df.select(scripts.variants_column({"a": ["a", "ā"]}, F.col("x"), 2).alias("v")).collect()
    assert told[1]["v"] == ["raamah", "raamāh"]


def test_expiring_cache():
    now, made = [0.0], []
    cache = ExpiringCache(2, 10, lambda: now[0])
    get = lambda k: cache.get(k, lambda: made.append(k) or k)
    get("a"), get("b"), get("a"), get("c")
    assert made == ["a", "b", "c"] and len(cache) == 2
    get("b")
    now[0] = 11
    get("b")
    assert made == ["a", "b", "c", "b", "b"]


def test_a_cut_leaves_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    found = lambda: {f for d in folders for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}
    before, set_before = found(), spark.conf.get(storage._CLEANUP)
    rows = storage.cut(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    end = time.monotonic() + 10
    while found() - before and time.monotonic() < end:  # files are deleted beside what goes on
        time.sleep(0.1)
    assert not found() - before
    assert rows.count() == 10 and spark.conf.get(storage._CLEANUP) == set_before


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "64k")
    try:
        store = TableStore(spark, str(tmp_path))
        store.replace("contained_works", spark.range(0, 20_000, 1, 8).select(F.lit("w").alias("parent_work_id"), F.sha2(F.col("id").cast("string"), 256).alias("contained_work_id")))
        assert len(list(tmp_path.glob("contained_works/*/bucket=*/*.parquet"))) > 1
        assert store.read("contained_works").distinct().count() == 20_000
    finally:
        spark.conf.set(size, before)
