import hashlib
import hmac
import sqlite3

import pytest
from pyspark.sql import functions as F

from lectern import storage
from lectern.functions import scripts
from lectern.operators import claims, morphology, search
from lectern.sources import catalog_readers as C
from lectern.sources import enrichment as E
from lectern.sources import tool_answers


def test_files_that_cannot_be_read_give_their_error(spark):
    files = spark.createDataFrame([("/a.xml", "<TEI><text><body><l n='1'>x</l></body></text></TEI>"), ("/b.xml", "<TEI"), ("/c.xml", ""), ("/d.xml", None)], "path string, content string")
    rows = {r["path"]: r for r in C.read(files, C.tei).collect()}
    assert rows["/a.xml"]["text"] == "x" and rows["/a.xml"]["error"] is None
    assert all(rows[p]["error"] for p in ("/b.xml", "/c.xml", "/d.xml"))
    assert C.catalog_tables(C.read(files, C.tei), "t", "tei")["works"].count() == 1
    assert C.read(files.limit(0), C.tei).count() == 0
    bad = spark.createDataFrame([("/x", "[1, 2"), ("/y", '{"verses": [{"text": null}, "plain verse"]}')], "path string, content string")
    got = {(r["path"], r["text"], r["error"] is None) for r in C.read(bad, C.verse_json).collect()}
    assert got == {("/x", None, False), ("/y", "plain verse", True)}


def test_natural_order_and_stems(spark):
    df = spark.createDataFrame([("/b/ch10.txt",), ("/b/ch2.txt",), ("/b/ch1.tar.gz",)], "path string")
    assert [r["path"] for r in df.orderBy(C.natural(F.col("path"))).collect()] == ["/b/ch1.tar.gz", "/b/ch2.txt", "/b/ch10.txt"]
    assert [r[0] for r in df.select(C.stem(F.col("path"))).collect()] == ["ch10", "ch2", "ch1.tar"]


def test_bookmarks_of_dumps():
    raw = bytes([0xEF, 0x81, 0xB1, 0xFF, 0x93, 0x81]) + b"one" + bytes([0x80]) + b"two" + bytes([0x90, 0x81]) + b"new chapter" + bytes([0x8F]) + b"\xe1\xe2\xff" + b"by name"
    raw += bytes([0x8B, 0x81, 0x80]) + b"large" + bytes([0x89, 0x85, 0xE1]) + b"letter" + bytes([0xFE]) + b"junk" * 4000
    found = list(C.decode_dump(raw))
    assert [(x.get("y"), x.get("z"), t) for x, t in found[:6]] == [
        ("3", "1", "one"), ("3", "2", "two"), ("4", "1", "new chapter"), ("4", "ab", "by name"), ("4", "128", "large"), ("4", "5a", "letter"),
    ]
    assert all(x["work"] == "1" for x, _ in found) and list(C.decode_dump(b"")) == [] and C.decode_index(b"") == []


def test_broken_dumps_give_their_error(spark):
    files = spark.createDataFrame([("/d", bytearray(b"\x88"))], "path string, content binary")
    assert C.read_dumps(files).first()["error"].startswith("IndexError")


def test_databases_and_facets(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "x.db")
    db.execute("CREATE TABLE t (a INTEGER, b TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?)", [(1, "x"), (2, None)])
    db.commit()
    db.close()
    files = spark.read.format("binaryFile").load(str(tmp_path / "x.db"))
    assert [tuple(r) for r in E.database_rows(files, "SELECT a, b FROM t ORDER BY a", "a bigint, b string").collect()] == [(1, "x"), (2, None)]
    assert E.number_key("h0012a") == "H12" and E.number_key("") == ""


def test_answers_that_have_another_shape_give_no_triple(spark):
    rows = spark.createDataFrame([("1", None), ("2", "not json"), ("3", "[]"), ("4", "{}")], "call_id string, payload string")
    for tool in claims.MAKERS:
        assert claims.tool_triples(rows, tool).count() == 0
    assert tool_answers.parse_word_list("") == {"wordlist": []} and tool_answers.parse_word_list("no words here")["wordlist"] == []
    one = tool_answers.parse_word_list("am.o   V 1 1 PRES ACTIVE IND 1 S\namo, amare, amavi, amatus  V (1st)   [XXXAO]\nlove; like;")["wordlist"][0]
    assert one["lemma"] == "amo" and one["conjugation"] == "1" and one["senses"] == ["love", "like"]
    assert one["terms"][0] == {"term": "amo", "tense": "present", "voice": "active", "mood": "indicative", "person": "first", "number": "singular"}


def test_no_triples_no_candidates(spark):
    none = spark.createDataFrame([], "query string, ord int, subject string, predicate string, object string, source string")
    assert morphology.candidates(none).count() == 0
    asked = spark.createDataFrame([("x",)], "query string")
    assert morphology.paradigm_requests(asked, morphology.candidates(none)).first()["reason"] == "no_grammar_evidence"


def test_searches_of_little(spark, tmp_path):
    segments = spark.createDataFrame([("w", "1", 1, "Arma virumque cano"), ("w", "2", 2, None), ("w", "3", 3, "ARMA, arma!"), ("gone", "4", 1, "arma")], "work_id string, segment_id string, sort_key int, text string")
    works = spark.createDataFrame([("w", "lat", "A")], "work_id string, language string, title string")
    search.build_index(search.search_rows(segments, works), str(tmp_path / "i"))
    index = search.Index(spark, str(tmp_path / "i"))
    assert index.issues().count() == 0 and index.rows.count() == 3
    ids = lambda df: [r["segment_id"] for r in df.collect()]
    assert ids(search.search(index, "arma")) == ["3", "1"] and ids(search.search(index, "arma", limit=1, offset=1)) == ["1"]
    assert ids(search.search(index, "arma cano", mode="all")) == ["1"] and ids(search.search(index, "arma uirumque", mode="fuzzy", filters={"language": "lat"})) == ["1"]
    assert ids(search.search(index, "virumque cano", mode="phrase", context=1)) == ["1"] and ids(search.search(index, "cano virumque", mode="phrase")) == []
    assert ids(search.search(index, "", mode="words")) == [] and ids(search.search(index, "zzz")) == []
    assert search.query_candidates("ivlia", "lat")[:2] == [["ivlia"], ["ivlja"]] and search.query_candidates("", "lat") == []


def test_hashes_and_folders(spark, monkeypatch):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    got = [r[0] for r in df.select(scripts.hmac_hex(b"secret", F.col("x"))).collect()]
    assert got == [hmac.new(b"secret", b"a", hashlib.sha256).hexdigest()[:24], None]
    assert storage._local("local") and storage._local("local[4]") and not storage._local("local-cluster[2,1,1024]") and not storage._local("yarn")

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        storage.shared_dir(Session())
