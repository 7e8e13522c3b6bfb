"""Readers and sinks on small files, and the rollup as a stream."""

import json

from pyspark.sql import functions as F

from lectern.operators.dml import merge_counts
from lectern.sources import sinks, text_formats
from lectern.streaming import rollup

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><titleStmt><title>Song</title><author>Bard</author></titleStmt></teiHeader>
<text><body><div type="edition" n="urn:x"><div type="textpart" n="1"><l n="1">first line</l><l n="3">third <hi>line</hi></l></div>
<div type="textpart" n="2"><l n="1">other &c;</l></div></div></body></text></TEI>"""
CONLLU = "## text: Hymns\n## author: Seer\n# sent_id = 1.1\n# text = agnim ile\n1\tagnim\tagni\n2\tile\tid\n\n# sent_id = 1.2\n1\tx\ty\n1-2\txy\t_\n\n"


def test_readers(spark, tmp_path):
    (tmp_path / "a.xml").write_text(TEI)
    (tmp_path / "b.xml").write_text("<broken")
    (tmp_path / "c.conllu").write_text(CONLLU)
    (tmp_path / "d.txt").write_text("Title: Plain\nAuthor: Me\n1.1 | one\n\n1.2 | two\n")
    (tmp_path / "e.json").write_text(json.dumps({"text": "V", "author": "K", "lines": [[{"w": "a"}, {"w": "b"}], [{"w": "c"}]]}))
    tei = {(r["citation"], r["text"]) for r in text_formats.read_tei(spark, str(tmp_path)).collect() if r["error"] is None}
    assert tei == {("1.1", "first line"), ("1.3", "third line"), ("2.1", "other &c;")}
    assert text_formats.read_tei(spark, str(tmp_path)).filter("error IS NOT NULL").count() == 1
    con = [(r["work_title"], r["citation"], r["text"]) for r in text_formats.read_conllu(spark, str(tmp_path)).orderBy("sort_key").collect()]
    assert con == [("Hymns", "1.1", "agnim ile"), ("Hymns", "1.2", "x")]
    plain = [(r["work_title"], r["citation"], r["text"]) for r in text_formats.read_plain(spark, str(tmp_path)).orderBy("sort_key").collect()]
    assert plain == [("Plain", "1.1", "one"), ("Plain", "1.2", "two")]
    assert [r["text"] for r in text_formats.read_verse_json(spark, str(tmp_path)).orderBy("sort_key").collect()] == ["a b", "c"]


def test_tables_and_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,name\n1,"a, b"\n2,\n')
    assert [tuple(r) for r in text_formats.read_table_text(spark, str(tmp_path / "t.csv"), "id int, name string").orderBy("id").collect()] == [(1, "a, b"), (2, None)]
    (tmp_path / "t.jsonl").write_text('{"a": 1}\nnot json\n')
    got = text_formats.read_jsonl(spark, str(tmp_path / "t.jsonl"), "a int").collect()
    assert sorted((r["a"] is None, r["_corrupt"] is None) for r in got) == [(False, True), (True, False)]
    lines = spark.createDataFrame([("| Id | Name |",), ("|---|---|",), ("| 1 | x |",), ("text",)], "value string")
    assert [tuple(r) for r in text_formats.read_markdown_table(lines, ["id", "name"]).collect()] == [("1", "x")]
    wide = spark.createDataFrame([("ab  12",)], "value string")
    assert tuple(text_formats.read_fixed_width(wide, {"w": (1, 4), "n": (5, 2)}).first()) == ("ab", "12")


def test_html(spark):
    html = '<html lang="la"><head><title>T &amp; U</title><script>var x="<p>"</script></head><body><a href="/x">go</a> <p>on</p></body></html>'
    r = text_formats.parse_html(spark.createDataFrame([(1, html), (2, None)], "k bigint, h string"), "k", "h").orderBy("k").collect()
    assert (r[0]["title"], r[0]["lang"], r[0]["n_links"], r[0]["body_text"]) == ("T & U", "la", 1, "go on") and r[1]["body_text"] == ""


def test_bundle(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    sinks.write_bundle({"t": df, "u": df.limit(0)}, str(tmp_path / "b"))
    assert sinks.bundle_issues(spark, str(tmp_path / "b")).count() == 0
    df.limit(9).write.mode("overwrite").parquet(str(tmp_path / "b" / "t"))
    assert [tuple(r) for r in sinks.bundle_issues(spark, str(tmp_path / "b")).collect()] == [("t", "row-count")]
    sinks.write_delimited(df.withColumn("a", F.array("x")), str(tmp_path / "d"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "d")).count() == 10


def test_rollup_streams_like_a_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(5).write.parquet(str(tmp_path / "in"))
    roll = lambda df: rollup.minute_rollup(df, "ts", ["event_type"], F.col("event_id") % 7, {"even": F.col("event_id") % 2 == 0})
    state = {}

    def write(df, batch_id):
        rows = df.collect()
        state["now"] = spark.createDataFrame(rows, df.schema)
        state["id"] = batch_id

    keys, sums = ["window_start", "event_type"], ["requests", "cost", "even"]
    merge = rollup.merge_into(keys, sums, ["second_bits"], lambda: state.get("now"), write)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(lambda b, i: merge(roll(b), i)).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    columns = [*keys, *sums, "second_bits"]
    told = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert told(state["now"]) == told(roll(events)) and state["id"] > 0
    assert told(merge_counts(roll(events), roll(events).limit(0), keys, sums, ["second_bits"])) == told(roll(events))


def test_curated_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"alias": "x", "evidence": [{"label": "l"}]}, {"alias": "y"}]))
    (tmp_path / "b.json").write_text(json.dumps({"alias": "z"}))
    got = text_formats.read_curated(spark, str(tmp_path), "alias string, evidence array<struct<label:string>>")
    assert sorted((r["alias"], len(r["evidence"] or [])) for r in got.collect()) == [("x", 1), ("y", 0), ("z", 0)]


def test_watermarked_rollup(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.filter("event_id < 500").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = rollup.watermarked_rollup(stream, "ts", ["event_type"], F.col("event_id") % 7, "1 hour", "0 seconds")
    q = out.writeStream.format("memory").queryName("rolled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("rolled").collect()}
    batch = rollup.minute_rollup(events.filter("event_id < 500"), "ts", ["event_type"], F.col("event_id") % 7, {}, 3600)
    every = {(r["window_start"], r["event_type"], r["requests"], r["cost"]) for r in batch.collect()}
    assert got and got <= every and len(every - got) <= 5  # the last window is still open
