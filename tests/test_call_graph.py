import pytest
from pyspark.sql import functions as F

from lectern.operators import call_graph as C
from lectern.operators.stages import HandlerRegistry

REQUESTS = "query_id string, language string, surface string, lemma string, spellings array<string>"


def registry(missing=(), empty=()):
    r = HandlerRegistry()
    for tool in {t for c in C.CHAINS for t in c.tools.split()} - set(missing):
        rows = (lambda rows: rows.filter("false")) if tool in empty else (lambda rows, tool=tool: rows.select("input_id", F.concat("payload", F.lit(">" + tool)).alias("payload")))
        r.register(tool, tool.split(".")[0], "v1")(rows)
    return r


def plans(spark):
    rows = [("1", "lat", "Lupum", "lupus", None), ("2", "grc", "λόγος", "λόγος", ["logos", "", "LOGOS", "lógos"]), ("3", "san", None, "agni", ["agni", "agnī"]), ("4", "eng", "x", "x", []), ("5", "lat", "a", None, None)]
    return C.plan_graph(spark.createDataFrame(rows, REQUESTS))


def test_calls_of_three_languages(spark):
    calls = {(r["query_id"], r["call_id"]): r for r in plans(spark).collect()}
    assert sum(q == "1" for q, _ in calls) == 24 and not any(q == "4" for q, _ in calls)
    assert calls["1", "whitakers-fetch-1"]["asked"] == "lupum" and ("2", "surface-fetch-1") not in calls
    assert calls["3", "heritage-fetch-1"]["optional"] is False and calls["3", "heritage-fetch-2"]["optional"] is True and calls["3", "heritage-fetch-2"]["asked"] == "agnī"
    assert [calls["2", f"strongs_greek-fetch-{k}"]["asked"] for k in (1, 2)] == ["logos", "lógos"] and ("2", "strongs_greek-fetch-3") not in calls
    assert calls["2", "cts-fetch-1"]["source"] == "citation-derive-1" and calls["2", "citation-derive-1"]["source"] == "diogenes-extract-1"
    assert calls["2", "cts-claim-1"]["source"] == "cts-derive-1" and calls["5", "whitakers-fetch-1"]["asked"] == "a"


def test_a_call_runs_after_its_source(spark):
    states, outputs = C.run_graph(plans(spark), registry())
    rounds = {(r["query_id"], r["call_id"]): r["round"] for r in states.collect()}
    assert {r["status"] for r in states.collect()} == {"done"} and rounds["2", "cts-claim-1"] == 7 and rounds["2", "citation-derive-1"] == 3 and rounds["1", "diogenes-claim-1"] == 4
    told = {(r["query_id"], r["call_id"]): r["payload"] for r in outputs.collect()}
    assert told["1", "gaffiot-claim-1"] == "lupus>fetch.gaffiot>extract.gaffiot.json>derive.gaffiot.entries>claim.gaffiot.entries"
    assert told["2", "cts-fetch-1"].endswith("derive.diogenes.citation>fetch.cts_index")


def test_skipped_calls_tell_why(spark):
    states, outputs = C.run_graph(plans(spark), registry(missing=["extract.cltk.lexicon", "fetch.diogenes"], empty=["derive.gaffiot.entries"]))
    told = {(r["query_id"], r["call_id"]): (r["status"], r["reason"]) for r in states.collect()}
    assert told["1", "cltk-fetch-1"] == ("done", None) and told["1", "cltk-extract-1"] == ("skipped", "missing_handler_extract")
    assert told["1", "cltk-derive-1"] == ("skipped", "missing_source_derive") and told["1", "cltk-claim-1"] == ("skipped", "missing_source_claim")
    assert told["1", "diogenes-fetch-1"] == ("failed", "missing_handler_fetch") and told["2", "cts-claim-1"] == ("skipped", "missing_source_claim")
    assert told["1", "gaffiot-derive-1"] == ("done", None) and told["1", "gaffiot-claim-1"] == ("skipped", "missing_source_claim")
    of = {r["query_id"]: r for r in C.plan_states(states).collect()}
    assert of["1"]["failed"] and not of["3"]["failed"] and of["3"]["skipped"] == 0 and of["1"]["done"] + of["1"]["skipped"] == 23
    assert outputs.filter("call_id LIKE 'cts%'").count() == 0


def test_further_links_and_circles(spark):
    chains = [C.Chain("x", "a", "fetch.dico extract.dico.json"), C.Chain("x", "b", "fetch.dico")]
    calls = C.plan_graph(spark.createDataFrame([("1", "x", "s", "l", None)], REQUESTS), chains)
    after = spark.createDataFrame([("1", "a-extract-1", "b-fetch-1"), ("1", "gone", "a-fetch-1")], "query_id string, from_call string, to_call string")
    rounds = {r["call_id"]: r["round"] for r in C.run_graph(calls, registry(), after)[0].collect()}
    assert rounds == {"a-fetch-1": 1, "a-extract-1": 2, "b-fetch-1": 3}
    circle = spark.createDataFrame([("1", "a-extract-1", "a-fetch-1")], "query_id string, from_call string, to_call string")
    with pytest.raises(RuntimeError):
        C.run_graph(calls, registry(), circle)
    states, outputs = C.run_graph(calls.limit(0), registry())
    assert states.count() == outputs.count() == 0


def test_a_round_joins_what_is_left_once(spark, monkeypatch):
    told, cut = [], C.cut
    calls = cut(plans(spark))
    monkeypatch.setattr(C, "cut", lambda df: told.append(df._jdf.queryExecution().executedPlan().toString().count("Join ")) or cut(df))
    states, _ = C.run_graph(calls, registry())
    rounds = states.agg(F.max("round")).first()[0]
    # one for the sources that are there, and a round's for what is left and for what is given; the states need none
    assert rounds == 7 and told[-1] == 0 and 0 < sum(told) <= 2 * rounds + 1, told
