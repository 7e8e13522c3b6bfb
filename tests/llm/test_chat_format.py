import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import chat_format as C
from lectern.llm import queries
from tests.compare import oracle_rows, spark_rows

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string, ts int, runs int"


def digests(turns):
    told = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), sha(told), len(loss), sha(loss)


def read_back(spark, rows):
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    out = C.format_conversations(df)
    got = {}
    for r in out.select(
        "conv_id", "formatted", C.read_turns(F.col("formatted")).alias("turns"), C.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")
    ).collect():
        got[r["conv_id"]] = (r["formatted"], [(t["role"], t["text"]) for t in r["turns"]], r["loss"])
    return got


def test_merging_and_awkward_rows(spark):
    rows = [
        (1, 2, "assistant", "b</s>[NEXT]\\$1"),
        (1, 0, "user", "a"),
        (1, 1, "user", "[INST] <s>[~INST][~~ROLE]"),
        (1, 3, "assistant", ""),
        (2, None, None, None),
        (3, 0, "assistant", "x"),
        (3, 0, "assistant", "x"),
        (None, 5, "user", "no id\n"),
        (4, 0, "[/ROLE]<s>", "role is control"),
    ]
    got = read_back(spark, rows)
    assert got[1][1] == [("user", "a"), ("user", "[INST] <s>[~INST][~~ROLE]"), ("assistant", "b</s>[NEXT]\\$1"), ("assistant", "")]
    assert got[1][0].count(C.OPEN) == 2 and got[1][2] == "b</s>[NEXT]\\$1"
    assert got[2][1] == [("", "")] and got[2][2] == ""
    assert got[3][1] == [("assistant", "x")] * 2 and got[3][2] == "xx"
    assert got[None][1] == [("user", "no id\n")] and got[4][1] == [("[/ROLE]<s>", "role is control")]
    assert read_back(spark, []) == {}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), st.text(alphabet="<s>/[]~INSTROLEXT \n\\$é😀", max_size=25)), min_size=1, max_size=6), min_size=1, max_size=6))
def test_round_trip(spark, conversations):
    rows = [(c, t, role, text) for c, turns in enumerate(conversations) for t, (role, text) in enumerate(turns)]
    got = read_back(spark, rows)
    for c, turns in enumerate(conversations):
        assert got[c][1] == turns and got[c][2] == "".join(t for r, t in turns if r == "assistant")


def test_query(spark, sf_dir):
    turns = {-1: [("user", queries.PROBE), ("assistant", queries.PROBE)]}
    for r in sorted(spark.read.parquet(f"{sf_dir}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    got = {r["conv_id"]: r for r in queries.op4_chat_format(spark, sf_dir).collect()}
    assert got.keys() == turns.keys()
    for c, t in turns.items():
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == digests(t)


def test_query_equals_sql(spark, sf_dir):
    assert spark_rows(queries.op4_chat_format(spark, sf_dir)) == oracle_rows(queries.ORACLES["op4_chat_format"], sf_dir)


def test_a_very_long_conversation(spark):
    """Work that grew with the square of the turns would take many minutes here."""
    rows = spark.range(30_000).select(
        F.lit(1).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("text "), F.col("id")).alias("text"),
    )
    out = C.format_conversations(rows).select(
        C.read_turns(F.col("formatted")).alias("turns"), C.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )
    r = out.select(F.size("turns").alias("n"), F.sha2("loss", 256).alias("loss")).collect()[0]
    spoken = "".join(f"text {i}" for i in range(1, 30_000, 2))
    assert (r["n"], r["loss"]) == (30_000, hashlib.sha256(spoken.encode()).hexdigest())


def test_ties_stand_by_what_is_said(spark):
    """``[INST]`` is escaped with a tilde, which sorts behind what follows it here."""
    rows = [(1, 0, "user", t) for t in ("[INST] b", "[INST}", "[INST]", "<s> x", "<s>")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = C.format_conversations(df).select(C.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [x["text"] for x in out] == sorted(t for *_, t in rows)
