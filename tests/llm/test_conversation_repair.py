import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import conversation_repair, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        told = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{told[0]}:{told[1]}".encode()) % 20
        role, text = told[2:]
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_repair(rows):
    """Dijkstra over (cost, audit) for one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            break
        for role in ("user", "assistant"):
            if (state, role[0]) in legal:
                heapq.heappush(heap, (cost + 5, audit + "I", at, role[0], (*out, f"{role}:")))
        if at == len(rows):
            continue
        _, role, text = rows[at]
        heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, out))
        if faults[at] in ("blank", "duplicate"):
            continue
        more = 5 if faults[at] == "truncated" else 0
        if (state, role[:1]) in legal:
            heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[0], (*out, f"{role}:{text}")))
        for other in ("user", "assistant"):
            if (state, other[0]) in legal:
                heapq.heappush(heap, (cost + more + 1, audit + "R", at + 1, other[0], (*out, f"{other}:{text}")))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return {
        "gaps": gaps,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(),
    }


def by_conversation(rows):
    groups = defaultdict(list)
    for conv, *rest in rows:
        groups[conv].append(tuple(rest))
    return groups


def summarised(df):
    found = conversation_repair.summaries(conversation_repair.repair(df), lambda said: F.sha2(said, 256)).withColumnRenamed("digest", "repaired_sha256")
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in found.collect()}


def invented(rng, conversations, longest):
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][t % 2]
            role = rng.choice(["system", "tool", "", "student"]) if rng.random() < 0.15 else role
            text = rng.choice(["Yes.", "No", "Hm! \n", " \t", "", "a b?", f"text {rng.random()}.", f"long {rng.random()}"])
            rows.append((c, None if rng.random() < 0.05 else rng.randint(0, 2 * longest), role, text))
    return rows


def plain_turns(rows):
    return [(c, t, r or "", x or "") for c, t, r, x in rows]


@pytest.mark.parametrize("longest", [4, 12, 40])
def test_against_shortest_paths(spark, longest):
    rng = random.Random(longest)
    rows = invented(rng, 150, longest)
    got = summarised(spark.createDataFrame(rows, SCHEMA).repartition(3))
    expected = {c: plain_repair(r) for c, r in by_conversation(rows).items()}
    assert got == expected


def test_conversations_in_many_pieces(spark):
    """Batches of 7 rows and many ranges cut almost every conversation; the result is the same."""
    rng = random.Random(5)
    rows = invented(rng, 12, 120) + [(99, t, "user", f"{t}.") for t in range(400)] + [(98, 1, "user", "Same.")] * 60
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        pieces = conversation_repair.repair(df)
        assert pieces.groupBy("conv_id").count().filter("count > 10").count() >= 5
        got = summarised(df)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {c: plain_repair(r) for c, r in by_conversation(rows).items()}


def test_matrices_multiply():
    rng = np.random.default_rng(0)
    final = conversation_repair.FINAL
    for n in (2, 3, 5, 9):
        codes = rng.integers(0, 16, (n, 50))
        whole = (conversation_repair.transfers(codes) + final).min(axis=2)
        for k in range(1, n):
            ends = (conversation_repair.transfers(codes[k:]) + final).min(axis=2)
            assert ((conversation_repair.transfers(codes[:k]) + ends[:, None, :]).min(axis=2) == whole).all()


def test_awkward_rows_and_other_columns(spark):
    rows = [
        (1, 0, None, None), (1, 1, "user", "x" * 100_000 + "."), (1, 2, "assistant", "Well."), (2, None, "user", "Hi."), (2, None, "user", "Hi."),
        (None, 0, "user", "One."), (None, 1, "assistant", "Two."), (3, -(2**62), "user", "a."), (3, 2**62, "assistant", "b."), (4, 5, "système", "é!"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("piece", "copy", "code", "hash", "first", "copies", "edge", "audit", "lane"):
        df = df.withColumn(name, F.lit(7))
    got = summarised(df)
    expected = {c: plain_repair(r) for c, r in by_conversation(plain_turns(rows)).items()}
    expected[3]["gaps"] = None  # beyond 64 bits: 2^63 - 1
    assert expected[None]["audit"] == "KK" and got[3].pop("gaps") in (None, 2**63 - 1)
    expected[3].pop("gaps")
    assert got == expected
    assert summarised(df.limit(0)) == {}


def test_query(spark, sf_dir, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in queries.op12_conversation_repair(spark, sf_dir).collect()}
    assert got == query_expected(rows)
    # every fault, nulls in any column, and conversations that lose all rows
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(6)]), rng.choice([None, "user", "assistant", "system"]), rng.choice([None, "a.", "b? c", "d! "])) for _ in range(150)]
    rows = list(dict.fromkeys(rows)) + [(1000 + i, 0, "user", "One.") for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == query_expected(rows) and any(not x["audit"] for x in got.values())
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.op12_conversation_repair(spark, f"{tmp_path}/none").count() == 0


def query_expected(rows):
    nothing = {**dict.fromkeys("gaps blank duplicate truncated illegal cost".split(), 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    found = {c: plain_repair(r) for c, r in by_conversation(plain_damage(rows)).items()}
    return {c: found.get(c, nothing) for c in {r[0] for r in rows}}
