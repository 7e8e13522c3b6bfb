import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import scans


def plain_states(rows, table, start=0):
    out, state = [], {}
    for k, o, a in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        s = state.get(k, start)
        if a is not None and 0 <= a < len(table[s]):
            s = table[s][a]
        state[k] = s
        out.append((k, o, s))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part", [1, 3, 512])
def test_any_split_gives_the_same_states_and_counts(spark, monkeypatch, part):
    monkeypatch.setattr(scans, "PART", part)
    rng = random.Random(part)
    table = [[1, 0, 2], [2, 1, 0], [0, 2, 2]]
    rows = [(rng.choice([None, 1, 2, 2, 2]), i, rng.choice([0, 1, 2, 2, None, 7])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, o int, a int").repartition(5)
    at = scans.placed(df, ["k"], ["o"])
    got = sorted(((r["k"], r["o"], r["state"]) for r in scans.states(at, ["k"], "a", table, 1).collect()), key=repr)
    assert got == plain_states(rows, table, 1)
    sums, expected = {}, []
    for k, o, a in sorted(rows, key=lambda r: r[1]):
        sums[k] = sums.get(k, 0) + (a or 0)
        expected.append((k, o, sums[k]))
    counted = scans.counts(at, ["k"], {"n": F.col("a"), "rows": F.lit(1)})
    assert sorted(((r["k"], r["o"], r["n"]) for r in counted.collect()), key=repr) == sorted(expected, key=repr)
    assert counted.agg(F.max("rows")).first()[0] == max(sum(r[0] == k for r in rows) for k in (None, 1, 2))
    assert scans.states(scans.placed(df.limit(0), ["k"], ["o"]), ["k"], "a", table).count() == 0


def test_titles_over_lines(spark):
    lines = ["noise 9", "1. one ... 3", "noise", "2. two", "goes on", "to its end .. 5", "3. three", "4. four .... 7", "after .... 8", "5. five"]
    df = spark.createDataFrame([("b", i, t) for i, t in enumerate(lines)] + [("c", 0, "no entry .. 4")], "book string, i int, t string")
    got = [tuple(r)[1:] for r in scans.toc_entries(df, ["book"], ["i"], "t", r"^(\d+)\.\s", r"\s*\.{2,}\s*(\d+)").orderBy("entry_no").collect()]
    assert got == [(1, "1", "one", "3"), (2, "2", "two goes on to its end", "5"), (3, "3", "three", None), (4, "4", "four", "7"), (5, "5", "five", None)]
