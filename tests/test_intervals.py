import random

import pytest

from lectern.operators import graph, intervals, windows


@pytest.mark.parametrize("most", [3, 40, 10**6, 10**15, 2**62])
def test_places_in_intervals_of_any_length(spark, most):
    rng = random.Random(most)
    place = lambda: rng.choice([rng.randint(-most, most), rng.randint(-5, 5), most, -most])
    rows = [(i, rng.randint(0, 2), place()) for i in range(150)] + [(900, 1, None), (901, None, 0)]
    found = []
    for j in range(60):
        a, b = sorted((place(), place()))
        found.append((j, rng.randint(0, 2), *rng.choice([(a, b), (a, a), (b, a), (a, min(a + 3, most))])))
    found += [(70, 1, None, 5), (71, 1, 0, None), (72, None, -most, most)]
    got = intervals.places_in(
        spark.createDataFrame(rows, "i int, k int, p bigint"), spark.createDataFrame(found, "j int, k int, s bigint, e bigint"), ["k"], "p", "s", "e"
    )
    expected = sorted((i, j) for i, k, p in rows for j, l, s, e in found if None not in (k, l, p, s, e) and k == l and s <= p <= e)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == expected


def test_an_interval_takes_few_bins(spark):
    df = spark.createDataFrame([(-1, 10**15), (7, 7), (0, 4**20 - 1), (5, 4)], "s bigint, e bigint")
    levels = intervals._levels(df, "s", "e")
    own = df.select("s", "e", intervals._own_bins(df["s"], df["e"], levels).alias("bins")).collect()
    assert levels == 26 and [len(r["bins"] or []) for r in own][1:] == [1, 1, 0] and len(own[0]["bins"]) <= 6 * levels
    for r in own:  # the bins are the interval, each place once
        spans = sorted((b["_bin"] * 4 ** b["_level"], (b["_bin"] + 1) * 4 ** b["_level"] - 1) for b in r["bins"] or [])
        assert all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert not spans or (spans[0][0], spans[-1][1]) == (r["s"], r["e"])


def test_no_nested_loop(spark):
    rows, found = spark.range(5).selectExpr("1 AS k", "id AS p"), spark.range(5).selectExpr("1 AS k", "id AS s", "id + 1000000000 AS e")
    plan = intervals.places_in(rows, found, ["k"], "p", "s", "e")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_short_bins_follow_the_places(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, rng.randint(0, 10**12)) for i in range(200)] + [(200 + i, 1, 7 * 10**11 + i) for i in range(300)]
    found = [(j, j % 2, s := rng.choice([rng.randint(0, 10**12), 7 * 10**11 + rng.randint(0, 300)]), s + rng.choice([-1, 0, 5, 10**9, 10**11])) for j in range(80)]
    df, spans = spark.createDataFrame(rows, "i int, k int, p bigint"), spark.createDataFrame(found, "j int, k int, s bigint, e bigint")
    assert intervals._shortest_bits(df.filter("i < 200"), ["k"], "p") > 24  # spread out: bins of hours, not of microseconds
    assert intervals._shortest_bits(df, ["k"], "p") < 4  # the crowd isn't one bin
    for part in (df.filter("i < 200"), df):
        got = intervals.places_in(part, spans, ["k"], "p", "s", "e")
        expected = sorted((r["i"], j) for r in part.collect() for j, k, s, e in found if r["k"] == k and s <= r["p"] <= e)
        assert sorted((r["i"], r["j"]) for r in got.collect()) == expected


def test_small_files_are_not_broadcast(spark, tmp_path):
    spark.range(50).selectExpr("1 AS k", "id * 1000000 AS p").write.parquet(f"{tmp_path}/rows")
    spark.range(50).selectExpr("1 AS k", "id AS s", "id + 1000000000 AS e").write.parquet(f"{tmp_path}/found")
    rows, found = spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/found")
    held = intervals.places_in(rows, found, ["k"], "p", "s", "e")
    assert held.count() == 2500 - 49 and "Broadcast" not in held._jdf.queryExecution().executedPlan().toString()


def test_overlaps(spark):
    rng = random.Random(4)
    some = lambda n: [(i, rng.randint(0, 1), s := rng.randint(0, 300), s + rng.choice([-1, 0, 1, 7, 100])) for i in range(n)]
    one, two = some(60), some(50)
    schema = "i int, k int, s bigint, e bigint"
    got = intervals.overlapping(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema), ["k"], "s", "e")
    assert got.columns == ["i", "k", "s", "e", "other_i", "other_s", "other_e"]
    expected = sorted((a[0], b[0]) for a in one for b in two if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3] and a[2] <= a[3] and b[2] <= b[3])
    assert sorted((r["i"], r["other_i"]) for r in got.collect()) == expected


def test_rows_without_a_span_stay(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 50, "b"), (2, 5, "c"), (1, None, "d"), (1, 5, "a")], "k int, p bigint, x string")
    found = spark.createDataFrame([(1, 1, 9), (1, 4, 10**12)], "k int, span_start bigint, span_end bigint")
    got = sorted(map(tuple, windows.in_spans(rows, found, ["k"], "p").collect()), key=repr)
    assert got == sorted([(1, 5, "a", 1, 9)] * 2 + [(1, 5, "a", 4, 10**12)] * 2 + [(1, 50, "b", 4, 10**12), (2, 5, "c", None, None), (1, None, "d", None, None)], key=repr)


def test_trees_of_any_depth(spark):
    rows = [(i, i - 1 if i else None) for i in range(300)] + [(1000, None), (1001, 1000), (1002, 1000), (5000, 4999), (5001, 5000), (6000, 6001), (6001, 6000), (6002, 6001)]
    got = {r["n"]: (r["p"], r["level"], r["path"]) for r in graph.trees(spark.createDataFrame(rows, "n int, p int"), "n", "p").collect()}
    assert len(got) == 303 and got[299] == (298, 299, ".".join(map(str, range(300)))) and got[1002] == (1000, 1, "1000.1002") and got[0] == (None, 0, "0")
    assert graph.trees(spark.createDataFrame([], "n int, p int"), "n", "p").count() == 0


def test_chains_circles_and_gaps(spark):
    links = [(i, i + 1) for i in range(100, 300)] + [(300, None), (1, 2), (2, 3), (3, 1), (7, 7), (8, 99), (9, 10), (11, 10), (10, None), (20, 21), (21, 22), (22, 21)]
    rows = spark.createDataFrame(links, "a int, b int")
    found = graph.chains(rows, "a", "b")
    got = {r["node"]: (r["head"], r["place"], r["length"], r["circle"]) for r in found.collect()}
    assert len(got) == len({a for a, _ in links})
    assert got[100] == (100, 0, 201, False) and got[300] == (100, 200, 201, False) and got[8] == (8, 0, 1, False)
    assert [got[i] for i in (1, 2, 3)] == [(1, i, 3, True) for i in range(3)] and got[7] == (7, 0, 1, True)
    assert got[10] == (9, 1, 2, False) and got[11] == (11, 0, 1, False)  # the smaller one's link counts
    seeds = spark.createDataFrame([(3,), (299,), (8,), (7,), (150,)], "a int")
    steps = lambda **k: {(r["seed"], r["step"], r["node"]) for r in graph.walks(found, seeds, "a", 4, **k).collect()}
    assert steps() == {(3, 0, 3), (3, 1, 1), (3, 2, 2), (299, 0, 299), (299, 1, 300), (8, 0, 8), (7, 0, 7), *((150, k, 150 + k) for k in range(5))}
    assert {x for x in steps(forwards=False) if x[0] in (3, 150)} == {(3, 0, 3), (3, 1, 2), (3, 2, 1), *((150, k, 150 - k) for k in range(5))}
