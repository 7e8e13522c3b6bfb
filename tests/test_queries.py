"""Every library query against its SQL, and those without SQL against plain Python."""

import pytest

import __spark_entry__
from tests.compare import oracle_rows, spark_rows

REGISTRIES = __spark_entry__._registries()
QUERIES = {k: v for r in REGISTRIES for k, v in r.queries.items()}
ORACLES = {k: v for r in REGISTRIES for k, v in r.oracles.items()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == oracle_rows(ORACLES[name], sf_dir)


def test_char_budget_around(spark, sf_dir):
    got = QUERIES["char_budget_around"](spark, sf_dir).collect()
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], {})[r["turn"]] = len(r["text"])
    expected = set()
    for conv, sizes in turns.items():
        if 2 not in sizes:
            continue
        chosen, used, open_ = {2}, sizes[2], [True, True]
        side = 0
        while any(open_):
            at = min(chosen) - 1 if side == 0 else max(chosen) + 1
            if open_[side]:
                open_[side] = at in sizes and used + sizes[at] <= 1500
                if open_[side]:
                    chosen.add(at)
                    used += sizes[at]
            side = 1 - side
        expected |= {(conv, t) for t in chosen}
    assert {(r["conv_id"], r["turn"]) for r in got} == expected


def test_entry_and_registration(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
