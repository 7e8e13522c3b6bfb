"""State machines and running counts over ordered rows of keys of any size.

A key's rows are dealt out by ranges of their order and cut into parts of ``PART`` rows.  What a part does to a state machine is a function from each
state to a state, which needs nothing of the rows before; functions compose, so the state that each part begins in follows from those
of the parts before it, one small row each, and then all parts find their rows' states at the same time.  Running counts go the same
way with sums.  How rows are split changes nothing, and no task needs a key's rows together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.storage import stored

PART = 512


def placed(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with ``_n``, which grows with each key's order, as a table of the shared folder; equal places stand anyhow."""
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return stored(dealt.withColumn("_n", F.monotonically_increasing_id()), "placed")


def _part() -> Column:
    return F.floor(F.col("_n") / PART).cast("bigint")


def _key_struct(keys: list[str]) -> Column:
    return F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))


def _entered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that each part of a key begins in, from its first part to its last."""
    for batch in batches:
        of, states = [], []
        for start, parts in zip(batch.column("start").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            state = start
            for p in parts:
                of.append(p["part"])
                states.append(state)
                state = p["after"][state]
        rows = [i for i, parts in enumerate(batch.column("parts").to_pylist()) for _ in parts]
        key = batch.column("key").take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([key, pa.array(of, pa.int64()), pa.array(states, pa.int32())], names=["key", "of", "state"])


def states(rows: DataFrame, keys: list[str], symbol: str, table: list[list[int]], start: int = 0, name: str = "state") -> DataFrame:
    """The rows of ``placed`` with the state of a machine after each: ``table[state][symbol]`` is the next one.

    A null symbol, and one that the table doesn't have, leave the state as it is.
    """
    width = max(len(t) for t in table)
    flat = F.array(*(F.lit(t[a] if a < len(t) else s) for s, t in enumerate(table) for a in range(width)))
    known = F.when(F.col(symbol).between(0, width - 1), F.col(symbol).cast("int"))
    next_state = lambda s, a: F.when(a.isNull(), s).otherwise(F.get(flat, s * width + a))
    own = rows.select(_key_struct(keys).alias("key"), _part().alias("part"), F.col("_n"), known.alias("a"))
    parts = own.groupBy("key", "part").agg(F.array_sort(F.collect_list(F.struct("_n", "a"))).alias("read"))
    every = F.array(*(F.lit(s) for s in range(len(table))))
    after = F.aggregate("read", every, lambda acc, r: F.transform(acc, lambda s: next_state(s, r["a"])))
    parts = parts.withColumn("after", after)
    by_key = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "after"))).alias("parts")).withColumn("start", F.lit(start))
    kind = own.schema["key"].dataType.simpleString()
    entered = by_key.mapInArrow(_entered, f"key {kind}, of bigint, state int")
    same = parts["key"].eqNullSafe(entered["key"]) & (F.col("part") == F.col("of"))
    begun = parts.join(entered, same).select("read", F.col("state").alias("begin"))
    walked = F.aggregate(
        "read", F.struct(F.col("begin").alias("s"), F.array().cast("array<int>").alias("all")),
        lambda acc, r: F.struct(next_state(acc["s"], r["a"]).alias("s"), F.concat(acc["all"], F.array(next_state(acc["s"], r["a"]))).alias("all")),
    )["all"]
    each = begun.select(F.explode(F.arrays_zip(F.col("read")["_n"].alias("n"), walked.alias("s"))).alias("x")).select(F.col("x.n").alias("_n"), F.col("x.s").alias(name))
    return rows.join(each, "_n")


def counts(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """The rows of ``placed`` with running sums of whole numbers over each key's order, each row's own included."""
    parted = rows.withColumn("_part", _part()).withColumns({f"_v_{k}": F.coalesce(v.cast("bigint"), F.lit(0)) for k, v in values.items()})
    sums = parted.groupBy(*keys, "_part").agg(*(F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    starts = sums.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_of"), *(F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in values)
    )
    same = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy(*keys, "_part").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    own = parted.withColumns({f"_w_{k}": F.sum(f"_v_{k}").over(within) for k in values})
    return own.join(starts, same).select(*rows.columns, *((F.col(f"_w_{k}") + F.col(f"_b_{k}")).cast("bigint").alias(k) for k in values))


#: States of a table of contents: nothing, a title that goes on, a title that its page has ended.
_TOC = [[1, 2, 0, 0], [1, 2, 1, 2], [1, 2, 0, 0]]


def toc_entries(lines: DataFrame, keys: list[str], order: list[str], text: str, begins: str, page: str) -> DataFrame:
    """``keys, entry_no, number, title, page`` of tables of contents whose titles may go over several lines.

    A line that ``begins`` (a pattern whose first group is the number) opens an entry, and one that ends in ``page`` (its first group the
    page) closes it; lines between are the title's, lines outside belong to none.  An entry that another one interrupts has no page.
    """
    number, end = F.regexp_extract(text, begins, 1), F.regexp_extract(text, f"(?:{page})$", 1)
    symbol = F.when(number != "", 0).otherwise(2) + F.when(end != "", 1).otherwise(0)
    at = states(placed(lines.withColumn("_symbol", symbol), keys, order), keys, "_symbol", _TOC)
    begun = counts(at, keys, {"entry_no": (F.col("_symbol") < 2).cast("int")})
    # a closed entry's own lines are those up to the one that closed it
    own = begun.filter((F.col("state") == 1) | ((F.col("state") == 2) & F.col("_symbol").isin(0, 1, 3)))
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.col(text), f"(?:{page})$", ""), begins, ""))
    part = F.struct("_n", F.when(number != "", number).alias("number"), bare.alias("bare"), F.when((end != "") & (F.col("state") == 2), end).alias("page"))
    found = own.groupBy(*keys, "entry_no").agg(F.array_sort(F.collect_list(part)).alias("p"))
    title = F.array_join(F.filter(F.transform("p", lambda x: x["bare"]), lambda t: t != ""), " ")
    return found.select(*keys, "entry_no", F.get("p", F.lit(0))["number"].alias("number"), title.alias("title"), F.array_max(F.transform("p", lambda x: x["page"])).alias("page"))
