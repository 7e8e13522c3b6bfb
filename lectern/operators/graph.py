"""Connected components of an edge list, without ever gathering a node's neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import intervals
from lectern.storage import cut, drop_cut


def _sums(pairs: DataFrame):
    """Equal sets of pairs have equal counts and equal sums of pair hashes."""
    return pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the smallest node that each node of an edge reaches.

    Rounds of large-star and small-star (each node's neighbours are tied to the smallest of them) until no edge
    changes; the number of rounds grows with the logarithm of the longest path.  Minima are combined before the shuffle and
    joined back, so a node with very many neighbours never becomes one task's list.
    """
    now = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    )
    known = _sums(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.filter("u > v")
        floor = low.groupBy("u").agg(F.min("v").alias("m"))
        tied = low.join(floor, "u")
        small = (
            tied.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(tied.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = cut(small)
        drop_cut(now)
        now, before, known = after, known, _sums(after)
        if known == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )


def trees(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """``node, parent, level, path`` of each node that a root (a null parent) leads to; the path joins the nodes from the root by dots.

    Each node knows a part of its way up, and each round doubles it by that of the ancestor where it ends, so there are as many rounds as
    the depth has binary digits.  Nodes whose parent isn't there are left out with all below them, and so are circles: a round
    in which no way comes to its end has no end before it.
    """
    own = F.col(node).cast("string")
    begun = nodes.select(node, parent, F.col(parent).alias("up"), own.alias("path"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("level"))
    now = cut(begun)
    left = None
    while True:
        ended, going = now.filter("up IS NULL"), now.filter("up IS NOT NULL")
        count = going.count()
        if not count or count == left:
            break
        left = count
        above = now.select(F.col(node).alias("_node"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("level").alias("_level"))
        longer = going.join(above, F.col("up") == F.col("_node")).select(
            node, parent, F.col("_up").alias("up"), F.concat("_path", F.lit("."), "path").alias("path"), (F.col("level") + F.col("_level")).alias("level")
        )
        after = cut(ended.unionByName(longer))
        drop_cut(now)
        now = after
    return now.filter("up IS NULL").select(node, parent, "level", "path")


def _heads(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, head, place`` along predecessors (``node, up``; null at a head), and the nodes that no head leads to, by doubling."""
    now = cut(steps.select("node", "up", F.when(F.col("up").isNull(), F.col("node")).alias("head"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("place")))
    left = None
    while True:
        count = now.filter("head IS NULL").count()
        if not count or count == left:
            break
        left = count
        above = now.select(F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("head").alias("_head"), F.col("place").alias("_place"))
        longer = now.filter("head IS NULL").join(above, F.col("up") == F.col("_node")).select("node", F.col("_up").alias("up"), F.col("_head").alias("head"), (F.col("place") + F.col("_place")).alias("place"))
        after = cut(now.filter("head IS NOT NULL").unionByName(longer))
        drop_cut(now)
        now = after
    return now.filter("head IS NOT NULL").select("node", "head", "place"), now.filter("head IS NULL").select("node")


def chains(rows: DataFrame, node: str, following: str) -> DataFrame:
    """``node, head, place, length, circle``: where each node stands in the chain that its links to the following one make.

    A link to a node that isn't there, or that a smaller one links to, is none, so what follows begins a chain of its own.  A
    circle is opened before its smallest node.  Rounds go with the logarithm of the longest chain.
    """
    own = rows.select(F.col(node).alias("node"), F.col(following).alias("next"))
    links = own.filter("next IS NOT NULL").groupBy("next").agg(F.min("node").alias("up")).withColumnRenamed("next", "node")
    steps = cut(own.select("node").distinct().join(links, "node", "left"))
    straight, round_ = _heads(steps)
    circles = cut(steps.join(round_, "node"))
    opened = components(circles.filter("node <> up"), "node", "up").unionByName(circles.filter("node = up").select("node", F.col("node").alias("root")))
    smallest = circles.join(opened, "node").select("node", F.when(F.col("node") != F.col("root"), F.col("up")).alias("up"))
    turned, _ = _heads(smallest)
    both = straight.withColumn("circle", F.lit(False)).unionByName(turned.withColumn("circle", F.lit(True)))
    lengths = both.groupBy("head").agg(F.count("*").alias("length"))
    return both.join(lengths, "head").select("node", "head", "place", "length", "circle")


def walks(chained: DataFrame, seeds: DataFrame, seed: str, most: int, forwards: bool = True) -> DataFrame:
    """``seed, step, node`` of the walks from seeds along ``chains``, at most ``most`` steps, without coming to a node twice."""
    begun = seeds.select(F.col(seed).alias("seed")).distinct().join(chained.select(F.col("node").alias("seed"), "head", "place", "length", "circle"), "seed")
    steps = F.least(F.lit(most), F.col("length") - 1)
    low, high = (F.col("place"), F.col("place") + steps) if forwards else (F.col("place") - steps, F.col("place"))
    # a circle's places come again one length on and one back
    turns = F.when(F.col("circle"), F.array(F.lit(0), F.col("length"), -F.col("length"))).otherwise(F.array(F.lit(0).cast("bigint")))
    spans = begun.select("seed", "head", F.col("place").alias("from"), low.alias("s"), high.alias("e"), F.explode(turns).alias("turn"))
    spans = spans.select("seed", "head", "turn", F.col("from"), (F.col("s") + F.col("turn")).alias("s"), (F.col("e") + F.col("turn")).alias("e"))
    held = intervals.places_in(chained.select("node", "head", "place"), spans, ["head"], "place", "s", "e")
    step = F.abs(F.col("place") - F.col("turn") - F.col("from"))
    return held.select("seed", step.cast("int").alias("step"), "node")
