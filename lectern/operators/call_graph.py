"""Plans of calls as graphs, and their runs in rounds over all plans at once.

A request's language gives it chains of calls, fetch, extract, derive and claim, each fed by the one before; a chain can also begin at another
chain's call, as citations do.  A plan is rows: its calls, and links from call to call.  A run takes all calls of all plans whose links are done,
by joins, round by round, as many rounds as the longest chain has calls.  A call that has no handler, or whose source gave nothing, is
skipped with its reason, and so are those behind it; if it isn't optional it has failed, and so has its plan.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.stages import HandlerRegistry
from lectern.storage import cut

STAGES = ("fetch", "extract", "derive", "claim")


class Chain(NamedTuple):
    language: str
    name: str
    #: The tools of its calls, in order; a tool begins with its stage.
    tools: str
    #: What is asked: the ``lemma``, the ``surface`` (only where it's another), or each of the ``spellings``.
    asked: str = "lemma"
    priority: int = 1
    #: The first call of the first spelling has to succeed.
    required: bool = False
    #: The call of another chain that feeds this one.
    source: str | None = None


#: The tools that each language's requests call.
CHAINS = [
    Chain("san", "heritage", "fetch.heritage extract.heritage.html derive.heritage.morph claim.heritage.morph", "spellings", 1, True),
    Chain("san", "cdsl-mw", "fetch.cdsl extract.cdsl.xml derive.cdsl.sense claim.cdsl.sense", "lemma", 2),
    Chain("san", "cdsl-ap90", "fetch.cdsl extract.cdsl.xml derive.cdsl.sense claim.cdsl.sense", "lemma", 2),
    Chain("san", "dico", "fetch.dico extract.dico.json derive.dico.entries claim.dico.entries", "lemma", 2),
    Chain("lat", "diogenes", "fetch.diogenes extract.diogenes.html derive.diogenes.morph claim.diogenes.morph", "lemma", 1, True),
    Chain("lat", "whitakers", "fetch.whitakers extract.whitakers.lines derive.whitakers.facts claim.whitakers", "surface", 2),
    Chain("lat", "cltk", "fetch.cltk extract.cltk.lexicon derive.cltk.ipa claim.cltk.ipa", "lemma", 3),
    Chain("lat", "gaffiot", "fetch.gaffiot extract.gaffiot.json derive.gaffiot.entries claim.gaffiot.entries", "lemma", 2),
    Chain("lat", "lewis_1890", "fetch.lewis_1890 extract.lewis_1890.json derive.lewis_1890.entries claim.lewis_1890.entries", "lemma", 2),
    Chain("lat", "georges_1913", "fetch.georges_1913 extract.georges_1913.json derive.georges_1913.entries claim.georges_1913.entries", "lemma", 2),
    Chain("grc", "diogenes", "fetch.diogenes extract.diogenes.html derive.diogenes.morph claim.diogenes.morph", "lemma", 1, True),
    Chain("grc", "citation", "derive.diogenes.citation claim.diogenes.citation", "lemma", 5, False, "diogenes-extract-1"),
    Chain("grc", "surface", "fetch.diogenes extract.diogenes.html derive.diogenes.morph claim.diogenes.morph", "surface", 2),
    Chain("grc", "cts", "fetch.cts_index extract.cts_index.json derive.cts_index.citation claim.cts_index", "lemma", 7, False, "citation-derive-1"),
    Chain("grc", "bailly", "fetch.bailly extract.bailly.json derive.bailly.entries claim.bailly.entries", "lemma", 2),
    Chain("grc", "strongs_greek", "fetch.strongs_greek extract.strongs_greek.json derive.strongs_greek.entries claim.strongs_greek.entries", "spellings", 2),
    Chain("grc", "spacy", "fetch.spacy extract.spacy.json derive.spacy.morph claim.spacy.morph", "lemma", 3),
    Chain("grc", "cltk", "fetch.cltk extract.cltk.lexicon derive.cltk.ipa claim.cltk.ipa", "lemma", 3),
]


def template_rows(chains: list[Chain]) -> list[tuple]:
    """``language, chain, place, tool, stage, asked, priority, required, source``: a row for each call of a chain, its source one of
    its own stages or another chain's call."""
    out = []
    for c in chains:
        stages = [t.split(".")[0] for t in c.tools.split()]
        for k, tool in enumerate(c.tools.split()):
            source = stages[k - 1] if k else c.source
            out.append((c.language, c.name, k, tool, stages[k], c.asked, c.priority + k, c.required and not k, source))
    return out


TEMPLATES = "language string, chain string, place int, tool string, stage string, asked string, priority int, required boolean, source string"


def plan_graph(requests: DataFrame, chains: list[Chain] | None = None) -> DataFrame:
    """Calls of requests (``query_id, language, surface, lemma, spellings``): ``query_id, language, call_id, tool, stage, asked, priority, optional,
    source`` (the call that feeds it, else null).  A language without chains has no calls; empty spellings are left out, equal ones asked once."""
    told = template_rows(CHAINS if chains is None else chains)
    templates = F.broadcast(requests.sparkSession.createDataFrame(told, TEMPLATES))  # a row for each call of a chain
    lemma, surface = (F.lower(F.coalesce(c, F.lit(""))) for c in ("lemma", "surface"))
    spellings = F.array_distinct(F.filter(F.transform(F.coalesce("spellings", F.array().cast("array<string>")), F.lower), lambda s: s != ""))
    rows = requests.select("query_id", "language", lemma.alias("lemma"), surface.alias("surface"), spellings.alias("spellings"))
    asked = (
        F.when(F.col("asked") == "spellings", F.when(F.size("spellings") > 0, F.col("spellings")).otherwise(F.array("lemma")))
        .when(F.col("asked") == "lemma", F.array("lemma"))
        .otherwise(F.filter(F.array("surface"), lambda s: (s != "") & (s != F.col("lemma"))))
    )
    each = rows.join(templates, "language").select("*", F.posexplode(asked).alias("k", "text"))
    call = lambda stage: F.concat_ws("-", "chain", stage, (F.col("k") + 1).cast("string"))
    own = F.when(F.col("source").isin(*STAGES), call("source")).otherwise(F.col("source"))
    return each.select(
        "query_id", "language", call("stage").alias("call_id"), "tool", "stage", F.col("text").alias("asked"), "priority", (~(F.col("required") & (F.col("k") == 0))).alias("optional"), own.alias("source")
    )


_KEY = ["query_id", "call_id"]
_BETWEEN = "\x1f"


def _made(fed: DataFrame, registry: HandlerRegistry) -> DataFrame | None:
    """What the handlers make of their calls' inputs: ``query_id, call_id, payload``."""
    out = None
    for stage, tool in sorted(map(tuple, fed.select("stage", "tool").distinct().collect())):  # registered tools
        if tool in registry.tools(stage):
            own = fed.filter((F.col("tool") == tool) & (F.col("stage") == stage))
            rows = own.select(F.concat_ws(_BETWEEN, *_KEY).alias("input_id"), "payload")
            made = registry.get(tool, stage).handler(rows).filter("payload IS NOT NULL").select("input_id", "payload")
            out = made if out is None else out.unionByName(made)
    if out is None:
        return None
    parts = F.split("input_id", _BETWEEN)
    return out.select(*(F.get(parts, F.lit(i)).alias(k) for i, k in enumerate(_KEY)), "payload")


def run_graph(calls: DataFrame, registry: HandlerRegistry, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Run all calls: ``query_id, call_id, tool, stage, status, reason, round``, and the outputs ``query_id, call_id, payload``.

    Handlers are called by tool and stage with ``input_id, payload`` rows: what is asked, or what the source gave; they return such rows, any number
    for an input.  ``more`` are further links.  Links in a circle are an error.
    """
    spark = calls.sparkSession
    every = calls.withColumn("query_id", F.col("query_id").cast("string"))
    further = None if more is None else cut(_existing(more.select(F.col("query_id").cast("string"), "from_call", "to_call").distinct(), every))
    # a source that isn't there isn't waited for, and gives nothing
    pending = every.withColumn("fed", F.col("source").isNull())
    there = every.select("query_id", F.col("call_id").alias("source"), F.lit(True).alias("waits")).distinct()
    pending = cut(_held(pending.join(there, ["query_id", "source"], "left"), further))
    known = F.concat_ws(" ", "stage", "tool").isin([f"{s} {t}" for s in STAGES for t in registry.tools(s)])
    states = spark.createDataFrame([], "query_id string, call_id string, tool string, stage string, status string, reason string, round int")
    outputs = spark.createDataFrame([], "query_id string, call_id string, payload string")
    rounds = 0
    while not pending.isEmpty():
        rounds += 1
        free = F.col("waits").isNull() if further is None else F.col("waits").isNull() & F.col("held").isNull()
        ready, rest = pending.filter(free), pending.filter(~free)
        if ready.isEmpty():
            raise RuntimeError("the links of some plans are a circle")
        reason = F.when(~known, F.concat(F.lit("missing_handler_"), F.col("stage"))).when(~F.col("fed"), F.concat(F.lit("missing_source_"), F.col("stage")))
        status = F.when(reason.isNull(), "done").when(F.col("optional"), "skipped").otherwise("failed")
        states = states.unionByName(ready.select(*_KEY, "tool", "stage", status.alias("status"), reason.alias("reason"), F.lit(rounds).alias("round")))
        able = ready.filter(reason.isNull())
        fed = able.filter("source IS NULL").select(*_KEY, "tool", "stage", F.col("asked").alias("payload"))
        if rounds > 1:
            # without further links a call runs in the round after its source's
            given = (made if further is None else outputs).select("query_id", F.col("call_id").alias("source"), "payload")
            fed = fed.unionByName(able.join(given, ["query_id", "source"]).select(*_KEY, "tool", "stage", "payload"))
        made = _made(cut(fed), registry)
        made = outputs.limit(0) if made is None else cut(made)
        outputs = outputs.unionByName(made)
        pending = cut(_after(rest, ready, made))
        if further is not None:
            further = cut(further.join(ready.select("query_id", F.col("call_id").alias("from_call")), ["query_id", "from_call"], "left_anti"))
            pending = cut(_held(pending, further))
    return cut(states), outputs


def _existing(before: DataFrame, calls: DataFrame) -> DataFrame:
    """The links from calls that are there."""
    return before.join(calls.select("query_id", F.col("call_id").alias("from_call")), ["query_id", "from_call"], "left_semi")


def _held(pending: DataFrame, further: DataFrame | None) -> DataFrame:
    """Calls that further links hold back are ``held``."""
    if further is None:
        return pending
    held = further.select("query_id", F.col("to_call").alias("call_id"), F.lit(True).alias("held")).distinct()
    return pending.drop("held").join(held, _KEY, "left")


def _after(rest: DataFrame, ready: DataFrame, made: DataFrame) -> DataFrame:
    """The calls that are left after a round: those whose sources were in it don't wait any more, and are ``fed`` if these gave something."""
    done = ready.select("query_id", F.col("call_id").alias("source"), F.lit(True).alias("done"), F.lit(False).alias("gave"))
    gave = made.select("query_id", F.col("call_id").alias("source"), F.lit(None).cast("boolean").alias("done"), F.lit(True).alias("gave"))
    of = done.unionByName(gave).groupBy("query_id", "source").agg(F.max("done").alias("done"), F.max("gave").alias("gave"))
    told = rest.join(of, ["query_id", "source"], "left")
    own = [c for c in rest.columns if c not in ("waits", "fed")]
    return told.select(*own, F.when(F.col("done").isNull(), F.col("waits")).alias("waits"), (F.col("fed") | F.coalesce("gave", F.lit(False))).alias("fed"))


def responses(table: DataFrame, tool: str):
    """A handler that fetches from a table of responses (``tool, asked, payload``)."""

    def fetch(rows: DataFrame) -> DataFrame:
        own = table.filter(F.col("tool") == tool).select(F.col("asked").alias("_asked"), F.col("payload").alias("_payload"))
        return rows.join(own, rows["payload"] == F.col("_asked")).select("input_id", F.col("_payload").alias("payload"))

    return fetch


def plan_states(states: DataFrame) -> DataFrame:
    """``query_id, failed, done, skipped, rounds`` of each plan."""
    count = lambda s: F.count_if(F.col("status") == s)
    return states.groupBy("query_id").agg((count("failed") > 0).alias("failed"), count("done").alias("done"), count("skipped").alias("skipped"), F.max("round").alias("rounds"))

