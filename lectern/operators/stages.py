"""A staged evidence pipeline: fetch, extract, derive, claim.

Each stage is a table of effects keyed by a stable id with the version of the handler that made it.  A stage's new rows are the
inputs whose effect isn't stored yet with the current version; stored ones are reused, so a run after a handler's new version
does again only what that handler and those behind it make.  Inputs that failed or came back empty are skipped by all later stages.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import stable_id
from lectern.storage import cut

Handler = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Registered:
    handler: Handler
    version: str


class HandlerRegistry:
    """Handlers by (tool, stage): functions from ``input_id, payload`` rows to ``input_id, payload`` rows."""

    def __init__(self):
        self._known: dict[tuple[str, str], Registered] = {}

    def register(self, tool: str, stage: str, version: str) -> Callable[[Handler], Handler]:
        def add(handler: Handler) -> Handler:
            self._known[tool, stage] = Registered(handler, version)
            return handler

        return add

    def get(self, tool: str, stage: str) -> Registered:
        if (tool, stage) not in self._known:
            raise KeyError(f"no handler for {stage} of {tool}")
        return self._known[tool, stage]

    def tools(self, stage: str) -> list[str]:
        return sorted(t for t, s in self._known if s == stage)


EFFECTS = "effect_id string, tool string, input_id string, payload string, handler_version string"


def run_stage(inputs: DataFrame, stored: DataFrame, registry: HandlerRegistry, stage: str) -> DataFrame:
    """All effects of a stage for ``effect_id, tool, payload`` inputs: stored ones of the current version, and new ones."""
    out = None
    for tool in registry.tools(stage):
        known = registry.get(tool, stage)
        own = inputs.filter((F.col("tool") == tool) & F.col("payload").isNotNull()).select(
            F.col("effect_id").alias("input_id"), "payload"
        )
        have = stored.filter((F.col("tool") == tool) & (F.col("handler_version") == known.version))
        kept = have.join(own.select("input_id"), "input_id", "left_semi").select(*stored.columns)
        fresh = known.handler(own.join(have.select("input_id"), "input_id", "left_anti")).filter(F.col("payload").isNotNull())
        made = fresh.select(
            stable_id(f"{stage}-", F.lit(tool), F.col("input_id"), F.col("payload")).alias("effect_id"),
            F.lit(tool).alias("tool"),
            "input_id",
            "payload",
            F.lit(known.version).alias("handler_version"),
        )
        part = kept.unionByName(made)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else stored.limit(0)


def run_plan(raw: DataFrame, stored: dict[str, DataFrame], registry: HandlerRegistry, stages: tuple[str, ...] = ("extract", "derive", "claim")) -> dict[str, DataFrame]:
    """The effects of each stage, from the raw responses on; each is cut, so that the next doesn't run its handlers again."""
    found, now = {}, raw
    for stage in stages:
        now = found[stage] = cut(run_stage(now, stored[stage], registry, stage))
    return found


def plan_calls(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """Calls for requests (``query, language``): every template of the language with its placeholder filled, in order of priority.

    ``templates``: ``language, tool, stage, endpoint, priority``; the endpoint has ``{query}`` where the query goes.
    """
    joined = requests.join(templates, "language")
    filled = F.replace("endpoint", F.lit("{query}"), F.col("query"))
    call = stable_id("call-", F.col("language"), F.col("tool"), F.col("stage"), filled)
    return joined.select("query", "language", "tool", "stage", filled.alias("endpoint"), "priority", call.alias("call_id"))


def plan_hash(calls: DataFrame) -> DataFrame:
    """``query, plan_hash``: equal for plans with the same calls, whatever their order."""
    told = F.to_json(F.sort_array(F.collect_set(F.struct("tool", "stage", "endpoint"))))
    return calls.groupBy("query").agg(F.sha2(told, 256).alias("plan_hash"))


def cached_responses(plans: DataFrame, index: DataFrame, responses: DataFrame) -> DataFrame:
    """Stored responses of plans that were run before (``index``: plan_hash, response_id); other plans give none."""
    return plans.join(index, "plan_hash").join(responses, "response_id")


def payload(**parts) -> str:
    """A payload as JSON with sorted keys."""
    return json.dumps(parts, sort_keys=True, ensure_ascii=False)
