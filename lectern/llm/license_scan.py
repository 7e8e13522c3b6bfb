"""License scans by diagonal voting.

Every document's words, and every template's, are hashed in rolling pairs.  A Spark join of the documents' hashes with the templates' gives
hits (text position, template position).  Hits of one unbroken quotation share the difference of the two, their diagonal, and are
aggregated there, with the template places that were voted for.  Hits on neighbouring diagonals whose places touch, directly or
over others, are merged, as a word more or less moves the diagonal.  A merged group is verified by its longest chain, in
which text and template places both rise: so every template place counts once, where it stands in order.  Its share is
the chain's length by the number of pairs of the template or of the text that the chain spans, whichever is more; a notice is found from
the share that it still has with one word changed (``least_share``), if the chain holds its telling words.  Of a
phrase that is looked for exactly, all pairs must stand on one diagonal.

Templates are few and fixed, so their hashes are looked up among them before anything leaves the document's row, and their side of the
join is broadcast, after a check of its size (``BROADCAST_GRAMS``): the corpus isn't shuffled; only hits and one row for each document are.
More templates are joined by shuffling all pairs.

Words are runs of ASCII letters, digits and characters beyond ASCII, of the text with A-Z lower-cased.

Defined results: null and empty texts have no word and no label; very long texts are read whole, and one document's hits are verified in one
task; rows with equal doc_id and text give equal results, each its own row; a null doc_id is a key like any other; among chains
of equal length the one over fewer words is taken; an empty table gives no row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import release_caches

#: Phrases whose exact places are counted, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices by label; own wordings of what licenses call for, found also when a word differs.  Words in braces tell the license.
NOTICES = {
    "apache-2.0": [
        "licensed under the {apache} license version 2.0",
        "you may not use this file except in compliance with the license",
    ],
    "mit": [
        "released under the {mit} license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "gpl-3": ["licensed under the gnu {general} {public} license version {3}"],
    "cc-by-nc": ["licensed under {cc} by {nc} 4.0"],
    "cc-by-sa": ["licensed under {cc} by {sa} 4.0"],
    "proprietary": ["copyright all rights reserved no part of this publication may be reproduced"],
}

#: Words of a hashed run.
GRAM = 2
#: Diagonals at most so far apart are merged.
SLACK = 3
MIN_SHARE = 0.7
BROADCAST_GRAMS = 100_000
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LARGE, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """``telling`` has the places of words without which the template isn't found."""

    label: str
    words: tuple[str, ...]
    exact: bool
    telling: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        if len(self.words) < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {self.words}")

    @property
    def grams(self) -> int:
        return len(self.words) - GRAM + 1


def words_of(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def notice(label: str, wording: str) -> Template:
    telling = tuple(k for k, w in enumerate(re.split(r"[\s.]+", wording)) if w[:1] == "{")
    return Template(label, tuple(words_of(wording)), False, telling)


def default_templates() -> list[Template]:
    exact = [Template(label, tuple(words_of(p)), True) for p, label in PHRASES.items()]
    return exact + [notice(label, t) for label, ts in NOTICES.items() for t in ts]


def least_share(grams: int) -> float:
    """The share from which a notice is found: what one replaced word leaves of a short one."""
    return min(MIN_SHARE, max(0.5, (grams - GRAM) / grams))


def _positions(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """Every run of the templates: hash, text, template, place; and a row that marks documents."""
    rows = [("", -1, 0)]
    for t, template in enumerate(templates):
        rows += [(" ".join(template.words[i : i + GRAM]), t, i) for i in range(template.grams)]
    frame = docs.sparkSession.createDataFrame(rows, "gram string, template int, at int")
    parts = F.split("gram", " ")
    hashed = F.when(F.col("template") < 0, F.lit(0).cast("bigint")).otherwise(F.xxhash64(*(F.get(parts, i) for i in range(GRAM))))
    return frame.withColumn("hash", hashed)


def _few(templates: list[Template]) -> bool:
    """Whether the templates' runs are few enough to broadcast."""
    return sum(len(t.words) for t in templates) <= BROADCAST_GRAMS


def hits(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """``doc_id, text_hash, n, template, diagonal``, its ``votes`` and the template places ``ats``; template -1 marks documents."""
    # by code points, as lower() changes letters beyond ASCII
    text = F.translate(F.coalesce("text", F.lit("")), _LARGE, _SMALL)
    words = F.array_remove(F.split(text, _NO_WORD), "")
    # as a generator's output the words are computed once, not for each element that looks at them
    a = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(F.array(words)).alias("w"))
    w = F.col("w")
    positions = _positions(docs, templates)
    hashed = lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, GRAM)))
    if _few(templates):
        known = [r["hash"] for r in positions.filter("template >= 0").select("hash").distinct().collect()]
        places = F.array_compact(F.transform(w, lambda x, i: F.when(hashed(x, i).isin(known), i)))
        positions = F.broadcast(positions)
    else:
        places = F.when(F.size(w) >= GRAM, F.sequence(F.lit(0), F.size(w) - GRAM)).otherwise(F.array().cast("array<int>"))
    spelled = lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(GRAM)))
    run = lambda i: F.struct(i.alias("i"), hashed(F.get(w, i), i).alias("hash"), spelled(i).alias("spelled"))
    mark = F.struct(F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("hash"), F.lit("").alias("spelled"))
    each = a.select("doc_id", "text_hash", F.size(w).alias("n"), F.explode(F.concat(F.array(mark), F.transform(places, run))).alias("g"))
    found = each.select("doc_id", "text_hash", "n", "g.*").join(positions, "hash").filter(F.col("spelled") == F.col("gram"))
    return (
        found.select("doc_id", "text_hash", "n", "template", (F.col("i") - F.col("at")).alias("diagonal"), "at")
        .groupBy("doc_id", "text_hash", "n", "template", "diagonal")
        .agg(F.count("*").alias("votes"), F.collect_set("at").alias("ats"))
    )


def groups_of(found: list[tuple[int, int]], reach: int) -> list[list[tuple[int, int]]]:
    """Hits (text place, template place) in groups: neighbours on near diagonals, directly or over others; ``reach`` is in words."""
    found = sorted(set(found))
    parent = list(range(len(found)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    last: dict[int, int] = {}  # of each diagonal
    for k, (i, at) in enumerate(found):
        d = i - at
        for near in range(d - SLACK, d + SLACK + 1):
            if near in last and i - found[last[near]][0] <= reach:
                parent[find(k)] = find(last[near])
        last[d] = k
    out: dict[int, list[tuple[int, int]]] = {}
    for k, hit in enumerate(found):
        out.setdefault(find(k), []).append(hit)
    return list(out.values())


Hit = tuple[int, int]


def best_from(start: int, found: list[Hit], gone: list[bool], template: Template) -> tuple[float, int, int] | None:
    """(share, first place, last place) of the best notice whose first hit is ``found[start]``, or None.

    Both places rise along a notice's hits, and they have all its telling words.  Its share is the number of its hits by the pairs of
    words that it spans in text or template, so only hits within a few times the template's length can follow the first one.
    """
    grams, need = template.grams, least_share(template.grams)
    every = (1 << len(template.telling)) - 1

    def told(at: int) -> int:
        return sum(1 << k for k, place in enumerate(template.telling) if at <= place < at + GRAM)

    first, at0 = found[start]
    # for each template place and set of telling words, the longest chain that ends there
    longest: dict[int, dict[int, int]] = {at0: {told(at0): 1}}
    best = (1 / grams, first, first) if told(at0) == every and 1 / grams >= need else None
    for k in range(start + 1, len(found)):
        i, at = found[k]
        if (i - first + 1) * need > grams:
            break
        if gone[k] or at <= at0 or i == first:
            continue
        own: dict[int, int] = {}
        for before, lengths in longest.items():
            if before < at:
                for words, n in lengths.items():
                    words |= told(at)
                    own[words] = max(own.get(words, 0), n + 1)
        here = longest.setdefault(at, {})
        for words, n in own.items():
            here[words] = max(here.get(words, 0), n)
        share = own.get(every, 0) / max(grams, i - first + 1)
        if share >= need and (best is None or share > best[0]):
            best = (share, first, i)
    return best


def notices_in(found: list[Hit], template: Template) -> list[tuple[int, int, float]]:
    """(first word, word after the last, share) of each place where a template stands, from its hits.

    The best share of a group comes first, then the best of what is left beside it, so further pieces of a notice never hide it.
    """
    out = []
    least = least_share(template.grams) * template.grams
    for group in groups_of(found, len(template.words)):
        if len({at for _, at in group}) < least:
            continue
        group = sorted(group, key=lambda h: (h[0], -h[1]))  # hits of one text place can't follow each other
        places = [i for i, _ in group]
        gone = [False] * len(group)
        ranked = []
        for k in range(len(group)):
            best = best_from(k, group, gone, template)
            if best:
                ranked.append((-best[0], best[1], best[2], k))
        heapq.heapify(ranked)
        while ranked:
            share, first, last, k = heapq.heappop(ranked)
            own = slice(bisect_left(places, first), bisect_right(places, last))
            if gone[k]:
                continue
            if any(gone[own]):  # another notice has some of its hits
                best = best_from(k, group, gone, template)
                now = best and (-best[0], best[1], best[2], k)
                if best and now != (share, first, last, k):
                    heapq.heappush(ranked, now)
                    continue
                if not best:
                    continue
            out.append((first, last + GRAM, -share))
            gone[own] = [True] * len(gone[own])
    return out


SPANS = "array<struct<begin:int,end:int,label:string,exact:boolean,share:double>>"
_SPANS = pa.list_(
    pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("exact", pa.bool_()), ("share", pa.float64())])
)


def _spans(items: list[dict], templates: list[Template]) -> list[dict]:
    out = []
    fuzzy: dict[int, list[tuple[int, int]]] = {}
    for x in items:
        t, d = x["template"], x["diagonal"]
        if not templates[t].exact:
            fuzzy.setdefault(t, []).extend((d + at, at) for at in x["ats"])
        elif len(x["ats"]) == templates[t].grams:
            out.append((d, d + len(templates[t].words), templates[t].label, True, 1.0))
    for t, found in fuzzy.items():
        out += [(a, b, templates[t].label, False, share) for a, b, share in notices_in(found, templates[t])]
    return [dict(zip(("begin", "end", "label", "exact", "share"), x, strict=True)) for x in sorted(out)]


def scan(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """A row for each document: ``doc_id, n_words, spans`` - array<struct<begin, end, label, exact, share>>, in order."""
    templates = templates or default_templates()
    item = F.struct("template", "diagonal", "ats")
    by_doc = hits(docs, templates).groupBy("doc_id", "text_hash", "n").agg(
        F.max(F.when(F.col("template") == -1, F.col("votes"))).alias("copies"),
        F.collect_list(F.when(F.col("template") >= 0, item)).alias("items"),
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for batch in batches:
            spans = [_spans(x, templates) if x else [] for x in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, _SPANS)], names=["doc_id", "n_words", "copies", "spans"])

    found = by_doc.select("doc_id", F.col("n").cast("bigint").alias("n_words"), "copies", "items")
    out = found.mapInArrow(run, f"doc_id bigint, n_words bigint, copies bigint, spans {SPANS}")
    return out.select("doc_id", "n_words", "spans", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_")).drop("_")
