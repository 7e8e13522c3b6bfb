"""Quality rules: a decision list learned from labelled statistics, applied as Spark conditional expressions.

Every statistic of a text is a built-in expression over its row.  Sequential covering learns the list: a rule grows by the
threshold that gains most information about low-quality texts until it covers no good one, is pruned back on rows it didn't
grow on, and joins the list if it is precise there, and if rules grown the same way on four fifths of the rows are on the fifth they
haven't seen.  The texts it covers go, and the next rule is learned from the rest.  Where a rule isn't precise enough, the next best first
condition is tried.  With few low-quality rows left, growing and pruning share all of them.
The list is an ordered chain of conjunctions, so ``explain`` or ``print`` shows all there is to a verdict.

The fit draws at most ``FIT_ROWS`` labelled ids (lowest hashes first) and uses the statistics of those texts that the base rule
leaves open, one for each id; verdicts read whole texts.

Defined results: a null or empty text has no words and fails the base rule; very long texts are read whole, in memory of one task; repeated
rows get a verdict each, and in the fit the one with the least text hash stands for its id; a label of 0 outweighs another of 1
for the same id, and null labels or ids are none; labels of one class only, or none, learn no rule; an empty table gives
no row; ``judge`` and ``keep_good`` carry all other columns, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import set_aside

FIT_ROWS = 8000
MIN_PRECISION = 0.98
#: Least share of low-quality rows among those that cross-validated rules cover, and least number of low-quality rows of a rule: of so
#: many labelled rows one, but 2 to 8.
HELD_PRECISION = 0.9
ROWS_A_COVER, LEAST_COVER, MOST_COVER = 500, 2, 8
FOLDS = 5
#: Low-quality rows that must be left to prune on rows of their own.
PRUNE_ROWS = 8
MAX_CONDITIONS = 4
MAX_RULES = 16
THRESHOLDS = 64

_SPACE = r"\x20\x09-\x0D"


def _removed(text: Column, pattern: str) -> Column:
    """How many characters a pattern of single characters takes from a text."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))).cast("bigint")


def _repeat_words(grams: Column) -> Column:
    """Words in the windows that occur at least twice: windows are sorted with their places, and the union of the
    repeated ones' words is measured along the text."""
    placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def starts(sorted_: Column) -> Column:
        same = lambda i, e: F.coalesce(F.get(sorted_, i)["g"] == e["g"], F.lit(False))
        return F.filter(sorted_, lambda e, i: same(i - 1, e) | same(i + 1, e))

    def measure(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, s: a + s)

    def bound(value: Column, use) -> Column:
        """``use`` of a value that is computed once."""
        return F.element_at(F.transform(F.array(value), use), 1)

    covered = bound(placed, lambda s: bound(F.sort_array(F.transform(starts(s), lambda e: e["i"])), measure))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), covered).otherwise(F.lit(0).cast("bigint"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """The rows with one more column, computed once for each row.

    As the output of a generator the value isn't copied into the filters and lambdas that use it, where the optimizer
    would otherwise put its whole expression, to be computed again for each element.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``row`` (a struct of the document's columns) and ``stats``, a struct of counts.  Texts are read as they are, in whole."""
    row, names = set_aside(docs)
    text = F.coalesce(names["text"], F.lit(""))
    words = F.filter(F.split(text, f"[{_SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{_SPACE}]"))
    parts = F.struct(
        F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"),
        F.size(lines).alias("lines"),
        F.size(F.array_distinct(lines)).alias("line_kinds"),
    )
    a = _once(row, "parts", parts)
    hashes = F.col("parts.hashes")
    n = F.size(hashes)
    grams = F.transform(
        F.slice(hashes, 1, F.greatest(n - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2)),
    )
    b = _once(a, "grams", grams)
    counts = {
        "n_words": n.cast("bigint"),
        "word_chars": F.char_length(F.regexp_replace(text, f"[{_SPACE}]+", "")).cast("bigint"),
        "n_symbols": _removed(text, "[#*$%&|<>]+"),
        "n_dup_lines": (F.col("parts.lines") - F.col("parts.line_kinds")).cast("bigint"),
        "n_repeat_words": _repeat_words(F.col("grams")),
        "n_lines": F.col("parts.lines").cast("bigint"),
        "n_capitals": _removed(text, "[A-Z]+"),
        "n_marks": _removed(text, "[!?]+"),
        "n_digits": _removed(text, "[0-9]+"),
    }
    own = F.struct(*(F.col(c).alias(name) for name, c in names.items())).alias("row")
    return _once(b, "stats", F.struct(*(x.alias(k) for k, x in counts.items()))).select(own, "stats")


#: What rules look at: a name and how it follows from the counts.
_SHARES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "digits": ("n_digits", "word_chars"),
    "word_length": ("word_chars", "n_words"),
}


def features(stats: Column) -> dict[str, Column]:
    shares = {k: stats[a] / F.greatest(stats[b], F.lit(1)) for k, (a, b) in _SHARES.items()}
    return shares | {"n_words": stats["n_words"].cast("double")}


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


@dataclass(frozen=True)
class Rule:
    """All conditions (feature, "<=" or ">", threshold) hold: the text is bad."""

    conditions: tuple[tuple[str, str, float], ...]

    def __str__(self) -> str:
        return " and ".join(f"{f} {o} {t:.6g}" for f, o, t in self.conditions)


def _holds(x: dict[str, np.ndarray], condition: tuple[str, str, float]) -> np.ndarray:
    f, o, t = condition
    return x[f] > t if o == ">" else x[f] <= t


def _covers(x: dict[str, np.ndarray], conditions) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in conditions:
        out &= _holds(x, c)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, barred: frozenset[tuple[str, str]] = frozenset()) -> list[tuple[str, str, float]]:
    """Conditions by gain of information; ``barred`` has features and directions that can't come first."""
    if not bad.any():
        return []
    conditions: list[tuple[str, str, float]] = []
    inside = np.ones(len(bad), bool)
    while len(conditions) < MAX_CONDITIONS and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        before = np.log2(p0 / (p0 + n0))
        best: tuple[float, tuple[str, str, float] | None] = (0.0, None)
        for f, v in x.items():
            own = np.unique(v[inside])
            if len(own) < 2:
                continue
            middle = (own[1:] + own[:-1]) / 2
            at = np.unique(np.linspace(0, len(middle) - 1, THRESHOLDS).astype(int))
            good_v, bad_v = np.sort(v[inside & ~bad]), np.sort(v[inside & bad])
            # beside even steps, the places just beyond the good rows
            edge = np.searchsorted(own, [good_v[0], good_v[-1]])
            at = np.unique(np.clip(np.concatenate([at, edge - 1, edge]), 0, len(middle) - 1))
            for t in middle[at]:
                p_low, n_low = np.searchsorted(bad_v, t, "right"), np.searchsorted(good_v, t, "right")
                for o, p, n in (("<=", p_low, n_low), (">", p0 - p_low, n0 - n_low)):
                    if not conditions and (f, o) in barred:
                        continue
                    if p and (gain := p * (np.log2(p / (p + n)) - before)) > best[0]:
                        best = (gain, (f, o, float(t)))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside &= _holds(x, best[1])
    return conditions


def _rows(x: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {f: v[rows] for f, v in x.items()}


def _tally(x: dict[str, np.ndarray], bad: np.ndarray, conditions, rows: np.ndarray) -> tuple[int, int]:
    """How many bad and good ones of the rows the conditions cover."""
    inside = _covers(x, conditions) & rows
    return int((inside & bad).sum()), int((inside & ~bad).sum())


def _rule(x, bad: np.ndarray, left: np.ndarray, prune: np.ndarray, fold: np.ndarray, least: int) -> list[tuple[str, str, float]]:
    """The best rule over the rows that are left and passes all gates; none if no first condition gives one."""
    few = (left & bad & prune).sum() < PRUNE_ROWS
    grown, kept = (left, left) if few else (left & ~prune, left & prune)
    barred: frozenset[tuple[str, str]] = frozenset()

    def worth(c) -> float:
        p, n = _tally(x, bad, c, kept)
        return (p - n) / max(1, p + n)

    while conditions := _grow(_rows(x, grown), bad[grown], barred):
        first = conditions[0][:2]
        while len(conditions) > 1:
            best = max((conditions[:i] + conditions[i + 1 :] for i in range(len(conditions))), key=worth)
            if worth(best) < worth(conditions):
                break
            conditions = best
        p, n = _tally(x, bad, conditions, left)
        if p >= least and p >= MIN_PRECISION * (p + n) and worth(conditions) >= 2 * MIN_PRECISION - 1:
            held = [0, 0]
            for k in range(FOLDS):
                seen = left & (fold != k)
                again = _grow(_rows(x, seen), bad[seen], barred)
                if again:
                    got = _tally(x, bad, again, left & (fold == k))
                    held = [held[0] + got[0], held[1] + got[1]]
            if 2 * held[0] >= p and held[0] >= HELD_PRECISION * sum(held):
                return conditions
        barred |= {first}
    return []


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 11) -> list[Rule]:
    """Rules in order, from the features of labelled rows and whether each is bad."""
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    prune, fold = rng.random(len(bad)) < 1 / 3, rng.integers(0, FOLDS, len(bad))
    least = min(max(LEAST_COVER, len(bad) // ROWS_A_COVER), MOST_COVER)
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES and (left & bad).sum() >= least:
        conditions = _rule(x, bad, left, prune, fold, least)
        if not conditions:
            break
        rules.append(Rule(tuple(conditions)))
        left &= ~_covers(x, conditions)
    return rules


def verdict(rules: list[Rule], stats: Column) -> Column:
    """True (kept) unless a rule of the list holds: an ordered chain of conditions."""
    own = features(stats)
    out = None
    for rule in rules:
        holds = None
        for f, o, t in rule.conditions:
            c = own[f] > t if o == ">" else own[f] <= t
            holds = c if holds is None else holds & c
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[Rule]:
    """Rules from at most ``rows`` labelled ids; only the statistics of one text for each reach the driver."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most `rows` ids
    stats = F.col("stats")
    own = features(stats)
    found = with_statistics(texts).filter(~base_failed(stats))
    values = F.struct(F.xxhash64("row.text").alias("hash"), "row.quality", *(c.alias(k + "_") for k, c in own.items()))
    table = sorted(found.groupBy("row.doc_id").agg(F.min(values).alias("v")).collect())
    if not table:
        return []
    bad = np.array([r["v"]["quality"] == 0 for r in table])
    return learn({k: np.array([r["v"][k + "_"] for r in table]) for k in own}, bad)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``row`` (a struct of the document's columns), ``stats``, ``base_failed`` and ``kept``."""
    stats = F.col("stats")
    failed = base_failed(stats)
    return with_statistics(docs).select("row", "stats", failed.alias("base_failed"), (~failed & verdict(rules, stats)).alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return judge(docs, rules).filter("kept").select("row.*")
