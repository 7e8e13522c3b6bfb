"""URL filters: all glob rules are simulated at once, bit-parallel, over each canonical URL.

A URL's host is what stands between its first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; its path goes on to the
next ``?``, ``#`` or the end.  Its canonical form is ``.host#path``, in which ``#`` can only be the separator.  A rule is a host, a path
and a verdict, with globs in both: ``*`` stands for any characters, ``?`` for one.  A rule fits its host and all its subdomains and all paths
that begin with its own, so its pattern is ``*.host#path*``.

Each character of a pattern is one bit of a state of as many 64-bit words as all rules need, and each rule has a bit before its first
character.  A step shifts the state by one, with the carry from word to word, keeps the bits whose character is the one read, and adds the
bits that a ``*`` lets stay (Shift-And for patterns with gaps).  Characters that no rule names share one mask.  URLs of similar lengths go
through these steps together as the rows of an array, whose cells are bounded by ``CELLS``.

Of the fitting rules the longest wins (host and path); of equally long ones the longer host, then ``block``.
The given rules come before the globs of the method, and a URL that nothing fits is allowed.

Defined results: a null URL, an empty one and one without ``://`` have an empty host and path, which no rule with a host fits; URLs of any length
are read whole; repeated rows are judged each; an empty table gives no row; an empty list of rules allows all; other columns, whatever
their names, are carried.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import release_caches, set_aside, slices


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Words of hosts that offer betting, adult content, advertisements and copied pages, and paths of trackers.
GLOBS = [
    *(Rule(f"*{word}*", "", "block") for word in "adult casino bets porn spam xxx".split()),
    *(Rule(host, "", "block") for host in "ads.* ads-* *-ads.* adserver.* *-track.* track.* tracker.* click.* *-farm.*".split()),
    *(Rule("*", path, "block") for path in "/ads/ */ads/ */pixel.gif */track?.gif */login */signup */cart/".split()),
]

#: Columns that ``judge`` adds, or writes over.
RESULT = ["host", "path", "rule", "glob", "verdict"]
#: Numbers in one array of states.
CELLS = 1 << 19


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, url.substr(start + 3, F.length(url)))
    found = lambda group: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", group), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(found(1), upper, upper.lower()), found(2)


class Automaton:
    """Masks of all rules: ``follow[c]`` has the bits whose character is of class c, ``stay`` those before a ``*``."""

    def __init__(self, rules: list[Rule]):
        patterns = [f"*.{r.host}#{r.path}*" for r in rules]
        bits = sum(len(p.replace("*", "")) + 1 for p in patterns)
        self.words = max(1, -(-bits // 64))
        letters = sorted({ord(c) for p in patterns for c in p} - {ord("*"), ord("?")})
        self.letters = np.array(letters, np.uint32)
        follow = [0] * (len(letters) + 1)  # the last is any other character
        start = stay = 0
        self.ends: list[int] = []
        bit = 0
        for p in patterns:
            start |= 1 << bit
            for c in p:
                if c == "*":
                    stay |= 1 << bit
                    continue
                bit += 1
                for k, letter in enumerate([*letters, -1]):
                    # a wildcard for one character can't be the separator
                    if letter == ord(c) or c == "?" and letter != ord("#"):
                        follow[k] |= 1 << bit
            self.ends.append(bit)
            bit += 1
        self.start, self.stay = self._array([start])[0], self._array([stay])[0]
        self.follow = self._array(follow)

    def _array(self, masks: list[int]) -> np.ndarray:
        return np.frombuffer(b"".join(m.to_bytes(8 * self.words, "little") for m in masks), "<u8").reshape(len(masks), self.words)

    def _classes(self, characters: np.ndarray) -> np.ndarray:
        if not len(self.letters):
            return np.zeros(len(characters), np.int64)
        at = np.minimum(np.searchsorted(self.letters, characters), len(self.letters) - 1)
        return np.where(self.letters[at] == characters, at, len(self.letters))

    def _states(self, texts: list[str]) -> np.ndarray:
        """The state after each text; they come by descending length."""
        longest = len(texts[0])
        grid = np.zeros((longest, len(texts)), np.int64)
        live = np.zeros(longest, np.int64)
        for i, t in enumerate(texts):
            grid[: len(t), i] = self._classes(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32))
            live[: len(t)] = i + 1
        state = np.tile(self.start, (len(texts), 1))
        for t in range(longest):
            now = state[: live[t]]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= self.follow[grid[t, : live[t]]]
            now &= self.stay
            now |= moved
        return state

    def fitting(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Places of the texts, part by part, and a column for each rule that tells which of them fit."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        words, shifts = np.array(self.ends) // 64, (np.array(self.ends) % 64).astype(np.uint64)
        at = 0
        while at < len(order):
            n = max(1, CELLS // max(self.words, len(self.ends), len(texts[order[at]]), 1))
            part = order[at : at + n]
            yield part, (self._states([texts[i] for i in part])[:, words] >> shifts & np.uint64(1)).astype(bool)
            at += n


def ranked(rules: list[Rule]) -> list[Rule]:
    """The rule that wins comes first."""
    return sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block", r.text))


def judge(pages: DataFrame, rules: list[Rule], globs: list[Rule] = GLOBS) -> DataFrame:
    """The rows, with ``host``, ``path``, ``rule`` (null where none fits), ``glob`` (the method's own that fits) and ``verdict``."""
    rules, globs = ranked(rules), ranked(globs)
    rows, names = set_aside(pages)
    host, path = host_and_path(F.col(names["url"]))
    carried = [c for name, c in names.items() if name not in RESULT]
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in carried), *(f"_{c} string" for c in RESULT)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        both = Automaton(rules + globs)
        for part in slices(batches, "canonical"):
            first = {True: np.full(part.num_rows, -1), False: np.full(part.num_rows, -1)}
            if rules or globs:
                for places, fits in both.fitting(part.column("canonical").to_pylist()):
                    for given, columns in ((True, fits[:, : len(rules)]), (False, fits[:, len(rules) :])):
                        if columns.shape[1]:
                            first[given][places] = np.where(columns.any(axis=1), columns.argmax(axis=1), -1)
            rule = [rules[i] if i >= 0 else None for i in first[True].tolist()]
            glob = [globs[i] if i >= 0 else None for i in first[False].tolist()]
            verdict = [r.verdict if r else g.verdict if g else "allow" for r, g in zip(rule, glob, strict=True)]
            told = [part.column("host"), part.column("path"), *(pa.array([r and r.text for r in x], pa.string()) for x in (rule, glob)), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *told], names=[*carried, *(f"_{c}" for c in RESULT)])

    parsed = rows.select(*carried, host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("canonical", F.concat(F.lit("."), "host", F.lit("#"), "path"))
    found = parsed.mapInArrow(run, schema)
    back = {c: name for name, c in names.items()}
    return found.toDF(*(back[c] for c in carried), *RESULT)
