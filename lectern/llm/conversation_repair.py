"""Conversation structure repair: the cheapest edits that give turns in the order of ``(s?(ua)+)?``, by a time-major tensor DP.

A row's first fault counts: blank (white space only), duplicate (its role and text stand earlier in the conversation), truncated (the last
character that isn't white space ends no sentence).  A row is kept (0), given the role user or assistant (1) or deleted (2, a must for blank
and duplicate ones); a truncated row that stays costs 5 more, and an empty user or assistant turn can be put in anywhere (5).  Of the cheapest
edits those whose initials (K, R, D, I) are least in ASCII order are taken; these tell the roles, so the result is one.

There are four states: nothing said, a system turn, a user's turn, an assistant's turn; the first and the last may end a conversation.
Conversations are dealt out by ranges of their sorted rows and cut into pieces where a range or a slice ends, so one conversation of any
length is many pieces and no task holds it.  Pieces of similar lengths go through the DP together, each turn at once for all of them:

1. from the last turn to the first, the costs from each state to each state, a (min, +) matrix for each piece;
2. the matrices of the few conversations in several pieces are multiplied from their ends, which gives the costs that each piece ends with;
3. the backward costs are stored for each turn, and the edits are traced forward, for pieces that don't begin a conversation from
   each of the four states; which of these it is, the pieces before tell.

Exact copies are counted before rows are dealt out, and what is said earlier is a minimum of turns joined back.

Defined results: a conversation's rows stand by turn (nulls first), then role, text, number of the copy (by the role's first 32 and the text's
first 64 characters before the copy); a null role or text is empty, and a role without a first letter s, u or a can't be kept; a null conv_id is
a conversation; repeated rows are duplicates; texts of any length are kept whole and not read by Python beyond slices; ``gaps`` is null where
64 bits can't hold it; an empty table gives no row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import release_caches, slices
from lectern.storage import stored

#: States: nothing said, after a system, user or assistant turn.
STATES = 4
#: The state after a user or assistant turn that is put in or given another role.
NEXT = np.array([2, 2, 3, 2])
#: What the end of a conversation costs from each state.
FINAL = np.array([0, 10, 5, 0], np.int64)
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
FAR = 1 << 50
#: A row's code is 4 times its role's initial (another, s, u, a) and its fault (none, blank, duplicate, truncated); PAD is no row.
PAD = 16
#: Pairs of initials that may stand together: su, ua, au.
LEGAL = [4 * 1 + 2, 4 * 2 + 3, 4 * 3 + 2]
SPACE = " \t\n\x0b\x0c\r"


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code and state: the cost of keeping a row, the state after it; by code: the cost of another role."""
    keep, after = np.full((PAD + 1, STATES), FAR, np.int64), np.zeros((PAD + 1, STATES), np.int64)
    rerole = np.full(PAD + 1, FAR, np.int64)
    legal = {1: {0: 1}, 2: {0: 2, 1: 2, 3: 2}, 3: {2: 3}}
    for code in range(PAD):
        initial, fault = divmod(code, 4)
        if fault in (1, 2):
            continue
        more = TRUNCATED if fault == 3 else 0
        rerole[code] = REROLE + more
        for state, then in legal.get(initial, {}).items():
            keep[code, state], after[code, state] = more, then
    return keep, after, rerole


KEEP, AFTER, OTHER_ROLE = _tables()
D, I, K, R = b"DIKR"  # noqa: E741  the edits' initials


def step(costs: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Costs [piece, state, end] before a turn, from those after it."""
    own = np.arange(len(codes))[:, None]
    before = np.minimum(costs + DELETE, costs[:, NEXT] + OTHER_ROLE[codes][:, None, None])
    before = np.minimum(before, costs[own, AFTER[codes]] + KEEP[codes][:, :, None])
    for _ in range(2):  # two turns at most are put in before a row
        before = np.minimum(before, before[:, NEXT] + INSERT)
    return np.where((codes == PAD)[:, None, None], costs, before)


def transfers(codes: np.ndarray) -> np.ndarray:
    """The cost from each state to each state of pieces, [turn, piece] codes."""
    costs = np.tile(np.where(np.eye(STATES, dtype=bool), 0, FAR)[None], (codes.shape[1], 1, 1))
    for row in codes[::-1]:
        costs = step(costs, row)
    return np.minimum(costs, FAR)


def trace(codes: np.ndarray, lengths: np.ndarray, ends: np.ndarray, last: np.ndarray, piece: np.ndarray, state: np.ndarray):
    """Edits of lanes, each a piece and the state that it begins in.

    ``codes`` are [turn, piece], ``ends`` the costs that each piece ends with.  Returns the initials and the state after each edit
    ([lane, edit], zero beyond a lane's last), the lanes' last states and costs.
    """
    turns = len(codes)
    costs = np.empty((turns + 1, len(lengths), STATES), np.int64)
    costs[turns] = ends
    for t in range(turns - 1, -1, -1):
        costs[t] = step(costs[t + 1][:, :, None], codes[t])[:, :, 0]
    at, total = np.zeros(len(piece), np.int64), np.zeros(len(piece), np.int64)
    initials, states = [], []
    while True:
        now = costs[at, piece, state]
        left = at < lengths[piece]
        active = left | last[piece] & (now > 0)
        if not active.any():
            break
        code, then = codes[np.minimum(at, turns - 1), piece], np.minimum(at + 1, turns)
        kept, other, put = AFTER[code, state], NEXT[state], NEXT[state]
        options = [
            (left & (costs[then, piece, state] + DELETE == now), D, state, DELETE),
            (costs[at, piece, put] + INSERT == now, I, put, INSERT),
            (left & (costs[then, piece, kept] + KEEP[code, state] == now), K, kept, KEEP[code, state]),
            (left & (costs[then, piece, other] + OTHER_ROLE[code] == now), R, other, OTHER_ROLE[code]),
        ]
        tests = [active & test for test, *_ in options]
        initial = np.select(tests, [x[1] for x in options], 0).astype(np.uint8)
        total += np.select(tests, [x[3] for x in options], 0)
        state = np.select(tests, [x[2] for x in options], state)
        at = at + (active & (initial != I))
        initials.append(initial)
        states.append(state)
    if not initials:
        return np.zeros((len(piece), 0), np.uint8), np.zeros((len(piece), 0), np.int64), state, total
    return np.stack(initials, 1), np.stack(states, 1), state, total


def by_length(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Places of pieces whose lengths have the same number of bits."""
    bits = np.frexp(lengths.astype(np.float64))[1]
    for b in np.unique(bits):
        yield np.flatnonzero(bits == b)


def grid(codes: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """[turn, piece] codes of pieces of one flat array."""
    turns = np.arange(int(lengths.max()))[:, None]
    inside = turns < lengths[None]
    return np.where(inside, codes[np.where(inside, begins[None] + turns, 0)], PAD)


def _codes(rows: DataFrame) -> DataFrame:
    """One row for each copy, with its code."""
    plain = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    folded = plain.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    folded = folded.withColumn("hash", F.unhex(F.sha2("text", 256)))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = plain.select("conv_id", "role", F.unhex(F.sha2("text", 256)).alias("hash"), when.alias("when")).groupBy("conv_id", "role", "hash").agg(F.min("when").alias("first"))
    first = first.toDF("_conv", "_role", "_hash", "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("hash") == F.col("_hash"))
    each = folded.join(first, same).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    text = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(text == "", 1)
        .when((F.col("copy") > 1) | ~when.eqNullSafe(F.col("first")), 2)
        .when(~F.right(text, F.lit(1)).isin(".", "!", "?"), 3)
        .otherwise(0)
    )
    initial = F.instr(F.lit("sua"), F.left("role", F.lit(1)))
    code = 4 * F.when(F.col("role") == "", 0).otherwise(initial) + fault
    return each.select("conv_id", "turn", "role", "text", "copy", code.cast("int").alias("code"))


NUMBERS = "blank duplicate truncated illegal turns min_turn first_turn last_turn first_code last_code".split()
_KINDS = ", ".join(f"{c} bigint" for c in NUMBERS)
#: edge: the piece is the first or the last of a slice, so its conversation may have more.
PIECES = f"piece bigint, conv_id bigint, edge boolean, roles array<string>, texts array<string>, codes binary, costs array<bigint>, {_KINDS}"


def _changes(values: pa.Array) -> np.ndarray:
    """Which values differ from the one before; a null equals a null."""
    known = values.is_valid().to_numpy(zero_copy_only=False)
    x = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
    return (x[1:] != x[:-1]) | (known[1:] != known[:-1])


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of sorted rows, with their counts and their matrices."""
    release_caches()
    number = TaskContext.get().partitionId() << 32
    for part in slices(batches):
        n = part.num_rows
        conv, turn = part.column("conv_id"), part.column("turn")
        begins = np.flatnonzero(np.concatenate(([True], _changes(conv))))
        lengths = np.diff(np.append(begins, n))
        codes = part.column("code").to_numpy()
        first = np.zeros(n, bool)
        first[begins] = True
        initial, fault = codes // 4, codes % 4
        legal = np.isin(np.append(0, initial[:-1] * 4 + initial[1:]), LEGAL)
        known = turn.is_valid().to_numpy(zero_copy_only=False)
        counts = [fault == 1, fault == 2, fault == 3, ~first & ~legal, known & (first | np.append(True, _changes(turn)))]
        counts = [np.add.reduceat(x.astype(np.int64), begins) for x in counts]
        ends = begins + lengths - 1
        n_known = np.add.reduceat(known.astype(np.int64), begins)
        edge = np.isin(np.arange(len(begins)), [0, len(begins) - 1])
        costs = np.empty((len(begins), STATES, STATES), np.int64)
        for own in by_length(lengths):
            costs[own] = transfers(grid(codes, begins[own], lengths[own]))
        offsets = pa.array(np.append(begins, n).astype(np.int32))
        code_bytes = codes.astype(np.uint8).tobytes()
        columns = [
            pa.array(number + np.arange(len(begins))),
            conv.take(pa.array(begins)),
            pa.array(edge),
            pa.ListArray.from_arrays(offsets, part.column("role")),
            pa.ListArray.from_arrays(offsets, part.column("text")),
            pa.array([code_bytes[b : b + k] for b, k in zip(begins.tolist(), lengths.tolist(), strict=True)], pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.arange(len(begins) + 1, dtype=np.int32) * STATES**2), pa.array(costs.ravel())),
            *map(pa.array, counts),
            turn.take(pa.array(ends - n_known + 1, mask=n_known == 0)),
            turn.take(pa.array(begins)),
            turn.take(pa.array(ends)),
            pa.array(codes[begins].astype(np.int64)),
            pa.array(codes[ends].astype(np.int64)),
        ]
        number += len(begins)
        yield pa.RecordBatch.from_arrays(columns, names=["piece", "conv_id", "edge", "roles", "texts", "codes", "costs", *NUMBERS])


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each piece of a conversation ends with, from its last piece to its first."""
    for batch in batches:
        pieces, vectors, last, opens = [], [], [], []
        for found in batch.column("pieces").to_pylist():
            ends = FINAL
            for k, x in enumerate(reversed(found)):
                pieces.append(x["piece"])
                vectors.append(ends.tolist())
                last.append(k == 0)
                opens.append(k == len(found) - 1)
                ends = (np.array(x["costs"]).reshape(STATES, STATES) + ends).min(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int64()), pa.array(vectors, pa.list_(pa.int64())), pa.array(last, pa.bool_()), pa.array(opens, pa.bool_())], names=["of", "ends", "last", "opens"])


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that each piece of a conversation begins in, from its first piece to its last."""
    for batch in batches:
        pieces, states = [], []
        for found in batch.column("pieces").to_pylist():
            state = 0
            for x in found:
                pieces.append(x["piece"])
                states.append(state)
                state = x["exits"][state if len(x["exits"]) > 1 else 0]
        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int64()), pa.array(states, pa.int32())], names=["of", "entry"])


TRACED = f"piece bigint, conv_id bigint, edge boolean, lanes array<struct<audit: string, roles: array<string>, texts: array<string>, exit: int, cost: bigint>>, {_KINDS}"


def _traced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and edited turns of each piece, for each state that it may begin in."""
    release_caches()
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            code_lists = part.column("codes").to_pylist()
            all_lengths = np.array([len(c) for c in code_lists])
            codes = np.frombuffer(b"".join(code_lists), np.uint8).astype(np.int64)
            all_begins = np.cumsum(all_lengths) - all_lengths
            ends = np.array(part.column("ends").to_pylist(), np.int64).reshape(-1, STATES)
            last, opens = (part.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("last", "opens"))
            rows = part.column("texts").flatten().__len__()
            roles = pa.concat_arrays([part.column("roles").flatten(), pa.array(["user", "assistant"], pa.string())])
            texts = pa.concat_arrays([part.column("texts").flatten(), pa.array([""], pa.string())])
            for own in by_length(all_lengths):
                begins, lengths = all_begins[own], all_lengths[own]
                n_lanes = np.where(opens[own], 1, STATES)
                piece = np.repeat(np.arange(len(own)), n_lanes)
                state = np.arange(len(piece)) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes)
                initials, states, exits, cost = trace(grid(codes, begins, lengths), lengths, ends[own], last[own], piece, state)
                used, stays = initials > 0, np.isin(initials, [I, K, R])
                read = used & (initials != I)
                row = begins[piece][:, None] + np.cumsum(read, axis=1) - read
                text_at = np.where(initials == I, rows, row)[stays]
                role_at = np.where(initials == K, row, rows + (states == 3))[stays]
                offsets = lambda mask: pa.array(np.append(0, np.cumsum(mask.sum(axis=1))).astype(np.int32))
                audit = pa.StringArray.from_buffers(len(piece), offsets(used).buffers()[1], pa.py_buffer(initials[used].tobytes()))
                lanes = pa.StructArray.from_arrays(
                    [
                        audit,
                        pa.ListArray.from_arrays(offsets(stays), roles.take(pa.array(role_at))),
                        pa.ListArray.from_arrays(offsets(stays), texts.take(pa.array(text_at))),
                        pa.array(exits.astype(np.int32)),
                        pa.array(cost),
                    ],
                    names=["audit", "roles", "texts", "exit", "cost"],
                )
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_lanes)).astype(np.int32)), lanes)
                carried = {c: part.column(c).take(pa.array(own)) for c in ("piece", "conv_id", "edge", *NUMBERS)}
                yield pa.RecordBatch.from_pydict({**carried, "lanes": lists}).select(["piece", "conv_id", "edge", "lanes", *NUMBERS])


def _in_order(pieces: DataFrame, value: str) -> DataFrame:
    """Of conversations that may have several pieces, a value of each in order."""
    groups = pieces.filter("edge").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", value))).alias("pieces"))
    return groups.select("pieces")


def repair(rows: DataFrame) -> DataFrame:
    """Pieces of repaired conversations from ``conv_id, turn, role, text``, in the order of ``piece``.

    Returns ``piece, conv_id, audit, roles, texts, cost``, and numbers of the rows before the repair: ``blank, duplicate, truncated,
    illegal`` and ``turns`` (pairs and distinct turns within the piece), ``min_turn, first_turn, last_turn, first_code, last_code``.
    """
    coded = stored(_codes(rows), "repair-rows")
    beginning = [F.left("role", F.lit(32)), F.left("text", F.lit(64)), F.col("copy")]
    dealt = coded.repartitionByRange("conv_id", "turn", *beginning).sortWithinPartitions("conv_id", "turn", *beginning, "role", "text")
    pieces = stored(dealt.mapInArrow(_cut, PIECES), "repair-pieces")
    ends = _in_order(pieces, "costs").mapInArrow(_ends, "of bigint, ends array<bigint>, last boolean, opens boolean")
    edges = pieces.join(ends, F.col("piece") == F.col("of"))
    final = F.array(*(F.lit(int(x)).cast("bigint") for x in FINAL)).alias("ends")
    whole = pieces.filter("NOT edge").select("*", final, F.lit(True).alias("last"), F.lit(True).alias("opens"))
    known = whole.drop("costs").unionByName(edges.drop("costs", "of"))
    traced = stored(known.mapInArrow(_traced, TRACED), "repair-traced")
    exits = traced.select("piece", "conv_id", "edge", F.col("lanes.exit").alias("exits"))
    entries = _in_order(exits, "exits").mapInArrow(_entries, "of bigint, entry int")
    entered = traced.join(entries, F.col("piece") == F.col("of")).withColumn("entry", F.when(F.size("lanes") > 1, F.col("entry")).otherwise(0))
    found = traced.filter("NOT edge").withColumn("entry", F.lit(0)).unionByName(entered.drop("of"))
    return found.withColumn("lane", F.col("lanes")[F.col("entry")]).select("piece", "conv_id", "lane.audit", "lane.roles", "lane.texts", "lane.cost", *NUMBERS)


def summaries(pieces: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """A row for each conversation of ``repair``: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` and ``digest`` of its
    repaired turns, as ``role:text`` in lines of one text."""
    order = Window.partitionBy("conv_id").orderBy("piece")
    told = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    parts = pieces.withColumn("_part", F.struct("piece", "audit", F.size("roles").alias("n"), told.alias("told")))
    parts = parts.select("conv_id", "_part", "cost", *NUMBERS, *(F.lag(c).over(order).alias(f"_{c}") for c in ("last_turn", "last_code")))
    initial = lambda c: F.floor(F.col(c) / 4)
    legal = (initial("_last_code") * 4 + initial("first_code")).isin(*LEGAL)
    seam = F.when(F.col("_last_code").isNotNull() & ~legal, 1).otherwise(0)
    again = F.when(F.col("_last_turn") == F.col("first_turn"), 1).otherwise(0)
    found = parts.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "cost")),
        F.sum(F.col("illegal") + seam).alias("illegal"),
        F.try_add(F.try_subtract(F.max("last_turn"), F.min("min_turn")), 1 - F.sum(F.col("turns") - again)).alias("gaps"),
        F.max("last_turn").alias("_last"),
        F.sort_array(F.collect_list("_part")).alias("_parts"),
    )
    lines = F.transform(F.filter("_parts", lambda p: p["n"] > 0), lambda p: p["told"])
    return found.select(
        "conv_id",
        F.when(F.col("_last").isNull(), F.lit(0)).otherwise(F.col("gaps")).cast("bigint").alias("gaps"),
        "blank",
        "duplicate",
        "truncated",
        "illegal",
        "cost",
        F.array_join(F.transform("_parts", lambda p: p["audit"]), "").alias("audit"),
        digest(F.array_join(lines, "\n")).alias("digest"),
    )
