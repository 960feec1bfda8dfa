"""Repair of conversations: the cheapest edits that make their turns alternate, over a grammar.

A conversation's turns, in order, become symbols: the initial of the role (s, u, a, other) with or
without the fault `truncated`, or "must go" for blank and duplicate turns. A repaired conversation
is empty or an optional s followed by one or more ua, which four states track: nothing yet, after s,
after u, after a. Each symbol has a min-plus matrix: the cheapest way from state to state over that
turn, inserts before it included. Re-Pair (`pair_grammar`) shares rules between the conversations of
a batch; each rule's matrix is the min-plus product of its parts' matrices, made once, bottom-up.

The audit of a rule is a rope: for each pair of states the state between its two parts. Of equal
costs the ASCII-least audit wins. Audits over the same turns from the same state never are prefixes
of each other (inserts stand before turns, so each ends with its last turn's edit), so the order of
a rope follows from the order of its left part, then of its right part: a matrix carries, beside its
costs, the order of its audits from each state, and no string is built to compare.

Turns are sorted by range over (conversation, turn, role, text), so a conversation of any size
spreads over tasks. Each Arrow batch makes its own grammar. Conversations that lie inside a batch are
solved there. One that touches a batch's edge may go on in the next: its turns carry the edits for
all pairs of states, its matrix (32 numbers a batch) is combined with those of its other batches in
order, and the states found select the edits.

Faults: blank (no character but white space of ASCII), duplicate (role and text of an earlier turn),
truncated (last other character none of . ! ?); the first that holds counts. Nulls in role and text
are one space. Turns are ordered by turn (nulls first), then role and text; rows equal in all are
one row with a number of copies, of which the first may stay. A null conversation id is a
conversation of its own. Empty tables give empty results. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.llm.common import stored
from bazaarlens.llm.pair_grammar import build_grammar

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a. What an inserted or reroled turn must be, and leads to.
WANTED = ("u", "u", "a", "u")
AFTER = (2, 2, 3, 2)
#: Inserts that end a conversation in each state.
CLOSING = (0, 2, 1, 0)
NAMES = {"u": "user", "a": "assistant"}
INITIALS = "sua"
#: Symbols: 2 * role + truncated for roles s, u, a, other; then "must go", as often as a power of two.
GONE = 8
TERMINALS = GONE + 40
NEVER = np.int64(1 << 50)
SPACE = r"[\x20\x09-\x0D]"


def _turn_ways(symbol: int, state: int) -> dict[int, tuple[int, str, str, str | None]]:
    """By end state: cost, edits, inserted lines and the role of the turn ('' as it is, None if gone)."""
    if symbol >= GONE:
        return {state: (DELETE << (symbol - GONE), "D", "", None)}
    role, more = symbol // 2, TRUNCATED * (symbol % 2)
    found: dict[int, tuple[int, str, str, str | None]] = {state: (DELETE, "D", "", None)}
    at, edits, lines, cost = state, "", "", 0
    for _ in range(3):  # more inserts only come back to a state met before
        ways = [(AFTER[at], (cost + REROLE + more, edits + "R", lines, NAMES[WANTED[at]]))]
        if role == 0 and at == 0:
            ways.append((1, (cost + KEEP + more, edits + "K", lines, "")))
        elif role < 3 and INITIALS[role] == WANTED[at]:
            ways.append((AFTER[at], (cost + KEEP + more, edits + "K", lines, "")))
        for end, way in ways:
            if end not in found or way[:2] < found[end][:2]:
                found[end] = way
        lines += NAMES[WANTED[at]] + ":\n"
        at, edits, cost = AFTER[at], edits + "I", cost + INSERT
    return found


WAYS = {(x, i, j): way for x in range(TERMINALS) for i in range(4) for j, way in _turn_ways(x, i).items()}


def _terminal_matrices() -> tuple[np.ndarray, np.ndarray]:
    cost = np.full((TERMINALS, 4, 4), NEVER)
    order = np.zeros((TERMINALS, 4, 4), np.int64)
    for (x, i, j), way in WAYS.items():
        cost[x, i, j] = way[0]
    for x in range(TERMINALS):
        for i in range(4):
            ranked = sorted(range(4), key=lambda j: (0, WAYS[x, i, j][1]) if (x, i, j) in WAYS else (1, ""))
            order[x, i, ranked] = range(4)
    return cost, order


def product(
    a: np.ndarray, a_order: np.ndarray, b: np.ndarray, b_order: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Min-plus products of stacked matrices: costs, order of the audits from each state, states between."""
    total = a[:, :, :, None] + b[:, None, :, :]  # from, between, to
    total = np.minimum(total, NEVER)
    via = np.argmin(total * 4 + a_order[:, :, :, None], axis=2)
    cost = np.take_along_axis(total, via[:, :, None, :], axis=2)[:, :, 0, :]
    first = np.take_along_axis(a_order, via, axis=2)
    rows = np.arange(len(b))[:, None, None]
    key = first * 4 + b_order[rows, via, np.arange(4)[None, None, :]] + np.where(cost >= NEVER, 64, 0)
    order = np.argsort(np.argsort(key, axis=2, kind="stable"), axis=2, kind="stable")
    return cost, order, via


def best_end(cost: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The end state of the cheapest closed conversation, from costs and orders by end state."""
    return np.argmin((cost + np.array(CLOSING) * INSERT) * 4 + order, axis=-1)


def solve_batch(symbols: np.ndarray, owner: np.ndarray, sequences: int) -> tuple:
    """Grammar, costs and orders of each sequence (n, 4, 4), and the states between by rule."""
    grammar = build_grammar(symbols, owner, sequences, TERMINALS)
    cost = np.full((len(grammar.size), 4, 4), NEVER)
    order = np.zeros((len(grammar.size), 4, 4), np.int64)
    via = np.zeros((len(grammar.left), 4, 4), np.int8)
    cost[:TERMINALS], order[:TERMINALS] = _terminal_matrices()
    for a, b in grammar.levels:
        x, y = grammar.left[a:b], grammar.right[a:b]
        made = product(cost[x], order[x], cost[y], order[y])
        cost[TERMINALS + a : TERMINALS + b], order[TERMINALS + a : TERMINALS + b], via[a:b] = made
    return grammar, cost[grammar.roots], order[grammar.roots], via


def unrolled(grammar, via: np.ndarray, symbol: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray):
    """(place, symbol, state before, state after) of all terminals below the given symbols and states."""
    out = []
    while len(symbol):
        leaf = symbol < grammar.terminals
        out.append(np.stack([place[leaf], symbol[leaf], start[leaf], end[leaf]]))
        symbol, start, end, place = (x[~leaf] for x in (symbol, start, end, place))
        rule = symbol - grammar.terminals
        between = via[rule, start, end].astype(np.int64)
        left, right = grammar.left[rule], grammar.right[rule]
        symbol, start, end, place = (
            np.concatenate(x)
            for x in ((left, right), (start, between), (between, end), (place, place + grammar.size[left]))
        )
    return np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)


def _marked(df: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """One row for each different turn: copies, fault and symbol."""
    rows = df.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(role, F.lit(" ")).alias("role"),
        F.coalesce(text, F.lit(" ")).alias("text"),
        (F.col(copies).cast("long") if copies else F.lit(1).cast("long")).alias("copies"),
    )
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("text_key", F.sha2("text", 256)).withColumn(
        "at", F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    )
    rows = rows.withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    # the first turn with a role and text; a hot text is one row there, and adaptive joins split its turns
    firsts = (
        rows.where("NOT blank")
        .groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text_key").alias("k"))
        .agg(F.min("at").alias("first"))
    )
    rows = rows.join(
        firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text_key") == F.col("k")), "left"
    )
    whole = F.col("text").rlike(rf"[.!?]{SPACE}*\z")
    fault = (
        F.when(F.col("blank"), "blank")
        .when(F.col("at") > F.col("first"), "duplicate")
        .when(~whole, "truncated")
        .otherwise("")
    )
    initial = F.substring("role", 1, 1)
    number = F.coalesce(*(F.when(initial == c, i) for i, c in enumerate(INITIALS)), F.lit(3))
    return rows.withColumn("fault", fault).select(
        "conv_id", "turn", "role", "text", "copies", "fault",
        F.when(F.col("fault").isin("blank", "duplicate"), GONE)
        .otherwise(number * 2 + (F.col("fault") == "truncated").cast("int"))
        .alias("symbol"),
    )


def _batch_edits(batch: pa.RecordBatch, part: int, names: list[str]) -> pa.RecordBatch:
    """The batch's turns with their edits; see `repair_turns`."""
    n = batch.num_rows
    codes = batch.column("conv_id").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    begins = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    conversation = np.cumsum(np.r_[False, codes[1:] != codes[:-1]])
    sequences = len(begins)
    symbol = batch.column("symbol").to_numpy().astype(np.int64)
    copies = batch.column("copies").to_numpy()
    # each turn is its symbol, then "must go" for the binary digits of its other copies
    digits = [np.zeros(n, np.int64)]
    rows = [np.arange(n)]
    for bit in range(int(copies.max()).bit_length()):
        more = np.flatnonzero(((copies - 1) >> bit) & 1)
        rows.append(more)
        digits.append(np.full(len(more), GONE + bit))
    row = np.concatenate(rows)
    flat = np.concatenate([symbol, *digits[1:]])
    order = np.argsort(row, kind="stable")
    row, flat, own_symbol = row[order], flat[order], (order < n)
    grammar, cost, ranks, via = solve_batch(flat, conversation[row], sequences)
    begin_flat = np.searchsorted(conversation[row], np.arange(sequences))

    edge = np.zeros(sequences, bool)
    edge[[0, -1]] = True
    end = best_end(cost[:, 0], ranks[:, 0])
    seq = np.flatnonzero(~edge)
    symbols, starts, ends, places = grammar.roots[seq], np.zeros(len(seq), np.int64), end[seq], begin_flat[seq]
    a, b = np.divmod(np.arange(16), 4)
    for s in np.flatnonzero(edge).tolist():  # all pairs of states of the one or two at the edges
        can = cost[s, a, b] < NEVER
        symbols = np.r_[symbols, np.full(can.sum(), grammar.roots[s])]
        starts, ends = np.r_[starts, a[can]], np.r_[ends, b[can]]
        variant = (np.arange(16) + 1)[can]
        places = np.r_[places, begin_flat[s] + variant * len(flat)]
    found = unrolled(grammar, via, symbols, starts, ends, places)
    slot, at = np.divmod(found[0], len(flat))
    real = own_symbol[at]
    slot, at, found = slot[real], at[real], found[:, real]
    code = found[1] * 16 + found[2] * 4 + found[3]
    ways = np.full((n, 16), -1, np.int16)
    ways[row[at], np.maximum(slot - 1, 0)] = code
    open_ = edge[conversation]
    width = np.where(open_, 16, 1)
    picked = ways[np.arange(16)[None, :] < width[:, None]]
    offsets = np.r_[0, np.cumsum(width)].astype(np.int32)
    last = np.r_[begins[1:], n] - 1
    tail = np.full(n, -1, np.int64)
    tail[last[~edge]] = np.array(CLOSING)[end[~edge]]
    matrix: list = [None] * n
    for s in np.flatnonzero(edge).tolist():
        matrix[last[s]] = np.r_[cost[s].ravel(), ranks[s].ravel()].tolist()
    made = [
        pa.array(np.full(n, part, np.int64)),
        pa.array(np.arange(n, dtype=np.int64)),
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(picked)),
        pa.array(tail),
        pa.array(matrix, pa.list_(pa.int64())),
    ]
    kept = [batch.column(c) for c in ("conv_id", "turn", "role", "text", "copies", "fault")]
    return pa.RecordBatch.from_arrays(kept + made, names=names)


def _chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States of each piece of the conversations that lie in several batches."""
    for batch in batches:
        for conv, pieces in zip(batch.column("conv_id"), batch.column("pieces").to_pylist()):
            cost, order = np.array([[[0, NEVER, NEVER, NEVER]]]), np.array([[[0, 1, 2, 3]]])
            back = []
            for piece in pieces:
                both = np.array(piece["matrix"], np.int64).reshape(2, 1, 4, 4)
                cost, order, via = product(cost, order, both[:1, 0], both[1:, 0])
                back.append(via[0, 0])
            end = int(best_end(cost[0, 0], order[0, 0]))
            tails = [-1] * (len(pieces) - 1) + [CLOSING[end]]
            slots = []
            for via in back[::-1]:
                slots.append(int(via[end]) * 4 + end)
                end = int(via[end])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([conv.as_py()] * len(pieces), batch.schema.field("conv_id").type),
                    pa.array([p["part"] for p in pieces], pa.int64()),
                    pa.array(slots[::-1], pa.int32()),
                    pa.array(tails, pa.int64()),
                ],
                names=["conv", "piece", "slot", "closing"],
            )


def repair_turns(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None
) -> DataFrame:
    """Turns with their cheapest edits: conv_id, turn, role, text, copies, fault, part, place, edits,
    inserted, new_role, tail.

    (part, place) order a conversation's turns. edits has the initials of Insert, then Keep, Rerole
    or Delete, then a Delete for each further copy. inserted has the lines before the turn, new_role
    the role it then has (null: it goes). tail, on the last turn only (else -1), is the number of
    turns inserted at the end. `copies` names a column of how often a row stands.
    """
    rows = _marked(df, conv, turn, role, text, copies)
    kept = ["conv_id", "turn", "role", "text", "copies", "fault"]
    schema = T.StructType(
        [rows.schema[c] for c in kept]
        + [
            T.StructField("part", T.LongType()),
            T.StructField("place", T.LongType()),
            T.StructField("ways", T.ArrayType(T.ShortType())),
            T.StructField("tail", T.LongType()),
            T.StructField("matrix", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        filled = (b for b in batches if b.num_rows)
        for k, batch in enumerate(filled):
            yield _batch_edits(batch, first + k, schema.names)

    keys = ("conv_id", "turn", "role", "text")
    in_order = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    planned = stored(in_order.mapInArrow(run, schema), "turn-edits")
    pieces = (
        planned.where("matrix IS NOT NULL")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("part", "matrix"))).alias("pieces"))
    )
    states = pieces.mapInArrow(
        _chained,
        T.StructType(
            [
                T.StructField("conv", schema["conv_id"].dataType),
                T.StructField("piece", T.LongType()),
                T.StructField("slot", T.IntegerType()),
                T.StructField("closing", T.LongType()),
            ]
        ),
    )
    states = stored(states, "turn-states")
    known = [(x * 16 + i * 4 + j, w[1], w[2], w[3]) for (x, i, j), w in WAYS.items()]
    table = df.sparkSession.createDataFrame(known, "code int, edits string, inserted string, as_role string")
    joined = planned.join(states, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("piece")), "left")
    code = F.get("ways", F.coalesce("slot", F.lit(0)))
    return joined.withColumn("code", code.cast("int")).join(F.broadcast(table), "code").select(
        *kept, "part", "place",
        F.concat("edits", F.repeat(F.lit("D"), (F.col("copies") - 1).cast("int"))).alias("edits"),
        "inserted",
        F.when(F.col("as_role") == "", F.col("role")).otherwise(F.col("as_role")).alias("new_role"),
        F.when(F.col("matrix").isNull(), F.col("tail")).otherwise(F.col("closing")).alias("tail"),
    )


SUMMARY = (
    ("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"),
    ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string"),
)


class _Tally:
    """What a conversation adds up to, one turn after another; its texts are hashed, not held."""

    def __init__(self):
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.turns: list[int] = []
        self.distinct = self.illegal = self.cost = 0
        self.last = None
        self.audit: list[str] = []
        self.hash = hashlib.sha256()
        self.lines = False

    def line(self, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + text).encode())
        self.lines = True

    def add(self, turn, role, text, copies, fault, edits, inserted, new_role, tail) -> None:
        if turn is not None and (not self.turns or turn != self.turns[-1]):
            self.turns = [self.turns[0] if self.turns else turn, turn]
            self.distinct += 1
        again = copies - 1
        if fault:
            self.count[fault] += 1
        self.count["blank" if fault == "blank" else "duplicate"] += again
        initial = role[:1]
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.illegal += again
        self.last = initial
        own = edits[: len(edits) - again]
        self.cost += own.count("I") * INSERT + {"K": KEEP, "R": REROLE, "D": DELETE}[own[-1]] + again * DELETE
        if fault == "truncated" and own[-1] != "D":
            self.cost += TRUNCATED
        self.audit.append(edits)
        for line in inserted.split("\n")[:-1]:
            self.line(line)
        if new_role is not None:
            self.line(f"{new_role}:{text}")
        if tail > 0:
            self.cost += tail * INSERT
            self.audit.append("I" * tail)
            for name in (["user", "assistant"])[-tail:]:
                self.line(name + ":")

    def row(self) -> tuple:
        gaps = self.turns[-1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        c = self.count
        return (gaps, c["blank"], c["duplicate"], c["truncated"], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def summarise(turns: DataFrame) -> DataFrame:
    """One row for each conversation of `repair_turns`: faults, cost, audit and digest of the repaired lines.

    A digest and an audit are made in order, so a conversation is one stream of sorted turns; a task
    holds its audit (one letter for each turn), not its texts.
    """
    names = ["turn", "role", "text", "copies", "fault", "edits", "inserted", "new_role", "tail"]
    conv = turns.schema["conv_id"]
    schema = T.StructType([conv] + [T.StructField(n, T.LongType() if t == "long" else T.StringType()) for n, t in SUMMARY])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tally = None, None
        kind = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            types = [kind, *(pa.int64() if t == "long" else pa.string() for _, t in SUMMARY)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            done = []
            for conv_id, *rest in zip(batch.column("conv_id").to_pylist(), *(batch.column(n).to_pylist() for n in names)):
                if tally is None or conv_id != current:
                    if tally is not None:
                        done.append((current, *tally.row()))
                    current, tally = conv_id, _Tally()
                tally.add(*rest)
            if done:
                yield out(done)
        if tally is not None:
            yield out([(current, *tally.row())])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    return ordered.select("conv_id", *names).mapInArrow(run, schema)
