"""Repair of the structure of conversations by a dynamic program over runs of equal rows.

A conversation is a sequence of rows. Each row is a symbol: what its role begins with (s, u, a or another letter), and whether it has to
go, is cut off, or neither. Equal symbols in a row collapse to one run. A row moves a conversation between four states (nothing yet,
behind a system, user or assistant row), and the least cost of each move, insertions before the row included, is a 4 x 4 matrix in which
sums are minima and products are sums. A run of n rows is the n-th power of its matrix: the powers of two are worked out once for each
symbol and kept, and a run is passed by the binary digits of its length. Going back over the runs gives the least cost from every state
on; going forward, the audit takes the first letter in ASCII order that keeps to it. Halves of runs that begin and end alike give the
same letters, so these are remembered too.

On Spark: rows are damaged and judged by column functions. Equal rows of a conversation and turn are counted together, so copies are one
row; the first of equal texts is a minimum joined back. The ordered rows, one short record each, are cut by ranges of (conversation,
turn), so a conversation with a third of all rows spreads over many tasks; each gives the runs of its stretch, and a conversation is
decided over its runs. What the contract asks of one conversation as a whole has a task of its own only as far as it must: the audit,
one letter a row, is one value, and SHA-256 cannot be split, so the texts of a conversation pass one task in order, row by row, and
none are gathered.

Null roles and texts are one space, so such a row is blank. Null turns come first. Rows of one conversation and turn are ordered by role
and then by the SHA-256 of the text, copies beside each other. A null conv_id is a conversation of its own; where it or the turn is part
of a name it reads as one space. Repeated rows are repeated faults. A conversation that lost all its rows has zeros, an empty audit and
the hash of the empty string. Texts of any length are taken whole. Empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sigloft.session import stored

#: White space, as the faults count it.
BLANKS = " \t\n\x0b\f\r"
#: States: nothing yet, behind a system, a user, an assistant row. Which of them may end a conversation.
STATES, ENDS = range(4), (0, 3)
#: The state behind an inserted or re-roled row (a user row, behind a user an assistant row) and behind a kept row by its initial.
INSERTED = (2, 2, 3, 2)
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
#: Symbols: one for rows that have to go; the initial of the role, a capital if the text is cut off; o for any other role.
GONE, OTHER = "x", "o"
NEVER = float("inf")

Vector = tuple[float, ...]


def row_moves(symbol: str, state: int) -> list[tuple[str, int, float]]:
    """The edits of a row that need no insertion, in ASCII order: letter, next state, cost."""
    moves = [("D", state, DELETE)]
    if symbol == GONE:
        return moves
    extra = CUT_OFF if symbol.isupper() else 0
    kept = KEPT.get(symbol.lower(), (None,) * 4)[state]
    if kept is not None:
        moves.append(("K", kept, extra))
    return [*moves, ("R", INSERTED[state], REROLE + extra)]


def transition(symbol: str) -> tuple[Vector, ...]:
    """The least cost of one row from each state to each state, with any insertions before it."""
    matrix = [[NEVER] * 4 for _ in STATES]
    for state in STATES:
        here, paid = state, 0
        for _ in range(3):  # a third insertion leads where the first did
            for _, there, cost in row_moves(symbol, here):
                matrix[state][there] = min(matrix[state][there], paid + cost)
            here, paid = INSERTED[here], paid + INSERT
    return tuple(map(tuple, matrix))


def product(a: tuple[Vector, ...], b: tuple[Vector, ...]) -> tuple[Vector, ...]:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in STATES) for j in STATES) for i in STATES)


@lru_cache(maxsize=None)  # 9 symbols and as many powers as a length has digits
def power(symbol: str, digit: int) -> tuple[Vector, ...]:
    """The matrix of 2 ** digit equal rows."""
    if digit == 0:
        return transition(symbol)
    half = power(symbol, digit - 1)
    return product(half, half)


def before(matrix: tuple[Vector, ...], v: Vector) -> Vector:
    return tuple(min(m + x for m, x in zip(row, v)) for row in matrix)


def advance(symbol: str, n: int, v: Vector) -> Vector:
    """The least costs before n equal rows, given those behind them."""
    digit = 0
    while n:
        if n & 1:
            v = before(power(symbol, digit), v)
        n, digit = n >> 1, digit + 1
    return v


def level(v: Vector) -> Vector:
    """The costs less their minimum: the same choices, and few different vectors."""
    least = min(v)
    return tuple(x - least for x in v)


def last_inserts(state: int) -> int:
    n = 0
    while state not in ENDS:
        state, n = INSERTED[state], n + 1
    return n


END: Vector = tuple(float(INSERT * last_inserts(s)) for s in STATES)


def one_row(symbol: str, v: Vector, state: int) -> tuple[str, int]:
    here, letters = before(power(symbol, 0), v), []
    while True:
        for letter, there, cost in sorted([*row_moves(symbol, state), ("I", INSERTED[state], INSERT)]):
            if cost + (here if letter == "I" else v)[there] == here[state]:
                break
        letters.append(letter)
        state = there
        if letter != "I":
            return "".join(letters), state


@lru_cache(maxsize=1 << 14)
def _short_block(symbol: str, digit: int, v: Vector, state: int) -> tuple[str, int]:
    return _halves(symbol, digit, v, state) if digit else one_row(symbol, v, state)


def _halves(symbol: str, digit: int, v: Vector, state: int) -> tuple[str, int]:
    first, state = block(symbol, digit - 1, level(before(power(symbol, digit - 1), v)), state)
    second, state = block(symbol, digit - 1, v, state)
    return first + second, state


def block(symbol: str, digit: int, v: Vector, state: int) -> tuple[str, int]:
    """The audit of 2 ** digit equal rows from a state, given the costs behind them, and the state behind them."""
    return (_short_block if digit <= 8 else _halves)(symbol, digit, v, state)


def repaired(runs: Iterable[tuple[str, int]]) -> tuple[int, str]:
    """The least cost of a conversation given as runs (symbol, length), and its audit."""
    runs = tuple(runs)
    behind = [END]
    for symbol, n in reversed(runs):
        behind.append(advance(symbol, n, behind[-1]))
    cost, state, letters = behind.pop()[0], 0, []
    for symbol, n in runs:
        v = behind.pop()
        while n:
            digit = n.bit_length() - 1
            n -= 1 << digit
            part, state = block(symbol, digit, level(advance(symbol, n, v)), state)
            letters.append(part)
    return int(cost), "".join(letters) + "I" * last_inserts(state)


_remembered = lru_cache(maxsize=1 << 15)(repaired)


def decided(runs: list[tuple[str, int]]) -> tuple[int, str]:
    """As ``repaired``; short conversations, which are often alike, are remembered."""
    return _remembered(tuple(runs)) if sum(n for _, n in runs) <= 64 else repaired(runs)


def collapsed(symbols: Iterable[tuple[str, int]]) -> list[tuple[str, int]]:
    runs: list[tuple[str, int]] = []
    for symbol, n in symbols:
        if runs and runs[-1][0] == symbol:
            runs[-1] = (symbol, runs[-1][1] + n)
        else:
            runs.append((symbol, n))
    return runs


# -- rows ---------------------------------------------------------------------------------------------------------------
def _columns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    space = F.lit(" ")
    return rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(role_col, space).alias("role"), F.coalesce(text_col, space).alias("text"),
    )


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text``: the rows of a table of conversations, some of them spoilt.

    By the CRC-32 of "conv_id:turn" modulo 20: 0 drops a row, 1 empties its text, 2 removes its end marks, 3 repeats it, 4 makes it a
    user's.
    """
    rows = _columns(rows, conv_col, turn_col, role_col, text_col)
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.col("kind")
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return (
        rows.withColumn("kind", (F.crc32(name) % 20).cast("int"))
        .withColumn("text", F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
        .withColumn("role", F.when(kind == 4, "user").otherwise(F.col("role")))
        .withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies)))
        .select("conv_id", "turn", "role", "text")
    )


def _order() -> list[Column]:
    return [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def judged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, initial, fault, m, first``: distinct rows of a turn, how often they stand there, their fault by
    themselves, and whether an equal row stands in an earlier turn (then ``first`` is false). Texts stay behind; a digest goes on."""
    shown = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(shown == "", "blank").when(~F.substring(shown, -1, 1).isin(".", "!", "?"), "truncated")
    narrow = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), fault.alias("fault"))
    places = narrow.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("m"), F.first("fault").alias("fault"))
    places = stored(places, "places")
    turns = places.groupBy("conv_id", "role", "digest").agg(
        F.count_if(F.col("turn").isNull()).alias("untimed"), F.min("turn").alias("from_turn")
    )
    met = places.alias("p").join(
        turns.alias("t"),
        F.col("p.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("p.role") == F.col("t.role")) & (F.col("p.digest") == F.col("t.digest")),
    )
    first = F.when(F.col("untimed") > 0, F.col("turn").isNull()).otherwise(F.col("turn") == F.col("from_turn"))
    return met.select(*(f"p.{c}" for c in places.columns), first.alias("first")).withColumn("initial", F.substring("role", 1, 1))


_STRETCH = """known boolean, conv_id {id}, at long, first_turn long, last_turn long, turns long, first_initial string, last_initial string,
blank long, duplicate long, truncated long, illegal long, symbols string, lengths array<long>"""
LEGAL = {"su", "ua", "au"}


class _Stretch:
    """What one task knows of a conversation: counts, both ends, and the runs."""

    def __init__(self, at: int):
        self.at, self.first_turn, self.last_turn, self.turns = at, None, None, 0
        self.first_initial = self.last_initial = None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.runs: list[tuple[str, int]] = []

    def _run(self, symbol: str, n: int) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1] = (symbol, self.runs[-1][1] + n)
        else:
            self.runs.append((symbol, n))

    def add(self, turn: int | None, initial: str, fault: str | None, m: int, first: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1
        if self.first_initial is None:
            self.first_initial = initial
        elif self.last_initial + initial not in LEGAL:
            self.illegal += 1
        self.last_initial = initial
        if m > 1 and initial + initial not in LEGAL:
            self.illegal += m - 1
        if fault == "blank":
            self.blank += m
            self._run(GONE, m)
            return
        if first:
            symbol = initial if initial in KEPT else OTHER
            if fault == "truncated":
                self.truncated += 1
                symbol = symbol.upper()
            self._run(symbol, 1)
        again = m - 1 if first else m
        if again:
            self.duplicate += again
            self._run(GONE, again)

    def row(self, conv_id) -> tuple:
        return (True, conv_id, self.at, self.first_turn, self.last_turn, self.turns, self.first_initial, self.last_initial, self.blank, self.duplicate,
                self.truncated, self.illegal, "".join(s for s, _ in self.runs), [n for _, n in self.runs])


def _lists(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names))


def _handed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _stretches(facts: DataFrame) -> DataFrame:
    """The rows in order, cut by ranges of (conversation, turn): one row for each conversation and task."""
    id_type = facts.schema["conv_id"].dataType.simpleString()
    out = _STRETCH.format(id=id_type)
    schema = to_arrow_schema(T.StructType.fromDDL(out))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, now, current, done = TaskContext.get().partitionId(), None, None, []
        for batch in batches:
            for conv, *facts_of in _lists(batch, "conv_id", "turn", "initial", "fault", "m", "first"):
                if current is None or conv != now:
                    if current is not None:
                        done.append(current.row(now))
                    now, current = conv, _Stretch(task)
                current.add(*facts_of)
            if done:
                yield _handed(done, schema)
                done = []
        if current is not None:
            yield _handed([current.row(now)], schema)

    return facts.repartitionByRange(*_order()).sortWithinPartitions(*_order()).mapInArrow(gathered, out)


_DECISION = """conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"""


def decisions(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` for every ``conv_id`` of ``conversations``, from ``rows``
    (conv_id, turn, role, text)."""
    parts = _stretches(stored(judged(rows), "judged"))
    named = conversations.select("conv_id").distinct().select(
        *(F.lit(False).alias(f.name) if f.name == "known" else F.col("conv_id") if f.name == "conv_id" else F.lit(-1).cast(f.dataType).alias(f.name)
          if f.name == "at" else F.lit(None).cast(f.dataType).alias(f.name) for f in parts.schema)
    )
    out = _DECISION.format(id=rows.schema["conv_id"].dataType.simpleString())
    schema = to_arrow_schema(T.StructType.fromDDL(out))
    names = parts.columns

    def closed(conv, stretches: list[dict]) -> tuple:
        sums = {k: sum(s[k] for s in stretches) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        first_turn = last_turn = initial = None
        for s in stretches:
            if initial is not None and initial + s["first_initial"] not in LEGAL:
                sums["illegal"] += 1
            initial = s["last_initial"]
            if s["first_turn"] is not None:
                sums["turns"] -= s["first_turn"] == last_turn
                first_turn, last_turn = s["first_turn"] if first_turn is None else first_turn, s["last_turn"]
        cost, audit = decided(collapsed((c, n) for s in stretches for c, n in zip(s["symbols"], s["lengths"])))
        gaps = 0 if first_turn is None else last_turn - first_turn + 1 - sums["turns"]
        return (conv, gaps, sums["blank"], sums["duplicate"], sums["truncated"], sums["illegal"], cost, audit)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started, gathered = None, False, []
        for batch in batches:
            done = []
            for row in _lists(batch, *names):
                fields = dict(zip(names, row))
                if not started or fields["conv_id"] != now:
                    if started:
                        done.append(closed(now, gathered))
                    now, started, gathered = fields["conv_id"], True, []
                if fields["known"]:
                    gathered.append(fields)
            if done:
                yield _handed(done, schema)
        if started:
            yield _handed([closed(now, gathered)], schema)

    met = parts.unionByName(named)
    return met.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(decide, out)


def repaired_hashes(rows: DataFrame, decided_rows: DataFrame) -> DataFrame:
    """``decided_rows`` with ``repaired_sha256``: the SHA-256 of each repaired conversation, its rows as "role:text" joined by newlines.

    The audit of a conversation comes before its rows; they pass in order and each is hashed as it comes.
    """
    columns = decided_rows.columns
    kept = [c for c in columns if c != "conv_id"]
    texts = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text", *(F.lit(None).cast(decided_rows.schema[c].dataType).alias(c) for c in kept))
    heads = decided_rows.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                                F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("text"), *kept)
    out_schema = decided_rows.schema.add("repaired_sha256", "string")
    schema = to_arrow_schema(out_schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = script = None
        state = at = 0
        sha, empty = hashlib.sha256(), True

        def put(line: str) -> None:
            nonlocal empty
            sha.update(line.encode() if empty else b"\n" + line.encode())
            empty = False

        def inserts() -> None:
            nonlocal state, at
            while at < len(script) and script[at] == "I":
                state, at = INSERTED[state], at + 1
                put("user:" if state == 2 else "assistant:")

        for batch in batches:
            done = []
            for *values, role, text in _lists(batch, *columns, "role", "text"):
                if role is None:  # a new conversation
                    if head is not None:
                        inserts()
                        done.append((*head, sha.hexdigest()))
                    head, script = values, values[columns.index("audit")]
                    state, at, sha, empty = 0, 0, hashlib.sha256(), True
                    continue
                inserts()
                letter, at = script[at], at + 1
                if letter == "K":
                    state = KEPT[role[0]][state]
                    put(f"{role}:{text}")
                elif letter == "R":
                    state = INSERTED[state]
                    put(f"{'user' if state == 2 else 'assistant'}:{text}")
            if done:
                yield _handed(done, schema)
        if head is not None:
            inserts()
            yield _handed([(*head, sha.hexdigest())], schema)

    met = heads.unionByName(texts)
    order = [F.col("conv_id"), F.col("role").isNotNull(), *_order()[1:]]
    return met.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(hashed, out_schema)


def structure_repairs(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The decisions on all conversations with the hash of each repaired one (see ``decisions`` and ``repaired_hashes``).

    ``rows``: conv_id, turn, role, text. ``conversations``: where further ids come from that have no row.
    """
    decided_rows = stored(decisions(rows, rows if conversations is None else conversations), "decisions")
    return repaired_hashes(rows, decided_rows)
