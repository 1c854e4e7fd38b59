"""Conversation structure repair by iterative-deepening A* (op12).

Rows of a conversation are taken by turn (nulls first), rows of one turn by role and text. The first fault of a row
counts: blank (no character but white space), duplicate (role and text seen earlier), truncated (the last such character
is not ``.``, ``!`` or ``?``). A repair is a string of edits, one letter each: Keep a row (free), Rerole it to user or
assistant (3), Delete it (4; the only choice for blank and duplicate rows), Insert a row of empty text by user or
assistant anywhere (3); a truncated row that stays adds 3. The role initials of what is left must be
``(s?(ua)+)?``. Among the cheapest repairs the least in ASCII order is taken.

Search. Depth first, edits in ASCII order (D, I, K, R), under a bound on cost so far plus an estimate of the rest; when
a bound fails, the least total above it is the next. States that failed are kept with the largest allowance that they
failed with and are not entered again with as little. Every bound below the cheapest cost fails, so the first accepting
path is a cheapest one and, by the order, the least. The estimate is the exact cost of the rest under a pattern with
states merged ("after s" and "after a" count as one), hence never too high; few bounds are tried and few states fail.

Spark does one shuffle by conversation. Each row goes to the sorted stream of its task twice: first narrow (one byte of
the row is kept for the search), then whole, when the edits are known; texts are never gathered. Memory for a
conversation of n rows is a few machine words a row, as its audit is one string; texts are read one at a time.

Cases: null roles and texts are one space, and null ids and turns in the damage's hash too; null ids are a conversation
of their own, null turns come first and count in no gap; repeated rows are duplicates; conversations of which no row is
left after damage have an empty repair; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: a row's byte: its initial (1 s, 2 u, 3 a, 0 another one) and flags
GONE, MUST_GO, CUT = 4, 8, 16
#: faults, as numbers in the stream
BLANK, DUPLICATE, TRUNC = 1, 2, 3

# states of (s?(ua)+)?: nothing yet, after s, after u, after a
START, S, U, A = range(4)
#: the letter (2 user, 3 assistant) that may come next, and the state after it
NEXT = {START: 2, S: 2, U: 3, A: 2}
AFTER = {2: U, 3: A}
MERGED = (0, 1, 2, 1)  # states of the estimate


def row_costs(code: int) -> tuple[int, int]:
    """(cost to keep, cost to rerole) of a row; -1 for what is not allowed."""
    if code & MUST_GO:
        return -1, -1
    extra = TRUNCATED if code & CUT else 0
    return (KEEP + extra if code & 3 else -1), REROLE + extra


def estimates(codes: bytes) -> np.ndarray:
    """rest[i, merged state]: the cheapest cost of rows i.. when "after s" counts as "after a"."""
    n = len(codes)
    rest = np.zeros((n + 1, 3), np.int64)
    rest[n] = (0, 0, INSERT)
    start, even, odd = 0, 0, INSERT  # nothing yet; a user row is due; an assistant row is due
    for i in range(n - 1, -1, -1):
        code = codes[i]
        keep, rerole = row_costs(code)
        who = code & 3
        d0, d1, d2 = start + DELETE, even + DELETE, odd + DELETE
        if rerole >= 0:
            as_user = odd + (keep if who == 2 else rerole)
            d1, d2 = min(d1, as_user), min(d2, even + (keep if who == 3 else rerole))
            d0 = min(d0, as_user, even + keep if who == 1 else as_user)
        # one insertion in front brings the other state about; two bring the same one
        d1, d2 = min(d1, d2 + INSERT), min(d2, d1 + INSERT)
        start, even, odd = min(d0, d2 + INSERT), d1, d2
        rest[i] = (start, even, odd)
    return rest


def repair(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, the least in ASCII order."""
    n = len(codes)
    rest = estimates(codes)
    bound = int(rest[0, 0])
    while True:
        found, bound = _within(codes, rest, bound)
        if found is not None:
            return bound, found


def _moves(codes: bytes, i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
    """Edits in ASCII order: letter, cost, next row, next state."""
    if i < len(codes):
        yield "D", DELETE, i + 1, q
    due = NEXT[q]
    yield "I", INSERT, i, AFTER[due]
    if i < len(codes):
        keep, rerole = row_costs(codes[i])
        who = codes[i] & 3
        if keep >= 0 and (who == due or who == 1 and q == START):
            yield "K", keep, i + 1, AFTER[due] if who == due else S
        if rerole >= 0 and who != due:  # a row of the role that is due is kept for less
            yield "R", rerole, i + 1, AFTER[due]


def _within(codes: bytes, rest: np.ndarray, bound: int) -> tuple[str | None, int]:
    """The first accepting path within the bound, with the bound; or None and the least total above it."""
    n = len(codes)
    failed: dict[tuple[int, int], int] = {}
    above = -1
    path: list[str] = []
    stack = [(0, START, 0, _moves(codes, 0, START))]
    while stack:
        i, q, cost, moves = stack[-1]
        if i == n and q in (START, A):
            return "".join(path), bound
        for letter, step, j, r in moves:
            total = cost + step + int(rest[j, MERGED[r]])
            if total > bound:
                above = total if above < 0 else min(above, total)
            elif failed.get((j, r), -1) < bound - cost - step:
                path.append(letter)
                stack.append((j, r, cost + step, _moves(codes, j, r)))
                break
        else:
            failed[i, q] = max(failed.get((i, q), -1), bound - cost)
            stack.pop()
            if path:
                path.pop()
    return None, above


# ------------------------------------------------------------ Spark ----
def damaged(conversations: DataFrame) -> DataFrame:
    """The damage of the benchmark query: by crc32 of ``conv_id:turn`` modulo 20, rows are dropped (column ``gone``,
    so that their conversation stays known), emptied, stripped of sentence ends, repeated, or given the role user."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                                (F.crc32(key.cast("binary")) % 20).alias("_fate"))
    fate = F.col("_fate")
    text = F.when(fate.isin(0, 1), "").when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (fate == 0).alias("gone"),
                       F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")).drop("_copy")


def intact(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form of ``damaged``."""
    return conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(False).alias("gone"))


def _fault(duplicate: Column) -> Column:
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    return (F.when(F.col("gone"), 0).when(last == "", BLANK).when(duplicate, DUPLICATE)
            .when(~last.isin(".", "!", "?"), TRUNC).otherwise(0))


def _streams(rows: DataFrame) -> DataFrame:
    """One shuffle by conversation; in each task every conversation's rows in order, first narrow, then whole."""
    by = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    marked = (rows.repartition("conv_id").withColumn("fault", _fault(F.row_number().over(by) > 1))
              .withColumn("initial", F.substring("role", 1, 1)))
    phase = F.explode(F.when(F.col("gone"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))
    twice = marked.select("conv_id", "turn", "role", "text", "gone", "fault", "initial", phase.alias("phase"))
    order = ["conv_id", "phase", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == DUPLICATE]
    whole = F.col("phase") == 1
    return (twice.sortWithinPartitions(*order)
            .select("conv_id", "phase", "turn", "gone", "fault", "initial", F.when(whole, F.col("role")).alias("role"), F.when(whole, F.col("text")).alias("text")))


class Conversation:
    """What the stream knows of one conversation."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.codes, self.faults = bytearray(), [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.low = self.high = self.before = self.edits = None

    def narrow(self, turn, gone, fault, initial):
        if gone:
            return
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.faults[fault] += 1
        self.codes.append("sua".find(initial) + 1 if initial in ("s", "u", "a") else 0)
        self.codes[-1] |= MUST_GO if fault in (BLANK, DUPLICATE) else CUT if fault == TRUNC else 0

    def solve(self):
        self.cost, self.audit = repair(bytes(self.codes))
        self.gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        self.edits, self.state = iter(self.audit), START

    def inserted(self, letter: str):
        """The role of an inserted or reroled row."""
        due = NEXT[self.state]
        self.state = AFTER[due]
        return "user" if due == 2 else "assistant"

    def whole(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what the repair puts up to this row."""
        for e in self.edits:
            if e == "I":
                yield e, self.inserted(e), ""
                continue
            if e == "K":
                self.state = S if role[0] == "s" else AFTER[NEXT[self.state]]
                yield e, role, text
            elif e == "R":
                yield e, self.inserted(e), text
            return

    def rest(self) -> Iterator[tuple[str, str, str]]:
        for e in self.edits:
            yield e, self.inserted(e), ""


def _walk(batches) -> Iterator[tuple[Conversation, list, bool]]:
    """(conversation, rows put by the repair, whether it ends) along a task's sorted stream."""
    now = None
    for b in batches:
        columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
        for conv_id, phase, turn, gone, fault, initial, role, text in zip(*columns):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    if now.edits is None:
                        now.solve()
                    yield now, list(now.rest()), True
                now = Conversation(conv_id)
            if phase == 0:
                now.narrow(turn, gone, fault, initial)
                continue
            if now.edits is None:
                now.solve()
            put = list(now.whole(role, text))
            if put:
                yield now, put, False
    if now is not None:
        if now.edits is None:
            now.solve()
        yield now, list(now.rest()), True


#: rows of an outgoing batch
OUT_ROWS = 4096


def _batches(rows: Iterator[tuple], schema: T.StructType):
    arrow, held = to_arrow_schema(schema), []
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
    for r in rows:
        held.append(r)
        if len(held) == OUT_ROWS:
            yield make()
            held = []
    if held:
        yield make()


def repaired(rows: DataFrame) -> DataFrame:
    """The rows after repair: conv_id, pos (from 0), edit (K, R or I), role, text. ``rows``: see ``intact``."""
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("pos", T.LongType()), T.StructField("edit", T.StringType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches):
        def out():
            pos = 0
            for now, put, ends in _walk(batches):
                for edit, role, text in put:
                    yield now.conv_id, pos, edit, role, text
                    pos += 1
                pos = 0 if ends else pos
        yield from _batches(out(), schema)
    return _streams(rows).mapInArrow(run, schema)


def report(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, cost and audit of the repair, and the SHA-256 of the
    repaired ``role:text`` rows joined by line feeds. ``rows``: see ``intact``."""
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *[T.StructField(c, T.LongType()) for c in numbers],
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches):
        def out():
            digest, first = hashlib.sha256(), True
            for now, put, ends in _walk(batches):
                for _, role, text in put:
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
                if ends:
                    f = now.faults
                    yield now.conv_id, now.gaps, f[BLANK], f[DUPLICATE], f[TRUNC], now.illegal, now.cost, now.audit, digest.hexdigest()
                    digest, first = hashlib.sha256(), True
        yield from _batches(out(), schema)
    return _streams(rows).mapInArrow(run, schema)
