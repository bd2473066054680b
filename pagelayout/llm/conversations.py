"""Repair of conversation structure: one sorted pass per conversation with a dynamic program over its turns."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelayout.llm.common import column, wrap

WHITE = " \t\n\v\f\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
HELD = 1 << 20  # bytes of backpointers that a conversation keeps in memory

# States of the text written so far: nothing, only a system turn, a user turn last, an assistant turn last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_GIVEN = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # state after an inserted or a rerolled turn
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_EDITS = "KRD"


class Repair:
    """The cheapest edits of one conversation, fed turn by turn.

    Per state the cheapest way there is kept: its cost, its place among the ways in the order of their edits' initials, and the running hash
    of what it writes. Two ways that have used the same turns end in a turn's edit, so none is the beginning of another, and the order of
    the ways decides every tie. What is remembered of a turn is one byte per state; beyond ``HELD`` bytes these go to an unnamed
    scratch file of the task, which ends with it (a task that is run again begins anew).
    """

    def __init__(self) -> None:
        self.ways: dict[int, tuple[int, int, object]] = {EMPTY: (0, 0, hashlib.sha256())}
        self.steps, self.spilled, self.file = bytearray(), 0, None

    def _write(self, state: int, done: object, lines: list[str]) -> object:
        done = done.copy()
        done.update(("" if state == EMPTY else "\n").encode() + "\n".join(lines).encode("utf-8", "surrogatepass"))
        return done

    def turn(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        best: dict[int, tuple] = {}

        def offer(to: int, cost: int, rank: int, letters: str, start: int, inserted: int, edit: str) -> None:
            found = (cost, rank, letters, start, inserted, edit)
            if to not in best or found[:3] < best[to][:3]:
                best[to] = found

        for start, (cost, rank, _) in self.ways.items():
            state = start
            for inserted in range(3):  # more than two in a row only go in circles
                so_far, letters = cost + INSERT * inserted, "I" * inserted
                offer(state, so_far + DELETE, rank, letters + "D", start, inserted, "D")
                if not must_go:
                    extra = TRUNCATED if truncated else 0
                    kept = _AFTER[state].get(role[:1])
                    if kept is not None:
                        offer(kept, so_far + extra, rank, letters + "K", start, inserted, "K")
                    offer(_GIVEN[state], so_far + extra + REROLE, rank, letters + "R", start, inserted, "R")
                state = _GIVEN[state]

        order = sorted(best, key=lambda to: best[to][1:3])
        ways, step = {}, bytearray(4)
        for to, (cost, _, _, start, inserted, edit) in best.items():
            lines, state = [], start
            for _ in range(inserted):
                state = _GIVEN[state]
                lines.append(f"{_ROLE[state]}:")
            if edit != "D":
                lines.append(f"{role if edit == 'K' else _ROLE[_GIVEN[state]]}:{text}")
            done = self.ways[start][2]
            ways[to] = (cost, order.index(to), self._write(start, done, lines) if lines else done)
            step[to] = start | inserted << 2 | _EDITS.index(edit) << 4
        self.ways = ways
        self.steps += step
        if len(self.steps) >= HELD:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.steps)
            self.spilled += len(self.steps)
            self.steps = bytearray()

    def _backwards(self) -> Iterator[bytes]:
        yield bytes(self.steps)
        while self.spilled:
            self.spilled -= HELD
            self.file.seek(self.spilled)
            yield self.file.read(HELD)
        if self.file:
            self.file.close()

    def end(self) -> tuple[int, str, str]:
        """(cost, initials of the edits, hash of the repaired conversation)."""
        ends = {EMPTY: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}  # turns to insert behind the last
        found = [(cost + INSERT * ends[s], rank, s) for s, (cost, rank, _) in self.ways.items()]
        cost, _, state = min(found)
        done, lines, at = self.ways[state][2], [], state
        for _ in range(ends[state]):
            at = _GIVEN[at]
            lines.append(f"{_ROLE[at]}:")
        digest = (self._write(state, done, lines) if lines else done).hexdigest()
        audit = [b"I" * ends[state]]
        for held in self._backwards():
            part = []
            for i in range(len(held) - 4, -1, -4):
                step = held[i + state]
                part.append("I" * (step >> 2 & 3) + _EDITS[step >> 4])
                state = step & 3
            audit.append("".join(reversed(part)).encode())
        return cost, b"".join(reversed(audit)).decode(), digest


class _Conversation:
    """What is known of a conversation while its turns stream by."""

    def __init__(self, conv) -> None:
        self.conv, self.repair = conv, Repair()
        self.low = self.last = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None

    def turn(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        if turn is not None and turn != self.last:
            self.low = turn if self.low is None else self.low
            self.last, self.distinct = turn, self.distinct + 1
        seen = text.rstrip(WHITE)
        blank = not seen
        truncated = not blank and not repeated and seen[-1] not in ".!?"
        self.blank += blank
        self.duplicate += not blank and repeated
        self.truncated += truncated
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self.repair.turn(role, text, blank or repeated, truncated)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.last - self.low + 1 - self.distinct
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.end())


def sorted_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str, dropped: Column | None) -> DataFrame:
    """(conv, turn, role, text, copy, gone, repeated), by conversation and sorted in it. One exchange: the window keeps the distribution."""
    rows = wrap(turns)
    rows = rows.select(
        column(conv).alias("conv"),
        column(turn).cast("long").alias("turn"),
        F.coalesce(column(role), F.lit(" ")).alias("role"),
        F.coalesce(column(text), F.lit(" ")).alias("text"),
        (column("copy") if "copy" in turns.columns else F.lit(0)).cast("int").alias("copy"),
        (F.lit(False) if dropped is None else dropped).alias("gone"),
    ).repartition("conv")
    same = W.partitionBy("conv", F.xxhash64("role", "text"), "role", "text", "gone").orderBy(F.asc_nulls_first("turn"), "copy")
    return rows.withColumn("repeated", F.row_number().over(same) > 1)


def repair_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: Column | None = None) -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256.

    Turns are taken by ``turn`` (nulls first), those of one turn by role, text and ``copy`` (if there is such a column); null roles and texts are one space.
    Rows for which ``dropped`` (an expression on the wrapped row) holds are not there, but their conversation is. A turn's first fault counts: blank, duplicate of
    an earlier role and text, truncated. ``audit`` are the initials of the cheapest edits (Keep, Rerole, Delete, Insert) after which the roles read
    system at most once and first, then user and assistant in turn, or nothing at all. Conversations without turns have zeros, no edits and the hash of
    the empty text; a null conv is a conversation. No rows give no rows.

    Turns go by conversation to a task and are sorted there by Spark, which spills; the dynamic program streams over them, from one Arrow batch
    to the next, and holds four ways, whatever the conversation's length. A conversation is walked in order by one task.
    """
    rows = sorted_turns(turns, conv, turn, role, text, dropped)
    rows = rows.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text", "copy").select("conv", "turn", "role", "text", "gone", "repeated")
    kind = T.StructType([T.StructField("conv", rows.schema["conv"].dataType)])
    for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"):
        kind = kind.add(name, "long")
    kind = kind.add("audit", "string").add("repaired_sha256", "string")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, arrow = None, None

        def made(done: list[_Conversation]) -> pa.RecordBatch:
            out = [c.row() for c in done]
            columns = [pa.array([r[0] for r in out], arrow)] + [pa.array([r[i] for r in out], pa.int64()) for i in range(1, 7)] + [pa.array([r[i] for r in out], pa.string()) for i in (7, 8)]
            return pa.RecordBatch.from_arrays(columns, names=kind.names)

        for batch in batches:
            arrow, done = batch.schema.field("conv").type, []
            for c, n, who, said, gone, repeated in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if now is None or c != now.conv:
                    if now is not None:
                        done.append(now)
                    now = _Conversation(c)
                if not gone:
                    now.turn(n, who, said, repeated)
            if done:
                yield made(done)
        if now is not None:
            yield made([now])

    return rows.mapInArrow(walk, kind)


def repaired_turns(turns: DataFrame, repairs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The conversations after their edits: conv, position (from 0), edit, turn (null for inserted ones), role, text.

    ``repairs`` is the result of ``repair_conversations`` on the same turns.
    """
    place = W.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text", "copy")
    rows = sorted_turns(turns, conv, turn, role, text, None).withColumn("n", F.row_number().over(place)).select(F.col("conv").alias("c"), "n", "turn", F.col("role").alias("own"), F.col("text").alias("said"))
    edits = repairs.select("conv", F.posexplode(F.split("audit", "")).alias("p", "edit")).where("edit <> ''")
    upto = W.partitionBy("conv").orderBy("p").rowsBetween(W.unboundedPreceding, 0)
    edits = edits.withColumn("used", F.sum((F.col("edit") != "I").cast("int")).over(upto)).withColumn("position", F.sum((F.col("edit") != "D").cast("int")).over(upto) - 1)
    joined = edits.join(rows, F.col("conv").eqNullSafe(F.col("c")) & (F.col("used") == F.col("n")) & (F.col("edit") != "I"), "left").where("edit <> 'D'")
    opens = F.max(F.when((F.col("position") == 0) & (F.col("edit") == "K") & F.col("own").startswith("s"), 1).otherwise(0)).over(W.partitionBy("conv"))
    joined = joined.withColumn("opens", opens)
    given = F.when((F.col("position") - F.col("opens")) % 2 == 0, "user").otherwise("assistant")
    return joined.select("conv", "position", "edit", "turn", F.when(F.col("edit") == "K", F.col("own")).otherwise(given).alias("role"), F.coalesce("said", F.lit("")).alias("text"))


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with damage by crc32 of ``conv:turn`` modulo 20: conv, turn, role, text, copy, gone.

    0 takes the turn away (``gone``), 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes the role user.
    Nulls of any column are one space in the key; null roles and texts become one space.
    """
    rows = wrap(turns)
    name = F.concat(F.coalesce(column(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(column(turn).cast("string"), F.lit(" ")))
    harm = F.crc32(name.cast("binary")) % 20
    said = F.coalesce(column(text), F.lit(" "))
    rows = rows.select(
        column(conv).alias(conv),
        column(turn).alias(turn),
        F.when(harm == 4, "user").otherwise(F.coalesce(column(role), F.lit(" "))).alias(role),
        F.when(harm == 1, "").when(harm == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias(text),
        (harm == 0).alias("gone"),
        harm.alias("harm"),
    )
    return rows.withColumn("copy", F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("harm")
