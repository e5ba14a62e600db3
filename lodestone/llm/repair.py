"""Structure of conversations: faults of their turns, and the cheapest edits that make roles alternate.

The edits of a conversation are a shortest path over four states (`viterbi`). Rows are sorted into ranges over all tasks, and a task
solves the conversations that it holds whole, all at once. One that ranges or `TURNS` cut is solved by rank convergence: its stretches
start from guesses of the cost vector behind them; fix-up passes rerun them for the vectors that turned up instead, until every
vector met differs from a guess by a constant only; with these vectors each stretch is traced from every state, and the
traces are put together from the front. There are at most some dozen vectors, so the number of passes has that bound, however long a
conversation is. Its digest alone has to read its rows one after another, in pieces of a stretch each.

A null role or text counts as one space; rows without a turn come first; rows of one turn go by role, then by the SHA-256 of the text. Equal
rows are counted before they are sorted, so many of them are no burden, and each but the first is a duplicate. Very long texts are one value
of a row. Rows without `conv_id` are one conversation, whose id is null. Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import viterbi as V
from lodestone.llm.common import NO_ID, Stored, public_id
from lodestone.llm.ordered import ranged

#: Turns, and bytes of text, of a stretch that is solved by itself.
TURNS, BYTES = 1024, 4 << 20
#: Turns of whole conversations that are solved together.
TOGETHER = 1 << 16
SPACES = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"
RESULT = f"conv_id long, {COUNTS}, cost long, audit string, repaired_sha256 string"
_PART = (
    "part int, seq long, codes binary, runs array<long>, roles array<string>, texts array<string>, "
    "turns long, low long, high long, head int, tail int"
)
_PASS = f"{RESULT}, whole boolean, {_PART}"
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by crc32(`conv_id:turn`) modulo 20: 0 drops a row, 1 empties its text, 2 takes its `[.!?]` out, 3 repeats it, 4 makes
    the user its speaker. `copies` says how often a row stands there; a dropped one stays as an empty row of no copies."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    gone = fault == 0
    return conversations.select(
        "conv_id", F.when(~gone, F.col("turn").cast("long")).alias("turn"),
        F.when(gone, "").when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(gone | (fault == 1), "").when(fault == 2, F.translate(text, "".join(ENDS), "")).otherwise(text).alias("text"),
        F.when(gone, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _turns(rows: DataFrame) -> DataFrame:
    """Each different row with its copies, its code, and whether its role and text were said in an earlier turn (`kind` 0 marks that)."""
    counted = rows.groupBy(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("did"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).agg(F.sum("copies").alias("copies"))
    first = F.substring("role", 1, 1)
    initial = F.when(first == V.INITIALS[0], 0).when(first == V.INITIALS[1], 1).when(first == V.INITIALS[2], 2).otherwise(3)
    shown = F.rtrim("text", F.lit(SPACES))
    code = F.when(shown == "", V.GONE).otherwise(2 * initial + F.when(F.right(shown, F.lit(1)).isin(*ENDS), 0).otherwise(1))
    turns = counted.select(
        "did", "turn", "role", F.unhex(F.sha2("text", 256)).alias("hash"), F.lit(1).alias("kind"), "text", "copies",
        code.cast("int").alias("code"), initial.alias("initial"),
    )
    said = turns.where("copies > 0").select("did", "turn", "role", "hash")
    order = F.struct(F.col("turn").isNotNull(), "turn")
    again = said.groupBy("did", "role", "hash").agg(F.min(order).alias("first"), F.count("*").alias("times")).where("times > 1")
    marks = said.join(again, ["did", "role", "hash"]).where(order > F.col("first")).select("did", "turn", "role", "hash")
    return turns.unionByName(marks.withColumn("kind", F.lit(0)), allowMissingColumns=True)


@dataclass
class _Stretch:
    """Turns of a conversation, in order, and what is counted over them."""

    did: int
    codes: list[int] = field(default_factory=list)
    runs: list[int] = field(default_factory=list)
    roles: list[str | None] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    head: int | None = None
    tail: int | None = None
    size: int = 0

    def add(self, turn, role, text, copies, code, initial, again) -> None:
        if self.head is None:
            self.head = initial
        elif (self.tail, initial) not in _LEGAL:
            self.illegal += 1
        self.tail = initial
        # Copies stand side by side, and no role may follow itself.
        self.illegal += copies - 1
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = (turn if self.low is None else self.low), turn
        if code == V.GONE:
            self.blank += copies
        elif again:
            self.duplicate += copies
        else:
            self.truncated += code & 1
            self.duplicate += copies - 1
            self._entry(code, 1, role, text)
            copies -= 1
        if copies:
            self._entry(V.GONE, copies, None, None)

    def _entry(self, code, run, role, text) -> None:
        self.codes.append(code)
        self.runs.append(run)
        self.roles.append(role)
        self.texts.append(text)
        self.size += 0 if text is None else len(text)

    def join(self, behind: _Stretch) -> None:
        """Adds the counts of the stretch that follows."""
        if behind.head is not None:
            if self.head is None:
                self.head = behind.head
            elif (self.tail, behind.head) not in _LEGAL:
                self.illegal += 1
            self.tail = behind.tail
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(behind, name))
        if behind.high is not None:
            self.turns += behind.turns - (behind.low == self.high)
            self.low, self.high = (behind.low if self.low is None else self.low), behind.high

    def counts(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


class _Repaired:
    """Digest, cost and letters of the repaired turns, stretch by stretch."""

    def __init__(self):
        self.state, self.cost, self.first = V.START, 0, True
        self.digest, self.letters = hashlib.sha256(), []

    def add(self, letters: str, codes, runs, roles, texts) -> None:
        state, lines, at, left = self.state, [], 0, 0
        for letter in letters:
            if letter == "I":
                self.cost += V.INSERT
                lines.append(V.ROLES[state] + ":")
                state = int(V.FILLED[state])
                continue
            if not left:
                left = runs[at]
            left -= 1
            if letter == "D":
                self.cost += V.DELETE
            else:
                self.cost += codes[at] & 1
                if letter == "K":
                    lines.append(f"{roles[at]}:{texts[at]}")
                    state = int(V.AFTER[state, codes[at] >> 1])
                else:
                    self.cost += V.REROLE
                    lines.append(f"{V.ROLES[state]}:{texts[at]}")
                    state = int(V.FILLED[state])
            if not left:
                at += 1
        if lines:
            if not self.first:
                self.digest.update(b"\n")
            self.first = False
            self.digest.update("\n".join(lines).encode())
        self.state = state
        self.letters.append(letters)

    def row(self) -> tuple:
        return self.cost, "".join(self.letters), self.digest.hexdigest()


def _solved(codes: list[np.ndarray], runs: list[np.ndarray], ends: np.ndarray, starts: list[int], final: np.ndarray):
    """Letters from each start state, and the states behind, of each stretch; `ends` are the vectors behind them."""
    letters: list = [None] * len(codes)
    states = np.empty((len(codes), len(starts)), np.int64)
    for some in V.buckets([len(c) for c in codes]):
        table, count = V.padded([codes[i] for i in some], [runs[i] for i in some])
        costs = V.backward(table, count, ends[some])
        found, states[some] = V.trace(table, count, costs, np.tile(starts, (len(some), 1)), final[some])
        for i, own in zip(some, found, strict=True):
            pad = 4 * (table.shape[1] - len(codes[i]))
            kept = own if not pad else np.concatenate([own[:, : 4 * len(codes[i])], own[:, -3:]], axis=1)
            letters[i] = [V.spelled(x, runs[i]) for x in kept]
    return letters, states


def _records(rows: list[dict], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=like)


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _first_pass(turns: int, size: int, together: int, out: pa.Schema):
    """Results of the conversations that a range holds whole, and the stretches of the others."""
    names = [f.split()[0] for f in RESULT.split(", ")]

    def whole(waiting: list[_Stretch]) -> pa.RecordBatch:
        codes = [np.array(s.codes, np.uint8) for s in waiting]
        runs = [np.array(s.runs, np.int64) for s in waiting]
        ends = np.tile(V.TERMINAL, (len(waiting), 1))
        letters, _ = _solved(codes, runs, ends, [V.START], np.ones(len(waiting), bool))
        rows = []
        for s, (audit,) in zip(waiting, letters, strict=True):
            made = _Repaired()
            made.add(audit, s.codes, s.runs, s.roles, s.texts)
            rows.append(dict(zip(names, (s.did, *s.counts(), *made.row()), strict=True)) | {"whole": True})
        return _records(rows, out)

    def stretch(s: _Stretch, part: int, seq: int) -> pa.RecordBatch:
        row = {k: getattr(s, k) for k in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "head", "tail")}
        row |= {"runs": s.runs, "roles": s.roles, "texts": s.texts, "codes": bytes(s.codes)}
        return _records([row | {"conv_id": s.did, "whole": False, "part": part, "seq": seq}], out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, heavy = TaskContext.get().partitionId(), 0, 0, 0
        waiting: list[_Stretch] = []
        now: _Stretch | None = None
        cut = True  # whether the present conversation may have begun before: in another range, or in an earlier stretch
        again = False
        columns = ("did", "turn", "role", "text", "copies", "code", "initial", "kind")
        for batch in batches:
            for did, turn, role, text, copies, code, initial, kind in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if now is None:
                    now = _Stretch(did)
                elif did != now.did:
                    if cut:
                        yield stretch(now, part, seq)
                        seq += 1
                    else:
                        waiting.append(now)
                        held, heavy = held + len(now.codes) + 1, heavy + now.size
                        if held >= together or heavy >= size:
                            yield whole(waiting)
                            waiting, held, heavy = [], 0, 0
                    now, cut = _Stretch(did), False
                elif len(now.codes) >= turns or now.size >= size:
                    yield stretch(now, part, seq)
                    seq, now, cut = seq + 1, _Stretch(did), True
                if kind == 0:
                    again = True
                elif copies:
                    now.add(turn, role, text, copies, code, initial, again)
                    again = False
        if waiting:
            yield whole(waiting)
        if now is not None:
            yield stretch(now, part, seq)

    return work


def _codes(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    codes = [np.frombuffer(c, np.uint8) for c in batch.column("codes").to_pylist()]
    return codes, [np.array(r, np.int64) for r in batch.column("runs").to_pylist()]


def _rows(batch: pa.RecordBatch, most: int = 256) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(batch), most):
        yield batch.slice(start, most)


_KEY = "conv_id long, part int, seq long"


def _sweep(guesses: list[int]):
    """For each stretch the vector before it, by guess of the one behind it."""
    out = _schema(f"{_KEY}, fronts array<int>")
    vectors = np.array([V.unpacked(g) for g in guesses])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _rows(whole):
                codes, runs = _codes(batch)
                found: list = [None] * len(codes)
                for some in V.buckets([len(c) for c in codes]):
                    table, _ = V.padded([codes[i] for i in some], [runs[i] for i in some])
                    for i, own in zip(some, V.fronts(table, vectors), strict=True):
                        found[i] = [V.packed(v) for v in own]
                keys = [batch.column(c) for c in ("conv_id", "part", "seq")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(found, pa.list_(pa.int32()))], schema=out)

    return work


def _stitch(guesses: list[int]):
    """The vector behind each stretch, from the last stretch of a conversation on; `missing` is one that was not guessed."""
    out = _schema(f"{_KEY}, behind int, final boolean, missing int")
    place = {g: i for i, g in enumerate(guesses)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, vector, started = None, None, False
        for batch in batches:
            rows = []
            for did, part, seq, found in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "seq", "fronts")), strict=True):
                final = not started or did != current
                if final:
                    current, vector, started = did, V.packed(V.TERMINAL), True
                known = vector in place
                if vector is not None:
                    rows.append({"conv_id": did, "part": part, "seq": seq, "behind": vector, "final": final, "missing": None if known else vector})
                vector = found[place[vector]] if known else None
            yield _records(rows, out)

    return work


def _traces():
    """Letters and last states of each stretch, from every state, with the true vector behind it."""
    out = _schema(f"{_KEY}, kind int, letters array<string>, states array<int>")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _rows(whole, 64):
                codes, runs = _codes(batch)
                ends = np.array([V.unpacked(v) for v in batch.column("behind").to_pylist()])
                final = np.array(batch.column("final").to_pylist(), bool)
                letters, states = _solved(codes, runs, ends, list(range(V.STATES)), final)
                keys = [batch.column(c) for c in ("conv_id", "part", "seq")]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array([0] * len(codes), pa.int32()), pa.array(letters, pa.list_(pa.string())),
                     pa.array(states.tolist(), pa.list_(pa.int32()))], schema=out)

    return work


def _joined():
    """Results of conversations from their stretches in order: each one's letters come first, then its turns."""
    out = _schema(RESULT)
    names = out.names
    counted = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "head", "tail")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: _Stretch | None = None
        made, letters, states = None, None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if counts is None or row["conv_id"] != counts.did:
                    if counts is not None:
                        done.append(dict(zip(names, (counts.did, *counts.counts(), *made.row()), strict=True)))
                    counts, made = _Stretch(row["conv_id"]), _Repaired()
                if row["kind"] == 0:
                    letters, states = row["letters"], row["states"]
                    continue
                start = made.state
                made.add(letters[start], row["codes"], row["runs"], row["roles"], row["texts"])
                if made.state != states[start]:
                    raise RuntimeError("the trace of a stretch does not lead where it was said to")
                counts.join(_Stretch(row["conv_id"], **{k: row[k] for k in counted}))
            if done:
                yield _records(done, out)
        if counts is not None:
            yield _records([dict(zip(names, (counts.did, *counts.counts(), *made.row()), strict=True))], out)

    return work


def _by_rank_convergence(parts: DataFrame) -> DataFrame:
    """Results of the conversations that were cut."""
    guesses = sorted({V.packed(g) for g in V.GUESSES})
    codes = parts.select("conv_id", "part", "seq", "codes", "runs")
    while True:
        swept = codes.mapInArrow(_sweep(guesses), f"{_KEY}, fronts array<int>")
        last_first = swept.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
        behind = Stored(last_first.mapInArrow(_stitch(guesses), f"{_KEY}, behind int, final boolean, missing int"), "vectors")
        # There are no more vectors than those that the steps can make of the last one.
        missing = [r[0] for r in behind.df.where("missing is not null").select("missing").distinct().collect()]
        if not missing:
            break
        behind.drop()
        guesses += missing
    traces = codes.join(behind.df.drop("missing"), ["conv_id", "part", "seq"]).mapInArrow(
        _traces(), f"{_KEY}, kind int, letters array<string>, states array<int>"
    )
    both = traces.unionByName(parts.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    in_order = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq", "kind")
    return in_order.mapInArrow(_joined(), RESULT)


def repair(rows: DataFrame, turns: int = TURNS, size: int = BYTES, together: int = TOGETHER) -> DataFrame:
    """Faults and cheapest repair of each conversation of `rows(conv_id, turn, role, text, copies)`.

    `gaps`: turn numbers between the first and the last that do not occur. `blank`, `duplicate`, `truncated`: turns by their first fault.
    `illegal`: neighbours whose roles may not follow each other. `cost`, `audit`: of the cheapest edits (Delete, Insert, Keep, Rerole), and
    their letters. `repaired_sha256`: of the repaired `role:text` lines. A conversation of no copies has zeros and empty texts.
    """
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    sorted_turns = ranged(_turns(rows), "did", "turn", "role", "hash", within=("kind",))
    first = Stored(sorted_turns.mapInArrow(_first_pass(turns, size, together, _schema(_PASS)), _PASS), "repair")
    names = [f.split()[0] for f in RESULT.split(", ")]
    whole = first.df.where("whole").select(*names)
    parts = first.df.where("not whole").select("conv_id", *[f.split()[0] for f in _PART.split(", ")], "blank", "duplicate", "truncated", "illegal")
    found = whole.unionByName(_by_rank_convergence(parts).select(*names))
    return found.withColumn("conv_id", public_id("conv_id"))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """`repair` of the rows that `damaged` makes."""
    return repair(damaged(conversations))
