"""Repair of conversations at least cost: a chain of four states, solved in slices by rank convergence.

A conversation is in order if the initials of its roles match ``(s?(ua)+)?``. Rows are kept, given another role, deleted, or
empty ones inserted, each at a cost. The states are: nothing yet, after the system's row, after the user's, after the assistant's.
The cost to go from each state is carried from the last row to the first; the least audit is then read off from the first to the last.

A conversation of any length is cut into slices of bounded size, which lie in the ranges of one global order, so that no task holds
a whole one. All slices start at once from a speculative cost vector. Where a slice's own right neighbour ended in a vector that is
not the assumed one, up to a constant, the slice is run again from it, until no vector differs (rank convergence: most vectors become
parallel after a few rows, whatever they started from). Only differences of costs decide edits; the constants that were left
out are summed up for the total. Traces are stitched alike: each slice is traced from all four states, and the state that it is
entered in is what its left neighbour leaves, again until nothing changes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import bounded_batches
from tallyloom.session import scratch_dir

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
FAR = 1 << 20
#: A slice holds at most so many rows, and closes with the row that brings its texts to so many characters
SLICE_ROWS, SLICE_CHARS = 4096, 1 << 20
#: Where each kind of role leads from each state, if it may stand there
_LEADS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The one role that may stand next, besides the system's at the start
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: A row's code: its fault (none, truncated, has to go) and the kind of its role
KINDS, FAULTS = "sua?", 3
OTHER = len(KINDS) - 1
GO = 2 * len(KINDS)


def code(fault: int, initial: str) -> int:
    kind = KINDS.find(initial) if initial in ("s", "u", "a") else OTHER
    return fault * len(KINDS) + kind


def _with_inserts(cost: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go if empty rows may be put in first. Twice in a row is as far as it ever pays."""
    cost = list(cost)
    for _ in range(2):
        cost = [min(c, INSERT + cost[_NEXT[s]]) for s, c in enumerate(cost)]
    return tuple(cost)


def _choices(row: int, state: int, after: tuple[int, ...]) -> list[tuple[str, int, int]]:
    """The edits of a row in a state: letter, cost to go, next state. ``after`` are the costs to go behind the row."""
    fault, kind = divmod(row, len(KINDS))
    made = [("D", DELETE + after[state], state)]
    if fault < 2:
        extra = TRUNCATED * fault
        to = _LEADS.get(KINDS[kind], {}).get(state)
        if to is not None:
            made.append(("K", KEEP + extra + after[to], to))
        made.append(("R", REROLE + extra + after[_NEXT[state]], _NEXT[state]))
    return made


class Costs:
    """Steps of cost vectors, remembered: vectors are held less their least entry, so that few different ones exist."""

    def __init__(self):
        self.steps: dict[tuple[int, tuple[int, ...]], tuple[tuple[int, ...], int]] = {}
        self.edits: dict[tuple[int, tuple[int, ...], int], tuple[str, int]] = {}

    @staticmethod
    def last() -> tuple[int, ...]:
        """Behind the last row: a conversation may end where nothing or an assistant's row is last; elsewhere rows have to be put in."""
        return _with_inserts(tuple(0 if s in ENDS else FAR for s in range(4)))

    def before(self, row: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
        """The vector in front of a row, less its least entry, and that entry."""
        known = self.steps.get((row, after))
        if known is None:
            cost = _with_inserts(tuple(min(c for _, c, _ in _choices(row, s, after)) for s in range(4)))
            least = min(cost)
            known = self.steps[row, after] = tuple(c - least for c in cost), least
        return known

    def vectors(self, rows: bytes, after: tuple[int, ...]) -> tuple[list[tuple[int, ...]], int]:
        """The vectors in front of each row and behind the last, and the sum of what was taken off."""
        made, total = [after], 0
        for row in reversed(rows):
            after, least = self.before(row, after)
            made.append(after)
            total += least
        return made[::-1], total

    def edit(self, row: int, after: tuple[int, ...], state: int) -> tuple[str, int]:
        """The least letters of a cheapest way from before a row to behind it, and the state there."""
        known = self.edits.get((row, after, state))
        if known is None:
            known = self.edits[row, after, state] = self._least(row, after, state)
        return known

    def _least(self, row: int, after: tuple[int, ...], state: int) -> tuple[str, int]:
        plain = [min(c for _, c, _ in _choices(row, s, after)) for s in range(4)]
        cost = _with_inserts(tuple(plain))
        letters = ""
        while True:
            ways = [(letter, c, to) for letter, c, to in _choices(row, state, after) if c == cost[state]]
            if INSERT + cost[_NEXT[state]] == cost[state]:
                ways.append(("I", cost[state], -1))
            letter, _, to = min(ways)
            letters += letter
            if letter != "I":
                return letters, to
            state = _NEXT[state]

    def end(self, state: int) -> str:
        """The rows put in behind the last one."""
        letters = ""
        while state not in ENDS:
            letters, state = letters + "I", _NEXT[state]
        return letters

    def trace(self, rows: bytes, vectors: list[tuple[int, ...]], state: int) -> tuple[list[str], int]:
        """The letters of each row and the state behind the last one."""
        letters = []
        for i, row in enumerate(rows):
            edit, state = self.edit(row, vectors[i + 1], state)
            letters.append(edit)
        return letters, state


def apply(letters: list[str], turns: list[dict], state: int) -> list[dict]:
    """The rows after their edits; the letters behind the last row's are for rows put in at the end."""
    made = []
    for i, edit in enumerate(letters):
        for letter in edit:
            if letter == "I":
                state = _NEXT[state]
                made.append({"role": _NAMES[state], "text": ""})
            elif letter == "R":
                state = _NEXT[state]
                made.append({"role": _NAMES[state], "text": turns[i]["text"]})
            elif letter == "K":
                state = _LEADS[turns[i]["role"][:1]][state]
                made.append(turns[i])
    return made


# ---- slices of the sorted rows

_BLANKS = " \t\n\x0b\x0c\r"
TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
SLICE = pa.schema(
    [
        ("conv_id", pa.int64()), ("part", pa.int64()), ("piece", pa.int64()), ("whole", pa.bool_()),
        ("codes", pa.binary()), ("turns", pa.list_(TURN)), ("digests", pa.list_(pa.binary())), ("audit", pa.string()), ("cost", pa.int64()),
        ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
        ("n_turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first", pa.string()), ("last", pa.string()),
    ]
)
_SQL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean", pa.list_(TURN): "array<struct<role:string,text:string>>", pa.list_(pa.binary()): "array<binary>"}
SLICE_SQL = ", ".join(f"{f.name} {_SQL[f.type]}" for f in SLICE)
LEGAL = ("su", "ua", "au")


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


class _Slice:
    """Rows of one conversation, in order, as far as they lie together."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.codes, self.seen, self.chars = conv, [], bytearray(), {}, 0
        self.digests: list[bytes] = []
        self.counts = [0, 0, 0, 0]
        self.numbers: list[int | None] = [None, None]
        self.n_numbers = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        said = text.rstrip(_BLANKS)
        digest = _digest(role, text)
        fault = 0
        if not said:
            fault = 1
        elif digest in self.seen:
            fault = 2
        elif said[-1] not in ".!?":
            fault = 3
        self.seen[digest] = True
        self.digests.append(digest)
        if fault:
            self.counts[fault - 1] += 1
        if self.turns and self.turns[-1]["role"][:1] + role[:1] not in LEGAL:
            self.counts[3] += 1
        if turn is not None:
            if self.numbers[0] is None:
                self.numbers[0] = turn
            if turn != self.numbers[1]:
                self.n_numbers += 1
            self.numbers[1] = turn
        self.codes.append(code((0, 2, 2, 1)[fault], role[:1]))
        self.turns.append({"role": role, "text": text})
        self.chars += len(role) + len(text)

    def row(self, costs: Costs, part: int, piece: int, whole: bool) -> dict:
        rows, turns, audit, cost = bytes(self.codes), self.turns, "", 0
        if whole and rows:
            vectors, total = costs.vectors(rows, costs.last())
            letters, state = costs.trace(rows, vectors, NOTHING)
            letters.append(costs.end(state))
            turns, audit, cost = apply(letters, turns, NOTHING), "".join(letters), total + vectors[0][NOTHING]
        ends = [t["role"][:1] for t in (self.turns[:1] + self.turns[-1:])] or [None, None]
        blank, duplicate, truncated, illegal = self.counts
        return {
            "conv_id": self.conv, "part": part, "piece": piece, "whole": whole, "codes": rows, "turns": turns, "digests": [] if whole else self.digests, "audit": audit, "cost": cost,
            "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal,
            "n_turns": self.n_numbers, "first_turn": self.numbers[0], "last_turn": self.numbers[1], "first": ends[0], "last": ends[-1],
        }


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, turn, role, text, here) to slices of ``most`` rows; a conversation that surely lies in this range alone is solved at once."""
    from pyspark import TaskContext

    part, costs = TaskContext.get().partitionId(), Costs()
    piece, held, out, size = 0, None, [], 0
    inside = False  # whether the held slice opens its conversation

    def close(ends: bool):
        nonlocal piece, size
        out.append(held.row(costs, part, piece, inside and ends))
        piece, size = piece + 1, size + held.chars

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for conv, turn, role, text, here in zip(*columns):
            if held is None or held.conv != conv:
                if held is not None:
                    close(True)
                inside = held is not None
                held = _Slice(conv)
            elif len(held.turns) >= most or held.chars >= SLICE_CHARS:
                close(False)
                inside = False
                held = _Slice(conv)
            if here:
                held.add(turn, role, text)
        if size > SLICE_CHARS or len(out) > SLICE_ROWS:
            yield pa.RecordBatch.from_pylist(out, schema=SLICE)
            out, size = [], 0
    if held is not None:
        close(False)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=SLICE)


# ---- slices of conversations that lie in several

_ORDER = ("part", "piece")
SOLVED = "conv_id long, part long, piece long, codes binary, after binary, vectors binary, lows binary, total long"


def _neighbours():
    return Window.partitionBy("conv_id").orderBy(*_ORDER)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices whose assumed vector behind them is not ``wanted`` are run from it, from their end until a vector is the one of the run before."""
    costs = Costs()
    for batch in batches:
        made = []
        for r in batch.to_pylist():
            rows, wanted = r["codes"], tuple(r["wanted"])
            old, lows = r["vectors"], bytearray(r["lows"] or bytes(len(rows)))
            new = bytearray(old or bytes(4 * len(rows) + 4))
            new[4 * len(rows) :] = bytes(wanted)
            after = wanted
            for i in range(len(rows) - 1, -1, -1):
                after, lows[i] = costs.before(rows[i], after)
                if old and tuple(old[4 * i : 4 * i + 4]) == after:
                    break
                new[4 * i : 4 * i + 4] = bytes(after)
            made.append({"conv_id": r["conv_id"], "part": r["part"], "piece": r["piece"], "codes": rows, "after": bytes(wanted), "vectors": bytes(new), "lows": bytes(lows), "total": sum(lows)})
        yield pa.RecordBatch.from_pylist(made, schema=_SOLVED)


_SOLVED = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("piece", pa.int64()), ("codes", pa.binary()), ("after", pa.binary()), ("vectors", pa.binary()), ("lows", pa.binary()), ("total", pa.int64())])


def _converged(codes: DataFrame) -> DataFrame:
    """Slices (conv_id, part, piece, codes) with the vectors in front of and behind each row, up to a constant each."""
    spark = codes.sparkSession
    end = F.lit(bytes(Costs.last()))
    none = [F.lit(None).cast("binary").alias(c) for c in ("vectors", "lows")]
    state = codes.select("conv_id", *_ORDER, "codes", *none, end.alias("wanted")).mapInArrow(_solve, SOLVED)
    while True:
        to = scratch_dir(spark, "repair-vectors")
        state.write.parquet(to)
        state = spark.read.parquet(to)
        wanted = F.coalesce(F.lead(F.substring("vectors", 1, 4)).over(_neighbours()), end)
        checked = state.select("*", wanted.alias("wanted"))
        if checked.where("wanted != after").isEmpty():
            return state
        again = checked.where("wanted != after").select("conv_id", *_ORDER, "codes", "vectors", "lows", "wanted").mapInArrow(_solve, SOLVED)
        state = checked.where("wanted = after").drop("wanted").unionByName(again)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state behind a slice for each state in front of it."""
    costs = Costs()
    for batch in batches:
        made = []
        for r in batch.to_pylist():
            vectors = [tuple(r["vectors"][i : i + 4]) for i in range(0, len(r["vectors"]), 4)]
            made.append({"conv_id": r["conv_id"], "part": r["part"], "piece": r["piece"], "exits": [costs.trace(r["codes"], vectors, s)[1] for s in range(4)]})
        yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("piece", pa.int64()), ("exits", pa.list_(pa.int64()))]))


def _entered(solved: DataFrame) -> DataFrame:
    """Slices with the state in which each is entered: what its left neighbour leaves, passed on until nothing changes."""
    spark = solved.sparkSession
    state = solved.mapInArrow(_exits, "conv_id long, part long, piece long, exits array<long>").withColumn("entry", F.lit(NOTHING).cast("long"))
    while True:
        to = scratch_dir(spark, "repair-states")
        state.write.parquet(to)
        state = spark.read.parquet(to)
        left = F.coalesce(F.lag(F.get("exits", F.col("entry").cast("int"))).over(_neighbours()), F.lit(NOTHING))
        checked = state.withColumn("left", left)
        if checked.where("left != entry").isEmpty():
            return state
        state = checked.select("conv_id", *_ORDER, "exits", F.col("left").alias("entry"))


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices with their vectors and entry states: the audit and the rows after their edits."""
    costs = Costs()
    schema = pa.schema([f for f in SLICE if f.name not in ("codes", "digests", "whole")])
    for batch in batches:
        for r in batch.to_pylist():
            vectors = [tuple(r["vectors"][i : i + 4]) for i in range(0, len(r["vectors"]), 4)]
            letters, state = costs.trace(r["codes"], vectors, r["entry"])
            letters.append(costs.end(state) if r["closes"] else "")
            r["turns"], r["audit"] = apply(letters, r["turns"], r["entry"]), "".join(letters)
            r["cost"] = r["total"] + (vectors[0][NOTHING] if r["opens"] else 0)
            yield pa.RecordBatch.from_pylist([r], schema=schema)


def _seen_before(slices: DataFrame) -> DataFrame:
    """The codes of each slice, rows that an earlier slice of the conversation holds marked as to be deleted, and the counts after that."""
    rows = slices.select("conv_id", *_ORDER, F.posexplode("digests").alias("at", "digest"))
    earliest = rows.groupBy("conv_id", "digest").agg(F.min(F.struct(*_ORDER)).alias("at_first"))
    a, b = rows.alias("a"), earliest.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.digest") == F.col("b.digest"))
    late = a.join(b, same & (F.struct("a.part", "a.piece") > F.col("b.at_first"))).groupBy("a.conv_id", "a.part", "a.piece").agg(F.collect_list("a.at").alias("late"))
    joined = slices.alias("s").join(late.alias("l"), F.col("s.conv_id").eqNullSafe(F.col("l.conv_id")) & (F.col("s.part") == F.col("l.part")) & (F.col("s.piece") == F.col("l.piece")), "left")
    counts = ("duplicate", "truncated")
    return joined.select("s.conv_id", "s.part", "s.piece", "s.codes", *[f"s.{c}" for c in counts], "l.late").mapInArrow(_marked, "conv_id long, part long, piece long, codes binary, duplicate long, truncated long")


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("piece", pa.int64()), ("codes", pa.binary()), ("duplicate", pa.int64()), ("truncated", pa.int64())])
    for batch in batches:
        made = batch.to_pylist()
        for r in made:
            rows = bytearray(r["codes"])
            for i in r.pop("late") or []:
                # blank rows and copies inside the slice have to go already, and stay counted as what they are
                if rows[i] < GO:
                    r["truncated"] -= rows[i] >= len(KINDS)
                    r["duplicate"] += 1
                    rows[i] = GO + rows[i] % len(KINDS)
            r["codes"] = bytes(rows)
        yield pa.RecordBatch.from_pylist(made, schema=schema)


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", here: str | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows of conversations to their repaired slices: conv_id, part, piece (their order), whole, turns (role, text after the edits), audit
    (the edits' letters), cost, blank, duplicate, truncated, illegal, n_turns (different numbers), first_turn, last_turn.

    Rows are taken by turn (nulls first), then role and text; rows that are alike stand next to each other, and all but the first are
    duplicates. A null role or text is one blank. Rows without a conv_id are one conversation. Rows where ``here`` is not true take no
    part; a conversation of such rows only has one slice without turns. Most conversations are one slice (``whole``); long ones,
    and those on the border of two ranges, may be several, whose numbers add up. An empty table gives no rows.
    """
    bounded_batches(turns.sparkSession)
    spark = turns.sparkSession
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), (F.coalesce(F.col(here), F.lit(False)) if here else F.lit(True)).alias("here")
    )
    ranges = rows.repartitionByRange(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.left("role", F.lit(16)), F.left("text", F.lit(64)))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    to = scratch_dir(spark, "repair-slices")
    ranges.sortWithinPartitions(*order).mapInArrow(partial(_cut, most=slice_rows), SLICE_SQL).write.parquet(to)
    slices = spark.read.parquet(to)
    done = slices.where("whole").drop("codes", "digests", "first", "last")
    if slices.where("not whole").isEmpty():
        return done
    some = F.max(F.length("codes")).over(Window.partitionBy("conv_id"))
    first = F.row_number().over(_neighbours())
    # of a conversation without rows one slice stays, else those with rows
    kept = slices.where("not whole").select("conv_id", *_ORDER, "codes", "digests", "duplicate", "truncated").withColumn("some", some).withColumn("k", first).where("length(codes) > 0 or (some = 0 and k = 1)").drop("some", "k")
    to = scratch_dir(spark, "repair-marked")
    _seen_before(kept).write.parquet(to)
    marked = spark.read.parquet(to)
    solved = _converged(marked.select("conv_id", *_ORDER, "codes"))
    entered = _entered(solved)
    near = _neighbours()
    heads = slices.where("not whole").select("conv_id", *_ORDER, "blank", "illegal", "n_turns", "first_turn", "last_turn", "first", "last")
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.part") == F.col(f"{b}.part")) & (F.col(f"{a}.piece") == F.col(f"{b}.piece"))
    small = (
        marked.alias("m").join(heads.alias("h"), same("m", "h")).join(solved.alias("v"), same("m", "v")).join(entered.alias("e"), same("m", "e"))
        .select("m.*", *[f"h.{c}" for c in heads.columns[3:]], "v.vectors", "v.total", "e.entry")
        .withColumn("opens", F.lag("piece").over(near).isNull()).withColumn("closes", F.lead("piece").over(near).isNull())
        .withColumn("illegal", F.col("illegal") + F.coalesce((~F.concat(F.lag("last").over(near), "first").isin(*LEGAL)).cast("long"), F.lit(0)))
        .withColumn("n_turns", F.col("n_turns") - F.coalesce((F.last("last_turn", True).over(near.rowsBetween(Window.unboundedPreceding, -1)) == F.col("first_turn")).cast("long"), F.lit(0)))
    )
    texts = slices.where("not whole").select("conv_id", *_ORDER, "turns")
    open_ones = small.alias("m").join(texts.alias("t"), same("m", "t")).select("m.*", "t.turns")
    columns = ", ".join(f"{f.name} {_SQL[f.type]}" for f in SLICE if f.name not in ("codes", "digests", "whole"))
    rest = open_ones.mapInArrow(_repaired, columns).drop("first", "last").withColumn("whole", F.lit(False))
    return done.unionByName(rest)


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices in order to one row per conversation; only one slice's texts are held at a time."""
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    now, sums, low, high, audit, text = None, None, None, None, [], None

    def row():
        gaps = 0 if low is None else high - low + 1 - sums["n_turns"]
        kept = {k: v for k, v in sums.items() if k != "n_turns"}
        return pa.RecordBatch.from_pylist([{"conv_id": now[0], "gaps": gaps, **kept, "audit": "".join(audit), "repaired_sha256": text.hexdigest()}], schema=schema)

    for batch in batches:
        for r in batch.to_pylist():
            if now is None or now[0] != r["conv_id"]:
                if now is not None:
                    yield row()
                now, low, high, audit, text, empty = (r["conv_id"],), None, None, [], hashlib.sha256(), True
                sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "n_turns"), 0)
            for k in sums:
                sums[k] += r[k]
            low = r["first_turn"] if low is None else low
            high = r["last_turn"] if r["last_turn"] is not None else high
            audit.append(r["audit"])
            for t in r["turns"]:
                text.update(("" if empty else "\n").encode() + f"{t['role']}:{t['text']}".encode())
                empty = False
    if now is not None:
        yield row()


def summary(slices: DataFrame) -> DataFrame:
    """One row per conversation: gaps in its numbers, the counts, the cost, the audit, and the digest of the repaired ``role:text`` lines."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat_ws(":", t["role"], t["text"])), "\n")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0))
    one = slices.where("whole").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    more = slices.where("not whole").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_ORDER).mapInArrow(_joined, SUMMARY)
    return one.unionByName(more)
