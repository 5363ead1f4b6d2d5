"""Repair of conversation structure: cheapest edits by bidirectional Dijkstra.

The lattice of a conversation has a node for every row position and every state
of the wanted pattern ``(s?(ua)+)?``: nothing yet, after a system turn, after a
user turn, after an assistant turn.  Keep, rerole and delete go one row on, insert
stays.  A forward heap starts at the beginning and a reverse heap at the ends;
they stop once their smallest costs together pass the cheapest crossing, so
every crossing of that cost is known, and the one with the least audit counts.

Conversations of any length: rows are dealt by ranges of (conversation, turn, role,
text), which cuts a long one anywhere, and read as a stream.  A conversation inside one
range is finished there.  Of one that is cut, every block of rows gives a table
of cheapest edits from each state to each state; tables, and the texts of the blocks,
meet in order.  Only there a conversation goes through one task, as a stream of
blocks: the digest of its repaired text cannot be put together from parts.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of the pattern.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
STEP = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: What a rerole or an insert makes in each state: one role, never a system turn.
MADE = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: States from which a rerole or an insert comes to a state.
FROM = {USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 3, 4, 3, 3
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 20


@dataclass(slots=True)
class Row:
    """A row with its equal copies; only the first of the copies can be kept."""

    turn: int | None
    role: str
    text: str
    copies: int
    first: bool
    fault: str = ""

    def __post_init__(self) -> None:
        solid = self.text.rstrip(" \t\n\v\f\r")
        if not solid:
            self.fault = "blank"
        elif not self.first:
            self.fault = "duplicate"
        elif solid[-1] not in ".!?":
            self.fault = "truncated"

    def edits(self) -> list[tuple[int, str, str]]:
        """Cost, audit and kind of the edits that take this row; surplus copies go with it."""
        if self.fault in ("blank", "duplicate"):
            return [(DELETE * self.copies, "D" * self.copies, "D")]
        more, surplus = (LEFT_TRUNCATED if self.fault == "truncated" else 0), self.copies - 1
        gone = DELETE * surplus
        return [
            (more + gone, "K" + "D" * surplus, "K"),
            (REROLE + more + gone, "R" + "D" * surplus, "R"),
            (DELETE + gone, "D" * self.copies, "D"),
        ]

    def moves(self, state: int) -> Iterator[tuple[int, int, str]]:
        """State after the row, cost and audit."""
        for cost, audit, kind in self.edits():
            if kind == "D":
                yield state, cost, audit
            elif kind == "R":
                yield MADE[state][1], cost, audit
            elif (to := STEP[state].get(self.role[:1])) is not None:
                yield to, cost, audit


def cheapest(rows: list[Row], begin: int, ends: Iterable[int]) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits that lead from a state to one of ``ends``.

    Two audits of equal cost at one node are never the beginning of one
    another (a longer one would hold more inserts), so the least whole audit is
    made of least halves.  A key of a heap holds the rows gone over behind the cost,
    since keeping a row costs nothing: a node is then settled after all that lead to it.
    """
    n = len(rows)
    steps = [[list(row.moves(state)) for state in range(4)] for row in rows]
    back = [[[] for _ in range(4)] for _ in rows]
    for i, by_state in enumerate(steps):
        for state, found in enumerate(by_state):
            for to, cost, audit in found:
                back[i][to].append((state, cost, audit))
    ahead: dict[tuple[int, int], tuple[int, str]] = {(0, begin): (0, "")}
    behind: dict[tuple[int, int], tuple[int, str]] = {(n, state): (0, "") for state in ends}
    heaps = ([(0, 0, begin)], [(0, 0, state) for state in ends])
    heapq.heapify(heaps[1])
    settled: tuple[set, set] = (set(), set())
    best: tuple[int, str] | None = None

    def crossing(node: tuple[int, int]) -> None:
        nonlocal best
        if node in ahead and node in behind:
            (a, x), (b, y) = ahead[node], behind[node]
            if best is None or (a + b, x + y) < best:
                best = (a + b, x + y)

    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best[0]):
        side = 0 if heaps[0][0] <= heaps[1][0] else 1
        cost, gone, state_at = heapq.heappop(heaps[side])
        i = gone if side == 0 else n - gone
        node = (i, state_at)
        if node in settled[side]:
            continue
        settled[side].add(node)
        crossing(node)
        known = (ahead, behind)[side]
        audit = known[node][1]
        if side == 0:
            nexts = [((i, MADE[state_at][1]), cost + INSERT, audit + "I")]
            if i < n:
                nexts += [((i + 1, to), cost + c, audit + a) for to, c, a in steps[i][state_at]]
        else:
            nexts = [((i, state), cost + INSERT, "I" + audit) for state in FROM.get(state_at, ())]
            if i:
                nexts += [((i - 1, state), cost + c, a + audit) for state, c, a in back[i - 1][state_at]]
        for to, c, a in nexts:
            if to not in known or (c, a) < known[to]:
                if to not in known or c < known[to][0]:
                    heapq.heappush(heaps[side], (c, to[0] if side == 0 else n - to[0], to[1]))
                known[to] = (c, a)
                crossing(to)
    return best


def repaired(rows: list[Row], audit: str, state: int) -> tuple[list[tuple[str, str]], int]:
    """Turns after the edits of an audit that begins in a state, and the state after them."""
    out, at = [], 0

    def insert() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role, state = MADE[state]
            out.append((role, ""))
            at += 1

    for row in rows:
        insert()
        if audit[at] == "K":
            out.append((row.role, row.text))
            state = STEP[state][row.role[:1]]
        elif audit[at] == "R":
            role, state = MADE[state]
            out.append((role, row.text))
        at += row.copies
    insert()
    return out, state


@dataclass
class Counts:
    """Sums over neighbouring rows, in order."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    low: int | None = None
    high: int | None = None
    turns: int = 0
    head: str | None = None
    tail: str | None = None

    def add(self, other: Counts) -> None:
        """``other`` stands behind; a turn that goes on there counts once."""
        if other.head is None:
            return
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if self.head is None:
            self.head = other.head
        else:
            self.illegal += self.tail + other.head not in ("su", "ua", "au")
        self.tail = other.tail
        if other.low is not None:
            self.turns += other.turns - (self.high == other.low)
            self.low, self.high = (other.low if self.low is None else self.low), other.high

    @staticmethod
    def of(row: Row) -> Counts:
        role = row.role[:1]
        n = {"blank": 0, "duplicate": row.copies - 1, "truncated": 0}
        if row.fault in ("blank", "duplicate"):
            n = {"blank": 0, "duplicate": 0, "truncated": 0, row.fault: row.copies}
        elif row.fault:
            n["truncated"] = 1
        has = row.turn is not None
        return Counts(**n, illegal=row.copies - 1, low=row.turn, high=row.turn, turns=int(has), head=role, tail=role)

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


class Digest:
    """SHA-256 of turns written as ``role:text``, joined by line ends."""

    def __init__(self) -> None:
        self.sha, self.empty = hashlib.sha256(), True

    def add(self, turns: Iterable[tuple[str, str]]) -> None:
        for role, text in turns:
            self.sha.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            self.empty = False


class Ways:
    """Cheapest audits from the beginning to each state, block after block.

    What the audits of all states have in common is set aside, so the
    strings that are compared stay short.
    """

    def __init__(self) -> None:
        self.done: list[str] = []
        self.by_state: dict[int, tuple[int, str]] = {START: (0, "")}

    def add(self, table: dict[tuple[int, int], tuple[int, str]]) -> None:
        new: dict[int, tuple[int, str]] = {}
        for (begin, end), (cost, audit) in table.items():
            if begin in self.by_state:
                c, a = self.by_state[begin]
                if end not in new or (c + cost, a + audit) < new[end]:
                    new[end] = (c + cost, a + audit)
        shared = os.path.commonprefix([a for _, a in new.values()])
        self.done.append(shared)
        self.by_state = {s: (c, a[len(shared) :]) for s, (c, a) in new.items()}

    def end(self) -> tuple[int, str]:
        cost, audit = min(self.by_state[s] for s in ENDS if s in self.by_state)
        return cost, "".join(self.done) + audit


COUNTS = "blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, head string, tail string"
BLOCKS = f"conv_id long, part int, block int, kind int, {COUNTS}, cost long, audit string, sha256 string, ways array<struct<begin: int, end: int, cost: long, audit: string>>, rows array<struct<role: string, text: string, copies: long>>"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNT_NAMES = [x.split()[0] for x in COUNTS.split(", ")]


def _arrow(schema: str) -> pa.Schema:
    plain = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    way = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    row = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())]))
    fields = [x.strip().split(" ", 1) for x in schema.split(", ways")[0].split(",")]
    out = [(n, plain[t]) for n, t in fields]
    return pa.schema(out + ([("ways", way), ("rows", row)] if "ways" in schema else []))


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of ``conv_id, turn, role, text`` with the contract's faults; nulls are written as one space.

    A hash of conversation and turn drops a row (0), empties its text (1), takes its
    full stops, exclamation and question marks (2), repeats it (3) or makes its
    role ``user`` (4).
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return turns.where(fault != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(space("role")).alias("role"),
        text.alias("text"),
        F.when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Counts of faults, the cheapest edits and the digest of the repaired turns of each conversation.

    ``turns`` has ``conv_id, turn, role, text`` and, if rows stand for several equal
    ones, ``copies``; other columns are not looked at.  Null roles and texts are one
    space; null turns come first, and rows of one turn go by role and text.  A null
    conversation is one like any other.  ``conversations`` (with ``conv_id``) adds
    those without any row: zeros, no edits, the digest of nothing.
    """
    copies: Column = F.col("copies") if "copies" in turns.columns else F.lit(1)
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = (
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), copies.alias("copies"))
        .groupBy("conv_id", "turn", "role", "text")
        .agg(F.sum("copies").cast("long").alias("copies"))
    )
    # The first turn of each text of a conversation; both sides of the join are as many as the distinct rows.
    said = F.sha2(F.to_json(F.struct("role", "text")), 256)
    firsts = rows.groupBy(F.col("conv_id").alias("f_conv"), said.alias("f_said")).agg(F.min(F.struct("turn")).alias("f_first"), F.count(F.lit(1)).alias("f_rows")).where("f_rows > 1")
    marked = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (said == F.col("f_said")), "left").select(
        "conv_id", "turn", "role", "text", "copies", (F.col("f_first").isNull() | F.col("f_first").eqNullSafe(F.struct("turn"))).alias("first")
    )
    order = ["conv_id", "turn", "role", "text"]
    blocks = marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks, BLOCKS)
    # A finished conversation is one slim row, a cut one a row for every block: tables first, then texts.
    joined = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "block").mapInArrow(_joined, RESULT)
    if conversations is None:
        return joined
    empty = hashlib.sha256(b"").hexdigest()
    every = conversations.select(F.col("conv_id").cast("long").alias("e_conv")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return every.join(joined, F.col("e_conv").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("e_conv").alias("conv_id"),
        *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )


@dataclass
class Block:
    rows: list[Row] = field(default_factory=list)
    size: int = 0

    def add(self, row: Row) -> None:
        self.rows.append(row)
        self.size += len(row.text)

    def full(self) -> bool:
        return len(self.rows) >= BLOCK_ROWS or self.size >= BLOCK_BYTES

    def counts(self) -> Counts:
        out = Counts()
        for row in self.rows:
            out.add(Counts.of(row))
        return out


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Blocks of rows in order: conversation, block, and whether the conversation begins and ends with it here."""
    names = ("conv_id", "turn", "role", "text", "copies", "first")
    current, block, begins = None, Block(), True
    for batch in batches:
        for conv, *rest in zip(*(batch.column(n).to_pylist() for n in names)):
            if block.rows and (conv != current or block.full()):
                yield current, block, begins, conv != current
                begins, block = conv != current, Block()
            current = conv
            block.add(Row(*rest))
    if block.rows:
        yield current, block, begins, True


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished conversations, and the blocks of those that may go on in a neighbouring range."""
    from pyspark import TaskContext

    part, schema, out, size = TaskContext.get().partitionId(), _arrow(BLOCKS), [], 0
    found = _conversations(batches)
    now, first, number = next(found, None), True, 0
    while now is not None:
        conv, block, begins, ends = now
        now = next(found, None)
        counts = block.counts()
        row = {"conv_id": conv, "part": part, "block": number, **{n: getattr(counts, n) for n in COUNT_NAMES}}
        if begins and ends and not first and now is not None:
            cost, audit = cheapest(block.rows, START, ENDS)
            digest = Digest()
            digest.add(repaired(block.rows, audit, START)[0])
            out.append(row | {"kind": 0, "cost": cost, "audit": audit, "sha256": digest.sha.hexdigest()})
        else:
            ways = [(b, e, cheapest(block.rows, b, (e,))) for b in range(4) for e in range(4)]
            out.append(row | {"kind": 1, "ways": [{"begin": b, "end": e, "cost": w[0], "audit": w[1]} for b, e, w in ways if w]})
            out.append({"conv_id": conv, "part": part, "block": number, "kind": 2, "rows": [{"role": r.role, "text": r.text, "copies": r.copies} for r in block.rows]})
            size += block.size
        first, number = first and not ends, number + 1
        if len(out) >= 1000 or size >= 4 * BLOCK_BYTES:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation, from finished ones or from blocks in order."""
    schema, out = _arrow(RESULT), []
    open_: dict | None = None

    def close() -> None:
        nonlocal open_
        if open_ is not None:
            open_["digest"].add(repaired([], open_["audit"][open_["at"] :], open_["state"])[0])
            out.append(line(open_["conv"], open_["counts"], open_["cost"], open_["audit"], open_["digest"].sha.hexdigest()))
            open_ = None

    def line(conv, counts: Counts, cost: int, audit: str, sha: str) -> dict:
        return {"conv_id": conv, "gaps": counts.gaps(), **{n: getattr(counts, n) for n in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "repaired_sha256": sha}

    for batch in batches:
        for at in range(len(batch)):
            row = batch.slice(at, 1).to_pylist()[0]
            if open_ is not None and (row["conv_id"] != open_["conv"] or row["kind"] == 0):
                close()
            counts = Counts(**{n: row[n] for n in COUNT_NAMES}) if row["kind"] < 2 else None
            if row["kind"] == 0:
                out.append(line(row["conv_id"], counts, row["cost"], row["audit"], row["sha256"]))
            elif row["kind"] == 1:
                if open_ is None:
                    open_ = {"conv": row["conv_id"], "counts": Counts(), "ways": Ways(), "digest": Digest(), "audit": None, "at": 0, "state": START}
                open_["counts"].add(counts)
                open_["ways"].add({(w["begin"], w["end"]): (w["cost"], w["audit"]) for w in row["ways"]})
            else:
                if open_["audit"] is None:
                    open_["cost"], open_["audit"] = open_["ways"].end()
                rows = [Row(None, r["role"], r["text"], r["copies"], True) for r in row["rows"]]
                # The edits of a block: as many letters other than inserts as it has rows, and the inserts before them.
                audit, start, left = open_["audit"], open_["at"], sum(r.copies for r in rows)
                end = start
                while left:
                    left -= audit[end] != "I"
                    end += 1
                turns, open_["state"] = repaired(rows, audit[start:end], open_["state"])
                open_["digest"].add(turns)
                open_["at"] = end
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)
