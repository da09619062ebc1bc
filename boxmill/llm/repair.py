"""Operator 13, conversation structure repair by depth-first branch-and-bound.

Rows are exchanged into ranges of (conversation, turn) and read as sorted
streams. A stream cuts a conversation into pieces of PIECE rows, and each piece is
solved for the roles that can stand before and after it. Conversations that lie
inside one range are done then; the pieces of others, a row each, meet in the
order of their ranges, where only four best repairs are held at a time.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Fixed costs of edits, and what a truncated row adds unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a conversation that are solved at once.
PIECE = 256
#: What stands last: nothing, a system, user or assistant row; a repair ends after nothing or an assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: What stands last after a row with an initial, by what stood there before; other steps are not allowed.
STEPS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLES = {"u": "user", "a": "assistant"}
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
FOREVER = 1 << 60

Best = tuple[int, str]


def _moves(initial: str, fault: int) -> list[list[tuple[str, int, int]]]:
    """By what stands last: the edits (initial, cost, what stands last then) that use the row up, in ASCII order."""
    out: list[list[tuple[str, int, int]]] = []
    must, extra = fault in (BLANK, DUPLICATE), TRUNCATED if fault == CUT_OFF else 0
    for state in range(4):
        found = [("D", DELETE, state)]
        if not must:
            if (state, initial) in STEPS:
                found.append(("K", extra, STEPS[state, initial]))
            found += [("R", REROLE + extra, STEPS[state, x]) for x in ROLES if (state, x) in STEPS]
        out.append(found)
    return out


#: Edits that insert a row, by what stands last.
INSERTS = [[("I", INSERT, STEPS[state, x]) for x in ROLES if (state, x) in STEPS] for state in range(4)]


def _bounds(moves: list[list[list[tuple[str, int, int]]]], ends: tuple[int, ...]) -> list[list[int]]:
    """Suffix lower bounds: the least cost from each (row, what stands last) to the end."""

    def with_inserts(cost: list[int]) -> list[int]:
        for _ in range(2):  # more than two in a row only lead back
            cost = [min(c, *(w + cost[to] for _, w, to in INSERTS[s])) for s, c in enumerate(cost)]
        return cost

    out = [with_inserts([0 if s in ends else FOREVER for s in range(4)])]
    for row in reversed(moves):
        out.append(with_inserts([min(w + out[-1][to] for _, w, to in row[s]) for s in range(4)]))
    return out[::-1]


def search(moves: list[list[list[tuple[str, int, int]]]], begin: int, ends: tuple[int, ...]) -> Best | None:
    """The cheapest edits as (cost, initials), of equal costs the ASCII-least; None if nothing leads to `ends`.

    Depth first, with the ASCII-least edit next. A node is a row and what stands
    last; its table entry is the best (cost, initials) seen there, and prefixes
    that are no better are dropped, as both have the same suffixes. Initials tell
    the roles, so of equal prefixes to a node none is the beginning of the other.
    """
    least, n = _bounds(moves, ends), len(moves)
    most, best = least[0][begin], None  # the bounds are tight, so the first incumbent's cost is known before it is found
    reached: dict[tuple[int, int], Best] = {}
    stack: list[tuple[int, int, int, str]] = [(0, begin, 0, "")] if most < FOREVER else []
    while stack:
        row, state, cost, audit = stack.pop()
        if cost + least[row][state] > most or best and audit > best[1][: len(audit)]:
            continue
        if (seen := reached.get((row, state))) and seen <= (cost, audit):
            continue
        reached[row, state] = cost, audit
        if row == n and state in ends and (best is None or (cost, audit) < best):
            best = cost, audit
        steps = [*INSERTS[state], *([] if row == n else moves[row][state])]
        stack += [(row + (edit != "I"), to, cost + weight, audit + edit) for edit, weight, to in sorted(steps, reverse=True)]
    return best


def repaired(audit: str, begin: int, roles: list[str], texts: list[str]) -> Iterator[str]:
    """The rows that edits leave, as role:text."""
    state, row = begin, 0
    for edit in audit:
        if edit != "D":
            initial = roles[row][:1] if edit == "K" else "a" if state == USER else "u"
            yield f"{roles[row] if edit == 'K' else ROLES[initial]}:{'' if edit == 'I' else texts[row]}"
            state = STEPS[state, initial]
        row += edit != "I"


@dataclass
class Piece:
    """Rows of a conversation in order, with what their neighbours need to know."""

    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    faults: list[int] = field(default_factory=list)
    turns: list[int | None] = field(default_factory=list)

    def moves(self) -> list[list[list[tuple[str, int, int]]]]:
        return [_moves(role[:1], fault) for role, fault in zip(self.roles, self.faults, strict=True)]

    def counts(self) -> dict:
        known = [t for t in self.turns if t is not None]
        starts = [r[:1] for r in self.roles]
        return {
            "n": len(starts), "low": known[0] if known else None, "high": known[-1] if known else None, "turns": len(set(known)),
            "blank": self.faults.count(BLANK), "duplicate": self.faults.count(DUPLICATE), "truncated": self.faults.count(CUT_OFF),
            "illegal": sum(a + b not in LEGAL for a, b in zip(starts, starts[1:], strict=False)), "head": starts[0] if starts else None, "foot": starts[-1] if starts else None,
        }


LEGAL = ("su", "ua", "au")
COUNTS = ["n", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "head", "foot"]
PIECES = """part int, k long, n long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, head string, foot string,
 costs array<long>, audits array<string>, roles array<string>, texts array<string>, sha string"""
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _fault(text: str, seen: bool) -> int:
    last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
    return BLANK if not last else DUPLICATE if seen else FINE if last in ".!?" else CUT_OFF


def _record(conv, part: int, k: int, piece: Piece, whole: bool) -> dict:
    """A piece as a row: solved if it is a whole conversation, else for all that can stand before and after it."""
    moves, out = piece.moves(), {"conv_id": conv, "part": part, "k": k, **piece.counts()}
    if whole:
        cost, audit = search(moves, NOTHING, ENDS)
        sha = hashlib.sha256("\n".join(repaired(audit, NOTHING, piece.roles, piece.texts)).encode()).hexdigest()
        return out | {"costs": [cost], "audits": [audit], "roles": None, "texts": None, "sha": sha}
    ways = [search(moves, begin, (end,)) or (None, None) for begin in range(4) for end in range(4)]
    texts = [None if fault in (BLANK, DUPLICATE) else text for text, fault in zip(piece.texts, piece.faults, strict=True)]
    return out | {"costs": [w[0] for w in ways], "audits": [w[1] for w in ways], "roles": piece.roles, "texts": texts, "sha": None}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(records: Iterator[dict], schema: pa.Schema, room: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Records in batches of up to 1,000, and of about `room` bytes of text."""
    some, size = [], 0
    for r in records:
        some.append(r)
        size += sum(len(t or "") for t in r.get("texts") or ()) + len(r.get("audit") or "")
        if len(some) == 1000 or size >= room:
            yield pa.RecordBatch.from_pylist(some, schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


def _cut_pieces(rows: Iterator[tuple], part: int, size: int) -> Iterator[dict]:
    """Pieces of a sorted stream of (conv_id, turn, role, text, live, again); only runs with rows of others before and after are whole."""
    piece, k, conv, before, edge = None, 0, None, None, True
    for of, turn, role, text, live, again in rows:
        if piece is None or of != conv:
            if piece is not None:
                yield _record(conv, part, k, piece, not edge)
                edge, k = False, k + 1
            piece, conv, before = Piece(), of, None
        elif len(piece.roles) >= size:
            yield _record(conv, part, k, piece, False)
            piece, k, edge = Piece(), k + 1, True
        if live:
            piece.roles.append(role)
            piece.texts.append(text)
            piece.faults.append(_fault(text, again or before == (turn, role, text)))
            piece.turns.append(turn)
            before = turn, role, text
    if piece is not None:
        yield _record(conv, part, k, piece, False)


@dataclass
class Path:
    """The best repair so far that ends with one of the states."""

    cost: int
    audit: str
    sha: object
    empty: bool


class Meeting:
    """The pieces of one conversation, one after the other."""

    def __init__(self, conv):
        self.conv, self.sums, self.low, self.high, self.foot = conv, dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0), None, None, None
        self.paths: dict[int, Path] = {NOTHING: Path(0, "", hashlib.sha256(), True)}
        self.done: tuple[int, str, str] | None = None
        self.shared: list[str] = []  # what all paths begin with

    def add(self, r: dict) -> None:
        for name in self.sums:
            self.sums[name] += r[name]
        if r["n"]:
            self.sums["illegal"] += self.foot is not None and self.foot + r["head"] not in LEGAL
            self.foot = r["foot"]
        if r["low"] is not None:
            self.sums["turns"] -= self.high == r["low"]
            self.low, self.high = r["low"] if self.low is None else self.low, r["high"]
        if not r["n"]:
            return
        if r["sha"]:  # a whole conversation
            self.done = r["costs"][0], r["audits"][0], r["sha"]
            return
        paths = {}
        for end in range(4):
            ways = [(p.cost + r["costs"][begin * 4 + end], p.audit + r["audits"][begin * 4 + end], begin) for begin, p in self.paths.items() if r["costs"][begin * 4 + end] is not None]
            if ways:
                cost, audit, begin = min(ways)
                before = self.paths[begin]
                sha, empty = before.sha.copy(), before.empty
                for line in repaired(audit[len(before.audit) :], begin, r["roles"], r["texts"]):
                    sha.update((line if empty else "\n" + line).encode())
                    empty = False
                paths[end] = Path(cost, audit, sha, empty)
        self.paths = paths
        first = os.path.commonprefix([p.audit for p in paths.values()])
        self.shared.append(first)
        for p in paths.values():
            p.audit = p.audit[len(first) :]

    def result(self) -> dict:
        cost, audit, sha = self.done or min((p.cost, p.audit, p.sha.hexdigest()) for s, p in self.paths.items() if s in ENDS)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.sums["turns"]
        return {"conv_id": self.conv, "gaps": gaps, **{x: self.sums[x] for x in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": "".join(self.shared) + audit, "repaired_sha256": sha}


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults drawn by crc32(conv_id:turn) mod 20; dropped rows stay as `live` false, so that no conversation is lost."""
    drawn = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    new_text = F.when(drawn == 1, "").when(drawn == 2, F.translate(text, ".!?", "")).otherwise(text)
    d = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(drawn == 4, "user").otherwise(role).alias("role"), new_text.alias("text"), (drawn != 0).alias("live"), F.when(drawn == 3, 2).otherwise(1).alias("times"))
    d = d.withColumns({c: F.when(F.col("live"), F.col(c)).otherwise("") for c in ("role", "text")})
    return d.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "time")


def _again(d: DataFrame) -> DataFrame:
    """d with `again`: its role and text stand at an earlier turn of the conversation, nulls first. Only what repeats at several turns is joined back."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    keys = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2")]
    d = d.select("*", *keys)
    often = d.where("live").groupBy(F.col("conv_id").alias("_conv"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where("_first < _last").drop("_last")
    on = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    return d.join(often, on, "left").select("conv_id", "turn", "role", "text", "live", F.coalesce(place > F.col("_first"), F.lit(False)).alias("again"))


def repair(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Of rows (conv_id, turn, role, text, live): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows of a conversation go by turn, nulls first, then by role and text. Those
    that are not `live` only name their conversation. A null conversation is one
    of its own. Null roles and texts count as one space. Rows alike in all are
    duplicates but for the first. A conversation without live rows has zeros, an
    empty audit and the hash of nothing. Conversations of any length are solved in
    pieces; a long one's pieces meet in one task, which holds four hashes and what
    its four best repairs don't share. An empty table gives no rows; other
    columns don't matter.
    """
    kind = dict(rows.dtypes)["conv_id"]
    d = _again(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], "live"))
    # the beginning of the text is enough for the ranges, so that their sampled bounds stay small
    streams = d.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")

    def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_cut_pieces(_rows(batches), TaskContext.get().partitionId(), piece), pieces_schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[dict]:
            at: Meeting | None = None
            for batch in batches:
                for r in batch.to_pylist():
                    if at is None or r["conv_id"] != at.conv:
                        if at:
                            yield at.result()
                        at = Meeting(r["conv_id"])
                    at.add(r)
            if at:
                yield at.result()

        yield from _batches(results(), result_schema)

    pieces_schema = to_arrow_schema(StructType.fromDDL(f"conv_id {kind}, {PIECES}"))
    result_schema = to_arrow_schema(StructType.fromDDL(f"conv_id {kind}, {RESULT}"))
    pieces = streams.mapInArrow(cut_pieces, f"conv_id {kind}, {PIECES}")
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "k").mapInArrow(meet, f"conv_id {kind}, {RESULT}")
