"""Repair of the structure of conversations, as cheap as possible, by divide and conquer.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Rows can be kept, given another role or deleted, and
empty ones inserted. What has been written so far is in one of four states: nothing yet, after ``s``, after ``u``, after ``a``. From a state
and an edit the next state follows, so an audit (the initials of the edits) belongs to one path only.

Among the cheapest paths the one with the least audit is wanted. Forward vectors hold for each state the cost and the rank
of its least audit among those of all states. Two audits of the same rows, cut behind the last of them, are never one the beginning of
the other, so ranks are carried on from row to row. Backward vectors hold the costs to the end. Where both meet, in the middle, the
state of least cost, and of those the one of least rank, is on the path; both halves are settled in the same way (Hirschberg). Only
vectors of four are kept, and the audit.

Rows stand in order across tasks, in segments of bounded length. Each segment's costs between all states are found where it
lies, segments of a conversation meet as their vectors do, and each segment is then settled on its own. So a conversation with a third of
all rows is many tasks' work, up to its audit and its checksum, which are single values of one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.session import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED_COST = 0, 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = "sua"
FAULTS = SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
SEGMENT_ROWS = 1 << 16
#: As many rows are settled with a table of backward vectors.
FEW_ROWS = 16
NEVER = 1 << 60

SPACE = r"\x20\x09-\x0D"


def following(state: int, initial: str) -> int | None:
    """The state behind ``initial``, if it may be written."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return USER if state != USER else None
    if initial == "a":
        return ASSISTANT if state == USER else None
    return None


def turn_of(state: int) -> str:
    """The one of user and assistant that may be written in a state."""
    return "a" if state == USER else "u"


def inserted(state: int, times: int) -> int:
    for _ in range(times):
        state = following(state, turn_of(state))
    return state


def code_of(initial: str, fault: int) -> int:
    """A row as a byte: the initial of its role (s, u, a or another one) and its first fault."""
    place = ROLES.find(initial) if initial else -1
    return (place if place >= 0 else 3) * 4 + fault


@lru_cache(maxsize=None)
def steps(code: int) -> tuple:
    """Cheapest ways over one row, as ((from, to, cost, letters), ...): insertions before it, and its own edit."""
    initial, fault = "sua?"[code // 4], code % 4
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start, times in product(range(4), range(3)):
        state = inserted(start, times)
        edits = [(DELETE, "D", state)]
        if fault in (SOUND, TRUNCATED):
            more = TRUNCATED_COST if fault == TRUNCATED else 0
            kept = following(state, initial)
            edits += [(KEEP + more, "K", kept)] if kept is not None else []
            edits += [(REROLE + more, "R", following(state, turn_of(state)))]
        for cost, letter, to in edits:
            way = (INSERT * times + cost, "I" * times + letter)
            best[start, to] = min(way, best.get((start, to), way))
    return tuple((p, q, cost, letters) for (p, q), (cost, letters) in sorted(best.items()))


#: What closes a conversation from each state: a user row needs its assistant, a system row both.
CLOSING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
AT_END = tuple(cost for cost, _ in CLOSING)


def ranked(ways: dict) -> list[tuple[int, int]]:
    """Vectors (cost, rank) from the least (cost, key of its audit) of each state that is reached."""
    places = {key: i for i, key in enumerate(sorted(key for _, key in ways.values()))}
    return [(ways[q][0], places[ways[q][1]]) if q in ways else (NEVER, 4) for q in range(4)]


def start_in(state: int) -> list[tuple[int, int]]:
    return [(0, 0) if q == state else (NEVER, 4) for q in range(4)]


def forward(codes: bytes, vector: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Costs and ranks of the least audits behind all rows, from those before them."""
    for code in codes:
        ways: dict = {}
        for p, q, cost, letters in steps(code):
            before, rank = vector[p]
            if before < NEVER:
                way = (before + cost, (rank, letters))
                if q not in ways or way < ways[q]:
                    ways[q] = way
        vector = ranked(ways)
    return vector


def backward(codes: bytes, costs) -> list[int]:
    """Costs to the end from each state before the rows, given those behind them."""
    for code in reversed(codes):
        before = [NEVER] * 4
        for p, q, cost, _ in steps(code):
            if cost + costs[q] < before[p]:
                before[p] = cost + costs[q]
        costs = before
    return list(costs)


def crossing(ahead: list[tuple[int, int]], behind) -> int:
    """The state in which the least of the cheapest audits crosses from one part to the next."""
    return min(range(4), key=lambda q: (ahead[q][0] + behind[q], ahead[q][1]))


def audit_between(codes: bytes, start: int, costs) -> str:
    """The least of the cheapest audits over the rows, from a state, given the costs behind them. What closes is not in it."""
    if len(codes) <= FEW_ROWS:
        tables = [costs]
        for code in reversed(codes):
            tables.append(backward(bytes([code]), tables[-1]))
        tables.reverse()
        letters, state = [], start
        for i, code in enumerate(codes):
            ways = [(cost + tables[i + 1][q], text, q) for p, q, cost, text in steps(code) if p == state]
            _, text, state = min(ways)
            letters.append(text)
        return "".join(letters)
    middle = len(codes) // 2
    meeting = crossing(forward(codes[:middle], start_in(start)), backward(codes[middle:], costs))
    reached = [0 if q == meeting else NEVER for q in range(4)]
    return audit_between(codes[:middle], start, reached) + audit_between(codes[middle:], meeting, costs)


def matrix(codes: bytes) -> list[list[tuple[int, int]]]:
    """The vectors over a segment from each state."""
    return [forward(codes, start_in(p)) for p in range(4)]


def joined(vector: list[tuple[int, int]], over: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Costs and ranks behind a segment, from those before it and its matrix."""
    ways: dict = {}
    for p, q in product(range(4), range(4)):
        if vector[p][0] < NEVER and over[p][q][0] < NEVER:
            way = (vector[p][0] + over[p][q][0], (vector[p][1], over[p][q][1]))
            if q not in ways or way < ways[q]:
                ways[q] = way
    return ranked(ways)


def before_segment(over: list[list[tuple[int, int]]], costs) -> list[int]:
    return [min(min(over[p][q][0] + costs[q] for q in range(4)), NEVER) for p in range(4)]


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after a repeatable damage: key, turn, role, text. A null counts as one space, but for the order of turns."""
    space = F.lit(" ")
    key = F.coalesce(F.col("conv_id").cast("long").cast("string"), space)
    number = F.crc32(F.concat(key, F.lit(":"), F.coalesce(F.col("turn").cast("long").cast("string"), space)).cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), space)
    hurt = rows.select(
        key.alias("key"),
        F.col("turn").cast("long").alias("turn"),
        F.when(number == 4, F.lit("user")).otherwise(F.coalesce(F.col("role").cast("string"), space)).alias("role"),
        F.when(number == 1, F.lit("")).when(number == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        number.alias("number"),
    )
    return hurt.filter("number != 0").drop("number")


def twice(rows: DataFrame) -> DataFrame:
    """How often the damage leaves a row, once or twice, by its key and turn."""
    turn = F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    return F.when(F.crc32(F.concat("key", F.lit(":"), turn).cast("binary")) % 20 == 3, 2).otherwise(1)


def coded(rows: DataFrame) -> DataFrame:
    """Equal rows of a conversation as one: key, turn, role, print, n, initial, own (fault but for duplicates), is_first.

    ``is_first`` says whether the first of them is the first with its role and text in the conversation.
    """
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    ended = F.col("text").rlike(f"[.!?][{SPACE}]*\\z")
    own = F.when(blank, BLANK).when(ended, SOUND).otherwise(TRUNCATED)
    facts = rows.select("key", "turn", "role", F.md5("text").alias("print"), own.alias("own"), twice(rows).alias("n"))
    same = stored(facts.groupBy("key", "turn", "role", "print", "own").agg(F.sum("n").alias("n")), "turns")
    again = same.groupBy("key", "role", "print").agg(F.min(F.struct("turn")).alias("earliest"), F.count("*").alias("turns"))
    known = same.join(again.filter("turns > 1").drop("turns"), ["key", "role", "print"], "left")
    first = F.col("earliest").isNull() | F.col("turn").eqNullSafe(F.col("earliest.turn"))
    return known.select("key", "turn", "role", "print", "own", "n", F.substring("role", 1, 1).alias("initial"), first.alias("is_first"))


_SEGMENT = (
    "key string, part int, no long, codes binary, matrix array<long>, low long, high long, turns long, "
    "blank long, duplicate long, truncated long, illegal long, first int, last int"
)
_FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def legal(left: int, right: int) -> bool:
    return (left // 4, right // 4) in ((0, 1), (1, 2), (2, 1))


def _segments(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, out, no = TaskContext.get().partitionId(), None, [], 0

        def close():
            nonlocal held, no
            if held is not None:
                codes = bytes(held["codes"])
                faults = [c % 4 for c in codes]
                flat = [v for row in matrix(codes) for pair in row for v in pair]
                illegal = sum(not legal(a, b) for a, b in zip(codes, codes[1:]))
                out.append(
                    (held["key"], part, no, codes, flat, held["low"], held["high"], held["turns"])
                    + tuple(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED))
                    + (illegal, codes[0], codes[-1])
                )
                held, no = None, no + 1

        for batch in batches:
            for key, turn, own, n, initial, is_first in zip(*(batch.column(c).to_pylist() for c in ("key", "turn", "own", "n", "initial", "is_first"))):
                while n:
                    if held is None or held["key"] != key or len(held["codes"]) >= size:
                        close()
                        held = {"key": key, "codes": bytearray(), "low": None, "high": None, "turns": 0}
                    if turn is not None and turn != held["high"]:
                        held["turns"] += 1
                        held["low"] = turn if held["low"] is None else held["low"]
                        held["high"] = turn
                    fault = own if own == BLANK or is_first else DUPLICATE
                    # Equal rows behind the first one are duplicates and go on in one piece.
                    many = 1 if is_first and own != BLANK else min(n, size - len(held["codes"]))
                    held["codes"] += bytes([code_of(initial, fault)]) * many
                    n, is_first = n - many, False
            if len(out) >= 1000:
                yield _batch(out, _SEGMENT)
                out = []
        close()
        yield _batch(out, _SEGMENT)

    return run


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[t]) for c, (_, t) in zip(columns, fields)], names=[f for f, _ in fields])


_MET = "key string, part int, no long, codes binary, start int, reached int, " + ", ".join(f"{f} long" for f in _FACTS)


def _meetings(segments: list[dict]) -> list[tuple]:
    """The states in which a conversation's path enters and leaves each of its segments, and its facts, with the first one."""
    overs = [[[tuple(s["matrix"][8 * p + 2 * q : 8 * p + 2 * q + 2]) for q in range(4)] for p in range(4)] for s in segments]
    behind = [list(AT_END)]
    for over in reversed(overs):
        behind.append(before_segment(over, behind[-1]))
    behind.reverse()
    states = [NOTHING]
    for over, costs in zip(overs[:-1], behind[1:]):
        states.append(crossing(joined(start_in(states[-1]), over), costs))
    lows, highs = [s["low"] for s in segments if s["low"] is not None], [s["high"] for s in segments if s["high"] is not None]
    turns = sum(s["turns"] for s in segments) - sum(
        a["high"] is not None and a["high"] == b["low"] for a, b in zip(segments, segments[1:])
    )
    facts = [
        highs[-1] - lows[0] + 1 - turns if lows else 0,
        *(sum(s[f] for s in segments) for f in ("blank", "duplicate", "truncated")),
        sum(s["illegal"] for s in segments) + sum(not legal(a["last"], b["first"]) for a, b in zip(segments, segments[1:])),
        behind[0][NOTHING],
    ]
    ends = states[1:] + [-1]
    return [
        (s["key"], s["part"], s["no"], s["codes"], p, q, *(facts if i == 0 else [None] * len(facts)))
        for i, (s, p, q) in enumerate(zip(segments, states, ends))
    ]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if held and held[0]["key"] != row["key"]:
                out += _meetings(held)
                held = []
            held.append(row)
        yield _batch(out, _MET)
    yield _batch(_meetings(held) if held else [], _MET)


_PIECE = "key string, part int, no long, piece string, " + ", ".join(f"{f} long" for f in _FACTS)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            costs = AT_END if row["reached"] < 0 else [0 if q == row["reached"] else NEVER for q in range(4)]
            piece = audit_between(row["codes"], row["start"], costs)
            out.append((row["key"], row["part"], row["no"], piece, *(row[f] for f in _FACTS)))
        yield _batch(out, _PIECE)


_DONE = "key string, " + ", ".join(f"{f} long" for f in _FACTS) + ", audit string, repaired_sha256 string"


class _Open:
    """A conversation that is being read: its facts, its audit, and the checksum of what has been written."""

    def __init__(self, key: str):
        self.key, self.facts, self.pieces = key, [0] * len(_FACTS), []
        self.sum, self.written = hashlib.sha256(), False
        self.letters: Iterator[str] | None = None
        self.state = NOTHING

    def _write(self, role: str, text: str) -> None:
        self.sum.update((f"\n{role}:{text}" if self.written else f"{role}:{text}").encode())
        self.written = True

    def row(self, role: str, text: str) -> None:
        if self.letters is None:
            self.letters = iter("".join(self.pieces))
        for letter in self.letters:
            initial = turn_of(self.state) if letter in "IR" else role[:1]
            name = "user" if initial == "u" else "assistant"
            if letter != "D":
                self._write(role if letter == "K" else name, "" if letter == "I" else text)
                self.state = following(self.state, initial)
            if letter != "I":
                return

    def close(self) -> tuple:
        audit = "".join(self.pieces) + CLOSING[self.state][1]
        for _ in CLOSING[self.state][1]:
            initial = turn_of(self.state)
            self._write("user" if initial == "u" else "assistant", "")
            self.state = following(self.state, initial)
        return (self.key, *self.facts, audit, self.sum.hexdigest())


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams of a conversation's key, the pieces of its audit and its rows, in this order."""
    held: _Open | None = None
    for batch in batches:
        out = []
        names = ["key", "tag", "piece", "n", "role", "text", *_FACTS]
        for key, tag, piece, n, role, text, *facts in zip(*(batch.column(c).to_pylist() for c in names)):
            if held is None or held.key != key:
                out += [held.close()] if held else []
                held = _Open(key)
            if tag == 1:
                held.pieces.append(piece)
                held.facts = facts if facts[0] is not None else held.facts
            elif tag == 2:
                for _ in range(n):
                    held.row(role, text)
        yield _batch(out, _DONE)
    yield _batch([held.close()] if held else [], _DONE)


def repair_conversations(rows: DataFrame, every: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Each conversation's facts, audit and checksum: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` are as ``damaged`` gives them, ``every`` has the ``key`` of all conversations; those without rows have zeros, an empty audit and
    the checksum of nothing. Rows are read by turn, nulls first; those of one turn by role and by the checksum of the text.
    """
    order = ["key", "turn", "role", "print"]
    lined = coded(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    segments = lined.mapInArrow(_segments(segment_rows), _SEGMENT)
    met = segments.repartition("key").sortWithinPartitions("key", "part", "no").mapInArrow(_meet, _MET)
    pieces = met.repartition("key", "part", "no").mapInArrow(_settle, _PIECE)
    keys = every.groupBy("key").agg(F.lit(0).alias("tag"))
    texts = rows.select("key", F.lit(2).alias("tag"), "turn", "role", F.md5("text").alias("print"), "text", twice(rows).alias("n"))
    stream = keys.unionByName(pieces.withColumn("tag", F.lit(1)), True).unionByName(texts, True)
    whole = stream.repartition("key").sortWithinPartitions("key", "tag", "part", "no", "turn", "role", "print")
    done = whole.mapInArrow(_finish, _DONE)
    return done.select(F.when(F.col("key") != " ", F.col("key").cast("long")).alias("conv_id"), *done.columns[1:])


def repair_damaged(conversations: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Damage a table of conversations, find the faults, and repair it; a row for each conv_id.

    ``conversations`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns are ignored. Null roles and texts are one space, rows of a null conv_id
    are a conversation of their own, null turns come first. Equal rows count each: all but the first are duplicates. A role whose
    initial is none of s, u and a has to be changed or deleted. Empty texts are blank. An empty table gives an empty result.
    """
    every = conversations.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(" ")).alias("key"))
    return repair_conversations(damaged(conversations), every, segment_rows)


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
