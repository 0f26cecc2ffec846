"""Repair of conversations against a plain table of all states, with whole audits in it."""

import hashlib
import random
import re
import zlib

import pytest

from likeness.llm import conversations as C

SPACES = " \t\n\x0b\x0c\r"


def damage(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        n = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if n == 0:
            continue
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        role = "user" if n == 4 else role
        for _ in range(2 if n == 3 else 1):
            yield conv, turn, role, text


def least(rows):
    """(cost, audit) of the best edits, by states 0, s, u, a with their whole audits."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "")}

    def settle(ways):
        """Insertions, until nothing gets better."""
        while True:
            more = dict(ways)
            for state, (cost, audit) in ways.items():
                for initial in "ua":
                    to = after[state].get(initial)
                    if to:
                        more[to] = min(more.get(to, (1 << 60, "")), (cost + 5, audit + "I"))
            if more == ways:
                return ways
            ways = more

    for fault, role in rows:
        ways = {}
        for state, (cost, audit) in settle(best).items():
            options = [(state, 2, "D")]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                options += [(after[state].get(role[:1]), extra, "K")]
                options += [(after[state].get(i), 1 + extra, "R") for i in "ua"]
            for to, more, letter in options:
                if to is not None:
                    ways[to] = min(ways.get(to, (1 << 60, "")), (cost + more, audit + letter))
        best = ways
    ends = settle(best)
    return min(ends[s] for s in ("", "a") if s in ends)


def expected(rows):
    every = {r[0] for r in rows}
    left = list(damage(rows))
    out = {}
    for conv in every:
        own = [r[1:] for r in left if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            body = text.strip(SPACES)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        cost, audit = least([(f, r[1]) for f, r in zip(faults, own)])
        rest, state, text = iter(own), "", []
        for letter in audit:
            row = None if letter == "I" else next(rest)
            if letter == "D":
                continue
            state = row[1][:1] if letter == "K" else "a" if state == "u" else "u"
            text.append(f"{row[1] if letter == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{row[2] if row else ''}")
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(text).encode()).hexdigest(),
        )
    return out


def drawn(seed, n_convs, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(n_convs):
        for turn in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "Yes.", "No!", "how so", " ", None, "", "é. \n", "a.b", f"{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("segment", [3, 1 << 16])
def test_repair_matches_brute_force(spark, segment):
    rows = drawn(1, 60, 24) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (900, 0, None, None)]
    rows += [(901, t, ("user", "assistant")[t % 2], f"{t}. " * 3) for t in range(400)] + [(902, 5, "user", "same.")] * 40
    rows += [(903, 1, "system", "x" * 200_000 + "."), (903, 2, "user", "y." * 100_000)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' AS key", "1 AS n", "2 AS tag").repartition(7)
    got = {r[0]: tuple(r)[1:] for r in C.repair_damaged(table, segment).collect()}
    assert got == expected(rows)


def test_rows_that_damage_drops_leave_an_empty_conversation(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = C.repair_damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    found = C.repair_damaged(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and found.columns[0] == "conv_id" and found.columns[-1] == "repaired_sha256"


def test_long_audits_are_the_least_of_the_cheapest():
    rng = random.Random(5)
    names = {C.SOUND: "", C.BLANK: "blank", C.DUPLICATE: "duplicate", C.TRUNCATED: "truncated"}
    for n in (0, 1, 15, 16, 17, 33, 100, 257):
        for _ in range(20):
            rows = [(rng.choice(C.FAULTS if rng.random() < 0.4 else [C.SOUND]), rng.choice("suax")) for _ in range(n)]
            codes = bytes(C.code_of(role, fault) for fault, role in rows)
            cost, audit = least([(names[f], r) for f, r in rows])
            mine = C.audit_between(codes, C.NOTHING, C.AT_END)
            assert audit.startswith(mine) and set(audit[len(mine) :]) <= {"I"}
            assert C.backward(codes, C.AT_END)[C.NOTHING] == cost


def test_query_on_stored_tables(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in C.op13_conversation_repair(spark, folder).collect()}
    assert got == expected(rows)
