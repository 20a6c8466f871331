"""Conversation repair against a plain search over all edit sequences."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from innkeep.llm import structure
from pyspark.sql import functions as F

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_faults(rows):
    """[(role, text, fault)] in order of turns."""
    seen, out = set(), []
    for _, role, text in sorted(((t is not None, t or 0), r, x) for t, r, x in rows):
        body = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain_repair(rows):
    """(cost, audit, turns): dynamic programming over all role strings read so far, not over automaton states."""
    def ok(s):                                    # a prefix of some string of the grammar
        return re.match(r"s?(ua)*u?\Z", s) is not None
    state = {"": (0, "", ())}
    two = {}

    def put(to, key, value):
        if ok(key) and (key not in to or value[:2] < to[key][:2]):
            to[key] = value

    def inserted(now):
        out = dict(now)
        for _ in range(3):
            for key, (cost, audit, turns) in list(out.items()):
                for x, name in (("u", "user"), ("a", "assistant")):
                    put(out, key + x, (cost + 5, audit + "I", turns + (name + ":",)))
        return out
    for role, text, fault in rows:
        new = {}
        for key, (cost, audit, turns) in inserted(state).items():
            put(new, key, (cost + 2, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            put(new, key + role[:1], (cost + more, audit + "K", turns + (f"{role}:{text}",)) if role[:1] else (10 ** 9, "", ()))
            for x, name in (("u", "user"), ("a", "assistant")):
                put(new, key + x, (cost + 1 + more, audit + "R", turns + (f"{name}:{text}",)))
        state = new
    return min(v for k, v in inserted(state).items() if GRAMMAR.match(k))


def plain_row(rows):
    found = plain_faults(rows)
    cost, audit, turns = plain_repair(found)
    roles = [r[:1] for r, _, _ in found]
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    count = [sum(f == x for *_, f in found) for x in ("blank", "duplicate", "truncated")]
    return (gaps, *count, sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit,
            hashlib.sha256("\n".join(turns).encode()).hexdigest())


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def plain_report(original, rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {c: plain_row(by[c]) if c in by else empty for c in {r[0] for r in original}}


def random_rows(seed, conversations, most):
    rnd = random.Random(seed)
    rows = []
    for conv in [*range(conversations - 1), None]:
        for turn in range(rnd.randint(1, most)):
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 2, None]),
                         rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ürgen"]),
                         rnd.choice(["Yes.", "Why?", "no end", " ", "", None, "a b.\n", "é!", f"{rnd.random()}.", f"{turn}."])))
    return rows


def got(spark, rows, harmed=None, segment=structure.SEGMENT, parts=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).selectExpr("*", "1 AS c", "2 AS seg", "'x' AS row", "3 AS fault")
    found = structure.report(df, structure.damage(df) if harmed is None else harmed, segment)
    return {r[0]: tuple(r)[1:] for r in found.collect()}


@pytest.mark.parametrize("segment", [256, 3, 1])
def test_against_plain_search(spark, segment):
    rows = random_rows(5, 60, 9)
    assert got(spark, rows, segment=segment) == plain_report(rows, plain_damage(rows))


def test_undamaged_rows(spark):
    rows = random_rows(6, 40, 7)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(spark, rows, df, segment=2) == plain_report(rows, rows)


def test_one_conversation_over_many_segments_and_tasks(spark):
    """A conversation that holds nearly all rows: the same result as in one segment."""
    rows = [(1, t, *x[2:]) for t, x in enumerate(random_rows(7, 60, 9))] + [(2, 0, "user", "Yes."), (2, 1, "assistant", "No.")]
    assert len(rows) > 250
    whole = plain_report(rows, plain_damage(rows))
    for segment in (5, 64, 100_000):
        assert got(spark, rows, segment=segment) == whole


def test_every_short_role_sequence(spark):
    """All sequences of three kinds and three faults up to three rows."""
    rows, n = [], 0
    for length in (1, 2, 3):
        for roles in product(["system", "user", "assistant"], repeat=length):
            for ends in product(["x.", "x", " "], repeat=length):
                rows += [(n, i, r, f"{i}{e}" if e != " " else " ") for i, (r, e) in enumerate(zip(roles, ends))]
                n += 1
    assert got(spark, rows, spark.createDataFrame(rows, SCHEMA)) == plain_report(rows, rows)


def test_agenda_and_plain_search_agree():
    rnd = random.Random(8)
    for _ in range(300):
        found = [(rnd.choice(["s", "u", "a", "x", ""]), str(i), rnd.choice(["", "", "truncated", "blank"])) for i in range(rnd.randint(1, 8))]
        (mine,) = structure.derive([r for r, _, _ in found], [None if f == "blank" else 5 if f else 0 for *_, f in found]).values()
        assert mine[:2] == plain_repair(found)[:2]
        assert "".join(re.sub("[ua]", "", c) for c in mine[2]) == mine[1]


def test_nothing_left_and_empty_table(spark):
    rows = [(c, t, "user", "Yes.") for c in range(40) for t in range(1)]
    gone = [r for r in rows if zlib.crc32(f"{r[0]}:0".encode()) % 20 == 0]
    assert gone
    assert got(spark, gone) == {r[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in gone}
    assert structure.report(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SCHEMA)).collect() == []


def test_turns_are_the_repaired_conversation(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "user", "cut off"), (1, 3, "user", "Bye."), (1, 4, "user", "")]
    turns, _ = structure.repair(spark.createDataFrame(rows, SCHEMA))
    out = [(r.role, r.text, r.edit) for r in turns.orderBy("row", "step").collect()]
    assert out == [("system", "Be kind.", "K"), ("user", "Hi.", "R"), ("user", "cut off", "D"), ("assistant", "Bye.", "R"), ("user", "", "D")]


def test_long_text(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "." * 1_000_000 + " " * 1000)]
    assert got(spark, rows, spark.createDataFrame(rows, SCHEMA)) == plain_report(rows, rows)
