"""Conversation structure repair by lightest derivations.

The roles of a conversation should read ``(s?(ua)+)?`` by their first letters: an
optional system turn, then user and assistant in turn.  Rows are kept (0), given the role
user or assistant (1), deleted (2) or preceded by an inserted empty turn (5); blank
and repeated rows must be deleted, truncated ones that stay add 5.  The cheapest repair is
wanted, ties by the least text of its edits' letters (its audit).

**Deductions.** Items are ``Prefix(i, q)``: the first i rows are repaired and what they give has
brought the role automaton to state q; ``Live(i)`` (weight (0 or 5, "")) if row i may stay; and
the goal.  Keep and Rerole deduce ``Prefix(i+1, q')`` from ``Prefix(i, q)`` and
``Live(i)``, Delete and Insert from ``Prefix(i, q)`` alone, the goal follows from an
accepting prefix of all rows.  Each deduction adds the antecedents' costs and its own and
appends its letter to the prefix's audit, a function that is superior (no result is less
than an antecedent) and monotone, since audits of one item are never
prefixes of each other at equal cost.  Knuth's agenda pops items by (cost, audit); the first time
an item is popped its value is final.  States: 0 nothing, 1 system, 2 user, 3 assistant.

**Scale.** Rows are range-partitioned by (conversation, turn, role, start of the text) and
read in order, a segment of ``SEGMENT`` rows of one conversation at a time; texts of earlier rows are
compared by an aggregate of digests.  A conversation that lies in one segment is
settled there.  Of any other one, each segment derives ``Span(q, q')`` for every pair of states, and
``Prefix(segment, q)`` with ``Span(q, q')`` deduces the prefix one segment further, so a
conversation of any length is many tasks; what joins its spans holds only the undecided ends
of at most four audits besides the result.

Defined results: null roles and texts count as one space, a null conversation id is an id of its own; rows
go by turn (nulls first), equal turns by role and text; repeated rows are duplicates; a role's first character
alone decides its kind; a conversation without rows has cost 0 and no turns; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innkeep.llm.common import cut_lineage

SEGMENT = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# fixed values: the automaton of s?(ua)+ and the letters of the faults
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
ACCEPTING = (0, 3)
STATES = 4
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
# no state saves more than this over another on the rows to come: insert two turns and delete one row
WORTH = 2 * INSERT + DELETE
BLANKS = r"\x20\x09-\x0D"
LONG_MAX = (1 << 63) - 1


# --- one segment -----------------------------------------------------------

def derive(initials: list[str], live: list[int | None], entry: int = 0, to_goal: bool = True) -> dict:
    """Lightest derivations over some rows from state ``entry``.

    ``live[i]``: what row i costs if it stays (None: it must be deleted).  Returns exit state ->
    (cost, audit, codes per row): with ``to_goal`` only the lightest accepting one, else one for each
    state that can be reached.  A code is an edit's letter, with the role's after R and I.
    """
    n = len(initials)
    agenda = [(0, "", 0, entry, None, "")]
    final: dict[tuple[int, int], tuple] = {}
    out = {}
    while agenda:
        cost, audit, i, q, back, code = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final[i, q] = (back, code)
        if i == n and (q in ACCEPTING or not to_goal):
            out[q] = (cost, audit, _codes(final, n, q))
            if to_goal or len(out) == STATES:
                break
        nxt = NEXT[q]
        heapq.heappush(agenda, (cost + INSERT, audit + "I", i, STEPS[q, nxt], (i, q), "I" + nxt))
        if i == n:
            continue
        heapq.heappush(agenda, (cost + DELETE, audit + "D", i + 1, q, (i, q), "D"))
        if live[i] is not None:
            stays = cost + live[i]
            kept = STEPS.get((q, initials[i]))
            if kept is not None:
                heapq.heappush(agenda, (stays + KEEP, audit + "K", i + 1, kept, (i, q), "K"))
            heapq.heappush(agenda, (stays + REROLE, audit + "R", i + 1, STEPS[q, nxt], (i, q), "R" + nxt))
    return out


def _codes(final: dict, n: int, q: int) -> list[str]:
    """The codes of each row, those of turns inserted before it included; turns
    inserted at the end belong to the last row."""
    codes, at = [""] * n, (n, q)
    while at is not None:
        back, code = final[at]
        if back is not None:
            row = min(back[0], n - 1)
            codes[row] = code + codes[row]
        at = back
    return codes


# --- rows and their faults ----------------------------------------------------

def damage(table: DataFrame) -> DataFrame:
    """Rows harmed by ``crc32(conv_id:turn) % 20`` (0 dropped, 1 emptied, 2 without ``.!?``, 3 twice,
    4 as user): test input whose repair is known to be needed."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    d = F.col("_d")
    return (table.select("conv_id", "turn", F.coalesce("role", space).alias("role"),
                         F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("_d"))
            .where(d != 0)
            .withColumn("role", F.when(d == 4, F.lit("user")).otherwise(F.col("role")))
            .withColumn("text", F.when(d == 1, F.lit("")).when(d == 2, F.regexp_replace("text", "[.!?]", ""))
                        .otherwise(F.col("text")))
            .withColumn("_copy", F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .drop("_d", "_copy"))


def _conversation(column: str = "conv_id") -> list[Column]:
    """A conversation's key without nulls."""
    return [F.coalesce(F.col(column).cast("long"), F.lit(0)).alias("c"), F.col(column).isNull().alias("c_null")]


def faults(rows: DataFrame) -> DataFrame:
    """(c, c_null, turn, role, text, digest, blank, seen, truncated) of conversation rows; ``seen``: role and text
    occur in an earlier turn (within a turn, equal rows follow each other)."""
    space = F.lit(" ")
    given = rows.select(*_conversation(), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), space).alias("role"),
                        F.coalesce(F.col("text").cast("string"), space).alias("text"))
    given = given.withColumn("digest", F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary")))
    key = ["c", "c_null", "digest"]
    first = given.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.col("turn").isNull()).alias("_no_turn"),
                                    F.min("turn").alias("_turn")).where("n > 1").drop("n")
    return given.join(first, key, "left").select(
        "c", "c_null", "turn", "role", "text", "digest",
        (~F.col("text").rlike(f"[^{BLANKS}]")).alias("blank"),
        F.coalesce(F.col("turn").isNotNull() & (F.col("_no_turn") | (F.col("turn") > F.col("_turn"))), F.lit(False)).alias("seen"),
        (~F.col("text").rlike(rf"[.!?][{BLANKS}]*\z")).alias("truncated"))


_DERIVED = ("row long, c long, c_null boolean, turn long, no_turn boolean, role string, text string, fault string, illegal long, seg long, "
            "open boolean, codes array<string>, costs array<long>, audits array<string>, first string, last string")


def segments(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Each row with its fault and codes; a segment's last row has the segment's summary.

    ``codes``, ``costs``, ``audits`` have one entry where the segment is a whole conversation, else
    (``open``) one for each entry state times 4 plus exit state; -1 is the cost of what cannot be reached.
    """
    place = ["c", "c_null", "turn", "role"]
    dealt = (faults(rows).withColumn("_head", F.substring("text", 1, 64)).repartitionByRange(*place, "_head")
             .sortWithinPartitions(*place, "text").drop("_head").withColumn("row", F.monotonically_increasing_id())
             .withColumn("no_turn", F.col("turn").isNull()).withColumn("turn", F.coalesce("turn", F.lit(0))))

    names = [x.split()[0] for x in _DERIVED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []              # rows of the segment being read
        begins = False                      # whether it is the first of its conversation, for certain
        before = None                       # the row before: conversation, turn, digest, first letter

        def done(ends: bool) -> list[tuple]:
            nonlocal held
            initials = [r[5][:1] for r in held]
            live = [None if r[7] in ("blank", "duplicate") else TRUNCATED if r[7] else 0 for r in held]
            is_open = not (begins and ends)
            if is_open:
                found = [derive(initials, live, q, False).get(z) for q in range(STATES) for z in range(STATES)]
            else:
                found = list(derive(initials, live).values())
            last = len(held) - 1
            costs, audits = [f[0] if f else -1 for f in found], [f[1] if f else "" for f in found]
            out = [(*r, held[0][0], is_open, [f[2][k] if f else "" for f in found], costs if k == last else None,
                    audits if k == last else None, initials[0], initials[-1]) for k, r in enumerate(held)]
            held = []
            return out

        for b in batches:
            ready = []
            for row, c, c_null, turn, no_turn, role, text, digest, blank, seen, truncated in zip(
                    *(b[x].tolist() for x in ("row", "c", "c_null", "turn", "no_turn", "role", "text", "digest", "blank",
                                              "seen", "truncated"))):
                same = before is not None and before[0] == (c, c_null)
                if held and (not same or len(held) == segment):
                    ready += done(not same)
                    begins = False
                if not same:
                    begins = before is not None          # a partition may begin inside a conversation
                repeated = same and before[1:3] == ((turn, no_turn), digest)
                fault = "blank" if blank else "duplicate" if seen or repeated else "truncated" if truncated else ""
                initial = role[:1]
                held.append((row, c, c_null, turn, no_turn, role, text, fault, int(bool(held) and before[3] + initial not in LEGAL)))
                before = ((c, c_null), (turn, no_turn), digest, initial)
            if ready:
                yield pd.DataFrame(ready, columns=names)
        if held:
            yield pd.DataFrame(done(False), columns=names)   # the next partition may go on with the conversation
    found = dealt.mapInPandas(run, _DERIVED)
    return cut_lineage(found.withColumn("turn", F.when(~F.col("no_turn"), F.col("turn"))).drop("no_turn"))


# --- whole conversations -------------------------------------------------------

class Chain:
    """Prefix items of a conversation, one segment after the other."""

    def __init__(self):
        self.settled: list[str] = []
        # state -> (cost, audit after the settled part, chain of (segment, choice))
        self.prefix: dict[int, tuple[int, str, tuple | None]] = {0: (0, "", None)}
        self.last: str | None = None
        self.illegal = 0

    def add(self, seg: int, costs, audits, first: str, last: str) -> None:
        if self.last is not None and self.last + first not in LEGAL:
            self.illegal += 1
        self.last = last
        agenda = sorted((cost + costs[STATES * q + z], audit + audits[STATES * q + z], z, q)
                        for q, (cost, audit, _) in self.prefix.items() for z in range(STATES) if costs[STATES * q + z] >= 0)
        best: dict[int, tuple] = {}
        for cost, audit, z, q in agenda:                 # popped by (cost, audit): the first of an item is final
            if z not in best and cost <= agenda[0][0] + WORTH:
                best[z] = (cost, audit, (self.prefix[q][2], seg, STATES * q + z))
        common = len(os.path.commonprefix([a for _, a, _ in best.values()]))
        self.settled.append(next(iter(best.values()))[1][:common])
        self.prefix = {z: (cost, audit[common:], chain) for z, (cost, audit, chain) in best.items()}

    def goal(self) -> tuple[int, str, list[tuple[int, int]]]:
        """(cost, audit, [(segment, choice)]) of the lightest accepting prefix."""
        cost, audit, chain = min((self.prefix[q] for q in ACCEPTING if q in self.prefix), key=lambda f: f[:2])
        choices = []
        while chain is not None:
            chain, seg, choice = chain
            choices.append((seg, choice))
        return cost, "".join([*self.settled, audit]), choices[::-1]


_CHAINED = "c long, c_null boolean, is_seg boolean, seg long, choice int, cost long, audit string, illegal long"


def _chained(derived: DataFrame) -> DataFrame:
    """Of conversations of several segments: a row with ``seg`` null, cost, audit and the illegal
    borders, and one per segment with the choice made for it."""
    ends = (derived.where("open and costs is not null").select("c", "c_null", "seg", "costs", "audits", "first", "last")
            .repartition("c", "c_null").sortWithinPartitions("c", "c_null", "seg"))

    names = [x.split()[0] for x in _CHAINED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, chain = None, None

        def done() -> list[tuple]:
            cost, audit, choices = chain.goal()
            return [(*key, False, 0, 0, cost, audit, chain.illegal),
                    *[(*key, True, seg, choice, 0, "", 0) for seg, choice in choices]]
        for b in batches:
            ready = []
            for c, c_null, seg, costs, audits, first, last in zip(
                    *(b[x].tolist() for x in ("c", "c_null", "seg", "costs", "audits", "first", "last"))):
                if key != (c, c_null):
                    if chain is not None:
                        ready += done()
                    key, chain = (c, c_null), Chain()
                chain.add(seg, list(costs), list(audits), first, last)
            if ready:
                yield pd.DataFrame(ready, columns=names)
        if chain is not None:
            yield pd.DataFrame(done(), columns=names)
    return cut_lineage(ends.mapInPandas(run, _CHAINED))


def repair(rows: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(turns, summary) of conversation rows ``conv_id, turn, role, text``.

    ``turns``: the repaired conversations, in order of (c, c_null, row, step), with the ``edit`` that made each turn
    and a deleted row's ``edit`` D; ``summary``: per conversation the faults, illegal borders,
    gaps, cost and audit.
    """
    derived = segments(rows, segment)
    chained = _chained(derived)
    chosen = derived.where("open").join(chained.where("is_seg").select("seg", "choice"), "seg").select(
        "c", "c_null", "row", "role", "text", F.element_at("codes", F.col("choice") + 1).alias("code"))
    codes = derived.where("not open").select("c", "c_null", "row", "role", "text", F.element_at("codes", 1).alias("code")).unionByName(chosen)
    edits = F.regexp_extract_all("code", F.lit("[KD]|[RI][ua]"), 0)
    turns = codes.select("c", "c_null", "row", "role", "text", F.posexplode(edits).alias("step", "edit"))
    roles = F.when(F.col("edit").endswith("u"), F.lit(ROLES["u"])).when(F.col("edit").endswith("a"), F.lit(ROLES["a"]))
    turns = (turns.withColumn("role", F.coalesce(roles, "role"))
             .withColumn("text", F.when(F.col("edit").startswith("I"), F.lit("")).otherwise(F.col("text")))
             .withColumn("edit", F.substring("edit", 1, 1)))
    wide = "decimal(38,0)"
    gaps = F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.count_distinct("turn")
    one = F.col("costs").isNotNull() & ~F.col("open")
    summary = derived.groupBy("c", "c_null").agg(
        F.least(F.coalesce(gaps, F.lit(0).cast(wide)), F.lit(LONG_MAX).cast(wide)).cast("long").alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.sum("illegal").alias("_illegal"),
        F.max(F.when(one, F.element_at("costs", 1))).alias("_cost"), F.max(F.when(one, F.element_at("audits", 1))).alias("_audit"))
    whole = chained.where("not is_seg").select("c", "c_null", "cost", "audit", "illegal")
    summary = summary.join(whole, ["c", "c_null"], "left").select(
        "c", "c_null", "gaps", "blank", "duplicate", "truncated",
        (F.col("_illegal") + F.coalesce("illegal", F.lit(0))).alias("illegal"),
        F.coalesce("cost", "_cost").alias("cost"), F.coalesce("audit", "_audit").alias("audit"))
    return turns, summary


def fingerprints(turns: DataFrame) -> DataFrame:
    """(c, c_null, repaired_sha256): digest of each conversation's ``role:text`` lines, read in order
    by one task per conversation that holds only the running digest."""
    ordered = (turns.where("edit <> 'D'").select("c", "c_null", "row", "step", F.concat("role", F.lit(":"), "text").alias("line"))
               .repartition("c", "c_null").sortWithinPartitions("c", "c_null", "row", "step"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, None
        for b in batches:
            ready = []
            for c, c_null, line in zip(b["c"].tolist(), b["c_null"].tolist(), b["line"].tolist()):
                if key == (c, c_null):
                    digest.update(b"\n" + line.encode())
                    continue
                if key is not None:
                    ready.append((*key, digest.hexdigest()))
                key, digest = (c, c_null), hashlib.sha256(line.encode())
            if ready:
                yield pd.DataFrame(ready, columns=["c", "c_null", "repaired_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, digest.hexdigest())], columns=["c", "c_null", "repaired_sha256"])
    return ordered.mapInPandas(run, "c long, c_null boolean, repaired_sha256 string")


def report(conversations: DataFrame, rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """For every id of ``conversations``: faults, cost, audit and digest of the repair of ``rows``."""
    turns, summary = repair(rows, segment)
    ids = conversations.select(*_conversation()).distinct()
    zero = F.lit(0).cast("long")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (ids.join(summary, ["c", "c_null"], "left").join(fingerprints(turns), ["c", "c_null"], "left")
            .select(F.when(~F.col("c_null"), F.col("c")).alias("conv_id"), *[F.coalesce(n, zero).alias(n) for n in numbers],
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))
