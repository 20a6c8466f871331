"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared lower-cased, with every run of white space as one blank.  An
item of ``m`` characters may occur in a document with at most ``k =
floor(rate * m)`` edits.  It is split into ``k + 1`` pieces; an occurrence
leaves one piece untouched, so every occurrence contains an exact piece hit at
its place.  One automaton finds the hits of all pieces in a pass over the whole
text; the stretches around the hits (``k`` characters more on either side) are
verified with Myers' bit-parallel distance, which also gives the best place.

The benchmark is the stated query set: it is taken in blocks of bounded size,
each sent to the tasks as a broadcast, and every block is matched against all
documents in place, without a shuffle.

**Results.** Per document and item: the best occurrence (least distance, then leftmost)
and ``occurrences``, places that do not overlap, such that every occurrence within the
budget overlaps one of them.  All positions count characters of the normalised text,
ends exclusive.

Defined results: null or empty texts hold nothing; an empty item (after
normalisation) matches nothing; an item shorter than ``min_chars`` leaves too little of
a piece to tell it from chance: it counts without edits only, where it is the whole
document or, with ``short_words``, anywhere between word borders (``keep_clean`` leaves
that off: a text that says "yes" is not contaminated by an answer "yes"); equal items
are reported under each id; repeated documents are each reported; empty tables
give an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innkeep.llm.common import texts

RATE = 0.08
MIN_CHARS = 24
BLOCK_CHARS = 1_000_000
PLACE = "distance:int,start:bigint,end:bigint"
MATCHES = f"array<struct<item_id:bigint,{PLACE},occurrences:array<struct<{PLACE}>>>>"
MATCHERS = 4                                      # matchers that one Python worker keeps
_built: dict = {}


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _ends(pattern: str, text: str, a: int, b: int, most: int) -> Iterator[tuple[int, int]]:
    """(end, distance) wherever an occurrence of ``pattern`` with at most ``most`` edits ends in
    ``text[a:b]``, from left to right."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for j in range(a, b):
        eq = peq.get(text[j], 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        pv = (mh << 1 & full) | (full & ~(xv | ph))
        mv = ph & xv
        if score <= most:
            yield j + 1, score


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best approximate occurrence of ``pattern`` in
    ``text`` with at most ``most`` edits (leftmost end of the least distance)."""
    best = None
    for end, score in _ends(pattern, text, 0, len(text), most):
        if best is None or score < best[0]:
            best = (score, end)
    return best


def _start(pattern: str, text: str, low: int, end: int, distance: int) -> int:
    """Where the shortest occurrence with this distance begins that ends at ``end``."""
    low = max(low, end - len(pattern) - distance)
    return end - myers(pattern[::-1], text[low:end][::-1], distance)[1]


def occurrences(pattern: str, text: str, most: int, a: int, b: int) -> list[tuple[int, int, int]]:
    """(distance, start, end), not overlapping, from left to right: every occurrence in
    ``text[a:b]`` with at most ``most`` edits overlaps one of them.

    Of the ends that can overlap the first one found, the least distance is taken; what
    lies wholly before it is searched on its own, and the search goes on behind it.
    """
    out, reach = [], len(pattern) + most
    while a < b:
        first = best = None
        for end, score in _ends(pattern, text, a, b, most):
            first = first or end
            if end > first + reach:
                break
            if best is None or score < best[0]:
                best = (score, end)
        if best is None:
            break
        distance, end = best
        start = _start(pattern, text, a, end, distance)
        if first <= start:
            out += occurrences(pattern, text, most, max(a, first - reach), start)
        out.append((distance, start, end))
        a = end
    return out


class Matcher:
    """Finds the items of one block in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, min_chars: int = MIN_CHARS,
                 short_words: bool = False):
        import ahocorasick
        by_text: dict[str, list[int]] = {}
        for item, text in items:
            by_text.setdefault(normalise(text), []).append(item)
        by_text.pop("", None)
        self.short_words = short_words
        self.short = {t: ids for t, ids in by_text.items() if len(t) < min_chars}
        self.items = [(t, ids, int(rate * len(t))) for t, ids in by_text.items() if len(t) >= min_chars]
        if short_words:
            self.items += [(t, ids, 0) for t, ids in self.short.items()]
        places: dict[str, list[tuple[int, int]]] = {}
        for no, (t, _, k) in enumerate(self.items):
            cuts = [len(t) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                places.setdefault(t[a:b], []).append((no, b))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        if places:
            self.automaton.make_automaton()

    def matches(self, raw: str | None) -> list[tuple[int, int, int, int, list]]:
        """(item, distance, start, end, occurrences): the best occurrence of each item found, and all."""
        text = normalise(raw)
        out = []
        if not self.short_words:
            out = [(i, 0, 0, len(text), [(0, 0, len(text))]) for i in self.short.get(text, ())]
        hits: dict[int, list[int]] = {}
        if self.items and text:
            for end, where in self.automaton.iter(text):
                for no, piece_end in where:
                    hits.setdefault(no, []).append(end + 1 - piece_end)
        for no, starts in hits.items():
            pattern, ids, k = self.items[no]
            if pattern in self.short:
                every = _between_borders(pattern, text, sorted(starts))
                best = every[0] if every else None
            else:
                best, every = self._verified(pattern, text, sorted(starts), k)
            if best:
                out += [(i, *best, every) for i in ids]
        return sorted(out)

    @staticmethod
    def _verified(pattern: str, text: str, starts: list[int], k: int):
        best, every = None, []
        for a, b in _stretches(starts, len(pattern), k):
            a, b = max(0, a), min(b, len(text))
            found = myers(pattern, text[a:b], k)
            if not found:
                continue
            if best is None or found[0] < best[0]:
                best = (found[0], a + found[1])
            every += occurrences(pattern, text, k, a, b)
        if best:
            distance, end = best
            best = (distance, _start(pattern, text, 0, end, distance), end)
        return best, every


def _between_borders(item: str, text: str, starts: list[int]) -> list[tuple[int, int, int]]:
    """Exact occurrences that neither begin nor end inside a word, none overlapping another."""
    out, at = [], 0
    for s in starts:
        e = s + len(item)
        inside = (s > 0 and item[0].isalnum() and text[s - 1].isalnum()
                  or e < len(text) and item[-1].isalnum() and text[e].isalnum())
        if s >= at and not inside:
            out.append((0, s, e))
            at = e
    return out


def _stretches(starts: list[int], length: int, k: int) -> Iterator[tuple[int, int]]:
    """Merged stretches of text that can hold the occurrences at these starts."""
    a = b = None
    for s in starts:
        if b is not None and s - k <= b:
            b = max(b, s + length + k)
            continue
        if b is not None:
            yield a, b
        a, b = s - k, s + length + k
    if b is not None:
        yield a, b


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
           block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of about ``block_chars`` characters."""
    rows = (benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
            .where("t is not null").distinct())
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r.t) > block_chars:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t)
    if block:
        yield block


def matches(text: Column, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS,
            block_chars: int = BLOCK_CHARS, short_words: bool = False) -> Column:
    """Column of the matches (``MATCHES``) of each text, over all blocks."""
    sc, names = benchmark.sparkSession.sparkContext, ("distance", "start", "end")

    def one(items: list[tuple[int, str]]) -> Column:
        shared, key = sc.broadcast(items), uuid.uuid4().hex

        @F.pandas_udf(MATCHES)
        def run(column: pd.Series) -> pd.Series:
            matcher = _built.get(key)
            if matcher is None:
                if len(_built) >= MATCHERS:
                    _built.popitem()       # blocks come round in turn: the older matchers stay useful
                matcher = _built[key] = Matcher(shared.value, rate, min_chars, short_words)
            return column.map(lambda t: [
                dict(zip(("item_id", *names), m[:4]), occurrences=[dict(zip(names, o)) for o in m[4]])
                for m in matcher.matches(t)])
        return run(text)

    found = [one(items) for items in blocks(benchmark, block_chars=block_chars)]
    return F.concat(*found) if found else F.array().cast(MATCHES)


def find(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, distance, start_pos, end_pos, occurrences): one row per document and item
    found, with its best occurrence and all of them."""
    t = texts(docs)
    hit = F.explode(matches(F.col("text"), benchmark, **options)).alias("m")
    return t.select("doc_id", hit).select(
        "doc_id", "m.item_id", "m.distance", F.col("m.start").alias("start_pos"), F.col("m.end").alias("end_pos"),
        "m.occurrences")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows whose text holds no item, with all their columns."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.where(F.size(matches(text, benchmark, **options)) == 0)
