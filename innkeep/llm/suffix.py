"""Exact substring deduplication with suffix arrays (grouping construction).

Every byte covered by a ``WIDTH``-byte string that also starts anywhere else
(another document, or elsewhere in the same one) is found; strings are judged
on the input.

**Anchors.** Of the ``GRAM``-byte grams in every WIDTH-byte window the one with
the smallest hash (leftmost of equals) is the window's anchor.  Equal windows
have equal anchors at equal offsets, so equal windows meet under their anchor's
hash, and an anchor that occurs once clears all its windows.  The windows of
one anchor occurrence are consecutive; the bytes they span are its *segment*.

**Suffix arrays.** The different segments of one anchor are aligned at it.
They can only stop agreeing at a few offsets (where neighbours differ when they
are sorted to the right, and to the left, of the anchor; a segment that shares
too little with both its neighbours shares no window).  So each segment is written as a short string of pieces between those offsets, equal pieces having
equal symbols; a segment that occurs several times is written twice.  The suffix array
of these strings is built by ``suffix_array``: suffixes are grouped by Lyndon
prefix, groups are processed in descending order through pointers to the
previous smaller suffix, splitting lower groups by the number of pointers they
get, and each group's order is then emitted without recursion or renaming.  The
longest common prefix with a neighbour in that array, in bytes, says which
windows occur again.

**Scale.** Anchors are about 1 in 90 bytes; hashes are counted with partial
aggregation, and only occurrences of repeated anchors move on.  One text per
different segment is shipped.  An anchor with more than ``limit`` different
segments (a passage in very many contexts) is not gathered: its windows are
counted by digest instead, which partial aggregation bounds.  Covered
intervals return to their documents by a join.

Defined results: null text counts as empty; texts shorter than WIDTH keep all
bytes; repeated rows are documents of their own (so each covers the other); an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.llm.common import cut_lineage, texts

WIDTH = 200
GRAM = 24
LIMIT = 20_000
SLICE = 1 << 22                     # bytes of a text worked on at once
_U = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def suffix_array(symbols: list[int]) -> list[int]:
    """Suffix array of a string of positive integers, by Lyndon-prefix groups.

    ``order`` holds the suffixes by group; a group is a slice of it, named by its
    first place.  Groups are taken from the highest down.
    """
    text = [*symbols, 0]
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, {}
    first = 0
    for k, i in enumerate(order):
        if text[i] != text[order[first]]:
            first = k
        place[i], group[i] = k, first
        size[first] = size.get(first, 0) + 1
    smaller = [-1] * n
    end = n
    while end > 0:
        top = group[order[end - 1]]
        pointed: dict[int, int] = {}
        for i in sorted(order[top:end]):            # previous suffix of a lower group
            j = i - 1
            while j >= 0 and group[j] >= top:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        by_count: dict[int, dict[int, list[int]]] = {}
        for j, c in pointed.items():
            by_count.setdefault(c, {}).setdefault(group[j], []).append(j)
        for c in sorted(by_count, reverse=True):    # the most pointed to become the highest part
            for g, moved in by_count[c].items():
                rest = size[g] - len(moved)
                if not rest:
                    continue
                new = g + rest
                size[g], size[new] = rest, len(moved)
                own = set(moved)
                leaving = [j for j in moved if place[j] < new]
                free = [k for k in range(new, new + len(moved)) if order[k] not in own] if leaving else []
                for j, k in zip(leaving, free):
                    other, at = order[k], place[j]
                    order[k], order[at], place[j], place[other] = j, other, k, at
                for j in moved:
                    group[j] = new
        end = top
    out, placed, filled = [-1] * n, [False] * n, dict.fromkeys(size, 0)
    out[0], placed[n - 1] = n - 1, True
    for r in range(n):                              # each suffix places those that wait for it
        j = out[r] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[g + filled[g]] = j
            filled[g] += 1
            placed[j] = True
            j = smaller[j]
    return out[1:]


def common_prefixes(symbols: list[int], order: list[int]) -> list[int]:
    """Symbols shared by each suffix in ``order`` with the one before it."""
    n = len(symbols)
    rank, out, h = [0] * n, [0] * n, 0
    for r, i in enumerate(order):
        rank[i] = r
    for i in range(n):
        if not rank[i]:
            h = 0
            continue
        j = order[rank[i] - 1]
        while i + h < n and j + h < n and symbols[i + h] == symbols[j + h]:
            h += 1
        out[rank[i]] = h
        h = max(0, h - 1)
    return out


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def repeated_parts(segments: list[tuple[int, bytes, bool]], width: int = WIDTH) -> list[list[tuple[int, int]]]:
    """Per segment (offset of the anchor in it, bytes, occurs several times): the
    covered byte ranges, relative to the anchor."""
    n = len(segments)
    right = [s[left:] for left, s, _ in segments]
    back = [s[:left][::-1] for left, s, _ in segments]
    best: list[list[int]] = []                      # most that a segment shares, to either side
    steps: list[set[int]] = []
    for parts in (right, back):
        line = sorted(range(n), key=parts.__getitem__)
        shared = [_shared(parts[i], parts[j]) for i, j in zip(line, line[1:])]
        own = [0] * n
        for i, j, k in zip(line, line[1:], shared):
            own[i], own[j] = max(own[i], k), max(own[j], k)
        best.append(own)
        steps.append(set(shared))
    # a string shared with another segment reaches at most so far to the two sides
    used = [i for i in range(n) if segments[i][2] or best[0][i] + best[1][i] >= width]
    if not used:
        return [[] for _ in segments]
    far = [max(len(side[i]) for i in used) for side in (right, back)]
    cuts = sorted({0} | {k for k in steps[0] if k + far[1] >= width} | {-k for k in steps[1] if k + far[0] >= width})
    symbol: dict[tuple[int, bytes], int] = {}
    text: list[int] = []
    where: list[tuple[int, int]] = []               # (segment, cut) of each symbol, (-1, _) after a string
    bytes_from: list[int] = []
    for no in used:
        left, s, several = segments[no]
        own = [-left, *(c for c in cuts if -left < c < len(s) - left), len(s) - left]
        pieces = [symbol.setdefault((a, s[a + left:b + left]), len(symbol) + 1) for a, b in zip(own, own[1:])]
        for _ in range(2 if several else 1):
            text += pieces
            where += [(no, a) for a in own[:-1]]
            bytes_from += [b - a for a, b in zip(own, own[1:])]
            text.append(0)
            where.append((-1, 0))
            bytes_from.append(0)
    stops = len(symbol)
    for k, x in enumerate(text):                    # a symbol of its own after every string
        if not x:
            stops += 1
            text[k] = stops
    order = suffix_array(text)
    shared = common_prefixes(text, order)
    upto = [0]
    for b in bytes_from:
        upto.append(upto[-1] + b)
    longest = [0] * len(text)
    for r, i in enumerate(order):
        for k in (shared[r], shared[r + 1] if r + 1 < len(order) else 0):
            longest[i] = max(longest[i], upto[i + k] - upto[i])
    found: list[list[tuple[int, int]]] = [[] for _ in segments]
    for k, (no, at) in enumerate(where):
        if no >= 0 and longest[k] >= width:
            last = min(at + bytes_from[k] - 1, at + longest[k] - width)
            if not found[no] or found[no][-1] != (at, last + width):
                found[no].append((at, last + width))
    return [merged(f) for f in found]


def merged(ranges) -> list[tuple[int, int]]:
    """Union of half-open ranges, touching ones joined."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(32))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers = (np.cumprod(np.concatenate([[_U(1)], np.full(SLICE + WIDTH, _MULTIPLIER, _U)])),
           np.cumprod(np.concatenate([[_U(1)], np.full(SLICE + WIDTH, _INVERSE, _U)])))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash (mod 2**64) of every ``size``-byte gram, mixed."""
    up, down = _powers
    sums = np.concatenate([[_U(0)], np.cumsum((data.astype(_U) + _U(1)) * up[:len(data)])])
    return _mix((sums[size:] - sums[:-size]) * down[:len(data) - size + 1])


def anchors(data: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, hash) of the text's windows, in order.

    The text is cut into slices of windows, so memory is bounded; an anchor may
    appear in two slices, each with its own windows.
    """
    found = []
    span = width - gram + 1
    for base in range(0, max(0, len(data) - width + 1), SLICE):
        part = np.frombuffer(data, np.uint8, min(len(data) - base, SLICE + width - 1), base)
        h = gram_hashes(part, gram)
        key = (h & ~_U(0x7FFFFF)) | np.arange(len(h), dtype=_U)
        pad = -len(key) % span
        blocks = np.concatenate([key, np.full(pad, ~_U(0))]).reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = len(part) - width + 1
        best = (np.minimum(behind[:windows], ahead[span - 1:span - 1 + windows]) & _U(0x7FFFFF)).astype(np.int64)
        change = np.nonzero(np.diff(best))[0] + 1
        first = np.concatenate([[0], change])
        last = np.concatenate([change - 1, [windows - 1]])
        at = best[first]
        found.append((at + base, first + base, last + base, h[at].view(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*found))


_KEY = ["t1", "t2"]
_NO_ID = -(1 << 63)


def _documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a null id stands under the smallest number."""
    return texts(docs).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "text")


def document_key(doc: int, data: bytes) -> tuple[int, int]:
    """(t1, t2): 128 bits of the id and the text, so that texts under one id are told apart."""
    import xxhash
    t1, t2 = np.frombuffer(xxhash.xxh3_128_digest(data, int(doc) & (1 << 64) - 1), np.int64)
    return int(t1), int(t2)


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, z): the text compressed, for the joins that move it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            datas = [t.encode("utf-8") for t in b["text"]]
            keys = np.array([document_key(d, x) for d, x in zip(b["doc_id"], datas)], np.int64).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": b["doc_id"], "t1": keys[:, 0], "t2": keys[:, 1],
                                "z": [pack.compress(x) for x in datas]})
    return _documents(docs).mapInPandas(run, "doc_id long, t1 long, t2 long, z binary")


def _unpack(z) -> bytes:
    import zstandard
    return zstandard.ZstdDecompressor().decompress(bytes(z))


def occurrences(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(h, d, t1, t2, at, back, fore): every anchor, with its segment's digest
    and the distances from the anchor back to its first and last window."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash
        digest = xxhash.xxh3_64_digest
        for b in batches:
            for a in range(0, len(b), 256):
                out = []
                for doc, text in zip(*(b[c][a:a + 256] for c in ("doc_id", "text"))):
                    data = text.encode("utf-8")
                    at, first, last, h = anchors(data, width, gram)
                    if not len(at):
                        continue
                    view = memoryview(data)
                    d = b"".join([digest(view[x:y + width], p - x) for p, x, y in
                                  zip(at.tolist(), first.tolist(), last.tolist())])
                    t1, t2 = document_key(doc, data)
                    out.append(pd.DataFrame({"h": h, "d": np.frombuffer(d, np.int64), "t1": t1,
                                             "t2": t2, "at": at, "back": (at - first).astype(np.int16),
                                             "fore": (at - last).astype(np.int16)}))
                if out:
                    yield pd.concat(out, ignore_index=True)
    return _documents(docs).mapInPandas(
        run, "h long, d long, t1 long, t2 long, at long, back short, fore short")


def _per_document(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*_KEY).agg(F.collect_list(F.struct(*columns)).alias("items"))


def covered(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, limit: int = LIMIT) -> DataFrame:
    """(t1, t2, x, y): covered byte ranges; a range may appear in parts."""
    every = occurrences(docs, width, gram)
    # a table of its own, so that the join may split the rows of a very frequent anchor
    repeated = cut_lineage(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    occ = cut_lineage(every.join(repeated, "h"))
    kinds = cut_lineage(occ.groupBy("h", "d").agg(
        F.count("*").alias("n"), F.min(F.struct(*_KEY, "at", "back", "fore")).alias("one")))
    wide = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where(F.col("kinds") > limit).select("h")
    narrow = kinds.join(wide, "h", "left_anti").select("h", "d", "n", "one.*")
    texts_of = _packed(docs).drop("doc_id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for z, items in zip(b["z"], b["items"]):
                data = _unpack(z)
                out += [(i["h"], i["d"], i["n"] > 1, i["back"], data[i["at"] - i["back"]:i["at"] - i["fore"] + width])
                        for i in items]
            yield pd.DataFrame(out, columns=["h", "d", "several", "back", "segment"])
    listed = _per_document(narrow.select(*_KEY, "h", "d", "n", "at", "back", "fore"), "h", "d", "n", "at", "back", "fore")
    segments = texts_of.dropDuplicates(_KEY).join(listed, _KEY).mapInPandas(
        cut, "h long, d long, several boolean, back short, segment binary")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(rows: list) -> list:
            parts = repeated_parts([(back, bytes(s), several) for _, _, several, back, s in rows], width)
            return [(h, d, x, y) for (h, d, *_), found in zip(rows, parts) for x, y in found]
        held: list = []
        for b in batches:
            out = []
            for row in b.itertuples(index=False, name=None):
                if held and held[0][0] != row[0]:
                    out += done(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=["h", "d", "x", "y"], dtype="int64")
        if held:
            yield pd.DataFrame(done(held), columns=["h", "d", "x", "y"], dtype="int64")
    judged = segments.repartition("h").sortWithinPartitions("h", "d").mapInPandas(
        judge, "h long, d long, x long, y long")
    ranges = occ.join(judged, ["h", "d"]).select(*_KEY, (F.col("at") + F.col("x")).alias("x"),
                                                 (F.col("at") + F.col("y")).alias("y"))
    if wide.isEmpty():
        return ranges
    return ranges.unionByName(_wide_ranges(texts_of, occ.join(wide, "h", "left_semi"), width))


def _wide_ranges(texts_of: DataFrame, occ: DataFrame, width: int) -> DataFrame:
    """Ranges of the anchors with very many different segments: windows by digest."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash
        for b in batches:
            for t1, t2, z, items in zip(b["t1"], b["t2"], b["z"], b["items"]):
                view, out = memoryview(_unpack(z)), []
                for i in items:
                    for s in range(i["at"] - i["back"], i["at"] - i["fore"] + 1):
                        key = np.frombuffer(xxhash.xxh3_128_digest(view[s:s + width]), np.int64)
                        out.append((key[0], key[1], t1, t2, s))
                yield pd.DataFrame(out, columns=["k1", "k2", *_KEY, "x"], dtype="int64")
    listed = _per_document(occ, "at", "back", "fore")
    rows = texts_of.join(listed, _KEY).mapInPandas(run, "k1 long, k2 long, t1 long, t2 long, x long")
    often = rows.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")
    return rows.join(often, ["k1", "k2"], "left_semi").select(*_KEY, "x", (F.col("x") + width).alias("y"))


def deduplicate(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, limit: int = LIMIT,
                with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if
    asked for, ``kept`` (the remaining bytes)."""
    ranges = covered(docs, width, gram, limit).distinct()
    joined = _packed(docs).join(_per_document(ranges, "x", "y"), _KEY, "left")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, z, items in zip(b["doc_id"], b["z"], b["items"]):
                data = _unpack(z)
                spans = merged([(i["x"], i["y"]) for i in items]) if items is not None else []
                kept, at = [], 0
                for x, y in spans:
                    kept.append(data[at:x])
                    at = y
                rest = b"".join([*kept, data[at:]])
                row = (doc, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest())
                out.append((*row, rest) if with_text else row)
            yield pd.DataFrame(out, columns=names)
    found = joined.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
                               + ", kept binary" * with_text)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))
