"""Paragraph deduplication: exact groups, MinHash bands, verified Jaccard, components.

A paragraph is a line of the text; it is compared as its lower-cased words.
Paragraphs of fewer than ``SHINGLE = 5`` words have no shingle and are kept.
Two paragraphs are linked if they have the same words, or if the exact Jaccard
similarity of their sets of 5-word shingles is at least 0.8.  Of each connected
component of links the first paragraph (smallest document, then line) stays.

**Passages.** What repeats inside longer lines, or is broken into lines otherwise,
is found by runs of ``PASSAGE = 25`` words of the whole text.  Which runs are
taken depends on their words only: of every ``WINDOW = 16`` neighbouring ones that
with the smallest hash.  So of 40 or more equal words in a row at least one run is
taken in both texts, and all words but at most 15 at either end are covered.
Runs with the same words are a group, of which the first outside removed lines
(smallest document, then place) stays.  An altered passage is found by its equal
parts (at 25 words one altered word inside leaves a Jaccard of 0.6).

**Bands.** ``BANDS = 6`` bands of 2 minima: a pair at similarity 0.8 collides
with probability 1 - (1 - 0.64) ** 6 = 0.998, at 0.9 with 0.99996.

**Scale.**  Equal paragraphs become one node before anything else (128-bit
keys, partial aggregation), so a line that a third of all documents share is
one node.  Buckets of one are dropped before members move.  A bucket's members
are first compared with a pivot each (two rounds with different pivots, chosen
by a hash); components formed that way are then resolved, and only members of a
bucket that are still in different components are compared with each other
in tasks that count shared shingles and return a spanning forest.  A large bucket is split into blocks
of about ``block`` members or ``BLOCK_BYTES`` of words, every pair of blocks meeting in one task.  Texts are
fetched for members of shared buckets only.  Of passages, hashes and places move;
no text.  Tables in between are freed as soon as their successors are written.

Defined results: null text counts as empty; a repeated row (same id and text)
is the same document, different texts under one id (or under none) are different
documents, told apart by 128 bits of id and text; ties cannot occur (the first line of the smallest id
stays); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innkeep.llm.common import Tables, connected_components, texts

SHINGLE = 5
BANDS, ROWS = 6, 2
SIMILARITY = 0.8
BLOCK = 2048
BLOCK_BYTES = 4 << 20
HOT = 1000
FEW, FEW_BYTES = 32, 1 << 18
PIVOT_ROUNDS = 2
PASSAGE, WINDOW = 25, 16
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def normal_words(line: str) -> list[bytes]:
    return line.lower().encode("utf-8").split()


def _minima(lines: list[list[bytes]]) -> np.ndarray:
    """Band hashes (lines x BANDS) of lines with at least SHINGLE words."""
    import xxhash
    digest = xxhash.xxh3_64_digest
    sizes = np.array([len(w) for w in lines])
    h = np.frombuffer(b"".join([digest(w) for words in lines for w in words]), _U)
    n = len(h) - SHINGLE + 1
    grams = np.zeros(n, _U)
    for i in range(SHINGLE):
        grams = grams * _U(0x9E3779B97F4A7C15) + h[i:i + n]
    ends = sizes.cumsum()
    whole = np.ones(n, bool)                    # shingles that lie inside one line
    for i in range(1, SHINGLE):
        at = ends[:-1] - i
        whole[at[at < n]] = False
    grams = _mix(grams[whole])
    first = np.concatenate([[0], (sizes - SHINGLE + 1).cumsum()[:-1]])
    out = np.zeros((len(lines), BANDS), _U)
    for b in range(BANDS):
        for r in range(ROWS):
            k = b * ROWS + r + 1
            low = np.minimum.reduceat(_mix(grams + _U(k * 0xD1342543DE82EF95 % 2 ** 64)), first)
            out[:, b] = _mix(out[:, b] * _U(0x9E3779B97F4A7C15) + low)
    return out.view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, text): 128 bits of id and text tell texts under one id apart."""
    return texts(docs).select("doc_id", *_keys(F.col("doc_id"), F.col("text")), "text")


def _keys(doc_id: Column, text: Column) -> list[Column]:
    tell = [doc_id.isNull(), doc_id, text]
    return [F.xxhash64(*tell).alias("t1"), F.xxhash64(F.lit("t2"), *tell).alias("t2")]


def lines(docs: DataFrame, bands: bool = False, with_words: bool = False) -> DataFrame:
    """(k1, k2) of the lines of SHINGLE words or more, with the bands b0.. or with the
    words, or else with their place (doc_id, t1, t2, para)."""
    placed = not bands and not with_words
    schema = "k1 long, k2 long"
    if placed:
        schema = "doc_id long, t1 long, t2 long, para int, " + schema
    if with_words:
        schema += ", words binary"
    if bands:
        schema += "".join(f", b{i} long" for i in range(BANDS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch[a:a + 256]
                of, where, split, keys = [], [], [], []
                for doc, text in enumerate(part["text"]):
                    for no, line in enumerate(text.split("\n")):
                        words = normal_words(line)
                        if len(words) >= SHINGLE:
                            of.append(doc)
                            where.append(no)
                            split.append(words)
                            keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                if not of:
                    continue
                key = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                out = pd.DataFrame({"k1": key[:, 0], "k2": key[:, 1]})
                if placed:
                    out["doc_id"] = part["doc_id"].astype("Int64").array[of]
                    out["t1"], out["t2"] = part["t1"].to_numpy()[of], part["t2"].to_numpy()[of]
                    out["para"] = np.array(where, np.int32)
                    out = out[["doc_id", "t1", "t2", "para", "k1", "k2"]]
                if with_words:
                    out["words"] = [b" ".join(w) for w in split]
                if bands:
                    found = _minima(split)
                    for i in range(BANDS):
                        out[f"b{i}"] = found[:, i]
                yield out
    return keyed(docs).mapInPandas(run, schema)


def shingles(words: bytes) -> set[tuple[bytes, ...]]:
    w = words.split(b" ")
    return set(zip(*[w[i:] for i in range(SHINGLE)]))


def jaccard_at_least(a: set, b: set, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both) - 1e-12


def _verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose paragraphs reach the similarity."""
    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaccard_at_least(shingles(bytes(p)), shingles(bytes(q)), least) for p, q in zip(x, y)],
                         dtype=bool)
    left = words.select(F.col("nid").alias("a"), F.col("words").alias("x"))
    right = words.select(F.col("nid").alias("b"), F.col("words").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(similar("x", "y")).select("a", "b")


def _forest(members: DataFrame, words: DataFrame, least: float, block: int) -> DataFrame:
    """Links that connect, within each bucket, members of different components.

    ``members``: (band, hash, nid, component).  A bucket is cut into blocks of about
    ``block`` members or ``BLOCK_BYTES`` of words, and blocks meet pairwise; a member is
    sent once if its bucket is one block.
    """
    m = members.join(words, "nid")
    sizes = (members.join(words.select("nid", F.length("words").alias("size")), "nid").groupBy("band", "hash")
             .agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int").alias("blocks")))
    m = m.join(sizes, ["band", "hash"]).withColumn("own", F.pmod(F.xxhash64("nid"), "blocks").cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = ["band", "hash", "p", "q"]
    m = m.select("band", "hash", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
                 "nid", "component", "words", (F.col("own") > F.col("other")).alias("second"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # many small buckets in one task: rows arrive sorted, no bucket is cut
        def done(rows: list) -> list:
            _, _, p, q = rows[0][:4]
            return similar_pairs([r[4] for r in rows], [r[5] for r in rows], [bytes(r[6]) for r in rows], least,
                                 [r[7] for r in rows] if p != q else None)
        held: list = []
        for b in batches:
            out = []
            for row in b.itertuples(index=False, name=None):
                if held and held[0][:4] != row[:4]:
                    out += done(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        if held:
            yield pd.DataFrame(done(held), columns=["a", "b"], dtype="int64")
    return m.select(*place, "nid", "component", "words", "second").repartition(*[F.col(c) for c in place]) \
        .sortWithinPartitions(*place, "nid").mapInPandas(run, "a long, b long")


def _shingle_numbers(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(member, shingle): the distinct shingles of each member, numbered over all members."""
    number: dict = {}
    split = [w.split(b" ") for w in words]
    flat = np.fromiter((number.setdefault(x, len(number)) for w in split for x in w), np.int64)
    sizes = np.array([len(w) for w in split])
    n = len(flat) - SHINGLE + 1
    gram = flat[:n]
    for i in range(1, SHINGLE):                      # pairs of (prefix, next word), numbered anew each time
        gram = np.unique(gram * len(number) + flat[i:i + n], return_inverse=True)[1]
    member = np.repeat(np.arange(len(words)), sizes)
    inside = member[:n] == member[SHINGLE - 1:]
    both = np.unique(member[:n][inside] * n + gram[inside])
    return both // n, both % n


def similar_pairs(nid: list, component: list, words: list[bytes], least: float,
                  second: list | None = None) -> list[tuple[int, int]]:
    """Links that join the components of one bucket; with ``second``, only links
    between the members marked so and the others.

    For each member one count over the lists of its shingles gives what it shares with
    all others, so the Jaccard similarity of every pair of components is exact.  Buckets of
    up to ``FEW`` members and ``FEW_BYTES`` of words, most of all buckets, are compared set by set.
    """
    if len(words) <= FEW and sum(map(len, words)) <= FEW_BYTES:
        return _few_pairs(nid, component, words, least, second)
    member, gram = _shingle_numbers(words)
    size = np.bincount(member, minlength=len(words))
    order = np.argsort(gram, kind="stable")
    holders, ends = member[order], np.bincount(gram).cumsum()
    root = np.unique(np.array(component, np.int64), return_inverse=True)[1]
    start = np.searchsorted(member, np.arange(len(words) + 1))
    side = None if second is None else np.array(second, bool)
    # a pair of components always has a member outside the largest one
    biggest = np.bincount(root).argmax()
    out = []
    for i in np.flatnonzero(root != biggest):
        mine = gram[start[i]:start[i + 1]]
        common = np.bincount(np.concatenate([holders[ends[g] - n:ends[g]] for g, n in zip(mine, _lengths(ends, mine))]),
                             minlength=len(words))
        near = (common >= least * (size[i] + size - common) - 1e-12) & (root != root[i])
        if side is not None:
            near &= side != side[i]
        for j in np.flatnonzero(near):
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((nid[j], nid[i]))
    return out


def _few_pairs(nid: list, component: list, words: list[bytes], least: float,
               second: list | None) -> list[tuple[int, int]]:
    sets, root, out = [shingles(w) for w in words], list(component), []
    for i in range(len(sets)):
        for j in range(i):
            if root[j] != root[i] and (second is None or bool(second[i]) != bool(second[j])) \
                    and jaccard_at_least(sets[i], sets[j], least):
                gone = root[j]
                root = [root[i] if r == gone else r for r in root]
                out.append((nid[j], nid[i]))
    return out


def _lengths(ends: np.ndarray, which: np.ndarray) -> np.ndarray:
    return ends[which] - np.where(which > 0, ends[which - 1], 0)


def groups(docs: DataFrame, tables: Tables, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(k1, k2, component) of every paragraph text that occurs
    more than once, exactly or nearly; component is any number of the group."""
    nodes = tables.keep(lines(docs, bands=True).groupBy("k1", "k2").agg(
        F.count("*").alias("copies"), *[F.min(f"b{i}").alias(f"b{i}") for i in range(BANDS)])
        .withColumn("nid", F.monotonically_increasing_id()))
    rows = nodes.select("nid", F.posexplode(F.array(*[f"b{i}" for i in range(BANDS)]))
                        .alias("band", "hash"))
    often = rows.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    members = tables.keep(rows.join(often, ["band", "hash"]))
    wanted = members.select("nid").distinct().join(nodes.select("nid", "k1", "k2"), "nid")
    words = tables.keep(lines(docs, with_words=True).join(wanted, ["k1", "k2"], "inner").select("nid", "words")
                        .groupBy("nid").agg(F.first("words").alias("words")))
    links, comps = [], None
    for turn in range(PIVOT_ROUNDS):
        live = members if comps is None else _open_buckets(members, comps)
        pivot = live.groupBy("band", "hash").agg(
            F.min(F.struct(F.xxhash64("nid", F.lit(turn)).alias("h"), F.col("nid").alias("pivot"))).alias("p"))
        pairs = (live.join(pivot, ["band", "hash"]).where(F.col("nid") != F.col("p.pivot"))
                 .select(F.least("nid", "p.pivot").alias("a"), F.greatest("nid", "p.pivot").alias("b")).distinct())
        links.append(tables.keep(_verified(pairs, words, least)))
        comps = tables.keep(connected_components(reduce(DataFrame.unionByName, links), tables=tables))
    rest = tables.keep(_open_buckets(members, comps).select("band", "hash", "nid", "component"))
    links.append(tables.keep(_forest(rest, words, least, block)))
    tables.free(members, words, rest)
    comps = connected_components(reduce(DataFrame.unionByName, links), tables=tables)
    found = tables.keep(
        nodes.join(comps, nodes.nid == comps.node, "left")
        .where("component IS NOT NULL OR copies > 1")
        .select("k1", "k2", F.coalesce("component", "nid").alias("component")))
    tables.free(nodes, *links)
    return found


def _open_buckets(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members (with component) of the buckets that still hold several components."""
    m = (members.join(comps, members.nid == comps.node, "left")
         .select("band", "hash", "nid", F.coalesce("component", "nid").alias("component")))
    several = (m.groupBy("band", "hash").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
               .where("lo <> hi").select("band", "hash"))
    return m.join(several, ["band", "hash"])


def with_first(rows: DataFrame, group: list[str], place: Column, tables: Tables) -> DataFrame:
    """``rows`` (stored) with ``f``, the smallest place of the row's group.

    Groups of more than one in ``HOT`` rows (so fewer than ``HOT`` groups) are joined by
    broadcast and never meet in one task; all others are shuffled.
    """
    first = tables.keep(rows.groupBy(*group).agg(F.min(place).alias("f"), F.count("*").alias("n")))
    least = (first.agg(F.sum("n")).first()[0] or 0) // HOT
    hot = first.where(F.col("n") > least + 1).drop("n")
    cold = first.where(F.col("n") <= least + 1).drop("n")
    return rows.join(F.broadcast(hot), group).unionByName(
        rows.join(F.broadcast(hot.select(*group)), group, "left_anti").join(cold, group))


def shared_lines(docs: DataFrame, tables: Tables | None = None, **options) -> DataFrame:
    """(doc_id, t1, t2, para, component, first_doc, first_para, removed) of every line of a group;
    (t1, t2) as in ``keyed``."""
    tables = tables or Tables(docs.sparkSession, "paragraphs")
    found = groups(docs, tables, **options)
    rows = tables.keep(lines(docs).join(found, ["k1", "k2"]).select("doc_id", "t1", "t2", "para", "component"))
    tables.free(found)
    place = F.struct("doc_id", "t1", "t2", "para")
    return with_first(rows, ["component"], place, tables).select(
        "doc_id", "t1", "t2", "para", "component", F.col("f.doc_id").alias("first_doc"),
        F.col("f.para").alias("first_para"), (~place.eqNullSafe(F.col("f"))).alias("removed"))


def passage_runs(docs: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """(number of the text, first word, k1, k2) of the runs of PASSAGE words that are taken."""
    import xxhash
    digest = xxhash.xxh3_64_digest
    h = np.frombuffer(b"".join([digest(w) for words in docs for w in words]), _U)
    n = len(h) - PASSAGE + 1
    if n < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    sizes = np.array([len(words) for words in docs])
    doc = np.repeat(np.arange(len(docs)), sizes)
    place = np.arange(len(h)) - np.repeat(sizes.cumsum() - sizes, sizes)
    keys = np.zeros(n, _U)
    for i in range(PASSAGE):
        keys = keys * _U(0x9E3779B97F4A7C15) + h[i:i + n]
    keys = _mix(keys)
    # the place modulo WINDOW parts equal runs, so that one word over and over takes one run a window
    low = keys & ~_U(WINDOW - 1) | (place[:n] % WINDOW).astype(_U)
    width = 1
    while width < WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    first = np.arange(len(low))
    at = first + ((low & _U(WINDOW - 1)).astype(np.int64) - place[:len(low)]) % WINDOW
    at = np.unique(at[doc[first] == doc[first + PASSAGE + WINDOW - 2]])     # windows inside one text
    second = np.zeros(len(at), _U)
    for i in range(PASSAGE):
        second = _mix(second + h[at + i])
    return doc[at], place[at], keys[at].view(np.int64), second.view(np.int64)


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, word, para, last, k1, k2): runs of words, by their first word and
    the lines of their first and last word."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch[i:i + 256]
                lined = [[normal_words(line) for line in text.split("\n")] for text in part["text"]]
                doc, at, k1, k2 = passage_runs([[w for line in x for w in line] for x in lined])
                if not len(at):
                    continue
                para, last = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
                bounds = np.searchsorted(doc, np.arange(len(lined) + 1))
                for x, a, z in zip(lined, bounds, bounds[1:]):
                    ends = np.cumsum([len(line) for line in x])
                    para[a:z] = np.searchsorted(ends, at[a:z], "right")
                    last[a:z] = np.searchsorted(ends, at[a:z] + PASSAGE - 1, "right")
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array[doc],
                                    "t1": part["t1"].to_numpy()[doc], "t2": part["t2"].to_numpy()[doc],
                                    "word": at.astype(np.int32),
                                    "para": para, "last": last, "k1": k1, "k2": k2})
    return keyed(docs).mapInPandas(
        run, "doc_id long, t1 long, t2 long, word int, para int, last int, k1 long, k2 long")


def repeated_passages(docs: DataFrame, found_lines: DataFrame, tables: Tables) -> DataFrame:
    """(doc_id, t1, t2, word, first_doc) of every run of words that repeats one before it,
    outside the removed lines of ``found_lines`` (from ``shared_lines``)."""
    runs = tables.keep(passages(docs))         # read twice; the texts are split and hashed once
    often = tables.keep(runs.groupBy("k1").agg(F.count("*").alias("n")).where("n > 1").select("k1"))
    gone = (found_lines.where("removed").groupBy("t1", "t2").agg(F.collect_set("para").alias("gone")))
    found = runs.join(often, "k1")
    found = (found.join(gone, ["t1", "t2"], "left")
             .where(F.col("gone").isNull() | ~F.exists("gone", lambda g: g.between(F.col("para"), F.col("last")))))
    found = tables.keep(found.select("doc_id", "t1", "t2", "word", "k1", "k2"))
    tables.free(often, runs)
    place = F.struct("doc_id", "t1", "t2", "word")
    return (with_first(found, ["k1", "k2"], place, tables).where(~place.eqNullSafe(F.col("f")))
            .select("doc_id", "t1", "t2", "word", F.col("f.doc_id").alias("first_doc")).distinct())


def _spans(words: Column) -> Column:
    """The runs that start at these words (rising), overlapping and touching ones joined: (a, b)."""
    def add(spans, w):
        end = w + PASSAGE
        joined = F.concat(F.slice(spans, 1, F.size(spans) - 1),
                          F.array(F.struct(F.element_at(spans, -1)["a"].alias("a"), end.alias("b"))))
        return F.when((F.size(spans) > 0) & (w <= F.try_element_at(spans, F.lit(-1))["b"]), joined).otherwise(
            F.concat(spans, F.array(F.struct(w.alias("a"), end.alias("b")))))
    return F.aggregate(words, F.array().cast("array<struct<a:int,b:int>>"), add)


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: lines, lines shared with others, lines removed (their
    numbers, comma-joined), passages removed besides (first word and word after the
    last, ``a-b``, comma-joined) with their words, and the documents that hold the
    first of each group of which this one loses something."""
    tables = Tables(docs.sparkSession, "paragraphs")
    found = tables.keep(shared_lines(docs, tables, **options))
    runs = repeated_passages(docs, found, tables).groupBy("t1", "t2").agg(
        F.array_sort(F.collect_set("word")).alias("words"), F.collect_set("first_doc").alias("run_docs"))
    runs = runs.select("t1", "t2", "run_docs", _spans(F.col("words")).alias("spans"))
    per_doc = found.distinct().groupBy("t1", "t2").agg(
        F.count("*").alias("n_shared"), F.count_if("removed").alias("n_removed"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("removed"), F.col("para")))), ",").alias("removed"),
        F.sort_array(F.collect_set(F.when(F.col("removed"), F.col("first_doc")))).alias("first_docs"))
    every = keyed(docs).select("doc_id", "t1", "t2", F.size(F.split("text", "\n", -1)).cast("long").alias("n_paragraphs"))
    none = F.lit(0).cast("long")
    empty = F.array().cast("array<bigint>")
    return every.join(per_doc, ["t1", "t2"], "left").join(runs, ["t1", "t2"], "left").select(
        "doc_id", "n_paragraphs", F.coalesce("n_shared", none).alias("n_shared"),
        F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("removed", F.lit("")).alias("removed"),
        F.sort_array(F.array_union(F.coalesce("first_docs", empty), F.coalesce("run_docs", empty))).alias("first_docs"),
        F.coalesce(F.size("spans").cast("long"), none).alias("n_passages"),
        F.coalesce(F.aggregate("spans", none, lambda n, x: n + x["b"] - x["a"]), none).alias("passage_words"),
        F.coalesce(F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["a"], x["b"])), ","), F.lit(""))
        .alias("passages"), "t1", "t2")


def without(text: str, removed: str, passages: str) -> str:
    """The text without these lines and runs of words, as ``report`` names them."""
    gone = set(map(int, removed.split(","))) if removed else set()
    cut = {w for span in passages.split(",") if span for w in range(*map(int, span.split("-")))}
    out, at = [], 0
    for no, line in enumerate(text.split("\n")):
        found = list(re.finditer(r"[^ \t\r\x0b\x0c]+", line))
        own = [m for k, m in enumerate(found, at) if k in cut]
        at += len(found)
        if no in gone or own and len(own) == len(found):
            continue
        kept, upto = [], 0
        for m in own:
            kept.append(line[upto:m.start()])
            upto = m.end() + (line[m.end():m.end() + 1] in (" ", "\t"))
        out.append("".join([*kept, line[upto:]]))
    return "\n".join(out)


def remove(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` with the removed lines and passages taken out of the text."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gone = (report(named, **options).where("n_removed > 0 OR n_passages > 0")
            .select("t1", "t2", "removed", "passages").distinct())

    @F.pandas_udf("string")
    def kept(text: pd.Series, lines: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or g is None else without(t, g, p) for t, g, p in zip(text, lines, runs)],
                         dtype=object)
    # the row is one column, so that no name of its own meets ours
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"),
                       *_keys(F.col(f"`{id_col}`").cast("long"), F.coalesce(text, F.lit(""))))
    joined = rows.join(gone, ["t1", "t2"], "left")
    return joined.select(*[kept(F.col("text"), F.col("removed"), F.col("passages")).alias(c) if c == text_col
                           else F.col("row").getField(c).alias(c) for c in docs.columns])
