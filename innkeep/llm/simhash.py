"""SimHash fingerprints and near-duplicate components by pigeonring filtering.

**Fingerprint.** A-Z are lower-cased, words are runs without ASCII white space,
features are the 3-word shingles (repeats included; fewer words: the whole
sequence; none: fingerprint 0), hashed by XXH64 with seed 42.  A bit is 1 if it
is set in more than half of the hashes.

**Candidates (pigeonring).** The 64 bits form a ring of ``M = 7`` segments.  If
two fingerprints differ in at most ``d = 3`` bits, then some segment starts a
chain in which every prefix of ``l`` consecutive segments (round the ring) has
at most ``floor(l * d / M)`` differing bits: 0, 0, 1, 1, 2, 2, 3.  So the first
two segments of that chain are equal, and at least one of the next two is:
every fingerprint is filed under the 14 keys (start, which of the two, the
three equal segments, 27 bits), and linked pairs meet in some key.  Members of
a bucket are tested by the chain condition first, then by the full distance.

**Scale.** Equal fingerprints are one node (partial aggregation first), so
copies never meet in a bucket.  Buckets of one are dropped before any member is
moved.  A bucket with more than ``limit`` different fingerprints is never
gathered: it is split again by pigeonhole on the segments outside the key (the
at most three differing bits leave one of four parts equal), level by level, until it
fits; the bits that are left at the last level bound its size.  A bucket
returns a spanning forest of its links, not its pairs; components are then
contracted in Spark.

Defined results: null text counts as empty; all texts without words share
fingerprint 0 and one component, whose id is null if no member has one; repeated
rows (same id) keep one row each; ``keep_one`` keeps of every component the row
that comes first by id (nulls last), then digest of the text, so a component of
null ids keeps one row, and two texts under one id in two components keep both;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innkeep.llm.common import connected_components, cut_lineage, texts

WIDTHS = (9, 9, 9, 9, 9, 9, 10)         # bits of the ring's segments, low bits first
MAX_BITS = 3
SHINGLE = 3
LIMIT = 2048
KEY = ["none", "doc_id", "k1", "k2"]     # of a row, in keep_one


def fingerprint_bytes(data: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one UTF-8 text."""
    import xxhash
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = (ends[shingle - 1:] if len(words) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    step = 65536
    for i in range(0, n, step):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[i:i + step], stops[i:i + step])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprint_bytes(t.encode("utf-8"), shingle) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fps.view(np.int64)})
    return texts(docs, id_col, text_col).mapInPandas(run, "doc_id long, fp long")


def _shifts(widths: tuple[int, ...]) -> list[int]:
    return [sum(widths[:i]) for i in range(len(widths))]


def _masks(widths: tuple[int, ...]) -> list[int]:
    return [((1 << w) - 1) << s for w, s in zip(widths, _shifts(widths))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def budgets(max_bits: int, m: int) -> list[int]:
    """Most differing bits of the first 1..m segments of a chain."""
    return [max_bits * n // m for n in range(1, m + 1)]


def ring_masks(widths: tuple[int, ...] = WIDTHS) -> list[int]:
    """Key masks: two segments from each start and one of the next two."""
    masks, m = _masks(widths), len(widths)
    return [masks[i] | masks[(i + 1) % m] | masks[(i + 2 + j) % m] for i in range(m) for j in (0, 1)]


def _split_mask(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask`` dealt into ``parts`` contiguous parts."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def deeper_masks(masks: list[int], max_bits: int) -> list[int]:
    """Key masks of the next level: mask ``i`` has the children ``i * (max_bits + 1) + j``,
    each with one part of its remaining bits added."""
    return [m | extra for m in masks for extra in _split_mask(m, max_bits + 1)]


def links_in_bucket(fps: np.ndarray, max_bits: int = MAX_BITS,
                    widths: tuple[int, ...] = WIDTHS) -> list[tuple[int, int]]:
    """Spanning forest of the links among different fingerprints of one bucket."""
    x = np.sort(fps.astype(np.int64)).view(np.uint64)
    n, parent = len(x), np.arange(len(x))
    masks = [np.uint64(m) for m in _masks(widths)]
    most = np.array(budgets(max_bits, len(widths)))
    out: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n - 1):
        diff = x[i] ^ x[i + 1:]
        near = np.nonzero(np.bitwise_count(diff & (masks[0] | masks[1] | masks[2])) <= max_bits)[0]
        if not len(near):
            continue
        d = np.stack([np.bitwise_count(diff[near] & m) for m in masks], axis=1).astype(np.int64)
        ring = np.concatenate([d, d[:, :-1]], axis=1)
        sums = np.concatenate([np.zeros((len(d), 1), np.int64), ring.cumsum(axis=1)], axis=1)
        m = len(masks)
        chain = np.zeros(len(d), bool)
        for s in range(m):                     # the chain that starts at segment s
            chain |= ((sums[:, s + 1:s + m + 1] - sums[:, s:s + 1]) <= most).all(axis=1)
        linked = near[chain & (d.sum(axis=1) <= max_bits)]
        for j in linked:
            a, b = root(i), root(i + 1 + j)
            if a != b:
                parent[b] = a
                out.append((int(x[i].view(np.int64)), int(x[i + 1 + j].view(np.int64))))
    return out


def _key(fp: Column, masks: list[int], numbers) -> Column:
    return F.array(*[F.struct(F.lit(i).cast("int").alias("no"),
                              fp.bitwiseAND(F.lit(_signed(masks[i]))).alias("key")) for i in numbers])


def links(distinct_fps: DataFrame, max_bits: int = MAX_BITS, widths: tuple[int, ...] = WIDTHS,
          limit: int = LIMIT) -> DataFrame:
    """(a, b): links that connect every component of the fingerprints (column ``fp``)."""
    masks = ring_masks(widths)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [e for fps in b["fps"] for e in links_in_bucket(np.asarray(fps), max_bits, widths)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    rows = distinct_fps.select("fp", F.explode(_key(F.col("fp"), masks, range(len(masks))))
                               .alias("k")).select("fp", "k.no", "k.key")
    out = None
    while True:
        sizes = cut_lineage(rows.groupBy("no", "key").agg(F.count("*").alias("n")).where("n > 1"))
        shared = rows.join(sizes, ["no", "key"])
        small = shared.where(F.col("n") <= limit).groupBy("no", "key").agg(F.collect_list("fp").alias("fps"))
        part = small.select("fps").mapInPandas(run, "a long, b long")
        out = part if out is None else out.unionByName(part)
        if sizes.where(F.col("n") > limit).isEmpty():
            break
        fan, masks = max_bits + 1, deeper_masks(masks, max_bits)
        lut = F.split(F.lit(",".join(str(_signed(m)) for m in masks)), ",").cast("array<bigint>")
        child = F.explode(F.transform(F.sequence(F.lit(0), F.lit(fan - 1)),
                                      lambda j: F.col("no") * fan + j)).alias("no")
        rows = cut_lineage(shared.where(F.col("n") > limit).select("fp", child)
                           .withColumn("key", F.col("fp").bitwiseAND(F.element_at(lut, F.col("no") + 1))))
    return out.distinct()


def _members(fps: DataFrame, max_bits: int = MAX_BITS, limit: int = LIMIT) -> DataFrame:
    """(fp, component_id, component): the component of every fingerprint by its smallest
    id and by its smallest fingerprint."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    comps = connected_components(links(nodes.select("fp"), max_bits, limit=limit))
    named = (nodes.join(comps, nodes.fp == comps.node, "left")
             .select("fp", "first_id", F.coalesce("component", "fp").alias("component")))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return named.join(least, "component").select("fp", "component_id", "component")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               shingle: int = SHINGLE, max_bits: int = MAX_BITS, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest id reachable over links."""
    fps = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    return fps.join(_members(fps, max_bits, limit), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _row_key(doc_id: Column, text: Column) -> Column:
    """(none, doc_id, k1, k2): the order of rows, by id (nulls last) and 128 bits of the
    text.  No part is null: in pandas, nulls would turn ids into doubles."""
    number, value = doc_id.cast("long"), F.md5(F.coalesce(text.cast("string"), F.lit("")))
    halves = [F.conv(F.substring(value, at, 16), 16, -10).cast("long") for at in (1, 17)]
    return F.struct(number.isNull().alias("none"), F.coalesce(number, F.lit(0)).alias("doc_id"),
                    halves[0].alias("k1"), halves[1].alias("k2"))


def _keyed_fingerprints(rows: DataFrame) -> DataFrame:
    """(none, doc_id, k1, k2, fp) of rows (key, text)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprint_bytes(t.encode("utf-8")) for t in b["text"]], np.uint64)
            yield b[KEY].assign(fp=fps.view(np.int64))
    return (rows.select("key.*", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .mapInPandas(run, "none boolean, doc_id long, k1 long, k2 long, fp long"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for every component: the first by id (nulls last), then text digest.

    Rows that repeat the kept id and text are the same document's; of them one stays.
    """
    key = _row_key(F.col(id_col), F.col(text_col))
    fps = cut_lineage(_keyed_fingerprints(docs.select(key.alias("key"), F.col(text_col).alias("text"))))
    by_fp = fps.groupBy("fp").agg(F.min(F.struct(*KEY)).alias("first"))
    kept = (by_fp.join(_members(fps), "fp").groupBy("component").agg(F.min("first").alias("first"))
            .select(*[F.col(f"first.{c}").alias(f"_{c}") for c in KEY]))
    # the columns travel in one struct, so that none of them can clash with the key
    rows = docs.select(key.alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    same = [F.col(f"_key.{c}") == F.col(f"_{c}") for c in KEY]
    return rows.join(kept, same, "left_semi").dropDuplicates(["_key"]).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
