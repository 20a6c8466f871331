"""Embedding near-duplicates by spherical-cap filters over random product codes.

**Filters.** There are ``CODES`` independent codes.  For each, vectors are normalised
and turned by a fixed random rotation, then cut into ``BLOCKS`` blocks.  Every block has a small code of Gaussian
directions; a filter is one code word per block, its direction their
concatenation, so there are ``words ** BLOCKS`` filters but only ``words *
BLOCKS`` inner products per vector.  A vector is filed under every filter whose
inner product exceeds ``alpha``; these are listed block by block, dropping
partial sums that the best remaining words cannot lift to ``alpha`` (list
decoding).  Near vectors fall into the same caps.

**Size of the code.** ``alpha`` is set so that a vector meets ``HITS`` filters
on average over all codes, and the number of filters grows with the number of
vectors so that a filter is met by ``CAP`` unrelated vectors on average; the
rows that share a filter grow in step with the input.  Several codes even out
how many filters a vector meets (one code of 32 hits finds 85 to 97 % of the
pairs at cosine 0.95 exactly, eight of 8 hits each over 99 %; the tests measure
recall against brute force); links below the limit are never reported,
because each candidate is verified in double precision.

**Scale.** Equal vectors are one node with a count.  Filters met by one node
are dropped before vectors move.  The members of a cap are dealt into blocks of
``block`` rows, and each pair of blocks meets in one task: a hot cap is
many tasks.  A task returns, per vector, a number of links and a spanning
forest of them, never the pairs.  A pair that shares several filters is counted
under the smallest only, found from the filter lists that travel with the rows.

Defined results: null, zero and non-finite vectors link with nothing and are
their own component, also where several are equal; vectors of different length do not link; parallel vectors
link whatever their norms; repeated
rows (equal id) are reported each and count as different vectors; an empty
table gives an empty result; labels and other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.llm.common import connected_components, cut_lineage

COSINE = 0.95
HITS = 64.0
CAP = 0.5
BLOCKS = 2
CODES = 8
BLOCK = 512
SEED = 20


def code_size(vectors: int, hits: float = HITS, cap: float = CAP, blocks: int = BLOCKS,
              codes: int = CODES) -> tuple[int, float]:
    """(code words per block, alpha) of each code for so many different vectors."""
    own = hits / codes
    words = max(4, math.ceil(max(own * 4, vectors * own / cap) ** (1 / blocks)))
    return words, NormalDist().inv_cdf(1 - min(0.5, own / words ** blocks))


class Caps:
    """Random product code: which filters does a unit vector exceed?"""

    def __init__(self, dim: int, words: int, alpha: float, blocks: int = BLOCKS, seed: int = SEED):
        rng = np.random.default_rng([seed, dim])
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = [dim * i // blocks for i in range(blocks + 1)]
        self.codes = [rng.standard_normal((words, b - a)) for a, b in zip(self.cuts, self.cuts[1:])]
        self.words, self.alpha = words, alpha

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that the rows of ``unit`` exceed."""
        x = unit @ self.rotation
        scores = [x[:, a:b] @ c.T for a, b, c in zip(self.cuts, self.cuts[1:], self.codes)]
        best = [s.max(axis=1) for s in scores]
        row, number, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for i, s in enumerate(scores):
            rest = sum(best[i + 1:]) if i + 1 < len(best) else np.zeros(len(x))
            sums = total[:, None] + s[row]
            keep, word = np.nonzero(sums + rest[row][:, None] > self.alpha)
            total, number, row = sums[keep, word], number[keep] * self.words + word, row[keep]
        return row, number


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column])
    x = x / np.abs(x).max(axis=1)[:, None]                    # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _filters(nodes: DataFrame, words: int, alpha: float, blocks: int, codes: int, seed: int) -> DataFrame:
    """(nid, dim, filters): the filters that each vector exceeds."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caps: dict[int, list[Caps]] = {}
        for batch in batches:
            for dim, b in batch.groupby(batch["vector"].map(len)):
                if dim not in caps:
                    caps[dim] = [Caps(dim, words, alpha, blocks, seed + i) for i in range(codes)]
                for a in range(0, len(b), 512):
                    part = b.iloc[a:a + 512]
                    unit = _unit(part["vector"])
                    found = [c.decode(unit) for c in caps[dim]]
                    row = np.concatenate([r for r, _ in found])
                    number = np.concatenate([f + i * words ** blocks for i, (_, f) in enumerate(found)])
                    order = np.lexsort((number, row))
                    lists = np.split(number[order], np.searchsorted(row[order], np.arange(1, len(part))))
                    yield pd.DataFrame({"nid": part["nid"].to_numpy(), "dim": dim, "filters": lists})
    return nodes.select("nid", "vector").mapInPandas(run, "nid long, dim int, filters array<long>")


def links_in_block(nid: np.ndarray, own: np.ndarray, copies: np.ndarray, unit: np.ndarray,
                   lists: list[np.ndarray], filter_no: int, cosine: float, across: bool):
    """Of one cap (or two of its blocks): links per row and a spanning forest.

    Counts only pairs whose smallest common filter is ``filter_no``; the forest
    takes every verified pair.  ``across``: pairs between the two blocks only.
    """
    near = (unit @ unit.T) >= cosine
    np.fill_diagonal(near, False)
    if across:
        near &= own[:, None] != own[None, :]
    counts = np.zeros(len(nid), np.int64)
    forest = []
    if near.any():
        involved = np.nonzero(near.any(axis=1))[0]
        below = [lists[i][lists[i] < filter_no] for i in involved]
        flat = np.concatenate(below)
        met, inverse, often = np.unique(flat, return_inverse=True, return_counts=True)
        column = np.cumsum(often > 1) - 1
        member = np.zeros((len(involved), int((often > 1).sum())), np.float32)
        row = np.repeat(np.arange(len(involved)), [len(b) for b in below])
        use = often[inverse] > 1
        member[row[use], column[inverse[use]]] = 1
        first = (member @ member.T) == 0                     # no smaller filter in common
        sub = near[np.ix_(involved, involved)]
        counts[involved] = (sub & first) @ copies[involved]
        seen = np.zeros(len(involved), bool)
        for start in range(len(involved)):
            if seen[start]:
                continue
            seen[start], stack = True, [start]
            while stack:
                i = stack.pop()
                new = np.nonzero(sub[i] & ~seen)[0]
                seen[new] = True
                stack.extend(new.tolist())
                forest += [(nid[involved[i]], nid[involved[j]]) for j in new]
    return counts, forest


def components(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
               hits: float = HITS, cap: float = CAP, blocks: int = BLOCKS, codes: int = CODES,
               block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    element = table.schema[vector_col].dataType.elementType.simpleString()
    kind = "double" if element == "double" else "float"
    v = F.col(vector_col).cast(f"array<{kind}>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).withColumn(
        "vector", F.when(F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                         | ~F.exists("vector", lambda x: x != 0), None)
        .otherwise(F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x))))
    good = rows.where("vector is not null").withColumn("digest", F.sha2(F.to_binary(F.concat_ws(
        ",", F.transform("vector", lambda x: x.cast("string"))), F.lit("utf-8")), 256))
    nodes = cut_lineage(good.groupBy("digest").agg(
        F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
        .withColumn("nid", F.monotonically_increasing_id()))
    words, alpha = code_size(nodes.count(), hits, cap, blocks, codes)
    met = cut_lineage(_filters(nodes, words, alpha, blocks, codes, seed)
                      .select("nid", "dim", F.explode("filters").alias("filter")))
    sizes = met.groupBy("dim", "filter").agg(F.count("*").alias("n")).where("n > 1")
    met = cut_lineage(met.join(sizes, ["dim", "filter"]))
    filed = met.groupBy("nid").agg(F.collect_list("filter").alias("filters")).join(
        nodes.select("nid", "vector", "copies"), "nid")
    members = met.withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    members = members.withColumn("own", F.pmod(F.xxhash64("nid"), "parts").cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.select("dim", "filter", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
                             "own", "nid")
    full = members.join(filed, "nid")
    place = ["dim", "filter", "p", "q"]
    # many caps in one task: rows arrive sorted by cap, and no cap (pair of blocks) is cut
    dealt = full.repartition(*[F.col(c) for c in place]).sortWithinPartitions(*place)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
            out = []
            for (_, no, p, q), g in b.groupby(place, sort=False):
                counts, forest = links_in_block(
                    g["nid"].to_numpy(), g["own"].to_numpy(), g["copies"].to_numpy(), _unit(g["vector"]),
                    [np.asarray(f) for f in g["filters"]], no, cosine, p != q)
                out += [(n, 0, 0, c) for n, c in zip(g["nid"], counts) if c]
                out += [(-1, a, z, 0) for a, z in forest]
            if out:
                yield pd.DataFrame(out, columns=["nid", "a", "b", "links"], dtype="int64")
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            last = (b[place] != b[place].iloc[-1]).any(axis=1).to_numpy()
            cut = int(np.nonzero(last)[0][-1]) + 1 if last.any() else 0
            held = b.iloc[cut:]
            if cut:
                yield from done(b.iloc[:cut])
        if held is not None and len(held):
            yield from done(held)

    found = cut_lineage(dealt.mapInPandas(run, "nid long, a long, b long, links long"))
    counts = found.where("nid >= 0").groupBy("nid").agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("nid < 0").select("a", "b"))
    named = (nodes.select("nid", "digest", "copies", "first_id").join(counts, "nid", "left")
             .join(comps, F.col("nid") == comps.node, "left")
             .select("digest", "first_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0).cast("long"))).alias("n_links"),
                     F.coalesce("component", "nid").alias("component")))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_vector = named.join(least, "component").select("digest", "n_links", "component_id")
    linked = good.join(by_vector, "digest").select("vec_id", "n_links", "component_id")
    alone = rows.where("vector is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
