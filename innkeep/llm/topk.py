"""Exact top-k search by inner product, as a Voronoi kNN join.

Vectors are integers (``floor(scale * x)`` per component); the score of a query
and a vector is their inner product; each query gets its ``k`` highest scores,
ties to the smaller id.

**Groups.** Data and queries are dealt by pivots, each to the cell of its
nearest one: up to ``CELLS`` data pivots, which are rows of the table, and up to ``GROUPS`` query pivots, which are
queries.  A query group that holds more than ``block`` queries is several
blocks, so a hot query vector is many tasks.

**Bounds.** A vector s of the cell with pivot direction c is s = a c + e with e
orthogonal to c and length r, so q.s lies within a (q.c) plus or minus r |q - (q.c) c|.
A group's summary against a cell holds the least and largest q.c and the largest
|q - (q.c) c| of its queries.  From each cell the summary of the data holds (a, r) of the ``k + 1``
vectors of least r.  The (k+1)-th largest lower bound over these, or that the
pivots' own scores give (pivots are rows too), is reached by k vectors beside the query itself,
so a vector whose upper bound lies below it cannot be a result of the group
and is not sent there; all others are.

**Local.** A block of queries meets the vectors sent to its group in chunks of about
``chunk`` rows, each pair of block and chunk in one task.  A task returns the ``k`` best per
query; the bests of all chunks are ranked in Spark.

**Exact.** Components are whole numbers kept in doubles; a product of blocks
whose sums stay below 2**53 runs in doubles without rounding, any other one in Python's integers.
Bounds get a margin far above the rounding of their doubles, and where norms are
so large that it might not do (2**26), nothing is pruned.  Collected to the driver
are the pivots and the summaries: at most CELLS + GROUPS vectors, CELLS * (k + 1)
pairs and GROUPS * CELLS triples for each length of vector.

Defined results: vectors that are null or hold null or non-finite components take
no part; only vectors of the same length meet; a row is not its own candidate, but
other rows under the same id are; a null id is never a query and comes after all
others on ties; equal rows are candidates each; scores outside 64 bits are ranked (to 125 bits) and given as the
nearest long; empty vectors score 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innkeep.llm.common import cut_lineage

K = 10
SCALE = 1024
CELLS = 64
GROUPS = 64
QUERIES_PER_GROUP = 256
BLOCK = 1024
CHUNK = 4096
WHOLE = 2.0 ** 53
NORM_LIMIT = 2.0 ** 26
LARGEST = 1.7976931348623157e308
LONG_MAX = (1 << 63) - 1
HALF = 62


def prepare(table: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(rid, vec_id, dim, v, query) of the rows that take part; v holds whole numbers."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform("v", lambda x: F.when(F.abs(x) < WHOLE, F.floor(x * F.lit(scale)).cast("double"))
                         .otherwise(F.greatest(F.least(x * F.lit(float(scale)), F.lit(LARGEST)), F.lit(-LARGEST))))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"),
                        F.coalesce(is_query, F.lit(False)).alias("query"))
    return (rows.where(F.col("v").isNotNull() & ~bad)
            .select(F.monotonically_increasing_id().alias("rid"), F.coalesce("vec_id", F.lit(0)).alias("vec_id"),
                    F.col("vec_id").isNull().alias("absent"), F.size("v").alias("dim"), scaled.alias("v"), "query"))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), dim)


def nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot at the least distance from each row (the first on ties)."""
    if len(pivots) < 2:
        return np.zeros(len(x), np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        far = (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
    return np.nan_to_num(far, nan=np.inf).argmin(axis=1)


class Directions:
    """The unit directions of some pivots (a zero pivot: the zero vector)."""

    def __init__(self, pivots: np.ndarray):
        length = np.sqrt((pivots * pivots).sum(axis=1))
        self.unit = pivots / np.where(length > 0, length, 1.0)[:, None]

    def along(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(part along, length of the rest) of each row against each direction."""
        a = x @ self.unit.T
        rest = (x * x).sum(axis=1)[:, None] - a * a * (self.unit * self.unit).sum(axis=1)
        return a, np.sqrt(np.maximum(rest, 0))

    def own(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for each row against the direction of its own cell."""
        u = self.unit[cell]
        a = (x * u).sum(axis=1)
        return a, np.sqrt(np.maximum((x * x).sum(axis=1) - a * a * (u * u).sum(axis=1), 0))


def upper_bounds(a: np.ndarray, r: np.ndarray, low: np.ndarray, high: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Of vectors (part along, rest) against query summaries: no score is larger."""
    return np.where(a >= 0, a * high, a * low) + r * rest


def lower_bounds(a: np.ndarray, r: np.ndarray, low: np.ndarray, high: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return np.where(a >= 0, a * low, a * high) - r * rest


class Plan:
    """For one length of vectors: the pivots, the summaries and each group's limit."""

    def __init__(self, dim: int, pivots: np.ndarray, query_pivots: np.ndarray, largest_norm: float, k: int):
        self.dim, self.k = dim, k
        self.pivots, self.query_pivots = pivots, query_pivots
        self.prunes = largest_norm < NORM_LIMIT
        self.margin = 1e-6 * max(1.0, min(largest_norm, NORM_LIMIT) ** 2)
        self.directions = Directions(pivots) if self.prunes else None
        groups, cells = len(query_pivots), len(pivots)
        self.low, self.high = np.full((groups, cells), np.inf), np.full((groups, cells), -np.inf)
        self.rest, self.limit = np.zeros((groups, cells)), np.full(groups, np.inf)

    def query_summary(self, q: np.ndarray):
        """Of queries: (group, least along, largest along, largest rest, limit by the pivots)."""
        group = nearest(q, self.query_pivots)
        if not self.prunes:
            return group, None
        a, r = self.directions.along(q)
        scores = np.sort(q @ self.pivots.T, axis=1)
        own = scores[:, -self.k - 1] if scores.shape[1] > self.k else np.full(len(q), -np.inf)
        return group, (a, r, own)

    def take(self, group: int, low, high, rest, limit: float) -> None:
        self.low[group] = np.minimum(self.low[group], low)
        self.high[group] = np.maximum(self.high[group], high)
        self.rest[group] = np.maximum(self.rest[group], rest)
        self.limit[group] = min(self.limit[group], limit)

    def settle(self, cell: np.ndarray, a: np.ndarray, r: np.ndarray) -> None:
        """Limits from the summary of the data: cells, parts along and rests of its vectors."""
        for g in np.nonzero(np.isfinite(self.low[:, 0]))[0]:          # groups that have queries
            bounds = np.sort(lower_bounds(a, r, self.low[g, cell], self.high[g, cell], self.rest[g, cell]))
            if len(bounds) > self.k:
                self.limit[g] = max(self.limit[g], bounds[-self.k - 1])
        self.limit -= self.margin

    def groups_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, group) of every group in which a vector may be among the best."""
        if not self.prunes:
            return tuple(i.ravel() for i in np.indices((len(x), len(self.query_pivots))))
        cell = nearest(x, self.pivots)
        a, r = self.directions.own(x, cell)
        with np.errstate(invalid="ignore"):                             # groups that have no queries
            best = upper_bounds(a, r, self.low[:, cell], self.high[:, cell], self.rest[:, cell])
        group, row = np.nonzero(best + self.margin >= self.limit[:, None])
        return row, group


def best_scores(q: np.ndarray, q_rid: np.ndarray, x: np.ndarray, x_rid: np.ndarray, x_order: np.ndarray,
                k: int) -> Iterator[tuple[int, int, int]]:
    """(query index, vector index, exact score) of the k best vectors of each query;
    ``x_order`` ranks equal scores."""
    top = max(np.abs(q).max(initial=0), 1) * max(np.abs(x).max(initial=0), 1) * max(q.shape[1], 1)
    if top < WHOLE:
        scores = q @ x.T
        for i in range(len(q)):
            s = scores[i]
            if len(s) > k + 1:                       # all that reach the k-th score of the others
                least = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                near = np.nonzero(s >= least)[0]
            else:
                near = np.arange(len(s))
            near = near[x_rid[near] != q_rid[i]]
            for j in near[np.lexsort((x_order[near], -s[near]))][:k]:
                yield i, int(j), int(s[j])
        return
    whole = [[int(c) for c in v] for v in x]
    for i in range(len(q)):
        mine = [int(c) for c in q[i]]
        found = [(-sum(a * b for a, b in zip(mine, v)), x_order[j], j) for j, v in enumerate(whole) if x_rid[j] != q_rid[i]]
        for s, _, j in sorted(found)[:k]:
            yield i, j, -s


def _plan(rows: DataFrame, dim: int, total: int, queries: int, norm: float, k: int, cells: int, groups: int,
          per_group: int) -> Plan:
    """Pivots by a hash of the row, then two small summaries of all rows."""
    def pivots(df: DataFrame, n: int) -> np.ndarray:
        got = df.orderBy(F.xxhash64("rid"), "rid").limit(n).select("v").toPandas()
        return _matrix(got["v"], dim)
    mine = rows.where(F.col("dim") == dim)
    data_pivots = pivots(mine, min(cells, total))
    asking = mine.where("query").select("rid", "v")
    plan = Plan(dim, data_pivots, pivots(asking, max(1, min(groups, -(-queries // per_group)))), norm, k)
    if not plan.prunes:
        return plan

    def of_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            group, (a, r, own) = plan.query_summary(_matrix(b["v"], dim))
            for g in np.unique(group):
                m = group == g
                for c in range(a.shape[1]):
                    yield pd.DataFrame([(g, c, a[m, c].min(), a[m, c].max(), r[m, c].max(), own[m].min())])
    # one row per group and cell leaves a batch, one a group and cell the job
    found = asking.select("v").mapInPandas(of_queries, "g int, c int, low double, high double, rest double, own double")
    got = found.groupBy("g", "c").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("rest").alias("rest"),
                                      F.min("own").alias("own")).toPandas().sort_values(["g", "c"])
    for g, part in got.groupby("g"):
        plan.take(g, part["low"].to_numpy(), part["high"].to_numpy(), part["rest"].to_numpy(), float(part["own"].min()))

    def of_data(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["v"], dim)
            cell = nearest(x, plan.pivots)
            a, r = plan.directions.own(x, cell)
            out = pd.DataFrame({"c": cell, "a": a, "r": r})
            yield out.sort_values(["c", "r", "a"]).groupby("c").head(k + 1)
    rank = Window.partitionBy("c").orderBy("r", "a")
    near = (mine.select("v").mapInPandas(of_data, "c int, a double, r double")
            .withColumn("n", F.row_number().over(rank)).where(F.col("n") <= k + 1).drop("n").toPandas())
    plan.settle(near["c"].to_numpy(), near["a"].to_numpy(), near["r"].to_numpy())
    return plan


def top_k(table: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id",
          vector_col: str = "embedding", cells: int = CELLS, groups: int = GROUPS, per_group: int = QUERIES_PER_GROUP,
          block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score, query_row): the ``k`` best rows for each row where ``is_query``
    holds; ``query_row`` tells queries under one id apart."""
    rows = cut_lineage(prepare(table, is_query, id_col, vector_col, scale))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("query").alias("q"), F.max(norm).alias("norm"))
    out = None
    # one plan per length of vector that has queries
    for s in sizes.where("q > 0").orderBy("dim").collect():
        plan = _plan(rows, s.dim, s.n, s.q, s.norm, k, cells, groups, per_group)
        found = _join(rows.where(F.col("dim") == s.dim), plan, s.n, k, block, chunk)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.sparkSession.createDataFrame([], _FOUND)
    rank = Window.partitionBy("query_row").orderBy(*_best_first())
    return (out.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.when(~F.col("absent"), F.col("vec_id")).alias("vec_id"),
                    F.when(F.col("high").between(-2, 1), F.shiftleft("high", HALF) + F.col("low"))
                    .otherwise(F.when(F.col("high") < 0, F.lit(-LONG_MAX - 1)).otherwise(F.lit(LONG_MAX))).alias("score"),
                    "query_row"))


_FOUND = "query_id long, query_row long, vec_id long, absent boolean, rid long, high long, low long"


def _best_first() -> list[Column]:
    return [F.desc("high"), F.desc("low"), F.asc("absent"), F.asc("vec_id"), F.asc("rid")]


def _join(rows: DataFrame, plan: Plan, total: int, k: int, block: int, chunk: int) -> DataFrame:
    """The k best of every (block of queries, chunk of vectors)."""
    chunks = max(1, -(-total // chunk))
    dim = plan.dim

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(g=nearest(_matrix(b["v"], dim), plan.query_pivots))
    asking = cut_lineage(rows.where("query").select("rid", "vec_id", "v").mapInPandas(
        grouped, "rid long, vec_id long, v array<double>, g int"))
    sizes = asking.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = F.broadcast(sizes)                                      # a row per group
    asking = (asking.join(sizes, "g").withColumn("b", F.pmod(F.xxhash64("rid"), "blocks").cast("int"))
              .withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).drop("blocks"))

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["v"], dim)
            for at in range(0, len(b), 512):
                row, group = plan.groups_of(x[at:at + 512])
                yield b.iloc[at + row].assign(g=group)
    data = (rows.select("rid", "vec_id", "absent", "v")
            .mapInPandas(sent, "rid long, vec_id long, absent boolean, v array<double>, g int")
            .join(sizes, "g").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("c", F.pmod(F.xxhash64("rid"), F.lit(chunks)).cast("int")).drop("blocks"))

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "query_row", "vec_id", "absent", "rid", "high", "low"]
        if not len(q) or not len(x):
            return pd.DataFrame([], columns=columns)
        x = x.sort_values(["absent", "vec_id", "rid"], ignore_index=True)
        q_rid, q_id = q["rid"].to_numpy(), q["vec_id"].to_numpy()
        x_rid, x_id, absent = x["rid"].to_numpy(), x["vec_id"].to_numpy(), x["absent"].to_numpy()
        found = best_scores(_matrix(q["v"], dim), q_rid, _matrix(x["v"], dim), x_rid, np.arange(len(x)), k)
        return pd.DataFrame([(q_id[i], q_rid[i], x_id[j], absent[j], x_rid[j],
                              max(-LONG_MAX, min(LONG_MAX, s >> HALF)), s & ((1 << HALF) - 1))
                             for i, j, s in found], columns=columns)
    return asking.groupBy("g", "b", "c").cogroup(data.groupBy("g", "b", "c")).applyInPandas(solve, _FOUND)
