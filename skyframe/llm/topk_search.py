"""Exact top-k by inner product: ball trees per shard, branch and bound, a threshold shared between shards.

Vectors are turned into integers and go to the nearest of at most ``PIVOTS`` vectors; such a cell has a centre and a
radius and makes up one shard, or as many as its size needs. Each shard is built into a ball tree inside its task; inner
products with a ball's vectors are at most <query, centre> + |query| * radius. Queries come in blocks of neighbours. A
block opens a shard's nodes in falling order of that bound, each only for the queries whose bound still reaches their
current kth score.

The kth scores are shared: in a first round each query searches one shard of the cell nearest in direction, and the kth
score it finds goes with it to the other shards, but only to those of cells whose bound reaches it. A (block, shard)
pair is the unit of a task; both are of bounded size, and vectors are sent only to blocks that open their shard.
Neither queries nor candidates are broadcast or gathered whole. How much is closed depends on the vectors: if no cell
is, every query still meets every shard, as an exact search then must.

Defined results: vectors that are null, or hold a null or a component that isn't finite, take no part; equal scores
go to the smaller id; queries with fewer candidates than k return them all; an empty table gives an empty table;
vectors of another length than the query's are compared over the longer one, with zeros; candidates that share an id
count each, queries that share one have a single ranking, in which a candidate may occur once for each of them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, stage_table

#: Vectors of a shard, queries of a block, queries that go through a tree together, vectors of a leaf.
SHARD_ROWS, BLOCK_ROWS, SEARCH_ROWS, LEAF_ROWS = 8192, 8192, 256, 64
#: Most cells; their centres are what every task gets.
PIVOTS = 1024


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as double; null if a component is missing or not finite."""
    x = F.transform(vector.cast("array<double>"), lambda v: F.floor(v * scale))
    fine = F.forall(vector.cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(vector.isNotNull() & fine, x)


class BallTree:
    """A tree of balls over integer vectors; node k's children are 2k+1 and 2k+2, all leaves are at the same depth."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.depth = max(0, math.ceil(math.log2(max(len(x), 1) / LEAF_ROWS)))
        order, spans = np.arange(len(x)), [(0, len(x))]
        for level in range(self.depth):
            for lo, hi in spans[2**level - 1 :]:
                own = x[order[lo:hi]]
                axis = own.var(0).argmax() if hi > lo else 0
                order[lo:hi] = order[lo:hi][np.argsort(own[:, axis], kind="stable")]
                middle = (lo + hi) // 2
                spans += [(lo, middle), (middle, hi)]
        self.ids, self.x, self.spans = ids[order], x[order], spans
        nodes = [self.x[lo:hi] for lo, hi in spans]
        self.centre = np.array([n.mean(0) if len(n) else np.zeros(x.shape[1]) for n in nodes])
        self.radius = np.array([np.sqrt(((n - c) ** 2).sum(1).max()) if len(n) else 0.0 for n, c in zip(nodes, self.centre)])

    def search(self, own: np.ndarray, q: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best of each query, -inf where fewer; ``least`` is the kth score known so far."""
        score, who = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        norm = np.sqrt((q * q).sum(1))
        kth = least.copy()
        bound = lambda node, rows: q[rows] @ self.centre[node] + norm[rows] * self.radius[node]
        reaches = lambda b, rows: b >= kth[rows] - 1e-6 * (1 + np.abs(b))  # noqa: E731 (equal scores may still win by their id)
        rows = np.arange(len(q))
        open_ = [(0.0, 0, rows, bound(0, rows))]
        while open_:
            _, node, rows, b = heapq.heappop(open_)
            rows = rows[reaches(b, rows)]
            lo, hi = self.spans[node]
            if not len(rows) or lo == hi:
                continue
            if node < 2**self.depth - 1:
                for child in (2 * node + 1, 2 * node + 2):
                    b = bound(child, rows)
                    near = reaches(b, rows)
                    if near.any():
                        heapq.heappush(open_, (-b[near].max(), child, rows[near], b[near]))  # nodes differ: no tie goes on to arrays
                continue
            found = q[rows] @ self.x[lo:hi].T
            found[self.ids[lo:hi][None, :] == own[rows][:, None]] = -np.inf
            s = np.concatenate([score[rows], found], 1)
            i = np.concatenate([who[rows], np.broadcast_to(self.ids[lo:hi], found.shape)], 1)
            i = np.where(np.isinf(s), np.iinfo(np.int64).max, i)
            best = np.lexsort((i, -s), axis=1)[:, :k]
            score[rows], who[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
            kth[rows] = np.maximum(kth[rows], score[rows, -1])
        return score, who


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _search(k: int):
    def run(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(shard) or not len(block):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
        block = block.sort_values("home", kind="stable")  # neighbours go through the tree together
        width = max(shard["x"].map(len).max(), block["asked"].map(len).max())
        tree = BallTree(shard["id"].to_numpy(np.int64), _matrix(shard["x"], width))
        parts = []
        for at in range(0, len(block), SEARCH_ROWS):
            b = block.iloc[at : at + SEARCH_ROWS]
            own = b["own"].to_numpy(np.int64)
            score, who = tree.search(own, _matrix(b["asked"], width), k, b["kth"].to_numpy(float))
            row, column = np.nonzero(~np.isinf(score) & (score >= b["kth"].to_numpy(float)[:, None]))
            parts.append(pd.DataFrame({"query_id": own[row], "vec_id": who[row, column], "score": score[row, column].astype(np.int64)}))
        return pd.concat(parts)

    return run


def _widened(pivots: np.ndarray, vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Pivots and vectors as matrices of one width."""
    width = max(pivots.shape[1], vectors.map(len).max())
    return np.pad(pivots, ((0, 0), (0, width - pivots.shape[1]))), _matrix(vectors, width)


def _cells(rows: DataFrame, n: int) -> tuple[np.ndarray, DataFrame]:
    """Pivots, and the rows with the nearest one, the distance to it and a draw that spreads a cell over its shards."""
    wanted = min(PIVOTS, max(1, math.ceil(n / SHARD_ROWS)))
    # a threshold first, so that partitions don't send their smallest hashes each
    sample = rows.filter(F.pmod(F.xxhash64("x"), F.lit(max(n, 1))) < 8 * wanted).select("x").distinct()
    drawn = [r["x"] for r in sample.orderBy(F.xxhash64("x")).limit(wanted).collect()] or [[0]]
    pivots = _matrix(pd.Series(drawn), max(len(x) for x in drawn))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p, x = _widened(pivots, b["x"])
                square = np.maximum((x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1), 0)
                cell = square.argmin(1)
                away = np.sqrt(((x - p[cell]) ** 2).sum(1))
                yield b.assign(cell=cell.astype(np.int32), away=away)

    placed = rows.mapInPandas(nearest, "id long, x array<long>, q boolean, cell int, away double")
    return pivots, stage_table(placed.withColumn("spread", F.rand(7)), "placed")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates, every other row, of each query."""
    named = vectors.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector)).alias("x"), is_query.alias("q"))
    rows = stage_table(named.filter("id IS NOT NULL AND x IS NOT NULL"), "vectors")
    pivots, placed = _cells(rows, rows.count())
    # at most PIVOTS rows
    sizes = {r["cell"]: r for r in placed.groupBy("cell").agg(F.max("away").alias("away"), F.count("*").alias("n")).collect()}
    radius = np.array([sizes[c]["away"] if c in sizes else 0.0 for c in range(len(pivots))])
    pieces = np.array([math.ceil(sizes[c]["n"] / SHARD_ROWS) if c in sizes else 0 for c in range(len(pivots))])
    start = np.cumsum(pieces) - pieces
    whose = np.repeat(np.arange(len(pivots)), pieces)  # the cell of each shard

    def at(values: np.ndarray, where: str) -> Column:
        return F.get(F.array(*(F.lit(int(v)) for v in values)), F.col(where))

    candidates = placed.select("id", "x", (at(start, "cell") + F.floor(F.col("spread") * at(pieces, "cell"))).cast("int").alias("shard"))

    def to_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p, x = _widened(pivots, b["asked"])
                home = np.where(pieces > 0, x @ p.T, -np.inf).argmax(1)
                shard = start[home] + (b["spread"].to_numpy() * pieces[home]).astype(int)
                yield b.assign(home=home.astype(np.int32), shard=shard.astype(np.int32))

    def to_others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            p, x = _widened(pivots, b["asked"])
            bound = x @ p.T + np.sqrt((x * x).sum(1))[:, None] * radius
            near = bound >= b["kth"].to_numpy(float)[:, None] - 1e-6 * (1 + np.abs(bound))
            for lo in range(0, len(whose), PIVOTS):  # so that few copies of a batch are held at once
                part = near[:, whose[lo : lo + PIVOTS]]
                part[np.arange(lo, lo + part.shape[1])[None, :] == b["shard"].to_numpy()[:, None]] = False
                for rows in np.array_split(np.arange(len(b)), max(1, part.sum() // 8192)):
                    row, shard = np.nonzero(part[rows])
                    if len(row):
                        yield b.iloc[rows[row]].assign(shard=(lo + shard).astype(np.int32))

    columns = "own long, asked array<long>, spread double, home int, shard int"
    asked = placed.filter("q").select(F.col("id").alias("own"), F.col("x").alias("asked"), "spread")
    homed = stage_table(asked.mapInPandas(to_first, columns), "asked")
    n_home = {r["home"]: r["count"] for r in homed.groupBy("home").count().collect()}
    n_home = np.array([n_home.get(c, 0) for c in range(len(pivots))])
    before = np.cumsum(n_home) - n_home
    block = F.floor((at(before, "home") + F.col("spread") * at(n_home, "home")) / BLOCK_ROWS).cast("int")
    homed = homed.withColumn("block", block)

    def against(queries: DataFrame) -> DataFrame:
        opened = queries.groupBy(F.col("shard").alias("s"), F.col("block").alias("b")).agg(F.count("*").alias("n"))
        met = candidates.join(opened, candidates["shard"] == opened["s"]).select("id", "x", "shard", F.col("b").alias("block"))
        pair = met.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block"))
        return pair.applyInPandas(_search(k), "query_id long, vec_id long, score long")

    first = stage_table(against(homed.withColumn("kth", F.lit(float("-inf")))), "first")
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("kth"))
    known = homed.join(kth, homed["own"] == kth["query_id"], "left").select(homed["*"], F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
    wide = stage_table(known.mapInPandas(to_others, columns + ", block int, kth double"), "wide")
    found = first.union(against(wide))
    discard(rows)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
QUERIES = {"op2_topk_search": op2_topk_search}
ORACLE = {"op2_topk_search": OP2_SQL}
