"""Mixing sources to target weights by fitting subset sums of document lengths.

A document's size is its number of words. Sources share the mix by weight, none above twice its size. A source's
target is met by whole copies of all its documents and, for the remaining budget, by a choice of documents: the
documents are counted by exact size, a fair part of every size is taken, and a bounded-knapsack dynamic programme over
the counts that are left finds the sum nearest to what is missing. Which documents of a size are taken follows a
seeded hash of their ids.

The counts of one source by size are at most the square root of twice its words (different sizes add up), so one task
fits a source from its counts alone. Choosing documents within a source and size is done in bins of the hash, so a
size that holds most rows is spread over many tasks.

Targets need the sources in order: one row per source passes through one task, and one number through the driver.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are
taken 0 words; rows with the same id and text are told apart by nothing, so which of them is taken is arbitrary, but
all of them count; very long texts are sizes like any other; columns of ``docs`` that aren't asked for, whatever their
names, play no part; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, split_words, stage_table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Rows that one bin of one (source, size) group holds on average at most, if all rows were in one group.
BIN_ROWS = 200_000
LEAST_BINS = 64


def goals(totals: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(sk, words, docs, target), stored, from (sk, words, docs): one row per source, in order of sk.

    Sources get ``share`` of all words by weight; a target stops at ``most`` times its source's words and the excess is
    shared again. By rising words per weight, sources are full up to the first one that what is left, dealt by weight
    among it and all behind it, doesn't fill.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (1 + (F.row_number().over(Window.orderBy("sk")) - 1) % len(weights)).cast("int"))
    rows = totals.withColumn("weight", weight).withColumn("full", most * F.col("words"))
    rising = Window.orderBy(F.col("full") / F.col("weight"), "sk")
    every = Window.partitionBy()
    left = share * F.sum("words").over(every) - F.sum("full").over(rising) + F.col("full")
    unit = left / (F.sum("weight").over(every) - F.sum("weight").over(rising) + F.col("weight"))
    rows = stage_table(rows.withColumn("unit", unit), "goals")
    first = rows.filter("unit * weight <= full").orderBy(F.col("full") / F.col("weight"), "sk").select("unit").first()
    level = F.lit(float(first["unit"]) if first else 0.0)
    return rows.select("sk", "words", "docs", F.least("full", level * F.col("weight")).alias("target"))


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that their sizes add up to nearly ``budget``.

    First the same part of every count, rounded down and one less, then a few of the largest that still fit; the rest of the
    budget, now about the largest size, goes to a bounded knapsack over the counts that are left.
    """
    total = int((sizes * counts).sum())
    taken = np.zeros(len(sizes), np.int64)
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return counts.copy()
    taken = np.maximum(np.floor(counts * (budget / total)).astype(np.int64) - 1, 0)
    rest = budget - int((sizes * taken).sum())
    reserve = int(2 * sizes[-1])
    for k in np.argsort(-sizes, kind="stable"):
        if rest <= reserve:
            break
        more = min(int(counts[k] - taken[k]), (rest - reserve) // int(sizes[k]) if sizes[k] else 0)
        taken[k] += more
        rest -= more * int(sizes[k])
    # sums reachable with the remaining counts, split into powers of two; how[s]: the last part that first reached s
    span = rest + int(sizes[-1])
    reach, how, parts = np.zeros(span + 1, bool), np.full(span + 1, -1, np.int64), []
    reach[0] = True
    for k in range(len(sizes)):
        spare, n = min(int(counts[k] - taken[k]), span // int(sizes[k])) if sizes[k] else 0, 1
        while spare > 0:
            n_now = min(n, spare)
            step = n_now * int(sizes[k])
            new = np.zeros(span + 1, bool)
            new[step:] = reach[: span + 1 - step]
            new &= ~reach
            how[new] = len(parts)
            reach |= new
            parts.append((k, n_now))
            spare, n = spare - n_now, 2 * n
        if reach[rest]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at:
        k, n = parts[how[at]]
        taken[k] += n
        at -= n * int(sizes[k])
    return taken


def _fit_source(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size")
    size, count, target = group["size"].to_numpy(np.int64), group["docs"].to_numpy(np.int64), float(group["target"].iloc[0])
    whole = int((size * count).sum())
    copies = int(target // whole) if whole else 0
    extra = fit(size, count, round(target) - copies * whole)
    return pd.DataFrame({"sk": group["sk"], "size": size, "copies": copies, "extra": extra})


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS, seed: int = 4, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, source, size, source_size, target, copies, taken): how often the mix takes each document."""
    # a key that is never null and sorts like the source, null last
    sk = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    lot = F.xxhash64(F.col("doc_id"), F.col(text), F.lit(seed))
    rows = docs.select("doc_id", *carry, F.col("source").cast("string").alias("source"), sk.alias("sk"), F.size(split_words(F.col(text))).cast("long").alias("size"), lot.alias("lot"))
    sizes = stage_table(rows.drop(*carry), "sizes")
    totals = stage_table(sizes.groupBy("sk").agg(F.sum("size").alias("words"), F.count("*").alias("docs")), "totals")
    goal = goals(totals, share, most, weights)
    docs_in_all = totals.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n")).first()["n"]

    bins = max(LEAST_BINS, math.ceil(docs_in_all / BIN_ROWS))
    in_bin = F.pmod(F.col("lot"), F.lit(bins)).cast("int").alias("bin")
    binned = stage_table(sizes.groupBy("sk", "size", in_bin).agg(F.count("*").alias("docs")), "bins")
    counts = binned.groupBy("sk", "size").agg(F.sum("docs").alias("docs")).join(goal.select("sk", "target"), "sk")
    plan = counts.groupBy("sk").applyInPandas(_fit_source, "sk string, size long, copies int, extra long")

    before = Window.partitionBy("sk", "size").orderBy("bin")
    of_bin = binned.join(plan, ["sk", "size"]).withColumn("room", F.col("extra") - F.sum("docs").over(before) + F.col("docs"))
    of_bin = of_bin.join(goal.select("sk", F.col("words").alias("source_size"), "target"), "sk")
    of_bin = of_bin.select("sk", "size", "bin", "copies", "room", "source_size", "target")

    # the join has the ranking's own keys, so that carried columns are shuffled once
    rank = F.row_number().over(Window.partitionBy("sk", "size", "bin").orderBy("lot", "doc_id"))
    ranked = (rows if carry else sizes).select("*", in_bin).withColumn("rank", rank)
    times = F.col("copies") + F.when(F.col("rank") <= F.col("room"), 1).otherwise(0)
    joined = ranked.join(of_bin, ["sk", "size", "bin"]).select("doc_id", *carry, "source", "size", "source_size", "target", times.alias("copies"))
    return joined.withColumn("taken", F.col("copies") * F.col("size"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix itself, each document as often as it is taken."""
    own = F.struct(*docs.columns).alias("__row")
    mixed = mix(docs.select("doc_id", "source", "text", own), carry=("__row",))
    return mixed.filter("copies > 0").select("__row", F.explode(F.sequence(F.lit(1), "copies"))).select("__row.*")


QUERIES = {"op4_mixing": op4_mixing}
ORACLE: dict[str, str] = {}
