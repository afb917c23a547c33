"""Near-duplicate documents by b-bit MinHash, links confirmed on full shingle sets.

1. One pass over the texts gives for each document the number of distinct shingles, a 128-bit hash of the set, the
   keys of ``BANDS`` bands of ``ROWS`` minima, and a signature that keeps two hashed bits of each of 256 of the minima.
2. Documents with the same set form a class; from here on one row stands for a class, so copies cost nothing.
3. Classes that share a band meet in a bucket. Each member is paired with one pivot; pairs whose collision-corrected
   similarity, estimated from the bits that agree, may reach the threshold are confirmed on the full sets, and
   confirmed links are merged into components. Members of buckets that still hold several components meet once more,
   by the rarest of their differences from the largest component's centre; two that link must share one of these, so
   this is exact whatever the size of a bucket. Two members of one component need no comparison; no other pair that
   could link is left out, and there is no cap on bucket sizes.
4. A document's component is the smallest id it can reach.

A pair at the threshold of 0.8 shares no band with probability (1 - 0.8**7)**72, about 4e-8, and falls below the
estimate's margin of six standard deviations about as seldom.

Defined results: null and blank texts have an empty set and are linked with nothing; fewer words than a shingle count
as one shingle; a null id is linked like any other, and stands for its component only if that has no other id; rows
with the same id and text are one class; an empty table gives an empty table. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, stage_table

BANDS, ROWS, HASHES = 72, 7, 512
#: Minima that the signature keeps two bits of, in so many longs.
KEPT, LONGS = 256, 8
#: Documents sketched at once inside a task.
BLOCK_ROWS = 2048
CACHE_WORDS = 1 << 19
_RANDOM = np.random.default_rng(7)
_A = _RANDOM.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RANDOM.integers(0, 2**32, HASHES, dtype=np.uint32)
_C = _RANDOM.integers(0, 2**63, 128, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """64-bit hashes of the distinct shingles of a text."""

    def __init__(self, words: int):
        self.k = words
        self.cache = _WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        if len(h) < self.k:
            return _mix((_mix(h + np.arange(len(h), dtype=np.uint64)) * _C[: len(h)]).sum(keepdims=True))
        n = len(h) - self.k + 1
        return np.unique(_mix(reduce(np.add, (_mix(h[j : j + n]) * _C[j] for j in range(self.k)))))


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the set, as signed numbers."""
    with np.errstate(over="ignore"):
        a, b = _mix(s + np.uint64(1)).sum(dtype=np.uint64), _mix(s ^ _C[-1]).sum(dtype=np.uint64)
    return int(np.int64(a)), int(np.int64(b))


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima of each set (none empty), in blocks that stay in the processor's cache."""
    out = np.empty((len(sets), HASHES), np.uint32)
    at = 0
    while at < len(sets):
        end, size = at + 1, len(sets[at])
        while end < len(sets) and size + len(sets[end]) <= 1 << 14:
            size += len(sets[end])
            end += 1
        block = sets[at:end]
        x = (np.concatenate(block) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, block[:-1])])
        for p in range(HASHES):
            out[at:end, p] = np.minimum.reduceat(x * _A[p] + _B[p], starts)
        at = end
    return out


def sketch(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, s1, s2, bits, bands) of each document; bits and bands are null for an empty set."""
    rows = docs.select(F.col(key), F.col(text).alias("__text"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        place = np.uint64(2) * np.arange(32, dtype=np.uint64)
        for b in (whole.slice(at, BLOCK_ROWS) for whole in batches for at in range(0, whole.num_rows, BLOCK_ROWS)):
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            full = [k for k, s in enumerate(sets) if len(s)]
            minima = _minima([sets[k] for k in full])
            two = ((minima[:, :KEPT] * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint64).reshape(-1, LONGS, 32)
            bits = np.bitwise_or.reduce(two << place, axis=2)
            parts = minima[:, : BANDS * ROWS].astype(np.uint64).reshape(-1, BANDS, ROWS)
            keys = _mix((_mix(parts + np.uint64(1)) * _C[:ROWS]).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
            there = np.zeros(len(sets), bool)
            there[full] = True
            hashes = [_set_hash(s) for s in sets]

            def lists(values: np.ndarray, width: int) -> pa.Array:
                ends = np.concatenate([[0], np.cumsum(there * width)]).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel().view(np.int64)), mask=pa.array(~there))

            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([h[0] for h in hashes], pa.int64()),
                 pa.array([h[1] for h in hashes], pa.int64()), lists(bits, LONGS), lists(keys, BANDS)],
                ["key", "n_shingles", "s1", "s2", "bits", "bands"],
            )

    schema = f"key {kind}, n_shingles long, s1 long, s2 long, bits array<long>, bands array<long>"
    return rows.mapInArrow(run, schema).withColumn("node", F.when(F.col("n_shingles") > 0, F.xxhash64("n_shingles", "s1", "s2")))


def full_sets(docs: DataFrame, words: int, text: str = "text") -> DataFrame:
    """(n, s1, s2, shingles): the whole shingle set of each document that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for b in batches:
            sets = [s for t in b.column(0).to_pylist() if len(s := shingles(t))]
            hashes = [_set_hash(s) for s in sets]
            ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            flat = pa.array((np.concatenate(sets) if sets else np.empty(0, np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(s) for s in sets], pa.int64()), pa.array([h[0] for h in hashes], pa.int64()),
                 pa.array([h[1] for h in hashes], pa.int64()), pa.ListArray.from_arrays(ends, flat)],
                ["n", "s1", "s2", "shingles"],
            )

    return docs.select(text).mapInArrow(run, "n long, s1 long, s2 long, shingles array<long>")


def agreeing(a: Column, b: Column) -> Column:
    """Of the 256 two-bit places of two signatures, how many agree."""
    each = []
    for k in range(LONGS):
        x = F.get(a, k).bitwiseXOR(F.get(b, k))
        differ = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        each.append(F.bit_count(differ))
    return F.lit(KEPT) - reduce(lambda p, q: p + q, each)


def least_agreeing(percent: int) -> int:
    """Places that agree at the threshold, less six standard deviations; unequal minima agree in 1 of 4 places."""
    p = 0.25 + 0.75 * percent / 100
    return int(KEPT * p - 6 * (KEPT * p * (1 - p)) ** 0.5)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of edges (a, b): the smallest node of each connected component.

    Labels move along links and then jump to the label's label, so the rounds grow with the logarithm of the longest
    path. Each round is a stage table; those of earlier rounds go.
    """
    both = stage_table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = stage_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        moved = labels.join(near, "node").select("node", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        up = labels.select(F.col("node").alias("to"), F.col("comp").alias("up"))
        step = stage_table(moved.join(up, "to", "left").select("node", F.least("to", "up").alias("comp"), "was"), "labels")
        discard(labels)
        labels = step.select("node", "comp")
        if step.filter("comp <> was").isEmpty():
            discard(both)
            return labels


def _pairs_that_may_link(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b), those whose sizes and signatures allow a link."""

    def side(s: str) -> DataFrame:
        return classes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return both.filter((100 * small >= percent * large) & (agreeing(F.col("bits_a"), F.col("bits_b")) >= least_agreeing(percent))).select("a", "b")


def _sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """(node, n, shingles) of some classes. Sets are made again from texts, for these alone."""
    ids = classes.join(nodes, "node", "left_semi").select(F.col("key").alias("__key"))
    chosen = docs.join(ids, docs[key].eqNullSafe(ids["__key"]), "left_semi")
    sets = full_sets(chosen, words, text).select(F.xxhash64("n", "s1", "s2").alias("node"), "n", "shingles").dropDuplicates(["node"])
    return stage_table(sets.join(nodes, "node", "left_semi"), "sets")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """Of distinct pairs (a, b), those whose full sets reach the threshold."""
    tried = stage_table(_pairs_that_may_link(pairs, classes, percent), "tried")
    wanted = tried.select(F.col("a").alias("node")).union(tried.select("b")).distinct()
    sets = _sets_of(wanted, classes, docs, words, key, text)

    def side(s: str) -> DataFrame:
        return sets.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("shingles").alias(f"set_{s}"))

    both = tried.join(side("b"), "b").join(side("a"), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    rows = both.select("a", "b", "n_a", "n_b", common.alias("common"))
    links = rows.filter(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")
    links = stage_table(links, "links")
    discard(tried, sets)
    return links


def _meeting_by_differences(placed: DataFrame, links: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """What is left to compare in buckets of several components, as (links, pairs): links found on the way, and pairs
    (a, b) that may link. placed: (band, node, comp).

    Members of a bucket are written as differences D from the set p of a node at the centre of the bucket's largest
    component. With r = (100 - percent) / (100 + percent), x and y link if |D(x) ^ D(y)| = |x ^ y| <= r (|x| + |y|), so
    they share at least (|D(x)| + |D(y)| - r (|x| + |y|)) / 2 differences. One of a pair isn't linked with p (else both
    are in its component), say x: |D(x)| > r (|x| + |p|). Then the pair shares over (|D(y)| + r (|p| - |y|)) / 2
    differences, whatever x, and at least (|D(x)| - r (|x| + |p|)) / 2, whatever y. With all differences in one order,
    rarest first, two sets that share t of them share one among the first |D| - t + 1 of each; the first one shared
    also leaves room for the rest behind it on both sides. Members of one family differ from its centre mostly in
    places of their own, so that few meet.
    """
    sizes = placed.groupBy("band", "comp").agg(F.count("*").alias("c"))
    main = sizes.groupBy("band").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1")
    near = stage_table(placed.join(main, "band").select("node", "comp", "main").distinct(), "near")
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("c")).join(labels, "node")
    centres = degree.groupBy(F.col("comp").alias("main")).agg(F.max_by("node", F.struct("c", "node")).alias("p"))
    # a component without links is one node, and has its name
    near = near.join(centres, "main", "left").withColumn("p", F.coalesce("p", "main"))
    sets = _sets_of(near.select("node").union(near.select("p")).distinct(), classes, docs, words, key, text)
    centre = sets.select(F.col("node").alias("p"), F.col("n").alias("n_p"), F.col("shingles").alias("set_p"))
    both = near.join(sets, "node").join(centre, "p")
    both = both.withColumns({"more": F.array_except("shingles", "set_p"), "less": F.array_except("set_p", "shingles")})
    common = F.col("n") - F.size("more")
    linked = 100 * common >= percent * (F.col("n") + F.col("n_p") - common)
    rows = both.select("node", "p", "main", "n", "n_p", linked.alias("linked"), F.when(linked, F.col("main")).otherwise(F.col("comp")).alias("comp"), (F.col("comp") != F.col("main")).alias("apart"), F.concat("more", "less").alias("d"))
    rows = stage_table(rows, "differences")
    discard(sets)
    found = rows.filter("linked AND apart").select(F.greatest("node", "p").alias("a"), F.least("node", "p").alias("b"))

    rows = rows.withColumn("u", F.size("d").cast("long")).drop("apart", "p")
    held = rows.select("main", "node", F.explode("d").alias("e"))
    count = held.groupBy("main", "e").agg(F.count("*").alias("df")).filter("df > 1")
    known = held.join(count, ["main", "e"]).groupBy("main", "node").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("known"))
    whole, part = 100 + percent, 100 - percent
    # how many of the first differences a member is met by: by any that isn't linked with p, and as one of these by any
    by = F.col("u") - F.expr(f"({whole} * u + {part} * (n_p - n)) div {2 * whole}")
    of = F.when(~F.col("linked") & (F.col("comp") != F.col("main")), F.col("u") + 1 - F.greatest(F.lit(1), F.expr(f"({whole} * u - {part} * (n + n_p) + {2 * whole - 1}) div {2 * whole}")))
    # differences of one member alone come first in its order, and can meet nothing
    alone = F.col("u") - F.size("known")
    ranked = rows.drop("d").join(known, ["main", "node"]).withColumns({"by": by, "of": of, "alone": alone})
    length = F.greatest("by", F.coalesce("of", F.lit(0))) - F.col("alone")
    first = ranked.filter(length > 0).select("main", "node", "comp", "n", "u", "by", "of", "alone", F.posexplode(F.slice("known", F.lit(1), length.cast("int"))).alias("k", "e"))
    first = first.select("main", F.col("e.e").alias("e"), "node", "comp", "n", "u", "by", "of", (F.col("alone") + F.col("k") + 1).alias("at"))
    first = stage_table(first, "marks")
    x = first.filter("at <= of").select("main", "e", *(F.col(c).alias(f"{c}_x") for c in ("node", "comp", "n", "u", "at")))
    y = first.filter("at <= by")
    room = 2 * whole * (1 + F.least(F.col("u") - F.col("at"), F.col("u_x") - F.col("at_x")))
    needed = whole * (F.col("u") + F.col("u_x")) - part * (F.col("n") + F.col("n_x"))
    met = x.join(y, ["main", "e"]).filter((F.col("comp") != F.col("comp_x")) & (room >= needed))
    return found, met.select(F.greatest("node", "node_x").alias("a"), F.least("node", "node_x").alias("b")).distinct()


def link(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for every document.

    Linked are documents with 100 * intersection >= percent * union of their sets of shingles of so many words.
    """
    docs = docs.select(key, text)
    sketches = stage_table(sketch(docs, words, key, text), "sketches")
    rows = stage_table(sketches.select("key", "n_shingles", "node"), "rows")
    members = sketches.filter("node IS NOT NULL").select("node", F.explode("bands").alias("band")).distinct()
    shared = members.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("members")).filter("members > 1")
    live = stage_table(members.join(shared, "band"), "buckets")
    ids = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("key").alias("key"), F.first("n_shingles").alias("n"))
    bits = sketches.select("node", "bits").join(live.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    classes = stage_table(ids.join(bits, "node", "left"), "classes")
    discard(sketches)

    stars = live.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    links = _confirmed(stars, classes, docs, words, percent, key, text)
    labels = components(links)
    rest = live.filter("members > 2 AND node <> pivot").select("band", "node")
    placed = stage_table(rest.join(labels, "node", "left").select("band", "node", F.coalesce("comp", "node").alias("comp")), "placed")
    discard(live)
    found, pairs = _meeting_by_differences(placed, links, labels, classes, docs, words, percent, key, text)
    found = found.union(_confirmed(pairs, classes, docs, words, percent, key, text))
    discard(placed, labels)
    labels = components(links.union(found))

    placed = classes.select("node", "key").join(labels, "node", "left").select("node", "key", F.coalesce("comp", "node").alias("comp"))
    smallest = placed.groupBy("comp").agg(F.min("key").alias("component_id"))
    of_node = placed.join(smallest, "comp").select("node", "component_id")
    full = rows.filter("node IS NOT NULL").join(of_node, "node").select("key", "n_shingles", "component_id")
    empty = rows.filter("node IS NULL").select("key", "n_shingles", F.col("key").alias("component_id"))
    out = full.union(empty).withColumn("kept", F.col("key").eqNullSafe(F.col("component_id")))
    return out.withColumnRenamed("key", key)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(documents(spark, sf_dir), words=2, percent=80)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group of near duplicates, and every row whose text has no words.

    It is the row with the smallest id, one with an id before one without; of texts with the same id, the one with the
    smallest hash; of rows with the same id and text, the smallest by all columns. Rows are told apart by id and text,
    so that texts that share an id, or have none, are kept or dropped each by its own links.
    """
    full = F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("th"))
    rows = docs.filter(full).withColumn("__row", row)
    kept = link(rows, words=5, percent=80, key="__row").filter("kept").select("__row").distinct()
    one = rows.join(kept, "__row", "left_semi").groupBy("__row").agg(F.min(F.struct(*docs.columns)).alias("r"))
    return one.select("r.*").unionByName(docs.filter(~full))


QUERIES = {"op7_minhash_dedup": op7_minhash_dedup}
ORACLE: dict[str, str] = {}
