"""Source divergence audit: how far the sources of a language differ in their words, by count-level bitmaps.

Each language keeps the terms of at least ``MIN_DOCS`` of its documents. For every group (language, source) a block of
4,096 kept terms is held as one bitset per count: the terms that occur so often in it. Terms of one count share one
probability, so what two groups differ by in a block is a sum over pairs of counts: the AND of two bitsets, its
popcount, times the divergence of the two probabilities. Terms that a group lacks come by complement, so bitsets hold
only counts above zero. A level of fewer than ``RARE`` terms is kept as its bits, which are looked up one by one in the
other group's levels: then a block costs at most (4,096 / RARE) squared ANDs and 4,096 look-ups for each pair of groups,
however far counts reach.

Memory: words are counted in a task's dictionary of at most ``ENTRIES`` entries (and the words of one text) that is
passed on when full, and summed by Spark; a task of the pair step holds one block of at most 128 groups. Groups are
dealt in tiles of 64, and a pair of tiles meets in a task of its own, so a row is repeated once for 64 sources of its
language. The pairs themselves are the contract's result: sources squared for each language. Only the list of the
groups passes through windows by language, one row a source.

Numbers of terms come from a stored table, which no plan computes twice. All arithmetic is on integers: probabilities as
Python integers or decimals, divergences in 64 bits (at most 10^9 each).

Defined results: null text, language and source are ''; repeated rows count each; a text without letters adds no
term, but its group is listed; a language without kept terms has value 0 for all pairs; very long texts are counted
whole, in pieces that end between terms; ties are ranked by the item's UTF-8; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, discard, documents, stage_table

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Terms in a block, as a power of two; a level below RARE terms of a block is kept as its bits.
BLOCK_BITS = 12
RARE = 16
#: Groups in a tile of the pair step.
TILE = 64
#: Counted terms that a task holds before it passes them on.
ENTRIES = 200_000
#: Texts are counted in pieces of about so many bytes.
PIECE = 1 << 20

#: Bytes of terms once A-Z are lower-cased: letters, and whatever belongs to a character outside ASCII.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^a-z\x80-\xff]")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces that end between terms."""
    low = text.lower()  # of bytes: A-Z alone
    at = 0
    while at < len(low):
        end = _GAP.search(low, at + PIECE)
        to = end.start() if end else len(low)
        yield _TERM.findall(low, at, to)
        at = to


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term, of each term in each group.

    A group has one row with a null term besides, so that groups without terms are listed too.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).alias("text"))

    def passed_on(n: dict, d: dict) -> pa.RecordBatch:
        flat = [(*g, t, c, d[g][t]) for g, counts in n.items() for t, c in counts.items()] + [(*g, None, 0, 0) for g in n]
        kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        columns = [pa.array(x, k) for x, k in zip(zip(*flat), kinds)]
        return pa.RecordBatch.from_arrays([c.cast(pa.string()) if k < 3 else c for k, c in enumerate(columns)], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = defaultdict(Counter)
        d: dict[tuple, Counter] = defaultdict(Counter)
        held = 0
        for b in batches:
            columns = [b.column(k).cast(pa.binary()).to_pylist() for k in range(3)]
            for g0, g1, t in zip(*columns):
                counts, seen = n[g0, g1], set()
                before = len(counts)
                for terms in _pieces(t):
                    counts.update(terms)
                    seen.update(terms)
                d[g0, g1].update(seen)
                held += len(counts) - before
                if held >= ENTRIES:
                    yield passed_on(n, d)
                    n.clear(), d.clear()
                    held = 0
        if n:
            yield passed_on(n, d)

    parts = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, lang_n, block, bit), stored: the kept terms with their place in a bitset."""
    rows = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    numbered = rows.filter(F.col("docs") >= min_docs).sortWithinPartitions("lang").withColumn("__id", F.monotonically_increasing_id())
    place = F.shiftright("__id", BLOCK_BITS).alias("block"), F.col("__id").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("bit")
    return stage_table(numbered.select("lang", "term", "lang_n", *place), "terms")


def term_groups(counts: DataFrame, cells: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, kept, tile, tiles): every group that occurs, one row each."""
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("kept"))
    rows = counts.filter("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    rows = rows.withColumn("tile", F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / TILE).cast("int"))
    return rows.withColumn("tiles", F.max("tile").over(Window.partitionBy("lang")) + 1)


def probability(count: int, total: int, kept: int) -> int:
    return 1 + SCALE * (count + 2) // (total + 2 * kept)


class Levels:
    """One group's terms of a block by their counts: bitsets of the levels with many terms, bits of the others."""

    def __init__(self, bits: np.ndarray, counts: np.ndarray, total: int, kept: int):
        levels, at = np.unique(counts, return_inverse=True)
        self.size = np.bincount(at, minlength=len(levels))
        #: Probabilities by level; the last one is that of no occurrence.
        self.p = np.array([probability(int(c), total, kept) for c in [*levels, 0]], "int64")
        self.level = np.full(1 << BLOCK_BITS, len(levels))
        self.level[bits] = at
        self.common = np.flatnonzero(self.size >= RARE)
        self.rare_bits = bits[self.size[at] < RARE]
        flags = np.zeros((len(self.common), 1 << BLOCK_BITS), bool)
        for k, level in enumerate(self.common):
            flags[k, bits[at == level]] = True
        self.words = np.packbits(flags, axis=1).view("uint64")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def divergence(a: Levels, b: Levels, terms: int) -> int:
    """The sum over all ``terms`` of a block: joint cells of two groups' levels, each times its divergence."""
    joint = np.bitwise_count(a.words[:, None, :] & b.words[None, :, :]).sum(axis=2, dtype="int64")
    value = int((joint * _f(a.p[a.common][:, None], b.p[b.common][None, :])).sum())
    seen_a, seen_b = np.zeros(len(a.size), "int64"), np.zeros(len(b.size), "int64")
    seen_a[a.common], seen_b[b.common] = joint.sum(axis=1), joint.sum(axis=0)
    # bits of rare levels on either side that the other group has too
    bits = np.union1d(a.rare_bits, b.rare_bits)
    bits = bits[(a.level[bits] < len(a.size)) & (b.level[bits] < len(b.size))]
    la, lb = a.level[bits], b.level[bits]
    value += int(_f(a.p[la], b.p[lb]).sum())
    seen_a += np.bincount(la, minlength=len(a.size))
    seen_b += np.bincount(lb, minlength=len(b.size))
    # the complement: terms that one of the groups, or both, don't have
    only_a, only_b = a.size - seen_a, b.size - seen_b
    neither = terms - int(seen_a.sum() + only_a.sum() + only_b.sum())
    value += int((only_a * _f(a.p[:-1], b.p[-1])).sum()) + int((only_b * _f(a.p[-1], b.p[:-1])).sum())
    return value + neither * int(_f(a.p[-1], b.p[-1]))


def pair_divergence(groups: DataFrame, cells: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, a, b, value) of each two groups of a language with a before b that share a block, summed over blocks."""
    blocks = kept.groupBy("lang", "block").agg(F.count("*").cast("int").alias("terms"))
    here = blocks.join(groups, "lang")  # every group of the language has a part in each of its blocks, if only by its zeros
    held = cells.groupBy("lang", "source", "block").agg(F.collect_list(F.struct("bit", "n")).alias("cells"))  # 4,096 at most
    rows = here.join(held, ["lang", "source", "block"], "left")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("__other")
    dealt = rows.select("lang", "block", "source", "terms", "total", "kept", "tile", other, F.col("cells.bit").alias("bits"), F.col("cells.n").alias("counts"))
    dealt = dealt.withColumns({"__a": F.least("tile", "__other"), "__b": F.greatest("tile", "__other")}).drop("__other")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first, second, out = key[2], key[3], []
        rows = rows.sort_values(["tile", "source"])
        none = np.zeros(0, "int64")
        made = [
            (s, tile, Levels(none if b is None else np.asarray(b, "int64"), none if c is None else np.asarray(c, "int64"), int(n), int(k)))
            for s, tile, b, c, n, k in zip(rows["source"], rows["tile"], rows["bits"], rows["counts"], rows["total"], rows["kept"])
        ]
        terms = int(rows["terms"].iloc[0])
        for i, (s, tile, x) in enumerate(made):
            if tile == first:
                out += [(key[0], s, t, divergence(x, y, terms)) for t, u, y in made[i + 1 :] if u == second]
        return pd.DataFrame(out, columns=["lang", "a", "b", "value"])

    parts = dealt.groupBy("lang", "block", "__a", "__b").applyInPandas(run, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _p(count: Column, total: Column, kept: Column) -> Column:
    up = (count.cast("decimal(18,0)") + F.lit(2).cast("decimal(2,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    down = (total.cast("decimal(18,0)") + kept.cast("decimal(18,0)") * F.lit(2).cast("decimal(2,0)"))
    return F.call_function("div", up, down) + 1


def excess_terms(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms that a group uses more than its language does, with what they add."""
    rows = cells.join(groups, ["lang", "source"])
    rows = rows.withColumns({"__p": _p(F.col("n"), F.col("total"), F.col("kept")), "__q": _p(F.col("lang_n"), F.col("lang_total"), F.col("kept"))})
    value = F.expr("((__p - __q) * (__p - __q)) div (__p + __q)")
    return rows.filter("__p > __q").select("lang", "source", F.col("term").alias("item"), value.alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): each group against every other source of its language (``pair``), and
    the ``top`` terms in which it exceeds its language most (``term``)."""
    counts = stage_table(term_counts(docs, text, lang, source), "counts")
    kept = kept_terms(counts, min_docs)
    cells = stage_table(counts.filter("term IS NOT NULL").drop("docs").join(kept, ["lang", "term"]), "cells")
    groups = stage_table(term_groups(counts, cells, kept), "groups")
    discard(counts)
    a, b = (groups.select("lang", F.col("source").alias(c)) for c in "ab")
    pairs = a.join(b, "lang").filter("a < b").join(pair_divergence(groups, cells, kept), ["lang", "a", "b"], "left").na.fill(0, ["value"])
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pairs = pairs.select("lang", "value", ways).select("lang", "w.*", "value").withColumn("rank", ranked)
    terms = excess_terms(groups, cells).withColumn("rank", ranked).filter(F.col("rank") <= top)
    shaped = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, df in (("pair", pairs), ("term", terms))]
    return shaped[0].unionByName(shaped[1])


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir).select("text", "lang", "source"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS ln FROM x GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM x JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(ln)::HUGEINT AS lt FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n)::HUGEINT AS t FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.t, 0) + 2 * v.v) AS p,
             1 + ({SCALE}::HUGEINT * (k.ln + 2)) // (v.lt + 2 * v.v) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
      LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
m AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLE = {"op13_source_divergence": OP13_SQL}
