"""Prediction by partial matching: a byte-context trie learned from the corpus, code length per document.

Texts are modelled as their lower-cased words with one space between and an end mark. The trie holds every context of
up to ``ORDER`` bytes of the training documents, with counts; it is a table (one row per node, keyed by a packed long),
built by counting the longest grams in Arrow batches, summing them, and summing their suffixes. A symbol is coded at
the longest context that has seen it. Escapes are estimated by the number of distinct symbols (half a count is taken
from each), and symbols that a longer context has seen are excluded from shorter ones. Nothing is pruned.

The trie grows with the corpus, so no task holds it. Grams with at least 1/``HOT_GRAMS`` of all occurrences can number
no more than ``HOT_GRAMS``; these, and words likewise, are broadcast with their code lengths, and give most of a
document's score in the pass over its text. The rest leaves that pass as (document, gram, count) rows, which meet the
trie in ordinary joins; grams that the trie lacks go through all their suffixes in one more.

Defined results: a null or blank text is an end mark alone; a null id belongs to the training documents; repeated rows
are scored each; with no training document all symbols are equally likely; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stage_table

ORDER = 5
#: No valid UTF-8 text holds this byte: it stands before the first and after the last symbol.
EDGE = 255
SYMBOLS = 256
HOT_GRAMS, HOT_WORDS = 1 << 23, 1 << 20
#: Bytes of text handled at once inside a task.
BLOCK = 1 << 19
#: Counts of grams (16 bytes each) and words that a task holds before it gives them out; Spark adds them up.
HELD_GRAMS, HELD_WORDS = 1 << 20, 1 << 17


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def blocks(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first index, words of each text) in blocks of about BLOCK bytes; only the texts of one block are decoded at once."""
    first, size, held = 0, 0, []
    for k, value in enumerate(texts):
        t = value.as_py()
        held.append(words_of(t))
        size += len(t or "") + ORDER + 1
        if size >= BLOCK:
            yield first, held
            first, size, held = k + 1, 0, []
    if held:
        yield first, held


def grams_of(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams (context and symbol) of all symbols of the texts, and where each text's grams begin."""
    edge = bytes([EDGE])
    texts = [edge * ORDER + b" ".join(w) + edge for w in words]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    grams = np.zeros(len(raw) - ORDER, np.int64)
    for k in range(ORDER + 1):
        grams = (grams << 8) | raw[k : len(raw) - ORDER + k]
    ends = np.cumsum(sizes)
    keep = np.ones(len(grams), bool)
    keep[(ends[:-1, None] - ORDER + np.arange(ORDER)).ravel()] = False  # these span two texts
    return grams[keep], np.concatenate([[0], np.cumsum(sizes[:-1] - ORDER)])


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    every = np.concatenate(keys)
    order = np.argsort(every)
    every = every[order]
    starts = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    return every[starts], np.add.reduceat(np.concatenate(counts)[order], starts)


def count(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, gram, n): counts of words, with a null token's place taken by grams; the end of a text is the word ''."""

    def gram_rows(grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(grams), pa.string()), pa.array(grams), pa.array(n)], ["token", "gram", "n"])

    def token_rows(tokens: Counter[bytes]) -> pa.RecordBatch:
        texts = pa.array([t.decode() for t in tokens], pa.string())
        return pa.RecordBatch.from_arrays([texts, pa.nulls(len(texts), pa.int64()), pa.array(list(tokens.values()), pa.int64())], ["token", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter[bytes] = Counter()
        keys, counts, held = [], [], 0
        for b in batches:
            for _, words in blocks(b.column(0)):
                for w in words:
                    tokens.update(w)
                tokens[b""] += len(words)
                k, c = np.unique(grams_of(words)[0], return_counts=True)
                keys.append(k), counts.append(c)
                held += len(k)
                if held >= 2 * HELD_GRAMS:
                    grams, n = _summed(keys, counts)
                    keys, counts, held = [grams], [n], len(grams)
                if held >= HELD_GRAMS and len(keys) == 1:
                    yield gram_rows(keys[0], counts[0])
                    keys, counts, held = [], [], 0
                if len(tokens) >= HELD_WORDS:
                    yield token_rows(tokens)
                    tokens = Counter()
        if keys:
            yield gram_rows(*_summed(keys, counts))
        if tokens:
            yield token_rows(tokens)

    counted = docs.select(text).mapInArrow(run, "token string, gram long, n long")
    return counted.groupBy("token", "gram").agg(F.sum("n").alias("n"))


def _key(order: Column, value: Column) -> Column:
    return order.cast("long") * F.lit(1 << 56) + value


def _low(value: Column, bits: Column) -> Column:
    return F.pmod(value, F.pow(F.lit(2.0), bits).cast("long"))


class Trie:
    """``nodes`` (node, n) with a node for every gram of every order, and ``contexts`` (context, total, distinct, below).

    ``total`` and ``distinct`` are over the symbols seen in the context, ``below`` is what these symbols count in the
    next shorter context, where they are excluded.
    """

    def __init__(self, grams: DataFrame):
        orders = F.explode(F.sequence(F.lit(0), F.lit(ORDER)))
        each = grams.select("gram", "n", orders.alias("o")).select("o", _low(F.col("gram"), 8 * (F.col("o") + 1)).alias("g"), "n")
        nodes = each.groupBy("o", "g").agg(F.sum("n").alias("n"))
        self.nodes = stage_table(nodes.select(_key(F.col("o"), F.col("g")).alias("node"), "o", "g", "n"), "nodes")
        parent = self.nodes.select(F.col("node").alias("parent"), F.col("n").alias("n_below"))
        longer = self.nodes.withColumn("parent", F.when(F.col("o") > 0, _key(F.col("o") - 1, _low(F.col("g"), 8 * F.col("o")))))
        with_below = longer.join(parent, "parent", "left").withColumn("context", _key(F.col("o"), F.shiftright("g", 8)))
        sums = with_below.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum(F.coalesce("n_below", F.lit(0))).alias("below"))
        self.contexts = stage_table(sums, "contexts")

    def longest(self) -> DataFrame:
        """(gram, n, code): grams of the longest order and their log10 probability."""
        own = self.nodes.filter(F.col("o") == ORDER).select(F.col("g").alias("gram"), "n", _key(F.col("o"), F.shiftright("g", 8)).alias("context"))
        return own.join(self.contexts, "context").select("gram", "n", F.log10((2 * F.col("n") - 1) / (2 * F.col("total"))).alias("code"))

    def escaped(self, grams: DataFrame) -> DataFrame:
        """(gram, code) for distinct grams that the trie doesn't have in full, by way of shorter contexts."""
        each = grams.select("gram", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("o"))
        each = each.withColumn("low", _low(F.col("gram"), 8 * (F.col("o") + 1)))
        each = each.select("gram", "o", _key(F.col("o"), F.col("low")).alias("node"), _key(F.col("o"), F.shiftright("low", 8)).alias("context"))
        found = each.join(self.nodes.select("node", "n"), "node", "left").join(self.contexts, "context", "left")
        steps = found.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct((-F.col("o")).alias("o"), "n", "total", "distinct", "below"))).alias("steps"))
        start = F.struct(F.lit(0.0).alias("code"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("gone"), F.lit(False).alias("done"))

        def step(s: Column, x: Column) -> Column:
            total, distinct = 2 * (x["total"] - s["below"]), x["distinct"] - s["gone"]
            hit = F.struct((s["code"] + F.log10((2 * x["n"] - 1) / total)).alias("code"), s["below"].alias("below"), s["gone"].alias("gone"), F.lit(True).alias("done"))
            cost = F.when(distinct > 0, F.log10(distinct / total)).otherwise(0.0)
            miss = F.struct((s["code"] + cost).alias("code"), x["below"].alias("below"), x["distinct"].alias("gone"), F.lit(False).alias("done"))
            return F.when(s["done"] | x["total"].isNull(), s).when(x["n"].isNotNull(), hit).otherwise(miss)

        def finish(s: Column) -> Column:
            return F.when(s["done"], s["code"]).otherwise(s["code"] - F.log10(F.greatest(SYMBOLS - s["gone"], F.lit(1)).cast("double")))

        return steps.select("gram", F.aggregate("steps", start, step, finish).alias("code"))


def _first_pass(docs: DataFrame, tokens: dict[bytes, float], grams: np.ndarray, codes: np.ndarray, text: str, key: str) -> DataFrame:
    """One row per document with what the broadcast tables give, and rows for what they lack."""
    # sorted arrays take 16 bytes a gram in each worker, and no hash table beside them; the last key is above all grams
    order = np.argsort(grams)
    grams, codes = np.append(grams[order], np.iinfo(np.int64).max), np.append(codes[order], 0.0)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, grams, codes))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_known, keys, values = shared.value
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for first, words in blocks(b.column(1)):
                found, starts = grams_of(words)
                by_gram = np.argsort(found)  # in order, so that the look-ups walk through memory
                place = np.empty(len(found), np.int64)
                place[by_gram] = np.searchsorted(keys, found[by_gram])
                place[keys[place] != found] = len(keys) - 1
                scores = np.add.reduceat(values[place], starts)  # a miss is at the last place, the zero
                miss = np.flatnonzero(place == len(keys) - 1)
                doc = np.searchsorted(starts, miss, side="right") - 1
                order = np.lexsort((found[miss], doc))
                doc, gram = doc[order], found[miss][order]
                new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1]))) if len(doc) else np.empty(0, int)
                times = np.diff(np.append(new, len(doc)))
                n = len(words)
                known, base, rare_doc, rare, rare_n = [], [], [], [], []
                for k, w in enumerate(words):
                    at, total = 0, 0.0
                    for t, c in Counter(w).items():
                        code = words_known.get(t)
                        if code is None:
                            rare_doc.append(k), rare.append(t.decode()), rare_n.append(c)
                        else:
                            at += c
                            total += c * code
                    if (code := words_known.get(b"")) is None:
                        rare_doc.append(k), rare.append(""), rare_n.append(1)
                    else:
                        at += 1
                        total += code
                    known.append(at), base.append(total)
                sizes = (n, len(rare), len(new))
                which = np.concatenate([np.arange(n), np.array(rare_doc, np.int64), doc[new]]).astype(np.int64)

                def column(values, part: int, kind: pa.DataType) -> pa.Array:
                    own = [pa.array(values, kind) if p == part else pa.nulls(s, kind) for p, s in enumerate(sizes)]
                    return pa.concat_arrays(own)

                times_of = np.concatenate([[len(w) + 1 for w in words], np.array(rare_n, np.int64), times]).astype(np.int64)
                ids = pa.concat_arrays([b.column(0).slice(first, n), pa.nulls(sizes[1] + sizes[2], b.column(0).type)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + which), ids, pa.array(times_of), column(known, 0, pa.int64()), column(base, 0, pa.float64()),
                     column(scores, 0, pa.float64()), column(rare, 1, pa.string()), column(gram[new], 2, pa.int64())],
                    ["row", "key", "n", "known", "base", "score", "token", "gram"],
                )
                row += n

    return docs.select(key, text).mapInArrow(run, f"row long, key {kind}, n long, known long, base double, score double, token string, gram long")


def score(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every document; ``training`` says which to learn from."""
    counts = stage_table(count(docs.filter(training), text), "counts")
    tokens, grams = counts.filter("token IS NOT NULL").select("token", F.col("n").alias("c")), counts.filter("gram IS NOT NULL").select("gram", "n")
    size = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    cells = float(size["n"] + size["v"] + 1)
    trie = Trie(grams)
    codes = stage_table(trie.longest(), "codes")
    symbols = codes.agg(F.sum("n")).first()[0] or 0

    hot_words = tokens.filter(F.col("c") * HOT_WORDS >= size["n"]).toPandas()
    hot_grams = codes.filter(F.col("n") * HOT_GRAMS >= symbols).select("gram", "code").toArrow()
    word_codes = {t.encode(): float(c) for t, c in zip(hot_words["token"], np.log10((hot_words["c"].to_numpy(float) + 1) / cells))}
    rows = stage_table(_first_pass(docs, word_codes, hot_grams["gram"].to_numpy(), hot_grams["code"].to_numpy(), text, key), "rows")

    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    whole = rows.filter("known IS NOT NULL").select("row", "key", F.col("n").alias("n_tokens"), "known", "base", "score")
    rare = rows.filter("token IS NOT NULL").join(tokens, "token", "left")
    rare = rare.select("row", "key", zero.alias("n_tokens"), F.when(F.col("c").isNotNull(), F.col("n")).otherwise(zero).alias("known"),
                       (F.col("n") * F.log10((F.coalesce("c", zero) + 1) / F.lit(cells))).alias("base"), none.alias("score"))
    cold = stage_table(rows.filter("gram IS NOT NULL").select("row", "gram", "n").join(codes.select("gram", "code"), "gram", "left"), "cold")
    lost = cold.filter("code IS NULL").select("row", "gram", "n")
    lost = lost.join(trie.escaped(lost.select("gram").distinct()), "gram").select("row", "gram", "n", "code")
    cold = cold.filter("code IS NOT NULL").select("row", "gram", "n", "code").union(lost)
    null_key = F.lit(None).cast(rows.schema["key"].dataType)
    cold = cold.select("row", null_key.alias("key"), zero.alias("n_tokens"), zero.alias("known"), none.alias("base"), (F.col("n") * F.col("code")).alias("score"))
    sums = whole.union(rare).union(cold).groupBy("row").agg(
        F.max("key").alias(key), F.sum("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score")
    )
    return sums.select(key, "n_tokens", "n_known", F.lit(size["n"]).cast("long").alias("train_tokens"), "base_score", "score")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 7; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7, F.lit(0))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(documents(spark, sf_dir).select("doc_id", "text"), fold(F.col("doc_id")) != 2)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op1_lm_scoring": op1_lm_scoring}
ORACLE: dict[str, str] = {}
