"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed once, in Arrow batches, and kept in a stage table. The trees are fitted on
the driver to a bounded sample of labelled rows (``SAMPLE_ROWS``, those with the smallest seeded hash of their id):
that bound is a parameter of the fit; scores cover all rows. The fitted model is a few flat arrays of fixed size, sent
to the tasks in the function, which walk all rows of a batch through a tree level by level.

Defined results: null and empty texts have statistics of zero and get a score like any other; a null id is never held
out and has no label; repeated rows give repeated results; without labelled rows every score is 0.5; an empty table
gives an empty table; a document with several labels gives one sample row for each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stage_table

#: Most labelled rows that a fit takes.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 120, 4, 64, 0.1, 5.0

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256),
    "space": b" \t\r\v\f", "line": b"\n", "stop": b".", "comma": b",", "bang": b"!?", "mark": b"#*$%&|<>@_=~^\\",
    "bracket": b"()[]{}", "slash": b"/:", "dash": b"-",
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _k, _c in enumerate(_CLASSES.values()):
    _TABLE[list(_c), _k] = 1
STATISTICS = [
    *(f"{c}_share" for c in _CLASSES), "log_words", "word_length", "distinct_words", "top_word", "distinct_pairs", "distinct_triples",
    "log_lines", "distinct_lines", "words_a_line", "longest_word", "closed_lines", "capital_words",
]


def statistics(text: str | None) -> list[float]:
    """The numbers a text is judged by."""
    raw = text.encode() if text else b""
    words = raw.lower().split()
    if not words:
        return [0.0] * len(STATISTICS)
    n = len(words)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE / len(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        *shares,
        np.log1p(n),
        sum(map(len, words)) / n,
        len(set(words)) / n,
        Counter(words).most_common(1)[0][1] / n,
        len(set(zip(words, words[1:]))) / max(n - 1, 1),
        len(set(zip(words, words[1:], words[2:]))) / max(n - 2, 1),
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        n / len(lines),
        float(min(max(map(len, words)), 1000)),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
        sum(w[:1].isupper() for w in raw.split()) / n,
    ]


@dataclass(frozen=True)
class Trees:
    """Complete binary trees in flat arrays: node k has children 2k+1 and 2k+2; rows with x <= cut go left."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for log loss; every split is chosen from sums of gradients in at most ``BINS`` bins a column."""
    rows, columns = x.shape if len(y) else (0, len(STATISTICS))
    inner = 2**DEPTH - 1
    if not rows:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    edges = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, BINS)[1:-1])) for c in range(columns)]
    binned = np.stack([np.searchsorted(e, x[:, c], side="left") for c, e in enumerate(edges)], 1)
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(rate / (1 - rate)))
    margin = np.full(rows, base)
    features, cuts, leaves = [], [], []
    offset = np.arange(columns) * BINS
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(rows, np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            cell = ((node - first)[:, None] * (columns * BINS) + offset + binned).ravel()
            G, H = (np.bincount(cell, np.repeat(v, columns), width * columns * BINS).reshape(width, columns, BINS).cumsum(2) for v in (g, h))
            gain = (s := lambda a, b: a * a / (b + RIDGE))(G, H) + s(G[..., -1:] - G, H[..., -1:] - H) - s(G[..., -1:], H[..., -1:])
            gain[np.minimum(H, H[..., -1:] - H) < 1.0] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                c, b = divmod(int(best[k]), BINS)
                if gain[k, c, b] > 1e-9 and b < len(edges[c]):
                    feature[first + k], cut[first + k] = c, edges[c][b]
            node = 2 * node + 1 + (x[np.arange(rows), feature[node]] > cut[node])
        at = node - inner
        leaf = RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + RIDGE)
        margin += leaf[at]
        features.append(feature), cuts.append(cut), leaves.append(leaf)
    return Trees(np.array(features), np.array(cuts), np.array(leaves), base)


def with_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x): the statistics of each whole text as an array."""
    rows = docs.select(F.col(key), F.col(text).alias("__text"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "x": [statistics(t) for t in b["__text"]]})

    return rows.mapInPandas(run, f"`{key}` {kind}, x array<double>")


def train(rows: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fits to at most ``sample_rows`` of the rows (doc_id, x) that have a label (doc_id, quality).

    Labelled rows are counted first, so that only hashes below a threshold, of which a third more than needed can be
    expected, are sorted and limited; a limit alone would send that many rows from every partition to the driver.
    """
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter("y IN (0, 1)").withColumn("draw", F.xxhash64(F.col("doc_id"), F.lit(9)))
    expected = max(1, rows.select("doc_id").join(marks, "doc_id").count())
    below = -(2**63) + int(2**64 * min(1.0, (4 * sample_rows / 3 + 100) / expected)) - 1
    known = rows.join(marks.filter(F.col("draw") <= F.lit(below)), "doc_id")
    drawn = known.orderBy("draw", "y").limit(sample_rows).select("x", "y").toPandas()
    x = np.array(drawn["x"].tolist(), float).reshape(len(drawn), len(STATISTICS))
    return fit(x, drawn["y"].to_numpy(float))


def score(rows: DataFrame, model: Trees) -> DataFrame:
    """Adds ``score`` to rows (doc_id, x)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["x"].tolist(), float).reshape(len(b), len(STATISTICS))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.score(x)})

    return rows.select("doc_id", "x").mapInPandas(run, f"doc_id {kind}, score double")


def _fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 3 == 1


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage_table(with_statistics(documents(spark, sf_dir)), "statistics")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(rows.filter(~_fold(F.col("doc_id"))), labels)
    return score(rows, model).select(
        "doc_id", _fold(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLE: dict[str, str] = {}
