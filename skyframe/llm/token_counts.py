"""Word-piece lengths without building the pieces.

Greedy longest-match-first segmentation needs only the number of pieces. The vocabulary is a trie in which every node
has a failure link and the number of pieces that following it pops; reading a word moves down the trie and along
failure links, so each byte is handled once on average, whatever the lengths of the pieces.

Pieces come in two kinds, those that begin a word and those that continue one. ``from_byte_level`` makes such a
vocabulary of a byte-level file: entries that begin with a space begin words, the others continue them, and every
single byte does both, so each word can be cut.

Defined results: null and blank texts have no pieces; a word that can't be cut counts as one unknown piece; repeated
rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_characters
from .common import documents

CACHE_WORDS = 1 << 18


class PieceCounter:
    """The automaton. Nodes are numbers; 0 is the start of a word, 1 the start of a continuing piece."""

    def __init__(self, begin: Iterable[bytes], inside: Iterable[bytes]):
        self.child: list[dict[int, int]] = [{}, {}]
        entry: list[bool] = [False, False]
        for root, pieces in ((0, begin), (1, inside)):
            for piece in pieces:
                node = root
                for b in piece:
                    nxt = self.child[node].get(b)
                    if nxt is None:
                        nxt = self.child[node][b] = len(self.child)
                        self.child.append({})
                        entry.append(False)
                    node = nxt
                entry[node] = bool(piece)
        self.fail: list[int] = [-1] * len(self.child)
        self.popped: list[int] = [0] * len(self.child)
        level = [0, 1]
        while level:
            below = []
            for up in level:
                for b, node in self.child[up].items():
                    below.append(node)
                    if entry[node]:
                        self.fail[node], self.popped[node] = 1, 1
                        continue
                    link, count = self.fail[up], self.popped[up]
                    while link >= 0 and b not in self.child[link]:
                        count += self.popped[link]
                        link = self.fail[link]
                    if link >= 0:
                        self.fail[node], self.popped[node] = self.child[link][b], count
            level = below
        self.cache: dict[bytes, int] = {}

    @classmethod
    def from_byte_level(cls, source: str) -> PieceCounter:
        code = {c: b for b, c in enumerate(byte_characters())}
        pieces = [bytes(code[c] for c in t) for t in json.loads(source)["model"]["vocab"] if all(c in code for c in t)]
        alone = [bytes([b]) for b in range(256)]
        return cls([p[1:] for p in pieces if p[:1] == b" "] + alone, [p for p in pieces if p[:1] != b" "] + alone)

    def word(self, word: bytes) -> int:
        """Pieces of one word; 1 if it can't be cut."""
        child, fail, popped = self.child, self.fail, self.popped
        node, n = 0, 0
        for b in word:
            while (nxt := child[node].get(b)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = nxt
        while node > 1:
            n += popped[node]
            node = fail[node]
        return n if node == 1 else 1

    def text(self, text: str | None) -> tuple[int, int]:
        """Words and pieces of a text."""
        words = text.encode().split() if text else []
        cache, n = self.cache, 0
        for w in words:
            c = cache.get(w)
            if c is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                c = cache[w] = self.word(w)
            n += c
        return len(words), n


_LOADED: dict[str, PieceCounter] = {}


def count_pieces(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``n_words`` and ``n_tokens`` (long) of each whole text, replacing columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))  # as large as the file
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_tokens")]
    rows = docs.select(*keep, F.col(text).alias("__text"))
    added = [T.StructField(n, T.LongType(), False) for n in ("n_words", "n_tokens")]
    schema = T.StructType([*(f for f in rows.schema if f.name != "__text"), *added])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if shared.value not in _LOADED:
            _LOADED.clear()
            _LOADED[shared.value] = PieceCounter.from_byte_level(shared.value)
        counter = _LOADED[shared.value]
        for b in batches:
            counts = [counter.text(t) for t in b["__text"]]
            yield b[keep].assign(n_words=[c[0] for c in counts], n_tokens=[c[1] for c in counts])

    return rows.mapInPandas(run, schema)


def op8_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Words and word pieces of every document."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return count_pieces(documents(spark, sf_dir).select("doc_id", "text"), path, keep=["doc_id"])


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLE: dict[str, str] = {}
