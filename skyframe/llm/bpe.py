"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

A word's tokens under the merge rules are the only sequence in which every neighbouring pair is *compatible*: taking
the pair apart merge by merge never shows a merge across their border that the rules would have made first. So the
encoder takes the longest vocabulary entry at each place (from one pass of an Aho-Corasick automaton), checks it
against its left neighbour, falls back to shorter prefixes, and steps back when none fits. No place is left twice,
which keeps the work linear in the word.

Vocabulary files are read on the driver from a path that the caller gives, and broadcast: their size is fixed by the
file (1.7 MB here), not by the data. Words are encoded once per task and kept in a bounded cache.

Defined results: a null or blank text has no ids and decodes to an empty text; repeated rows give repeated results;
ids out of range or null raise; an empty table gives an empty table; input columns named ``ids`` or ``decoded`` are
replaced, others pass through.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property
from hashlib import sha256
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents

END = "</w>"
#: White space as the tokenizer's regular expressions see it.
SPACE = r"\t-\r\x85\p{Z}"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
GAPS = regex.compile(rf"[{SPACE}]+")
#: Characters at which str.split() parts and the tokenizer doesn't.
ODD_GAPS = "\x1c\x1d\x1e\x1f"
#: Words whose ids a worker remembers, and as many older ones, none longer than LONG characters: a bounded number of bytes.
CACHE_WORDS = 1 << 17
LONG = 64
#: Pairs of neighbouring tokens whose compatibility a worker remembers; then it begins anew.
CACHE_PAIRS = 1 << 19
BLOCK_ROWS = 256


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [table[b] for b in range(256)]


class _Cache(dict):
    """Results of a function by its argument; when it holds too many, those not asked for since the last time go.

    Arguments over ``LONG`` characters are never held: texts without white space would fill it with a few of them.
    """

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > LONG:
            return self.make(key)
        if len(self) >= 2 * CACHE_WORDS:
            self.trim()
        value = self.older.pop(key, None)
        self[key] = value = self.make(key) if value is None else value
        return value

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            self.older = dict(self)
            self.clear()


class WordBpe:
    """Tables of a byte-level BPE vocabulary with word ends, built from the JSON text of a tokenizer file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens = [""] * self.size
        for t, i in (vocab | self.special).items():
            self.tokens[i] = t
        # inside, a word's end is one character, so that a token's length is its number of places
        self.ids = {self._closed(t): i for t, i in vocab.items()}
        self.length = {i: len(k) for k, i in self.ids.items()}
        self.keys = {i: k for k, i in self.ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((left, right), n)
            self.parts.setdefault(whole, (left, right))
            self.made_at.setdefault(whole, n)
        self.byte_char = byte_characters()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}
        self.pieces = _Cache(self._piece)
        self.chunks = _Cache(self._chunk)

    @staticmethod
    def _closed(token: str) -> str:
        return token[: -len(END)] + "\n" if token.endswith(END) and token != END else token

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for key, i in self.ids.items():
            a.add_word(key, (i, len(key)))
        a.make_automaton()
        return a

    @cached_property
    def special_pattern(self) -> regex.Pattern:
        return regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)))

    def fits(self, left: int, right: int) -> bool:
        """Whether no merge across the border of two neighbouring tokens comes before the merges that made them."""
        pair = (left, right)
        if (known := self.compatible.get(pair)) is not None:
            return known
        # walk back through the merges of both sides, latest first; a border merge earlier than the one undone wins
        undone = len(self.rank)
        a, b = left, right
        result = True
        while True:
            if self.rank.get((a, b), undone) < undone:
                result = False
                break
            at_a, at_b = self.made_at.get(a, -1), self.made_at.get(b, -1)
            if at_a < 0 and at_b < 0:
                break
            if at_a > at_b:  # the same merge on both sides happens left first
                undone, a = at_a, self.parts[a][1]
            else:
                undone, b = at_b + (at_a != at_b), self.parts[b][0]
        if len(self.compatible) >= CACHE_PAIRS:
            self.compatible.clear()
        self.compatible[pair] = result
        return result

    def prefix(self, token: int) -> int | None:
        """The longest vocabulary entry that is a proper prefix of a token."""
        if token not in self.shorter:
            key = self.keys[token]
            self.shorter[token] = next((self.ids[key[:n]] for n in range(len(key) - 1, 0, -1) if key[:n] in self.ids), None)
        return self.shorter[token]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one word piece, given as text."""
        plain = piece.isascii() and piece.isprintable()
        key = (piece if plain else "".join(map(self.byte_char.__getitem__, piece.encode()))) + "\n"
        size, length, known = len(key), self.length, self.compatible
        longest: list[int | None] = [None] * (size + 1)
        for end, (token, n) in self.automaton.iter(key):
            longest[end + 1 - n] = token  # later ends are longer
        open_ = bytearray(b"\1" * (size + 1))
        open_[size - 1] = 0  # the end mark goes with its character
        out: list[int] = []
        at, token, left = 0, longest[0], -1
        while at < size:
            while token is not None:
                if open_[at + length[token]]:
                    if left < 0:
                        break
                    fits = known.get((left, token))
                    if fits or fits is None and self.fits(left, token):
                        break
                token = self.prefix(token)
            if token is None:
                open_[at] = 0
                token = out.pop()
                at -= length[token]
                token = self.prefix(token)
                left = out[-1] if out else -1
            else:
                out.append(token)
                left = token
                at += length[token]
                token = longest[at]
        return out

    def _piece(self, piece: str) -> bytes:
        return np.array(self.encode_piece(piece), np.int32).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        lower = chunk.replace("Σ", "σ").lower()  # case by character: no final sigma
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(lower)))

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        split = GAPS.split(text) if any(c in text for c in ODD_GAPS) else text.split()
        self.chunks.trim()
        self.pieces.trim()
        return b"".join(map(self.chunks.__getitem__, split))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        parts: list[bytes] = []
        text, at = text or "", 0
        if "<|" in text:
            for m in self.special_pattern.finditer(text):
                parts += self._plain(text[at : m.start()]), np.int32(self.special[m.group()]).tobytes()
                at = m.end()
        parts.append(self._plain(text[at:]))
        return np.frombuffer(b"".join(parts), np.int32)

    @staticmethod
    def _offsets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts in one buffer, each followed by a space, and where each begins."""
        coded = [t.encode() + b" " for t in texts]
        return np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)])

    @cached_property
    def token_texts(self) -> tuple[np.ndarray, np.ndarray]:
        return self._offsets(self.tokens)

    @cached_property
    def id_texts(self) -> tuple[np.ndarray, np.ndarray]:
        return self._offsets([str(i) for i in range(self.size)])

    @staticmethod
    def _joined(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> bytes:
        """The table's texts of some ids, with one space between."""
        if not len(ids):
            return b""
        buffer, start = table
        ids = ids.astype(np.int64)
        size = start[ids + 1] - start[ids]
        place = np.arange(size.sum()) + np.repeat(start[ids] - np.cumsum(size) + size, size)
        return buffer[place].tobytes()[:-1]

    def decode(self, ids: np.ndarray) -> bytes:
        """Token texts in UTF-8 with one space between, as the library joins them for a vocabulary without decoder."""
        return self._joined(self.token_texts, ids)

    def decimal(self, ids: np.ndarray) -> bytes:
        return self._joined(self.id_texts, ids)


_LOADED: dict[str, WordBpe] = {}


def _tables(shared) -> WordBpe:
    """One copy of the tables in each Python worker."""
    if shared.value not in _LOADED:
        _LOADED.clear()
        _LOADED[shared.value] = WordBpe(shared.value)
    return _LOADED[shared.value]


def _share(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time: lists of ids take much more memory than the texts that Arrow batches."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK_ROWS):
            yield b.slice(at, BLOCK_ROWS)


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """Adds ``ids`` (array of int), the tokens of each whole text; ``keep`` names the columns to return besides.

    With ``decoded``, also what ``decode`` adds, in the same pass: one Python worker a task holds the tables, not two.
    """
    shared = _share(docs.sparkSession, path)
    added = {"ids": T.ArrayType(T.IntegerType())} | ({"decoded": T.StringType()} if decoded else {})
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(c, t) for c, t in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tables(shared)
        for b in _blocks(batches):
            lists = [bpe.encode(t) for t in b.column(len(keep)).to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int32), *lists])))
            texts = [pa.array([bpe.decode(x).decode() for x in lists], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids, *texts], [*keep, *added])

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of the tokens in ``ids``; a null list decodes to an empty text."""
    shared = _share(df.sparkSession, path)
    df = df.drop("decoded")
    names, at = df.columns, df.columns.index(ids)
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tables(shared)
        for b in _blocks(batches):
            texts = [bpe.decode(x.values.to_numpy()).decode() if x.is_valid else "" for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return df.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): what ``encode`` and then ``decode`` give for each text, by hash.

    Both run in one pass, so that ids and decoded texts, together several times the input, stay inside the task.
    """
    shared = _share(docs.sparkSession, path)
    rows = docs.select(key, F.col(text).alias("__text"))
    texts = [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")]
    schema = T.StructType([rows.schema.fields[0], T.StructField("n_tokens", T.LongType()), *texts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tables(shared)
        for b in batches:
            out: list[tuple[int, str, str]] = []
            for t in b.column(1):
                ids = bpe.encode(t.as_py())
                out.append((len(ids), sha256(bpe.decimal(ids)).hexdigest(), sha256(bpe.decode(ids)).hexdigest()))
            n, of_ids, of_text = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return digests(documents(spark, sf_dir), path or vocabulary_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """Pipeline stage: the ids and decoded text of each document."""
    path = path or vocabulary_path()
    rows = encode(docs, path, keep=[c for c in docs.columns if c != "text"], decoded=True)
    return rows.withColumn("n_tokens", F.size("ids").cast("long"))


QUERIES = {"op5_bpe": op5_bpe}
ORACLE: dict[str, str] = {}
