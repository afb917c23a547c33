"""Operators that look at one text at a time, against plain Python."""

import hashlib
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from skyframe.llm import bpe, quality_classifier, quality_rules, token_counts


def test_quality_rules(docs, rows, empty):
    led = quality_rules.ledger(docs)
    got = Counter((x.doc_id, *(x.m[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for x in led.collect())

    def brute(t):
        t = t or ""
        w = [x for x in re.split(r"[ \t-\r]+", t) if x]
        lines = [x for x in t.split("\n") if re.search(r"[^ \t-\r]", x)]
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)

    assert got == Counter((i, *brute(t)) for i, t, _ in rows)
    kept = {x.doc_id for x in quality_rules.apply_policy(led).filter("kept").collect()}
    assert {0, 5, 110, 300} <= kept and not kept & {200, 201, 301, 302, 303, 304}
    ablation = {x.rule: (x.n_failed, x.n_only) for x in quality_rules.ablations(led).collect()}
    bits = [x.fail_bits for x in led.collect()]
    assert ablation == {r: (sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits)) for k, r in enumerate(quality_rules.RULES)}
    assert quality_rules.ledger(empty).count() == 0
    assert quality_rules.stage(None, docs, "").columns == docs.columns


def test_bpe_equals_the_library(docs, rows, empty):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library = Tokenizer.from_file(path)
    out = bpe.decode(bpe.encode(docs, path, keep=["doc_id", "text", "m"]), path).collect()
    assert len(out) == len(rows)
    for x in out:
        ids = library.encode(x.text or "", add_special_tokens=False).ids
        assert x.ids == ids and x.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(empty, path), path).count() == bpe.digests(empty, path).count() == 0
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    one_pass = sorted((str(x.doc_id), x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in bpe.digests(docs, path).collect())
    assert one_pass == sorted((str(x.doc_id), len(x.ids), sha(" ".join(map(str, x.ids))), sha(x.decoded)) for x in out)
    table = bpe.WordBpe(open(path, encoding="utf-8").read())
    for t in ["ΣΑΣ it's 12 <|endoftext|>x", "a\x1cb\x85c　d", "é é", "don't!!…", "日本語 text 😀", "x" * 3000]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert table.encode(t).tolist() == ids
        assert hashlib.sha256(table.decode(np.array(ids))).hexdigest() == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def _greedy(word, begin, inside):
    n = i = 0
    while i < len(word):
        pieces = begin if i == 0 else inside
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return 1
        n, i = n + 1, j
    return n


def test_token_counts(docs, rows, empty):
    import json

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    source = open(path, encoding="utf-8").read()
    code = {c: b for b, c in enumerate(bpe.byte_characters())}
    pieces = [bytes(code[c] for c in t) for t in json.loads(source)["model"]["vocab"] if all(c in code for c in t)]
    alone = {bytes([b]) for b in range(256)}
    begin, inside = {p[1:] for p in pieces if p[:1] == b" "} | alone, {p for p in pieces if p[:1] != b" "} | alone
    want = Counter((i, len((t or "").encode().split()), sum(_greedy(w, begin, inside) for w in (t or "").encode().split())) for i, t, _ in rows)
    got = Counter((x.doc_id, x.n_words, x.n_tokens) for x in token_counts.count_pieces(docs, path).collect())
    assert got == want
    assert token_counts.count_pieces(empty, path).count() == 0
    counter = token_counts.PieceCounter([b"ab", b"abc", b"a"], [b"d", b"bcd", b"c"])
    assert [counter.word(w) for w in (b"abcd", b"abd", b"acd", b"abcx", b"b", b"")] == [2, 2, 3, 1, 1, 1]


def test_classifier_learns(spark, rows, docs, empty):
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, len(quality_classifier.STATISTICS)))
    y = (x[:, 3] + x[:, 5] > 0).astype(float)
    trees = quality_classifier.fit(x[:1500], y[:1500])
    assert ((trees.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.9
    assert quality_classifier.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
    stats = quality_classifier.with_statistics(docs)
    labels = spark.createDataFrame([(i, int(i < 200)) for i, _, _ in rows if i is not None], "doc_id long, quality int")
    out = quality_classifier.score(stats, quality_classifier.train(stats, labels)).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 for x in out)
    assert quality_classifier.with_statistics(empty).count() == 0


@pytest.mark.parametrize("text", [None, "", " \n "])
def test_blank_statistics(text):
    assert set(quality_classifier.statistics(text)) == {0.0}


def test_small_word_caches_give_the_same_ids(monkeypatch):
    source = Path(bpe.vocabulary_path()).read_text(encoding="utf-8")
    texts = [" ".join(f"word{k * n % 17} it's {k}{n}" for k in range(9)) for n in range(12)] * 2
    whole = bpe.WordBpe(source)
    want = [list(whole.encode(t)) for t in texts]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    small = bpe.WordBpe(source)
    assert [list(small.encode(t)) for t in texts] == want and small.chunks.older


def test_bpe_memory_is_bounded(monkeypatch):
    """Texts without white space, and more pairs or words than are remembered: the same ids, and little held."""
    import random

    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library, r = Tokenizer.from_file(path), random.Random(6)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 200)
    own = bpe.WordBpe(Path(path).read_text(encoding="utf-8"))
    for k in range(40):
        text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789+/=-é中") for _ in range(3000)) + " " + " ".join(r.choice("abcde") * r.randint(1, 90) for _ in range(300))
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    for cache in (own.chunks, own.pieces):
        assert len(cache) <= 101 and len(cache.older) <= 101 and max(map(len, [*cache, *cache.older])) <= bpe.LONG
    assert len(own.compatible) <= 200


def test_trees_against_loops():
    """The flat traversal against a recursive one, and every split and leaf of a tree against sums in plain loops."""
    Q, r = quality_classifier, np.random.default_rng(3)
    x = np.round(r.normal(size=(300, len(Q.STATISTICS))), 1)
    y = ((x[:, 1] > 0.2) ^ (x[:, 4] > 0.5)).astype(float)
    trees = Q.fit(x, y)

    def walk(t, row, node):
        if node >= trees.feature.shape[1]:
            return trees.leaf[t][node - trees.feature.shape[1]]
        return walk(t, row, 2 * node + (2 if row[trees.feature[t][node]] > trees.cut[t][node] else 1))

    want = [trees.base + sum(walk(t, row, 0) for t in range(len(trees.feature))) for row in x]
    assert np.allclose(trees.margin(x), want) and ((trees.score(x) >= 0.5) == y).mean() > 0.9

    rate = y.mean()
    g, h = y - rate, np.full(len(y), rate * (1 - rate))
    edges = [np.unique(np.quantile(x[:, c], np.linspace(0, 1, Q.BINS)[1:-1])) for c in range(x.shape[1])]
    part = lambda rows: sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + Q.RIDGE)

    def check(node, rows):
        if node >= trees.feature.shape[1]:
            total = Q.RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + Q.RIDGE)
            assert np.isclose(trees.leaf[0][node - trees.feature.shape[1]], total)
            return
        split = lambda c, cut: ([i for i in rows if x[i, c] <= cut], [i for i in rows if x[i, c] > cut])
        gains = [0.0]
        for c in range(x.shape[1]):
            for cut in edges[c]:
                left, right = split(c, cut)
                if min(sum(h[i] for i in left), sum(h[i] for i in right)) >= 1.0:
                    gains.append(part(left) + part(right) - part(rows))
        left, right = split(trees.feature[0][node], trees.cut[0][node])
        assert np.isclose(part(left) + part(right) - part(rows), max(gains))
        check(2 * node + 1, left)
        check(2 * node + 2, right)

    check(0, list(range(len(x))))
