"""Operators over the whole corpus, against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.llm import line_dedup, lm_scoring, minhash_dedup, mixing, sharding, topk_search

from .conftest import prose, table


def test_sharding(docs, rows, empty):
    out = sharding.shard(docs, 8).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in out) == want
    slots = defaultdict(list)
    for x in out:
        slots[x.shard].append(x.slot)
    assert set(slots) <= set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard(empty, 8).count() == 0


def test_sharding_splits_a_heavy_text(spark):
    rows = [(k, "same text" if k % 3 == 0 else f"text {k} " * 3, None) for k in range(6000)]
    out = sharding.shard(table(spark, rows), 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [x.b for x in out]
    assert len(sizes) == 8 and max(sizes) < 1.02 * min(sizes)


def test_sharding_divides_every_overfull_range(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLE", 60)  # ranges of very unequal size
    monkeypatch.setattr(sharding, "RANGES", 128)
    rows = [(k, f"text {k} " * (1 + k % 7), None) for k in range(5000)] + [(9000 + k, "text 5 " * 6, None) for k in range(3)]
    out = sharding.shard(table(spark, rows), 8)
    sizes = [x.b for x in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.1 * min(sizes)
    assert out.groupBy("text_crc32").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0  # equal texts stay together


def _targets(sizes, share=1.5, most=2.0, weights=(3.0, 1.0, 2.0)):
    """Targets of sources in order: shares by weight, stopped at ``most`` times the size, the excess shared again."""
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        unit = left / sum(weight[k] for k in open_)
        above = {k for k in open_ if unit * weight[k] > most * sizes[k]}
        for k in above or open_:
            target[k] = most * sizes[k] if above else unit * weight[k]
        if not above:
            break
        left -= sum(target[k] for k in above)
        open_ -= above
    return target


def test_targets(spark):
    assert _targets([10, 10, 10]) == pytest.approx([20.0, 25 / 3, 50 / 3])
    import random

    r = random.Random(6)
    cases = [[10, 10, 10], [0, 0], [], [5, 100, 3, 40], [7], [0, 9, 1], *([r.choice([0, 1, 5, 50, 700]) for _ in range(r.randint(1, 12))] for _ in range(6))]
    for sizes in cases:
        totals = spark.createDataFrame([(f"0{k:03}", n, 1) for k, n in enumerate(sizes)], "sk string, words long, docs long")
        got = [x.target for x in mixing.goals(totals).orderBy("sk").collect()]
        assert got == pytest.approx(_targets(sizes))


def test_fit_reaches_the_budget():
    sizes, counts = np.array([3, 5, 17, 40]), np.array([4, 3, 9, 2])
    reach = {0}
    for s, c in zip(sizes, counts):
        reach = {r + k * s for r in reach for k in range(c + 1)}
    for budget in range(0, 280, 7):
        x = mixing.fit(sizes, counts, budget)
        assert (x <= counts).all() and (x >= 0).all()
        assert abs(int((x * sizes).sum()) - min(budget, 260)) <= 3


def test_mixing(docs, rows, empty):
    out = mixing.mix(docs).collect()
    words = {(i, s): len((t or "").split()) for i, t, s in rows}
    assert len(out) == len(rows)
    taken = defaultdict(int)
    for x in out:
        assert x.size == words[x.doc_id, x.source] and x.taken in (0, x.size, 2 * x.size)
        taken[x.source] += x.taken
    assert {None} < set(taken)
    for x in out:
        assert x.target <= 2 * x.source_size
        if x.source != "s1":  # one text holds most of s1, and no choice of the others comes near
            assert abs(taken[x.source] - x.target) <= 20
    again = Counter((x.doc_id, x.taken) for x in mixing.mix(docs.repartition(5)).collect())
    assert again == Counter((x.doc_id, x.taken) for x in out)
    assert mixing.mix(empty).count() == 0


def _sets(rows, k):
    out = []
    for i, t, _ in rows:
        w = re.findall(r"[^ \t-\r]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    return out


def _components(sets):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(sets)):
        groups[find(k)].append(k)
    return {k: min((sets[j][0] for j in g if sets[j][0] is not None), default=None) for g in groups.values() for k in g}


def _check_links(spark, rows, k):
    sets = _sets(rows, k)
    comp = _components(sets)
    got = Counter((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in minhash_dedup.link(table(spark, rows), k, 80).collect())
    assert got == Counter((i, len(s), comp[n], i == comp[n]) for n, (i, s) in enumerate(sets))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, rows, k):
    _check_links(spark, rows, k)


def test_near_duplicates_in_families(spark):
    """Families around one text whose members link to some of the others only, and texts that share a passage."""
    import random

    r = random.Random(5)
    rows = []
    base, passage = prose(r, 120).split(" "), prose(r, 100)
    for k in range(90):
        w = list(base)
        for j in r.sample(range(len(w)), r.randint(0, 16)):
            w[j] = f"x{r.randint(0, 5)}"
        rows.append((k, " ".join(w), None))
    rows += [(1000 + k, passage + " " + prose(r, r.randint(10, 40)), None) for k in range(60)]
    _check_links(spark, rows, 2)


def test_near_duplicates_in_a_large_family(spark):
    """A thousand near copies, most of them linked to the text at the centre, others to a few of each other only."""
    import random

    r = random.Random(12)
    base = prose(r, 110).split(" ")
    rows = []
    for k in range(1000):
        w = list(base)
        for j in r.sample(range(len(w)), r.choice([1, 2, 3, 5, 6, 7, 8])):
            w[j] = r.choice(base) + r.choice("abc")
        rows.append((k, " ".join(w[: r.choice([110, 110, 100, 92])]), None))
    _check_links(spark, rows, 2)
    assert len({x.component_id for x in minhash_dedup.link(table(spark, rows), 2, 80).collect()}) > 10


def test_near_duplicate_stage_tells_rows_of_one_id_apart(spark):
    import random

    r = random.Random(8)
    a, b, c, d, e, f = (prose(r, 60) for _ in range(6))
    rows = [(1, a, "s0"), (2, a + " more", "s0"), (2, b, "s0"), (3, b, "s1"), (3, c, "s0"), (4, d, "s1"), (4, d, "s0")]
    rows += [(None, e, None), (None, f, None), (None, f, "s0"), (None, a, "s0"), (None, None, "s1"), (None, None, "s1"), (5, " \n", None), (5, None, None)]
    docs = table(spark, rows).repartition(3)
    out = minhash_dedup.stage(spark, docs, "")
    assert out.columns == docs.columns
    want = [(1, a, "s0"), (2, b, "s0"), (3, c, "s0"), (4, d, "s0"), (None, e, None), (None, f, None), *rows[-4:]]
    assert Counter((x.doc_id, x.text, x.source) for x in out.collect()) == Counter(want)


def test_no_documents_to_link(empty):
    assert minhash_dedup.link(empty).count() == 0


def test_line_dedup(spark, rows, docs, empty):
    out = line_dedup.dedup_lines(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    text = {(x.doc_id, x.source): x for x in out.collect()}
    assert len(text) == len({(i, s) for i, _, s in rows})
    old = {(i, s): t for i, t, s in rows}
    passage = rows[28][1].split("\n")[1]
    assert text[110, "s0"].text == old[110, "s0"]  # the first one stays
    for key in ((111, "s0"), (112, "s1")):
        assert passage[30:-30] not in text[key].text and text[key].words_deleted >= 50
    assert text[112, "s1"].text.startswith(old[112, "s1"][:40])
    assert text[100, "s0"].text == "" and text[103, "s2"].text == ""
    for k in (1, 2, 3, 4, 205, 300):
        key = next(x for x in old if x[0] == k)
        assert text[key].text == old[key] and text[key].n_deleted == 0
    assert text[200, "s0"].text is None and text[201, None].text == ""
    assert len(text[302, "s2"].text) < len(old[302, "s2"])
    assert line_dedup.dedup_lines(empty).count() == 0


def _repeated_lines(texts):
    """By the rule itself: places of the lines that lie in a run of 25 words or more that is also found before."""
    out, seen = [], set()
    for lines in texts:
        cut, n = set(), [len(x.split()) for x in lines]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(n[a:b]) >= 25:
                    run = tuple(x.strip() for x in lines[a:b])
                    if run in seen:
                        cut |= set(range(a, b))
                    seen.add(run)
        out.append(cut)
    return out


def test_line_dedup_finds_every_run_of_lines(spark):
    """Lines that are common on their own, in runs whose two-line parts first occur elsewhere; short lines and long ones."""
    import random

    r = random.Random(11)
    line = lambda n: prose(r, n).replace(".", "")
    a, b, c, d = (line(9) for _ in range(4))
    x, y = line(13), line(14)
    texts = [[line(40), a, b], [b, c, line(41)], [c, d, line(42)], [line(43), a, b, c, d], [line(44), a, b, c, d, line(45)]]
    texts += [[line(3), x, y, line(50)], [line(6), x, y, line(51)]] * 3  # two lines of 27 words between others
    pool = [line(r.choice([1, 2, 5, 8, 12, 20, 30])) for _ in range(14)]
    texts += [[r.choice(pool) for _ in range(r.randint(1, 14))] for _ in range(60)]
    want = _repeated_lines(texts)
    assert want[4] == {1, 2, 3, 4}
    docs = table(spark, [(k, "\n".join(t) + "\n", None) for k, t in enumerate(texts)])
    out = line_dedup.dedup_lines(docs, cut=r"(?<=\n)").collect()
    got = {x.doc_id: x for x in out}
    for k, t in enumerate(texts):
        assert got[k].text == "".join(x + "\n" for j, x in enumerate(t) if j not in want[k])
        assert got[k].n_lines == len(t) + 1 and got[k].n_deleted in (len(want[k]), len(want[k]) + 1)


def test_line_dedup_finds_passages_inside_sentences(spark):
    """A passage of 55 words between other words of one sentence, and with one word changed; names that clash; a long text."""
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("adeginorsty") for _ in range(6))
    some = lambda n: " ".join(word() for _ in range(n))
    passage = some(55).split(" ")
    changed = [*passage[:40], "other", *passage[41:]]
    texts = [" ".join([some(7), *passage, some(8)]), " ".join([some(9), *passage, some(5)]), " ".join([some(6), *changed, some(6)])]
    texts += [some(200_000) + " " + " ".join(passage), "\n".join(["a b c d e f g"] * 9)]
    docs = table(spark, [(k, t, "s0") for k, t in enumerate(texts)])
    docs = docs.selectExpr("*", "source AS row", "source AS th", "source AS cut", "1 AS made", "2 AS n_lines")
    got = {x.doc_id: x for x in line_dedup.dedup_lines(docs).collect()}
    assert got[0].text == texts[0] and got[0].row == got[0].th == got[0].cut == "s0" and got[0].made == 1
    runs = {tuple(passage[j : j + 25]) for j in range(31)}
    for k in (1, 2, 3):
        left = got[k].text.split()
        assert 25 <= got[k].words_deleted <= 55 and len(left) + got[k].words_deleted == len(texts[k].split())
        assert not any(tuple(left[j : j + 25]) in runs for j in range(len(left)))
    # runs that overlap in one text: of 18 pieces those from the third on lie in a later run
    assert got[4].text == "a b c d e f g\n" and got[4].n_deleted == 16


def test_line_dedup_fingerprints_are_no_common_short_lines(spark):
    """Documents that share short pieces only have no fingerprint in common, and white space doesn't change lines."""
    import random

    r = random.Random(8)
    word = lambda: "".join(r.choice("aeginorst") for _ in range(6))
    long = lambda: " ".join(word() for _ in range(6)) + ". "
    texts = ["".join(long() if j % 4 == 3 else r.choice(["and ", "a, ", "we stay. "]) for j in range(60)) for _ in range(30)]
    hashed = line_dedup._hashed(table(spark, [(k, t, None) for k, t in enumerate(texts)]), "text", line_dedup.CUT)
    prints = line_dedup._winnowed(line_dedup._windows(hashed))
    assert prints.filter("f IS NOT NULL").count() > 30
    assert prints.groupBy("f").count().filter("f IS NOT NULL AND count > 1").count() == 0
    one = ["One line here and\nanother, by me. End", "x and y z", "a\n\nb. c", "end d \n", ""]
    odd = ["\tOne  line here and\n another,  by me.  End", " x and \ty\x0b z", "a \n\r\nb.  c", "  end d \n", ""]
    at = lambda t: [(x.n_lines, x.at, x.h) for x in line_dedup._hashed(table(spark, [(k, y, None) for k, y in enumerate(t)]), "text", line_dedup.CUT).orderBy("doc_id").collect()]
    even, uneven = at(one), at(odd)
    assert even[0] == uneven[0] and even[2] == uneven[2] and even[3] == uneven[3] and even[4] == uneven[4]
    assert even[1][2] != uneven[1][2]  # after y stands no space there, so it is no place to cut


def test_top_k(spark):
    r = np.random.default_rng(2)
    x = (r.normal(size=(1500, 6)) / 3).astype(np.float32)
    x[100] = x[200]  # equal scores
    data = [(k, [float(v) for v in x[k]]) for k in range(1500)] + [(5000, None), (5050, [1.0, None, 0.0]), (5100, [math.inf] * 6), (5150, [math.nan] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    old = topk_search.SHARD_ROWS
    topk_search.SHARD_ROWS = 400
    try:
        got = {(a.query_id, a.rank): (a.vec_id, a.score) for a in topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    finally:
        topk_search.SHARD_ROWS = old
    q = np.floor(256 * x.astype(float)).astype(int)
    for k in range(0, 1500, 50):
        s = q @ q[k]
        order = sorted((i for i in range(1500) if i != k), key=lambda i: (-s[i], i))[:5]
        assert [got[k, n + 1] for n in range(5)] == [(i, s[i]) for i in order]
    assert len(got) == 150
    few = spark.createDataFrame(data[:3], "vec_id long, embedding array<float>")
    assert topk_search.top_k(few, F.col("vec_id") == 0).count() == 2
    assert topk_search.top_k(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_top_k_of_clustered_and_repeated_vectors(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 60), ("PIVOTS", 6), ("BLOCK_ROWS", 9)):
        monkeypatch.setattr(topk_search, name, value)
    r = np.random.default_rng(11)
    x = r.integers(-60, 60, (5, 6))[r.integers(0, 5, 900)] * 4 + r.integers(-9, 9, (900, 6))
    x[::3] = x[0]  # a third of the rows hold one vector
    x[40:50] = 0
    rows = [(k, [float(v) / 256 for v in x[k]]) for k in range(900)]
    got = {(a.query_id, a.rank): (a.vec_id, a.score) for a in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()}
    assert len(got) == 225
    for k in range(0, 900, 20):
        s = x @ x[k]
        order = sorted((i for i in range(900) if i != k), key=lambda i: (-s[i], i))[:5]
        assert [got[k, n + 1] for n in range(5)] == [(i, s[i]) for i in order]
    # an id that repeats: its candidates count each, and its rows as queries share a ranking
    twice = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    found = [(a.rank, a.vec_id) for a in topk_search.top_k(twice, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert found == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 2)]


def test_ppm(rows, docs, empty):
    k = lm_scoring.ORDER
    trie, tokens, seqs = [defaultdict(Counter) for _ in range(k + 1)], Counter(), []
    train = lambda i: i is None or i % 3 != 0
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        s = b"\xff" * k + b" ".join(w) + b"\xff"
        seqs.append((i, w, s))
        if train(i):
            tokens.update([*w, b""])
            for p in range(k, len(s)):
                for j in range(k + 1):
                    trie[j][s[p - j : p]][s[p]] += 1
    n, v = sum(tokens.values()), len(tokens)

    def code(s, p):
        gone, total = set(), 0.0
        for j in range(k, -1, -1):
            seen = {b: c for b, c in trie[j].get(s[p - j : p], {}).items() if b not in gone}
            size = 2 * sum(seen.values())
            if s[p] in seen:
                return total + math.log10((2 * seen[s[p]] - 1) / size)
            if seen:
                total += math.log10(len(seen) / size)
            gone |= set(seen)
        return total - math.log10(256 - len(gone))

    want = sorted((str(i), len(w) + 1, sum(tokens[x] > 0 for x in [*w, b""]), round(sum(math.log10((tokens[x] + 1) / (n + v + 1)) for x in [*w, b""]), 6), round(sum(code(s, p) for p in range(k, len(s))), 6)) for i, w, s in seqs)
    learn = F.col("doc_id").isNull() | (F.col("doc_id") % 3 != 0)
    got = sorted((str(x.doc_id), x.n_tokens, x.n_known, round(x.base_score, 6), round(x.score, 6)) for x in lm_scoring.score(docs, learn).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], atol=1e-5)
    assert lm_scoring.score(docs, F.lit(False)).filter("n_known <> 0").count() == 0
    assert lm_scoring.score(empty, F.lit(True)).count() == 0
