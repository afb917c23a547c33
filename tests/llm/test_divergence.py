"""Source divergence against plain Python integers."""

import random
import re
from collections import Counter, defaultdict

import pytest

from skyframe.llm import source_divergence as D

TERM = re.compile(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    docs, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = TERM.findall((text or "").translate(LOW))
        docs[lang or ""].update(set(words))
        count[lang or "", source or ""].update(words)
    out = []
    for lang, source in count:
        kept = [t for t, n in docs[lang].items() if n >= 10]
        p = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        own, whole = p(count[lang, source]), p(sum((c for (x, _), c in count.items() if x == lang), Counter()))
        f = lambda t, a, b: (a[t] - b[t]) ** 2 // (a[t] + b[t])
        pair = [(s, sum(f(t, own, q) for t in kept)) for x, s in count if x == lang and s != source for q in [p(count[x, s])]]
        term = [(t, f(t, own, whole)) for t in kept if count[lang, source][t] > 0 and own[t] > whole[t]]
        for part, items, most in (("pair", pair, None), ("term", term, 10)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def corpus(seed, n, vocabulary):
    r = random.Random(seed)
    words = [f"w{''.join(r.choice('abcdefghij') for _ in range(3))}" for _ in range(vocabulary)] + ["É", "é", "Straße", "ÀB", "x"]
    rows = []
    for _ in range(n):
        k = int(r.paretovariate(0.7)) % 60
        text = " ".join(words[min(int(r.paretovariate(0.6)), len(words)) - 1].title() for _ in range(k)) + r.choice(["", "1", ".x", "-ÉÉ"])
        rows.append((r.choice(["en", "en", "de", None]), r.choice(["a", "a", "a", "b", "c", "é", None, ""]), text))
    return rows + [("en", "silent", "12 34"), ("xx", "one", "too few"), ("xx", "two", None), ("en", "a", "long " * 200_000 + "tail")] + rows[:3]


def table(spark, rows):
    return spark.createDataFrame([(i, *x, 1, "y") for i, x in enumerate(rows)], "doc_id long, lang string, source string, text string, n long, term string").repartition(3)


@pytest.mark.parametrize("small", [False, True])
def test_against_plain_python(spark, monkeypatch, small):
    """Also with small blocks, tiles and dictionaries, so that several of each meet."""
    if small:
        for name, value in (("BLOCK_BITS", 6), ("RARE", 3), ("TILE", 2), ("ENTRIES", 50), ("PIECE", 100)):
            monkeypatch.setattr(D, name, value)
    rows = corpus(3, 900, 300)
    assert sorted(tuple(x) for x in D.audit(table(spark, rows)).collect()) == brute(rows)


def test_empty(spark):
    assert D.audit(table(spark, [])).count() == 0


def test_levels_against_a_loop():
    r = random.Random(1)
    for _ in range(20):
        counts = [{b: int(r.paretovariate(0.8)) for b in r.sample(range(4096), r.randint(0, 1500))} for _ in range(2)]
        totals = [sum(c.values()) + r.randint(0, 9) for c in counts]
        made = [D.Levels(D.np.array([*c], "int64"), D.np.array([*c.values()], "int64"), t, 4000) for c, t in zip(counts, totals)]
        want = 0
        for b in range(4096):
            p, q = (D.probability(c.get(b, 0), t, 4000) for c, t in zip(counts, totals))
            want += (p - q) ** 2 // (p + q)
        assert D.divergence(*made, 4096) == want
