"""License scans against plain Python, and on notices that are cut, changed or repeated."""

import random
import re

from skyframe.llm import license_scan as L

from .conftest import prose, table

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LISTED = [(x, t.split(), True) for t, x in L.PHRASES.items()] + [(x, t.split(), False) for x, t in L.NOTICES]
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = WORD.findall((text or "").translate(LOW))
    places, base, labels, score = [], set(), set(), 0.0
    for label, t, is_base in LISTED:
        k = min(3, len(t))
        runs = len(t) - k + 1
        votes = {}
        for i in range(len(words) - k + 1):
            for j in range(runs):
                if words[i : i + k] == t[j : j + k]:
                    votes.setdefault(i - j, set()).add((i, j))
        for d, own in votes.items():
            near = own if is_base else set().union(*(v for e, v in votes.items() if abs(e - d) <= 8))
            share = len({j for _, j in near}) / runs
            score = max(score, share)
            if is_base and share == 1:
                places.append(d)
                base.add(label)
                labels.add(label)
            if not is_base and share >= 0.7 and 2 * (max(i for i, _ in near) + k - min(i for i, _ in near)) <= 3 * len(t):
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def texts():
    r = random.Random(4)
    notices = [t for t, _ in L.PHRASES.items()] + [t for _, t in L.NOTICES]
    out = [None, "", " \n", "CC BY", "cc-by cc_by, CC: BY", "All rights", "ALL RIGHTS RESERVED. All rights reserved", "İcc by KeyK", "é" * 50, "cc by " * 4000]
    for n in notices:
        w = n.split()
        out += [n, n.title(), prose(r, 30) + "\n" + n.upper() + ". " + prose(r, 20)]
        out.append(" ".join(w[: max(1, int(len(w) * 0.75))]))
        out.append(" ".join(x for k, x in enumerate(w) if k != len(w) // 2))
        out.append(" ".join([*w[: len(w) // 2], "put", "in", *w[len(w) // 2 :], *w]))
        out.append(" ".join(r.sample(w, len(w))))
    return out + [prose(r, 400) for _ in range(5)]


def test_against_plain_python(spark):
    rows = [(k if k % 7 else None, t, "s") for k, t in enumerate(texts())] + [(3, "CC BY", "s")] * 3
    docs = table(spark, rows).repartition(3).withColumnsRenamed({"m": "labels", "kept": "score"})
    got = L.scan(docs)
    assert {"lang", "source", "n_chars", "ids"} <= {*got.columns} and len(got.columns) == len({*got.columns})
    key = lambda x: tuple(str(v) for v in x)
    found = sorted((tuple(x) for x in got.select("doc_id", *L.FIELDS).collect()), key=key)
    assert found == sorted(((i, *brute(t)) for i, t, _ in rows), key=key)


def test_words_put_in_keep_the_label(spark):
    notice = next(t for x, t in L.NOTICES if x == "mit" and len(t) > 80).split()
    changed = " ".join([*notice[:10], "truly", *notice[10:20], *notice[21:]])
    assert L.scan(table(spark, [(1, changed, "s")]), keep=["doc_id"]).first()["labels"] == "mit"


def test_empty(spark, empty):
    assert L.scan(empty).count() == 0


def test_no_python_on_the_way(spark, docs):
    plan = L.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "BroadcastHashJoin" in plan and "NestedLoop" not in plan
