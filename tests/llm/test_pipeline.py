"""Each stage of the pipeline, and all of it, against plain Python; ids are repeated and null, texts null and blank."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
import xxhash
from skyframe.llm import bpe, mixing

from .conftest import prose, table
from .test_corpus import _components, _sets

GAP = re.compile(r"[ \t-\r]+")


def _words(t):
    return [x for x in GAP.split(t or "") if x]


def _id_order(row):
    """Ids with null first; texts of one id by hash."""
    h = xxhash.xxh64(row[1].encode(), seed=42).intdigest() if row[1] is not None else 42
    return row[0] is not None, row[0] or 0, h - (h >> 63 << 64)


def _good(row):
    t, w = row[1] or "", _words(row[1])
    n, chars = len(w), sum(map(len, w))
    lines = [x for x in t.split("\n") if _words(x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    repeats = len({i + k for i in range(n - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)})
    upper, lower = len(re.findall("[A-Z]", t)), len(re.findall("[a-z]", t))
    again = len(lines) >= 4 and 10 * (len(lines) - len(set(lines))) > 3 * len(lines)
    return not (n < 50 or 2 * repeats > n or 10 * sum(c in "#*$%&|<>" for c in t) > n or upper > lower or again or not 2 * n <= chars <= 15 * n or 5 * t.count("!") > n)


def _without_repeats(rows):
    seen, left = set(), {}
    for key in sorted({_id_order(x): x[1] for x in rows if x[1]}.items()):
        lines = re.split(r"(?<=\n)|(?<=[.!?,;:dy] )", key[1])
        at = [k for k, x in enumerate(lines) if _words(x)]
        cut = set()
        for a in range(len(at)):
            run, n = (), 0
            for b in range(a, len(at)):
                run, n = (*run, " ".join(_words(lines[at[b]]))), n + len(_words(lines[at[b]]))
                if n >= 25:
                    if run in seen:
                        cut |= {k for j in range(a, b + 1) for k in range(at[j], [*at, len(lines)][j + 1])}
                    seen.add(run)
        left[key[0]] = "".join(x for k, x in enumerate(lines) if k not in cut)
    out = [(i, left.get(_id_order((i, t, s)), t), s, t) for i, t, s in rows]
    return [x[:3] for x in out if x[1] == x[3] or _words(x[1])]


def _one_of_each(rows):
    sets = _sets(rows, 5)
    names = [(k, s) for k, (_, s) in enumerate(sets)]
    groups = {}
    for k, g in _components(names).items():
        groups.setdefault(g, []).append(rows[k])
    best = lambda g: min(g, key=lambda x: (x[0] is None, _id_order(x), x[2] is not None, x[2] or ""))
    return [x for g in groups.values() for x in (g if not _words(g[0][1]) else [best(g)])]


def _rows(df):
    return Counter((x.doc_id, x.text, x.source) for x in df.collect())


@pytest.fixture(scope="module")
def corpus(rows):
    r = random.Random(21)
    more = [prose(r, r.randint(55, 90)) for _ in range(6)]
    out = [*rows, (None, more[0], "s1"), (None, more[1], None), (None, more[1], "s0"), (400, more[2], "s0"), (400, more[3], "s1"), (401, more[3], "s2")]
    return out + [(402, more[4] + "\n\n" + rows[3][1], "s0"), (402, more[4] + "\n\n" + rows[3][1], "s0"), (None, None, None), (403, "", "s2")]


@pytest.mark.parametrize("name", ["quality_rules", "line_dedup", "minhash_dedup"])
def test_stage(spark, corpus, name):
    brute = {"quality_rules": lambda x: list(filter(_good, x)), "line_dedup": _without_repeats, "minhash_dedup": _one_of_each}[name]
    docs = table(spark, corpus).repartition(3)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    assert out.columns == docs.columns and _rows(out) == Counter(brute(corpus))


def _ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    return {t: library.encode(t or "", add_special_tokens=False).ids for t in texts}


def test_all_stages(spark, corpus, tmp_path):
    table(spark, corpus).drop("kept", "ids").write.parquet(f"{tmp_path}/documents.parquet")
    left = _one_of_each(_without_repeats(list(filter(_good, corpus))))
    taken = {(x.doc_id, x.source): x.taken // x.size for x in mixing.mix(table(spark, left)).collect() if x.size}
    alone = Counter((i, s) for i, _, s in left)
    out = [(x.doc_id, x.source, tuple(x.ids)) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    ids = _ids({t for _, t, _ in left})
    known = Counter((i, s, tuple(ids[t])) for i, t, s in left)
    times = Counter(out)
    assert times and all(known[k] and n <= 2 * known[k] for k, n in times.items())
    assert all(times[i, s, tuple(ids[t])] == taken[i, s] for i, t, s in left if alone[i, s] == 1)
