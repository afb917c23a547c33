import random

import pytest

WORDS = "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them".split()


def prose(r: random.Random, n: int) -> str:
    out = []
    while len(out) < n:
        sentence = [r.choice(WORDS) + r.choice(["", "s", "ing", "ed"]) for _ in range(r.randint(4, 11))]
        out += [sentence[0].capitalize(), *sentence[1:-1], sentence[-1] + "."]
    return " ".join(out[:n])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, m int, kept string, ids string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, "x", "y") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    """Texts with null, blank, long, repeated and nearly equal ones; ids with a null and a repeated row; null sources."""
    r = random.Random(3)
    base = [prose(r, r.randint(60, 160)) for _ in range(24)]
    out = [(k, t, f"s{k % 3}") for k, t in enumerate(base)]
    near = base[0].split(" ")
    out += [(100, base[0], "s0"), (101, base[0] + " tail", "s1"), (102, " ".join(["Other", *near[1:]]), None), (103, base[5], "s2")]
    passage = prose(r, 70)
    out += [(110, prose(r, 50) + "\n" + passage, "s0"), (111, passage + " " + prose(r, 40), "s0"), (112, prose(r, 30) + " " + passage + "\n" + prose(r, 30), "s1")]
    out += [(200, None, "s0"), (201, "", None), (202, " \n\t ", "s1"), (203, "word", "s2"), (204, "Word", "s2"), (205, "ein Wort mit ß und é", "s1"), (None, "no id but words here", "s0")]
    out += [(300, prose(r, 6000), "s1"), (301, "spam " * 400, "s1"), (302, "\n".join(["Same line again here."] * 40), "s2"), (303, "LOUD!! " * 80, "s0"), (304, "### $$$ word " * 60, "s0")]
    out += [(7, base[7], "s1")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return table(spark, rows).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])
