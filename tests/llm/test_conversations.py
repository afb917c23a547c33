"""Conversation repair against a plain DP over whole strings, and that against every possible edit."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from skyframe.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, at string, block int"
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
NEXT = {"0": "u", "s": "u", "u": "a", "a": "u"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        full = text.rstrip(BLANK)
        out.append("blank" if not full else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, repaired lines) by a DP that keeps whole strings; turns are put in one by one anywhere."""
    found = faults(rows)

    def put_in(cells):
        for _ in range(3):
            for s, (cost, audit, lines) in list(cells.items()):
                to = NEXT[s]
                new = (cost + 3, audit + "I", [*lines, ("user" if to == "u" else "assistant") + ":"])
                if to not in cells or new[:2] < cells[to][:2]:
                    cells[to] = new
        return cells

    cells = put_in({"0": (0, "", [])})
    for (_, role, text), fault in zip(rows, found):
        best = {}

        def take(s, new):
            if s not in best or new[:2] < best[s][:2]:
                best[s] = new

        for s, (cost, audit, lines) in cells.items():
            take(s, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if role[:1] == NEXT[s] or role[:1] == "s" and s == "0":
                take(role[:1], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            to = NEXT[s]
            take(to, (cost + 3 + more, audit + "R", [*lines, f"{'user' if to == 'u' else 'assistant'}:{text}"]))
        cells = put_in(best)
    return min((cells[s] for s in ("0", "a") if s in cells), key=lambda c: c[:2])


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = damaged([r for r in rows if r[0] == conv])
        found, turns = faults(own), [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, lines = brute(own)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [found.count(k) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversation(r, conv, n):
    text = lambda: r.choice(["Yes.", "No!", "Is it so?", "It breaks off", "", " \n", None, "Again.", f"Say {r.randint(0, 99)}."])
    return [(conv, r.choice([k, k, k, k + 1, None]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "USER", "umpire"]), text()) for k in range(n)]


def result(spark, tmp_path, rows):
    spark.createDataFrame([(*x, "x", 1) for x in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = C.op11_conversation_repair(spark, str(tmp_path)).collect()
    return {x["conv_id"]: tuple(x)[1:] for x in got}, len(got)


@pytest.mark.parametrize("bits", [C.BLOCK_BITS, 2])
def test_against_plain_dp(spark, tmp_path, monkeypatch, bits):
    """With blocks of four rows, conversations are put together from many of them."""
    monkeypatch.setattr(C, "BLOCK_BITS", bits)
    r = random.Random(7)
    rows = [x for c in range(120) for x in conversation(r, c if c else None, r.randint(1, 14))]
    rows += conversation(r, 500, 300) + [(501, 3, "user", "The same."), (501, 3, "user", "The same.")] * 40 + [(502, 0, "user", "x" * 300_000 + ".")]
    got, n = result(spark, tmp_path, rows)
    want = expected(rows)
    assert n == len(want) and got == want


def test_empty(spark, tmp_path):
    assert result(spark, tmp_path, [])[1] == 0


def test_all_dropped(spark, tmp_path):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got, _ = result(spark, tmp_path, [(conv, 0, "user", "Gone.")])
    assert got == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_plain_dp_against_all_edits():
    """Every string of edits of small conversations, checked and costed one by one."""
    r = random.Random(5)
    for _ in range(60):
        rows = [(k, r.choice(["system", "user", "assistant", "tool"]), r.choice(["Yes.", "No", "", "Oh."])) for k in range(r.randint(1, 4))]
        found, best = faults(rows), None
        for edits in itertools.product(["D", "K", "R"], repeat=len(rows)):
            for puts in itertools.product(range(3), repeat=len(rows) + 1):
                audit, cost, s, good = "", 0, "0", True
                for k, n in enumerate(puts):
                    for _ in range(n):
                        audit, cost, s = audit + "I", cost + 3, NEXT[s]
                    if k == len(rows):
                        break
                    e, first, fault = edits[k], rows[k][1][:1], found[k]
                    audit += e
                    cost += {"D": 4, "K": 0, "R": 3}[e] + (3 if e != "D" and fault == "truncated" else 0)
                    if e != "D":
                        good &= fault not in ("blank", "duplicate") and (e == "R" or first == NEXT[s] or first == "s" and s == "0")
                        s = NEXT[s] if e == "R" else first
                        if s not in NEXT:
                            good = False
                            break
                if good and s in ("0", "a") and (best is None or (cost, audit) < best):
                    best = (cost, audit)
        assert brute(rows)[:2] == best


def test_trail_compares_as_strings():
    r = random.Random(2)
    trail, nodes = C.Trail(), {(): 0}
    for _ in range(300):
        path = r.choice(list(nodes))
        label = r.choice("abc")
        nodes[*path, label] = trail.add(nodes[path], label)
    by_length = {}
    for p, n in nodes.items():
        by_length.setdefault(len(p), []).append((p, n))
    for same in by_length.values():
        for (p, a), (q, b) in itertools.product(same[:40], repeat=2):
            assert trail.before(a, b) == (p < q) and trail.same(a, b) == (p == q)
    trail.hash = [0] * len(trail.hash)  # all hashes collide: the labels decide
    for same in by_length.values():
        for (p, a), (q, b) in itertools.product(same[:20], repeat=2):
            assert trail.before(a, b) == (p < q) and trail.same(a, b) == (p == q)
