"""Conversation repair against a plain search over edits, and the auction against a plain shortest path."""

import hashlib
import random
import re
import zlib

import pytest

from engram.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
BAD = (10**9, "~")


def damage(rows):
    out, ids = {}, []
    for c, t, role, text in rows:
        out.setdefault(c, [])
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out[c] += [(t, role, text)] * (2 if fate == 3 else 1)
        ids.append(c)
    return out


def cheapest(codes):
    """(cost, audit), least by cost and then by letters, by the plain recursion from the end."""
    due = {"0": "u", "s": "u", "u": "a", "a": "u"}
    best = {"0": (0, ""), "a": (0, ""), "s": BAD, "u": BAD}

    def inserts(b):
        for _ in range(3):
            b = {q: min(b[q], (2 + b[due[q]][0], "I" + b[due[q]][1])) for q in b}
        return b

    best = inserts(best)
    for role, cut, forced in reversed(codes):
        new = {}
        for q in best:
            options = [(3 + best[q][0], "D" + best[q][1])]
            if not forced:
                if (role == "s" and q == "0") or (role == "u" and q in "0sa") or (role == "a" and q == "u"):
                    options.append((cut + best[role][0], "K" + best[role][1]))
                options.append((2 + cut + best[due[q]][0], "R" + best[due[q]][1]))
            new[q] = min(options)
        best = inserts(new)
    return best["0"]


def expected(rows):
    found = []
    for c, after in damage(rows).items():
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, codes, counts = set(), [], [0, 0, 0]
        for _, role, text in after:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            codes.append((role[:1], fault == 2, fault in (0, 1)))
        turns = [t for t, _, _ in after if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:], strict=False))
        cost, audit = cheapest(codes)
        said, at, last = [], 0, ""
        for e in audit:
            role, text = ("", "") if e == "I" else after[at][1:]
            at += e != "I"
            if e == "D":
                continue
            if e in "IR":
                role = "assistant" if last == "u" else "user"
            last = role[:1]
            said.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in said))
        found.append((c, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(found, key=str)


def made(g, convs, longest):
    rows = []
    for c in convs:
        for t in range(g.randrange(1, longest)):
            role = g.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]) if g.random() < 0.4 else ("user", "assistant")[t % 2]
            text = g.choice(["", None, " \t\n", "Hello.", "Hello?", "No end", "Same. ", "Long text. Here!\n", "é 日本."]) if g.random() < 0.5 else f"Text {g.randrange(50)}" + g.choice(".!?") * g.randrange(2)
            rows.append((c, None if g.random() < 0.05 else t + (g.random() < 0.1), role, text))
    return rows


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_repair_against_brute_force(spark):
    rows = made(random.Random(1), [None, *range(-3, 250)], 12)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(repair.repair_report(repair.damaged(df))) == expected(rows)


@pytest.mark.parametrize("segment, fan", [(3, 2), (5, 3)])
def test_long_conversations_by_segments(segment, fan, spark, monkeypatch):
    g = random.Random(segment)
    rows = made(g, [7], 2) + [(7, t, *r[2:]) for t, r in enumerate(made(g, range(60), 12))] + made(g, range(20, 40), 9)
    rows += [(8, 3, "user", "Again and again.")] * 40
    want = expected(rows)
    monkeypatch.setattr(repair, "FAN", fan)
    audit = next(w for w in want if w[0] == 7)
    codes = next(codes for c, codes in codes_of(rows) if c == 7)
    parts = [codes[i : i + segment] for i in range(0, len(codes), segment)]
    costs = [repair.segment_costs(p, i == len(parts) - 1) for i, p in enumerate(parts)]
    state, said = 0, ""
    for i, (p, ends) in enumerate(zip(parts, repair.borders(costs, repair.ENDS), strict=True)):
        edits, state = repair.traced(p, tuple(ends), i == len(parts) - 1)[state]
        said += edits
    assert said == audit[7]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the conversation lies in several tasks
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        assert result(repair.repair_report(repair.damaged(df))) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def codes_of(rows):
    for c, after in damage(rows).items():
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, codes = set(), ""
        for _, role, text in after:
            bare = text.strip(" \t\n\x0b\x0c\r")
            code = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if not bare or (role, text) in seen else code if bare[-1] in ".!?" else code.upper()
            seen.add((role, text))
        yield c, codes


def test_auction_against_plain_shortest_paths():
    g = random.Random(5)
    for _ in range(300):
        codes = "".join(g.choice("suaoxSUAO") for _ in range(g.randrange(0, 14)))
        arcs, prices = repair.priced(repair.lattice(codes, True), repair.ENDS)
        dist = [repair.INF] * len(arcs)
        dist[-1] = 0
        for _ in range(len(arcs)):
            for i, out in enumerate(arcs):
                for _, j, cost in out:
                    dist[i] = min(dist[i], cost + dist[j])
        assert prices[0] == dist[0]
        assert all(p in (repair.INF, d) for p, d in zip(prices, dist, strict=True))
        plain = [(c.lower(), c.isupper(), c == "x") for c in codes]
        edits, _ = repair.traced(codes, repair.ENDS, True)[0]
        assert (dist[0], edits) == cheapest(plain)


def test_repaired_rows_and_odd_tables(spark):
    rows = made(random.Random(9), range(30), 8)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", digest string, part int")
    want = {w[0]: w for w in expected(rows)}
    texts = {}
    for r in sorted(repair.repaired(repair.damaged(df)).collect(), key=lambda r: (r["conv_id"], r["place"])):
        texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(texts.get(c, [])).encode()).hexdigest() for c in want} == {c: w[8] for c, w in want.items()}
    assert repair.repair_report(repair.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
    long = [(1, 0, "user", "word " * 300_000 + "."), (1, 1, "assistant", "x" * 2_000_000)]
    assert result(repair.repair_report(repair.damaged(spark.createDataFrame(long, SCHEMA)))) == expected(long)
