"""The prefix trie against plain loops, and tree contraction against recursion."""

import hashlib
import random
import zlib

import pytest

from engram.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t, role or "", text or ""))
    for v in own.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    members = {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        turns = [r[1:] for r in own.get(base, [])[:h]] + [r[1:] for r in v[h:]]
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append((c, d == len(turns)))
    least = {k: min(c for c, _ in v) for k, v in members.items()}
    kids = {k: 0 for k in members}
    leaves, saved = dict(kids), dict(kids)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, v in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(v) - 1) * len(k[-1][1]) if k else 0
    sha = lambda v: hashlib.sha256(",".join(map(str, sorted(c for c, end in v if end))).encode()).hexdigest()
    return sorted((least[k], len(k), least[k[:-1]] if k else None, len(v), kids[k], leaves[k], saved[k], sha(v)) for k, v in members.items())


def made(g, convs, longest):
    """Conversations of few turns, so that prefixes are shared, with nulls, ties and repeated rows."""
    rows = []
    for c in convs:
        for t in range(g.randrange(1, longest)):
            for _ in range(1 + (g.random() < 0.1)):
                rows.append((c, None if g.random() < 0.05 else t, g.choice(["user", "assistant", None, ""]) if g.random() < 0.2 else "user", g.choice([None, "", "a", "é日", "same text", "same  text"])))
    return rows


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def trie_of(df):
    return trie.prefix_trie(trie.rebuilt(df))


@pytest.fixture
def spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a conversation lies in several tasks
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_against_plain_loops(spark, spread):
    g = random.Random(2)
    rows = made(g, [*range(-5, 5), *range(95, 130), *range(203, 240), *range(1000, 1060)], 9)
    rows += [(700, t, "user", f"turn {g.randrange(9)}") for t in range(50)] + [(701, t, *r[2:]) for t, r in enumerate(rows[-50:])]
    rows += [(None, 0, "user", "no conversation")]
    assert result(trie_of(spark.createDataFrame(rows, SCHEMA).repartition(4))) == expected(rows)


def test_odd_tables(spark):
    assert trie_of(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(104, 0, "user", "x")]  # nothing is left of it: its first turn is borrowed from a conversation that is not there
    rows += [(300, None, None, None), (301, 0, "user", "word " * 300_000), (302, 0, "user", "word " * 300_000)]
    df = spark.createDataFrame([(*r, "d", 3, b"n") for r in rows], SCHEMA + ", digest string, n int, name binary")
    assert result(trie_of(df)) == expected(rows)


@pytest.mark.parametrize("shape", ["path", "random", "broom"])
def test_contraction_against_recursion(spark, shape):
    g = random.Random(4)
    n = 40
    parent = {i: {"path": i - 1, "random": g.randrange(i) if i else 0, "broom": i - 1 if i < 20 else 19}[shape] for i in range(1, n)}
    rows = [(f"{i:03}", f"{parent[i]:03}" if i else None, i + 1, 1) for i in range(n)]
    want = {f"{i:03}": [i + 1, 1] for i in range(n)}
    for i in range(n - 1, 0, -1):
        for k in (0, 1):
            want[f"{parent[i]:03}"][k] += want[f"{i:03}"][k]
    got = trie.contracted(spark.createDataFrame(rows, "name string, parent string, s long, t long"), ["s", "t"], rounds=40)
    assert {r["name"]: [r["s"], r["t"]] for r in got.collect()} == want


def test_hashes_are_associative():
    g = random.Random(1)
    digests = [g.randbytes(32) for _ in range(20)]

    def whole(ds):
        name = (0, 0)
        for d in ds:
            name = trie.joined(name, trie.turn_hash(d), 1)
        return name

    for cut in range(21):
        a, b = whole(digests[:cut]), whole(digests[cut:])
        assert trie.joined(a, b, 20 - cut) == whole(digests)
        assert trie.without(whole(digests), a, 20 - cut) == b
        assert trie.unpacked(trie.packed(a)) == a


def test_rounds_grow_with_branches_not_with_turns(spark, monkeypatch):
    g = random.Random(9)
    rows = [(c, t, "user", f"turn {g.random()}") for c in (0, 1, 2) for t in range(120)] + [(100, t, "user", f"turn {t}") for t in range(60)] + [(101, t, "user", f"turn {t}") for t in range(61)]
    folders = []
    monkeypatch.setattr(trie, "new_folder", lambda s, name, f=trie.new_folder: folders.append(name) or f(s, name))
    assert result(trie_of(spark.createDataFrame(rows, SCHEMA))) == expected(rows)
    assert folders.count("live") <= 5  # a long conversation is one path


def test_rest_of_a_path_in_several_tasks(spark, spread):
    g = random.Random(3)
    rows = [(c, d, f"{c}:{d}", g.randrange(9), g.randrange(9)) for c, n in ((7, 500), (8, 1), (9, 3), (-1, 40)) for d in range(n)]
    got = trie.rest_of_path(spark.createDataFrame(rows, "conv_id long, depth long, name string, s long, t long").repartition(4), ["s", "t"])
    want = {name: tuple(sum(r[k] for r in rows if r[0] == c and r[1] >= d) for k in (3, 4)) for c, d, name, *_ in rows}
    assert {r["name"]: (r["s"], r["t"]) for r in got.collect()} == want
