"""Set joins, decisions, greedy clusters and priming against plain loops."""

import random
from datetime import datetime

import pytest

from engram.operators import decisions, priming, setjoin, smart_merge
from engram.streaming import logs


def made(g, n, members):
    """Sets with rare and very frequent members, many of them equal."""
    sets = {f"g{i:03}": {f"m{min(int(g.expovariate(0.25)), members)}" for _ in range(g.randrange(1, 7))} for i in range(n)}
    return sets | {f"h{i}": {"m0"} for i in range(6)} | {"z": {f"m{i}" for i in range(members)}}


@pytest.mark.parametrize("least", [0.2, 0.75])
def test_pairs_of_sets(spark, least):
    sets = made(random.Random(int(least * 100)), 60, 20)
    rows = [(k, m) for k, v in sets.items() for m in v] * 2
    df = spark.createDataFrame(rows, "fiber_id string, k string")
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and jaccard(a, b) >= least}
    got = setjoin.overlap_pairs(df, key="k", min_jaccard=least).collect()
    assert {(r["a"], r["b"]): r["shared"] for r in got} == want and len(got) == len(want)
    left, right = df.filter("fiber_id < 'g030'"), df.filter("fiber_id >= 'g020'")
    got = setjoin.overlap_between(left, right, key="k", group="fiber_id", min_jaccard=least).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got})
    assert {(r["a"], r["b"]) for r in got} == {(a, b) for a in sets for b in sets if a < "g030" and b >= "g020" and jaccard(a, b) >= least}


def test_decisions_that_overlap(spark):
    schema = "id string, chosen string, rejected array<string>, tags array<string>"
    old = [("same", "Use Redis", ["Memcached"], ["cache"]), ("against", "Memcached", ["Use Redis"], ["Cache", "infra"]), ("far", "Tabs", ["Spaces"], ["style"]), ("tags", "Kafka", None, ["cache", "infra"]), ("empty", None, None, None)]
    new = [("new", "use redis", ["memcached"], ["cache", "infra"]), ("none", None, None, None)]
    got = {(r["id"], r["old_id"]): (round(r["score"], 4), r["relation"], r["rank"]) for r in decisions.decision_overlap(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)).collect()}
    assert got == {("new", "against"): (1.0, "contradicts", 1), ("new", "same"): (0.8, "confirms", 2), ("new", "tags"): (0.4, "evolves", 3)}


def greedy(n, near):
    leader = {}
    for i in range(n):
        if i not in leader:
            free = [j for j in near.get(i, []) if j != i and j not in leader]
            if free:
                leader |= {j: i for j in [i, *free]}
    return leader


@pytest.mark.parametrize("seed", [1])
def test_greedy_clusters(spark, seed):
    g = random.Random(seed)
    n = 16
    near = {i: g.sample(range(n), g.randrange(4)) + ([0] if i > 9 else []) for i in range(n)}
    df = spark.createDataFrame([(i, j) for i, js in near.items() for j in js], "id long, other long")
    got = smart_merge.greedy_clusters(spark.range(n), df)
    assert {r["id"]: r["leader"] for r in got.collect()} == greedy(n, near)


def test_merged_texts(spark):
    nodes = spark.createDataFrame([(1, "One. Two", 5.0, 0.5), (2, "Two. Three. Four", None, None), (3, "Four. Five", 9.0, 0.1), (4, "alone", 1.0, 1.0), (5, "x" * 30, 9.0, 0.9), (6, "y", 1.0, 0.1)], "id long, content string, priority double, activation double")
    near = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.85), (2, 1, 0.9), (4, 1, 0.5), (5, 6, 0.99)], "id long, other long, sim double")
    got = {r["anchor_id"]: (r["members"], r["content"]) for r in smart_merge.smart_merge(nodes, near, most_chars=20).collect()}
    assert got == {1: (3, "One. Two. Three. ..."), 5: (2, "x" * 17 + "...")}


HISTORY = [(1, 0, "a", 1.0), (1, 1, "b", 0.5), (1, 3, "a", 0.2), (1, 3, "c", 0.01), (2, 0, "a", 0.9)]


def cached(rows):
    last = {s: max(t for x, t, _, _ in rows if x == s) for s, *_ in rows}
    out = {}
    for s, t, n, level in rows:
        out[s, n] = max(out.get((s, n), 0), level * 0.7 ** (last[s] - t))
    return {k: round(v, 9) for k, v in out.items() if v >= 0.01}


def test_cache_and_boosts(spark):
    f = spark.createDataFrame
    cache = priming.activation_cache(f(HISTORY, "session_id long, turn int, node_id string, level double"))
    assert {(r["session_id"], r["node_id"]): round(r["level"], 9) for r in cache.collect()} == cached(HISTORY)
    sessions = f([(1, 5, 2.0), (2, 1, 1.0)], "session_id long, queries int, aggressiveness double")
    topics = f([(1, "redis", 0.8), (1, "kafka", 0.4), (2, "redis", 0.9)], "session_id long, topic string, ema double")
    nodes = f([("r", "redis cache", False), ("q", "queue work", True), ("k", "kafka", False)], "node_id string, content string, abstract boolean")
    habits = f([("redis", "queue", 0.7), ("kafka", "redis", 0.9), ("redis", "kafka", 0.5)], "topic string, next_topic string, weight double")
    together = f([("x", "y", 3, 0.9), ("x", "z", 2, 0.9), ("x", "w", 9, 0.4)], "a string, b string, count int, strength double")
    recent = f([(1, "x"), (2, "x"), (2, "y")], "session_id long, node_id string")
    none = cache.limit(0)
    got = {(r["session_id"], r["node_id"]): round(r["boost"], 6) for r in priming.priming_boosts(sessions, topics, nodes, habits, together, recent, none).collect()}
    assert got == {(1, "r"): round(0.15 * 0.8 * 2, 6), (1, "q"): round(0.12 * 0.7 * 1.25 * 2, 6), (1, "y"): round(0.1 * 0.9 * 2, 6)}
    anchors = f([(1, "r", 0.9), (1, "s", 0.2)], "session_id long, node_id string, level double")
    boosts = f([(1, "r", 0.3), (1, "t", 0.1)], "session_id long, node_id string, boost double")
    assert {(r["node_id"], round(r["level"], 6)) for r in priming.primed(anchors, boosts).collect()} == {("r", 1.0), ("s", 0.2), ("t", 0.1)}


def test_cache_stream_is_the_batch(spark, tmp_path):
    schema = "session_id long, turn int, node_id string, level double, ts timestamp"
    rows = [(*r, datetime(2024, 1, 1, 0, r[1])) for r in HISTORY]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = logs.activation_cache_stream(stream).writeStream.format("memory").queryName("cache_stream").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    rows = spark.sql("SELECT * FROM cache_stream").collect()
    newest = {s: max(r["turn"] for r in rows if r["session_id"] == s) for s in (1, 2)}
    assert {(r["session_id"], r["node_id"]): round(r["level"], 9) for r in rows if r["turn"] == newest[r["session_id"]]} == cached(HISTORY)
