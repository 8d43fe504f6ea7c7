"""Formulas and rules on graphs made by hand, and odd inputs."""

import math

from pyspark.sql import functions as F

from engram.functions import formulas
from engram.operators import consolidate, dedup, graph, joins, ranking, sets, versions, windows

EDGE = "id string, source_id string, target_id string, type string, weight double"


def edges(spark, *rows, type="LEADS_TO"):
    return spark.createDataFrame([(f"{a}>{b}", a, b, type, float(w)) for a, b, w in rows], EDGE)


def test_spread_keeps_the_best_way(spark):
    e = edges(spark, ("a", "b", 0.9), ("b", "c", 0.8), ("a", "c", 0.3), type="IS_A")
    got = {r["node_id"]: (round(r["level"], 6), r["hop"]) for r in graph.spread(spark.createDataFrame([("q", "a", 1.0)], "query_id string, node_id string, level double"), graph.walkable(e), max_hops=3, decay=0.9, min_level=0.1).collect()}
    assert got == {"a": (1.0, 0), "b": (0.81, 1), "c": (round(0.81 * 0.72, 6), 2)}


def test_ppr_sums_to_its_seeds(spark):
    e = edges(spark, ("a", "b", 0.5), ("b", "a", 0.5), ("b", "c", 0.5))
    got = {r["node_id"]: r["score"] for r in graph.ppr(spark.createDataFrame([("q", "a", 1.0)], "query_id string, node_id string, mass double"), e, rounds=40, eps=1e-12).collect()}
    assert max(got.values()) == 1.0 and got["a"] > got["b"] > got["c"] > 0


def test_causal_chain_stops_at_cycles(spark):
    e = edges(spark, ("a", "b", 0.9), ("b", "c", 0.4), ("c", "a", 0.9))
    got = {r["node_id"]: (r["depth"], round(r["confidence"], 6)) for r in graph.causal_chain(spark.createDataFrame([("a",)], "node_id string"), e, max_depth=5).collect()}
    assert got == {"b": (1, 0.9), "c": (2, 0.6)}


def test_two_triangles(spark):
    e = edges(spark, ("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("c", "d", 1), ("d", "e", 1), ("e", "f", 1), ("f", "d", 1))
    got = {r["node_id"]: (r["triangles"], round(r["coefficient"], 4)) for r in graph.clustering_coefficient(e).collect()}
    assert got["a"] == (1, 1.0) and got["c"] == (1, round(1 / 3, 4)) and len(got) == 6


def test_neighbors_are_asymmetric(spark):
    e = edges(spark, ("a", "b", 0.9)).union(edges(spark, ("c", "b", 0.9), type="CO_OCCURS"))
    f = spark.createDataFrame([("b",)], "node_id string")
    near = lambda d: {r["neighbor_id"] for r in joins.neighbors(f, e, direction=d).collect()}
    assert near("both") == {"a", "c"} and near("in") == {"c"} and near("out") == set()


def test_leaders_differ_from_components(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (6, 7)], "id_a long, id_b long")
    got = {r["id"]: r["leader"] for r in dedup.leaders(pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 6: 6, 7: 6}
    assert dedup.leaders(pairs.limit(0)).count() == 0


def test_near_duplicates_of_hashes(spark):
    rows = [(1, 0), (2, 0), (3, 0b111), (4, 0b1111), (5, -1), (6, -1 - (1 << 40))]
    got = {(r["id_a"], r["id_b"]): r["bits"] for r in dedup.near_duplicate_pairs(spark.createDataFrame(rows, "id long, hash long")).collect()}
    assert got == {(1, 2): 0, (1, 3): 3, (2, 3): 3, (3, 4): 1, (5, 6): 1}


def test_simhash_of_blank_is_zero(spark):
    df = spark.createDataFrame([(1, None), (2, "  "), (3, "ab"), (4, "A  b"), (5, "a b")], "id long, text string")
    got = {r["id"]: r["h"] for r in df.select("id", dedup.simhash("text").alias("h")).collect()}
    assert got[1] == got[2] == 0 and got[3] != 0 and got[4] == got[5]


def test_ema_equals_a_fold(spark):
    values = [1.0, 0.0, 1.0, 1.0, 0.0, 1.0]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, i int, v double")
    alpha, want = 2 / 5, values[2]
    for v in values[3:]:
        want = alpha * v + (1 - alpha) * want
    assert abs(windows.ema(df, by="g", order=[F.col("i")], value=F.col("v"), window=4).head()["ema"] - want) < 1e-12


def test_lateral_inhibition_leaves_few_alone(spark):
    rows = [("q", f"n{i:02}", 1 - i / 100, "s") for i in range(20)] + [("p", "x", 0.1, "s")]
    got = ranking.lateral_inhibition(spark.createDataFrame(rows, "query_id string, node_id string, level double, source string")).collect()
    by = {(r["query_id"], r["node_id"]): r["level"] for r in got}
    assert by["p", "x"] == 0.1 and by["q", "n09"] == 0.91 and abs(by["q", "n10"] - 0.27) < 1e-9 and len(got) == 21


def test_snapshot_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "id int, v string")
    assert {(r["id"], r["change"]) for r in sets.snapshot_diff(a, b, key="id", values=["v"]).collect()} == {(1, "removed"), (2, "modified"), (4, "added")}


def test_merge_deletes_win(spark):
    s = "entity_id string, sequence long, operation string, weight double"
    a = versions.latest_changes(spark.createDataFrame([("x", 1, "insert", 0.1), ("x", 2, "update", 0.4), ("y", 3, "delete", 0.9)], s))
    b = versions.latest_changes(spark.createDataFrame([("x", 1, "insert", 0.3), ("y", 5, "update", 0.2), ("z", 1, "insert", 0.5)], s))
    assert {(r["entity_id"], r["operation"], r["weight"]) for r in versions.merge_changes(a, b).collect()} == {("x", "upsert", 0.4), ("y", "delete", None), ("z", "upsert", 0.5)}


def test_replay_is_closed_form(spark):
    e = edges(spark, ("a", "b", 0.5), ("a", "c", 0.5))
    m = spark.createDataFrame([("f1", "a"), ("f1", "b"), ("f2", "a"), ("f2", "b")], "fiber_id string, neuron_id string")
    got = {r["id"]: r["weight"] for r in consolidate.replay(e, m).collect()}
    assert abs(got["a>b"] - 0.5 * 1.1**2) < 1e-12 and abs(got["a>c"] - 0.5 * 0.98**2) < 1e-12


def test_formulas(spark):
    r = spark.range(1).select(
        formulas.synapse_time_decay(F.lit(1.0), F.lit(0), F.lit(1440.0)).alias("half"), formulas.synapse_time_decay(F.lit(1.0), F.lit(10), F.lit(1e6)).alias("floor"),
        formulas.retention(F.lit(0), F.lit(30.0)).alias("r"), formulas.heat(F.lit(0.0), F.lit(40.0), F.lit(10.0)).alias("heat"), formulas.neuron_decay(F.lit(1.0), F.lit(0.1), F.lit(10.0)).alias("d"),
    ).head()
    assert abs(r["half"] - 0.5) < 1e-12 and abs(r["floor"] - 0.8) < 1e-12 and r["r"] == 0.5 and abs(r["heat"] - 1) < 1e-12 and abs(r["d"] - math.exp(-1)) < 1e-12


def test_empty_inputs(spark):
    none = edges(spark, ("a", "b", 1)).limit(0)
    nodes = spark.createDataFrame([], "query_id string, node_id string, level double")
    assert graph.spread(nodes, graph.walkable(none)).count() == 0
    assert graph.clustering_coefficient(none).count() == 0
    assert joins.neighbors(nodes, none).count() == 0
    assert consolidate.transitive_links(none).count() == 0
