"""Shorter texts by tier, and parts of brains moved."""

from engram.operators import compression
from engram.operators.transplant import Brain, transplant

TEXT = 'Start here. Dr. Smith met Alice in Paris. Nothing at all happened then. Bob said no! "Quoted" by Alice and Bob. A dull one. Another dull one.'


def test_tiers(spark):
    rows = [(f"t{d}{h}{z}", TEXT, 200 - d, 0, h, z) for d, h, z in ((3, 0.0, False), (10, 0.0, False), (40, 0.0, False), (100, 0.0, False), (190, 0.0, False), (190, 0.6, False), (190, 0.9, False), (190, 0.0, True))]
    m = spark.createDataFrame(rows, "id string, content string, created_day int, tier int, heat double, frozen boolean")
    names = spark.createDataFrame([(r[0], n) for r in rows for n in ("Alice", "Bob", "Dr. Smith", "")], "id string, name string")
    out = compression.compress(m, names, as_of=200)
    got = {r["id"]: (r["tier"], r["content"], r["backup"] == TEXT) for r in out.collect()}
    best = 'Start here. Dr. Smith met Alice in Paris. Nothing at all happened then. Bob said no! "Quoted" by Alice and Bob.'
    assert got == {
        "t100.0False": (1, best, True), "t400.0False": (2, 'Dr. Smith met Alice in Paris. Bob said no! "Quoted" by Alice and Bob.', True), "t1000.0False": (3, "Alice related_to Bob; Bob related_to Dr. Smith", False),
        "t1900.0False": (4, "", False), "t1900.6False": (3, "Alice related_to Bob; Bob related_to Dr. Smith", False), "t1900.9False": (1, best, True),
    }
    new = compression.applied(m, out)
    assert compression.compress(new, names, as_of=200).collect() == []  # a second run changes nothing
    back = {r["id"]: (r["content"], r["tier"]) for r in compression.restored(new, out).collect()}
    assert all(back[i] == (TEXT, 0) for i in got if got[i][2])


def brain(spark, nodes, edges, fibers, bridge, tags):
    f = spark.createDataFrame
    return Brain(f(nodes, "id string, type string, content string"), f(edges, "source_id string, target_id string, type string, weight double, day int"), f(fibers, "id string, anchor string, salience double, day int"), f(bridge, "fiber_id string, node_id string"), f(tags, "fiber_id string, tag string"), f([(x[0], "fact") for x in fibers], "fiber_id string, memory_type string"))


def test_transplant(spark):
    source = brain(spark, [("1", "E", "Alice"), ("2", "E", "Bob"), ("3", "T", "noon"), ("4", "E", "Eve")], [("1", "2", "KNOWS", 0.9, 5), ("2", "4", "KNOWS", 0.9, 5), ("1", "3", "AT", 0.9, 5)], [("f1", "1", 0.9, 5), ("f2", "4", 0.9, 5), ("f3", "3", 0.1, 5)], [("f1", "1"), ("f1", "2"), ("f1", "3"), ("f2", "4"), ("f3", "3")], [("f1", "go"), ("f3", "go"), ("f2", "stay")])
    target = brain(spark, [("a", "E", "Alice"), ("2", "E", "Zoe")], [("a", "2", "KNOWS", 0.5, 1)], [("f1", "a", 0.2, 1)], [("f1", "a")], [("f1", "old")])
    for strategy, salience in (("prefer_local", 0.2), ("prefer_remote", 0.9), ("prefer_recent", 0.9), ("prefer_stronger", 0.9)):
        out, ids, report = transplant(source, target, strategy=strategy, tags=["go"], node_types=["E"], min_salience=0.5)
        ids = {r["id"]: r["new_id"] for r in ids.collect()}
        assert ids["1"] == "a" and ids["2"].startswith("moved:") and set(ids) == {"1", "2"}
        assert {(r["source_id"], r["target_id"]) for r in out.edges.collect()} == {("a", "2"), ("a", ids["2"])}
        assert [(r["id"], r["anchor"], r["salience"]) for r in out.fibers.collect()] == [("f1", "a", salience)]
        members = {r["node_id"] for r in out.bridge.collect()}
        assert members == ({"a"} if strategy == "prefer_local" else {"a", ids["2"]})
        n = {(r["entity"], r["outcome"]): r["n"] for r in report.collect()}
        assert n["node", "added"] == n["node", "mapped"] == n["edge", "added"] == 1 and n["edge", "dangling"] == 0
        assert n["fiber", "kept" if strategy == "prefer_local" else "replaced"] == 1
