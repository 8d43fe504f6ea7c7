"""Inverted lists against all pairs, and recall that starts from a search."""

import random

import numpy as np
import pytest

from engram.operators import anchors, familiar, ivf, searching

V = "node_id long, embedding array<float>"


@pytest.fixture(scope="module")
def vectors():
    """Clusters of several sizes, one of them with half of all rows."""
    g = np.random.default_rng(4)
    centres = g.standard_normal((12, 24))
    return np.vstack([c + 0.5 * g.standard_normal((600 if i == 0 else 50, 24)) for i, c in enumerate(centres)]).astype(np.float32)


def table(spark, x, id="node_id"):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], V.replace("node_id", id)).repartition(3)


def exact(x, q, k):
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(x[q] @ x.T, 12)
    return {i: [int(j) for j in np.lexsort((np.arange(len(x)), -s))[:k]] for i, s in zip(q, sims, strict=True)}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["node_id"])
    return out


@pytest.mark.parametrize("part, block", [(8192, 512), (40, 7)])
def test_inverted_lists(spark, vectors, monkeypatch, part, block):
    monkeypatch.setattr(ivf, "PART", part)
    monkeypatch.setattr(ivf, "QUERY_BLOCK", block)
    v = table(spark, vectors)
    q = v.filter("node_id % 20 = 0").withColumnRenamed("node_id", "query_id")
    c = ivf.fit_centroids(v)
    index = ivf.assign(v, c)
    assert index.count() == len(vectors) and len(c) == round(len(vectors) ** 0.5)
    want = exact(vectors, range(0, len(vectors), 20), 10)
    assert found(ivf.search(index, q, c, k=10, probes=len(c))) == want
    got = found(ivf.search(index, q, c, k=10, probes=8))
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) >= 0.9


def test_pairs_within_an_angle(spark, vectors):
    v = table(spark, vectors[::4])
    x = vectors[::4].astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = ivf.fit_centroids(v, lists=9)
    for least in (0.95, 0.8, 0.0):
        got = {(r["query_id"], r["node_id"]) for r in ivf.within(ivf.assign(v, c), v.withColumnRenamed("node_id", "query_id"), c, least=least).collect()}
        assert got == {(int(i), int(j)) for i, j in np.argwhere(x @ x.T >= least)}


def test_vectors_of_nothing(spark):
    v = spark.createDataFrame([(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, 0.0])], V)
    c = ivf.fit_centroids(v.filter("size(embedding) > 0"))
    assert found(ivf.search(ivf.assign(v, c), v.withColumnRenamed("node_id", "query_id"), c, k=1, probes=9)) == {3: [3], 4: [4]}
    none = v.filter("node_id > 9")
    c = ivf.fit_centroids(none)
    assert ivf.search(ivf.assign(none, c), none.withColumnRenamed("node_id", "query_id"), c, k=1, probes=1).collect() == []


def test_recall_is_confined_to_what_was_found(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "x", 1.0), ("b", "c", 1.0), ("x", "c", 1.0)], "source string, target string, factor double")
    nearest = spark.createDataFrame([("q", f"n{i}", i) for i in range(3, 12)] + [("q", "b", 1), ("few", "b", 1)], "query_id string, node_id string, rank int")
    texts = spark.createDataFrame([("q", "c")], "query_id string, node_id string")
    anchors = spark.createDataFrame([("q", "a", 1.0), ("few", "a", 1.0)], "query_id string, node_id string, level double")
    got = {(r["query_id"], r["node_id"]): (round(r["level"], 6), r["scoped"]) for r in searching.hybrid_vector_recall(nearest, texts, anchors, edges).collect()}
    assert got == {("q", "a"): (1.0, True), ("q", "b"): (round(0.5 + 1 / 61, 6), True), ("q", "c"): (0.25, True), ("few", "a"): (1.0, False), ("few", "b"): (0.5, False), ("few", "x"): (0.5, False), ("few", "c"): (0.25, False)}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_like_words_against_all_pairs(spark):
    g = random.Random(3)

    def near(w):
        w = list(w)
        for _ in range(g.randrange(4)):
            i = g.randrange(len(w) + 1)
            g.choice([lambda: w.insert(i, g.choice("ab")), lambda: w.__delitem__(slice(i, i + 1)), lambda: w.__setitem__(slice(i, i + 1), [g.choice("ab")])])()
        return "".join(w)

    words = sorted({"".join(g.choice("ab") for _ in range(n)) for n in [*range(1, 9)] * 4 + [21, 22, 23, 24, 25, 26, 40] * 3})
    terms = sorted({near(w) for w in words for _ in range(2)})
    got = {(r["term"], r["word"]): r["distance"] for r in anchors.fuzzy_words(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(t, w): d for t in terms for w in words if (d := edit_distance(t, w)) <= 2}


def test_terms_in_contents(spark):
    nodes = spark.createDataFrame([("a", "Red Bolt, new"), ("b", "a bolt of red cloth"), ("c", "redness"), ("d", None), ("e", "RED BOLT")], "node_id string, content string")
    terms = spark.createDataFrame([("red bolt",), ("red",), ("Bolt",), ("none",), ("",)], "term string")
    got = {(r["term"], r["node_id"]): r["place"] for r in anchors.content_hits(nodes, terms, most=2).collect()}
    assert got == {("red bolt", "a"): 1, ("red bolt", "e"): 2, ("red", "a"): 1, ("red", "b"): 2, ("Bolt", "a"): 1, ("Bolt", "b"): 2}


def test_gates_in_order(spark):
    q = [("none", "recall"), ("empty", "recall"), ("noise", "recall"), ("spread", "recall"), ("same", "recall"), ("meet", "recall"), ("meet_strict", "ask_what"), ("strong", "recall"), ("few", "recall"), ("pass", "recall")]
    anchor_rows = [(n, 0, f"{n}0") for n, _ in q if n != "none"]
    act = [("noise", 0, "x", 0.1, 1, "noise0")] + [("spread", 0, f"s{i}", 0.1, 2, "spread0") for i in range(40)] + [("same", 0, "x", 0.5, 0, "same0")]
    act += [(n, s, x, 0.45, 1, f"{n}0") for n in ("meet", "meet_strict") for s in (0, 1) for x in ("x", "y")] + [("strong", 0, "x", 0.9, 0, "strong0"), ("few", 0, "x", 0.55, 0, "few0")]
    act += [("pass", 0, f"p{i}", 0.4, 1, "pass0") for i in range(7)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    args = (frame(q, "query_id string, intent string"), frame(anchor_rows, "query_id string, set_no int, node_id string"), frame(act, "query_id string, set_no int, node_id string, level double, hop int, source string"))
    more = {"removed": frame([("noise", 9)], "query_id string, removed long"), "previous": frame([("same", 0.52, 1, 1.0)], "query_id string, top double, n long, focus double")}
    got = {r["query_id"]: (r["gate"], r["sufficient"]) for r in familiar.sufficiency(*args, **more).collect()}
    assert got == {
        "none": ("no_anchors", False), "empty": ("empty_landscape", False), "noise": ("unstable_noise", False), "spread": ("ambiguous_spread", False), "same": ("diminishing_returns", True),
        "meet": ("intersection_convergence", True), "meet_strict": ("default_pass", True), "strong": ("high_coverage_strong_hit", True), "few": ("focused_result", True), "pass": ("default_pass", True),
    }
    sure = frame([("default_pass", 0.5, 0.1, 10)], "gate string, accuracy double, avg_confidence double, samples int")
    got = {r["query_id"]: r["sufficient"] for r in familiar.sufficiency(*args, calibration=sure).collect()}
    assert not got["pass"] and got["strong"]


def test_stages_of_familiarity(spark):
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    asked = f([("weak", "default_pass"), ("words", "no_anchors"), ("late", "no_anchors"), ("lost", "no_anchors")], "query_id string, gate string")
    act = f([("weak", "n1", 0.1), ("weak", "n2", 0.05), ("words", "n1", 0.9)], "query_id string, node_id string, level double")
    keys = f([("words", 0, "bolt"), ("late", 0, "nowhere"), ("late", 1, "summary"), ("lost", 0, "nowhere")], "query_id string, pos int, term string")
    nodes = f([("n1", "a bolt"), ("n2", "a rod")], "node_id string, content string")
    edges = f([("n1", "n2", 1.0)], "source string, target string, factor double")
    fibers = f([("f1", 0.5, 0.8, 0), ("f2", 0.9, 1.0, 0)], "id string, salience double, conductivity double, created_day int")
    bridge = f([("f1", "n1"), ("f2", "n2")], "fiber_id string, neuron_id string")
    notes = f([("s1", "a Summary of things"), ("s2", "no")], "fiber_id string, summary string")
    got = {(r["query_id"], r["fiber_id"]): (r["stage"], r["rank"]) for r in familiar.familiarity(asked, act, keys, nodes, edges, fibers, bridge, notes, as_of=1).collect()}
    assert got == {("weak", "f1"): (1, 1), ("words", "f2"): (2, 1), ("words", "f1"): (2, 2), ("late", "s1"): (3, 1)}


def test_near_items_become_one(spark):
    items = spark.createDataFrame([(1, 10, "One. Two.", 0.5), (1, 11, "One. Three! Four. Five.", 0.3), (1, 12, "Six optimized.", 0.4), (2, 20, "One. Two.", 0.5)], "query_id long, item_id long, content string, score double")
    pairs = spark.createDataFrame([(10, 11)], "id_a long, id_b long")
    terms = spark.createDataFrame([(1, "Optimizing!"), (1, "six"), (2, "none")], "query_id long, term string")
    got = [(r["item_id"], r["content"], round(r["final_score"], 2), r["merged"]) for r in sorted(familiar.compile_context(items, pairs, terms).collect(), key=lambda r: (r["query_id"], r["rank"]))]
    assert got == [(12, "Six optimized.", 0.7, 1), (10, "One. Two. Three! Four.", 0.5, 2), (20, "One. Two.", 0.5, 1)]
