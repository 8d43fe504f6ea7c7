"""Shape of graphs, forecasts and texts that keep their direction, against plain Python."""

import itertools
import random
import re

import numpy as np
import pytest

from engram.operators import forecast, hyperbolic, semantic

EDGES = "a string, b string"


def delta(spark, pairs, nodes=None, **more):
    nodes = sorted({x for p in pairs for x in p if x}) if nodes is None else nodes
    return hyperbolic.gromov_delta(spark.createDataFrame([(n,) for n in nodes], "node_id string"), spark.createDataFrame(pairs, EDGES), **more).collect()[0].asDict()


def plain_delta(pairs):
    nodes = sorted({x for p in pairs for x in p})
    far = {a: {a: 0} for a in nodes}
    for a in nodes:
        row = [a]
        for x in row:
            for p, q in [*pairs, *((q, p) for p, q in pairs)]:
                if p == x and q not in far[a]:
                    far[a][q] = far[a][x] + 1
                    row.append(q)
    best = widest = 0
    for w, x, y, z in itertools.combinations(nodes, 4):
        if all(b in far[a] for a, b in itertools.combinations((w, x, y, z), 2)):
            s = sorted([far[w][x] + far[y][z], far[w][y] + far[x][z], far[w][z] + far[x][y]])
            best, widest = max(best, (s[2] - s[1]) / 2), max([widest, *(far[a][b] for a, b in itertools.combinations((w, x, y, z), 2))])
    return best, widest


def test_trees_and_rings(spark):
    star = delta(spark, [("m", c) for c in "abcd"])
    assert star["delta"] == 0 and star["structure_quality"] == "tree-like" and star["diameter"] == 2 and star["tuple_count"] == 5
    ring = [(f"r{i}", f"r{(i + 1) % 8}") for i in range(8)]
    got = delta(spark, ring)
    assert (got["delta"], got["diameter"]) == plain_delta(ring) == (2, 4) and got["structure_quality"] == "flat" and got["normalized_delta"] == 0.5
    g = random.Random(5)
    loose = sorted({tuple(g.sample([f"n{i:02}" for i in range(14)], 2)) for _ in range(15)})
    got = delta(spark, loose)
    assert (got["delta"], got["diameter"]) == plain_delta(loose)


def test_delta_of_odd_graphs(spark):
    assert delta(spark, [("a", "b"), ("b", "c")])["structure_quality"] == "insufficient_data"
    assert delta(spark, [], nodes=[])["sample_count"] == 0
    apart = delta(spark, [("a", "a"), (None, "b"), ("c", None)], nodes=["a", "b", "c", "d", None, "a"])
    assert apart == {"delta": 0.0, "normalized_delta": 0.0, "structure_quality": "tree-like", "sample_count": 4, "tuple_count": 1, "diameter": 0}
    ring = [(f"r{i}", f"r{(i + 1) % 30}") for i in range(30)]
    drawn = [delta(spark, ring, sample=20, tuples=100, seed=3) for _ in range(2)]
    assert drawn[0] == drawn[1] and drawn[0]["sample_count"] == 20 and 60 <= drawn[0]["tuple_count"] <= 100
    assert delta(spark, ring, max_hops=2)["diameter"] <= 2


def plain_forecast(x, ahead, energy=0.95):
    """By a singular value decomposition of the snapshots themselves; x: nodes by steps."""
    u, s, vt = np.linalg.svd(x[:, :-1], full_matrices=False)
    rank = min(int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), energy)) + 1, len(s))
    u, s, vt = u[:, :rank], s[:rank], vt[:rank]
    step = u.T @ x[:, 1:] @ vt.T / s
    state, out = u.T @ x[:, -1], []
    for _ in range(ahead):
        state = step @ state
        out.append(u @ state)
    return np.array(out), np.abs(np.linalg.eigvals(step)).max(), rank


SERIES = "group string, node_id string, step long, value double, `points` int"


def test_forecast(spark):
    g = np.random.default_rng(2)
    t = np.arange(24)
    groups = {"grows": np.outer(g.random(30) + 0.1, 1.2**t), "waves": g.random((40, 2)) @ np.array([1 + np.sin(t / 3), 1 + np.cos(t / 3)]) + 0.01 * g.random((40, 24)), None: g.random((6, 12))}
    rows = [(name, f"n{i}", 100 + s, float(v), 0) for name, x in groups.items() for i, row in enumerate(x) for s, v in enumerate(row)]
    rows += [("few", "a", s, 1.0, 0) for s in range(9)] + [("zero", "a", s, 0.0, 0) for s in range(12)] + [("grows", None, 3, 1.0, 0), ("grows", "n0", None, 1.0, 0)]
    got = forecast.koopman_forecast(spark.createDataFrame(rows, SERIES).repartition(5), ahead=3).collect()
    assert {r["group"] for r in got} == set(groups) and len(got) == 3 * (30 + 40 + 6)
    for name, x in groups.items():
        want, largest, rank = plain_forecast(x, 3)
        for r in got:
            if r["group"] == name:
                i = int(r["node_id"][1:])
                assert r["value"] == pytest.approx(want[r["step"] - 1][i], rel=1e-6, abs=1e-8) and r["max_eigenvalue"] == pytest.approx(largest, rel=1e-6) and r["rank"] == rank
                assert r["stable"] == (r["max_eigenvalue"] <= 1) and r["spike"] == (x[i, -1] > 0 and r["value"] > 2 * x[i, -1])
    assert not any(r["stable"] for r in got if r["group"] == "grows")
    assert len(forecast.koopman_forecast(spark.createDataFrame([], SERIES)).collect()) == 0


def test_forecast_of_gaps(spark):
    """Missing steps, nulls and what is not a number are 0; rows of one step are summed; older steps than the newest few are left out."""
    x = np.array([[1, 0, 2, 1, 0, 2, 1, 0, 2, 1, 0, 2.0], [2, 1, 1, 2, 1, 1, 2, 1, 1, 2, 1, 1.0]])
    rows = [("g", "n0", s, float(v), 0) for s, v in enumerate(x[0]) if v] + [("g", "n0", 1, None, 0), ("g", "n0", 4, float("nan"), 0)] + [("g", "n1", s, float(v / 2), 0) for s, v in enumerate(x[1]) for _ in "ab"]
    want = plain_forecast(x, 2)[0]
    for more, rest in ((1000, rows), (12, [*rows, ("g", "n0", -3, 9.0, 0)])):
        got = {(r["node_id"], r["step"]): r["value"] for r in forecast.koopman_forecast(spark.createDataFrame(rest, SERIES), ahead=2, most_steps=more).collect()}
        assert got == {(f"n{i}", k + 1): pytest.approx(want[k][i], abs=1e-9) for i in range(2) for k in range(2)}


def test_semantic_compress(spark):
    text = "Alpha one. Beta two! Gamma three? Alpha one. Delta."
    own = {"Alpha one.": [1.0, 0.0], "Beta two!": [0.0, 1.0], "Gamma three?": None, "Delta.": [0.0, 0.0]}
    kinds = [(1, "summary", [1.0, 0.0]), (2, "essence", [1.0, 0.0]), (3, "ghost", [1.0, 0.0]), (4, "FULL", None), (5, "summary", None), (6, "essence", [0.0, 1.0]), (7, None, [1.0, 0.0]), (8, "essence", [1.0, 0.0]), (9, "summary", [1.0, 0.0])]
    texts = {7: None, 8: "One sentence only", 9: text}
    docs = spark.createDataFrame([(i, texts.get(i, text), lv, v, "x") for i, lv, v in kinds], "doc_id long, text string, level string, vector array<double>, pos string")
    cut = semantic_cut(text)
    parts = [(i, p, s, own[s]) for i, _, _ in kinds if i not in (7, 8) for p, s in enumerate(cut)] + [(8, 0, "One sentence only", None)]
    parts = spark.createDataFrame(parts, "doc_id long, pos int, sentence string, vector array<double>")
    related = spark.createDataFrame([(6, 0, [0.0, 1.0]), (9, 0, [0.0, 1.0]), (9, 1, None), (9, 3, [1.0, 0.0])], "doc_id long, place int, vector array<double>")
    got = {r["doc_id"]: (r["content"], r["kept"], r["total"]) for r in semantic.semantic_compress(docs, parts, related).collect()}
    assert got == {
        1: ("Alpha one. Gamma three? Alpha one.", 3, 5),  # 0.6, 0.5 and 0.6; both places of a sentence
        2: ("Alpha one. Alpha one.", 2, 5),
        3: ("Alpha one. Beta two! Gamma...", 0, 0),
        4: (text, 0, 0),
        5: ("Alpha one. Beta two! Gamma three?...", 0, 0),
        6: ("Beta two!", 1, 5),
        7: ("", 0, 0),
        8: ("One sentence only", 1, 1),
        9: ("Alpha one. Gamma three? Alpha one.", 3, 5),  # the fourth neighbour is not looked at
    }
    split = spark.createDataFrame([(text,), ("",), ("  One.Two. \n Three  ",)], "t string").select(semantic.sentences("t").alias("s")).collect()
    assert [r["s"] for r in split] == [cut, [], ["One.Two.", "Three"]]
    assert semantic.semantic_compress(docs.limit(0), parts.limit(0), related.limit(0)).collect() == []


def semantic_cut(text):
    return re.split(r"(?<=[.!?])\s+", text)
