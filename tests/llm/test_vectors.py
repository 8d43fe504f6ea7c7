"""Near-duplicate vectors against all pairs, and the estimates and bounds they rest on."""

import math

import numpy as np
import pytest

from engram.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.9):
    xs = []
    for i, v, _ in rows:
        good = v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)
        x = np.array(v, dtype=np.float32).astype(np.float64) if good else None
        xs.append(None if x is None else x / np.linalg.norm(x))
    n = len(rows)
    near = [[j for j in range(n) if j != i and xs[i] is not None and xs[j] is not None and len(xs[i]) == len(xs[j]) and xs[i] @ xs[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    g = np.random.default_rng(3)
    base = g.standard_normal((300, 64))
    out = [list(map(float, v)) for v in base]
    for i, spread in enumerate((0.02, 0.3, 0.4, 0.45, 0.5)):  # tight and loose groups, about the threshold too
        for _ in range(30):
            out.append([float(c) for c in base[i] + spread * g.standard_normal(64)])
    out += [out[7]] * 40 + [[2.5 * c for c in out[8]], [-c for c in out[9]]]
    return [(i, v, 0) for i, v in enumerate(out)]


def result(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("bucket, chunk", [(1024, 2048), (16, 32)])
def test_all_links_of_planted_groups(spark, rows, monkeypatch, bucket, chunk):
    monkeypatch.setattr(vectors, "BUCKET", bucket)
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    got = result(vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    want = brute(rows)
    assert [r[0] for r in got] == [r[0] for r in want]
    links = lambda x: sum(r[1] for r in x)
    assert links(got) <= links(want) and links(got) >= 0.999 * links(want) > 1000
    if links(got) == links(want):
        assert got == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 2.0, 2.0]
    rows = [(1, one, 1), (2, None, 1), (3, [], 1), (4, [0.0, -0.0, 0.0], 1), (5, [1.0, None, 2.0], 1), (6, [nan, 1.0, 1.0], 1), (7, [inf, 1.0, 1.0], 1), (8, [1e-30, 2e-30, 2e-30], 1), (9, [1e30, 2e30, 2e30], 1)]
    rows += [(1, one, None), (None, one, 2), (12, [1.0, 2.0], 2), (13, [2.0, 4.0], 2), (None, [5.0, -1.0, 0.0], 0), (15, [3.0], 0), (16, [-3.0], 0), (17, [0.5], 0)]
    got = result(vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert got == sorted([(a, b, c, a == c) for a, b, c, _ in brute(rows)], key=str)


def test_empty_and_clashing_columns(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    assert result(vectors.near_duplicates(none)) == []
    some = rows[:40] + rows[-5:]
    plain = result(vectors.near_duplicates(spark.createDataFrame(some, SCHEMA)))
    t = spark.createDataFrame([(*r, 1, "x", b"c") for r in some], SCHEMA + ", n long, name string, code binary")
    assert result(vectors.near_duplicates(t)) == plain


def test_estimates_are_unbiased_and_within_their_bounds():
    g = np.random.default_rng(1)
    dim, n = 64, 400
    a = g.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = a + 0.06 * g.standard_normal((n, dim))
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    true = np.einsum("ij,ij->i", a, b)
    errors, outside = [], 0
    for seed in range(20):
        codes, factors = vectors.encode(a, seed)
        est = np.array([vectors.estimates(b[i : i + 1], codes[i : i + 1], factors[i : i + 1], seed)[0, 0] for i in range(0, n, 10)])
        errors.append(est - true[::10])
        side = 3 / math.sqrt(vectors.width(dim) - 1)
        f = factors[::10]
        outside += (np.abs(est - true[::10]) > np.sqrt(1 - f * f) / f * np.sqrt(1 - true[::10] ** 2) * side + 1e-4).sum()
    errors = np.concatenate(errors)
    assert abs(errors.mean()) < 4 * errors.std() / math.sqrt(len(errors))
    assert outside <= 0.01 * len(errors)


def test_tables_reach_the_recall():
    for n in (10**4, 10**6):
        k, tables = vectors.plan(n, 0.9, 0.99)
        g = np.random.default_rng(n)
        a = g.standard_normal((4000, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        d = g.standard_normal((4000, 64))
        d -= np.einsum("ij,ij->i", a, d)[:, None] * a
        d /= np.linalg.norm(d, axis=1, keepdims=True)
        b = 0.9 * a + math.sqrt(1 - 0.81) * d
        x, y = (np.unpackbits(vectors.encode(v)[0], axis=1) for v in (a, b))
        met = np.zeros(len(a), bool)
        for key in vectors.positions(vectors.width(64), k, tables, 0):
            met |= (x[:, key] == y[:, key]).all(axis=1)
        assert met.mean() > 0.985
