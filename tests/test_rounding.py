"""Values that lie on the edge of the sixth place, against the SQL to the last bit."""

import glob
import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from engram.functions.formulas import rounded
from engram.operators import graph
from engram.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(folder):
    c = pytest.importorskip("duckdb").connect()
    for path in [*glob.glob(f"{DATA}/*.parquet"), *glob.glob(f"{folder}/*.parquet")]:
        c.sql(f"CREATE OR REPLACE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def test_rounded_is_the_sqls(spark, tmp_path):
    values = [0.10 * 0.631875, 1.0171875, 0.9984375, -0.0631875, 0.5e-6, 1.5e-6, -2.5e-6, 0.0, 1e300, float("inf"), *(i / 320 for i in range(320))]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [tuple(r) for r in df.select(*[rounded(F.col("x"), p) for p in (6, 9)]).collect()]
    assert got == duck(tmp_path).execute("SELECT round(x, 6), round(x, 9) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["rk21_priming_boosts", "sc3_weighted_keywords"])
def test_edges_of_the_sixth_place(spark, tmp_path, name):
    if name.startswith("rk21"):
        seen = [(s, e, k) for s in range(3) for e, k in (("view", 4), ("click", 1))] + [(9, "click", 1)]
        rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i), s, e, 31.59375, json.dumps({"k": k})) for i, (s, e, k) in enumerate(seen)]
        tables = {"events": (rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")}
    else:
        words = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) + "q" for i in range(321)]  # the i-th weighs 1 - i / 640
        tables = {"documents": ([(1, " ".join(words))], "doc_id long, text string"), "conversations": ([], "conv_id long, turn long, text string"), "benchmark": ([], "item_id long, text string")}
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{table}.parquet"))
    got = registry.queries()[name](spark, str(tmp_path))
    want = duck(tmp_path).sql(f"SELECT {', '.join(got.columns)} FROM ({registry.oracles()[name]})").fetchall()
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_totals_do_not_depend_on_order(spark):
    weights = [0.16, 0.34, 0.28, 0.8, 1.0, 0.7, 0.9, 0.62, 0.2]  # 5 in all; a sum of doubles in this order is a little more
    for order in (weights, weights[::-1], sorted(weights)):
        edges = spark.createDataFrame([(str(i), "a", w) for i, w in enumerate(order)], "id string, source_id string, weight double").coalesce(1)
        assert graph.normalize_outgoing(edges).count() == 0
