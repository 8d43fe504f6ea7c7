"""Marks of negation next to letters beyond ASCII, against the SQL."""

import pytest

from engram.plans import registry

TURNS = [(1, 1, "el ladoñno cache redis server queue"), (1, 2, "el lado cache redis server queue"), (2, 1, "the cacheéremoved redis server"), (2, 2, "the cache redis server"), (3, 1, "redis\x0bqueue never stopped using kafka"), (3, 2, "redis\x0bqueue kafka"), (3, 3, None)]


@pytest.mark.parametrize("name", ["dd13_negation_conflicts", "dd14_resolve_conflicts", "dd15_surprise"])
def test_words_end_where_ascii_does(spark, tmp_path, name):
    c = pytest.importorskip("duckdb").connect()
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, text string").write.parquet(path)
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    got = registry.queries()[name](spark, str(tmp_path))
    want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.oracles()[name]})").fetchall()
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
