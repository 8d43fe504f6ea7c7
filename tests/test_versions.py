from engram.operators import selection


def test_versions_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 0.5)], "id long, c string, w double")
    first = selection.create_version(spark, df, str(tmp_path / "v"), 1, "id")
    again = selection.create_version(spark, df.repartition(3), str(tmp_path / "v"), 2, "id")
    other = selection.create_version(spark, df.limit(1), str(tmp_path / "v"), 3, "id")
    assert first == again != other
    assert sorted(map(str, selection.read_version(spark, str(tmp_path / "v"), 2).collect())) == sorted(map(str, df.collect()))


def test_diverse_leaves_out_near_copies(spark):
    scored = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.9), ("q", "c", 0.8)], "query_id string, fiber_id string, score double")
    members = spark.createDataFrame([(f, str(n)) for f in "ab" for n in range(5)] + [("c", "x")], "fiber_id string, neuron_id string")
    assert [r["fiber_id"] for r in selection.diverse(scored, members).orderBy("rank").collect()] == ["a", "c"]
