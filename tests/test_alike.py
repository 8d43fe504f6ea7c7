"""Rankings, pairs and groups in which equal things are looked at once, against plain ways."""

import random

from pyspark.sql import functions as F

from engram.operators import dedup, graph, joins, links, ranking


def test_equal_names_are_scored_once(spark):
    g = random.Random(4)
    words = [f"w{i}" for i in range(5)]
    docs = [(i, w) for i in range(120) for w in g.choices(words, k=g.randrange(1, 4))]
    queries = [(q, w) for q in range(40) for w in g.choices([*words, "none", None], k=g.randrange(1, 4))]
    d, q = spark.createDataFrame(docs, "doc_id long, term string"), spark.createDataFrame(queries, "query_id long, term string")
    for limit in (1, 7, 200):
        want = {(r["query_id"], r["doc_id"], round(r["score"], 9), r["rank"]) for r in ranking.bm25(d, q, limit=limit).collect()}
        assert want == {(r["query_id"], r["doc_id"], round(r["score"], 9), r["rank"]) for r in ranking.bm25_alike(d, q, limit=limit).collect()}


def test_copies_are_one_in_clusters(spark):
    hashes = [(i, 5) for i in range(30_000)] + [(40_000, 7), (50_000, 7 << 40), (60_000, 7 << 50)]  # 450 million pairs of copies
    pairs, of = dedup.near_duplicate_classes(spark.createDataFrame(hashes, "id long, hash long"))
    assert [(r["id_a"], r["id_b"], r["bits"]) for r in pairs.collect()] == [(0, 40_000, 1)]
    assert of.filter("first = 0").count() == 30_000 and [tuple(r) for r in of.filter("first > 0").collect()] == [(40_000, 40_000)]


def test_the_first_leader_claims(spark):
    g = random.Random(6)
    edges = sorted({(a, b) for a, b in ((g.randrange(60), g.randrange(60)) for _ in range(150)) if a < b})
    want = {}
    for i in sorted({x for e in edges for x in e}):
        want[i] = min([a for a, b in edges if b == i and want[a] == a], default=i)
    assert {r["id"]: r["leader"] for r in dedup.leaders(spark.createDataFrame(edges, "id_a long, id_b long")).collect()} == want


def test_anchors_of_a_crowded_day(spark):
    g = random.Random(7)
    fibers = [(f"b{g.randrange(2)}", f"f{i:05d}", g.choice(["a", "a", "a", "b", "c", None]), g.choice([1, 2, 2, 2, 5, 6, None])) for i in range(200)]
    df = spark.createDataFrame(fibers, "brain_id string, id string, anchor string, created_day int")
    want = set()
    for brain, fiber, anchor, day in fibers:
        if anchor and day:
            near = sorted((day - d, f, a) for b, f, a, d in fibers if b == brain and a and d and day - 3 <= d <= day and a != anchor)[:3]
            want |= {(brain, fiber, a, round(max(0.1, 0.4 * (1 - gap / 3)), 6)) for gap, f, a in near}
    assert {(r["brain_id"], r["fiber_id"], r["target_id"], round(r["weight"], 6)) for r in joins.temporal_binding(df, window=3).collect()} == want
    many = spark.range(40_000).selectExpr("'b' AS brain_id", "concat('f', id) AS id", "concat('c', id % 4) AS anchor", "7 AS created_day")  # 1.6 billion pairs
    assert joins.temporal_binding(many, window=3).count() == 120_000


def test_hashes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PART", 16)
    g = random.Random(8)
    hashes = sorted({g.choice([0, 1 << 20, 5 << 62]) ^ sum(1 << i for i in g.sample(range(64), g.randrange(4))) for _ in range(300)})
    signed = [h - (1 << 64) if h >> 63 else h for h in (x % (1 << 64) for x in hashes)]
    want = {(min(a, b), max(a, b), ((a ^ b) % (1 << 64)).bit_count()) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3}
    df = spark.createDataFrame([(h,) for h in signed], "hash long")
    got = [tuple(r) for r in dedup.near_by_bands(df).collect()]
    assert set(got) == want and len(got) == len(want) > 100
    pairs = dedup.near_by_bands(df, joined=True).select(F.col("hash").alias("a"), F.col("other").alias("b"))
    full = spark.createDataFrame([(a, b) for a, b, _ in want], "a long, b long")
    assert sorted(links.connected_components(pairs).collect()) == sorted(links.connected_components(full).collect())


def test_triangles_of_a_random_graph(spark):
    g = random.Random(9)
    edges = [(f"n{min(g.randrange(40), g.randrange(40))}", f"n{g.randrange(40)}") for _ in range(300)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {(n, len(x), sum(1 for a in x for b in x if a < b and b in near[a])) for n, x in near.items() if len(x) > 1}
    got = graph.clustering_coefficient(spark.createDataFrame(edges, "source_id string, target_id string"))
    assert {(r["node_id"], r["degree"], r["triangles"]) for r in got.collect()} == want


def test_interference_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PART", 8)
    g = random.Random(10)
    hashes = {i: g.getrandbits(24) for i in range(90)}
    tags = {i: g.sample("abc", g.randrange(4)) for i in hashes}
    rows = [(i, hashes[i], t) for i in hashes for t in tags[i]]
    want = {(a, b, round(1 - (hashes[a] ^ hashes[b]).bit_count() / 18, 9)) for a in hashes for b in hashes if a < b and set(tags[a]) & set(tags[b]) and 8 <= (hashes[a] ^ hashes[b]).bit_count() <= 18}
    got = [(r["id_a"], r["id_b"], round(r["score"], 9)) for r in dedup.interference(spark.createDataFrame(rows, "id long, hash long, tag string")).collect()]
    assert set(got) == want and len(got) == len(want) > 100
