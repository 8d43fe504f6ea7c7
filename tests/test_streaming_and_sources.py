"""Streams against their batch twins; files and records; text functions."""

import datetime
import hashlib
import json

from pyspark.sql import functions as F

from engram.functions import text
from engram.functions.register import register_all
from engram.operators import aggregates, links
from engram.sources import files
from engram.streaming import logs

T0 = datetime.datetime(2024, 1, 1)
EVENTS = "id long, session_id long, ts timestamp, action string, duration_ms double"


def stream(spark, tmp_path, rows, schema):
    df = spark.createDataFrame(rows, schema)
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def drain(df, tmp_path, name, mode="append"):
    """Runs a stream over all there is, and a last row far in the future has closed its windows."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def events(n=60):
    rows = [(i, i % 3, T0 + datetime.timedelta(minutes=37 * i), "ab"[i % 2], float(i)) for i in range(n)]
    return rows + [rows[5], (10_000, 9, T0 + datetime.timedelta(days=400), "z", 0.0)]


def test_tool_stats_stream(spark, tmp_path):
    df, s = stream(spark, tmp_path, events(), EVENTS)
    got = {(r["day"], r["action"]): (r["cnt"], round(r["avg_ms"], 6)) for r in drain(logs.tool_stats_stream(s, watermark="3 days"), tmp_path, "tool_stats", "complete") if r["action"] != "z"}
    want = df.dropDuplicates(["id"]).filter("action <> 'z'").groupBy(F.date_trunc("day", "ts").alias("day"), "action").agg(F.count(F.lit(1)).alias("cnt"), F.avg("duration_ms").alias("m"))
    assert got == {(r["day"], r["action"]): (r["cnt"], round(r["m"], 6)) for r in want.collect()}


def test_sessions_stream(spark, tmp_path):
    rows = [(i, 1, T0 + datetime.timedelta(hours=h), "a", 0.0) for i, h in enumerate([0, 1, 2, 6, 7, 20])] + [(99, 2, T0 + datetime.timedelta(days=400), "a", 0.0)]
    _, s = stream(spark, tmp_path, rows, EVENTS)
    got = sorted((r["begin"], r["events"]) for r in drain(logs.sessions_stream(s, watermark="3 days"), tmp_path, "sessions") if r["session_id"] == 1)
    assert [n for _, n in got] == [3, 2, 1]


def test_co_activation_stream(spark, tmp_path):
    """Each sliding window holds what the batch operator counts over its days; a pair that is seen again is counted again, a strength that is null is no part of the mean."""
    schema = "a string, b string, ts timestamp, strength double"
    rows = [("abc"[i % 3], "xy"[i % 2], T0 + datetime.timedelta(hours=7 * i), None if i == 4 else float(i % 5)) for i in range(40)]
    last = [("z", "z", T0 + datetime.timedelta(days=400), 0.0)]
    df, s = stream(spark, tmp_path, [*rows, rows[3], *last], schema)
    got = {(r["begin"], r["a"], r["b"]): (r["cnt"], r["avg_strength"]) for r in drain(logs.co_activation_stream(s, watermark="30 days"), tmp_path, "together") if r["a"] != "z"}
    want = {}
    for k in range(-6, 12):
        begin = T0 + datetime.timedelta(days=k)
        part = df.filter((F.col("ts") >= F.lit(begin)) & (F.col("ts") < F.lit(begin + datetime.timedelta(days=7))) & (F.col("a") != "z"))
        want |= {(begin, r["a"], r["b"]): (r["cnt"], r["avg_strength"]) for r in aggregates.co_activation_counts(part).collect()}
    assert got == want and max(n for n, _ in got.values()) > 1


def test_temporal_binding_stream(spark, tmp_path):
    schema = "brain_id string, fiber_id string, anchor string, ts timestamp"
    rows = [("b", f"f{i}", f"a{i % 3}", T0 + datetime.timedelta(minutes=3 * i)) for i in range(6)]
    df, s = stream(spark, tmp_path, rows, schema)
    got = {(r["fiber_id"], r["other_id"]) for r in drain(logs.temporal_binding_stream(s, s), tmp_path, "binding")}
    assert got == {(f"f{i}", f"f{i - 1}") for i in range(1, 6)}


def test_each_batch_splits_late_rows(spark, tmp_path):
    rows = [(0, T0), (1, T0 + datetime.timedelta(hours=5))]
    _, s = stream(spark, tmp_path, rows, "id long, ts timestamp")
    kept = []
    split = logs.with_late(s, bound="1 hour", late_path=str(tmp_path / "late"))
    logs.each_batch(s.coalesce(1), lambda b, n: kept.extend(r["id"] for r in split(b, n).collect()), str(tmp_path / "ck")).awaitTermination(120)
    late = [r["id"] for r in spark.read.schema("id long, ts timestamp").parquet(str(tmp_path / "late")).collect()]
    assert sorted(kept + late) == [0, 1] and 1 in kept


def test_sequential_pair_stream(spark, tmp_path):
    rows = [(i, i % 2, T0 + datetime.timedelta(seconds=20 * i), "abc"[i % 3], 0.0) for i in range(12)]
    df = spark.createDataFrame(rows, EVENTS)
    for part in (0, 1):  # two files, a micro-batch each
        df.filter(f"int(id / 6) = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r["session_id"], r["a"], r["b"], r["gap_s"]) for r in drain(logs.sequential_pair_stream(s, window_s=45), tmp_path, "pairs"))
    assert got == sorted((k, rows[i][3], rows[i + 2][3], 40.0) for k in (0, 1) for i in range(k, 10, 2))
    assert drain(logs.sequential_pair_stream(s, window_s=30), tmp_path, "no_pairs") == []


def test_topic_ema_stream(spark, tmp_path):
    rows = [(i, 1, T0 + datetime.timedelta(minutes=i), "aab"[i % 3]) for i in range(9)]
    _, s = stream(spark, tmp_path, rows, "id long, session_id long, ts timestamp, topic string")
    got = {r["topic"]: r["weight"] for r in drain(logs.topic_ema_stream(s), tmp_path, "ema", "update")}
    want = {}
    for r in rows:
        want = {t: w * 0.7 for t, w in want.items()}
        want[r[3]] = want.get(r[3], 0.0) + 0.3
    assert {t: round(w, 9) for t, w in got.items()} == {t: round(w, 9) for t, w in want.items()}


def test_watch_directory_and_alerts(spark, tmp_path):
    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "a.md").write_text("one")
    (tmp_path / "docs" / "sub" / "b.md").write_text("two")
    (tmp_path / "docs" / "c.bin").write_text("no")
    assert sorted(r["content"] for r in drain(logs.watch_directory(spark, str(tmp_path / "docs"), pattern="*.md"), tmp_path, "watch")) == ["one", "two"]
    schema = "brain_id string, kind string, ts timestamp"
    for hours in (0, 3, 8):
        spark.createDataFrame([("b", "decay", T0 + datetime.timedelta(hours=hours)), ("b", "decay", T0 + datetime.timedelta(hours=hours, minutes=9)), ("b", f"k{hours}", T0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "alerts"))
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "alerts"))
        logs.alert_stream(s, path=str(tmp_path / "out"), checkpoint=str(tmp_path / "ck_alerts")).awaitTermination(120)
    got = sorted((r["kind"], r["ts"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("decay", T0), ("decay", T0 + datetime.timedelta(hours=8)), ("k0", T0), ("k3", T0), ("k8", T0)]


def test_files(spark, tmp_path):
    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "a.md").write_text("# A\nhello")
    (tmp_path / "docs" / "sub" / "b.txt").write_text("b")
    (tmp_path / "docs" / "c.bin").write_text("c")
    got = files.read_documents(spark, str(tmp_path / "docs"), exclude="/sub/").collect()
    assert [r["content"] for r in got] == ["# A\nhello"]
    assert files.skip_known_files(spark.createDataFrame([("x",), ("y",)], "content string"), spark.createDataFrame([(got[0]["sha256"],)], "sha256 string")).count() == 2
    lines = [json.dumps({"id": 1, "tool_name": "t", "args_summary": "x" * 500}), "{broken", "[]", ""]
    parsed = files.parse_events(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r["bad"] for r in parsed] == [False, True, True, True] and len(parsed[0]["args_summary"]) == 200


def test_snapshot_round_trip(spark, tmp_path):
    n = spark.createDataFrame([("b0", "n1", "x"), ("b1", "n2", None)], "brain_id string, id string, content string")
    e = spark.createDataFrame([("b0", "e1", 0.5)], "brain_id string, id string, weight double")
    files.write_snapshot(spark, n, e, str(tmp_path / "snap"))
    got = files.read_snapshot(spark, str(tmp_path / "snap"), n.schema.simpleString(), e.schema.simpleString())
    assert sorted(map(str, got[0].collect())) == sorted(map(str, n.collect())) and got[1].collect() == e.collect()


def test_schema_patterns(spark):
    rows = [("m", c) for c in ("a_id", "b_id")] + [("t", c) for c in ("id", "parent_id", "created_at", "updated_at", "x", "y", "z")] + [("s", c) for c in ("deleted_at", "owner_id", "owner_type", "q", "r", "v")]
    got = {(r["table"], r["pattern"]) for r in files.schema_patterns(spark.createDataFrame(rows, "table string, column string")).collect()}
    assert got == {("m", "join_table"), ("t", "tree"), ("t", "audit_trail"), ("s", "soft_delete"), ("s", "polymorphic")}


def test_html_and_chunks(spark):
    html = "<html><head><style>x{}</style></head><body><nav>skip</nav><h1>One</h1><p>alpha beta gamma</p><h2>Two &amp; more</h2><p>delta epsilon zeta</p><script>var a='</p>';</script></body></html>"
    docs = spark.createDataFrame([(1, html), (2, None), (3, "")], "doc_id long, html string").select("doc_id", text.html_to_text("html").alias("text"))
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got == {1: "# One\nalpha beta gamma\n## Two & more\ndelta epsilon zeta", 2: "", 3: ""}
    chunks = text.chunk_markdown(docs, min_words=1).collect()
    assert [(r["heading"], r["heading_path"], r["content"]) for r in chunks] == [("One", ["One"], "alpha beta gamma"), ("Two & more", ["One", "Two & more"], "delta epsilon zeta")]
    fenced = spark.createDataFrame([(1, "# A\nx y\n```\n# not a heading\n```\nz")], "doc_id long, text string")
    assert [r["word_count"] for r in text.chunk_markdown(fenced, min_words=1).collect()] == [9]
    long = spark.createDataFrame([(1, "\n\n".join("w " * 30 for _ in range(5)))], "doc_id long, text string")
    assert [r["word_count"] for r in text.chunk_markdown(long, min_words=1, max_words=70).collect()] == [60, 60, 30]


def test_components_and_chains(spark):
    got = {r["id"]: r["component"] for r in links.connected_components(spark.createDataFrame([("d", "c"), ("c", "b"), ("x", "y"), ("y", "y")], "a string, b string")).collect()}
    assert got == {"b": "b", "c": "b", "d": "b", "x": "x", "y": "x"}
    chain = links.version_chain(spark.createDataFrame([("v6",)], "node_id string"), spark.createDataFrame([(f"v{i}", f"v{i - 1}") for i in range(2, 7)] + [("v1", "v6")], "newer string, older string"))
    assert {(r["ancestor"], r["n"]) for r in chain.collect()} == {(f"v{6 - n}", n) for n in range(1, 6)}


def test_supersession(spark):
    act = spark.createDataFrame([("q", f"v{i}", 0.9) for i in range(1, 5)] + [("q", "w", 0.5)], "query_id string, node_id string, level double")
    newer = spark.createDataFrame([("v1", "v2"), ("v2", "v3"), ("v3", "v4")], "old string, new string")
    got = {r["node_id"]: round(r["level"], 6) for r in links.supersession(act, newer).collect()}
    assert got == {"v1": 0.09, "v2": 0.09, "v3": 0.09, "v4": 1.0, "w": 0.5}


def test_sql_functions(spark):
    register_all(spark)
    r = spark.sql("SELECT mem_hamming(5L, 6L) AS h, mem_heat(0D, 40D, 10D) AS heat, mem_synapse_decay(1D, 0D, 1440D) AS w, mem_simhash('') AS s").head()
    assert (r["h"], round(r["heat"], 9), round(r["w"], 9), r["s"]) == (2, 1.0, 0.5, 0)


def test_packages(spark, tmp_path):
    snapshot = {"neurons": [{"id": "n1", "content": "é \U0001f600"}, {"id": "n2", "content": None}], "fibers": [], "synapses": [{"source_id": "n1", "target_id": "n2", "weight": 0.5}]}
    told = "sha256:" + hashlib.sha256(json.dumps(snapshot, sort_keys=True).encode()).hexdigest()
    manifest = {"id": "i", "name": "p", "display_name": "P", "description": "d", "author": "a", "version": "2.0.0", "content_hash": told}
    good = {"package_version": "1.0", "manifest": manifest, "snapshot": snapshot}
    files_ = {
        "good": json.dumps(good), "spaced": json.dumps(good, indent=3), "bent": json.dumps(good | {"snapshot": snapshot | {"fibers": [1]}}), "old": json.dumps(good | {"package_version": "0.9"}),
        "large": json.dumps(good | {"more": "x" * 200_000}), "bare": "{}", "list": "[1]", "empty": "", "broken": "{", "short": json.dumps({"package_version": "1.0", "manifest": {**manifest, "author": ""}, "snapshot": {"neurons": 3}}),
    }
    (tmp_path / "deep").mkdir()
    for name, text_ in files_.items():
        (tmp_path / ("deep" if name == "old" else "") / f"{name}.brain").write_text(text_)
    (tmp_path / "bytes.brain").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "other.txt").write_text("{}")
    p = files.read_packages(spark, str(tmp_path))
    rows = {r["path"].rsplit("/", 1)[1][:-6]: r for r in p.collect()}
    assert set(rows) == {*files_, "bytes"} - {"empty"} and {n for n, r in rows.items() if r["valid"]} == {"good", "spaced", "large"}
    assert all(rows[n]["size_bytes"] == len(t.encode()) for n, t in files_.items() if t) and rows["good"]["size_tier"] == "micro" and rows["large"]["size_tier"] == "small"
    assert (rows["good"]["hash_ok"], rows["good"]["name"], rows["good"]["version"], rows["bent"]["hash_ok"], rows["bent"]["errors"]) == (True, "p", "2.0.0", False, ["hash mismatch"])
    assert rows["old"]["errors"] == ["format version: 0.9"] and rows["old"]["hash_ok"] and rows["bare"]["errors"] == ["format version: None", "no manifest", "no snapshot"] and rows["bare"]["hash_ok"] is None
    assert rows["broken"]["errors"] == rows["bytes"]["errors"] == ["not JSON"] and rows["list"]["errors"] == ["not a JSON object"]
    assert rows["short"]["errors"] == ["manifest lacks author", "snapshot lacks neurons", "snapshot lacks synapses", "snapshot lacks fibers", "hash mismatch"]
    read = files.package_records(p.filter("path like '%good%'"), "neurons", "id string, content string").select("id", "content").collect()
    assert [tuple(r) for r in read] == [("n1", "é \U0001f600"), ("n2", None)]
    assert files.package_records(p, "synapses", "source_id string, weight double").agg(F.sum("weight")).head()[0] == 1.5


def test_tabular_documents(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,text\n1,"a, ""b"""\n2,\n')
    (tmp_path / "t.json").write_text('{"id": 1, "text": "a, \\"b\\"", "more": 3}\n{"id": 2}\n')
    for kind in ("csv", "json"):
        got = files.read_tabular(spark, str(tmp_path / f"t.{kind}"), kind, "id long, text string").orderBy("id").collect()
        assert [r["id"] for r in got] == [1, 2] and got[1]["text"] is None and got[0]["text"] == 'a, "b"'
    (tmp_path / "m.csv").write_text('id,text\n1,"a\nb"\n')
    assert [tuple(r) for r in files.read_tabular(spark, str(tmp_path / "m.csv"), "csv", "id long, text string", multiline=True).collect()] == [(1, "a\nb")]
