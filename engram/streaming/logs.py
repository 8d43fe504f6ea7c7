"""Structured Streaming twins of the log operators. Late rows beyond the watermark go to a side table by `with_late`."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engram.operators.links import alerts


def tool_stats_stream(events: DataFrame, *, watermark: str = "10 minutes") -> DataFrame:
    """Per day and tool, counts and mean time of events (id, ts, action, success, duration_ms), each id once."""
    once = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["id"])
    return once.groupBy(F.window("ts", "1 day").alias("w"), "action").agg(F.count(F.lit(1)).alias("cnt"), F.avg("duration_ms").alias("avg_ms")).select(F.col("w.start").alias("day"), "action", "cnt", "avg_ms")


def sessions_stream(events: DataFrame, *, gap: str = "2 hours", watermark: str = "10 minutes") -> DataFrame:
    """Sessions of a user that end after a gap."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", watermark).groupBy("session_id", w.alias("w")).agg(F.count(F.lit(1)).alias("events")).select("session_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "events")


def co_activation_stream(pairs: DataFrame, *, span: str = "7 days", slide: str = "1 day", watermark: str = "10 minutes") -> DataFrame:
    """Counts of pairs (a, b, ts, strength) over sliding windows."""
    return pairs.withWatermark("ts", watermark).groupBy(F.window("ts", span, slide).alias("w"), "a", "b").agg(F.count(F.lit(1)).alias("cnt"), F.avg("strength").alias("avg_strength")).select(F.col("w.start").alias("begin"), "a", "b", "cnt", "avg_strength")


def temporal_binding_stream(fibers: DataFrame, others: DataFrame, *, window: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Anchors of fibers (brain_id, fiber_id, anchor, ts) that begin within a window before another, as a stream-stream join with bounded state."""
    a = fibers.withWatermark("ts", watermark).alias("a")
    b = others.select("brain_id", F.col("fiber_id").alias("other_id"), F.col("anchor").alias("other"), F.col("ts").alias("other_ts")).withWatermark("other_ts", watermark).alias("b")
    near = F.expr(f"a.brain_id = b.brain_id AND other_ts <= ts AND other_ts >= ts - INTERVAL {window} AND anchor <> other")
    return a.join(b, near).select("a.brain_id", "fiber_id", "anchor", "other_id", "other", "ts", "other_ts")


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a batch operator on every micro-batch; its number is the watermark of incremental consolidation, so a repeated batch writes the same."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_late(stream: DataFrame, *, bound: str, late_path: str) -> Callable[[DataFrame, int], DataFrame]:
    """For foreachBatch: rows later than the bound behind the batch's newest go to late_path, the others are returned."""

    def split(batch: DataFrame, number: int) -> DataFrame:
        newest = batch.agg(F.max("ts")).head()[0]
        edge = F.lit(newest) - F.expr(f"INTERVAL {bound}")
        batch.filter(F.col("ts") < edge).write.mode("append").parquet(late_path)
        return batch.filter(F.col("ts") >= edge)

    return split


#: Milliseconds of event time without an event after which a session's state is dropped; what is later than that is dropped, too.
IDLE_MS = 24 * 3600 * 1000


def _marked(stream: DataFrame, idle_ms: int) -> DataFrame:
    return stream.withWatermark("ts", f"{idle_ms} milliseconds")


def sequential_pair_stream(events: DataFrame, *, window_s: float = 30.0, idle_ms: int = IDLE_MS) -> DataFrame:
    """session_id, a, b, gap_s: actions that follow each other within a window, across micro-batches. The state of a session is its last event, dropped
    when it has been idle; late events are paired in the order of their batch."""

    def pair(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        out = []
        for ts, action in zip(rows["ts"], rows["action"], strict=True):
            at = ts.timestamp()
            if last is not None and 0 <= at - last[0] <= window_s and action != last[1]:
                out.append((key[0], last[1], action, at - last[0]))
            last = (at, action)
        state.update(last)
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "a", "b", "gap_s"])

    schema = "session_id long, a string, b string, gap_s double"
    return _marked(events, idle_ms).groupBy("session_id").applyInPandasWithState(pair, schema, "at double, action string", "append", GroupStateTimeout.EventTimeTimeout)


def topic_ema_stream(topics: DataFrame, *, keep: float = 0.7, least: float = 0.01, idle_ms: int = IDLE_MS) -> DataFrame:
    """session_id, topic, weight after each micro-batch: topics (session_id, id, ts, topic) of a session fade with each event and the named one gains 1 - keep.
    The state of a session is its topics above `least`, dropped when it has been idle."""

    def fold(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        weights = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        for _, event in rows.groupby(["ts", "id"], sort=True):
            weights = {t: w * keep for t, w in weights.items() if w * keep >= least}
            for topic in sorted(set(event["topic"])):
                weights[topic] = weights.get(topic, 0.0) + 1 - keep
        state.update((json.dumps(weights, sort_keys=True),))
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + idle_ms)
        yield pd.DataFrame([(key[0], t, w) for t, w in sorted(weights.items())], columns=["session_id", "topic", "weight"])

    return _marked(topics, idle_ms).groupBy("session_id").applyInPandasWithState(fold, "session_id long, topic string, weight double", "weights string", "update", GroupStateTimeout.EventTimeTimeout)


def activation_cache_stream(results: DataFrame, *, fade: float = 0.7, least: float = 0.01, most: int = 200, idle_ms: int = IDLE_MS) -> DataFrame:
    """session_id, node_id, level, turn after each micro-batch: what a session's queries reached (session_id, ts, turn, node_id, level), faded by each
    turn since, the highest level of a node kept, of the `most` strongest. A session's state is that cache, dropped when it has been idle."""

    def fold(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        levels, last = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, None)
        rows = pd.concat(list(batches))
        newest = int(rows["turn"].max()) if last is None else max(last, int(rows["turn"].max()))
        levels = {n: v * fade ** (newest - last) for n, v in levels.items()} if last is not None else {}
        for turn, node, level in zip(rows["turn"], rows["node_id"], rows["level"], strict=True):
            levels[node] = max(levels.get(node, 0.0), level * fade ** (newest - int(turn)))
        kept = sorted(((n, v) for n, v in levels.items() if v >= least), key=lambda x: (-round(x[1], 9), x[0]))[:most]
        state.update((json.dumps(dict(kept)), newest))
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + idle_ms)
        yield pd.DataFrame([(key[0], n, v, newest) for n, v in kept], columns=["session_id", "node_id", "level", "turn"])

    return _marked(results, idle_ms).groupBy("session_id").applyInPandasWithState(fold, "session_id long, node_id string, level double, turn long", "levels string, turn long", "update", GroupStateTimeout.EventTimeTimeout)


def watch_directory(spark: SparkSession, path: str, *, pattern: str = "*", most_files: int = 1000) -> DataFrame:
    """path, content, sha256, modified of files as they appear in a folder and those below it; each file is one row, read once."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", most_files).load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.sha2(F.col("value").cast("binary"), 256).alias("sha256"), F.col("_metadata.file_modification_time").alias("modified"))


def alert_stream(candidates: DataFrame, *, path: str, checkpoint: str, cooldown_h: float = 6.0) -> StreamingQuery:
    """Writes the alerts (brain_id, kind, ts) that are let through to path: one after another, each unless an accepted one of its
    kind lies inside the cooldown, across micro-batches. A repeated batch writes its alerts to the same folder again."""
    by = ("brain_id", "kind")

    def accept(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.createDataFrame([], "brain_id string, kind string, at long")
        if number:
            known = spark.read.schema("brain_id string, kind string, ts timestamp, n long").parquet(path).filter(F.col("n") < number).groupBy(*by).agg(F.max(F.unix_timestamp("ts")).alias("at"))
        last = known.withColumnRenamed("at", "last")
        new = batch.select(*by, F.unix_timestamp("ts").alias("at")).join(last, list(by), "left").filter(F.col("last").isNull() | (F.col("at") > F.col("last"))).drop("last")
        passed = alerts(new.unionByName(known), cooldown=int(cooldown_h * 3600), by=by).join(known, [*by, "at"], "left_anti")
        passed.select(*by, F.timestamp_seconds("at").alias("ts"), F.lit(number).cast("long").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return candidates.writeStream.foreachBatch(accept).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
