"""One name for each operator: its query over the tables of a folder, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _oracles[name] = sql
        return f

    return keep


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best orders of each region: activation spreads from its top customers, and scores the orders that hold what it reaches."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from engram.fixtures import Tables
    from engram.operators import graph, ranking

    t = Tables(spark, sf_dir)
    c = t.read("customer").join(t.read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("r:"), F.col("n_regionkey").cast("string")).alias("query_id"), t.key("c", "c_custkey").alias("id"))
    top = c.join(t.neuron_states().select("id", "access_frequency"), "id")
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("access_frequency").desc(), "id"))).filter("r <= 3")
    anchors = top.select("query_id", F.col("id").alias("node_id"), F.lit(1.0).alias("level"))
    reached = graph.spread(anchors, graph.walkable(t.synapses(), t.neuron_states()), max_hops=2, min_level=0.1)
    return ranking.fiber_score(ranking.rrf_levels(reached.withColumnRenamed("level", "score")), t.fiber_neurons(), t.fibers(), as_of=t.order_as_of())


def _load() -> None:
    from engram.plans import capturing, choosing, cognition, deciding, derived, encoding, insight, memory, merging, moving, priming, recall, searching, selection, sequences, shape, shortening, signals, wording  # noqa: F401  they register their queries


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)
