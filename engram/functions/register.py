"""Functions for SQL: register_all(spark) makes them known to a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from engram.functions.text import html_to_text
from engram.operators.dedup import simhash


def register_all(spark: SparkSession) -> None:
    """mem_simhash, mem_html_to_text (Arrow), and SQL functions mem_hamming, mem_heat, mem_synapse_decay."""
    spark.udf.register("mem_simhash", simhash)
    spark.udf.register("mem_html_to_text", html_to_text)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION mem_hamming(a BIGINT, b BIGINT) RETURNS INT RETURN bit_count(a ^ b)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION mem_heat(days DOUBLE, uses DOUBLE, priority DOUBLE) RETURNS DOUBLE RETURN 0.4D * exp(-days / 7) + 0.4D * least(1.0D, uses / 20) + 0.2D * priority / 10")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION mem_synapse_decay(weight DOUBLE, n DOUBLE, hours DOUBLE) RETURNS DOUBLE "
        "RETURN weight * greatest(0.3D + least(0.5D, 0.05D * n), 1 / (1 + exp((hours - 1440D * (1 + 0.5D * n)) / (720D * (1 + 0.5D * n)))))"
    )
