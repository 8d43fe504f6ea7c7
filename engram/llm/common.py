"""What the operators share: reading tables, and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Sends the package to the workers, and bounds what a Python worker gets at once."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="engram-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/engram-{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder, so that losing an executor never repeats what made them."""
    prepare(df.sparkSession)
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, *tables: DataFrame) -> str:
    """The name, with as many underscores after it as make it a new column of all tables."""
    used = {c.lower() for t in tables for c in t.columns}
    while name.lower() in used:
        name += "_"
    return name


def fold_of(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def broadcast_if_small(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """Broadcasts a table whose counted rows are within `most`; a larger one is left to a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def crc_ctes(keys: str) -> str:
    """SQL common table expressions (of a recursive WITH) that end in crc32(s, crc): the unsigned CRC-32 of every ASCII text s of `keys`."""
    return f"""crc_steps(n, k, c) AS (SELECT n, 0, n FROM range(256) r(n) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT n, c FROM crc_steps WHERE k = 8), crc_keys AS ({keys}),
crc_chars(s, i, c) AS (SELECT s, 0, 4294967295 FROM crc_keys UNION ALL SELECT s, i + 1, xor(x.c >> 8, t.c) FROM crc_chars x JOIN crc_table t ON t.n = xor(x.c, ascii(substr(s, i + 1, 1))) & 255 WHERE i < length(s)),
crc32 AS (SELECT s, xor(c, 4294967295) AS crc FROM crc_chars WHERE i = length(s))"""
