"""Files and records to tables, and back."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "id long, tool_name string, server_name string, args_summary string, success boolean, duration_ms double, session_id string, task_context string, created_at string"

#: Packages smaller than each are of that tier (the last one's own size belongs to it), larger ones are oversized; format version and fields asked for.
SIZE_TIERS = (("micro", 100 * 1024), ("small", 1024 * 1024), ("medium", 10 * 1024 * 1024))
PACKAGE_VERSION, MANIFEST, SNAPSHOT = "1.0", ("id", "name", "display_name", "description", "author"), ("neurons", "synapses", "fibers")


def read_documents(spark: SparkSession, folder: str, *, extensions: Sequence[str] = ("md", "txt"), exclude: str | None = None) -> DataFrame:
    """path, content, sha256 of text files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(folder)
    if exclude:
        files = files.filter(~F.col("path").rlike(exclude))
    return files.select("path", F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("sha256"))


def read_tabular(spark: SparkSession, path: str, kind: str, schema: str, *, multiline: bool = False) -> DataFrame:
    """Rows of CSV files with a header (a quote inside quotes is doubled) or of JSON lines. multiline: records may hold line ends; each file is one task then."""
    reader = spark.read.schema(schema).option("multiLine", multiline)
    return reader.option("header", "true").option("escape", '"').csv(path) if kind == "csv" else reader.json(path)


def parse_events(lines: DataFrame, *, summary: int = 200) -> DataFrame:
    """JSON lines (value) as tool events; `bad` marks lines that are no JSON object; argument summaries are cut. Works on streams, too."""
    parsed = lines.withColumn("e", F.from_json("value", EVENT + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    names = [x.split()[0] for x in EVENT.split(", ")]
    columns = [F.left("e.args_summary", F.lit(summary)).alias(n) if n == "args_summary" else F.col(f"e.{n}").alias(n) for n in names]
    return parsed.select(*columns, (F.col("e").isNull() | F.col("e._corrupt").isNotNull() | F.col("e.tool_name").isNull()).alias("bad"))


def incremental_import(records: DataFrame, imported: DataFrame, *, last_sync: Column) -> DataFrame:
    """Records changed since the last sync that were not imported yet. Both have source_system and record_id."""
    return records.filter(F.col("updated_at") > last_sync).join(imported, ["source_system", "record_id"], "left_anti")


def skip_known_files(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files whose content hash is not in the registry (sha256)."""
    return files.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256)).join(registry.select("sha256").distinct(), "sha256", "left_anti")


def map_records(records: DataFrame, relations: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of external records, and edges of relations whose two ends are among them."""
    lookup = F.create_map(*[x for k, v in types.items() for x in (F.lit(k), F.lit(v))])
    nodes = records.select(F.concat_ws(":", "source_system", "record_id").alias("id"), F.coalesce(lookup[F.col("kind")], F.lit("CONCEPT")).alias("type"), "content")
    ids = nodes.select("id")
    edges = relations.select(F.concat_ws(":", "source_system", "from_id").alias("source_id"), F.concat_ws(":", "source_system", "to_id").alias("target_id"), "relation")
    return nodes, edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def write_snapshot(spark: SparkSession, neurons: DataFrame, synapses: DataFrame, path: str) -> None:
    """Nodes and edges as JSON lines by brain and kind, so that no brain has to fit into one document."""
    node = neurons.select("brain_id", F.lit("neuron").alias("kind"), F.to_json(F.struct(*neurons.columns)).alias("body"))
    edge = synapses.select("brain_id", F.lit("synapse").alias("kind"), F.to_json(F.struct(*synapses.columns)).alias("body"))
    node.unionByName(edge).write.partitionBy("brain_id", "kind").json(path)


def read_snapshot(spark: SparkSession, path: str, neurons: str, synapses: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.schema("brain_id string, kind string, body string").json(path)
    part = lambda kind, schema: rows.filter(F.col("kind") == kind).select(F.from_json("body", schema).alias("r")).select("r.*")
    return part("neuron", neurons), part("synapse", synapses)


def schema_patterns(columns: DataFrame) -> DataFrame:
    """table, pattern of a catalogue of columns (table, column): audit trail, soft delete, tree, polymorphic, join table."""
    name = F.lower("column")
    has = lambda c: F.max(c.cast("int"))
    t = columns.groupBy("table").agg(
        has(name.isin("created_at", "created_on")).alias("c"), has(name.isin("updated_at", "modified_at")).alias("u"), has(name.isin("deleted_at", "is_deleted")).alias("d"),
        has(name.isin("parent_id", "parent_key")).alias("p"), has(name.rlike("_type$")).alias("y"), F.sum(name.rlike("(_id|key)$").cast("int")).alias("k"), F.count(F.lit(1)).alias("n"),
    )
    found = {"audit_trail": "c = 1 and u = 1", "soft_delete": "d = 1", "tree": "p = 1", "polymorphic": "y = 1 and k >= 1", "join_table": "k >= 2 and n <= k + 2"}
    picks = F.array(*[F.when(F.expr(test), F.lit(p)) for p, test in found.items()])
    return t.select("table", F.explode(F.array_compact(picks)).alias("pattern"))


def _package(raw: bytes, version_key: str) -> dict:
    """The findings and parts of one package; what is wrong is told, never raised."""
    out = dict.fromkeys(["id", "name", "version", "author", "content_hash", "hash_ok", *SNAPSHOT])
    try:
        data = json.loads(raw)
    except ValueError:  # no JSON, or no UTF-8
        return out | {"errors": ["not JSON"]}
    if not isinstance(data, dict):
        return out | {"errors": ["not a JSON object"]}
    manifest, snapshot = data.get("manifest"), data.get("snapshot")
    errors = [] if data.get(version_key) == PACKAGE_VERSION else [f"format version: {data.get(version_key)}"]
    if isinstance(manifest, dict):
        errors += [f"manifest lacks {f}" for f in MANIFEST if not manifest.get(f)]
        out |= {f: str(manifest[f]) for f in ("id", "name", "version", "author", "content_hash") if manifest.get(f) is not None}
    else:
        errors.append("no manifest")
    if isinstance(snapshot, dict):
        errors += [f"snapshot lacks {f}" for f in SNAPSHOT if not isinstance(snapshot.get(f), list)]
        out |= {f: [json.dumps(r) for r in snapshot[f]] for f in SNAPSHOT if isinstance(snapshot.get(f), list)}
        told = hashlib.sha256(json.dumps(snapshot, sort_keys=True).encode()).hexdigest()
        out["hash_ok"] = out["content_hash"] == f"sha256:{told}"
        if not out["hash_ok"]:
            errors.append("hash mismatch")
    else:
        errors.append("no snapshot")
    return out | {"errors": errors}


def read_packages(spark: SparkSession, folder: str, *, glob: str = "*.brain", version_key: str = "package_version") -> DataFrame:
    """path, size_bytes, size_tier, id, name, version, author, content_hash, hash_ok, neurons, synapses, fibers, valid, errors of all packages below a folder.

    A package is one JSON document of a format version (under version_key), a manifest and a snapshot; files are spread over tasks, each is parsed alone.
    The hash is taken anew over the snapshot with sorted keys. Records of the snapshot are JSON strings, to be read by `package_records`. Files that
    are no package and those of other versions stay as rows that are not valid and say why (Spark lists no empty files); hash_ok is null without a snapshot.
    """
    fields = "id string, name string, version string, author string, content_hash string, hash_ok boolean, neurons array<string>, synapses array<string>, fibers array<string>, errors array<string>"

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, size, raw in zip(b["path"], b["length"], b["content"], strict=True):  # one at a time: a package may be large
                row = {"path": path, "size_bytes": size, **_package(raw, version_key)}
                yield pd.DataFrame({k: pd.Series([v], dtype=object) for k, v in row.items()})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    out = files.select("path", "length", "content").mapInPandas(parsed, "path string, size_bytes long, " + fields)
    (micro, a), (small, b), (medium, c) = SIZE_TIERS
    size = F.col("size_bytes")
    tier = F.when(size < a, micro).when(size < b, small).when(size <= c, medium).otherwise("oversized")
    return out.select("path", "size_bytes", tier.alias("size_tier"), *[x.split()[0] for x in fields.split(", ")[:-1]], (F.size("errors") == 0).alias("valid"), "errors")


def package_records(packages: DataFrame, part: str, schema: str) -> DataFrame:
    """path and the columns of schema: the records of a part (neurons, synapses or fibers) of the packages that are valid."""
    return packages.filter("valid").select("path", F.explode(part).alias("r")).select("path", F.from_json("r", schema).alias("r")).select("path", "r.*")
