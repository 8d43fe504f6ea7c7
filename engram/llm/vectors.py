"""Near-duplicate vectors by randomly rotated binary codes.

A unit vector o is padded to `width` dimensions and rotated at random; its code is the signs of the rotated coordinates, x their
unit vector, and the stored correction factor is f = <x, o>. For any other unit vector q, <x, q> / f estimates <o, q> without
bias, and it errs by sqrt(1 - f^2) / f * sqrt(1 - <o, q>^2) times one coordinate of a random direction in width - 1 dimensions.
That coordinate is under sigmas / sqrt(width - 1) but for a share of exp(-sigmas^2 / 2), so a pair whose estimate lies further
below the threshold is not linked, and every other pair is recomputed in double precision: no link is below the threshold.

Vectors meet in buckets of equal code bits, in as many tables as find a pair at the threshold with probability `recall`; pairs
further above it are found more surely still. A pair counts in the first table in which it meets, so links are summed up where
they are found and no pair leaves its task. A bucket above CHUNK rows is compared by pairs of chunks.

Rules: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors of different
lengths do not link. Equal vectors are one vector with a count, and link with each other. Rows may repeat ids or have none:
each is a vector of its own, and a group's id is its smallest one (null if it has none). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import broadcast_if_small, prepare, staged, table
from engram.llm.graph import components

THRESHOLD = 0.9
#: Confidence of the bounds: an estimate is off by more in a share of exp(-SIGMAS^2 / 2), 1.5e-8.
SIGMAS = 6.0
#: Probability that a pair of exactly the threshold's cosine meets in a table.
RECALL = 0.999
#: Rows that a bucket has on average, and rows of a chunk of a large one.
BUCKET, CHUNK = 1024, 2048
LEAST_WIDTH = 128
#: Rows of a block that are compared at once.
STRIP = 512


def width(dim: int) -> int:
    return max(LEAST_WIDTH, -(-dim // 64) * 64)


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int) -> np.ndarray:
    """The first `dim` columns of a random rotation in width(dim) dimensions."""
    g = np.random.default_rng([seed, dim]).standard_normal((width(dim), dim))
    q, r = np.linalg.qr(g)
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Packed code bits and correction factors of unit vectors, a row each."""
    y = x @ rotation(x.shape[1], seed).T
    return np.packbits(y > 0, axis=1), np.abs(y).sum(1) / math.sqrt(y.shape[1])


def signs(codes: np.ndarray) -> np.ndarray:
    """The unit vectors that codes stand for."""
    bits = np.unpackbits(codes, axis=1).astype(np.float32)
    return (2 * bits - 1) / np.float32(math.sqrt(bits.shape[1]))


def estimates(q: np.ndarray, codes: np.ndarray, factors: np.ndarray, seed: int = 0) -> np.ndarray:
    """Estimated inner products of unit vectors q with the coded ones."""
    rotated = (q @ rotation(q.shape[1], seed).T).astype(np.float32)
    return rotated @ signs(codes).T / factors.astype(np.float32)


def margins(factors: np.ndarray, dim: int, threshold: float, sigmas: float) -> np.ndarray:
    """How far below the threshold the estimate of a pair at the threshold may lie."""
    side = min(1.0, sigmas / math.sqrt(width(dim) - 1))
    f = np.clip(factors, 1e-9, 1.0)
    return np.sqrt(1 - f * f) / f * math.sqrt(max(0.0, 1 - threshold * threshold)) * side + 1e-4


def plan(rows: int, threshold: float, recall: float, bits: int = LEAST_WIDTH) -> tuple[int, int]:
    """(bits of a key, tables) for so many vectors."""
    k = max(1, min(24, int(math.log2(max(rows, 2) / BUCKET)))) if rows > 2 * BUCKET else 1
    differ = math.acos(threshold) / math.pi  # probability that a bit differs
    log = [math.lgamma(bits + 1) - math.lgamma(h + 1) - math.lgamma(bits - h + 1) + h * math.log(max(differ, 1e-12)) + (bits - h) * math.log(1 - differ) for h in range(bits + 1)]
    chance = np.exp(log)
    meet = (1 - np.arange(bits + 1) / bits) ** k
    tables = 1
    while float(chance @ (1 - meet) ** tables) > 1 - recall:
        tables += 1
    return k, tables


@lru_cache(maxsize=8)
def positions(bits: int, k: int, tables: int, seed: int) -> np.ndarray:
    """Code bits of each table's key: every bit is used before one is used again."""
    rng = np.random.default_rng([seed, bits, k, tables])
    need = k * tables
    order = np.concatenate([rng.permutation(bits) for _ in range(-(-need // bits))])[:need]
    return order.reshape(tables, k)


def _read(column: pa.Array, kind: str) -> list[np.ndarray | None]:
    """Vectors of a batch; None for those that link with nothing."""
    out = []
    for v in column:
        x = None
        if v.is_valid and len(v.values):
            a = v.values
            if not a.null_count:
                x = a.to_numpy(zero_copy_only=False).astype(kind) + 0.0
                if not (np.isfinite(x).all() and x.any()):
                    x = None
        out.append(x)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # tiny and huge components
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def coded(vectors: DataFrame, *, id: str, embedding: str, seed: int) -> DataFrame:
    """vec_id, name (digest of the vector, null for one that links with nothing), dim, raw, code, factor."""
    kind = "f4" if vectors.schema[embedding].dataType.elementType.typeName() == "float" else "f8"
    schema = "vec_id long, name binary, dim int, raw binary, code binary, factor double"

    def run(batches):
        for b in batches:
            names, dims, raws, codes, factors = ([None] * b.num_rows for _ in range(5))
            xs = _read(b.column(1), kind)
            by_dim: dict[int, list[int]] = {}
            for i, x in enumerate(xs):
                if x is not None:
                    by_dim.setdefault(len(x), []).append(i)
            for dim, at in by_dim.items():
                code, factor = encode(_unit(np.stack([xs[i] for i in at])), seed)
                for j, i in enumerate(at):
                    raws[i] = xs[i].tobytes()
                    names[i], dims[i], codes[i], factors[i] = hashlib.md5(raws[i]).digest(), dim, code[j].tobytes(), float(factor[j])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(names, pa.binary()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary()), pa.array(codes, pa.binary()), pa.array(factors, pa.float64())], ["vec_id", "name", "dim", "raw", "code", "factor"])

    return vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(embedding)).mapInArrow(run, schema)


def _matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that links reach from each."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root, new)  # a root's links move its whole group
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(kind: str, k: int, tables: int, threshold: float, sigmas: float, seed: int):
    def run(t: pa.Table) -> pa.Table:
        n, dim, at = t.num_rows, t.column("dim")[0].as_py(), t.column("t")[0].as_py()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        names = np.array(t.column("name").to_pylist(), dtype=object)
        own, many, factors = (np.asarray(t.column(c)) for c in ("own", "m", "factor"))
        codes = _matrix(t.column("code"), "u1")
        x = _unit(_matrix(t.column("raw"), kind))
        keys = positions(width(dim), k, tables, seed)[:at]
        bits = np.unpackbits(codes, axis=1)
        rows, cols = np.flatnonzero(own == i), np.flatnonzero(own == j)
        low = threshold - margins(factors, dim, threshold, sigmas)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for s in range(0, len(rows), STRIP):
            part = rows[s : s + STRIP]
            a, b = np.nonzero(estimates(x[part], codes[cols], factors[cols], seed) >= low[cols].astype(np.float32))
            a, b = part[a], cols[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            for z in range(0, len(a), 1 << 16):  # pairs at once
                p, q = a[z : z + (1 << 16)], b[z : z + (1 << 16)]
                new = np.ones(len(p), bool)
                for key in keys:  # an earlier table in which they meet has them
                    new &= (bits[p][:, key] != bits[q][:, key]).any(axis=1)
                p, q = p[new], q[new]
                good = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                found.append((p[good], q[good]))
        a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        links = np.bincount(a, many[b], n).astype(np.int64) + np.bincount(b, many[a], n).astype(np.int64)
        hit = np.flatnonzero(links)
        root = _roots(n, a, b)
        return pa.table({"name": pa.array(list(names[hit]), pa.binary()), "links": pa.array(links[hit]), "root": pa.array(list(names[root[hit]]), pa.binary())})

    return run


def near_duplicates(vectors: DataFrame, *, id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, sigmas: float = SIGMAS, seed: int = 0) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for every row of `vectors`."""
    prepare(vectors.sparkSession)
    kind = "f4" if vectors.schema[embedding].dataType.elementType.typeName() == "float" else "f8"
    own = staged(coded(vectors, id=id, embedding=embedding, seed=seed), "codes")
    named = own.filter("name is not null")
    heads = named.groupBy("name").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("first_id"))
    one = named.select("name", "dim", "raw", "code", "factor").dropDuplicates(["name"]).join(heads.select("name", "m"), "name")
    n = named.count()
    k, tables = plan(n, threshold, recall)

    def key(batches):  # a row for every table
        for b in batches:
            for dim in set(b.column("dim").to_pylist()):
                part = b.filter(pc.equal(b.column("dim"), dim))
                bits = np.unpackbits(_matrix(part.column("code"), "u1"), axis=1)
                for t, at in enumerate(positions(width(dim), k, tables, seed)):
                    value = bits[:, at].astype(np.int64) @ (1 << np.arange(len(at)))
                    yield part.append_column("t", pa.array(np.full(part.num_rows, t, np.int32))).append_column("key", pa.array(value))

    fields = "name binary, dim int, raw binary, code binary, factor double, m long, t int, key long"
    keys = named.select("name", "dim", F.lit(None).cast("binary").alias("raw"), "code", "factor", F.lit(1).cast("long").alias("m")).dropDuplicates(["name"])
    large = staged(keys.mapInArrow(key, fields).groupBy("dim", "t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHUNK), "large")
    rows = one.select("name", "dim", "raw", "code", "factor", "m").mapInArrow(key, fields)
    rows = rows.join(broadcast_if_small(large, large.count()), ["dim", "t", "key"], "left")
    chunks = F.ceil(F.coalesce("n", F.lit(1)) / CHUNK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("name"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("n", "other")
    found = rows.groupBy("dim", "t", "key", "i", "j").applyInArrow(_compare(kind, k, tables, threshold, sigmas, seed), "name binary, links long, root binary")
    found = staged(found, "links")
    group = components(found.filter("name <> root").select(F.hex("name").alias("a"), F.hex("root").alias("b")))
    heads = heads.join(found.groupBy("name").agg(F.sum("links").alias("links")), "name", "left").withColumn("id", F.hex("name")).join(group, "id", "left")
    heads = staged(heads.select("name", "m", "first_id", "links", F.coalesce("component", "id").alias("component")), "heads")
    least = heads.groupBy("component").agg(F.min("first_id").alias("least"))
    heads = heads.join(least, "component").select("name", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("least").alias("component_id"))
    out = own.select("vec_id", "name").join(heads, "name", "left")
    component = F.when(F.col("name").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of `embeddings` with its links, its group's smallest id, and whether it is kept."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP13_SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0 AND len([c for c in embedding if c <> 0]) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.9),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other),
grouped AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM grouped"""
