"""The trie of conversation prefixes, with totals of every subtree by parallel tree contraction.

A node is a distinct sequence of first turns. Its name is a pair of 62-bit polynomial hashes of the turns' digests, which are
associative: parts of a conversation that lie in several tasks of a range partitioning are hashed apart and put together, and so
are a prefix borrowed from one conversation and the rest of another.

Totals (childless nodes, saved tokens) go over paths first. The nodes whose smallest member is one conversation are the end of that
conversation: a path, which hangs below a node of another conversation's path. The tree of paths has a node for each distinct
conversation and is as deep as conversations branch off each other, seldom more than a few levels. Its totals are summed up a contracting
tree; a node's total is then the sum over the rest of its path of what the nodes hold and of what hangs below them, by running sums over a
range partitioning, so that a path may lie in several tasks.

A round of contraction rakes all leaves, whose totals are then known, into their parents, and compresses nodes with one child, no two
neighbours at once: a child of such a node is linked to its grandparent, and the edge carries what the node held. When the root alone is
left its total is known, and the rounds are taken back in reverse order: a compressed node's total is what it held and the total of the
child it had. The number of rounds grows with the logarithm of the number of paths, however deep they hang.

Rules: turns are in order of turn (null first), then of role, then of the text's digest; null roles and texts are empty. Rows without a
conv_id belong to no conversation and are left out. Columns beyond the four are ignored. An empty table has no node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import crc_ctes, new_folder, prepare, staged, table

#: Moduli and multipliers of the two hashes.
MODULI = ((1 << 61) - 1, (1 << 61) - 31)
BASES = (0x1F3D5B79A2C4E687 % MODULI[0], 0x0E8C6A4F2B7D9135 % MODULI[1])
#: Conversations of a block borrow their first turns from its first one.
BLOCK, MOST_BORROWED = 100, 6
Name = tuple[int, int]


def joined(a: Name, b: Name, length: int) -> Name:
    """The hash of a sequence and one of `length` turns after it."""
    return tuple((x * pow(r, length, m) + y) % m for x, y, r, m in zip(a, b, BASES, MODULI, strict=True))


def without(whole: Name, first: Name, length: int) -> Name:
    """The hash of the last `length` turns of a sequence, given that of those before."""
    return tuple((x - y * pow(r, length, m)) % m for x, y, r, m in zip(whole, first, BASES, MODULI, strict=True))


def turn_hash(digest: bytes) -> Name:
    return int.from_bytes(digest[:8]) % MODULI[0] or 1, int.from_bytes(digest[8:16]) % MODULI[1] or 1


def packed(name: Name) -> bytes:
    return name[0].to_bytes(8) + name[1].to_bytes(8)


def unpacked(raw: bytes) -> Name:
    return int.from_bytes(raw[:8]), int.from_bytes(raw[8:])


ROOT = packed((0, 0))


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation borrows."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % MOST_BORROWED).cast("int")


def _turns(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    return t.select("conv_id", "turn", "role", digest.alias("digest"), F.char_length("text").cast("long").alias("points"))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, n (from 1), prefix, before, points: each turn with its place and the hashes of the turns up to it and before it."""
    order = ["conv_id", "turn", "role", "digest"]
    t = _turns(conversations)
    t = t.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        conv = key = None
        n, name = 0, (0, 0)
        for b in batches:
            ids, turns, roles, digests, points = (c.to_pylist() for c in b.columns)
            first, ns, names, befores = [], [], [], []
            for i, t, r, d in zip(ids, turns, roles, digests, strict=True):
                if i != conv or key is None:
                    conv, n, name, key = i, 0, (0, 0), hashlib.md5(f"{t}:{len(r)}:{r}".encode("utf-8", "surrogatepass") + d).digest()
                n += 1
                befores.append(packed(name))
                name = joined(name, turn_hash(d), 1)
                first.append(key)
                ns.append(n)
                names.append(packed(name))
            yield pa.RecordBatch.from_arrays([b.columns[0], b.columns[1], b.columns[2], b.columns[3], b.columns[4], pa.array(first, pa.binary()), pa.array(ns, pa.int64()), pa.array(names, pa.binary()), pa.array(befores, pa.binary())], ["conv_id", "turn", "role", "digest", "points", "piece", "n", "prefix", "before"])

    # pieces: what a task holds of a conversation; most conversations have one
    t = staged(t.mapInArrow(run, "conv_id long, turn long, role string, digest binary, points long, piece binary, n long, prefix binary, before binary"), "pieces")
    ends = t.groupBy("conv_id", "piece").agg(F.max(F.struct("n", "prefix")).alias("end"), F.min_by(F.struct(F.col("turn").isNotNull(), "turn", "role", "digest"), "n").alias("start"))
    several = ends.groupBy("conv_id").agg(F.count(F.lit(1)).alias("pieces")).filter("pieces > 1")
    several = staged(several.join(ends, "conv_id").select("conv_id", "piece", "start", "end.n", "end.prefix"), "several")

    def offsets(t: pa.Table) -> pa.Table:  # a row for every task that the conversation lies in
        rows = sorted(t.to_pylist(), key=lambda r: tuple(x.encode() if isinstance(x, str) else x if x is not None else 0 for x in r["start"].values()))
        n, name, out = 0, (0, 0), []
        for r in rows:
            out.append((r["conv_id"], r["piece"], n, packed(name)))
            n, name = n + r["n"], joined(name, unpacked(r["prefix"]), r["n"])
        c, p, before, names = zip(*out, strict=True)
        return pa.table({"conv_id": pa.array(c, pa.int64()), "piece": pa.array(p, pa.binary()), "skip": pa.array(before, pa.int64()), "lead": pa.array(names, pa.binary())})

    moved = several.groupBy("conv_id").applyInArrow(offsets, "conv_id long, piece binary, skip long, lead binary")
    t = t.join(moved, ["conv_id", "piece"], "left").select("conv_id", "n", "prefix", "before", "points", "skip", "lead")

    def put(batches):
        for b in batches:
            n, prefix, before = (b.column(c).to_pylist() for c in ("n", "prefix", "before"))
            for k, (skip, lead) in enumerate(zip(b.column("skip").to_pylist(), b.column("lead").to_pylist(), strict=True)):
                if lead is not None:
                    prefix[k] = packed(joined(unpacked(lead), unpacked(prefix[k]), n[k]))
                    before[k] = packed(joined(unpacked(lead), unpacked(before[k]), n[k] - 1))
                    n[k] += skip
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(n, pa.int64()), pa.array(prefix, pa.binary()), pa.array(before, pa.binary()), b.column("points")], ["conv_id", "n", "prefix", "before", "points"])

    return staged(t.mapInArrow(put, "conv_id long, n long, prefix binary, before binary, points long"), "turns")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, name, parent, points, last: the turns of rebuilt conversations, and a row of depth 0 for each conversation."""
    turns = numbered(conversations)
    heads = turns.filter(F.col("n") < MOST_BORROWED).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "prefix", "before", "points"))).alias("head"))  # at most five
    convs = turns.groupBy("conv_id").agg(F.max("n").alias("own")).withColumn("h", borrowed(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK)
    convs = convs.join(heads.select(F.col("conv_id").alias("base"), F.col("head").alias("lent")), "base", "left").join(heads, "conv_id", "left")
    given = F.when(F.col("lent").isNull(), 0).otherwise(F.least("h", F.size("lent"))).cast("int")
    convs = convs.withColumn("given", given).withColumn("length", F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    end = lambda a, n: F.when(n >= 1, F.get(a, n - 1)["prefix"])
    lead, gone = end(F.col("lent"), F.col("given")), end(F.col("head"), F.least("h", "own").cast("int"))
    convs = staged(convs.select("conv_id", "h", "given", "length", lead.alias("lead"), gone.alias("gone"), F.slice("lent", F.lit(1), F.col("given")).alias("lent")), "conversations")
    rest = turns.join(convs.drop("lent"), "conv_id").filter(F.col("n") > F.col("h"))

    def rename(batches):
        for b in batches:
            depth, name, parent = [], [], []
            for n, prefix, before, h, given, lead, gone in zip(*(b.column(c).to_pylist() for c in ("n", "prefix", "before", "h", "given", "lead", "gone")), strict=True):
                for out, raw, length in ((name, prefix, n - h), (parent, before, n - h - 1)):
                    own = without(unpacked(raw), unpacked(gone), length) if gone is not None else unpacked(raw)
                    out.append(packed(joined(unpacked(lead), own, length) if lead is not None else own))
                depth.append(given + n - h)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(depth, pa.int64()), pa.array(name, pa.binary()), pa.array(parent, pa.binary()), b.column("points"), b.column("length")], ["conv_id", "depth", "name", "parent", "points", "length"])

    rest = rest.mapInArrow(rename, "conv_id long, depth long, name binary, parent binary, points long, length long")
    borrowed_turns = convs.select("conv_id", "length", F.explode("lent").alias("t")).select("conv_id", F.col("t.n").alias("depth"), F.col("t.prefix").alias("name"), F.col("t.before").alias("parent"), F.col("t.points").alias("points"), "length")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), zero.alias("points"), "length")
    every = root.unionByName(borrowed_turns).unionByName(rest)
    return every.select("conv_id", "depth", "name", "parent", "points", (F.col("depth") == F.col("length")).alias("last"))


def written(df: DataFrame, name: str) -> str:
    """The folder that holds the rows."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return path


def contracted(tree: DataFrame, sums: list[str], *, rounds: int = 200, seed: int = 0) -> DataFrame:
    """name and the totals of `sums` over its subtree. tree: name, parent (null for the root alone), and the sums' values."""
    coin = lambda c, r: F.pmod(F.xxhash64(F.lit(seed), F.lit(r), c), F.lit(2)) == 0
    edge = [f"edge_{s}" for s in sums]
    kids = tree.filter("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("kids"))
    live = tree.join(kids, "name", "left").select("name", "parent", F.coalesce("kids", F.lit(0)).cast("long").alias("kids"), *sums, *[F.lit(0).cast("long").alias(e) for e in edge])
    # folders of what is left after each round, and what it compressed; a node without children in one of them has its total
    lives, pending = [written(live, "live")], []
    shape = live.schema
    ended = live.select("name", *sums).schema
    expanded = [written(live.select("name", *sums).limit(0), "expanded")]
    live = tree.sparkSession.read.schema(shape).parquet(lives[0])
    left = live.count()
    for r in range(rounds):
        if left <= 1:
            break
        # rake: leaves give what they and their edges hold to their parents
        leaf = F.col("parent").isNotNull() & (F.col("kids") == 0)
        given = live.filter(leaf).groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("raked"), *[F.sum(F.col(s) + F.col(e)).alias(f"new_{s}") for s, e in zip(sums, edge, strict=True)])
        stem = live.filter(~leaf).join(given, "name", "left")
        stem = staged(stem.select("name", "parent", (F.col("kids") - F.coalesce("raked", F.lit(0))).alias("kids"), *[(F.col(s) + F.coalesce(f"new_{s}", F.lit(0))).alias(s) for s in sums], *edge), "raked")
        # compress: nodes with one child, none of which is its own neighbour's
        unary = stem.filter("kids = 1 and parent is not null").filter(coin(F.col("name"), r))
        child = stem.filter("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.min(F.struct("name", *edge)).alias("c"))  # partial minima: a node may have any number of children
        child = child.select("name", F.col("c.name").alias("child"), *[F.col(f"c.{e}").alias(f"child_{e}") for e in edge]).filter(~coin(F.col("child"), r))
        unary = staged(unary.join(child, "name"), "compressed")
        # what a compressed node holds beside its child's total
        pending.append(unary.select("name", "child", *[(F.col(s) + F.col(f"child_{e}")).alias(s) for s, e in zip(sums, edge, strict=True)]))
        moved = unary.select(F.col("child").alias("name"), F.col("parent").alias("up"), *[(F.col(s) + F.col(e)).alias(f"more_{e}") for s, e in zip(sums, edge, strict=True)])
        taken = stem.join(unary.select("name"), "name", "left_anti").join(moved, "name", "left")
        lives.append(written(taken.select("name", F.coalesce("up", "parent").alias("parent"), "kids", *sums, *[(F.col(e) + F.coalesce(f"more_{e}", F.lit(0))).alias(e) for e in edge]), "live"))
        live = tree.sparkSession.read.schema(shape).parquet(lives[-1])
        left = live.count()
    else:
        raise RuntimeError(f"the tree did not contract within {rounds} rounds")
    spark = tree.sparkSession
    # one scan of all rounds from `first` on, however many these are, so that the plan stays small
    ends = lambda first: spark.read.schema(shape).parquet(*lives[first:]).filter("kids = 0").select("name", *sums).unionByName(spark.read.schema(ended).parquet(*expanded))
    for r in range(len(pending) - 1, -1, -1):  # a child of what a round compressed got its total in a later one
        below = ends(r + 1).select(F.col("name").alias("child"), *[F.col(s).alias(f"below_{s}") for s in sums])
        expanded.append(written(pending[r].join(below, "child").select("name", *[(F.col(s) + F.col(f"below_{s}")).alias(s) for s in sums]), "expanded"))
    return ends(0)


def _ends(members: DataFrame) -> DataFrame:
    """name, ends_sha256: the digest of the ids of conversations that end in a node, fed id by id."""
    t = members.filter("last").select("name", "conv_id").repartition("name").sortWithinPartitions("name", "conv_id")

    def run(batches):
        out, now, sha = [], None, None
        for b in batches:
            for name, conv in zip(b.column("name").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if name != now:
                    if now is not None:
                        out.append((now, sha.hexdigest()))
                    now, sha = name, hashlib.sha256(str(conv).encode())
                else:
                    sha.update(f",{conv}".encode())
            if len(out) > 10_000:
                yield batch(out)
                out.clear()
        if now is not None:
            out.append((now, sha.hexdigest()))
        yield batch(out)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["name", "ends_sha256"])

    return t.mapInArrow(run, "name binary, ends_sha256 string")


def rest_of_path(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """nodes (conv_id, depth, and any columns) with the sums taken over each node and the deeper ones of its conversation."""
    t = nodes.repartitionByRange(F.col("conv_id"), F.col("depth").desc()).sortWithinPartitions(F.col("conv_id"), F.col("depth").desc())
    schema = f"{', '.join(f'`{n}` {k}' for n, k in nodes.dtypes)}, piece long"

    def run(batches):
        conv = piece = None
        had = [0] * len(sums)
        for b in batches:
            ids, depths = (np.asarray(b.column(c)) for c in ("conv_id", "depth"))
            if not len(ids):
                continue
            heads = np.flatnonzero(np.concatenate([[conv is None or int(ids[0]) != conv], ids[1:] != ids[:-1]]))
            # before the first head goes on what the last batch began
            number = np.searchsorted(heads, np.arange(len(ids)), side="right") - 1
            pieces = np.where(number < 0, -1 if piece is None else piece, depths[heads[np.maximum(number, 0)]] if len(heads) else 0)
            columns = {n: b.column(n) for n in b.schema.names} | {"piece": pa.array(pieces, pa.int64())}
            for k, name in enumerate(sums):
                run_on = np.cumsum(np.asarray(b.column(name)))
                before = np.concatenate([[-had[k]], run_on[heads - 1] * (heads > 0)])[number + 1]
                columns[name] = pa.array(run_on - before, pa.int64())
                had[k] = int(run_on[-1] - before[-1])
            conv, piece = int(ids[-1]), int(pieces[-1])
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    t = staged(t.mapInArrow(run, schema), "pieces")
    # a conversation has a piece for every task that it lies in, most have one
    whole = t.groupBy("conv_id", "piece").agg(*[F.max_by(s, -F.col("depth")).alias(f"whole_{s}") for s in sums])
    several = whole.groupBy("conv_id").agg(F.count(F.lit(1)).alias("pieces")).filter("pieces > 1").select("conv_id")
    several = staged(several.join(whole, "conv_id"), "several")
    deeper = several.withColumnRenamed("piece", "deeper")
    more = several.select("conv_id", "piece").join(deeper, "conv_id").filter("deeper > piece").groupBy("conv_id", "piece").agg(*[F.sum(f"whole_{s}").alias(f"more_{s}") for s in sums])
    return t.join(more, ["conv_id", "piece"], "left").select(*[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) if c in sums else c for c in nodes.columns])


def prefix_trie(members: DataFrame) -> DataFrame:
    """The trie's nodes with their totals. members: conv_id, depth, name, parent, points, last."""
    prepare(members.sparkSession)
    sums = ["n_leaves", "saved_tokens"]
    nodes = members.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("points").alias("points"), F.count(F.lit(1)).alias("n_convs"))
    nodes = staged(nodes, "nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")).join(above, "parent", "left")
    nodes = nodes.withColumns({"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("points")})
    nodes = staged(nodes.drop("points"), "trie")
    top = F.col("parent_conv_id") != F.col("conv_id")  # of a path that hangs below another
    paths = nodes.groupBy(F.col("conv_id").alias("name")).agg(F.max(F.when(top, F.col("parent_conv_id"))).alias("parent"), *[F.sum(s).alias(s) for s in sums])
    totals = contracted(paths, sums).select(F.col("name").alias("conv_id"), *[F.col(s).alias(f"path_{s}") for s in sums])
    hung = nodes.filter(top).select("conv_id", F.col("parent").alias("name")).join(totals, "conv_id").groupBy("name").agg(*[F.sum(f"path_{s}").alias(f"path_{s}") for s in sums])
    held = staged(nodes.join(hung, "name", "left").select("name", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *[(F.col(s) + F.coalesce(f"path_{s}", F.lit(0))).alias(s) for s in sums]), "held")
    out = rest_of_path(held, sums).join(_ends(members), "name", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt `conversations`, a row for each node."""
    return prefix_trie(staged(rebuilt(table(spark, sf_dir, "conversations")), "members"))


OP12_SQL = f"""WITH RECURSIVE t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n
    FROM conversations WHERE conv_id IS NOT NULL),
{crc_ctes("SELECT DISTINCT CAST(conv_id AS VARCHAR) AS s FROM t")},
c AS (SELECT CAST(s AS BIGINT) AS conv_id, crc % 6 AS h, CAST(s AS BIGINT) - CAST(s AS BIGINT) % 100 AS base FROM crc32),
lent AS (SELECT conv_id AS base, count(*) AS turns FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, t.n AS depth, role, text FROM c JOIN t ON t.conv_id = c.base AND t.n <= h
    UNION ALL SELECT c.conv_id, least(h, coalesce(turns, 0)) + t.n - h, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.n > h LEFT JOIN lent ON lent.base = c.base),
p AS (SELECT conv_id, depth, length(text) AS points, string_agg(md5(length(role) || ':' || role || text), '/') OVER (PARTITION BY conv_id ORDER BY depth) AS name FROM r
    UNION ALL SELECT conv_id, 0, 0, '' FROM c),
nodes AS (SELECT name, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(points) AS points,
    CASE WHEN any_value(depth) = 1 THEN '' WHEN any_value(depth) > 1 THEN left(name, length(name) - 33) END AS parent FROM p GROUP BY name),
kids AS (SELECT parent AS name, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
sums AS (SELECT p.name, count(*) FILTER (k.name IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.points) AS saved
    FROM nodes n LEFT JOIN kids k ON k.name = n.name JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.name),
ends AS (SELECT p.name, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids FROM p
    JOIN (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id) d ON d.conv_id = p.conv_id AND d.depth = p.depth GROUP BY p.name)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, above.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN kids ON kids.name = n.name JOIN sums ON sums.name = n.name LEFT JOIN ends ON ends.name = n.name LEFT JOIN nodes above ON above.name = n.parent"""
