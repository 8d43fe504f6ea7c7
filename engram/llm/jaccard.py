"""Operator 10: n-gram Jaccard join with token-combination prefixes.

A document is its set of distinct five-word shingles; documents link when 100 * intersection >= 80 * union. Tokens are
ordered by the number of sets that hold them, rarest first, and fall into three classes by that number, with bounds at the
sixth root of the number of sets and its square. Of a set x at most d = |x| - ceil(0.8 |x|) tokens are missing in a set
that links with it; tokens of no other set are among these and come first. Rare tokens are signatures one by one, those of
the second class in pairs, and those of the third in threes. Tokens of these two classes fall into groups by hash, about
one for each GROUP tokens of the set, and combinations are formed inside a group, so their number grows with the set's
size, not with its powers. A prefix is extended until its rare tokens, and of each group what is beyond k - 1 tokens, are
more than d less what no other set holds: then a set that links with x and had none of the signatures would miss more than
d tokens of it. Of two prefixes the one that ends first in the order holds such a combination, and the other one holds it
too. Groups depend on a set's size by powers of two; linked sets differ by a quarter at most, and a set so near to the
next power takes part in both. Sets of three shingles or fewer link with equal ones alone, which are one node.

All shingles of all documents are counted, in one exchange of packed arrays: tokens by the first bits of their hash (a
clash of those changes the order of tokens at most, never a link), sets by their place in the map task. What other sets
hold as well goes back to the task's sets, which then choose their signatures. Equal sets are one node. The nodes of a
signature are its list. First each node meets the others whose least list neighbour is the same (its hub) and the hub, and
is compared exactly with these; near copies of one text mostly find each other there. Lists all of whose nodes are then in
one component are done. Of the others those with the same least component are put together, and their nodes are compared
exactly with each other. So nodes are compared that share a list, or have one each with a node of one component;
components grow by real links alone, and a large group is compared in blocks of bounded size, whose tasks return as few
links as join what the links inside each block leave apart.

Defined results: a null or empty text, or one without words, has an empty set and links with nothing. A text of fewer
than five words has one shingle, its whole sequence. Rows with one doc_id are one document if their texts are equal. A
row without doc_id links with nothing and has a null component. Repeated rows are each returned. Ties go to the smaller
doc_id, equal counts by the token's hash. Texts of any length are compared whole; other columns are never read by the
join, and the stage returns the columns it got, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import broadcast_if_small, fresh, staged, table
from engram.llm.graph import components
from engram.llm.textvec import SPACED, Block, mix, shingle_sets, signed, slices

WORDS = 5
PERCENT = 80
#: Tokens of a set for each group in which combinations are formed.
GROUP = 32
#: Bits of a token's hash by which it is counted; tokens of one part of the count, about; shingles packed at once.
BITS, PART, PACKED = 44, 1 << 20, 800_000
#: Nodes and shingles of a block of a cohort (nodes that are compared with each other), about; two blocks meet in one task.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1 << 20


def missing(n: int) -> int:
    """Tokens of a set of n that a linked set can lack."""
    return n - -(-PERCENT * n // 100)


def classes(sets: int) -> tuple[int, int]:
    """Holders up to which a token is rare, and up to which it is paired."""
    root = max(1.0, float(sets)) ** (1 / 6)
    return int(root), int(root * root)


_chosen: dict[tuple[int, int], np.ndarray] = {}


def _choose(n: int, k: int) -> np.ndarray:
    """The k-combinations of 0..n-1 as columns."""
    if (n, k) not in _chosen:
        _chosen[n, k] = np.array(list(combinations(range(n), k)), dtype=np.int64).reshape(-1, k).T
    return _chosen[n, k]


def signatures(n: int, token: np.ndarray, held: np.ndarray, bounds: tuple[int, int]) -> np.ndarray:
    """The signatures of a set of n tokens; token, held: those that other sets hold as well, rarest first, and by how many sets."""
    need = missing(n) + 1 - (n - len(token))
    if need <= 0 or n <= 3:
        return token[:0]
    rare = int(np.searchsorted(held, bounds[0], side="right"))
    if rare >= need:
        return token[:need]
    out, many = [token[:rare]], token[rare:]
    k = np.where(held[rare:] > bounds[1], 3, 2)
    bits = n.bit_length() - 1
    for size in (bits, bits + 1) if 5 * n >= 8 << bits else (bits,):
        groups = max(1, (1 << size) // GROUP)
        group = ((many >> np.uint64(7)) % np.uint64(groups)).astype(np.int64) * 2 + (k == 3)
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0]))
        turn = np.empty(len(many), np.int64)  # a token's place in its group
        turn[order] = np.arange(len(many)) - np.repeat(first, np.diff(np.append(first, len(many))))
        end = int(np.searchsorted(np.cumsum(turn >= k - 1), need - rare)) + 1
        order = order[order < end]
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0, [True]])).tolist()
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            of = k[order[a]]
            if z - a >= of:
                mine = many[order[a:z]]
                x = np.zeros(1, np.uint64)
                for i in _choose(z - a, int(of)):
                    x = mix(x * np.uint64(0xD6E8FEB86659FD93) + mine[i])
                out.append(x)
    return np.concatenate(out)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set."""
    a = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
    return int(a[0]), int(a[1])


def nodes_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fp, check (null for an empty set)."""

    def run(batches):
        for b in slices(batches):
            sets = list(shingle_sets(Block(b.column("text"), SPACED), WORDS))
            prints = [fingerprint(s) if len(s) else (None, None) for s in sets]
            columns = [b.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "fp", "check"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, fp long, check long")


def _pack(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that the exchange's compression finds the empty ones."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unpack(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _runs(batches, key: str) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each key; those of one key stand together."""
    now, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if r[key] != now:
                if rows:
                    yield now, rows
                now, rows = r[key], []
            rows.append(r)
    if rows:
        yield now, rows


def signed_sets(docs: DataFrame, shingles: int, sets: int) -> DataFrame:
    """(sig, fp): the signatures of every set; some rows twice. shingles: of all sets together."""
    bounds = classes(sets)
    parts_bits = max(5, (shingles // PART).bit_length())
    packed = "part long, pack long, first long, gaps binary, place binary, fps binary, sizes binary"
    back = "pack long, token binary, place binary, held binary, fps binary, sizes binary"

    def index(batches):
        task, made, seen = TaskContext.get().partitionId(), 0, set()
        tokens, fps, sizes, total = [], [], [], 0

        def flush():
            nonlocal made
            pack = (task << 20) + made
            made += 1
            key = np.concatenate(tokens) >> np.uint64(64 - BITS)
            place = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
            order = np.argsort(key, kind="stable")
            key, place = key[order], place[order]
            cuts = np.searchsorted(key, np.arange((1 << parts_bits) + 1, dtype=np.uint64) << np.uint64(BITS - parts_bits))
            rows = []
            for part, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if z > a:
                    rows.append((part, pack, int(key[a]), _pack(np.diff(key[a:z], prepend=key[a])), _pack(place[a:z]), None, None))
            rows.append((pack % (1 << parts_bits), pack, 0, None, None, np.array(fps).tobytes(), np.array(sizes, np.int64).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in packed.split(", ")])

        for b in slices(batches):
            for s in shingle_sets(Block(b.column("text"), SPACED), WORDS):
                fp = fingerprint(s)[0] if len(s) else None
                if fp is None or fp in seen:
                    continue
                seen.add(fp)
                tokens.append(s)
                fps.append(fp)
                sizes.append(len(s))
                total += len(s)
                if total > PACKED or len(sizes) > 65_000:
                    yield flush()
                    tokens, fps, sizes, total = [], [], [], 0
                    seen.clear()
        if sizes:
            yield flush()

    def count(batches):
        """For each pack the tokens of a part that more than one set holds."""
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        names = [x.split()[0] for x in back.split(", ")]
        for _, rows in _runs(batches, "part"):
            out = [(r["pack"], None, None, None, r["fps"], r["sizes"]) for r in rows if r["fps"] is not None]
            rows = [r for r in rows if r["fps"] is None]
            if rows:
                keys = [np.uint64(r["first"]) + np.cumsum(_unpack(r["gaps"], np.uint64)) for r in rows]
                owner = np.repeat(np.arange(len(rows)), [len(k) for k in keys])
                key, place = np.concatenate(keys), np.concatenate([_unpack(r["place"], np.uint16) for r in rows])
                order = np.argsort(key, kind="stable")
                head = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) > 0]))
                runs = np.diff(np.append(head, len(key)))
                held = np.empty(len(key), np.uint32)
                held[order] = np.repeat(runs, runs)
                again = held > 1
                cuts = np.searchsorted(owner[again], np.arange(len(rows) + 1))
                key, place, held = key[again], place[again], held[again]
                out += [(r["pack"], key[a:z].tobytes(), place[a:z].tobytes(), held[a:z].tobytes(), None, None) for r, a, z in zip(rows, cuts[:-1], cuts[1:], strict=True) if z > a]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def sign(batches):
        for _, rows in _runs(batches, "pack"):
            fps, sizes = (np.frombuffer(next(r[c] for r in rows if r["fps"] is not None), np.int64) for c in ("fps", "sizes"))
            rows = [r for r in rows if r["fps"] is None]
            if not rows:
                continue
            token, place, held = (np.concatenate([np.frombuffer(r[c], kind) for r in rows]) for c, kind in (("token", np.uint64), ("place", np.uint16), ("held", np.uint32)))
            order = np.lexsort((token, held, place))
            token, held = token[order], held[order]
            cuts = np.searchsorted(place[order], np.arange(len(sizes) + 1))
            found = [np.unique(signatures(int(n), token[a:z], held[a:z], bounds)) for n, a, z in zip(sizes, cuts[:-1], cuts[1:], strict=True)]
            sig, fp = signed(np.concatenate(found)), np.repeat(fps, [len(x) for x in found])
            if len(sig):
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(fp)], ["sig", "fp"])

    counted = docs.select("text").mapInArrow(index, packed).repartition("part").sortWithinPartitions("part").mapInArrow(count, back)
    return counted.repartition("pack").sortWithinPartitions("pack").mapInArrow(sign, "sig long, fp long")


class _Sets:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def forest(sets: list[np.ndarray], block: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets, or, where they are of two blocks, as few links between the blocks as join what the
    links inside each leave apart (another task finds those): shared tokens are counted for all pairs, by rare tokens one by one, by others as blocks of a 0/1 matrix product."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    token, who = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(token, kind="stable")
    token, who = token[order], who[order]
    head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    count = np.diff(np.append(head, len(token)))
    shared = np.zeros((n, n), dtype=np.float32)
    few = np.repeat(count <= 12, count)
    t, w = token[few], who[few]
    for gap in range(1, 12):
        same = np.flatnonzero(t[gap:] == t[:-gap]) if len(t) > gap else []
        if not len(same):
            break
        np.add.at(shared, (w[same], w[same + gap]), 1)
    shared += shared.T
    wide = np.flatnonzero(count > 12)
    for a in range(0, len(wide), 4096):
        part = wide[a : a + 4096]
        x = np.zeros((n, len(part)), dtype=np.float32)
        x[np.concatenate([who[head[k] : head[k] + count[k]] for k in part]), np.repeat(np.arange(len(part)), count[part])] = 1
        shared += x @ x.T
    both = shared.astype(np.int64)
    i, j = np.nonzero(np.triu(100 * both >= PERCENT * (size[:, None] + size[None, :] - both), 1))
    joined = _Sets(n)
    across = block[i] != block[j]
    if across.any():
        for x, y in zip(i[~across].tolist(), j[~across].tolist(), strict=True):
            joined.join(x, y)
        i, j = i[across], j[across]
    elif (block != block[0]).any():
        return []
    return [(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True) if joined.join(x, y)]


def verified(docs: DataFrame, cohorts: DataFrame, few: int) -> DataFrame:
    """(a, b): a spanning forest of the exact links inside each cohort. cohorts: doc_id, cohort, n_shingles of nodes."""
    sizes = cohorts.groupBy("cohort").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n_shingles").alias("shingles")).filter("nodes > 1")
    blocks = F.greatest(F.ceil(F.col("nodes") / BLOCK_NODES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    want = cohorts.join(sizes, "cohort").select("doc_id", "cohort", blocks.alias("blocks"))
    texts = docs.select("doc_id", "text").join(broadcast_if_small(want, few), "doc_id")
    schema = "cohort long, task long, block long, doc_id long, tokens binary"

    def spread(batches):
        """Each set goes to the tasks of its block with every block of the cohort."""
        for b in slices(batches):
            rows = []
            for doc, cohort, blocks, s in zip(b.column("doc_id").to_pylist(), b.column("cohort").to_pylist(), b.column("blocks").to_pylist(), shingle_sets(Block(b.column("text"), SPACED), WORDS), strict=True):
                own = int(mix(np.array([doc], np.int64).view(np.uint64))[0] % np.uint64(blocks))
                for other in range(blocks):
                    i, j = min(own, other), max(own, other)
                    rows.append((cohort, i * blocks + j, own, doc, s.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["cohort", "task", "block", "doc_id", "tokens"])

    def compare(batches):
        """Rows of one task of a cohort stand together."""

        def groups() -> Iterator[list]:
            task, group = None, []
            for b in batches:
                for c, t, own, doc, tokens in zip(*(b.column(x).to_pylist() for x in ("cohort", "task", "block", "doc_id", "tokens")), strict=True):
                    if (c, t) != task:
                        if len(group) > 1:
                            yield group
                        task, group = (c, t), []
                    group.append((doc, (own, tokens)))
            if len(group) > 1:
                yield group

        out = []
        for group in groups():
            found = dict(group)  # a repeated row counts once
            ids = list(found)
            if len(ids) > 1:
                out += [(ids[i], ids[j]) for i, j in forest([np.frombuffer(found[x][1], np.uint64) for x in ids], np.array([found[x][0] for x in ids]))]
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], ["a", "b"])

    return texts.mapInArrow(spread, schema).repartition("cohort", "task").sortWithinPartitions("cohort", "task").mapInArrow(compare, "a long, b long")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = docs.select("doc_id", "text")
    each = staged(nodes_of(docs), "nodes")
    nodes = staged(each.filter("fp is not null and doc_id is not null").groupBy("fp", "check").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles")), "sets")
    shingles, sets = nodes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count(F.lit(1))).head()
    pairs = signed_sets(docs, shingles, sets).distinct()
    pairs = staged(pairs.join(nodes.select("fp", "doc_id", "n_shingles"), "fp").select("sig", "doc_id", "n_shingles"), "signatures")
    hubs = pairs.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("hub")).filter("n > 1").select("sig", "hub")
    lists = staged(pairs.join(hubs, "sig"), "lists")
    stars = lists.groupBy("doc_id").agg(F.min("hub").alias("cohort"), F.first("n_shingles").alias("n_shingles"))
    own = lists.filter("doc_id = hub").select("doc_id", F.col("doc_id").alias("cohort"), "n_shingles")
    stars = staged(stars.unionByName(own).distinct(), "stars")
    links = staged(verified(docs, stars, stars.count()), "links")
    found = components(links)
    parts = lists.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("sig", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    meet = parts.groupBy("sig").agg(F.min("component").alias("cohort"), F.max("component").alias("most")).filter("cohort < most").select("sig", "cohort")
    rest = parts.join(meet, "sig").select("doc_id", "cohort", "n_shingles")
    # sizes of linked sets are a quarter apart at most: a node that has no other of its cohort in its size class or the next ones meets none
    rest = staged(rest.distinct().withColumn("size", F.floor(F.log("n_shingles") / F.log(F.lit(1.25))).cast("int")), "rest")
    filled = rest.groupBy("cohort", "size").agg(F.count(F.lit(1)).alias("n"))
    near = filled.select("cohort", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"), "n").groupBy("cohort", "size").agg(F.sum("n").alias("n")).filter("n > 1")
    rest = staged(rest.join(near.drop("n"), ["cohort", "size"]).drop("size"), "near")
    linked = components(links.unionByName(verified(docs, rest, rest.count())))
    named = nodes.join(linked, nodes["doc_id"] == linked["id"], "left").select("fp", "check", F.coalesce("component", "doc_id").alias("component_id"))
    rows = each.join(named, ["fp", "check"], "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", alone.alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest doc_id; rows without doc_id stay."""
    gone = staged(jaccard_components(docs).filter("component_id <> doc_id").select("doc_id").distinct().toDF(fresh("__gone", docs)), "gone")
    return docs.join(broadcast_if_small(gone, gone.count()), docs["doc_id"] == gone[gone.columns[0]], "left_anti")


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
OP10_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_W} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 80 * (x.n + y.n - both_have)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS other FROM ways UNION SELECT r.doc_id, ways.b FROM reach r JOIN ways ON ways.a = r.other)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(m, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1) r ON r.doc_id = d.doc_id
"""
