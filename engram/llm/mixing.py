"""Operator 8: mix overlapping sources to target weights by min-cost flow, then pick seeded documents.

Sources overlap where they hold the same text. A text's membership pattern is the sorted set of the sources that hold it,
and documents are aggregated by pattern and by their own source. A pattern can give the words of its distinct texts once
for nothing, and again at a cost that rises by one each time (a convex cost of repetition, wherever the copies stand), to
any of its sources, as far as MOST_TIMES the words of its own documents there go. Each source asks for its quota of words.
The flow over patterns and sources so prefers texts that no other source has taken. Inside a pattern the seeded hash of
the text orders the documents, and each source starts where the one before it stopped, so that sources that share texts
take different ones as long as they can. That cut stops short of the quota in every cell; what a source then lacks is made up
by whole documents of its own that may be taken once more: PURSE of each size class (powers of two), the largest that fit first.

Sums per source and per pattern and source reach the driver. The MOST_PATTERNS heaviest patterns are told apart; lighter
ones are summed by their first source, so at most MOST_PATTERNS + sources rows for each source come, none for documents.

Defined results: a null text has size 0, a null source is a source of its own that sorts last. A document of size 0 is
never taken, and neither is one of an empty table. Repeated rows are documents of their own and are taken alike; ties of
the hash are taken together. Texts of any length are counted whole. Columns that are called like results are replaced by them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import broadcast_if_small, staged, table

WEIGHTS = (5.0, 2.0, 1.0)
MOST_TIMES = 3
SEED = 8
#: Patterns that the flow tells apart (all there can be of eight sources).
MOST_PATTERNS = 256
#: Documents of each source and size class among which those are that fill its quota up.
PURSE = 8


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most_times: float = MOST_TIMES) -> DataFrame:
    """(source, source_size) -> the same with target.

    Sources by code point, null last, get the weights in turn and share all sizes by them; a target stops at
    most_times its source's size and the excess goes to the others by weight. With r = cap / weight ascending,
    the sources capped are a prefix, so the level of the others follows from running sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ring = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("weight", F.element_at(ring, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    w = w.withColumn("cap", F.lit(float(most_times)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = w.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct(F.col("ratio"), F.col("level")))).over(everything)["level"]
    return w.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * level, F.col("cap")))).select("source", "source_size", "target")


def min_cost_flow(once: Sequence[float], limits: Sequence[dict[int, float]], quota: Sequence[float]) -> list[dict[int, float]]:
    """Words that each pattern gives to each of its sources, at least cost among the flows that fill the quotas as far as they can.

    once: words of a pattern at each cost 0, 1, 2, ..., as often as its limits allow; limits: words of a pattern for each source.
    Costs lie on the patterns alone, so what patterns can give is a polymatroid, and filling the quotas level by level with
    as much as goes in gives the least cost: each level is a maximum flow on what the levels before have left.
    """
    n_p, sink = len(once), len(once) + len(quota) + 1
    to, left, out = [], [], [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, words: float) -> int:
        for x, y, w in ((a, b, words), (b, a, 0.0)):
            to.append(y)
            left.append(float(w))
            out[x].append(len(to) - 1)
        return len(to) - 2

    enters = [arc(0, 1 + p, 0.0) for p in range(n_p)]
    gives = [{s: arc(1 + p, 1 + n_p + s, words) for s, words in row.items()} for p, row in enumerate(limits)]
    fills = [arc(1 + n_p + s, sink, q) for s, q in enumerate(quota)]
    little = 1e-9 * max(1.0, sum(quota))

    def push(a: int, most: float, depth: list[int], turn: list[int]) -> float:
        """Sends up to `most` words from a to the sink along arcs that go one step deeper."""
        if a == sink:
            return most
        sent = 0.0
        while turn[a] < len(out[a]):
            e = out[a][turn[a]]
            if left[e] > little and depth[to[e]] == depth[a] + 1:
                part = push(to[e], min(most - sent, left[e]), depth, turn)
                left[e] -= part
                left[e ^ 1] += part
                sent += part
                if most - sent <= little:
                    return sent
            turn[a] += 1
        return sent

    levels = max((math.ceil(sum(row.values()) / words) for row, words in zip(limits, once, strict=True) if words > 0), default=0)
    for _ in range(levels):
        if sum(left[e] for e in fills) <= little:
            break
        for p, e in enumerate(enters):
            left[e] += once[p]
        while True:
            depth, row = [-1] * (sink + 1), [0]
            depth[0] = 0
            while row and depth[sink] < 0:
                found = {to[e] for a in row for e in out[a] if left[e] > little and depth[to[e]] < 0}
                for a in found:
                    depth[a] = depth[row[0]] + 1
                row = sorted(found)
            if depth[sink] < 0 or push(0, float("inf"), depth, [0] * (sink + 1)) <= little:
                break
    return [{s: left[e ^ 1] for s, e in row.items()} for row in gives]


def _below(docs: DataFrame, want: DataFrame, cells: int) -> DataFrame:
    """(cell, below): the hash below which a cell's documents sum to at most `extra` words: two rounds of 2**16 bins, each a
    partial sum, whose 256 coarse bins say in which of them to look."""

    def cut(binned: DataFrame, want: DataFrame) -> DataFrame:
        """The first bin of each cell at whose end the running sum passes `left`, and the sum before it."""
        sums = staged(binned.groupBy("cell", "bin").agg(F.sum("size").alias("words")), "bins")
        for shift in (8, 0):
            part = sums.groupBy("cell", F.shiftright("bin", shift).alias("b")).agg(F.sum("words").alias("words"))
            run = part.withColumn("upto", F.sum("words").over(Window.partitionBy("cell").orderBy("b"))).join(broadcast_if_small(want.select("cell", "left"), cells), "cell").filter(F.col("upto") > F.col("left"))
            found = run.groupBy("cell").agg(F.min_by(F.struct("b", "words", (F.col("upto") - F.col("words")).alias("under")), "b").alias("c")).select("cell", "c.*")
            if shift:
                found = found.withColumnRenamed("b", "coarse")
                sums = sums.join(broadcast_if_small(found.select("cell", "coarse"), cells), "cell").filter(F.shiftright("bin", 8) == F.col("coarse"))
                want = want.join(found.select("cell", "under"), "cell").withColumn("left", F.col("left") - F.col("under")).drop("under")
        return want.join(found, "cell").withColumn("left", F.col("left") - F.col("under")).drop("under")

    high, low = F.shiftrightunsigned("hash", 16), F.col("hash").bitwiseAND(0xFFFF)
    first = staged(cut(docs.select("cell", "size", high.alias("bin")), want.select("cell", F.col("extra").alias("left"))).select("cell", F.col("b").alias("high"), "left"), "high")
    inside = docs.join(broadcast_if_small(first.select("cell", "high"), cells), "cell").filter(high == F.col("high"))
    second = cut(inside.select("cell", "size", low.alias("bin")), first)
    return second.select("cell", (F.col("high") * 65536 + F.col("b")).alias("below"))


def fill_up(lacks: float, purse: Sequence[tuple[int, object]]) -> list[object]:
    """The largest of a purse of (size, name) that still fit into what a source lacks, in turn, and one more where that comes nearer."""
    taken, rest = [], []
    for size, name in sorted(purse, key=lambda x: -x[0]):
        if size <= lacks:
            taken.append(name)
            lacks -= size
        else:
            rest.append((size, name))
    if rest and rest[-1][0] < 2 * lacks:
        taken.append(rest[-1][1])
    return taken


def mix(docs: DataFrame, source: Column | None = None, *, weights: Sequence[float] = WEIGHTS, most_times: int = MOST_TIMES, seed: int = SEED, most_patterns: int = MOST_PATTERNS, key: Column | None = None, rows: bool = False) -> DataFrame:
    """key, size, source, source_size, target, pattern (JSON), epochs (times the mix takes a document), taken (words, repeats counted).

    source: the source of a document, whose size it counts in. rows: adds the struct `row` of all columns of docs.
    """
    spark = docs.sparkSession
    key = F.col("doc_id") if key is None else key
    source = F.col("source") if source is None else source
    base = docs.select(*([F.struct(*docs.columns).alias("row")] if rows else []), key.alias("key"), source.alias("source"), n_words(F.col("text")).alias("size"), *[F.xxhash64(F.lit(i), "text").alias(f"t{i}") for i in (1, 2)])
    narrow = staged(base.drop("row"), "sizes")
    per_source = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_times)
    quota = [(r["source"], float(r["target"]), int(r["source_size"])) for r in per_source.collect()]
    number = {s: i for i, (s, _, _) in enumerate(quota)}

    # a text's sources: partial sums for each text and source first, so a text in a third of all rows is few rows here
    each = narrow.filter("size > 0").groupBy("t1", "t2", "source").agg(F.max("size").alias("size"))
    of_text = staged(each.groupBy("t1", "t2").agg(F.max("size").alias("size"), F.to_json(F.sort_array(F.collect_set(F.struct("source")))).alias("pattern"), F.count(F.lit(1)).alias("n")), "texts")
    shared = of_text.filter("n > 1").select("t1", "t2", F.col("pattern").alias("of_text"))
    n_shared = shared.count()
    heavy = of_text.groupBy("pattern").agg(F.sum("size").alias("once"), F.max("n").alias("n"))
    heavy = heavy.orderBy((F.col("n") == 1).desc(), F.col("once").desc(), "pattern").limit(len(quota) + most_patterns)
    told = {r["pattern"]: float(r["once"]) for r in heavy.collect()}
    known = F.broadcast(spark.createDataFrame([(p,) for p in told], "told string"))  # at most sources + most_patterns rows
    folded = F.when(F.col("told").isNotNull(), F.col("pattern")).otherwise(F.concat(F.get_json_object("pattern", "$[0]"), F.lit("+")))
    fold = lambda df: df.join(known, df["pattern"] == known["told"], "left").withColumn("pattern", folded).drop("told")
    once = {r["pattern"]: float(r["once"]) for r in fold(of_text).groupBy("pattern").agg(F.sum("size").alias("once")).collect()}

    def with_pattern(df: DataFrame) -> DataFrame:
        out = df.join(broadcast_if_small(shared, n_shared), ["t1", "t2"], "left")
        return fold(out.withColumn("pattern", F.coalesce("of_text", F.to_json(F.array(F.struct("source"))))).drop("of_text"))

    named = staged(with_pattern(narrow), "patterns")
    cells = [(r["pattern"], r["source"], int(r["words"])) for r in named.filter("size > 0").groupBy("pattern", "source").agg(F.sum("size").alias("words")).orderBy("pattern", F.col("source").asc_nulls_last()).collect()]

    names = list(dict.fromkeys(p for p, _, _ in cells))
    limits: list[dict[int, float]] = [{} for _ in names]
    for p, s, words in cells:
        limits[names.index(p)][number[s]] = float(most_times * words)
    flow = min_cost_flow([once[p] for p in names], limits, [q for _, q, _ in quota])
    plan, start = [], {}
    for p, s, words in cells:
        total = flow[names.index(p)].get(number[s], 0.0)
        full = min(most_times, int((total + 1e-6 * words) // words))
        extra = max(0.0, total - full * words) if full < most_times else 0.0
        plan.append((len(plan), p, s, full, extra, int(start.get(p, 0.0) * (1 << 16)) & 0xFFFF))
        start[p] = start.get(p, 0.0) + extra / words
    chosen = spark.createDataFrame(plan, "cell int, pattern string, source string, full int, extra double, start int")

    def placed(df: DataFrame) -> DataFrame:
        """With the cell's plan and the hash: the text says where a document lies among those of its pattern, its key where among the text's copies."""
        cell = broadcast_if_small(chosen.withColumnsRenamed({"pattern": "p", "source": "s"}), len(plan))
        out = df.join(cell, (df["pattern"] == cell["p"]) & df["source"].eqNullSafe(cell["s"]), "left").drop("p", "s")
        text_part = F.pmod(F.xxhash64(F.lit(seed), "t1", "t2").bitwiseAND(0xFFFF) - F.col("start"), F.lit(1 << 16))
        return out.withColumn("hash", text_part * 65536 + F.xxhash64(F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit(""))).bitwiseAND(0xFFFF))

    below = _below(placed(named).filter("extra > 0 and size > 0").select("cell", "size", "hash"), chosen.filter("extra > 0"), len(plan))
    below = staged(below.withColumnRenamed("cell", "c"), "below")
    more = F.when((F.col("extra") > 0) & (F.col("hash") < F.coalesce("below", F.lit(1 << 32))), 1).otherwise(0)

    def cut(df: DataFrame) -> DataFrame:
        out = placed(df).join(broadcast_if_small(below, len(plan)), F.col("cell") == F.col("c"), "left")
        return out.withColumn("epochs", F.when(F.col("size") > 0, F.col("full") + more).otherwise(0))

    # what each source lacks, and a purse of its documents: next in the cell's order, those not taken yet first; equal rows are one and go together
    early = staged(cut(named).filter("size > 0").select(F.col("key").cast("string").alias("k"), "source", "t1", "t2", "size", "epochs", F.pmod(F.col("hash") - F.coalesce("below", F.lit(0)), F.lit(1 << 32)).alias("turn")), "early")
    given = {r["source"]: r["words"] for r in early.groupBy("source").agg(F.sum(F.col("epochs") * F.col("size")).alias("words")).collect()}
    lacks = [(s, t - given.get(s, 0)) for s, t, _ in quota if t - given.get(s, 0) >= 0.5]
    short = spark.createDataFrame(lacks, "s string, lacks double")
    open_ = early.filter(F.col("epochs") < most_times).join(broadcast_if_small(short, len(lacks)), F.col("source").eqNullSafe(F.col("s"))).filter("size < 2 * lacks")
    of_key = open_.groupBy("k", "source", "t1", "t2", "epochs", "turn").agg(F.sum("size").alias("size"))
    in_class = Window.partitionBy("source", F.floor(F.log2("size"))).orderBy("epochs", "turn", "k", "t1", "t2")
    purses: dict[object, list] = {s: [] for s, _ in lacks}
    for r in of_key.withColumn("r", F.row_number().over(in_class)).filter(F.col("r") <= PURSE).collect():  # at most PURSE of each source and class
        purses[r["source"]].append((int(r["size"]), (r["k"], r["source"], r["t1"], r["t2"])))
    added = [name for s, lack in lacks for name in fill_up(lack, sorted(purses[s], key=str))]
    plus = spark.createDataFrame(added, "ak string, asource string, a1 long, a2 long").withColumn("plus", F.lit(1))
    is_plus = F.col("key").cast("string").eqNullSafe(F.col("ak")) & F.col("source").eqNullSafe(F.col("asource")) & (F.col("t1") == F.col("a1")) & (F.col("t2") == F.col("a2"))
    times = cut(with_pattern(base) if rows else named).join(broadcast_if_small(plus, len(added)), is_plus, "left")
    times = times.withColumn("epochs", F.col("epochs") + F.coalesce("plus", F.lit(0)))
    sums = spark.createDataFrame([(s, z, t) for s, t, z in quota], "s string, source_size long, target double")
    out = times.join(broadcast_if_small(sums, len(quota)), times["source"].eqNullSafe(sums["s"]))
    return out.withColumn("taken", F.col("epochs") * F.col("size")).select(*(["row"] if rows else []), "key", "size", "source", "source_size", "target", "pattern", "epochs", "taken")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(F.col("key").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), "target", F.col("taken").cast("long").alias("taken"), F.col("epochs").cast("int").alias("epochs"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (epochs) and with how many words (taken); columns of these names are replaced."""
    mixed = mix(docs, rows=True).filter("epochs > 0")
    old = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("epochs", "taken")]
    return mixed.select(*old, F.col("epochs").cast("int").alias("epochs"), F.col("taken").cast("long").alias("taken"))
