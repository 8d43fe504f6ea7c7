"""Operator 4: quality by hierarchical empirical Bayes.

A logistic classifier over a text's shape (repetition, symbols, case, lines, word lengths) is trained on a bounded
labelled sample and gives each document's evidence: its log likelihood ratio of good against bad. Documents stand
under a host and a path of that host (here source and lang). The good share of each path is estimated from the summed
posteriors of its documents, shrunk toward its host's share, and that toward the global one; how strongly comes by moments
from the spread of hosts, and of paths around their own host. The prior of a document's path, taken without the document
itself, and its evidence make its posterior.

The sums are grouped partial aggregates over all documents. The sites' table is broadcast only while its counted rows
are few, else joined by shuffle. Defined results: null or empty texts have the evidence of an empty text; a null host or
path is a site of its own; a long text is read whole; repeated rows count and are scored as often as they stand, alike; a
posterior of exactly THRESHOLD is kept; other columns are carried, whatever their names; an empty table gives no rows;
without labels of both values nothing is rejected (the posterior is 1).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import broadcast_if_small, fresh, staged, table
from engram.llm.linear import decide, fit_logistic
from engram.llm.textvec import SPACED, Block, slices

#: Labelled rows on which the classifier is fitted, at most, by seeded hash.
SAMPLE = 20_000
SEED = 4
#: A document is rejected where the posterior of being good is below this.
THRESHOLD = 0.5
SITE = ("source", "lang")
EVIDENCE = "__evidence"
_MARKS = tuple(b"|#&%*$!?.,;:\"'()<>[]{}/\\=+-_@~^")


def shape(block: Block) -> np.ndarray:
    """texts x features, all from the whole text."""
    n = block.n
    size = np.maximum(np.diff(block.at), 1).astype(float)
    words = np.maximum(block.counts(), 1).astype(float)
    csum = lambda x: np.concatenate([[0], np.cumsum(x)])
    per_word = lambda x: (lambda c: c[block.first[1:]] - c[block.first[:-1]])(csum(x))
    owner = np.repeat(np.arange(n, dtype=np.int64) * 256, np.diff(block.at))
    count = np.bincount(owner + block.raw, minlength=n * 256).reshape(n, 256) if n else np.zeros((0, 256))
    out = [np.sqrt(count[:, mark] / size) for mark in _MARKS]
    part = lambda a, z: count[:, a:z].sum(1) / size
    lines = count[:, 10] + 1.0
    out += [part(65, 91), part(48, 58), part(128, 256), part(0, 9), lines / words, np.log1p(words), np.log(size / words)]
    h, doc = block.h, block.doc
    for gap in (1, 2, 3):  # words that come again at once, or in a short period
        again = np.zeros(len(h), dtype=bool)
        if len(h) > gap:
            again[gap:] = (h[gap:] == h[:-gap]) & (doc[gap:] == doc[:-gap])
        out.append(per_word(again) / words)
    length = block.end - block.start
    last = block.raw[block.end - 1] if len(h) else np.empty(0, np.uint8)
    marked = ~(((last >= 48) & (last <= 57)) | ((last >= 65) & (last <= 90)) | ((last >= 97) & (last <= 122)) | (last >= 128))
    out += [per_word(marked) / words, per_word(length == 1) / words, per_word(length > 12) / words, per_word(length <= 3) / words]
    distinct = np.ones(n)
    common = np.zeros(n)
    for i in range(n):
        a, b = block.first[i], block.first[i + 1]
        if b > a:
            count = np.unique(h[a:b], return_counts=True)[1]
            distinct[i], common[i] = len(count) / (b - a), count.max() / (b - a)
    out += [distinct, common, distinct * np.log1p(words)]
    return np.stack(out, axis=1).astype(float)


def fit_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple | None:
    """(weights, mean, scale, prior log-odds), or None where the labels show one class only."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    known = known.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(sample)

    def rows(batches):
        for b in slices(batches):
            x = np.hstack([shape(Block(b.column("text"), SPACED)), np.asarray(b.column("quality"), dtype=float)[:, None]]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    got = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "quality").mapInArrow(rows, "x binary").collect()
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got]).astype(float) if got else np.zeros((0, 1))
    y = x[:, -1]
    if not 0 < (y >= 0.5).sum() < len(y):
        return None
    order = np.lexsort(x.T)  # the same fit whatever order the rows come in
    x, y = x[order], y[order]
    fitted = fit_logistic(np.hstack([x[:, :-1], x[:, :-1] ** 2]), y, ridge=3.0)
    return (*fitted, float(np.log(y.mean() / (1 - y.mean()))))


def with_evidence(docs: DataFrame, model: tuple | None, columns: Sequence[str]) -> DataFrame:
    """The named columns and last, under a name that docs don't have, the log likelihood ratio of good against bad. columns has text."""
    columns = list(columns)
    name = fresh(EVIDENCE, docs)
    schema = docs.select(*columns).schema.add(name, "double")

    def run(batches):
        for b in slices(batches):
            if model is None:
                e = np.full(b.num_rows, 50.0)
            else:
                x = shape(Block(b.column("text"), SPACED))
                e = np.clip(decide(np.hstack([x, x**2]), model[:3]) - model[3], -50, 50)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(e)], [*columns, name])

    return docs.select(*columns).mapInArrow(run, schema)


def _strength(chance: float, spread: float) -> float:
    """Beta strength a + b of shares that differ by `spread` (variance beyond sampling), where m (1 - m) is `chance`."""
    return float(np.clip(chance / spread - 1, 1.0, 1e6)) if spread > 1e-9 else 1e6


def sites(evidence: DataFrame, prior: float) -> DataFrame:
    """(host, path, good, n, host_good, host_n, mean, over_hosts, over_paths): the summed posteriors and documents of every path and
    of its host, the global share, and how strongly hosts are drawn to it and paths to their host. evidence: host, path, evidence.

    The strength toward the global share is from the spread of hosts, that toward the host from the spread of paths around their own host's share.
    """
    p = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(prior))))
    paths = staged(evidence.groupBy("host", "path").agg(F.sum(p).alias("good"), F.count(F.lit(1)).alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"), F.count(F.lit(1)).alias("paths"))
    joined = staged(paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.host", "p.path", "good", "n", "host_good", "host_n", "paths"), "shares")
    share = F.col("host_good") / F.col("host_n")
    h = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("g"), F.sum(F.col("host_n") * share * share).alias("s"), F.count(F.lit(1)).alias("k")).head()
    mean, over_hosts, over_paths = 0.5, 1e6, 1e6
    if h["n"]:
        mean = h["g"] / h["n"]
        over_hosts = _strength(mean * (1 - mean), h["s"] / h["n"] - mean * mean - mean * (1 - mean) * h["k"] / h["n"])
        own = F.col("good") / F.col("n")
        chance = share * (1 - share)
        w = joined.agg(F.sum(F.col("n") * (own - share) * (own - share)).alias("s"), F.sum(F.col("n") * chance).alias("v"), F.sum(chance * (1 - 1 / F.col("paths"))).alias("e")).head()
        over_paths = _strength(w["v"] / h["n"], (w["s"] - w["e"]) / h["n"])
    return joined.select("host", "path", "good", "n", "host_good", "host_n", *[F.lit(float(x)).alias(c) for c, x in (("mean", mean), ("over_hosts", over_hosts), ("over_paths", over_paths))])


def prior_without(p: Column | float) -> Column:
    """Over the columns of sites: the log-odds of a path's good share, shrunk toward its host's, that toward the global one; both without one document of posterior p."""
    one = F.lit(0) if isinstance(p, float) else F.lit(1)
    p = F.lit(p) if isinstance(p, float) else p
    c = F.col
    host = (c("mean") * c("over_hosts") + c("host_good") - p) / (c("over_hosts") + c("host_n") - one)
    share = (host * c("over_paths") + c("good") - p) / (c("over_paths") + c("n") - one)
    share = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), share))
    return F.log(share / (1 - share))


def assess(docs: DataFrame, labels: DataFrame, *, site: tuple[str, str] = SITE, columns: Sequence[str] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The named columns with evidence, site_prior (both log-odds) and posterior, the probability of being good; their names begin with prefix."""
    columns = list(columns)
    model = fit_classifier(docs, labels)
    prior = model[3] if model else 0.0
    scored = with_evidence(docs, model, ["text", *site])
    found = scored.columns[-1]
    every_site = sites(scored.select(F.col(site[0]).alias("host"), F.col(site[1]).alias("path"), F.col(found).alias("evidence")), prior)
    few = broadcast_if_small(every_site, every_site.count())
    kept = list(dict.fromkeys([*columns, "text", *site]))
    every = with_evidence(docs, model, kept)
    found = every.columns[-1]
    # columns of docs travel in a struct, so that they can have any name
    every = every.select(F.struct(*columns).alias("row"), F.col(site[0]).alias("of_host"), F.col(site[1]).alias("of_path"), F.col(found).alias("evidence"))
    out = every.join(few, F.col("of_host").eqNullSafe(F.col("host")) & F.col("of_path").eqNullSafe(F.col("path")), "left")
    out = out.withColumn("site_prior", prior_without(1 / (1 + F.exp(-(F.col("evidence") + F.lit(prior))))))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + F.col("site_prior"))))
    return out.select(*[F.col("row")[c].alias(c) for c in columns], F.col("evidence").alias(f"{prefix}evidence"), F.col("site_prior").alias(f"{prefix}site_prior"), posterior.alias(f"{prefix}posterior"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("keep", (F.col("posterior") >= THRESHOLD).cast("int"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not rejected."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    out = assess(docs, table(spark, sf_dir, "labels"), columns=docs.columns, prefix=prefix)
    return out.filter(F.col(f"{prefix}posterior") >= THRESHOLD).select(*docs.columns)
