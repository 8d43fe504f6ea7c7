"""Operator 9: toxicity by weak supervision.

Voters are a fixed lexicon, patterns of style, and words and word beginnings mined from labelled training rows. A
generative label model (two classes, one vote probability for each voter and class) starts from the labelled rows and is
then fitted by EM over the vote patterns of all documents. In it a given label is one more voter, with an accuracy of its
own for each class, that abstains where a row has none: enough other votes outvote it. From the pairwise moments come the
correlations of voters within a class, by which a voter's evidence is shared out. A linear classifier over votes and hit
rates is trained on the model's posterior labels of all rows of the training folds, labelled or not, by Newton steps whose
sums are one job each, and scores every whole text.

Labels are read only where crc32(doc_id as text) mod 5 is not 0; lang, source, labels and doc_id are no inputs of a
score. Defined results: a null or empty text has no votes and gets the classifier's score for that; a long text is read
whole; a repeated row counts and is scored as often as it stands; equal texts score alike, and a score of exactly 0.5 is
predicted 1; a label that is null is none, one that stands more than once counts as its mean; a row without doc_id is in
the fold of the empty text and has no label; other columns are never read; an empty table gives no rows. Without labels
of both classes the score is the label model's posterior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import broadcast_if_small, fold_of, staged, table
from engram.llm.linear import decide, newton, sigmoid, summed
from engram.llm.textvec import ALNUM, Block, signed, slices

#: Plain insults in English, German, French and Spanish, as words of ALNUM.
LEXICON = (
    "idiot", "moron", "stupid", "scum", "trash", "pathetic", "worthless", "disgusting", "loser", "clown", "dumb", "fool", "garbage", "vermin", "filth", "imbecile", "jerk", "creep", "coward", "liar",
    "dummkopf", "trottel", "abschaum", "widerlich", "versager", "dreck", "blödmann", "feigling", "lügner", "schwachkopf",
    "imbécile", "crétin", "abruti", "ordure", "déchet", "minable", "dégoûtant", "menteur", "racaille", "lâche",
    "idiota", "estúpido", "imbécil", "basura", "escoria", "asqueroso", "patético", "mentiroso", "cobarde", "inútil",
)
MINED = 240
BITS = 20
LENGTHS = (4, 5, 6, 7, 8, 9, 10, 12)
ROUNDS = 6
#: Style voters, after the terms: three or more hits, two hit rates, shouting, exclamation marks.
STYLES = 5
#: Odds that a given label starts with, as the probabilities of label 1 in each class.
GIVEN = (0.02, 0.95)
#: Rows of votes for each task that sums them into a matrix.
ROWS = 50_000


def features(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word number, 64-bit hash) of the words, and of their beginnings of each length."""
    yield np.arange(len(block.h)), block.h
    for length in LENGTHS:
        yield block.prefixes(length)


def bucket(h: np.ndarray) -> np.ndarray:
    """The bucket of a feature, in which mining counts it first."""
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _lexicon(words: tuple[str, ...]) -> list[int]:
    return signed(Block(pa.array([" ".join(words)]), ALNUM).h).tolist()


@dataclass
class Model:
    terms: list[int]  # whole hashes (signed) of the term voters; the style voters follow them
    yes: np.ndarray = field(default_factory=lambda: np.empty(0))  # probability of a vote if toxic
    no: np.ndarray = field(default_factory=lambda: np.empty(0))
    share: np.ndarray = field(default_factory=lambda: np.empty(0))  # weight of each voter after correlations
    prior: float = 0.1
    given: tuple[float, float] = GIVEN  # probability of label 1 in each class, where a row has a label
    linear: tuple | None = None

    @property
    def voters(self) -> int:
        return len(self.terms) + STYLES

    def votes(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(texts x voters 0/1, texts x dense features)"""
        n, m = block.n, self.voters
        terms = np.array(self.terms, np.int64).view(np.uint64)
        slot = np.argsort(terms)
        terms = terms[slot]
        taken = np.zeros(1 << BITS, dtype=bool)
        taken[bucket(terms)] = True
        hits = np.zeros((n, m), dtype=np.float32)
        struck = np.zeros(len(block.h), dtype=bool)
        for at, f in features(block):
            # a bucket that is taken only says where to look: the whole hash decides
            found = np.flatnonzero(taken[bucket(f)])
            place = np.searchsorted(terms, f[found])
            right = terms[np.minimum(place, len(terms) - 1)] == f[found]
            found, v = found[right], slot[place[right]]
            struck[at[found]] = True
            np.add.at(hits, (block.doc[at[found]], v), 1)
        words = np.maximum(block.counts(), 1).astype(np.float64)
        total = np.add.reduceat(np.append(struck, False).astype(np.int64), np.minimum(block.first[:-1], len(struck))) * (block.counts() > 0) if n else np.zeros(0)
        rate = total / words
        sums = lambda x: (lambda c: c[block.at[1:]] - c[block.at[:-1]])(np.concatenate([[0], np.cumsum(x)]))
        high, low, marks = (sums(x) for x in ((block.raw >= 65) & (block.raw <= 90), (block.raw >= 97) & (block.raw <= 122), block.raw == 33))
        v = (hits > 0).astype(np.float64)
        v[:, m - 5 :] = np.stack([total >= 3, rate >= 0.02, rate >= 0.005, (high >= 12) & (high > low), marks * 20 > words], axis=1)
        dense = np.stack([np.log1p(total), np.log1p(1000 * rate), np.log1p((hits[:, :-STYLES] > 0).sum(1)), np.log(words), np.minimum(total, 2) / np.log2(words + 1)], axis=1)
        return v, dense

    def odds(self, v: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
        """Log-odds of the label model for rows of votes, and of given labels (0 to 1, nan for none)."""
        on, off = np.log(self.yes / self.no), np.log((1 - self.yes) / (1 - self.no))
        out = np.log(self.prior / (1 - self.prior)) + v @ (self.share * (on - off)) + (self.share * off).sum()
        if given is not None:
            no, yes = self.given
            out += np.where(np.isnan(given), 0.0, np.nan_to_num(given) * np.log(yes / no) + (1 - np.nan_to_num(given)) * np.log((1 - yes) / (1 - no)))
        return out

    def score(self, block: Block) -> np.ndarray:
        v, dense = self.votes(block)
        return sigmoid(decide(np.hstack([v, dense]), self.linear) if self.linear else self.odds(v))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic 0..1) of labelled rows outside the held-out fold."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    return known.groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))


def mine(known: DataFrame, most: int = MINED) -> list[int]:
    """Features that stand in toxic documents of `known` far more often than in others: buckets are counted first, and only the
    features of buckets with enough toxic documents are then counted by their whole hashes."""

    def count(chosen: np.ndarray | None):
        def run(batches):
            tally = np.zeros(1 << BITS, dtype=np.int64)
            rows = np.zeros(2, dtype=np.int64)
            for b in slices(batches):
                toxic = np.asarray(b.column("toxic")) >= 0.5
                rows += np.bincount(toxic.astype(np.int64), minlength=2)
                if chosen is None:
                    b, toxic = b.filter(pa.array(toxic)), toxic[toxic]
                    if not len(toxic):
                        continue
                block = Block(b.column("text"), ALNUM)
                doc, h = (np.concatenate(x) for x in zip(*((block.doc[at], f) for at, f in features(block)), strict=True))
                if chosen is None:
                    seen = np.unique(doc * (1 << BITS) + bucket(h))
                    tally += np.bincount(seen & ((1 << BITS) - 1), minlength=1 << BITS)
                    continue
                some = chosen[bucket(h)]
                doc, h = doc[some], h[some]
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                once = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (h[1:] != h[:-1])])) if len(h) else order
                terms, at = np.unique(h[once], return_inverse=True)
                bad = np.bincount(at, weights=toxic[doc[once]], minlength=len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed(terms)), pa.array(bad), pa.array(np.bincount(at, minlength=len(terms)) - bad)], ["feature", "bad", "good"])
            if chosen is None:
                some = np.flatnonzero(tally)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(tally[some], rows[1])), pa.array(np.append(0 * some, rows[0]))], ["feature", "bad", "good"])

        return known.select("text", "toxic").mapInArrow(run, "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))

    sums = staged(count(None), "buckets")
    total = sums.filter("feature = -1").head()
    if not total or not total["bad"] or not total["good"]:
        return []
    # a term's lift needs it in as many toxic documents as its bucket has at most, so no term that passes below is left out here
    chosen = np.zeros(1 << BITS, dtype=bool)
    chosen[[r["feature"] for r in sums.filter("feature >= 0 and bad >= 4").select("feature").collect()]] = True
    lift = (F.col("bad") + 0.5) / (total["bad"] + 1.0) / ((F.col("good") + 0.5) / (total["good"] + 1.0))
    best = count(chosen).filter("bad >= 4").withColumn("lift", lift).filter("lift >= 6")
    return [r["feature"] for r in best.orderBy((F.col("bad") * F.log("lift")).desc(), "feature").limit(most).collect()]


def cast_votes(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, votes, dense) of every row: the voters that vote, and the hit rates."""

    def cast(batches):
        for b in slices(batches):
            v, dense = model.votes(Block(b.column("text"), ALNUM))
            at, on = np.nonzero(v)
            cut = np.searchsorted(at, np.arange(len(v) + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(on, pa.int32()))
            rates = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * dense.shape[1], pa.int32()), pa.array(dense.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), lists, rates], ["doc_id", "votes", "dense"])

    return docs.select("doc_id", "text").mapInArrow(cast, "doc_id long, votes array<int>, dense array<float>")


def _of(b: pa.RecordBatch, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The votes of a batch as a 0/1 matrix, and its given labels."""
    lists = b.column("votes")
    v = np.zeros((b.num_rows, m))
    v[np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths())), np.asarray(lists.flatten())] = 1
    return v, np.asarray(b.column("toxic").to_numpy(zero_copy_only=False), dtype=float)


def fit_label_model(seen: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """EM over the patterns (votes, toxic or null, n), each round one job that sums posterior moments; the first one over
    the labelled patterns alone, whose labels it takes as they are; then the correlations."""
    m = model.voters
    model.yes, model.no, model.share = np.full(m, 0.3), np.full(m, 0.005), np.ones(m)
    model.prior, model.given = 0.1, GIVEN

    def moments(first: bool, pairs: bool) -> np.ndarray:
        """Of each class the sums of products of two votes (or, without pairs, of single ones), where vote m is always cast, and m + 1, m + 2 are a label and label 1."""

        def run(batches):
            total = np.zeros((2, m + 3, m + 3))
            for b in batches:
                v, given = _of(b, m)
                known = ~np.isnan(given)
                v = np.column_stack([v, np.ones(len(v)), known, np.nan_to_num(given)])
                p = sigmoid(model.odds(v[:, :m], given))
                n = np.asarray(b.column("n"), dtype=float)
                if first:
                    p, n = np.clip(np.nan_to_num(given), *GIVEN), n * known
                for k, weight in enumerate((n * (1 - p), n * p)):
                    total[k] += (v * weight[:, None]).T @ v if pairs else np.outer(np.eye(m + 3)[m], weight @ v)
            return total.reshape(2 * (m + 3), m + 3)

        return summed(seen, run, (2 * (m + 3), m + 3)).reshape(2, m + 3, m + 3)

    for step in range(rounds + 1):
        clean, toxic = moments(first=step == 0, pairs=step == rounds)
        if not clean[m, m] + toxic[m, m]:
            continue  # no label at all: what the model began with stays for the first round
        if step:
            model.prior = float(np.clip((toxic[m, m] + 0.5) / (toxic[m, m] + clean[m, m] + 1), 1e-4, 0.9))
            rate = lambda x, a: float(np.clip((x[m, m + 2] + 20 * a) / (x[m, m + 1] + 20), 0.01, 0.99))
            model.given = (rate(clean, GIVEN[0]), rate(toxic, GIVEN[1]))
        model.yes = np.clip((toxic[m, :m] + 0.3) / (toxic[m, m] + 1), 1e-4, 1 - 1e-4)
        model.no = np.clip((clean[m, :m] + 0.005) / (clean[m, m] + 1), 1e-6, 1 - 1e-4)
    together = np.zeros((m, m))
    for x in (clean, toxic):
        mean = x[m, :m] / max(x[m, m], 1e-9)
        cov = x[:m, :m] / max(x[m, m], 1e-9) - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        together = np.maximum(together, np.abs(cov / np.outer(sd, sd)))
    np.fill_diagonal(together, 0)
    model.share = 1 / (1 + np.where(together > 0.1, together, 0).sum(1))
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    docs, labels = docs.select("doc_id", "text"), training_labels(labels)
    few = labels.count()
    known = docs.join(broadcast_if_small(labels, few), "doc_id")
    mined = mine(known if few <= 200_000 else staged(known, "labelled"))  # beyond a broadcast the texts move once, not for both counts
    model = Model(list(dict.fromkeys(_lexicon(LEXICON) + mined)))
    rows = staged(cast_votes(docs, model).join(broadcast_if_small(labels, few), "doc_id", "left"), "votes")
    seen = staged(rows.groupBy("votes", "toxic").agg(F.count(F.lit(1)).alias("n")), "patterns")
    fit_label_model(seen.coalesce(-(-seen.count() // ROWS) or 1), model)
    if not mined:
        return model

    def training(batches):
        for b in batches:
            v, given = _of(b, model.voters)
            yield np.hstack([v, np.asarray(b.column("dense").flatten(), dtype=float).reshape(len(v), -1)]), sigmoid(model.odds(v, given))

    own = rows.filter(fold_of(F.col("doc_id")) != 0)
    model.linear = newton(own.coalesce(-(-own.count() // ROWS) or 1), training, model.voters + 5, ridge=2.0)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches):
        for b in slices(batches):
            s = model.score(Block(b.column("text"), ALNUM))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
