"""Operator 6: language-model scores by a gated recurrent network with a class-factored output.

Tokens are lower-cased words (`[^\\x20\\x09-\\x0D]+`) and one end for each document. All training tokens of the corpus
are counted. The most frequent words are outputs of the network, WIDE to a class; less frequent ones stand in a few
bands, each one class, inside which a word has its share of the smoothed counts; the last class holds every other word,
seen or not. So the model is a distribution over the counted words and one unknown: P(word) = P(class) * P(word in class).

Every text is cut into words once and staged as the ranks of its words. The network is trained on every token of every
training document, once, by truncated backpropagation in numpy: each task streams its whole partition through LANES lanes
whose state is carried from window to window, and the tasks' weights are averaged, each by its tokens, after each of
ROUNDS, which take ever larger shares of the documents by seeded hash. More data are more tasks, not larger ones. Scoring
runs over whole documents, many side by side, in windows across which the state is carried. Counts of rare words are too
many to broadcast, so a document's rare words are joined with them, and their share of the sums is added to what the
network gave their class.

Defined results: a null or empty text has one token, its end. doc_id null counts as the empty text in the fold.
Repeated rows are scored one by one and train as often as they stand. Ties of counts go by hash. A text of any length is
scored whole. Other columns are never read. An empty table gives no rows. With no training document at all the base score
is 0 and the model is untrained.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import fold_of, staged, table
from engram.llm.linear import summed
from engram.llm.textvec import SPACED, Block, slices

END = 0  # the hash that stands for the end of a document
SHORT, WIDE = 1024, 32  # words that the network tells apart, and words of a class
HEAD, BANDS = 1 << 17, 8  # words whose counts are broadcast, and bands of those beyond SHORT
INPUT, HIDDEN = 16, 24
#: Lanes of a training stream at most, words of a lane about, words of a window, and words that a task arranges in lanes at once.
LANES, LONG, WINDOW, BUFFER = 256, 2048, 16, 1 << 20
#: Documents fall into SLICES by seeded hash; a round trains on those of its slices, and each is in one round.
SLICES, ROUNDS = 16, ((0, 1), (1, 3), (3, 8), (8, 16))
#: Documents scored side by side, and states whose output is computed at once.
BESIDE, AT_ONCE = 512, 4096
RATE, SEED = 0.15, 6


def count_tokens(docs: DataFrame) -> DataFrame:
    """(h, n) of every token of docs."""

    def run(batches):
        held, rows = [], 0

        def flush():
            h = np.concatenate([x[0] for x in held])
            n = np.concatenate([x[1] for x in held])
            u, back = np.unique(h, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(back, weights=n).astype(np.int64))], ["h", "n"])

        for b in slices(batches):
            u, n = np.unique(Block(b.column("text"), SPACED).h, return_counts=True)
            held.append((np.append(u, np.uint64(END)), np.append(n, b.num_rows)))
            rows += len(u)
            if rows > 3_000_000:
                yield flush()
                held, rows = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The end and the words of the highest count classes that together are at most `most`; sixteen classes for each doubling, so their sizes are few numbers."""
    level = F.floor(16 * F.log2(F.col("n").cast("double")))
    sizes = counts.filter(F.col("h") != END).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("level").desc()).collect()
    total, least = 1, None
    for r in sizes:
        total += r["words"]
        if total > most:
            break
        least = r["level"]
    return counts.filter((F.col("h") == END) | (level >= least) if least is not None else F.col("h") == END)


class Vocabulary:
    """The frequent words: h sorted; of each rank (0 is the end, then by count) code (below `short` an output; then bands) and base (log10 of the smoothed share)."""

    def __init__(self, h: np.ndarray, n: np.ndarray, tokens: int, distinct: int):
        self.tokens, self.scale = tokens, tokens + 0.5 * (distinct + 1)
        order = np.lexsort((h, -n, h != END))  # the end first, then by count
        h, n = h[order], n[order]
        if not len(h):
            h, n = np.array([END], np.uint64), np.array([0])
        self.short = min(SHORT, len(h))
        self.classes = -(-self.short // WIDE)
        share = (n + 0.5) / self.scale
        code = np.arange(len(h))
        beyond = len(h) - self.short
        if beyond:
            code[self.short :] = self.classes * WIDE + np.minimum(np.arange(beyond) * BANDS // beyond, BANDS - 1)
        self.outputs = self.classes + BANDS + 1
        self.edge = self.classes * WIDE
        self.rest = self.edge + BANDS
        mass = np.zeros(self.rest + 1)
        np.add.at(mass, code, share)
        mass[self.rest] = max(1.0 - share.sum(), 0.5 / self.scale)
        self.log_mass = np.log10(np.maximum(mass, 1e-300))
        inside = np.full(self.edge, -40.0)
        inside[: self.short] = np.log(share[: self.short])
        self.prior_inside = inside.reshape(self.classes, WIDE)
        by_class = np.concatenate([np.exp(self.prior_inside).sum(1), mass[self.edge :]])
        self.prior_class = np.log(np.maximum(by_class, 1e-12))
        self.prior_inside = self.prior_inside - np.log(np.exp(self.prior_inside).sum(1, keepdims=True))
        # the last rank stands for every word that isn't frequent
        self.code = np.append(code, self.rest).astype(np.int16 if self.rest < 1 << 15 else np.int32)
        self.base = np.append(np.log10(share), 0.0)
        every = np.arange(self.rest + 1)
        self.class_of = np.where(every < self.edge, every // WIDE, every - self.edge + self.classes).astype(np.int16)
        self.rank = np.argsort(h).astype(np.int32)
        self.h = h[self.rank]

    def look(self, h: np.ndarray) -> np.ndarray:
        """The rank of each word; the number of frequent words for one that isn't frequent."""
        i = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[i] == h, self.rank[i], len(self.h)).astype(np.int32)


class Network:
    """Gated recurrent units; weights in one dict of float32 arrays. A gate is (1 + tanh) / 2 of its sum."""

    def __init__(self, v: Vocabulary, weights: dict[str, np.ndarray] | None = None):
        self.v, g = v, np.random.default_rng(SEED)
        f = lambda *shape: (g.standard_normal(shape) / math.sqrt(shape[-2])).astype(np.float32)
        self.w = weights or {
            "in": 0.3 * g.standard_normal((v.rest + 1, INPUT)).astype(np.float32), "x": f(INPUT, 3 * HIDDEN), "u": f(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
            "c": 0.1 * f(HIDDEN, v.outputs), "cb": v.prior_class.astype(np.float32), "o": 0.1 * f(v.classes, HIDDEN, WIDE), "ob": v.prior_inside.astype(np.float32),
        }
        self.squares: dict[str, np.ndarray] = {}

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.w.values()])

    def replace(self, flat: np.ndarray) -> None:
        at = 0
        for k, a in self.w.items():
            self.w[k] = flat[at : at + a.size].reshape(a.shape).astype(np.float32)
            at += a.size

    def step(self, gates: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        hu = h @ self.w["u"]
        zr = gates[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = r * hu[:, 2 * HIDDEN :]
        n += gates[:, 2 * HIDDEN :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n

    def log_prob(self, h: np.ndarray, code: np.ndarray, slopes: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each code after each state, and the loss's slope at the states."""
        w, v = self.w, self.v
        k, at = v.class_of[code], np.arange(len(code))
        x = h @ w["c"]
        x += w["cb"]
        np.minimum(x, 60, out=x)
        out = x[at, k]
        np.exp(x, out=x)
        total = x.sum(1)
        out -= np.log(total)
        back = None
        if slopes is not None:
            x /= total[:, None]
            x[at, k] -= 1
            slopes["c"], slopes["cb"] = h.T @ x, x.sum(0)
            back = x @ w["c"].T
        order = np.flatnonzero(k < v.classes)
        order = order[np.argsort(k[order], kind="stable")]
        k, inside, hs, at = k[order], code[order] % WIDE, h[order], np.arange(len(order))
        cuts = np.searchsorted(k, np.arange(v.classes + 1)).tolist()
        classes = [(c, cuts[c], cuts[c + 1]) for c in range(v.classes) if cuts[c + 1] > cuts[c]]
        x = np.empty((len(order), WIDE), np.float32)
        for c, a, z in classes:
            np.matmul(hs[a:z], w["o"][c], out=x[a:z])
        x += w["ob"][k]
        np.minimum(x, 60, out=x)
        got = x[at, inside]
        np.exp(x, out=x)
        total = x.sum(1)
        out[order] += got - np.log(total)
        if slopes is not None:
            slopes["o"], slopes["ob"] = np.zeros_like(w["o"]), np.zeros_like(w["ob"])
            x /= total[:, None]
            x[at, inside] -= 1
            theirs = np.empty((len(order), HIDDEN), np.float32)
            for c, a, z in classes:
                np.matmul(hs[a:z].T, x[a:z], out=slopes["o"][c])
                np.matmul(x[a:z], w["o"][c].T, out=theirs[a:z])
            if classes:
                slopes["ob"][[c for c, _, _ in classes]] = np.add.reduceat(x, [a for _, a, _ in classes])
            back[order] += theirs
        return out, back

    def slopes_of(self, xs: np.ndarray, ys: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Truncated backpropagation over one window (steps x lanes) from the states h: slopes of the summed loss (those of "in"
        for the codes that the second result names), and the states after the window."""
        w = self.w
        steps, lanes = xs.shape
        emb = w["in"][xs.ravel()]
        gates = (emb @ w["x"] + w["b"]).reshape(steps, lanes, 3 * HIDDEN)
        states = np.empty((steps + 1, lanes, HIDDEN), np.float32)
        states[0], kept = h, []
        for t in range(steps):
            states[t + 1], *rest = self.step(gates[t], states[t])
            kept.append(rest)
        slopes: dict[str, np.ndarray] = {}
        _, back = self.log_prob(states[1:].reshape(-1, HIDDEN), ys.ravel(), slopes)
        back = back.reshape(steps, lanes, HIDDEN)
        down, dh = np.empty_like(gates), np.zeros((lanes, HIDDEN), np.float32)  # slopes at what tanh gets, by the input's share
        du = np.empty_like(gates)  # and by the state's
        across = states[:-1].reshape(-1, HIDDEN) @ w["u"][:, 2 * HIDDEN :]
        across = across.reshape(steps, lanes, HIDDEN)
        up = np.ascontiguousarray(w["u"].T)
        for t in range(steps - 1, -1, -1):
            z, r, n = kept[t]
            d = back[t] + dh
            dn = d * (1 - z)
            dn *= 1 - n * n
            down[t, :, :HIDDEN] = 2 * d * (states[t] - n) * z * (1 - z)
            down[t, :, HIDDEN : 2 * HIDDEN] = 2 * dn * across[t] * r * (1 - r)
            down[t, :, 2 * HIDDEN :] = dn
            du[t, :, : 2 * HIDDEN] = down[t, :, : 2 * HIDDEN]
            du[t, :, 2 * HIDDEN :] = dn * r
            dh = du[t] @ up
            dh += d * z
        flat = down.reshape(-1, 3 * HIDDEN)
        slopes["u"] = states[:-1].reshape(-1, HIDDEN).T @ du.reshape(-1, 3 * HIDDEN)
        slopes["b"], slopes["x"] = flat.sum(0), emb.T @ flat
        order = np.argsort(xs.ravel(), kind="stable")
        code = xs.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        slopes["in"] = np.add.reduceat((flat @ w["x"].T)[order], first)
        return slopes, code[first], states[-1]

    def train(self, stream: np.ndarray, rate: float = RATE) -> np.ndarray:
        """Trains on a stream of codes, side by side in lanes; returns its end, which is too short for another step of all lanes."""
        lanes = min(LANES, max(1, len(stream) // LONG))
        length = (len(stream) - 1) // lanes
        if length < 1:
            return stream
        x, y = (np.ascontiguousarray(stream[i : lanes * length + i].reshape(lanes, length).T) for i in (0, 1))
        h = np.zeros((lanes, HIDDEN), np.float32)
        if not self.squares:
            self.squares = {k: np.full_like(a, 1e-3) for k, a in self.w.items()}
        for t in range(0, length, WINDOW):
            slopes, codes, h = self.slopes_of(x[t : t + WINDOW], y[t : t + WINDOW], h)
            scale = 1 / x[t : t + WINDOW].size
            norm = scale * math.sqrt(sum(float(np.vdot(s, s)) for s in slopes.values()))
            scale *= min(1.0, 1.0 / max(norm, 1e-9))
            for k, s in slopes.items():
                s *= scale
                if k == "in":
                    square = self.squares[k][codes] + s * s
                    self.squares[k][codes] = square
                    self.w[k][codes] -= rate * s / np.sqrt(square)
                    continue
                self.squares[k] += s * s
                s /= np.sqrt(self.squares[k])
                s *= rate
                self.w[k] -= s
        return stream[lanes * length :]

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 probability of the codes (class, and word in class where the network tells them apart) of each document."""
        out = np.zeros(len(docs))
        order = np.argsort([-len(d) for d in docs], kind="stable")
        table = self.w["in"] @ self.w["x"] + self.w["b"]
        lengths = np.array([len(docs[i]) for i in order])
        for a in range(0, len(order), BESIDE):
            ids, long = order[a : a + BESIDE], lengths[a : a + BESIDE]
            codes = np.zeros((int(long[0]) + 1, len(ids)), np.int32)  # the first input is the end of nothing
            for row, i in enumerate(ids):
                codes[1 : len(docs[i]) + 1, row] = docs[i]
            h = np.zeros((len(ids), HIDDEN), np.float32)
            for t in range(0, int(long[0]), WINDOW):
                live = int(np.searchsorted(-long, -t, side="left"))
                steps = min(WINDOW, int(long[0]) - t)
                h = h[:live]
                states = np.empty((steps, live, HIDDEN), np.float32)
                for i in range(steps):
                    h = states[i] = self.step(table[codes[t + i, :live]], h)[0]
                inside = (t + np.arange(steps))[:, None] < long[:live][None, :]
                states, want = states[inside], codes[t + 1 : t + steps + 1, :live][inside]
                got = np.zeros(inside.shape)
                got[inside] = np.concatenate([self.log_prob(states[i : i + AT_ONCE], want[i : i + AT_ONCE])[0] for i in range(0, len(want), AT_ONCE)])
                out[ids[:live]] += got.sum(0)
        return out / math.log(10)


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """(key, doc_id, training, slice, ranks, tail) of every row: the ranks of its words, and the hashes of those that aren't frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(v)  # at most HEAD words
    training = fold_of(F.col("doc_id")) != 1
    piece = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", F.octet_length("text")), F.lit(SLICES)).cast("int")

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        for b in slices(batches):
            block = Block(b.column("text"), SPACED)
            rank = shared.value.look(block.h)
            far = rank == len(shared.value.h)
            cut = np.searchsorted(np.flatnonzero(far), block.first)
            ranks = pa.array([rank[a:z].tobytes() for a, z in zip(block.first[:-1], block.first[1:], strict=True)], pa.binary())
            tail = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(block.h[far].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array((part << 40) + made + np.arange(b.num_rows)), *(b.column(c) for c in ("doc_id", "training", "slice")), ranks, tail], ["key", "doc_id", "training", "slice", "ranks", "tail"])
            made += b.num_rows

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), training.alias("training"), piece.alias("slice"), "text")
    return staged(rows.mapInArrow(run, "key long, doc_id long, training boolean, slice int, ranks binary, tail array<long>"), "encoded")


def train(encoded: DataFrame, v: Vocabulary) -> Network:
    """A network trained on every token of the training rows."""
    net = Network(v)
    spark = encoded.sparkSession
    width = 4096
    shape = (-(-(net.flat().size + 1) // width), width)

    def one_round(now, rate: float):
        def run(batches) -> np.ndarray:
            own = Network(now.value.v, {k: a.copy() for k, a in now.value.w.items()})
            held, size, tokens = [np.zeros(1, own.v.code.dtype)], 1, 0
            for b in batches:
                for ranks in b.column("ranks").to_pylist():
                    codes = np.append(own.v.code[np.frombuffer(ranks, np.int32)], own.v.code[0])
                    held.append(codes)
                    size += len(codes)
                    tokens += len(codes)
                    if size > BUFFER:
                        held = [own.train(np.concatenate(held), rate)]
                        size = len(held[0])
            own.train(own.train(np.concatenate(held), rate), rate)  # and what was too short for all lanes
            out = np.zeros(shape)
            out.ravel()[: net_size] = own.flat() * float(tokens)
            out[-1, -1] = tokens
            return out

        return run

    net_size = net.flat().size
    for number, (low, high) in enumerate(ROUNDS):
        rows = encoded.filter(F.col("training") & (F.col("slice") >= low) & (F.col("slice") < high)).select("ranks")
        total = summed(rows, one_round(spark.sparkContext.broadcast(net), RATE / math.sqrt(1 + number)), shape)
        if total[-1, -1]:
            net.replace(total.ravel()[:net_size] / total[-1, -1])
    return net


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counts = staged(count_tokens(docs.filter(fold_of(F.col("doc_id")) != 1)), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).head()
    top = frequent(counts, HEAD).toPandas()  # at most HEAD rows
    v = Vocabulary(top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), total["n"], total["v"])
    encoded = encode(docs, v)
    net = spark.sparkContext.broadcast(train(encoded, v))  # HEAD words and the weights
    schema = "key long, doc_id long, n_tokens long, known long, base double, score double"

    def run(batches):
        n, v = net.value, net.value.v
        seen_end = int(v.tokens > 0)  # every training document has an end

        def flush(held: list[tuple[int, int | None, np.ndarray]]) -> pa.RecordBatch:
            ranks = [r for _, _, r in held]
            sizes = np.array([len(r) for r in ranks])
            every = np.concatenate(ranks)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            code, base = v.code[every], v.base[every]
            # log10 of the shares inside the bands and the last class; a rare word's own part is joined later
            inside = np.where(code >= v.edge, base - v.log_mass[code], 0.0)
            score = n.score(np.split(code, first[1:])) + np.add.reduceat(inside, first)
            known = np.add.reduceat((every < len(v.h)).astype(np.int64), first) - 1 + seen_end
            columns = [[k for k, _, _ in held], [d for _, d, _ in held], sizes, known, np.add.reduceat(base, first), score]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if i > 3 else pa.int64()) for i, c in enumerate(columns)], [x.split()[0] for x in schema.split(", ")])

        held: list = []
        size = 0
        for b in batches:
            for key, doc, ranks in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "ranks")), strict=True):
                held.append((key, doc, np.append(np.frombuffer(ranks, np.int32), np.int32(0))))
                size += len(held[-1][2])
                if size > 2_000_000:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    mapped = encoded.select("key", "doc_id", "ranks").mapInArrow(run, schema)
    rare = encoded.select("key", F.explode("tail").alias("h")).join(counts, "h", "left")
    each = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(v.scale))
    rare = rare.groupBy("key").agg(F.sum(each).alias("more"), F.count("n").alias("also"))
    out = mapped.join(rare, "key", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(int(total["n"])).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
