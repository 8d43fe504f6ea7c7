"""Operator 1: benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles into classes (L/2, L], L a power of two. For each class a
document is cut into blocks of 2L shingles, one for every L, so that a passage as long as an item of the class lies
whole in some block and the two are of like size. Items and blocks are sketched by MinHash in 8L bins (one permutation:
a bin keeps its least hash); an item is a candidate for a document when a bin of it equals that bin of a block. Items of
fewer than EXACT shingles are looked up by each shingle. A candidate counts when the document's whole shingle set holds
at least `threshold` of the item's distinct shingles, counted exactly.

An item of 0.8 containment shares at least 7 shingles with a document; one is missed by a bin with a chance of about
0.12, so all with one below 1e-6. Documents are read in one pass for each block of items (at most ITEMS rows and
ITEM_BYTES of text, which is what a task gets), and nothing is shuffled.

Words are as in the licence scan: letters, digits and non-ASCII of the lower-cased text, so punctuation doesn't hide a
leak. Defined results: an item of one to four words is found where its words stand in a row; null, empty or wordless
items and texts match nothing; repeated rows and equal items match alike, so there are no ties. A long text is searched
whole, alone; its memory follows its own length, not the longest item's. Other columns are kept by `clean`, whatever their
names. Without documents or items nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import table
from engram.llm.textvec import ALNUM, Block, mix, slices, whole

WORDS, THRESHOLD = 5, 0.8
EXACT, BINS_A_SHINGLE = 9, 8
ITEMS, ITEM_BYTES = 50_000, 16 << 20
#: Bins of all blocks of a batch that are held as one array; where there would be more, only those with a hash are.
DENSE = 4 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _bin(h: np.ndarray, bins: int) -> np.ndarray:
    return (h & np.uint64(bins - 1)).astype(np.int64)


class Items:
    """A block of test items, ready for the tasks."""

    def __init__(self, ids: list, texts: list):
        self.ids, self.sets, self.sizes = [], [], []
        self.short: dict[int, list[tuple[int, int]]] = {}  # words -> (hash of the words in a row, item)
        by_class: dict[int, list[int]] = {}
        exact: list[tuple[int, int]] = []
        block = Block(pa.array(texts, pa.large_string()), ALNUM)
        grams, at = block.grams(WORDS)
        cut = np.searchsorted(at, block.first)
        for i, item in enumerate(ids):
            a, z = int(block.first[i]), int(block.first[i + 1])
            if z == a:
                continue
            own = np.unique(grams[cut[i] : cut[i + 1]]) if z - a >= WORDS else np.array([whole(block.h[a:z])], np.uint64)
            k = len(self.ids)
            self.ids.append(item)
            self.sets.append(own)
            if z - a < WORDS:
                self.short.setdefault(z - a, []).append((int(own[0]), k))
            elif len(own) < EXACT:
                exact += [(int(h), k) for h in own]
            else:
                by_class.setdefault(1 << (len(own) - 1).bit_length(), []).append(k)
        self.exact = self._table([(mix(np.array([h], np.uint64)), k) for h, k in exact])
        self.classes = []
        for size, members in sorted(by_class.items()):
            bins, rows = size * BINS_A_SHINGLE, []
            for k in members:
                own = self.sets[k]  # sorted, so the first of a bin is its least
                rows += [(mix(own[j : j + 1]), k) for j in np.unique(_bin(own, bins), return_index=True)[1]]
            self.classes.append((size, bins, self._table(rows)))

    @staticmethod
    def _table(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys, their items, and a filter over the keys' first bits."""
        if not rows:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(1 << 16, bool)
        key, item = np.concatenate([r[0] for r in rows]), np.array([r[1] for r in rows])
        order = np.argsort(key, kind="stable")
        some = np.zeros(1 << 20, bool)
        some[(key >> np.uint64(44)).astype(np.int64)] = True
        return key[order], item[order], some

    @staticmethod
    def _hits(values: np.ndarray, owner: np.ndarray, found) -> Iterator[tuple[int, int]]:
        """(text, item) of the values that are keys of a table."""
        key, item, some = found
        if not len(key):
            return
        value = mix(values)
        at = np.flatnonzero(some[(value >> np.uint64(44)).astype(np.int64)])
        value, owner = value[at], owner[at]
        a, z = np.searchsorted(key, value, side="left"), np.searchsorted(key, value, side="right")
        for i in np.flatnonzero(z > a):
            for k in item[a[i] : z[i]]:
                yield int(owner[i]), int(k)

    @staticmethod
    def _sketches(grams: np.ndarray, doc: np.ndarray, halves: np.ndarray, many: np.ndarray, size: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, least hash) of every bin that isn't empty of every block, a half and the next one of the same text. many: shingles of each text."""
        count = np.concatenate([[0], np.cumsum(-(-many // size))])
        row = count[:-1][doc] + halves
        owner = np.repeat(np.arange(len(many)), np.diff(count))
        follows = np.append(False, owner[1:] == owner[:-1])[: len(owner)]  # the half before is of the same text
        if count[-1] * bins <= DENSE:
            least = np.full(int(count[-1]) * bins, _NONE, np.uint64)
            np.minimum.at(least, row * bins + _bin(grams, bins), grams)
            least = least.reshape(-1, bins)
            both = least.copy()
            at = np.flatnonzero(follows)
            both[at - 1] = np.minimum(least[at - 1], least[at])
            row, _ = np.nonzero(both != _NONE)
            return owner[row], both[both != _NONE]

        def least_of(key, value):
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            return key[head], np.minimum.reduceat(value, head) if len(key) else value

        key, value = least_of(row * bins + _bin(grams, bins), grams)
        again = follows[key // bins]
        key, value = least_of(np.append(key, key[again] - bins), np.append(value, value[again]))
        return owner[key // bins], value

    def search(self, block: Block) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) of each candidate, and of short items that are there."""
        grams, at = block.grams(WORDS)
        cut = np.searchsorted(at, block.first)
        doc = np.repeat(np.arange(block.n), np.diff(cut))
        candidates = set(self._hits(grams, doc, self.exact))
        place = np.arange(len(grams)) - cut[:-1][doc]
        for size, bins, found in self.classes:
            halves = place // size
            owner, value = self._sketches(grams, doc, halves, np.diff(cut), size, bins)
            candidates.update(self._hits(value, owner, found))
        for d, k in sorted(candidates):
            text = np.unique(grams[cut[d] : cut[d + 1]])
            i = np.minimum(np.searchsorted(text, self.sets[k]), len(text) - 1)
            yield d, k, int((text[i] == self.sets[k]).sum())
        for words, wanted in self.short.items():
            h = block.h
            if len(h) < words:
                continue
            runs = np.full(len(h) - words + 1, words, np.uint64)
            for j in range(words):
                runs = runs * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - words + 1 + j]
            runs[block.doc[: len(runs)] != block.doc[words - 1 :]] = 0
            runs = mix(runs)
            for value, k in wanted:
                for d in np.unique(block.doc[np.flatnonzero(runs == np.uint64(value))]):
                    yield int(d), k, 1


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator(prefetchPartitions=False):
        text = r["text"] or ""
        if ids and (len(ids) >= ITEMS or size + len(text) > ITEM_BYTES):
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(text)
        size += len(text)
    if ids:
        yield Items(ids, texts)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment of each item in each document that holds it."""
    docs = docs.select("doc_id", "text")
    schema = "doc_id long, item_id long, shared long, item_shingles long, containment double"
    kinds = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("shared", pa.int64()), ("item_shingles", pa.int64()), ("containment", pa.float64())]

    def search(items: Items) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches):
            items = sent.value
            for b in slices(batches):
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[d], items.ids[k], n, len(items.sets[k]), n / len(items.sets[k])) for d, k, n in items.search(Block(b.column("text"), ALNUM)) if n >= threshold * len(items.sets[k]) - 1e-9]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])

        return docs.mapInArrow(run, schema)

    out = None
    for items in _blocks(benchmark):
        out = search(items) if out is None else out.unionByName(search(items))
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text holds no test item, all columns kept; a filter over the rows as they lie."""

    def without(docs: DataFrame, items: Items) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches):
            items = sent.value
            for b in slices(batches):
                keep = np.ones(b.num_rows, bool)
                for d, k, n in items.search(Block(b.column("text"), ALNUM)):
                    keep[d] &= n < threshold * len(items.sets[k]) - 1e-9
                yield b.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)

    for items in _blocks(benchmark):
        docs = without(docs, items)
    return docs


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no test item."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""
WITH i AS (SELECT item_id, {_W} AS w FROM benchmark),
d AS (SELECT doc_id, {_W} AS w FROM documents),
si AS (SELECT DISTINCT item_id, array_to_string(w[p : p + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS p FROM i WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS item_shingles FROM si GROUP BY item_id),
sd AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
c AS (SELECT doc_id, item_id, count(*) AS shared FROM sd JOIN si USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(shared AS BIGINT) AS shared, CAST(item_shingles AS BIGINT) AS item_shingles, shared / item_shingles AS containment
FROM c JOIN n USING (item_id) WHERE 10 * shared >= 8 * item_shingles
"""
