"""Ranked lexical search: the k best documents of each query item, by best-first search over document intervals.

1. One pass over the texts: each document's number of terms and the frequencies of those that any item asks for, written once. Their sums are the corpus figures
   (documents N, terms L, document frequencies).
2. One pass over that table: consecutive documents form blocks. In a block each asked term has a posting list (documents, impacts) with a sparse table of range maxima.
   An item starts with the block as one interval. Its bound is the sum of its terms' range maxima. The best intervals are taken first, each split at the document
   with its highest impact, which is scored exactly; the two rests get bounds of their own. It ends when no bound reaches the k-th best score of the task so far, so nothing that
   belongs to the k best is lost, and later blocks start with the bound that earlier ones left.
3. A task's k best of each item are ranked, in two steps, so that no item gathers more rows than its number of tasks needs.

Items come in blocks by hash, of about ITEMS bytes of text each, so what tasks know of the items stays bounded; each block of items reads the documents' table again.

Nulls: a null text has no term, and is neither counted nor ranked; items without terms have no rows. A null item_id is an item of its own; rows of one item_id are one item that asks for
all their terms. A null doc_id comes after others of the same score. Repeated rows are documents of their own, with ranks of their own. Terms are taken from whole texts. No rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of

#: Characters between terms (ASCII that is neither digit nor letter).
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same for bytes, whose letters are lower case already.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of a block of items' texts; postings of a block of documents; intervals split at a time. They change no result.
ITEMS, POSTINGS, FRONT = 8_000_000, 1_000_000, 256
SHORT, LONG, SCALE = 50, 20, 1_000_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), BETWEEN), "")


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term adds to a document of n terms, in whole numbers."""
    m = 100 - SHORT + (SHORT * n * documents) // total
    return weight * ((SCALE * tf) // (1000 * tf + LONG * m))


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def frequencies(docs: DataFrame, asked: list[str]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (places in asked), tfs, of each document with a term."""
    number = {t.encode(): k for k, t in enumerate(asked)}

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = TERM.findall(text.as_py().lower())
                if found:
                    here = [(number[t], c) for t, c in Counter(found).items() if t in number]
                    rows.append((doc_id, len(found), [t for t, _ in here], [c for _, c in here]))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Postings:
    """Posting lists of a block of documents, one after the other, with a sparse table of the places of range maxima: row j has those of 2^j postings from each place on."""

    def __init__(self, term: np.ndarray, document: np.ndarray, impact: np.ndarray, documents: int):
        """term, document: sorted by both, each pair once."""
        self.documents, self.document, self.impact = documents, document, impact
        self.names, starts = np.unique(term, return_index=True)
        self.spans = {t: (a, b) for t, a, b in zip(self.names.tolist(), starts.tolist(), np.append(starts, len(term))[1:].tolist(), strict=True)}
        longest = max((b - a for a, b in self.spans.values()), default=1)
        self.logs = np.zeros(longest + 2, np.int64)
        for j in range(1, longest.bit_length()):
            self.logs[1 << j :] = j
        self.best = [np.arange(len(term), dtype=np.int32)]
        for j in range(1, longest.bit_length()):  # a range over a list's end is never asked for
            last = self.best[-1]
            other = last[np.minimum(np.arange(len(term)) + (1 << (j - 1)), len(term) - 1)]
            self.best.append(np.where(impact[other] > impact[last], other, last))
        self.best = np.stack(self.best)

    def before(self, terms: list[int]) -> np.ndarray:
        """For each term and document: the place of its first posting at or after the document."""
        out = np.empty((len(terms), self.documents + 1), np.int32)
        for k, t in enumerate(terms):
            a, b = self.spans[t]
            out[k, 0] = a
            out[k, 1:] = a + np.cumsum(np.bincount(self.document[a:b], minlength=self.documents))
        return out

    def maxima(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places of the highest impacts in ranges of places [low, high), which are not empty."""
        j = self.logs[high - low]
        x, y = self.best[j, low], self.best[j, high - (1 << j)]
        return np.where(self.impact[y] > self.impact[x], y, x)


def search(block: Postings, terms: list[int], k: int, floor: int, front: int = FRONT) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a block among which are all its k best that reach the floor, ties at the end included."""
    terms = [t for t in terms if t in block.spans]
    nothing = np.zeros(0, np.int64)
    if not terms:
        return nothing, nothing
    before = block.before(terms)

    def bounds(low, high):
        """Bound and split of intervals of documents: the sum of all terms' range maxima, and the document of the highest one."""
        a, b = before[:, low], before[:, high]
        some = b > a
        at = block.maxima(np.where(some, a, 0), np.where(some, b, 1))
        most = np.where(some, block.impact[at], 0)
        top = most.argmax(axis=0)
        return most.sum(axis=0), block.document[at[top, np.arange(len(low))]]

    low, high = np.array([0]), np.array([block.documents])
    bound, split = bounds(low, high)
    found, scores = [nothing], [nothing]
    top = nothing
    while True:
        alive = bound >= max(floor, 1)
        low, high, bound, split = low[alive], high[alive], bound[alive], split[alive]
        if not len(low):
            return np.concatenate(found), np.concatenate(scores)
        if len(low) > front:
            order = np.argpartition(-bound, front)
            first, rest = order[:front], order[front:]
        else:
            first, rest = np.arange(len(low)), nothing
        d = split[first]
        place = before[:, d]
        score = np.where(before[:, d + 1] > place, block.impact[np.minimum(place, len(block.impact) - 1)], 0).sum(axis=0)
        good = score >= max(floor, 1)
        found.append(d[good])
        scores.append(score[good])
        top = np.concatenate([top, score[good]])
        if len(top) >= k:
            top = np.partition(top, len(top) - k)[len(top) - k :]
            floor = max(floor, int(top.min()))
        new_low, new_high = np.concatenate([low[first], d + 1]), np.concatenate([d, high[first]])
        some = new_low < new_high
        new_low, new_high = new_low[some], new_high[some]
        new_bound, new_split = bounds(new_low, new_high) if len(new_low) else (nothing, nothing)
        low, high = np.concatenate([low[rest], new_low]), np.concatenate([high[rest], new_high])
        bound, split = np.concatenate([bound[rest], new_bound]), np.concatenate([split[rest], new_split])


def best_of_tasks(counted: DataFrame, items: list[list[int]], weights: dict[int, int], documents: int, total: int, k: int, postings: int = POSTINGS) -> DataFrame:
    """item (its place), doc_id, score: at least the k best of each item in each task's documents."""
    table = np.zeros(max(weights, default=0) + 1, np.int64)
    table[list(weights)] = list(weights.values())

    def run(batches):
        best = defaultdict(list)  # item -> (-score, null id, id), at most k and ties of ids
        floors = [0] * len(items)
        waiting, size = [], 0

        def block():
            ids = [i for w in waiting for i in w[0]]
            n = np.concatenate([w[1] for w in waiting])
            lengths = np.concatenate([w[2] for w in waiting])
            term, tf = (np.concatenate([w[j] for w in waiting]) for j in (3, 4))
            document = np.repeat(np.arange(len(ids)), lengths)
            order = np.lexsort((document, term))
            term, document, tf = term[order], document[order], tf[order]
            made = Postings(term, document, impacts(table[term], tf, n[document], documents, total), len(ids))
            for item, asked in enumerate(items):
                here, scores = search(made, asked, k, floors[item])
                if len(here):
                    rows = [*best[item], *((-s, ids[d] is None, ids[d] or 0) for d, s in zip(here.tolist(), scores.tolist(), strict=True))]
                    best[item] = sorted(rows)[:k]
                    if len(best[item]) == k:
                        floors[item] = -best[item][-1][0]

        for batch in batches:
            ids, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            lists, tfs = batch.column(2), batch.column(3)
            lengths = pa.compute.list_value_length(lists).to_numpy()
            at, ends = 0, np.cumsum(lengths)
            term, tf = lists.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy()
            while at < len(ids):  # a block ends with the document that fills it
                before = int(ends[at - 1]) if at else 0
                end = min(len(ids), int(np.searchsorted(ends, before + postings - size)) + 1)
                waiting.append((ids[at:end], n[at:end], lengths[at:end], term[before : int(ends[end - 1])], tf[before : int(ends[end - 1])]))
                size, at = size + int(ends[end - 1]) - before, end
                if size >= postings:
                    block()
                    waiting, size = [], 0
        if waiting:
            block()
        rows = [(item, None if null else i, -s) for item, found in best.items() for s, null, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return counted.mapInArrow(run, "item int, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 50, item_bytes: int = ITEMS, postings: int = POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0, equal scores by doc_id. docs: doc_id, text; items: item_id, text."""
    session = docs.sparkSession
    asked = items.select("item_id", F.explode(F.array_distinct(terms(text_of(items)))).alias("term")).distinct()
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 8), F.lit(0))).first()[0]
    blocks = -(-size // item_bytes) or 1
    asked = cut(asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), "items")
    kind = items.schema["item_id"].dataType
    out = None
    for number in range(blocks):
        of_item = defaultdict(list)
        for r in asked.where(F.col("block") == number).select("item_id", "term").collect():  # about item_bytes at most
            of_item[r["item_id"]].append(r["term"])
        words = sorted({t for ts in of_item.values() for t in ts})
        place = {t: n for n, t in enumerate(words)}
        ids = list(of_item)
        counted = cut(frequencies(docs, words), "terms")
        documents, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # one row a term of the block at most
        weights = {r["term"]: weight(documents, r["count"]) for r in df}
        best = best_of_tasks(counted, [[place[t] for t in of_item[i]] for i in ids], weights, documents, total or 1, k, postings)
        names = session.createDataFrame([(n, i) for n, i in enumerate(ids)], f"item int, item_id {kind.simpleString()}")
        best = best.withColumn("part", F.spark_partition_id() % 64)
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        some = best.withColumn("nth", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("nth") <= k)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out
