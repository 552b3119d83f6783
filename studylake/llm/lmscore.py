"""Stupid-backoff language-model scores of n-grams of up to three words.

The model is the corpus itself, less the document that is scored. A word after two others scores c(uvw) / c(uv) if another document has the three words, else ALPHA
times c(vw) / c(v) if another has the last two, else ALPHA squared times the word's share of all words; for a word of no other document the count is ALPHA. The first
words of a text start on a lower level. Every word and every n-gram counts, at any size of the data; n-grams are told apart by 61 bits or more of their hash.

Counts are made and joined as in counted.py: each batch of documents explodes its n-grams of all orders, summed within the batch; they are counted
by hash over all batches; the counts come back and are joined to the documents' n-grams; a document's terms are summed.

Nulls: a null text counts as empty; an empty text has no tokens, a score of 0 and a null mean. Rows with a null id, and repeated rows, are scored each for itself (copies are other documents). Very
long texts are scored whole. There are no ties: every row has a score of its own. An empty table gives an empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of, word_hashes
from .counted import same_number, with_counts

ALPHA, ORDER = 0.4, 3
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: str) -> list[bytes]:
    """Lower-case words between ASCII blanks."""
    return text.lower().encode("utf-8", "surrogatepass").split()


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([t.lower() for t in texts])


def _grams(words: np.ndarray, ends: np.ndarray, n: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at the places, and whether a place has one within its text. The upper bits tell the orders apart (1, 01, 001 from the highest on)."""
    h = np.full(max(0, len(words) - n + 1), n, np.uint64)
    for k in range(n):
        h = (h ^ words[k : k + len(h)]) * FACTOR
        h ^= h >> np.uint64(29)
    there = np.ones(len(words), bool)
    for k in range(n - 1):
        at = ends[:-1] + k
        there[at[at < ends[1:]]] = False
    out = np.zeros(len(words), np.uint64)
    out[len(words) - len(h) :] = h >> np.uint64(order - n + 1) | np.uint64(1 << (63 - order + n))
    return out, there


def _in_order(keys: np.ndarray, bits: int = 22) -> np.ndarray:
    """Places of the keys in their order, equal ones as they come. The upper bits and the place are sorted as one number; where that leaves different keys out of order, the keys are."""
    if len(keys) < 1 << bits:
        low = np.uint64((1 << bits) - 1)
        both = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
        both.sort()
        order = (both & low).astype(np.int64)
        found = keys[order]
        if (found[1:] >= found[:-1]).all():
            return order
    return np.argsort(keys, kind="stable")


def _others(keys: np.ndarray, there: np.ndarray, doc: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: how often other documents have the n-gram that ends there; and the totals that are left, of higher orders.

    Places in the order of their keys, equal keys in the order of the texts: runs of a key have one total, runs of a key and text are the text's own.
    """
    at = np.flatnonzero(there)
    order = at[_in_order(keys[at])]
    keys = keys[order]
    new = np.diff(keys, prepend=~keys[:1]) != 0
    n = int(new.sum())
    same_number(n, min(n, len(totals)))
    starts = np.flatnonzero(new | (np.diff(doc[order], prepend=-1) != 0))
    own = np.diff(starts, append=len(order))
    out = np.zeros(len(there), np.int64)
    out[order] = totals[np.cumsum(new) - 1] - np.repeat(own, own)
    return out, totals[n:]


def _terms(words: np.ndarray, ends: np.ndarray, totals: np.ndarray, order: int):
    """Per text: words, places scored by each order from 2, the sum of logarithms, how many terms have the number of all words below."""
    n, texts = len(words), len(ends) - 1
    doc = np.repeat(np.arange(texts, dtype=np.int32), np.diff(ends))
    counts, longest = [], np.zeros(n, np.int8)
    for k in range(1, order + 1):
        keys, there = _grams(words, ends, k, order)
        c, totals = _others(keys, there, doc, totals)
        counts.append(c)
        longest += there  # the order a place begins with
    same_number(0, len(totals))
    level, score = np.zeros(n, np.int8), np.zeros(n)
    for k in range(order, 1, -1):
        hit = np.flatnonzero((level == 0) & (counts[k - 1] > 0))
        level[hit] = k
        score[hit] = np.log(counts[k - 1][hit]) - np.log(counts[k - 2][hit - 1])
    lone = np.flatnonzero(level == 0)
    score[lone] = np.log(np.maximum(counts[0][lone], ALPHA))
    level[lone] = 1
    score += (longest - level) * math.log(ALPHA)
    sums = lambda x: np.bincount(doc, x, texts)
    return np.diff(ends), [sums(level == k).astype(np.int64) for k in range(2, order + 1)], sums(score).astype(np.float64), sums(level == 1).astype(np.int64)


def score(docs: DataFrame, order: int = ORDER, written: bool = False, **sizes: int) -> DataFrame:
    """doc_id, n_tokens, n_seen (places scored by an n-gram of two words or more), n_seen_whole (by one of the full order), log_score, mean_log_score.

    written: docs is read from files as they are, so that reading it twice gives the same partitions; anything else is written first. sizes: of batches and parts, see counted.py.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    rows = rows if written else cut(rows, "lm-texts")

    def keys(prepared: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.concatenate([h[there] for h, there in (_grams(*prepared, k, order) for k in range(1, order + 1))])

    def finish(table: pa.Table, prepared: tuple[np.ndarray, np.ndarray], totals: np.ndarray) -> pa.Table:
        n, seen, score, lone = _terms(*prepared, totals, order)
        whole = seen[-1] if seen else np.zeros(len(n), np.int64)
        return pa.table({"doc_id": table["doc_id"], "n_tokens": pa.array(n), "n_seen": pa.array(sum(seen, np.zeros(len(n), np.int64))), "n_seen_whole": pa.array(whole), "log_score": pa.array(score), "lone": pa.array(lone)})

    found = cut(with_counts(rows, _words, keys, finish, "doc_id long, n_tokens long, n_seen long, n_seen_whole long, log_score double, lone long", **sizes), "lm-scores")
    total = found.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    log_score = F.col("log_score") - F.col("lone") * F.log(F.greatest(F.lit(1), F.lit(total) - F.col("n_tokens")))
    out = found.select("doc_id", "n_tokens", "n_seen", "n_seen_whole", log_score.alias("log_score"))
    return out.withColumn("mean_log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")))
