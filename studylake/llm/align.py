"""Alignment of two tokenizers' tokens over the same texts, and which ids are linked how often in the whole corpus.

A document's bytes are a blank and its text. Tokenizer A (byte-level) encodes both, tokenizer B (pieces, which adds the blank itself) the text.
Both tile the bytes, so tokens are intervals: those of A and B together are sorted by start (lexsort), the ends' running maximum is taken
(maximum.accumulate), and a group breaks where a start reaches it: where both tokenizers end a token. Within the groups every overlapping pair is a link.

A batch of texts is encoded and aligned once, and written as one row: figures and digests of its documents, its distinct id pairs with their
counts, and each link as its pair's place among them. The pairs are then summed over all batches, the highest sum of each B id is found, and both come back to
the batches that asked, all in joins of plain rows (one for each batch and distinct pair, so no pair is hot beyond the number of batches). Nothing is broadcast or collected.

Nulls, empty texts and texts that either tokenizer changes (a text with U+2581): no tokens, zeros, ''. Special tokens' strings are plain text. Repeated rows are
rows of their own, a null id stays null. A very long text is cut where both tokenizers break (before a single blank between two other characters) and aligned piece by piece; only
its links meet in one row. No rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of
from .tokens import LETTERS, MARKS, STRETCH, WS, _bytes_as_letters, _Memo, path_of, tokenizer

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of a batch's texts, and of what is aligned at a time (a longer text is a batch of its own). They change no result.
BATCH, CHUNK = 6_000_000, 1_000_000
MEMO = 250_000


class Tokenizers(dict):
    """Stretch of text -> its A ids and B ids as bytes (None for B where the model changes its bytes); two generations of bounded size.

    A stretch is white space and what follows it, cut between letters and marks as in tokens.STRETCH. The pieces are looked through once: none may reach over such a cut.
    """

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.old, self.a_ids, self.model = {}, _Memo(tokenizer(path_of(a)), False).ids, sentencepiece.SentencePieceProcessor(model_file=path_of(b))
        pieces = [self.model.id_to_piece(k) for k in range(self.model.vocab_size())]
        over = re.compile(rf"[^▁]▁|\n|[{LETTERS}][{MARKS}]|[{MARKS}][{LETTERS}]")
        if any(over.search(p) for p in pieces):
            raise ValueError("pieces reach over the cuts between stretches")
        odd = "".join(sorted({c for p in pieces for c in re.findall(rf".([{WS}])", p)}))
        self.odd = re.compile(f"[{odd}]" if odd else "(?!)")  # texts with white space that ends a piece (\\r) are not cut
        back = {c: k for k, c in enumerate(_bytes_as_letters())}
        vocabulary = tokenizer(path_of(a)).get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.words = [f"{k}{end}".encode() for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for k in range(n) for end in ends]

    def both(self, stretch: str) -> tuple[bytes, bytes | None]:
        """The model adds a blank of its own; a line's end, which no piece holds, keeps that apart from the stretch."""
        a, whole = self.a_ids(stretch), stretch.encode()
        b = array("I", self.model.encode("\n" + stretch)[2:])
        same = b"".join(map(self.a_bytes.__getitem__, array("I", a))) == whole == b"".join(map(self.b_bytes.__getitem__, b))
        return a, b.tobytes() if same else None

    def __missing__(self, stretch: str) -> tuple[bytes, bytes | None]:
        found = self.old.get(stretch) or self.both(stretch)
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[stretch] = found
        return found

    def encode(self, text: str) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """(A ids, B ids) of each piece of a text; None if a tokenizer changes its bytes."""
        out = []
        for piece in cuts(" " + text):
            a, b = zip(*([self.both(piece)] if self.odd.search(piece) else map(self.__getitem__, STRETCH.findall(piece))), strict=True)
            if None in b:
                return None
            out.append((np.frombuffer(b"".join(a), np.uint32), np.frombuffer(b"".join(b), np.uint32)))
        return out


@lru_cache(maxsize=2)
def tokenizers(a: str = A, b: str = B) -> Tokenizers:
    return Tokenizers(a, b)


def cuts(text: str, most: int = CHUNK) -> list[str]:
    """A long text in pieces that both tokenizers encode as they encode the whole."""
    edge, out, at = re.compile(r"(?<=\S)(?= \S)"), [], 0
    while len(text) - at > most:
        m = edge.search(text, at + most)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def coalesce(a_sizes: np.ndarray, b_sizes: np.ndarray):
    """Groups and links of two tilings of the same bytes, given their tokens' sizes: each A token's group, each B token's, and the links as (A token, B token)."""
    a_end, b_end = np.cumsum(a_sizes), np.cumsum(b_sizes)
    a_start, b_start = a_end - a_sizes, b_end - b_sizes
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((np.arange(len(start)) >= len(a_end), start))
    reached = np.maximum.accumulate(end[order])
    group = np.empty(len(start), np.int64)
    group[order] = np.cumsum(np.concatenate([[False], start[order][1:] >= reached[:-1]])) if len(start) else 0
    low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    n = high - low
    left = np.repeat(np.arange(len(n)), n)
    right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n - low, n)
    return group[: len(a_end)], group[len(a_end) :], left, right


class _Batch:
    """Documents of a batch as they are aligned."""

    def __init__(self, both: Tokenizers):
        self.both, self.docs, self.links, self.segments, self.size, self.waiting = both, [], [], [], 0, 0

    def add(self, doc_id, text: str) -> None:
        self.size += len(text)
        pieces = self.both.encode(text) if text else None
        self.docs.append([doc_id, 0, 0, 0, 0, hashlib.sha256() if pieces else None])
        for a, b in pieces or []:
            self.segments.append((len(self.docs) - 1, a, b))
            self.waiting += len(a)
            if self.waiting * 4 > CHUNK:
                self.align()

    def align(self) -> None:
        if not self.segments:
            return
        both, (of, a, b) = self.both, zip(*self.segments, strict=True)
        n_a, n_b = ([len(x) for x in s] for s in (a, b))
        a, b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
        group_a, group_b, left, right = coalesce(both.a_sizes[a], both.b_sizes[b])
        self.links.append(a[left] * len(both.b_bytes) + b[right])
        # The groups' text: tokens by group, those of A first, each with what follows it.
        n = len(a) + len(b)
        words, last = np.empty(n, np.int64), 2 * len(both.a_bytes)
        words[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = 2 * a + np.append(group_a[1:] != group_a[:-1], True)
        words[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = last + 2 * b + np.append(group_b[1:] != group_b[:-1], True)
        texts = list(map(both.words.__getitem__, words.tolist()))
        a_at, b_at = np.cumsum([0, *n_a]), np.cumsum([0, *n_b])
        link_at = np.searchsorted(left, a_at).tolist()
        groups = np.append(group_a[a_at[:-1]], group_a[-1] + 1).tolist()
        ends = (a_at + b_at).tolist()
        for k, doc in enumerate(of):
            d = self.docs[doc]
            text = b"".join(texts[ends[k] : ends[k + 1]])[:-1]
            d[5].update(b";" + text if d[1] else text)
            d[1] += n_a[k]
            d[2] += n_b[k]
            d[3] += groups[k + 1] - groups[k]
            d[4] += link_at[k + 1] - link_at[k]
        self.segments, self.waiting = [], 0

    def row(self) -> list:
        self.align()
        found = pa.array(np.concatenate(self.links) if self.links else np.zeros(0, np.int64)).dictionary_encode()
        keys, at = found.dictionary.to_numpy(), found.indices.to_numpy()
        counts = np.bincount(at, minlength=len(keys))
        docs = [[*x] for x in zip(*self.docs, strict=True)]
        docs[5] = [x.hexdigest() if x else "" for x in docs[5]]
        return [*docs, keys, counts, zstandard.compress(at.astype("<u4").tobytes(), 1)]


_FIGURES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_BATCH = "batch long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, keys array<long>, counts array<long>, links binary"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned(docs: DataFrame, a: str = A, b: str = B, batch_size: int = BATCH) -> DataFrame:
    """One row for each batch of texts, numbered as it is written (see above)."""

    def run(batches):
        import pyspark

        task, nth, batch = pyspark.TaskContext.get().partitionId(), 0, _Batch(tokenizers(a, b))
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.list_(pa.int64())] * 2, pa.binary()]
        names = [x.split()[0] for x in _BATCH.split(", ")]

        def out():
            row = [(task << 32) + nth, *batch.row()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

        for arrow in batches:
            for doc_id, text in zip(arrow.column(0).to_pylist(), arrow.column(1), strict=True):
                text = text.as_py()
                if batch.docs and batch.size + len(text) > batch_size:
                    yield out()
                    nth, batch = nth + 1, _Batch(batch.both)
                batch.add(doc_id, text)
        if batch.docs:
            yield out()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, _BATCH)


def pair_counts(batches: DataFrame, b_ids: int) -> DataFrame:
    """key (A id x number of B ids + B id), total (links that hold the pair), best (the B id's highest total)."""
    totals = batches.select(F.explode(F.arrays_zip("keys", "counts")).alias("x")).groupBy("x.keys").agg(F.sum("x.counts").alias("total")).withColumnRenamed("keys", "key")
    totals = cut(totals.withColumn("b", F.col("key") % b_ids), "pairs")
    return totals.join(totals.groupBy("b").agg(F.max("total").alias("best")), "b").drop("b")


def align(docs: DataFrame, a: str = A, b: str = B, batch_size: int = BATCH) -> DataFrame:
    """Per document: numbers of tokens, groups and links, links whose pair is its B id's most frequent one, sum of its links' counts, digest of its groups."""
    batches = cut(aligned(docs, a, b, batch_size), "aligned")
    asked = batches.select("batch", F.posexplode("keys").alias("nth", "key")).join(pair_counts(batches, len(tokenizers(a, b).b_bytes)), "key")
    counts = asked.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("nth", "total", "best"))).alias("found"))
    back = batches.drop("keys", "counts").join(counts, "batch", "left").select(*_FIGURES, "links", F.col("found.total").alias("total"), F.col("found.best").alias("best"))

    def finish(rows):
        for row in (r for batch in rows for r in batch.to_pylist()):
            links = np.frombuffer(zstandard.decompress(row["links"]), "<u4")
            total, best = (np.array(row[k] or [], np.int64) for k in ("total", "best"))
            if len(links) and int(links.max()) >= len(total):
                raise ValueError("a batch lost counts")
            ends = np.cumsum([0, *row["n_links"]])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[links])])[ends]) for x in (total == best, total)]
            columns = [*(row[k] for k in _FIGURES[:5]), *sums, row["groups_sha256"]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate(columns)], names=[x.split()[0] for x in _OUT.split(", ")])

    return back.mapInArrow(finish, _OUT)
