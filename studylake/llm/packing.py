"""Packing documents into windows by non-negative least squares over length combinations.

Each document is its ids and an end id; what exceeds a window is cut off in full windows, the rest is one piece. Pieces are
counted in length bins (rounded up). Shallow combinations - so many pieces of one bin with so many of another - that fill a
window are enumerated; non-negative least squares finds how often to use each so that the bins' counts are met; counts are rounded
down and pieces dealt to them by rank within their bin. What is left is packed greedily, first fit by falling length, in groups of
bounded size. Only the histogram, whose size is that of a window, comes to the driver.

Nulls: a null text is empty, its document is the end id alone; a null id is kept. Repeated rows are packed each for itself, like empty texts. Very long texts are cut in
full windows. Equal lengths are packed in the order of the rows' numbers. An empty table gives an empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, longs, map_rows, text_of
from .tokens import encoder

WINDOW, END, WIDTH = 4096, 2, 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """Each document's full windows and its rest."""

    def start():
        encode, end = encoder(vocabulary), np.array([END], "<u4").tobytes()

        def body(rows):
            out = []
            for doc, text in rows:
                ids = encode(text) + end
                n = len(ids) // 4
                out += [(doc, at, min(window, n - at), zlib.crc32(ids[4 * at : 4 * (at + window)]), n) for at in range(0, n, window)]
            return out

        return body

    return map_rows(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")), start, PIECES)


def combinations(bins: int) -> np.ndarray:
    """Columns of piece counts by bin (1..bins): m pieces of bin i, then one or more of the bin that fills what is left."""
    found = set()
    for i in range(1, bins + 1):
        for m in range(1, bins // i + 1):
            left = bins - m * i
            if not left:
                found.add(((i, m),))
            for k in range(1, 5):
                if left and left % k == 0 and left // k != i:
                    found.add(tuple(sorted(((i, m), (left // k, k)))))
    out = np.zeros((bins, len(found)), np.float32)
    for c, parts in enumerate(sorted(found)):
        for b, m in parts:
            out[b - 1, c] = m
    return out


def nnls(a: np.ndarray, h: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that makes |a x - h| small: projected gradient with momentum."""
    v = np.ones(a.shape[1], np.float32)
    for _ in range(20):  # largest eigenvalue of a'a, for the step
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) or 1
    step = 1 / (1.05 * float(np.linalg.norm(a.T @ (a @ v))) or 1)
    x = y = np.zeros(a.shape[1], np.float32)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (a.T @ (a @ y - h)))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / t2 * (new - x), t2
    return x.astype(np.float64)


def plan(histogram: dict[int, int], bins: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (bin, low, high, first sequence, place): the pieces of a bin with ranks low..high-1 go, in that order, to consecutive sequences at a place; and the number of sequences."""
    a, left = combinations(bins), np.zeros(bins, np.int64)
    for b, n in histogram.items():
        left[b - 1] = n
    x, used, rows, sequence = nnls(a, left.astype(np.float32)), np.zeros(bins, np.int64), [], 0
    for c in np.argsort(-x, kind="stable"):
        parts = np.flatnonzero(a[:, c])
        times = min([int(x[c] + 0.5), *(int((left[b] - used[b]) // a[b, c]) for b in parts)])
        if times <= 0:
            continue
        place = 0
        for b in parts[::-1]:
            for _ in range(int(a[b, c])):
                rows.append((int(b) + 1, int(used[b]), int(used[b]) + times, sequence, place))
                used[b] += times
                place += 1
        sequence += times
    return rows, sequence


def _first_fit(lengths: np.ndarray, ties: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and place of each piece of one group: falling length, the first sequence with room (a tree of free room finds it)."""
    order, n = np.lexsort((ties, -lengths)), len(lengths)
    width = 1 << max(0, n - 1).bit_length()
    room = [window] * (2 * width)
    sequence, place, filled = np.zeros(n, np.int64), np.zeros(n, np.int64), [0] * width
    for k, need in enumerate(lengths[order].tolist()):
        at = 1
        while at < width:
            at = 2 * at if room[2 * at] >= need else 2 * at + 1
        s = at - width
        sequence[order[k]], place[order[k]] = s, filled[s]
        filled[s] += 1
        room[at] -= need
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return sequence, place


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", window: int = WINDOW, width: int = WIDTH, group: int = 20_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark, bins = docs.sparkSession, window // width
    cuts = cut(pieces(docs, vocabulary, window).withColumns({"bin": F.ceil(F.col("length") / width).cast("int"), "tie": F.monotonically_increasing_id()}), "pack-pieces")
    # Ranks within a bin, in two steps: a bin may hold most pieces, so it is dealt over as many parts as its own pieces ask for.
    histogram = {r["bin"]: r["n"] for r in cuts.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    parts = longs(min(1 << 20, -(-histogram.get(b, 0) // 1000) or 1) for b in range(1, bins + 1))
    salted = cuts.withColumn("part", F.pmod(F.xxhash64("tie"), F.get(parts, F.col("bin") - 1)).cast("int"))
    counted = salted.groupBy("bin", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = salted.withColumn("nth", F.row_number().over(Window.partitionBy("bin", "part").orderBy("tie")))
    ranked = ranked.join(counted.select("bin", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), ["bin", "part"])
    ranked = ranked.withColumn("rank", F.col("nth") + F.col("before") - 1).drop("nth", "before", "part")
    rows, full = plan(histogram, bins) if histogram else ([], 0)
    # The plan has a few rows for each combination in use: its size is bounded by the window's, not by the data's.
    planned = spark.createDataFrame(rows, "bin int, low long, high long, first long, place long")
    met = ranked.join(F.broadcast(planned.withColumnRenamed("bin", "of")), (F.col("bin") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
    met = cut(met.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "tie", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "place"), "pack-planned")
    left = met.where(F.col("sequence_id").isNull()).drop("sequence_id", "place")
    groups = max(1, -(-left.count() // group))

    names = met.columns

    def fit(key, rows):
        sequence, place = _first_fit(rows["length"].to_numpy(), rows["tie"].to_numpy(), window)
        rows = rows.append_column("sequence_id", pa.array(full + key[0].as_py() + groups * sequence)).append_column("place", pa.array(place))
        return rows.select(names)

    greedy = left.withColumn("g", F.pmod(F.xxhash64("tie", F.lit("greedy")), F.lit(groups))).groupBy("g").applyInArrow(fit, met.schema)
    inside = Window.partitionBy("sequence_id").orderBy("place", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = met.where(F.col("sequence_id").isNotNull()).unionByName(greedy)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))
