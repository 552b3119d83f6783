"""Near-duplicate documents by improved consistent weighted sampling.

A text's features are its shingles of five words, weighted by their count and by their inverse document frequency over all documents, told apart by 64-bit
hashes. Frequencies are exact at any size; they are counted and joined back as in counted.py. Consistent weighted sampling draws, for
each of BANDS x ROWS hashes, one shingle and level of it, alike for two texts with a chance near their weighted Jaccard similarity; texts
that agree on all samples of a band are candidates. Candidates that agree on fewer than AGREE of all samples are left out (a pair of similarity 0.8 agrees on fewer with a chance
below 10^-4), the others are verified by the exact weighted Jaccard similarity of their whole texts.

Copies are one class from the start, and only one of them goes on, under a row number that is written once. Within a bucket of candidates each text is first compared with
the bucket's first text, so a large group costs one comparison a text; then, in buckets whose texts still belong to several
classes, every pair of texts from two classes is compared: as pairs in small buckets; in larger ones the texts outside the largest class
meet all texts block by block, so that rows grow with the number of blocks and not of pairs: first their samples alone, then the texts of those that agree with some other. The rule is the same in buckets of every size. Classes are the connected components of all links found.

The samples' random numbers come from a table of 2^16 rows that a shingle's hash picks from. The table is a fixed size; two shingles on one row only make candidates likelier.

Nulls: a null text counts as empty; empty texts are copies of each other. A text of fewer than five words has one shingle of all its words. Rows with a null id take the
class of an equal text, or null. Repeated rows share their class; different texts of one id are texts of their own. Very long texts are compared whole. Ties: the smallest id names a class. An empty table gives an empty result. Columns besides doc_id and text are not read (keep_one() passes every column on).
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL, cut, map_rows, text_of, word_hashes
from .components import components
from .counted import packed, same_number, unpacked, with_counts

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 12, 4
#: Samples (of BANDS x ROWS) that a pair to be verified agrees on.
AGREE = 27
TABLE_BITS = 16
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Texts in a block of a large bucket; buckets up to PAIRWISE texts are compared as pairs.
BLOCK, PAIRWISE = 2048, 48


def _shingles(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of the shingles of a row of words, one for each place; fewer words than a shingle has are one."""
    n = max(1, len(words) - SHINGLE + 1) if len(words) else 0
    h = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        h = (h ^ words[k : k + n]) * _FACTOR
        h ^= h >> np.uint64(29)
    return h


def shingles(text: str) -> np.ndarray:
    return _shingles(word_hashes([text])[0])


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return (np.log((1 + n) / (1 + df.astype(np.float64))) + 1).astype(np.float32)


def weighted(text: str, dfs: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and their weights from their document frequencies (dfs, packed) among n documents."""
    h, tf = np.unique(shingles(text), return_counts=True)
    return h, tf.astype(np.float32) * idf_of(unpacked(dfs), n)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    (ha, wa), (hb, wb) = a, b
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    low = float(np.minimum(wa[i], wb[j]).sum(dtype=np.float64))
    total = float(wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64)) - low
    return low / total if total else 1.0


@lru_cache(maxsize=1)
def _draws() -> np.ndarray:
    """In each row of the table, for each hash: r and beta (r from Gamma(2, 1), beta uniform), and the logarithm of c (from Gamma(2, 1)) less r."""
    g = np.random.Generator(np.random.PCG64(20_10))
    shape = (1 << TABLE_BITS, BANDS * ROWS)
    r = g.standard_gamma(2.0, shape, np.float32)
    return np.concatenate([r, g.random(shape, np.float32), np.log(g.standard_gamma(2.0, shape, np.float32)) - r], axis=1)


def samples(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sampled shingle and its level for each hash."""
    draws, k, logs = _draws(), BANDS * ROWS, np.log(w)
    best = level = chosen = None
    for at in range(0, len(h), 1024):
        rows = draws[(h[at : at + 1024] & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)]
        r, beta = rows[:, :k], rows[:, k : 2 * k]
        t = logs[at : at + 1024, None] / r
        t += beta
        np.floor(t, out=t)
        a = t - beta
        a *= r
        np.subtract(rows[:, 2 * k :], a, out=a)
        low = a.min(axis=0)
        hits = np.flatnonzero(a == low)[::-1]  # the first of equal ones is written last
        first = np.zeros(k, np.int64)
        first[hits % k] = hits // k
        t, s = t[first, np.arange(k)], h[at + first]
        if best is None:
            best, level, chosen = low, t, s
        else:
            less = low < best
            best, level, chosen = np.where(less, low, best), np.where(less, t, level), np.where(less, s, chosen)
    return chosen, level


def sketch(h: np.ndarray, w: np.ndarray) -> tuple[list[int], bytes]:
    """One 64-bit key for each band, and a byte of each sample."""
    chosen, level = samples(h, w)
    both = np.stack([chosen, level.astype(np.int64).view(np.uint64)], 1)
    mixed = ((both[:, 0] ^ (both[:, 1] * _FACTOR)) * _FACTOR) >> np.uint64(56)
    return [xxhash.xxh64_intdigest(row.tobytes()) - (1 << 63) for row in both.reshape(BANDS, -1)], mixed.astype(np.uint8).tobytes()


def _copy(text):
    return F.unhex(F.md5(text))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("copy", _copy(F.col("text")))


def sketches_of(rows: DataFrame, n: int, **sizes: int) -> DataFrame:
    """doc_id, copy (digest), weight (total), bands, bytes (of the samples), dfs (its shingles' document frequencies, packed) for each of rows (doc_id, text, from files), n in all."""

    def prepare(texts: list[str]) -> tuple[list[bytes], dict]:
        """The texts' digests, and the distinct shingles of each digest with their numbers."""
        copies, known = [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts], {}
        first = dict(zip(reversed(copies), reversed(texts), strict=True))
        words, ends = word_hashes(list(first.values()))
        every = _shingles(words)  # a shingle of one text is one of all, where it doesn't reach into the next
        for copy, a, b in zip(first, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            known[copy] = np.unique(every[a : b - SHINGLE + 1] if b - a >= SHINGLE else _shingles(words[a:b]), return_counts=True)
        return copies, known

    def keys(prepared) -> np.ndarray:
        copies, known = prepared
        return np.concatenate([known[c][0] for c in copies])

    def finish(table: pa.Table, prepared, totals: np.ndarray) -> pa.Table:
        (copies, known), made, found = prepared, {}, np.unique(keys(prepared))
        same_number(len(found), len(totals))
        for copy, (h, tf) in known.items():
            df = totals[np.searchsorted(found, h)]
            w = tf.astype(np.float32) * idf_of(df, n)
            made[copy] = (float(w.sum(dtype=np.float64)), *(sketch(h, w) if len(h) else ([], b"")), packed(df))  # a text without words has no shingles
        kinds = {"weight": pa.float64(), "bands": pa.list_(pa.int64()), "bytes": pa.binary(), "dfs": pa.binary()}
        columns = {name: pa.array([made[c][k] for c in copies], kind) for k, (name, kind) in enumerate(kinds.items())}
        return pa.table({"doc_id": table["doc_id"], "copy": pa.array(copies, pa.binary()), **columns})

    return with_counts(rows, prepare, keys, finish, "doc_id long, copy binary, weight double, bands array<long>, bytes binary, dfs binary", **sizes)


def _agreeing(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree on enough samples."""
    for side in "ab":
        pairs = pairs.join(sketches.select(F.col("rep").alias(side), F.col("bytes").alias(f"bytes_{side}")), side)
    same = F.aggregate(F.sequence(F.lit(1), F.lit(BANDS * ROWS)), F.lit(0), lambda n, k: n + (F.col("bytes_a").substr(k, F.lit(1)) == F.col("bytes_b").substr(k, F.lit(1))).cast("int"))
    return pairs.where(same >= AGREE).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, least: float) -> DataFrame:
    """The pairs (a, b) whose whole texts are alike enough, with their similarity."""

    def start():
        seen = {}

        def of(i: int, text: str, dfs: bytes):
            if i not in seen:
                if len(seen) >= 32:
                    seen.clear()
                seen[i] = weighted(text, dfs, n)
            return seen[i]

        def body(rows):
            out = ((a, b, weighted_jaccard(of(a, x, dx), of(b, y, dy))) for a, b, x, dx, y, dy in rows)
            return [r for r in out if r[2] >= least]

        return body

    one, two = texts.select(F.col("rep").alias("a"), F.col("text").alias("x"), F.col("dfs").alias("dx")), texts.select(F.col("rep").alias("b"), F.col("text").alias("y"), F.col("dfs").alias("dy"))
    return map_rows(pairs.join(two, "b").join(one, "a").select("a", "b", "x", "dx", "y", "dy"), start, "a long, b long, similarity double")


def _agree_with(samples: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Which rows of samples agree with one on enough of them."""
    return (samples == one).sum(axis=1) >= AGREE


def _samples(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def _sifted(table: pa.Table, least: float) -> pa.Table:
    """The rows of a block, without texts, that have a partner on the other side: of another class, with a total not too far off and enough samples in common."""
    side, kinds, totals = (table[c].to_numpy() for c in ("side", "class", "weight"))
    samples, low = _samples(table), least - 1e-6
    right = np.flatnonzero(side)
    keep = np.zeros(len(side), bool)
    for k in np.flatnonzero(side == 0):
        met = _agree_with(samples[right], samples[k]) & (kinds[right] != kinds[k]) & (totals[right] >= totals[k] * low) & (totals[k] >= totals[right] * low)
        keep[right[met]] = True
        keep[k] = met.any()
    return table.filter(pa.array(keep))


def _near_in_blocks(texts: list[str], dfs: list[bytes], sides: list[int], reps: list[int], classes: list[int], samples: np.ndarray, n: int, least: float) -> list[tuple[int, int]]:
    """Links between a left and a right text of different classes: for each left text one to each class it meets. An inverted index of the right texts gives all its similarities at once."""
    weights = [weighted(t, d, n) for t, d in zip(texts, dfs, strict=True)]
    right = [k for k, side in enumerate(sides) if side]
    if not right or len(right) == len(sides):
        return []
    h = np.concatenate([weights[k][0] for k in right])
    w = np.concatenate([weights[k][1] for k in right]).astype(np.float64)
    who = np.repeat(np.arange(len(right)), [len(weights[k][0]) for k in right])
    order = np.argsort(h, kind="stable")
    h, w, who = h[order], w[order], who[order]
    totals, of_right = np.bincount(who, w, len(right)), samples[right]
    names, kinds = np.array([reps[k] for k in right]), np.array([classes[k] for k in right])
    out = []
    for k, side in enumerate(sides):
        if side:
            continue
        low, high = np.searchsorted(h, weights[k][0], "left"), np.searchsorted(h, weights[k][0], "right")
        hits = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(hits)[:-1]]), hits) + np.arange(hits.sum())
        own = weights[k][1].astype(np.float64)
        shared = np.bincount(who[at], np.minimum(w[at], np.repeat(own, hits)), len(right))
        near = np.flatnonzero((shared >= least * (totals + own.sum() - shared)) & (kinds != classes[k]) & _agree_with(of_right, samples[k]))
        _, first = np.unique(kinds[near], return_index=True)
        out += [(min(reps[k], int(x)), max(reps[k], int(x))) for x in names[near[first]]]
    return out


def _by_blocks(members: DataFrame, largest: DataFrame, sketches: DataFrame, texts: DataFrame, total: int, least: float) -> DataFrame:
    """Links in large buckets (members: band, key, rep, weight, class). Those outside the bucket's largest class are the left side, all are the right side; each left block meets each right block.

    First by samples alone, then with the texts of those that have a partner; the candidates are those of small buckets, pair by pair.
    """
    sized = members.join(largest, ["band", "key"])
    left = F.col("class") != F.col("largest")
    part = lambda n: F.pmod(F.xxhash64("rep"), n)
    lefts, rights = F.ceil(F.col("others") / BLOCK), F.ceil(F.col("n") / BLOCK)
    named = ["band", "key", "rep", "weight", "class"]
    one = sized.where(left).select(*named, F.lit(0).alias("side"), part(lefts).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), rights - 1)).alias("j"))
    two = sized.select(*named, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), lefts - 1)).alias("i"), part(rights).alias("j"))
    block = ["band", "key", "i", "j"]
    rows = one.unionByName(two).join(sketches.select("rep", "bytes"), "rep").select(*block, "rep", "weight", "class", "side", "bytes")
    sifted = rows.groupBy(*block).applyInArrow(lambda t: _sifted(t, least), rows.schema)

    def compare(t):
        found = _near_in_blocks(*(t[c].to_pylist() for c in ("text", "dfs", "side", "rep", "class")), _samples(t), total, least)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return cut(sifted, "sifted").join(texts, "rep").groupBy(*block).applyInArrow(compare, "a long, b long")


def _texts(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, text, dfs of the texts named by reps (rep, doc, copy, dfs). Few digests go to the texts; many meet them by a shuffle."""
    few = reps.limit(SMALL + 1).count() <= SMALL
    wanted = reps.select("doc", "copy")
    found = _plain(docs).withColumnRenamed("doc_id", "doc").join(F.broadcast(wanted) if few else wanted, ["doc", "copy"], "left_semi").dropDuplicates(["copy"])
    return found.drop("doc").join(reps.drop("doc"), "copy").select("rep", "text", "dfs")


def _classes(docs: DataFrame, least: float, written: bool) -> DataFrame:
    """copy (digest), doc (smallest id), label (of the class), class_id (the class's smallest id) for each distinct text."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    rows = rows if written else cut(rows, "near-texts")
    total = rows.count()
    every = cut(sketches_of(rows, total).withColumn("rep", F.monotonically_increasing_id()), "sketches")
    firsts = cut(every.groupBy("copy").agg(F.min("rep").alias("rep"), F.min("doc_id").alias("doc")), "firsts")
    sketches = every.drop("copy").join(firsts.where(F.col("doc").isNotNull()), "rep")
    each = sketches.select("rep", "doc", "weight", F.posexplode("bands").alias("band", "key"))
    hubs = each.groupBy("band", "key").agg(F.min(F.struct("doc", "rep", "weight")).alias("hub"), F.count("*").alias("n")).where(F.col("n") > 1)
    met = cut(each.drop("doc").join(hubs.select("band", "key", F.col("hub.rep").alias("hub"), F.col("hub.weight").alias("hub_weight")), ["band", "key"]), "met")
    in_met = cut(sketches.select("rep", "doc", "copy", "bytes", "dfs").join(met.select("rep").distinct(), "rep", "left_semi"), "met-sketches")
    # Totals further apart than this can't be alike enough.
    level = lambda x, y: (F.col(x) >= F.col(y) * (least - 1e-6)) & (F.col(y) >= F.col(x) * (least - 1e-6))
    stars = met.where((F.col("rep") != F.col("hub")) & level("weight", "hub_weight")).select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
    stars = cut(_agreeing(stars, in_met), "stars")
    texts = cut(_texts(rows, in_met.drop("bytes")), "texts")
    links = cut(_verified(stars, texts, total, least).select("a", "b"), "links")
    labels = components(links)
    # Buckets whose texts are still in several classes: all pairs of texts from two of them.
    classed = met.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("band", "key", "rep", "weight", F.coalesce("label", "rep").alias("class"))
    kinds = classed.groupBy("band", "key", "class").agg(F.count("*").alias("k"))
    mixed = kinds.groupBy("band", "key").agg(F.sum("k").alias("n"), F.count("*").alias("classes"), F.max(F.struct("k", "class")).alias("top")).where(F.col("classes") > 1)
    mixed = cut(mixed.select("band", "key", "n", F.col("top.class").alias("largest"), (F.col("n") - F.col("top.k")).alias("others")), "mixed")
    few = classed.join(mixed.where(F.col("n") <= PAIRWISE).select("band", "key"), ["band", "key"])
    side = lambda c: few.select("band", "key", F.col("class").alias(f"c{c}"), F.col("rep").alias(f"r{c}"), F.col("weight").alias(f"w{c}"))
    cross = side("a").join(side("b"), ["band", "key"]).where((F.col("ca") < F.col("cb")) & level("wa", "wb"))
    cross = cross.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    cross = _agreeing(cross, in_met)
    many = mixed.where(F.col("n") > PAIRWISE)
    more = cut(_verified(cross, texts, total, least).select("a", "b").unionByName(_by_blocks(classed, many, in_met, texts, total, least)), "links")
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    classes = firsts.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("copy", "doc", F.coalesce("label", "rep").alias("label"))
    return classes.join(classes.groupBy("label").agg(F.min("doc").alias("class_id")), "label")


def near_duplicates(docs: DataFrame, least: float = LEAST, written: bool = False) -> DataFrame:
    """doc_id, class_id: the smallest id among the documents linked to it. written: docs is read from files as they are; anything else is written first."""
    return _plain(docs).select("doc_id", "copy").join(_classes(docs, least, written).select("copy", "class_id"), "copy").select("doc_id", "class_id")


def keep_one(docs: DataFrame, least: float = LEAST, written: bool = False) -> DataFrame:
    """One document of each class, that of the smallest id, with all its columns. Rows with a null id can't be named by a class and are kept."""
    first = _classes(docs, least, written).where(F.col("doc").isNotNull()).groupBy("label").agg(F.min(F.struct("doc", "copy")).alias("f")).select(F.col("f.doc").alias("__doc"), F.col("f.copy").alias("__copy"))
    named = docs.where(docs["doc_id"].isNotNull()).withColumns({"__doc": F.col("doc_id").cast("long"), "__copy": _copy(text_of(docs))})
    kept = named.join(first, ["__doc", "__copy"], "left_semi").dropDuplicates(["__doc", "__copy"])
    return kept.select(docs.columns).unionByName(docs.where(docs["doc_id"].isNull()))


def least_chance(similarity: float = LEAST) -> float:
    """The chance that a pair of this similarity becomes a candidate."""
    return 1 - math.pow(1 - similarity**ROWS, BANDS)
