"""A content-addressed store of token ids.

Documents are encoded, and a rolling hash over the last ids cuts each id stream where the hash has zeros, so that equal
passages give equal chunks wherever they stand. The store has these tables of Parquet files:

  kind=chunk   key (SHA-256 of ids), n_tokens, ids: each chunk once; ids is a byte that says how many bytes an id takes (2 or 4), then the ids, little-endian
  kind=recipe  key (root), n_tokens, digests: how a document's ids are put together, once for each distinct document; root = Merkle root of the digests
  documents    doc_id, start, n_tokens, root: in ascending doc_id order; start = ids of all documents before it
  manifest     level, node, n_docs, n_tokens, root: a tree of 1024 documents a node on level 1, 1024 nodes of the level below on levels 2 and 3, all on level 4;
               a node's root is the SHA-256 of its children's roots (with start and doc_id on level 1) in order

Reading checks the documents against the manifest, each chunk against its digest and each document against its root, and fails on any difference or loss. read() gives
the ids themselves; digests() needs only their checksums, so it reads each chunk once and combines the chunks' checksums.

Nulls: a null text is empty (the end id alone); documents with a null id come first. Repeated rows are stored as documents of their own that share one recipe; rows of one id are
ordered by root. A very long text is a document of many chunks. An empty table gives an empty store. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_rows, text_of
from .tokens import encoder

END = 2
#: Rolling hash: zero bits asked for, least and most ids of a chunk. It takes in the last 16 ids, by doubling.
BITS, LEAST, MOST = 9, 128, 4096
FACTORS = [(1 << k, np.uint32(pow(0x9E3779B1, 1 << k, 1 << 32))) for k in range(4)]
#: Children of a node of the manifest, as a power of two; rows of a range that is numbered by one task, about.
FANOUT_BITS, ROWS_PER_PART = 10, 500_000
POLYNOMIAL = 0xEDB88320


def _zeros(ids: np.ndarray) -> list[int]:
    """Places after which the hash of the last 16 ids has BITS zeros on top."""
    h = (ids + np.uint32(1)) * FACTORS[0][1]
    for back, factor in FACTORS:
        older = h[:-back] * factor
        h[back:] += older
    return (np.flatnonzero(h < np.uint32(1 << (32 - BITS))) + 1).tolist()


def _ends(n: int, zeros: list[int]) -> list[int]:
    """Ends of the chunks of n ids: at zeros, but LEAST ids apart; MOST at the latest."""
    ends, at = [], 0
    if n > LEAST:
        for e in zeros:
            while e - at > MOST:
                at += MOST
                ends.append(at)
            if e - at >= LEAST and n - e >= LEAST:
                ends.append(e)
                at = e
        while n - at > MOST:
            at += MOST
            ends.append(at)
    return [*ends, n]


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of a document."""
    return _ends(len(ids), _zeros(ids) if len(ids) > LEAST else [])


def chunked(documents: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """For each document (its ids as 32-bit integers): the number of ids and the bytes of its chunks.

    The hash runs over all documents at once: a cut is LEAST ids from a document's start at least, so it sees no other document's ids.
    """
    ids, out, start, k = np.frombuffer(b"".join(documents), "<u4"), [], 0, 0
    zeros = _zeros(ids)
    head, size = (b"\2", 2) if len(ids) == 0 or int(ids.max()) < 65536 else (b"\4", 4)
    data = ids.astype("<u2").tobytes() if size == 2 else ids.tobytes()
    for document in documents:
        n, first = len(document) // 4, k
        k = bisect.bisect_left(zeros, start + n, k)
        at, found = 0, []
        for e in _ends(n, [z - start for z in zeros[first:k]]):
            found.append((e - at, head + data[(start + at) * size : (start + e) * size]))
            at = e
        out.append(found)
        start += n
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256; a leaf without a partner moves up."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return hashlib.sha256(b"\2" + level[0]).digest()


def unpacked(data: bytes) -> bytes:
    """A chunk's ids as little-endian unsigned 32-bit integers."""
    return data[1:] if data[0] == 4 else np.frombuffer(data, "<u2", offset=1).astype("<u4").tobytes()


def _encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows of kind document (key: a number of its own, digests: its root), recipe and chunk; a task gives each recipe and chunk about once."""

    def start():
        import pyspark

        encode, end, seen, task, count = encoder(vocabulary), np.array([END], "<u4").tobytes(), set(), pyspark.TaskContext.get().partitionId(), iter(range(1 << 62))

        def body(rows):
            out = []
            documents = [encode(text) + end for _, text in rows]
            for (doc, _), document, chunks in zip(rows, documents, chunked(documents), strict=True):
                found = []
                for n, part in chunks:
                    found.append(d := hashlib.sha256(part).digest())
                    if d not in seen:
                        seen.add(d)
                        out.append(("chunk", d, None, n, None, part))
                root = merkle(found)
                if root not in seen:
                    seen.add(root)
                    out.append(("recipe", root, None, len(document) // 4, found, None))
                out.append(("document", b"%d-%d" % (task, next(count)), doc, len(document) // 4, [root], None))
                if len(seen) > 200_000:
                    seen.clear()
            return out

        return body

    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return map_rows(plain, start, "kind string, key binary, doc_id long, n_tokens long, digests array<binary>, ids binary")


def write(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json") -> None:
    """Write the store under path. The ids are shuffled once, by digest, and written once."""
    spark = docs.sparkSession
    once = _encoded(docs, vocabulary).repartition("kind", "key").dropDuplicates(["kind", "key"])
    once.write.options(**{"compression": "zstd", "parquet.enable.dictionary": "false"}).partitionBy("kind").parquet(f"{path}/store")
    started(_kind(spark, path, "document").select("doc_id", "n_tokens", F.get("digests", F.lit(0)).alias("root"), "key")).write.parquet(f"{path}/documents")
    _manifest(_documents(spark, path)).write.parquet(f"{path}/manifest")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, start long, n_tokens long, root binary, nth long").parquet(f"{path}/documents")


def _kind(spark: SparkSession, path: str, kind: str) -> DataFrame:
    stored = spark.read.schema("key binary, doc_id long, n_tokens long, digests array<binary>, ids binary, kind string")
    return stored.parquet(f"{path}/store").where(F.col("kind") == kind)


def started(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, root, nth (gapless from 0) in ascending doc_id order, for any ids: rows are range-partitioned by id, sums run within a part, then over one row for each part."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("doc_id"), F.asc("root"), F.asc("key")]
    rows = cut(rows.repartitionByRange(max(parts, rows.count() // ROWS_PER_PART), *order).withColumn("part", F.spark_partition_id()), "ids-dealt")
    ahead = lambda over: over.rowsBetween(Window.unboundedPreceding, -1)
    before = ahead(Window.orderBy("part"))
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"))
    sums = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy(*order)
    out = rows.withColumns({"inner": F.coalesce(F.sum("n_tokens").over(ahead(inside)), F.lit(0)), "nth": F.row_number().over(inside)}).join(sums, "part")
    out = out.select("doc_id", (F.col("start") + F.col("inner")).cast("long").alias("start"), "n_tokens", "root", (F.col("first") + F.col("nth") - 1).alias("nth"))
    return out.repartitionByRange("nth").sortWithinPartitions("nth")


def _manifest(documents: DataFrame) -> DataFrame:
    """level, node, n_docs, n_tokens, root of every node."""

    def nodes(rows: DataFrame, level: int, number, leaf) -> DataFrame:
        root = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", leaf.alias("leaf")))), lambda x: x["leaf"]), ";"), 256)
        return rows.groupBy(number.alias("node")).agg(F.sum("docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), root.alias("root")).select(F.lit(level).alias("level"), "node", "n_docs", "n_tokens", "root")

    leaf = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("start").cast("string"), F.hex("root"))
    levels = [cut(nodes(documents.withColumn("docs", F.lit(1)), 1, F.shiftright("nth", FANOUT_BITS), leaf), "ids-nodes")]
    for level in (2, 3, 4):
        below = levels[-1].select(F.col("node").alias("nth"), F.col("n_docs").alias("docs"), "n_tokens", "root")
        levels.append(nodes(below, level, F.shiftright("nth", FANOUT_BITS) if level < 4 else F.lit(0).cast("long"), F.col("root")))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def check_manifest(spark: SparkSession, path: str) -> None:
    """Raise if the documents, in number, order, place or root, are not those of the manifest."""
    kept = spark.read.schema("level int, node long, n_docs long, n_tokens long, root string").parquet(f"{path}/manifest")
    found = _manifest(_documents(spark, path))
    names = ["n_docs", "n_tokens", "root"]
    both = kept.select("level", "node", F.struct(*names).alias("kept")).join(found.select("level", "node", F.struct(*names).alias("found")), ["level", "node"], "full")
    if wrong := both.where(~F.col("kept").eqNullSafe(F.col("found"))).select("level", "node").limit(3).collect():
        raise ValueError(f"the documents differ from the manifest: {wrong}")


def _combined(rows: DataFrame, join, schema: str) -> DataFrame:
    """rows: root, n_tokens, parts (array of pos, digest, n, value) -> (root, n_tokens, join(parts)), where the digests give the root and the lengths the count."""
    columns = ["pos", "digest", "n", "value"]
    flat = rows.select("root", "n_tokens", *(F.transform("parts", (lambda c: lambda p: p[c])(c)).alias(c) for c in columns[1:]))

    def start():
        def body(batch):
            out = []
            for root, n, found, lengths, values in batch:
                if merkle(found) != root or sum(lengths) != n:
                    raise ValueError("a document differs from its Merkle root")
                out.append((root, n, join(values, lengths)))
            return out

        return body

    return map_rows(flat, start, schema)


def _recipes(spark: SparkSession, path: str, chunks: DataFrame) -> DataFrame:
    """root, n_tokens, parts in order. chunks: digest, n, value; a missing one is an error."""
    pieces = _kind(spark, path, "recipe").select(F.col("key").alias("root"), "n_tokens", F.posexplode("digests").alias("pos", "digest"))
    met = pieces.join(chunks, "digest", "left").withColumn("n", F.coalesce("n", F.raise_error("a chunk is missing").cast("long")))
    return met.groupBy("root", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "n", "value"))).alias("parts"))


def _chunks(spark: SparkSession, path: str, make, schema: str) -> DataFrame:
    """digest, n, value = make(ids) of every chunk, checked against its digest."""

    def start():
        def body(rows):
            out = []
            for digest, data in rows:
                if hashlib.sha256(data).digest() != digest:
                    raise ValueError("a chunk differs from its digest")
                ids = unpacked(data)
                out.append((digest, len(ids) // 4, make(ids)))
            return out

        return body

    return map_rows(_kind(spark, path, "chunk").select("key", "ids"), start, schema)


def _with_contents(spark: SparkSession, path: str, contents: DataFrame, column: str) -> DataFrame:
    """Every document with what its recipe gives (contents: root, size, and the column); a lost recipe or another length is an error."""
    check_manifest(spark, path)
    met = _documents(spark, path).join(contents, "root", "left")
    wrong = F.col("size").isNull() | (F.col("size") != F.col("n_tokens"))
    n = F.when(wrong, F.raise_error("a recipe is missing or has another length").cast("long")).otherwise(F.col("n_tokens"))
    return met.select("doc_id", "start", n.alias("n_tokens"), column)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit): every document, verified."""
    recipes = _recipes(spark, path, _chunks(spark, path, lambda ids: ids, "digest binary, n long, value binary"))
    contents = _combined(recipes, lambda values, _: b"".join(values), "root binary, size long, ids binary")
    return _with_contents(spark, path, contents, "ids")


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the checksum's, bits reflected."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = (b >> 1) ^ (POLYNOMIAL if b & 1 else 0)
    return out


@lru_cache(maxsize=8192)
def _shift(n: int) -> int:
    """x to the power 8 n: what n more bytes do to a checksum."""
    out, square = 1 << 31, 1 << 23  # x^0, x^8
    while n:
        if n & 1:
            out = _times(out, square)
        square, n = _times(square, square), n >> 1
    return out


def combined_crc(crcs: list[int], lengths: list[int]) -> int:
    """CRC-32 of the ids of several chunks from the CRC-32 and the number of ids of each."""
    out = 0
    for c, n in zip(crcs, lengths, strict=True):
        out = _times(_shift(4 * n), out) ^ c if out else c
    return out


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    recipes = _recipes(spark, path, _chunks(spark, path, zlib.crc32, "digest binary, n long, value long"))
    sums = _combined(recipes, combined_crc, "root binary, size long, ids_crc32 long")
    return _with_contents(spark, path, sums, "ids_crc32")
