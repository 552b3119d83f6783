"""Corpus-wide counts of hashed keys (n-grams, shingles), joined back to the texts they come from.

A task's consecutive texts form a batch. The batch's keys are exploded, summed within the batch, and dealt by hash: one row for each batch and part of
the key space, its keys sorted and packed. Each part sums its keys over all batches - its count table - and joins the counts to the rows that asked for
them; these go back to their batches by number, where they meet the texts. A key travels once for each batch that has it, whatever the number of texts or copies with it, so no
key is hot; rows grow with distinct (batch, key) pairs. The number of parts follows the size of the texts, so that a part's keys fit a task.

The texts are read twice, once for the keys and once for what is made of them, and batches are numbered by partition. So the input must give the same partitions
each time it is read: files do while the cluster stays as it is, and cut() makes files of anything else. Each batch's keys carry a digest of its texts through the count;
where it meets other texts (partitions were split anew between the readings) that is an error, never a wrong count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a batch's texts, about (a longer text is a batch of its own); keys of a part, about.
BATCH, PART = 10_000_000, 2_000_000


def same_number(keys: int, counts: int) -> None:
    """A batch must have as many distinct keys as counts came back."""
    if keys != counts:
        raise ValueError("a batch changed between two readings: write the input first, with cut()")


def digest_of(table: pa.Table) -> int:
    """64 bits of a batch's texts, in order."""
    h = xxhash.xxh3_64()
    for text in table["text"].to_pylist():
        data = text.encode("utf-8", "surrogatepass")
        h.update(len(data).to_bytes(8, "little"))
        h.update(data)
    return h.intdigest() - 2**63


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte of all of them, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def _batches(batches, number: int, most: int):
    """(number of the batch, its rows) in order: the same for the same rows."""
    rows, size, nth = [], 0, 0
    for batch in batches:
        lengths = pa.compute.utf8_length(batch.column("text")).to_pylist()
        at = 0
        for k, n in enumerate(lengths):
            if size and size + n > most:
                yield (number << 32) + nth, pa.Table.from_batches([*rows, batch.slice(at, k - at)])
                rows, size, nth, at = [], 0, nth + 1, k
            size += n
        rows.append(batch.slice(at))
    if rows:
        yield (number << 32) + nth, pa.Table.from_batches(rows)


def with_counts(rows: DataFrame, prepare, keys, finish, schema: str, batch_size: int = BATCH, part_size: int = PART) -> DataFrame:
    """finish(a batch's rows, what prepare gave, counts over all rows of its sorted distinct keys) -> pa.Table of the schema, for every batch.

    rows: a column text and any others, from files. prepare(list of texts) -> anything; keys(that) -> array<uint64> of what to count (a key as often as it counts).
    batch_size, part_size: see above; they change no result.
    """
    session = rows.sparkSession
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), size // (3 * part_size))

    def number() -> int:
        import pyspark

        return pyspark.TaskContext.get().partitionId()

    def deal(batches):
        """Keys of a batch by their upper bits."""
        for batch, table in _batches(batches, number(), batch_size):
            found, counts = np.unique(keys(prepare(table["text"].to_pylist())), return_counts=True)
            part = (((found >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
            starts, digest = np.flatnonzero(np.diff(part, prepend=-1)).tolist(), digest_of(table)
            asked = [(int(part[a]), a, b) for a, b in zip(starts, [*starts[1:], len(part)][: len(starts)], strict=True)]
            for some in (asked[k : k + 64] for k in range(0, len(asked), 64)):
                blobs = ([make(c[a:b]) for _, a, b in some] for c, make in ((found, _packed_keys), (counts, packed)))
                yield pa.RecordBatch.from_arrays([pa.array([batch] * len(some), pa.int64()), pa.array([digest] * len(some), pa.int64()), pa.array([p for p, _, _ in some], pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], names=["batch", "digest", "part", "keys", "counts"])

    def count(table):
        """One part: its count table, joined to the batches that asked."""
        asked = [_unpacked_keys(x) for x in table["keys"].to_pylist()]
        _, at = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.bincount(at, np.concatenate([unpacked(x) for x in table["counts"].to_pylist()]).astype(np.float64))
        ends = np.cumsum([0, *map(len, asked)])
        counts = [packed(totals[at[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return table.select(["batch", "digest", "part"]).append_column("counts", pa.array(counts, pa.binary()))

    def send(batches):
        """A batch's rows, compressed, in one row."""
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for batch, table in _batches(batches, number(), batch_size):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                out.write_table(table.combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "rows"])

    def meet(texts, counts):
        table = pa.ipc.open_stream(texts["rows"][0].as_py()).read_all()
        prepared = prepare(table["text"].to_pylist())
        if set(counts["digest"].to_pylist()) - {digest_of(table)}:
            raise ValueError("a batch changed between two readings: its counts are those of other texts")
        blobs = counts.sort_by("part")["counts"].to_pylist()
        totals = np.concatenate([unpacked(x) for x in blobs]) if blobs else np.zeros(0, "<u8")
        return finish(table.drop_columns("text"), prepared, totals.view(np.int64))

    dealt = rows.mapInArrow(deal, "batch long, digest long, part int, keys binary, counts binary")
    counted = dealt.groupBy("part").applyInArrow(count, "batch long, digest long, part int, counts binary")
    texts = rows.mapInArrow(send, "batch long, rows binary")
    return texts.groupBy("batch").cogroup(counted.groupBy("batch")).applyInArrow(meet, schema)
