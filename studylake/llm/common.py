"""What the corpus operators share: input tables, the shared folder, small Column helpers."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, shared_dir  # noqa: F401

#: Characters that separate words: space and \x09-\x0D.
BLANKS = r"[ \t-\r]"

#: Rows of a table that may be sent to every task, once they are counted.
SMALL = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def longs(values) -> Column:
    """A constant array<bigint>."""
    values = list(values)
    if not values:
        return F.expr("cast(array() as array<bigint>)")
    return F.expr("array(" + ",".join("(-9223372036854775807L - 1L)" if v == -(2**63) else f"{int(v)}L" for v in values) + ")")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}


def map_rows(df: DataFrame, start, schema: str) -> DataFrame:
    """Rows through Python in Arrow batches. start() is called once for each task and gives a function from a list of tuples to a list of tuples.

    Batches hold a thousand rows at most, so that very long texts don't meet in memory by the ten thousand.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    fields = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split(" ") for x in schema.split(", "))])

    def run(batches):
        body = start()
        for batch in batches:
            out = body(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
            columns = list(zip(*out, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return df.mapInArrow(run, schema)


_BASE, _FACTOR = 0xD6E8FEB86659FD93, np.uint64(0x9E3779B97F4A7C15)
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse modulo 2^64 to the powers 0 .. n - 1."""
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b % 2**64, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 2**64)))


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words between ASCII blanks start, and their 64-bit hashes: polynomials of their bytes, from differences of one running sum, mixed with their lengths."""
    b = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(_SOLID[b], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    powers, inverse = _powers(max(1 << 20, 1 << len(b).bit_length()))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b + np.uint64(1)) * powers[: len(b)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts] ^ (ends - starts).astype(np.uint64) * _FACTOR
    h = (h ^ (h >> np.uint64(32))) * _FACTOR
    return starts, h ^ (h >> np.uint64(29))


def _pieces(text: str, most: int = 1_000_000) -> list[str]:
    """A very long text cut at ASCII blanks into pieces of so many characters, or of one word."""
    out, at = [], 0
    while len(text) - at > most:
        blank = re.compile(BLANKS).search(text, at + most)
        end = blank.start() if blank else len(text)
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, one text after the other, and where each text begins and the last ends."""
    found, counts, group, size = [np.zeros(0, np.uint64)], np.zeros(len(texts) + 1, np.int64), [], 0

    def out():
        data = [t.encode("utf-8", "surrogatepass") for _, t in group]
        starts, h = _hashes(b" ".join(data))
        found.append(h)
        np.add.at(counts, [k + 1 for k, _ in group], np.diff(np.searchsorted(starts, np.cumsum([0, *(len(d) + 1 for d in data)]))))
        group.clear()

    for k, text in enumerate(texts):
        for piece in _pieces(text):
            if group and size + len(piece) > 500_000:
                out()
                size = 0
            group.append((k, piece))
            size += len(piece) + 1
    if group:
        out()
    return np.concatenate(found), np.cumsum(counts)
