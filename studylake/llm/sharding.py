"""Shards of near-equal bytes by sampled splitters.

Records are ordered by (hash of the text, hash of the id): equal texts lie together, and a group of copies that
is too large for one range can still be cut by the second part. A sample in which each record's chance
grows with its size gives quantile splitters; records go to the ranges between them; ranges that turn out overfull get
more splitters from a denser sample of their own. There are MOST ranges at most (a range of more rows is sorted with spill), so what the driver holds is bounded. Bytes before each range plus a running sum inside it then place each
record on the line of all bytes, which is cut into equal lengths.

A group of equal texts stays in one shard, at the place of its middle, unless it holds more than `slack` of a shard's bytes, at every size of the data; only such a group is dealt over neighbouring
shards record by record. So shards differ by about twice `slack` and the largest records.

Nulls: a null text counts as empty, a null id is replaced by the row's number. Repeated rows are kept, each with a slot of its own.
Very long texts are records like others. Ties (equal hashes) are ordered by the rows' numbers.
An empty table gives an empty result. Columns other than the two asked for are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, longs, text_of

LOWEST = -(2**63)
MOST = 8192


def _range_of(points: list[tuple[int, int]], key: Column, minor: Column) -> Column:
    """The number of splitters at or below (key, minor): a binary search in constant arrays."""
    if not points:
        return F.lit(0).cast("long")
    keys, minors = longs(p[0] for p in points), longs(p[1] for p in points)
    steps = longs(1 << b for b in reversed(range(len(points).bit_length())))

    def step(at: Column, width: Column) -> Column:
        k, m = F.get(keys, (at + width - 1).cast("int")), F.get(minors, (at + width - 1).cast("int"))
        return F.when((at + width <= len(points)) & ((k < key) | ((k == key) & (m <= minor))), at + width).otherwise(at)

    return F.aggregate(steps, F.lit(0).cast("long"), step)


def _drawn(df: DataFrame, rate: Column) -> DataFrame:
    """Rows with the chance size * rate, by a hash: the same rows in every attempt."""
    u = F.pmod(F.xxhash64("key", "minor", "tie", F.lit("draw")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return df.where(u < F.col("size") * rate).select("key", "minor")


def _quantiles(rows: list, n: int) -> list[tuple[int, int]]:
    """n - 1 quantiles of the sample; where a key holds only one of them, the cut goes before all of that key."""
    rows = sorted((r["key"], r["minor"]) for r in rows)
    points = sorted({rows[len(rows) * i // n] for i in range(1, n)}) if rows else []
    keys = [k for k, _ in points]
    return sorted({(k, m if k in keys[max(0, i - 1) : i] + keys[i + 1 : i + 2] else LOWEST) for i, (k, m) in enumerate(points)})


def shard(docs: DataFrame, shards: int = 24, ranges_per_shard: int = 32, drawn_per_range: int = 16, overfull: float = 2.5, slack: float = 0.05, rounds: int = 3) -> DataFrame:
    """doc_id, size, text_crc32, law 'bytes', shard, slot, grown_shard (null).

    `slack`: see above. `overfull`: a range above so many times the mean is subdivided, in at most `rounds` rounds.
    """
    text = text_of(docs)
    base = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.monotonically_increasing_id().alias("tie"),
        ).withColumn("minor", F.xxhash64("doc_id", "tie")),  # so that splitters can cut repeated rows too
        "shard-keys",
    )
    total, n = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(shards * ranges_per_shard, min(MOST, n // 500_000))
    rate = ranges * drawn_per_range / max(1, total)
    points = _quantiles(_drawn(base, F.lit(rate)).collect(), ranges)
    for turn in range(rounds + 1):
        ranged = base.withColumn("range", _range_of(points, F.col("key"), F.col("minor")))
        held = {r["range"]: r for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        most = overfull * total / ranges
        full = [k for k, r in held.items() if r["bytes"] > most and r["n"] > 1]
        if not full or turn == rounds:
            break
        more = _drawn(ranged.where(F.array_contains(longs(full), F.col("range"))), F.lit(rate * 4)).collect()
        points = sorted({*points, *_quantiles(more, 4 * len(full) + 1)})
    before_bytes, before_rows, b, k = [], [], 0, 0
    for i in range(len(points) + 1):
        before_bytes.append(b)
        before_rows.append(k)
        b, k = b + (held[i]["bytes"] if i in held else 0), k + (held[i]["n"] if i in held else 0)
    # Groups that splitters have cut (as many as splitters at most): their bytes in all ranges, and where they start on the line.
    parts = ranged.where(F.col("key").isin(sorted({k for k, _ in points}))).groupBy("key", "range").agg(F.sum("size").alias("bytes")).collect() if points else []
    cut_groups: dict[int, list] = {}
    for r in sorted(parts, key=lambda r: r["range"]):
        cut_groups.setdefault(r["key"], []).append(r)
    known = [(k, sum(r["bytes"] for r in rs), before_bytes[rs[0]["range"] + 1] - rs[0]["bytes"]) for k, rs in cut_groups.items() if len(rs) > 1]
    ranged = ranged.join(F.broadcast(docs.sparkSession.createDataFrame(known, "key long, cut_size long, cut_start long")), "key", "left")
    group = Window.partitionBy("range", "key")
    inside = Window.partitionBy("range").orderBy("key", "minor", "tie").rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("range").cast("int")
    line = ranged.withColumns({"through": F.sum("size").over(inside), "nth": F.count(F.lit(1)).over(inside)}).withColumns(
        {"group_size": F.sum("size").over(group), "group_start": F.min(F.col("through") - F.col("size")).over(group)}
    )
    before = F.get(longs(before_bytes), at)
    size, begins = F.coalesce("cut_size", "group_size"), F.coalesce("cut_start", before + F.col("group_start"))
    middle = F.when(size <= slack * total / shards, begins + size / 2).otherwise(before + F.col("through") - F.col("size") / 2)
    placed = cut(
        line.select(
            "doc_id", "size", "text_crc32",
            F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(1, total)))).cast("int").alias("shard"),
            (F.get(longs(before_rows), at) + F.col("nth") - 1).alias("row"),
        ),
        "shard-rows",
    )
    first = {r["shard"]: r["row"] for r in placed.groupBy("shard").agg(F.min("row").alias("row")).collect()}
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.get(longs(first.get(i, 0) for i in range(shards)), F.col("shard"))).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
