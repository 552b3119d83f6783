"""Reversible chat formatting with empty turns, groups of copies across ranges, batches that change between readings."""

from __future__ import annotations

import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from studylake.llm import chat, counted, sharding


def test_random_conversations_come_back(spark):
    """20,000 conversations of short texts, many of them empty, of blanks, backslashes, marks and letters."""
    r = random.Random(4)
    bits = ["", "", " ", "\\", "\\\\", "### ", "\\### Assistant: ", "</turn>", "a", "é", "\n", "\U0001f600", "ok"]
    rows = [(c, t, r.choice(["user", "assistant", "assistant"]), "".join(r.choice(bits) for _ in range(r.randint(0, 3)))) for c in range(20_000) for t in range(r.randint(1, 4))]
    rows += [(-1, 0, "assistant", ""), (-1, 1, "assistant", ""), (-1, 2, "assistant", " \\\\")]
    got = {x.conv_id: x for x in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    want: dict = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role, text))
    assert got[-1].loss_chars == 3
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        sha = hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest()), turns


@pytest.mark.parametrize("share", [0.01, 0.03, 0.045, 0.049])
def test_groups_below_the_slack_stay_whole(spark, share):
    """A hundred groups of one to five per cent of a shard, whatever splitters lie in them."""
    n, shards = 40_000, 24
    each = int(n / shards * share)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 100 * each, F.concat(F.lit("group"), F.lpad((F.col("id") % 100).cast("string"), 6, "0"))).otherwise(F.lpad(F.col("id").cast("string"), 11, "x")).alias("text"))
    placed = sharding.shard(docs, shards)
    split = placed.join(docs, "doc_id").groupBy("text").agg(F.count_distinct("shard").alias("n")).where("n > 1")
    assert split.count() == 0
    sizes = [r["b"] for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == shards and max(sizes) - min(sizes) < 0.12 * sum(sizes) / shards


def test_a_hot_repeated_row_is_cut(spark):
    """One row makes a third of the table: splitters cut it too, so no range holds it all."""
    docs = spark.range(30_000).select(F.when(F.col("id") < 10_000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 10_000, "same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    sizes = [r["b"] for r in sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 24 and max(sizes) < 1.1 * sum(sizes) / 24
    slots = sharding.shard(docs).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in slots)


def test_digest_tells_batches_apart():
    table = lambda *t: pa.table({"text": pa.array(t)})
    digests = {counted.digest_of(table(*t)) for t in ([], [""], ["", ""], ["ab"], ["a", "b"], ["b", "a"])}
    assert len(digests) == 6
    split = pa.concat_tables([table("a"), table("b", "c")])
    assert counted.digest_of(split) == counted.digest_of(table("a", "b", "c"))


def test_batches_that_move_between_readings_are_an_error(spark, monkeypatch, tmp_path):
    """The second reading numbers its batches from other partitions: with equal numbers of distinct keys the counts would pass unnoticed."""
    spark.createDataFrame([(f"w{i} x{i}",) for i in range(40)], "text string").repartition(4).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    prepare = lambda texts: np.array(sorted(hash(w) & 0xFFFF for t in texts for w in t.split()), np.uint64)
    finish = lambda table, prepared, totals: pa.table({"n": pa.array([len(totals)], pa.int64())})
    assert counted.with_counts(rows, prepare, lambda k: k, finish, "n long").count() > 0

    class Shifting:
        """Rows whose second mapInArrow reads them in another order."""

        def __init__(self):
            self.sparkSession, self.calls = spark, 0

        def agg(self, *a):
            return rows.agg(*a)

        def mapInArrow(self, f, schema):  # noqa: N802
            self.calls += 1
            return (rows if self.calls == 1 else rows.repartition(4, "text").sortWithinPartitions("text")).mapInArrow(f, schema)

    with pytest.raises(Exception, match="changed between two readings"):
        counted.with_counts(SimpleNamespace(sparkSession=spark, agg=rows.agg, mapInArrow=Shifting().mapInArrow), prepare, lambda k: k, finish, "n long").collect()


def test_cutting_ids_takes_few_bytes_an_id():
    """op6's rolling hash runs in 32 bits: before, it took 24 bytes an id and more."""
    import tracemalloc

    from studylake.llm import idstore

    ids = np.random.default_rng(1).integers(0, 50_000, 1_000_000).astype("<u4")
    tracemalloc.start()
    try:
        zeros = idstore._zeros(ids)
        assert tracemalloc.get_traced_memory()[1] < 16 * len(ids)
    finally:
        tracemalloc.stop()
    assert 0.8 < len(zeros) / (len(ids) / 2**idstore.BITS) < 1.25
