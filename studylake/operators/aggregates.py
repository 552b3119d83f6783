"""Aggregations over the archive, journals and measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import status_class


def first_occurrence(value: Column, seq: Column) -> Column:
    """Distinct non-empty values in the order of their first seq, comma-joined; an aggregate."""
    kept = F.filter(F.array_sort(F.collect_set(F.struct(seq.alias("s"), value.alias("v")))), lambda x: x["v"].isNotNull() & (x["v"] != ""))
    return F.array_join(F.array_distinct(F.transform(kept, lambda x: x["v"])), ",")


def study_totals(series: DataFrame, instances: DataFrame) -> DataFrame:
    """Per study: series, instances (hidden ones too), bytes, modalities in first-occurrence order. Series and instances are counted apart."""
    s = series.groupBy("study_uid").agg(F.count("*").alias("series_count"), first_occurrence(F.col("modality"), F.col("seq")).alias("modalities_in_study"))
    i = instances.groupBy("study_uid").agg(F.count("*").alias("instance_count"), F.sum("file_size").alias("total_bytes"))
    return s.join(i, "study_uid", "full_outer").select("study_uid", F.coalesce("series_count", F.lit(0)).alias("series_count"), F.coalesce("instance_count", F.lit(0)).alias("instance_count"), F.coalesce("modalities_in_study", F.lit("")).alias("modalities_in_study"), F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"))


def storage(instances: DataFrame) -> DataFrame:
    """Logical and physical objects and the share saved by sharing blobs. Two levels: per blob and study, then all."""
    each = instances.groupBy("blob_hash", "study_uid").agg(F.count("*").alias("n"), F.sum("file_size").alias("b"))
    logical, physical = F.sum("n"), F.count_distinct("blob_hash")
    return each.agg(logical.alias("logical"), physical.alias("physical"), F.when(logical > 0, 1 - physical / logical).otherwise(0.0).alias("dedup_ratio"), F.sum("b").alias("bytes"), F.count_distinct("study_uid").alias("studies"))


def tiers(instances: DataFrame) -> DataFrame:
    """Files, bytes and studies per tier, with a total line (tier 'all')."""
    return instances.rollup("tier").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"), F.count_distinct("study_uid").alias("studies"), F.grouping("tier").alias("g")).select(F.when(F.col("g") == 1, "all").otherwise(F.col("tier")).alias("tier"), "files", "bytes", "studies")


def chunks(frames: DataFrame) -> DataFrame:
    return frames.agg(F.count("*").alias("total"), F.count_distinct("blob_hash").alias("unique_chunks"))


def chunk_sketches(frames: DataFrame, day: Column, size: int = 14) -> DataFrame:
    """A row a day: frames and a sketch of their distinct chunks (HyperLogLog of 2^size registers: relative standard error about 1 / 2^(size / 2))."""
    return frames.groupBy(day.alias("day")).agg(F.count("*").alias("total"), F.hll_sketch_agg("blob_hash", size).alias("chunks"))


def chunks_estimated(sketches: DataFrame) -> DataFrame:
    """Frames and about how many distinct chunks over all days: their sketches are merged, no frame is read again."""
    return sketches.agg(F.sum("total").alias("total"), F.hll_sketch_estimate(F.hll_union_agg("chunks")).alias("unique_chunks"))


def quantile_sketches(rows: DataFrame, group: str, ts: str, value: str, size: int = 800) -> DataFrame:
    """A row a group and hour: a mergeable quantile sketch of a whole-number value (KLL; with size 800 ranks are off by less than half a per cent), with what merges by itself: count, sum, sum of squares, ends."""
    v = F.col(value).cast("long")
    return rows.where(v.isNotNull()).groupBy(group, F.date_trunc("hour", ts).alias("hour")).agg(
        F.kll_sketch_agg_bigint(v, F.lit(size)).alias("sketch"), F.count("*").alias("n"), F.sum(v).alias("total"), F.sum(v.cast("double") * v).alias("squares"), F.min(v).alias("low"), F.max(v).alias("high")
    )


def run_stats_merged(sketches: DataFrame, group: str, quantiles: list[float]) -> DataFrame:
    """Statistics of each group from its hours' sketches: n, mean, sd, low, high and the quantiles (q0, q1, ...); rows are not read again, and no buffer holds a group's values."""
    mean = F.sum("total") / F.sum("n")
    merged = F.kll_merge_agg_bigint("sketch")
    at = [F.kll_sketch_get_quantile_bigint(merged, F.lit(q)).alias(f"q{i}") for i, q in enumerate(quantiles)]
    sd = F.sqrt(F.greatest(F.sum("squares") / F.sum("n") - mean * mean, F.lit(0.0)))
    return sketches.groupBy(group).agg(F.sum("n").alias("n"), mean.alias("mean"), sd.alias("sd"), F.min("low").alias("low"), F.max("high").alias("high"), *at)


def unreferenced(blobs: DataFrame, references: DataFrame) -> DataFrame:
    """Objects, bytes and how many have no reference."""
    live = references.select("blob_hash").distinct().withColumn("_live", F.lit(1))
    return blobs.join(live, "blob_hash", "left").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"), F.count_if(F.col("_live").isNull()).alias("unreferenced"))


def route_status(access: DataFrame) -> DataFrame:
    return access.groupBy("route").pivot("class", ["2xx", "4xx", "5xx"]).count().na.fill(0) if "class" in access.columns else route_status(access.withColumn("class", status_class(F.col("status"))))


def route_latency(access: DataFrame) -> DataFrame:
    return access.groupBy("route").agg(F.sum("us").alias("us"), F.count("*").alias("requests"))


def quantile_recent(rows: DataFrame, value: str, order: list[Column], q: float, last: int = 1000) -> DataFrame:
    """Nearest rank round((n - 1) q) over the last samples."""
    s = F.array_sort(F.collect_list(value))
    at = F.floor((F.size(s) - 1) * F.lit(q) + 0.5).cast("int")
    return rows.orderBy(*order).limit(last).agg(F.get(s, at).alias("quantile"), F.count("*").alias("samples"))


def by_reason(rejected: DataFrame, restored: DataFrame, reasons: list[int]) -> DataFrame:
    """Rejected and restored instances for each known reason, zero included. Both have a row for each change with its reason; the reasons are a fixed handful."""
    known = rejected.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, reasons))).alias("reason"))
    both = rejected.select("reason", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(restored.select("reason", F.lit(0).alias("a"), F.lit(1).alias("b")))
    every = both.where(F.col("reason").isin(*reasons)).unionByName(known.select("reason", F.lit(0).alias("a"), F.lit(0).alias("b")))
    return every.groupBy("reason").agg(F.sum("a").alias("rejected"), F.sum("b").alias("restored"))


def assoc_summary(rows: DataFrame, key: str) -> DataFrame:
    """Per connection: studies, instances, and text like 'CTx4, SRx2' in first-seen order; a study's modality is that of its first instance."""
    per = rows.groupBy(key, "study_uid").agg(F.min_by("modality", "seq").alias("modality"), F.min("seq").alias("seq"), F.count("*").alias("n"))
    mod = per.groupBy(key, "modality").agg(F.sum("n").alias("n"), F.min("seq").alias("seq"), F.count("*").alias("studies"))
    parts = F.array_sort(F.collect_list(F.struct("seq", F.concat("modality", F.lit("x"), F.col("n").cast("string")).alias("t"))))
    return mod.groupBy(key).agg(F.sum("studies").alias("studies"), F.sum("n").alias("instances"), F.array_join(F.transform(parts, lambda x: x["t"]), ", ").alias("summary"))


def audit_copies(rows: DataFrame, key: str) -> DataFrame:
    """A row for each distinct hash of a key and kind (tracked or orphans), with the number of them; no key is gathered. rows: key, blob_hash, orphan."""
    each = rows.select(key, F.when(F.col("orphan"), "orphans").otherwise("tracked").alias("kind"), "blob_hash").distinct()
    return each.join(each.groupBy(key, "kind").agg(F.count("*").alias("hashes")), [key, "kind"])


def run_stats(rows: DataFrame, condition: str, value: str) -> DataFrame:
    v = F.col(value)
    return rows.groupBy(condition).agg(F.count(v).alias("n"), F.median(v).alias("median"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"))


def history(rows: DataFrame, ts: str, value: str, step: str, last: int) -> DataFrame:
    """The last points of a series at a step: start, sum, count."""
    points = rows.groupBy(F.window(ts, step).alias("w")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return points.select(F.col("w.start").alias("start"), "total", "n").orderBy(F.col("start").desc()).limit(last)


def commit_verdict(rows: DataFrame) -> DataFrame:
    """Per transaction: success if it is not empty and every instance is committed. rows: transaction_uid, sop_uid (null: none), found."""
    n, bad = F.count("sop_uid"), F.count_if(F.col("sop_uid").isNotNull() & ~F.col("found"))
    return rows.groupBy("transaction_uid").agg(n.alias("instances"), bad.alias("failed"), F.when((n > 0) & (bad == 0), "success").otherwise("failures").alias("verdict"))


#: Fixed value: the reason of an instance that was not confirmed (processing failure).
UNCONFIRMED = 0x0110


def commit_failures(rows: DataFrame) -> DataFrame:
    """The instances that a transaction's verdict names as failed, each once, with the reason. rows as for commit_verdict."""
    failed = rows.where(F.col("sop_uid").isNotNull() & ~F.col("found"))
    return failed.select("transaction_uid", "sop_uid").distinct().withColumn("reason", F.lit(UNCONFIRMED))


def measurements(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flat, per finding). rows: study_uid, groups array<struct<finding, items array<struct<concept, value, unit>>>>."""
    flat = rows.select("study_uid", F.explode_outer("groups").alias("g")).select("study_uid", F.col("g.finding").alias("finding"), F.explode_outer("g.items").alias("m")).select("study_uid", "finding", "m.*")
    return flat, flat.where("value is not null").groupBy("finding", "concept").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


