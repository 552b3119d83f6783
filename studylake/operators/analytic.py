"""Ranking and window operators: ingest outcomes, first of its kind, ordinals, streaks, spacing, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ingest_outcome(arrivals: DataFrame, order: list[Column]) -> DataFrame:
    """Adds outcome: inserted, conflict, idempotent or updated, in arrival order.

    A known id conflicts if its owner study is another, or if the arriving patient is not the one of the arrival that created
    the study; what is not a conflict compares with the last accepted hash. Windows by id, study and id, no UDF; of hash and owner the shuffles carry a number within the id and a flag.
    """
    w = Window.partitionBy("sop_uid").orderBy(*order)
    hashes = F.when(F.col("blob_hash").isNotNull(), F.dense_rank().over(Window.partitionBy("sop_uid").orderBy("blob_hash")))
    a = arrivals.withColumns({"_rn": F.row_number().over(w), "_other": F.col("study_uid") != F.first("study_uid").over(w), "_hash": hashes})
    whole = Window.partitionBy("study_uid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own_whole = F.first(F.when(F.col("_rn") == 1, F.col("patient_id")), ignorenulls=True).over(whole)
    b = a.withColumn("_patient", own_whole)
    c = b.withColumn("_conf", (F.col("_rn") > 1) & (F.col("_other") | F.coalesce(F.col("patient_id") != F.col("_patient"), F.lit(False))))
    d = c.withColumn("_prev", F.lag("_hash").over(Window.partitionBy("sop_uid", "_conf").orderBy("_rn")))
    outcome = F.when(F.col("_rn") == 1, "inserted").when(F.col("_conf"), "conflict").when(F.col("_hash") == F.col("_prev"), "idempotent").otherwise("updated")
    return d.withColumn("outcome", outcome).drop("_rn", "_other", "_hash", "_patient", "_conf", "_prev")


def keep_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an explicit order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def line_ordinal(lines: DataFrame, file: str, line: Column) -> DataFrame:
    """Adds ordinal, the line's number over all files in file order: rank within the file, plus the rows of the files before. The window over files has one row a file."""
    counts = lines.groupBy(file).agg(F.count("*").alias("_n"))
    before = counts.select(F.col(file), F.coalesce(F.sum("_n").over(Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return lines.withColumn("_k", F.row_number().over(Window.partitionBy(file).orderBy(line))).join(before, file).withColumn("ordinal", F.col("_before") + F.col("_k")).drop("_k", "_before")


def representative(instances: DataFrame, key: str) -> DataFrame:
    """Per key the first instance that is no localizer, else the first, and its middle frame."""
    localizer = F.array_contains(F.split("image_type", ","), "LOCALIZER")
    best = F.min_by(F.struct("sop_uid", "frames"), F.struct(localizer, F.col("seq")))
    return instances.groupBy(key).agg(best.alias("b")).select(key, F.col("b.sop_uid").alias("sop_uid"), F.when(F.col("b.frames") > 1, F.floor(F.col("b.frames") / 2) + 1).otherwise(1).cast("long").alias("frame"))


def failure_streak(attempts: DataFrame, peer: str, order: list[Column], least: int) -> DataFrame:
    """Peers with so many failures since their last success. attempts: peer, ok. One aggregation: failures after the last success, no window."""
    last = attempts.where("ok").groupBy(peer).agg(F.max(F.struct(*order)).alias("_last"))
    return attempts.where("not ok").join(last, peer, "left").where(F.col("_last").isNull() | (F.struct(*order) > F.col("_last"))).groupBy(peer).agg(F.count("*").alias("failures")).where(F.col("failures") >= least)


def slice_spacing(slices: DataFrame, key: str, declared: str | None = None) -> DataFrame:
    """Per series the middle one (upper median) of the signed steps along the normal, in list order: its sign says whether the stack runs along the normal or against it.

    Slices without a position are passed over. With fewer than two positions the declared spacing counts, if positive. refused says why there is no spacing: 'positions coincide' (the
    middle step is zero; a declared value does not replace it) or 'unknown'.
    slices: key, number, position array<double>(3), orientation array<double>(6).
    """
    o = lambda i: F.get("orientation", F.lit(i))
    p = lambda i: F.get("position", F.lit(i))
    normal = [o(1) * o(5) - o(2) * o(4), o(2) * o(3) - o(0) * o(5), o(0) * o(4) - o(1) * o(3)]
    along = slices.withColumn("_d", p(0) * normal[0] + p(1) * normal[1] + p(2) * normal[2])
    before = Window.partitionBy(key).orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    steps = along.withColumn("_step", F.col("_d") - F.last("_d", ignorenulls=True).over(before))
    s = F.array_sort(F.collect_list("_step"))
    out = steps.groupBy(key).agg(F.get(s, F.floor(F.size(s) / 2).cast("int")).alias("_mid"), F.size(s).alias("_n"), (F.max(declared) if declared else F.lit(None).cast("double")).alias("_declared"))
    spacing = F.when(F.col("_n") > 0, F.nullif("_mid", F.lit(0.0))).when(F.col("_declared") > 0, F.col("_declared"))
    refused = F.when((F.col("_n") > 0) & (F.col("_mid") == 0), "positions coincide").when((F.col("_n") == 0) & ~F.coalesce(F.col("_declared") > 0, F.lit(False)), "unknown")
    return out.select(key, spacing.alias("spacing"), refused.alias("refused"))


#: Legal changes of a task's state.
LEGAL = (("SCHEDULED", "IN PROGRESS"), ("IN PROGRESS", "COMPLETED"), ("IN PROGRESS", "CANCELED"), ("COMPLETED", "COMPLETED"), ("CANCELED", "CANCELED"))


def transitions(history: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Adds previous and legal (null for the first) to each state."""
    prev = F.lag("state").over(Window.partitionBy(key).orderBy(*order))
    pair = F.concat_ws(">", "previous", "state")
    return history.withColumn("previous", prev).withColumn("legal", F.when(F.col("previous").isNotNull(), pair.isin(*(">".join(p) for p in LEGAL))))
