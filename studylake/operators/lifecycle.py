"""Changes as plans and as new table versions: nothing here writes in place; a job returns its plan or the new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import study_totals
from .analytic import LEGAL, keep_first
from .joins import cascade

#: Rejections that may replace another one, and that refuse a new version.
STRICT = (113037, 113038)
QUALITY = 113001


def merge_ingest(stored: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Stored rows win; of new ones the first arrival stays: what is stored goes before the rest is sorted."""
    fresh = keep_first(incoming.join(stored.select(key), key, "left_anti"), [key], order)
    return stored.unionByName(fresh.select(stored.columns))


def replace_ingest(stored: DataFrame, incoming: DataFrame, key: str, order: list[Column], fill: list[str] = ()) -> DataFrame:
    """The last arrival replaces a stored row; columns in fill keep what was stored and only fill gaps."""
    latest = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*(o.desc() for o in order)))).where("_n = 1").select(stored.columns)
    a, b = stored.alias("a"), latest.alias("b")
    new = F.col(f"b.{key}").isNotNull()
    pick = [F.coalesce(f"a.{key}", f"b.{key}").alias(key)]
    pick += [F.coalesce(f"a.{c}", f"b.{c}").alias(c) if c in fill else F.when(new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in stored.columns if c != key]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*pick)


def reject(instances: DataFrame, notes: DataFrame, ai_classes: list[str], enabled: list[int]) -> DataFrame:
    """Instances with their reason after rejection notes (sop_uid, code), and changed: whether any note changed it.

    Each note is judged alone: quality holds for AI result classes only, other codes only where enabled. What is left of an instance's notes is applied by ascending code: a visible
    instance is hidden by the first; a hidden one takes a strict code in place of its own, and no other.
    """
    codes = F.array_sort(F.collect_set("code"))  # as many as there are codes, at most
    asked = notes.where("code is not null").groupBy("sop_uid").agg(codes.alias("_codes"))
    quality = F.col("sop_class").isin(*ai_classes)
    left = F.filter(F.coalesce("_codes", F.array().cast("array<int>")), lambda c: F.when(c == QUALITY, F.coalesce(quality, F.lit(False))).otherwise(c.isin(*enabled)))

    def apply(state, code):
        takes = ((state["reason"] == 0) | code.isin(*STRICT)) & (state["reason"] != code)
        return F.struct(F.when(takes, code).otherwise(state["reason"]).cast("long").alias("reason"), (state["changed"] | takes).alias("changed"))

    start = F.struct(F.coalesce("reason", F.lit(0)).cast("long").alias("reason"), F.lit(False).alias("changed"))
    out = instances.join(asked, "sop_uid", "left").withColumn("_end", F.aggregate(left, start, apply))
    kind = instances.schema["reason"].dataType
    return out.withColumns({"changed": F.col("_end.changed"), "reason": F.when(F.col("_end.changed"), F.col("_end.reason").cast(kind)).otherwise(F.col("reason"))}).drop("_codes", "_end")


def restore(instances: DataFrame, named: DataFrame) -> DataFrame:
    """Clears the reason of named instances; changed says where."""
    hit = instances.join(named.select("sop_uid").distinct().withColumn("_hit", F.lit(True)), "sop_uid", "left")
    return hit.withColumn("changed", F.coalesce("_hit", F.lit(False)) & (F.coalesce("reason", F.lit(0)) != 0)).withColumn("reason", F.when(F.col("changed"), F.lit(0)).otherwise(F.col("reason"))).drop("_hit")


def refuse_hidden(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows whose stored version was rejected for safety or a wrong worklist entry."""
    return incoming.join(stored.where(F.col("reason").isin(*STRICT)).select("sop_uid"), "sop_uid", "left_semi")


LEVELS = {"study": "study_uid", "series": "series_uid", "instance": "sop_uid"}


def delete(instances: DataFrame, named: DataFrame, level: str = "study", classes: list[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(preview, what stays, tombstones) of deleting studies, series or instances (named: their ids): instances, bytes and blobs shared with others; studies without an instance left.

    Derived objects of the classes (instances.refs: what they refer to) go with the series or instances they refer to. Rows are marked, not joined with themselves; the preview is one grouping by blob.
    """
    key = LEVELS[level]
    named = named.select(key).distinct()
    marked = instances.join(named.withColumn("_gone", F.lit(True)), key, "left")
    if classes:
        lost = instances.select("sop_uid", "series_uid", key).join(named, key, "left_semi")
        uids = lost.select(F.explode(F.array("sop_uid", "series_uid")).alias("uid")) if level != "instance" else lost.select(F.col("sop_uid").alias("uid"))
        marked = marked.join(cascade(instances, list(classes), uids).withColumn("_derived", F.lit(True)), "sop_uid", "left").withColumn("_gone", F.coalesce("_gone", "_derived")).drop("_derived")
    marked = marked.withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    deleted, stays = (marked.where(c).select(instances.columns) for c in (F.col("_gone"), ~F.col("_gone")))
    each = marked.groupBy("blob_hash").agg(F.count_if("_gone").alias("n"), F.sum(F.when(F.col("_gone"), F.col("file_size"))).alias("b"), F.bool_or(~F.col("_gone")).alias("held"))
    preview = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("instances"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"), F.count_if((F.col("n") > 0) & F.col("held") & F.col("blob_hash").isNotNull()).alias("shared_blobs"))
    touched = deleted.select("study_uid").unionByName(named) if level == "study" else deleted.select("study_uid")
    return preview, stays, touched.distinct().join(stays.select("study_uid"), "study_uid", "left_anti")


def _totalled(studies: DataFrame, series: DataFrame, instances: DataFrame) -> dict[str, DataFrame]:
    totals = ["series_count", "instance_count", "modalities_in_study", "total_bytes"]
    out = studies.drop(*totals).join(study_totals(series, instances), "study_uid", "left")
    return {"studies": out.na.fill({"series_count": 0, "instance_count": 0, "total_bytes": 0, "modalities_in_study": ""}), "series": series, "instances": instances}


def merge_archive(stored: dict[str, DataFrame], incoming: dict[str, DataFrame], order: dict[str, list[Column]]) -> dict[str, DataFrame]:
    """studies, series and instances after an ingest: what is stored wins at every level, arrived_at of a study that got something is that of its last arrival, totals are new."""
    new = {level: merge_ingest(stored[level], incoming[level], LEVELS[key], order[level]) for level, key in (("studies", "study"), ("series", "series"), ("instances", "instance"))}
    last = incoming["studies"].groupBy("study_uid").agg(F.max("arrived_at").alias("_last"))
    studies = new["studies"].join(last, "study_uid", "left").withColumn("arrived_at", F.greatest("arrived_at", "_last")).drop("_last")
    return _totalled(studies, new["series"], new["instances"])


def replace_archive(stored: dict[str, DataFrame], incoming: dict[str, DataFrame], order: dict[str, list[Column]]) -> dict[str, DataFrame]:
    """The same where the incoming version replaces: study attributes and instances are those of the last arrival, series attributes only fill gaps."""
    fill = [c for c in stored["series"].columns if c != "series_uid"]
    new = {level: replace_ingest(stored[level], incoming[level], LEVELS[key], order[level], fill if level == "series" else []) for level, key in (("studies", "study"), ("series", "series"), ("instances", "instance"))}
    return _totalled(new["studies"], new["series"], new["instances"])


def tier_plan(instances: DataFrame, studies: DataFrame, tiers: list[str], cutoff: int, excluded: DataFrame, limit: int) -> DataFrame:
    """Blobs of the tiers from studies dated before the cutoff, each once, oldest first; undated studies never; excluded hashes go before the limit."""
    old = studies.where(F.col("study_date") < cutoff).select("study_uid", "study_date")
    found = instances.where(F.col("tier").isin(*tiers)).join(old, "study_uid").groupBy("blob_hash").agg(F.min("study_date").alias("study_date"))
    return found.join(excluded.select("blob_hash"), "blob_hash", "left_anti").orderBy("study_date", "blob_hash").limit(limit)


def tier_patients(instances: DataFrame, studies: DataFrame, cutoff: int, tier: str = "hot") -> DataFrame:
    """Patients all of whose studies are older than the cutoff (an undated one blocks), with the number of their distinct blobs in the tier."""
    ready = studies.where(F.col("patient_id") != "").groupBy("patient_id").agg(F.bool_and(F.coalesce(F.col("study_date") < cutoff, F.lit(False))).alias("old"), F.min("study_date").alias("earliest")).where("old").select("patient_id", "earliest")
    owned = studies.select("study_uid", "patient_id").join(ready, "patient_id")
    blobs = instances.where(F.col("tier") == tier).select("study_uid", "blob_hash").join(owned, "study_uid").select("patient_id", "earliest", "blob_hash").distinct()
    return blobs.groupBy("patient_id", "earliest").agg(F.count("*").alias("blobs")).orderBy("earliest", "patient_id")


def tier_emergency(blobs: DataFrame, need: int) -> DataFrame:
    """Oldest blobs until so many bytes are free: rows whose preceding sum is below the need. blobs: blob_hash, study_date, size. Sums run within a day and over days."""
    days = blobs.groupBy("study_date").agg(F.sum("size").alias("_all"))
    before = days.select("study_date", F.coalesce(F.sum("_all").over(Window.orderBy("study_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")).where(F.col("_before") < need)
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("study_date").orderBy("blob_hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blobs.join(before, "study_date").withColumn("preceding", F.col("_before") + inside).where(F.col("preceding") < need).drop("_before")


def tier_flip(instances: DataFrame, batch: DataFrame, tier: str) -> DataFrame:
    """Every reference to the batch's hashes moves to the tier; changed says which did."""
    hit = instances.join(batch.select("blob_hash").distinct().withColumn("_hit", F.lit(True)), "blob_hash", "left")
    return hit.withColumn("changed", F.coalesce("_hit", F.lit(False)) & (F.col("tier") != tier)).withColumn("tier", F.when(F.col("changed"), F.lit(tier)).otherwise(F.col("tier"))).drop("_hit")


def _off(days: int) -> Column | None:
    return F.lit(False) if days <= 0 else None


def expire_workitems(rows: DataFrame, now: str, days: int, locked_at: str | None = None, ttl_hours: int = 24) -> DataFrame:
    """Finished tasks older than the retention; none while a lock is younger than its time; 0 days keep all."""
    live = locked_at and F.expr(f"timestamp'{locked_at}' > timestamp'{now}' - interval {ttl_hours} hours")
    gone = F.col("state").isin("COMPLETED", "CANCELED") & (F.col("updated_at") < F.expr(f"timestamp'{now}' - interval {days} days"))
    return rows.where(_off(days) if days <= 0 else gone & ~live if locked_at else gone)


def scheduled_start(date: Column, time: Column) -> Column:
    """Epoch seconds of a scheduled start: date of eight digits, time of six, four, two or no digits (a fraction is dropped, no time is midnight); null where either can't be read."""
    d, t = F.trim(date.cast("string")), F.split_part(F.trim(F.coalesce(time, F.lit(""))), F.lit("."), F.lit(1))
    part = lambda c, at, n: F.try_to_number(F.substring(c, at, n), F.lit("9" * n)).cast("int")
    month, day = part(d, 5, 2), part(d, 7, 2)
    readable = d.rlike("^[0-9]{8}$") & month.between(1, 12) & day.between(1, 31) & t.rlike("^([0-9]{2}){0,3}$")
    hour, minute, second = (F.coalesce(part(t, at, 2), F.lit(0)) for at in (1, 3, 5))
    readable &= (hour < 24) & (minute < 60) & (second <= 60)
    first = F.unix_date(F.make_date(part(d, 1, 4), month, F.lit(1)))
    return F.when(readable, (first + day - 1).cast("long") * 86_400 + hour * 3600 + minute * 60 + second)


def expire_worklist(rows: DataFrame, now: str, days: int) -> DataFrame:
    """Age counts from the later of the last change and the scheduled start; a row whose start can't be read ages by its stamp alone, only one whose stamp can't be read stays."""
    stamp = F.unix_seconds(F.try_to_timestamp(F.coalesce("updated_at", "created_at").cast("string")))
    start = F.coalesce(scheduled_start(F.col("start_date"), F.col("start_time")), stamp)
    gone = stamp.isNotNull() & (F.greatest(stamp, start) < F.unix_seconds(F.expr(f"timestamp'{now}' - interval {max(days, 0)} days")))
    return rows.where(_off(days) if days <= 0 else gone)


def expire_steps(rows: DataFrame, now: str, days: int) -> DataFrame:
    gone = F.col("status").isin("COMPLETED", "DISCONTINUED") & (F.col("updated_at") < F.expr(f"timestamp'{now}' - interval {max(days, 0)} days"))
    return rows.where(_off(days) if days <= 0 else gone)


def expire_commitments(rows: DataFrame, now: str, days: int) -> DataFrame:
    """Requested before the cutoff; unreadable stamps stay."""
    gone = F.try_to_timestamp(F.col("requested_at")) < F.expr(f"timestamp'{now}' - interval {max(days, 0)} days")
    return rows.where(_off(days) if days <= 0 else gone)


def prune_journal(days_present: DataFrame, day: str, today: str, keep: int) -> DataFrame:
    """Day partitions past the retention, never today or later; a plan, nothing is deleted."""
    return days_present.where(F.lit(False) if keep <= 0 else F.datediff(F.lit(today).cast("date"), F.col(day)) > keep).select(day).distinct()


def workitem_update(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes with accepted and why not. changes: workitem_uid, arrival, expected_revision, transaction_uid, state. One change a task and batch, the first; the revision and the transaction must fit, and the step must be legal."""
    first = F.row_number().over(Window.partitionBy("workitem_uid").orderBy("arrival"))
    now = current.select("workitem_uid", F.col("revision").alias("_rev"), F.col("transaction_uid").alias("_tx"), F.col("state").alias("_state"))
    j = changes.withColumn("_nth", first).join(now, "workitem_uid", "left")
    legal = F.concat_ws(">", "_state", "state").isin(*(">".join(p) for p in LEGAL))
    why = (
        F.when(F.col("_state").isNull(), "unknown").when(F.col("_nth") > 1, "later in batch").when(F.col("expected_revision") != F.col("_rev"), "revision")
        .when(F.col("_tx").isNotNull() & ~F.col("transaction_uid").eqNullSafe(F.col("_tx")), "transaction").when(~legal, "transition")
    )
    return j.withColumn("refused", why).withColumn("revision", F.when(F.col("refused").isNull(), F.col("_rev") + 1)).drop("_nth", "_rev", "_tx", "_state")


def step_update(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Performed steps after changes (mpps_uid, status, series_count, description): given fields overwrite, a final state is frozen, and final needs series."""
    c = changes.select("mpps_uid", *(F.col(k).alias(f"_{k}") for k in ("status", "series_count", "description")), F.lit(True).alias("_asked"))
    j = current.join(c, "mpps_uid", "left")
    final = lambda s: s.isin("COMPLETED", "DISCONTINUED")
    series = F.coalesce("_series_count", "series_count")
    why = F.when(F.col("_asked") & final(F.col("status")), "final").when(F.col("_asked") & F.coalesce(final(F.col("_status")), F.lit(False)) & (F.coalesce(series, F.lit(0)) == 0), "no series")
    ok = F.col("_asked") & why.isNull()
    new = {k: F.when(ok, F.coalesce(f"_{k}", k)).otherwise(F.col(k)) for k in ("status", "series_count", "description")}
    return j.withColumn("refused", why).withColumns(new).drop("_status", "_series_count", "_description", "_asked")


def readiness_regress(workitems: DataFrame, grown: DataFrame) -> DataFrame:
    """READY tasks, still SCHEDULED, of studies with new instances become INCOMPLETE; changed says which."""
    hit = workitems.join(grown.select("study_uid").distinct().withColumn("_hit", F.lit(True)), "study_uid", "left")
    return hit.withColumn("changed", F.coalesce("_hit", F.lit(False)) & (F.col("readiness") == "READY") & (F.col("state") == "SCHEDULED")).withColumn("readiness", F.when(F.col("changed"), "INCOMPLETE").otherwise(F.col("readiness"))).drop("_hit")


