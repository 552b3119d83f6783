"""Integrity of blobs and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from ..sources.readers import dicom_datasets, dicom_json
from .joins import index_gap
from .lifecycle import merge_ingest


def verify(blobs: DataFrame, expected: DataFrame) -> DataFrame:
    """Each expected hash with ok, mismatch, unreadable (no content) or gone. blobs: blob_hash (the name), content (binary)."""
    found = blobs.select("blob_hash", F.when(F.col("content").isNull(), "unreadable").when(F.sha2("content", 256) == F.col("blob_hash"), "ok").otherwise("mismatch").alias("_v"))
    return expected.select("blob_hash").distinct().join(found, "blob_hash", "left").select("blob_hash", F.coalesce("_v", F.lit("gone")).alias("verdict"))


def bad_hashes(verdicts: DataFrame, most: int = 1024) -> DataFrame:
    return verdicts.where("verdict <> 'ok'").orderBy("blob_hash").limit(most)


def rebuild(datasets: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instances, conflicts): the instance table from DICOM JSON datasets (text in column value). An id belongs to its stored study, else to the smallest study that claims it; claims of others are conflicts. The identifiers are written once, so each text is parsed once."""
    rows = cut(dicom_json(datasets, {"sop_uid": "00080018", "series_uid": "0020000E", "study_uid": "0020000D"}), "identifiers").where("sop_uid is not null")
    held = stored.select("sop_uid", F.col("study_uid").alias("_study"))
    owner = rows.groupBy("sop_uid").agg(F.min("study_uid").alias("_least")).join(held, "sop_uid", "left").select("sop_uid", F.coalesce("_study", "_least").alias("_owner"))
    claims = rows.join(owner, "sop_uid")
    conflicts, good = (claims.where(c).drop("_owner") for c in ("study_uid <> _owner", "not coalesce(study_uid <> _owner, false)"))
    return merge_ingest(stored, good.select(stored.columns), "sop_uid", [F.col("study_uid"), F.col("series_uid")]), conflicts


#: Keys of the levels, and the identifiers of DICOM datasets.
LEVELS = {"studies": ["study_uid"], "series": ["study_uid", "series_uid"], "instances": ["sop_uid"]}
UIDS = {"study_uid": ("0020000D", "text"), "series_uid": ("0020000E", "text"), "sop_uid": ("00080018", "text")}


def rebuild_levels(datasets: DataFrame, stored: dict[str, DataFrame], attributes: dict[str, dict[str, tuple[str, str]]]) -> dict[str, DataFrame]:
    """studies, series and instances from the datasets of all blobs; also conflicts (sop_uid, study_uid, owner, blob_hash) and errors (blob_hash).

    datasets: value (DICOM JSON), blob_hash. stored: a table for each level with its key, for instances study_uid and series_uid too, and the columns named in attributes
    (level -> column -> (tag, kind)). Stored values win; a gap takes the value of the dataset with the smallest hash that has one, and studies, series and instances that are not
    stored are added. An instance belongs to its stored study, else to the smallest study that claims it; other claims are conflicts and add nothing. Datasets that are no JSON or
    lack one of the three identifiers are errors. Repeated datasets count once. The attributes are written once: a filter or join above the parser would move below it and parse each text
    again for every condition, table and level. Claims are dealt by instance once, for owners and instances; rows of a series or study lie scattered then, so nothing is gained by aggregating
    them before they are dealt by those keys, which would sort them all.
    """
    wanted = {level: [*(c for c in ("study_uid", "series_uid") if level == "instances"), *attributes[level]] for level in LEVELS}
    columns = UIDS | {name: at for level in attributes.values() for name, at in level.items()}
    rows = cut(dicom_datasets(datasets.select("value", "blob_hash"), columns).drop("dataset"), "datasets")
    whole = F.col("study_uid").isNotNull() & F.col("series_uid").isNotNull() & F.col("sop_uid").isNotNull()
    good = rows.where(whole)
    held = stored["instances"].select("sop_uid", F.col("study_uid").alias("_study"))
    least = F.min("study_uid").over(Window.partitionBy("sop_uid"))
    claims = good.join(held, "sop_uid", "left").withColumn("owner", F.coalesce("_study", least)).drop("_study")
    own = claims.where("study_uid = owner")
    out = {
        "conflicts": claims.where("study_uid <> owner").select("sop_uid", "study_uid", "owner", "blob_hash").distinct(),
        "errors": rows.where(~whole).select("blob_hash").distinct(),
    }
    for level, key in LEVELS.items():
        first = {c: F.min(F.when(F.col(c).isNotNull(), F.struct("blob_hash", F.col(c).alias("v"))))["v"] for c in wanted[level]}
        dealt = own if level == "instances" else own.repartition(*key)
        found = dealt.groupBy(*key).agg(*(e.alias(f"_{c}") for c, e in first.items()))
        both = stored[level].select(*key, *wanted[level]).join(found, key, "full_outer")
        out[level] = both.select(*key, *(F.coalesce(c, f"_{c}").alias(c) for c in wanted[level]))
    return out


def reconcile(records: DataFrame, index: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new index, report): what the index lacks is added; report has scanned and added."""
    gap = index_gap(records, index, keys)
    report = records.select(*keys).distinct().agg(F.count("*").alias("scanned")).crossJoin(gap.agg(F.count("*").alias("added")))  # one row each
    return index.select(*keys).unionByName(gap), report


def corrupt_report(rows: DataFrame, corrupt: str = "_corrupt_record", strict: bool = False) -> DataFrame:
    """scanned and corrupt; strict jobs stop at the first corrupt record."""
    bad = F.col(corrupt).isNotNull()
    if strict:
        return rows.select(F.when(bad, F.raise_error("corrupt record")).otherwise(F.lit(1)).cast("int").alias("ok")).agg(F.count("ok").alias("scanned"), F.lit(0).cast("long").alias("corrupt"))
    return rows.agg(F.count("*").alias("scanned"), F.count_if(bad).alias("corrupt"))


def uid_ok(uid: Column) -> Column:
    """Digits and dots, no empty part, no leading zero, 64 characters at most."""
    return F.coalesce(uid.rlike(r"^(0|[1-9][0-9]*)(\.(0|[1-9][0-9]*))*$") & (F.length(uid) <= 64) & ~uid.contains("\n"), F.lit(False))
