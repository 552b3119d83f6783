"""Searches: filters, a total order, paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import mask_name
from .aggregates import study_totals

#: How each study key matches. Names match by glob, or within one edit where the search asks for it.
STUDY_KEYS = {
    "patient_name": P.fuzzy, "patient_id": P.glob, "accession_number": P.glob, "study_description": P.glob, "institution_name": P.glob, "study_uid": P.in_list, "sex": P.glob, "study_id": P.glob,
    "study_time": P.time_range, "modalities_in_study": P.list_intersects, "other_patient_ids": P.list_intersects, "birth_date": P.date_range, "requested_procedure_description": P.glob,
    **dict.fromkeys(("referring_physician", "performing_physician", "reading_physicians", "requesting_physician", "responsible_person"), P.fuzzy),
}
#: Study keys that a series must meet.
STUDY_SERIES_KEYS = {"modality": P.in_list, "series_uid": P.in_list, "series_number": P.number_glob}
SERIES_KEYS = {"modality": P.in_list, "series_uid": P.in_list, "series_number": P.number_glob, "series_description": P.glob, "body_part": P.glob, "series_date": P.date_equals}
INSTANCE_KEYS = {"sop_uid": P.in_list, "sop_class": P.in_list, "instance_number": P.number_glob}
WORKITEM_KEYS = {"state": None, "readiness": None, "station": None, "patient_id": None, "accession_number": None, "priority": None, "study_uid": None, "workitem_uid": None, "step_label": None, "workitem_code": None, "procedure_id": None}
#: Baselines of includefield; these columns always come.
BASELINE = {
    "study": ("study_date", "study_time", "accession_number", "modalities_in_study", "referring_physician", "patient_name", "patient_id", "birth_date", "sex", "study_uid", "study_id", "series_count", "instance_count"),
    "series": ("modality", "series_uid", "series_number", "instance_count"),
    "instance": ("sop_class", "sop_uid", "study_uid", "series_uid", "instance_number"),
}
TAGS = {
    "00080016": "sop_class", "00080018": "sop_uid", "00080020": "study_date", "00080030": "study_time", "00080050": "accession_number", "00080060": "modality", "00080061": "modalities_in_study", "00080080": "institution_name",
    "00080090": "referring_physician", "00081030": "study_description", "0008103E": "series_description", "00100010": "patient_name", "00100020": "patient_id", "00100030": "birth_date", "00100040": "sex", "00180015": "body_part",
    "0020000D": "study_uid", "0020000E": "series_uid", "00200010": "study_id", "00200011": "series_number", "00200013": "instance_number", "00201206": "series_count", "00201208": "instance_count", "00201209": "instance_count", "00280008": "frames",
}
ALL = 1 << 62


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def matching(rows: DataFrame, rules: dict, **keys) -> DataFrame:
    """Rows that meet every key; an unknown key is an error."""
    if unknown := set(keys) - set(rules):
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    return rows.where(every([(rules[k] or (lambda c, v: c == v))(rows[k], v) for k, v in keys.items() if v is not None]))


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int | None = None, default: int = 0) -> DataFrame:
    """One page; limit None takes the default, of which 0 is none."""
    n = limit if limit is not None else default
    out = rows.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out.limit(n) if n or limit is not None else out


def remaining(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """total, returned and remaining (null if none) of a page: one row."""
    t = F.col("total")
    returned = F.least(F.greatest(t - offset, F.lit(0)), F.lit(limit))
    left = F.greatest(t - offset - returned, F.lit(0))
    return rows.agg(F.count("*").alias("total")).select("total", returned.cast("long").alias("returned"), F.nullif(left, F.lit(0)).cast("long").alias("remaining"))


def studies(rows: DataFrame, low: str = "", high: str = "", offset: int = 0, limit: int | None = None, series_rows: DataFrame | None = None, **keys) -> DataFrame:
    """Studies by date range and keys; by study date (none last), then uid. Keys of series need one series that meets them all."""
    of_series = {k: keys.pop(k) for k in STUDY_SERIES_KEYS if k in keys and series_rows is not None}
    found = matching(rows, STUDY_KEYS, **keys)
    if of_series:
        found = found.join(matching(series_rows, STUDY_SERIES_KEYS, **of_series).select("study_uid"), "study_uid", "left_semi").select(rows.columns)
    if low or high:
        found = found.where(P.study_date_range(found["study_date"], low, high))
    return page(found, [F.col("study_date").asc_nulls_last(), F.col("study_uid")], offset, limit)


def with_totals(studies: DataFrame, series: DataFrame, instances: DataFrame) -> DataFrame:
    """A page of studies with their derived columns, in the page's order: only the page's series and instances are aggregated."""
    page = studies.select("study_uid")
    totals = study_totals(series.join(page, "study_uid", "left_semi"), instances.join(page, "study_uid", "left_semi"))
    out = studies.join(totals, "study_uid", "left").na.fill({"series_count": 0, "instance_count": 0, "total_bytes": 0, "modalities_in_study": ""})
    return out.orderBy(F.col("study_date").asc_nulls_last(), "study_uid")


def by_number(column: str) -> list[Column]:
    """Numbers in their order, missing and other text last."""
    return [F.col(column).try_cast("bigint").asc_nulls_last()]


def series(rows: DataFrame, study_uid: str | None = None, offset: int = 0, limit: int | None = None, **keys) -> DataFrame:
    found = matching(rows, SERIES_KEYS, **keys)
    found = found.where(F.col("study_uid") == study_uid) if study_uid else found
    return page(found, [*by_number("series_number"), F.col("series_uid")] if study_uid else [F.col("series_uid")], offset, limit)


def instances(rows: DataFrame, series_uid: str, expose_quality: bool = False, **keys) -> DataFrame:
    """Visible instances of one series."""
    found = matching(rows, INSTANCE_KEYS, **keys)
    return found.where((F.col("series_uid") == series_uid) & P.visible(F.col("reason"), expose_quality)).orderBy(*by_number("instance_number"), "sop_uid")


def study_instances(series_rows: DataFrame, rows: DataFrame, study_uid: str, expose_quality: bool = False, **series_keys) -> DataFrame:
    """Visible instances of one study, whose series meet the keys."""
    chosen = matching(series_rows, SERIES_KEYS, **series_keys).where(F.col("study_uid") == study_uid).select("series_uid", "series_number")
    found = rows.where((F.col("study_uid") == study_uid) & P.visible(F.col("reason"), expose_quality)).join(chosen, "series_uid")
    return found.orderBy(*by_number("series_number"), "series_uid", *by_number("instance_number"), "sop_uid")


def instances_global(study_rows: DataFrame, series_rows: DataFrame, rows: DataFrame, study_keys: dict, series_keys: dict, expose_quality: bool = False, offset: int = 0, limit: int | None = None, **keys) -> DataFrame:
    """Instances whose study and series meet their keys; filters run below the joins."""
    a = matching(study_rows, STUDY_KEYS, **study_keys).select("study_uid")
    b = matching(series_rows, SERIES_KEYS, **series_keys).select("series_uid")
    c = matching(rows, INSTANCE_KEYS, **keys).where(P.visible(F.col("reason"), expose_quality))
    return page(c.join(a, "study_uid", "left_semi").join(b, "series_uid", "left_semi"), [F.col("sop_uid")], offset, limit)


def recent_patients(rows: DataFrame, born: str | None = None, name: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """Patients by last arrival, with rank on the page; name filters run after grouping. The name is that of the smallest study uid."""
    known = rows.where(F.col("patient_id") != "")
    out = known.groupBy("patient_id").agg(F.max("arrived_at").alias("arrived_at"), F.count("*").alias("studies"), F.min_by("birth_date", F.when(F.col("birth_date").isNotNull(), F.col("study_uid"))).alias("birth_date"), F.min_by("patient_name", "study_uid").alias("patient_name"))
    out = out.where(P.date_range(F.col("birth_date"), born)) if born else out
    out = out.where(P.fuzzy(F.col("patient_name"), name)) if name else out
    top = page(out, [F.col("arrived_at").desc(), F.col("patient_id")], offset, limit)
    # The page is bounded, so ranking it by one window is too.
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("arrived_at").desc(), "patient_id")) - 1)


def patient_fold(rows: DataFrame, order: list[Column]) -> DataFrame:
    """One row per patient, the first by order; rows without an id are patients of their own. One aggregation: the row of the least key."""
    key = F.coalesce(F.nullif(F.col("patient_id"), F.lit("")), F.concat(F.lit("study:"), F.col("study_uid")))
    first = F.struct(*order, *(F.col(c) for c in rows.columns if c != "patient_id"), F.col("patient_id"))
    return rows.groupBy(key.alias("patient_key")).agg(F.min(first).alias("r"), F.count("*").alias("studies")).select("patient_key", "studies", *(F.col(f"r.{c}").alias(c) for c in rows.columns))


def workitems(rows: DataFrame, name: str | None = None, modality: str | None = None, start: str | None = None, offset: int = 0, limit: int | None = None, **keys) -> DataFrame:
    found = matching(rows, WORKITEM_KEYS, **keys)
    found = found.where(F.trim("patient_name") == name.strip()) if name else found
    found = found.where(F.lower("modality") == modality.lower()) if modality else found
    found = found.where(P.datetime_range(F.col("start_dt"), start)) if start else found
    return page(found, [F.col("created_at").desc(), F.col("workitem_uid")], offset, limit)


def worklist(rows: DataFrame, patient_name: str | None = None, fuzzy: bool = False, limit: int | None = None, default: int = 100, ceiling: int = 1000, **keys) -> DataFrame:
    """Exact keys; limit 0 is none, else at most the ceiling."""
    found = matching(rows, {c: None for c in rows.columns}, **keys)
    if patient_name:
        found = found.where(P.fuzzy(F.col("patient_name"), patient_name) if fuzzy else F.col("patient_name") == patient_name)
    n = default if limit is None else limit
    out = found.orderBy("start_date", "start_time", "sps_uid")
    return out.limit(min(n, ceiling)) if n else out


def admin_instances(study_rows: DataFrame, rows: DataFrame, auditor: bool = False, patient_name: str = "", description: str = "", limit: int = 500) -> DataFrame:
    """Instances with their studies; an auditor sees masked names and no description."""
    s = study_rows.where(P.sql_like(F.col("patient_name"), patient_name) & P.sql_like(F.col("study_description"), description)).select("study_uid", "study_date", "patient_name", "study_description")
    out = rows.select("study_uid", "series_uid", "sop_uid").join(s, "study_uid")
    if auditor:
        out = out.withColumns({"patient_name": mask_name(F.col("patient_name")), "study_description": F.lit(None).cast("string")})
    return out.orderBy(F.col("study_date").desc_nulls_last(), "sop_uid").limit(min(limit, 500))


#: Rejection codes and their meaning.
REASONS = ((113001, "quality"), (113037, "patient-safety"), (113038, "incorrect-mwl"), (113039, "retention-expired"))


def meaning(reason: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, name in REASONS:
        out = F.when(reason == code, name).otherwise(out)
    return out


def hidden_instances(rows: DataFrame, study_uid: str | None = None, reason: int | None = None, series_uid: str | None = None, sop_uid: str | None = None) -> DataFrame:
    found = rows.where(F.coalesce("reason", F.lit(0)) != 0)
    for column, value in (("study_uid", study_uid), ("reason", reason), ("series_uid", series_uid), ("sop_uid", sop_uid)):
        found = found.where(F.col(column) == value) if value else found
    return found.withColumn("meaning", meaning(F.col("reason"))).orderBy("sop_uid")


def hidden_page(study_rows: DataFrame, rows: DataFrame, auditor: bool = False, offset: int = 0, limit: int = 500, **keys) -> DataFrame:
    """A page of at most 500 hidden instances by instance id, with their patients; an auditor sees masked names. keys: study_uid, series_uid, sop_uid, reason."""
    found = hidden_instances(rows, **keys).select("sop_uid", "study_uid", "series_uid", "modality", "reason", "meaning", "file_size")
    found = page(found, [F.col("sop_uid")], offset, min(limit, 500))
    s = study_rows.select("study_uid", F.coalesce("patient_id", F.lit("")).alias("patient_id"), F.coalesce("patient_name", F.lit("")).alias("patient_name"))
    out = found.join(s, "study_uid", "left").na.fill("", ["patient_id", "patient_name"])
    return (out.withColumn("patient_name", mask_name(F.col("patient_name"))) if auditor else out).orderBy("sop_uid")


def journal(rows: DataFrame, ordinal: str, when: Column, low=None, high=None, user: str | None = None, action: str | None = None, offset: int = 0, limit: int = 100, total: bool = False) -> DataFrame:
    """A page of a journal, newest line first; with total, each of its rows tells how many lines match in all."""
    found = rows.withColumn("at", when)
    for c in [F.col("at") >= F.lit(low).cast("timestamp") if low else None, F.col("at") <= F.lit(high).cast("timestamp") if high else None, F.col("user_name") == user if user else None, F.col("action") == action if action else None]:
        found = found.where(c) if c is not None else found
    lines = page(found, [F.col(ordinal).desc()], offset, min(limit, 10_000))
    return lines.crossJoin(found.agg(F.count("*").alias("total"))).orderBy(F.col(ordinal).desc()) if total else lines  # one row


def include_fields(level: str, available: list[str], asked: list[str]) -> list[str]:
    """Columns to select: the level's baseline and what is asked for, by tag or name; 'all' is everything, unknown names say nothing."""
    if "all" in asked:
        return available
    base = [c for c in BASELINE[level] if c in available]
    named = [TAGS.get(a.upper(), a) for a in asked]
    return base + [c for c in dict.fromkeys(named) if c in available and c not in base]
