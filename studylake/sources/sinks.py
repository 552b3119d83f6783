"""Sinks: search JSON, partitioned index, journals, audit messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def search_json(rows: DataFrame, tags: dict[str, tuple[str, str]]) -> DataFrame:
    """json: a DICOM JSON object a row. tags: column -> (tag, vr); ascending tags, absent values omitted."""
    fields = []
    for column, (tag, vr) in sorted(tags.items(), key=lambda x: x[1][0]):
        v = F.struct(F.col(column).cast("string").alias("Alphabetic")) if vr == "PN" else F.col(column) if vr in ("US", "UL", "IS") else F.col(column).cast("string")
        fields.append(F.when(F.col(column).isNotNull(), F.struct(F.lit(vr).alias("vr"), F.array(v).alias("Value"))).alias(tag))
    return rows.select("*", F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("json"))


def write_index(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Rows by modality and day, append-only; each partition's rows are gathered, so files don't multiply."""
    rows.repartition("modality", "day").write.mode(mode).partitionBy("modality", "day").parquet(path)


def write_journal(rows: DataFrame, path: str) -> None:
    """JSON lines under a day partition."""
    rows.write.mode("append").partitionBy("day").json(path)


def journal_batches(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: JSON lines under batch and day. A batch that runs again replaces its own lines, so each line is there once. A batch's rows must have a column day."""

    def each(batch: DataFrame, number: int) -> None:
        _replace(batch.withColumn("batch", F.lit(number)), path, ["batch", "day"], "json")

    return each


def update_partitions(path: str, incoming: DataFrame, partitions: list[str], change: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Brings arrivals into a partitioned Parquet table and returns the plan: the partitions they touch, with the number of arrivals.

    change(stored rows of these partitions, arrivals) gives the partitions' new rows, for instance merge_ingest. Other partitions are neither read nor written and keep their files.
    A row's partition must follow from its key, so that its stored row lies in the partition of its arrival. The plan and the new rows are written apart before the table is touched;
    a run that was cut off is simply run again. Partitions without rows after the change keep their old ones.
    """
    spark = incoming.sparkSession
    plan = cut(incoming.groupBy(*partitions).agg(F.count("*").alias("arrivals")), "partition-plan")
    stored = spark.read.parquet(path)
    stored = stored.select(*(F.col(c).cast(incoming.schema[c].dataType).alias(c) if c in partitions else F.col(c) for c in stored.columns))
    new = cut(change(stored.join(plan.select(*partitions), partitions, "left_semi"), incoming), "partition-rows")
    _replace(new.hint("rebalance", *partitions), path, partitions, "parquet")
    return plan


def _replace(rows: DataFrame, path: str, partitions: list[str], kind: str) -> None:
    """Overwrites the partitions that rows has, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).format(kind).save(path)


#: Event codes and what they mean; identifiers and the codes of their kinds.
EVENTS = {
    "110101": "Audit Log Used", "110103": "DICOM Instances Accessed", "110104": "DICOM Instances Transferred", "110109": "Order Record",
    "110110": "Patient Record", "110111": "Procedure Record", "110112": "Query",
}
OBJECTS = (("study", "110180"), ("series", "110181"), ("sop", "110182"))
#: A query's criteria are cut to so many characters.
CRITERIA = 4096


def _xml(c: Column) -> Column:
    """Text without control characters, escaped; null if nothing is left."""
    c = F.regexp_replace(c.cast("string"), r"[\x00-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.nullif(c, F.lit(""))


def _attributes(**values: Column | str) -> Column:
    """Those attributes whose value is not null; _ in a name stands for a hyphen."""
    each = [F.concat(F.lit(f' {name.replace("_", "-")}="'), v if isinstance(v, Column) else F.lit(v), F.lit('"')) for name, v in values.items()]
    return F.concat_ws("", *each)


def _object(id_: Column, code: str, inner: str = "Name", **more: str) -> Column:
    """A participant object, null without an identifier."""
    head = F.concat(F.lit("<ParticipantObjectIdentification"), _attributes(ParticipantObjectID=id_, **more), F.lit(">"))
    kind = F.lit(f'<ParticipantObjectIDTypeCode csd-code="{code}" codeSystemName="DCM" />')
    return F.when(id_.isNotNull(), F.concat(head, kind, F.lit(f"<ParticipantObject{inner}>"), id_, F.lit(f"</ParticipantObject{inner}></ParticipantObjectIdentification>")))


def audit_message(rows: DataFrame, host: str = "-", application: str = "archive") -> DataFrame:
    """message: a syslog line with an audit XML of each journal row (ts, user, src, src_ip, action, atna, status, study, series, sop, patient, q; absent columns are null).

    Attributes and objects without a value are left out; a row without a user is told by its source. The outcome is 4 for a status of 400 to 499, 8 from 500 on, else 0.
    """
    raw = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    f = lambda c: _xml(raw(c))
    meaning = F.lit(None).cast("string")
    for code, text in EVENTS.items():
        meaning = F.when(raw("atna") == code, text).otherwise(meaning)
    status = raw("status").try_cast("int")
    outcome = F.when(status.between(400, 499), "4").when(status >= 500, "8").otherwise("0")
    action = F.when(raw("action").isin("R", "C", "U", "D"), raw("action"))
    event = F.when(f("atna").isNotNull(), F.concat(F.lit("<EventID"), _attributes(csd_code=f("atna"), codeSystemName="DCM", displayName=meaning), F.lit(" />")))
    address = F.when(f("src_ip").isNotNull(), "2")
    query = _xml(F.left(raw("q"), F.lit(CRITERIA)))
    xml = F.concat_ws(
        "", F.lit("<AuditMessage><EventIdentification"), _attributes(EventActionCode=action, EventOutcomeIndicator=outcome, EventDateTime=f("ts")), F.lit(">"), event, F.lit("</EventIdentification><ActiveParticipant"),
        _attributes(UserID=F.coalesce(f("user"), f("src")), UserIsRequestor="true", NetworkAccessPointID=f("src_ip"), NetworkAccessPointTypeCode=address), F.lit(" /><AuditSourceIdentification"),
        _attributes(AuditSourceID=f("src")), F.lit('><AuditSourceTypeCode csd-code="3" /></AuditSourceIdentification>'), *(_object(f(c), code, ParticipantObjectTypeCode="2") for c, code in OBJECTS),
        _object(f("patient"), "2", ParticipantObjectTypeCode="1", ParticipantObjectTypeCodeRole="1"), _object(query, "10", "Query", ParticipantObjectTypeCode="2", ParticipantObjectTypeCodeRole="24"), F.lit("</AuditMessage>"),
    )
    head = F.concat(F.lit("<109>1 "), F.coalesce(raw("ts"), F.lit("-")), F.lit(f" {host} {application} - "), F.coalesce(raw("atna"), F.lit("-")), F.lit(" - \ufeff"))
    return rows.select("*", F.concat(head, xml).alias("message"))
