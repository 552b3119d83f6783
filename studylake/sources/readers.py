"""Sources: study trees, DICOM JSON, journals, blobs, sidecar lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import vr_of

TREE = """study_uid string, patient_id string, patient_name string, birth_date long, sex string, study_date long, study_time string, accession_number string, study_id string, study_description string,
  institution_name string, referring_physician string, arrived_at string,
  series array<struct<series_uid: string, modality: string, series_number: string,
    instances: array<struct<sop_uid: string, sop_class: string, instance_number: string, blob_hash: string, file_size: long, reason: int,
      frames: array<struct<number: int, hash: string, offset: long, compressed_len: long>>>>>>"""
JOURNAL = "event string, ts string, user string, role string, src string, src_ip string, via string, action string, atna string, status long, count long, study string, series string, sop string, patient string, obj_type string, q string, changed_attrs long, bytes_replaced long, reason string, target string, patient_id string, bytes_to_free long, reason_code string, note_uid string, batch_id string"


def study_tree(spark: SparkSession, path: str, kind: str = "json") -> dict[str, DataFrame]:
    """studies, series, instances and frames of nested study records, and corrupt records; seq is the arrival position."""
    if kind == "parquet":
        rows = spark.read.parquet(path).withColumn("_corrupt_record", F.lit(None).cast("string"))
    else:
        rows = spark.read.schema(TREE + ", _corrupt_record string").json(path, mode="PERMISSIVE")
    good = rows.where("_corrupt_record is null and study_uid is not null")
    series = good.select("study_uid", F.posexplode_outer("series").alias("seq", "s")).where("s is not null")
    inst = series.select("study_uid", F.col("s.series_uid").alias("series_uid"), F.posexplode_outer("s.instances").alias("seq", "i")).where("i is not null")
    return {
        "studies": study_only(good), "series": series.select("study_uid", "seq", "s.series_uid", "s.modality", "s.series_number"),
        "instances": inst.select("study_uid", "series_uid", "seq", "i.sop_uid", "i.sop_class", "i.instance_number", "i.blob_hash", "i.file_size", "i.reason"),
        "frames": inst.select(F.col("i.sop_uid").alias("sop_uid"), F.explode("i.frames").alias("f")).select("sop_uid", "f.*"),
        "corrupt": rows.where("_corrupt_record is not null or study_uid is null"),
    }


def study_only(rows: DataFrame) -> DataFrame:
    """The study columns alone. Over Parquet the scan reads no nested column; JSON lines are parsed whole, but only these columns are built."""
    return rows.select(*(c for c in rows.columns if c not in ("series", "_corrupt_record")))


def dicom_json(rows: DataFrame, tags: dict[str, str], value: str = "value") -> DataFrame:
    """Columns from DICOM JSON text {tag: {vr, Value}}: names by first value, dates and integers (by the tag's representation) as numbers; person names give their alphabetic group."""
    m = rows.withColumn("_m", F.from_json(value, "map<string, struct<vr: string, Value: array<string>>>"))

    def of(tag: str):
        e = F.col("_m")[tag]
        first = F.get(e["Value"], F.lit(0))
        text = F.when(e["vr"] == "PN", F.get_json_object(first, "$.Alphabetic")).otherwise(first)
        return text.try_cast("bigint") if vr_of(tag) in ("DA", "IS") else text

    return m.select(*(c for c in rows.columns if c != value), *(of(t).alias(n) for n, t in tags.items()))


#: Kinds of attribute: where below the tag the value lies, and its type.
KINDS = {
    "text": (".Value[0]", "string"), "number": (".Value[0]", "bigint"), "name": (".Value[0].Alphabetic", "string"),
    "all": (".Value", "array<string>"), "items": (".Value", "array<variant>"), "binary": (".InlineBinary", "string"),
}


def attribute(dataset: Column, tag: str, kind: str = "text") -> Column:
    """An attribute of a dataset held as VARIANT, by kind; null where it is absent or of another shape."""
    below, type_ = KINDS[kind]
    found = F.try_variant_get(dataset, f'$["{tag}"]{below}', type_)
    return F.try_to_binary(found, F.lit("base64")) if kind == "binary" else found


def dicom_datasets(rows: DataFrame, attributes: dict[str, tuple[str, str]], value: str = "value") -> DataFrame:
    """Columns from DICOM JSON text by column -> (tag, kind), and the whole dataset as VARIANT (null where the text is no JSON)."""
    parsed = rows.withColumn("dataset", F.try_parse_json(value)).drop(value)
    return parsed.select("*", *(attribute(F.col("dataset"), tag, kind).alias(name) for name, (tag, kind) in attributes.items()))


def sequence(rows: DataFrame, tag: str, attributes: dict[str, tuple[str, str]], dataset: str = "dataset") -> DataFrame:
    """One row an item of a sequence, with its position and attributes. The item takes the dataset's place, so nested sequences are read by one more call; rows without items go."""
    kept = [c for c in rows.columns if c != dataset]
    items = rows.select(*kept, F.posexplode(attribute(F.col(dataset), tag, "items")).alias("position", "dataset"))
    return items.select("*", *(attribute(F.col("dataset"), t, kind).alias(name) for name, (t, kind) in attributes.items()))


#: The same kinds within a cast of a whole item: what is cast below the tag, and how the value is taken from it.
WITHIN = {
    "text": ("Value: array<string>", lambda e: F.get(e["Value"], F.lit(0))), "number": ("Value: array<bigint>", lambda e: F.get(e["Value"], F.lit(0))),
    "name": ("Value: array<struct<Alphabetic: string>>", lambda e: F.get(e["Value"], F.lit(0))["Alphabetic"]), "all": ("Value: array<string>", lambda e: e["Value"]),
    "items": ("Value: array<variant>", lambda e: e["Value"]), "binary": ("InlineBinary: string", lambda e: F.try_to_binary(e["InlineBinary"], F.lit("base64"))),
}


def sequences(rows: DataFrame, levels: list[tuple[str, str, dict[str, tuple[str, str]]]], dataset: str = "dataset") -> DataFrame:
    """One row an item of the last of nested sequences. levels: tag, name of the position, attributes of its items, from the outermost inwards.

    Gives what a call of sequence() for each level gives but for the dataset of the item: all levels are cast once, so no dataset is made of an item. An attribute's tag is named once a level.
    """
    type_ = ""
    for tag, _, attributes in reversed(levels):
        fields = [f"`{t}`: struct<{WITHIN[kind][0]}>" for t, kind in attributes.values()]
        type_ = f"array<struct<{', '.join(fields + ([f'`{inner}`: struct<Value: {type_}>'] if type_ else []))}>>"
        inner = tag
    kept = [c for c in rows.columns if c != dataset]
    found = F.try_variant_get(F.col(dataset), f'$["{inner}"].Value', type_)
    for n, (_, position, attributes) in enumerate(levels):
        items = rows.select(*kept, F.posexplode(found).alias(position, "_item"))
        rows = items.select("*", *(WITHIN[kind][1](F.col("_item")[t]).alias(name) for name, (t, kind) in attributes.items()))
        kept += [position, *attributes]
        found = F.col("_item")[levels[n + 1][0]]["Value"] if n + 1 < len(levels) else None
    return rows.select(*kept)


def journal(spark: SparkSession, path: str, event: str, stream: bool = False) -> DataFrame:
    """Lines of one event kind with day and file, from JSON-lines files named by day, or in folders of a day; torn lines are skipped."""
    schema = JOURNAL + ", _corrupt_record string"
    rows = (spark.readStream if stream else spark.read).schema(schema).option("mode", "PERMISSIVE").json(path)
    name = F.col("_metadata.file_path")
    return rows.select(*(c for c in rows.columns if c != "day"), name.alias("file"), F.to_date(F.regexp_extract(name, r"([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[^/]*|/[^/]*)$", 1)).alias("day")).where((F.col("event") == event) & F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def blobs(spark: SparkSession, path: str, suffix: str = ".dcm") -> DataFrame:
    """path, blob_hash (the file's name), length, content of the files below path with the suffix, temporary folders left out."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path)
    below = F.substring_index("path", path.rstrip("/").rpartition("/")[2] + "/", -1)
    return rows.where(~below.rlike(r"(^|/)\.?(tmp|temp)/")).select("path", F.regexp_extract("path", rf"([^/]+){re.escape(suffix)}$", 1).alias("blob_hash"), "length", "content")


def sidecar_lines(spark: SparkSession, path: str) -> DataFrame:
    """blob_hash and tier of 'hash tier' lines; malformed lines are dropped."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^([0-9a-f]+) ([1-3])\s*$", 1).alias("blob_hash"), F.regexp_extract("value", r"^([0-9a-f]+) ([1-3])\s*$", 2).try_cast("int").alias("tier")).where("blob_hash <> '' and tier is not null")
