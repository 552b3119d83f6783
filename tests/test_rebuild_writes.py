from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from studylake.operators import integrity as I
from studylake.operators import lifecycle as L
from studylake.operators import search as S
from studylake.operators import usercode as U
from studylake.sources import readers, sinks


def element(vr, *values):
    return {"vr": vr, "Value": list(values)}


def dataset(study, series, sop, **more):
    return json.dumps({"0020000D": element("UI", study), "0020000E": element("UI", series), "00080018": element("UI", sop)} | more)


def test_datasets_of_every_shape(spark):
    inner = {"00081155": element("UI", "1.9")}
    whole = {
        "00080008": element("CS", "ORIGINAL", None, "AXIAL"), "00100010": element("PN", {"Alphabetic": "Doe^J"}), "00280010": element("US", 512), "00281050": element("DS", "abc"),
        "00282000": {"vr": "OB", "InlineBinary": "AAEC"}, "00081115": element("SQ", {"0020000E": element("UI", "1.5"), "00081199": element("SQ", inner, {})}, {}), "00080060": {"vr": "CS"},
    }
    rows = spark.createDataFrame([(1, json.dumps(whole)), (2, "{bad"), (3, None), (4, "[1]")], "n int, value string")
    kinds = {"types": ("00080008", "all"), "name": ("00100010", "name"), "height": ("00280010", "number"), "wrong": ("00281050", "number"), "raw": ("00282000", "binary"), "empty": ("00080060", "text")}
    d = readers.dicom_datasets(rows, kinds)
    got = {r.n: r for r in d.drop("dataset").collect()}
    assert tuple(got[1]) == (1, ["ORIGINAL", None, "AXIAL"], "Doe^J", 512, None, bytes([0, 1, 2]), None)
    assert all(tuple(got[n])[1:] == (None,) * 6 for n in (2, 3, 4))
    items = readers.sequence(d.select("n", "dataset"), "00081115", {"series_uid": ("0020000E", "text")})
    assert sorted((r.n, r.position, r.series_uid or "") for r in items.collect()) == [(1, 0, "1.5"), (1, 1, "")]
    nested = readers.sequence(items.drop("position"), "00081199", {"sop_uid": ("00081155", "text")})
    assert sorted((r.series_uid, r.position, r.sop_uid or "") for r in nested.collect()) == [("1.5", 0, "1.9"), ("1.5", 1, "")]


def test_rebuild_fills_gaps_and_keeps_what_is_stored(spark):
    name = lambda n: {"00100010": element("PN", {"Alphabetic": n})}
    rows = [
        (dataset("s1", "r1", "a", **name("late")), "h9"), (dataset("s1", "r1", "b", **name("early")), "h1"), (dataset("s1", "r1", "b"), "h0"), (dataset("s1", "r1", "b"), "h0"),
        (dataset("s2", "r2", "a", **name("thief")), "h2"), (dataset("s3", "r3", "c", **name("other")), "h3"), ("{bad", "h4"), (json.dumps({"0020000D": element("UI", "s1")}), "h5"), (None, "h6"),
    ]
    stored = {
        "studies": spark.createDataFrame([("s3", "kept"), ("s4", None)], "study_uid string, patient_name string"),
        "series": spark.createDataFrame([], "study_uid string, series_uid string, modality string"),
        "instances": spark.createDataFrame([("a", "s1", None)], "sop_uid string, study_uid string, series_uid string"),
    }
    attributes = {"studies": {"patient_name": ("00100010", "name")}, "series": {"modality": ("00080060", "text")}, "instances": {}}
    out = I.rebuild_levels(spark.createDataFrame(rows, "value string, blob_hash string"), stored, attributes)
    table = lambda t: sorted(tuple(x or "" for x in r) for r in out[t].collect())
    assert table("studies") == [("s1", "early"), ("s3", "kept"), ("s4", "")]
    assert table("series") == [("s1", "r1", ""), ("s3", "r3", "")]
    assert table("instances") == [("a", "s1", "r1"), ("b", "s1", "r1"), ("c", "s3", "r3")]
    assert table("conflicts") == [("a", "s2", "s1", "h2")] and table("errors") == [("h4",), ("h5",), ("h6",)]
    nothing = I.rebuild_levels(spark.createDataFrame([], "value string, blob_hash string"), stored, attributes)
    assert {k: v.count() for k, v in nothing.items()} == {"studies": 2, "series": 0, "instances": 1, "conflicts": 0, "errors": 0}


def test_failing_empty_and_good_tasks(spark):
    studies = spark.createDataFrame([("bad",), ("none",), ("good",), ("frameless",), ("column",)], "study_uid string").withColumns({"modality": F.lit("CT"), "body_part": F.lit("HEAD"), "study_description": F.lit("x")})
    rules = spark.createDataFrame([(1, "a", "ct", None, None)], "position int, name string, r_modality string, r_body_part string, r_study_description string")
    frames = spark.createDataFrame([("bad", 1), ("none", 1), ("good", 1), ("good", 2), ("column", 1)], "study_uid string, v int")

    def model(pdf, p):
        kind = pdf["study_uid"].iloc[0]
        if kind == "bad":
            raise RuntimeError("no memory")
        if kind == "column":
            return pdf[["study_uid", "rule"]]
        return pdf[["study_uid", "rule", "v"]].head(0 if kind == "none" else 9)

    got = sorted(tuple("" if x is None else x for x in r) for r in U.chain_outcomes(studies, rules, frames, model, "study_uid string, rule string, v long").collect())
    assert [g[:4] for g in got if g[0] != "column"] == [("bad", "a", "", "failed"), ("frameless", "a", "", "empty"), ("good", "a", 1, "complete"), ("good", "a", 2, "complete"), ("none", "a", "", "empty")]
    assert got[0][4] == "RuntimeError: no memory" and [g[3] for g in got if g[0] == "column"] == ["failed"]


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 3, "x")], "key string, part int, v string").write.partitionBy("part").parquet(path)
    files = lambda: {(d, f) for d in os.listdir(path) if d.startswith("part=") for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")}
    before = files()
    new = spark.createDataFrame([("b", 2, "y"), ("d", 2, "y"), ("e", 4, "y"), ("e", 4, "y")], "key string, part int, v string")
    change = lambda old, arrived: L.merge_ingest(old, arrived, "key", [F.col("v")])
    want = [("a", 1, "x"), ("b", 2, "x"), ("c", 3, "x"), ("d", 2, "y"), ("e", 4, "y")]
    for _ in range(2):  # a run again changes no row
        plan = sinks.update_partitions(path, new, ["part"], change)
        assert sorted(tuple(r) for r in plan.collect()) == [(2, 2), (4, 2)]
        assert sorted((r.key, r.part, r.v) for r in spark.read.parquet(path).collect()) == want
        assert {d for d, _ in before & files()} == {"part=1", "part=3"}


def test_a_batch_that_runs_twice_is_there_once(spark, tmp_path):
    each = sinks.journal_batches(str(tmp_path / "j"))
    lines = spark.createDataFrame([("access", "1", "2024-01-01"), ("access", "1", "2024-01-01"), ("access", "2", "2024-01-02")], "event string, ts string, day string")
    for number in (0, 0, 1):
        each(lines, number)
    assert sorted((r.ts, str(r.day)) for r in readers.journal(spark, str(tmp_path / "j"), "access").collect()) == [("1", "2024-01-01")] * 4 + [("2", "2024-01-02")] * 2


def test_audit_message_leaves_out_what_is_absent(spark):
    rows = spark.createDataFrame([(None, None, None, "\x01", None), ("200", "1", "a\"b\x07", "ip", "x&" * 5000)], "status string, ts string, src string, src_ip string, q string")
    bare, full = (r.message for r in sinks.audit_message(rows).orderBy(F.col("ts").asc_nulls_first()).collect())
    assert bare == "<109>1 - - archive - - - \ufeff<AuditMessage><EventIdentification EventOutcomeIndicator=\"0\"></EventIdentification><ActiveParticipant UserIsRequestor=\"true\" /><AuditSourceIdentification><AuditSourceTypeCode csd-code=\"3\" /></AuditSourceIdentification></AuditMessage>"
    assert 'UserID="a&quot;b"' in full and full.count("x&amp;") == 2 * 2048 and '=""' not in full


def test_journal_totals_and_hidden_pages(spark):
    lines = spark.createDataFrame([(i, "u", "C" if i % 2 else "R") for i in range(10)], "n long, user_name string, action string").withColumn("ts", F.timestamp_seconds(F.col("n")))
    page = S.journal(lines, "n", F.col("ts"), action="C", offset=1, limit=2, total=True).collect()
    assert [(r.n, r.total) for r in page] == [(7, 5), (5, 5)]
    assert S.journal(lines, "n", F.col("ts"), user="nobody", total=True).count() == 0
    rows = spark.createDataFrame([("a", "s", "r", "CT", 113001, 5), ("b", "t", "r", "CT", 113037, 5), ("c", "t", "r", "CT", 0, 5), ("d", "t", "q", "CT", 113037, 5)], "sop_uid string, study_uid string, series_uid string, modality string, reason int, file_size long")
    studies = spark.createDataFrame([("t", "P1", "Doe^J"), ("s", None, None)], "study_uid string, patient_id string, patient_name string")
    got = [(r.sop_uid, r.patient_id, r.patient_name) for r in S.hidden_page(studies, rows, auditor=True).collect()]
    assert got == [("a", "", ""), ("b", "P1", "D***J"), ("d", "P1", "D***J")]
    assert [r.sop_uid for r in S.hidden_page(studies, rows, series_uid="r", reason=113037).collect()] == ["b"]
    assert [r.sop_uid for r in S.hidden_page(studies, rows, offset=1, limit=1).collect()] == ["b"]
