from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from studylake.operators import integrity as I
from studylake.operators import usercode as U
from studylake.sources import readers, sinks
from studylake.streaming import jobs, sessions


def test_study_tree(spark, tmp_path):
    good = {"study_uid": "1", "series": [{"series_uid": "1.1", "modality": "CT", "instances": [{"sop_uid": "a", "frames": [{"number": 1, "hash": "h"}]}, {"sop_uid": "b"}]}, {"series_uid": "1.2"}]}
    (tmp_path / "s.json").write_text(json.dumps(good) + "\n{broken\n" + json.dumps({"study_uid": "2"}) + "\n")
    t = readers.study_tree(spark, str(tmp_path))
    assert {k: v.count() for k, v in t.items()} == {"studies": 2, "series": 2, "instances": 2, "frames": 1, "corrupt": 1}
    assert [(r.sop_uid, r.seq) for r in t["instances"].orderBy("seq").collect()] == [("a", 0), ("b", 1)]


def test_dicom_json(spark):
    d = {"00100010": {"vr": "PN", "Value": [{"Alphabetic": "Doe^J"}]}, "00080018": {"vr": "UI", "Value": ["1.2"]}, "0020000D": {"vr": "UI", "Value": ["9"]}, "00280010": {"vr": "US", "Value": [512]}}
    rows = spark.createDataFrame([(json.dumps(d),), ("{bad",)], "value string")
    out = readers.dicom_json(rows, {"name": "00100010", "sop": "00080018", "rows": "00280010", "missing": "00080060"}).collect()
    assert tuple(out[0]) == ("Doe^J", "1.2", "512", None) and tuple(out[1]) == (None,) * 4
    stored = spark.createDataFrame([("1.2", "s", "8")], "sop_uid string, series_uid string, study_uid string")
    table, conflicts = I.rebuild(rows, stored)
    assert table.count() == 1 and conflicts.count() == 1


def test_journal_and_index(spark, tmp_path):
    lines = [{"event": "access", "ts": "t1", "user": "u"}, {"event": "other"}, {"event": "access", "ts": "t2"}]
    (tmp_path / "2024-05-06.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n{"event": "acc')
    j = readers.journal(spark, str(tmp_path), "access")
    assert sorted(r.ts for r in j.collect()) == ["t1", "t2"] and str(j.first()["day"]) == "2024-05-06"
    rows = spark.createDataFrame([("CT", "2024-01-01", 1), ("MR", "2024-01-01", 2)], "modality string, day string, x int")
    sinks.write_index(rows, str(tmp_path / "index"))
    sinks.write_index(rows, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).where("modality = 'CT'").count() == 2
    sinks.write_journal(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_blobs_and_sidecars(spark, tmp_path):
    data = b"content"
    name = hashlib.sha256(data).hexdigest()
    (tmp_path / "b" / "tmp").mkdir(parents=True)
    (tmp_path / "b" / f"{name}.dcm").write_bytes(data)
    (tmp_path / "b" / f"{'0' * 64}.dcm").write_bytes(data)
    (tmp_path / "b" / "tmp" / "x.dcm").write_bytes(data)
    (tmp_path / "b" / "note.txt").write_bytes(data)
    blobs = readers.blobs(spark, str(tmp_path / "b"))
    expected = spark.createDataFrame([(name,), ("0" * 64,), ("f" * 64,)], "blob_hash string")
    assert {r.blob_hash[0]: r.verdict for r in I.verify(blobs, expected).collect()} == {name[0]: "ok", "0": "mismatch", "f": "gone"}
    assert I.bad_hashes(I.verify(blobs, expected)).count() == 2
    (tmp_path / "side").write_text("abc 1\nbad line\nabc 7\n12f 3\n")
    assert sorted(tuple(r) for r in readers.sidecar_lines(spark, str(tmp_path / "side")).collect()) == [("12f", 3), ("abc", 1)]


def test_user_code(spark):
    frames = spark.createDataFrame([("s1", 1, 2.0), ("s1", 2, 4.0), ("s2", 1, 1.0)], "study_uid string, frame int, v double").withColumns({"modality": F.lit("CT"), "body_part": F.lit("HEAD"), "study_description": F.lit("x")})
    fn = lambda pdf, p: pdf.head(1)[["study_uid"]].assign(total=pdf["v"].sum() * p["k"])
    assert {r.study_uid: r.total for r in U.per_study(frames, fn, "study_uid string, total double", {"k": 1.0}, k=2).collect()} == {"s1": 12.0, "s2": 2.0}
    with pytest.raises(ValueError):
        U.per_study(frames, fn, "study_uid string, total double", {"k": 1.0}, z=2)
    rules = spark.createDataFrame([(1, "a", "ct", None, None), (2, "b", None, "head", None), (3, "c", "mr", None, None)], "position int, name string, r_modality string, r_body_part string, r_study_description string")
    studies = frames.select("study_uid", "modality", "body_part", "study_description").distinct()
    by = lambda pdf, p: pdf.head(1)[["study_uid", "rule"]].assign(n=len(pdf))
    assert sorted(tuple(r) for r in U.chain(studies, rules, frames.select("study_uid", "v"), by, "study_uid string, rule string, n long").collect()) == [("s1", "a", 2), ("s1", "b", 2), ("s2", "a", 1), ("s2", "b", 1)]


ACCESS = "event_id long, ts timestamp, user_name string, src_ip string, study string, series string, status int, bytes long, us long, expected long"


def access(spark, tmp_path):
    at = lambda s: F.timestamp_micros(F.lit(1_700_000_000_000_000) + s)
    # a: two loaded sessions of two and one open; b: exactly 60 s idle is one session, one microsecond more is two; c comes last and flushes
    rows = [(1, 0, "a", 2), (2, 1, "a", None), (3, 2, "a", 2), (4, 3, "a", None), (5, 4, "a", None), (6, 0, "b", None), (7, 60_000_000, "b", None), (8, 120_000_001, "b", None)]
    df = spark.createDataFrame([(i, int(t if t > 1000 else t * 1_000_000), u, e) for i, t, u, e in rows], "event_id long, s long, user_name string, expected long")
    df = df.select("event_id", at(F.col("s")).alias("ts"), "user_name", F.lit("ip").alias("src_ip"), F.lit("s").alias("study"), F.lit("r").alias("series"), F.lit(200).alias("status"), F.lit(10).cast("long").alias("bytes"), F.lit(1).cast("long").alias("us"), "expected")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    flush = df.limit(1).withColumns({"ts": at(F.lit(10_000_000_000)), "user_name": F.lit("z"), "expected": F.lit(None).cast("long"), "event_id": F.lit(99).cast("long")})
    for k in (1, 2):
        flush.withColumn("ts", F.col("ts") + F.expr(f"interval {k} hours")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_access_sessions(spark, tmp_path):
    batch = sessions.access_sessions(access(spark, tmp_path))
    want = sorted((r.user_name, r.fetched, r.state) for r in batch.collect())
    assert want == [("a", 1, "partial"), ("a", 2, "loaded"), ("a", 2, "loaded"), ("b", 1, "partial"), ("b", 2, "partial")]
    stream = spark.readStream.schema(ACCESS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "60 seconds")
    got = run(sessions.access_sessions_stream(stream), "access_sessions")
    assert sorted((r.user_name, r.fetched, r.state) for r in got.where("user_name <> 'z'").collect()) == want


def test_windowed_sessions_stream_equals_batch(spark, tmp_path):
    df = access(spark, tmp_path)
    stream = lambda: spark.readStream.schema(ACCESS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "60 seconds")
    for name, op in (("ingest", sessions.ingest_sessions), ("ready", lambda x: sessions.readiness(x.where("user_name <> 'z'") if not x.isStreaming else x, "60 seconds"))):
        got = {tuple(r) for r in run(op(stream()), f"w_{name}").collect()}
        assert {tuple(r) for r in op(df).collect()} <= got
    counts = run(jobs.counters(stream().withColumn("route", F.lit("x"))), "counters", "complete")
    assert [tuple(r) for r in counts.collect()] == [("x", "2xx", 10)]
    plain = spark.readStream.schema(ACCESS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert run(jobs.first_seen(plain, ["user_name"]), "seen").count() == 3


def test_mint_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "tasks")
    schema = "study_uid string, code string, trigger string"
    spark.createDataFrame([], schema).write.parquet(path)
    codes = spark.createDataFrame([("CT", "liver", False), ("CT", "lung", False)], "modality string, code string, manual boolean")
    each = jobs.mint(codes, lambda: spark.read.schema(schema).parquet(path), lambda d: d.write.mode("append").parquet(path), ["SR"], "general")
    batch = spark.createDataFrame([("1", "CT"), ("1", "CT"), ("2", "MR"), ("3", "SR")], "study_uid string, modality string")
    each(batch, 0)
    each(batch, 0)
    assert sorted((r.study_uid, r.code) for r in spark.read.parquet(path).collect()) == [("1", "liver"), ("1", "lung"), ("2", "general")]


def test_commit_wait(spark, tmp_path):
    schema = "transaction_uid string, sop_uid string, expected long, ts timestamp"
    rows = [("t1", "a", 2, 0), ("t1", "b", 2, 5), ("t2", "a", 2, 0), ("t2", "a", 2, 1)]
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("s") * 1_000_000)
    make = lambda rs: spark.createDataFrame(rs, "transaction_uid string, sop_uid string, expected long, s long").select("transaction_uid", "sop_uid", "expected", at.alias("ts")).coalesce(1)
    make(rows).write.parquet(str(tmp_path / "in"))
    for k in (5000, 9000):
        make([("z", "a", 5, k)]).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "10 seconds")
    got = {r.transaction_uid: r.verdict for r in run(jobs.commit_wait(stream), "commits").collect()}
    assert got["t1"] == "success" and got["t2"] == "failures"
