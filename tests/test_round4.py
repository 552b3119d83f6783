"""What the findings of round 4 said: each has a test that failed before."""

from __future__ import annotations

from unittest.mock import MagicMock

import duckdb
import pandas as pd
import pytest

from studylake.operators import integrity as I
from studylake.operators import usercode as U
from studylake.plans import roundtrips
from studylake.plans.archive import QUERIES
from studylake.plans.registry import with_views
from studylake.sources.views import view
from studylake.streaming import sessions

from .oracle import SMALL, rows as cells
from .test_sessions import FIELDS, lines_model, made


@pytest.mark.parametrize("kind, buckets", [("access", 1), ("access", 3), ("ingest", 2)])
def test_session_lines_from_buckets(spark, tmp_path, kind, buckets):
    """The lines of sessions that share a state and a timer are those of each key, null keys included."""
    rows = made(240, 9, keys=5)
    end = (*["end"] * 4, 10**6, rows[-1][5].replace(year=2026), 200, 0, 0, None)
    for part in (rows[:80], rows[80:160], rows[160:], [end]):
        spark.createDataFrame(part, FIELDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "0 seconds")
    if kind == "access":
        out = sessions.session_lines(stream, 60, sessions.KEY, sessions.ACCESS_SUMS, expected="expected", idle="partial", buckets=buckets)
        want = lines_model(rows, 60)
    else:
        out = sessions.session_lines(stream, 30, sessions.KEY, sessions.INGEST_SUMS, every=5, buckets=buckets)
        want = lines_model(rows, 30, 5, False, "completed")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.ROCKSDB)
    try:
        q = out.writeStream.format("memory").queryName(f"buckets_{kind}_{buckets}").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.table(f"buckets_{kind}_{buckets}").where("user_name is null or user_name <> 'end'").select(*sessions.KEY, "ts", "line", "requests", "bytes").collect()
    assert sorted((tuple(r) for r in got), key=str) == want


def test_a_bucket_asks_the_state_store_once():
    """A hundred new keys take one question, one state and one timer; their timer moves when the first of them ends."""
    lines = sessions.BucketLines(1000, ["bytes"], 0, "partial", ["k0"])
    lines.handle, lines.state = MagicMock(), MagicMock()
    lines.state.exists.return_value = False
    at = pd.Timestamp("2024-01-01")
    frame = lambda keys, ts: pd.DataFrame({"ts": ts, "arrival": 1, "k0": keys, "known": None, "bytes": 5})
    calls = lambda: [c[0] for m in (lines.handle, lines.state) for c in m.method_calls]
    keys = [f"u{i}" for i in range(99)] + [None]
    assert list(pd.concat(lines.handleInputRows((0,), iter([frame(keys[:50], at), frame(keys[50:], at)]), None))["line"]) == ["started"] * 100
    assert calls() == ["registerTimer", "exists", "update"]
    first = lines.handle.registerTimer.call_args[0][0]
    lines.state.exists.return_value, lines.state.get.return_value = True, lines.state.update.call_args[0][0]
    later = at + pd.Timedelta("900ms")
    assert not list(lines.handleInputRows((0,), iter([frame(keys[:10] + [None], later)]), None))
    lines.state.get.return_value = lines.state.update.call_args[0][0]
    ended = pd.concat(lines.handleExpiredTimer((0,), MagicMock(getCurrentWatermarkInMs=lambda: first + 1), None))
    assert sorted(ended["k0"]) == sorted(keys[10:99]) and set(ended["line"]) == {"partial"}
    assert lines.handle.registerTimer.call_args[0][0] == first + 900 and len(lines.state.update.call_args[0][0][1]) == 11


def test_the_lines_are_dealt_in_buckets(spark, monkeypatch):
    asked, real = [], sessions.session_lines
    monkeypatch.setattr(sessions, "session_lines", lambda *a, **how: (asked.append(how), real(*a, **how))[1])
    given = spark.createDataFrame(made(20, 1), FIELDS)
    roundtrips._lines(given.fillna("u"), sessions.KEY, sums=sessions.ACCESS_SUMS, expected="expected", idle="partial")
    assert asked[0]["buckets"] > 1


def _handed(spark, monkeypatch, build) -> tuple[list[pd.DataFrame], object]:
    """The rows and the function that build hands to mapInPandas."""
    handed, kind = [], type(spark.range(1))
    monkeypatch.setattr(kind, "mapInPandas", lambda self, fn, schema: (handed.append((self.toPandas(), fn)), self)[1])
    build()
    (pdf, fn), = handed
    return pdf.sort_values(["study_uid", "rule"], ignore_index=True), fn


def test_columns_are_chosen_once_a_batch(spark, monkeypatch):
    """No column of a task's few rows is asked for but by the model; tasks that reach over batches are whole, and those without frames never reach it."""
    studies = spark.range(40).selectExpr("concat('s', id + 100) as study_uid", "'CT' as modality", "'HEAD' as body_part", "'x' as study_description")
    rules = spark.createDataFrame([(1, "a", "ct", None, None)], "position int, name string, r_modality string, r_body_part string, r_study_description string")
    frames = spark.range(90).selectExpr("concat('s', id % 30 + 100) as study_uid", "id as v")
    seen, asked, real = [], [], pd.DataFrame.__getitem__

    def model(pdf, p):
        seen.append((list(pdf.columns), list(pdf.index), len(pdf)))
        if len(seen) % 3 == 0:
            raise ValueError("third")
        return [(*pdf.iloc[0, :2], len(pdf))]

    pdf, fn = _handed(spark, monkeypatch, lambda: U.chain_outcomes(studies, rules, frames, model, "study_uid string, rule string, n long"))
    monkeypatch.setattr(pd.DataFrame, "__getitem__", lambda self, c: (asked.append(c), real(self, c))[1])
    got = pd.concat(fn(iter([pdf.iloc[:50], pdf.iloc[50:50], pdf.iloc[50:52], pdf.iloc[52:]])))
    assert len(asked) < 40 and seen == [(["study_uid", "rule", "v"], [0, 1, 2], 3)] * 30
    assert got["outcome"].tolist() == ["complete", "complete", "failed"] * 10 + ["empty"] * 10
    assert got["study_uid"].tolist() == [f"s{100 + i}" for i in range(40)] and set(got["error"].dropna()) == {"ValueError: third"}


def test_small_rows_keep_their_tasks(spark):
    """What a function costs does not show in the bytes of its rows, so adaptive execution must not put them into few tasks."""
    out = U.per_study(spark.range(50).selectExpr("cast(id as string) as study_uid"), lambda pdf, p: [(pdf["study_uid"].iat[0],)], "study_uid string")
    assert out.count() == 50 and out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def _plan(df, stage: str = "optimizedPlan") -> str:
    return getattr(df._jdf.queryExecution(), stage)().toString()


def test_series_and_instances_share_the_first_shuffle(spark):
    """Both are made of lines dealt by instance; no line is sorted before it is dealt, and rows of a series are aggregated once."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = QUERIES["int_rebuild_series"](spark, SMALL)
        assert _plan(got, "executedPlan").count("ReusedExchange") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" not in _plan(got)
    assert _plan(got, "executedPlan").count("REPARTITION_BY_COL") == 1


def test_lines_without_an_order_or_a_number(spark, tmp_path):
    """All lines that lack either are one instance without an id; its own number, order and study stay."""
    con = duckdb.connect()
    con.sql(f"""copy (select * replace (case when l_partkey % 5 = 1 then null else l_orderkey end as l_orderkey, case when l_partkey % 7 = 2 then null else l_linenumber end as l_linenumber, case when l_partkey % 11 = 3 then null else l_suppkey end as l_suppkey)
      from '{SMALL}/lineitem.parquet') to '{tmp_path}/lineitem.parquet' (format parquet)""")
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    got = view(spark, str(tmp_path), "v_instances")
    assert got.where("sop_uid is null").count() == 1 and dict(got.dtypes)["seq"] == "int"
    assert cells(got.toPandas()) == cells(con.sql(with_views("select * from v_instances")).df())


def test_owners_take_the_claims_once(spark):
    """Claims are read and dealt once for owners and instances; an instance that is stored twice has both studies as owners."""
    text = lambda study, series, sop: f'{{"00080018": {{"Value": ["{sop}"]}}, "0020000D": {{"Value": ["{study}"]}}, "0020000E": {{"Value": ["{series}"]}}}}'
    texts = spark.createDataFrame([(text("s1", "e1", "a"), "h1"), (text("s2", "e2", "a"), "h2"), (text("s2", "e3", "a"), "h0"), (text("s4", "e4", "b"), "h4"), (text("s3", "e5", "b"), "h5"), (text("s9", "e9", "c"), "h9")], "value string, blob_hash string")
    stored = {"studies": "study_uid string, x string", "series": "study_uid string, series_uid string, x string", "instances": "sop_uid string, study_uid string, series_uid string, x string"}
    held = {"instances": [("a", "s1", None, None), ("a", "s2", None, None), ("c", None, "e8", "kept"), (None, "s7", "e7", None)]}
    out = I.rebuild_levels(texts, {k: spark.createDataFrame(held.get(k, []), s) for k, s in stored.items()}, {k: {"x": ("00080060", "text")} for k in stored})
    table = lambda t: sorted(tuple(x or "" for x in r) for r in out[t].collect())
    assert table("conflicts") == [("a", "s1", "s2", "h1"), ("a", "s2", "s1", "h0"), ("a", "s2", "s1", "h2"), ("b", "s4", "s3", "h4")]
    assert table("instances") == [("", "s7", "e7", ""), ("a", "s1", "e3", ""), ("a", "s2", "e3", ""), ("b", "s3", "e5", ""), ("c", "s9", "e8", "kept")]
    assert table("series") == [("s1", "e1", ""), ("s2", "e2", ""), ("s2", "e3", ""), ("s3", "e5", ""), ("s9", "e9", "")]
    assert all(_plan(out[t]).count(" parquet") == 1 for t in ("studies", "series", "instances", "conflicts"))
