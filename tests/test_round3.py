"""What the findings of round 3 said: each test failed before."""

from __future__ import annotations

from unittest.mock import MagicMock

import duckdb
import pandas as pd
import pytest

from studylake.operators import integrity as I
from studylake.operators import lifecycle as L
from studylake.operators import usercode as U
from studylake.plans import changes, roundtrips
from studylake.plans.archive import ORACLES, QUERIES
from studylake.plans.registry import with_views
from studylake.sources import readers
from studylake.sources.views import view
from studylake.streaming import sessions

from .oracle import SMALL, connection, rows


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_samples_are_multiplied_in_single_precision(spark):
    """-0.2765 is a little less than that as a float; times 1000 it is -276.5 in single precision, as in the SQL."""
    given = spark.createDataFrame([(1, [-0.2765, 0.1405, 0.25])], "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.sql("create view embeddings as select 1 as vec_id, [-0.2765, 0.1405, 0.25]::float[] as embedding")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            assert changes.pix(lambda name: given).first()["a"] == con.sql(f"select a from {changes.PIX}").fetchall()[0][0]
        finally:
            spark.conf.set("spark.sql.ansi.enabled", "true")


@pytest.mark.parametrize("name", ["arr_downsample", "arr_downsample_11x4", "arr_downsample_3x2", "arr_minmax", "arr_rescale"])
def test_arrays_of_halves_equal_their_sql(spark, tmp_path, name):
    """Every sample but one is such a half, so means of cells show it too."""
    spark.createDataFrame([(1, [-0.2765] * 63 + [0.25]), (2, [0.25] + [0.1405, -0.2765] * 31 + [-0.5])], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.sql(ORACLES[name]).df())


def test_a_rebuild_parses_each_text_once(spark):
    """Neither a level's table nor the conflicts parse texts again; the errors neither."""
    texts = spark.createDataFrame([('{"00080018": {"vr": "UI", "Value": ["i1"]}, "0020000D": {"vr": "UI", "Value": ["s1"]}, "0020000E": {"vr": "UI", "Value": ["e1"]}}', "b1"), ("{", "b2")], "value string, blob_hash string")
    empty = {"studies": "study_uid string, x string", "series": "study_uid string, series_uid string, x string", "instances": "sop_uid string, study_uid string, series_uid string, x string"}
    out = I.rebuild_levels(texts, {k: spark.createDataFrame([], s) for k, s in empty.items()}, {k: {"x": ("00080060", "text")} for k in empty})
    assert all("parseJson" not in _optimized(df) for df in out.values())
    assert (out["instances"].first()["sop_uid"], out["errors"].first()["blob_hash"]) == ("i1", "b2")


def test_a_plain_rebuild_parses_each_text_once(spark):
    assert all("from_json" not in _optimized(QUERIES[q](spark, SMALL)) for q in ("int_rebuild", "int_rebuild_conflicts"))


def test_studies_are_cut_from_sorted_batches(spark):
    """No group for each study; one that reaches over several Arrow batches is whole, null is a study of its own, and columns of several types keep large numbers."""
    rows = [("a", 1)] * 7 + [(None, 2)] * 5 + [("b", 3), ("c", 4), ("c", 5)]
    given = spark.createDataFrame(rows, "study_uid string, size long")
    big = 2**60 + 1
    frame = lambda pdf, p: pdf[["study_uid"]].head(1).assign(n=len(pdf), total=big if pdf["study_uid"].iat[0] != "b" else float("nan"))
    tuples = lambda pdf, p: [(pdf["study_uid"].iat[0], len(pdf), big if pdf["study_uid"].iat[0] != "b" else None)]
    want = {("a", 7, big), (None, 5, big), ("b", 1, None), ("c", 2, big)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("2", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            for fn in (frame, tuples):
                out = U.per_study(given, fn, "study_uid string, n long, total long")
                assert {tuple(r) for r in out.collect()} == want and out.count() == 4
                assert "FlatMapGroupsInPandas" not in _optimized(out)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_new_key_asks_the_state_store_once():
    """Of a key without a session nothing is stored: whether there is one is the only question, then its state and timer are set."""
    lines = sessions.SessionLines(1000, ["bytes"], 0, "partial")
    lines.handle, lines.session, lines.expected = MagicMock(), MagicMock(), MagicMock()
    lines.session.exists.return_value = False
    row = lambda known: pd.DataFrame({"ts": [pd.Timestamp("2024-01-01")], "arrival": [1], "known": [known], "bytes": [5]})
    calls = lambda: [c[0] for m in (lines.handle, lines.session, lines.expected) for c in m.method_calls]
    assert list(next(lines.handleInputRows(("k",), iter([row(None)]), None))["line"]) == ["started"]
    assert calls() == ["registerTimer", "exists", "update"]
    assert list(next(lines.handleInputRows(("k",), iter([row(1)]), None))["line"]) == ["started", "loaded"]
    assert calls() == ["registerTimer", "exists", "update", "exists"]


def test_instances_are_sorted_by_narrow_columns(spark, tmp_path):
    """No text is made before the windows; a line without a number, orders that share a study, and copies are as in the SQL."""
    con = duckdb.connect()
    con.sql(f"""copy (select * replace (case when l_orderkey % 10 = 3 then null else l_linenumber % 2 end as l_linenumber, case when l_partkey % 3 = 0 then 37 else l_suppkey end as l_suppkey) from '{SMALL}/lineitem.parquet') to '{tmp_path}/lineitem.parquet' (format parquet)""")
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    for name in ("v_instances", "v_series"):
        got = view(spark, str(tmp_path), name)
        assert rows(got.toPandas()) == rows(con.sql(with_views(f"select * from {name}")).df())
        below = _optimized(got).split("Window", 1)[1]
        assert "md5(" not in below and "concat(" not in below


def _counted(spark):
    """A v that counts how often a view is asked for."""
    asked = []
    return asked, lambda name: (asked.append(name), view(spark, SMALL, name))[1]


def test_a_tree_takes_each_view_once(spark):
    asked, v = _counted(spark)
    roundtrips._trees(v)
    assert sorted(asked) == ["v_instances", "v_studies"]


def test_notes_are_made_in_one_pass(spark):
    got, con = changes._notes(lambda name: view(spark, SMALL, name)), connection()
    assert _optimized(got).count("Relation [") == 1
    assert rows(got.toPandas()) == rows(con.sql(with_views(changes.NOTES)).df())


def test_deletion_marks_rows_in_one_pass(spark):
    """Instances are read once, with derived objects three times; a hash that is missing is no shared blob."""
    given = spark.range(6).selectExpr("concat('i', id) as sop_uid", "concat('e', id div 2) as series_uid", "concat('s', id div 4) as study_uid", "case id when 2 then 'sr' else 'ct' end as sop_class", "nullif(concat('b', id % 3), 'b1') as blob_hash", "id as file_size", "array('e0') as refs")
    reads = lambda df: _optimized(df).count("Range (")
    named = spark.createDataFrame([("s0",), ("s9",)], "study_uid string")
    preview, stays, dead = L.delete(given, named)
    assert (tuple(preview.first()), reads(preview), reads(stays)) == ((4, 6, 1), 1, 1)
    assert {r.sop_uid for r in stays.collect()} == {"i4", "i5"} and {r.study_uid for r in dead.collect()} == {"s0", "s9"} and stays.columns == given.columns
    preview, stays, dead = L.delete(given, spark.createDataFrame([("e0",)], "series_uid string"), "series", ["sr"])
    assert (tuple(preview.first()), reads(preview)) == ((3, 3, 2), 3)
    assert {r.sop_uid for r in stays.collect()} == {"i3", "i4", "i5"} and dead.count() == 0


def test_outcomes_carry_no_hash_through_shuffles(spark):
    plan = _optimized(QUERIES["win_ingest_outcome"](spark, SMALL))
    assert "blob_hash" not in plan[: plan.index("windowspecdefinition(study_uid")]


def test_what_is_stored_goes_before_arrivals_are_sorted(spark):
    stored = spark.createDataFrame([("a", 1)], "sop_uid string, n int")
    coming = spark.createDataFrame([("a", 2), ("b", 4), ("b", 3), (None, 5)], "sop_uid string, n int")
    out = L.merge_ingest(stored, coming, "sop_uid", [changes.F.col("n")])
    assert {tuple(r) for r in out.collect()} == {("a", 1), ("b", 3), (None, 5)}
    assert 0 < _optimized(out).index("Window") < _optimized(out).index("LeftAnti")


def test_two_archives_run_the_windows_once(spark):
    stored, coming, _ = changes._archives(lambda name: view(spark, SMALL, name))
    assert all("Window" not in _optimized(a[level]) for a in (stored, coming) for level in ("series", "instances"))


def test_nested_sequences_are_cast_once(spark):
    """One cast for both levels, with the rows that a call of sequence() for each level gives, for texts of other shapes as well."""
    texts = [
        '{"A": {"Value": [{"B": {"Value": ["x", "y"]}, "C": {"Value": [{"D": {"Value": [1.50]}}, {"D": 3}, null, 4]}}, null, 5, {"C": {"Value": {}}}, {"C": {"Value": []}}, {"C": 4}]}}',
        '{"A": {"Value": [{"B": {"Value": [{"q": 1}]}, "C": {"Value": [{"D": {"Value": [[1, 2], 3]}}, {"D": {"Value": "z"}}, {"D": {"Value": [null, "z"]}}]}}]}}',
        '{"A": {"Value": {"B": 1}}}', '{"A": [1]}', '{"A": null}', "[]", "{", None,
    ]
    d = readers.dicom_datasets(spark.createDataFrame(list(enumerate(texts)), "i int, value string"), {})
    for kind in readers.KINDS:
        each = readers.sequence(readers.sequence(d, "A", {"b": ("B", kind)}).withColumnRenamed("position", "p"), "C", {"d": ("D", kind)}).drop("dataset")
        once = readers.sequences(d, [("A", "p", {"b": ("B", kind)}), ("C", "position", {"d": ("D", kind)})])
        assert once.columns == each.columns and sorted(str(r) for r in once.collect()) == sorted(str(r) for r in each.collect())
    assert _optimized(QUERIES["src_dicom_sequence"](spark, SMALL)).count("posexplode(try_variant_get") == 1


@pytest.mark.parametrize("name", ["src_dicom_sequence", "src_dicom_datasets"])
def test_datasets_are_joined_by_number(spark, name):
    """No text is made of a line before its study is joined."""
    below = _optimized(QUERIES[name](spark, SMALL)).split("Join LeftOuter", 1)[1]
    assert "md5(" not in below and "concat(" not in below


@pytest.mark.parametrize("name", ["arr_downsample", "arr_minmax"])
def test_sql_of_arrays_states_the_whole_rule(spark, tmp_path, name):
    """Equal samples become 128; a cell has one sample at least, and is 0 where there is none."""
    vectors = [[0.25] * 64, [0.1], [0.1, 0.2, 0.3, 0.4, 0.5], [0.1, -0.1] * 6 + [0.7], []]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["arr_downsample_11x4", "arr_downsample_3x2", "arr_rescale"])
def test_sql_of_odd_arrays_states_the_whole_rule(spark, tmp_path, name):
    """Images without samples are zeros, means are rounded half up below 0 too, a null sample makes its cell null, and each row counts for itself."""
    vectors = [(1, None), (2, []), (3, [0.1] * 6), (4, [0.1] * 7), (5, [0.1, None, 0.3] * 5), (6, [None] * 14), (7, [-6.1, -7.3, -5.0005, -9.9995] * 14), (8, [0.5] * 14), (8, [0.25] * 21), (None, [0.5] * 14)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.sql(ORACLES[name]).df())
