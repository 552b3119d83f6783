from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from studylake.functions import predicates as P
from studylake.functions import text as T
from studylake.functions.times import dt_bounds, tm_period
from studylake.operators import analytic as W
from studylake.operators import joins as J
from studylake.operators import lifecycle as L
from studylake.operators import search as S
from studylake.operators.aggregates import quantile_recent
from studylake.operators.arrays import minmax, window


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fuzzy_pairs(spark):
    cases = [("abcd", "abd", True), ("abcd", "abc", True), ("abcd", "bcd", True), ("abcd", "abxcd", True), ("abcd", "ad", False), ("abc", "ax", False), ("ononymo", "Anonymo", True), ("otonymo", "anonymo", False), ("иванов", "ивн", False), ("ивн", "иванов", True), ("x" * 70, "zz" + "x" * 70 + "zz", True), ("", "anything", True), ("a", "", False), ("a", "q", True), ("a.c", "xa+c", True)]
    for pattern, text, want in cases:
        assert one(spark, P.fuzzy(F.lit(text), pattern)) is want, (pattern, text)


def test_fuzzy_against_edit_distance(spark):
    def near(p, t):
        def d(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                row, old = [i], row
                for j, y in enumerate(b, 1):
                    row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
            return row[-1]

        return any(d(p, t[i:j]) <= 1 for i in range(len(t) + 1) for j in range(i, len(t) + 1))

    r = random.Random(1)
    for _ in range(4000):
        p, t = "".join(r.choice("ab^") for _ in range(r.randint(2, 5))), "".join(r.choice("ab^") for _ in range(r.randint(0, 8)))
        assert bool(re.search(P.fuzzy_regex(p), t)) == near(p, t), (p, t)


def test_globs_keep_stored_signs_literal(spark):
    rows = spark.createDataFrame([("T2*",), ("%_",), ("Chest?",), ("*Axial",), ("a\nb",), ("back\\slash",), (None,)], "s string")
    find = lambda p: sorted(r.s for r in rows.where(P.glob(F.col("s"), p)).collect())
    assert find("%_") == ["%_"] and find("%") == [] and find("_") == [] and find("a?b") == ["a\nb"] and find("back\\*") == ["back\\slash"]
    assert len(find("*")) == 6 and find("Chest*") == ["Chest?"]


def test_ranges(spark):
    day = lambda p: one(spark, P.date_range(F.lit(20260115), p))
    assert day("20260101-20260131") and day("20260115-") and day("-20260115") and day("20260115")
    assert not day("-") and not day("2026") and not day("20260101-20260131-") and not day("x")
    assert one(spark, P.study_date_range(F.lit(20260115), "bad", "20270101")) and not one(spark, P.study_date_range(F.lit(20260115), "20260116", ""))
    time = lambda v, p: one(spark, P.time_range(F.lit(v), p))
    assert time("1000", "1000-1100") and time("10", "1059-1200") and not time("10", "1100-") and time("100000.5", "100000.500000") and not time("100000", "100001") and not time("1000", "1-2")
    dt = lambda v, p: bool(one(spark, P.datetime_range(F.lit(v), p)))
    assert dt("20261115", "20261115") and dt("20261115103000", "20261115") and dt("202602", "2026-2027") and not dt("2028", "2026-2027")
    assert dt("20260101000000", "20251231190000-0500") and dt("20260228235959", "-202602") and not dt("20260301", "-202602") and dt("junk", "junk") and not dt("20261116", "20261115")
    assert P.split_datetime_range("20261116-0500") == ("20261116-0500", None) and P.split_datetime_range("2026-2027") == ("2026", "2027") and P.split_datetime_range("-2026") == ("", "2026")


def test_periods(spark):
    assert one(spark, tm_period(F.lit("10"))) == (36_000_000_000, 39_599_999_999)
    assert one(spark, tm_period(F.lit("100000.5"))) == (36_000_500_000, 36_000_500_000)
    assert all(one(spark, tm_period(F.lit(x))) is None for x in ("1", "123", "12345", "1234567", "ab", "100000."))
    lo, hi = one(spark, dt_bounds(F.lit("202602")))
    assert hi - lo + 1 == 28 * 86400 * 1_000_000
    assert one(spark, dt_bounds(F.lit("20260230"))) is None and one(spark, dt_bounds(F.lit("x"))) is None


def test_text_functions(spark):
    assert one(spark, T.mask_name(F.lit("ab"))) == "**" and one(spark, T.mask_name(F.lit("Müller"))) == "M****r"
    assert one(spark, T.mask_query(F.lit("a=1&PatientName=x&100%=2"))) == "a=1&PatientName=***&100%=2"
    assert len(one(spark, T.mask_query(F.lit("q=" + "é" * 2000))).encode()) == 1024
    assert one(spark, T.sanitize_controls(F.lit("a\x07b c\x85"))) == "a?b?c?"
    assert one(spark, T.stable_uid(F.lit("a|b"), F.lit("c"))) != one(spark, T.stable_uid(F.lit("a"), F.lit("b|c"))) and one(spark, T.stable_uid(F.lit(""), F.lit(None))) is None
    assert one(spark, T.pn_ngrams(F.lit(""))) == [] and one(spark, T.pn_ngrams(F.lit("A^b"))) == ["6162"]
    assert [one(spark, T.status_class(F.lit(s))) for s in (200, 302, 404, 503, 100)] == ["2xx", "2xx", "4xx", "5xx", "2xx"]


def test_ingest_outcome_against_a_row_by_row_model(spark):
    r = random.Random(3)
    for _ in range(6):
        rows = [(i, r.choice("ab"), r.choice("xyz"), r.choice("pq"), r.choice("12")) for i in range(40)]
        owner, patient, last, want = {}, {}, {}, {}
        for i, study, sop, pat, h in rows:
            if sop not in owner:
                owner[sop], last[sop], want[i] = study, h, "inserted"
                patient.setdefault(study, pat)
            elif owner[sop] != study or patient.get(study, pat) != pat:
                want[i] = "conflict"
            else:
                want[i] = "idempotent" if last[sop] == h else "updated"
                last[sop] = h
        df = spark.createDataFrame(rows, "i int, study_uid string, sop_uid string, patient_id string, blob_hash string")
        assert {x.i: x.outcome for x in W.ingest_outcome(df, [F.col("i")]).collect()} == want


def test_fuzzy_names_against_all_pairs(spark):
    r = random.Random(5)
    names = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(150)})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(x.a, x.b) for x in J.fuzzy_names(df, df).collect()}
    all_pairs = df.select(F.col("name").alias("a")).crossJoin(df.select(F.col("name").alias("b"))).where(F.levenshtein("a", "b") <= 1)
    assert got == {(x.a, x.b) for x in all_pairs.collect()}


def test_studies_against_a_model(spark):
    r = random.Random(7)
    rows = [(f"1.{i}", "".join(r.choice("AbC") for _ in range(3)), r.choice([None, 20200101 + r.randint(0, 400)])) for i in range(80)]
    df = spark.createDataFrame(rows, "study_uid string, patient_name string, study_date long")
    for _ in range(8):
        low, prefix = r.choice(["", "20200115"]), r.choice(["A*", "?b*", None])
        like = lambda s: prefix is None or re.fullmatch(prefix.lower().replace("*", ".*").replace("?", "."), s.lower())  # noqa: B023, E731
        want = [u for u, n, d in sorted(rows, key=lambda x: (x[2] is None, x[2] or 0, x[0])) if like(n) and (not low or (d and d >= int(low)))]
        assert [x.study_uid for x in S.studies(df, low, "", patient_name=prefix).collect()] == want
        assert [x.study_uid for x in S.studies(df, low, "", patient_name=prefix, offset=3, limit=5).collect()] == want[3:8]
    with pytest.raises(ValueError):
        S.studies(df, nonsense="1")


def test_orphans_fail_closed(spark):
    blobs, refs = spark.createDataFrame([("h",)], "blob_hash string"), spark.createDataFrame([], "blob_hash string, study_uid string")
    for call in (lambda: J.orphan_blobs(blobs, refs), lambda: J.orphan_blobs(blobs, blobs, unreadable=1)):
        with pytest.raises(ValueError):
            call()


def test_small_rules(spark):
    assert one(spark, window(F.array(F.lit(0.0), F.lit(100.0)), 50, 0)) == [0, 255] and one(spark, minmax(F.array(F.lit(3), F.lit(3)))) == [128, 128]
    s = spark.createDataFrame([(i, float(i)) for i in range(11)], "i int, v double")
    assert quantile_recent(s, "v", [F.col("i").desc()], 0.5).first()["quantile"] == 5.0
    assert S.include_fields("study", ["study_uid", "x", "institution_name"], ["00080080", "y"]) == ["study_uid", "institution_name"]
    j = spark.createDataFrame([("2024-01-01",), ("2024-01-09",), ("2024-02-01",)], "day string").select(F.to_date("day").alias("day"))
    assert L.prune_journal(j, "day", "2024-01-10", 0).count() == 0 and L.prune_journal(j, "day", "2024-01-10", 3).count() == 1
    slices = spark.createDataFrame([("a", 1, [0.0, 0.0, 0.0]), ("a", 2, [0.0, 0.0, 2.0]), ("b", 1, [0.0, 0.0, 1.0])], "series_uid string, number int, position array<double>").withColumns({"orientation": F.expr("array(1d,0d,0d,0d,1d,0d)"), "declared": F.lit(1.5)})
    assert {r.series_uid: r.spacing for r in W.slice_spacing(slices, "series_uid", "declared").collect()} == {"a": 2.0, "b": 1.5}
