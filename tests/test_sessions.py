"""Access and ingest sessions against a row-by-row model."""

from __future__ import annotations

import random

import pytest

from studylake.streaming import sessions

FIELDS = "user_name string, src_ip string, study string, series string, event_id long, ts timestamp, status int, bytes long, us long, expected long"


def model(rows, gap=60):
    """One bucket a key: the first known number counts, a bucket closes when full or when idle for longer than the gap."""
    out, buckets = [], {}
    for user, ip, study, series, _, ts, status, size, us, expected in sorted(rows, key=lambda r: (r[5], r[4])):
        key = (user, ip, study, series)
        b = buckets.get(key)
        if b and (ts - b["last"]).total_seconds() > gap:
            out.append((*key, b["first"], b["last"], *b["sums"], "partial"))
            b = None
        b = b or {"first": ts, "sums": [0, 0, 0, 0], "expected": None}
        b["last"], b["sums"] = ts, [b["sums"][0] + 1, b["sums"][1] + (status >= 400), b["sums"][2] + size, b["sums"][3] + us]
        b["expected"] = expected if b["expected"] is None else b["expected"]
        buckets[key] = b
        if b["expected"] is not None and b["sums"][0] >= b["expected"]:
            out.append((*key, b["first"], b["last"], *b["sums"], "loaded"))
            del buckets[key]
    out += [(*key, b["first"], b["last"], *b["sums"], "partial") for key, b in buckets.items()]
    return sorted(out, key=str)


def made(n, seed, keys=3, known=0.3):
    from datetime import datetime, timedelta

    r, at, rows = random.Random(seed), datetime(2025, 1, 1), []
    for i in range(n):
        at += timedelta(seconds=r.choice([0, 0, 1, 5, 70] if r.random() < 0.2 else [0, 1]))
        k = r.randrange(keys)
        rows.append((None if k == 1 else f"u{k}", "ip", "s", f"s{k}", i, at, r.choice([200, 404]), r.randrange(100), r.randrange(9), r.choice([0, 1, 2, 3, 7, 30]) if r.random() < known else None))
    return rows


@pytest.mark.parametrize("n, seed, keys, known, piece", [(300, 1, 3, 0.3, 1000), (300, 2, 3, 0.3, 7), (400, 3, 1, 0.05, 4), (200, 4, 2, 0.0, 10), (250, 5, 1, 1.0, 3), (0, 6, 1, 1.0, 3)])
def test_access_sessions_follow_the_model(spark, n, seed, keys, known, piece):
    """Late, changing and absent expected numbers; sessions that span pieces."""
    rows = made(n, seed, keys, known)
    got = sessions.access_sessions(spark.createDataFrame(rows, FIELDS), piece=piece)
    assert sorted((tuple(r) for r in got.collect()), key=str) == model(rows)


def test_number_known_on_the_last_retrieve(spark):
    """Five retrieves, two expected, known on the fifth: one loaded session of five."""
    rows = [(*r[:9], 2 if i == 4 else None) for i, r in enumerate(made(5, 1, keys=1))]
    rows = [(*r[:5], rows[0][5], *r[6:]) for r in rows]
    assert [(r.fetched, r.state) for r in sessions.access_sessions(spark.createDataFrame(rows, FIELDS)).collect()] == [(5, "loaded")]


def lines_model(rows, gap, every=0, use_expected=True, idle="partial"):
    """(key, ts, line, requests, bytes) of each line."""
    out, open_ = [], {}
    for *key, _, ts, _, size, _, expected in sorted(rows, key=lambda r: (r[5], r[4])):
        key = tuple(key)
        b = open_.get(key)
        if b and (ts - b[0]).total_seconds() > gap:
            out.append((*key, b[0], idle, b[1], b[2]))
            b = None
        b = [ts, b[1] + 1, b[2] + size, b[3]] if b else [ts, 1, size, None]
        open_[key] = b
        if b[1] == 1:
            out.append((*key, ts, "started", 1, b[2]))
        if use_expected and b[3] is None:
            b[3] = expected
        if every and b[1] % every == 0:
            out.append((*key, ts, "progress", b[1], b[2]))
        if b[3] is not None and b[1] >= b[3]:
            out.append((*key, ts, "loaded", b[1], b[2]))
            del open_[key]
    return sorted([*out, *((*k, b[0], idle, b[1], b[2]) for k, b in open_.items())], key=str)


@pytest.mark.parametrize("kind", ["access", "ingest"])
def test_session_lines_stream(spark, tmp_path, kind):
    """Three triggers and a last event long after; every line comes, the idle ones by timers."""
    rows = [(*("u" if x is None else x for x in r[:4]), *r[4:]) for r in made(240, 9)]
    end = (*["end"] * 4, 10**6, rows[-1][5].replace(year=2026), 200, 0, 0, None)
    for part in (rows[:80], rows[80:160], rows[160:], [end]):
        spark.createDataFrame(part, FIELDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "0 seconds")
    if kind == "access":
        out = sessions.session_lines(stream, 60, sessions.KEY, sessions.ACCESS_SUMS, expected="expected", idle="partial")
        want = lines_model(rows, 60)
    else:
        out = sessions.session_lines(stream, 30, sessions.KEY, sessions.INGEST_SUMS, every=5)
        want = lines_model(rows, 30, 5, False, "completed")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.ROCKSDB)
    try:
        q = out.writeStream.format("memory").queryName(f"lines_{kind}").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.table(f"lines_{kind}").where("user_name <> 'end'").select(*sessions.KEY, "ts", "line", "requests", "bytes").collect()
    assert sorted((tuple(r) for r in got), key=str) == want
