"""Sessions over the access and ingest streams, with batch twins. Event time; streams need a watermark of at least the gap."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import cut

KEY = ["user_name", "src_ip", "study", "series"]


def _same(names: list[str], left: str, right: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names])


def _next_starts(events: DataFrame, gap_seconds: int, key: list[str], order: str) -> DataFrame:
    """Numbers each key's rows (_n) and says for each row, were it the first of a session: the first row after that session (_next), and whether it would be loaded (_full).

    A session ends before a gap, or with the row by which as many rows are there as the first expected number known since its start.
    """
    w = Window.partitionBy(*key).orderBy("ts", order)
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w) > gap_seconds * 1_000_000
    a = events.withColumns({"_n": F.row_number().over(w).cast("long"), "_new": F.coalesce(gap, F.lit(True)).cast("int")})
    a = a.withColumn("_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy(*key, "_s").orderBy(F.desc("ts"), F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)  # the nearest known number from here on
    known = F.last(F.when(F.col("expected").isNotNull(), F.struct("_n", "expected")), ignorenulls=True).over(back)
    b = a.withColumns({"_e": known, "_end": F.max("_n").over(back)})
    full = F.greatest(F.col("_e._n"), F.col("_n") + F.col("_e.expected") - 1)
    return b.withColumns({"_full": F.coalesce(full <= F.col("_end"), F.lit(False)), "_next": F.least(full, "_end") + 1})


def access_sessions(events: DataFrame, gap_seconds: int = 60, key: list[str] = KEY, order: str = "event_id", piece: int = 1000) -> DataFrame:
    """Batch: a session ends when idle for more than the gap, or as soon as it has as many retrieves as expected: the first number known since its start, however late.

    Where a session starts depends on where the one before ended, so starts are followed from row to row: by an ordered fold within pieces of so many rows; between the pieces of a long key, links
    from every row to the first start beyond its piece are followed in doubling steps (as many as the logarithm of its pieces). No key is gathered; windows only number its rows. The number of
    pieces is counted when the plan is built, and links are written.

    Columns: key, started, ended, fetched, failed (status >= 400), bytes, us, state ('loaded' or 'partial').
    """
    rows = _next_starts(events.withColumn("ts", F.col("ts").cast("timestamp")), gap_seconds, key, order)
    fields = [F.col("_n"), F.col("_next"), F.col("_full"), F.col("ts"), F.coalesce(F.col("status") >= 400, F.lit(False)).alias("bad"), F.col("bytes"), F.col("us")]
    pieces = rows.groupBy(*key, F.floor((F.col("_n") - 1) / piece).alias("_p")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_rows"))
    most = events.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    if most <= piece:
        entered = pieces.withColumns({"_entry": F.lit(1).cast("long"), "_carry": F.lit(None).cast("long")})
    else:
        entered = _entries(pieces, key, piece, most)
    step = lambda acc, r: F.when(r["_n"] == acc["next"], F.struct(r["_next"].alias("next"), r["_n"].alias("start"), F.concat(acc["out"], F.array(r["_n"])).alias("out"))).otherwise(F.struct(acc["next"].alias("next"), acc["start"].alias("start"), F.concat(acc["out"], F.array(acc["start"])).alias("out")))
    begin = F.struct(F.col("_entry").alias("next"), F.col("_carry").alias("start"), F.expr("cast(array() as array<bigint>)").alias("out"))
    starts = F.aggregate("_rows", begin, step)["out"]
    r = entered.select(*key, F.explode(F.arrays_zip(F.col("_rows").alias("r"), starts.alias("start"))).alias("x")).select(*key, "x.start", "x.r.*")
    sums = [F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("fetched"), F.count_if("bad").alias("failed"), F.sum("bytes").alias("bytes"), F.sum("us").alias("us")]
    full = F.bool_or(F.col("_full") & (F.col("_n") == F.col("start")))
    return r.groupBy(*key, "start").agg(*sums, F.when(full, "loaded").otherwise("partial").alias("state")).drop("start")


def _entries(pieces: DataFrame, key: list[str], piece: int, most: int) -> DataFrame:
    """Each piece with the first row in it that starts a session (_entry, null for none), and the start of the session that reaches into it (_carry)."""
    at = F.col("_p") * piece  # row _n of the piece is number _n - at of it
    inside = F.transform("_rows", lambda r: F.when(r["_next"] - at <= F.size("_rows"), r["_next"] - at).otherwise(r["_n"] - at).cast("int"))
    for _ in range(piece.bit_length()):  # the last start of the piece that each row leads to
        inside = F.get(F.transform(F.array(inside), lambda a: F.transform(a, lambda i: F.get(a, i - 1))), F.lit(0))
    last = pieces.select(*key, "_p", "_rows", F.posexplode(inside).alias("_i", "_l"))
    links = cut(last.select(*key, (at + F.col("_i") + 1).alias("_from"), (at + F.col("_l")).alias("_last"), F.get("_rows", F.col("_l") - 1)["_next"].alias("_to")), "links")
    reached = links.where("_from = 1").select(*key, "_from", "_last")
    jumps, hops = links.select(*key, "_from", "_to"), links.select(*key, "_from", "_last")
    for _ in range((-(-most // piece)).bit_length()):
        on = reached.alias("a").join(jumps.alias("b"), _same([*key, "_from"], "a", "b")).select(*(F.col(f"a.{k}") for k in key), F.col("b._to").alias("_from"))
        new = on.alias("a").join(hops.alias("b"), _same([*key, "_from"], "a", "b")).select(*(F.col(f"a.{k}") for k in key), F.col("b._from").alias("_from"), "b._last")
        reached = cut(reached.unionByName(new).distinct(), "reached")
        double = jumps.alias("a").join(jumps.alias("b"), _same(key, "a", "b") & (F.col("a._to") == F.col("b._from"))).select(*(F.col(f"a.{k}") for k in key), "a._from", "b._to")
        jumps = cut(double, "jumps")
    found = reached.select(*key, F.floor((F.col("_from") - 1) / piece).alias("_p"), F.col("_from").alias("_entry"), "_last")
    both = pieces.alias("a").join(found.alias("b"), _same([*key, "_p"], "a", "b"), "left").select("a.*", "b._entry", "b._last")
    before = Window.partitionBy(*key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("_carry", F.last("_last", ignorenulls=True).over(before))


def access_sessions_stream(events: DataFrame, gap_seconds: int = 60, key: list[str] = KEY) -> DataFrame:
    """Streaming twin: one row when a session is loaded or falls idle. events has ts with a watermark; within one batch rows go by ts."""
    schema = ", ".join(f"{k} string" for k in key) + ", started timestamp, ended timestamp, fetched long, failed long, bytes long, us long, state string"
    names = [*key, "started", "ended", "fetched", "failed", "bytes", "us", "state"]
    gap = gap_seconds * 1_000_000

    def run(group, frames, state):
        opened = state.get if state.exists else None
        out = []

        def close(kind):
            out.append((*group, pd.Timestamp(opened[0], unit="us"), pd.Timestamp(opened[1], unit="us"), *opened[2:6], kind))

        rows = [r for f in frames for r in f[["ts", "status", "bytes", "us", "expected"]].itertuples(index=False)]
        for ts, status, size, us, expected in sorted(rows, key=lambda r: r[0]):
            at = pd.Timestamp(ts).value // 1000
            if opened and at - opened[1] > gap:
                close("partial")
                opened = None
            known = int(expected) if expected == expected and expected is not None else 0
            if not opened:
                opened = (at, at, 0, 0, 0, 0, 0)
            opened = (opened[0], at, opened[2] + 1, opened[3] + int(status >= 400), opened[4] + int(size), opened[5] + int(us), opened[6] or known)
            if opened[6] and opened[2] >= opened[6]:
                close("loaded")
                opened = None
        if state.hasTimedOut and opened:
            close("partial")
            opened = None
        if opened:
            state.update(opened)
            state.setTimeoutTimestamp(max(opened[1] // 1000 + gap_seconds * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names)

    return events.groupBy(*key).applyInPandasWithState(run, schema, "started long, ended long, fetched long, failed long, bytes long, us long, expected long", "append", "EventTimeTimeout")


def _windowed(events: DataFrame, key: list[str], gap: str, *aggregates: Column) -> DataFrame:
    return events.groupBy(*key, F.session_window("ts", gap).alias("w")).agg(*aggregates)


#: What a request of a store says: status 409 is a conflict, a redirect an instance that was there already.
INGEST = {"stored": "status < 300", "idempotent": "status >= 300 and status < 400", "failed": "status >= 400 and status <> 409", "conflicts": "status = 409"}


def ingest_sessions(events: DataFrame, gap: str = "30 seconds", key: list[str] = ("study", "user_name", "src_ip")) -> DataFrame:
    """Totals of each ingest session; batch, or a stream in append mode. progress = how many times 50 requests were passed."""
    sums = (F.count_if(F.expr(c)).alias(n) for n, c in INGEST.items())
    out = _windowed(events, list(key), gap, F.count("*").alias("requests"), *sums, F.sum("bytes").alias("bytes"))
    return out.select(*key, F.col("w.start").alias("started"), F.col("w.end").alias("idle_at"), "requests", *INGEST, "bytes", F.floor(F.col("requests") / 50).alias("progress"))


def ingest_events(events: DataFrame, gap_seconds: int = 30, every: int = 50, key: list[str] = ("study", "user_name", "src_ip"), order: str = "event_id") -> DataFrame:
    """Batch: the lines of each ingest session: started at its first request, progress at every so many, completed at its last; with the requests so far."""
    key = list(key)
    w = Window.partitionBy(*key).orderBy("ts", order)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    a = events.withColumn("_new", F.coalesce(micros - F.lag(micros).over(w) > gap_seconds * 1_000_000, F.lit(True)).cast("int")).withColumn("_s", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = Window.partitionBy(*key, "_s").orderBy("ts", order)
    b = a.withColumns({"requests": F.row_number().over(s), "_last": F.lead(order).over(s).isNull()})
    lines = F.filter(F.array(F.when(F.col("requests") == 1, "started"), F.when(F.col("requests") % every == 0, "progress"), F.when(F.col("_last"), "completed")), lambda x: x.isNotNull())
    return b.select(*key, "ts", order, "requests", F.explode(lines).alias("line"))


def readiness(events: DataFrame, gap: str = "10 seconds") -> DataFrame:
    """A study is ready when no instance came for the gap: ready_at and arrivals of each quiet end."""
    return _windowed(events, ["study"], gap, F.count("*").alias("arrivals")).select("study", F.col("w.end").alias("ready_at"), "arrivals")


def anonymous_rate(events: DataFrame, width: str = "60 minutes", step: str = "1 minute") -> DataFrame:
    """Requests without a user in each sliding window."""
    return events.where("who = ''").groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("requests")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "requests")


#: The state store that session_lines() needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Columns that session_lines() sums: what a request adds to each.
ACCESS_SUMS = {"failed": "case when status >= 400 then 1 else 0 end", "bytes": "bytes", "us": "us"}
INGEST_SUMS = {**{n: f"case when {c} then 1 else 0 end" for n, c in INGEST.items()}, "bytes": "bytes"}


class SessionLines(StatefulProcessor):
    """One key's open session: its first and last time, requests and sums, and apart from them the expected number, which may become known late. A timer of event time ends it when idle."""

    def __init__(self, gap_ms: int, sums: list[str], every: int, idle: str):
        self.gap_ms, self.sums, self.every, self.idle = gap_ms, sums, every, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "first long, last long, requests long, sums array<long>")
        self.expected = handle.getValueState("expected", "expected long")

    def _frame(self, key, lines):
        columns = [*(f"k{i}" for i in range(len(key))), "ts", "line", "requests", *self.sums]
        return pd.DataFrame([(*key, pd.Timestamp(at, unit="us"), line, requests, *sums) for at, line, requests, sums in lines], columns=columns)

    def _timer(self, at: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(at)

    def _step(self, opened, at, known, adds, lines):
        """The open session (first, last, requests, sums, expected) after one more request, or None; lines (ts, line, requests, sums) are appended to what is there."""
        if opened and at - opened[1] > self.gap_ms * 1000:
            lines.append((opened[1], self.idle, opened[2], opened[3]))
            opened = None
        first, _, requests, sums, expected = opened or (at, at, 0, [0] * len(self.sums), None)
        requests, sums = requests + 1, [a + int(b) for a, b in zip(sums, adds, strict=True)]
        if requests == 1:
            lines.append((at, "started", 1, sums))
        if expected is None and known is not None and known == known:
            expected = int(known)
        if self.every and requests % self.every == 0:
            lines.append((at, "progress", requests, sums))
        if expected is not None and requests >= expected:
            lines.append((at, "loaded", requests, sums))
            return None
        return first, at, requests, sums, expected

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        now = self.session.get() if self.session.exists() else None
        expected = self.expected.get()[0] if now and self.expected.exists() else None
        came = [r for f in rows for r in f[["ts", "arrival", "known", *self.sums]].itertuples(index=False)]
        opened, lines = (now[0], now[1], now[2], list(now[3]), expected) if now else None, []
        for ts, _, known, *adds in sorted(came, key=lambda r: (r[0], r[1])):
            opened = self._step(opened, pd.Timestamp(ts).value // 1000, known, adds, lines)
        first, last, requests, sums, expected = opened or (None, None, 0, [], None)
        if not now:  # nothing is stored of a key without a session, neither a number nor a timer; each call to the store is a round trip
            if requests:
                self.session.update((first, last, requests, sums))
                if expected is not None:
                    self.expected.update((expected,))
                self.handle.registerTimer(last // 1000 + self.gap_ms + 1)
        elif requests:
            self.session.update((first, last, requests, sums))
            self.expected.update((expected,)) if expected is not None else self.expected.clear()
            self._timer(last // 1000 + self.gap_ms + 1)
        else:
            self.session.clear()
            self.expected.clear()
            self._timer(None)
        yield self._frame(key, lines)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        lines = []
        if self.session.exists():
            _, last, requests, sums = self.session.get()
            if last // 1000 + self.gap_ms < expiredTimerInfo.getExpiryTimeInMs():
                lines.append((last, self.idle, requests, list(sums)))
                self.session.clear()
                self.expected.clear()
        yield self._frame(key, lines)

    def close(self) -> None:
        pass


class BucketLines(SessionLines):
    """The open sessions of all keys of a bucket as one state, with one timer at the first of their ends: a call, and its round trips to the store, serve all requests of a bucket in a trigger."""

    def __init__(self, gap_ms: int, sums: list[str], every: int, idle: str, names: list[str]):
        super().__init__(gap_ms, sums, every, idle)
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        keys = ", ".join(f"{n} array<string>" for n in self.names)
        self.state = handle.getValueState("open", f"timer long, {keys}, first array<long>, last array<long>, requests array<long>, sums array<array<long>>, expected array<long>")

    def _load(self):
        """The timer that is set, and the open sessions by key."""
        if not self.state.exists():
            return None, {}
        timer, *columns = self.state.get()
        n = len(self.names)
        return timer, {tuple(r[:n]): (*r[n : n + 3], list(r[n + 3]), r[n + 4]) for r in zip(*columns, strict=True)}

    def _store(self, timer, before, opened) -> None:
        """timer: the one that is set; before: whether there is a state."""
        due = min((s[1] for s in opened.values()), default=None)
        due = None if due is None else due // 1000 + self.gap_ms + 1
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        if opened:
            self.state.update((due, *(list(c) for c in zip(*((*k, *s) for k, s in opened.items()), strict=True))))
        elif before:
            self.state.clear()

    def _lines(self, lines):
        """lines: the key, and ts, line, requests, sums of each of its lines."""
        if lines:
            keys, at, line, requests, sums = zip(*((k, *x) for k, some in lines for x in some), strict=True)
            columns = {f"k{i}": c for i, c in enumerate(zip(*keys, strict=True))} | {"ts": pd.to_datetime(list(at), unit="us"), "line": line, "requests": requests}
            yield pd.DataFrame(columns | dict(zip(self.sums, zip(*sums, strict=True), strict=True)))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        timer, opened = self._load()
        before, n, lines = bool(opened), len(self.names), {}
        came = []
        for f in rows:
            at = f["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
            came += zip(at, *(f[c].tolist() for c in ["arrival", *self.names, "known", *self.sums]), strict=True)
        for r in sorted(came, key=lambda r: r[:2]):
            k = r[2 : n + 2]
            now = self._step(opened.get(k), r[0], r[n + 2], r[n + 3 :], lines.setdefault(k, []))
            if now:
                opened[k] = now
            else:
                opened.pop(k, None)
        self._store(timer, before, opened)
        yield from self._lines([x for x in lines.items() if x[1]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        timer, opened = self._load()
        passed = timerValues.getCurrentWatermarkInMs()
        ended = {k: s for k, s in opened.items() if s[1] // 1000 + self.gap_ms + 1 < passed}
        self._store(timer, bool(opened), {k: s for k, s in opened.items() if k not in ended})
        yield from self._lines([(k, [(s[1], self.idle, s[2], s[3])]) for k, s in ended.items()])


def session_lines(events: DataFrame, gap_seconds: int, key: list[str], sums: dict[str, str], every: int = 0, expected: str | None = None, idle: str = "completed", order: str = "event_id", buckets: int = 0) -> DataFrame:
    """A stream's session lines: started, progress at every so many requests, loaded as soon as the expected number is there, and the idle line after more than the gap; with time, requests and sums so far.

    events: a stream with ts and its watermark. Rows of one trigger go by ts and order; earlier ones than the watermark are dropped. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass); a session's state goes with its idle line.

    buckets: into how many states the open sessions are dealt by a hash of their key; 0 gives each its own. A trigger reads and writes the whole buckets that it touches: buckets are for triggers with
    requests of many sessions, where a call for each costs far more than its requests; states of their own are for small triggers beside many open sessions. A checkpoint keeps its number.
    """
    names = [f"k{i}" for i in range(len(key))]
    schema = ", ".join(f"{n} string" for n in names) + ", ts timestamp, line string, requests long" + "".join(f", {s} long" for s in sums)
    known = F.col(expected).cast("long") if expected else F.lit(None).cast("long")
    rows = events.select(*(F.col(k).cast("string").alias(n) for k, n in zip(key, names, strict=True)), "ts", F.col(order).alias("arrival"), known.alias("known"), *(F.coalesce(F.expr(e).cast("long"), F.lit(0).cast("long")).alias(s) for s, e in sums.items()))
    if buckets:
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)))
        out = dealt.groupBy("bucket").transformWithStateInPandas(BucketLines(gap_seconds * 1000, list(sums), every, idle, names), schema, "append", "EventTime")
    else:
        out = rows.groupBy(*names).transformWithStateInPandas(SessionLines(gap_seconds * 1000, list(sums), every, idle), schema, "append", "EventTime")
    return out.select(*(F.col(n).alias(k) for k, n in zip(key, names, strict=True)), "ts", "line", "requests", *sums)
