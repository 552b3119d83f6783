"""Queries for table changes, integrity, session twins and arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrays as R
from ..operators import integrity as I
from ..operators import lifecycle as L
from ..operators import usercode as U
from ..session import cut
from ..sources.views import ARRIVAL
from ..streaming import jobs, sessions
from .registry import query
from .relations import SR, order

KEPT = ["sop_uid", "series_uid", "study_uid", "blob_hash", "file_size"]
stored = lambda v: v("v_instances").where("seq <= 2").select(*KEPT)
query(
    "chg_merge_ingest",
    lambda v: L.merge_ingest(stored(v), v("v_arrivals"), "sop_uid", order()),
    f", s as (select {', '.join(KEPT)} from v_instances where seq <= 2) select * from s union all select {', '.join(KEPT)} from v_arrivals where sop_uid not in (select sop_uid from s) qualify row_number() over (partition by sop_uid order by {ARRIVAL}) = 1",
)
query(
    "chg_replace_ingest",
    lambda v: L.replace_ingest(stored(v), v("v_arrivals"), "sop_uid", order(), fill=["series_uid"]),
    f""", s as (select {', '.join(KEPT)} from v_instances where seq <= 2), n as (select {', '.join(KEPT)} from v_arrivals qualify row_number() over (partition by sop_uid order by {ARRIVAL.replace(',', ' desc,')} desc) = 1)
      select coalesce(s.sop_uid, n.sop_uid) as sop_uid, coalesce(s.series_uid, n.series_uid) as series_uid, coalesce(n.study_uid, s.study_uid) as study_uid, coalesce(n.blob_hash, s.blob_hash) as blob_hash, coalesce(n.file_size, s.file_size) as file_size from s full join n using (sop_uid)""",
)
# whole archives: early studies are stored, the odd ones arrive again with another description, the late ones for the first time
STORED, COMING = "arrived_at < timestamp '1997-01-01'", "cast(substring(study_uid, 5) as bigint) % 2 = 1"


def _archives(v):
    studies = v("v_studies").select("study_uid", "study_description", F.col("arrived_at").cast("timestamp").alias("arrived_at"))
    # both archives take their rows from one table written once, so the views' windows run once
    all_series, all_instances = cut(v("v_series").select("series_uid", "study_uid", "modality", "body_part", "seq"), "series"), cut(v("v_instances").select("sop_uid", "series_uid", "study_uid", "file_size"), "instances")
    series, instances = (lambda some, t=t: t.join(some.select("study_uid"), "study_uid", "left_semi").select(t.columns) for t in (all_series, all_instances))
    old, new = studies.where(STORED), studies.where(COMING).withColumns({"study_description": F.concat(F.lit("new "), "study_description"), "arrived_at": F.expr("arrived_at + interval 30 days")})
    stored = {"studies": old, "series": series(old).withColumn("body_part", F.expr("nullif(body_part, 'HEAD')")), "instances": instances(old).where("file_size > 10000")}
    incoming = {"studies": new, "series": series(new), "instances": instances(new).withColumn("file_size", F.col("file_size") + 1)}
    return stored, incoming, {"studies": [F.col("arrived_at")], "series": [F.col("seq")], "instances": [F.col("sop_uid")]}


_whole = lambda rule: lambda v: rule(*_archives(v))
ARCHIVE = f""", o as (select study_uid, study_description, cast(arrived_at as timestamp) as arrived_at from v_studies where {STORED}), n as (select study_uid, 'new ' || study_description as study_description, cast(arrived_at as timestamp) + interval 30 days as arrived_at from v_studies where {COMING}),
  os as (select series_uid, study_uid, modality, nullif(body_part, 'HEAD') as body_part, seq from v_series where study_uid in (select study_uid from o)), ns as (select series_uid, study_uid, modality, body_part, seq from v_series where study_uid in (select study_uid from n)),
  oi as (select sop_uid, series_uid, study_uid, file_size from v_instances where study_uid in (select study_uid from o) and file_size > 10000), ni as (select sop_uid, series_uid, study_uid, file_size + 1 as file_size from v_instances where study_uid in (select study_uid from n)),
  {{0}}, c as (select study_uid, sum(k) as series_count, string_agg(modality, ',' order by seq, modality) as modalities_in_study from (select study_uid, modality, count(*) as k, min(seq) as seq from s group by all) group by all), b as (select study_uid, count(*) as instance_count, sum(file_size) as total_bytes from i group by all)
  select d.*, coalesce(series_count, 0) as series_count, coalesce(instance_count, 0) as instance_count, coalesce(modalities_in_study, '') as modalities_in_study, coalesce(total_bytes, 0) as total_bytes from d left join c using (study_uid) left join b using (study_uid)"""
_either = lambda k, a, b: f"{k} as (select * from {a} union all select * from {b} where {{0}} not in (select {{0}} from {a}))"
query(
    "chg_merge_archive", lambda v: _whole(L.merge_archive)(v)["studies"],
    ARCHIVE.format(f"d as (select coalesce(o.study_uid, n.study_uid) as study_uid, coalesce(o.study_description, n.study_description) as study_description, greatest(o.arrived_at, n.arrived_at) as arrived_at from o full join n using (study_uid)), {_either('s', 'os', 'ns').format('series_uid')}, {_either('i', 'oi', 'ni').format('sop_uid')}"),
)
query(
    "chg_replace_archive", lambda v: _whole(L.replace_archive)(v)["studies"],
    ARCHIVE.format(f"d as (select coalesce(n.study_uid, o.study_uid) as study_uid, coalesce(n.study_description, o.study_description) as study_description, coalesce(n.arrived_at, o.arrived_at) as arrived_at from o full join n using (study_uid)), {_either('s', 'os', 'ns').format('series_uid')}, {_either('i', 'ni', 'oi').format('sop_uid')}"),
)
query(
    "chg_replace_archive_series", lambda v: _whole(L.replace_archive)(v)["series"],
    ARCHIVE.split("{0}")[0].rstrip(", \n") + " select coalesce(os.series_uid, ns.series_uid) as series_uid, coalesce(os.study_uid, ns.study_uid) as study_uid, coalesce(os.modality, ns.modality) as modality, coalesce(os.body_part, ns.body_part) as body_part, coalesce(os.seq, ns.seq) as seq from os full join ns using (series_uid)",
)
#: Up to three notes an instance: of the weaker codes, of one that is not enabled, and strict ones.
NOTES = """select sop_uid, case seq % 3 when 0 then 113001 when 1 then 113037 else 113039 end as code from v_instances where seq <= 3
  union all select sop_uid, case file_size % 3000 when 0 then 113038 when 1000 then 113001 else 113037 end from v_instances where file_size % 4000 <> 0 union all select sop_uid, 113039 from v_instances where frames = 2"""
ENABLED = [113037, 113038]


def _notes(v):
    weak = "case when seq <= 3 then case seq % 3 when 0 then 113001 when 1 then 113037 else 113039 end end"
    more = "case when file_size % 4000 <> 0 then case file_size % 3000 when 0 then 113038 when 1000 then 113001 else 113037 end end"
    return v("v_instances").select("sop_uid", F.explode(F.expr(f"array_compact(array({weak}, {more}, case when frames = 2 then 113039 end))")).alias("code"))


# What holds after all notes: the highest strict code, else the lowest one on a visible instance, else what was there.
query(
    "chg_reject",
    lambda v: L.reject(v("v_instances").select("sop_uid", "sop_class", "reason"), _notes(v), [SR], ENABLED).select("sop_uid", "reason", "changed"),
    f""", n as ({NOTES}),
      g as (select sop_uid, min(code) as low, max(code) filter (code in (113037, 113038)) as strict, count(distinct code) filter (code in (113037, 113038)) as kinds from n join v_instances using (sop_uid)
        where case when code = 113001 then sop_class = '{SR}' else code in (113037, 113038) end group by sop_uid)
      select sop_uid, coalesce(strict, case when reason = 0 then low end, reason) as reason, low is not null and (reason = 0 or kinds > 1 or (kinds = 1 and strict <> reason)) as changed from v_instances left join g using (sop_uid)""",
)
query("chg_restore", lambda v: L.restore(v("v_instances").select("sop_uid", "reason"), v("v_instances").where("seq = 1")), ", n as (select sop_uid from v_instances where seq = 1) select sop_uid, case when sop_uid in (from n) then 0 else reason end as reason, sop_uid in (from n) and reason <> 0 as changed from v_instances")
query("chg_refuse_hidden", lambda v: L.refuse_hidden(v("v_arrivals"), v("v_instances")).select("sop_uid", "a1", "a2", "a3"), "select sop_uid, a1, a2, a3 from v_arrivals where sop_uid in (select sop_uid from v_instances where reason in (113037, 113038))")
gone = lambda v: v("v_studies").where("study_description = '1-URGENT'")
GONE = "(select study_uid from v_studies where study_description = '1-URGENT')"
query(
    "chg_delete",
    lambda v: L.delete(v("v_instances"), gone(v))[0],
    f"select count(*) as instances, sum(file_size) as bytes, (select count(distinct blob_hash) from v_instances where study_uid in {GONE} and blob_hash in (select blob_hash from v_instances where study_uid not in {GONE})) as shared_blobs from v_instances where study_uid in {GONE}",
)
query(
    "chg_delete_series",
    lambda v: L.delete(v("v_instances").withColumn("refs", F.array(F.expr("study_uid || '.A'"))), v("v_series").where("modality = 'CT' and seq = 1"), "series", [SR])[1].select("sop_uid"),
    f", g as (select series_uid from v_series where modality = 'CT' and seq = 1) select sop_uid from v_instances where series_uid not in (from g) and not (sop_class = '{SR}' and study_uid || '.A' in (from g))",
)
query(
    "chg_delete_instances",
    lambda v: L.delete(v("v_instances").withColumn("refs", F.array(F.expr("study_uid || '.1'"))), v("v_instances").where("seq = 1"), "instance", [SR])[0],
    f""", g as (select sop_uid from v_instances where seq = 1), d as (select * from v_instances where sop_uid in (from g) or (sop_class = '{SR}' and study_uid || '.1' in (from g)))
      select count(*) as instances, sum(file_size) as bytes, (select count(distinct blob_hash) from d where blob_hash in (select blob_hash from v_instances where sop_uid not in (select sop_uid from d))) as shared_blobs from d""",
)
query("chg_delete_tombstones", lambda v: L.delete(v("v_instances"), v("v_series").where("modality = 'CT'"), "series")[2], ", g as (select series_uid from v_series where modality = 'CT') select distinct study_uid from v_instances where series_uid in (from g) and study_uid not in (select study_uid from v_instances where series_uid not in (from g))")
query("chg_delete_remaining", lambda v: L.delete(v("v_instances"), gone(v))[1].select("sop_uid"), f"select sop_uid from v_instances where study_uid not in {GONE}")
query(
    "chg_tier_plan",
    lambda v: L.tier_plan(v("v_instances"), v("v_studies"), ["hot"], 19980101, v("v_instances").where("seq = 4"), 500),
    "select blob_hash, min(study_date) as study_date from v_instances join v_studies using (study_uid) where tier = 'hot' and study_date < 19980101 and blob_hash not in (select blob_hash from v_instances where seq = 4) group by blob_hash order by study_date, blob_hash limit 500",
)
query(
    "chg_tier_patients",
    lambda v: L.tier_patients(v("v_instances"), v("v_studies"), 20010101),
    """, e as (select patient_id, min(study_date) as earliest from v_studies where patient_id <> '' group by patient_id having bool_and(coalesce(study_date < 20010101, false)))
      select e.patient_id, earliest, count(distinct blob_hash) as blobs from v_instances i join v_studies s on i.study_uid = s.study_uid join e on s.patient_id = e.patient_id where i.tier = 'hot' group by e.patient_id, earliest""",
)
query(
    "chg_tier_emergency",
    lambda v: L.tier_emergency(v("v_instances").where("tier = 'hot'").join(v("v_studies"), "study_uid").where("study_date is not null").groupBy("blob_hash").agg(F.min("study_date").alias("study_date"), F.max("file_size").alias("size")), 3_000_000),
    ", b as (select blob_hash, min(study_date) as study_date, max(file_size) as size from v_instances join v_studies using (study_uid) where tier = 'hot' and study_date is not null group by blob_hash) select * from (select *, coalesce(sum(size) over (order by study_date, blob_hash rows between unbounded preceding and 1 preceding), 0) as preceding from b) where preceding < 3000000",
)
query(
    "chg_tier_flip", lambda v: L.tier_flip(v("v_instances").select("sop_uid", "blob_hash", "tier"), v("v_instances").where("seq = 1"), "cold"),
    ", h as (select blob_hash from v_instances where seq = 1) select sop_uid, blob_hash, case when blob_hash in (from h) then 'cold' else tier end as tier, blob_hash in (from h) and tier <> 'cold' as changed from v_instances",
)
query("chg_expire_workitems", lambda v: L.expire_workitems(v("v_workitems"), "2000-01-01 00:00:00", 365, locked_at="1999-12-30 00:00:00").select("workitem_uid"), "select workitem_uid from v_workitems where state in ('COMPLETED', 'CANCELED') and updated_at < timestamp '2000-01-01' - interval 365 days")
query("chg_expire_off", lambda v: L.expire_workitems(v("v_workitems"), "2000-01-01 00:00:00", 0).select("workitem_uid"), "select workitem_uid from v_workitems where false")
#: Starts two years later, some without a date, with an impossible one, without time, with an hour only, with a fraction, with a time that can't be read; stamps from change or creation, some without either.
START = {
    "start_date": "case when start_date % 10 = 1 then null when start_date % 10 = 2 then '19991340' else cast(start_date + 20000 as string) end",
    "start_time": "case start_date % 7 when 0 then null when 1 then '23' when 2 then '235959.5' when 3 then 'noon' when 4 then '2359' else start_time end",
    "updated_at": "case when start_date % 3 = 0 then null else updated_at end", "created_at": "case when start_date % 9 = 0 then null else created_at end",
}
query(
    "chg_expire_worklist",
    lambda v: L.expire_worklist(v("v_worklist").select("sps_uid", *(F.expr(e).alias(c) for c, e in START.items())), "1999-12-31 23:59:59", 30).select("sps_uid"),
    f""", r as (select sps_uid, {", ".join(f"{e} as {c}" for c, e in START.items())} from v_worklist),
      t as (select sps_uid, coalesce(updated_at, created_at) as stamp, try_strptime(start_date || case when start_time is null then '000000' when start_time = '23' then '230000' when start_time like '235959%' then '235959'
        when start_time = 'noon' then null else start_time || '00' end, '%Y%m%d%H%M%S') as start from r)
      select sps_uid from t where stamp is not null and greatest(stamp, coalesce(start, stamp)) < timestamp '1999-12-01 23:59:59'""",
)
steps = lambda v: v("v_workitems").select(F.col("workitem_uid").alias("mpps_uid"), F.expr("case state when 'COMPLETED' then 'COMPLETED' when 'SCHEDULED' then 'DISCONTINUED' else 'IN PROGRESS' end").alias("status"), F.expr("cast(revision as int)").alias("series_count"), F.col("priority").alias("description"), "updated_at")
STEPS = "(select workitem_uid as mpps_uid, case state when 'COMPLETED' then 'COMPLETED' when 'SCHEDULED' then 'DISCONTINUED' else 'IN PROGRESS' end as status, revision as series_count, priority as description, updated_at from v_workitems)"
query("chg_expire_steps", lambda v: L.expire_steps(steps(v), "2000-01-01 00:00:00", 10).select("mpps_uid"), f"select mpps_uid from {STEPS} where status <> 'IN PROGRESS' and updated_at < timestamp '1999-12-22'")
query(
    "chg_expire_commitments", lambda v: L.expire_commitments(v("v_workitems").select("workitem_uid", F.expr("case when revision = 0 then 'bad' else cast(created_at as string) end").alias("requested_at")), "2000-01-01 00:00:00", 10).select("workitem_uid"),
    "select workitem_uid from v_workitems where revision <> 0 and created_at < timestamp '1999-12-22'",
)
query("chg_prune_journal", lambda v: L.prune_journal(v("v_access").select(F.to_date("ts").alias("day")).distinct(), "day", "2024-01-20", 7).select(F.col("day").cast("string").alias("day")), "select distinct cast(cast(ts as date) as varchar) as day from v_access where date '2024-01-20' - cast(ts as date) > 7")
CHANGES = "select workitem_uid, x.n as arrival, revision + case when revision = 3 then 1 else 0 end as expected_revision, case when revision = 2 then 'T9' else transaction_uid end as transaction_uid, case when x.n = 1 then 'COMPLETED' else 'CANCELED' end as state from v_workitems cross join {} where x.n = 1 or revision = 1"
query(
    "chg_workitem_update",
    lambda v: L.workitem_update(
        v("v_workitems"),
        v("v_workitems").select("workitem_uid", F.explode(F.expr("case when revision = 1 then array(1, 2) else array(1) end")).alias("arrival"), F.expr("revision + case when revision = 3 then 1 else 0 end").alias("expected_revision"), F.expr("case when revision = 2 then 'T9' else transaction_uid end").alias("transaction_uid")).withColumn("state", F.expr("case when arrival = 1 then 'COMPLETED' else 'CANCELED' end")),
    ).select("workitem_uid", "arrival", "refused", "revision"),
    f""", c as ({CHANGES.format('(values (1), (2)) x(n)')}) select c.workitem_uid, arrival, case when arrival > 1 then 'later in batch' when expected_revision <> revision then 'revision' when w.transaction_uid is not null and c.transaction_uid is distinct from w.transaction_uid then 'transaction'
      when w.state = 'SCHEDULED' then 'transition' end as refused, case when not (arrival > 1 or expected_revision <> revision or (w.transaction_uid is not null and c.transaction_uid is distinct from w.transaction_uid) or w.state = 'SCHEDULED') then revision + 1 end as revision from c join v_workitems w using (workitem_uid)""",
)
query(
    "chg_step_update",
    lambda v: L.step_update(steps(v), steps(v).select("mpps_uid", F.lit("COMPLETED").alias("status"), F.lit(None).cast("int").alias("series_count"), F.lit("done").alias("description"))).select("mpps_uid", "status", "description", "refused"),
    f"select mpps_uid, case when status = 'IN PROGRESS' and series_count > 0 then 'COMPLETED' else status end as status, case when status = 'IN PROGRESS' and series_count > 0 then 'done' else description end as description, case when status <> 'IN PROGRESS' then 'final' when series_count = 0 then 'no series' end as refused from {STEPS}",
)
query(
    "chg_readiness_regress", lambda v: L.readiness_regress(v("v_workitems"), v("v_series").where("seq = 1")).select("workitem_uid", "readiness", "changed"),
    ", g as (select study_uid from v_series where seq = 1) select workitem_uid, case when study_uid in (from g) and readiness = 'READY' and state = 'SCHEDULED' then 'INCOMPLETE' else readiness end as readiness, study_uid in (from g) and readiness = 'READY' and state = 'SCHEDULED' as changed from v_workitems",
)
# integrity
named = lambda v: v("documents").select("doc_id", F.expr("case when doc_id % 9 = 0 then sha2('x', 256) else sha2(text, 256) end").alias("blob_hash"), F.col("text").cast("binary").alias("content"))
# every document's blob, each stored once under its expected name: some names are of other content, some blobs have no content, some are asked for under a name that is not stored
blobs = lambda v: named(v).select("blob_hash", F.expr("case when doc_id % 7 = 0 then null else content end").alias("content"), "doc_id").withColumn("blob_hash", F.expr("case when doc_id % 9 = 0 then sha2(concat('wrong', doc_id), 256) else blob_hash end"))
once = lambda b: b.groupBy("blob_hash").agg(F.min_by("content", F.struct(F.col("content").isNull(), "doc_id")).alias("content"))
asked = lambda v: blobs(v).select(F.expr("case when doc_id % 5 = 0 then sha2(concat('lost', doc_id), 256) else blob_hash end").alias("blob_hash")).unionByName(blobs(v).select("blob_hash"))
VERIFIED = """with n as (select doc_id, case when doc_id % 9 = 0 then sha256('wrong' || doc_id) else sha256(text) end as h, case when doc_id % 7 = 0 then null else text end as content from documents),
      b as (select h as blob_hash, content from n qualify row_number() over (partition by h order by content is null, doc_id) = 1), a as (select h as blob_hash from n union select sha256('lost' || doc_id) from n where doc_id % 5 = 0)
      select a.blob_hash, case when b.blob_hash is null then 'gone' when content is null then 'unreadable' when sha256(content) = a.blob_hash then 'ok' else 'mismatch' end as verdict from a left join b using (blob_hash)"""
query("int_verify_each", lambda v: I.verify(once(blobs(v)), asked(v)), VERIFIED)
query("int_verify", lambda v: I.verify(once(blobs(v)), asked(v)).groupBy("verdict").agg(F.count("*").alias("n")), f"select verdict, count(*) as n from ({VERIFIED}) group by verdict")
query(
    "int_reconcile", lambda v: I.reconcile(v("v_series"), v("v_series").where("seq <= 2"), ["modality", "study_uid"])[1],
    "select (select count(*) from (select distinct modality, study_uid from v_series)) as scanned, (select count(*) from (select modality, study_uid from v_series except select modality, study_uid from v_series where seq <= 2)) as added",
)
query("int_corrupt_report", lambda v: I.corrupt_report(v("v_workitems").withColumn("_corrupt_record", F.expr("case when revision = 4 then 'x' end"))), "select count(*) as scanned, count(*) filter (revision = 4) as corrupt from v_workitems")
# batch twins of the streams
# access sessions: numbers that become known late, change and stay absent; the SQL goes from row to row
EXPECTED = "cast(case when event_id % 4 = 0 then event_id % 3 + 1 end as bigint)"
WALK = f""", x as (select event_id, ts, user_name, src_ip, study, series, status, bytes, us, {EXPECTED} as expected, row_number() over (partition by user_name, src_ip, study, series order by ts, event_id) as k from v_access),
  walk as (select * from (with recursive r as (
    select *, true as fresh, 1 as session, ts as started, 1::bigint as requests, (status >= 400)::bigint as bad, bytes as size, us as took, expected as e, coalesce(expected <= 1, false) as done from x where k = 1
    union all
    select x.*, f, r.session + f::int, case when f then x.ts else r.started end, case when f then 1 else r.requests + 1 end, case when f then 0 else r.bad end + (x.status >= 400)::bigint, case when f then 0 else r.size end + x.bytes,
      case when f then 0 else r.took end + x.us, case when f then x.expected else coalesce(r.e, x.expected) end, coalesce(case when f then 1 else r.requests + 1 end >= case when f then x.expected else coalesce(r.e, x.expected) end, false)
    from r join x on x.user_name = r.user_name and x.src_ip = r.src_ip and x.study = r.study and x.series = r.series and x.k = r.k + 1, lateral (select r.done or epoch_us(x.ts) - epoch_us(r.ts) > 21600000000 as f)
  ) select * from r)),
  ended as (select *, coalesce(lead(fresh) over (partition by user_name, src_ip, study, series order by k), true) as last from walk)
"""
SESSION = WALK + "select user_name, src_ip, study, series, started, ts as ended, requests as fetched, bad as failed, size as bytes, took as us, case when done then 'loaded' else 'partial' end as state from ended where last"
accesses = lambda v: v("v_access").withColumn("expected", F.expr(EXPECTED))
query("st_access_sessions", lambda v: sessions.access_sessions(accesses(v), 6 * 3600), SESSION)
query("st_access_sessions_pieces", lambda v: sessions.access_sessions(accesses(v), 6 * 3600, piece=2), SESSION)


def _gaps(keys: str, seconds: int, select: str) -> str:
    return f""", a as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by {keys} order by ts, event_id) <= {seconds}000000 then 0 else 1 end as n from v_access), b as (select *, sum(n) over (partition by {keys} order by ts, event_id) as s from a)
      select {keys}, {select} from b group by {keys}, s"""


stores = lambda v: v("v_access").withColumn("status", F.expr("case when status = 404 then 409 else status end"))
query(
    "st_ingest_events", lambda v: sessions.ingest_events(v("v_access"), 21600, 3, key=["study"]).select("study", "event_id", "requests", "line"),
    """, a as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by study order by ts, event_id) <= 21600000000 then 0 else 1 end as n from v_access), b as (select *, sum(n) over (partition by study order by ts, event_id) as s from a),
      c as (select *, row_number() over (partition by study, s order by ts, event_id) as requests, count(*) over (partition by study, s) as whole from b)
      select study, event_id, requests, line from c, (values ('started'), ('progress'), ('completed')) l(line) where case line when 'started' then requests = 1 when 'progress' then requests % 3 = 0 else requests = whole end""",
)
query(
    "st_ingest_sessions", lambda v: sessions.ingest_sessions(stores(v), "21600 seconds").drop("progress"),
    _gaps("study, user_name, src_ip", 21600, "min(ts) as started, max(ts) + interval 6 hours as idle_at, count(*) as requests, count(*) filter (status < 300) as stored, count(*) filter (status = 302) as idempotent, count(*) filter (status = 503) as failed, count(*) filter (status = 404) as conflicts, sum(bytes) as bytes"),
)
query("st_readiness", lambda v: sessions.readiness(v("v_access"), "3600 seconds"), _gaps("study", 3600, "max(ts) + interval 1 hour as ready_at, count(*) as arrivals"))
query(
    "st_anonymous_rate", lambda v: sessions.anonymous_rate(v("v_access"), "60 minutes", "1 minute"),
    "select m as start, m + interval 60 minutes as stop, count(*) as requests from (select unnest(list_transform(range(60), lambda i: date_trunc('minute', ts) - to_minutes(i))) as m from v_access where who = '') group by m",
)
query("st_counters", lambda v: jobs.counters(v("v_access")), "select route, case status // 100 when 4 then '4xx' when 5 then '5xx' else '2xx' end as class, count(*) as requests from v_access group by all")
# arrays: samples in thousandths, multiplied in the column's own single precision (an integer literal would make it double where spark.sql.ansi.enabled is set, and move halves)
pix = lambda v: v("embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x * F.lit(1000).cast("float")).cast("int")).alias("a"))
PIX = "(select vec_id, list_transform(embedding, lambda x: cast(round(x * 1000) as int)) as a from embeddings)"
flat = lambda c, name="a": F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(name)
query("arr_rescale", lambda v: pix(v).select("vec_id", flat(F.transform(R.rescale(F.col("a"), 2, -1024), lambda x: x.cast("long")))), f"select vec_id, case when a is not null then coalesce(array_to_string(list_transform(a, lambda x: x * 2 - 1024), ','), '') end as a from {PIX}")
WIN = "least(255.0::double, greatest(0.0::double, (x - (40 - 200 / 2)) / 200 * 255))"
query("arr_window", lambda v: pix(v).select("vec_id", flat(R.window(F.col("a"), 40, 200)), flat(R.window(F.col("a"), 40, 200, True), "b")), f"select vec_id, array_to_string(list_transform(a, lambda x: cast(trunc({WIN}) as int)), ',') as a, array_to_string(list_transform(a, lambda x: cast(trunc(255 - {WIN}) as int)), ',') as b from {PIX}")
query("arr_minmax", lambda v: pix(v).select("vec_id", flat(R.minmax(F.col("a")))), f"select vec_id, array_to_string(list_transform(a, lambda x: case when list_max(a) = list_min(a) then 128 else cast(trunc(cast(x - list_min(a) as double) / (list_max(a) - list_min(a)) * 255) as int) end), ',') as a from {PIX}")
query("arr_threshold", lambda v: R.threshold(pix(v), "vec_id", F.col("a"), 50).select("vec_id", "above", "share"), f"select vec_id, len(list_filter(a, lambda x: x > 50)) as above, len(list_filter(a, lambda x: x > 50)) / len(a) as share from {PIX}")


def _area(to_width: int, to_height: int) -> None:
    """Vectors as images of 7 columns (what is left over is cut off), to a smaller and to a larger image."""
    image = lambda v: pix(v).select("vec_id", F.transform("a", lambda x: x + 5000).alias("a"), F.floor(F.size("a") / 7).cast("int").alias("h"))
    query(
        f"arr_downsample_{to_width}x{to_height}",
        lambda v: image(v).select("vec_id", flat(R.downsample_2d(F.col("a"), F.lit(7), F.col("h"), to_width, to_height))),
        f"""with v as (select row_number() over () as row, vec_id, a, len(a) // 7 as h from {PIX}),
          p as (select row, h, (i - 1) // 7 as sy, (i - 1) % 7 as sx, cast(a[i] + 5000 as bigint) as p from (select row, h, a, unnest(range(1, len(a) + 1)) as i from v)),
          c as (select row, y, x, sum(p) + count(*) // 2 as s, count(*) as n, count(p) as known from p
            join (select unnest(range({to_height})) as y) on sy >= y * h // {to_height} and sy < least(greatest((y + 1) * h // {to_height}, y * h // {to_height} + 1), h)
            join (select unnest(range({to_width})) as x) on sx >= x * 7 // {to_width} and sx < least(greatest((x + 1) * 7 // {to_width}, x * 7 // {to_width} + 1), 7)
            group by row, y, x),
          m as (select row, y, x, case when known = n then cast((s - (s % n + n) % n) // n as bigint) end as m from c)
          select vec_id, case when h > 0 then coalesce(string_agg(m, ',' order by y, x), '') else '{",".join(["0"] * to_width * to_height)}' end as a from v left join m using (row) group by row, vec_id, h""",
    )


_area(3, 2)
_area(11, 4)
query("arr_downsample", lambda v: pix(v).select("vec_id", flat(R.downsample(F.transform("a", lambda x: x + 5000), 7))), f"select vec_id, array_to_string(list_transform(range(7), lambda i: (coalesce(list_sum(p[(i * len(p)) // 7 + 1 : greatest(((i + 1) * len(p)) // 7, (i * len(p)) // 7 + 1)]), 0) + (greatest(((i + 1) * len(p)) // 7, (i * len(p)) // 7 + 1) - (i * len(p)) // 7) // 2) // (greatest(((i + 1) * len(p)) // 7, (i * len(p)) // 7 + 1) - (i * len(p)) // 7)), ',') as a from (select vec_id, list_transform(a, lambda x: cast(x + 5000 as bigint)) as p from {PIX})")
query(
    "arr_to_patient", lambda v: pix(v).select("vec_id", R.to_patient(F.get("a", F.lit(0)), F.get("a", F.lit(1)), F.expr("array(1d, 2d, 3d)"), F.expr("array(1d, 0d, 0d, 0d, 0d, -1d)"), F.expr("array(0.5d, 2d)")).alias("p")).select("vec_id", *(F.get("p", F.lit(i)).alias(n) for i, n in enumerate("xyz"))),
    f"select vec_id, 1 + 2.0 * a[1] as x, 2.0 as y, 3 - 0.5 * a[2] as z from {PIX}",
)
query("arr_contours", lambda v: R.contours(pix(v).select(F.col("vec_id").alias("roi"), F.expr("array(array(array(cast(a[0] as double), 1d, 2d), array(cast(a[1] as double), 3d, 4d)), array(array(cast(a[2] as double), 5d, 6d)))").alias("contours"))), f"select vec_id as roi, c as contour, case when c = 0 then 2 else 1 end as points, n, cast(a[c * 2 + n + 1] as double) as x, cast(1 + 2 * (c * 2 + n) as double) as y, cast(2 + 2 * (c * 2 + n) as double) as z from {PIX}, (values (0, 0), (0, 1), (1, 0)) t(c, n)")


# user code: a study's bytes times a factor, and a frame's count times ten
def _bytes(pdf, p):
    return [(pdf["study_uid"].iat[0], int(pdf["file_size"].sum()) * p["factor"])]


query("udf_per_study", lambda v: U.per_study(v("v_instances").select("study_uid", "file_size"), _bytes, "study_uid string, total long", {"factor": 2}, factor=3), "select study_uid, cast(sum(file_size) * 3 as bigint) as total from v_instances group by study_uid")
query("udf_per_frame", lambda v: U.per_frame(v("v_instances").select("sop_uid", "frames"), lambda d: d.assign(frames=d["frames"] * 10), "sop_uid string, frames long"), "select sop_uid, frames * 10 as frames from v_instances")
results = lambda v: v("v_instances").select("study_uid", F.col("frames").alias("frame"), F.expr("case when seq % 5 = 0 then array() when seq % 5 = 1 then array(1) else array(1, 0, 1) end").alias("mask"))
size = lambda v: v("v_studies").select("study_uid", F.lit(3).alias("n_frames"), F.lit(3).alias("mask_size"))
query(
    "udf_result_check", lambda v: U.result_check(results(v), size(v))[1].groupBy("refused").agg(F.count("*").alias("n")),
    "select case when s.study_uid is null then 'unknown study' when frames not between 1 and 3 then 'frame out of range' when seq % 5 = 0 then 'empty' else 'incomplete mask' end as refused, count(*) as n from v_instances i left join v_studies s using (study_uid) where s.study_uid is null or frames not between 1 and 3 or seq % 5 in (0, 1) group by 1",
)
