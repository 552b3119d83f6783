"""Queries for joins, aggregations and window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import analytic as W
from ..operators import joins as J
from ..sources.views import ARRIVAL
from .registry import query
from .searches import TOTALS



def order():
    return [F.col(c.strip()) for c in ARRIVAL.split(",")]


# joins
query("jn_sop_owner", lambda v: J.owner(v("v_commitments").select("sop_uid", "position"), v("v_instances"), "sop_uid"), "select sop_uid, position, study_uid as owner_study from v_commitments left join v_instances using (sop_uid)")
query("jn_series_owner", lambda v: J.owner(v("v_arrivals").select("series_uid").distinct(), v("v_series"), "series_uid"), "select distinct series_uid, s.study_uid as owner_study from v_arrivals left join v_series s using (series_uid)")
query(
    "jn_commit_presence",
    lambda v: J.commit_presence(v("v_commitments"), v("v_instances")).select("transaction_uid", "sop_uid", "position", "found"),
    "select c.transaction_uid, c.sop_uid, c.position, i.sop_uid is not null as found from v_commitments c left join v_instances i on c.sop_uid = i.sop_uid and (c.study_hint is null or c.study_hint = i.study_uid)",
)
query(
    "jn_covered_studies",
    lambda v: J.covered_studies(v("v_instances"), v("v_commitments")),
    "select study_uid, count(*) as instances from v_instances group by study_uid having count(*) filter (sop_uid not in (select sop_uid from v_commitments)) = 0",
)
REFS = "(select blob_hash, owner from v_blobs where doc_id % 5 <> 0)"
refs = lambda v: v("v_blobs").where("doc_id % 5 <> 0").select("blob_hash", F.col("owner").alias("study_uid"), "tier")
query("jn_orphan_blobs", lambda v: J.orphan_blobs(v("v_blobs"), refs(v)).select("path", "blob_hash"), f"select path, blob_hash from v_blobs where blob_hash not in (select blob_hash from {REFS})")
query(
    "jn_orphan_gc",
    lambda v: J.orphan_split(v("v_blobs").where("doc_id % 5 = 0").select("blob_hash").distinct(), refs(v)),
    f"select distinct blob_hash, case when blob_hash in (select blob_hash from {REFS}) then 'referenced' else 'removable' end as verdict from v_blobs where doc_id % 5 = 0",
)
query("jn_shared_blobs", lambda v: J.shared_blobs(v("v_instances")), "select blob_hash, count(distinct study_uid) as studies from v_instances group by blob_hash having count(distinct study_uid) > 1")
query(
    "jn_exclusive_hot",
    lambda v: J.exclusive_hot(refs(v), v("v_blobs").where("owner = 'src3'").select(F.col("owner").alias("study_uid"))),
    "select distinct blob_hash from v_blobs where doc_id % 5 <> 0 and owner = 'src3' and blob_hash not in (select blob_hash from v_blobs where doc_id % 5 <> 0 and owner <> 'src3' and tier = 'hot')",
)
query(
    "jn_index_gap",
    lambda v: J.index_gap(v("v_series"), v("v_series").where("seq <= 2"), ["modality", "study_uid"]),
    "select distinct modality, study_uid from v_series except select modality, study_uid from v_series where seq <= 2",
)
RULES = "(1, 'liver', 'ct', 'abdomen', null), (2, 'urgent', null, null, '%urgent'), (3, 'head', null, 'head', '4-not%'), (4, 'any-mr', 'mr', null, null)"
RULE_HIT = "(r_modality is null or lower(modality) like r_modality) and (r_body_part is null or lower(body_part) like r_body_part) and (r_study_description is null or lower(study_description) like r_study_description)"
RULE_ROWS = "(select * from v_series join (select study_uid, study_description from v_studies) d using (study_uid)) s"


def _rules(df):
    return df.sparkSession.sql(f"select * from values {RULES} as t(position, name, r_modality, r_body_part, r_study_description)")


def _rule_rows(v):
    return v("v_series").join(v("v_studies").select("study_uid", "study_description"), "study_uid")


query(
    "jn_first_rule",
    lambda v: (lambda s: J.first_rule(s, _rules(s), "series_uid", "none"))(_rule_rows(v)),
    f"select s.series_uid, coalesce(arg_min(r.name, r.position), 'none') as rule from {RULE_ROWS} left join (values {RULES}) r(position, name, r_modality, r_body_part, r_study_description) on {RULE_HIT} group by s.series_uid",
)
query("jn_all_rules", lambda v: (lambda s: J.all_rules(s, _rules(s)).select("series_uid", "position", "name"))(_rule_rows(v)), f"select s.series_uid, r.position, r.name from {RULE_ROWS} join (values {RULES}) r(position, name, r_modality, r_body_part, r_study_description) on {RULE_HIT}")
SUBS = "('A', null, 'CT', null, null), ('B', 'COMPLETED', null, 'ST1%', null), ('C', null, null, null, 'W7'), ('D', 'SCHEDULED', 'mr', '%', null)"
query(
    "jn_subscribers",
    lambda v: (lambda w: J.subscribers(w, w.sparkSession.sql(f"select * from values {SUBS} as t(subscriber, s_state, s_modality, s_station, s_workitem_uid)"), ["state", "modality", "station"]).select("workitem_uid", "subscriber"))(v("v_workitems")),
    f"select workitem_uid, subscriber from v_workitems join (values {SUBS}) t(subscriber, s_state, s_modality, s_station, s_workitem_uid) on (s_state is null or state like s_state) and (s_modality is null or modality like s_modality) and (s_station is null or station like s_station) and (s_workitem_uid is null or s_workitem_uid = workitem_uid)",
)
SR = "1.2.840.10008.5.1.4.1.1.88.33"
query(
    "jn_cascade",
    lambda v: J.cascade(v("v_instances").withColumn("refs", F.array("series_uid", F.expr("study_uid || '.A'"))), [SR], v("v_series").where("modality = 'CT' and seq = 1").select(F.col("series_uid").alias("uid"))),
    f"select distinct sop_uid from v_instances where sop_class = '{SR}' and (series_uid in (select series_uid from v_series where modality = 'CT' and seq = 1) or study_uid || '.A' in (select series_uid from v_series where modality = 'CT' and seq = 1))",
)
TASKS = "('CT', 'liver', false), ('CT', 'lung', false), ('MR', 'lung', false), ('MR', 'manual', true)"
query(
    "jn_catalog",
    lambda v: (lambda s: J.catalog_tasks(s, s.sparkSession.sql(f"select * from values {TASKS} as t(modality, code, manual)"), s.where("seq = 1 and modality = 'MR'").select("study_uid", F.lit("lung").alias("code")), ["XX"], "general"))(v("v_series")),
    f""", t as (select distinct s.study_uid, s.modality, c.code from v_series s left join (select * from (values {TASKS}) x(modality, code, manual) where not manual) c using (modality)),
      a as (select study_uid, code, min(modality) as trigger from t where code is not null group by all union all select study_uid, 'general' as code, min(modality) as trigger from t group by study_uid having count(code) = 0)
      select * from a where (study_uid, code) not in (select study_uid, 'lung' from v_series where seq = 1 and modality = 'MR')""",
)
query("jn_ngram_candidates", lambda v: J.ngram_candidates(v("v_names"), "name_id", "name", F.lit("red b")), "select name_id from v_names where name like '%red%' and name like '%ed %' and name like '%d b%'")
query(
    "jn_fuzzy_names",
    lambda v: J.fuzzy_names(v("v_names").select("name"), v("v_names").select(F.expr("replace(name, 'o', 'a')"))),
    "select a, b from (select distinct name as a from v_names), (select distinct replace(name, 'o', 'a') as b from v_names) where levenshtein(a, b) <= 1",
)
query(
    "jn_result_diff",
    lambda v: J.result_diff(v("v_studies").where("sex <> 'O'").select("study_uid", "study_time"), v("v_studies").where("sex <> 'M'").select("study_uid", F.expr("case when study_date % 10 = 1 then 'x' else study_time end as study_time")), "study_uid", "study_time"),
    "select study_uid, case sex when 'M' then 'only_left' when 'O' then 'only_right' else 'different' end as verdict from v_studies where sex <> 'F' or study_date % 10 = 1",
)
# aggregations
query("agg_study_totals", lambda v: A.study_totals(v("v_series"), v("v_instances")), TOTALS + "select * from tot")
query("agg_storage", lambda v: A.storage(v("v_instances")), "select count(*) as logical, count(distinct blob_hash) as physical, 1 - count(distinct blob_hash) / count(*) as dedup_ratio, sum(file_size) as bytes, count(distinct study_uid) as studies from v_instances")
query("agg_tiers", lambda v: A.tiers(v("v_instances")), "select coalesce(tier, 'all') as tier, count(*) as files, sum(file_size) as bytes, count(distinct study_uid) as studies from v_instances group by rollup(tier)")


def _chunks_near(v):
    """The estimate from the days' sketches lies within two per cent of the exact count."""
    sketched = A.chunks_estimated(A.chunk_sketches(v("v_arrivals"), F.col("a1"))).withColumnRenamed("unique_chunks", "about")
    return sketched.join(A.chunks(v("v_arrivals")).drop("total")).select("total", "unique_chunks", (F.abs(F.col("about") - F.col("unique_chunks")) <= 0.02 * F.col("unique_chunks")).alias("near"))


def _quantiles_near(v):
    """Each route's statistics from its hours' sketches, and whether the sketched quantiles' ranks are within one per cent of what was asked for."""
    rows, asked = v("v_access").select("route", "ts", "us"), [0.5, 0.95]
    stats = A.run_stats_merged(A.quantile_sketches(rows, "route", "ts", "us"), "route", asked)
    ranks = rows.join(stats.select("route", "q0", "q1"), "route").groupBy("route").agg(*(F.count_if(F.col("us") < F.col(f"q{i}")).alias(f"b{i}") for i in (0, 1)), *(F.count_if(F.col("us") <= F.col(f"q{i}")).alias(f"u{i}") for i in (0, 1)))
    near = [((F.col(f"b{i}") <= (q + 0.01) * F.col("n") + 1) & (F.col(f"u{i}") >= (q - 0.01) * F.col("n") - 1)).alias(f"near{i}") for i, q in enumerate(asked)]
    return stats.join(ranks, "route").select("route", "n", F.round("mean", 3).alias("mean"), F.round("sd", 1).alias("sd"), "low", "high", *near)


query("agg_chunks_sketched", _chunks_near, "select count(*) as total, count(distinct blob_hash) as unique_chunks, true as near from v_arrivals")
query(
    "agg_quantiles_sketched", _quantiles_near,
    "select route, count(*) as n, round(avg(us), 3) as mean, round(stddev_pop(us), 1) as sd, min(us) as low, max(us) as high, true as near0, true as near1 from v_access where us is not null group by route",
)
query("agg_chunks", lambda v: A.chunks(v("v_arrivals")), "select count(*) as total, count(distinct blob_hash) as unique_chunks from v_arrivals")
query("agg_unreferenced", lambda v: A.unreferenced(v("v_blobs"), refs(v)), f"select count(*) as objects, sum(size) as bytes, count(*) filter (blob_hash not in (select blob_hash from {REFS})) as unreferenced from v_blobs")
query(
    "agg_route_status", lambda v: A.route_status(v("v_access")),
    'select route, count(*) filter (status // 100 not in (4, 5)) as "2xx", count(*) filter (status // 100 = 4) as "4xx", count(*) filter (status // 100 = 5) as "5xx" from v_access group by route',
)
query("agg_route_latency", lambda v: A.route_latency(v("v_access")), "select route, sum(us) as us, count(*) as requests from v_access group by route")
query(
    "agg_quantile_recent", lambda v: A.quantile_recent(v("v_access"), "us", [F.col("ts").desc(), F.col("event_id").desc()], 0.95),
    "select list_sort(list(us))[cast(floor((count(*) - 1) * 0.95 + 0.5) as int) + 1] as quantile, count(*) as samples from (select us from v_access order by ts desc, event_id desc limit 1000)",
)
query(
    "agg_by_reason", lambda v: A.by_reason(v("v_instances"), v("v_instances").where("seq = 1"), [113001, 113037, 113038, 113039]),
    "select reason, count(sop_uid) as rejected, count(sop_uid) filter (seq = 1) as restored from (values (113001), (113037), (113038), (113039)) r(reason) left join v_instances using (reason) group by reason",
)
query(
    "agg_assoc_summary",
    lambda v: A.assoc_summary(v("v_instances").withColumn("seq", F.concat_ws("|", "study_uid", F.lpad(F.col("seq").cast("string"), 5, "0"))), "patient_id"),
    """, p as (select patient_id, study_uid, arg_min(modality, seq) as modality, min(study_uid || '|' || lpad(cast(seq as varchar), 5, '0')) as seq, count(*) as n from v_instances group by all),
      m as (select patient_id, modality, sum(n) as n, min(seq) as seq, count(*) as studies from p group by all)
      select patient_id, sum(studies) as studies, sum(n) as instances, string_agg(modality || 'x' || cast(n as varchar), ', ' order by seq) as summary from m group by patient_id""",
)
query(
    "agg_audit_copies", lambda v: A.audit_copies(v("v_blobs").select("owner", "blob_hash", F.expr("tier = 'cold'").alias("orphan")), "owner"),
    "select *, count(*) over (partition by owner, kind) as hashes from (select distinct owner, case tier when 'cold' then 'orphans' else 'tracked' end as kind, blob_hash from v_blobs)",
)
query(
    "agg_run_stats", lambda v: A.run_stats(v("v_access"), "route", "bytes").withColumns({c: F.round(c, 4) for c in ("mean", "sd")}),
    "select route, count(bytes) as n, median(bytes) as median, round(avg(bytes), 4) as mean, round(stddev_pop(bytes), 4) as sd, min(bytes) as low, max(bytes) as high from v_access group by route",
)
query(
    "agg_history", lambda v: A.history(v("v_access"), "ts", "bytes", "360 seconds", 240),
    "select to_timestamp(floor(epoch(ts) / 360) * 360)::timestamp as start, sum(bytes) as total, count(*) as n from v_access group by 1 order by 1 desc limit 240",
)
query(
    "agg_commit_failures", lambda v: A.commit_failures(J.commit_presence(v("v_commitments"), v("v_instances"))),
    "select distinct transaction_uid, sop_uid, 272 as reason from v_commitments c where sop_uid is not null and not exists (select 1 from v_instances i where i.sop_uid = c.sop_uid and (c.study_hint is null or c.study_hint = i.study_uid))",
)
query(
    "agg_commit_verdict", lambda v: A.commit_verdict(J.commit_presence(v("v_commitments"), v("v_instances"))),
    "select transaction_uid, count(*) as instances, count(*) filter (not found) as failed, case when count(*) filter (not found) = 0 then 'success' else 'failures' end as verdict from (select c.*, i.sop_uid is not null as found from v_commitments c left join v_instances i on c.sop_uid = i.sop_uid and (c.study_hint is null or c.study_hint = i.study_uid)) group by transaction_uid",
)
query(
    "agg_measurements",
    lambda v: A.measurements(v("v_instances").groupBy("study_uid", "body_part").agg(F.collect_list(F.struct(F.col("modality").alias("concept"), F.col("file_size").alias("value"), F.lit("B").alias("unit"))).alias("items")).groupBy("study_uid").agg(F.collect_list(F.struct(F.col("body_part").alias("finding"), "items")).alias("groups")))[1],
    "select body_part as finding, modality as concept, count(*) as n, min(file_size) as low, max(file_size) as high from v_instances group by all",
)
# windows
OUTCOME = f""", a as (select *, row_number() over (partition by sop_uid order by {ARRIVAL}) as rn, first_value(study_uid) over (partition by sop_uid order by {ARRIVAL}) as own from v_arrivals),
  b as (select *, first_value(case when rn = 1 then patient_id end ignore nulls) over (partition by study_uid order by {ARRIVAL} rows between unbounded preceding and unbounded following) as sp from a),
  c as (select *, rn > 1 and (study_uid <> own or coalesce(patient_id <> sp, false)) as conf from b), d as (select *, lag(blob_hash) over (partition by sop_uid, conf order by {ARRIVAL}) as prev from c),
  o as (select *, case when rn = 1 then 'inserted' when conf then 'conflict' when blob_hash = prev then 'idempotent' else 'updated' end as outcome from d)
"""
query("win_ingest_outcome", lambda v: W.ingest_outcome(v("v_arrivals"), order()).select("sop_uid", "a1", "a2", "a3", "outcome"), OUTCOME + "select sop_uid, a1, a2, a3, outcome from o")
query("win_keep_first", lambda v: W.keep_first(v("v_arrivals"), ["series_uid", "sop_uid"], order()).select("series_uid", "sop_uid", "blob_hash"), f"select series_uid, sop_uid, blob_hash from v_arrivals qualify row_number() over (partition by series_uid, sop_uid order by {ARRIVAL}) = 1")
query("win_line_ordinal", lambda v: W.line_ordinal(v("v_access").withColumn("day", F.to_date("ts")), "day", F.struct("ts", "event_id")).select("event_id", "ordinal"), "select event_id, row_number() over (order by ts, event_id) as ordinal from v_access")
query(
    "win_representative", lambda v: W.representative(v("v_instances"), "study_uid"),
    "select study_uid, sop_uid, case when frames > 1 then frames // 2 + 1 else 1 end as frame from v_instances qualify row_number() over (partition by study_uid order by image_type like '%LOCALIZER%', seq) = 1",
)
query(
    "win_failure_streak", lambda v: W.failure_streak(v("v_access").withColumn("ok", F.expr("status < 400")), "user_name", [F.col("ts"), F.col("event_id")], 2),
    "select user_name, count(*) as failures from (select *, max(case when status < 400 then (ts, event_id) end) over (partition by user_name) as last from v_access) where status >= 400 and (last is null or (ts, event_id) > last) group by user_name having count(*) >= 2",
)


#: Stacks along the normal and against it, some whose slices share one place, some slices without a position, some series without a declared spacing.
Z = """case when seq % 7 = 0 then null when substring(series_uid, length(series_uid), 1) = 'N' and length(series_uid) % 2 = 0 then 4
  else (case when length(study_uid) % 2 = 0 then -1 else 1 end) * (frames * 2 + seq * 3) end"""
DECLARED = "case when file_size % 2000 = 0 then 2.5 when file_size % 3000 = 0 then -1.0 end"


def _slices(v):
    number = F.concat_ws("|", "study_uid", F.lpad(F.col("seq").cast("string"), 6, "0")).alias("number")
    position = F.expr(f"array(0d, 0d, cast({Z} as double))").alias("position")
    return v("v_instances").select("series_uid", number, position, F.expr("array(1d, 0d, 0d, 0d, 1d, 0d)").alias("orientation"), F.expr(f"cast({DECLARED} as double)").alias("declared"))


query(
    "win_slice_spacing",
    lambda v: W.slice_spacing(_slices(v), "series_uid", "declared"),
    f""", z as (select series_uid, study_uid, seq, {Z} as z, {DECLARED} as d from v_instances),
      p as (select series_uid, z - lag(z) over (partition by series_uid order by study_uid || '|' || lpad(cast(seq as varchar), 6, '0')) as step from z where z is not null),
      m as (select series_uid, count(step) as n, list_sort(list(step) filter (step is not null))[count(step) // 2 + 1] as mid from p group by series_uid),
      s as (select series_uid, max(d) as d from z group by series_uid)
      select series_uid, case when n > 0 then case when mid <> 0 then mid end when d > 0 then d end as spacing,
        case when n > 0 and mid = 0 then 'positions coincide' when coalesce(n, 0) = 0 and not coalesce(d > 0, false) then 'unknown' end as refused from s left join m using (series_uid)""",
)
query(
    "win_transitions", lambda v: W.transitions(v("v_workitems").select(F.col("patient_id"), "state", "created_at", "workitem_uid"), "patient_id", [F.col("created_at"), F.col("workitem_uid")]).select("workitem_uid", "previous", "legal"),
    "select workitem_uid, p as previous, case when p is not null then (p, state) in (('SCHEDULED', 'IN PROGRESS'), ('IN PROGRESS', 'COMPLETED'), ('IN PROGRESS', 'CANCELED'), ('COMPLETED', 'COMPLETED'), ('CANCELED', 'CANCELED')) end as legal from (select *, lag(state) over (partition by patient_id order by created_at, workitem_uid) as p from v_workitems)",
)
