"""Queries for scalar functions and predicates."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..functions import times
from ..operators.integrity import uid_ok
from .registry import query

PN = "patient_name || '=' || case when study_date is null then '' else institution_name end || '=' || study_description"
query(
    "fn_pn_groups",
    lambda v: v("v_studies").select("study_uid", T.pn_groups(F.expr(PN)).alias("p")).select("study_uid", "p.alphabetic", "p.ideographic", "p.phonetic"),
    f"select study_uid, string_split({PN}, '=')[1] as alphabetic, nullif(string_split({PN}, '=')[2], '') as ideographic, nullif(string_split({PN}, '=')[3], '') as phonetic from v_studies",
)
query("fn_pn_normalize", lambda v: v("v_studies").select("study_uid", T.pn_normalize(F.col("patient_name")).alias("n")), "select study_uid, lower(translate(patient_name, '^=', '  ')) as n from v_studies")
query(
    "fn_pn_ngrams",
    lambda v: v("v_studies").select("study_uid", F.array_join(T.pn_ngrams(F.col("patient_name")), ",").alias("grams")),
    "select study_uid, array_to_string(list_transform(range(1, greatest(length(b) - 1, 2)), lambda i: hex(encode(substring(b, i, 3)))), ',') as grams from (select study_uid, lower(replace(replace(patient_name, '^', ''), '=', '')) as b from v_studies)",
)
query(
    "fn_mask_name",
    lambda v: v("v_names").select("name_id", T.mask_name(F.col("name")).alias("m")),
    "select name_id, case when length(name) <= 2 then repeat('*', length(name)) else substring(name, 1, 1) || repeat('*', length(name) - 2) || substring(name, length(name), 1) end as m from v_names",
)
Q = "'Patient,Name=' || patient_name || '&StudyDate=' || study_time || '&00100010=x&%50atientID=' || patient_id || '&limit=5&Patient%4Eame=y'"
query(
    "fn_mask_query_phi",
    lambda v: v("v_studies").select("study_uid", T.mask_query(F.expr(Q)).alias("q")),
    "select study_uid, 'Patient,Name=***&StudyDate=' || study_time || '&00100010=***&%50atientID=' || patient_id || '&limit=5&Patient%4Eame=***' as q from v_studies",
)
query("fn_sanitize_ctl", lambda v: v("documents").select("doc_id", F.md5(T.sanitize_controls(F.col("text"))).alias("m")), r"select doc_id, md5(regexp_replace(text, '[\x{0}-\x{1f}\x{7f}-\x{9f}\x{2028}\x{2029}]', '?', 'g')) as m from documents")
query(
    "fn_tm_period",
    lambda v: v("v_studies").select("study_uid", times.tm_period(F.col("study_time")).alias("p")).select("study_uid", "p.*"),
    """select study_uid, s as start_us, s + case length(study_time) when 2 then 3599999999 when 4 then 59999999 else 0 end as end_us from (select study_uid, study_time,
      (cast(substring(study_time, 1, 2) as bigint) * 3600 + case when length(study_time) > 2 then cast(substring(study_time, 3, 2) as bigint) * 60 else 0 end + case when length(study_time) > 4 then cast(substring(study_time, 5, 2) as bigint) else 0 end) * 1000000 as s from v_studies)""",
)
query(
    "fn_dt_bounds",
    lambda v: v("v_workitems").select("workitem_uid", times.dt_bounds(F.col("start_dt")).alias("b")).select("workitem_uid", "b.*"),
    """select workitem_uid, epoch_us(lo) as lo, epoch_us(hi) - 1 as hi from (select workitem_uid, case length(start_dt) when 6 then strptime(start_dt, '%Y%m') when 8 then strptime(start_dt, '%Y%m%d') when 12 then strptime(start_dt, '%Y%m%d%H%M')
      else strptime(substring(start_dt, 1, 14), '%Y%m%d%H%M%S') + interval 5 hours end as lo, case length(start_dt) when 6 then strptime(start_dt, '%Y%m') + interval 1 month when 8 then strptime(start_dt, '%Y%m%d') + interval 1 day
      when 12 then strptime(start_dt, '%Y%m%d%H%M') + interval 1 minute else strptime(substring(start_dt, 1, 14), '%Y%m%d%H%M%S') + interval 5 hours + interval 1 second end as hi from v_workitems)""",
)
query(
    "fn_stable_uid",
    lambda v: v("v_studies").select("study_uid", T.stable_uid(F.col("patient_id"), F.col("study_date"), F.col("study_time"), F.concat("accession_number", F.lit("|x"))).alias("uid")),
    r"select study_uid, '2.25.' || cast(cast('0x' || substring(sha256(patient_id || '|' || coalesce(cast(study_date as varchar), '') || '|' || study_time || '|' || accession_number || '\|x'), 1, 15) as ubigint) as varchar) as uid from v_studies",
)
CODES = ", ".join(f"('{r}', '{a}', '{e}', '{o}', {n})" for r, a, e, o, n, _ in T.AUDIT_CODES)


def _audit(v):
    from ..operators.joins import small

    access = v("v_access")
    codes = access.sparkSession.sql(f"select * from values {CODES} as t(route, action, event_code, obj_type, named)")
    return access.join(small(codes), "route").select("event_id", "route", "action", "event_code", "obj_type", F.when(F.col("named") >= 1, F.col("study")).alias("study"), F.when(F.col("named") >= 2, F.col("series")).alias("series"))


QUERIES_OF = "case event_id % 5 when 0 then 'update' when 1 then 'a=1&update=2' when 2 then 'updated=1' when 3 then 'x=update' end"


query("fn_route_audit_code", _audit, f"select event_id, route, action, event_code, obj_type, case when named >= 1 then study end as study, case when named >= 2 then series end as series from v_access join (values {CODES}) t(route, action, event_code, obj_type, named) using (route)")
query(
    "fn_route_audit_update",
    lambda v: v("v_access").select("event_id", T.audit_action(F.expr("case when route = 'stow_studies' then 'R' else 'C' end"), F.expr(QUERIES_OF)).alias("action")),
    "select event_id, case when route = 'stow_studies' then 'R' when event_id % 5 < 2 then 'U' else 'C' end as action from v_access",
)
#: Methods and paths with their families, all branches.
PATHS = (
    ("GET", "/health", "health"), ("HEAD", "/health/status", "health"), ("GET", "/healthz", "other"), ("DELETE", "/health", "other"), ("GET", "/metrics", "metrics"), ("DELETE", "/metrics", "other"), ("GET", "/dicomweb/patients", "qido_patients"),
    ("POST", "/dicomweb/patients", "other"), ("GET", "/dicomweb/studies?limit=1", "qido_studies"), ("PUT", "/dicomweb/studies", "other"), ("GET", "/dicomweb/studies/1/series", "wado_study"), ("HEAD", "/dicomweb/studies/1", "wado_study"),
    ("DELETE", "/dicomweb/studies/1", "other"), ("POST", "/dicomweb/studies", "stow_studies"), ("POST", "/dicomweb/studies/1.2", "stow_studies"), ("GET", "/dicomweb/commitment-requests/1", "commitment"), ("POST", "/dicomweb/commitment-requests", "commitment"),
    ("PUT", "/dicomweb/commitment-requests", "other"), ("GET", "/dicomweb/workitems/1", "ups"), ("PUT", "/dicomweb/workitems/1/state", "ups"), ("DELETE", "/dicomweb/workitems/1", "other"), ("DELETE", "/admin/v1/x", "admin"), ("GET", "/admin/v1", "other"), ("GET", "/x", "other"),
)
_case = lambda k: f"case event_id % {len(PATHS)} " + " ".join(f"when {i} then '{row[k]}'" for i, row in enumerate(PATHS)) + " end"
query("fn_route_class", lambda v: v("v_access").select("event_id", T.route_class(F.expr(_case(0)), F.expr(_case(1))).alias("family")), f"select event_id, {_case(2)} as family from v_access")
#: What each tag's value representation must be, apart from the table under test; the last three are unknown, or known in another case.
VRS = """('00080016', 'UI'), ('00080018', 'UI'), ('00080020', 'DA'), ('00080021', 'DA'), ('00080030', 'TM'), ('00080031', 'TM'), ('00080050', 'SH'), ('00080060', 'CS'), ('00080061', 'CS'), ('00080070', 'LO'), ('00080080', 'LO'), ('00080090', 'PN'), ('00081010', 'SH'), 
  ('00081030', 'LO'), ('0008103E', 'LO'), ('00081040', 'LO'), ('00081050', 'PN'), ('00081060', 'PN'), ('00081070', 'PN'), ('00100010', 'PN'), ('00100020', 'LO'), ('00100021', 'LO'), 
  ('00100030', 'DA'), ('00100040', 'CS'), ('00180015', 'CS'), ('00181030', 'LO'), ('0020000D', 'UI'), ('0020000E', 'UI'), ('00200010', 'SH'), 
  ('00200011', 'IS'), ('00200013', 'IS'), ('00200060', 'CS'), ('00201206', 'IS'), ('00201208', 'IS'), ('00280008', 'IS'), ('00321032', 'PN'), ('00321060', 'LO')"""
TAG_LIST = [*re.findall("[0-9A-F]{8}", VRS), "0020000d", "00101010", ""]
_tag = f"element_at(array({', '.join(repr(t) for t in TAG_LIST)}), cast(event_id % {len(TAG_LIST)} + 1 as int))"
query(
    "fn_vr_lookup",
    lambda v: v("v_access").select("event_id", T.vr_lookup(F.expr(_tag)).alias("vr")),
    f"select event_id, coalesce(vr, 'UN') as vr from (select event_id, [{', '.join(repr(t) for t in TAG_LIST)}][event_id % {len(TAG_LIST)} + 1] as tag from v_access) left join (values {VRS}) k(known, vr) on upper(tag) = known",
)
#: Fields of requests and the tags they name.
FIELDS = (
    ("PatientName", "00100010"), (" patientid ", "00100020"), ("STUDYINSTANCEUID", "0020000D"), ("0020000e", "0020000E"), ("00189999", "00189999"), ("NumberOfStudyRelatedInstances", "00201208"), ("modalitiesinstudy", "00080061"),
    ("SeriesDescription", "0008103E"), ("requestedproceduredescription", "00321060"), ("NoSuchKeyword", None), ("0010001", None), ("0010001G", None), ("", None), ("all", None),
)
_field = lambda k: f"case event_id % {len(FIELDS)} " + " ".join(f"when {i} then '{row[k]}'" for i, row in enumerate(FIELDS) if row[k] is not None) + " end"
query("fn_tag_lookup", lambda v: v("v_access").select("event_id", T.tag_lookup(F.expr(_field(0))).alias("tag")), f"select event_id, {_field(1)} as tag from v_access")
query("fn_status_class", lambda v: v("v_access").select("event_id", T.status_class(F.col("status")).alias("class")), "select event_id, case status // 100 when 4 then '4xx' when 5 then '5xx' else '2xx' end as class from v_access")
query(
    "fn_outcome_code",
    lambda v: v("v_access").select("event_id", T.outcome_code(F.expr("case when event_id % 7 = 0 then 'x' else cast(status as string) end")).alias("code")),
    "select event_id, case when event_id % 7 = 0 then '0' when status between 400 and 499 then '4' when status between 500 and 599 then '8' else '0' end as code from v_access",
)
query(
    "fn_split_multi",
    lambda v: v("v_instances").select("sop_uid", F.explode(T.split_multi(F.col("image_type"))).alias("part")),
    "select sop_uid, trim(unnest(string_split(image_type, ','))) as part from v_instances",
)


def flt(name: str, table: str, key: str, condition, sql: str) -> None:
    query(name, lambda v: v(table).where(condition()).select(key), f"select {key} from {table} where {sql}")


c = F.col
flt("flt_glob", "v_series", "series_uid", lambda: P.glob(c("series_description"), "T2* 50%_?xial"), r"series_description like 'T2%% 50\%\__xial' escape '\'")
flt("flt_glob_ci", "v_studies", "study_uid", lambda: P.glob_ci(c("study_description"), "*-hIGh"), "lower(study_description) like '%-high'")
flt("flt_fuzzy1", "v_names", "name_id", lambda: P.fuzzy(c("name"), "smoll ring"), f"regexp_matches(lower(translate(name, '^=', '  ')), '{P.fuzzy_regex('smoll ring')}')")
flt("flt_in_list", "v_series", "series_uid", lambda: P.in_list(c("modality"), "CT, SR"), "modality in ('CT', 'SR')")
flt("flt_list_intersects", "v_instances", "sop_uid", lambda: P.list_intersects(c("image_type"), "LOCALIZER, ,MPR"), "list_has_any(string_split(image_type, ','), ['LOCALIZER', 'MPR'])")
flt("flt_da_range_study", "v_studies", "study_uid", lambda: P.study_date_range(c("study_date"), "19970101", "bad"), "study_date >= 19970101")
flt("flt_da_range", "v_studies", "study_uid", lambda: P.date_range(c("birth_date"), "19500101-19601231"), "birth_date between 19500101 and 19601231")
flt("flt_da_range_bad", "v_studies", "study_uid", lambda: P.date_range(c("birth_date"), "-"), "false")
flt("flt_da_equals", "v_worklist", "sps_uid", lambda: P.date_equals(c("start_date"), "19970528"), "start_date = 19970528")
flt(
    "flt_tm_range", "v_studies", "study_uid", lambda: P.time_range(c("study_time"), "0930-1015"),
    "(cast(rpad(study_time, 6, '0') as int) <= 101559 and cast(study_time || case length(study_time) when 2 then '5959' when 4 then '59' else '' end as int) >= 93000)",
)
flt(
    "flt_dt_range", "v_workitems", "workitem_uid", lambda: P.datetime_range(c("start_dt"), "199703-19970620"),
    "(case length(start_dt) when 6 then strptime(start_dt, '%Y%m') when 8 then strptime(start_dt, '%Y%m%d') when 12 then strptime(start_dt, '%Y%m%d%H%M') else strptime(substring(start_dt, 1, 14), '%Y%m%d%H%M%S') + interval 5 hours end) between timestamp '1997-03-01' and timestamp '1997-06-20 23:59:59.999999'",
)
flt("flt_number_glob", "v_instances", "sop_uid", lambda: P.number_glob(c("frames"), "?"), "cast(frames as varchar) like '_'")
flt("flt_visible", "v_instances", "sop_uid", lambda: P.visible(c("reason"), True), "reason in (0, 113001)")
flt("flt_sql_like", "v_studies", "study_uid", lambda: P.sql_like(c("study_description"), "*NOT%ified"), "lower(study_description) like '%not%ified'")
flt("flt_rule_glob", "v_studies", "study_uid", lambda: P.rule_glob(c("study_description"), "4-NOT   spec*"), r"regexp_replace(trim(lower(study_description)), '\s+', ' ', 'g') like '4-not spec%'")
query("int_uid_check", lambda v: v("v_instances").select("sop_uid", uid_ok(F.expr("case when frames = 0 then sop_uid || '.007' else sop_uid end")).alias("ok")), "select sop_uid, frames <> 0 as ok from v_instances")
