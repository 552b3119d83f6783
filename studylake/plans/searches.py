"""Search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import aggregates as A
from ..operators import search as S
from ..operators.analytic import line_ordinal
from ..sources.sinks import audit_message, search_json
from .registry import query

TOTALS = """, tot as (select coalesce(s.study_uid, i.study_uid) as study_uid, coalesce(series_count, 0) as series_count, coalesce(instance_count, 0) as instance_count, coalesce(modalities_in_study, '') as modalities_in_study, coalesce(total_bytes, 0) as total_bytes from
  (select study_uid, sum(n) as series_count, string_agg(modality, ',' order by seq, modality) as modalities_in_study from (select study_uid, modality, count(*) as n, min(seq) as seq from v_series group by all) group by all) s
  full join (select study_uid, count(*) as instance_count, sum(file_size) as total_bytes from v_instances group by all) i on s.study_uid = i.study_uid),
 st as (select v_studies.*, coalesce(series_count, 0) as series_count, coalesce(instance_count, 0) as instance_count, coalesce(modalities_in_study, '') as modalities_in_study, coalesce(total_bytes, 0) as total_bytes from v_studies left join tot using (study_uid))
"""


def full_studies(v):
    """Studies with their derived columns; a study without series has zeros."""
    t = A.study_totals(v("v_series"), v("v_instances"))
    s = v("v_studies").join(t, "study_uid", "left")
    return s.na.fill({"series_count": 0, "instance_count": 0, "total_bytes": 0, "modalities_in_study": ""})


COLS = ["study_uid", "patient_name", "study_date", "series_count", "instance_count", "modalities_in_study"]
query(
    "qry_studies",
    lambda v: S.with_totals(S.studies(v("v_studies"), "19960101", "19990630", offset=5, limit=200, patient_name="Customer*1?"), v("v_series"), v("v_instances")).select(*COLS),
    TOTALS + f"select {', '.join(COLS)} from st where study_date between 19960101 and 19990630 and lower(patient_name) like 'customer%1_' order by study_date nulls last, study_uid limit 200 offset 5",
)
query(
    "qry_studies_modalities",
    lambda v: S.studies(full_studies(v), modalities_in_study="MR, XX", patient_name="custamer", limit=300).select(*COLS),
    TOTALS + f"select {', '.join(COLS)} from st where list_has_any(string_split(modalities_in_study, ','), ['MR', 'XX']) and regexp_matches(lower(translate(patient_name, '^=', '  ')), '{P.fuzzy_regex('custamer')}') order by study_date nulls last, study_uid limit 300",
)
query(
    "qry_studies_uid_list", lambda v: S.studies(v("v_studies"), study_uid="1.2.5, 1.2.9,1.2.5,1.2.97").select("study_uid", "study_date"), "select study_uid, study_date from v_studies where study_uid in ('1.2.5', '1.2.9', '1.2.97')"
)
query(
    "qry_page",
    lambda v: S.remaining(S.matching(v("v_studies"), S.STUDY_KEYS, sex="M"), 100, 250),
    "select count(*) as total, least(greatest(count(*) - 100, 0), 250) as returned, nullif(greatest(count(*) - 100 - least(greatest(count(*) - 100, 0), 250), 0), 0) as remaining from v_studies where sex = 'M'",
)
NUM = "try_cast({0} as bigint) nulls last"
query("qry_series", lambda v: S.series(v("v_series"), study_uid="1.2.12", modality="CT,MR,SR").select("series_uid", "modality", "series_number"), "select series_uid, modality, series_number from v_series where study_uid = '1.2.12'")
query("qry_instances", lambda v: S.instances(v("v_instances"), "1.2.17.N", expose_quality=True).select("sop_uid", "instance_number"), "select sop_uid, instance_number from v_instances where series_uid = '1.2.17.N' and reason in (0, 113001)")
query(
    "qry_study_instances",
    lambda v: S.study_instances(v("v_series"), v("v_instances"), "1.2.12", modality="CT,MR").select("sop_uid", "series_uid"),
    "select sop_uid, i.series_uid from v_instances i join v_series s using (series_uid) where i.study_uid = '1.2.12' and s.study_uid = '1.2.12' and s.modality in ('CT', 'MR') and reason = 0",
)
query("qry_series_global", lambda v: S.series(v("v_series"), series_description="T1*", offset=10, limit=500).select("series_uid", "study_uid"), "select series_uid, study_uid from v_series where series_description like 'T1%' order by series_uid limit 500 offset 10")
query(
    "qry_instances_global",
    lambda v: S.instances_global(v("v_studies"), v("v_series"), v("v_instances"), {"sex": "F"}, {"modality": "CT"}, instance_number="?", limit=1000).select("sop_uid", "study_uid"),
    "select i.sop_uid, i.study_uid from v_instances i where reason = 0 and instance_number like '_' and study_uid in (select study_uid from v_studies where sex = 'F') and series_uid in (select series_uid from v_series where modality = 'CT') order by sop_uid limit 1000",
)
query(
    "qry_recent_patients",
    lambda v: S.recent_patients(v("v_studies"), born="19400101-", name="customer", offset=3, limit=40).select("patient_id", "studies", "birth_date", "patient_name", F.col("rank").cast("long").alias("rank")),
    f"""select patient_id, studies, birth_date, patient_name, row_number() over (order by arrived_at desc, patient_id) - 1 as rank from (select * from (select patient_id, max(arrived_at) as arrived_at, count(*) as studies, arg_min(birth_date, study_uid) filter (birth_date is not null) as birth_date, arg_min(patient_name, study_uid) as patient_name
      from v_studies where patient_id <> '' group by patient_id) where birth_date >= 19400101 and regexp_matches(lower(translate(patient_name, '^=', '  ')), '{P.fuzzy_regex("customer")}') order by arrived_at desc, patient_id limit 40 offset 3)""",
)
query(
    "qry_patient_fold",
    lambda v: S.patient_fold(v("v_studies").select("patient_id", "study_uid", "study_date"), [F.col("study_uid").alias("k")]).select("patient_key", "studies", "study_uid", "study_date"),
    "select k as patient_key, count(*) as studies, min(study_uid) as study_uid, arg_min_null(study_date, study_uid) as study_date from (select coalesce(nullif(patient_id, ''), 'study:' || study_uid) as k, * from v_studies) group by k",
)
query(
    "qry_workitems",
    lambda v: S.workitems(v("v_workitems"), modality="CT", start="1997-1998", state="COMPLETED", limit=400).select("workitem_uid", "start_dt"),
    "select workitem_uid, start_dt from v_workitems where lower(modality) = 'ct' and state = 'COMPLETED' and substring(start_dt, 1, 4) in ('1997', '1998') order by created_at desc, workitem_uid limit 400",
)
query(
    "qry_worklist",
    lambda v: S.worklist(v("v_worklist"), patient_name="custmer", fuzzy=True, modality="US", limit=5000, ceiling=300).select("sps_uid", "start_date", "start_time"),
    f"select sps_uid, start_date, start_time from v_worklist where modality = 'US' and regexp_matches(lower(translate(patient_name, '^=', '  ')), '{P.fuzzy_regex('custmer')}') order by start_date, start_time, sps_uid limit 300",
)
query(
    "qry_admin_instances",
    lambda v: S.admin_instances(v("v_studies"), v("v_instances"), auditor=True, description="*low*").select("sop_uid", "study_date", "patient_name", "study_description"),
    "select sop_uid, study_date, substring(patient_name, 1, 1) || repeat('*', length(patient_name) - 2) || right(patient_name, 1) as patient_name, cast(null as varchar) as study_description from v_instances join v_studies using (study_uid) where lower(study_description) like '%low%' order by study_date desc nulls last, sop_uid limit 500",
)
query(
    "qry_hidden_instances",
    lambda v: S.hidden_instances(v("v_instances")).select("sop_uid", "reason", "meaning"),
    f"select sop_uid, reason, meaning from v_instances join (values {', '.join(map(str, S.REASONS))}) r(reason, meaning) using (reason)",
)


def _journal(v):
    lines = v("v_access").withColumns({"day": F.to_date("ts"), "action": F.when(F.col("route") == "stow_studies", "C").otherwise("R")})
    return line_ordinal(lines, "day", F.struct("ts", "event_id"))


query(
    "qry_access_log",
    lambda v: S.journal(_journal(v), "ordinal", F.col("ts"), low="2024-01-05", high="2024-01-20", action="C", limit=300).select("ordinal", "event_id", "user_name"),
    "select ordinal, event_id, user_name from (select *, row_number() over (order by ts, event_id) as ordinal from v_access) where ts between timestamp '2024-01-05' and timestamp '2024-01-20' and route = 'stow_studies' order by ordinal desc limit 300",
)
query(
    "qry_delete_trail",
    lambda v: S.journal(_journal(v).where("status >= 400").withColumn("ts", F.expr("case when event_id % 3 = 0 then null else ts end")), "ordinal", F.coalesce("ts", F.col("day").cast("timestamp")), low="2024-01-10", limit=200).select("ordinal", "event_id", F.col("at")),
    "select ordinal, event_id, case when event_id % 3 = 0 then date_trunc('day', ts) else ts end as at from (select *, row_number() over (order by ts, event_id) as ordinal from v_access) where status >= 400 and (case when event_id % 3 = 0 then date_trunc('day', ts) else ts end) >= timestamp '2024-01-10' order by ordinal desc limit 200",
)
ASKED = {"study": ["00081030", "nonsense", "institution_name"], "series": ["0008103E", "00201209"], "instance": ["00280008"]}


def _fields(level: str, rows):
    return rows.select(*S.include_fields(level, rows.columns, ASKED[level]))


query(
    "prj_includefield", lambda v: _fields("study", full_studies(v)),
    TOTALS + "select study_date, study_time, accession_number, modalities_in_study, referring_physician, patient_name, patient_id, birth_date, sex, study_uid, study_id, series_count, instance_count, study_description, institution_name from st",
)
query(
    "prj_includefield_series", lambda v: _fields("series", v("v_series").join(v("v_instances").groupBy("series_uid").agg(F.count("*").alias("instance_count")), "series_uid")),
    "select modality, series_uid, series_number, instance_count, series_description from v_series join (select series_uid, count(*) as instance_count from v_instances group by all) using (series_uid)",
)
query("prj_includefield_instance", lambda v: _fields("instance", v("v_instances")), "select sop_class, sop_uid, study_uid, series_uid, instance_number, frames from v_instances")
query("prj_includefield_all", lambda v: (lambda d: d.select(*S.include_fields("series", d.columns, ["all"])))(v("v_series")), "select * from v_series")
query(
    "qry_studies_keys",
    lambda v: S.studies(v("v_studies"), referring_physician="Doctor^1*", performing_physician="*", reading_physicians="reader?7", requesting_physician="Ward^*", requested_procedure_description="proc ?", study_id="S*", other_patient_ids="Y6, Y12,Y18,Y24,Y30,Y36,Y42,Y48,Y90").select("study_uid", "study_id", "other_patient_ids"),
    "select study_uid, study_id, other_patient_ids from v_studies where referring_physician like 'Doctor^1%' and lower(reading_physicians) like 'reader_7' and list_has_any(string_split(other_patient_ids, ','), ['Y6', 'Y12', 'Y18', 'Y24', 'Y30', 'Y36', 'Y42', 'Y48', 'Y90'])",
)
query(
    "qry_studies_series_keys",
    lambda v: S.studies(v("v_studies"), responsible_person="owner*", modality="CT,MR", series_number="1*", series_rows=v("v_series")).select("study_uid", "responsible_person"),
    "select study_uid, responsible_person from v_studies where responsible_person is not null and study_uid in (select study_uid from v_series where modality in ('CT', 'MR') and series_number like '1%')",
)
query(
    "qry_workitems_keys",
    lambda v: S.workitems(v("v_workitems"), step_label="step 2", workitem_code="code4", procedure_id="RP20").select("workitem_uid", "step_label"),
    "select workitem_uid, step_label from v_workitems where step_label = 'step 2' and workitem_code = 'code4' and procedure_id = 'RP20'",
)
query(
    "snk_search_json",
    lambda v: search_json(v("v_studies").select("study_uid", "study_date", "patient_name", "sex"), {"study_uid": ("0020000D", "UI"), "study_date": ("00080020", "DA"), "patient_name": ("00100010", "PN"), "sex": ("00100040", "CS")}).select("study_uid", "json"),
    """select study_uid, '{' || case when study_date is null then '' else '"00080020":{"vr":"DA","Value":["' || cast(study_date as varchar) || '"]},' end || '"00100010":{"vr":"PN","Value":[{"Alphabetic":"' || patient_name || '"}]},"00100040":{"vr":"CS","Value":["' || sex || '"]},"0020000D":{"vr":"UI","Value":["' || study_uid || '"]}}' as json from v_studies""",
)
query(
    "snk_audit_message",
    lambda v: audit_message(
        v("v_access").select(
            "event_id", "status", F.expr("case when event_id % 5 = 0 then 'X' else 'R' end").alias("action"), F.col("event_id").alias("ts"), F.expr("case event_id % 3 when 0 then '110103' when 1 then '110112' end").alias("atna"),
            F.expr("case when event_id % 7 > 0 then user_name || '<&>' end").alias("user"), F.lit("'").alias("src"), F.expr("nullif(src_ip, '10.0.0.0')").alias("src_ip"), "study", F.expr("case when event_id % 2 = 0 then series end").alias("series"),
            F.expr("case when event_id % 4 = 0 then user_name end").alias("patient"), F.expr("case when event_id % 3 = 1 then 'Modality=\"CT\"&limit=' || event_id else '' end").alias("q"),
        )
    ).select("event_id", "message"),
    """select event_id, '<109>1 ' || event_id || ' - archive - ' || case event_id % 3 when 0 then '110103' when 1 then '110112' else '-' end || ' - ' || chr(65279) || '<AuditMessage><EventIdentification'
      || case when event_id % 5 = 0 then '' else ' EventActionCode="R"' end || ' EventOutcomeIndicator="' || case status // 100 when 4 then '4' when 5 then '8' else '0' end || '" EventDateTime="' || event_id || '">'
      || case event_id % 3 when 0 then '<EventID csd-code="110103" codeSystemName="DCM" displayName="DICOM Instances Accessed" />' when 1 then '<EventID csd-code="110112" codeSystemName="DCM" displayName="Query" />' else '' end
      || '</EventIdentification><ActiveParticipant UserID="' || case when event_id % 7 > 0 then user_name || '&lt;&amp;&gt;' else '&apos;' end || '" UserIsRequestor="true"'
      || case when src_ip = '10.0.0.0' then '' else ' NetworkAccessPointID="' || src_ip || '" NetworkAccessPointTypeCode="2"' end || ' /><AuditSourceIdentification AuditSourceID="&apos;"><AuditSourceTypeCode csd-code="3" /></AuditSourceIdentification>'
      || '<ParticipantObjectIdentification ParticipantObjectID="' || study || '" ParticipantObjectTypeCode="2"><ParticipantObjectIDTypeCode csd-code="110180" codeSystemName="DCM" /><ParticipantObjectName>' || study || '</ParticipantObjectName></ParticipantObjectIdentification>'
      || case when event_id % 2 = 0 then '<ParticipantObjectIdentification ParticipantObjectID="' || series || '" ParticipantObjectTypeCode="2"><ParticipantObjectIDTypeCode csd-code="110181" codeSystemName="DCM" /><ParticipantObjectName>' || series || '</ParticipantObjectName></ParticipantObjectIdentification>' else '' end
      || case when event_id % 4 = 0 then '<ParticipantObjectIdentification ParticipantObjectID="' || user_name || '" ParticipantObjectTypeCode="1" ParticipantObjectTypeCodeRole="1"><ParticipantObjectIDTypeCode csd-code="2" codeSystemName="DCM" /><ParticipantObjectName>' || user_name || '</ParticipantObjectName></ParticipantObjectIdentification>' else '' end
      || case when event_id % 3 = 1 then replace('<ParticipantObjectIdentification ParticipantObjectID="?" ParticipantObjectTypeCode="2" ParticipantObjectTypeCodeRole="24"><ParticipantObjectIDTypeCode csd-code="10" codeSystemName="DCM" /><ParticipantObjectQuery>?</ParticipantObjectQuery></ParticipantObjectIdentification>', '?', 'Modality=&quot;CT&quot;&amp;limit=' || event_id) else '' end
      || '</AuditMessage>' as message from v_access""",
)
query(
    "qry_hidden_page",
    lambda v: S.hidden_page(v("v_studies"), v("v_instances"), auditor=True, offset=20, limit=100, reason=113037),
    """select i.sop_uid, i.study_uid, i.series_uid, i.modality, i.reason, 'patient-safety' as meaning, i.file_size, coalesce(s.patient_id, '') as patient_id,
      case when length(coalesce(patient_name, '')) <= 2 then repeat('*', length(coalesce(patient_name, ''))) else patient_name[1] || repeat('*', length(patient_name) - 2) || patient_name[-1] end as patient_name
      from (select * from v_instances where reason = 113037 order by sop_uid limit 100 offset 20) i left join v_studies s using (study_uid)""",
)
query(
    "qry_access_log_total",
    lambda v: S.journal(_journal(v), "ordinal", F.col("ts"), low="2024-01-05", action="C", offset=10, limit=50, total=True).select("ordinal", "event_id", "user_name", "total"),
    "select ordinal, event_id, user_name, count(*) over () as total from (select *, row_number() over (order by ts, event_id) as ordinal from v_access) where ts >= timestamp '2024-01-05' and route = 'stow_studies' order by ordinal desc limit 50 offset 10",
)
