"""Scalar text functions. Each takes and returns Columns; nulls stay null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys whose values name a person (tags and keywords, lower case).
NAME_KEYS = (
    "00100010", "patientname", "00080090", "referringphysicianname", "00081050", "performingphysicianname", "00081060", "nameofphysiciansreadingstudy", "00081070", "operatorsname",
    "00101001", "otherpatientnames", "00101000", "otherpatientids", "00101002", "otherpatientidsequence", "00104000", "patientcomments", "00400275", "requestedprocedurecomments",
)
QUERY_CAP = 1024


def pn_groups(name: Column) -> Column:
    """alphabetic=ideographic=phonetic; an empty or missing second or third group is null."""
    p = F.split(name, "=")
    return F.when(name.isNotNull(), F.struct(F.get(p, F.lit(0)).alias("alphabetic"), F.nullif(F.get(p, F.lit(1)), F.lit("")).alias("ideographic"), F.nullif(F.get(p, F.lit(2)), F.lit("")).alias("phonetic")))


def pn_normalize(name: Column) -> Column:
    """Component and group signs as blanks, lower case."""
    return F.lower(F.translate(name, "^=", "  "))


def _bare(name: Column) -> Column:
    return F.lower(F.translate(name, "^=", ""))


def pn_ngrams(name: Column, at_most: int = 3) -> Column:
    """Sliding windows of the bare lower-case name, as hex of their UTF-8; as long as the name, at most three characters. Empty name: no windows."""
    b = _bare(name)
    n = F.least(F.length(b), F.lit(at_most))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(b) - n + 1, F.lit(1))), lambda i: F.hex(F.encode(F.substring(b, i, n), "UTF-8")))
    return F.when(F.length(b) == 0, F.array().cast("array<string>")).when(b.isNotNull(), grams)


def mask_name(name: Column) -> Column:
    """First and last character stay; all of a name of two or fewer goes."""
    n = F.length(name)
    return F.when(n <= 2, F.rpad(F.lit(""), n, "*")).otherwise(F.concat(F.substring(name, F.lit(1), F.lit(1)), F.rpad(F.lit(""), n - 2, "*"), F.substring(name, n, F.lit(1))))


def mask_query(query: Column, cap: int = QUERY_CAP) -> Column:
    """Values of keys that name a person become ***, key by key; then cut to so many bytes at a character's end."""

    def part(s: Column) -> Column:
        at = F.instr(s, "=")
        key = F.substring(s, F.lit(1), at - 1)
        plain = F.lower(F.translate(F.coalesce(F.try_url_decode(key), key), ",", ""))
        return F.when((at > 0) & plain.isin(*NAME_KEYS), F.concat(key, F.lit("=***"))).otherwise(s)

    masked = F.array_join(F.transform(F.split(query, "&"), part), "&")
    # Bytes up to each character's end; characters after the cap go. Only long texts are walked.
    ends = F.filter(F.sequence(F.lit(1), F.length(masked)), lambda i: F.octet_length(F.substring(masked, F.lit(1), i)) <= cap)
    return F.when(F.octet_length(masked) <= cap, masked).otherwise(F.substring(masked, F.lit(1), F.array_max(ends)))


def sanitize_controls(text: Column) -> Column:
    """Control characters and line or paragraph separators become '?'."""
    return F.regexp_replace(text, r"[\p{Cc}  ]", "?")


def stable_uid(*parts: Column) -> Column:
    """2.25.<number> from the parts, joined by | with | and \\ escaped; null where all are empty."""
    clean = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    joined = F.concat_ws("|", *(F.regexp_replace(p, r"([|\\])", r"\\$1") for p in clean))
    digits = F.conv(F.substring(F.sha2(joined, 256), 1, 15), 16, 10)
    return F.when(F.concat(*clean) != "", F.concat(F.lit("2.25."), digits))


def status_class(status: Column) -> Column:
    """4xx and 5xx by their hundreds; anything else counts as 2xx."""
    h = F.floor(status / 100)
    return F.when(h == 4, "4xx").when(h == 5, "5xx").otherwise("2xx")


def outcome_code(status: Column) -> Column:
    """Audit outcome of a status, number or text: 2xx-3xx '0', 4xx '4', 5xx '8', unreadable '0'."""
    n = status.try_cast("int")
    return F.when((n >= 400) & (n < 500), "4").when((n >= 500) & (n < 600), "8").otherwise("0")


def split_multi(text: Column, separator: str = ",") -> Column:
    """Trimmed elements of a comma or backslash list."""
    return F.transform(F.split(text, r"\\" if separator == "\\" else separator), lambda x: F.trim(x))


#: Methods (none: any), path, whether longer paths count as well, family; the first that fits counts.
ROUTES = (
    ((), "/admin/v1/", True, "admin"),
    (("GET", "HEAD"), "/health", False, "health"), (("GET", "HEAD"), "/health/status", False, "health"), (("GET", "HEAD"), "/metrics", False, "metrics"),
    (("GET", "HEAD"), "/dicomweb/patients", False, "qido_patients"), (("GET", "HEAD"), "/dicomweb/studies", False, "qido_studies"), (("GET", "HEAD"), "/dicomweb/studies/", True, "wado_study"),
    (("POST",), "/dicomweb/studies", False, "stow_studies"), (("POST",), "/dicomweb/studies/", True, "stow_studies"),
    (("GET", "HEAD", "POST"), "/dicomweb/commitment-requests", True, "commitment"), (("GET", "HEAD", "POST", "PUT"), "/dicomweb/workitems", True, "ups"),
)


def route_class(method: Column, path: Column) -> Column:
    """One of ten families by method and path (without its query)."""
    plain, c = F.substring_index(path, "?", 1), F.when(F.lit(False), "other")
    for methods, start, longer, name in ROUTES:
        fits = plain.startswith(start) if longer else plain == start
        c = c.when(fits & method.isin(*methods) if methods else fits, name)
    return c.otherwise("other")


def audit_action(action: Column, query: Column) -> Column:
    """A create whose query has the parameter update is an update."""
    return F.when((action == "C") & F.coalesce(query, F.lit("")).rlike("(^|&)update(=|&|$)"), "U").otherwise(action)


#: Value representation and keyword of the tags that searches know.
TAGS = {
    "00080016": ("UI", "SOPClassUID"),
    "00080018": ("UI", "SOPInstanceUID"),
    "00080020": ("DA", "StudyDate"),
    "00080021": ("DA", "SeriesDate"),
    "00080030": ("TM", "StudyTime"),
    "00080031": ("TM", "SeriesTime"),
    "00080050": ("SH", "AccessionNumber"),
    "00080060": ("CS", "Modality"),
    "00080061": ("CS", "ModalitiesInStudy"),
    "00080070": ("LO", "Manufacturer"),
    "00080080": ("LO", "InstitutionName"),
    "00080090": ("PN", "ReferringPhysicianName"),
    "00081010": ("SH", "StationName"),
    "00081030": ("LO", "StudyDescription"),
    "0008103E": ("LO", "SeriesDescription"),
    "00081040": ("LO", "InstitutionalDepartmentName"),
    "00081050": ("PN", "PerformingPhysicianName"),
    "00081060": ("PN", "NameOfPhysiciansReadingStudy"),
    "00081070": ("PN", "OperatorsName"),
    "00100010": ("PN", "PatientName"),
    "00100020": ("LO", "PatientID"),
    "00100021": ("LO", "IssuerOfPatientID"),
    "00100030": ("DA", "PatientBirthDate"),
    "00100040": ("CS", "PatientSex"),
    "00180015": ("CS", "BodyPartExamined"),
    "00181030": ("LO", "ProtocolName"),
    "0020000D": ("UI", "StudyInstanceUID"),
    "0020000E": ("UI", "SeriesInstanceUID"),
    "00200010": ("SH", "StudyID"),
    "00200011": ("IS", "SeriesNumber"),
    "00200013": ("IS", "InstanceNumber"),
    "00200060": ("CS", "Laterality"),
    "00201206": ("IS", "NumberOfStudyRelatedSeries"),
    "00201208": ("IS", "NumberOfStudyRelatedInstances"),
    "00280008": ("IS", "NumberOfFrames"),
    "00321032": ("PN", "RequestingPhysician"),
    "00321060": ("LO", "RequestedProcedureDescription"),
}


def vr_of(tag: str) -> str:
    return TAGS.get(tag.upper(), ("UN", ""))[0]


def vr_lookup(tag: Column) -> Column:
    """Value representation of an eight-digit tag; UN for one that searches don't know."""
    known = F.create_map(*(F.lit(x) for t, (vr, _) in TAGS.items() for x in (t, vr)))
    return F.when(tag.isNotNull(), F.coalesce(F.try_element_at(known, F.upper(tag)), F.lit("UN")))


def tag_lookup(field: Column) -> Column:
    """The tag (eight hexadecimal digits, upper case) that a field of a request names, by its digits or by its keyword in any case; null for anything else."""
    keywords = F.create_map(*(F.lit(x) for t, (_, keyword) in TAGS.items() for x in (keyword.lower(), t)))
    f = F.trim(field)
    return F.when(f.rlike("^[0-9A-Fa-f]{8}$"), F.upper(f)).otherwise(F.try_element_at(keywords, F.lower(f)))


#: Route -> action, event id, object type, how many of study, series, instance it names, and whether the query is kept.
AUDIT_CODES = (
    [(r, "R", "110103", "110180", 3, False) for r in ("wado_instance", "wado_uri", "wado_frame", "wado_frame_thumbnail", "wado_bulkdata", "wado_thumbnail", "wado_rendered", "wado_frame_rendered")]
    + [(r, "R", "110103", "110180", 2, False) for r in ("wado_series", "wado_series_metadata", "wado_series_thumbnail")]
    + [(r, "R", "110103", "110180", 1, False) for r in ("wado_study", "wado_study_metadata", "wado_study_thumbnail", "wado_metadata")]
    + [("qido_patients", "R", "110110", "", 0, True)]
    + [(r, "R", "110112", "", 0, True) for r in ("qido_studies", "qido_study_instances", "qido_series", "qido_series_instances", "qido_series_global", "qido_series_root_instances", "qido_instances_global", "mwl_search")]
    + [(r, "C", "110104", "", 0, False) for r in ("stow_studies", "stow_study")]
    + [("mpps_create_or_update", "C", "110111", "110180", -1, False), ("mpps_get", "R", "110111", "110180", -1, False)]
    + [(r, "R", "110101", "", 0, False) for r in ("admin_audit_log", "admin_access_log")]
)
