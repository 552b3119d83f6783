"""Joins of the archive: owners, presence, coverage, orphans, rules, subscriptions, references, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import rule_text
from ..functions.text import pn_ngrams
from ..session import cut

#: Small tables (rules, subscriptions, codes) come with the site's configuration; more rows than this are joined without a broadcast.
SMALL = 10_000


def small(rows: DataFrame) -> DataFrame:
    """rows, broadcast if they are few: counted up to the bound, since their number is not known here."""
    return F.broadcast(rows) if rows.limit(SMALL + 1).count() <= SMALL else rows


def owner(keys: DataFrame, archive: DataFrame, key: str) -> DataFrame:
    """Each key with its study, null where there is none."""
    return keys.join(archive.select(key, F.col("study_uid").alias("owner_study")).groupBy(key).agg(F.min("owner_study").alias("owner_study")), key, "left")


def commit_presence(requests: DataFrame, archive: DataFrame) -> DataFrame:
    """Requested instances with found; a study hint must agree. Archive instance ids are unique."""
    held = archive.select(F.col("sop_uid").alias("_sop"), F.col("study_uid").alias("_study"))
    return requests.join(held, (F.col("sop_uid") == F.col("_sop")) & (F.col("study_hint").isNull() | (F.col("study_hint") == F.col("_study"))), "left").withColumn("found", F.col("_sop").isNotNull()).drop("_sop", "_study")


def covered_studies(archive: DataFrame, committed: DataFrame) -> DataFrame:
    """Studies of which every stored instance is committed."""
    done = committed.select("sop_uid").distinct().withColumn("_in", F.lit(1))
    return archive.select("study_uid", "sop_uid").join(done, "sop_uid", "left").groupBy("study_uid").agg(F.count("*").alias("instances"), F.count_if(F.col("_in").isNull()).alias("missing")).where("missing = 0").select("study_uid", "instances")


def orphan_blobs(blobs: DataFrame, references: DataFrame, unreadable: int = 0) -> DataFrame:
    """Blobs without a reference. Fails where a record could not be read, or where there is no reference at all."""
    if unreadable:
        raise ValueError(f"{unreadable} records can't be read: no blob can be called an orphan")
    if references.limit(1).count() == 0:
        raise ValueError("no references at all: refusing to call every blob an orphan")
    return blobs.join(references.select("blob_hash").where("blob_hash is not null"), "blob_hash", "left_anti")


def orphan_split(listed: DataFrame, references: DataFrame) -> DataFrame:
    """Listed orphans with removable or still referenced."""
    live = references.select("blob_hash").distinct().withColumn("_live", F.lit(True))
    return listed.join(live, "blob_hash", "left").withColumn("verdict", F.when(F.col("_live"), "referenced").otherwise("removable")).drop("_live")


def shared_blobs(references: DataFrame) -> DataFrame:
    """Blobs that more than one study refers to. Distinct pairs first, so a blob of many references is counted in parts."""
    return references.select("blob_hash", "study_uid").distinct().groupBy("blob_hash").agg(F.count("*").alias("studies")).where("studies > 1")


def exclusive_hot(references: DataFrame, studies: DataFrame) -> DataFrame:
    """Hashes of the studies that no other study holds hot."""
    chosen = studies.select("study_uid").distinct()
    mine = references.join(chosen, "study_uid", "left_semi").select("blob_hash").distinct()
    others = references.where("tier = 'hot'").join(chosen, "study_uid", "left_anti").select("blob_hash")
    return mine.join(others, "blob_hash", "left_anti")


def index_gap(records: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    return records.select(*keys).distinct().join(index.select(*keys), keys, "left_anti")


#: Characters of a pattern's literal beginning that the index uses at most, and parts over which patterns without one are dealt.
PREFIX, SALTS = 8, 64


def _literal(pattern: Column) -> Column:
    """The beginning of a LIKE pattern up to its first wildcard or escape."""
    return F.regexp_extract(pattern, r"^[^%_\\]*", 0)


def by_patterns(rows: DataFrame, rules: DataFrame, tests: dict[str, Column], most: int = SMALL) -> DataFrame:
    """Each row with every rule that fits. tests: rule column (a LIKE pattern, null fits all) -> the row's value, which fits no pattern where it is null.

    Up to `most` rules (counted when the plan is built) are broadcast. More go through an index: each rule is posted once, under that of its constants or literal beginnings which the
    fewest rules share; the rows' distinct values are looked up by their own constants and beginnings, and what meets is tested in full. Rules of wildcards only meet dealt values.
    No join is without a key, and rows are joined back by their values. (A stream has no distinct values to look up: it meets all rules.)
    """
    fits = reduce(lambda a, b: a & b, [F.col(p).isNull() | F.coalesce(F.like(F.col(v), F.col(p)), F.lit(False)) for p, v in ((p, f"_v{i}") for i, p in enumerate(tests))])
    given = rows.withColumns({f"_v{i}": v for i, v in enumerate(tests.values())})
    names = [f"_v{i}" for i in range(len(tests))]
    few = rules.limit(most + 1).count() <= most
    if few or rows.isStreaming:
        return given.join(F.broadcast(rules) if few else rules, fits).drop(*names)
    key = lambda i, kind, c: F.when(F.length(c) > 0, F.concat(F.lit(f"{i}{kind}"), c))
    posted = rules.withColumn("_rule", F.monotonically_increasing_id())
    offers = [key(i, "=", F.col(p)) if kind == "=" else key(i, "^", F.left(_literal(F.col(p)), F.lit(PREFIX))) for i, p in enumerate(tests) for kind in "=^"]
    offers = [F.when(_literal(F.col(p)) == F.col(p), o) if kind == "=" else o for (p, kind), o in zip(((p, kind) for p in tests for kind in "=^"), offers, strict=True)]
    posted = cut(posted.withColumn("_keys", F.array_compact(F.array(*offers))), "rules")
    each = posted.select("_rule", F.explode("_keys").alias("_key"))
    shared = each.groupBy("_key").agg(F.count("*").alias("_n"))
    chosen = each.join(shared, "_key").groupBy("_rule").agg(F.min(F.struct("_n", "_key"))["_key"].alias("_key"))
    values = cut(given.select(*names).distinct().withColumn("_value", F.monotonically_increasing_id()), "values")
    looks = [k for i, v in enumerate(names) for k in (key(i, "=", F.col(v)), *(key(i, "^", F.left(F.col(v), F.lit(n))) for n in range(1, PREFIX + 1)))]
    asked = values.select(*names, "_value", F.explode(F.array_distinct(F.array_compact(F.array(*looks)))).alias("_key"))
    patterns = posted.select("_rule", *tests)
    met = asked.join(patterns.join(chosen, "_rule"), "_key").where(fits).select("_value", "_rule")
    bare = posted.where(F.size("_keys") == 0).select("_rule", *tests, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rest = values.withColumn("_salt", F.pmod(F.col("_value"), F.lit(SALTS)).cast("int")).join(bare, "_salt").where(fits).select("_value", "_rule")
    hits = met.unionByName(rest).join(values, "_value").join(posted.drop("_keys"), "_rule").drop("_rule", "_value")
    back = hits.withColumnsRenamed({n: f"_b{n}" for n in names})
    return given.join(back, reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_b{n}")) for n in names])).drop(*names, *(f"_b{n}" for n in names))


def all_rules(studies: DataFrame, rules: DataFrame, most: int = SMALL) -> DataFrame:
    """Each study with every rule that fits. rules: position, name, r_modality, r_body_part, r_study_description (LIKE patterns, null fits all)."""
    return by_patterns(studies, rules, {f"r_{c}": rule_text(F.col(c)) for c in ("modality", "body_part", "study_description")}, most)


def first_rule(studies: DataFrame, rules: DataFrame, key: str, fallback: str, most: int = SMALL) -> DataFrame:
    """Each study with the first rule that fits, else the fallback."""
    hits = all_rules(studies, rules, most).groupBy(key).agg(F.min_by("name", "position").alias("rule"))
    return studies.select(key).join(hits, key, "left").select(key, F.coalesce("rule", F.lit(fallback)).alias("rule"))


def subscribers(events: DataFrame, subscriptions: DataFrame, keys: list[str], most: int = SMALL) -> DataFrame:
    """event x subscription: each key null fits all, else a LIKE pattern; a missing value fits no pattern; s_workitem_uid narrows to one."""
    literal = F.regexp_replace("s_workitem_uid", r"([%_\\])", r"\\$1")
    narrowed = subscriptions.withColumn("_only", literal)
    return by_patterns(events, narrowed, {**{f"s_{k}": F.col(k) for k in keys}, "_only": F.col("workitem_uid")}, most).drop("_only")


def cascade(derived: DataFrame, classes: list[str], deleted: DataFrame) -> DataFrame:
    """Derived objects of the classes that refer to a deleted series or instance. derived: sop_uid, sop_class, refs (array); deleted: uid."""
    refs = derived.where(F.col("sop_class").isin(*classes)).select("sop_uid", F.explode("refs").alias("uid"))
    return refs.join(deleted.select("uid").distinct(), "uid", "left_semi").select("sop_uid").distinct()


def catalog_tasks(study_modalities: DataFrame, codes: DataFrame, existing: DataFrame, never: list[str], fallback: str) -> DataFrame:
    """One task for each (study, code); trigger: the smallest modality. codes: modality, code, manual. The fallback code only where a candidate modality matched no code."""
    candidates = study_modalities.where(~F.col("modality").isin(*never)).select("study_uid", "modality").distinct()
    hits = candidates.join(small(codes.where("not manual").select("modality", "code")), "modality", "left")
    coded = hits.where("code is not null").groupBy("study_uid", "code").agg(F.min("modality").alias("trigger"))
    bare = hits.groupBy("study_uid").agg(F.min("modality").alias("trigger"), F.count("code").alias("n")).where("n = 0").select("study_uid", F.lit(fallback).alias("code"), "trigger")
    return coded.unionByName(bare).join(existing.select("study_uid", "code"), ["study_uid", "code"], "left_anti")


def ngram_candidates(names: DataFrame, key: str, name: str, query: Column) -> DataFrame:
    """Keys whose name has all n-grams of the query."""
    asked = F.array_distinct(pn_ngrams(query))
    return names.select(key, F.explode(pn_ngrams(F.col(name))).alias("gram")).where(F.array_contains(asked, F.col("gram"))).groupBy(key).agg(F.count_distinct("gram").alias("grams")).where(F.col("grams") == F.size(asked)).select(key)


def fuzzy_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of names (a, b) within one edit.

    Two such names have a form in common: themselves or what one deletion leaves of them. So distinct names meet on their hashed forms; a form belongs only to names one
    insertion away from it, so a common beginning makes no hot key. Pairs are tested before they are shuffled again.
    """
    a, b = (x.select(F.col(x.columns[0]).alias(n)).where(f"{n} is not null").distinct() for x, n in ((left, "a"), (right, "b")))

    def forms(c: str) -> Column:
        less = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.xxhash64(F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.length(c)))))
        return F.array_distinct(F.when(F.length(c) > 0, F.concat(F.array(F.xxhash64(c)), less)).otherwise(F.array(F.xxhash64(c))))

    pairs = a.select("a", F.explode(forms("a")).alias("form")).join(b.select("b", F.explode(forms("b")).alias("form")), "form")
    return pairs.where(F.levenshtein("a", "b", 1) >= 0).select("a", "b").distinct()


def result_diff(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, verdict: only_left, only_right or different."""
    a, b = left.select(key, F.col(value).alias("_a"), F.lit(1).alias("_l")), right.select(key, F.col(value).alias("_b"), F.lit(1).alias("_r"))
    verdict = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(~F.col("_a").eqNullSafe(F.col("_b")), "different")
    return a.join(b, key, "full_outer").select(key, verdict.alias("verdict")).where("verdict is not null")
