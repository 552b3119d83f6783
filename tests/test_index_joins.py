"""Rules through the index equal the nested loop; names within one edit equal all pairs, also on names with one beginning."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from studylake.operators import joins


def studies_of(spark, n, seed=1):
    r = random.Random(seed)
    rows = [(f"s{i}", r.choice(["CT", "MR", "SR", None]), r.choice(["CHEST", "HEAD", "", None]), r.choice(["CT chest 50%_x", "Head axial", "head", "back\\slash", None, "Study " + str(r.randrange(50))])) for i in range(n)]
    return spark.createDataFrame(rows, "study_uid string, modality string, body_part string, study_description string")


def rules_of(spark, n, seed=2):
    r = random.Random(seed)
    pick = lambda *x: r.choice(x)
    rows = [(i, f"rule{i}", pick(None, "CT", "M_", "%R", "%"), pick(None, "CHEST", "H%", "%EA%", ""), pick(None, "CT%", "%chest%", "head%", "Head axial", "back\\\\slash", "Study 1_", "Study " + str(r.randrange(99)), "%")) for i in range(n)]
    made = spark.createDataFrame(rows, "position int, name string, r_modality string, r_body_part string, r_study_description string")
    return made.withColumns({c: F.lower(c) for c in made.columns[2:]})  # values are compared in lower case


def test_rule_index_equals_the_loop(spark):
    studies, rules = studies_of(spark, 120), rules_of(spark, 150)
    loop, index = (sorted(map(str, joins.all_rules(studies, rules, most).collect())) for most in (1000, 0))
    assert loop == index and len(loop) > 200
    first = [sorted(map(tuple, joins.first_rule(studies, rules, "study_uid", "none", most).collect())) for most in (1000, 0)]
    assert first[0] == first[1]


def test_subscription_index_equals_the_loop(spark):
    events = spark.createDataFrame([(f"W{i}%_\\"[: 2 + i % 4] + str(i), ["SCHEDULED", "DONE", None][i % 3], ["CT", "MR", None][i % 4 % 3]) for i in range(60)], "workitem_uid string, state string, modality string")
    subs = events.limit(20).select(F.col("workitem_uid").alias("s_workitem_uid"), F.lit(None).cast("string").alias("s_state"), F.lit("_R").alias("s_modality"), F.lit("a").alias("subscriber"))
    subs = subs.unionByName(spark.createDataFrame([(None, "SCHED%", None, "b"), (None, None, None, "c"), (None, "DONE", "CT", "d")], "s_workitem_uid string, s_state string, s_modality string, subscriber string"))
    got = [sorted(map(str, joins.subscribers(events, subs, ["state", "modality"], most).collect())) for most in (1000, 0)]
    assert got[0] == got[1] and len(got[0]) > 60


def test_many_rules_have_no_join_without_a_key(spark):
    """100,000 rules: constants and beginnings of many kinds."""
    rules = spark.range(100_000).select(F.col("id").cast("int").alias("position"), F.concat(F.lit("r"), "id").alias("name"), F.when(F.col("id") % 3 == 0, "ct").alias("r_modality"), F.lit(None).cast("string").alias("r_body_part"), F.when(F.col("id") % 1000 != 1, F.concat(F.lit("study "), "id", F.when(F.col("id") % 2 == 0, "%").otherwise(""))).otherwise(F.concat(F.lit("%"), "id")).alias("r_study_description"))
    found = joins.first_rule(studies_of(spark, 2000), rules, "study_uid", "none")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.where("rule <> 'none'").count() > 100


@pytest.mark.parametrize("seed", [1, 2])
def test_fuzzy_names_equal_all_pairs(spark, seed):
    r = random.Random(seed)
    names = lambda n: [("".join(r.choice("abé^ ") for _ in range(r.randint(0, 5))),) for _ in range(n)] + [(None,)]
    a, b = (spark.createDataFrame(names(60), "name string") for _ in "ab")
    got = {tuple(x) for x in joins.fuzzy_names(a, b).collect()}
    x, y = ({q[0] for q in d.collect() if q[0] is not None} for d in (a, b))

    def near(p, q):
        if abs(len(p) - len(q)) > 1 or p == q:
            return p == q
        k = next((i for i, (m, n) in enumerate(zip(p, q, strict=False)) if m != n), min(len(p), len(q)))
        return p[k + (len(p) >= len(q)) :] == q[k + (len(q) >= len(p)) :]

    assert got == {(p, q) for p in x for q in y if near(p, q)}


def test_a_hundred_thousand_names_with_one_beginning(spark):
    names = spark.range(100_000).select(F.concat(F.lit("PATIENT^WITH^ONE^PREFIX^"), F.lpad(F.conv(F.col("id") * 7919, 10, 36), 8, "0")).alias("name"))
    began = time.time()
    assert joins.fuzzy_names(names, names).count() >= 100_000
    assert time.time() - began < 120
