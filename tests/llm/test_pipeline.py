from __future__ import annotations

import itertools
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from studylake.llm import minhash, pii, queries, tokens  # noqa: E402

from .test_operators import exact_weights, near_classes  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names and 0 < out.count() <= docs.count(), name
            docs = out
    assert out.select("doc_id").distinct().count() == docs.count()


def test_pipeline_against_a_plain_version(spark):
    """Quality by its SQL, all pairs by exact weighted Jaccard, plain redaction, the tokenizer on whole texts."""
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    good = {i for i, kept in con.sql(f"select doc_id, kept from ({queries.oracle_sql()['op4_risk_controlled_quality']})").fetchall() if kept}
    texts = {i: t or "" for i, t in con.sql("select doc_id, text from documents").fetchall() if i in good}
    w = {i: (h, x) for i, h, x in exact_weights(sorted(texts.items()))}
    links = [(a, b) for a, b in itertools.combinations(w, 2) if minhash.weighted_jaccard(w[a], w[b]) >= 0.8]
    kept = set(near_classes(links, sorted(w)).values())
    assert 0 < len(kept) < len(texts)
    fitted, want = pii.fitted(), Counter()
    t = tokens.tokenizer(tokens.path_of("word_bpe_49k.json"))
    for i in kept:
        ids = np.array([*t.encode(pii.redacted(texts[i], fitted), add_special_tokens=False).ids, 2], "<u4")
        for a in range(0, len(ids), 4096):
            want[i, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes()), len(ids)] += 1
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in map(sorted, sequences.values()):
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(s[-1]) <= 4096


def test_native_operators_have_no_python_node(spark):
    for name in ("op3_shard_by_splitters", "op4_risk_controlled_quality", "op10_spotsigs", "spots_near_classes"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval")), name
