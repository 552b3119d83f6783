"""op13: interval search against scores of all documents, its range maxima against slices, and hard rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from studylake.llm import queries, ranking

from ..oracle import SMALL, connection, rows
from .test_operators import HARD, corpus, docs_of


def plain(docs, items, k=50):
    """Every document's score for every item."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(i, Counter(split(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(split(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in counts:
            m = 50 + (50 * c.total() * n_docs) // total
            s = sum(ranking.weight(n_docs, df[t]) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            scored += [(-s, i is None, i or 0)] if s > 0 else []
        out += [(item, n, None if null else i, -s) for n, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "The cdecb, of and OF é"), (2, None), (3, ""), (None, "the one 12.5"), (4, "word word a"), (5, "zzzz"), (5, "and AND one"), (6, "12 5 \x85 endoftext")]


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumns({c: F.lit(None).cast("string") for c in ("term", "block", "doc_id", "score", "rank")})


@pytest.mark.parametrize("k, item_bytes, postings", [(50, 8_000_000, 1_000_000), (3, 8_000_000, 50), (7, 900, 200)])
def test_rank_is_every_score(spark, k, item_bytes, postings):
    docs = [*corpus(), *HARD, (7, "one"), (7, "one"), (None, "one")]
    items = [*ITEMS, (9, " ".join(t for _, t in corpus(6, seed=5)))]
    found = ranking.rank(docs_of(spark, docs), items_of(spark, items), k, item_bytes, postings)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(docs, items, k)


def test_no_rows(spark):
    none = ranking.rank(docs_of(spark, []), items_of(spark, ITEMS))
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.count() == 0
    assert ranking.rank(docs_of(spark, HARD), items_of(spark, [])).count() == 0


def test_query_is_its_sql(spark):
    name = "op13_range_maximum_search"
    assert rows(queries.queries()[name](spark, SMALL).toPandas()) == rows(connection().sql(queries.oracle_sql()[name]).df())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 6), st.integers(1, 5))
def test_search_keeps_the_best_and_ties(seed, documents, n_terms, k):
    r = random.Random(seed)
    pairs = sorted({(r.randrange(n_terms), r.randrange(documents)) for _ in range(r.randint(1, 80))})
    term, document = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    impact = np.array([r.randint(1, 4) for _ in pairs], np.int64)
    block = ranking.Postings(term, document, impact, documents)
    for t, (a, b) in block.spans.items():
        for x in range(a, b):
            for y in range(x + 1, b + 1):
                assert impact[block.maxima(np.array([x]), np.array([y]))[0]] == impact[x:y].max(), t
    asked, floor = list(range(n_terms)), r.choice([0, 0, 5])
    scores = Counter()
    for (_, d), i in zip(pairs, impact.tolist(), strict=True):
        scores[d] += i
    least = max(floor, sorted(scores.values())[-k] if len(scores) >= k else 0)
    for front in (1, 3, 256):
        found = dict(zip(*(x.tolist() for x in ranking.search(block, asked, k, floor, front)), strict=True))
        assert all(found[d] == scores[d] for d in found)
        assert {d for d, s in scores.items() if s >= least} <= set(found)


def test_search_leaves_most_of_a_block_alone(monkeypatch):
    """Few documents hold the rare term, so the bounds end the search early."""
    r, n = random.Random(1), 5000
    pairs = [(0, d, r.randint(1, 5)) for d in range(n)] + [(1, d, 1000 + d) for d in range(0, n, 100)]
    term, document, impact = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    found, _ = ranking.search(ranking.Postings(term, document, impact, n), [0, 1], 10, 0, front=8)
    assert len(found) < 300
