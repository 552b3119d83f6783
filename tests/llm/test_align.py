"""op11: interval coalescing against a walk over both tokenizers' tokens, and on hard rows."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from studylake.llm import align
from studylake.llm.tokens import path_of, tokenizer

from .test_operators import HARD, corpus, docs_of


def plain(rows):
    """id -> the query's columns, by whole texts and one step a token."""
    import sentencepiece

    a_model, b_model, both = tokenizer(path_of(align.A)), sentencepiece.SentencePieceProcessor(model_file=path_of(align.B)), align.tokenizers()
    found, pairs = [], Counter()
    for doc_id, text in rows:
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        x, y = [both.a_bytes[k] for k in a], [both.b_bytes[k] for k in b]
        if not text or not b"".join(x) == b"".join(y) == (" " + text).encode():
            found.append((doc_id, None))
            continue
        links, groups, i, j, at_a, at_b, group = [], [], 0, 0, len(x[0]), len(y[0]), ([a[0]], [b[0]])
        while True:
            links.append((a[i], b[j]))
            if at_a == at_b:
                groups.append("|".join(",".join(map(str, side)) for side in group))
                i, j, group = i + 1, j + 1, ([], [])
                if i == len(a):
                    break
            step_a = not group[0] or at_a < at_b
            step_b = not group[1] or not step_a
            if not group[0] and not group[1]:
                group = ([a[i]], [b[j]])
                at_a, at_b = at_a + len(x[i]), at_b + len(y[j])
            elif step_a:
                i += 1
                at_a += len(x[i])
                group[0].append(a[i])
            elif step_b:
                j += 1
                at_b += len(y[j])
                group[1].append(b[j])
        pairs.update(links)
        found.append((doc_id, (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    best = Counter()
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    out = []
    for doc_id, f in found:
        if f:
            out.append((doc_id, *f[:3], len(f[3]), sum(pairs[p] == best[p[1]] for p in f[3]), sum(pairs[p] for p in f[3]), f[4]))
        else:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


MORE = [(20, "x▁y"), (21, "a\r\nb } \r\n c"), (22, "  two  blanks  "), (23, "<s> </s> <unk> <0x0A>"), (24, "tab\tnbsp\xa0em x　y"), (25, "naïve café, 12.5% (e.g.) l'été"), (26, "\x00\x01 nul")]


@pytest.mark.parametrize("batch_size", [300, 10_000_000])
def test_alignment_is_the_walk(spark, batch_size):
    rows = [*corpus(), *HARD, *MORE]
    assert got(align.align(docs_of(spark, rows), batch_size=batch_size)) == plain(rows)


def test_no_rows(spark):
    assert got(align.align(docs_of(spark, []))) == []
    assert got(align.align(docs_of(spark, [(1, None), (1, "")]))) == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_long_text_in_pieces(spark):
    """A text of over two million characters is cut and aligned piece by piece, as the whole would be."""
    rows = [(1, " ".join(t for _, t in corpus(60, seed=3)) * 100)]
    assert len(rows[0][1]) > 2_000_000 and len(align.cuts(" " + rows[0][1])) > 1
    assert got(align.align(docs_of(spark, rows))) == plain(rows)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("ab,.' \n\r\t\xa0é’}();") + ["\U0001f600", "　"]), max_size=40))
def test_stretches_encode_as_the_whole(text):
    import sentencepiece

    both = align.tokenizers()
    (pieces,) = both.encode(text)
    assert pieces[0].tolist() == tokenizer(path_of(align.A)).encode(" " + text, add_special_tokens=False).ids
    assert pieces[1].tolist() == (sentencepiece.SentencePieceProcessor(model_file=path_of(align.B)).encode(text) if text else [28705])


@given(st.lists(st.integers(1, 4), max_size=20), st.lists(st.integers(1, 4), max_size=20))
def test_coalesce_finds_every_overlap(a, b):
    n = min(sum(a), sum(b))
    a, b = ([min(x, n - at) for x, at in zip(s, np.cumsum([0, *s]), strict=False) if at < n] for s in (a, b))
    group_a, group_b, left, right = align.coalesce(np.array(a, np.int64), np.array(b, np.int64))
    spans = [[(at, at + x) for x, at in zip(s, np.cumsum([0, *s]), strict=False)] for s in (a, b)]
    assert list(zip(left, right, strict=True)) == [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
    edges = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    assert all(group_a[i] == sum(x <= s for x in edges) for i, (s, _) in enumerate(spans[0]))
    assert all(group_b[i] == sum(x <= s for x in edges) for i, (s, _) in enumerate(spans[1]))
