"""Each operator against a plain version, and on hard rows: nulls, empty and very long texts, ties, repeats, no rows, clashing names."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from studylake.llm import chat, idstore, lmscore, minhash, nbest, packing, pii, quality, sharding, spotsigs, tokens
from studylake.llm.components import components

CLASH = "size long, key string, minor long, tie long, row string, range int, shard string, words string, sigs string, block long, stratum string, n_words string, kept string, bands string, copy string, class_id string, digest string, root string, bin int, rank int, sequence_id string, spans string, x string, y string"


def docs_of(spark, rows):
    """doc_id, text (with lang, source, n_chars and names that the operators use inside)."""
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.when(F.col("doc_id") % 3 == 0, None).otherwise("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in CLASH.split(", ")})


def corpus(n=60, seed=1):
    r = random.Random(seed)
    words = ["the", "of", "and", *("".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(200))]
    texts = [" ".join(r.choice(words) + r.choice(["", "", ".", ",", "!"]) for _ in range(r.randint(5, 160))) for _ in range(n)]
    texts[3] = texts[2]
    texts[5] = texts[4] + " one more word"
    return list(enumerate(texts))


HARD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (6, "é́ \x85 <|endoftext|> 12.5 \U0001f600"), (7, "a" * 30_000), (8, "word " * 6000), (None, "null id text of some words"), (None, None), (9, "same row"), (9, "same row"), (10, "1 " * 3000)]


@pytest.fixture(scope="module")
def texts(spark):
    return docs_of(spark, corpus()).cache()


@pytest.fixture(scope="module")
def hard(spark):
    return docs_of(spark, HARD).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return docs_of(spark, [])


def test_hard_rows_and_no_rows(spark, hard, nothing):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    ops = {
        "pii": pii.find, "nbest": nbest.digests, "shard": sharding.shard, "quality": lambda d: quality.judge(d, labels), "pack": packing.pack, "lm": lmscore.score, "spots": spotsigs.compare_edits,
        "classes": spotsigs.near_classes, "redact": pii.redact, "keep": lambda d: quality.keep_good(d, labels),
    }
    out = {}
    for name, op in ops.items():
        assert op(nothing).count() == 0, name
        out[name] = op(hard).collect()
        assert len(out[name]) >= len(HARD) or name == "keep", name
    key = lambda i: -1 if i is None else i
    for name in ("pii", "nbest", "shard", "quality", "lm", "spots", "classes", "redact"):
        assert sorted(key(r.doc_id) for r in out[name]) == sorted(key(i) for i, _ in HARD), name
    assert all((r.n_email, r.n_ip, r.n_card, r.n_phone) == (0, 0, 0, 0) and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in out["pii"])
    assert all(r.decoded_same and len(r.scores) >= 1 for r in out["nbest"]) and {r.n_pieces for r in out["nbest"] if r.doc_id in (1, 2)} == {0}
    assert Counter(r.size for r in out["shard"]) == Counter(len((t or "").encode()) + 8 for _, t in HARD)
    by = defaultdict(list)
    for r in out["shard"]:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert Counter(r.n_chars for r in out["spots"]) == Counter(len(t or "") for _, t in HARD) and all(0 <= x <= 1 for r in out["spots"] for x in (r.near_edited, r.near_next))
    assert {key(r.doc_id): r.class_id for r in out["classes"] if r.doc_id in (2, 5, 9)} == {2: 1, 5: 4, 9: 9}
    same = lambda rows: Counter(map(str, (r.text for r in rows if r.doc_id != 10)))
    assert same(out["redact"]) == same(hard.collect()) and out["keep"] == []
    assert not any(r.kept for r in out["quality"])


# 1
def test_pii_base_spans():
    text = "mail a.b+c@x-y.co.uk, @b.c, d@e; 1.2.3.4, 999.1.1.1, 1.2.3.4.5; 4111 1111 1111 1111; 4111111111111112; +49 (30) 1234-567; +1 2"
    got = [(k, text[a:b]) for k, a, b in pii.base_spans(text)]
    assert got == [("email", "a.b+c@x-y.co.uk"), ("ip", "1.2.3.4"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 1234-567")]


@given(st.text("a@.1 +-()9", max_size=40))
@settings(max_examples=300, deadline=None)
def test_pii_base_is_what_the_patterns_say(text):
    import re

    want = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    want += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    want += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= sum(c.isdigit() for c in m[0]) <= 19 and pii.luhn(re.sub("[ -]", "", m[0]))]
    want += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    assert pii.base_spans(text) == want


def test_pii_field_on_held_out_sentences():
    w, found, gold, both = pii.fitted(), 0, 0, 0
    for text, spans in pii.training_sentences(250, seed=99):
        got = set(pii.field_spans(text, w))
        found, gold, both = found + len(got), gold + len(spans), both + len(got & set(spans))
    assert both / gold > 0.97 and both / found > 0.97


def test_pii_dynamic_programme_is_exact():
    r = random.Random(4)
    for _ in range(200):
        n = r.randint(1, 6)
        cands = [(i, j, "ip", r.uniform(-1, 2)) for i in range(n) for j in range(i + 1, n + 1) if r.random() < 0.5]
        best, total = 0.0, 0.0
        for k in range(len(cands) + 1):
            for chosen in itertools.combinations(cands, k):
                spans = sorted(c[:2] for c in chosen)
                if all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)):
                    s = sum(c[3] for c in chosen)
                    best, total = max(best, s), total + np.exp(s)
        value = {c[:3]: c[3] for c in cands}
        assert abs(sum(value[c] for c in pii.decode(n, cands)) - best) < 1e-9
        p = pii.expected(n, cands)
        assert all(-1e-9 <= x <= 1 + 1e-9 for x in p) and total >= 1


def test_pii_redacts_and_keeps_clean(spark):
    d = docs_of(spark, [(1, "call +1 (269) 555-3296 4524132264652876 or a.b [at] c [dot] org"), (2, "Version 2.0 of 2024-01-05, 12:30, clean.")])
    out = {r.doc_id: r.text for r in pii.redact(d).collect()}
    assert out == {1: "call [PHONE] [CARD] or [EMAIL]", 2: "Version 2.0 of 2024-01-05, 12:30, clean."}
    assert pii.redact(d).columns == d.columns


def test_pii_stretches_meet_no_text_twice():
    w = pii.fitted()
    for text in ("212-555-1234," + "x" * 200 + "5", "1 ٠١٢٣ 5 555-1234", "a" * 500 + "1" + "b" * 500 + " 212-555-1234", "٠١٢٣", "@" * 50, "5" + "y" * 3000 + " 4 " + "z" * 3000 + "6"):
        at = pii.stretches(text)
        assert all(a < b for a, b in at) and all(x[1] <= y[0] for x, y in zip(at, at[1:], strict=False)), text[:20]
        spans = pii.all_spans(text, w)[1]
        assert len(spans) == len(set(spans))
    assert pii.all_spans("212-555-1234," + "x" * 200 + "5", w)[1] == [("phone", 0, 12)]


# 2
def test_nbest_against_all_paths():
    p, r = nbest.pieces_of("piece_bpe_32k.model"), random.Random(2)
    for _ in range(60):
        s = nbest.SIGN + "".join(r.choice("theanq\n✓") for _ in range(r.randint(1, 7)))
        arcs, paths = p.arcs(s), {0: [(0.0, b"")]}
        for j in range(1, len(s) + 1):
            paths[j] = [(a + score, ids + more) for i, more, score in arcs[j] for a, ids in paths.get(i, [])]
        want = sorted(paths[len(s)], key=lambda x: -x[0])
        got = p.best(s, 6)
        assert np.allclose([x for x, _ in got], [x for x, _ in want[:6]]) and len({i for _, i in got}) == len(got) and {i for _, i in got} <= {i for _, i in want}


def test_forward_pass_gives_the_two_best():
    p, r = nbest.pieces_of("piece_bpe_32k.model"), random.Random(3)
    for n in (1, 2, 5, 9):
        same = ["".join(r.choice(nbest.SIGN + "theansi\n✓é") for _ in range(n)) for _ in range(150)]
        for s, (score, ids, gap) in zip(same, p.two_best(same), strict=True):
            best = p.best(s, 2)
            assert abs(score - best[0][0]) < 1e-9 and p.decode(np.frombuffer(ids, "<i4").tolist()) == s.replace(nbest.SIGN, " ")[1:]
            assert gap == (best[0][0] - best[1][0] if len(best) > 1 else float("inf"))


def test_nbest_of_texts_is_that_of_their_whole_lattice(spark):
    p = nbest.pieces_of("piece_bpe_32k.model")
    for text in ("the cat, sat on. a mat", "a  b\n\nc!", " x ", "", "été 3.14"):
        (got,), whole = nbest.segments([text], "piece_bpe_32k.model", 4), p.best(p.normal(text), 4)
        assert np.allclose([s for s, _ in got], [s for s, _ in whole[: len(got)]])
        assert all(p.decode(np.frombuffer(i, "<i4").tolist()) == text for _, i in got)
    d = docs_of(spark, [(1, "the cat"), (2, None)])
    rows = nbest.encode(d, 3)
    assert {(r.doc_id, r.text) for r in nbest.decode(rows).collect()} == {(1, "the cat"), (2, "")}


# 3
def test_shards(spark, texts):
    rows = sharding.shard(texts, shards=5).collect()
    assert sorted(r.doc_id for r in rows) == list(range(60))
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    t = dict(corpus())
    assert all(r.size == len(t[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(t[r.doc_id].encode()) for r in rows)
    bytes_of = Counter()
    for r in rows:
        bytes_of[r.shard] += r.size
    assert max(bytes_of.values()) - min(bytes_of.values()) <= 2 * max(r.size for r in rows)
    assert len({r.shard for r in rows if r.doc_id in (2, 3)}) == 1


def test_shards_split_a_hot_group(spark):
    d = docs_of(spark, [(i, "copy of one text") for i in range(900)] + [(i, f"other {i}") for i in range(900, 1800)])
    bytes_of = Counter()
    for r in sharding.shard(d).collect():
        bytes_of[r.shard] += r.size
    assert len(bytes_of) == 24 and max(bytes_of.values()) < 1.1 * min(bytes_of.values())


def test_shards_keep_groups_whole(spark):
    rows = [(i, f"text of its own {i}") for i in range(4000)] + [(9000 + 10 * g + k, f"copied text {g}") for g in range(60) for k in range(7)]
    where, bytes_of = defaultdict(set), Counter()
    for r in sharding.shard(docs_of(spark, rows), shards=8).collect():
        where[r.text_crc32].add(r.shard)
        bytes_of[r.shard] += r.size
    assert all(len(s) == 1 for s in where.values()) and max(bytes_of.values()) < 1.12 * min(bytes_of.values())


# 4
def test_quality_measures(spark, texts, hard):
    def plain(text):
        import re

        text = text or ""
        w = [x for x in re.split("[ \t-\r]+", text) if x]
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)

    extra = docs_of(spark, [(1, "a b c d a b c x a b"), (2, "x\n\nx\n y\nx # * |"), (3, "q " * 40)])
    for d in (texts, hard, extra):
        got = quality.measures(quality._plain(d), "doc_id", "text").collect()
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(r.text), r.text[:50]


def test_quality_cutoffs_are_certified(spark):
    assert abs(quality.binomial_tail(2, 10, 0.3) - sum(__import__("math").comb(10, i) * 0.3**i * 0.7 ** (10 - i) for i in range(3))) < 1e-12
    rows = [("en", i, i % 4 != 0) for i in range(6000)]
    measured = spark.createDataFrame(rows, "stratum string, doc_id long, good boolean").select("stratum", "doc_id", "good", *(F.lit(100).alias(c) for c in ("n_words", "word_chars", "n_lines")), F.when(~F.col("good"), 30).otherwise(F.col("doc_id") % 3).alias("n_symbols"), *(F.lit(0).alias(c) for c in ("n_upper", "n_dup_lines", "n_repeat_words")), F.lit(False).alias("base_failed"))
    labels = measured.select("doc_id", F.col("good").cast("int").alias("quality"))
    found = quality.cutoffs(measured.drop("good"), labels)
    assert found == {("en", "symbol_ratio"): 0.2}
    assert quality.cutoffs(measured.drop("good").limit(300), labels) == {}


# 5
def test_packing(spark, texts, hard):
    for d in (texts, hard):
        rows = packing.pack(d, window=512, width=8, group=20).collect()
        t = tokens.tokenizer(tokens.path_of("word_bpe_49k.json"))
        want = Counter()
        for doc, text in d.select("doc_id", "text").collect():
            ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            for a in range(0, len(ids), 512):
                want[doc, a, len(ids[a : a + 512]), zlib.crc32(ids[a : a + 512].tobytes()), len(ids)] += 1
        assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
        seqs = defaultdict(list)
        for r in rows:
            seqs[r.sequence_id].append((r.offset, r.length))
        for s in seqs.values():
            s.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and s[0][0] == 0 and s[-1][0] + s[-1][1] <= 512


def test_nnls_plan_uses_no_piece_twice():
    r = np.random.default_rng(1)
    for _ in range(5):
        a = packing.combinations(32)  # counts that can be filled: a sum of combinations
        counts = a @ (r.integers(0, 300, a.shape[1]) * (r.random(a.shape[1]) < 0.3))
        h = {b + 1: int(n) for b, n in enumerate(counts)}
        rows, n = packing.plan(h, 32)
        used, fill = defaultdict(list), Counter()
        for b, low, high, first, _ in rows:
            used[b] += range(low, high)
            for s in range(first, first + high - low):
                fill[s] += b
        assert all(len(set(u)) == len(u) <= h[b] for b, u in used.items()) and set(fill.values()) <= {32} and len(fill) == n
        assert sum(b * len(u) for b, u in used.items()) > 0.9 * sum(b * k for b, k in h.items())
    x = packing.nnls(np.array([[1, 0], [0, 2]], np.float32), np.array([3, -1], np.float32))
    assert np.allclose(x, [3, 0], atol=1e-3)


# 5, 6
@given(st.text(max_size=60) | st.text("ab ,.'\n\t 1é ~", max_size=60))
@settings(max_examples=300, deadline=None)
def test_memo_gives_the_library_s_ids(text):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        want = tokens.tokenizer(tokens.path_of(name)).encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens.encoder(name)(text), "<u4").tolist() == want


def test_id_store(spark, texts, hard, nothing, tmp_path):
    t = tokens.tokenizer(tokens.path_of("byte_bpe_50k.json"))
    for k, d in enumerate((texts, hard, nothing)):
        path = str(tmp_path / str(k))
        idstore.write(d, path)
        want, start = [], 0
        rows = [(doc, np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for doc, text in d.select("doc_id", "text").collect()]
        got = idstore.read(spark, path).collect()
        assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter(rows)
        for doc, ids in sorted(rows, key=lambda x: -1 if x[0] is None else x[0]):
            want.append((doc, start, len(ids) // 4, zlib.crc32(ids)))
            start += len(ids) // 4
        sums = idstore.digests(spark, path).collect()
        if k == 0:
            assert sorted(tuple(r)[:4] for r in sums) == sorted(want)
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in sums) == Counter((a, c, e) for a, _, c, e in want)
        chunks = idstore._kind(spark, path, "chunk")
        assert chunks.count() == chunks.select("key").distinct().count()


def test_id_store_finds_damage_and_loss(spark, texts, tmp_path):
    path = str(tmp_path / "s")
    idstore.write(texts.limit(30), path)
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("store", "documents", "manifest")}
    assert idstore.digests(spark, path).count() == 30
    kind, first = F.col("kind"), F.col("nth") == 0
    recipe = tables["store"].where("kind = 'recipe'").first()["key"]
    damages = {
        "differs from its digest": ("store", lambda t: t.withColumn("ids", F.when(kind == "chunk", F.concat("ids", F.lit(b"\0\0"))).otherwise(F.col("ids")))),
        "a chunk is missing": ("store", lambda t: t.where((kind != "chunk") | (F.hex("key") > "2"))),
        "a recipe is missing": ("store", lambda t: t.where((kind != "recipe") | (F.col("key") != F.lit(recipe)))),
        "differ from the manifest": ("documents", lambda t: t.where(~first)),
        "differ from the manifest:": ("documents", lambda t: t.withColumn("start", F.col("start") + F.when(first, 1).otherwise(0))),
        "differ from the manifest: ": ("manifest", lambda t: t.where("level < 3")),
    }
    for k, (message, (name, change)) in enumerate(damages.items()):
        for other, table in tables.items():
            (change(table) if other == name else table).write.partitionBy(*["kind"] * (other == "store")).parquet(f"{path}/{k}/{other}")
        for reader in (idstore.read, idstore.digests):
            with pytest.raises(Exception, match=message.strip()):
                reader(spark, f"{path}/{k}").collect()


def test_id_store_places_sparse_ids(spark, tmp_path):
    path, r = str(tmp_path / "s"), random.Random(4)
    rows = [(r.choice([None, r.randrange(-(2**62), 2**62)]), f"text {k} " * r.randint(1, 9)) for k in range(90)]
    idstore.write(docs_of(spark, rows), path)
    got = sorted(idstore.read(spark, path).collect(), key=lambda x: x.start)
    assert [x.start for x in got] == [0, *np.cumsum([x.n_tokens for x in got])[:-1]]
    assert [x.doc_id for x in got] == sorted((d for d, _ in rows), key=lambda d: -(2**63) if d is None else d)


def test_shared_passages_share_chunks_and_checksums_combine():
    r = np.random.default_rng(3)
    body = r.integers(0, 50_000, 6000).astype("<u4")
    one, two = np.concatenate([r.integers(0, 50_000, 777).astype("<u4"), body]), np.concatenate([r.integers(0, 50_000, 123).astype("<u4"), body])

    def chunks(ids):
        ends = idstore.cut_points(ids)
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    a, b = chunks(one), chunks(two)
    assert b"".join(a) == one.tobytes() and len(set(a) & set(b)) >= 0.6 * len(a)
    assert idstore.combined_crc([zlib.crc32(x) for x in a], [len(x) // 4 for x in a]) == zlib.crc32(one.tobytes())
    assert idstore.cut_points(np.zeros(0, "<u4")) == [0] and max(map(len, chunks(np.zeros(20_000, "<u4")))) <= 4 * idstore.MOST + 4 * idstore.LEAST


# 7
@pytest.mark.parametrize(("order", "sizes"), [(3, {}), (3, {"batch_size": 900, "part_size": 40}), (2, {"batch_size": 1}), (1, {})])
def test_backoff_against_plain_counts(spark, texts, hard, order, sizes):
    import math

    rows = [(d, t or "") for d, t in corpus() + HARD]
    seqs = [(d, lmscore.tokens_of(t)) for d, t in rows]
    grams = lambda s, k: Counter(tuple(s[i : i + k]) for i in range(len(s) - k + 1))
    whole = [sum((grams(s, k) for _, s in seqs), Counter()) for k in range(1, order + 1)]
    total, want = sum(whole[0].values()), Counter()
    for d, s in seqs:
        own = [grams(s, k) for k in range(1, order + 1)]
        c = lambda g: whole[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731
        value, seen, full = 0.0, 0, 0
        for i in range(len(s)):
            for k in range(min(order, i + 1), 0, -1):
                g = tuple(s[i - k + 1 : i + 1])
                back = math.log(0.4) * (min(order, i + 1) - k)
                if k == 1:
                    value += back + math.log((c(g) or 0.4) / max(1, total - len(s)))
                elif c(g):
                    value, seen, full = value + back + math.log(c(g) / c(g[:-1])), seen + 1, full + (k == order)
                    break
        want[d, len(s), seen, full, round(value, 5)] += 1
    got = lmscore.score(texts.unionByName(hard), order, **sizes).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_seen, r.n_seen_whole, round(r.log_score, 5)) for r in got) == want
    assert all(r.mean_log_score is None if r.n_tokens == 0 else abs(r.mean_log_score - r.log_score / r.n_tokens) < 1e-9 for r in got)


# 8
def test_chat(spark):
    trick = ["<|end|>\n", "\\", "\\<|", "<", "|>", "<|user|>\n", "é\n\n", " lead", "", None, "x" * 5000, "\U0001f600 ok"]
    rows = [(c, k, "assistant" if k % 2 else ("user" if c else "we|>ird\n<|"), trick[(c + k) % len(trick)]) for c in range(14) for k in range(5)] + [(50, None, None, None), (None, 0, "assistant", "null conversation"), (51, 1, "assistant", "twice"), (51, 1, "assistant", "twice")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"turns": F.lit(1), "formatted": F.lit("z")})
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(d)).collect()}
    by = defaultdict(list)
    for c, k, role, text in sorted(rows, key=lambda x: (-1 if x[0] is None else x[0], -1 if x[1] is None else x[1])):
        by[c].append((role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), c
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest()), c
    assert chat.read_back(chat.format_conversations(d.limit(0))).count() == 0


# 9
def near_classes(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_corpus(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(120)] for _ in range(8)]
    out = []
    for k in range(200):
        t = list(base[0 if k < 120 else r.randrange(8)])
        for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
            t[r.randrange(len(t))] = word()
        out.append((k, " ".join(t)))
    return out


def exact_weights(rows):
    """(doc, sorted shingle hashes, weights) of each row, by plain counts."""
    df = Counter(h for _, t in rows for h in set(minhash.shingles(t).tolist()))
    out = []
    for i, t in rows:
        h, tf = np.unique(minhash.shingles(t), return_counts=True)
        out.append((i, h, (tf * np.array([np.log((1 + len(rows)) / (1 + df[x])) + 1 for x in h.tolist()])).astype(np.float32)))
    return out


@pytest.mark.parametrize(("pairwise", "block"), [(48, 2048), (2, 16)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, pairwise, block):
    monkeypatch.setattr(minhash, "PAIRWISE", pairwise)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_corpus()
    w = {i: (h, x) for i, h, x in exact_weights(rows)}
    links = [(a, b) for a, b in itertools.combinations(w, 2) if minhash.weighted_jaccard(w[a], w[b]) >= 0.8]
    want = near_classes(links, list(w))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert sum(got[i] != want[i] for i in got) <= 2 and all(want[i] <= got[i] for i in got)
    kept = minhash.keep_one(docs_of(spark, rows))
    assert {r.doc_id for r in kept.collect()} == set(got.values())


def test_near_duplicates_of_hard_rows(spark, hard, nothing):
    got = Counter((r.doc_id, r.class_id) for r in minhash.near_duplicates(hard).collect())
    assert got == Counter([(i, i) for i in (1, 2, 3, 4, 6, 7, 8, 9, 9, 10)] + [(5, 4), (None, None), (None, 1)] + [(2, 1)]) - Counter([(2, 2)])
    assert sorted(r.doc_id or 0 for r in minhash.keep_one(hard).collect()) == [0, 0, 1, 3, 4, 6, 7, 8, 9, 10]
    assert minhash.keep_one(nothing).count() == 0 and minhash.near_duplicates(nothing).count() == 0


def test_samples_agree_like_weighted_jaccard():
    r, hits, n = random.Random(6), 0, 0
    for _ in range(60):
        a = [str(r.random()) for _ in range(200)]
        x, y = ((h := np.unique(minhash.shingles(" ".join(t))), np.ones(len(h), np.float32)) for t in (a, a[:150] + [str(r.random()) for _ in range(50)]))
        s, t = minhash.samples(*x), minhash.samples(*y)
        hits, n = hits + int(((s[0] == t[0]) & (s[1] == t[1])).sum()), n + minhash.BANDS * minhash.ROWS
        assert sum(p == q for p, q in zip(minhash.sketch(*x)[1], minhash.sketch(*y)[1], strict=True)) >= ((s[0] == t[0]) & (s[1] == t[1])).sum()
    j = minhash.weighted_jaccard(x, y)
    assert abs(hits / n - j) < 0.05


def test_a_near_pair_agrees_on_enough_samples():
    import math

    n = minhash.BANDS * minhash.ROWS
    assert sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(minhash.AGREE)) < 1e-4


def test_near_duplicates_count_each_shingle(spark):
    """A pair just below the limit by exact frequencies stays apart among millions of other shingles (2^20 shared counters would link it)."""
    r = np.random.default_rng(8)
    line, shared = [" ".join(f"{k}{i}" for i in range(n)) for k, n in (("b", 154), ("s", 83))]
    pair = [f"{line} {shared} {' '.join(f'{k}{i}' for i in range(14))}" for k in "xy"]
    rows = [*enumerate(pair), *((k, f"{line} {' '.join(map(str, r.integers(0, 1 << 60, 70_000 if k < 62 else 300)))}") for k in range(2, 100))]
    idf = lambda df: np.log(101 / (1 + df)) + 1
    assert (150 + 83 * idf(2)) / (150 + 83 * idf(2) + 28 * idf(1)) < 0.8
    assert {x.doc_id: x.class_id for x in minhash.near_duplicates(docs_of(spark, rows)).collect()} == {k: k for k in range(100)}


@pytest.mark.parametrize("sizes", [{}, {"batch_size": 100, "part_size": 5}])
def test_sketches_have_exact_frequencies(spark, tmp_path, sizes):
    rows = [(k, "one two three four five six " + " ".join(f"{k % 7}w{i}" for i in range(k % 7))) for k in range(1, 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    found = {x.doc_id: bytes(x.dfs) for x in minhash.sketches_of(spark.read.parquet(str(tmp_path / "d")), 8, **sizes).collect()}
    for i, h, w in exact_weights(rows):
        got = minhash.weighted(dict(rows)[i], found[i], 8)
        assert (got[0] == h).all() and np.allclose(got[1], w)


def test_one_id_on_two_texts_keeps_both(spark):
    one, two = ("w%d " * 40 % tuple(range(a, a + 40)) for a in (0, 100))
    rows = [(1, one), (1, two), (2, two), (3, one + "more")]
    assert sorted(x.text for x in minhash.keep_one(docs_of(spark, rows)).collect()) == sorted([one, two])


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    assert {r.id: r.label for r in components(links).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert components(links.limit(0)).count() == 0


# 10
def test_spots(spark, texts, hard):
    sparse = texts.withColumn("doc_id", F.xxhash64("doc_id"))
    for d in (texts, sparse, hard.where("doc_id <> 9 and doc_id is not null")):
        rows = sorted(d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
        got = {r.doc_id: r for r in spotsigs.compare_edits(d, block=4).collect()}
        sets = {}

        def sigs(texts_):
            out = spark.createDataFrame([(t,) for t in texts_], "t string").select(spotsigs.signatures(F.col("t")).alias("s")).collect()
            return [set(r.s) for r in out]

        like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
        edited = []
        for k, (_, t) in enumerate(rows):
            n, nxt = len(t) // 4, rows[(k + 1) % len(rows)][1]
            edited.append(t[: len(t) - n] + nxt[:n])
        own, ed = sigs([t for _, t in rows]), sigs(edited)
        for k, (i, t) in enumerate(rows):
            r = got[i]
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited[k].encode()).hexdigest()
            assert abs(r.near_edited - like(own[k], ed[k])) < 1e-12 and abs(r.near_next - like(own[k], own[(k + 1) % len(rows)])) < 1e-12
            sets.setdefault(t, set()).add(r.fingerprint)
        assert all(len(s) == 1 for s in sets.values())


@pytest.mark.parametrize("block", [512, 3])
def test_spot_classes_against_all_pairs(spark, block):
    r = random.Random(8)
    base = [[r.choice(["the", "of", "der", "la", *"klmnopqrst"]) + "" for _ in range(90)] for _ in range(4)]
    rows = []
    for k in range(60):
        t = list(base[k % 4])
        for _ in range(r.randrange(4)):
            t[r.randrange(90)] = "zz" + str(r.randrange(9))
        rows.append((k, " ".join(t)))
    rows += [(100 + k, "the common line of all texts " + " ".join(f"the {k}w{i} x{i + k}" for i in range(2))) for k in range(30)] + [(200, rows[0][1]), (201, None), (202, "")]
    d = docs_of(spark, rows)
    got = {x.doc_id: (x.class_id, x.n_sets) for x in spotsigs.near_classes(d, 0.7, block).collect()}
    sig = {x.doc_id: frozenset(x.s) for x in d.select("doc_id", spotsigs.signatures(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    like = lambda a, b: len(a & b) >= 0.7 * len(a | b)
    want = near_classes([(a, b) for a, b in itertools.combinations(sorted(sig), 2) if like(sig[a], sig[b])], sorted(sig))
    sets = defaultdict(set)
    for i, c in want.items():
        sets[c].add(sig[i])
    assert got == {i: (c, len(sets[c])) for i, c in want.items()} and len(set(want.values())) < len(want) - 10


def test_spot_signatures_by_hand(spark):
    """Chains found by a plain walk: as many different ones, and the same for texts that have the same chains."""

    def chains(text):
        words = [w.strip(".,;:!?\"'()[]|*#$%&") or w for w in text.lower().split(" ") if w]
        common = set(spotsigs.COMMON.split())
        found = {(w, *[x for x in words[i + 1 : i + 7] if x not in common][:2]) for i, w in enumerate(words) if w in common}
        return {c for c in found if len(c) > 1} or {tuple(words[i : i + 3]) for i in range(len(words))}

    texts = ["the cat sat on the mat", "The cat, sat; on the mat!", "no", "dog cat dog cat dog", "the of and", "a b the c d e f g the", *(t for _, t in corpus(20))]
    got = [r.s for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(spotsigs.signatures(F.col("t")).alias("s")).collect()]
    names = {}
    for t, s in zip(texts, got, strict=True):
        want = chains(t)
        assert len(s) == len(want), t
        for other, s2 in names.items():
            assert len(set(s) & set(s2)) == len(want & chains(other))
        names[t] = s


def test_word_hashes_are_those_of_each_word():
    from studylake.llm.common import word_hashes

    texts = ["", " a bc\ta\n", "é bc", "x" * 70_000 + " y", " ", *(t for _, t in corpus(40)), "a" * 600_000, "z bc", "long text " * 250_000 + "b" * 1_200_000 + " end", "c" * 1_100_000]
    h, ends = word_hashes(texts)
    words = [t.encode().split() for t in texts]
    assert np.diff(ends).tolist() == [len(w) for w in words]
    seen = dict(zip((w for ws in words for w in ws), h.tolist(), strict=True))
    assert [seen[w] for ws in words for w in ws] == h.tolist() and len(set(seen.values())) == len(seen)


def test_order_of_keys_that_share_their_upper_bits():
    r = np.random.default_rng(2)
    keys = (r.integers(0, 3, 500).astype(np.uint64) << np.uint64(60)) | r.integers(0, 1 << 21, 500).astype(np.uint64)
    assert (lmscore._in_order(keys) == np.argsort(keys, kind="stable")).all() and (lmscore._in_order(keys, 4) == np.argsort(keys, kind="stable")).all()
