"""Quality rules with risk-controlled thresholds.

Per document a few ratios say how much of it is symbols, capitals, repeated lines and repeated word windows. For each stratum
(language) and ratio, labelled good documents are the holdout: a cutoff may be used only if the exact binomial test
rejects, at delta divided by the number of tests, that it turns away more than its share of the stratum's good documents.
Among the cutoffs that pass, the one with the fewest false rejections is taken, then the one with the most true ones,
then the loosest. A stratum whose holdout is too small to pass any test has no cutoff and keeps what the base rules keep.

Nulls: a null text has no words (base_failed), a null language is the stratum ''. Labels of null or unknown documents, or with a null quality, say nothing;
a document with several labels counts once for each distinct one. Repeated rows are judged alike. Very long texts are measured whole. Equal cutoffs: see above.
An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, let, text_of

#: Ratios above a cutoff are turned away.
RULES = {"symbol_ratio": "n_symbols / nullif(n_words, 0)", "upper_ratio": "n_upper / nullif(word_chars, 0)", "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)", "repeat_ratio": "n_repeat_words / nullif(n_words, 0)"}
CUTOFFS = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8)
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LIMIT, DELTA = 0.05, 0.1


def _repeated(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: windows are compared by 64-bit hashes."""

    def covered(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    def found(s: Column) -> Column:
        same = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), found))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows, count))


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, then counts, ratios and base_failed of each whole text."""
    t = text_of(docs)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    out = docs.select(
        *(docs[c] for c in keep),
        let(F.filter(F.split(t, BLANKS + "+"), lambda x: x != ""), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).cast("long").alias("r"))).alias("_w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("_l"),
        F.length(F.regexp_replace(t, BLANKS + "+", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.translate(t, CAPITALS, ""))).cast("long").alias("n_upper"),
    )
    out = out.select(*keep, F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", F.col("_l.d").alias("n_dup_lines"), F.col("_w.r").alias("n_repeat_words"), "n_upper", F.col("_l.n").alias("n_lines"))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p)."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def cutoffs(measured: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA) -> dict[tuple[str, str], float]:
    """(stratum, rule) -> certified cutoff. measured: doc_id, stratum and measures(); labels: doc_id, quality.

    Each of the rules may turn away limit / number of rules of a stratum's good documents. What comes to the driver is a
    row of counts for each stratum whose holdout could pass a test at all.
    """
    share = limit / len(RULES)
    known = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("_id"), (F.col("quality") > 0).alias("good")).distinct()
    held = measured.where(~F.col("base_failed")).join(known, F.col("doc_id") == F.col("_id"))
    counts = [F.count_if(F.expr(f"{e} > {c}D") & (F.col("good") if side else ~F.col("good"))).alias(f"{r}|{i}|{side}") for r, e in RULES.items() for i, c in enumerate(CUTOFFS) for side in (1, 0)]
    least = math.ceil(math.log(delta / (len(RULES) * len(CUTOFFS))) / math.log1p(-share))
    rows = held.groupBy("stratum").agg(F.count_if("good").alias("n_good"), *counts).where(F.col("n_good") >= least).collect()
    tests = max(1, len(rows)) * len(RULES) * len(CUTOFFS)
    out = {}
    for row in rows:
        for r in RULES:
            passed = [(row[f"{r}|{i}|1"], -row[f"{r}|{i}|0"], -c) for i, c in enumerate(CUTOFFS) if row[f"{r}|{i}|0"] and binomial_tail(row[f"{r}|{i}|1"], row["n_good"], share) <= delta / tests]
            if passed:
                out[row["stratum"], r] = -min(passed)[2]
    return out


def verdict(found: dict[tuple[str, str], float]) -> Column:
    """kept, from the columns of measures() and stratum."""
    fails = F.lit(False)
    for (stratum, r), c in sorted(found.items()):
        fails = fails | ((F.col("stratum") == F.lit(stratum)) & F.coalesce(F.expr(f"{RULES[r]} > {c}D"), F.lit(False)))
    return ~F.col("base_failed") & ~fails


def _plain(docs: DataFrame, row: bool = False) -> DataFrame:
    """doc_id, text and stratum alone, so that other columns' names can't clash; with row, the row they come from."""
    packed = [F.struct(*(docs[c] for c in docs.columns)).alias("_row")] if row else []
    return docs.select(docs["doc_id"], text_of(docs).alias("text"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("stratum"), *packed)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: measures and kept."""
    measured = cut(measures(_plain(docs), "doc_id", "stratum"), "quality-measures")
    return measured.withColumn("kept", verdict(cutoffs(measured, labels)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The kept documents with the columns they came with. Each text is measured once: the rows are written with their measures."""
    measured = cut(measures(_plain(docs, row=True), "doc_id", "stratum", "_row"), "quality-measures")
    return measured.where(verdict(cutoffs(measured.drop("_row"), labels))).select("_row.*")
