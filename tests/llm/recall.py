"""Recall of near_duplicates: python -m tests.llm.recall [sf_dir]. Every row whose id is divisible by 100 is compared with all rows by exact weighted Jaccard similarity; recall is the share of pairs of
0.8 or more, between different texts, that end in one class."""

from __future__ import annotations

import sys
from collections import Counter

import numpy as np

from studylake.llm import minhash
from studylake.session import session


def main(sf_dir: str) -> None:
    spark = session("local[2]", spark__sql__shuffle__partitions="8", spark__driver__memory="6g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs, written=True).collect()}
    rows = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    every = {i: np.unique(minhash.shingles(t), return_counts=True) for i, t in rows.items()}
    ids, lengths = list(every), [len(h) for h, _ in every.values()]
    h = np.concatenate([h for h, _ in every.values()])
    who = np.repeat(np.arange(len(ids)), lengths)
    _, at, df = np.unique(h, return_inverse=True, return_counts=True)
    w = np.concatenate([n for _, n in every.values()]) * minhash.idf_of(df, len(rows))[at]
    totals, order = np.bincount(who, w, len(ids)), np.argsort(at, kind="stable")
    ends, starts = np.cumsum(df), np.concatenate([[0], np.cumsum(lengths)])
    found = Counter()
    for k, i in enumerate(ids):
        if i % 100 == 0:
            shared = np.zeros(len(ids))
            for p in range(starts[k], starts[k + 1]):
                meet = order[ends[at[p]] - df[at[p]] : ends[at[p]]]
                shared[who[meet]] += np.minimum(w[meet], w[p])
            for other in np.flatnonzero(shared >= 0.8 * (totals + totals[k] - shared)):
                if rows[ids[other]] != rows[i]:
                    found[classes[ids[other]] == classes[i]] += 1
    print(f"{sf_dir}: {found[True] + found[False]} pairs of different texts, {found[True]} in one class")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
