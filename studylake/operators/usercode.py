"""User functions on studies and frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .joins import all_rules


def _changes(pdf: pd.DataFrame, by: list[str]) -> np.ndarray:
    """Numbers of the rows whose key is not that of the row before; null keys are one key."""
    new = np.zeros(max(len(pdf) - 1, 0), dtype=bool)
    for c in by:
        gap, a = pdf[c].isna().to_numpy(), pdf[c].to_numpy()
        new |= np.where(gap[1:] | gap[:-1], gap[1:] != gap[:-1], a[1:] != a[:-1])
    return np.flatnonzero(new) + 1


def _stacked(results: list, names: list[str]) -> Iterator[pd.DataFrame]:
    """Results as few frames: lists of rows as one; of frames, columns that have several types keep their values as they are."""
    if rows := [r for x in results if isinstance(x, list) for r in x]:
        yield pd.DataFrame(rows, columns=names, dtype=object)
    if frames := [x for x in results if not isinstance(x, list) and len(x)]:
        same = all(x.columns.equals(frames[0].columns) and x.dtypes.equals(frames[0].dtypes) for x in frames)
        yield pd.concat(frames if same else [x.astype(object) for x in frames], ignore_index=True)


def _studies(batches: Iterator[pd.DataFrame], by: list[str], hidden: list[str]) -> Iterator[list[tuple[tuple, pd.DataFrame]]]:
    """Of each sorted batch the studies that end before its last one, and that one when the next begins: the key and hidden values of the first row, and the rows without the hidden columns.

    What holds for all studies of a batch is done once for the batch: choosing columns or a value of a small frame costs more than cutting it.
    """
    head, pieces = None, []  # of the study that the batches so far end with
    for pdf in batches:
        if not len(pdf):
            continue
        cuts = [0, *_changes(pdf, by).tolist(), len(pdf)]
        heads = list(zip(*(pdf[c].take(cuts[:-1]).tolist() for c in [*by, *hidden]), strict=True))
        shown = pdf.drop(columns=hidden) if hidden else pdf
        whole = []
        if pieces and len(_changes(pd.concat([pieces[-1][by].tail(1), shown[by].head(1)]), by)):
            whole.append((head, pd.concat(pieces, ignore_index=True)))
            pieces = []
        for low, high, first in zip(cuts[:-1], cuts[1:], heads, strict=True):
            one = shown.iloc[low:high].reset_index(drop=True)
            head = head if pieces else first
            if high == len(pdf):
                pieces.append(one)
            elif pieces:
                whole.append((head, pd.concat([*pieces, one], ignore_index=True)))
                pieces = []
            else:
                whole.append((head, one))
        yield whole
    if pieces:
        yield [(head, pd.concat(pieces, ignore_index=True))]


def _per_key(frames: DataFrame, fn: Callable[[tuple, pd.DataFrame, dict], pd.DataFrame | list[tuple]], schema: str, defaults: dict | None, by: tuple[str, ...], parameters: dict, hidden: tuple[str, ...] = ()) -> DataFrame:
    defaults = defaults or {}
    if unknown := set(parameters) - set(defaults):
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    values = {k: type(v)(parameters.get(k, v)) for k, v in defaults.items()}
    names = StructType.fromDDL(schema).names

    def run(batches):
        for whole in _studies(batches, list(by), list(hidden)):
            yield from _stacked([fn(head, pdf, values) for head, pdf in whole], names)

    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named: else adaptive execution makes few tasks of rows that are small beside what a function costs
    return frames.repartition(parts, *by).sortWithinPartitions(*by).mapInPandas(run, schema)


def per_study(frames: DataFrame, fn: Callable[[pd.DataFrame, dict], pd.DataFrame | list[tuple]], schema: str, defaults: dict | None = None, by: tuple[str, ...] = ("study_uid",), **parameters) -> DataFrame:
    """fn(frames of one study, parameters) once for each study; parameters fall back to defaults and keep their types. fn gives a frame, or a list of tuples in the schema's order.

    Studies lie one after the other in sorted partitions and are cut from Arrow batches: a group for each of millions of small studies (applyInPandas) costs far more than its function.
    A study that reaches over several batches is put together first.
    """
    return _per_key(frames, lambda _, pdf, values: fn(pdf, values), schema, defaults, by, parameters)


def per_frame(frames: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn over batches of frames, without state."""

    def run(batches):
        for pdf in batches:
            yield fn(pdf)

    return frames.mapInPandas(run, schema)


def result_check(results: DataFrame, frames_in_study: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused with why). results: study_uid, frame, mask array; frames count from 1, a mask must not be empty and must have the study's mask_size."""
    j = results.join(frames_in_study.select("study_uid", "n_frames", "mask_size"), "study_uid", "left")
    why = F.when(F.col("n_frames").isNull(), "unknown study").when(~F.col("frame").between(1, F.col("n_frames")), "frame out of range").when(F.col("mask").isNull() | (F.size("mask") == 0), "empty").when(F.size("mask") != F.col("mask_size"), "incomplete mask")
    checked = j.withColumn("refused", why).drop("n_frames", "mask_size")
    return checked.where("refused is null").drop("refused"), checked.where("refused is not null")


def chain(studies: DataFrame, rules: DataFrame, frames: DataFrame, fn, schema: str, **kwargs) -> DataFrame:
    """Each rule that fits a study contributes its own result: fn runs once for each (study, rule)."""
    tasks = all_rules(studies, rules).select("study_uid", F.col("name").alias("rule"))
    return per_study(frames.join(tasks, "study_uid"), fn, schema, by=("study_uid", "rule"), **kwargs)


def chain_outcomes(studies: DataFrame, rules: DataFrame, frames: DataFrame, fn, schema: str, **kwargs) -> DataFrame:
    """chain with an outcome and an error for each (study, rule): the rows of a complete task, one row for an empty or failed one (its other columns null).

    An exception of fn, or a result without a column of the schema, fails its own task only; a task whose study has no frames is empty and fn is not called. Values of a wrong type still
    fail the job. schema has study_uid and rule.
    """
    names = StructType.fromDDL(schema).names

    def guarded(head: tuple, pdf: pd.DataFrame, parameters: dict) -> pd.DataFrame | list[tuple]:
        rows, error = None, None
        try:
            if pd.notna(head[2]):  # a study without frames has one row that says so
                rows = fn(pdf, parameters)
                if isinstance(rows, list):
                    rows = [(*r, "complete", None) for r in rows]
                    if any(len(r) != len(names) + 2 for r in rows):
                        raise ValueError(f"a row needs {len(names)} values")
                else:
                    rows = rows[names].assign(outcome="complete", error=None)
        except Exception as e:  # whatever a model raises is that task's outcome
            rows, error = None, f"{type(e).__name__}: {e}"
        if rows is None or not len(rows):
            own = dict(zip(("study_uid", "rule"), head, strict=False))
            return [(*(own.get(n) for n in names), "failed" if error else "empty", error)]
        return rows

    tasks = all_rules(studies, rules).select("study_uid", F.col("name").alias("rule"))
    given = tasks.join(frames.withColumn("_frame", F.lit(True)), "study_uid", "left")
    defaults = kwargs.pop("defaults", None)
    return _per_key(given, guarded, schema + ", outcome string, error string", defaults, ("study_uid", "rule"), kwargs, ("_frame",))


def outcome(error: Column, rows: Column) -> Column:
    """failed, empty or complete."""
    return F.when(error.isNotNull(), "failed").when(F.coalesce(rows, F.lit(0)) == 0, "empty").otherwise("complete")
