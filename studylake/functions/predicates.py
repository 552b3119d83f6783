"""Matching rules of searches. Each returns a boolean Column; a missing attribute gives null, which no filter lets through.

Patterns and bounds are arguments, so they are read on the driver and the plan holds plain comparisons.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import pn_normalize
from .times import dt_bounds, tm_period

LONGEST_FUZZY = 63
QUALITY = 113001


def like_of(pattern: str, one: bool = True) -> str:
    """A LIKE pattern of a glob: * any run, ? one character (if one), everything else itself. Runs of * are one."""
    out = []
    for c in re.sub(r"\*+", "*", pattern):
        out.append("%" if c == "*" else "_" if c == "?" and one else "\\" + c if c in "%_\\" else c)
    return "".join(out)


def glob(column: Column, pattern: str) -> Column:
    """Whole value, case-sensitive; numbers by their decimal text."""
    return column.cast("string").like(like_of(pattern))


def glob_ci(column: Column, pattern: str) -> Column:
    return F.lower(column).like(like_of(pattern.lower()))


def fuzzy_regex(pattern: str) -> str:
    """A regular expression for 'contains something within one edit of the pattern' (two characters or more)."""
    e = [re.escape(c) if c.isascii() and not c.isalnum() else c for c in pattern]
    ways = ["".join(e)]
    ways += ["".join(e[:i] + e[i + 1 :]) for i in range(len(e))]
    ways += ["".join([*e[:i], ".", *e[i + 1 :]]) for i in range(1, len(e) - 1)]
    ways += ["".join([*e[:i], ".", *e[i:]]) for i in range(1, len(e))]
    return "(?s:" + "|".join(dict.fromkeys(ways)) + ")"


def fuzzy(column: Column, pattern: str) -> Column:
    """Names: a pattern with a wildcard is a case-blind glob, any other matches what contains it within one edit."""
    if any(c in pattern for c in "*?"):
        return glob_ci(column, pattern)
    p, text = pattern.translate(str.maketrans("^=", "  ")).lower(), pn_normalize(column)
    if not p:
        return text.isNotNull()
    if len(p) > LONGEST_FUZZY:
        return text.contains(p)
    return text != "" if len(p) == 1 else text.rlike(fuzzy_regex(p))


def in_list(column: Column, values: str) -> Column:
    """Any element of a comma list."""
    return column.cast("string").isin(*(v.strip() for v in values.split(",")))


def list_intersects(column: Column, values: str) -> Column:
    """Two comma lists share an element; empty elements say nothing."""
    asked = [v.strip() for v in values.split(",") if v.strip()]
    own = F.transform(F.split(column, ","), lambda x: F.trim(x))
    return F.arrays_overlap(own, F.array(*map(F.lit, asked))) if asked else F.lit(False)


def _day(text: str) -> int | None:
    return int(text) if re.fullmatch("[0-9]{8}", text) else None


def study_date_range(column: Column, low: str = "", high: str = "") -> Column:
    """Inclusive; a bound that can't be read is no bound."""
    lo, hi, found = _day(low), _day(high), column.isNotNull()
    if lo is not None:
        found = found & (column >= lo)
    return found & (column <= hi) if hi is not None else found


def date_range(column: Column, pattern: str) -> Column:
    """lo-hi, lo-, -hi or one day; a bad pattern, or a dash alone, matches nothing."""
    lo, dash, hi = pattern.partition("-")
    hi = hi if dash else lo
    if "-" in hi or not (lo or hi) or any(x and _day(x) is None for x in (lo, hi)):
        return F.lit(False)
    return column.isNotNull() & (column >= _day(lo) if lo else F.lit(True)) & (column <= _day(hi) if hi else F.lit(True))


def date_equals(column: Column, day: str) -> Column:
    """Series date: the same eight digits."""
    return F.lpad(column.cast("string"), 8, "0") == day


def _time(text: str) -> tuple[int, int] | None:
    m = re.fullmatch(r"([0-9]{2})(?:([0-9]{2})(?:([0-9]{2})(?:\.([0-9]{1,6}))?)?)?", text)
    if not m:
        return None
    h, mi, s, f = m.groups()
    start = (int(h) * 3600 + int(mi or 0) * 60 + int(s or 0)) * 1_000_000 + int((f or "0").ljust(6, "0"))
    return start, start + (3_599_999_999 if mi is None else 59_999_999 if s is None else 0)


def time_range(column: Column, pattern: str) -> Column:
    """The stored period overlaps the asked one."""
    lo, dash, hi = pattern.partition("-")
    hi = hi if dash else lo
    low, high = _time(lo) if lo else (0, 0), _time(hi) if hi else (0, 86_400_000_000)
    if "-" in hi or not (lo or hi) or low is None or high is None:
        return F.lit(False)
    p = tm_period(column)
    return (p["end_us"] >= low[0]) & (p["start_us"] <= high[1])


_INSTANT = re.compile(r"[0-9]{4}(?:[0-9]{2}){0,5}(?:(?<=[0-9]{14})\.[0-9]{1,6})?(?:[+-][0-9]{4})?")


def split_datetime_range(value: str) -> tuple[str, str | None]:
    """(low, high) of a range, (value, None) of one value. A dash with four digits up to 1200 at the end is a zone's sign."""
    if value.startswith("-"):
        return "", value[1:]
    for m in re.finditer("-", value):
        i = m.start()
        tail = value[i + 1 :]
        if re.fullmatch("[0-9]{4}", tail) and int(tail) <= 1200:
            continue
        if _INSTANT.fullmatch(value[:i]) and (not tail or _INSTANT.fullmatch(tail)):
            return value[:i], tail
    return value, None


def datetime_range(column: Column, value: str, offset_seconds: int = 0) -> Column:
    """Zone-aware; a single short value names its whole period; an unreadable bound of a range is open; unreadable stored text is compared as text."""
    low, high = split_datetime_range(value)
    bound = lambda t: dt_bounds(F.lit(t), offset_seconds)
    if high is None:
        good, text = lambda at: F.coalesce((at >= bound(value)["lo"]) & (at <= bound(value)["hi"]), F.lit(False)), column == value
    else:
        good = lambda at: (F.coalesce(at >= bound(low)["lo"], F.lit(True)) if low else F.lit(True)) & (F.coalesce(at <= bound(high)["hi"], F.lit(True)) if high else F.lit(True))
        text = ((column >= low) if low else F.lit(True)) & ((column <= high) if high else F.lit(True))
    found = F.get(F.transform(F.array(dt_bounds(column, offset_seconds)["lo"]), lambda at: F.when(at.isNotNull(), good(at)).otherwise(text)), F.lit(0))
    return F.when(column.isNull(), F.lit(False)).otherwise(found)


def number_glob(column: Column, pattern: str) -> Column:
    return glob(column, pattern)


def visible(reason: Column, expose_quality: bool = False) -> Column:
    """Not hidden; instances rejected for quality are shown where the site exposes them."""
    shown = F.coalesce(reason, F.lit(0)) == 0
    return shown | (reason == QUALITY) if expose_quality else shown


def sql_like(column: Column, pattern: str) -> Column:
    """Admin search: case-blind, * and % any run, no single-character wildcard; empty or % matches all."""
    if pattern in ("", "%"):
        return F.lit(True)
    return F.lower(column).like(re.sub(r"([_\\])", r"\\\1", pattern.lower()).replace("*", "%"))


def rule_text(column: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(column)), r"\s+", " ")


def rule_glob(column: Column, pattern: str) -> Column:
    """Lower case, one blank for a run of them, then * only."""
    return rule_text(column).like(like_of(" ".join(pattern.lower().split()), one=False))
