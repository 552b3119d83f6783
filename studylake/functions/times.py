"""Partial-precision times and date-times: a short form names a period."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000


def _two(text: Column, at: int) -> Column:
    return F.substring(text, at, 2).try_cast("long")


def tm_period(text: Column) -> Column:
    """struct(start_us, end_us) of HH, HHMM, HHMMSS or HHMMSS.f{1,6}; null for any other form."""
    start = (_two(text, 1) * 3600 + F.coalesce(_two(text, 3), F.lit(0)) * 60 + F.coalesce(_two(text, 5), F.lit(0))) * SECOND
    part = F.rpad(F.regexp_extract(text, r"^[0-9]{6}\.([0-9]{1,6})$", 1), 6, "0").try_cast("long")
    period = lambda a, b: F.struct(a.cast("long").alias("start_us"), b.cast("long").alias("end_us"))
    digits = lambda n: (F.length(text) == n) & text.rlike("^[0-9]+$")
    return (
        F.when(digits(2), period(start, start + 3600 * SECOND - 1)).when(digits(4), period(start, start + 60 * SECOND - 1)).when(digits(6), period(start, start))
        .when(text.rlike(r"^[0-9]{6}\.[0-9]{1,6}$") & ~text.contains("\n"), period(start + part, start + part))
    )


_DT = r"^([0-9]{4})([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?(\.[0-9]{1,6})?([+-][0-9]{4})?$"


def dt_bounds(text: Column, offset_seconds: int = 0) -> Column:
    """struct(lo, hi) of microseconds since 1970 in UTC: the first and the last instant that a date-time of 4 to 14 digits names.

    A zone at the end shifts it, else offset_seconds does. A fraction pins the instant; a full second without one lasts to its end. Null where the text is no date-time.
    The parts are extracted once and handed on, so that the expression stays small.
    """

    def parts(found: Column) -> Column:
        g = lambda i: F.get(found, F.lit(i))
        num = lambda i, least: F.coalesce(F.nullif(g(i), F.lit("")).try_cast("int"), F.lit(least))
        shift = (F.substring(g(7), 2, 2).try_cast("int") * 3600 + F.substring(g(7), 4, 2).try_cast("int") * 60) * F.when(g(7).startswith("-"), -1).otherwise(1)
        named = F.lit(0)  # how many parts the text names
        for i in range(7):
            named = named + (g(i) != "").cast("int")
        return F.struct(
            F.try_make_timestamp(num(0, 1), num(1, 1), num(2, 1), num(3, 0), num(4, 0), num(5, 0).cast("decimal(16,6)")).alias("at"),
            F.rpad(F.substring(g(6), 2, 6), 6, "0").try_cast("long").alias("fraction"), F.when(g(7) == "", F.lit(offset_seconds)).otherwise(shift).cast("long").alias("zone"), named.alias("named"), ((g(6) == "") | (g(5) != "")).alias("good"),
        )

    def bounds(p: Column) -> Column:
        micros, day = F.unix_micros(p["at"]), p["at"].cast("date")
        months = F.unix_micros(F.add_months(day, F.when(p["named"] == 2, 1).otherwise(12)).cast("timestamp"))
        step = F.when(p["named"] == 7, p["fraction"] + 1).when(p["named"] == 6, SECOND).when(p["named"] == 5, 60 * SECOND).when(p["named"] == 4, 3600 * SECOND).otherwise(86400 * SECOND)
        end = F.when(p["named"] <= 2, months).otherwise(micros + step)
        lo = micros + F.when(p["named"] == 7, p["fraction"]).otherwise(0) - p["zone"] * SECOND
        return F.when(p["at"].isNotNull() & p["good"], F.struct(lo.alias("lo"), (end - 1 - p["zone"] * SECOND).alias("hi")))

    one = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    groups = F.when(text.rlike(_DT) & ~text.contains("\n"), F.split(F.regexp_replace(text, _DT, "$1,$2,$3,$4,$5,$6,$7,$8"), ","))
    return one(groups, lambda found: F.when(found.isNotNull(), one(parts(found), bounds)))
