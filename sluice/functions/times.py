"""Dates and windows as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import TIMEPOINTS
from .scalars import _col


def week_start(ts) -> Column:
    return F.date_trunc("week", _col(ts)).cast("date")


def time_bucket(ts, unit: str = "hour") -> Column:
    """Text of the hour, day or month; unknown for null."""
    form = {"hour": "yyyy-MM-dd-HH", "day": "yyyy-MM-dd", "month": "yyyy-MM"}[unit]
    return F.coalesce(F.date_format(_col(ts), form), F.lit("unknown"))


def quarter(ts) -> Column:
    return F.concat(F.year(_col(ts)).cast("string"), F.lit("-Q"), F.quarter(_col(ts)).cast("string"))


def offset_days(label) -> Column:
    """+31d is 31, 0d is 0; anything else is null."""
    return F.when(_col(label).rlike(r"^\+?[0-9]+d$"), F.regexp_extract(_col(label), "([0-9]+)", 1).cast("int"))


def timepoint_days(label) -> Column:
    """Days of the known labels only."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in TIMEPOINTS.items() for x in kv]), _col(label))


def hour_windows(start, end) -> Column:
    return F.sequence(F.date_trunc("hour", _col(start)), F.date_trunc("hour", _col(end)), F.expr("interval 1 hour"))


def day_buckets(start, end) -> Column:
    return F.sequence(_col(start).cast("date"), _col(end).cast("date"), F.expr("interval 1 day"))


def month_buckets(start, end) -> Column:
    """Structs (start, end) of the months, clipped to the range."""
    a, b = _col(start).cast("date"), _col(end).cast("date")
    months = F.sequence(F.trunc(a, "month"), F.trunc(b, "month"), F.expr("interval 1 month"))
    return F.transform(months, lambda m: F.struct(F.greatest(m, a).alias("start"), F.least(F.last_day(m), b).alias("end")))


def midpoint(start, end) -> Column:
    """The middle of a window in whole seconds, one second after its start at least."""
    a, b = (F.unix_timestamp(_col(x).cast("timestamp")) for x in (start, end))
    return F.timestamp_seconds(a + F.greatest(F.lit(1), F.floor((b - a) / 2))).cast("timestamp_ntz")


def epoch_seconds(ts) -> Column:
    return F.unix_timestamp(_col(ts).cast("timestamp"))
