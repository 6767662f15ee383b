"""Calendar columns, time zones and whole hours."""

import math

from pyspark.sql import Column, functions as F

from aerolith.schema import SEASONS


def season(month: Column) -> Column:
    winter, spring, summer, fall = SEASONS
    return (
        F.when(month.isNull(), None)
        .when(month.isin(12, 1, 2), winter)
        .when(month.between(3, 5), spring)
        .when(month.between(6, 8), summer)
        .otherwise(fall)
    )


def calendar_columns(time: Column, tz: str = "UTC") -> dict[str, Column]:
    """Calendar parts of a UTC time as seen in ``tz``; Monday is day 0."""
    local = time if tz == "UTC" else to_local(time, tz)
    dow, hour = F.weekday(local), F.hour(local)
    return {
        "hour": hour,
        "day_of_week": dow,
        "day_of_month": F.dayofmonth(local),
        "month": F.month(local),
        "quarter": F.quarter(local),
        "week_of_year": F.weekofyear(local),
        "is_weekend": (dow >= 5).cast("int"),
        "is_daytime": ((hour >= 6) & (hour < 18)).cast("int"),
        "season": season(F.month(local)),
    }


def cyclical_columns() -> dict[str, Column]:
    """Sine and cosine of hour, weekday and month."""
    out = {}
    for name, period in (("hour", 24), ("day_of_week", 7), ("month", 12)):
        angle = F.lit(2 * math.pi) * F.col(name) / F.lit(period)
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def to_utc(time: Column, tz: str | Column) -> Column:
    """Naive local time in ``tz`` to naive UTC."""
    zone = tz if isinstance(tz, Column) else F.lit(tz)
    return F.convert_timezone(zone, F.lit("UTC"), time)


def to_local(time: Column, tz: str | Column) -> Column:
    """Naive UTC time to naive local time in ``tz``."""
    zone = tz if isinstance(tz, Column) else F.lit(tz)
    return F.convert_timezone(F.lit("UTC"), zone, time)


def hour_floor(time: Column) -> Column:
    """The whole hour at or before a naive time, whatever the session's zone."""
    naive = time.cast("timestamp_ntz")
    return naive - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(naive), F.date_part(F.lit("SECOND"), naive))


def epoch_micros(time: Column) -> Column:
    """Microseconds of a naive UTC time since 1970, whatever the session's zone."""
    since = time.cast("timestamp_ntz") - F.expr("timestamp_ntz '1970-01-01 00:00:00'")
    return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")


def hour_ceil(time: Column) -> Column:
    return hour_floor(time + F.expr("interval 1 hour") - F.expr("interval 1 microsecond"))


def hours_after(time: Column, hours: Column) -> Column:
    """``time`` plus a whole number of hours given as a column."""
    return time + F.make_dt_interval(F.lit(0), hours.cast("int"))


def day_number(time: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(F.to_date(time))
