"""Date/time expressions: parsing, formatting, calendar parts, offsets
(P4, P5, F6, F7, F9, F21)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_dayfirst(s) -> Column:
    """`dd-MM-yyyy` first, ISO `yyyy-MM-dd` as fallback, bad text -> NULL.
    `try_to_date` keeps ANSI mode from raising on junk."""
    s = _c(s)
    return F.coalesce(F.try_to_date(s, "dd-MM-yyyy"), F.try_to_date(s, "yyyy-MM-dd"))


def format_dayfirst(d) -> Column:
    """P5: date -> `dd-MM-yyyy` text."""
    return F.date_format(_c(d), "dd-MM-yyyy")


def month_key(d) -> Column:
    """P5: date -> `yyyy-MM` text."""
    return F.date_format(_c(d), "yyyy-MM")


def iso_day(d) -> Column:
    return F.date_format(_c(d), "yyyy-MM-dd")


def cyclic_month(d) -> dict[str, Column]:
    """month on the unit circle, plus quarter."""
    m = F.month(_c(d))
    ang = m * F.lit(2 * math.pi / 12)
    return {"month_sin": F.sin(ang), "month_cos": F.cos(ang), "quarter": F.quarter(_c(d))}


def calendar_parts(d) -> dict[str, Column]:
    """year, month, day, day-of-year, season = (month % 12) div 3."""
    d = _c(d)
    return {
        "year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d),
        "dayofyear": F.dayofyear(d),
        "season": F.floor((F.month(d) % 12) / 3).cast("int"),
    }


def _micros_of_day(ts: Column) -> Column:
    return (F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000
            + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long"))


def micros_between(start, end) -> Column:
    """end - start in microseconds of wall-clock time, built from the day
    difference and the time of day. For TIMESTAMP_NTZ (what the tables hold)
    this never consults the session time zone, so a DST switch cannot shift
    an offset by an hour (`timestamp_diff` would cast NTZ to the session
    zone first; `unix_micros` rejects NTZ)."""
    return wall_micros(end) - wall_micros(start)


def wall_micros(ts) -> Column:
    """Microseconds of wall-clock time since 1970. Range joins compute it once a row on each side, since a pair
    then costs a subtraction."""
    ts = _c(ts)
    return F.unix_date(ts.cast("date")).cast("long") * MICROS_PER_DAY + _micros_of_day(ts)


def abs_day_offset(scene_ts, sample_ts) -> Column:
    """|floor((scene - sample) / 1 day)| — -0.5 d gives 1, +0.5 d gives 0,
    as Python's `timedelta.days`; `timestampdiff(DAY)` truncates instead."""
    return day_offset_of(micros_between(sample_ts, scene_ts))


def day_offset_of(micros: Column) -> Column:
    """`abs_day_offset` of a difference in microseconds."""
    return F.abs(F.floor(micros / F.lit(float(MICROS_PER_DAY)))).cast("bigint")


def epoch_day(ts) -> Column:
    """Day number of a timestamp / date (floor), used for time bucketing."""
    return F.unix_date(_c(ts).cast("date"))


def time_window_bounds(ts, days: int) -> dict[str, Column]:
    """search window as start/end text around a sample date."""
    d = _c(ts).cast("date")
    return {"date_start": iso_day(F.date_sub(d, days)), "date_end": iso_day(F.date_add(d, days))}
