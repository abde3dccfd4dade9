"""Date / time functions of the dialect layer (F1-F11) in Spark terms.

Native Spark functions are used wherever their meaning matches; where the
reference's own arithmetic differs (approximate TIMESTAMPDIFF, fractional
DATEDIFF) that formula is provided separately under its own name.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.dialect import mysql_to_spark_format
from tessera.session import AS_OF

# ---------------------------------------------------------------- fixed values
# Divisors of the reference's approximate TIMESTAMPDIFF (days per unit).
APPROX_DAYS_PER = {"YEAR": 365.25, "MONTH": 30.44}
APPROX_MULT = {"DAY": 1, "DAYS": 1, "HOUR": 24, "HOURS": 24, "MINUTE": 1440, "MINUTES": 1440}
# -----------------------------------------------------------------------------

MICROS_PER_DAY = 86_400_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def now_as_of(as_of: _dt.date = AS_OF) -> Column:
    """NOW() / CURDATE() / GETDATE() / SYSDATE bound to the as_of date so
    results are reproducible."""
    return F.lit(as_of)


def fractional_days(a, b) -> Column:
    """(b - a) in days, fractional (julianday(b) - julianday(a)). Computed on
    zone-less timestamps, so the session time zone (and its DST jumps) never
    enters the difference."""
    return (F.timestamp_diff("MICROSECOND", _c(a).cast("timestamp_ntz"), _c(b).cast("timestamp_ntz"))
            / F.lit(float(MICROS_PER_DAY)))


def timestampdiff_approx(unit: str, a, b) -> Column:
    """F6, reference formula: day difference scaled per unit, truncated
    toward zero (YEAR /365.25, MONTH /30.44, HOUR x24, MINUTE x1440, others
    days)."""
    u = unit.upper()
    d = fractional_days(a, b)
    if u in APPROX_DAYS_PER:
        d = d / F.lit(APPROX_DAYS_PER[u])
    else:
        d = d * F.lit(float(APPROX_MULT.get(u, 1)))
    return d.cast("bigint")


def timestampdiff_exact(unit: str, a, b) -> Column:
    """F6, native: complete units between a and b."""
    return F.timestamp_diff(unit.upper(), _c(a), _c(b)).cast("bigint")


def datediff_days(end, start) -> Column:
    """F7, native DATEDIFF: counts date boundaries."""
    return F.datediff(_c(end), _c(start))


def datediff_truncated(end, start) -> Column:
    """F7, reference formula: truncated fractional day difference."""
    return fractional_days(start, end).cast("bigint")


def date_format_mysql(x, mysql_fmt: str) -> Column:
    """DATE_FORMAT with a MySQL format, translated on the driver."""
    return F.date_format(_c(x), mysql_to_spark_format(mysql_fmt))


def age_years(birth, as_of: _dt.date = AS_OF) -> Column:
    """completed years between ``birth`` and ``as_of``."""
    return timestampdiff_exact("YEAR", birth, F.lit(as_of).cast("timestamp_ntz"))
