"""Date parameters shared by the Spark bindings and the oracle SQL, computed
once so both sides see the same literals."""

from __future__ import annotations

import calendar
import datetime as _dt

from tessera.session import AS_OF


def days_before(n: int, base: _dt.date = AS_OF) -> _dt.date:
    return base - _dt.timedelta(days=n)


def months_before(n: int, base: _dt.date = AS_OF) -> _dt.date:
    """Calendar month shift with end-of-month clamping (``add_months``)."""
    m = base.month - 1 - n
    y = base.year + m // 12
    m = m % 12 + 1
    d = min(base.day, calendar.monthrange(y, m)[1])
    return _dt.date(y, m, d)


def month_start(base: _dt.date = AS_OF) -> _dt.date:
    return base.replace(day=1)


def next_month_start(base: _dt.date = AS_OF) -> _dt.date:
    return months_before(-1, month_start(base))


def sql_date(d: _dt.date) -> str:
    return f"DATE '{d.isoformat()}'"


D30 = days_before(30)          # 2001-07-01
D7 = days_before(7)            # 2001-07-24
M3 = months_before(3)          # 2001-04-30
M6 = months_before(6)          # 2001-01-31
M12 = months_before(12)        # 2000-07-31
M24 = months_before(24)        # 1999-07-31
DAY_AFTER = days_before(-1)    # 2001-08-01
YEAR_START = AS_OF.replace(month=1, day=1)
NEXT_YEAR_START = YEAR_START.replace(year=YEAR_START.year + 1)
