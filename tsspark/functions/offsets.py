"""Calendar offsets as column arithmetic: (last date, step) to a date, without a loop.

An offset is written like ``D``, ``2h``, ``W-MON``, ``ME``, ``QS-FEB`` or ``3B``: a number, a unit, an anchor. Clock units
(seconds, minutes, hours) add a duration and keep the time of day. Days add days. All other units name one date per
period (week, month, quarter, year): ``anchor`` finds the start of the period a date lies in, ``place`` the named date of
a period. A step from a date before its period's named date first rolls to that date, so

    advance(d, k) = place(anchor(d) + k periods, one less if d < place(anchor(d)))

Business days are days without Saturdays and Sundays; a weekend counts as the Friday before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units, and the names of weekdays and months in anchors.
CLOCK = {"s": "SECOND", "min": "MINUTE", "h": "HOUR"}
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
#: Months of a period, and whether its named date is at the end, by unit.
PERIODS = {
    "MS": (1, "start"), "ME": (1, "end"), "BMS": (1, "business start"), "BME": (1, "business end"),
    "QS": (3, "start"), "QE": (3, "end"), "YS": (12, "start"), "YE": (12, "end"),
}


@dataclass(frozen=True)
class Offset:
    unit: str
    n: int = 1
    anchor: str | None = None

    @property
    def sub_daily(self) -> bool:
        return self.unit in CLOCK


def parse(text: str | Offset) -> Offset:
    """An offset from its text; an unknown unit or anchor is an error."""
    if isinstance(text, Offset):
        return text
    found = re.fullmatch(r"(\d*)([A-Za-z]+)(?:-([A-Z]{3}))?", text)
    if not found:
        raise ValueError(f"Unknown offset '{text}'.")
    n, unit, anchor = int(found[1] or 1), found[2], found[3]
    anchors = WEEKDAYS if unit == "W" else MONTHS if unit in ("QS", "QE", "YS", "YE") else ()
    if n < 1 or unit not in {*CLOCK, *PERIODS, "D", "B", "W"} or (anchor and anchor not in anchors):
        raise ValueError(f"Unknown offset '{text}'.")
    return Offset(unit, n, anchor)


def advance(last: Column, step: Column | int, offset: str | Offset = "D") -> Column:
    """The date ``step`` (>= 1) offsets after ``last``; a timestamp for clock units."""
    offset = parse(offset)
    k = (F.lit(step) if isinstance(step, int) else step) * F.lit(offset.n)
    if offset.sub_daily:
        return F.timestamp_add(CLOCK[offset.unit], k.cast("int"), last.cast("timestamp_ntz"))
    day, k = last.cast("date"), k.cast("int")
    if offset.unit == "D":
        return F.date_add(day, k)
    if offset.unit == "B":
        weekday = F.least(F.weekday(day), F.lit(4))
        friday = F.date_sub(day, F.weekday(day) - weekday)
        return F.date_add(friday, k + 2 * F.floor((weekday + k) / 5).cast("int"))
    if offset.unit == "W":
        return _weekly(day, k, WEEKDAYS.index(offset.anchor or "SUN"))
    months, kind = PERIODS[offset.unit]
    return _by_period(day, k, months, _first_month(offset, months), PLACES[kind])


def _weekly(day: Column, k: Column, weekday: int) -> Column:
    """Weeks begin on ``weekday``, so a date is never before its period's named date."""
    start = F.date_sub(day, F.pmod(F.weekday(day) - weekday, F.lit(7)))
    return F.date_add(start, 7 * k)


def _first_month(offset: Offset, months: int) -> int:
    """Number (0 to 11) of a month in which periods begin; an end anchor names the last month of a period."""
    if months == 1:
        return 0
    if PERIODS[offset.unit][1] == "end":
        return MONTHS.index(offset.anchor or "DEC") + 1
    return MONTHS.index(offset.anchor or "JAN")


def _by_period(day: Column, k: Column, months: int, first: int, place: Callable[[Column, int], Column]) -> Column:
    into = F.pmod(F.month(day) - 1 - first, F.lit(months))
    start = F.trunc(F.add_months(day, -into), "month")
    periods = k - F.when(day < place(start, months), 1).otherwise(0)
    return place(F.add_months(start, periods * months), months)


def _end(start: Column, months: int) -> Column:
    return F.last_day(F.add_months(start, months - 1))


def _business_start(start: Column, months: int) -> Column:
    return F.date_add(start, F.when(F.weekday(start) >= 5, 7 - F.weekday(start)).otherwise(0))


def _business_end(start: Column, months: int) -> Column:
    end = _end(start, months)
    return F.date_sub(end, F.greatest(F.weekday(end) - 4, F.lit(0)))


#: The named date of the period that begins on ``start``.
PLACES: dict[str, Callable[[Column, int], Column]] = {
    "start": lambda start, months: start,
    "end": _end,
    "business start": _business_start,
    "business end": _business_end,
}
