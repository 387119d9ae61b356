"""Civil dates and minutes of day as columns.  ``today`` and ``now`` are always arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Minutes of the named parts of a day.
PART_MINUTES = {"morning": 540, "noon": 720, "midday": 720, "afternoon": 840, "evening": 1080, "night": 1200, "tonight": 1200, "midnight": 0}


def parse_date(text: Column) -> Column:
    """A date written exactly as YYYY-MM-DD, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def parse_minute(text: Column) -> Column:
    """The minute of day of HH:MM, else null."""
    ok = text.rlike(r"^([01]\d|2[0-3]):[0-5]\d$")
    return F.when(ok, F.substring(text, 1, 2).try_cast("int") * 60 + F.substring(text, 4, 2).try_cast("int"))


def format_minute(minute: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), (minute % 60).cast("int"))


def iso_weekday(day: Column) -> Column:
    return F.weekday(day) + 1


def forward_weekday(today: Column, target: Column, allow_today: Column | bool = False) -> Column:
    """The next such weekday; today itself only if allowed."""
    ahead = F.pmod(target - iso_weekday(today), F.lit(7))
    allow = F.lit(allow_today) if isinstance(allow_today, bool) else allow_today
    return F.date_add(today, F.when((ahead == 0) & ~allow, 7).otherwise(ahead).cast("int"))


def next_week_weekday(today: Column, target: Column) -> Column:
    """That weekday of the next Monday-to-Sunday week."""
    return F.date_add(F.trunc(today, "week"), (target + 6).cast("int"))


def last_weekday(today: Column, target: Column) -> Column:
    """The latest such weekday before today."""
    back = F.pmod(iso_weekday(today) - target, F.lit(7))
    return F.date_sub(today, F.when(back == 0, 7).otherwise(back).cast("int"))


def exact_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where there is none."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")), "yyyy-MM-dd")


def day_of_month_on_or_after(today: Column, day: Column) -> Column:
    """The first date with this day of the month (1 to 31), today or later; no two months in a row are too short for it."""
    first = F.trunc(today, "month")

    def of_month(k: int) -> Column:
        start = F.add_months(first, k)
        return F.when(day.between(1, F.day(F.last_day(start))), F.date_add(start, (day - 1).cast("int")))

    this = of_month(0)
    return F.coalesce(F.when(this >= today, this), of_month(1), of_month(2))


def yearless_date(today: Column, month: Column, day: Column, years: int = 8) -> Column:
    """The first such date, today or later, within ``years`` years (for 29 February)."""
    dates = F.transform(F.sequence(F.lit(0), F.lit(years)), lambda k: exact_date(F.year(today) + k, month, day))
    return F.array_min(F.filter(dates, lambda d: d >= today))


def full_year(year: Column) -> Column:
    return F.when(year < 100, year + 2000).otherwise(year)


def hour_without_meridiem(hour: Column, written_zero: Column | bool = False) -> Column:
    """1 to 6 are afternoon hours, unless written with a leading zero."""
    zero = F.lit(written_zero) if isinstance(written_zero, bool) else written_zero
    return F.when((hour >= 1) & (hour <= 6) & ~zero, hour + 12).otherwise(hour)


def hour_with_meridiem(hour: Column, pm: Column) -> Column:
    return F.pmod(hour, F.lit(12)) + F.when(pm, 12).otherwise(0)


def hour_in_part(hour: Column, part: Column) -> Column:
    """A clock hour inside a spoken part of the day; at night 1 to 4 stay and 12 is midnight."""
    night = F.when(hour == 12, 0).when(hour.between(1, 4), hour).when(hour < 12, hour + 12).otherwise(hour)
    late = F.when(hour < 12, hour + 12).otherwise(hour)
    return F.when(part == "morning", F.when(hour == 12, 0).otherwise(hour)).when(part == "night", night).when(part.isin("afternoon", "evening"), late).otherwise(hour)


def to_instant(civil: Column, zone: str) -> Column:
    """The instant of a civil date-time in a zone: a gap moves forward, an overlap takes the earlier offset."""
    return F.to_utc_timestamp(civil.cast("timestamp"), zone)


def reminder_at(due: Column, minute: Column, all_day_minute: int, lead: Column, now: Column) -> Column:
    """When to remind, as TIMESTAMP_NTZ.

    Due time (or ``all_day_minute``) less the lead.  An all-day task of today whose
    time is over gets the next quarter of an hour at least 5 minutes ahead, at most 23:59.
    """
    start = due.cast("timestamp_ntz")
    at = start + F.make_dt_interval(mins=F.coalesce(minute, F.lit(all_day_minute)) - lead)
    quarter = F.least(F.floor((F.hour(now) * 60 + F.minute(now) + 5 + 14) / 15) * 15, F.lit(1439)).cast("int")
    late = minute.isNull() & (due == F.to_date(now)) & (at <= now)
    return F.when(late, start + F.make_dt_interval(mins=quarter)).otherwise(at)
