"""Time zones, local days and timestamps, on milliseconds since the epoch.

Names of zones are resolved before Spark sees them, as Spark reads CST, EST and MST in its own way and fails on names that
it does not know. Defined results: a null or empty zone is the default one; a name that nothing matches is as well.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .labels import literal_map

DEFAULT_ZONE = "UTC"
DAY_MS = 86_400_000
#: Abbreviations and common names that are no zones of the tz database, or mean others there.
ALIASES = {
    "PRC": "Asia/Shanghai", "ASIA/BEIJING": "Asia/Shanghai", "ASIA/CHONGQING": "Asia/Shanghai", "BEIJING": "Asia/Shanghai", "CHINA": "Asia/Shanghai",
    "GMT": "UTC", "Z": "UTC",
    "EST": "America/New_York", "EDT": "America/New_York",
    "PST": "America/Los_Angeles", "PDT": "America/Los_Angeles",
    "MST": "America/Denver", "MDT": "America/Denver",
}
#: A fixed offset: sign, hours and minutes, with a prefix that changes nothing.
_OFFSET = r"^(?:UTC|GMT|CST)?\s*([+-])\s*(\d{1,2})(?::?(\d{2}))?$"
MOST_HOURS = 14


@lru_cache(1)
def known_zones() -> tuple[str, ...]:
    """The names of the tz database, written as it writes them, that Spark reads (about 600)."""
    ids = SparkSession.active()._jvm.java.time.ZoneId.getAvailableZoneIds()
    return tuple(sorted({*ids.toArray(), "HST"}))


def resolve_zone(name: Column, cst: str = "America/New_York", default: str = DEFAULT_ZONE) -> Column:
    """A zone name or a fixed offset (+08:00) that Spark reads as meant: CST as configured, aliases in any case, names of the tz database, then offsets."""
    plain = F.trim(F.coalesce(name, F.lit("")))
    upper = F.upper(plain)
    known = F.try_element_at(literal_map(ALIASES | {"CST": cst}), upper)
    zone = F.when(plain.isin(*known_zones()), plain)
    part = lambda k: F.nullif(F.regexp_extract(upper, _OFFSET, k), F.lit(""))
    hours, minutes = part(2).cast("int"), F.coalesce(part(3), F.lit("00")).cast("int")
    total = hours * 60 + minutes
    offset = F.when(hours <= MOST_HOURS, F.format_string("%s%02d:%02d", part(1), F.floor(total / 60).cast("int"), F.pmod(total, F.lit(60))))
    return F.coalesce(known, zone, offset, F.lit(default))


def millis(ts: Column) -> Column:
    """Milliseconds of a timestamp, with or without a zone (taken as UTC)."""
    return F.unix_millis(ts.cast("timestamp"))


def local_time(ts_ms: Column, zone: Column) -> Column:
    """The wall clock in zone, as a timestamp."""
    return F.from_utc_timestamp(F.timestamp_millis(ts_ms), zone)


def local_date(ts_ms: Column, zone: Column) -> Column:
    return local_time(ts_ms, zone).cast("date")


def local_midnight(ts_ms: Column, zone: Column) -> Column:
    """Milliseconds of the midnight at which the local day of ts_ms begins."""
    return F.unix_millis(F.to_utc_timestamp(F.date_trunc("day", local_time(ts_ms, zone)), zone))


def day_range(date: Column, zone: Column) -> tuple[Column, Column]:
    """Where a local calendar day begins and ends; days on which clocks change have 23 or 25 hours."""
    at = lambda d: F.unix_millis(F.to_utc_timestamp(d.cast("timestamp"), zone))
    return at(date), at(F.date_add(date, 1))


def utc_midnight(ts_ms: Column) -> Column:
    return ts_ms - F.pmod(ts_ms, F.lit(DAY_MS))


def local_text(ts_ms: Column, zone: Column, millis: bool = False) -> Column:
    return F.date_format(local_time(ts_ms, zone), "yyyy-MM-dd HH:mm:ss.SSS" if millis else "yyyy-MM-dd HH:mm:ss")


#: Dates as 2026-08-19 or 20260819, or by weeks as 2026-W34-3 or 2026W343; then any sign, the clock (10, 10:05, 10:05:01.5, with or without colons), an offset.
_ISO = r"^(?:(\d{4})(-?)(\d{2})\2(\d{2})|(\d{4})-?W(\d{2})(?:-?(\d))?)(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?(?:(Z)|([+-])(\d{2})(?::?(\d{2})(?::?(\d{2})(?:\.\d+)?)?)?)?)?$"


def parse_time(text: Column, zone: Column) -> Column:
    """Milliseconds of a text: digits are milliseconds already; forms of ISO 8601, of which an offset wins, else the clock of zone; null where it is no time."""
    plain = F.trim(text)
    part = lambda k: F.nullif(F.regexp_extract(plain, _ISO, k), F.lit(""))
    number = lambda k: F.coalesce(part(k).cast("int"), F.lit(0))
    by_day = F.try_to_timestamp(F.concat_ws("-", part(1), part(3), part(4)), F.lit("yyyy-MM-dd")).cast("date")
    # The fourth of January is in the first week.
    monday = F.date_trunc("week", F.try_to_timestamp(F.concat(part(5), F.lit("-01-04")), F.lit("yyyy-MM-dd"))).cast("date")
    week, day = number(6), F.coalesce(part(7).cast("int"), F.lit(1))
    by_week = F.date_add(monday, (week - 1) * 7 + day - 1)
    by_week = F.when(week.between(1, 53) & day.between(1, 7) & (F.weekofyear(by_week) == week), by_week)
    fraction = F.substring(F.rpad(F.coalesce(part(11), F.lit("")), 3, "0"), 1, 3).cast("int")
    clock = F.when((number(8) < 24) & (number(9) < 60) & (number(10) < 60), (number(8) * 3600 + number(9) * 60 + number(10)) * 1000 + fraction)
    local = F.unix_date(F.coalesce(by_day, by_week)).cast("long") * DAY_MS + clock
    offset = F.when(part(13) == "-", -1).otherwise(1) * (number(14) * 3600 + number(15) * 60 + number(16)) * 1000
    own = F.coalesce(part(12), part(13)).isNotNull()
    iso = F.when(own, local - offset).otherwise(F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(local), zone)))
    return F.when(plain.rlike(r"^\d+$"), plain.try_cast("long")).when(plain.rlike(_ISO), iso)
