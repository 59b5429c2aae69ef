"""Date and duration expressions. Every moment is epoch milliseconds in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR
# years 1 to 9999
FIRST_DAY = -719_162 * DAY
LAST_DAY = 2_932_897 * DAY - 1

# Fixed patterns of the upload times shown on the list pages.
HOURS_AGO = r"^([0-9]+)小时"
YESTERDAY_AT = r"^昨天([0-9]+):([0-9]+)"
DAY_BEFORE_AT = r"^前天([0-9]+):([0-9]+)"
DAYS_AGO = r"^([0-9]+)天前"
ISO_DATE = r"^[0-9]+-[0-9]+-[0-9]+"
CN_DATE = r"([0-9]+)年([0-9]+)月([0-9]+)日"
DURATION_UNITS = (("分钟", MINUTE), ("小时", HOUR), ("天", DAY))


def as_millis(now: Column | int) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("bigint")


def _number(value: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(value, pattern, group).try_cast("bigint")


def _ago(now: Column, count: Column, unit: int) -> Column:
    return F.try_subtract(now, F.try_multiply(count, F.lit(unit).cast("bigint")))


def date_to_ms(value: Column) -> Column:
    """`Y-M-D` to the start of that day, null when it is no date."""
    day = F.try_to_timestamp(value, F.lit("yyyy-M-d")).cast("date")
    return F.unix_date(day).cast("bigint") * F.lit(DAY).cast("bigint")


def ms_to_day(ms: Column) -> Column:
    inside = ms.between(FIRST_DAY, LAST_DAY)
    return F.date_from_unix_date(F.floor(F.when(inside, ms) / F.lit(float(DAY))).cast("int"))


def ms_to_date(ms: Column) -> Column:
    """Milliseconds to `YYYY-MM-DD`."""
    return ms_to_day(ms).cast("string")


def upload_time_ms(value: Column, now: Column | int) -> Column:
    """Upload time from the site's wording; unreadable wording gives `now`."""
    now = as_millis(now)
    midnight = now - F.pmod(now, F.lit(DAY).cast("bigint"))

    def clock(pattern: str, days_back: int) -> Column:
        parts = [F.try_multiply(_number(value, pattern, group), F.lit(unit).cast("bigint"))
                 for group, unit in ((1, HOUR), (2, MINUTE))]
        return F.try_add(F.try_add(midnight - F.lit(days_back * DAY).cast("bigint"), parts[0]), parts[1])

    read = (F.when(value.rlike(HOURS_AGO), _ago(now, _number(value, HOURS_AGO), HOUR))
            .when(value.rlike(YESTERDAY_AT), clock(YESTERDAY_AT, 1))
            .when(value.rlike(DAY_BEFORE_AT), clock(DAY_BEFORE_AT, 2))
            .when(value.rlike(DAYS_AGO), _ago(now, _number(value, DAYS_AGO), DAY))
            .when(value.rlike(ISO_DATE), date_to_ms(value)))
    # a moment outside the calendar is as good as unreadable
    return F.coalesce(F.when(read.between(FIRST_DAY, LAST_DAY), read), now)


def upload_time_cn(value: Column, now: Column | int) -> Column:
    """First `Y年M月D日` in a longer text; without a date gives `now`."""
    parts = [F.regexp_extract(value, CN_DATE, group) for group in (1, 2, 3)]
    return F.coalesce(date_to_ms(F.concat_ws("-", *parts)), as_millis(now))


def duration_ms(value: Column) -> Column:
    """`N分钟`, `N小时` or `N天`; null without a unit or a number."""
    result = None
    for unit, millis in DURATION_UNITS:
        count = F.trim(F.substring_index(value, unit, 1)).try_cast("bigint")
        length = F.try_multiply(count, F.lit(millis).cast("bigint"))
        hit = value.contains(unit)
        result = F.when(hit, length) if result is None else result.when(hit, length)
    return result


def date_part(value: Column) -> Column:
    """Date of an ISO datetime; anything else is left as it is."""
    day = F.regexp_extract(value, r"^([0-9]+-[0-9]+-[0-9]+)T", 1)
    return F.coalesce(F.nullif(day, F.lit("")), value)
