"""Creation times arrive as text in several spellings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from factstore.functions.text import let, py_strip

_EPOCH = r"^(\d+\.?\d*|\.\d+)$"
_DATE = r"(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-\d)?|\d{4}W\d{2}\d?)"
_CLOCK = r"(\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?|(\d{2})(?:(\d{2})(?:[.,](\d+))?)?)?"
_ZONE = r"(?:Z|([+-])(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?)?"
_STAMP = f"^{_DATE}T{_CLOCK}{_ZONE}$"
# All parts of a stamp from a single match, as fields of one delimited text.
_FIELDS = "|".join(f"${i}" for i in range(1, 14))
_DAY, _HOUR, _SIGN = 0, 1, 8


def _calendar_day(day: Column) -> Column:
    """ISO day for a calendar date (2020-01-31, 20200131) or a week date (2020-W05-1)."""
    year = F.substring(day, 1, 4)
    compact = F.concat_ws("-", year, F.substring(day, 5, 2), F.substring(day, 7, 2))
    digits = F.regexp_replace(day, "-", "")
    week = F.substring(digits, 6, 2).try_cast("int")
    weekday = F.coalesce(F.substring(digits, 8, 1).try_cast("int"), F.lit(1))
    jan4 = F.concat(year, F.lit("-01-04")).try_cast("date")

    def checked(of_week):
        fits = weekday.between(1, 7) & (F.weekofyear(of_week) == week) & (
            F.extract(F.lit("YEAROFWEEK"), of_week) == year.try_cast("int"))
        return F.when(fits, of_week.cast("string"))

    of_week = F.date_add(F.date_sub(jan4, F.weekday(jan4)), ((week - 1) * 7 + weekday - 1).cast("int"))
    return (F.when(day.contains("W"), let(of_week, checked))
            .when(F.length(day) == 8, compact)
            .otherwise(day))


def _or_zero(field: Column) -> Column:
    return F.when(field == "", F.lit("00")).otherwise(field)


def _offset_micros(part) -> Column:
    """Offset from UTC in microseconds; null for an impossible one."""
    hours, minutes, seconds = (_or_zero(part[_SIGN + i]).try_cast("bigint") for i in (1, 2, 3))
    micros = F.rpad(part[_SIGN + 4], 6, "0").try_cast("bigint")
    size = (hours * 3600 + minutes * 60 + seconds) * 1000000 + micros
    return (F.when(part[_SIGN] == "", F.lit(0).cast("bigint"))
            .when((hours < 24) & (minutes < 60) & (seconds < 60),
                  F.when(part[_SIGN] == "-", -size).otherwise(size)))


def _stamp_seconds(part) -> Column:
    day, hour = _calendar_day(part[_DAY]), part[_HOUR]
    # The clock is spelled with colons (fields 2-4) or without (fields 5-7).
    minute, second = (_or_zero(F.concat(part[i], part[i + 3])) for i in (2, 3))
    fraction = F.rpad(F.concat(part[4], part[7]), 6, "0")
    fits = (hour < "24") & (minute < "60") & (second < "60") & ~part[_DAY].startswith("0000")
    local = F.concat(day, F.lit("T"), hour, F.lit(":"), minute, F.lit(":"), second, F.lit("."), fraction, F.lit("Z"))
    micros = F.unix_micros(F.when(fits, local.try_cast("timestamp")))
    return (micros - _offset_micros(part)) / F.lit(1000000.0)


def parse_created_at(c) -> Column:
    """Epoch seconds as double, or null when the text is no known spelling.

    Digits with at most one dot are epoch seconds; everything else must be an ISO
    day with an optional ``T`` time and zone. A missing zone means UTC.
    """
    def parsed(text):
        stamp = F.when(text.contains("T"), text).otherwise(F.concat(text, F.lit("T00:00:00")))
        fields = F.split(F.regexp_replace(stamp, _STAMP, _FIELDS), "\\|")
        return (F.when(text.rlike(_EPOCH), text.try_cast("double"))
                .otherwise(let(fields, lambda part: F.when(F.size(part) == 13, _stamp_seconds(part)))))

    return let(py_strip(c), parsed)


def utc_now_text() -> Column:
    """The current time as ISO text in UTC, whatever the session zone is."""
    utc = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
