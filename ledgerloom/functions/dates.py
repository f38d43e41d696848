"""Date expressions. Results are TIMESTAMP_NTZ in UTC; nothing here reads the clock.

Every text is first tested against the shape of a format and parsed only when it fits, so a row costs one
parse instead of a failed parse per format. Parsing needs the session zone UTC (``session.ENGINE_CONF``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .staging import bound
from .text import literal_array, literal_map, strip

# Accepted date formats in the order they are tried.
DATE_FORMATS = [
    "%b %d, %Y at %I:%M %p",
    "%B %d, %Y at %I:%M %p",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%d",
    "%m/%d/%Y",
    "%m/%d/%y",
    "%b %d, %Y",
    "%B %d, %Y",
    "%Y-%m-%d %H:%M:%S",
    "%m/%d/%y %I:%M %p",
    "%a, %d %b %Y %H:%M:%S %z",
    "%Y-%m-%dT%H:%M:%S%z",
    "%Y-%m-%d %H:%M:%S%z",
    "%d/%m/%Y %H:%M:%S%z",
    "%Y-%m-%dT%H:%M:%S.%f%z",
]

# Named zones in a date text.
NAMED_ZONES = {
    "GMT": "UTC",
    "ET": "America/New_York",
    "CT": "America/Chicago",
    "MT": "America/Denver",
    "PT": "America/Los_Angeles",
}

# Zone names of RFC 2822 headers.
HEADER_ZONES = {
    "UT": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "Z": "+00:00",
    "AST": "-04:00", "ADT": "-03:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
}

# directive -> (shape, Spark pattern letters)
_DIRECTIVES = {
    "%a": ("[a-z]{3}", ""),
    "%b": ("[a-z]{3}", "MMM"),
    "%B": ("[a-z]{3,9}", "MMMM"),
    "%d": (r"\d{1,2}", "d"),
    "%m": (r"\d{1,2}", "M"),
    "%Y": (r"\d{4}", "yyyy"),
    "%y": (r"\d{2}", "yy"),
    "%H": (r"\d{1,2}", "H"),
    "%I": (r"\d{1,2}", "h"),
    "%M": (r"\d{1,2}", "m"),
    "%S": (r"\d{1,2}", "s"),
    "%f": (r"\d{1,6}", "SSSSSS"),
    "%p": ("[ap]m", "a"),
    "%z": (r"(?:z|[+-]\d{2}:?\d{2})", ""),
}
_OFFSET = r"(?i)(?:z|([+-])(\d{2}):?(\d{2}))$"
_RFC2822 = (
    r"(?i)^(?:[a-z]+,?\s+)?(\d{1,2})\s+([a-z]{3})\s+(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?"
    r"(?:\s+([+-]\d{4}|[a-z]+))?$"
)


def _shape(fmt: str) -> str:
    parts = re.split("(%[a-zA-Z])", fmt)
    body = "".join(_DIRECTIVES[p][0] if p in _DIRECTIVES else re.escape(p).replace("\\ ", r"\s+") for p in parts)
    return f"(?i)^{body}$"


def _spark_pattern(fmt: str) -> str:
    parts = re.split("(%[a-zA-Z])", fmt.replace("%a, ", ""))
    out = "".join(_DIRECTIVES[p][1] if p in _DIRECTIVES else re.sub("([A-Za-z]+)", r"'\1'", p) for p in parts)
    return out.strip()


def _ntz(ts: Column) -> Column:
    return ts.cast("timestamp_ntz")


def _offset_zone(sign: Column, hours: Column, minutes: Column) -> Column:
    """``+05:30``; an offset that no zone has gives NULL."""
    valid = (hours <= "17") & (minutes <= "59")
    return F.when(valid, F.concat(sign, hours, F.lit(":"), minutes))


def _to_utc(local: Column, zone: Column) -> Column:
    return F.convert_timezone(zone, F.lit("UTC"), local)


def header_wall_clock(text: Column) -> Column:
    """Local time of an RFC 2822 header date, without its zone."""

    def wall_clock(text: Column) -> Column:
        wall = F.regexp_replace(text, _RFC2822, "$1 $2 $3 $4:$5:0$6")
        wall = F.regexp_replace(wall, r":0(\d{2})$", ":$1")
        return F.when(text.rlike(_RFC2822), _ntz(F.try_to_timestamp(wall, F.lit("d MMM yyyy H:m:s"))))

    return bound(_header_text(text), wall_clock)


def _header_text(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s*\([^)]*\)", ""))


def header_zone(text: Column) -> Column:
    """Zone of an RFC 2822 header date, NULL if it has none."""

    def offset(zone: Column) -> Column:
        numeric = _offset_zone(F.substring(zone, 1, 1), F.substring(zone, 2, 2), F.substring(zone, 4, 2))
        return F.when(zone == "-0000", None).when(zone.rlike("^[+-]"), numeric).otherwise(F.try_element_at(literal_map(HEADER_ZONES), zone))

    return bound(F.upper(F.regexp_extract(_header_text(text), _RFC2822, 7)), offset)


def header_instant(text: Column, default_zone: str = "UTC") -> Column:
    """RFC 2822 header date in UTC."""
    return _to_utc(header_wall_clock(text), F.coalesce(header_zone(text), F.lit(default_zone)))


def named_zone(text: Column) -> Column:
    """Zone named in the text as a whole upper-case word."""
    names = "|".join(NAMED_ZONES)
    return F.try_element_at(literal_map(NAMED_ZONES), F.regexp_extract(text, rf"\b({names})\b", 1))


def drop_zone_names(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"\s*\b(?:{'|'.join(NAMED_ZONES)})\b", ""))


def format_number(cleaned: Column) -> Column:
    """Position of the first format whose shape the text has, from 1; NULL if none."""
    chosen = F.when(cleaned.rlike(_shape(DATE_FORMATS[0])), 1)
    for number, fmt in enumerate(DATE_FORMATS[1:], 2):
        chosen = chosen.when(cleaned.rlike(_shape(fmt)), number)
    return chosen


def parse_date(text: Column, header_date: Column | None = None, default_zone: str = "UTC") -> Column:
    """First format that fits wins. Midnight takes the header's time of day; the zone is the offset in the
    text, else a named zone, else the header's zone, else ``default_zone``. The result is in UTC."""
    header_date = F.lit(None).cast("string") if header_date is None else header_date
    with_zone = [i for i, fmt in enumerate(DATE_FORMATS, 1) if "%z" in fmt]

    def in_utc(cleaned: Column, number: Column, local: Column) -> Column:
        sign = F.regexp_extract(cleaned, _OFFSET, 1)
        offset = F.when(sign == "", F.lit("UTC")).otherwise(
            _offset_zone(sign, F.regexp_extract(cleaned, _OFFSET, 2), F.regexp_extract(cleaned, _OFFSET, 3))
        )
        zone = F.when(number.isin(with_zone), offset).otherwise(
            F.coalesce(named_zone(text), header_zone(header_date), F.lit(default_zone))
        )
        sent_at = bound(header_wall_clock(header_date), lambda wall: wall - _ntz(F.date_trunc("day", wall)))
        time_of_day = F.when(_ntz(F.date_trunc("day", local)) == local, sent_at)
        filled = local + F.coalesce(time_of_day, F.expr("INTERVAL '0 00:00:00' DAY TO SECOND"))
        return F.when(local.isNotNull(), _to_utc(filled, zone))

    def parsed(cleaned: Column) -> Column:
        return bound(
            format_number(cleaned),
            lambda number: bound(_local_time(cleaned, number, with_zone), lambda local: in_utc(cleaned, number, local)),
        )

    return F.when(text.isNotNull(), bound(F.regexp_replace(drop_zone_names(text), r"\s+", " "), parsed))


def _local_time(cleaned: Column, number: Column, with_zone: list[int]) -> Column:
    """Local time of a text that has the shape of the format with that number."""
    plain = F.regexp_replace(cleaned, r"(?i)^[a-z]{3},\s*|(?<=\d{2})\s*(?:z|[+-]\d{2}:?\d{2})$", "")
    source = F.when(number.isin(with_zone), plain).otherwise(cleaned)
    pattern = F.get(literal_array([_spark_pattern(fmt) for fmt in DATE_FORMATS]), number - 1)
    short_year = [i for i, fmt in enumerate(DATE_FORMATS, 1) if "%y" in fmt]
    # two-digit years 69..99 belong to the last century
    back = lambda local: F.make_ym_interval(F.when(number.isin(short_year) & (F.year(local) >= 2069), 100).otherwise(0), F.lit(0))
    return F.when(number.isNotNull(), bound(_ntz(F.try_to_timestamp(source, pattern)), lambda local: local - back(local)))


def iso_to_utc(text: Column) -> Column:
    """ISO text to UTC: a bare date is midnight UTC, a missing zone is UTC, junk is NULL."""
    text = strip(text)
    shape = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:[zZ]|[+-]\d{2}:?\d{2}(?::\d{2})?)?)?$"
    return F.when(text.rlike(shape), _ntz(F.try_to_timestamp(F.upper(text))))


def is_iso(text: Column) -> Column:
    return F.coalesce(iso_to_utc(text).isNotNull(), F.lit(False))


def guarded_date(date: Column, as_of: Column) -> Column:
    """A missing date and a date in the future both become ``as_of``."""
    return F.when(date <= as_of, date).otherwise(as_of)


def is_stated(date: Column, as_of: Column) -> Column:
    """True when the date is used as given, so its parts may be filled."""
    return F.coalesce(date <= as_of, F.lit(False))


def date_parts(date: Column) -> dict[str, Column]:
    """Day, month, year and full weekday name."""
    return {
        "day": F.dayofmonth(date),
        "month": F.month(date),
        "year": F.year(date),
        "day_name": F.date_format(date, "EEEE"),
    }


def date_features(date: Column, as_of: Column) -> dict[str, Column]:
    """Date parts with the defaults 1, 1, year of ``as_of`` and Monday."""
    parts = date_parts(date)
    return {
        "day": F.coalesce(parts["day"], F.lit(1)),
        "month": F.coalesce(parts["month"], F.lit(1)),
        "year": F.coalesce(parts["year"], F.year(as_of)),
        "day_name": F.coalesce(parts["day_name"], F.lit("Monday")),
    }


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.expr(f"INTERVAL '{int(days)}' DAY")


def hours_before(as_of: Column, hours: int) -> Column:
    return as_of - F.expr(f"INTERVAL '{int(hours)}' HOUR")


def as_clock(as_of) -> Column:
    """``as_of`` as a column: an ISO text, a datetime or a column."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp_ntz")
