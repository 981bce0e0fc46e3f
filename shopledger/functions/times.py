"""Instants, business days and daylight-saving rules. The session time zone must be UTC."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted formats, the shape a value must have, and the Spark pattern.
FORMATS = {
    "%Y-%m-%d": (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    "%Y/%m/%d": (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    "%Y-%m-%d %H:%M:%S": (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
    "%d/%m/%Y %H:%M": (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$", "d/M/yyyy H:m"),
    "%m/%d/%Y %H:%M": (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$", "M/d/yyyy H:m"),
    "%d/%m/%Y": (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    "%m/%d/%Y": (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
}
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?"
_OFFSET = r"(Z|[+-]\d{2}:\d{2})$"
_FIXED_ZONES = {"UTC", "Etc/UTC", "GMT", "Etc/GMT"}


def wall_to_instant(wall: Column, zone: str) -> Column:
    """Local wall time to an instant; ambiguous and non-existent wall times become null."""
    if zone in _FIXED_ZONES:
        return wall

    instant = F.to_utc_timestamp(wall, zone)
    # some zones move their clocks by half an hour, so both steps are tried
    later = [F.from_utc_timestamp(instant + F.expr(f"INTERVAL {m} MINUTES"), zone) for m in (30, 60)]
    # all three are null or none is. `least` looks at all of them, so generated code computes each conversion once a row; behind
    # `&`, or inside a branch, Spark computes the text and the instant again for every use.
    clear = F.least(F.from_utc_timestamp(instant, zone) == wall, later[0] != wall, later[1] != wall)
    return F.when(clear, instant)


def parse_time(c: Column, time_format: str, zone: str) -> Column:
    """Text to an instant at second precision; an explicit offset is honoured."""
    if time_format == "iso8601":
        has_offset = c.rlike(_ISO + _OFFSET)
        instant = F.when(has_offset, c.try_cast("timestamp")).when(
            c.rlike(_ISO + "$"), wall_to_instant(c.try_cast("timestamp"), zone)
        )
    else:
        shape, pattern = FORMATS[time_format]
        instant = wall_to_instant(F.try_to_timestamp(F.when(c.rlike(shape), c), F.lit(pattern)), zone)
    return F.date_trunc("second", instant)


def local_day(instant: Column, zone: str) -> Column:
    if zone in _FIXED_ZONES:
        return F.to_date(instant)
    return F.to_date(F.from_utc_timestamp(instant, zone))


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")
