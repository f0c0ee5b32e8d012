"""Time rendering and the free-form timestamp normaliser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the display zone is a constant +05:30 offset.
DISPLAY_OFFSET_MINUTES = 330
# Fixed value: numbers below this are epoch seconds, others epoch milliseconds.
EPOCH_SECONDS_BELOW = 1e11
NO_TIME = "—"

# Month abbreviations.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_MON = "(?i:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*)"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
_ZONE = r"\s*(?:Z|UTC|GMT|[+-]\d{2}:?\d{2}|[+-]\d{2})?"
_DAY = r"(?:(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?"

# Shapes understood natively: (pattern, order of the year/month/day/hour/minute/second groups).
_SHAPES = [
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[T\s]\s*{_CLOCK}{_ZONE})?$", (1, 2, 3, 4, 5, 6)),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:T?(\d{{2}})(\d{{2}})(\d{{2}})?{_ZONE})?$", (1, 2, 3, 4, 5, 6)),
    (rf"^{_DAY}{_MON}\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{_CLOCK}{_ZONE})?$", (3, 1, 2, 4, 5, 6)),
    (rf"^{_DAY}{_MON}\s+(\d{{1,2}})\s+{_CLOCK}\s+(\d{{4}})$", (6, 1, 2, 3, 4, 5)),
    (rf"^{_DAY}(\d{{1,2}})[\s-]{_MON}[\s-](\d{{4}})(?:,?\s+{_CLOCK}{_ZONE})?$", (3, 2, 1, 4, 5, 6)),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:\s+{_CLOCK}{_ZONE})?$", (3, 1, 2, 4, 5, 6)),
]


def parse_wall_clock(value: Column) -> Column:
    """Wall-clock time of a full date or date-time as TIMESTAMP_NTZ, else null.

    The offset, if any, is not applied. Texts that lack a year, month or day give null: filling
    them from the current day would not be repeatable. Every shape rewrites the text to
    ``y|m|d|h|m|s``; the shapes exclude each other, so the rewrites can simply follow one another.
    """
    canonical = F.trim(value)
    for pattern, order in _SHAPES:
        canonical = F.regexp_replace(canonical, F.lit(pattern), F.lit("|".join(f"${g}" for g in order)))
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, start=1) for x in (m, f"{i:02d}")])

    def two(part):
        return (
            F.when(part == "", F.lit("00"))
            .when(F.rlike(part, F.lit("^[A-Za-z]")), F.try_element_at(months, F.lower(F.substring(part, 1, 3))))
            .otherwise(F.lpad(part, 2, "0"))
        )

    def stamp(parts):
        p = [F.get(parts, F.lit(i)) for i in range(6)]
        clock = F.concat(p[0], F.lit("-"), two(p[1]), F.lit("-"), two(p[2]), F.lit("T"), two(p[3]), F.lit(":"), two(p[4]), F.lit(":"), two(p[5]))
        return F.when(F.size(parts) == 6, clock)

    return F.get(F.transform(F.array(F.split(canonical, r"\|")), stamp), F.lit(0)).try_cast("timestamp_ntz")


# Most days a month can have.
_MONTH_DAYS = {"jan|mar|may|jul|aug|oct|dec": "3[01]|[12]\\d|0?[1-9]", "apr|jun|sep|nov": "30|[12]\\d|0?[1-9]", "feb": "[12]\\d|0?[1-9]"}
_SYSLOG_TIME = (
    r"^\s*(?:(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?(?:" + "|".join(rf"(?i:{m})[a-z]*\s+(?:{days})" for m, days in _MONTH_DAYS.items())
    + r"),?\s+(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?\s*(?:Z|UTC|GMT|[+-]\d{2}:?\d{2})?\s*$"
)


def is_yearless_time(value: Column) -> Column:
    """True for times as syslog writes them, ``Jan  5 10:00:00``: a date without a year, and a clock."""
    return F.coalesce(F.rlike(value, F.lit(_SYSLOG_TIME)), F.lit(False))


def _offset_minutes(value: Column) -> Column:
    """Offset at the end of the text in minutes; 0 when there is none."""
    tail = r"\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*([+-])(\d{2}):?(\d{2})?\s*$"
    sign = F.regexp_extract(value, tail, 1)
    hours = F.regexp_extract(value, tail, 2).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(value, tail, 3).try_cast("int"), F.lit(0))
    size = F.coalesce(hours * 60 + minutes, F.lit(0))
    return F.when(sign == "-", -size).otherwise(size)


def normalize_timestamp(value: Column, tz: str = "wall") -> Column:
    """Free-form time to ``yyyy-MM-ddTHH:mm:ssZ``; text that is no full date stays as it is.

    ``tz='wall'`` keeps the wall clock and drops the offset; ``tz='utc'`` applies the offset.
    """
    clock = parse_wall_clock(value)
    if tz == "utc":
        clock = clock - F.make_dt_interval(F.lit(0), F.lit(0), _offset_minutes(value), F.lit(0).cast("decimal(18,6)"))
    return F.coalesce(F.date_format(clock, "yyyy-MM-dd'T'HH:mm:ss'Z'"), value)


def to_ist_iso(ts: Column) -> Column:
    """ISO text at +05:30 of a UTC time (TIMESTAMP_NTZ); microseconds only when not zero."""
    shifted = _shift(ts)
    whole = F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(shifted, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit("+05:30"))


def to_utc_iso(ts: Column) -> Column:
    """ISO text in UTC with six fraction digits and a Z."""
    return F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _shift(ts: Column) -> Column:
    return ts.cast("timestamp_ntz") + F.expr(f"INTERVAL '{DISPLAY_OFFSET_MINUTES}' MINUTE")


def parse_epoch(number: Column) -> Column:
    """Number of seconds or milliseconds since 1970 to TIMESTAMP_NTZ (UTC); 0 gives null."""
    micros = F.when(number < EPOCH_SECONDS_BELOW, number * 1_000_000).otherwise(number * 1_000)
    return F.when(number != 0, _from_micros(micros))


def _from_micros(micros: Column) -> Column:
    return F.timestamp_micros(F.floor(micros).cast("long")).cast("timestamp_ntz")


def parse_mixed_time(value: Column) -> Column:
    """Text to TIMESTAMP_NTZ in UTC: no zone means UTC, an offset is applied, bad text gives null."""
    text = F.trim(value)
    shape = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?\s*(?:[Zz]|[+-]\d{2}:?\d{2}|[+-]\d{2})?$"
    ok = F.rlike(text, F.lit(shape))
    local = F.regexp_replace(text, r"(?<=:\d{2}|\.\d{1,9})\s*(?:[Zz]|[+-]\d{2}(?::?\d{2})?)$", "")
    clock = F.regexp_replace(F.regexp_replace(local, r"[Zz]$", ""), " ", "T").try_cast("timestamp_ntz")
    gap = F.make_dt_interval(F.lit(0), F.lit(0), _offset_minutes(text), F.lit(0).cast("decimal(18,6)"))
    return F.when(ok, clock - gap)


def format_ist(ts: Column, mode: str = "datetime") -> Column:
    """Display text at +05:30 in one of four modes; null gives a dash."""
    local = _shift(ts)
    clock = F.concat(F.lower(F.date_format(local, "hh:mm:ss a")), F.lit(" IST"))
    day = F.date_format(local, "dd MMM")
    full_day = F.date_format(local, "dd MMM yyyy")
    text = {
        "time": clock,
        "date": full_day,
        "compact": F.concat(day, F.lit(", "), clock),
        "datetime": F.concat(full_day, F.lit(" "), clock),
    }[mode]
    return F.coalesce(text, F.lit(NO_TIME))
