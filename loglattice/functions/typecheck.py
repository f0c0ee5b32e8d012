"""Type predicates on extracted values: text plus the JSON kind it came from."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loglattice.functions.timefmt import is_yearless_time, parse_wall_clock

# Spellings of truth values.
BOOLEAN_WORDS = ["true", "false", "1", "0", "yes", "no"]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"


def _ipv6_pattern() -> str:
    """RFC 4291 text forms: eight groups, or fewer around one '::', the last two may be IPv4."""
    group = "[0-9A-Fa-f]{1,4}"

    def run(n: int) -> str:
        return f"{group}(?::{group}){{{n - 1}}}" if n > 1 else group

    forms = [run(8), f"{run(6)}:{IPV4}"]
    for left in range(0, 8):
        head = run(left) if left else ""
        room = 7 - left
        tails = [f"(?:{group}(?::{group}){{0,{room - 1}}})?" if room else ""]
        if room >= 2:
            tails.append(f"(?:{group}:){{0,{room - 2}}}{IPV4}")
        forms.append(f"{head}::(?:{'|'.join(tails)})")
    return "(?:" + "|".join(forms) + ")(?:%[^%/]+)?"


IP_PATTERN = rf"^(?:{IPV4}|{_ipv6_pattern()})$"


def is_int(value: Column, kind: Column | None = None) -> Column:
    """Whole-number text; a JSON number or boolean always converts, JSON null and containers never."""
    textual = F.rlike(value, F.lit(r"^\s*[+-]?\d+(?:_\d+)*\s*$"))
    if kind is None:
        return F.coalesce(textual, F.lit(False))
    return F.when(kind.isin("num", "bool"), True).when(kind == "str", F.coalesce(textual, F.lit(False))).otherwise(False)


def is_float(value: Column, kind: Column | None = None) -> Column:
    """Text of a real number, including nan, inf and exponents."""
    pattern = r"(?i)^\s*[+-]?(?:(?:\d+(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?(?:e[+-]?\d+(?:_\d+)*)?|\.\d+(?:_\d+)*(?:e[+-]?\d+(?:_\d+)*)?|nan|inf|infinity)\s*$"
    textual = F.coalesce(F.rlike(value, F.lit(pattern)), F.lit(False))
    if kind is None:
        return textual
    return F.when(kind.isin("num", "bool"), True).when(kind == "str", textual).otherwise(False)


def is_ip(value: Column) -> Column:
    """IPv4 or IPv6 text, surrounding blanks allowed, leading zeros in IPv4 octets not."""
    return F.coalesce(F.rlike(F.trim(value), F.lit(IP_PATTERN)), F.lit(False))


def dateutil_accepts(text: str) -> bool:
    """Whether dateutil reads the text. Missing parts come from a leap year, not from today, so that
    ``Feb 29 10:00:00`` counts as a date in every year and reruns agree."""
    from datetime import datetime

    from dateutil import parser

    try:
        parser.parse(text, default=datetime(2000, 1, 1))
        return True
    except Exception:  # any parse failure means "not a date"
        return False


def _dateutil_ok(values: pd.Series) -> pd.Series:
    return values.map(lambda text: text is not None and dateutil_accepts(text)).astype(bool)


def is_datetime(value: Column, mode: str = "native") -> Column:
    """Full dates, date-times and syslog times without a year natively; ``mode='exact'`` asks
    dateutil, in Arrow batches, about the texts the native shapes do not cover."""
    native = parse_wall_clock(value).isNotNull() | is_yearless_time(value)
    if mode == "native":
        return native
    return native | F.coalesce(F.pandas_udf(_dateutil_ok, "boolean")(F.when(~native, value)), F.lit(False))


def is_boolean(value: Column) -> Column:
    return F.coalesce(F.lower(value).isin(BOOLEAN_WORDS), F.lit(False))


def check_type(value: Column, kind: Column, type_name: str, datetime_mode: str = "native") -> Column:
    """Predicate for a constraint name; unknown names always pass."""
    name = type_name.lower()
    if name in ("int", "integer"):
        return is_int(value, kind)
    if name == "float":
        return is_float(value, kind)
    if name == "ip":
        return is_ip(value)
    if name == "datetime":
        return is_datetime(value, datetime_mode)
    if name == "boolean":
        return is_boolean(value)
    return F.lit(True)


KNOWN_TYPES = ("int", "integer", "float", "ip", "datetime", "boolean")
