"""CEF lines: seven header fields, then key=value extensions whose values may hold blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglattice.operators.parsers.registry import let, outcome, pair, pair_parser, register_parser, split_once

# Header names, the unescaped pipe, the extension pattern, messages.
HEADER = ["cef_version", "device_vendor", "device_product", "device_version", "device_event_class_id", "name", "severity"]
PIPE = r"(?<!\\)\|"
EXTENSION = r"([a-zA-Z0-9]+)=((?:[^=](?!\s+[a-zA-Z0-9]+=))*[^=\s])"
NOT_CEF = "Event does not start with CEF:"
TOO_SHORT = "Invalid CEF format, expected at least 8 pipe-separated fields, got "


def header_pairs(parts: Column, names: list[str], prefix: str) -> Column:
    first = pair(F.lit(names[0]), F.replace(F.get(parts, F.lit(0)), F.lit(prefix), F.lit("")))
    rest = [
        pair(F.lit(name), F.replace(F.get(parts, F.lit(i)), F.lit("\\|"), F.lit("|")))
        for i, name in enumerate(names[1:], start=1)
    ]
    return F.array(first, *rest)


def extension_pairs(text: Column) -> Column:
    """One regex pass finds whole key=value stretches; the key holds no '=' so the first one splits."""

    def one(match):
        key, value = split_once(match, "=")
        return pair(key, F.replace(F.replace(value, F.lit("\\="), F.lit("=")), F.lit("\\\\"), F.lit("\\")))

    return F.transform(F.regexp_extract_all(text, F.lit(EXTENSION), F.lit(0)), one)


def cef_pairs(raw: Column) -> Column:
    def from_parts(parts):
        tail = F.array_join(F.slice(parts, 8, F.greatest(F.size(parts) - 7, F.lit(0))), "|")
        pairs = F.concat(header_pairs(parts, HEADER, "CEF:"), extension_pairs(tail))
        size = F.size(parts)
        error = (
            F.when(~F.startswith(raw, F.lit("CEF:")), F.lit(NOT_CEF))
            .when(size < 8, F.concat(F.lit(TOO_SHORT), size.cast("string")))
        )
        return outcome(error, F.when(error.isNull(), pairs))

    return let(F.split(raw, PIPE), from_parts)


register_parser("cef", pair_parser(lambda raw, rule: cef_pairs(raw), lambda rule: "cef"))
