"""LEEF lines: five header fields, then delimited key=value extensions (version 2.0 names the delimiter)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglattice.operators.parsers.cef import PIPE, header_pairs
from loglattice.operators.parsers.registry import let, outcome, pair_parser, pairs_of, register_parser, strip

# Header names, delimiter aliases, messages.
HEADER = ["leef_version", "device_vendor", "device_product", "device_version", "device_event_class_id"]
TAB_ALIASES = ["x09", "\\t"]
SPACE_ALIASES = ["x20", "\\s"]
NOT_LEEF = "Event does not start with LEEF:"
TOO_SHORT = "Invalid LEEF format, expected at least 5 pipe-separated fields, got "


def split_literal(text: Column, delimiter: Column) -> Column:
    """Split on a literal taken from a column, which may hold an end-of-quote mark itself."""
    quoted = F.replace(delimiter, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.split(text, F.concat(F.lit("\\Q"), quoted, F.lit("\\E")))


def leef_pairs(raw: Column) -> Column:
    def from_parts(parts):
        size = F.size(parts)
        second = (F.replace(F.get(parts, F.lit(0)), F.lit("LEEF:"), F.lit("")) == "2.0") & (size > 5)
        named = F.get(parts, F.lit(5))
        delimiter = (
            F.when(~second | (named == "") | named.isin(TAB_ALIASES), F.lit("\t"))
            .when(named.isin(SPACE_ALIASES), F.lit(" "))
            .otherwise(named)
        )
        extension = F.when(second, F.get(parts, F.lit(6))).otherwise(F.get(parts, F.lit(5)))
        extra = F.coalesce(
            pairs_of(split_literal(extension, delimiter), "=", strip, strip), F.expr("array()").cast("array<struct<k:string,v:string>>")
        )
        error = (
            F.when(~F.startswith(raw, F.lit("LEEF:")), F.lit(NOT_LEEF))
            .when(size < 5, F.concat(F.lit(TOO_SHORT), size.cast("string")))
        )
        return outcome(error, F.when(error.isNull(), F.concat(header_pairs(parts, HEADER, "LEEF:"), extra)))

    return let(F.split(raw, PIPE, 7), from_parts)


register_parser("leef", pair_parser(lambda raw, rule: leef_pairs(raw), lambda rule: "leef"))
