"""Structural form of JSON documents (unbounded recursion, hence an Arrow batch function)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INVALID_JSON = "<INVALID_JSON>"
# Tags that a batch remembers, of strings up to this length.
KNOWN_TAGS, KNOWN_CHARS = 4096, 64
_ONES = bytes.maketrans(b"023456789", b"1" * 9)


def string_tags() -> Callable[[str], str]:
    """Gives the tag of the first token class that matches all of a string, else STR.

    The classes treat digits alike, but for the 0 of 0x, so strings that differ in digits only are matched once.
    """
    from loglattice.functions.text import TOKEN_CLASSES

    classes = [(f"<{name}>", re.compile(pattern)) for name, pattern in TOKEN_CLASSES]

    def tag(value: str) -> str:
        return next((tag for tag, pattern in classes if pattern.fullmatch(value)), "<STR>")

    @lru_cache(KNOWN_TAGS)
    def known(shape: bytes) -> str:
        return tag(shape.decode("utf-8", "surrogatepass"))

    def tag_of(value: str) -> str:
        if len(value) > KNOWN_CHARS or "0x" in value:
            return tag(value)
        return known(value.encode("utf-8", "surrogatepass").translate(_ONES))

    return tag_of


def shape_of(value, tag_of: Callable[[str], str]) -> str:
    """Shape of one decoded JSON value: sorted keys, sorted distinct element shapes, scalar class."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{key}:{shape_of(value[key], tag_of)}" for key in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + "|".join(sorted({shape_of(item, tag_of) for item in value})) + "]"
    if value is None:
        return "<NULL>"
    if isinstance(value, bool):
        return "<BOOL>"
    if isinstance(value, (int, float)):
        return "<NUM>"
    return tag_of(value)


def json_structure(text: Column) -> Column:
    """Structure of JSON text; null stays null so callers can gate which rows are shipped."""
    def shapes(texts: pd.Series) -> pd.Series:
        tag_of = string_tags()

        def one(document):
            if document is None:
                return None
            try:
                return shape_of(json.loads(document), tag_of)
            except (ValueError, RecursionError):
                return INVALID_JSON

        return pd.Series([one(document) for document in texts], dtype=object)

    return F.pandas_udf(shapes, "string")(text)


def json_invalid(text: Column) -> Column:
    """True where brace-delimited text is not valid JSON."""
    return text.isNotNull() & F.try_parse_json(text).isNull()


def json_scalar_class(value: Column) -> Column:
    """Class of one JSON string scalar: the first token class that matches all of it, else STR."""
    from loglattice.functions.text import TOKEN_CLASSES, _unicode_form

    out = F
    for name, pattern in TOKEN_CLASSES:
        whole = "(?d)^(?:" + _unicode_form(pattern)[4:] + r")\z"
        out = out.when(F.rlike(value, F.lit(whole)), f"<{name}>")
    return F.when(value.isNull(), "<NULL>").otherwise(out.otherwise("<STR>"))
