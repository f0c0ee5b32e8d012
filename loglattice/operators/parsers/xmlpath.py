"""XML lines: element text and attributes by path.

The native ``xpath`` functions fail the whole query on one malformed line, so lines are read
with ElementTree in Arrow batches; only the lines that need it are sent to Python.
"""

from __future__ import annotations

from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loglattice.functions.text import _UNI_SPACE
from loglattice.operators.parsers.registry import Parser, found, last_first, register_parser, value_at

# Messages.
BAD_XML = "Failed to parse XML: "
NOT_XML = BAD_XML + "syntax error: line 1, column 0"

SCHEMA = "error string, root string, pairs array<struct<k:string,v:string>>"


def flatten(root) -> list[dict]:
    """Path/text and path/@attribute pairs in document order."""
    pairs: list[dict] = []
    stack = [(root, root.tag)]
    while stack:
        element, path = stack.pop()
        pairs.extend({"k": f"{path}/@{name}", "v": value} for name, value in element.attrib.items())
        text = (element.text or "").strip()
        if text:
            pairs.append({"k": path, "v": text})
        stack.extend((child, f"{path}/{child.tag}") for child in reversed(element))
    return pairs


_TYPE = pa.struct([("error", pa.string()), ("root", pa.string()), ("pairs", pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())])))])


def _read(texts: pa.Array) -> pa.Array:
    def one(text):
        if text is None:
            return None
        try:
            root = ElementTree.fromstring(text)
        except ElementTree.ParseError as exc:
            return {"error": f"{BAD_XML}{exc}"}
        return {"root": root.tag, "pairs": flatten(root)}

    # Most batches hold no XML at all.
    return pa.nulls(len(texts), _TYPE) if texts.null_count == len(texts) else pa.array([one(text) for text in texts.to_pylist()], _TYPE)


def xml_pairs(raw: Column) -> Column:
    """Lines whose first character cannot start a document get the reader's own error without Python."""
    hopeless = F.rlike(raw, F.lit(rf"^[^<{_UNI_SPACE}\ufeff]"))
    read = F.arrow_udf(_read, SCHEMA)(F.when(~hopeless, raw))
    error = F.when(hopeless, NOT_XML).otherwise(read["error"])
    return F.struct(error.alias("error"), read["root"].alias("root"), read["pairs"].alias("pairs"))


def _value(prepared: Column, rule, key: str) -> Column:
    keys, values = prepared["keys"], prepared["values"]
    below_root = value_at(keys, values, F.concat(prepared["root"], F.lit("/" + key)))
    return found(F.coalesce(value_at(keys, values, F.lit(key)), below_root))


register_parser(
    "xml", Parser(
        lambda raw, rule: xml_pairs(raw), lambda prepared, rule: prepared["error"], _value, lambda rule: "xml",
        lambda prepared: F.struct(prepared["error"].alias("error"), prepared["root"].alias("root"), *last_first(prepared["pairs"])),
    )
)
