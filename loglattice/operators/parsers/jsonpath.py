"""JSON lines: one VARIANT per line, one typed lookup per mapped path."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loglattice.operators.parsers.registry import Parser, absent, register_parser

# Messages.
NOT_JSON = "Event is not valid JSON"
BAD_PATH = "Unsupported JSON path: "

# Steps that one VARIANT lookup can follow: names, quoted names and array positions.
_SIMPLE = re.compile(r"""^\$(?:\.[^.\[\]*'"?@()]+|\[\d+\]|\['[^']*'\]|\["[^"]*"\])*$""")
_STEP = re.compile(
    r"""\.\.(?P<deep>[^.,:\[\]'"?@()]+)|\.(?P<name>[^.,:\[\]'"?@()]+)|\[(?P<star>\*)\]|\[(?P<indexes>-?\d+(?:\s*,\s*-?\d+)*)\]"""
    r"""|\[(?P<slice>(?:-?\d+)?:(?:-?\d+)?(?::[1-9]\d*)?)\]|\[(?P<quoted>'[^']*'(?:\s*,\s*'[^']*')*|"[^"]*"(?:\s*,\s*"[^"]*")*)\]"""
)


def full_path(path: str) -> str:
    return path if path.startswith("$") else "$." + path


def steps_of(path: str) -> list[re.Match] | None:
    """Steps of a path; null where a part of it is none that is known."""
    text, at, steps = full_path(path)[1:], 0, []
    while at < len(text):
        step = _STEP.match(text, at)
        if step is None:
            return None
        steps.append(step)
        at = step.end()
    return steps


def is_simple(path: str) -> bool:
    return bool(_SIMPLE.match(full_path(path)))


def _children(node):
    return list(node.values()) if isinstance(node, dict) else list(node) if isinstance(node, list) else []


def _descend(node, name):
    """Matches of ``name`` at any depth, outermost first."""
    if isinstance(node, dict) and (name == "*" or name in node):
        yield from node.values() if name == "*" else [node[name]]
    for child in _children(node):
        yield from _descend(child, name)


def find_first(document, path: str):
    """(found, value) of the first match of a path with wildcards, descendants, unions or slices."""
    nodes = [document]
    for step in steps_of(path) or []:
        if step["deep"]:
            nodes = [hit for node in nodes for hit in _descend(node, step["deep"])]
        elif step["star"] or step["name"] == "*":
            nodes = [child for node in nodes for child in _children(node)]
        elif step["indexes"]:
            wanted = [int(text) for text in step["indexes"].split(",")]
            nodes = [node[at] for node in nodes if isinstance(node, list) for at in wanted if -len(node) <= at < len(node)]
        elif step["slice"]:
            cut = slice(*[int(text) if text else None for text in step["slice"].split(":")])
            nodes = [child for node in nodes if isinstance(node, list) for child in node[cut]]
        else:
            names = [step["name"]] if step["name"] else [token[1:-1] for token in re.findall(r"'[^']*'|\"[^\"]*\"", step["quoted"])]
            nodes = [node[name] for node in nodes if isinstance(node, dict) for name in names if name in node]
    return (True, nodes[0]) if nodes else (False, None)


def wildcard_hits(raw: Column, paths: list[str]) -> Column:
    """First hit of each wildcard path as JSON text (null when absent), in one Arrow pass."""

    def hits(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: first_hits(text, paths))

    return F.pandas_udf(hits, "array<string>")(raw)


def first_hits(text: str | None, paths: list[str]) -> list[str | None] | None:
    """JSON text of each path's first hit in a document; null for no JSON."""
    try:
        document = json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return None
    results = (find_first(document, path) for path in paths)
    return [json.dumps(value) if ok else None for ok, value in results]


def _complex_paths(rule) -> list[str]:
    paths = rule.parser_definition.get("paths", {})
    return sorted({p for p in paths.values() if p and not is_simple(p) and steps_of(p) is not None})


def _error(prepared: Column, rule) -> Column:
    """A path that cannot be read fails every event of its rule; lines that are no JSON fail as such."""
    unknown = sorted({p for p in rule.parser_definition.get("paths", {}).values() if p and not is_simple(p) and steps_of(p) is None})
    return F.lit(BAD_PATH + unknown[0]) if unknown else F.when(prepared["doc"].isNull(), F.lit(NOT_JSON))


def _prepare(raw: Column, rule) -> Column:
    document = F.try_parse_json(raw)
    wild = _complex_paths(rule)
    hits = wildcard_hits(raw, wild) if wild else F.lit(None).cast("array<string>")
    return F.struct(document.alias("doc"), hits.alias("hits"))


def kind_of(value: Column) -> Column:
    """JSON kind of a VARIANT value: str, num, bool, null or json (object or array)."""
    schema = F.schema_of_variant(value)
    return (
        F.when(schema.isin("STRING"), "str")
        .when(schema == "BOOLEAN", "bool")
        .when(schema == "VOID", "null")
        .when(F.rlike(schema, F.lit("^(OBJECT|ARRAY)")), "json")
        .otherwise("num")
    )


def variant_field(value: Column) -> Column:
    """struct<value, kind, present> of a VARIANT; JSON null is present with a null value."""
    text = F.variant_get(value, "$", "string")
    present = value.isNotNull()
    return F.struct(
        F.when(present, text).alias("value"),
        F.when(present, kind_of(value)).otherwise("str").alias("kind"),
        present.alias("present"),
    )


def _value(prepared: Column, rule, key: str) -> Column:
    path = rule.parser_definition.get("paths", {}).get(key)
    if not path:
        return absent()
    if is_simple(path):
        return variant_field(F.try_variant_get(prepared["doc"], full_path(path), "variant"))
    if steps_of(path) is None:
        return absent()
    slot = _complex_paths(rule).index(path)
    return variant_field(F.try_parse_json(F.get(prepared["hits"], F.lit(slot))))


register_parser(
    "jsonpath",
    Parser(
        _prepare,
        _error,
        _value,
        lambda rule: "json" + repr(_complex_paths(rule)),
    ),
)
