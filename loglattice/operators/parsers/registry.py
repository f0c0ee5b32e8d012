"""Parser registry: a parser is three column builders, looked up by type name.

* ``prepare(raw, rule)``  one Column per line, computed once (pairs, variant, regex groups ...)
* ``finish(prepared)``  optional: the form in which the others read it, a step of its own
* ``error(prepared, rule)``  error text, null when the line parses
* ``value(prepared, rule, key)``  struct<value, kind, present> of one source key

Rules whose ``share_key`` is equal share one prepared column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglattice.functions.text import STRIP_CHARS
from loglattice.operators.rules import Rule


@dataclass(frozen=True)
class Parser:
    prepare: Callable[[Column, Rule], Column]
    error: Callable[[Column, Rule], Column]
    value: Callable[[Column, Rule, str], Column]
    share_key: Callable[[Rule], str]
    finish: Callable[[Column], Column] | None = None


_PARSERS: dict[str, Parser] = {}


def register_parser(name: str, parser: Parser) -> None:
    """Extension point: make a parser type available to rules under ``name``."""
    _PARSERS[name.lower()] = parser


def parser_for(rule: Rule) -> Parser:
    """Parser of a rule. A defect or an unknown type is an error of that rule's events, not of the batch."""
    known = _PARSERS.get(rule.parser_type.lower())
    if rule.defect or known is None:
        return _refusing(rule.defect or f"Unsupported parser type: {rule.parser_type}")
    return known


def _refusing(reason: str) -> Parser:
    return Parser(
        prepare=lambda raw, rule: F.lit(None).cast("string"),
        error=lambda prepared, rule: F.lit(reason),
        value=lambda prepared, rule, key: absent(),
        share_key=lambda rule: "refused",
    )


# --- shared column helpers --------------------------------------------------

def strip(text: Column, chars: str = STRIP_CHARS) -> Column:
    return F.trim(text, F.lit(chars))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an intermediate result so that it is evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pair(key: Column, value: Column) -> Column:
    return F.struct(key.alias("k"), value.alias("v"))


def split_once(text: Column, separator: str) -> tuple[Column, Column]:
    """Parts before and after the first separator; the text is known to contain it."""
    key = F.substring_index(text, separator, 1)
    return key, F.substr(text, F.char_length(key) + F.lit(len(separator) + 1))


def pairs_of(tokens: Column, separator: str, key_fn=lambda k: k, value_fn=lambda v: v) -> Column:
    """Tokens holding the separator as key/value pairs."""

    def one(token):
        key, value = split_once(token, separator)
        return pair(key_fn(key), value_fn(value))

    return F.transform(F.filter(tokens, lambda t: F.contains(t, F.lit(separator))), one)


def last_value(pairs: Column, key: Column) -> Column:
    """Value of the last pair with the key, null when there is none."""
    return F.try_element_at(F.filter(pairs, lambda p: p["k"] == key), F.lit(-1))["v"]


def found(value: Column, kind: Column | None = None, present: Column | None = None) -> Column:
    return F.struct(
        value.alias("value"),
        (F.lit("str") if kind is None else kind).alias("kind"),
        (value.isNotNull() if present is None else present).alias("present"),
    )


ABSENT_SQL = "named_struct('value', cast(null as string), 'kind', 'str', 'present', false)"


def absent() -> Column:
    return F.expr(ABSENT_SQL)


def last_first(pairs: Column) -> list[Column]:
    """Keys and values of pairs, the last first: of equal keys the first that a native search meets is the one that counts."""
    return [F.reverse(F.transform(pairs, lambda p: p[name])).alias(alias) for name, alias in (("k", "keys"), ("v", "values"))]


def value_at(keys: Column, values: Column, key: Column) -> Column:
    """Value of a key in :func:`last_first`, null when there is none.

    The lambda keeps the step out of whole-stage code, whose one method for all rules would be too long to be compiled.
    """
    return let((F.array_position(keys, key) - 1).cast("int"), lambda at: F.get(values, at))


def pair_parser(prepare: Callable[[Column, Rule], Column], share_key: Callable[[Rule], str]) -> Parser:
    """Parser whose prepared column is struct<error, pairs>, read as struct<error, keys, values>."""
    return Parser(
        prepare=prepare,
        error=lambda prepared, rule: prepared["error"],
        value=lambda prepared, rule, key: found(value_at(prepared["keys"], prepared["values"], F.lit(key))),
        share_key=share_key,
        finish=lambda prepared: F.struct(prepared["error"].alias("error"), *last_first(prepared["pairs"])),
    )


def outcome(error: Column | None, pairs: Column) -> Column:
    err = F.lit(None).cast("string") if error is None else error
    return F.struct(err.alias("error"), pairs.alias("pairs"))
