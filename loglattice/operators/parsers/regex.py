"""Regex lines: named or numbered groups of the first match, all groups read in one pass."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from loglattice.operators.parsers.registry import Parser, absent, found, register_parser
from loglattice.operators.regexsafety import MAX_LOOPS, chained_loops

# Messages.
NO_MATCH = "Regex did not match the event"
NO_PATTERN = "Regex parser requires a 'pattern' definition"
BAD_PATTERN = "Invalid regex pattern: "

_MARK = "\ufdd0"


@lru_cache(maxsize=512)
def java_pattern(pattern: str) -> tuple[str, dict[str, int], int, frozenset[int]]:
    """Rewrite a pattern for the JVM: (pattern, name -> group number, groups, optional groups).

    Named groups become numbered ones because the JVM knows neither ``(?P<`` nor ``_`` in names;
    ``[`` inside a class is escaped because the JVM would open a nested class, and a brace that
    counts nothing because the JVM takes it for a repetition.
    """
    compiled = re.compile(pattern)
    out: list[str] = []
    frames: list[dict] = [{"own": None, "groups": [], "alternatives": False}]
    optional: set[int] = set()
    count, i, n = 0, 0, len(pattern)
    while i < n:
        ch = pattern[i]
        if ch == "\\" and i + 1 < n:
            out.append(r"\z" if pattern[i + 1] == "Z" else pattern[i : i + 2])
            i += 2
        elif ch == "[":
            end = _class_end(pattern, i)
            body = pattern[i + 1 : end]
            out.append("[" + re.sub(r"\\.|\[|&&", lambda m: m[0] if m[0][0] == "\\" else "\\" + m[0], body, flags=re.S) + "]")
            i = end + 1
        elif ch == "(":
            reference = re.compile(r"\(\?P=(\w+)\)").match(pattern, i)
            named = re.compile(r"\(\?P<(\w+)>").match(pattern, i)
            if reference:
                out.append("\\" + str(compiled.groupindex[reference[1]]))
                i = reference.end()
                continue
            own = None
            if named or not pattern.startswith("(?", i):
                count += 1
                own = count
            out.append("(")
            i = named.end() if named else i + 1
            frames.append({"own": own, "groups": [], "alternatives": False})
        elif ch == ")":
            frame = frames.pop()
            inside = frame["groups"]
            if frame["alternatives"]:
                optional.update(inside)
            if frame["own"] is not None:
                inside = [*inside, frame["own"]]
            if re.compile(r"\)(?:[?*]|\{0?,|\{0\})").match(pattern, i):
                optional.update(inside)
            frames[-1]["groups"].extend(inside)
            out.append(ch)
            i += 1
        elif ch == "{":
            times = re.compile(r"\{(\d*)(,?)(\d*)\}").match(pattern, i)
            if times and times[1] + times[3]:
                # The JVM wants a lower bound.
                out.append("{" + (times[1] or "0") + times[2] + times[3] + "}")
                i = times.end()
            else:
                out.append("\\{")
                i += 1
        else:
            if ch == "|":
                frames[-1]["alternatives"] = True
            out.append(ch)
            i += 1
    if frames[0]["alternatives"]:
        optional.update(frames[0]["groups"])
    return "".join(out), dict(compiled.groupindex), compiled.groups, frozenset(optional)


def _class_end(pattern: str, start: int) -> int:
    """Index of the bracket that closes the class opened at ``start``."""
    i = start + 1
    if pattern.startswith("^", i):
        i += 1
    if pattern.startswith("]", i):
        i += 1
    while pattern[i] != "]":
        i += 2 if pattern[i] == "\\" else 1
    return i


def whole_line(pattern: str) -> tuple[str, str]:
    """Pattern of a whole line around the first match, and what replaces it: the groups behind marks."""
    body, _, groups, _ = java_pattern(pattern)
    return rf"(?d)\A(?s:.*?)(?:{body})(?s:.*)\z", _MARK + _MARK.join(f"${g}" for g in range(1, groups + 1))


def regex_groups(raw: Column, pattern: str) -> Column:
    """All groups of the first match as an array (index 0 is a marker slot); null when nothing matches.

    The whole line is replaced by its groups in one matching pass. A line that itself holds the
    marker is read group by group instead.
    """
    body, _, groups, _ = java_pattern(pattern)
    whole, template = whole_line(pattern)
    fast = F.regexp_replace(raw, whole, template)
    slow = F.when(
        F.rlike(raw, F.lit("(?d)" + body)),
        F.array(F.lit(""), *[F.regexp_extract(raw, "(?d)" + body, g) for g in range(1, groups + 1)]),
    )
    return F.when(F.contains(raw, F.lit(_MARK)), slow).otherwise(
        F.when(F.rlike(fast, F.lit("^" + _MARK)), F.split(fast, _MARK))
    )


def linear_pattern(pattern: str) -> str:
    """The pattern for an automaton-based matcher: all groups named by number, the whole match as ``g0``."""
    token = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?|.", re.S)
    number = 0
    out = []
    for part in token.findall(java_pattern(pattern)[0]):
        if part == "(":
            number += 1
            part = f"(?P<g{number}>"
        out.append(part)
    return f"(?P<g0>{''.join(out)})"


def linear_refusal(pattern: str) -> str:
    """Why the automaton-based matcher cannot take the pattern; empty text if it can."""
    try:
        pc.extract_regex(pa.array([""]), linear_pattern(pattern))
    except (pa.ArrowInvalid, re.error) as exc:
        return str(exc).splitlines()[0]
    return ""


def linear_groups(raw: Column, pattern: str) -> Column:
    """As :func:`regex_groups`, in time proportional to the line whatever the pattern (Arrow's matcher does not backtrack).

    Classes like ``\\d`` are ASCII in both; ``$`` stands at the very end only.
    """
    body, groups = linear_pattern(pattern), java_pattern(pattern)[2]

    def match(lines: pa.Array) -> pa.Array:
        found = pc.extract_regex(lines, body)
        columns = [pa.array([""] * len(lines)), *[pc.struct_field(found, f"g{g}") for g in range(1, groups + 1)]]
        cells = [column.cast(pa.string()).to_pylist() for column in columns]
        return pa.array([list(row) if hit else None for row, hit in zip(zip(*cells), found.is_valid().to_pylist())], pa.list_(pa.string()))

    return F.arrow_udf(match, "array<string>")(raw)


def _broken(rule) -> str | None:
    pattern = rule.parser_definition.get("pattern")
    if not pattern:
        return NO_PATTERN
    try:
        java_pattern(pattern)
    except re.error as exc:
        return f"{BAD_PATTERN}{exc}"
    return None


def _prepare(raw: Column, rule) -> Column:
    if _broken(rule):
        return F.lit(None).cast("array<string>")
    pattern = rule.parser_definition["pattern"]
    if chained_loops(pattern) > MAX_LOOPS:
        return linear_groups(raw, pattern)
    return regex_groups(raw, pattern)


def _error(prepared: Column, rule) -> Column:
    broken = _broken(rule)
    return F.lit(broken) if broken else F.when(prepared.isNull(), F.lit(NO_MATCH))


def group_of(pattern: str, key: str) -> tuple[int | None, bool | None]:
    """Number of the group that a source key names, and whether it may be left out; nulls for none."""
    _, names, groups, optional = java_pattern(pattern)
    number = names.get(key)
    if number is None and key.startswith("capture_"):
        digits = key.split("_")[1]
        number = int(digits) if re.fullmatch(r"\s*[+-]?\d+(?:_\d+)*\s*", digits) else None
    if number is None or not 1 <= number <= groups:
        return None, None
    return number, number in optional


def _value(prepared: Column, rule, key: str) -> Column:
    if _broken(rule):
        return absent()
    number, optional = group_of(rule.parser_definition["pattern"], key)
    if number is None:
        return absent()
    text = F.get(prepared, F.lit(number))
    if optional:
        return found(F.nullif(text, F.lit("")), present=prepared.isNotNull())
    return found(text)


register_parser(
    "regex", Parser(_prepare, _error, _value, lambda rule: "regex" + repr(rule.parser_definition.get("pattern")))
)
