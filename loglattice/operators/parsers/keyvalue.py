"""Key-value lines. Blank-separated ``k=v`` follows POSIX shell quoting; other delimiters are literal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglattice.operators.parsers.leef import split_literal
from loglattice.operators.parsers.registry import outcome, pair_parser, pairs_of, register_parser, strip

QUOTE_STRIP = " \"'"
_BLANKS = r" \t\r\n"
_DOUBLE = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'
_SINGLE = r"'[^']*+'"
_ESCAPE = r"\\[\s\S]"
_PLAIN = rf"[^{_BLANKS}\"'\\]+"
_GAP = rf"[{_BLANKS}]+"
_SEGMENT = f"{_GAP}|{_PLAIN}|{_DOUBLE}|{_SINGLE}|{_ESCAPE}"
# A Unicode noncharacter marks the token gaps while quoted blanks are put back in.
_MARK = "\ufdd0"


def quoting_balanced(raw: Column) -> Column:
    """True when every quote is closed and no escape dangles."""
    return F.regexp_replace(raw, _SEGMENT, "") == ""


def shell_tokens(raw: Column) -> Column:
    """Tokens of a line with balanced quoting: blanks split, quotes and escapes are resolved."""

    def resolve(segment):
        head = F.substring(segment, 1, 1)
        inner = F.substr(segment, F.lit(2), F.char_length(segment) - 2)
        return (
            F.when(F.rlike(head, F.lit(rf"[{_BLANKS}]")), F.lit(_MARK))
            .when(head == '"', F.regexp_replace(inner, r'\\(["\\])', "$1"))
            .when(head == "'", inner)
            .when(head == "\\", F.substr(segment, F.lit(2)))
            .otherwise(segment)
        )

    segments = F.regexp_extract_all(raw, F.lit(_SEGMENT), F.lit(0))
    quoted = F.split(F.array_join(F.transform(segments, resolve), ""), _MARK)
    return F.when(F.rlike(raw, F.lit(r"[\"'\\]")), quoted).otherwise(F.split(raw, _GAP))


def _double_quoted(raw: Column) -> Column:
    """Tokens of a line whose only quoting is balanced double quotes, which is most that quote at all; no empty token at the ends."""
    tokens = F.regexp_extract_all(raw, F.lit(rf'(?:[^{_BLANKS}"]++|"[^"]*+")++'), F.lit(0))
    return F.split(F.replace(F.array_join(tokens, _MARK), F.lit('"'), F.lit("")), _MARK)


def kv_quoted(raw: Column) -> Column:
    """Pairs under shell quoting; a line with unbalanced quotes falls back to a plain split."""
    double = F.contains(raw, F.lit('"'))
    other = F.contains(raw, F.lit("'")) | F.contains(raw, F.lit("\\"))
    even = (F.octet_length(raw) - F.octet_length(F.replace(raw, F.lit('"'), F.lit("")))) % 2 == 0
    tokens = (
        F.when(~double & ~other, F.split(raw, _GAP)).when(~other & even, _double_quoted(raw))
        .when(other & quoting_balanced(raw), shell_tokens(raw))
    )
    # Without tokens the quotes do not match.
    return F.when(tokens.isNotNull(), pairs_of(tokens, "=")).otherwise(kv_delimited(raw, " ", "="))


def kv_delimited(raw: Column, delimiter: str, separator: str) -> Column:
    """Pairs split on literal delimiters; keys trimmed, values stripped of quotes and blanks."""
    return pairs_of(split_literal(raw, F.lit(delimiter)), separator, strip, lambda v: strip(v, QUOTE_STRIP))


def _settings(rule) -> tuple[str, str]:
    return rule.parser_definition.get("delimiter", " "), rule.parser_definition.get("kv_separator", "=")


def _prepare(raw: Column, rule) -> Column:
    delimiter, separator = _settings(rule)
    pairs = kv_quoted(raw) if (delimiter, separator) == (" ", "=") else kv_delimited(raw, delimiter, separator)
    return outcome(None, pairs)


_parser = pair_parser(_prepare, lambda rule: "kv" + repr(_settings(rule)))
register_parser("keyvalue", _parser)
register_parser("kv", _parser)
