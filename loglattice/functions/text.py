"""Structural fingerprints of text lines and payload text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglattice.functions.jsonshape import json_structure
from loglattice.functions.lineshape import line_structures

# ---------------------------------------------------------------------------
# The token classes, in the order in which they are replaced.
# \b, \d and \s are ASCII here; `_unicode_form` widens them for non-ASCII lines.
# ---------------------------------------------------------------------------
TOKEN_CLASSES = [
    ("IP", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b|\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b"),
    ("TIME", r"\b\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b"
             r"|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\b"),
    ("NUM", r"\b\d+\b"),
    ("HEX", r"\b(?:0x)?[a-fA-F0-9]{8,}\b"),
    ("UUID", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    ("MAC", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}(?:[0-9A-Fa-f]{2})\b"),
    ("URL", r"\bhttps?://[^\s/$.?#].[^\s]*\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
]
WORD_PATTERN = r"\b[a-zA-Z_][a-zA-Z0-9_]*\b"
# ---------------------------------------------------------------------------

_PATTERN_OF = dict(TOKEN_CLASSES)

# White space and word characters as a Unicode-aware matcher sees them.
_ASCII_SPACE = r"\t-\r\x1c-\x20"
_UNI_SPACE = _ASCII_SPACE + r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNI_WORD = r"[\p{L}\p{N}_]"
_UNI_EDGE = rf"(?:(?<={_UNI_WORD})(?!{_UNI_WORD})|(?<!{_UNI_WORD})(?={_UNI_WORD}))"


# What each alternative starts with. Looking ahead for it first spares the matcher the costly
# word-edge test at all other positions.
_STARTS = {
    "IP": ["[0-9]", "[A-Fa-f0-9]"],
    "TIME": [r"\d", "[JFMASOND]"],
    "NUM": [r"\d"],
    "HEX": ["[a-fA-F0-9]"],
    "UUID": ["[0-9a-fA-F]"],
    "MAC": ["[0-9A-Fa-f]"],
    "URL": ["h"],
    "EMAIL": ["[A-Za-z0-9._%+-]++@"],
}


def _guarded(name: str, pattern: str) -> str:
    """The same pattern with a short look-ahead before each alternative."""
    starts = _STARTS.get(name, ["[a-zA-Z_]"])
    alternatives = pattern.removeprefix(r"\b").split(r"|\b")
    return "|".join(rf"(?={start})\b{alternative}" for start, alternative in zip(starts, alternatives, strict=True))


def _pinned(pattern: str) -> str:
    """The pattern for pure ASCII text, white space written out."""
    return pattern.replace(r"[^\s]", rf"[^{_ASCII_SPACE}]").replace(r"[^\s/", rf"[^{_ASCII_SPACE}/").replace(
        r"[T\s]", rf"[T{_ASCII_SPACE}]"
    ).replace(r"\s", rf"[{_ASCII_SPACE}]")


def _ascii_form(pattern: str) -> str:
    """The pattern for pure ASCII text; only white space and the dot need pinning down."""
    return "(?d)" + _pinned(pattern)


def _unicode_form(pattern: str) -> str:
    """The pattern with Unicode digits, white space and word edges."""
    wide = pattern.replace(r"[^\s]", rf"[^{_UNI_SPACE}]").replace(r"[^\s/", rf"[^{_UNI_SPACE}/")
    wide = wide.replace(r"[T\s]", rf"[T{_UNI_SPACE}]").replace(r"\s", rf"[{_UNI_SPACE}]")
    return "(?d)" + wide.replace(r"\d", r"\p{Nd}").replace(r"\b", _UNI_EDGE)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _replace(text: Column, name: str, pattern: str, form) -> Column:
    return F.regexp_replace(text, F.lit(form(_guarded(name, pattern))), F.lit(f"<{name}>"))


def mask_token(text: Column, name: str) -> Column:
    """Replace one token class (IP, TIME, NUM, HEX, UUID, MAC, URL, EMAIL, WORD) by its tag.

    ASCII lines take the cheap pattern, other lines the Unicode one.
    """
    pattern = _PATTERN_OF.get(name, WORD_PATTERN)
    return F.when(is_ascii(text), _replace(text, name, pattern, _ascii_form)).otherwise(_replace(text, name, pattern, _unicode_form))


def mask_ip(text: Column) -> Column:
    return mask_token(text, "IP")


def mask_time(text: Column) -> Column:
    return mask_token(text, "TIME")


def mask_num(text: Column) -> Column:
    return mask_token(text, "NUM")


def mask_hex(text: Column) -> Column:
    return mask_token(text, "HEX")


def mask_uuid(text: Column) -> Column:
    return mask_token(text, "UUID")


def mask_mac(text: Column) -> Column:
    return mask_token(text, "MAC")


def mask_url(text: Column) -> Column:
    return mask_token(text, "URL")


def mask_email(text: Column) -> Column:
    return mask_token(text, "EMAIL")


def mask_word(text: Column) -> Column:
    return mask_token(text, "WORD")


# White space at both ends of a line or field.
STRIP_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim_space(text: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.trim(text, F.lit(STRIP_CHARS))


def collapse_ws(text: Column) -> Column:
    """White-space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, rf"[{_UNI_SPACE}]+", " "))


def _arrow_masks() -> list[tuple[str, str]]:
    """Patterns and tags of all masks over ASCII text for the automaton-based matcher, white space last.

    The UUID mask is left out: its first group, eight hex digits between word edges, has always
    been replaced by the NUM or HEX mask before it could match.
    """
    masks = [(pattern, f"<{name}>") for name, pattern in TOKEN_CLASSES if name != "UUID"] + [(WORD_PATTERN, "<WORD>")]
    # Single blanks stay as they are, so only other runs are looked for.
    runs = rf"[\t-\r\x1c-\x1f][{_ASCII_SPACE}]*|\x20[{_ASCII_SPACE}]+"
    return [(_pinned(pattern), tag) for pattern, tag in masks] + [(runs, " ")]


def _masked(text: Column) -> Column:
    """All masks in order, with Unicode classes. The e-mail mask, the costliest, runs only on text that holds an ``@``."""
    out = text
    for name, pattern in TOKEN_CLASSES:
        if name == "EMAIL":
            gated = F.transform(
                F.array(out),
                lambda t: F.when(F.contains(t, F.lit("@")), _replace(t, "EMAIL", pattern, _unicode_form)).otherwise(t),  # noqa: B023
            )
            out = F.get(gated, F.lit(0))
        elif name != "UUID":
            out = _replace(out, name, pattern, _unicode_form)
    return collapse_ws(_replace(out, "WORD", WORD_PATTERN, _unicode_form))


def _plain(text: Column) -> Column:
    """Text for the matcher of ASCII texts; what cannot be decoded counts as not ASCII."""
    return is_ascii(text) & F.is_valid_utf8(text)


def _shaped(text: Column, lines: Column, with_json: bool, hashed: bool) -> Column:
    """Structures, or their digests, of ``lines`` in Arrow batches; where that is null, of the text on the JVM."""
    rest = _masked(text)
    return F.coalesce(line_structures(lines, _arrow_masks(), with_json, hashed), F.sha2(rest, 256) if hashed else rest)


def text_structure(text: Column, hashed: bool = False) -> Column:
    """All masks in order: ASCII texts in Arrow batches, others on the JVM; ``hashed`` gives the SHA-256 of the result."""
    return _shaped(text, F.when(_plain(text), text), False, hashed)


def typed_structure(text: Column) -> Column:
    """Variant that keeps the token classes apart: specific classes first, tags left alone."""
    out = text
    for name in ("URL", "EMAIL", "UUID", "MAC", "IP", "TIME", "NUM", "HEX"):
        out = F.regexp_replace(out, F.lit(_unicode_form(_PATTERN_OF[name])), F.lit(f"<{name}>"))
    words = r"(?<![<A-Za-z0-9_])" + _unicode_form(WORD_PATTERN)[4:] + r"(?!>)"
    return collapse_ws(F.regexp_replace(out, F.lit(words), F.lit("<WORD>")))


def is_json_like(text: Column) -> Column:
    """Trimmed text starts with an opening and ends with a closing brace; the end is trimmed only where the start is one."""
    spaces = F.lit(STRIP_CHARS)
    return F.startswith(F.ltrim(text, spaces), F.lit("{")) & F.endswith(F.rtrim(text, spaces), F.lit("}"))


def structure(text: Column, style: str = "parity", hashed: bool = False) -> Column:
    """Structural form of a line, or its SHA-256; brace-delimited and ASCII lines go through one Arrow function."""
    json_like = is_json_like(text)
    if style != "parity":
        typed = F.when(json_like, json_structure(F.when(json_like, trim_space(text)))).otherwise(typed_structure(text))
        return F.sha2(typed, 256) if hashed else typed
    return _shaped(text, F.when(json_like, trim_space(text)).when(_plain(text), text), True, hashed)


def _scoped(body: Column, vendor_token: Column | None) -> Column:
    if vendor_token is None:
        return body
    scope = F.substring(F.sha2(vendor_token, 256), 1, 8)
    return F.when(F.coalesce(vendor_token, F.lit("")) == "", body).otherwise(F.concat(scope, F.lit("::"), body))


def scoped_hash(structural: Column, vendor_token: Column | None = None) -> Column:
    """SHA-256 of the structure, prefixed by a short hash of the vendor token when there is one."""
    return _scoped(F.sha2(structural, 256), vendor_token)


def fingerprint(text: Column, vendor_token: Column | None = None, style: str = "parity") -> Column:
    """Fingerprint of any line. The token is the source id wherever events are processed."""
    return _scoped(structure(text, style, hashed=True), vendor_token)


def text_fingerprint(text: Column, vendor_token: Column | None = None) -> Column:
    """Fingerprint for data known to hold no JSON lines."""
    return _scoped(text_structure(text, hashed=True), vendor_token)


def decode_payload(payload: Column) -> Column:
    """Bytes to text; invalid UTF-8 sequences become U+FFFD."""
    return F.make_valid_utf8(payload.cast("string"))


def raw_as_json_or_text(text: Column) -> Column:
    """Raw text as canonical JSON when it parses as JSON, else the text itself."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)
