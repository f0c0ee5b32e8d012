"""Secret redaction for samples that leave the pipeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three secret patterns and their replacements, applied in this order.
AUTH_HEADER = (r"(?i)(Authorization:\s*(?:Bearer\s+|Basic\s+)?)([a-zA-Z0-9\-\._~+/]+=*)", "$1[REDACTED]")
PASSWORD = (r"(?i)(password|passwd|pwd)\s*(=|:)\s*([^\s,;]+)", "$1$2[REDACTED]")
AWS_KEY = (r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])", "[AWS_ACCESS_KEY_REDACTED]")

# Opt-in additions of the strict mode: quoted values and JSON members.
STRICT_JSON = (r'(?i)("(?:password|passwd|pwd)"\s*:\s*)"[^"\\]*+(?:\\.[^"\\]*+)*+"', '$1"[REDACTED]"')
STRICT_QUOTED = (r"""(?i)\b(password|passwd|pwd)\s*(=|:)\s*(?:"[^"]*"|'[^']*')""", "$1$2[REDACTED]")


def _apply(text: Column, rule: tuple[str, str]) -> Column:
    pattern, replacement = rule
    return F.regexp_replace(text, F.lit(pattern), F.lit(replacement))


def redact_auth_header(text: Column) -> Column:
    return _apply(text, AUTH_HEADER)


def redact_password(text: Column) -> Column:
    return _apply(text, PASSWORD)


def redact_aws_key(text: Column) -> Column:
    return _apply(text, AWS_KEY)


def redact_secrets(text: Column, strict: bool = False) -> Column:
    """Authorization headers, then passwords, then cloud access keys."""
    if strict:
        text = _apply(_apply(text, STRICT_JSON), STRICT_QUOTED)
    return redact_aws_key(redact_password(redact_auth_header(text)))
