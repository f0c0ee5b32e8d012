"""Identifiers, digests and vault addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGEST_PREFIX = "sha256:"
VAULT_SCHEME = "vault://"

# Base-32 digits as conv() writes them and as a ULID writes them.
_CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_ULID_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _base32(number_text: Column, from_base: int, width: int) -> Column:
    return F.translate(F.lpad(F.conv(number_text, from_base, 32), width, "0"), _CONV_DIGITS, _ULID_DIGITS)


def assign_trace_id(received_at: Column, *identity: Column) -> Column:
    """ULID-shaped id: 48-bit time, then 80 bits of a digest over the event's identity.

    Deterministic, so a retried task writes the same id again.
    """
    millis = F.unix_millis(received_at.cast("timestamp"))
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in identity]
    entropy = F.sha2(F.concat_ws("␟", *parts), 256)
    return F.concat(
        _base32(millis.cast("string"), 10, 10),
        _base32(F.substring(entropy, 1, 10), 16, 8),
        _base32(F.substring(entropy, 11, 10), 16, 8),
    )


def digest(payload: Column) -> Column:
    return F.concat(F.lit(DIGEST_PREFIX), F.sha2(payload, 256))


def byte_length(payload: Column) -> Column:
    return F.octet_length(payload).cast("long")


def storage_uri(source_id: Column, received_at: Column, trace_id: Column) -> Column:
    day = F.date_format(received_at, "yyyy-MM-dd")
    return F.concat(F.lit(VAULT_SCHEME), source_id, F.lit("/"), day, F.lit("/"), trace_id, F.lit(".raw"))


def parse_vault_uri(uri: Column) -> Column:
    """Struct of source_id, received_date, trace_id; null for anything but a three-part address."""
    parts = F.split(F.regexp_replace(uri, "vault://", ""), "/")
    good = F.startswith(uri, F.lit(VAULT_SCHEME)) & (F.size(parts) >= 3)
    return F.when(
        good,
        F.struct(
            F.get(parts, F.lit(0)).alias("source_id"),
            F.get(parts, F.lit(1)).alias("received_date"),
            F.regexp_replace(F.get(parts, F.lit(2)), r"\.raw", "").alias("trace_id"),
        ),
    )


def digest_verified(payload: Column, stored: Column) -> Column:
    """True when the recomputed digest equals the stored one."""
    return F.coalesce(digest(payload) == stored, F.lit(False))


def event_id_for(trace_id: Column, path: str) -> Column:
    """Deterministic id of an outcome row, in the usual 8-4-4-4-12 form."""
    h = F.sha2(F.concat(trace_id, F.lit("|" + path)), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts])
