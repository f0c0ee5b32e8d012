"""Action vocabulary and field masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Action synonyms.
ACTION_SYNONYMS = {
    "permit": "allow",
    "pass": "allow",
    "accept": "allow",
    "drop": "deny",
    "block": "deny",
    "reject": "deny",
}
MASKED = "***"

_BLOCK_BYTES = 64


def normalize_action(value: Column) -> Column:
    """Synonyms to allow/deny regardless of case; other values unchanged."""
    low = F.lower(value)
    out = F
    for word, target in ACTION_SYNONYMS.items():
        out = out.when(low == word, target)
    return out.otherwise(value)


def mask_hmac(value: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 built from two native SHA-256 calls; the pads come from the key."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > _BLOCK_BYTES else key).ljust(_BLOCK_BYTES, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in block))
    outer = F.lit(bytes(b ^ 0x5C for b in block))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def mask_value(value: Column, policy: str | None, key: bytes) -> Column:
    """Apply one masking policy: hash, mask, drop, or none."""
    if policy == "hash":
        return mask_hmac(value, key)
    if policy == "mask":
        return F.lit(MASKED)
    if policy == "drop":
        return F.lit(None).cast("string")
    return value
