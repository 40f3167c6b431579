"""HMAC-SHA256 out of native hash functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def hmac_sha256(secret: str, message: Column) -> Column:
    """Hex HMAC-SHA256 of ``message``: H(outer key || H(inner key || message))."""
    key = secret.encode("utf-8")
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    inner_key = bytes(b ^ 0x36 for b in key)
    outer_key = bytes(b ^ 0x5C for b in key)
    inner = F.sha2(F.concat(F.lit(inner_key), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer_key), F.unhex(inner)), 256)
