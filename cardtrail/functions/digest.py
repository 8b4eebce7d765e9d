"""Keyed card digest: HMAC-MD5 of ``reverse(concat(length(card), card))``.

Built from Spark SQL functions only (``md5``, ``unhex``, ``encode``, ``concat``),
so it runs inside whole-stage codegen; no Python UDF. The key is a required
argument: it is folded into two binary literals (RFC 2104 inner and outer
pads) and is never logged by this module.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64  # MD5 block size in bytes


def _pads(key: bytes | str) -> tuple[bytes, bytes]:
    k = key.encode("utf-8") if isinstance(key, str) else bytes(key)
    if len(k) > _BLOCK:
        k = hashlib.md5(k).digest()
    k = k.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)


def card_message(card: str | Column) -> Column:
    """``reverse(concat(length(card), card))``: the digit count is prefixed, then
    the whole string is reversed."""
    c = F.col(card) if isinstance(card, str) else card
    return F.reverse(F.concat(F.length(c).cast("string"), c))


def hmac_md5(message: str | Column, key: bytes | str) -> Column:
    """Lower-case hex HMAC-MD5 of a string column (UTF-8) under ``key``."""
    if key is None:
        raise ValueError("an HMAC key is required")
    m = F.col(message) if isinstance(message, str) else message
    ipad, opad = _pads(key)
    inner = F.unhex(F.md5(F.concat(F.lit(bytearray(ipad)), F.encode(m, "UTF-8"))))
    return F.md5(F.concat(F.lit(bytearray(opad)), inner))


def card_digest(card: str | Column, key: bytes | str) -> Column:
    """The digest under which a card is listed."""
    return hmac_md5(card_message(card), key)


def pads_hex(key: bytes | str) -> tuple[str, str]:
    """Hex of the inner and outer pads, for building the same digest in SQL."""
    ipad, opad = _pads(key)
    return ipad.hex(), opad.hex()
