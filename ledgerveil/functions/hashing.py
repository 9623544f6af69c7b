"""Identifier hashes as native expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def sha16(col: Column | str) -> Column:
    """First 16 hex digits of SHA-256; null stays null."""
    return F.substring(F.sha2(_text(col), 256), 1, 16)


def account_hash(col: Column | str, salt: str | None = None) -> Column:
    """Loader-side identifier hash: null and empty become the empty string."""
    text = _text(col)
    payload = F.concat(F.lit(f"{salt}:"), text) if salt else text
    return F.when(text.isNull() | (text == ""), F.lit("")).otherwise(sha16(payload))


def value_hash(col: Column | str) -> Column:
    """Transformation-side hash: null and empty become null."""
    text = _text(col)
    return F.when(text != "", sha16(text))


def hmac_pads(key: str) -> tuple[bytes, bytes]:
    """Inner and outer padded key blocks of HMAC with SHA-256 (RFC 2104)."""
    raw = key.encode("utf-8")
    if len(raw) > 64:
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)


def keyed_hash(col: Column | str, key: str) -> Column:
    """First 16 hex digits of HMAC-SHA-256, composed from sha2 so it stays in codegen."""
    text = _text(col)
    inner, outer = hmac_pads(key)
    inner_digest = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(text, "UTF-8")), 256))
    digest = F.sha2(F.concat(F.lit(bytearray(outer)), inner_digest), 256)
    return F.when(text != "", F.substring(digest, 1, 16))


def certificate_id(*parts: Column) -> Column:
    """Twelve upper-case hex digits identifying a certificate."""
    return F.upper(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 12))


def feature_tag(col: Column) -> Column:
    """Six upper-case hex digits of the MD5 of a feature or institution name."""
    return F.upper(F.substring(F.md5(col), 1, 6))
