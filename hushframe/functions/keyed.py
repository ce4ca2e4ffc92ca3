"""Keyed digests and sealed values. Keys given as literals show in plans; production passes them as columns of a table that only jobs read."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

_UNIT = "\x1f"


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 of the message's UTF-8 bytes; keys of at most 64 bytes."""
    if len(key) > 64:
        raise ValueError("keys are at most 64 bytes")
    padded = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in padded)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def value_digest(tenant: Column, scope: Column, entity_type: Column, canonical_value: Column, key: bytes) -> Column:
    return hmac_sha256(F.concat_ws(_UNIT, tenant, scope, entity_type, canonical_value), key)


def pseudonym(value: Column, key: bytes) -> Column:
    return F.left(hmac_sha256(value, key), F.lit(16))


def seal(value: Column, key: bytes, *bound: Column) -> Column:
    """AES-GCM with a random nonce in front; the bound fields must be the same to open it."""
    return F.aes_encrypt(value.cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.concat_ws(_UNIT, *bound).cast("binary"))


def unseal(sealed: Column, key: bytes, *bound: Column) -> Column:
    """The value, or null where the key or a bound field differs."""
    return F.try_aes_decrypt(sealed, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.concat_ws(_UNIT, *bound).cast("binary")).cast("string")
