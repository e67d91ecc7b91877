"""Deterministic draws and identifiers out of keys, as Column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The seed of draws, and what their stages are prefixed with; both are parameters of what a corpus generates.
SEED, VERSION = b"wardline seed", "1"
#: The namespace of row identifiers.
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def hmac_sha256(message: Column, key: bytes = SEED) -> Column:
    """HMAC-SHA256 of a text in hex: two digests over padded keys."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def stable_hex(stage: str, key: Column, namespace: Column | str = "") -> Column:
    """The first eight bytes of the keyed hash of stage, key and namespace, in hex."""
    space = F.lit(namespace) if isinstance(namespace, str) else namespace
    return F.substring(hmac_sha256(F.concat_ws("|", F.lit(VERSION), F.lit(stage), key, space)), 1, 16)


def stable_uint64(stage: str, key: Column, namespace: Column | str = "") -> Column:
    """A 64-bit draw as decimal(20,0)."""
    return F.conv(stable_hex(stage, key, namespace), 16, 10).cast("decimal(20,0)")


def stable_index(stage: str, key: Column, namespace: Column | str, n: int) -> Column:
    """A draw below n."""
    return F.pmod(stable_uint64(stage, key, namespace), F.lit(n).cast("decimal(20,0)")).cast("long")


def unit_draw(stage: str, key: Column, namespace: Column | str = "") -> Column:
    """A draw in [0, 1): the upper 53 bits."""
    return F.shiftrightunsigned(F.conv(stable_hex(stage, key, namespace), 16, -10).cast("long"), 11) / F.lit(float(1 << 53))


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """The name's identifier of version 5 in a namespace."""
    h = F.sha1(F.concat(F.lit(bytes.fromhex(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
