"""Hash expressions: MD5, SHA-256 and keyed HMAC-SHA256 as native columns.

HMAC(K, m) = SHA256((K xor opad) || SHA256((K xor ipad) || m)). The key
schedule needs byte-wise XOR, which Spark has no column function for, so the
two 64-byte pad blocks are computed once on the driver (they depend only on
the key, never on row data) and enter the plan as binary literals; the
per-row work -- two SHA-256 passes over the message -- is native ``sha2``.
Key blocks are secrets: the session redaction regex hides them in plans.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def pad_blocks(key: bytes) -> tuple[bytes, bytes]:
    """(K xor ipad, K xor opad) for a SHA-256 HMAC key."""
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256_hex(key: bytes, msg: Column) -> Column:
    """Lower-hex HMAC-SHA256 of a string/binary column under a fixed key."""
    ipad, opad = pad_blocks(key)
    inner = F.unhex(F.sha2(F.concat(F.lit(ipad), F.encode(msg, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(opad), inner), 256)


def hmac_sha256(key: bytes, msg: bytes) -> bytes:
    """Driver-side keyed hash, used only for the key-derivation chain."""
    return hmac.new(key, msg, hashlib.sha256).digest()


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def md5_hex(c: Column) -> Column:
    return F.md5(c)
