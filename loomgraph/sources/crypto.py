"""Encryption at rest: AES-256-GCM with keys derived by HKDF-SHA256."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F


def hkdf(secret: bytes, salt: bytes, info: bytes, length: int = 32) -> bytes:
    """RFC 5869."""
    key, out, block = hmac.new(salt or bytes(32), secret, hashlib.sha256).digest(), b"", b""
    for i in range(1, -(-length // 32) + 1):
        block = hmac.new(key, block + info + bytes([i]), hashlib.sha256).digest()
        out += block
    return out[:length]


class Cipher:
    """Nonce, ciphertext and tag in one binary column; the key comes from a lookup by key id."""

    def __init__(self, keys: dict[str, bytes], key_id: str, salt: bytes = b"loomgraph"):
        self.key = hkdf(keys[key_id], salt, key_id.encode())

    def encrypt(self, column: Column) -> Column:
        return F.aes_encrypt(column.cast("binary"), F.lit(self.key), F.lit("GCM"))

    def decrypt(self, column: Column) -> Column:
        return F.aes_decrypt(column, F.lit(self.key), F.lit("GCM"))


class NoCipher:
    def encrypt(self, column: Column) -> Column:
        return column.cast("binary")

    decrypt = encrypt
