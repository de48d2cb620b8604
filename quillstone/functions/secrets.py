"""Encryption of texts with a key derived once from a passphrase; signatures."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

ITERATIONS = 480_000


def key(passphrase: str, salt: bytes) -> bytes:
    """A 256-bit key; derive it on the driver, never per row."""
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, ITERATIONS)


def encrypted(text: Column, key: bytes, salt: bytes) -> Column:
    """Base64 of salt, nonce and AES-GCM ciphertext."""
    return F.base64(F.concat(F.lit(salt), F.aes_encrypt(text, F.lit(key), F.lit("GCM"))))


def decrypted(text: Column, key: bytes, salt_size: int = 16) -> Column:
    """The text again; null if the key does not fit."""
    whole = F.unbase64(text)
    return F.try_aes_decrypt(F.substring(whole, salt_size + 1, 2**30), F.lit(key), F.lit("GCM")).cast("string")


def signature(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))
