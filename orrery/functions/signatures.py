"""RSA signatures with SHA-256 (PKCS #1 v1.5), from public keys in PEM form."""

from __future__ import annotations

import base64
import hashlib
import re

import pandas as pd
from pyspark.sql import Column, functions as F

#: DER prefix of a SHA-256 digest: a fixed value.
SHA256_PREFIX = bytes.fromhex("3031300d060960864801650304020105000420")


def _item(data: bytes, at: int) -> tuple[int, bytes, int]:
    """Tag, content and end of a DER item."""
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    return tag, data[at : at + n], at + n


def public_key(pem: str) -> tuple[int, int]:
    """Modulus and exponent of a SubjectPublicKeyInfo or RSAPublicKey."""
    body = base64.b64decode("".join(re.sub(r"-----[^-]+-----", "", pem).split()))
    _, outer, _ = _item(body, 0)
    tag, first, end = _item(outer, 0)
    if tag == 0x30:  # an algorithm, then the key as a bit string
        _, bits, _ = _item(outer, end)
        _, outer, _ = _item(bits[1:], 0)
        _, first, end = _item(outer, 0)
    _, second, _ = _item(outer, end)
    return int.from_bytes(first, "big"), int.from_bytes(second, "big")


def _verified(key: tuple[int, int], text: str, signature: str) -> bool:
    n, e = key
    size = (n.bit_length() + 7) // 8
    raw = base64.b64decode(signature)
    if len(raw) != size:
        return False
    block = pow(int.from_bytes(raw, "big"), e, n).to_bytes(size, "big")
    tail = SHA256_PREFIX + hashlib.sha256(text.encode()).digest()
    return block == b"\x00\x01" + b"\xff" * (size - len(tail) - 3) + b"\x00" + tail


def verify(pem: Column, text: Column, signature: Column) -> Column:
    """Whether a signature in base64 is that of the text; false for what can't be read."""

    @F.pandas_udf("boolean")
    def run(pems: pd.Series, texts: pd.Series, signatures: pd.Series) -> pd.Series:
        keys: dict[str, tuple[int, int]] = {}

        def one(p: str | None, t: str | None, s: str | None) -> bool | None:
            if p is None or t is None or s is None:
                return None
            try:
                if p not in keys:
                    keys[p] = public_key(p)
                return _verified(keys[p], t, s)
            except (ValueError, IndexError):
                return False

        return pd.Series([one(*row) for row in zip(pems, texts, signatures, strict=True)], dtype=object)

    return run(pem, text, signature)
