"""Words of whole texts as bytes, for operators that count them in Arrow batches."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_table(keep: str) -> bytes:
    """Translation that lower-cases A-Z, keeps lower-cased ``keep`` and all bytes of non-ASCII characters, and blanks the rest."""
    kept = keep.encode()
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in kept else 32 for b in range(256))


LETTERS = byte_table("abcdefghijklmnopqrstuvwxyz")  # [^\x00-\x40\x5B-\x60\x7B-\x7F]+
LETTERS_DIGITS = byte_table("abcdefghijklmnopqrstuvwxyz0123456789")  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+


def raw(text: Column) -> Column:
    """A text's bytes, none for null."""
    return F.coalesce(text, F.lit("")).cast("binary")


def words(text: bytes, table: bytes) -> list[bytes]:
    return text.translate(table).split()


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


class Buckets(dict):
    """CRC-32 bucket of a feature; remembers at most ``most`` of them."""

    def __init__(self, n: int, most: int = 400_000):
        super().__init__()
        self.n, self.most = n, most

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.n
        return found
