"""Deterministic hashes and the splits made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_OFFSET, FNV_PRIME, MASK32 = 2166136261, 16777619, 4294967295


def hex_number(digest: Column, first: int = 1, digits: int = 8) -> Column:
    """Digits of a hex digest as a number."""
    return F.conv(F.substring(digest, first, digits), 16, 10).cast("long")


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as an unsigned 32-bit number in a long."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    places = F.sequence(F.lit(1), F.length(hexed) - 1, F.lit(2))
    byte = F.when(F.length(hexed) > 0, F.transform(places, lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.aggregate(byte, F.lit(FNV_OFFSET).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(MASK32).cast("long")))


def fnv1a32_of(text: str) -> int:
    """fnv1a32() of a given string."""
    h = FNV_OFFSET
    for b in text.encode():
        h = (h ^ b) * FNV_PRIME & MASK32
    return h


def fnv1a64(text: Column) -> Column:
    """FNV-1a of 64 bits over the UTF-8 bytes, as its unsigned halves (high, low). The prime is 2^40 + 435, so a step is
    shifts and short products of the halves, and nothing overflows."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    long_ = lambda x: F.lit(x).cast("long")
    byte = F.when(F.length(hexed) > 0, F.transform(F.sequence(F.lit(1), F.length(hexed) - 1, F.lit(2)), lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))

    def step(h: Column, b: Column) -> Column:
        low = h["low"].bitwiseXOR(b)
        product = low * long_(435)
        high = h["high"] * long_(435) + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(long_(MASK32)).alias("high"), product.bitwiseAND(long_(MASK32)).alias("low"))

    return F.aggregate(byte, F.struct(long_(0xCBF29CE4).alias("high"), long_(0x84222325).alias("low")), step)


def split_75_10_15(group: Column, namespace: str = "timing") -> Column:
    """train, validation or test by the SHA-256 of namespace, NUL and group."""
    p = hex_number(F.sha2(F.concat(F.lit(namespace), F.lit("\0"), group), 256)) % 100
    return F.when(p < 75, "train").when(p < 85, "validation").otherwise("test")


def fold(key: Column, folds: int = 5) -> Column:
    return hex_number(F.sha1(key)) % folds


def seed_of(key: Column) -> Column:
    """1 to 2147483646, from the first four bytes."""
    return F.lit(1) + hex_number(F.sha2(key, 256)) % 2147483646


def salted_key(parts: list[Column], retry: Column) -> Column:
    """The parts joined by NUL; from the first retry on with its number, so a rejected draw gets another seed."""
    salt = F.when(retry > 0, F.concat(F.lit("\0retry="), retry.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.concat_ws("\0", *parts), salt)


def choice_of(key: Column, n: int) -> Column:
    """0 to n - 1, from the next four bytes."""
    return hex_number(F.sha2(key, 256), 9) % n
