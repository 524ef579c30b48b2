"""Stable hashes and GUIDs computed inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# FNV-1a prime and offset, and the four word seeds of a stable GUID.
FNV_PRIME = 16777619
FNV_OFFSET = 0x811C9DC5
GUID_SEEDS = (0x811C9DC5, 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _code_units(text: Column) -> Column:
    """UTF-16 code units of a text as an array of longs."""
    raw = F.encode(text, "UTF-16BE")  # bytes, as a place in a string is only found by walking there
    count = (F.length(raw) / 2).cast("int")
    units = F.transform(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
        lambda i: F.conv(F.hex(F.substring(raw, (i - 1) * 2 + 1, F.lit(2))), 16, 10).cast("bigint"),
    )
    return F.when(count == 0, F.array().cast("array<bigint>")).otherwise(units)


def fnv1a32(c: Column | str, seed: int = FNV_OFFSET) -> Column:
    return F.aggregate(
        _code_units(_col(c)),
        F.lit(seed).cast("bigint"),
        lambda h, unit: (h.bitwiseXOR(unit) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)),
    )


def stable_guid(c: Column | str) -> Column:
    """GUID-shaped text that depends on nothing but the seed text."""
    # One walk over the text for all four hashes; an array of one element names words that are used several times.
    seeds = F.array(*[F.lit(seed).cast("bigint") for seed in GUID_SEEDS])
    hashes = F.aggregate(_code_units(_col(c)), seeds, lambda h, unit: F.transform(
        h, lambda word: (word.bitwiseXOR(unit) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF))))
    words = F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 8, "0")))
    return F.get(F.transform(F.array(words), _guid_text), F.lit(0))


def _guid_text(words: Column) -> Column:
    first, second, third, fourth = (F.get(words, F.lit(i)) for i in range(4))
    variant = F.lower(F.hex(F.conv(F.substring(third, 1, 1), 16, 10).cast("bigint").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(
        first, F.lit("-"), F.substring(second, 1, 4), F.lit("-4"), F.substring(second, 6, 3), F.lit("-"),
        variant, F.substring(third, 2, 3), F.lit("-"), F.substring(third, 5, 4), fourth,
    )


def random_guid() -> Column:
    """A new random GUID per row; never used while reconciling."""
    return F.expr("uuid()")


def sha256_hex(c: Column | str) -> Column:
    return F.sha2(_col(c).cast("binary"), 256)


def bytes_to_hex(c: Column | str) -> Column:
    return F.lower(F.hex(_col(c)))
