"""Vector functions over arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either vector is null, empty or zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def quantize_i8(a: Column) -> Column:
    """Each value times 127, rounded half away from zero and clamped to a byte's range, as bigint."""
    return F.transform(a, lambda x: F.round(F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(1.0)) * 127).cast("long"))


def quantize_b1(a: Column) -> Column:
    """One bit per value: 1 above zero."""
    return F.transform(a, lambda x: F.when(x > 0, 1).otherwise(0).cast("long"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def hash_embedding(text: Column, dims: int = 16) -> Column:
    """A deterministic unit vector from the SHA-256 of the text: byte 7i mod 32, sign by parity, size by value."""
    digest = F.sha2(text.cast("binary"), 256)

    def at(i: Column) -> Column:
        byte = F.conv(F.substring(digest, (F.pmod(i * 7, F.lit(32)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long")
        return F.when(byte % 2 == 0, byte / 255.0).otherwise(-(byte / 255.0))

    return unit(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), at))
