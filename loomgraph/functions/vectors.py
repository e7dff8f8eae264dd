"""Vector scalars as column expressions over array columns; sums run in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def paired(a: Column, b: Column) -> Column:
    """``a``, if the vectors have the same length; an error, if not."""
    message = F.concat(F.lit("vectors of different dimensions: "), F.size(a), F.lit(" and "), F.size(b))
    return F.when(a.isNull() | b.isNull() | (F.size(a) == F.size(b)), a).otherwise(F.raise_error(message).cast("array<double>"))


def type_of(v: Column, kind: str) -> Column:
    """"float32", "int8" or "bit"; null for a null vector."""
    return F.when(v.isNotNull(), kind)


def from_json(text: Column, kind: str = "float32") -> Column:
    """A vector from JSON text, as float, byte, or bits packed from zeros and ones."""
    values = F.from_json(text, "array<double>")
    return values.cast("array<float>") if kind == "float32" else values.cast("array<tinyint>") if kind == "int8" else quantized_bits(values)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(paired(a, b)), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(doubles(paired(a, b)), doubles(b), lambda x, y: (x - y) * (x - y))))


def l1_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(paired(a, b)), doubles(b), lambda x, y: F.abs(x - y)))


def cosine_distance(a: Column, b: Column) -> Column:
    """NULL when a norm is 0."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for empty vectors and zero norms."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(paired(a, b)), doubles(b), lambda x, y: x + y)


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(paired(a, b)), doubles(b), lambda x, y: x - y)


def sliced(v: Column, start: int, end: int) -> Column:
    """Half-open, 0-based; bounds outside the vector are an error."""
    if not 0 <= start < end:
        raise ValueError(f"no elements from {start} to {end}")
    v = F.when(v.isNull() | (F.size(v) >= end), v).otherwise(F.raise_error(F.lit(f"vector has fewer than {end} elements")).cast("array<double>"))
    return F.slice(v, start + 1, end - start)


def scaled(v: Column, of_zero: Callable[[Column], Column]) -> Column:
    """Elements through the norm, which is computed once, as is the vector itself; ``of_zero`` for a zero vector."""
    unit = lambda d: bound(norm(d), lambda n: F.transform(d, lambda x: F.when(n > 0, x / n).otherwise(of_zero(x))))
    return bound(doubles(v), unit)


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return scaled(v, lambda x: x)


def normalized_or_nan(v: Column) -> Column:
    """Unit length; a zero vector gives NaN elements."""
    return scaled(v, lambda x: F.lit(float("nan")))


def added_int8(a: Column, b: Column) -> Column:
    """Element-wise sum of bytes, wrapping around."""
    return F.zip_with(a.cast("array<int>"), b.cast("array<int>"), lambda x, y: (F.pmod(x + y + 128, F.lit(256)) - 128).cast("tinyint"))


def quantized_int8(v: Column) -> Column:
    """[-1, 1] to -128..127, cut towards zero."""
    return F.transform(doubles(v), lambda x: ((x + 1) / (2.0 / 255) - 128).cast("int"))


def quantized_bits(v: Column) -> Column:
    """Bytes of sign bits, the first element in the lowest bit; the length must be a multiple of 8."""
    v = F.when(v.isNull() | ((F.size(v) % 8 == 0) & (F.size(v) > 0)), v).otherwise(F.raise_error(F.lit("the dimension is no multiple of 8")).cast("array<double>"))
    bits = F.transform(doubles(v), lambda x: (x > 0).cast("int"))
    eights = F.transform(F.sequence(F.lit(0), F.size(v) - 8, F.lit(8)), lambda k: F.slice(bits, k + 1, 8))
    return F.transform(eights, lambda byte: F.aggregate(F.reverse(byte), F.lit(0), lambda a, x: a * 2 + x))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def as_json(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(doubles(v), lambda x: F.when(F.isnan(x), "null").otherwise(F.format_string("%.6f", x))), ","), F.lit("]"))
