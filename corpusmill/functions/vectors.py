"""Vector maths over arrays, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, f) -> Column:
    """f(value), with value computed once: an expression that a lambda only refers to is computed again for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def zero(dims: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dims)


def _same(a: Column, b: Column) -> Column:
    return F.size(a) == F.size(b)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """Of unit length; a zero vector stays."""
    return bind(v, lambda b: bind(norm(b), lambda n: F.transform(b, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / F.nullif(n, F.lit(0.0))))))


def dot(a: Column, b: Column) -> Column:
    """0 for different lengths."""
    return F.when(_same(a, b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths or a zero vector."""
    n = norm(a) * norm(b)
    return F.when(_same(a, b) & (n > 0), dot(a, b) / F.nullif(n, F.lit(0.0))).otherwise(0.0)


def add(a: Column, b: Column) -> Column:
    """The left one for different lengths."""
    return F.when(_same(a, b), F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double")))


def scale(v: Column, by: Column | float) -> Column:
    return F.transform(v, lambda x: x.cast("double") * by)


def blend(vectors: dict[str, Column], weights: dict[str, float], dims: int) -> Column:
    """Weighted mean of the layers that a row has, normalised; a layer without a weight weighs 1 / number of layers."""
    n = len(vectors)
    total, sum_ = F.lit(0.0), F.array_repeat(F.lit(0.0), dims)
    for layer, v in vectors.items():
        w = float(weights.get(layer, 1.0 / n))
        there = v.isNotNull()
        sum_ = F.when(there, F.zip_with(sum_, scale(v, w), lambda x, y: x + y)).otherwise(sum_)
        total = total + F.when(there, w).otherwise(0.0)
    return normalize(bind(F.nullif(total, F.lit(0.0)), lambda t: F.transform(sum_, lambda x: F.coalesce(x / t, x))))


def encode_vector(v: Column) -> Column:
    """Components as 32-bit floats, lowest byte first, one after the other: array<float> to binary, by way of hex digits."""

    def bits(x: Column) -> Column:
        a = F.abs(x.cast("double"))
        power = F.floor(F.log2(F.when((a > 0) & (a < float("inf")), a).otherwise(1.0)))
        power = F.when(F.pow(F.lit(2.0), power) > a, power - 1).when(F.pow(F.lit(2.0), power + 1) <= a, power + 1).otherwise(power)
        normal = ((power + 127) * 8388608 + F.round((a / F.pow(F.lit(2.0), power) - 1) * 8388608)).cast("bigint")
        tiny = F.round(a * F.pow(F.lit(2.0), F.lit(149.0))).cast("bigint")
        plain = F.when(F.isnan(x), F.lit(0x7FC00000)).when(a == float("inf"), F.lit(0x7F800000)).when(a < 2.0**-126, tiny).otherwise(normal)
        return plain + F.when(~F.isnan(x) & (x < 0), F.lit(0x80000000)).otherwise(F.lit(0))

    def swapped(h: Column) -> Column:
        return F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])

    return F.unhex(F.array_join(F.transform(v, lambda x: swapped(F.lpad(F.hex(bits(x)), 8, "0"))), ""))


def decode_vector(raw: Column) -> Column:
    """The reverse of encode_vector; null if the length is no multiple of four."""

    def value(h: Column) -> Column:
        n = F.conv(h, 16, 10).cast("bigint")
        sign, power, rest = F.when(n >= 0x80000000, -1.0).otherwise(1.0), F.floor(n / 8388608).cast("bigint") % 256, n % 8388608
        number = F.when(power == 0, rest * 2.0**-149).otherwise((1 + rest / 8388608) * F.pow(F.lit(2.0), (power - 127).cast("double")))
        return (sign * F.when(power < 255, number).when(rest == 0, float("inf")).otherwise(float("nan"))).cast("float")

    def words(h: Column) -> Column:
        n = (F.length(h) / 8).cast("int")
        each = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat(*[F.substring(h, i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)]))
        return F.when(n > 0, F.transform(each, value)).otherwise(F.array().cast("array<float>"))

    return F.when(F.octet_length(raw) % 4 == 0, bind(F.hex(raw), words))
