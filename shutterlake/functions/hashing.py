"""64-bit perceptual hashes as signed longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 64


def signed(value: int) -> int:
    """Python integer with 64 bits to the long with the same bits."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def phash_from_coefficients(values: Column | str) -> Column:
    """[X1] Bit i is set when coefficient i is above the median of all 64.

    One-element arrays bind the sorted values and the median once per row; as plain
    subexpressions they would be computed again for every bit.
    """
    values = F.col(values) if isinstance(values, str) else values
    doubles = values.cast("array<double>")

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def bind(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def bits(b: Column) -> Column:
        above = F.transform(b["v"], lambda x: F.when(x > b["median"], one).otherwise(zero))
        return F.aggregate(F.reverse(above), zero, lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit))

    def with_median(b: Column) -> Column:
        median = (b["ordered"][31] + b["ordered"][32]) / 2
        return bind(F.struct(b["v"].alias("v"), median.alias("median")), bits)

    # Lambdas use only what is bound, so the input may also come from a Python function.
    both = bind(doubles, lambda v: F.struct(v.alias("v"), F.sort_array(v).alias("ordered")))
    return bind(F.when(F.size(doubles) == HASH_BITS, both), with_median)


def valid_hash(c: Column | str) -> Column:
    """Sixteen hex digits."""
    return F.coalesce(F.regexp_like(c, F.lit(r"^[0-9a-fA-F]{16}\z")), F.lit(False))


def hash_from_hex(c: Column | str) -> Column:
    """NULL unless the text is a valid hash."""
    return F.when(valid_hash(c), F.conv(c, 16, -10).cast("long"))


def hash_to_hex(c: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    """[X3] Number of differing bits of two hashes."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hamming_hex(a: Column | str, b: Column | str) -> Column:
    """[X3] Distance of two hex hashes; invalid text is an error."""
    distance = hamming(hash_from_hex(a), hash_from_hex(b))
    return F.when(valid_hash(a) & valid_hash(b), distance).otherwise(
        F.raise_error(F.concat(F.lit("invalid hash: "), F.coalesce(a, F.lit("NULL")), F.lit(" "), F.coalesce(b, F.lit("NULL"))))
    )


def similarity_pct(distance: Column) -> Column:
    """[X4] Share of equal bits in percent, an exact multiple of 1.5625."""
    return (F.lit(HASH_BITS) - distance) * F.lit(100.0) / F.lit(float(HASH_BITS))


def similarity_text(distance: Column) -> Column:
    """[X4] The same with one decimal, ties up."""
    return F.format_string("%.1f%%", similarity_pct(distance))
