"""Column expressions that every operator shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: least and largest value of each subpixel type
LIMITS = {"u8": (0, 255), "i8": (-128, 127), "u16": (0, 65535), "i16": (-32768, 32767), "u32": (0, 4294967295), "i32": (-2147483648, 2147483647)}


def trunc(v: Column) -> Column:
    """Toward zero."""
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))


def rounded(v: Column | str, digits: int) -> Column:
    """``v`` at ``digits`` places as SQL rounds doubles: scaled, halves away from zero, and scaled back.

    Spark's own rounding with digits goes by the shortest decimal of the double, which can be on the other side of a half.
    """
    v = F.col(v) if isinstance(v, str) else v
    return F.round(v * 10.0**digits) / 10.0**digits


def clamp_trunc(v: Column, kind: str = "u8") -> Column:
    """Saturates, then truncates toward zero; NaN gives the largest value."""
    lo, hi = LIMITS[kind]
    d = v.cast("double")
    narrow = "bigint" if kind in ("u32",) else "int"
    return F.when(F.isnan(d) | (d >= hi), F.lit(hi)).when(d <= lo, F.lit(lo)).otherwise(trunc(d)).cast(narrow)


#: fixed values: 2^23 / ln 2, and 127 * 2^23 less what makes the mean error of the approximation least
EXP_SCALE, EXP_SHIFT = 12102203.0, 1065353216.0 - 486411.0


def fast_exp_negative(x: Column) -> Column:
    """exp(x) for x of 0 or less, by reading ``scale * x + shift``, in single precision, as the bits of a float."""
    bits = F.greatest(F.lit(0), (F.lit(EXP_SCALE).cast("float") * x.cast("float") + F.lit(EXP_SHIFT).cast("float")).cast("int"))
    exponent, fraction = F.shiftright(bits, 23), bits.bitwiseAND(F.lit((1 << 23) - 1))
    return F.when(exponent == 0, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), exponent - 127) * (1.0 + fraction / float(1 << 23)))


def black(channels: int = 1, kind: str = "u8", alpha: bool = False) -> tuple[int, ...]:
    """The black pixel of ``channels`` channels of a subpixel type; with ``alpha`` the last one is opaque."""
    return (LIMITS[kind][0],) * (channels - alpha) + (LIMITS[kind][1],) * alpha


def white(channels: int = 1, kind: str = "u8") -> tuple[int, ...]:
    """The white pixel of ``channels`` channels of a subpixel type; alpha is opaque."""
    return (LIMITS[kind][1],) * channels


def int_div(a: Column, b: Column | int) -> Column:
    """Integer division that truncates toward zero."""
    return trunc(a / b)


def clip_to(v: Column, lo: Column | int, hi: Column | int) -> Column:
    """``v`` between ``lo`` and ``hi``."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(as_column(lo), F.least(v, as_column(hi)))


def l1_norm(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.abs(x))


def l2_norm(xs: Column) -> Column:
    return F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x * x))


def weighted_sum(left: Column, right: Column, left_weight: float, right_weight: float, kind: str = "u8") -> Column:
    return clamp_trunc(left * F.lit(float(left_weight)) + right * F.lit(float(right_weight)), kind)


def interpolate(left: Column, right: Column, left_weight: float, kind: str = "u8") -> Column:
    return weighted_sum(left, right, left_weight, 1.0 - left_weight, kind)


def rotations(byte: Column) -> Column:
    """The eight rotations of a byte, by array."""
    return F.array(*[((byte * (2 ** (8 - i))) % 256 + F.floor(byte / 2**i)).cast("int") if i else byte.cast("int") for i in range(8)])


def min_shift(byte: Column) -> Column:
    """The least rotation of a byte."""
    return F.array_min(rotations(byte))


def count_transitions(byte: Column) -> Column:
    """Changes between neighbouring bits of a byte taken as a ring."""
    turned = ((byte % 2) * 128 + F.floor(byte / 2)).cast("int")
    return F.bit_count(byte.cast("int").bitwiseXOR(turned))


def uniform_representative(byte: Column) -> Column:
    """The least rotation where the byte has two transitions at most, else 170."""
    return F.when(count_transitions(byte) <= 2, min_shift(byte)).otherwise(F.lit(170))


def pack_bits(bits: Column) -> Column:
    """64 booleans to one long, the first in bit 0."""
    return F.aggregate(F.transform(bits, lambda b, i: F.call_function("shiftleft", b.cast("bigint"), i)), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def unpack_bits(h: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(h, i) == 1)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_words(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of longs of one size."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)


def bit_subset(words: Column, bits: list[int]) -> Column:
    """Chosen bits (64 at most) of an array of longs as one long, the first chosen one most significant."""
    total = F.lit(0).cast("bigint")
    for b in bits:
        total = total * 2 + F.getbit(F.element_at(words, b // 64 + 1), F.lit(b % 64)).cast("bigint")
    return total


def source_over(top: list[Column], bottom: list[Column]) -> list[Column]:
    """Four channels of 8 bits of ``top`` blended over ``bottom``.

    alpha = a + b - a*b of the shares; each colour is (top*a + bottom*b*(1-a)) / alpha, truncated.  A top without
    alpha changes nothing.
    """
    a, b = top[3] / 255.0, bottom[3] / 255.0
    alpha = a + b - a * b
    mixed = [clamp_trunc(F.when(alpha == 0, 0.0).otherwise((t * a + o * b * (1 - a)) / F.when(alpha == 0, 1.0).otherwise(alpha))) for t, o in zip(top[:3], bottom[:3], strict=True)]
    return [F.when(top[3].isNull() | (top[3] == 0), o).otherwise(m) for o, m in zip(bottom, [*mixed, clamp_trunc(alpha * 255)], strict=True)]
