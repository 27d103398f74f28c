"""Rounding as Python and as numpy do it, in column arithmetic.

``F.round`` rounds the shortest decimal half up (4.85 gives 4.9, 4.25 gives 4.3).
Python rounds the exact binary value, ties to even (4.8 and 4.2); numpy rounds
the scaled float to even. Published figures were made with the latter two.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 56


def py_round(x: Column, digits: int) -> Column:
    """``round(x, digits)`` of Python for up to four digits.

    The fraction is an exact multiple of 2^-56 (for values from 1/16 up), so its
    decimals compare with the tie in whole numbers: 64-bit ones for one or two
    digits, decimals beyond.
    """
    scale = 10**digits
    size = F.abs(x)
    whole = F.floor(size)
    units = (size - whole) * float(2**_BITS)
    if digits <= 2:
        units = units.cast("bigint") * scale
        steps = F.shiftright(units, _BITS)
        rest = units.bitwiseAND(F.lit(2**_BITS - 1))
    else:
        units = units.cast("decimal(18,0)") * F.lit(scale).cast("decimal(6,0)")
        unit = F.lit(2**_BITS).cast("decimal(18,0)")
        steps = F.floor(units / unit).cast("bigint")
        rest = (units - steps.cast("decimal(18,0)") * unit).cast("decimal(18,0)").cast("bigint")
    half = F.lit(2 ** (_BITS - 1))
    up = (rest > half) | ((rest == half) & (steps % 2 == 1))
    total = whole * scale + steps + up.cast("bigint")
    return F.signum(x) * (total.cast("double") / float(scale))


def np_round(x: Column, digits: int) -> Column:
    """``numpy.round(x, digits)``: scale, round half to even, scale back."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale
