"""Whole-number helpers as column expressions. Widths are 32 for int columns and 64 for bigint columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def positive_or_zero(x: Column) -> Column:
    return F.greatest(x, F.lit(0))


def absolute(x: Column) -> Column:
    return F.abs(x)


def smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def rotate_right_32(x: Column, n: int) -> Column:
    """x is a bigint that holds an unsigned 32-bit value; so is the result."""
    n %= 32
    return F.shiftrightunsigned(x, n).bitwiseOR(F.shiftleft(x, 32 - n).bitwiseAND(0xFFFFFFFF)) if n else x


def rotate_right_64(x: Column, n: int) -> Column:
    n %= 64
    return F.shiftrightunsigned(x, n).bitwiseOR(F.shiftleft(x, 64 - n)) if n else x


def swap_outer_16(x: Column) -> Column:
    """The top and the bottom 16 of 64 bits change places; those between become zero."""
    return F.shiftrightunsigned(x, 48).bitwiseOR(F.shiftleft(x, 48))
