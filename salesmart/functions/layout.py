"""Where rows lie in a table: orders that serve filters on two columns at once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of each of the two columns in the order, and bits by which rows are dealt to files.
BITS, CELL_BITS = 8, 6


def interleaved(date: str = "date", key: str = "product", bits: int = BITS) -> Column:
    """The day of the year and the hash of a key, bit by bit in turn.

    Rows that are close in this order are close in both: a stretch of it holds a
    range of days and a share of the keys, so that files and row groups can be
    skipped by the range of their dates and by the Bloom filter of their keys.
    """
    day = F.floor((F.dayofyear(date) - 1) * (1 << bits) / 367).cast("int")
    bucket = F.pmod(F.xxhash64(key), F.lit(1 << bits)).cast("int")
    mixed = F.lit(0)
    for n in range(bits):
        for shift, part in ((2 * n + 1, day), (2 * n, bucket)):
            bit = F.shiftright(part, n).bitwiseAND(F.lit(1))
            mixed = mixed.bitwiseOR(F.shiftleft(bit, shift))
    return F.coalesce(mixed, F.lit(0))


def cell(order: Column, bits: int = BITS, cell_bits: int = CELL_BITS) -> Column:
    """The stretch of the order that a row is in, of ``2 ** cell_bits`` stretches."""
    return F.shiftright(order, 2 * bits - cell_bits)
