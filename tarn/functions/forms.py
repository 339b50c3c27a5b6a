"""Binary and display forms of single values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def little_endian_hex(c: Column, bytes_: int = 4) -> Column:
    """The binary form of a whole number, as lower-case hexadecimal digits."""
    parts = [F.lower(F.lpad(F.hex(F.shiftright(c.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0")) for k in range(bytes_)]
    return F.concat(*parts)


def display_timestamp(c: Column) -> Column:
    """A timestamp's display form, at microseconds."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
