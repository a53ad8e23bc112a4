"""Number cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters no number has, and the dots between thousands: those before exactly three digits, whatever stands between.
NOT_OF_THE_NUMBER = r"[^0-9.,-]+|\.(?=(?:[^0-9.,-]*+[0-9]){3}[^0-9.,-]*+(?:[.,-]|\z))"


def text_to_number(c: Column) -> Column:
    """Double from free text such as `1.234.567 đ`; 0 where no number can be read.

    A dot before exactly three digits separates thousands, a comma is a
    decimal point.
    """
    number = F.replace(F.regexp_replace(c, NOT_OF_THE_NUMBER, ""), F.lit(","), F.lit(".")).try_cast("double")
    # A blank cell is not parsed: the failure would cost more than many numbers.
    return F.coalesce(F.when(c != "", number), F.lit(0.0))


def ratio_or_zero(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0 or missing."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))
