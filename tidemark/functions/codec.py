"""Order-preserving text form of binary keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The usual base-64 alphabet, and one whose characters ascend.
STANDARD = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
ORDERED = "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def order_preserving_base64(key: Column) -> Column:
    """Base 64 without padding, such that texts sort as the bytes do."""
    return F.translate(F.rtrim(F.translate(F.base64(key), "=\r\n", " ")), STANDARD, ORDERED)


def from_order_preserving_base64(text: Column) -> Column:
    back = F.translate(text, ORDERED, STANDARD)
    return F.unbase64(F.concat(back, F.repeat(F.lit("="), F.pmod(-F.length(back), F.lit(4)).cast("int"))))
