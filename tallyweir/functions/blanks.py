"""Blank handling shared by the operators: one Unicode definition of a blank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blanks (Unicode White_Space plus the byte order mark).
BLANK_CLASS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}\x{0085}]"


def squeeze(col: Column) -> Column:
    """Text with outer blanks removed and runs of blanks made one; empty text becomes null."""
    one = F.regexp_replace(col, BLANK_CLASS + "+", " ")
    return F.nullif(F.trim(one), F.lit(""))
