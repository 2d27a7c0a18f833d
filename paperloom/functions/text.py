"""Text functions as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dehyphenate(text: Column) -> Column:
    """Words broken by a hyphen or soft hyphen at a line's end are joined if the next line goes on in lower case."""
    return F.regexp_replace(text, r"(?U)(?<=\p{IsAlphabetic})[-­][^\S\n]*\n(?=[^\S\n]*\p{IsLowercase})", "")


def is_rtl(text: Column) -> Column:
    return text.rlike(r"[֐-ࣿיִ-﷿ﹰ-﻿]")


def tsv(cells: Column) -> Column:
    """Rows of cells as tab-separated lines; tabs and line ends within a cell become spaces."""
    return F.array_join(F.transform(cells, lambda r: F.array_join(F.transform(r, lambda c: F.regexp_replace(c, r"[\t\r\n]", " ")), "\t")), "\n")


def csv(cells: Column) -> Column:
    """Rows of cells as comma-separated lines, quoted where needed, parted by CR LF."""
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(cells, lambda r: F.array_join(F.transform(r, quoted), ",")), "\r\n")


def upper_median(values: Column) -> Column:
    """The upper median of positive values, 12 if there are none."""
    own = F.array_sort(F.filter(values, lambda v: v > 0))
    return F.coalesce(F.try_element_at(own, (F.floor(F.size(own) / 2) + 1).cast("int")), F.lit(12.0))
