"""Tolerant number parsing: a default instead of an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from factstore.functions.text import py_strip

_INT = r"^[+-]?\d+(_\d+)*$"
_FLOAT = r"^[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?|inf|infinity|nan)$"


def int_or(c, default: int) -> Column:
    text = py_strip(c)
    digits = F.replace(text, F.lit("_"), F.lit(""))
    return F.coalesce(F.when(text.rlike(_INT), digits.try_cast("bigint")), F.lit(default).cast("bigint"))


def float_or(c, default: float) -> Column:
    text = F.lower(py_strip(c))
    digits = F.replace(text, F.lit("_"), F.lit(""))
    return F.coalesce(F.when(text.rlike(_FLOAT), digits.try_cast("double")), F.lit(float(default)))
