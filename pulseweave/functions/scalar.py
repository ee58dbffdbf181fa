"""Scalar expressions: missing values, hashes, text keys, logistic function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "<MISSING>"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """The value, null where it is NaN or infinite: aggregates then skip it."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def present(c: str | Column) -> Column:
    """Trimmed text, null where blank."""
    return F.nullif(F.trim(col(c).cast("string")), F.lit(""))


def record_hash(*parts: str | int | Column) -> Column:
    """SHA-256 of the parts' text, joined by ``|``."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def md5_int(*parts: str | int | Column) -> Column:
    """32 bits of the MD5 of the parts' text, joined by ``|``, as a long: an order that SQL engines agree on."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def logistic(z: Column) -> Column:
    """1 / (1 + exp(-z)), z kept within 40."""
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))


def seconds(sample: str | Column, rate: float = 500.0) -> Column:
    return col(sample) / F.lit(rate)


def fold_of(key: str | Column, folds: int = 8) -> Column:
    """1 to ``folds``, by the hash of the key's text."""
    return (F.lit(1) + md5_int(col(key)) % folds).cast("int")


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once per row, also where ``f`` uses it inside of a lambda over an array."""
    return F.element_at(F.transform(F.array(value), f), 1)


def joined(c: str | Column, by: str = ";") -> Column:
    """An array's values as one text."""
    return F.array_join(col(c).cast("array<string>"), by)


def as_json(c: str | Column) -> Column:
    """An array, map or struct as JSON text."""
    return F.to_json(col(c))
