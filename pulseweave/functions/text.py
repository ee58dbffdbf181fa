"""Text as keys: one form for values that look alike, and keys of several columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import MISSING

#: ASCII white space, as text is stripped of it.
_EDGES = r"^[\x09-\x0D\x1C-\x20]+|[\x09-\x0D\x1C-\x20]+$"


def normal_text(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` with the text in ``columns`` composed (NFC) and stripped of white space; other types and columns are left.

    SQL has no word for composition. ASCII is composed already, so rows whose values are all ASCII stay
    in the JVM, and only the others pass through Python, in Arrow batches.
    """
    columns = [c for c in columns if rows.schema[c].dataType.typeName() in ("string", "varchar", "char")]
    if not columns:
        return rows
    ascii_ = F.lit(True)
    for c in columns:
        ascii_ = ascii_ & F.coalesce(F.octet_length(c) == F.char_length(c), F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = list(batch.columns)
            for c in columns:
                k = batch.schema.get_field_index(c)
                arrays[k] = pa.array([None if v is None else unicodedata.normalize("NFC", v).strip() for v in arrays[k].to_pylist()], arrays[k].type)
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    plain = rows.filter(ascii_).withColumns({c: F.regexp_replace(c, _EDGES, "") for c in columns})
    return plain.unionByName(rows.filter(~ascii_).mapInArrow(run, rows.schema))


def key_text(rows: DataFrame, column: str) -> Column:
    """The text of one column of ``rows`` as part of a key: booleans, by type, as 1 or 0; null, NaN and blank text as MISSING; anything else as its text."""
    kind, c = rows.schema[column].dataType.typeName(), F.col(column)
    if kind == "boolean":
        return F.coalesce(c.cast("int").cast("string"), F.lit(MISSING))
    if kind in ("float", "double"):
        return F.when(c.isNull() | F.isnan(c), MISSING).otherwise(c.cast("string"))
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(MISSING))


def with_stratum(rows: DataFrame, columns: Sequence[str], name: str = "stratum") -> DataFrame:
    """``rows`` with the JSON list of the columns' text, in one form; the columns themselves are left as they are."""
    copies, taken = {}, {c.lower() for c in rows.columns}
    for c in columns:
        own = f"_{c}"
        while own.lower() in taken:
            own += "_"
        taken.add(own.lower())
        copies[c] = own
    found = normal_text(rows.withColumns({own: F.col(c) for c, own in copies.items()}), list(copies.values()))
    return found.withColumn(name, F.to_json(F.array(*[key_text(found, own) for own in copies.values()]))).drop(*copies.values())
