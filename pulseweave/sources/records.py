"""Multi-lead records from header and data files: every failure is a row with a code, none is dropped."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.waveforms import LEADS, RATE

#: Millivolts in a unit (any case), the 16-bit value that marks a missing sample, and the most bytes that a header may ask for.
UNITS = {"mv": 1.0, "uv": 1e-3, "v": 1e3}
SENTINEL = -32768
MOST_BYTES = 1_000_000_000
#: Why a record could not be read, in the order in which it is looked for.
CODES = (
    "missing_header", "header_read_error", "malformed_header", "unsupported_format", "unsupported_format_modifier", "unsupported_unit", "unsupported_multifile", "unsafe_path", "missing_data", "data_size_limit", "data_size_mismatch",
    "invalid_digital_sentinel", "nonfinite_signal", "noncanonical_leads",
)
SIGNAL_LINE = re.compile(r"(?P<file>\S+)\s+(?P<format>\d+)(?P<more>\S*)\s+(?P<gain>-?[0-9.eE+-]+)(?:\((?P<base>-?\d+)\))?(?:/(?P<unit>\S+))?(?P<rest>(?:\s+\S+)*)\s+(?P<name>\S+)\s*$")
HEADER = "sampling_rate double, sample_count int, lead_names array<string>, data_file string, gains array<double>, bases array<double>, failure_code string"
SCHEMA = "record string, sampling_rate double, sample_count int, lead_names array<string>, signal array<array<float>>, ok boolean, failure_code string"


def canonical(name: str) -> str:
    """A lead's name in the usual case."""
    return next((lead for lead in LEADS if lead.lower() == name.lower()), name)


def parse_header(header: bytes | None) -> dict:
    """What a header says: dimensions, leads, data file, and gain (per mV) and base of each lead; or a code."""
    out: dict = {"sampling_rate": None, "sample_count": None, "lead_names": None, "data_file": None, "gains": None, "bases": None, "failure_code": None}
    fail = lambda code: out | {"failure_code": code}
    if header is None:
        return fail("missing_header")
    try:
        lines = [x for x in map(str.strip, header.decode("ascii").splitlines()) if x and x[0] != "#"]
    except UnicodeDecodeError:
        return fail("header_read_error")
    first = lines[0].split() if lines else []
    try:
        leads, rate, count = int(first[1]), float(first[2].split("/")[0]), int(first[3])
    except (IndexError, ValueError):
        return fail("malformed_header")
    if leads < 1 or not 1 <= count < 1 << 31 or not 0 < rate < float("inf") or len(lines) < leads + 1 or re.search(r"[/\\]", first[0]):
        return fail("malformed_header")
    out |= {"sampling_rate": rate, "sample_count": count}
    specs = [SIGNAL_LINE.match(x) for x in lines[1 : leads + 1]]
    if not all(specs):
        return fail("malformed_header")
    if any(s["format"] != "16" for s in specs):
        return fail("unsupported_format")
    if any(s["more"] not in ("", "+0") for s in specs):
        return fail("unsupported_format_modifier")
    try:
        gains = [float(s["gain"]) for s in specs]
    except ValueError:
        return fail("malformed_header")
    if not all(0 < g < float("inf") for g in gains) or any(re.match(r"/|.*\\", s["file"]) for s in specs):
        return fail("malformed_header")
    units = [(s["unit"] or "mV").lower().replace("\u00b5", "u") for s in specs]
    if any(u not in UNITS for u in units):
        return fail("unsupported_unit")
    out |= {"lead_names": [canonical(s["name"]) for s in specs], "gains": [g / UNITS[u] for g, u in zip(gains, units, strict=True)], "bases": [float(s["base"] or 0) for s in specs]}
    files = {s["file"] for s in specs}
    if len(files) != 1:
        return fail("unsupported_multifile")
    (file,) = files
    if ".." in file.split("/"):
        return fail("unsafe_path")
    return out | {"data_file": file}


def decode(header: dict, data: bytes | None) -> dict:
    """One record from its parsed header and data; ``signal`` is lead-major, twelve leads in canonical order."""
    out = {k: header[k] for k in ("sampling_rate", "sample_count", "lead_names")} | {"signal": None, "ok": False, "failure_code": header["failure_code"]}
    fail = lambda code: out | {"failure_code": code}
    if header["failure_code"]:
        return out
    names, count = header["lead_names"], header["sample_count"]
    if data is None:
        return fail("missing_data")
    if 2 * len(names) * count > MOST_BYTES:
        return fail("data_size_limit")
    if len(data) != 2 * len(names) * count:
        return fail("data_size_mismatch")
    digital = np.frombuffer(data, "<i2").reshape(count, len(names))
    if (digital == SENTINEL).any():
        return fail("invalid_digital_sentinel")
    with np.errstate(over="ignore"):
        signal = (digital - np.array(header["bases"])) / np.array(header["gains"])
    if not np.isfinite(signal).all():
        return fail("nonfinite_signal")
    if len(names) == len(LEADS):
        if set(names) != set(LEADS):
            return fail("noncanonical_leads")
        signal, out["lead_names"] = signal[:, [names.index(n) for n in LEADS]], list(LEADS)
    return out | {"signal": signal.T.astype(np.float32).tolist(), "ok": True}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path``, a row per header, and one per data file that no header names.

    Headers are parsed first, a small table; each names its data file, and data meet
    headers by that path. Samples are decoded in tasks. A header's row is named by its path without the ending.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    parsed_types = pa.schema([("record", pa.string()), ("folder", pa.string()), ("sampling_rate", pa.float64()), ("sample_count", pa.int32()), ("lead_names", pa.list_(pa.string())), ("data_file", pa.string()), ("gains", pa.list_(pa.float64())), ("bases", pa.list_(pa.float64())), ("failure_code", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"record": p.removesuffix(".hea"), "folder": p.rsplit("/", 1)[0]} | parse_header(c) for p, c in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=parsed_types)

    headers = files.filter(F.col("path").endswith(".hea")).mapInArrow(parse, f"record string, folder string, {HEADER}")
    headers = headers.withColumn("data_path", F.concat("folder", F.lit("/"), "data_file"))
    data = files.filter(F.col("path").endswith(".dat")).select(F.col("path").alias("data_path"), F.col("content").alias("data"))
    both = headers.join(data, "data_path", "full_outer")
    # data files that no header names and that have no header of their own
    stem = F.regexp_replace("data_path", r"\.dat$", "")
    alone = both.filter(F.col("record").isNull()).withColumn("record", stem).join(headers.select("record"), "record", "left_anti").withColumns({"failure_code": F.lit("missing_header"), "data": F.lit(None).cast("binary")})
    rows = both.filter(F.col("record").isNotNull()).unionByName(alone).drop("data_path", "folder", "data_file")
    types = pa.schema([("record", pa.string()), ("sampling_rate", pa.float64()), ("sample_count", pa.int32()), ("lead_names", pa.list_(pa.string())), ("signal", pa.list_(pa.list_(pa.float32()))), ("ok", pa.bool_()), ("failure_code", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{"record": row["record"]} | decode(row, row["data"])], schema=types)

    return rows.select("record", "sampling_rate", "sample_count", "lead_names", "gains", "bases", "failure_code", "data").mapInArrow(run, SCHEMA)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write each row (path below ``folder``, content) as a file of its own, from the tasks, to storage that all of them share; path and bytes of what was written. A task that runs again writes the same files again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        for batch in batches:
            sizes = []
            for path, content in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                target = f"{root.rstrip('/')}/{path}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(target) as out:
                    out.write(content)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return files.select("path", F.col("content").cast("binary").alias("content")).filter("path IS NOT NULL AND content IS NOT NULL").mapInArrow(run, "path string, bytes long")


def shape_gate(records: DataFrame, rate: float = RATE, samples: int = 5000, leads: tuple[str, ...] = LEADS) -> DataFrame:
    """Records of another rate, length or lead set, or with values that are not finite, fail with a code; earlier failures stay."""
    bad_value = F.exists("signal", lambda lead: F.exists(lead, lambda v: F.isnan(v) | (F.abs(v) == float("inf")) | v.isNull()))
    code = (
        F.when(~F.col("ok"), F.col("failure_code"))
        .when(F.col("sampling_rate") != rate, "sampling_rate_mismatch")
        .when((F.size("signal") != len(leads)) | F.exists("signal", lambda lead: F.size(lead) != samples), "shape_mismatch")
        .when(~F.col("lead_names").eqNullSafe(F.array(*[F.lit(n) for n in leads])), "noncanonical_leads")
        .when(bad_value, "nonfinite_signal")
    )
    return records.withColumn("failure_code", code).withColumn("ok", F.col("failure_code").isNull())
