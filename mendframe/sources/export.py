"""Sinks: write a cleaned table in its own or another format."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendframe.sources.load import table_name

META_COLUMNS = ("_source_format",)
WRITERS = ("csv", "json", "jsonl", "parquet")


@dataclass(frozen=True)
class ExportResult:
    path: str
    format: str
    row_count: int


def export_name(dataset: str) -> str:
    """The table's name, whole, and `_cleaned`: different tables never share a target."""
    return f"{table_name(dataset)}_cleaned"


def export_format(source_format: str, output_format: str | None = None) -> str:
    """The wanted format, else the source's, else CSV."""
    if output_format in WRITERS:
        return output_format
    return source_format if source_format in WRITERS else "csv"


def _flat(df: DataFrame) -> DataFrame:
    # CSV has no nested values; they are written as JSON text
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            F.to_json(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, nested)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def export_table(
    df: DataFrame,
    folder: str,
    dataset: str,
    source_format: str = "parquet",
    output_format: str | None = None,
    mode: str = "error",
) -> ExportResult:
    """Write `df` under `folder` and return where, how, and how many rows.

    Rows are counted while they are written.  Both JSON formats write JSON Lines.
    """
    fmt = export_format(source_format, output_format)
    if df.isEmpty():
        raise ValueError("Cannot export an empty table.")
    seen = Observation()
    out = df.drop(*META_COLUMNS).observe(seen, F.count(F.lit(1)).alias("n"))
    # the extension names what is written, so that loading it back needs no hint
    extension = "jsonl" if fmt == "json" else fmt
    path = f"{folder.rstrip('/')}/{export_name(dataset)}.{extension}"
    writer = out.write.mode(mode)
    if fmt == "csv":
        _flat(out).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        writer.option("ignoreNullFields", False).json(path)
    return ExportResult(path, fmt, seen.get["n"])
