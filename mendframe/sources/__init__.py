"""Reading and writing tables."""

from mendframe.sources.export import ExportResult, export_table
from mendframe.sources.load import LoadError, TableMeta, coerce_types, ensure_id, load_table, load_tables

__all__ = [
    "ExportResult",
    "LoadError",
    "TableMeta",
    "coerce_types",
    "ensure_id",
    "export_table",
    "load_table",
    "load_tables",
]
