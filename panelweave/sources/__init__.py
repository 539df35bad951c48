"""Readers, writers and file inventories."""

from .files import (
    count_rows,
    find_input_files,
    load_all_sources,
    load_data,
    load_diagnostic,
    normalise_missing,
    read_text_columns,
    save_data,
    save_diagnostic,
)
from .inventory import collect_files, file_inventory, source_hints

__all__ = [
    "collect_files",
    "count_rows",
    "file_inventory",
    "find_input_files",
    "load_all_sources",
    "load_data",
    "load_diagnostic",
    "normalise_missing",
    "read_text_columns",
    "save_data",
    "save_diagnostic",
    "source_hints",
]
