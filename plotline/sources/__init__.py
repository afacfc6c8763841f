"""Sources and sinks."""

from .readers import (DRIVER_TABLES, json_array_elements, json_records_to_df, parse_json_column, read_csv, read_json_array,
                      read_json_lines, read_listing_json, read_lookup, read_table, register_view, rows_to_df)
from .sinks import load_pipeline, save_model, write_batches, write_csv, write_json

__all__ = [
    "DRIVER_TABLES", "json_array_elements", "json_records_to_df", "load_pipeline", "parse_json_column", "read_csv",
    "read_json_array", "read_json_lines", "read_listing_json", "read_lookup", "read_table", "register_view", "rows_to_df",
    "save_model", "write_batches", "write_csv", "write_json",
]
