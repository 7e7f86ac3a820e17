"""Readers and writers."""

from tabulon.sources.files import read_any, read_csv, read_json, read_parquet, read_tsv
from tabulon.sources.html import extract_data_links, extract_html_tables
from tabulon.sources.sqlite import read_sqlite
from tabulon.sources.writers import json_safe, write_csv, write_report_tables
from tabulon.sources.xlsx import read_xlsx

__all__ = [
    "extract_data_links",
    "extract_html_tables",
    "json_safe",
    "read_any",
    "read_csv",
    "read_json",
    "read_parquet",
    "read_sqlite",
    "read_tsv",
    "read_xlsx",
    "write_csv",
    "write_report_tables",
]
