from slopefield.sources.listing import list_inputs
from slopefield.sources.local import local_rows
from slopefield.sources.run_logs import (
    invalid_run_records,
    read_run_metadata,
    read_run_records,
    read_scaling_log,
)
from slopefield.sources.tables import (
    RawTable,
    detect_separator,
    guess_label,
    read_labeled,
    read_table,
    undecodable_lines,
    usable_columns,
)

__all__ = [
    "RawTable",
    "detect_separator",
    "guess_label",
    "invalid_run_records",
    "list_inputs",
    "local_rows",
    "read_labeled",
    "read_run_metadata",
    "read_run_records",
    "read_scaling_log",
    "read_table",
    "undecodable_lines",
    "usable_columns",
]
