from tracerisk.sources.shared import materialize, release
from tracerisk.sources.tables import (
    load_model,
    read_table,
    save_model,
    write_result,
    write_table,
)
from tracerisk.sources.trace import list_parts, load_trace_parts, rejected_rows, rows_per_part

__all__ = [
    "list_parts",
    "load_model",
    "load_trace_parts",
    "materialize",
    "read_table",
    "rejected_rows",
    "release",
    "rows_per_part",
    "save_model",
    "write_result",
    "write_table",
]
