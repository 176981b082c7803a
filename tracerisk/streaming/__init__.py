from tracerisk.streaming.windows import (
    read_stream,
    run_to_end,
    stream_schedules_per_slot,
    stream_waiting_priority,
    write_end_mark,
)

__all__ = [
    "read_stream",
    "run_to_end",
    "stream_schedules_per_slot",
    "stream_waiting_priority",
    "write_end_mark",
]
