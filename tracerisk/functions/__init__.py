from tracerisk.functions.columns import (
    at_first,
    bucket,
    event_label,
    first_known,
    last_known,
    seconds,
    stable_hash,
)
from tracerisk.functions.student import two_sided_p

__all__ = [
    "at_first",
    "bucket",
    "event_label",
    "first_known",
    "last_known",
    "seconds",
    "stable_hash",
    "two_sided_p",
]
