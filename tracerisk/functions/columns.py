"""Column expressions shared by the operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracerisk.schema import EVENT_NO, EVENT_TYPES

MICROS = 1_000_000


def seconds(micros: Column) -> Column:
    """Microseconds to seconds."""
    return micros / F.lit(float(MICROS))


def bucket(micros: Column, width_sec: int) -> Column:
    """Number of the tumbling window of `width_sec` seconds that holds a time."""
    width = F.lit(width_sec * MICROS).cast("long")
    # Whole numbers throughout: a double is exact only up to 2^53. pmod rounds down below 0 as well.
    return F.call_function("div", micros - F.pmod(micros, width), width)


def event_label(code: Column) -> Column:
    """Name of an event code; null for an unknown code."""
    pairs = [F.lit(v) for item in EVENT_TYPES.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), code)


def last_known(col: Column) -> Column:
    """Aggregate over a task: value at the last event where it is not null."""
    return F.max_by(col, F.when(col.isNotNull(), F.col(EVENT_NO)))


def first_known(col: Column) -> Column:
    """Aggregate over a task: value at the first event where it is not null."""
    return F.min_by(col, F.when(col.isNotNull(), F.col(EVENT_NO)))


def at_first(col: Column, where: Column) -> Column:
    """Aggregate over a task: value at the first event that meets a condition."""
    return F.min_by(col, F.when(where, F.col(EVENT_NO)))


def stable_hash(seed: int, *cols: str) -> Column:
    """Seeded hexadecimal digest: the pseudo-random order of splits and folds."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))))
