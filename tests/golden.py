"""The hand-made trace of FIXTURES.md, section 3, in file order."""

from tracerisk.schema import SEQ, TRACE_SCHEMA

# seconds, job, task, machine, event, user, class, priority, cpu, memory, disk, different machine
ROWS = [
    (0, 1, 0, None, 0, "u1", 2, 5, 0.10, 0.20, 0.01, 0),
    (10, 1, 0, 500, 1, "u1", 2, 5, None, None, None, None),
    (100, 1, 0, 500, 4, None, 2, 5, None, None, None, None),
    (5, 1, 1, None, 0, "u1", 2, 9, 0.30, 0.10, 0.02, 1),
    (20, 1, 1, 500, 1, "u1", 2, 9, 0.30, 0.10, 0.02, 1),
    (50, 1, 1, 500, 3, "u1", 2, 9, None, None, None, None),
    (50, 1, 1, 500, 3, "u1", 2, 9, None, None, None, None),
    (30, 2, 0, 500, 1, "u2", 0, 2, None, None, None, None),
    (200, 2, 0, 500, 0, "u2", 0, 2, 0.4, 0.4, 0.04, 0),
    (400, 2, 0, 501, 5, "u2", 0, 2, None, None, None, None),
    (70, 3, 0, 501, 1, "u3", 1, 4, 0.2, 0.2, 0.02, 0),
    (130, 3, 0, 501, 2, "u3", 1, 4, None, None, None, None),
    (210, 3, 0, 501, 1, "u3", 1, 1, None, None, None, None),
    (900, 3, 0, 501, 4, "u3", 1, 1, None, None, None, None),
    (1, 4, 0, None, 0, "u4", 0, 0, 0.5, 0.5, 0.05, 0),
    (310, None, 0, 500, 1, "u5", 0, 0, 0.5, 0.5, 0.05, 0),
]

# label, final machine, user, cpu, delay, duration, concurrency, overcommit, gap, flag
EXPECTED = {
    (1, 0): (0, 500, "u1", 0.1, 10, 90, 3, 0.5, 4, 1),
    (1, 1): (1, 500, "u1", 0.3, 15, 30, 3, 1.5, 0, 0),
    (2, 0): (1, 501, "u2", 0.4, None, 370, 3, None, 7, 1),
    (3, 0): (0, 501, "u3", 0.2, None, 830, 2, 1.0, 1, 0),
}


def raw_trace(spark):
    rows = [(t * 1_000_000, None, *rest, i) for i, (t, *rest) in enumerate(ROWS)]
    schema = TRACE_SCHEMA.simpleString()[len("struct<") : -1].replace(":", " ")
    fields = ", ".join(
        f"`{name}` {kind}" for name, kind in (f.split(" ") for f in schema.split(","))
    )
    return spark.createDataFrame(rows, f"{fields}, {SEQ} long")
