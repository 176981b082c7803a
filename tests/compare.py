"""Side-by-side run of a query in Spark and of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(row[i] for i in order) for row in rows),
        key=lambda row: tuple((v is None, str(type(v)) if v is None else "", v or 0)
                              if not isinstance(v, str) else (False, "", v) for v in row),
    )


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs between the two results; empty if nothing does."""
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    theirs = relation.fetchall()
    ours = [tuple(r) for r in spark_df.collect()]
    if sorted(spark_df.columns) != sorted(names):
        return [f"columns {sorted(spark_df.columns)} and {sorted(names)}"]
    if len(ours) != len(theirs):
        return [f"{len(ours)} and {len(theirs)} rows"]
    types = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    duck = {d[0]: str(d[1]) for d in relation.description}
    out = []
    for name, kind in types.items():
        expected = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                    "boolean": "BOOLEAN"}[kind]
        if duck[name] != expected:
            out.append(f"type of {name}: {kind} and {duck[name]}")
    for a, b in zip(_rows(spark_df.columns, ours), _rows(names, theirs)):
        if a != b and not all(_same(x, y) for x, y in zip(a, b)):
            out.append(f"{a} and {b}")
            if len(out) > 3:
                break
    return out


def _same(x, y) -> bool:
    if isinstance(x, float) and isinstance(y, float):
        return x == y or (math.isnan(x) and math.isnan(y))
    return x == y and type(x) is type(y)
