import pytest
from pyspark.sql import functions as F

from tracerisk.schema import COLUMNS, SEQ
from tracerisk.sources import (
    list_parts,
    load_trace_parts,
    materialize,
    read_table,
    rejected_rows,
    rows_per_part,
    write_result,
    write_table,
)


@pytest.fixture(scope="module")
def folder(golden_raw, tmp_path_factory):
    """The small trace in three parts, one of them gzipped, and a file of another kind."""
    import gzip

    path = tmp_path_factory.mktemp("trace")
    rows = [
        ",".join("" if r[c] is None else str(r[c]) for c in COLUMNS)
        for r in golden_raw.orderBy(SEQ).collect()
    ]
    (path / "part-00000.csv").write_text("\n".join(rows[:6]) + "\n")
    (path / "part-00001.csv.gz").write_bytes(gzip.compress(("\n".join(rows[6:11]) + "\n").encode()))
    (path / "part-00002.csv").write_text("\n".join(rows[11:]) + "\n")
    (path / "notes.txt").write_text("not a part")
    return str(path)


def test_parts_in_name_order(spark, folder):
    names = [p.rsplit("/", 1)[1] for p in list_parts(spark, folder, None)]
    assert names == ["part-00000.csv", "part-00001.csv.gz", "part-00002.csv"]
    assert len(list_parts(spark, folder, 2)) == 2


def test_no_parts(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        list_parts(spark, str(tmp_path))


def test_load_keeps_rows_and_order(spark, folder, golden_raw):
    loaded = load_trace_parts(spark, folder)
    assert loaded.filter(F.col(SEQ).isNull()).count() == 0
    expected = [tuple(r) for r in golden_raw.orderBy(SEQ).select(*COLUMNS).collect()]
    assert [tuple(r) for r in loaded.orderBy(SEQ).select(*COLUMNS).collect()] == expected
    assert load_trace_parts(spark, folder, 1).count() == 6


def test_order_across_splits_of_one_file(spark, tmp_path):
    """A file cut into many splits keeps its order."""
    lines = [f"{i},,{i % 5},0,,0,u,0,0,0.1,0.1,0.1,0" for i in range(60_000)]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text("\n".join(lines[:10]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        loaded = load_trace_parts(spark, str(tmp_path))
        assert loaded.rdd.getNumPartitions() > 1
        times = [r[0] for r in loaded.orderBy(SEQ).select("timestamp").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert times == [*range(60_000), *range(10)]


def test_rows_per_part(spark, folder):
    rows = {r["part"]: r["n_rows"] for r in rows_per_part(spark, folder).collect()}
    assert rows == {"part-00000.csv": 6, "part-00001.csv.gz": 5, "part-00002.csv": 5}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_table_roundtrip(spark, golden_raw, tmp_path, fmt):
    path = str(tmp_path / fmt)
    write_table(golden_raw, path, fmt)
    again = read_table(spark, path, fmt, golden_raw.schema)
    assert sorted(map(str, again.collect())) == sorted(map(str, golden_raw.collect()))


def test_csv_table_needs_schema(spark, tmp_path):
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path), "csv")


def test_result_is_one_file(golden_raw, tmp_path):
    write_result(golden_raw.select("job_id"), str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("*.csv"))) == 1


def test_materialize_keeps_schema(golden_raw):
    assert materialize(golden_raw).schema.names == golden_raw.schema.names


def test_folder_name_with_a_space(spark, tmp_path, golden_raw):
    folder = tmp_path / "my trace"
    golden_raw.select(*COLUMNS).coalesce(1).write.csv(str(folder))
    loaded = load_trace_parts(spark, str(folder))
    assert loaded.filter(F.col(SEQ).isNull()).count() == 0
    assert loaded.count() == golden_raw.count()


def test_bad_values_are_noticed(spark, tmp_path):
    good = "1,,2.0,0,5.0,0,u,0,0,NaN,0.1,,0"
    (tmp_path / "a.csv").write_text(f"{good}\n")
    row = load_trace_parts(spark, str(tmp_path)).first()
    assert (row.job_id, row.machine_id, row.cpu_requested, row.disk_requested) == (2, 5, None, None)
    assert rejected_rows(spark, str(tmp_path)).count() == 0
    for bad in ("1,,x,0,5,0,u,0,0,0,0,0,0", "1,,2.5,0,5,0,u,0,0,0,0,0,0", f"{good},7,8", "1,2"):
        (tmp_path / "a.csv").write_text(f"{good}\n{bad}\n")
        with pytest.raises(Exception):
            load_trace_parts(spark, str(tmp_path)).collect()
        assert load_trace_parts(spark, str(tmp_path), strict=False).count() == 2
        assert rejected_rows(spark, str(tmp_path)).count() == 1


def test_all_parts_by_default(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"p{i:02}.csv").write_text("1,,2,0,5,0,u,0,0,0,0,0,0\n")
    assert load_trace_parts(spark, str(tmp_path)).count() == 12


SCRIPT = """
from pyspark.sql import SparkSession
from tracerisk.sources import materialize
from tracerisk.sources.shared import own_folder
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
materialize(spark.range(5))
print("FOLDER", own_folder(spark).removeprefix("file:"))
"""


def test_a_run_leaves_no_folder_behind(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    repo = str(Path(__file__).parents[1])
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, env=os.environ | {"PYTHONPATH": repo}, capture_output=True, text=True
    )
    folder = Path(done.stdout.split("FOLDER ")[1].strip())
    assert folder.parent.exists()
    assert not folder.exists()
