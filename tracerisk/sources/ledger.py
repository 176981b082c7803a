"""Loading a growing trace part by part: a ledger tells what has been loaded."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tracerisk.sources.trace import listed_parts, load_parts

LEDGER = "part string, path string, no long, length long, modified timestamp, digest string, n_rows long, load long"


def _digests(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, int]]:
    """Digest and number of the lines of every part, whatever order they are read in."""
    hashed = F.sum(F.xxhash64("value").cast("decimal(38,0)"))
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("part"))
    counted = lines.groupBy("part").agg(F.count("*").alias("n"), hashed.alias("sum"))
    # One row per part: no longer than the listing.
    return {r["part"]: (f"{r['n']}:{r['sum']}", r["n"]) for r in counted.collect()}


def read_ledger(spark: SparkSession, table: str) -> DataFrame:
    """The parts loaded so far, with name, path, number, size, digest, rows and the load that brought them."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{table}/ledger/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def load_new_parts(
    spark: SparkSession, folder: str, table: str, n_parts: int | None = None, strict: bool = True
) -> DataFrame:
    """Load the parts of `folder` that `table` doesn't hold yet and return all rows of the table.

    The ledger keeps name, size, time and a digest of the lines of every loaded part. A second
    run parses new parts only. A loaded part whose size has changed, or whose time
    and lines have, is an error: its rows may be in tables derived from it. A part that is gone stays loaded.

    New parts are numbered on in name order, so `ingest_seq` follows the order of loading.
    A load writes its rows, then its page of the ledger; rows without one are those of a
    load that failed, are not read, and are replaced by the next.
    """
    known = {r["part"]: r for r in read_ledger(spark, table).collect()}
    found = listed_parts(spark, folder, n_parts)
    touched = []
    for r in found:
        old = known.get(r["part"])
        if old is not None and r["length"] != old["length"]:
            raise ValueError(f"{r['part']} has changed since it was loaded: {old['length']} bytes, now {r['length']}")
        if old is not None and r["modified"] != old["modified"]:
            touched.append(r)
    again = _digests(spark, [r["path"] for r in touched]) if touched else {}
    for r in touched:
        if again.get(r["uri"], ("0:None", 0))[0] != known[r["part"]]["digest"]:
            raise ValueError(f"{r['part']} has changed since it was loaded")

    new = [r for r in found if r["part"] not in known]
    load = max((r["load"] for r in known.values()), default=-1) + 1
    if new:
        start = max((r["no"] for r in known.values()), default=-1) + 1
        rows = load_parts(spark, [(r["path"], r["uri"]) for r in new], strict, start)
        rows.write.mode("overwrite").parquet(f"{table}/rows/{load}")
        digests = _digests(spark, [r["path"] for r in new])
        page = [
            (r["part"], r["path"], start + i, r["length"], r["modified"], *digests.get(r["uri"], ("0:None", 0)), load)
            for i, r in enumerate(new)
        ]
        spark.createDataFrame(page, LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{table}/ledger/{load}")
    loads = sorted({r["load"] for r in known.values()} | ({load} if new else set()))
    return spark.read.parquet(*[f"{table}/rows/{i}" for i in loads])
