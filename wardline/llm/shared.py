"""What several corpus operators need: shared storage, size estimates, column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but these (space, tab, LF, VT, FF, CR).
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (one-process tests) a temporary folder of this machine is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    return _local.setdefault(app, tempfile.mkdtemp(prefix="wardline-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet to the shared folder and reads it back.

    The copy outlives lost executors, unlike cached blocks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Limits the rows of an Arrow batch: texts are long, and a worker holds whole batches. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, rows)


def input_bytes(df: DataFrame, text: str | None = None) -> int:
    """Estimated bytes of ``df`` from the optimizer's statistics, which need no scan.

    Where the plan has no usable estimate, ``text`` is summed instead.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 50:
        return size
    if text is None:
        return 1 << 30
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def groups_for(size: int, each: int, least: int = 128) -> int:
    """How many groups of about ``each`` bytes an input of ``size`` bytes is dealt into."""
    return max(least, -(-size // each))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, though a lambda uses it for every element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP, -1), lambda w: w != "")
