"""Shared pieces of the text operators: words, tables, durable intermediates."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone, as the contracts ask; `lower` would change other letters too."""
    return F.translate(c, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master may fall back on a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "local-cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must be set on a cluster")
        at = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="tideline-")
        shared_dir.own = at
    return at.rstrip("/")


def _folder(spark: SparkSession) -> str:
    """Where this application's tables are: they are read as long as a result may be, and removed when its driver ends."""
    path = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    if path not in _made:
        _made.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone by now
        return


_made: set[str] = set()


def durable(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and any executor may be lost."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._path = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes tables that `durable` wrote, once nothing that is still to run reads them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks_for(df: DataFrame, most: int = 64 << 20, top: int = 100_000) -> int:
    """Into how many chunks a table is dealt whose chunks are each worked on whole: as many as there are shuffle partitions,
    or more where Spark's estimate of its size asks for it, so that chunks do not grow with the table. Spark gives a huge
    number where it knows no size; that counts for nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(df.sparkSession), min(top, size // most) if size < 1 << 55 else 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that clash with no column of df."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        x = f"__{n}"
        while x.lower() in have:
            x += "_"
        out.append(x)
    return out
