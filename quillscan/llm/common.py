"""What the corpus operators share: the shared folder, shipping of code, word patterns."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space (U+0009 to U+000D, U+0020).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillscan-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: Spark's setting by which the shuffle files of a query go as soon as it is done.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _where(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    The table survives the loss of executors, and its size is known to the
    planner afterwards, which is what decides about broadcasts. The shuffle
    files of the write go at its end; the table goes with drop(), or when the
    session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillscan/{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    system, at = _where(spark, path)
    system.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in tables:
        system, at = _where(df.sparkSession, df._stashed)
        system.delete(at, True)


def sampled(df: DataFrame, by: Column, rows: int) -> DataFrame:
    """At most `rows` rows: those with the smallest values of by, a 64-bit hash, one row for each value.

    The rows are counted first, and a threshold on the hash that about twice as
    many pass is part of the scan, so no task sorts or sends more than its share
    of these, and copies of one row merge before the shuffle.
    """
    n, most = df.count(), 2 * rows + 100
    df = df.withColumn("_hash", by)
    if n > most:
        df = df.where(F.col("_hash") < (most << 64) // n - (1 << 63))
    return df.dropDuplicates(["_hash"]).orderBy("_hash").limit(rows).drop("_hash")


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once for a context."""
    sc = spark.sparkContext
    if getattr(sc, "_quillscan_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    to = os.path.join(tempfile.mkdtemp(prefix="quillscan-code-"), "quillscan.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        z.write(top / "__init__.py", "quillscan/__init__.py")
        for p in sorted((top / "llm").glob("*.py")):
            z.write(p, f"quillscan/llm/{p.name}")
    sc.addPyFile(to)
    sc._quillscan_shipped = True


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
