"""Shared helpers: tables kept in the cluster's folder, size-checked joins, salting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a single 8-byte id that may be broadcast; beyond it joins shuffle.
BROADCAST_IDS = 2_000_000
#: Partial keys that a hot join key is split into; a power of two.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without the setting, as in tests; it gets a private folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="codexmill-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Run ``df`` once and keep its rows as a table in the shared folder (survives lost executors).

    The table is small beside a checkpoint (columns, compressed), read only as far as its
    columns are used, and its size is known to the joins that follow.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._cut_path = path
    return kept


def discard(*cuts: DataFrame) -> None:
    """Delete tables that ``cut`` has kept, once nothing is to be read from them any more."""
    for df in cuts:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def arrow_rows(spark: SparkSession, rows: int = 256) -> None:
    """Small Arrow batches bound a Python worker's memory when texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def small_or_shuffled(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """Mark a table of ids for broadcast only if it is counted to be within ``limit``."""
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids


def salted(column: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(salts)).cast("int")


def spread(df: DataFrame, name: str = "salt", salts: int = SALTS) -> DataFrame:
    """One copy of each row per salt: the other side of a join on (key, salt)."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def first_rows(df: DataFrame, by: list[str], order: list, n: int, salt_on: str) -> DataFrame:
    """The first n rows of each group: first of each salted part, then of what is left.

    A group's last task reads SALTS * n rows at most, whatever the group's size.
    """
    part = F.pmod(F.xxhash64(F.lit(8), F.col(salt_on)), F.lit(SALTS))
    parts, whole = (Window.partitionBy(*by, *extra).orderBy(*order) for extra in (["__cm_salt"], []))
    few = df.withColumn("__cm_salt", part).withColumn("__cm_n", F.row_number().over(parts)).filter(F.col("__cm_n") <= n)
    return few.withColumn("__cm_n", F.row_number().over(whole)).filter(F.col("__cm_n") <= n).drop("__cm_salt", "__cm_n")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
