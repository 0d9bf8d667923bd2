"""Reading tables, cutting lineage in the shared folder, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are turned into Python objects at once.
SLICE = 256


#: Rows of an Arrow batch between the JVM and Python workers: bounds the memory of both.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session whose driver is its one executor may go without; it gets a temporary folder, once.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="seriesloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    Unlike ``checkpoint()`` it computes the plan a single time and keeps the columnar format.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what ``materialize`` has written, once nothing that is still to be computed reads it."""
    for t in tables:
        spark = t.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.scratch)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Stands for a null id in keys: it comes first, as nulls do. ``text_key`` tells the two apart.
NO_ID = -(1 << 63)


def id_key(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(NO_ID))


def text_key(id_col: Column, text: Column) -> Column:
    """64 bits that, beside the id, stand for a row: rows that repeat id and text have the same."""
    return F.xxhash64(F.coalesce(text, F.lit("")), id_col.isNull())


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def binary_values(column):
    """The values of an Arrow string or binary column as bytes (None for null), a slice at a time."""
    import pyarrow as pa

    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary())
    for at in range(0, len(column), SLICE):
        yield from column.slice(at, SLICE).to_pylist()


def row_key(df: DataFrame, name: str = "__row") -> DataFrame:
    """Number the rows of a *materialized or file-backed* table, so that repeated ids stay apart."""
    return df.withColumn(name, F.monotonically_increasing_id())
