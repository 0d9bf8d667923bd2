"""Adapters from tables to the long form of series: series_id, t (0, 1, ... in each series), v."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """Position is time: rows of a series in the order of ``order``, whose last column must break ties. Null values are left out."""
    w = Window.partitionBy(series).orderBy(*order)
    rows = rows.where(F.col(value).isNotNull() & F.col(series).isNotNull())
    return rows.select(F.col(series).alias("series_id"), (F.row_number().over(w) - 1).cast("long").alias("t"), F.col(value).cast("double").alias("v"))


def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value")


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per event type: sums by hour."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("value").alias("value"))
    return numbered(rows, "event_type", ["hour"], "value")


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series: total price by day."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("value"))
    return numbered(rows.withColumn("id", F.lit(0).cast("long")), "id", ["day"], "value")


def from_arrays(rows: DataFrame, series: str, values: str) -> DataFrame:
    """A row per series with its values in an array."""
    return rows.select(F.col(series).alias("series_id"), F.posexplode(values).alias("t", "v")).select("series_id", F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_arrays(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def csv_lines(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """A row per series: an id and a field of comma-joined numbers; with ``last``, its last so many."""
    rows = spark.read.csv(path, header=True).toDF("id", "data")
    values = F.transform(F.split("data", ","), lambda x: x.try_cast("double"))
    values = values if last is None else F.slice(values, F.greatest(F.size(values) - last + 1, F.lit(1)), last)
    return from_arrays(rows.select(F.col("id").cast("long").alias("id"), values.alias("values")), "id", "values")


def arrays(series: DataFrame) -> DataFrame:
    """series_id and values in order; one shuffle for all that follows.

    The number of partitions is given, so that adaptive planning doesn't join them by size: what follows
    costs far more by series than its bytes tell.
    """
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = series.repartition(parts, "series_id")
    return dealt.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("values"))
