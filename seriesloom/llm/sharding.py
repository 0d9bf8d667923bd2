"""Contiguous shards of near-equal bytes by global prefix sums.

Rows are range-partitioned by a hash of the text, then id, so equal texts lie together. Every partition reports its total, the (few) totals are summed
up in order, and a window inside each partition adds the local prefix. No task ever sees more than
one partition; the only global table has one row per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 8


def byte_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal rows, in the order of the text's MD5 and then ``id_col``, to ``shards`` contiguous shards of near-equal bytes.

    Size: UTF-8 bytes of the text plus 1; a null text counts 0 bytes and has the CRC of nothing.
    A row goes to the shard in which the middle of its byte range lies, so a shard misses its
    target by less than one row at either end. Equal texts (null ones are empty) are a run, which is cut only where a shard ends; null
    ids come first in it. Full repeats are interchangeable, so they may be cut anywhere. Very long texts are one row like any other.
    An empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    c = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(c), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(c, F.lit("")).cast("binary")).alias("text_crc32"),
        F.md5(F.coalesce(c, F.lit("")).cast("binary")).alias("__md5"),
        F.monotonically_increasing_id().alias("__salt"),
    )
    # The salt splits a repeated row over several partitions, as the id does a text that many rows have.
    dealt = rows.repartitionByRange("__md5", "doc_id", "__salt").withColumn("__part", F.spark_partition_id())
    dealt = common.materialize(dealt, "byte-shards")
    totals = dealt.groupBy("__part").agg(F.sum("size").alias("__bytes"), F.count("*").alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = totals.select(  # one row per partition
        "__part",
        F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__bytes_before"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows_before"),
        F.sum("__bytes").over(everything).alias("__all"),
    )
    inside = Window.partitionBy("__part").orderBy("__md5", "doc_id", "__salt")
    placed = (
        dealt.withColumn("__row", F.row_number().over(inside) - 1)
        .withColumn("__upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .join(F.broadcast(totals), "__part")  # as many rows as partitions
        .withColumn("__at", F.col("__bytes_before") + F.col("__upto") - F.col("size"))
        .withColumn("__row", F.col("__row") + F.col("__rows_before"))
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, ((2 * __at + size) * {shards}) div (2 * __all)) as int)"))
    )
    first = placed.groupBy("shard").agg(F.min("__row").alias("__first"))  # at most ``shards`` rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("__row") - F.col("__first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(common.table(spark, sf_dir, "documents"))


#: CRC-32 by its polynomial (fixed value 0xEDB88320 = 3988292384), eight steps a byte, over the bytes as hexadecimal digits.
OP3_SQL = """
with t256 as (select list(c order by i) as tab from (select i, list_reduce(list_prepend(cast(i as bigint), range(0, 8)), lambda a, b: case when a % 2 = 1 then xor(cast(3988292384 as bigint), a >> 1) else a >> 1 end) as c from range(0, 256) r(i))),
d as (select doc_id, coalesce(text, '') as x, case when text is null then 0 else octet_length(encode(text)) end + 1 as size from documents),
p as (select doc_id, x, size, md5(x) as h from d),
b as (select doc_id, size, h, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda y: cast((strpos('0123456789ABCDEF', y[1]) - 1) * 16 + strpos('0123456789ABCDEF', y[2]) - 1 as bigint)) as bytes from p),
c as (select doc_id, size, h, xor(cast(4294967295 as bigint), list_reduce(list_prepend(cast(4294967295 as bigint), bytes), lambda a, y: xor(a >> 8, tab[1 + (xor(a, y) & 255)]))) as crc from b, t256),
o as (select *, sum(size) over (order by h, doc_id nulls first rows between unbounded preceding and current row) as upto, sum(size) over () as total from c),
s as (select *, least(7, ((2 * (upto - size) + size) * 8) // (2 * total)) as shard from o)
select doc_id, cast(size as bigint) as size, cast(crc as bigint) as text_crc32, 'bytes' as law, cast(shard as int) as shard,
  row_number() over (partition by shard order by h, doc_id nulls first) - 1 as slot, cast(null as int) as grown_shard from s
"""
