"""Packing of token sequences by cutting-stock column generation.

Documents are cut into full pieces of ``CAPACITY`` tokens and one rest. Pieces are counted by length
class (multiples of ``GRAIN``). A linear program over patterns of classes is solved by revised
simplex; a knapsack dynamic program prices new columns. Its size depends on the number of classes
alone, so it runs on the driver for any corpus. Rounded-down patterns plus a best-fit packing of what
is left make an exact plan. Pieces are ranked within their class by prefix counts over partitions
(never in one task), and the rank names a place in the plan.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
GRAIN = 8
END_ID = 1
WORDS_KEPT = 400_000  # words whose ids a worker remembers; the memory starts anew beyond

_PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


class WordIds(dict):
    """Ids of blank-separated words as packed little-endian unsigned 32-bit integers, kept as they are met.

    The tokenizer drops white space and never merges across it, so a text's ids are its words' ids
    in a row. Words of Latin letters take the tokenizer's own steps one by one (lower case, splitting,
    byte alphabet, merges); all others and those with marks of special tokens go through it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize
        self.parts: dict[str, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.alphabet = {b: chr(b if b in printable else next(others)) for b in range(256)}
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.plain = re.compile("[!-~¡-¬®-įı-ɏ]*").fullmatch

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if len(text) > 200 or "<|" in text or not self.plain(text) or not unicodedata.is_normalized("NFC", text):
            out = array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        else:
            out = b"".join([self.parts.get(p) or self.part(p) for p in self.split(text.lower())])
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = out
        return out

    def part(self, part: str) -> bytes:
        out = array("I", [t.id for t in self.merge("".join([self.alphabet[b] for b in part.encode()]))]).tobytes()
        if len(self.parts) >= WORDS_KEPT:
            self.parts.clear()
        self.parts[part] = out
        return out

    def ids(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, text.split())) if text else b""


_kept: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per worker process and file."""
    if path not in _kept:
        _kept[path] = WordIds(path)
    return _kept[path]


def pieces(docs: DataFrame, keep: list[str], tokenizer: str, capacity: int = CAPACITY, text_col: str = "text") -> DataFrame:
    """``keep`` columns and start, length, CRC of each piece of a document; a null or empty text has the end id alone."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", " + _PIECES
    end = array("I", [END_ID]).tobytes()
    step = 4 * capacity

    def run(batches):
        words = word_ids(tokenizer)
        for batch in batches:
            row, start, length, crc, total = (array("q") for _ in range(5))
            for i, text in enumerate(common.binary_values(batch.column("__text"))):
                ids = memoryview(words.ids(text) + end)
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(ids) // 4)
            kept = batch.select(batch.schema.names[:-1]).take(pa.array(np.frombuffer(row, np.int64) if row else np.empty(0, np.int64)))
            cols = [pa.array(np.array(x, np.int64)) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *cols], [*kept.schema.names, "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def knapsack(value: np.ndarray, width: int) -> tuple[float, np.ndarray]:
    """Most value of items (item i has size i + 1) in ``width``, and how many of each."""
    best, choice = np.zeros(width + 1), np.full(width + 1, -1)
    for w in range(1, width + 1):
        worth = value[:w] + best[w - 1 :: -1][:w]
        i = int(worth.argmax())
        if worth[i] > best[w - 1] + 1e-12:
            best[w], choice[w] = worth[i], i
        else:
            best[w] = best[w - 1]
    counts, w = np.zeros(len(value), np.int64), width
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            counts[choice[w]] += 1
            w -= choice[w] + 1
    return float(best[width]), counts


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivoting, without threads of a linear algebra library beside the JVM."""
    n = len(matrix)
    a = np.hstack([matrix, np.eye(n)])
    for i in range(n):
        j = i + int(np.abs(a[i:, i]).argmax())
        a[[i, j]] = a[[j, i]]
        a[i] /= a[i, i]
        factor = a[:, i].copy()
        factor[i] = 0
        a -= np.multiply.outer(factor, a[i])
    return a[:, n:]


def cutting_stock(demand: np.ndarray, max_rounds: int = 4000, gap: float = 2e-4) -> list[tuple[int, np.ndarray]]:
    """Patterns with their whole-number uses that meet ``demand`` exactly (class i takes i + 1 of ``len(demand)`` units).

    The program is solved to half a sequence or to ``gap``, whichever is more.
    """
    width = len(demand)
    used = np.flatnonzero(demand)
    if not len(used):
        return []
    n = demand[used].astype(float)
    patterns = np.diag(width // (used + 1)).astype(float)  # columns of the basis
    inverse = np.diag(1 / np.diag(patterns))
    x = inverse @ n
    for k in range(max_rounds):
        dual = inverse.sum(axis=0)  # each pattern costs one sequence
        value = np.zeros(width)
        value[used] = np.maximum(dual, 0)
        worth, counts = knapsack(value, width)
        total = float(x.sum())
        if total - total / max(worth, 1.0) < max(0.5, gap * total):  # the dual scaled down is a lower bound
            break
        entering = counts[used].astype(float)
        step = inverse @ entering
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        patterns[:, out] = entering
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        if k % 256 == 255:  # against rounding errors
            inverse = inverted(patterns)
        x = np.maximum(inverse @ n, 0)
    left = demand.copy()
    plan: dict[tuple[int, ...], int] = {}

    def use(counts: np.ndarray, times: int) -> None:
        plan[key] = plan.get(key := tuple(counts.tolist()), 0) + times

    for j in np.argsort(-x):
        counts = np.zeros(width, np.int64)
        counts[used] = np.rint(patterns[:, j]).astype(np.int64)
        has = counts > 0
        times = min(int(x[j] + 1e-7), int((left[has] // counts[has]).min())) if has.any() else 0
        if times > 0:
            left -= times * counts
            use(counts, times)
    while left.any():  # at most what the fractions hold: bounded by the number of classes
        counts, room = np.zeros(width, np.int64), width
        while room and len(fit := np.flatnonzero(left[:room])):
            i = int(fit[-1])
            take = min(int(left[i]), room // (i + 1))
            counts[i] += take
            left[i] -= take
            room -= take * (i + 1)
        has = counts > 0
        more = int((left[has] // counts[has]).min())
        left -= more * counts
        use(counts, 1 + more)
    return [(times, np.array(counts)) for counts, times in plan.items()]


def places(spark: SparkSession, plan: list[tuple[int, np.ndarray]]) -> DataFrame:
    """cls, rank interval, pieces of the class in a sequence, first sequence: a few rows per pattern."""
    rows, upto, sequence = [], {}, 0
    for times, counts in plan:
        for i in np.flatnonzero(counts).tolist():
            a = int(counts[i])
            rows.append((i + 1, upto.get(i, 0), upto.get(i, 0) + a * times, a, sequence))
            upto[i] = upto.get(i, 0) + a * times
        sequence += times
    return spark.createDataFrame(rows, "cls int, first long, beyond long, each long, base long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, grain: int = GRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: every piece in one place of one sequence.

    Null and empty texts give one piece with the end id. Repeated rows are packed each; a null id is
    carried along. An empty table gives an empty result. Other columns are ignored. Very long texts are cut like any other; pieces of
    one length are interchangeable, so any of them may take any place of their class.
    """
    spark = docs.sparkSession
    cut = pieces(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], tokenizer, capacity)
    cut = cut.withColumn("cls", F.ceil(F.col("length") / grain).cast("int")).withColumn("__part", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    cut = common.materialize(cut, "pieces")
    counts = common.materialize(cut.groupBy("cls", "__part").agg(F.count("*").alias("n")), "piece-counts")
    demand = np.zeros(capacity // grain, np.int64)
    for cls, n in counts.groupBy("cls").agg(F.sum("n")).collect():  # one row per class
        demand[cls - 1] = n
    plan = places(spark, cutting_stock(demand))
    before = Window.partitionBy("cls").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    base = counts.select("cls", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("cls", "__part").orderBy("__i")
    ranked = cut.withColumn("__rank", F.row_number().over(inside) - 1).join(base, ["cls", "__part"]).withColumn("__rank", F.col("__rank") + F.col("__base"))
    at = (F.col("__rank") >= F.col("first")) & (F.col("__rank") < F.col("beyond"))
    placed = ranked.join(F.broadcast(plan.withColumnRenamed("cls", "__cls")), (F.col("cls") == F.col("__cls")) & at)  # bounded by the classes
    placed = placed.withColumn("sequence_id", F.expr("base + (__rank - first) div each"))
    along = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "__i").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(along), F.lit(0)).cast("long")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), default_tokenizer())
