"""Benchmark decontamination by winnowing.

A fingerprint is the least hash of the k-grams in a window of ``w`` consecutive ones, the last of equal ones; two texts
that share ``k + w - 1`` words share the fingerprint chosen there, at the same place of the shared words. The k-gram length and window are
set so that this guarantee meets the length of a wanted span exactly. Items too short for a window have the hash of all their words.

Fingerprints of documents and items meet in a join. Each hit names a diagonal (a shift of the document against the item), along which it
is extended to maximal runs of equal words, so no result rests on a hash. What is sent to all tasks is one bitmap of ``FILTER_BITS`` bits, whatever the
size of the benchmark: it spares fingerprints that no item has from the join, and loses none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import PUNCTUATION, mixed, slices
from .words import words_of as hashed_words

SPAN = 8  # words of a window
K, W = 4, 5  # words of a fingerprinted gram, grams of a winnowing window: K + W - 1 = SPAN
MIN_ITEMS = 2  # items from which a document is contaminated
FILTER_BITS = 25  # the bitmap has two to the power of this: 4 MB

#: Everything in ASCII but digits and letters becomes a blank; A-Z become a-z.
_FOLD = bytes(32 if PUNCTUATION[b] else bytes([b]).lower()[0] for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def grams(h: np.ndarray, left: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on, greatest where its text has fewer ``left``."""
    out = np.full(len(h), n, np.uint64)
    for j in range(n):
        on = np.flatnonzero(left > j)
        out[on] = (out[on] + h[on + j]) * np.uint64(0x2127599BF4325C37)
    return np.where(left >= n, mixed(out), ~np.uint64(0))


def winnowed(h: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of texts whose words' hashes lie on end, and the words where they begin. ``left``: how many words of its text there are from each on."""
    begins = np.flatnonzero(left >= SPAN)
    g = grams(h, left, K)
    best, at = g[begins], begins.copy()
    for j in range(1, W):
        x = g[begins + j]
        later = x <= best
        best, at = np.where(later, x, best), np.where(later, begins + j, at)
    at = np.unique(at)
    return g[at], at


def _prepared(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """text, hash, place in its text, and words left of each word; words of each text."""
    starts, h, _ = hashed_words(data, begins, PUNCTUATION)
    text = np.searchsorted(begins, starts, "right") - 1
    size = np.bincount(text, minlength=len(begins))
    first = np.cumsum(size) - size
    place = np.arange(len(h)) - first[text]
    return text, h, place, size[text] - place, size


def item_prints(items: DataFrame) -> DataFrame:
    """tid, n (words of a window), fp and pos of the fingerprints of ``items`` (tid, text)."""

    def run(batches):
        for batch in batches:
            for a, _, data, begins in slices(batch.column("text")):
                text, h, place, left, size = _prepared(data, begins)
                fp, at = winnowed(h, left)
                n = np.full(len(at), SPAN)
                short = np.flatnonzero((place == 0) & (left < SPAN))
                for k in np.unique(left[short]).tolist():
                    own = short[left[short] == k]
                    fp, at, n = np.r_[fp, grams(h, left, k)[own]], np.r_[at, own], np.r_[n, np.full(len(own), k)]
                tid = batch.column("tid").take(pa.array(text[at] + a, pa.int64()))
                yield pa.RecordBatch.from_arrays([tid, pa.array(n.astype(np.int32)), pa.array(fp.view(np.int64)), pa.array(place[at].astype(np.int32))], ["tid", "n", "fp", "pos"])

    return items.mapInArrow(run, "tid long, n int, fp long, pos int")


def bitmap(prints: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """``2 ** bits`` bits, those of the leading bits of the fingerprints set. Bounded, so it may pass through the driver."""
    place = F.shiftrightunsigned("fp", 64 - bits)
    words = prints.select(F.shiftrightunsigned(place, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most 2 ** (bits - 6) rows
    out = np.zeros(max(1, 1 << (bits - 6)), np.uint64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out


def doc_prints(docs: DataFrame, keep: list[str], filter_var, lengths: list[int], bits: int, text_col: str = "text") -> DataFrame:
    """``keep``, __row (a number of its own), n_words, hits (fp, pos) that pass the filter, and of rows with any the text."""
    kept = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]) + (", " if keep else "") + "__row long, n_words long, hits array<struct<fp: long, pos: int>>, __text string"

    def run(batches):
        known, no = filter_var.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b, data, begins in slices(batch.column(batch.num_columns - 1)):
                text, h, place, left, size = _prepared(data, begins)
                fps, at = winnowed(h, left)
                for n in lengths:
                    own = np.flatnonzero(left >= n)
                    fps, at = np.r_[fps, grams(h, left, n)[own]], np.r_[at, own]
                bit = fps >> np.uint64(64 - bits)
                ok = (known[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
                fps, at = fps[ok], at[ok]
                by = np.argsort(text[at], kind="stable")
                fps, at = fps[by], at[by]
                ends = np.searchsorted(text[at], np.arange(b - a + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(fps.view(np.int64)), pa.array(place[at].astype(np.int32))], ["fp", "pos"])
                part = batch.slice(a, b - a)
                texts = part.column(part.num_columns - 1).take(pa.array(np.arange(b - a), mask=np.diff(ends) == 0))
                cols = [*part.columns[:-1], pa.array(np.arange(no, no + b - a)), pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pairs), texts]
                no += b - a
                yield pa.RecordBatch.from_arrays(cols, [*part.schema.names[:-1], "__row", "n_words", "hits", "__text"])

    return kept.mapInArrow(run, schema)


def runs_on(doc: np.ndarray, item: np.ndarray, shifts: list[int]) -> list[tuple[int, int]]:
    """Maximal runs (places in the document) of equal words along each shift of the document against the item, of a window or more."""
    least, out = min(SPAN, len(item)), []
    for s in shifts:
        a, b = max(0, s), min(len(doc), len(item) + s)
        same = np.r_[False, doc[a:b] == item[a - s : b - s], False]
        turn = np.flatnonzero(same[1:] != same[:-1])
        out += [(a + x, a + y) for x, y in zip(turn[::2].tolist(), turn[1::2].tolist()) if y - x >= least]
    return out


def extended(hits: DataFrame) -> DataFrame:
    """__row, tid, starts, ends of the runs that hits (__row, tid, shifts, item, __text) extend to; rows without any go."""

    def run(batches):
        last, words, number = None, None, {}
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i in range(batch.num_rows):
                row = batch.column("__row")[i].as_py()
                if row != last:
                    last, number = row, {}
                    words = np.array([number.setdefault(w, len(number)) for w in words_of(batch.column("__text")[i].as_py().encode())])
                item = np.array([number.get(w, -1) for w in words_of(batch.column("item")[i].as_py().encode())])
                if spans := sorted(set(runs_on(words, item, batch.column("shifts")[i].as_py()))):
                    for x, y in zip(out, (row, batch.column("tid")[i].as_py(), [a for a, _ in spans], [b for _, b in spans])):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *(pa.array(x, pa.list_(pa.int32())) for x in out[2:])], ["__row", "tid", "starts", "ends"])

    return hits.mapInArrow(run, "__row long, tid long, starts array<int>, ends array<int>")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _merged_rows(spans: DataFrame) -> DataFrame:
    """__row, longest (single run), starts and ends of the union of each row's spans."""

    def run(batches):
        for batch in batches:
            lists = [[(x["a"], x["b"]) for x in row] for row in batch.column("spans").to_pylist()]
            union = [merged(x) for x in lists]
            cols = [batch.column("__row"), pa.array([max(b - a for a, b in x) for x in lists], pa.int32()), *(pa.array([[s[k] for s in x] for x in union], pa.list_(pa.int32())) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(cols, ["__row", "longest", "starts", "ends"])

    return spans.mapInArrow(run, "__row long, longest int, starts array<int>, ends array<int>")


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """``keep`` columns, n_words, longest, starts and ends (word places of the hit spans, merged) and items of each document.

    A window is ``SPAN`` consecutive words of an item, or the whole of a shorter item; ``longest`` is the longest single run of
    equal words. Nulls have no words; items without words or id match nothing; repeated items count once. Repeated documents each
    keep their row. Whole texts count, whatever their length. ``keep`` columns pass through untouched, so extra columns never clash. Empty tables
    give an empty result, or one without hits.
    """
    spark = docs.sparkSession
    known = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    known = common.materialize(known.withColumn("tid", F.xxhash64("text")), "benchmark")
    items = known.groupBy("tid").agg(F.min("text").alias("item"))  # copies are looked for once
    prints = common.materialize(item_prints(items.select("tid", F.col("item").alias("text"))), "benchmark-prints")
    lengths = sorted(r[0] for r in prints.where(F.col("n") < SPAN).select("n").distinct().collect())  # seven at most
    filter_var = spark.sparkContext.broadcast(bitmap(prints, filter_bits))
    rows = common.materialize(doc_prints(docs, keep, filter_var, lengths, filter_bits, text_col), "document-prints")
    hits = rows.select("__row", F.explode("hits").alias("x")).select("__row", "x.fp", "x.pos").join(prints.select("fp", "tid", F.col("pos").alias("of")), "fp")
    hits = hits.groupBy("__row", "tid").agg(F.collect_set(F.col("pos") - F.col("of")).alias("shifts"))  # at most the words of both
    hits = hits.join(items, "tid").join(rows.select("__row", "__text").where("__text is not null"), "__row")
    found = common.materialize(extended(hits), "decontamination-runs")
    spans = found.select("__row", F.explode(F.arrays_zip("starts", "ends")).alias("s")).groupBy("__row").agg(F.collect_set(F.struct(F.col("s.starts").alias("a"), F.col("s.ends").alias("b"))).alias("spans"))
    ids = found.select("__row", "tid").join(known.select("tid", "item_id").distinct(), "tid").groupBy("__row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))  # the result lists them
    out = rows.drop("hits", "__text").join(_merged_rows(spans), "__row", "left").join(ids, "__row", "left")
    none = F.array().cast("array<int>")
    return out.select(*(F.col(f"`{c}`") for c in keep), "n_words", F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that share no run of ``min_words`` or more words with a window of the benchmark, with their own columns.

    A shared window of ``SPAN`` words always counts; whole items of fewer than ``min_words`` words are
    too common to tell, alone or side by side. Null and empty texts are clean; rows that repeat id and text are judged alike; an empty table of documents
    gives an empty result, and an empty benchmark leaves all.
    """
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    keys = docs.select(common.id_key(i).alias("__d"), common.text_key(i, t).alias("__t"), t.alias("__x"))
    dirty = find(keys, benchmark, ["__d", "__t"], "__x").where(F.col("longest") >= min_words).select("__d", "__t").distinct()
    dirty = common.materialize(dirty, "contaminated")
    cols = [F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(docs.columns)]
    left = docs.select(*cols, common.id_key(i).alias("__d"), common.text_key(i, t).alias("__t")).join(dirty.hint("shuffle_hash"), ["__d", "__t"], "left_anti")
    return left.select(*(F.col(f"__c{k}").alias(c) for k, c in enumerate(docs.columns)))


def report(hits: DataFrame) -> DataFrame:
    ids = F.array_join("items", ",")
    return hits.select(
        "doc_id", "n_words",
        F.aggregate(F.zip_with("ends", "starts", lambda a, b: a - b), F.lit(0).cast("long"), lambda s, x: s + x).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.size("items") >= MIN_ITEMS).alias("contaminated"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), ["doc_id"]))


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


OP7_SQL = r"""
with d as (select doc_id, row_number() over () as rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, m, array_to_string(w[i : i + m - 1], ' ') as g from (select item_id, w, least(8, len(w)) as m, unnest(range(1, len(w) - least(8, len(w)) + 2)) as i from b where len(w) > 0)),
dw as (select rid, m, i, array_to_string(w[i : i + m - 1], ' ') as g from (select rid, w, m, unnest(range(1, len(w) - m + 2)) as i from d, (select distinct m from bw) where len(w) >= m)),
h as (select rid, i, dw.m, item_id from dw join bw on dw.g = bw.g and dw.m = bw.m),
hw as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + m)) as p from (select distinct rid, i, m from h)) group by rid),
hi as (select rid, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct rid, cast(item_id as varchar) as s from h) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join hw using (rid) left join hi using (rid)
"""
