"""SimHash near-duplicates of documents.

Fingerprints that differ in at most ``d`` bits agree on all but ``d`` of ``b`` blocks, so they share
one of the C(b, d) choices of ``b - d`` blocks. Distinct fingerprints are joined on these and then
verified by Hamming distance. A bucket with more than ``PAIRS_UPTO`` fingerprints is not paired up:
its members emit the fingerprint itself and its single-bit changes. Two fingerprints at distance
2 or less always share such a variant, so linking each to the least member with that variant loses
no connection and stays linear in the size of the bucket.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .blocking import linked
from .components import components
from .words import mixed, sim_hashes, slices, words_of

SEED = 42
SHINGLE = 3
MAX_BITS = 2
BLOCKS = 4
PAIRS_UPTO = 24
_CHUNK = 1 << 15  # shingles whose bits are counted at once


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    over = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + shingle - 1]
        h = np.array([digest(b" ".join(x), SEED) for x in zip(*(part[i:] for i in range(shingle)))] or [digest(b" ".join(part), SEED)], "<u8")
        over += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(over * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keep`` and ``fp``, the fingerprint as a signed long. A null text has no words."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", fp long"

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in common.binary_values(batch.column("__text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(fp)], [*batch.schema.names[:-1], "fp"])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def _masks(blocks: int, bits: int) -> list[tuple[int, int]]:
    """A mask for each choice of blocks that two close fingerprints may share, and a tag in the bits that it leaves out."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(block[i] for i in c) for c in combinations(range(blocks), blocks - bits)]
    return [(m, i * (~m & (m + 1))) for i, m in enumerate(masks)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(bits: int, blocks: int) -> Column:
    """The blocks of ``fp`` that another fingerprint at ``bits`` may share."""
    # The tag keeps choices apart in a single key. Where keys of two choices meet nevertheless, the check of the bits settles it.
    return F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))).bitwiseOR(F.lit(_signed(tag))) for m, tag in _masks(blocks, bits)))


def links(prints: DataFrame, bits: int = MAX_BITS, blocks: int = BLOCKS, pairs_upto: int = PAIRS_UPTO) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all pairs at ``bits`` or fewer differing bits.

    Every link is such a pair; in large buckets only links to the least member of each variant are made.
    """
    if bits > 2:
        raise ValueError("single-bit variants bridge two differing bits at most")
    keyed = prints.select("fp", F.explode(_keys(bits, blocks)).alias("k"))
    count = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    shared = common.materialize(keyed.join(count, "k"), "simhash-buckets")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits
    small = shared.where(F.col("n") <= pairs_upto)
    pairs = small.select("k", F.col("fp").alias("a")).join(small.select("k", F.col("fp").alias("b")), "k").where((F.col("a") < F.col("b")) & near("a", "b")).select("a", "b")
    hot = shared.where(F.col("n") > pairs_upto).select("fp").distinct()
    flips = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    variants = hot.select("fp", F.explode(flips).alias("variant"))
    least = variants.groupBy("variant").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = variants.join(least, "variant").where(F.col("fp") > F.col("b")).where(near("fp", "b")).select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(star).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): the least id among the documents that chains of close fingerprints reach.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows each stay; a null id is
    never the least unless its group has no other, and then component_id is null. Extra columns are ignored.
    """
    prints = common.materialize(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], "text", shingle), "fingerprints")
    return grouped(prints, bits)


def grouped(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    distinct = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    comp = components(links(distinct.select("fp"), bits))
    classes = distinct.join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    best = classes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_print = classes.join(best, "component").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


NEAR_SHINGLE = 5
NEAR_BITS = 48  # of 256: a similarity of 0.8 gives 39 on average, with a deviation of 6
LANES = 16  # 64-bit SimHashes of a text's different words, cut to blocks of 32 bits. At a similarity of 0.8 a block is left with 0.11, so one of 32 with 0.97


def wide(data: np.ndarray, begins: np.ndarray, shingle: int = NEAR_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Of texts whose bytes lie on end: ``LANES`` SimHashes of each one's set of words, and 256 bits of one of its word shingles (repeats included); zeros without words.

    Sets, as the few words that make up half of any text would otherwise bring all texts of a language together.
    """
    starts, h, _ = words_of(data, begins)
    text = np.searchsorted(begins, starts, "right") - 1
    sets, many = np.zeros((len(begins), LANES), np.uint64), np.zeros((len(begins), 4), np.uint64)
    if not len(h):
        return sets, many
    by = np.lexsort([h, text])
    u, t = h[by], text[by]
    keep = np.r_[True, (u[1:] != u[:-1]) | (t[1:] != t[:-1])]
    u, t = u[keep], t[keep]
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    held = t[first]
    sets[held] = sim_hashes(u, first, LANES)
    # A shingle begins at each word that has enough words of its text after it; of a shorter text all words are the one shingle.
    new = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    size = np.diff(np.r_[new, len(h)])
    left = np.repeat(new + size, size) - np.arange(len(h))
    g = np.zeros(len(h), np.uint64)
    for j in range(shingle):
        on = np.flatnonzero(left > j)
        g[on] = g[on] * np.uint64(0x2127599BF4325C37) + h[on + j]
    own = (left >= shingle) | ((np.repeat(size, size) < shingle) & (left == np.repeat(size, size)))
    g, t = g[own], text[own]
    many[held] = sim_hashes(mixed(g), np.flatnonzero(np.r_[True, t[1:] != t[:-1]]), 4)
    return sets, many


def text_table(docs: DataFrame) -> DataFrame:
    """did, th, keys (blocks of 32 bits, told apart by their place) and w (256 bits) of each row of ``docs`` (did, th, text)."""
    place = np.arange(2 * LANES, dtype=np.uint64) << np.uint64(32)

    def run(batches):
        for batch in batches:
            for at, end, data, begins in slices(batch.column("text")):
                sets, many = wide(data, begins)
                keys = sets.view(np.uint32).astype(np.uint64) | place
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.view(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (keys, many)]
                ids = batch.select(["did", "th"]).slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*ids.columns, *lists], ["did", "th", "keys", "w"])

    return docs.mapInArrow(run, "did long, th long, keys array<long>, w array<long>")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_bits: int = NEAR_BITS) -> DataFrame:
    """One row, with its own columns, of each group of near-duplicates: the first by id and hash of the text.

    Candidates are texts that share a block of 32 bits of the SimHashes of their words, however many texts share it; a
    candidate is a near-duplicate if 256 bits of SimHash over five-word shingles differ in at most ``near_bits``, and groups are closed under such links. Null
    ids come first, null and empty texts are one group, and of rows that repeat id and text one stays. Whole texts count, whatever their length.
    An empty table gives an empty result; other columns, whatever their names, pass through.
    """
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    keyed = docs.select(common.id_key(i).alias("did"), common.text_key(i, t).alias("th"), t.alias("text"))
    rows = common.materialize(text_table(keyed), "near-rows")
    # Equal texts have equal sketches: the first row of a text stands for it. 256 bits and all keys alike is as good as the same text.
    same = F.xxhash64("keys", "w")
    nodes = rows.groupBy(same.alias("node")).agg(F.min(F.struct("did", "th", "keys", "w")).alias("x")).select("node", "x.*")
    nodes = common.materialize(nodes, "near-texts")
    common.drop(rows)
    near = lambda x, y: sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(4)), F.lit(0)) <= near_bits
    sketch = nodes.select(F.col("node").alias("u"), F.col("w").alias("mark"))
    links = linked(nodes.select(F.explode("keys").alias("k"), F.col("node").alias("u")), lambda _: sketch, near)
    comp = components(links)
    classes = nodes.select("node", "did", "th").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    stay = classes.groupBy("component").agg(F.min(F.struct("did", "th")).alias("first")).select(F.col("first.did").alias("__d"), F.col("first.th").alias("__t"))
    stay = common.materialize(stay, "survivors")
    common.drop(nodes, links, comp)
    cols = [F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(docs.columns)]
    kept = docs.select(*cols, common.id_key(i).alias("__d"), common.text_key(i, t).alias("__t")).join(stay, ["__d", "__t"], "left_semi")
    # Repeated rows lie side by side after the join: this neither shuffles nor sorts again.
    kept = kept.withColumn("__n", F.row_number().over(Window.partitionBy("__d", "__t").orderBy("__t"))).where("__n = 1")
    return kept.select(*(F.col(f"__c{k}").alias(c) for k, c in enumerate(docs.columns)))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
