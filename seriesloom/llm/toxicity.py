"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words and their first four and five bytes, hashed. The machine is fitted on at most
``SAMPLE`` labelled documents (chosen by a hash of the id, so the sample is the same at any
parallelism) over the ``SLOTS`` hash slots that say most about the label; it has a weight per
slot and a vector per slot whose inner products weigh pairs. The model is a few hundred kB whatever
the corpus, and every document is scored in whole, map-side.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .decontamination import words_of

SAMPLE = 8000
HASH_BITS = 20
SLOTS = 4096
RANK = 4
FOLDS = 5
_WORDS_KEPT = 300_000


def slots_of_word(word: bytes) -> tuple[int, ...]:
    mask = (1 << HASH_BITS) - 1
    out = [zlib.crc32(word) & mask]
    if len(word) > 4:
        out.append(zlib.crc32(b"^" + word[:4]) & mask)
    if len(word) > 5:
        out.append(zlib.crc32(b"^" + word[:5]) & mask)
    return tuple(out)


class Terms(dict):
    """The slots (of those in ``number``, or all) of each word met."""

    def __init__(self, number: dict[int, int] | None = None):
        super().__init__()
        self.number = number

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        out = slots_of_word(word)
        if self.number is not None:
            out = tuple(self.number[s] for s in out if s in self.number)
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = out
        return out

    def of(self, text: bytes | None) -> list[int]:
        return sorted(set().union(*map(self.__getitem__, set(words_of(text)))))


class Machine:
    """Second-order factorization machine on sets of slots, by full-batch Adam on the logistic loss."""

    def __init__(self, slots: int = SLOTS, rank: int = RANK, rounds: int = 120, rate: float = 0.05, decay: float = 1e-4, seed: int = 7):
        self.slots, self.rank, self.rounds, self.rate, self.decay, self.seed = slots, rank, rounds, rate, decay, seed
        self.number: dict[int, int] = {}

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> Machine:
        y = np.asarray(y, float)
        self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
        self.w, self.v = np.zeros(0), np.zeros((0, self.rank))
        if not len(y) or y.min() == y.max():
            return self
        sizes = np.array([len(r) for r in rows])
        flat = np.concatenate(rows).astype(np.int64)
        n = 1 << HASH_BITS
        seen, hot = np.bincount(flat, minlength=n), np.bincount(flat, weights=np.repeat(y, sizes), minlength=n)
        # How unlikely a slot's share of the label is by chance.
        p = y.mean()
        z = np.abs(hot - seen * p) / np.sqrt(np.maximum(seen, 5) * p * (1 - p))
        z[seen < 3] = 0
        chosen = np.flatnonzero(z > 0)
        chosen = np.sort(chosen[np.argsort(-z[chosen], kind="stable")[: self.slots]])
        self.number = {int(s): i for i, s in enumerate(chosen)}
        table = np.full(n, -1)
        table[chosen] = np.arange(len(chosen))
        doc, col = np.repeat(np.arange(len(rows)), sizes), table[flat]
        doc, col = doc[col >= 0], col[col >= 0]
        by = np.argsort(col, kind="stable")
        rng = np.random.default_rng(self.seed)
        m = len(chosen)
        par = [np.array([self.bias]), np.zeros(m), rng.normal(0, 0.01, (m, self.rank))]
        mean, var = [np.zeros_like(a) for a in par], [np.zeros_like(a) for a in par]
        start_doc, has_doc = _starts(doc)
        start_col, has_col = _starts(col[by])
        for t in range(1, self.rounds + 1):
            b, w, v = par
            s, q, line = np.zeros((len(y), self.rank)), np.zeros(len(y)), np.zeros(len(y))
            vc = v[col]
            s[has_doc] = np.add.reduceat(vc, start_doc)
            q[has_doc] = np.add.reduceat((vc * vc).sum(1), start_doc)
            line[has_doc] = np.add.reduceat(w[col], start_doc)
            g = (sigmoid(b[0] + line + ((s * s).sum(1) - q) / 2) - y) / len(y)
            gd = g[doc]
            gw, gv = np.zeros(m), np.zeros((m, self.rank))
            gw[has_col] = np.add.reduceat(gd[by], start_col)
            gv[has_col] = np.add.reduceat((gd[:, None] * (s[doc] - vc))[by], start_col)
            for i, grad in enumerate((np.array([g.sum()]), gw + self.decay * w, gv + self.decay * v)):
                mean[i] = 0.9 * mean[i] + 0.1 * grad
                var[i] = 0.999 * var[i] + 0.001 * grad * grad
                par[i] = par[i] - self.rate * (mean[i] / (1 - 0.9**t)) / (np.sqrt(var[i] / (1 - 0.999**t)) + 1e-8)
        self.bias, self.w, self.v = float(par[0][0]), par[1], par[2]
        return self

    def score(self, numbers: list[int]) -> float:
        if not numbers:
            return float(sigmoid(np.array(self.bias)))
        v = self.v[numbers]
        s = v.sum(0)
        return float(sigmoid(np.array(self.bias + self.w[numbers].sum() + (s @ s - (v * v).sum()) / 2)))


def _starts(sorted_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]]) if len(sorted_ids) else np.empty(0, np.int64)
    return start, sorted_ids[start]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, training_only: bool = True) -> DataFrame:
    """At most ``limit`` (doc_id, text, label) rows: a label for an id once, chosen by a hash of the id."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if training_only:
        known = known.where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    met = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # ``limit`` rows of two numbers
    return met.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(limit)  # repeated ids of documents count against it


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, **options) -> Machine:
    """Fit on a bounded sample of labelled rows that are not held out. Without both labels the score is their rate."""

    def run(batches):
        terms = Terms()
        for batch in batches:
            slots = [terms.of(t) for t in common.binary_values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(slots, pa.list_(pa.int32()))], ["doc_id", "y", "slots"])

    rows = labelled_sample(docs, labels, "toxic", limit).mapInArrow(run, "doc_id long, y int, slots array<int>").toArrow().sort_by("doc_id")
    slots = rows.column("slots").combine_chunks()
    at, flat = slots.offsets.to_numpy(), slots.values.to_numpy()
    return Machine(**options).fit([flat[a:b] for a, b in zip(at, at[1:])], rows.column("y").to_numpy())


def score(docs: DataFrame, machine: Machine, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and the score of each whole text, however long; a null or empty text has the score of no terms.

    Repeated rows are scored each, equal texts alike; an empty table gives an empty result; other columns are ignored.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", score double"
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        machine = model.value
        terms = Terms(machine.number)
        for batch in batches:
            out = [machine.score(terms.of(t)) for t in common.binary_values(batch.column("__text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(out, pa.float64())], [*batch.schema.names[:-1], "score"])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, common.table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
