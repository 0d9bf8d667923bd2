"""Quality of documents by hierarchical empirical Bayes.

A logistic regression on whole-text statistics gives each document's evidence. Its probabilities are summed
over all documents of a host and of a path within it; both levels are shrunk, paths toward their
host and hosts toward the corpus, by strengths estimated from the spread between sites (method of
moments). A document's posterior odds are its own odds times the odds of its site, left-one-out, over
those of the corpus.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .toxicity import labelled_sample, sigmoid

SAMPLE = 8000
KEEP_FROM = 0.5
_BLANK = bytes.maketrans(b"", b"")
_LETTERS = bytes(b for b in range(256) if not (97 <= b <= 122))
_UPPER = bytes(b for b in range(256) if not (65 <= b <= 90))
_SYMBOLS = bytes(b for b in range(256) if b not in b"#$%&*+=<>@\\^_`{|}~!/[]")
_DIGITS = bytes(b for b in range(256) if not (48 <= b <= 57))
FEATURES = ("symbols", "upper", "digits", "repeats", "distinct", "word length", "long words", "marked words", "line repeats", "letters", "log words", "line words", "top word")


def features(text: bytes | None) -> list[float]:
    """Statistics of a whole text; all zero without words."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    at = lambda drop: len(text.translate(_BLANK, drop)) / size
    repeats = sum(map(bytes.__eq__, words, words[1:])) / n
    ends = sum(w[-1] in b"#$%&*|!" for w in words) / n
    top = max(counts.values()) / n
    return [
        at(_SYMBOLS), at(_UPPER), at(_DIGITS), repeats, len(counts) / n**0.9, (size - n) / n / 10, sum(len(w) > 25 for w in words) / n, ends,
        1 - len(set(lines)) / len(lines), at(_LETTERS), np.log1p(n) / 10, np.log1p(n / len(lines)) / 5, top,
    ]


@dataclass
class Evidence:
    """Standardized logistic regression with squares; ``odds`` gives log odds of good quality."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> Evidence:
        """Newton's method. Without both labels the odds are those of the labels' smoothed rate."""
        k = 2 * len(FEATURES)
        bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
        if not len(y) or y.min() == y.max():
            return cls(np.zeros(k), np.ones(k), np.zeros(k), bias)
        x = np.c_[x, x * x]
        mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1)
        z = np.c_[(x - mean) / scale, np.ones(len(x))]
        w = np.r_[np.zeros(k), bias]
        for _ in range(rounds):
            p = sigmoid(z @ w)
            grad = z.T @ (p - y) / len(y) + ridge * np.r_[w[:-1], 0]
            hess = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(k + 1)
            w = w - solved(hess, grad)
        return cls(mean, scale, w[:-1], float(w[-1]))

    def odds(self, x: np.ndarray) -> np.ndarray:
        return ((np.c_[x, x * x] - self.mean) / self.scale) @ self.weight + self.bias


def solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of a positive definite system, by conjugate gradients (no threads of a linear algebra library beside the JVM)."""
    x, r = np.zeros_like(b), b.copy()
    p = r.copy()
    for _ in range(20 * len(b)):
        rr = r @ r
        if rr < 1e-24:
            break
        ap = a @ p
        alpha = rr / (p @ ap)
        x += alpha * p
        r -= alpha * ap
        p = r + (r @ r) / rr * p
    return x


def _matrix(texts) -> np.ndarray:
    rows = [features(t) for t in texts]
    return np.array(rows, float).reshape(len(rows), len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Evidence:
    """Fit on at most ``limit`` labelled documents, chosen by a hash of the id."""

    def run(batches):
        for batch in batches:
            x = _matrix(common.binary_values(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = labelled_sample(docs, labels, "quality", limit, training_only=False).mapInArrow(run, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return Evidence.fit(x, rows.column("y").to_numpy())


def with_evidence(docs: DataFrame, model: Evidence, text_col: str = "text", column: str = "__odds", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` (default: all columns of ``docs``) and the log odds of each document."""
    kept = docs.select(*(keep or ["*"]), F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]) + f", `{column}` double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            odds = model.odds(_matrix(common.binary_values(batch.column(batch.num_columns - 1)))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(odds, pa.float64())], [*batch.schema.names[:-1], column])

    return kept.mapInArrow(run, schema)


def _strength(table: DataFrame, n: str, s: str, mean: Column) -> Column:
    """Prior strength (as a number of documents) from the spread of the sites' rates around ``mean``, between 1 and 1000."""
    rate = F.col(s) / F.col(n)
    noise = F.sum(mean * (1 - mean))  # of n * (rate - mean)^2, if sites did not differ
    spread = F.sum(F.col(n) * (rate - mean) ** 2)
    extra = F.greatest((spread - noise) / F.sum(F.col(n)), F.lit(1e-6))
    return F.least(F.greatest(F.avg(mean * (1 - mean)) / extra - 1, F.lit(1.0)), F.lit(1000.0))


def site_rates(evidence: DataFrame) -> DataFrame:
    """host, path, their counts and sums of probability, strengths and the corpus mean; a row per path.

    ``evidence``: host, path, p. Nulls in host or path are sites of their own.
    """
    paths = common.materialize(evidence.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("s")), "quality-paths")
    hosts = common.materialize(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")), "quality-hosts")
    total = hosts.agg((F.sum("host_s") / F.sum("host_n")).alias("mean"))
    host_strength = hosts.crossJoin(F.broadcast(total)).agg(F.first("mean").alias("mean"), _strength(hosts, "host_n", "host_s", F.col("mean")).alias("host_k"))  # one row beside each
    both = paths.withColumnRenamed("host", "__h").join(hosts, F.col("__h").eqNullSafe(F.col("host"))).drop("__h")
    path_strength = both.agg(_strength(both, "n", "s", F.col("host_s") / F.col("host_n")).alias("path_k"))
    return both.crossJoin(F.broadcast(host_strength.crossJoin(F.broadcast(path_strength))))


def posterior() -> Column:
    """Log odds of a document given ``__odds``, ``p`` and its site's row, itself left out of the site."""
    logit = lambda x: F.log(x / (1 - x))
    clip = lambda x: F.least(F.greatest(x, F.lit(0.001)), F.lit(0.999))
    host = (F.col("host_s") - F.col("p") + F.col("host_k") * F.col("mean")) / (F.col("host_n") - 1 + F.col("host_k"))
    path = (F.col("s") - F.col("p") + F.col("path_k") * host) / (F.col("n") - 1 + F.col("path_k"))
    return F.col("__odds") + logit(clip(path)) - logit(clip(F.col("mean")))


def judged(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (default: all of ``docs``) with __p (evidence), __site (site's shrunk rate, itself left out), __quality (posterior).

    Null and empty texts have all-zero statistics and are judged by them. Repeated rows are judged each;
    an empty table gives an empty result; without labels every document has even odds and is kept.
    """
    model = fit(docs, labels)
    carry = carry or docs.columns
    i, t = [F.col(host_col).cast("string"), F.col(path_col).cast("string")], F.col(text_col)
    narrow = text_col not in carry
    if narrow:  # each text is read once: its evidence is written, and rates and posteriors come from that
        keep = [*(F.col(f"`{c}`") for c in carry), i[0].alias("__host"), i[1].alias("__path")]
        out = common.materialize(with_evidence(docs, model, text_col, keep=keep), "quality-evidence")
    else:
        out = with_evidence(docs, model, text_col, keep=[*(F.col(f"`{c}`") for c in carry), i[0].alias("__host"), i[1].alias("__path")])
    p = (1 / (1 + F.exp(-F.col("__odds")))).alias("p")
    rated = out if narrow else with_evidence(docs, model, text_col, keep=[i[0].alias("__host"), i[1].alias("__path")])
    sites = common.materialize(site_rates(rated.select(F.col("__host").alias("host"), F.col("__path").alias("path"), p)), "quality-sites")
    site = F.struct(*(F.col(c) for c in sites.columns)).alias("__s")
    out = out.join(sites.select(site), F.col("__host").eqNullSafe(F.col("__s.host")) & F.col("__path").eqNullSafe(F.col("__s.path")))
    shifted = {"p": 1 / (1 + F.exp(-F.col("__odds")))} | {c: F.col(f"__s.{c}") for c in ("n", "s", "host_n", "host_s", "host_k", "path_k", "mean")}
    rows = out.select(*(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)), "__odds", *(v.alias(k) for k, v in shifted.items()))
    rows = rows.withColumn("__post", posterior())
    site_rate = 1 / (1 + F.exp(-(F.col("__post") - F.col("__odds") + F.log(F.col("mean") / (1 - F.col("mean"))))))
    return rows.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)), F.col("p").alias("__p"), site_rate.alias("__site"), (1 / (1 + F.exp(-F.col("__post")))).alias("__quality"))


def accepted(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents whose posterior is ``keep_from`` or more, with their own columns; rows that repeat id, text and site are judged alike.

    Nulls, empty and very long texts, repeats and empty tables as in ``judged``. Only keys of what is rejected meet the documents again.
    """
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    site = [F.col(options.get(k, d)).cast("string").alias(f"__{d}") for k, d in (("host_col", "source"), ("path_col", "lang"))]
    key = F.xxhash64(*(F.coalesce(c, F.lit("")) for c in (F.col("__source"), F.col("__lang"))), F.col("__source").isNull(), F.col("__lang").isNull())
    keyed = docs.select(common.id_key(i).alias("__d"), common.text_key(i, t).alias("__t"), i.alias("doc_id"), t.alias("text"), *site)
    verdicts = judged(keyed, labels, "__source", "__lang", carry=["__d", "__t", "__source", "__lang"])
    out = common.materialize(verdicts.where(F.col("__quality") < keep_from).select("__d", "__t", key.alias("__k")).distinct(), "rejected")
    cols = [F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(docs.columns)]
    rows = docs.select(*cols, common.id_key(i).alias("__d"), common.text_key(i, t).alias("__t"), *site).withColumn("__k", key)
    left = rows.join(out.hint("shuffle_hash"), ["__d", "__t", "__k"], "left_anti")
    return left.select(*(F.col(f"__c{k}").alias(c) for k, c in enumerate(docs.columns)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = judged(docs, common.table(spark, sf_dir, "labels"), carry=["doc_id", "source", "lang"])
    return out.select("doc_id", "source", "lang", F.col("__p").alias("evidence"), F.col("__site").alias("site_rate"), F.col("__quality").alias("quality"), (F.col("__quality") >= KEEP_FROM).alias("accepted"))
