"""Features of many series at once.

Series are gathered to arrays with a single shuffle; the wanted operators then run map-side over Arrow
batches of series, sharing what they have in common (decomposition, autocorrelation, lags). Operators that have a
relational plan can instead run as one over the long table, where no series has to fit in a task.
"""

from __future__ import annotations

import fnmatch
import inspect
import time
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.context import Series
from ..functions.kernels import FEATURES, compute_many
from ..functions.models import cross_validated
from ..operators import relational
from ..sources.series import arrays
from .summaries import checked_summaries, summaries

GROUPS = ("landmarking", "general", "global-stat", "local-stat", "model-based", "info-theory", "stat-tests", "autocorr", "randomize", "freq-domain")
_LONG = "feature string, idx long, value double"


def features(series: DataFrame, names: Iterable[str], period: int | None = None, seed: int = 0, args: dict[str, dict] | None = None) -> DataFrame:
    """series_id, feature, idx (null for scalars), value of the named operators with their ``args``. NaN stays NaN."""
    return features_of_arrays(arrays(series), list(names), period, seed, args).where(f"idx is null or idx <> {EMPTY}")


#: Values of series that are worked on together, shorter ones counted as long as the longest; a longer series is worked on alone.
POINTS = 1 << 17


def _parts(sizes: list[int]):
    """Begin and end of neighbouring rows that are worked on together."""
    start = 0
    while start < len(sizes):
        stop, longest = start, 0
        while stop < len(sizes) and (stop == start or max(longest, sizes[stop]) * (stop + 1 - start) <= POINTS):
            stop, longest = stop + 1, max(longest, sizes[stop])
        yield start, stop
        start = stop


def alike(many: list[Series]) -> list[Series]:
    """The series, each told which others are equally long."""
    equals = {}
    for s in many:
        s.equals = equals.setdefault(s.n, [])
        s.equals.append(s)
    return many


def together(batches, period: int | None, seed: int):
    """ids and ``Series`` of some rows of series_id and values at a time; series without values are passed over."""
    for batch in batches:
        values = batch.column("values")
        sizes = pc.fill_null(pc.list_value_length(values), 0).to_pylist()
        for start, stop in _parts(sizes):
            on = [i for i in range(start, stop) if sizes[i]]
            if on:
                ids = batch.column("series_id").take(pa.array(on, pa.int64()))
                yield ids, alike([Series(values[i].values.to_numpy(zero_copy_only=False), period, seed, key) for i, key in zip(on, ids.to_pylist())])


#: Stands at the place of an empty array, so that it still has a row for each summary.
EMPTY = -1
TIMES = "seconds"


def features_of_arrays(table: DataFrame, names: list[str], period: int | None = None, seed: int = 0, args: dict[str, dict] | None = None) -> DataFrame:
    """As ``features``, of series_id and values; empty arrays have one row at ``EMPTY``."""
    unknown = (set(names) | set(args or {})) - set(FEATURES)
    if unknown:
        raise ValueError(f"no such feature: {', '.join(sorted(unknown))}")
    args, chosen = args or {}, {n: FEATURES[n] for n in names}
    for n in set(args) & set(names):
        checked(n, args[n])
    key = table.schema["series_id"].dataType.simpleString()

    def run(batches):
        FEATURES.update(chosen)  # registered ones, on the executors
        for ids, many in together(batches, period, seed):
            for name in names:  # a batch out for each operator: memory goes with some series
                out = compute_many(many, name, args.get(name))
                scalar = np.array([np.ndim(x) == 0 for x in out])
                out = [np.atleast_1d(np.asarray(x, float)) for x in out]
                sizes = np.array([len(x) for x in out])
                rows = np.maximum(sizes, 1)
                at = np.repeat(np.arange(len(many)), rows)
                idx = np.where(sizes[at] > 0, np.arange(len(at)) - np.repeat(np.r_[0, np.cumsum(rows)[:-1]], rows), EMPTY)
                value = np.concatenate([x if len(x) else [np.nan] for x in out])
                cols = [ids.take(pa.array(at)), pa.repeat(pa.scalar(name, pa.string()), len(at)), pa.array(idx, pa.int64(), mask=scalar[at]), pa.array(value, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, ["series_id", "feature", "idx", "value"])

    return table.select("series_id", "values").mapInArrow(run, f"series_id {key}, {_LONG}")


def checked(name: str, options: dict) -> None:
    """ValueError for an argument that the operator doesn't have."""
    known = inspect.signature(FEATURES[name][1]).parameters
    if any(p.kind is p.VAR_KEYWORD for p in known.values()):
        return  # passed on: the operator itself tells
    wrong = set(options) - set(known) - {"lag", "max_nlags"}
    if wrong:
        raise ValueError(f"{name} has no argument {', '.join(sorted(wrong))}")


def components(series: DataFrame, period: int | None = None) -> DataFrame:
    """series_id, t, v, trend, season, resid, detrended, deseasonalized."""
    key = series.schema["series_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                s = Series(batch.column("values")[i].values.to_numpy(zero_copy_only=False), period)
                cols = [np.arange(s.n), s.ts, s.trend, s.season, s.resid, s.detrended, s.deseasonalized]
                yield pa.RecordBatch.from_arrays([batch.column("series_id").take(pa.array([i] * s.n)), *map(pa.array, cols)], ["series_id", "t", "v", "trend", "season", "resid", "detrended", "deseasonalized"])

    return arrays(series).mapInArrow(run, f"series_id {key}, t long, v double, trend double, season double, resid double, detrended double, deseasonalized double")


def summarize(table: DataFrame, summaries: Iterable[str], args: dict[str, dict] | None = None) -> DataFrame:
    """series_id, feature, value: scalars as they are, arrays by each summary ('name.summary' or 'name.summary.i') with its ``args``.

    NaN spoils a plain summary and is passed over by its nan form. Empty arrays have NaN, and counts of 0. An array must fit in a task.
    """
    names, key = checked_summaries(summaries), table.schema["series_id"].dataType.simpleString()
    held = F.filter(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"].isNotNull())
    values = F.transform(held, lambda x: x["value"])
    rows = table.groupBy("series_id", "feature").agg(values.alias("values"), F.max(F.col("idx").isNull()).alias("scalar"), F.max("idx").alias("last"))

    def run(batches):
        for batch in batches:
            for start, stop in _parts(pc.list_value_length(batch.column("values")).to_pylist()):
                part = batch.slice(start, stop - start)
                values = [np.asarray(x.values.to_numpy(zero_copy_only=False), float) for x in part.column("values")]
                values = [x[:0] if last == EMPTY else x for x, last in zip(values, part.column("last").to_pylist())]
                scalar = np.array(part.column("scalar").to_pylist(), bool)
                yield from _summarized(part.column("series_id"), part.column("feature"), values, scalar, names, args)

    return rows.mapInArrow(run, f"series_id {key}, feature string, value double")


def _summarized(ids: pa.Array, feature: pa.Array, values: list[np.ndarray], scalar: np.ndarray, names: list[str], args: dict[str, dict] | None):
    """Batches of series_id, feature, value: scalars as they are, summaries of the others."""
    on, rest = np.flatnonzero(scalar), np.flatnonzero(~scalar)
    if len(on):
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(on)), feature.take(pa.array(on)), pa.array(np.array([values[i][0] if len(values[i]) else np.nan for i in on]))], ["series_id", "feature", "value"])
    if len(rest) and names:
        ids, feature = ids.take(pa.array(rest)), feature.take(pa.array(rest))
        for name, value in summaries([values[i] for i in rest], names, args):
            yield pa.RecordBatch.from_arrays([ids, pc.binary_join_element_wise(feature, name, "."), pa.array(value)], ["series_id", "feature", "value"])


def rescaled(series: DataFrame, how: str) -> DataFrame:
    """Each series by 'standard' (mean and population deviation), 'min-max' (to 0 ... 1) or 'robust' (median and quartiles); without spread only moved."""
    w = Window.partitionBy("series_id")
    v = F.col("v")
    q = lambda p: F.percentile("v", p).over(w)
    ways = {"standard": (F.avg("v").over(w), F.stddev_pop("v").over(w)), "min-max": (F.min("v").over(w), F.max("v").over(w) - F.min("v").over(w)), "robust": (q(0.5), q(0.75) - q(0.25))}
    if how not in ways:
        raise ValueError(f"no such scale: {how}")
    centre, spread = ways[how]
    return series.withColumn("v", (v - centre) / F.when(spread > 0, spread).otherwise(1.0))


class Extractor:
    """Choose features by name (or a pattern with * and ?) or group, and summaries; ``extract`` gives series_id, feature, value.

    ``args`` has arguments by operator, ``summary_args`` by summary. ``score``, ``num_cv_folds`` and ``lm_sample_frac`` go to all landmarks, ``lag`` and
    ``max_nlags`` to all that embed. ``measure_time`` adds a row 'name.seconds' per operator and series.
    ``register`` adds an operator: a function of a ``Series`` that returns a number or an array.
    """

    def __init__(
        self, features: Iterable[str] | str = "all", groups: Iterable[str] | str = "all", summary: Iterable[str] | str | None = ("mean", "sd"), period: int | None = None, random_state: int = 0, args: dict[str, dict] | None = None,
        summary_args: dict[str, dict] | None = None, score: str | Callable = "rmse", num_cv_folds: int = 5, lm_sample_frac: float = 1.0, lag: int | str | None = None, max_nlags: int | None = None, measure_time: bool = False,
    ):
        wanted_groups = set(GROUPS) if groups == "all" else {g.lower() for g in ([groups] if isinstance(groups, str) else groups)}
        if wanted_groups - set(self.valid_groups()):
            raise ValueError(f"no such group: {', '.join(sorted(wanted_groups - set(self.valid_groups())))}")
        patterns = ["*"] if features == "all" else [features] if isinstance(features, str) else list(features)
        met = {p: fnmatch.filter(FEATURES, p) for p in patterns}
        if wrong := [p for p, names in met.items() if not names]:
            raise ValueError(f"no such feature: {', '.join(sorted(wrong))}")
        if not 0 < lm_sample_frac <= 1 or num_cv_folds < 1:
            raise ValueError("lm_sample_frac is above 0 and at most 1, num_cv_folds is 1 at least")
        self.names = sorted({n for names in met.values() for n in names if FEATURES[n][0] in wanted_groups})
        self.summary = tuple(self.valid_summary() if summary == "all" else [summary] if isinstance(summary, str) else summary or ())
        self.period, self.seed, self.measure_time, self.summary_args = period, random_state, measure_time, summary_args
        common = {k: v for k, v in (("score", score), ("num_cv_folds", num_cv_folds), ("lm_sample_frac", lm_sample_frac)) if v != inspect.signature(cross_validated).parameters[k].default}
        embedding = {k: v for k, v in (("lag", lag), ("max_nlags", max_nlags)) if v is not None}
        self.args = {n: ({k: v for k, v in common.items() if k != "score" or not n.endswith("nonpos")} if FEATURES[n][0] == "landmarking" else embedding) | (args or {}).get(n, {}) for n in self.names}
        for n, options in (args or {}).items():
            if n not in FEATURES:
                raise ValueError(f"no such feature: {n}")
            checked(n, options)
        self.series: DataFrame | None = None

    @staticmethod
    def valid_groups() -> tuple[str, ...]:
        return tuple(dict.fromkeys([*GROUPS, *(g for g, _ in FEATURES.values())]))

    @staticmethod
    def valid_summary() -> tuple[str, ...]:
        return (*relational.SUMMARIES, *relational.VECTOR_SUMMARIES)

    @staticmethod
    def valid_metafeatures(groups: Iterable[str] | None = None) -> tuple[str, ...]:
        return tuple(sorted(n for n, (g, _) in FEATURES.items() if groups is None or g in set(groups)))

    @staticmethod
    def register(name: str, group: str, f: Callable[[Series], object]) -> None:
        FEATURES[name] = (group, f)

    @staticmethod
    def description(spark) -> DataFrame:
        """feature, grp, description of every operator."""
        rows = [(n, g, (f.__doc__ or "").strip().split("\n")[0]) for n, (g, f) in sorted(FEATURES.items())]
        return spark.createDataFrame(rows, "feature string, grp string, description string")

    @staticmethod
    def parse_by_group(result: DataFrame, groups: Iterable[str]) -> DataFrame:
        """Rows of a result whose operator is in one of the groups."""
        names = [n for n, (g, _) in FEATURES.items() if g in set(groups)]
        return result.where(F.split("feature", r"\.")[0].isin(names))

    def fit(self, series: DataFrame, rescale: str | None = None) -> Extractor:
        """``series``: series_id, t, v, on the scale wished for (see ``rescaled``). Nothing runs before the result is used."""
        self.series = series if rescale is None else rescaled(series, rescale)
        return self

    def _long(self) -> DataFrame:
        if self.series is None:
            raise ValueError("call fit first")
        return features_of_arrays(arrays(self.series), self.names, self.period, self.seed, self.args)

    def raw(self) -> DataFrame:
        return self._long().where(f"idx is null or idx <> {EMPTY}")

    def extract(self) -> DataFrame:
        """A row for each series and operator (and summary), whatever fails. Without summaries, arrays keep a row per element as 'name' with its idx.

        Each operator runs once, and arrays are summarized in the task that made them."""
        if not self.summary:
            return self.raw()
        if self.series is None:
            raise ValueError("call fit first")
        key, measure, period, seed, own = self.series.schema["series_id"].dataType.simpleString(), self.measure_time, self.period, self.seed, self._own()

        def run(batches):
            FEATURES.update(own[0])
            for ids, many in together(batches, period, seed):
                for name, took, found in _computed(ids, many, *own[1:]):
                    yield from found
                    if measure:
                        cols = [ids, pa.repeat(pa.scalar(f"{name}.{TIMES}"), len(ids)), pa.array(np.full(len(ids), took))]
                        yield pa.RecordBatch.from_arrays(cols, ["series_id", "feature", "value"])

        return arrays(self.series).mapInArrow(run, f"series_id {key}, feature string, value double")

    def _own(self):
        return {n: FEATURES[n] for n in self.names}, self.names, self.args, checked_summaries(self.summary), self.summary_args

    def extract_with_confidence(self, sample_num: int = 128, confidence: float = 0.95, block: int = 1) -> DataFrame:
        """series_id, feature, value and the bootstrap interval (low, high). Values are drawn with replacement in blocks of ``block``, kept in time order.

        A task draws all samples of a series and works on those of some series together; only values and intervals leave it."""
        if self.series is None:
            raise ValueError("call fit first")
        key, period, seed, own = self.series.schema["series_id"].dataType.simpleString(), self.period, self.seed, self._own()
        tails = (1 - confidence) / 2, 1 - (1 - confidence) / 2

        def drawn(s: Series, id) -> list[Series]:
            rng, out = Series(s.ts, 1, seed, id).rng("bootstrap"), []
            for k in range(sample_num):
                start = np.sort(rng.integers(0, s.n, -(-s.n // block)))
                at = ((start[:, None] + np.arange(block)[None]) % s.n).ravel()[: s.n]
                out.append(Series(s.ts[at], period, seed, {"id": id, "sample": k}))
            return out

        def run(batches):
            FEATURES.update(own[0])
            for ids, many in together(batches, period, seed):
                for start, stop in _parts([s.n * sample_num for s in many]):
                    part = ids.slice(start, stop - start)
                    samples = alike([x for s, id in zip(many[start:stop], part.to_pylist()) for x in drawn(s, id)])
                    of = np.repeat(np.arange(stop - start), sample_num)
                    for batch in (x for _, _, found in _computed(pa.array(of), samples, *own[1:]) for x in found):
                        value, series = batch.column("value").to_numpy(), batch.column("series_id").to_numpy()
                        yield _limits(part, batch.column("feature"), series[~np.isnan(value)], value[~np.isnan(value)], tails)

        limits = arrays(self.series).mapInArrow(run, f"series_id {key}, feature string, low double, high double")
        return self.extract().join(limits, ["series_id", "feature"], "left")


def _computed(ids: pa.Array, many: list[Series], names: list[str], args: dict[str, dict], summary: list[str], summary_args: dict[str, dict] | None):
    """Each operator's name, how long it took by series, and batches of series_id, feature, value."""
    for name in names:
        began = time.perf_counter()
        out = compute_many(many, name, args.get(name))
        took = (time.perf_counter() - began) / len(many)
        scalar = np.array([np.ndim(x) == 0 for x in out])
        values = [np.atleast_1d(np.asarray(x, float)) for x in out]
        yield name, took, _summarized(ids, pa.repeat(pa.scalar(name), len(ids)), values, scalar, summary, summary_args)


def _limits(ids: pa.Array, feature: pa.Array, series: np.ndarray, value: np.ndarray, tails: tuple[float, float]) -> pa.RecordBatch:
    """series_id, feature, low, high: exact percentiles of the values of each of the ``series`` (places in ``ids``)."""
    by = np.lexsort((value, series))
    series, value = series[by], value[by]
    first = np.flatnonzero(np.r_[True, series[1:] != series[:-1]]) if len(series) else np.zeros(0, np.int64)
    many, limits = np.diff(np.r_[first, len(series)]), []
    for p in tails:
        at = (many - 1) * p
        low, high = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)
        limits.append(np.where(low == high, value[first + low], (high - at) * value[first + low] + (at - low) * value[first + high]) if len(first) else np.zeros(0))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(series[first])), feature.take(pa.array(np.zeros(len(first), np.int64))), *map(pa.array, limits)], ["series_id", "feature", "low", "high"])
