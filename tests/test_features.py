"""Relational plans against the numpy kernels, kernels against series with known answers, and sizes down to one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom import registry
from seriesloom.functions import core
from seriesloom.functions.context import Series
from seriesloom.functions.kernels import FEATURES, compute
from seriesloom.operators import relational
from seriesloom.plans.extract import Extractor, components, features, summarize

RNG = np.random.default_rng(5)
SERIES = {
    0: RNG.normal(size=70), 1: np.sin(np.arange(96) * 2 * np.pi / 12) + 0.05 * RNG.normal(size=96), 2: RNG.normal(size=61).cumsum(), 3: 0.5 + 0.25 * np.arange(40.0),
    4: np.full(33, 2.5), 5: np.array([1.0]), 6: np.array([3.0, 1.0]), 7: np.array([2.0, 5.0, 4.0]), 8: np.round(RNG.normal(size=50), 0),
}


@pytest.fixture(scope="module")
def series(spark):
    rows = [(k, t, float(v)) for k, x in SERIES.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "series_id long, t long, v double").cache()


def expected(name, k):
    out = compute(Series(SERIES[k], key=k), name)
    return [] if np.ndim(out) == 0 and np.isnan(out) else np.atleast_1d(out).tolist()


@pytest.mark.parametrize("name", sorted(relational.SQL))
def test_relational_equals_kernel(series, name):
    got = {}
    for r in relational.run(name, series).collect():
        if r["value"] is not None:
            got.setdefault(r["series_id"], []).append((r["idx"] if "idx" in r else 0, r["value"]))
    for k in SERIES:
        if name in ("hist_ent_out_diff", "model_linear") and k in (4, 5, 6, 7):
            continue  # a line through one point or a histogram without width: undefined in SQL
        want = [(i, v) for i, v in enumerate(expected(name, k)) if not np.isnan(v)]
        have = sorted(got.get(k, []))
        if name.startswith("model_") and name.endswith("c") and len(SERIES[k]) < 12:
            continue  # the fitted form asks for more observations
        assert [i for i, _ in have] == [i for i, _ in want], (name, k)
        assert np.allclose([v for _, v in have], [v for _, v in want], rtol=1e-6, atol=1e-8), (name, k)


@pytest.mark.parametrize("name", ["acf", "acf_diff"])
def test_lags_go_to_half_of_a_long_series(spark, name):
    x = RNG.normal(size=2300)
    table = spark.createDataFrame([(0, t, float(v)) for t, v in enumerate(x)], "series_id long, t long, v double")
    got = [r["value"] for r in relational.run(name, table).orderBy("idx").collect()]
    want = core.acf(x if name == "acf" else np.diff(x))
    assert len(got) == len(want) > 1023 and np.allclose(got, want)


def test_every_name_of_the_survey_is_there():
    assert len(FEATURES) == 149
    assert set(FEATURES) <= set(registry.queries())


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12])
def test_short_and_constant_series(n):
    for x in (np.zeros(n), np.arange(float(n)), np.full(n, np.nan)):
        for name in FEATURES:
            out = compute(Series(x), name)
            assert np.ndim(out) <= 1


def test_known_answers():
    sine = Series(SERIES[1])
    assert compute(sine, "period") % 12 == 0 and compute(sine, "season_strenght") > 0.9  # adjusted autocorrelation may peak at a multiple
    line = Series(SERIES[3])
    assert np.allclose(compute(line, "diff"), 0.25) and compute(line, "turning_points").sum() == 0
    assert np.allclose(compute(line, "model_naive_drift"), 0, atol=1e-9) and np.allclose(compute(line, "model_linear"), 0, atol=1e-9)
    ar = [0.0]
    for e in np.random.default_rng(1).normal(size=1500):
        ar.append(0.8 * ar[-1] + e)
    ar = Series(ar)
    assert abs(compute(ar, "acf")[0] - 0.8) < 0.06
    p = compute(ar, "pacf")
    assert abs(p[0] - 0.8) < 0.06 and abs(p[1]) < 0.1
    assert compute(ar, "test_adf") < 0.01 < compute(Series(np.random.default_rng(2).normal(size=400).cumsum()), "test_adf")
    noise = Series(np.random.default_rng(3).normal(size=600))
    assert compute(noise, "test_lilliefors") > 0.05 and 0.4 < compute(noise, "dfa") < 0.65 and compute(noise, "test_lb")[0] > 0.01
    assert core.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and core.chi2_sf(31.41043, 20) == pytest.approx(0.05, abs=1e-6)


def test_decomposition_adds_up(spark, series):
    rows = components(series).where("series_id < 5")
    bad = rows.where((F.abs(F.col("v") - F.col("trend") - F.col("season") - F.col("resid")) > 1e-9) | (F.abs(F.col("detrended") - F.col("season") - F.col("resid")) > 1e-9))
    assert rows.count() == sum(len(SERIES[k]) for k in range(5)) and bad.count() == 0


def test_surrogates_and_draws_repeat(series):
    names = ["surr_trev", "itrand_mean", "surprise", "resample_std"]
    a = features(series, names, seed=3).orderBy("series_id", "feature", "idx").collect()
    b = features(series.repartition(5), names, seed=3).orderBy("series_id", "feature", "idx").collect()
    assert str(a) == str(b)


def test_extract_names_values_and_groups(series):
    x = Extractor(["length", "diff", "t_mean"], summary=["mean", "histogram", "nancount", "quantiles"]).fit(series)
    got = {(r["series_id"], r["feature"]): r["value"] for r in x.extract().collect()}
    d = np.diff(SERIES[0])
    assert got[0, "length"] == 70 and got[0, "diff.mean"] == pytest.approx(d.mean()) and got[0, "diff.nancount"] == 69
    assert [got[0, f"diff.quantiles.{k}"] for k in range(5)] == pytest.approx(np.quantile(d, [0, 0.25, 0.5, 0.75, 1]).tolist())
    assert [got[0, f"diff.histogram.{k}"] for k in range(10)] == pytest.approx((np.histogram(d, 10)[0] / len(d)).tolist())
    by = Extractor.parse_by_group(x.extract(), ["global-stat"])
    assert {r["feature"] for r in by.collect()} == {"t_mean"}
    with pytest.raises(ValueError):
        Extractor(["no such"])
    with pytest.raises(ValueError):
        Extractor(groups=["no such"])
    with pytest.raises(ValueError):
        Extractor().extract()


def test_summaries_with_nan(spark):
    t = spark.createDataFrame([(1, "f", 0, 1.0), (1, "f", 1, float("nan")), (1, "f", 2, 3.0), (2, "g", None, 7.0)], "series_id long, feature string, idx long, value double")
    got = {(r["series_id"], r["feature"]): r["value"] for r in summarize(t, Extractor.valid_summary()).collect()}
    assert np.isnan(got[1, "f.mean"]) and got[1, "f.nanmean"] == 2 and got[1, "f.count"] == 3 and got[1, "f.nancount"] == 2 and got[2, "g"] == 7
    assert got[1, "f.nansum"] == 4 and got[1, "f.nanpnorm"] == pytest.approx(10**0.5)


def test_confidence_interval_holds_the_mean(series):
    got = {r["series_id"]: r for r in Extractor(["t_mean"]).fit(series).extract_with_confidence(64).collect()}
    for k in (0, 1):
        assert got[k]["low"] < got[k]["value"] < got[k]["high"]


def test_empty_table(spark, series):
    empty = series.where("false")
    assert features(empty, ["length", "diff"]).count() == 0 and relational.run("acf", empty).count() == 0


def test_csv_source(spark, tmp_path):
    (tmp_path / "s.csv").write_text('id,data\n0,"1.5,2,3"\n1,"4"\n')
    from seriesloom.sources.series import csv_lines

    rows = sorted(map(tuple, csv_lines(spark, str(tmp_path / "s.csv"), last=2).collect()))
    assert rows == [(0, 0, 2.0), (0, 1, 3.0), (1, 0, 4.0)]


def test_streams(spark, series, tmp_path):
    from seriesloom.streaming.features import recurrences, windowed

    series.where("series_id in (0, 2)").withColumn("ts", F.timestamp_seconds(F.col("t") * 3600)).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id long, t long, v double, ts timestamp").parquet(str(tmp_path / "in"))
    q = recurrences(stream, "series_id", ["t"], "v").writeStream.format("memory").queryName("rec").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = [r["threshold"] for r in spark.table("rec").where("series_id = 0").orderBy("place").collect()]
    s = Series(SERIES[0])
    s.__dict__["z"] = SERIES[0]
    assert np.allclose(got, compute(s, "moving_threshold")[1:])
    q = windowed(stream, "series_id", "ts", "v", "12 hours").writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    first = spark.table("win").where("series_id = 0").orderBy("start").first()
    assert first["n"] == 12 and first["mean"] == pytest.approx(SERIES[0][:12].mean())


def test_rows_of_a_short_series_and_of_what_fails(spark):
    one = spark.createDataFrame([(1, 0, 5.0)], "series_id long, t long, v double")
    got = {r["feature"]: r["value"] for r in Extractor(["diff", "t_mean", "acf"], summary=["mean", "count"]).fit(one).extract().collect()}
    assert set(got) == {"t_mean", "diff.mean", "diff.count", "acf.mean", "acf.count"}
    assert got["t_mean"] == 5 and np.isnan(got["diff.mean"]) and np.isnan(got["acf.mean"]) and got["diff.count"] == got["acf.count"] == 0


def test_arguments_of_operators(series):
    x = SERIES[0]
    s = Series(x)
    assert np.allclose(compute(s, "diff", {"order": 2}), np.diff(x, 2))
    assert len(compute(s, "lumpiness", {"num_tiles": 4})) == 4 and len(compute(s, "acf", {"nlags": 7})) == 7
    w = compute(s, "moving_avg", {"window_size": 0.3})
    assert len(w) == 70 - 21 + 1 and np.isclose(w[0], s.z[:21].mean())
    assert np.allclose(compute(s, "moving_avg_shift", {"window_size": 0.3, "diff_lag": 2, "abs_value": False}), w[2:] - w[:-2])
    d = np.diff(x)
    assert compute(s, "skewness_diff", {"method": 1}) == pytest.approx(((d - d.mean()) ** 3).mean() / d.std() ** 3)
    assert compute(s, "sd_diff", {"ddof": 0}) == pytest.approx(np.diff(x).std())
    assert compute(s, "trev", {"lag": 3}) == pytest.approx(((x[3:] - x[:-3]) ** 3).mean() / ((x[3:] - x[:-3]) ** 2).mean() ** 1.5)
    assert compute(s, "emb_lag", {"lag": 4}) == 4 and compute(s, "emb_lag", {"lag": "acf"}) >= compute(s, "emb_lag") >= 1 and compute(s, "emb_lag", {"lag": "ami"}) >= 1
    for name, options in (("itrand_mean", {"strategy": "permute"}), ("itrand_sd", {"strategy": "dist-static"}), ("surprise", {"method": "1-transition", "memory_size": 20}), ("force_potential", {"potential": "dblwell"}), ("ami", {"return_dist": True, "lags": 3})):
        out = compute(s, name, options)
        assert len(out) and not np.isnan(out).any(), name
    assert np.allclose(compute(s, "itrand_mean", {"strategy": "permute"})[:-1], 0, atol=1e-9)  # the values stay the same
    full = compute(s, "model_mean", {"num_cv_folds": 3, "score": "mae"})
    assert len(full) == 3 and np.allclose(compute(s, "model_mean", {"lm_sample_frac": 0.5}), compute(Series(x[35:]), "model_mean"))
    with pytest.raises(ValueError):
        Extractor(["diff"], args={"diff": {"no": 1}})
    e = Extractor(["moving_a*", "model_mean", "diff"], summary=["mean", "powersum", "quantiles", "sd", "pnorm"], args={"moving_avg": {"window_size": 0.3}, "diff": {"order": 2}}, summary_args={"powersum": {"p": [1, 3]}, "quantiles": {"p": [0.1]}, "sd": {"ddof": 0}, "pnorm": {"p": float("inf")}}, score="mae", num_cv_folds=3, measure_time=True)
    got = {(r["series_id"], r["feature"]): r["value"] for r in e.fit(series.where("series_id = 0")).extract().collect()}
    d = np.diff(x, 2)
    assert got[0, "moving_avg.mean"] == pytest.approx(w.mean()) and got[0, "model_mean.mean"] == pytest.approx(full.mean())
    assert got[0, "diff.powersum.1"] == pytest.approx((d**3).sum()) and got[0, "diff.quantiles.0"] == pytest.approx(np.quantile(d, 0.1)) and got[0, "diff.sd"] == pytest.approx(d.std()) and got[0, "diff.pnorm"] == pytest.approx(np.abs(d).max())
    assert got[0, "diff.seconds"] > 0 and (0, "moving_acf.mean") in got


@pytest.mark.parametrize("how, want", [("standard", lambda x: (x - x.mean()) / x.std()), ("min-max", lambda x: (x - x.min()) / np.ptp(x)), ("robust", lambda x: (x - np.median(x)) / np.subtract(*np.quantile(x, [0.75, 0.25])))])
def test_scales(series, how, want):
    got = {(r["series_id"], r["idx"]): r["value"] for r in Extractor(["diff"], summary=None).fit(series.where("series_id in (0, 4)"), rescale=how).raw().collect()}
    assert np.allclose([got[0, i] for i in range(69)], np.diff(want(SERIES[0]))) and got[4, 0] == 0


def test_other_sources(spark):
    from seriesloom.sources import series as sources

    sf = "/root/testdata/sf0.001"
    for name in ("events_hourly", "orders_daily", "embeddings"):
        rows = getattr(sources, name)(spark, sf).groupBy("series_id").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).collect()
        assert rows and all(r["a"] == 0 and r["b"] == r["n"] - 1 for r in rows)
    assert sources.events_hourly(spark, sf).agg(F.sum("v")).first()[0] == pytest.approx(spark.read.parquet(f"{sf}/events.parquet").agg(F.sum("value")).first()[0])


def test_long_series_need_no_pairs_of_all(spark):
    """Rolling and pairwise plans at 3,000 points against the kernels."""
    x = RNG.normal(size=3000)
    table = spark.createDataFrame([(0, t, float(v)) for t, v in enumerate(x)], "series_id long, t long, v double")
    for name in ("moving_sd", "moving_kurtosis", "moving_acf", "sample_entropy", "corr_dim"):
        got = [r["value"] for r in relational.run(name, table).orderBy("idx" if name.startswith("moving") else "value").collect()]
        assert np.allclose(got, np.atleast_1d(compute(Series(x), name)), rtol=1e-6, atol=1e-8), name


ITERATED = ["model_arima_011_c", "model_arima_112_nc", "model_arima_100_c", "model_arima_021_c", "avg_cycle_period", "model_ses", "model_hwes_ada", "model_hwes_adm", "ets_level", "des_trend", "model_exp", "model_sine"]


@pytest.mark.parametrize("name", ITERATED)
def test_many_series_at_once_as_one_by_one(name, monkeypatch):
    """The same numbers, whatever goes along, in far fewer steps than one by one."""
    from seriesloom.functions import kernels, models

    rng, steps = np.random.default_rng(8), []
    for owner, step in ((models.Arima, "_loss"), (models.Smoothing, "_run"), (models, "_solved")):
        monkeypatch.setattr(owner, step, lambda *a, _f=getattr(owner, step): steps.append(1) or _f(*a))
    equal, mixed = [rng.normal(size=60).cumsum() for _ in range(30)], [*SERIES.values(), np.full(40, np.nan), *(rng.normal(size=n) for n in rng.integers(30, 90, 10))]
    for rows in (mixed, equal):
        steps.clear()
        alone = [np.atleast_1d(compute(Series(x), name)) for x in rows]
        apart = len(steps)
        with monkeypatch.context() as m:
            m.setattr(kernels, "_FAILS", ())  # nothing falls back to one by one
            many = kernels.compute_many([Series(x) for x in rows], name)
        assert all(np.array_equal(a, np.atleast_1d(b), equal_nan=True) for a, b in zip(alone, many))
    assert len(steps) - apart < apart / 4


def test_together_parts_hold_all_series_of_mixed_lengths(spark, monkeypatch):
    from seriesloom.plans import extract

    rows = [(k, t, float((k * 7 + t * t) % 11)) for k in range(50) for t in range(3 + k * 5)]
    table = spark.createDataFrame(rows, "series_id long, t long, v double")
    got = {r["series_id"]: r["value"] for r in features(table, ["length"]).collect()}
    assert got == {k: 3 + k * 5 for k in range(50)} and extract.POINTS > 0


@pytest.mark.parametrize("n, period", [(24, 2), (61, 7), (70, 35), (100, 12), (96, 48)])
def test_seasonal_matrices_are_the_loess_steps(n, period, monkeypatch):
    y = np.random.default_rng(n).normal(size=n).cumsum()
    fast = core.stl(y, period)
    with monkeypatch.context() as m:
        m.setattr(core, "_local", lambda *a: pytest.fail("weights made again"))
        core.stl(y[::-1], period)
    monkeypatch.setattr(core, "SHORT", 0)
    assert np.allclose(fast, core.stl(y, period), rtol=0, atol=1e-10)


def test_smoother_of_rows_and_of_equally_long_series(monkeypatch):
    rows = np.random.default_rng(4).normal(size=(40, 61)).cumsum(1)
    assert all(np.array_equal(a, core.super_smoother(x)) for a, x in zip(core.super_smoother(rows), rows))
    many = [Series(x) for x in rows]
    for s in many:
        s.equals = many
    calls = []
    monkeypatch.setattr(core, "super_smoother", lambda x, _f=core.super_smoother: calls.append(1) or _f(x))
    assert np.array_equal([core.acf(x) for x in rows], core.acf_rows(rows))
    assert [s.period for s in many] == [Series(x).period for x in rows] and len(calls) == 41


@pytest.mark.parametrize("name", ["resample_first_acf_nonpos", "resample_first_acf_locmin"])
def test_subsamples_are_smoothed_at_once(name, monkeypatch):
    x, calls = np.random.default_rng(6).normal(size=80), []
    want = []
    for a in Series(x).rng(name).integers(0, 65, 128):
        part = x[a : a + 16]
        r = core.acf(part - core.super_smoother(part))
        at = core.local_minima(r)
        want.append(core.first_where(r <= 0) if name.endswith("nonpos") else float(at[0] + 1) if len(at) else np.nan)
    monkeypatch.setattr(core, "super_smoother", lambda x, _f=core.super_smoother: calls.append(1) or _f(x))
    assert np.array_equal(compute(Series(x), name), want, equal_nan=True) and len(calls) == 1


def test_nearest_neighbours_of_all_dimensions():
    s = Series(np.random.default_rng(7).normal(size=64))
    for dim, found in enumerate(s.neighbours(1e-8), 1):
        b = core.embed(s.z, dim + 1, s.lag)
        if len(b) < 2:
            assert found is None
            continue
        d = core.pairwise(b[:, 1:])
        d[d <= 1e-8] = np.inf
        assert np.array_equal(found[0], d.min(1)) and np.array_equal(found[1], np.abs(b[:, 0] - b[d.argmin(1), 0]))


def _differing(spark, name, sf):
    """Values of a query that differ in any bit from its SQL."""
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view events as select * from '{sf}/events.parquet'")
    want = {tuple(r[:-1]): r[-1] for r in c.execute(f"select series_id, feature, value from ({registry.oracle_sql()[name]}) q").fetchall()}
    got = {(r["series_id"], r["feature"]): r["value"] for r in registry.queries()[name](spark, sf).collect()}
    assert set(got) == set(want)
    return [k for k in want if got[k] != want[k]]


@pytest.mark.parametrize("name", ["summarize", "extract_by_pattern"])
def test_summaries_round_as_their_sql(spark, name):
    assert not _differing(spark, name, "/root/testdata/sf0.01")


def test_summaries_of_many_as_of_one():
    from seriesloom.plans.summaries import summaries

    rng = np.random.default_rng(2)
    rows = [rng.normal(size=n) for n in (5, 1, 30, 2, 17)] + [np.zeros(0), np.array([np.nan, 1.0, 4.0]), np.full(3, 2.0), np.array([np.inf, 1.0])]
    names = Extractor.valid_summary()
    for suffix, value in summaries(rows, names):
        alone = [dict((k, v[0]) for k, v in summaries([x], names))[suffix] for x in rows]
        assert np.array_equal(value, alone, equal_nan=True), suffix
    x = dict((k, v[2]) for k, v in summaries(rows, names))
    assert x["skewness"] == pytest.approx(core.skew3(rows[2])) and x["kurtosis"] == pytest.approx(core.kurt3(rows[2])) and x["var"] == pytest.approx(rows[2].var(ddof=1))
    assert [x[f"quantiles.{k}"] for k in range(5)] == pytest.approx(np.quantile(rows[2], [0, 0.25, 0.5, 0.75, 1]))


@pytest.mark.parametrize("name", ["acf", "acf_diff"])
def test_autocorrelation_without_a_row_for_each_value_and_lag(series, name):
    got = relational.run(name, series)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    order = lambda d: [(r["series_id"], r["idx"], r["value"]) for r in d.orderBy("series_id", "idx").collect()]
    have, want = order(got), order(relational.plan(relational.SQL[name], series, nums=relational.lags(series)))
    assert [x[:2] for x in have] == [x[:2] for x in want] and [x[2] is None for x in have] == [x[2] is None for x in want]
    assert np.allclose([x[2] for x in have if x[2] is not None], [x[2] for x in want if x[2] is not None], rtol=1e-9, atol=1e-12)


def test_each_operator_runs_once_and_samples_go_together(spark):
    """Extraction has one pass over the gathered series; a bootstrap sample is never shuffled."""
    rows = [(k, t, float((k + 3) * t % 17)) for k in range(3) for t in range(40)]
    x = Extractor(["t_mean", "diff", "acf_first_nonpos"], random_state=7).fit(spark.createDataFrame(rows, "series_id long, t long, v double"))
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert plan(x.extract()).count("MapInArrow") == 1 and plan(x.extract_with_confidence(8)).count("MapInArrow") == 2 and plan(x.extract_with_confidence(8)).count("Repartition") == 2
    got = x.extract_with_confidence(64).collect()
    assert {r["feature"] for r in got} == {"t_mean", "acf_first_nonpos", "diff.mean", "diff.sd"} and all(r["low"] is None or r["low"] <= r["high"] for r in got)
