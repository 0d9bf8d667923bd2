"""Names of the queries, their plans and their SQL. Each feature runs over the series of events by user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .functions.kernels import FEATURES, SCALARS
from .operators import relational
from .plans.extract import Extractor, features
from .sources import series as sources

def _kernel(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = features(sources.events_by_user(spark, sf_dir), [name])
        value = F.when(~F.isnan("value"), F.col("value")).alias("value")
        return out.select("series_id", value) if name in SCALARS else out.where("idx is not null").select("series_id", "idx", value)

    return run


def _relational(name: str):
    return lambda spark, sf_dir: relational.run(name, sources.events_by_user(spark, sf_dir))


def _summary(name: str):
    """Of the differences of each series."""
    sql = relational.summary_sql(name, "{values}")
    return lambda spark, sf_dir: relational.plan(sql, (s := sources.events_by_user(spark, sf_dir)), values=relational.run("diff", s).select("series_id", "value"))


def _extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features with the default summaries."""
    return Extractor().fit(sources.events_by_user(spark, sf_dir)).extract().withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def _confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Extractor(["t_mean", "sd_diff", "acf_first_nonpos"], random_state=7).fit(sources.events_by_user(spark, sf_dir))
    return x.extract_with_confidence()


def _by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Extractor(["length", "t_mean", "hist_entropy", "diff"]).fit(sources.events_by_user(spark, sf_dir)).extract()
    return Extractor.parse_by_group(x, ["global-stat"]).select("series_id", "feature", "value")


def _summaries_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Extractor(["diff", "bin_mean"], summary="all").fit(sources.events_by_user(spark, sf_dir))
    return x.extract().withColumn("value", F.when(~F.isnan("value"), F.col("value")))


#: Operators with arguments: query name, operator, options of the extractor.
WITH_ARGUMENTS = {
    "diff_order_2": ("diff", {"args": {"diff": {"order": 2}}}),
    "sd_diff_ddof_0": ("sd_diff", {"args": {"sd_diff": {"ddof": 0}}}),
    "lumpiness_8_tiles": ("lumpiness", {"args": {"lumpiness": {"num_tiles": 8}}}),
    "t_mean_pcut_10": ("t_mean", {"args": {"t_mean": {"pcut": 0.1}}}),
    "hist_entropy_5_bins": ("hist_entropy", {"args": {"hist_entropy": {"num_bins": 5}}}),
    "moving_avg_window_30": ("moving_avg", {"args": {"moving_avg": {"window_size": 0.3}}}),
    "acf_4_lags": ("acf", {"args": {"acf": {"nlags": 4}}}),
    "model_mean_mae_3_folds": ("model_mean", {"score": "mae", "num_cv_folds": 3}),
    "model_naive_last_half": ("model_naive", {"lm_sample_frac": 0.5}),
    "trev_lag_2": ("trev", {"lag": 2}),
}


def _with_arguments(name: str, options: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = Extractor([name], summary=None, **options).fit(sources.events_by_user(spark, sf_dir)).raw()
        value = F.when(~F.isnan("value"), F.col("value")).alias("value")
        return out.select("series_id", value) if name in SCALARS else out.select("series_id", "idx", value)

    return run


def _rescaled(how: str):
    return lambda spark, sf_dir: Extractor(["t_mean"], summary=None).fit(sources.events_by_user(spark, sf_dir), rescale=how).raw().select("series_id", "value")


def _by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operators whose names begin with 'local', with arguments of a summary."""
    x = Extractor(["local_*"], summary=["powersum", "sd"], summary_args={"powersum": {"p": 3}, "sd": {"ddof": 0}})
    return x.fit(sources.events_by_user(spark, sf_dir)).extract().withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def queries() -> dict:
    out = {n: _relational(n) if n in relational.SQL else _kernel(n) for n in FEATURES}
    out |= {f"summary_{n}": _summary(n) for n in Extractor.valid_summary()}
    out |= {"extract": _extract, "extract_with_confidence": _confidence, "parse_by_group": _by_group, "summarize": _summaries_at_once}
    out |= {n: _with_arguments(*v) for n, v in WITH_ARGUMENTS.items()}
    out |= {f"rescale_{how.replace('-', '_')}": _rescaled(how) for how in ("standard", "min-max", "robust")}
    out["extract_by_pattern"] = _by_pattern
    out |= {f"source_{f.__name__}": f for f in (sources.events_by_user, sources.events_hourly, sources.orders_daily, sources.embeddings)}
    out["metafeature_description"] = lambda spark, sf_dir: Extractor.description(spark)
    return out


def oracle_sql() -> dict:
    return dict(oracles.SQL)
