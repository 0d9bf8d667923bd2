"""Feature operators as SQL plans over ``series`` (series_id, t, v) and ``nums`` (k = 0 ... 1023, or as far as half the longest series for the lags of ``acf`` and ``acf_diff``).

The text keeps to ANSI functions, so Catalyst plans it here and any SQL engine can run it for comparison.
Nothing is collected per series: windows, prefix sums, joins on (series_id, t + lag) or on (series_id, cell of values) and grouped sums only.
``run`` leaves ``GATHERED`` to the kernels.
Scalars give (series_id, value), arrays (series_id, idx, value). Undefined values are NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Standardized values: by mean and population deviation of the series; a constant series gives zeros.
Z = """s0 as (select series_id, t, v, count(*) over (partition by series_id) as n, avg(v) over (partition by series_id) as m, stddev_pop(v) over (partition by series_id) as sd from {series}),
z as (select series_id, t, v, n, case when sd > 0 then (v - m) / sd else v - m end as z from s0)"""
# Differences, renumbered from 0.
D = "d as (select series_id, t - 1 as t, v - p as v, p is null as gone from (select series_id, t, v, lag(v) over (partition by series_id order by t) as p from {series}) x), dd as (select series_id, t, v from d where not gone)"
# Windows of odd(ceil(n / 10)) values from prefix sums of powers: the row before a window's start (p) and its last row (q) meet on (series_id, t).
ROLL = Z + """, zw as (select series_id, t, n, z, lead(z) over (partition by series_id order by t) as nz, cast(ceil(cast(0.1 as double) * n) as bigint) - (1 - cast(ceil(cast(0.1 as double) * n) as bigint) % 2) as w from z),
zs as (select series_id, t, n, w, z, nz, sum(z) over s as s1, sum(z * z) over s as s2, sum(z * z * z) over s as s3, sum(z * z * z * z) over s as s4, sum(z * coalesce(nz, 0)) over s as sp,
  sum(case when z > 0 then ln(z) end) over s as sl, sum(case when z < 0 then 1 else 0 end) over s as neg, sum(case when z = 0 then 1 else 0 end) over s as zero from zw window s as (partition by series_id order by t rows between unbounded preceding and current row)),
r as (select q.series_id, q.t - q.w + 1 as pos, q.w, q.z as final, q.nz as beyond, p.nz as start, (q.s1 - coalesce(p.s1, 0)) / q.w as m1, (q.s2 - coalesce(p.s2, 0)) / q.w as m2, (q.s3 - coalesce(p.s3, 0)) / q.w as m3, (q.s4 - coalesce(p.s4, 0)) / q.w as m4,
  q.sp - coalesce(p.sp, 0) as sp, (coalesce(q.sl, 0) - coalesce(p.sl, 0)) / q.w as ml, q.neg - coalesce(p.neg, 0) as neg, q.zero - coalesce(p.zero, 0) as zero, coalesce(p.nz, q.first_z) as z0
  from (select *, first_value(z) over (partition by series_id order by t) as first_z from zs) q left join zs p on p.series_id = q.series_id and p.t = q.t - q.w where q.t >= q.w - 1),
rv as (select *, m2 - m1 * m1 as var, m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1 as c3, m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1 as c4 from r)"""
# Sixteen parts, the longer ones first; none for series shorter than twice as much.
TILES = Z + ", p as (select series_id, ntile(16) over (partition by series_id order by t) - 1 as idx, z from z where n >= 32)"
# Ten equal-width bins.
BINS = """b0 as (select series_id, t, v, min(v) over (partition by series_id) as lo, max(v) over (partition by series_id) as hi from {series}),
b as (select series_id, t, case when hi > lo then least(floor((v - lo) / (hi - lo) * 10), 9) else 0 end as bin from b0)"""
# Five expanding folds: train rows t < a, test rows a <= t < b; values scaled by the training part, time from 0 to 1.
FOLDS = """f0 as (select series_id, t, v, count(*) over (partition by series_id) as n from {series}),
f1 as (select series_id, t, v, n, k as fold, n - (5 - k) * cast(floor(n / 6) as bigint) as a, n - (4 - k) * cast(floor(n / 6) as bigint) as b from f0 cross join {nums} q where k < 5 and n >= 6),
f2 as (select series_id, fold, t, n, a, cast(t as double) / (n - 1) as x, v, min(case when t < a then v end) over (partition by series_id, fold) as lo, max(case when t < a then v end) over (partition by series_id, fold) as hi from f1 where t < b),
f as (select series_id, fold, t, a, x, case when hi > lo then (v - lo) / (hi - lo) else v - lo end as y, t >= a as test, t >= a - cast(ceil(cast(0.25 as double) * a) as bigint) and t < a as recent from f2)"""


def moments(x: str, table: str, kind: str, by: str) -> str:
    """Skewness or kurtosis of method 3 by group: population moments with the correction for n."""
    inner = f"select *, avg({x}) over (partition by {by}) as __m from {table}"
    if kind == "skew":
        e = f"case when avg(pow({x} - __m, 2)) > 0 then avg(pow({x} - __m, 3)) / pow(avg(pow({x} - __m, 2)), 1.5) * pow(cast(count(*) - 1 as double) / count(*), 1.5) end"
    else:
        e = f"case when avg(pow({x} - __m, 2)) > 0 then avg(pow({x} - __m, 4)) / pow(avg(pow({x} - __m, 2)), 2) * pow(1 - 1 / cast(count(*) as double), 2) - 3 end"
    return f"select {by}, {e} as value from ({inner}) y group by {by}"


def rolled(e: str) -> str:
    return f"select series_id, pos, value from (select series_id, pos, {e} as value from rv) y where value is not null"


def indexed(body: str) -> str:
    return f"select series_id, row_number() over (partition by series_id order by pos) - 1 as idx, value from ({body}) q"


def shifted(body: str) -> str:
    """Absolute differences of consecutive windows that have a value."""
    return f"select series_id, idx - 1 as idx, value from (select series_id, row_number() over (partition by series_id order by pos) - 1 as idx, abs(value - lag(value) over (partition by series_id order by pos)) as value from ({body}) q) y where value is not null"


def entropy_of(table: str, by: str = "series_id") -> str:
    """Entropy of counts c in bits over log2(10)."""
    return f"select {by}, -sum(p * ln(p)) / ln(10) + 0.0 as value from (select {by}, c / cast(sum(c) over (partition by {by}) as double) as p from {table}) y group by {by}"


def acf_of(table: str) -> str:
    return f"""a0 as (select series_id, t, count(*) over (partition by series_id) as n, v - avg(v) over (partition by series_id) as c from {table}),
a1 as (select series_id, sum(c * c) / count(*) as c0 from a0 group by series_id),
a2 as (select x.series_id, q.k, sum(x.c * y.c) / (x.n - q.k) as ck from a0 x join {{nums}} q on q.k >= 1 and q.k <= floor(x.n / 2) join a0 y on y.series_id = x.series_id and y.t = x.t + q.k group by x.series_id, q.k, x.n)
select a2.series_id, cast(a2.k - 1 as bigint) as idx, case when c0 > 0 then ck / c0 end as value from a2 join a1 on a2.series_id = a1.series_id"""


#: Cells as wide as the radius, and those beside each: close values lie in one or the next, so pairs meet on (series_id, cell).
CELLS = "(select -1 as shift union all select 0 union all select 1)"


def pairs_below(table: str, radius: float = 0.2) -> str:
    """Numbers of close pairs of delay vectors of dimension 2 and 3 (lag 1), of different places."""
    return f"""e as (select series_id, t, z, lead(z) over (partition by series_id order by t) as z1, lead(z, 2) over (partition by series_id order by t) as z2, floor(z / {radius}) as cell from {table}),
c as (select a.series_id, count(*) as two, sum(case when a.z2 is not null and b.z2 is not null and abs(a.z2 - b.z2) < {radius} then 1 else 0 end) as three
  from (select e.*, cell + shift as beside from e cross join {CELLS} x where z1 is not null) a join e b on a.series_id = b.series_id and b.cell = a.beside and a.t < b.t where b.z1 is not null and abs(a.z - b.z) < {radius} and abs(a.z1 - b.z1) < {radius} group by a.series_id)
select i.series_id, case when two > 0 and three > 0 then ln(two) - ln(three) end as value from (select distinct series_id from {table}) i left join c on i.series_id = c.series_id"""


def landmark(prediction: str, extra: str = "") -> str:
    """Root mean squared error by fold of a prediction from training sums (m) for test rows (f)."""
    train = f"m as (select series_id, fold, avg(y) as mean, avg(case when recent then y end) as loc, max(case when t = a - 1 then y end) as final, min(case when t = 0 then y end) as start, max(a) as a, regr_slope(y, x) as slope, regr_intercept(y, x) as cut{extra} from f where not test group by series_id, fold)"
    return f"{FOLDS}, {train} select f.series_id, cast(f.fold as bigint) as idx, sqrt(avg(pow({prediction} - f.y, 2))) as value from f join m on f.series_id = m.series_id and f.fold = m.fold where f.test group by f.series_id, f.fold"


def _with(ctes: str, body: str) -> str:
    return f"with {ctes} {body}"


#: Below this a window of standardized values is constant but for the rounding of the sums.
_FLAT = "1e-10"
_ROLLED = {
    "moving_avg": rolled("m1"),
    "moving_var": rolled(f"case when w > 1 then case when var > {_FLAT} then var else 0 end * w / (w - 1) end"),
    "moving_sd": rolled(f"case when w > 1 then sqrt(case when var > {_FLAT} then var else 0 end * w / (w - 1)) end"),
    "moving_gmean": rolled("case when neg > 0 then null when zero > 0 then 0.0 else exp(ml) end"),
    "moving_acf": rolled(f"case when w > 1 and var > {_FLAT} then ((sp - final * coalesce(beyond, 0)) - m1 * (2 * m1 * w - final - z0) + (w - 1) * m1 * m1) / (w - 1) / var end"),
    "moving_skewness": rolled(f"case when var > {_FLAT} then c3 / pow(var, 1.5) * pow(cast(w - 1 as double) / w, 1.5) end"),
    "moving_kurtosis": rolled(f"case when var > {_FLAT} then c4 / (var * var) * pow(1 - 1 / cast(w as double), 2) - 3 end"),
}

SQL: dict[str, str] = {
    "length": "select series_id, cast(count(*) as double) as value from {series} group by series_id",
    "diff": _with(D, "select series_id, t as idx, v as value from dd"),
    "turning_points": "select series_id, t as idx, case when (v - lag(v) over (partition by series_id order by t)) * (lead(v) over (partition by series_id order by t) - v) < 0 then 1.0e0 else 0.0e0 end as value from {series}",
    "step_changes": "select series_id, t - 2 as idx, case when abs(v - m) > 2.000000002e0 * sd then 1.0e0 else 0.0e0 end as value from (select series_id, t, v, avg(v) over (partition by series_id order by t rows between unbounded preceding and 1 preceding) as m, stddev_samp(v) over (partition by series_id order by t rows between unbounded preceding and 1 preceding) as sd from {series}) x where t > 1",
    "frac_cp": "with m as (select series_id, median(v) as m, count(*) as n from {series} group by series_id), c as (select s.series_id, n, s.v <= m.m as low, lag(s.v <= m.m) over (partition by s.series_id order by t) as before from {series} s join m on s.series_id = m.series_id) select series_id, case when max(n) > 1 then sum(case when low <> before then 1.0e0 else 0.0e0 end) / (max(n) - 1) end as value from c group by series_id",
    "bin_mean": "select series_id, t as idx, case when v >= avg(v) over (partition by series_id) then 1.0e0 else 0.0e0 end as value from {series}",
    "fs_len": _with(BINS, "select series_id, run as idx, cast(count(*) as double) as value from (select series_id, run, max(run) over (partition by series_id) as final from (select series_id, cast(sum(case when bin <> p then 1 else 0 end) over (partition by series_id order by t rows between unbounded preceding and current row) as bigint) as run from (select series_id, t, bin, lag(bin) over (partition by series_id order by t) as p from b) x) y) q where run < final group by series_id, run"),
    "stick_angles": _with(Z, "select series_id, row_number() over (partition by series_id order by neg, t) - 1 as idx, atan((n - 1) * (z - pz) / (t - pt)) as value from (select series_id, t, n, z, neg, lag(z) over (partition by series_id, neg order by t) as pz, lag(t) over (partition by series_id, neg order by t) as pt from (select series_id, t, n, z, case when z < 0 then 1 else 0 end as neg from z) x) y where pt is not null"),
    "ioe_tdelta_mean": _with(
        Z + """, i0 as (select series_id, t, n, abs(z) as a, 0.05e0 * stddev_pop(abs(z)) over (partition by series_id) as step, min(abs(z)) over (partition by series_id) as lo, max(abs(z)) over (partition by series_id) as hi from z),
i1 as (select series_id, t, n, lo, step, floor((a - lo) / step) as passed, least(1024, ceil(hi / step)) as steps from i0 where step > 0),
i2 as (select series_id, least(passed, steps) as passed, max(n) as n, max(steps) as steps, count(*) as c, sum(t) as s from i1 group by series_id, least(passed, steps)),
i3 as (select series_id, max(n) as n, max(steps) as steps from i2 group by series_id),
i4 as (select i3.series_id, q.k + 1 as k, max(i3.n) as n, sum(c) as c, sum(s) as s from i3 join {nums} q on q.k < i3.steps left join i2 on i2.series_id = i3.series_id and i2.passed >= q.k + 1 group by i3.series_id, q.k)""",
        "select series_id, cast(k - 1 as bigint) as idx, case when c >= 2 and c >= 0.02e0 * n then 2 * (s / cast(c as double)) / n - 1 else -1.0e0 end as value from i4",
    ),
    "sd_diff": _with(D, "select series_id, stddev_samp(v) as value from dd group by series_id"),
    "skewness_diff": _with(D, moments("v", "dd", "skew", "series_id")),
    "kurtosis_diff": _with(D, moments("v", "dd", "kurt", "series_id")),
    "t_mean": "select series_id, avg(v) as value from (select series_id, v, row_number() over (partition by series_id order by v) as r, count(*) over (partition by series_id) as n from {series}) x where r > floor(cast(0.02 as double) * n) and r <= n - floor(cast(0.02 as double) * n) group by series_id",
    # Pairs within the greatest radius (a cell) get the class of the least radius that holds them; running sums over classes count the rest.
    "corr_dim": "with g as (select series_id, stddev_samp(v) as sd, count(*) as n from {series} group by series_id), e as (select s.series_id, t, v, sd, floor(v / (sd * 0.5e0)) as cell from {series} s join g on g.series_id = s.series_id where sd > 0 and n > 2), "
    "p as (select series_id, greatest(0, cast(ceil(least(greatest(16 * ln(case when d > 0 then d / (sd * 0.1e0) else 1e-9 end) / ln(5) - 1e-9, -1), 17)) as bigint)) as cls, count(*) as c from (select a.series_id, a.sd, abs(a.v - b.v) as d from (select e.*, cell + shift as beside from e cross join " + CELLS + " x) a join e b on a.series_id = b.series_id and b.cell = a.beside and a.t < b.t) q where d <= sd * 0.5000000001e0 group by 1, 2), "
    "c as (select g.series_id, q.k, max(g.sd) * 0.1e0 * pow(5.0e0, q.k / 16.0e0) as r, sum(p.c) / (max(cast(g.n as double)) * (max(g.n) - 1) / 2) as share from g join {nums} q on q.k <= 16 join p on p.series_id = g.series_id and p.cls <= q.k group by g.series_id, q.k) "
    "select series_id, regr_slope(ln(share), ln(r)) as value from c where share > 0 group by series_id having count(*) > 1",
    "lumpiness": _with(TILES, "select series_id, idx, var_samp(z) as value from p group by series_id, idx"),
    "stability": _with(TILES, "select series_id, idx, avg(z) as value from p group by series_id, idx"),
    "local_extrema": _with(TILES, "select series_id, idx, case when abs(min(z)) <= max(z) then max(z) else min(z) end as value from p group by series_id, idx"),
    "local_range": _with(TILES, "select series_id, idx, max(z) - min(z) as value from p group by series_id, idx"),
    "hist_entropy": _with(BINS + ", h as (select series_id, bin, count(*) as c from b group by series_id, bin)", entropy_of("h")),
    "hist_ent_out_diff": "with " + BINS + ", h as (select series_id, bin, count(*) as c from b group by series_id, bin), q as (select series_id, percentile_cont(0.05) within group (order by v) as lo, percentile_cont(0.95) within group (order by v) as hi from {series} group by series_id), i0 as (select s.series_id, s.v, min(s.v) over (partition by s.series_id) as lo, max(s.v) over (partition by s.series_id) as hi from {series} s join q on s.series_id = q.series_id where s.v >= q.lo and s.v <= q.hi), g as (select series_id, case when hi > lo then least(floor((v - lo) / (hi - lo) * 10), 9) else 0 end as bin from i0), gh as (select series_id, bin, count(*) as c from g group by series_id, bin), x as (" + entropy_of("h") + "), y as (" + entropy_of("gh") + ") select x.series_id, x.value - y.value as value from x join y on x.series_id = y.series_id",
    "sample_entropy": "with " + Z + ", " + pairs_below("z"),
    "control_entropy": "with " + Z + ", zd as (select series_id, t, z - p as z from (select series_id, t, z, lag(z) over (partition by series_id order by t) as p from z) x where p is not null), " + pairs_below("zd"),
    "approx_entropy": "with " + Z + """, e as (select series_id, t, n, z, lead(z) over (partition by series_id order by t) as z1, lead(z, 2) over (partition by series_id order by t) as z2, floor(z / 0.2) as cell from z),
c as (select a.series_id, a.t, a.n, a.z2 is not null as has3, count(*) as two, sum(case when a.z2 is not null and b.z2 is not null and abs(a.z2 - b.z2) < 0.2 then 1 else 0 end) as three
  from (select e.*, cell + shift as beside from e cross join """ + CELLS + """ x where z1 is not null) a join e b on a.series_id = b.series_id and b.cell = a.beside where b.z1 is not null and abs(a.z - b.z) < 0.2 and abs(a.z1 - b.z1) < 0.2 group by a.series_id, a.t, a.n, a.z2)
select series_id, avg(ln(two / cast(n - 1 as double))) - avg(case when has3 then ln(three / cast(n - 2 as double)) end) as value from c where n >= 3 group by series_id""",
    "acf": "with " + acf_of("{series}"),
    "acf_diff": "with " + D + ", " + acf_of("dd"),
    "model_mean": "with " + landmark("m.mean"),
    "model_loc_mean": "with " + landmark("m.loc"),
    "model_loc_median": "with " + landmark("m.med", ", median(case when recent then y end) as med"),
    "model_linear": "with " + landmark("(m.cut + m.slope * f.x)"),
    "model_naive": "with " + landmark("m.final"),
    "model_naive_drift": "with " + landmark("(m.final + (m.final - m.start) / (m.a - 1) * (f.t - m.a + 1))"),
    "model_arima_010_c": "with " + landmark("(m.final + (m.final - m.start) / (m.a - 1) * (f.t - m.a + 1))"),
}
for _name, _body in _ROLLED.items():
    SQL[_name] = _with(ROLL, indexed(_body))
    SQL[_name + "_shift"] = _with(ROLL, shifted(_body))

#: Summaries of an array-valued feature in a table ``x`` (series_id, idx, value).
SUMMARIES: dict[str, str] = {}
_GOOD = "case when value is not null and not isnan(value) then value end"
for _p, _x in (("", "value"), ("nan", _GOOD)):
    _n = f"count({_x})"
    SUMMARIES |= {
        f"{_p}mean": f"avg({_x})", f"{_p}sd": f"stddev_samp({_x})", f"{_p}var": f"var_samp({_x})", f"{_p}count": f"cast({_n} as double)", f"{_p}max": f"max({_x})", f"{_p}min": f"min({_x})", f"{_p}median": f"median({_x})",
        f"{_p}sum": f"sum({_x})", f"{_p}range": f"max({_x}) - min({_x})", f"{_p}iq_range": f"percentile_cont(0.75) within group (order by {_x}) - percentile_cont(0.25) within group (order by {_x})",
        f"{_p}powersum": f"sum(pow({_x}, 2))", f"{_p}pnorm": f"sqrt(sum(pow({_x}, 2)))",
        f"{_p}skewness": f"case when var_pop({_x}) > 0 then avg(pow({_x} - __m, 3)) / pow(avg(pow({_x} - __m, 2)), 1.5) * pow(cast({_n} - 1 as double) / {_n}, 1.5) end",
        f"{_p}kurtosis": f"case when var_pop({_x}) > 0 then avg(pow({_x} - __m, 4)) / pow(avg(pow({_x} - __m, 2)), 2) * pow(1 - 1 / cast({_n} as double), 2) - 3 end",
    }
VECTOR_SUMMARIES = ("histogram", "nanhistogram", "quantiles", "nanquantiles")


def summary_sql(name: str, table: str) -> str:
    """(series_id, value), or with idx for vectors, of the summary of ``table`` (series_id, value)."""
    kept = f"(select series_id, value from {table})" if not name.startswith("nan") else f"(select series_id, value from {table} where value is not null and not isnan(value))"
    base = name.removeprefix("nan")
    if base == "quantiles":
        q = " union all ".join(f"select series_id, cast({i} as bigint) as idx, percentile_cont({p}) within group (order by value) as value from x group by series_id" for i, p in enumerate((0.0, 0.25, 0.5, 0.75, 1.0)))
        return f"with x as {kept} {q}"
    if base == "histogram":
        return f"""with x as {kept}, e as (select series_id, value, min(value) over (partition by series_id) as lo, max(value) over (partition by series_id) as hi from x),
h as (select series_id, case when hi > lo then least(floor((value - lo) / (hi - lo) * 10), 9) else 5 end as bin from e)
select h.series_id, cast(q.k as bigint) as idx, avg(case when h.bin = q.k then 1.0e0 else 0.0e0 end) as value from h cross join {{nums}} q where q.k < 10 group by h.series_id, q.k"""
    return f"select series_id, {SUMMARIES[name]} as value from (select series_id, value, avg({_GOOD if name.startswith('nan') else 'value'}) over (partition by series_id) as __m from {table}) x group by series_id"


#: Their plans make a row for each value and lag, which is far more than the series; gathered, a transform of each series does.
GATHERED = ("acf", "acf_diff")


def run(name: str, series: DataFrame) -> DataFrame:
    if name in GATHERED:
        from ..plans.extract import features

        return features(series, [name]).select("series_id", "idx", F.nanvl("value", F.lit(None)).alias("value"))
    return plan(SQL[name], series)


def lags(series: DataFrame) -> DataFrame:
    """k from 0 to half the length of the longest series; none without series."""
    return series.sparkSession.sql("select explode(sequence(0L, max(n) div 2)) as k from (select count(*) as n from {series} group by series_id) x", series=series)


def plan(sql: str, series: DataFrame, **tables: DataFrame) -> DataFrame:
    spark = series.sparkSession
    used = {k: v for k, v in {"series": series, "nums": spark.range(1024).withColumnRenamed("id", "k"), **tables}.items() if "{" + k + "}" in sql}
    return spark.sql(sql, **used)
