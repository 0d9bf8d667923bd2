"""SQL for comparison, written from the definitions apart from the plans: each series is one list, and features are list expressions.

DuckDB's dialect. None of this shares text or constants with the plans, which work on the long table.
"""

from __future__ import annotations

SERIES = "(select user_id as id, list(cast(value as double) order by ts, event_id) as x from events where value is not null and user_id is not null group by user_id)"
#: Lists x (values), z (standardized) and n, by id.
BASE = f"""l0 as (select id, x, len(x) as n, list_avg(x) as mu, list_aggregate(x, 'stddev_pop') as sd from {SERIES}),
l as (select id, x, n, list_transform(x, lambda v: case when sd > 0 then (v - mu) / sd else v - mu end) as z from l0)"""


def each(a: str, i: str, e: str) -> str:
    return f"list_transform({a}, lambda {i}: {e})"


def upto(n: str, i: str, e: str) -> str:
    """List of ``e`` for ``i`` from 1 to ``n``."""
    return each(f"range(1, {n} + 1)", i, e)


def scalar(e: str, *ctes: str, frm: str = "l") -> str:
    return f"with {', '.join((BASE, *ctes))} select id as series_id, {e} as value from {frm}"


def array(e: str, *ctes: str, frm: str = "l", nulls: bool = True) -> str:
    keep = "" if nulls else " where value is not null"
    return f"with {', '.join((BASE, *ctes))}, a as (select id, {e} as a from {frm}) select series_id, idx, value from (select id as series_id, unnest(range(0, len(a))) as idx, unnest(a) as value from a) u{keep}"


def centred(u: str, power: int) -> str:
    return f"list_avg({each(u, 'cv', f'pow(cv - list_avg({u}), {power})')})"


def shape(u: str, power: int) -> str:
    """Skewness (3) or kurtosis (4) with the factor for the number of values."""
    more = "" if power == 3 else " - 3"
    return f"case when len({u}) > 0 and {centred(u, 2)} > 0 then {centred(u, power)} / pow({centred(u, 2)}, {power}e0 / 2) * pow(1 - 1e0 / len({u}), {power}e0 / 2){more} end"


def steps(x: str) -> str:
    return f"{upto(f'(len({x}) - 1)', 'di', f'{x}[di + 1] - {x}[di]')}"


def entropy10(bins: str) -> str:
    share = f"len(list_filter({bins}, lambda eb: eb = ed)) / cast(len({bins}) as double)"
    return f"0.0 - list_sum({each(f'list_distinct({bins})', 'ed', f'({share}) * log2({share})')}) / log2(10)"


def tenths(x: str, num: int = 10, slack: str = "") -> str:
    return each(x, "bv", f"case when list_max({x}) > list_min({x}) then least({num - 1}, floor({num} * ((bv - list_min({x})) / (list_max({x}) - list_min({x}))){slack})) else 0 end")


def acf(x: str) -> str:
    c = each(x, "av", f"av - list_avg({x})")
    return f"{upto('(len(c) // 2)', 'k', 'case when list_sum(' + each('c', 'q', 'q * q') + ') > 0 then list_sum(' + upto('(len(c) - k)', 'i', 'c[i] * c[i + k]') + ') / (len(c) - k) / list_avg(' + each('c', 'q', 'q * q') + ') end')}", f"c as (select id, {c} as c from l)"


def near(z: str, dim: int) -> str:
    """For each delay vector of ``dim`` values, how many lie within 0.2 in every coordinate, itself included."""
    close = " and ".join(f"abs({z}[i + {d}] - {z}[j + {d}]) < 0.2" for d in range(dim))
    return upto(f"(len({z}) - {dim - 1})", "i", f"len(list_filter(range(1, len({z}) - {dim - 2}), lambda j: {close}))")


def log_pairs(z: str) -> str:
    """Log ratio of the numbers of close pairs of different places in two and three dimensions."""
    two, three = (f"(list_sum({near(z, d)}) - (len({z}) - {d - 1}))" for d in (2, 3))
    return f"case when len({z}) > 3 and {two} > 0 and {three} > 0 then ln({two}) - ln({three}) end"


# Windows of an odd number of values, a tenth of the series.
W = "v as (select id, z, n, cast(ceil(n / 10.0) as int) - cast(ceil(n / 10.0) + 1 as int) % 2 as w from l), r as (select id, w, list_transform(range(0, n - w + 1), lambda i: z[i + 1 : i + w]) as u from v)"
_ONE = {
    "moving_avg": "list_avg(u1)", "moving_var": "list_aggregate(u1, 'var_samp')", "moving_sd": "list_aggregate(u1, 'stddev_samp')",
    "moving_gmean": "case when list_min(u1) > 0 then exp(list_avg(" + each("u1", "g", "ln(g)") + ")) when list_min(u1) = 0 then 0.0 end",
    "moving_acf": f"case when len(u1) > 1 and {centred('u1', 2)} > 0 then list_sum({upto('(len(u1) - 1)', 'i', '(u1[i] - list_avg(u1)) * (u1[i + 1] - list_avg(u1))')}) / (len(u1) - 1) / {centred('u1', 2)} end",
    "moving_skewness": shape("u1", 3), "moving_kurtosis": shape("u1", 4),
}
_DROP = "list_filter({}, lambda d: d is not null and not isnan(d))"
_APEN = f"list_avg({each(near('y', 2), 'q', 'ln(q / cast(len(y) - 1 as double))')}) - list_avg({each(near('y', 3), 'q', 'ln(q / cast(len(y) - 2 as double))')})"

_TILE = "t as (select id, z, n, list_transform(range(0, case when n >= 32 then 16 else 0 end), lambda k: z[k * (n // 16) + least(k, n % 16) + 1 : (k + 1) * (n // 16) + least(k + 1, n % 16)]) as u from l)"

_FOLD = """g as (select id, x, n, n // 6 as f from l where n >= 6),
h as (select id, n, f, k, n - (5 - k) * f as a, x[1 : n - (5 - k) * f] as tr, x[n - (5 - k) * f + 1 : n - (4 - k) * f] as te from g, range(0, 5) q(k)),
m as (select id, n, f, k, a, list_transform(tr, lambda v: case when list_max(tr) > list_min(tr) then (v - list_min(tr)) / (list_max(tr) - list_min(tr)) else v - list_min(tr) end) as tr,
  list_transform(te, lambda v: case when list_max(tr) > list_min(tr) then (v - list_min(tr)) / (list_max(tr) - list_min(tr)) else v - list_min(tr) end) as te from h)"""
_LINE = f"list_sum({upto('a', 'i', '(i - (a + 1) / 2.0) * (tr[i] - list_avg(tr))')}) / list_sum({upto('a', 'i', 'pow(i - (a + 1) / 2.0, 2)')})"


def fold(p: str) -> str:
    """Root mean squared error by fold of the prediction ``p`` of test value i (from 1)."""
    return f"with {BASE}, {_FOLD} select id as series_id, cast(k as bigint) as idx, sqrt(list_avg({upto('len(te)', 'i', f'pow({p} - te[i], 2)')})) as value from m"


def fold_lag(p: str) -> str:
    """First lag at which the autocorrelation of the errors is not positive, by fold."""
    r = f"e as (select id, k, {upto('len(te)', 'i', f'te[i] - ({p})')} as e from m), c as (select id, k, {each('e', 'ev', 'ev - list_avg(e)')} as c from e)"
    first = f"list_position({upto('(len(c) // 2)', 'k1', 'list_sum(' + upto('(len(c) - k1)', 'i', 'c[i] * c[i + k1]') + ') <= 0')}, true)"
    return f"with {BASE}, {_FOLD}, {r} select id as series_id, cast(k as bigint) as idx, cast({first} as double) as value from c"


_WALK = f"w as (select id, n, z, {upto('n', 'i', 'coalesce(list_sum(' + upto('(i - 1)', 'j', '0.1 * pow(0.9, i - 1 - j) * z[j]') + '), 0)')} as w from l)"
_GRID = """s1 as (select id, n, list_transform(z, lambda v: abs(v)) as a from l), s2 as (select id, n, a, 0.05 * list_aggregate(a, 'stddev_pop') as st from s1),
s3 as (select id, n, list_transform(range(1, cast(least(1024, ceil(list_max(a) / st)) as int) + 1), lambda k: list_filter(range(0, n), lambda i: a[i + 1] >= list_min(a) + k * st)) as kept from s2 where st > 0),
s4 as (select id, n, list_transform(kept, lambda q: case when len(q) >= 2 and len(q) >= 0.02 * n then q else [] end) as kept from s3)"""
_GAPS = f"""s5 as (select id, {each('kept', 'q', "case when len(q) = 0 then 0.0 else list_aggregate(q, 'stddev_samp') / sqrt(len(q)) end")} as y from s4),
s6 as (select id, y, len(y) as m, {upto('len(y)', 'i', '(i - 1) * 0.05')} as t from s5),
s7 as (select id, y, m, t, list_sum({upto('m', 'i', '(t[i] - list_avg(t)) * (y[i] - list_avg(y))')}) / list_sum({upto('m', 'i', 'pow(t[i] - list_avg(t), 2)')}) as b from s6 where m >= 3)"""
_NN = "case when isnan({0}) then null else {0} end"


def _log_log(sizes: str, measure: str, *ctes: str) -> str:
    """Slope of the log of a measure m of each window size w on the log of the size."""
    return f"with {', '.join((BASE, *ctes))}, z1 as (select id, x, n, unnest(list_distinct({sizes})) as w from l0x), z2 as (select id, w, {measure} as m from z1) select l.id as series_id, regr_slope(ln(m), ln(w)) as value from l left join (select * from z2 where m > 0 and not isnan(m)) z3 on l.id = z3.id group by l.id"


def _geom(lo: str, hi: str, k: int) -> str:
    return f"list_transform(range(0, {k}), lambda k: cast(floor(case when k = 0 then {lo} when k = {k - 1} then {hi} else exp(ln({lo}) + k * ln(({hi}) / cast({lo} as double)) / {k - 1}) end) as bigint))"


def _sql() -> dict[str, str]:
    x, out = "x", {}
    out["length"] = scalar("cast(n as double)")
    out["diff"] = array(steps("x"))
    out["turning_points"] = array(upto("n", "i", "case when i > 1 and i < n and (x[i] > x[i - 1] and x[i] > x[i + 1] or x[i] < x[i - 1] and x[i] < x[i + 1]) then 1.0 else 0.0 end"))
    out["step_changes"] = array(each("range(3, n + 1)", "i", "case when abs(x[i] - list_avg(x[1 : i - 1])) > 2.000000002 * list_aggregate(x[1 : i - 1], 'stddev_samp') then 1.0 else 0.0 end"))
    out["frac_cp"] = scalar(f"case when n > 1 then list_sum({upto('(n - 1)', 'i', 'case when (x[i] <= list_median(x)) <> (x[i + 1] <= list_median(x)) then 1.0 else 0.0 end')}) / (n - 1) end").replace("list_median(x)", "list_aggregate(x, 'median')")
    out["bin_mean"] = array(each("x", "v", "case when v >= list_avg(x) then 1.0 else 0.0 end"))
    b = f"b as (select id, n, {tenths('x')} as b from l), p as (select id, list_filter(range(1, n), lambda i: b[i] <> b[i + 1]) as p from b)"
    out["fs_len"] = array(upto("len(p)", "k", "cast(p[k] - case when k > 1 then p[k - 1] else 0 end as double)"), b, frm="p")
    out["walker_path"] = array(upto("n", "i", "abs(w[i] - z[i])"), _WALK, frm="w")
    out["walker_cross_frac"] = scalar(f"case when n > 1 then list_sum({upto('(n - 1)', 'i', 'case when (w[i] - z[i]) * (w[i + 1] - z[i + 1]) < 0 then 1.0 else 0.0 end')}) / (n - 1) end", _WALK, frm="w")
    grown = f"list_reduce(list_prepend([1.0::double], {each('z', 'v', '[abs(v)]')}), lambda s, e: list_append(s, case when e[1] > s[-1] then 1.1 * e[1] else 0.9 * s[-1] end))"
    out["moving_threshold"] = array(grown)
    moved = "list_reduce(list_prepend({'p': [0.0::double], 'q': 0.0::double}, list_transform(z[1 : n - 1], lambda f: {'p': [f], 'q': 0.0::double})), lambda s, e: {'p': list_append(s.p, s.p[-1] + 0.1 * s.q + 0.01 * (sin(s.p[-1]) + e.p[1] - s.q)), 'q': s.q + 0.1 * (sin(s.p[-1]) + e.p[1] - s.q)}).p"
    out["force_potential"] = array(moved)
    side = "list_filter(range(1, n + 1), lambda i: {})"
    angles = each("range(1, greatest(len({0}), 1))", "k", "atan((n - 1) * (z[{0}[k + 1]] - z[{0}[k]]) / ({0}[k + 1] - {0}[k]))")
    out["stick_angles"] = array(f"list_concat({angles.format('up')}, {angles.format('down')})", f"sides as (select id, n, z, {side.format('z[i] >= 0')} as up, {side.format('z[i] < 0')} as down from l)", frm="sides")
    out["ioe_tdelta_mean"] = array(each("kept", "q", "case when len(q) > 0 then 2 * list_avg(q) / n - 1 else -1.0 end"), _GRID, frm="s4")
    total, rest = f"list_sum({each('y', 'v', 'pow(v - list_avg(y), 2)')})", f"list_sum({upto('m', 'i', 'pow(y[i] - list_avg(y) - b * (t[i] - list_avg(t)), 2)')})"
    out["ioe_std_slope"] = scalar(_NN.format("b"), _GRID, _GAPS, frm="l left join s7 using (id)")
    out["ioe_std_adj_r_sqr"] = scalar(_NN.format(f"(1 - {rest} / {total} * (m - 1) / (m - 2))"), _GRID, _GAPS, frm="l left join s7 using (id)")
    d = f"d as (select id, {steps('x')} as d from l)"
    out["sd_diff"] = scalar("list_aggregate(d, 'stddev_samp')", d, frm="d")
    out["skewness_diff"] = scalar(shape("d", 3), d, frm="d")
    out["kurtosis_diff"] = scalar(shape("d", 4), d, frm="d")
    out["t_mean"] = scalar("list_avg(list_sort(x)[cast(floor(0.02 * n) as int) + 1 : n - cast(floor(0.02 * n) as int)])")
    radius = upto("17", "k", "list_aggregate(x, 'stddev_samp') * 0.1 * pow(5, (k - 1) / 16.0)")
    out["corr_dim"] = f"""with {BASE}, r as (select id, x, n, unnest({radius}) as r from l where n > 2), s as (select id, r, list_sum({upto('(n - 1)', 'i', 'len(list_filter(x[i + 1 : n], lambda q: abs(q - x[i]) <= r))')}) / (n * (n - 1) / 2) as s from r where r > 0)
select l.id as series_id, case when count(s) > 1 then regr_slope(ln(s), ln(r)) end as value from l left join (select * from s where s > 0) s on l.id = s.id group by l.id having count(s) > 1"""
    for name, e in (("lumpiness", "list_aggregate(u1, 'var_samp')"), ("stability", "list_avg(u1)"), ("local_extrema", "case when list_max(u1) >= abs(list_min(u1)) then list_max(u1) else list_min(u1) end"), ("local_range", "list_max(u1) - list_min(u1)")):
        out[name] = array(each("u", "u1", e), _TILE, frm="t")
    for name, e in _ONE.items():
        drop = f"k as (select id, {_DROP.format(each('u', 'u1', e))} as q from r)"
        out[name] = array("q", W, drop, frm="k")
        out[name + "_shift"] = array(upto("(len(q) - 1)", "i", "abs(q[i + 1] - q[i])"), W, drop, frm="k")
    y = "(" + each("u1", "sv", f"case when {centred('u1', 2)} > 0 then (sv - list_avg(u1)) / sqrt({centred('u1', 2)}) else sv - list_avg(u1) end") + ")"
    long = f"y as (select id, idx, y from (select id, unnest(range(0, len(u))) as idx, unnest({each('u', 'u1', y)}) as y from r) q0), k as (select id, idx, case when len(y) >= 3 then {_APEN} end as q from y)"
    out["moving_approx_ent"] = f"with {BASE}, {W}, {long} select id as series_id, row_number() over (partition by id order by idx) - 1 as idx, q as value from k where q is not null"
    parts = f"h as (select id, w, {each('u', 'u1', each('range(0, 10)', 'hb', 'len(list_filter(' + tenths('u1', 10, ' + 1e-9').replace('else 0 end', 'else 5 end') + ', lambda hc: hc = hb)) / cast(len(u1) as double)'))} as h from r)"
    one = "list_sum(list_transform(range(1, 11), lambda j: case when h[i + w][j] > 0 then h[i + w][j] * ln(h[i + w][j] / h[i][j]) else 0 end))"
    bad = "len(list_filter(range(1, 11), lambda j: h[i + w][j] > 0 and h[i][j] = 0)) > 0"
    kl = f"k as (select id, list_append(list_filter({upto('greatest(len(h) - w, 0)', 'i', f'case when {bad} then null else {one} end')}, lambda d: d is not null), 0.0) as q from h)"
    out["moving_kldiv"] = array("q", W, parts, kl, frm="k")
    out["moving_kldiv_shift"] = array(upto("(len(q) - 1)", "i", "abs(q[i + 1] - q[i])"), W, parts, kl, frm="k")
    out["hist_entropy"] = scalar(entropy10("b"), f"b as (select id, {tenths('x')} as b from l)", frm="b")
    inner = f"i as (select id, x, list_filter(x, lambda v: v >= list_aggregate(x, 'quantile_cont', 0.05) and v <= list_aggregate(x, 'quantile_cont', 0.95)) as y from l), b as (select id, {tenths('x')} as b, {tenths('y')} as c from i)"
    out["hist_ent_out_diff"] = scalar(f"({entropy10('b')}) - ({entropy10('c')})", inner, frm="b")
    out["sample_entropy"] = scalar(log_pairs("z"))
    out["control_entropy"] = scalar(log_pairs("d"), f"d as (select id, {steps('z')} as d from l)", frm="d")
    out["approx_entropy"] = scalar(f"case when n >= 3 then {_APEN} end", "y as (select id, n, z as y from l)", frm="y where n >= 3")
    lz = "list_reduce(list_prepend({'p': '', 's': []::varchar[]}, list_transform(b, lambda v: {'p': cast(v as int) || ',', 's': []::varchar[]})), lambda s, e: case when list_contains(s.s, s.p || e.p) then {'p': s.p || e.p, 's': s.s} else {'p': '', 's': list_append(s.s, s.p || e.p)} end).s"
    out["lz_complexity"] = scalar(f"len({lz}) * ln(n) / (n * ln(10))", f"b as (select id, n, {tenths('x')} as b from l)", frm="b")
    e, c = acf("x")
    out["acf"] = array(e, c, frm="c")
    e, c = acf("d")
    out["acf_diff"] = array(e, d, c.replace("from l)", "from d)"), frm="c")
    seg = "x[p * w + 1 : (p + 1) * w]"
    walk = "list_transform(range(1, w + 1), lambda i: list_sum(list_transform(SEG[1 : i], lambda v: v - list_avg(SEG))))".replace("SEG", seg)
    rs = f"list_aggregate(list_filter({each('range(0, n // w)', 'p', f'''case when list_aggregate({seg}, 'stddev_samp') > 0 then (list_max({walk}) - list_min({walk})) / list_aggregate({seg}, 'stddev_samp') end''')}, lambda q: q is not null), 'avg')"
    src = "l0x as (select id, x, n from l)"
    out["exp_hurst"] = _log_log(_geom("greatest(4, 0.02 * n)", "greatest(5, 0.5 * n)", 15), rs, src)
    path = f"l0x as (select id, {upto('n', 'i', 'list_sum(' + each('x[1 : i]', 'v', 'v - list_avg(x)') + ')')} as x, n from l where n >= 12)"
    part = "x[p + 1 : p + w]"
    slope = f"(list_sum({upto('w', 'i', f'{part}[i] * (i - (w + 1) / 2.0)')}) / (w * (w * w - 1) / 12.0))"
    spread = f"sqrt(list_avg({upto('w', 'i', f'pow({part}[i] - list_avg({part}) - {slope} * (i - (w + 1) / 2.0), 2)')}))"
    out["dfa"] = _log_log(f"case when n > 70 then {_geom('4', 'greatest(5, 0.1 * n)', 12)} else {_geom('4', 'n / 2.0', 12)} end", f"list_avg({each('range(0, n - w + 1, greatest(1, w // 2))', 'p', spread)})", path)
    out["model_mean"] = fold("list_avg(tr)")
    out["model_loc_mean"] = fold("list_avg(tr[a - cast(ceil(a / 4.0) as int) + 1 : a])")
    out["model_loc_median"] = fold("list_aggregate(tr[a - cast(ceil(a / 4.0) as int) + 1 : a], 'median')")
    line = f"(list_avg(tr) + {_LINE} * (a + i - (a + 1) / 2.0))"
    out["model_linear"] = fold(line)
    out["model_naive"] = fold("tr[a]")
    out["model_naive_drift"] = out["model_arima_010_c"] = fold("(tr[a] + i * (tr[a] - tr[1]) / (a - 1))")
    out["model_mean_acf_first_nonpos"] = fold_lag("list_avg(tr)")
    out["model_linear_acf_first_nonpos"] = fold_lag(line)
    # Summaries of the differences of each series.
    p = {
        "mean": "list_avg(d)", "sd": "list_aggregate(d, 'stddev_samp')", "var": "list_aggregate(d, 'var_samp')", "count": "cast(len(d) as double)", "max": "list_max(d)", "min": "list_min(d)", "median": "list_aggregate(d, 'median')",
        "sum": "list_sum(d)", "range": "list_max(d) - list_min(d)", "iq_range": "list_aggregate(d, 'quantile_cont', 0.75) - list_aggregate(d, 'quantile_cont', 0.25)",
        "powersum": f"list_sum({each('d', 'v', 'v * v')})", "pnorm": f"sqrt(list_sum({each('d', 'v', 'v * v')}))", "skewness": shape("d", 3), "kurtosis": shape("d", 4),
    }
    many = "d as (select id, d from (select id, " + steps("x") + " as d from l) q where len(d) > 0)"
    for k, e in p.items():
        out[f"summary_{k}"] = out[f"summary_nan{k}"] = scalar(e, many, frm="d")
    hist = each("range(0, 10)", "b", "len(list_filter(" + tenths("d").replace("else 0 end", "else 5 end") + ", lambda q: q = b)) / cast(len(d) as double)")
    out["summary_histogram"] = out["summary_nanhistogram"] = array(hist, many, frm="d")
    out["summary_quantiles"] = out["summary_nanquantiles"] = array("[" + ", ".join(f"list_aggregate(d, 'quantile_cont', {q})" for q in (0.0, 0.25, 0.5, 0.75, 1.0)) + "]", many, frm="d")
    return out




# ---- Decomposition, over the long table p (id, n, t, y), each step materialized.


def _lines(name: str, src: str, y: str, span: str) -> str:
    """Fits f and absolute left-one-out errors e of running lines of ``span`` points (a column of ``src``) through ``y``, beside all columns."""
    return f"""{name}_w as materialized (select *, greatest(1, {span} // 2) as hw, greatest(0, least(t - greatest(1, {span} // 2), greatest(0, n - 2 * greatest(1, {span} // 2) - 1))) as lo from {src}),
{name}_s as materialized (select a.id, a.t, count(*) as m, avg(b.t) as mt, avg(b.{y}) as my, sum((b.t - a.lo) * b.{y}) as sty, any_value(a.lo) as lo from {name}_w a join {src} b on a.id = b.id and b.t >= a.lo and b.t < least(a.lo + 2 * a.hw + 1, a.n) group by a.id, a.t),
{name}_b as materialized (select *, (sty - m * (mt - lo) * my) / (m * (cast(m as double) * m - 1) / 12) as sl from {name}_s),
{name} as materialized (select a.*, b.my + b.sl * (a.t - b.mt) as f, abs(a.{y} - b.my - b.sl * (a.t - b.mt)) / greatest(1 - 1e0 / m - pow(a.t - b.mt, 2) / (m * (cast(m as double) * m - 1) / 12), 1e-10) as e from {src} a join {name}_b b on a.id = b.id and a.t = b.t)"""


def _loess(name: str, src: str, key: str, y: str, n: str, span: str, low: str, high: str) -> str:
    """Local lines with tricube weights through ``y`` of ``src`` by ``key``, at at = low ... high."""
    keys = ", ".join(f"a.{k}" for k in key.split(", "))
    same = " and ".join(f"a.{k} = b.{k}" for k in key.split(", "))
    return f"""{name}_k as materialized (select distinct {key}, {n} as nn, {span} as sp from {src}),
{name}_a as materialized (select *, least({span.replace(span, 'sp')}, nn) as q from (select {key}, nn, sp, unnest(range({low}, cast({high} + 1 as bigint))) as pos from {name}_k) u),
{name}_l as materialized (select *, greatest(0, least(cast(ceil(pos - (q - 1) / 2.0) as bigint), nn - q)) as lo from {name}_a),
{name}_h as materialized (select *, greatest(abs(lo - pos), abs(lo + q - 1 - pos), 1e-12) * case when sp > nn then sp / cast(nn as double) else 1 end as h from {name}_l),
{name}_j as materialized (select {keys}, a.pos, b.t - a.pos as u, b.{y} as y, pow(greatest(0, 1 - pow(abs(b.t - a.pos) / (a.h * 1.0001), 3)), 3) as w from {name}_h a join {src} b on {same} and b.t >= a.lo and b.t < a.lo + a.q),
{name}_m as materialized (select {key}, pos, sum(w * y) / sum(w) as my, sum(w * u) / sum(w) as mu, sum(w * u * u) / sum(w) as uu, sum(w * u * y) / sum(w) as uy from {name}_j group by {key}, pos),
{name} as materialized (select {key}, pos, my - case when uu - mu * mu > 1e-12 then (uy - mu * my) / (uu - mu * mu) else 0 end * mu as f from {name}_m)"""


def _smoother(name: str, src: str) -> str:
    """Super smoother g of y of ``src`` (id, n, t, y)."""
    spans = ", ".join(f"greatest(2, cast(round_even({s} * n, 0) as bigint)) as s{i}" for i, s in enumerate((0.05, 0.2, 0.5)))
    parts = [f"{name}0 as materialized (select id, n, t, y, {spans} from {src} where n >= 3)"]
    for i in range(3):
        parts += [_lines(f"{name}f{i}", f"{name}0", "y", f"s{i}"), f"{name}r{i} as materialized (select id, n, t, s1, e as r from {name}f{i})", _lines(f"{name}e{i}", f"{name}r{i}", "r", "s1")]
    return ",\n".join(parts) + f""",
{name}1 as materialized (select a.id, a.n, a.t, a.s0, a.s1, a.s2, f0.f as f0, f1.f as f1, f2.f as f2, cast(case when e0.f <= e1.f and e0.f <= e2.f then a.s0 when e1.f <= e2.f then a.s1 else a.s2 end as double) as pick
  from {name}0 a join {name}f0 f0 using (id, t) join {name}f1 f1 using (id, t) join {name}f2 f2 using (id, t) join {name}e0 e0 using (id, t) join {name}e1 e1 using (id, t) join {name}e2 e2 using (id, t)),
""" + _lines(f"{name}p", f"{name}1", "pick", "s1") + f""",
{name}2 as materialized (select id, n, t, s0, case when sp > s1 then f1 + (f2 - f1) * (sp - s1) / greatest(s2 - s1, 1) else f0 + (f1 - f0) * (sp - s0) / greatest(s1 - s0, 1) end as o from (select *, greatest(s0, least(f, s2)) as sp from {name}p) q),
""" + _lines(f"{name}3", f"{name}2", "o", "s0") + f""",
{name} as materialized (select id, n, t, f as g from {name}3 union all select id, n, t, y from {src} where n < 3)"""


def _decomposed() -> str:
    """d: id, x, z, n, p (period), tr, se, re, dt (without trend), ds (without season), ac (autocorrelation of dt)."""
    steps = [BASE, "p0 as materialized (select id, n, unnest(range(0, n)) as t, unnest(x) as y from l)", _smoother("sm", "p0")]
    steps.append(f"""q0 as materialized (select p0.id, list(p0.y - sm.g order by p0.t) as q from p0 join sm using (id, t) group by p0.id), q1 as materialized (select id, {each('q', 'v', 'v - list_avg(q)')} as c from q0),
q2 as materialized (select id, case when list_sum({each('c', 'v', 'v * v')}) > 0 then {upto('(len(c) // 2)', 'k', 'abs(list_sum(' + upto('(len(c) - k)', 'i', 'c[i] * c[i + k]') + ') / (len(c) - k))')} else [] end as r from q1),
pd as materialized (select id, case when len(r) > 0 then list_position(r, list_max(r)) else 1 end as p from q2),
y0 as materialized (select id, n, p, t, y, cast(0 as double) as tr from p0 join pd using (id) where p > 1 and n >= 2 * p)""")
    odd = lambda e: f"(cast(ceil({e}) as bigint) + 1 - cast(ceil({e}) as bigint) % 2)"
    for i in range(5):
        steps += [
            f"c{i} as materialized (select id, n, p, t % p as ph, t // p as t, y - tr as y, (n - 1 - t % p) // p + 1 as m from y{i})",
            _loess(f"cl{i}", f"c{i}", "id, n, p, ph", "y", "m", "7", "-1", "nn"),
            f"cy{i} as materialized (select id, n, p, list(f order by ph + p * (pos + 1)) as c from cl{i} group by id, n, p)",
            f"ma{i} as materialized (select id, n, p, c, {upto('(n + 2)', 'i', 'list_avg(a[i : i + p - 1])')} as b from (select id, n, p, c, {upto('(n + p + 1)', 'i', 'list_avg(c[i : i + p - 1])')} as a from cy{i}) q)",
            f"lo{i} as materialized (select id, n, p, unnest(range(0, n)) as t, unnest({upto('n', 'i', '(b[i] + b[i + 1] + b[i + 2]) / 3')}) as y, unnest(c[p + 1 : p + n]) as c from ma{i})",
            _loess(f"ll{i}", f"lo{i}", "id, n, p", "y", "n", odd("p + 1"), "0", "nn - 1"),
            f"s{i} as materialized (select a.id, a.n, a.p, a.t, y.y as full_y, y.y - (a.c - b.f) as y, a.c - b.f as se from lo{i} a join ll{i} b on a.id = b.id and a.t = b.pos join y{i} y on a.id = y.id and a.t = y.t)",
            _loess(f"tl{i}", f"s{i}", "id, n, p", "y", "n", odd("1.5 * p / (1 - 1.5 / 7)"), "0", "nn - 1"),
            f"y{i + 1} as materialized (select a.id, a.n, a.p, a.t, a.full_y as y, b.f as tr, a.se from s{i} a join tl{i} b on a.id = b.id and a.t = b.pos)",
        ]
    steps.append(f"""al as materialized (select id, t, y, tr, se from y5 union all select p0.id, p0.t, p0.y, sm.g, 0.0 from p0 join sm using (id, t) where p0.id not in (select id from y5)),
dl as materialized (select id, list(tr order by t) as tr, list(se order by t) as se, list(y - tr - se order by t) as re, list(y - tr order by t) as dt, list(y - se order by t) as ds from al group by id),
dr as materialized (select dl.id, case when list_max({each('re', 'v', 'abs(v)')}) <= 1e-9 * list_aggregate(x, 'stddev_pop') then {each('re', 'v', '0.0')} else re end as re from dl join l using (id)),
dc as materialized (select id, {each('dt', 'v', 'v - list_avg(dt)')} as c from dl),
da as materialized (select id, {upto('(len(c) // 2)', 'k', 'case when list_sum(' + each('c', 'q', 'q * q') + ') > 0 then list_sum(' + upto('(len(c) - k)', 'i', 'c[i] * c[i + k]') + ') / (len(c) - k) / list_avg(' + each('c', 'q', 'q * q') + ') end')} as ac from dc),
dd as materialized (select l.id, l.x, l.z, l.n, pd.p, dl.tr, dl.se, dr.re, dl.dt, dl.ds, da.ac from l join pd using (id) join dl using (id) join dr using (id) join da using (id)),
d as materialized (select *, coalesce(list_position({each('ac', 'v', 'abs(v) <= 1.96 / sqrt(n)')}, true), 1) as lag, list_position({each('ac', 'v', 'v <= 0')}, true) as np from dd)""")
    return ",\n".join(steps)


DECOMPOSED = _decomposed()


def _of(e: str, *ctes: str, frm: str = "d", many: bool = False) -> str:
    head = f"with {', '.join((DECOMPOSED, *ctes))}"
    if not many:
        return f"{head} select id as series_id, {e} as value from {frm}"
    return f"{head}, aa as (select id, {e} as a from {frm}) select id as series_id, unnest(range(0, len(a))) as idx, unnest(a) as value from aa"


def _spectrum(window: str) -> str:
    return f"""w0 as materialized (select id, n, {upto('n', 'k', window)} as w, re from d), w1 as materialized (select id, n, list_sum(w) as sw, {upto('n', 'k', 'w[k] * re[k]')} as y from w0),
sp as materialized (select id, n, {upto('(n // 2 + 1)', 'f', "(pow(list_sum(" + upto('n', 'k', 'y[k] * cos(2 * pi() * (f - 1) * (k - 1) / n)') + "), 2) + pow(list_sum(" + upto('n', 'k', 'y[k] * sin(2 * pi() * (f - 1) * (k - 1) / n)') + "), 2)) / (sw * sw) * case when f = 1 or (n % 2 = 0 and f = n // 2 + 1) then 1 else 2 end")} as s from w1)"""


def _mutual(x: str, k: str, num: int = 64) -> str:
    a, b = f"{x}[1 : n - {k}]", f"{x}[{k} + 1 : n]"
    h = lambda bins: f"(0.0 - list_sum(list_transform(list_distinct({bins}), lambda mb: (len(list_filter({bins}, lambda mc: mc = mb)) / cast(n - {k} as double)) * log2(len(list_filter({bins}, lambda mc: mc = mb)) / cast(n - {k} as double)))))"
    both = f"list_transform(range(1, n - {k} + 1), lambda mi: ta[mi] * {num} + tb[mi])"
    return f"{h('ta')} + {h('tb')} - {h('tj')}", tenths(a, num), tenths(b, num), both


def _ami(x: str, lags: str, num: int = 64) -> str:
    """at: id, k, v for k = 1 ... lags."""
    e, a, b, both = _mutual(x, "k", num)
    return f"""m0 as materialized (select id, n, {x}, unnest(range(1, {lags} + 1)) as k from d), m1 as materialized (select id, n, k, {a} as ta, {b} as tb from m0), m2 as materialized (select id, n, k, ta, tb, {both} as tj from m1), ml as materialized (select id, list({e} order by k) as v from m2 group by id)"""


def _decomposed_sql() -> dict[str, str]:
    out = {"period": _of("cast(p as double)"), "emb_lag": _of("cast(lag as double)")}
    out["acf_detrended"] = _of("ac", many=True)
    out["acf_first_nonsig"] = _of(f"cast(list_position({each('ac', 'v', 'abs(v) <= 1.96 / sqrt(n)')}, true) as double)")
    out["acf_first_nonpos"] = _of("cast(np as double)")
    low = "list_filter(range(2, len(ac)), lambda i: ac[i] < ac[i - 1] and ac[i] < ac[i + 1])"
    out["first_acf_locmin"] = _of(f"cast({low}[1] as double)")
    out["autocorr_crit_pt"] = _of(each("list_filter(range(2, len(ac)), lambda i: (ac[i] < ac[i - 1] and ac[i] < ac[i + 1]) or (ac[i] > ac[i - 1] and ac[i] > ac[i + 1]))", "i", "cast(i - 1 as double)"), many=True)
    for name, part in (("trend_strenght", "ds"), ("season_strenght", "dt")):
        out[name] = _of(f"case when list_aggregate({part}, 'var_samp') > 0 then greatest(0, least(1, 1 - list_aggregate(re, 'var_samp') / list_aggregate({part}, 'var_samp'))) end")
    sd = f"sd as (select id, {each('range(1, n - p + 1)', 'i', 'x[i + p] - x[i]')} as q from d)"
    for name, u, frm, extra in (("residuals", "re", "d", ()), ("sdiff", "q", "sd", (sd,))):
        out[f"sd_{name}"] = _of(f"list_aggregate({u}, 'stddev_samp')", *extra, frm=frm)
        out[f"skewness_{name}"] = _of(shape(u, 3), *extra, frm=frm)
        out[f"kurtosis_{name}"] = _of(shape(u, 4), *extra, frm=frm)
    out["spikiness"] = _of(upto("n", "i", "list_aggregate(list_concat(re[1 : i - 1], re[i + 1 : n]), 'var_samp')"), many=True)
    out["turning_points_trend"] = _of(upto("n", "i", "case when i > 1 and i < n and (tr[i] > tr[i - 1] and tr[i] > tr[i + 1] or tr[i] < tr[i - 1] and tr[i] < tr[i + 1]) then 1.0 else 0.0 end"), many=True)
    out["step_changes_trend"] = _of(each("range(3, n + 1)", "i", "case when abs(tr[i] - list_avg(tr[1 : i - 1])) > 2.000000002 * list_aggregate(tr[1 : i - 1], 'stddev_samp') then 1.0 else 0.0 end"), many=True)
    for name, f in (("peak_frac", "list_max"), ("trough_frac", "list_min")):
        cut = "se[c * p + 1 : (c + 1) * p]"
        places = f"pl as (select id, p, case when p > 1 and n >= p then list_transform(range(0, n // p), lambda c: list_position({cut}, {f}({cut}))) else [] end as q from d)"
        often = "list_sort(list_transform(list_distinct(q), lambda v: {'c': 0 - len(list_filter(q, lambda w: w = v)), 'v': v}))[1].v"
        out[name] = _of(f"case when len(q) > 0 then {often} / cast(p as double) end", places, frm="pl")
    out["trev"] = _of("case when len(q) > 0 then list_avg(list_transform(q, lambda v: pow(v, 3))) / pow(list_avg(list_transform(q, lambda v: v * v)), 1.5) end", f"g as (select id, {each('range(1, n - lag + 1)', 'i', 'x[i + lag] - x[i]')} as q from d)", frm="g")
    out["tc3"] = _of(f"case when n > 2 * lag then list_avg({each('range(1, n - 2 * lag + 1)', 'i', 'x[i] * x[i + lag] * x[i + 2 * lag]')}) / pow(abs(list_avg({each('range(1, n - 2 * lag + 1)', 'i', 'x[i] * x[i + lag]')})), 1.5) end")
    out["gen_autocorr"] = _of("list_avg(list_transform(range(1, len(u) + 1), lambda i: u[i] * w[i])) - list_avg(u) * list_avg(w) / (list_aggregate(u, 'stddev_pop') * list_aggregate(w, 'stddev_pop'))", f"g as (select id, {each('x[1 : n - lag]', 'v', 'abs(v)')} as u, {each('x[lag + 1 : n]', 'v', 'abs(v)')} as w from d)", frm="g")
    out["test_dw"] = _of(f"list_sum({upto('(n - 1)', 'i', 'pow(re[i + 1] - re[i], 2)')}) / nullif(list_sum({each('re', 'v', 'v * v')}), 0) / 4")
    hamming, hann = "0.54 - 0.46 * cos(2 * pi() * (k - 1) / n)", "0.5 - 0.5 * cos(2 * pi() * (k - 1) / n)"
    out["ps_residuals"] = _of("s", _spectrum(hamming), frm="sp", many=True)
    out["ps_freqs"] = _of("list_sort(s)[len(s) - cast(ceil(0.05 * n) as int) + 1 : len(s)]", _spectrum(hamming), frm="sp", many=True)
    out["ps_peaks"] = _of(each("s", "v", "case when v >= 0.6 * list_max(s) then 1.0 else 0.0 end"), _spectrum(hamming), frm="sp", many=True)
    out["ps_entropy"] = _of(f"(0.0 - list_sum({each('list_filter(s, lambda v: v > 0)', 'v', 'v / list_sum(s) * log2(v / list_sum(s))')})) / log2(len(s))", _spectrum(hamming), frm="sp")
    out["low_freq_power"] = _of("list_sum(list_transform(range(1, len(s) + 1), lambda f: case when 2 * pi() * (f - 1) / n <= 0.04 then s[f] else 0 end)) / nullif(list_sum(s), 0)", _spectrum(hann), frm="sp")
    lags = "least(greatest(coalesce(np, n // 2), 1), n - 2)"
    out["ami"] = _of("v", _ami("x", lags), frm="ml", many=True)
    out["ami_detrended"] = _of("v", _ami("dt", lags), frm="ml", many=True)
    out["ami_first_critpt"] = _of("cast(list_filter(range(2, len(v)), lambda i: v[i] < v[i - 1] and v[i] < v[i + 1])[1] as double)", _ami("dt", "least(64, n // 2)"), frm="ml")
    out["embed_in_shell"] = _of(f"list_avg({each('range(1, n - lag + 1)', 'i', 'case when sqrt(z[i] * z[i] + z[i + lag] * z[i + lag]) <= 1 then 1.0 else 0.0 end')})")
    far = "sqrt(pow(z[i] - z[j], 2) + pow(z[i + lag] - z[j + lag], 2))"
    near_by = f"e0 as materialized (select id, n, z, lag, n - lag as m, list_transform(range(1, n - lag + 1), lambda i: list_transform(range(1, n - lag + 1), lambda j: {far})) as f from d), e1 as materialized (select *, flatten(list_transform(range(1, m + 1), lambda i: f[i][i + 1 : m])) as q from e0), e2 as materialized (select id, n, z, lag, m, f, unnest(range(0, 4)) as k, list_avg(q) as mu, list_aggregate(q, 'stddev_samp') as sd from e1)"
    held = "list_filter(range(1, m + 1), lambda j: j <> i and f[i][j] <= greatest(0, mu + 3 * sd * (2 * k / 3.0 - 1)))"
    sums = f"list_sum(list_transform(range(1, m + 1), lambda i: case when len({held}) > 1 then list_aggregate(flatten(list_transform({held}, lambda h: [z[h], z[h + lag]])), 'var_samp') else 0 end)) / 4"
    out["pred"] = f"with {DECOMPOSED}, {near_by} select id as series_id, cast(k as bigint) as idx, {sums} as value from e2"
    std = each("tr", "v", "(v - list_avg(tr)) / list_aggregate(tr, 'stddev_pop')")
    poly = f"o0 as materialized (select id, n, {std} as y, {upto('n', 'i', '(i - 1) / (n - 1.0) - 0.5')} as a from d where n >= 4), o1 as materialized (select *, {each('a', 'v', 'v * v')} as b from o0), o2 as materialized (select *, {each('b', 'v', 'v - list_avg(b)')} as g from o1)"
    for name, c in (("linearity", "a"), ("curvature", "g")):
        out[name] = _of(f"list_sum({upto('n', 'i', f'{c}[i] * y[i]')}) / sqrt(list_sum({each(c, 'v', 'v * v')}))", poly, frm="o2")
    return out


def _whole() -> dict[str, str]:
    """Queries of the extractor that need no decomposition."""
    plain = _sql()
    out = {"parse_by_group": f"select series_id, 't_mean' as feature, value from ({plain['t_mean']}) q"}
    tables = {"diff": steps("x"), "bin_mean": each("x", "v", "case when v >= list_avg(x) then 1.0 else 0.0 end")}
    one = {k.removeprefix("summary_"): v for k, v in plain.items() if k.startswith("summary_")}
    parts = []
    for f, e in tables.items():
        for k, sql in one.items():
            body = sql.replace(steps("x") + " as d", e + " as d")
            name = f"'{f}.{k}'" if "idx" not in sql else f"'{f}.{k}.' || idx"
            parts.append(f"select series_id, {name} as feature, value from ({body}) q")
    out["summarize"] = " union all ".join(parts)
    return out


def _arguments() -> dict[str, str]:
    plain = _sql()
    out = {"diff_order_2": array(upto("(n - 2)", "i", "x[i + 2] - 2 * x[i + 1] + x[i]"))}
    out["sd_diff_ddof_0"] = scalar(f"list_aggregate({steps('x')}, 'stddev_pop')")
    out["lumpiness_8_tiles"] = plain["lumpiness"].replace("n >= 32 then 16", "n >= 16 then 8").replace("n // 16", "n // 8").replace("n % 16", "n % 8")
    out["t_mean_pcut_10"] = plain["t_mean"].replace("0.02", "0.1")
    out["hist_entropy_5_bins"] = scalar(entropy10("b").replace("log2(10)", "log2(5)"), f"b as (select id, {tenths('x', 5)} as b from l)", frm="b")
    out["moving_avg_window_30"] = plain["moving_avg"].replace("ceil(n / 10.0)", "ceil(3 * n / 10.0)")
    out["acf_4_lags"] = f"select * from ({plain['acf']}) q where idx < 4"
    out["model_mean_mae_3_folds"] = plain["model_mean"].replace("n // 6 as f from l where n >= 6", "n // 4 as f from l where n >= 4").replace("(5 - k)", "(3 - k)").replace("(4 - k)", "(2 - k)").replace("range(0, 5) q(k)", "range(0, 3) q(k)").replace("sqrt(list_avg(", "(list_avg(").replace("pow(list_avg(tr) - te[i], 2)", "abs(list_avg(tr) - te[i])")
    out["model_naive_last_half"] = plain["model_naive"].replace("g as (select id, x, n, n // 6 as f from l where n >= 6)", "g0 as (select id, x[n - cast(ceil(n / 2.0) as int) + 1 : n] as x from l), g as (select id, x, len(x) as n, len(x) // 6 as f from g0 where len(x) >= 6)")
    jump = each("range(1, n - 1)", "i", "x[i + 2] - x[i]")
    out["trev_lag_2"] = scalar(f"list_avg({each('q', 'v', 'v * v * v')}) / pow(list_avg({each('q', 'v', 'v * v')}), 1.5)", f"g as (select id, {jump} as q from l)", frm="g")
    cut = "list_sort(x)[cast(floor(0.02 * n) as int) + 1 : n - cast(floor(0.02 * n) as int)]"
    quarter = lambda p: f"list_aggregate(x, 'quantile_cont', {p})"
    for name, centre, spread in (("standard", "list_avg(x)", "list_aggregate(x, 'stddev_pop')"), ("min_max", "list_min(x)", "list_max(x) - list_min(x)"), ("robust", quarter(0.5), f"{quarter(0.75)} - {quarter(0.25)}")):
        out[f"rescale_{name}"] = scalar(f"(list_avg({cut}) - ({centre})) / ({spread})")
    rows = " union all ".join(
        f"select series_id, '{n}.powersum' as feature, sum(pow(value, 3)) as value from ({plain[n]}) q group by 1 union all select series_id, '{n}.sd', stddev_pop(value) from ({plain[n]}) q group by 1" for n in ("local_extrema", "local_range")
    )
    out["extract_by_pattern"] = rows
    count = "row_number() over (partition by {0} order by {1}) - 1 as t"
    out["source_events_by_user"] = f"select user_id as series_id, {count.format('user_id', 'ts, event_id')}, cast(value as double) as v from events where value is not null and user_id is not null"
    out["source_events_hourly"] = f"select event_type as series_id, {count.format('event_type', 'h')}, cast(v as double) as v from (select event_type, date_trunc('hour', ts) as h, sum(value) as v from events group by 1, 2) q where v is not null and event_type is not null"
    out["source_orders_daily"] = f"select cast(0 as bigint) as series_id, row_number() over (order by d) - 1 as t, cast(v as double) as v from (select cast(o_orderdate as date) as d, sum(o_totalprice) as v from orders group by 1) q where v is not null"
    out["source_embeddings"] = "select vec_id as series_id, unnest(range(0, len(embedding))) as t, cast(unnest(embedding) as double) as v from embeddings"
    return out


SQL = _sql() | _decomposed_sql() | _whole() | _arguments()
