"""The 149 feature operators on one ``Series``: a scalar or an array each.

Registered by public group. ``random`` operators draw from a generator seeded by series and
operator. Where a series is too short or a quantity is undefined the value is NaN (or an empty array).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from . import core as c
from . import models
from .context import Series, mutual_information, periodogram

FEATURES: dict[str, tuple[str, Callable[[Series], object]]] = {}
NAN = c.NAN


def feature(group: str, name: str | None = None):
    def put(f):
        FEATURES[name or f.__name__] = (group, f)
        return f

    return put


def put(group: str, **named: Callable[[Series], object]) -> None:
    for name, f in named.items():
        FEATURES[name] = (group, f)


def put_many(group: str, **named: Callable[..., list]) -> None:
    """Operators on lists of series: what they iterate runs over all series of a batch at once."""
    for name, f in named.items():
        one = lambda s, *, _f=f, **o: _f([s], **o)[0]
        one.together = f
        FEATURES[name] = (group, one)


# ---- general


def turning(x: np.ndarray) -> np.ndarray:
    d = np.diff(x)
    return np.r_[0, (d[1:] * d[:-1] < 0), 0].astype(float) if len(x) > 1 else np.zeros(len(x))


def step_changes(x: np.ndarray, ddof: int = 1) -> np.ndarray:
    """Whether each value is more than two deviations off the mean of those before it; what is just as far but for rounding (on a line) is not."""
    n = np.arange(1, len(x) + 1)
    d = x - x[:1]  # sums of the squares of large values would lose digits
    mean = np.cumsum(d) / n
    square = np.cumsum((d - np.r_[0.0, mean[:-1]]) * (d - mean))  # Welford's update
    at = np.arange(ddof + 1, len(x))
    return (np.abs(d[at] - mean[at - 1]) > 2.000000002 * np.sqrt(square[at - 1] / (at - ddof))).astype(float)


def season_place(s: Series, arg, normalize: bool) -> float:
    p = s.period
    if p <= 1 or s.n < p:
        return NAN
    at = arg(s.season[: s.n // p * p].reshape(-1, p), axis=1) + 1
    kinds, many = np.unique(at, return_counts=True)
    return float(kinds[many.argmax()] / (p if normalize else 1))


def share_of(flags: np.ndarray, n: int, normalize: bool) -> float:
    return float(flags.sum() / (n if normalize else 1))


def discretized(x: np.ndarray, num_bins: int, strategy: str) -> np.ndarray:
    if strategy not in ("equal-width", "equiprobable"):
        raise ValueError(f"no such strategy: {strategy}")
    return (c.bins_equal_width if strategy == "equal-width" else c.bins_equal_count)(x, num_bins)


def run_lengths(symbols: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(np.diff(symbols)) + 1
    return np.diff(np.r_[0, at]).astype(float)  # the last run has no end


put(
    "general",
    length=lambda s: float(s.n),
    diff=lambda s, order=1: np.diff(s.ts, order),
    period=lambda s: float(s.period),
    turning_points=lambda s: turning(s.ts),
    turning_points_trend=lambda s: turning(s.trend),
    step_changes=lambda s, ddof=1: step_changes(s.ts, ddof),
    step_changes_trend=lambda s, ddof=1: step_changes(s.trend, ddof),
    frac_cp=lambda s, threshold=None, normalize=True: share_of(np.diff(s.z <= (np.median(s.z) if threshold is None else threshold)), s.n - 1, normalize) if s.n > 1 else NAN,
    bin_mean=lambda s: (s.ts >= s.ts.mean()).astype(float),
    fs_len=lambda s, num_bins=10, strategy="equal-width": run_lengths(discretized(s.ts, num_bins, strategy)),
    peak_frac=lambda s, normalize=True: season_place(s, np.argmax, normalize),
    trough_frac=lambda s, normalize=True: season_place(s, np.argmin, normalize),
    walker_path=lambda s, step_size=0.1, start_point=None, relative_dist=True: np.abs(w - s.z) if (w := s.walk(step_size, start_point)) is not None and relative_dist else w,
    walker_cross_frac=lambda s, step_size=0.1, start_point=None, normalize=True: share_of((d := s.walk(step_size, start_point) - s.z)[1:] * d[:-1] < 0, s.n - 1, normalize) if s.n > 1 else NAN,
    emb_lag=lambda s: float(s.lag),
    emb_dim_cao=lambda s: float(s.emb_dim),
    cao_e1=lambda s: s.cao[0],
    cao_e2=lambda s: s.cao[1],
)


@feature("general")
def pred(s: Series, embed_dim: int = 2, std_range: float = 3, num_spacing: int = 4, ddof: int = 1) -> np.ndarray:
    """Variance among the neighbours of each delay vector, within distances from few to many deviations off the mean distance."""
    e = c.embed(s.z, embed_dim, s.lag)
    if len(e) < 3:
        return np.full(num_spacing, NAN)
    d = c.pairwise(e, "euclidean")
    flat = d[np.triu_indices(len(e), 1)]
    out = []
    for i in range(num_spacing):
        near = (d <= max(0.0, flat.mean() + std_range * flat.std(ddof=ddof) * (2 * i / (num_spacing - 1) - 1))) & ~np.eye(len(e), dtype=bool)
        out.append(sum(e[row].var(ddof=ddof) for row in near if row.sum() > 1) / num_spacing)
    return np.array(out, float)


@feature("general")
def moving_threshold(s: Series, rate_absorption: float = 0.1, rate_decay: float = 0.1, relative: bool = False) -> np.ndarray:
    """A threshold that absolute values above it raise and others let decay."""
    out = [1.0]
    for a in np.abs(s.z):
        out.append((1 + rate_absorption) * a if a > out[-1] else (1 - rate_decay) * out[-1])
    return np.abs(np.array(out[1:]) - s.z) if relative else np.array(out)


@feature("general")
def embed_in_shell(s: Series, radii: tuple[float, float] = (0.0, 1.0), embed_dim: int = 2, normalize: bool = True) -> float:
    """Share of delay vectors whose length lies between two radii."""
    e = c.embed(s.z, embed_dim, s.lag)
    r = np.sqrt((e * e).sum(1))
    return share_of((r >= radii[0]) & (r <= radii[1]), len(e), normalize) if len(e) else NAN


@feature("general")
def force_potential(s: Series, potential: str = "sine", params: tuple[float, float, float] | None = None, start_point: float = 0.0) -> np.ndarray:
    """Path of a damped particle in a sine or double-well potential that the series drives. ``params``: width, friction, time step."""
    forces = {"sine": ((1.0, 1.0, 0.1), lambda x: math.sin(x / alpha) / alpha), "dblwell": ((2.0, 0.1, 0.1), lambda x: alpha**2 * x - x**3)}
    if potential not in forces:
        raise ValueError(f"no such potential: {potential}")
    defaults, force = forces[potential]
    alpha, friction, dt = params or defaults
    x, v, out = start_point, 0.0, [start_point]
    for f in s.z[:-1]:
        a = force(x) + f - friction * v
        x, v = x + v * dt + a * dt * dt, v + a * dt
        if not math.isfinite(x):
            return np.full(s.n, NAN)
        out.append(x)
    return np.array(out)


@feature("general")
def stick_angles(s: Series) -> np.ndarray:
    out = []
    for keep in (s.z >= 0, s.z < 0):
        t = np.flatnonzero(keep)
        out.append(np.arctan((s.n - 1) * np.diff(s.z[t]) / np.diff(t)))
    return np.concatenate(out)


@feature("general")
def fnn_prop(s: Series) -> np.ndarray:
    out = []
    for found in s.neighbours(1e-8):  # nearer ones count as the same
        if found is None:
            out.append(NAN)
            continue
        dist, step = found
        out.append(float(((step > 10 * dist) | (np.maximum(dist, step) > 2)).mean()))
    return np.array(out)


# ---- global statistics


def strength(rest: np.ndarray, whole: np.ndarray, ddof: int = 1) -> float:
    v = whole.var(ddof=ddof) if len(whole) > 1 else 0.0
    return float(np.clip(1 - rest.var(ddof=ddof) / v, 0, 1)) if v > 0 else NAN


def seasonal_diff(s: Series) -> np.ndarray:
    return s.ts[s.period :] - s.ts[: -s.period]


def leave_one_out_var(x: np.ndarray) -> np.ndarray:
    n = len(x)
    if n < 3:
        return np.full(n, NAN)
    d = x - x.mean()
    s2 = d @ d
    return (s2 - d * d - d * d / (n - 1)) / (n - 2)


def trimmed_mean(s: Series, pcut: float = 0.02) -> float:
    """Mean without a share of the values at either end."""
    k = int(pcut * s.n)
    return float(np.sort(s.ts)[k : s.n - k].mean())


put(
    "global-stat",
    ioe_tdelta_mean=lambda s: np.array([2 * (i.mean() if len(i) else 0) / s.n - 1 for i in s.ioe[1]]),
    trend_strenght=lambda s, ddof=1: strength(s.resid, s.deseasonalized, ddof),
    season_strenght=lambda s, ddof=1: strength(s.resid, s.detrended, ddof),
    sd_residuals=lambda s, ddof=1: c.sd(s.resid, ddof),
    sd_diff=lambda s, num_diff=1, ddof=1: c.sd(np.diff(s.ts, num_diff), ddof),
    sd_sdiff=lambda s, ddof=1: c.sd(seasonal_diff(s), ddof),
    skewness_residuals=lambda s, method=3: c.skew3(s.resid, method),
    skewness_diff=lambda s, num_diff=1, method=3: c.skew3(np.diff(s.ts, num_diff), method),
    skewness_sdiff=lambda s, method=3: c.skew3(seasonal_diff(s), method),
    kurtosis_residuals=lambda s, method=3: c.kurt3(s.resid, method),
    kurtosis_diff=lambda s, num_diff=1, method=3: c.kurt3(np.diff(s.ts, num_diff), method),
    kurtosis_sdiff=lambda s, method=3: c.kurt3(seasonal_diff(s), method),
    t_mean=trimmed_mean,
    spikiness=lambda s: leave_one_out_var(s.resid),
)


@feature("global-stat")
def exp_max_lyap(s: Series, dim: int = 10, length: int = 20) -> float:
    """Rosenstein's method: mean log divergence of nearest neighbours over ``length`` steps, and its slope."""
    e = c.embed(s.ts, dim, s.lag)
    m = len(e)
    if m < length + 3:
        return NAN
    f, p = periodogram(s.ts - s.ts.mean(), np.ones)
    apart = math.ceil(1 / max((f * p).sum() / p.sum(), 1e-9)) if p.sum() > 0 else 1
    apart = min(apart, int(0.25 * s.n))
    d = c.pairwise(e, "euclidean")
    start = m - length + 1
    near = d[:start, :start].copy()
    i, j = np.indices(near.shape)
    near[np.abs(i - j) < max(apart, 1)] = np.inf
    nn = near.argmin(1)
    ok = np.isfinite(near[np.arange(start), nn])
    div = []
    for k in range(length):
        x = d[np.arange(start)[ok] + k, nn[ok] + k]
        x = x[x > 0]
        div.append(np.log(x).mean() if len(x) else NAN)
    div = np.array(div)
    t = np.flatnonzero(~np.isnan(div))
    return float(np.polyfit(t, div[t], 1)[0]) if len(t) > 1 else NAN


@feature("global-stat")
def exp_hurst(s: Series) -> float:
    """Slope of log mean rescaled range on log window length."""
    sizes = np.unique(np.geomspace(max(4, 0.02 * s.n), max(5, 0.5 * s.n), 15).astype(int))
    x, y = [], []
    for w in sizes:
        parts = s.ts[: s.n // w * w].reshape(-1, w) if s.n >= w else np.empty((0, w))
        if not len(parts):
            continue
        d = parts - parts.mean(1, keepdims=True)
        walk, dev = d.cumsum(1), parts.std(1, ddof=1)
        rs = ((walk.max(1) - walk.min(1))[dev > 0] / dev[dev > 0])
        if len(rs) and rs.mean() > 0:
            x.append(math.log(w))
            y.append(math.log(rs.mean()))
    return float(np.polyfit(x, y, 1)[0]) if len(x) > 1 else NAN


@feature("global-stat")
def dfa(s: Series) -> float:
    """Detrended fluctuation analysis with half-overlapping windows and lines."""
    if s.n < 12:
        return NAN
    walk = (s.ts - s.ts.mean()).cumsum()
    sizes = np.unique(np.geomspace(4, max(5, 0.1 * s.n) if s.n > 70 else s.n / 2, 12).astype(int))
    x, y = [], []
    for w in sizes:
        parts = np.lib.stride_tricks.sliding_window_view(walk, w)[:: max(1, w // 2)]
        t = np.arange(w) - (w - 1) / 2
        slope = (parts @ t) / (t @ t)
        rest = parts - parts.mean(1, keepdims=True) - slope[:, None] * t
        f = np.sqrt((rest**2).mean(1)).mean()
        if f > 0:
            x.append(math.log(w))
            y.append(math.log(f))
    return float(np.polyfit(x, y, 1)[0]) if len(x) > 1 else NAN


@feature("global-stat")
def corr_dim(s: Series) -> float:
    """Correlation dimension with embedding dimension 1: slope of log correlation sum on log radius."""
    size = s.ts.std(ddof=1) if s.n > 2 else 0.0
    if not size > 0:
        return NAN
    d = np.abs(s.ts[:, None] - s.ts[None])[np.triu_indices(s.n, 1)]
    x, y = [], []
    for r in size * np.geomspace(0.1, 0.5, 17):
        share = (d <= r).mean()
        if share > 0:
            x.append(math.log(r))
            y.append(math.log(share))
    return float(np.polyfit(x, y, 1)[0]) if len(x) > 1 else NAN


@feature("global-stat")
def opt_boxcox_coef(s: Series) -> float:
    """Box-Cox exponent of most likelihood for the series moved to a least value of 1."""
    x = s.ts - s.ts.min() + 1
    if not x.std() > 0:
        return NAN
    logs = np.log(x)

    def loss(lam: float) -> float:
        y = logs if abs(lam) < 1e-12 else (np.exp(lam * logs) - 1) / lam
        return s.n / 2 * math.log(max(y.var(), 1e-300)) - (lam - 1) * logs.sum()

    return float(models.golden(loss, -2.0, 2.0))


# ---- local statistics


def rolled(s: Series, f, window_size: float = 0.1, remove_nan: bool = True, **options) -> np.ndarray:
    """A statistic of centred windows; ``options`` go to the statistic."""
    out = np.array([f(x, **options) for x in c.windows(s.z, c.window_size(s.n, window_size))], float)
    return out[~np.isnan(out)] if remove_nan else out


def changes(x: np.ndarray, diff_order: int = 1, diff_lag: int = 1, abs_value: bool = True) -> np.ndarray:
    """Differences of a statistic's values ``diff_lag`` apart, ``diff_order`` times over."""
    for _ in range(diff_order):
        x = x[diff_lag:] - x[:-diff_lag]
    return np.abs(x) if abs_value else x


_SHIFT = ("diff_order", "diff_lag", "abs_value")


def shift(s: Series, f, **options) -> np.ndarray:
    return changes(f(s, **{k: v for k, v in options.items() if k not in _SHIFT}), **{k: v for k, v in options.items() if k in _SHIFT})


def geometric_mean(x: np.ndarray) -> float:
    if (x < 0).any():
        return NAN
    return 0.0 if (x == 0).any() else float(np.exp(np.log(x).mean()))


def kl_windows(s: Series, window_size: float = 0.1, remove_inf: bool = True) -> np.ndarray:
    """Divergence of each window's histogram from the one before it by a window; ends with a zero."""
    w = c.window_size(s.n, window_size)
    part = c.windows(s.z, w)
    h = [np.bincount(c.bins_equal_width(x, 10, 1e-9) if x.max() > x.min() else np.full(w, 5), minlength=10) for x in part]
    out = []
    for i in range(s.n - 2 * w + 1):
        a, b = h[i + w], h[i]
        a, b = a / a.sum(), b / b.sum()
        out.append(np.inf if ((a > 0) & (b == 0)).any() else float((a[a > 0] * np.log(a[a > 0] / b[a > 0])).sum()))
    out = np.array([*out, 0.0])
    return out[np.isfinite(out)] if remove_inf else out


def lilliefors_rows(x: np.ndarray) -> np.ndarray:
    """Greatest distance from a normal distribution of each row's mean and deviation; NaN for rows without spread."""
    n = x.shape[1]
    if n < 2:
        return np.full(len(x), NAN)
    dev = x.std(1, ddof=1)
    p = c.normal_cdf((np.sort(x, axis=1) - x.mean(1, keepdims=True)) / np.where(dev > 0, dev, NAN)[:, None])
    return np.maximum((np.arange(1, n + 1) / n - p).max(1), (p - np.arange(n) / n).max(1))


def lilliefors(x: np.ndarray) -> float:
    return float(lilliefors_rows(x[None])[0])


def approximate_entropy(x: np.ndarray, embed_dim: int = 2, embed_lag: int = 1, threshold: float = 0.2) -> float:
    phi = []
    for m in (embed_dim, embed_dim + 1):
        e = c.embed(x, m, embed_lag)
        if not len(e):
            return NAN
        phi.append(np.log((c.pairwise(e) < threshold).mean(1)).mean())
    return float(phi[0] - phi[1])


def window_entropies(rows: np.ndarray, embed_dim: int = 2, embed_lag: int = 1, threshold: float = 0.2) -> np.ndarray:
    """``approximate_entropy`` of each row, standardized."""
    if not len(rows):
        return np.empty(0)
    z, phi = np.array([c.standardize(x) for x in rows]), []
    for m in (embed_dim, embed_dim + 1):
        at = c.embed(np.arange(z.shape[1]), m, embed_lag).astype(int)
        if not len(at):
            return np.full(len(z), NAN)
        e = z[:, at]
        near = np.ones((len(z), len(at), len(at)), bool)
        for j in range(m):
            near &= np.abs(e[:, :, None, j] - e[:, None, :, j]) < threshold
        phi.append(np.log(near.mean(2)).mean(1))
    return phi[0] - phi[1]


def rolled_at_once(s: Series, f, window_size: float = 0.1, remove_nan: bool = True, **options) -> np.ndarray:
    """As ``rolled``, of a statistic of rows; it takes as many windows at a time as have so many pairs of values."""
    x = c.windows(s.z, c.window_size(s.n, window_size))
    step = max(1, (1 << 20) // x.shape[1] ** 2)
    out = np.concatenate([np.empty(0), *(f(x[i : i + step], **options) for i in range(0, len(x), step))])
    return out[~np.isnan(out)] if remove_nan else out


_ROLLED = {
    "moving_avg": np.mean, "moving_var": lambda x, ddof=1: x.var(ddof=ddof) if len(x) > ddof else NAN, "moving_sd": c.sd, "moving_skewness": c.skew3, "moving_kurtosis": c.kurt3,
    "moving_acf": lambda x, adjusted=True: c.acf(x, 1, adjusted)[0] if len(x) > 1 else NAN, "moving_gmean": geometric_mean,
}
for _name, _f in _ROLLED.items():
    put("local-stat", **{_name: lambda s, *, _f=_f, **o: rolled(s, _f, **o)})
    put("local-stat", **{_name + "_shift": lambda s, *, _f=_f, **o: shift(s, lambda s, **p: rolled(s, _f, **p), **o)})
put(
    "local-stat",
    moving_lilliefors=lambda s, **o: rolled_at_once(s, lilliefors_rows, **o),
    moving_approx_ent=lambda s, **o: rolled_at_once(s, window_entropies, **o),
    moving_kldiv=kl_windows,
    moving_kldiv_shift=lambda s, **o: shift(s, kl_windows, **o),
    lumpiness=lambda s, num_tiles=16, ddof=1: np.array([x.var(ddof=ddof) if len(x) > ddof else NAN for x in c.tiles(s.ordered_z, num_tiles)]),
    stability=lambda s, num_tiles=16: np.array([x.mean() for x in c.tiles(s.ordered_z, num_tiles)]),
    local_extrema=lambda s, num_tiles=16: np.array([x.max() if abs(x.min()) <= x.max() else x.min() for x in c.tiles(s.ordered_z, num_tiles)]),
    local_range=lambda s, num_tiles=16: np.array([np.ptp(x) for x in c.tiles(s.ordered_z, num_tiles)]),
)


# ---- model-based


def orthogonal_trend(s: Series) -> np.ndarray:
    """Coefficients of the standardized trend on orthonormal polynomials of degree 1 and 2, leading coefficients positive."""
    if s.n < 4:
        return np.array([NAN, NAN])
    t = np.linspace(0, 1, s.n)
    p1 = t - t.mean()
    p1 /= math.sqrt(p1 @ p1)
    p2 = t * t - (t * t).mean()
    p2 -= (p2 @ p1) * p1
    p2 /= math.sqrt(p2 @ p2)
    y = c.standardize(s.trend)
    return np.array([p1 @ y, p2 @ y])


def cycle_period(many: list[Series]) -> list[float]:
    out = np.full(len(many), NAN)
    on = [i for i, s in enumerate(many) if s.n >= 8 and s.ts.std() > 0]
    fit = models.Arima((2, 0, 0), True).fit([many[i].ts for i in on])
    for k, (a, b) in zip(fit.kept, fit.ar.tolist()):
        if a * a + 4 * b < 0:
            cosine = -a * (1 - b) / (4 * b)
            out[on[k]] = 2 * math.pi / math.acos(cosine) if abs(cosine) <= 1 and math.acos(cosine) > 0 else NAN
    return out.tolist()


def smoothing(many: list[Series], season: bool, damped: bool, weight: str) -> list[float]:
    """A weight (alpha, beta, gamma) of exponential smoothing of each; fitted once, with or without a season."""
    key = f"_smoothing_{season}_{damped}"
    new = [s for s in many if key not in s.__dict__]
    for seasonal in (False, True):
        part = [s for s in new if (season and s.period > 1) == seasonal]
        fit = models.Smoothing(True, damped).fit([s.z for s in part], [s.period if seasonal else 1 for s in part])
        for i, s in enumerate(part):
            s.__dict__[key] = {w: float(getattr(fit, w)[fit.of[i]]) for w in ("alpha", "beta", "gamma")} if i in fit.of else dict.fromkeys(("alpha", "beta", "gamma"), NAN)
    return [s.__dict__[key][weight] for s in many]


def gaussian_r2(s: Series) -> float:
    total = (s.z * s.z).sum()
    return float(1 - (s.gaussian @ s.gaussian) / total) if total > 0 else NAN


put(
    "model-based",
    linearity=lambda s: float(orthogonal_trend(s)[0]),
    curvature=lambda s: float(orthogonal_trend(s)[1]),
    gaussian_r_sqr=gaussian_r2,
    ioe_std_slope=lambda s: s.ioe_line[0],
    ioe_std_adj_r_sqr=lambda s: s.ioe_line[1],
)

put_many(
    "model-based",
    des_level=lambda many: smoothing(many, False, False, "alpha"),
    des_trend=lambda many: smoothing(many, False, False, "beta"),
    ets_level=lambda many: smoothing(many, True, True, "alpha"),
    ets_trend=lambda many: smoothing(many, True, True, "beta"),
    ets_season=lambda many: smoothing(many, True, True, "gamma"),
    avg_cycle_period=cycle_period,
)

# ---- spectrum (public group info-theory, information theory is freq-domain: the names are swapped in the public surface)


def spectral_entropy(s: Series, normalize: bool = True, base: float = 2) -> float:
    p = s.spectrum[1]
    return c.entropy(p, base) / (math.log(len(p), base) if normalize else 1) if len(p) > 1 and p.sum() > 0 else NAN


def low_power(s: Series, threshold: float = 0.04) -> float:
    f, p = periodogram(s.resid, np.hanning)
    return float(p[2 * math.pi * f <= threshold].sum() / p.sum()) if p.sum() > 0 else NAN


put(
    "info-theory",
    ps_residuals=lambda s: s.spectrum[1],
    ps_freqs=lambda s, freq_num=0.05: np.sort(s.spectrum[1])[-(math.ceil(freq_num * s.n) if freq_num < 1 else freq_num) :],
    ps_peaks=lambda s, factor=0.6: (s.spectrum[1] >= factor * s.spectrum[1].max()).astype(float),
    ps_entropy=spectral_entropy,
    low_freq_power=low_power,
)


def histogram_entropy(x: np.ndarray, num_bins: int = 10, normalize: bool = True) -> float:
    return c.entropy(np.bincount(c.bins_equal_width(x, num_bins)).astype(float), 2) / (math.log2(num_bins) if normalize else 1) if len(x) else NAN


def first_ami(s: Series, num_bins: int = 64, dist_ami: bool = False) -> float:
    x = s.ami(s.detrended, max(0, min(64, s.n // 2)), num_bins, dist_ami)
    at = c.local_minima(x) if len(x) >= 3 else []
    return float(at[0] + 1) if len(at) else NAN


def ami_noise(s: Series, noise_range: tuple[float, float] = (0, 3), noise_inc_num: int = 10) -> float:
    if s.n < s.lag + 3:
        return NAN
    noise, levels, y = s.rng("ami_curvature").normal(size=s.n), np.linspace(*noise_range, noise_inc_num), []
    noisy = s.z + levels[:, None] * noise
    for x, period in zip(noisy, c.estimate_periods(noisy)):
        x = x - c.decompose(x, period)[0]
        y.append(mutual_information(x[: -s.lag], x[s.lag :], 32))
    return float(np.polyfit(levels, y, 1)[0])


def sample_entropy(x: np.ndarray, embed_dim: int = 2, embed_lag: int = 1, threshold: float = 0.2) -> float:
    count = []
    for m in (embed_dim, embed_dim + 1):
        e = c.embed(x, m, embed_lag)
        count.append(int((c.pairwise(e) < threshold)[np.triu_indices(len(e), 1)].sum()) if len(e) else 0)
    return math.log(count[0]) - math.log(count[1]) if min(count) else NAN


def surprise(s: Series, num_bins: int = 10, memory_size: float = 0.1, num_it: int = 128, method: str = "distribution", diff_order: int = 1, epsilon: float = 1e-8) -> np.ndarray:
    """How unlikely the symbol at random places is, by those (or by the transitions) in the memory before it."""
    if method not in ("distribution", "1-transition"):
        raise ValueError(f"no such method: {method}")
    d = np.diff(s.ts, diff_order)
    memory = math.ceil(memory_size * s.n) if memory_size < 1 else int(memory_size)
    if len(d) <= memory:
        return np.empty(0)
    symbols, p = c.bins_equal_count(d, num_bins), []
    for i in s.rng("surprise").integers(memory, len(d), num_it):
        past = symbols[i - memory : i]
        if method == "1-transition":
            past = past[1:][past[:-1] == past[-1]]
        p.append((past == symbols[i]).mean() if len(past) else 0.0)
    p = np.array(p)
    return np.where(p < epsilon, 0.0, -np.log(np.maximum(p, epsilon)))


def lempel_ziv(s: Series, num_bins: int = 10, normalize: bool = True) -> float:
    symbols, seen, phrase = c.bins_equal_width(s.ts, num_bins).tolist(), set(), ()
    for x in symbols:
        phrase += (x,)
        if phrase not in seen:
            seen.add(phrase)
            phrase = ()
    return float(len(seen) * (math.log(s.n) / (s.n * math.log(num_bins)) if normalize else 1))


def inner_entropy(s: Series, num_bins: int = 10, pcut: float = 0.05, normalize: bool = True) -> float:
    lo, hi = np.quantile(s.ts, [pcut, 1 - pcut])
    return histogram_entropy(s.ts, num_bins, normalize) - histogram_entropy(s.ts[(s.ts >= lo) & (s.ts <= hi)], num_bins, normalize)


put(
    "freq-domain",
    hist_entropy=lambda s, **o: histogram_entropy(s.ts, **o),
    hist_ent_out_diff=inner_entropy,
    ami=lambda s, num_bins=64, lags=None, return_dist=False: s.ami(s.ts, min(s.ami_lags, s.n - 2) if lags is None else lags, num_bins, return_dist),
    ami_detrended=lambda s, num_bins=64, lags=None, return_dist=False: s.ami(s.detrended, min(s.ami_lags, s.n - 2) if lags is None else lags, num_bins, return_dist),
    ami_first_critpt=first_ami,
    ami_curvature=ami_noise,
    approx_entropy=lambda s, **o: approximate_entropy(s.z, **o),
    sample_entropy=lambda s, **o: sample_entropy(s.z, **o),
    control_entropy=lambda s, **o: sample_entropy(np.diff(s.z), **o),
    surprise=surprise,
    lz_complexity=lempel_ziv,
)

# ---- statistical tests


def durbin_watson(x: np.ndarray, normalize: bool = True) -> float:
    return float((np.diff(x) ** 2).sum() / (x @ x) * (0.25 if normalize else 1)) if x @ x > 0 else NAN


def ljung_box(x: np.ndarray, lags: int = 16) -> np.ndarray:
    n = len(x)
    r = c.acf(x, lags, adjusted=False)
    q = n * (n + 2) * np.cumsum(r**2 / (n - np.arange(1, len(r) + 1)))
    return np.array([c.chi2_sf(v, k + 1) for k, v in enumerate(q)])


def engle_arch(x: np.ndarray, lags: int = 16) -> float:
    y = x * x
    n = len(y) - lags
    if n <= lags + 1:
        return NAN
    m = np.column_stack([np.ones(n), *(y[lags - k : len(y) - k] for k in range(1, lags + 1))])
    t = y[lags:]
    total = ((t - t.mean()) ** 2).sum()
    return c.chi2_sf(n * (1 - c.ols(m, t)[3] / total), lags) if total > 0 else NAN


def lilliefors_p(x: np.ndarray) -> float:
    """Approximation by Dallal and Wilkinson (1986), and a fit of the upper range beyond 0.1."""
    d, n = lilliefors(x), len(x)
    if math.isnan(d):
        return NAN
    if n > 100:
        d, n = d * (n / 100) ** 0.49, 100
    p = math.exp(-7.01256 * d * d * (n + 2.78019) + 2.99587 * d * math.sqrt(n + 2.78019) - 0.122119 + 0.974598 / math.sqrt(n) + 1.67997 / n)
    if p <= 0.1:
        return p
    k = (math.sqrt(n) - 0.01 + 0.85 / math.sqrt(n)) * d
    for limit, coef in ((0.302, (1.0,)), (0.5, (2.76773, -19.828315, 80.709644, -138.55152, 81.218052)), (0.9, (-4.901232, 40.662806, -97.490286, 94.029866, -32.355711)), (1.31, (6.198765, -19.558097, 23.186922, -12.234627, 2.423045))):
        if k <= limit:
            return float(min(1.0, sum(a * k**i for i, a in enumerate(coef))))
    return 0.0


put(
    "stat-tests",
    test_dw=lambda s, normalize=True: durbin_watson(s.resid, normalize),
    test_lb=lambda s, max_nlags=16: ljung_box(s.resid, max_nlags),
    test_earch=lambda s, max_nlags=16: engle_arch(s.resid, max_nlags),
    test_adf=lambda s: models.adf(s.ts),
    test_adf_gls=lambda s: models.adf_gls(s.ts),
    test_pp=lambda s: models.phillips_perron(s.ts),
    test_kpss=lambda s: models.kpss(s.ts),
    test_za=lambda s: models.zivot_andrews(s.ts),
    test_lilliefors=lambda s: lilliefors_p(s.ts),
)

# ---- autocorrelation


def lagged_moment(x: np.ndarray, lag: int, only_numerator: bool = False) -> float:
    d = x[lag:] - x[:-lag]
    if only_numerator:
        return float((d**3).mean()) if len(d) else NAN
    below = (d * d).mean() ** 1.5 if len(d) else 0.0
    return float((d**3).mean() / below) if below > 0 else NAN


def triple(x: np.ndarray, lag: int, only_numerator: bool = False) -> float:
    n = len(x) - 2 * lag
    if n < 1:
        return NAN
    a, b, d = x[:n], x[lag : lag + n], x[2 * lag :]
    if only_numerator:
        return float((a * b * d).mean())
    below = abs((a * b).mean()) ** 1.5
    return float((a * b * d).mean() / below) if below > 0 else NAN


def general_autocorrelation(s: Series, alpha: float = 1, beta: float = 1) -> float:
    a, b = np.abs(s.ts[: -s.lag]) ** alpha, np.abs(s.ts[s.lag :]) ** beta
    if not len(a) or not a.std() * b.std() > 0:
        return NAN
    return float((a * b).mean() - a.mean() * b.mean() / (a.std() * b.std()))


def without_outliers(s: Series, p: float = 0.8) -> np.ndarray:
    a = np.abs(s.ts)
    inner = s.ts[a <= np.quantile(a, p)]
    if len(inner) < 3:
        return np.empty(0)
    x, y = s.acf_detrended, c.acf(inner - c.super_smoother(inner))
    m = min(len(x), len(y))
    return np.abs(x[:m] - y[:m])


put(
    "autocorr",
    acf=lambda s, nlags=None, adjusted=True: c.acf(s.ts, nlags, adjusted),
    acf_detrended=lambda s, nlags=None, adjusted=True: s.acf_of(nlags, adjusted),
    acf_diff=lambda s, num_diff=1, nlags=None, adjusted=True: c.acf(np.diff(s.ts, num_diff), nlags, adjusted),
    pacf=lambda s, nlags=None: c.pacf(s.ts, nlags),
    pacf_detrended=lambda s, nlags=None: c.pacf(s.detrended, nlags),
    pacf_diff=lambda s, num_diff=1, nlags=None: c.pacf(np.diff(s.ts, num_diff), nlags),
    acf_first_nonsig=lambda s, max_nlags=None, adjusted=True, threshold=None: c.first_where(np.abs(s.acf_of(max_nlags, adjusted)) <= (1.96 / math.sqrt(s.n) if threshold is None else threshold)),
    acf_first_nonpos=lambda s, max_nlags=None, adjusted=True: c.first_where(s.acf_of(max_nlags, adjusted) <= 0),
    first_acf_locmin=lambda s, max_nlags=None, adjusted=True: float(at[0] + 1) if len(at := c.local_minima(s.acf_of(max_nlags, adjusted))) else NAN,
    trev=lambda s, only_numerator=False: lagged_moment(s.ts, s.lag, only_numerator),
    tc3=lambda s, only_numerator=False: triple(s.ts, s.lag, only_numerator),
    gen_autocorr=general_autocorrelation,
    autocorr_crit_pt=lambda s, crit_point_type="non-plateau", return_lags=True, max_nlags=None, adjusted=True: np.flatnonzero(x).astype(float) if len(x := c.critical_points(s.acf_of(max_nlags, adjusted), crit_point_type)) and return_lags else x,
    gresid_autocorr=lambda s, nlags=8, adjusted=True: c.acf(s.gaussian - c.super_smoother(s.gaussian), nlags, adjusted),
    gresid_lbtest=lambda s, nlags=8: ljung_box(s.gaussian, nlags),
    autocorr_out_dist=without_outliers,
)

# ---- randomization


def progressive(s: Series, stat, name: str, strategy: str = "dist-dynamic", prop_rep: float = 2, prop_interval: float = 0.1) -> np.ndarray:
    """The statistic while entries are overwritten by entries drawn from the series ('dist-static': as it was, 'dist-dynamic': as it is by then) or swapped ('permute'); a last 0 where the steps go up evenly."""
    if strategy not in ("dist-static", "dist-dynamic", "permute"):
        raise ValueError(f"no such strategy: {strategy}")
    rng, x = s.rng(name), s.z.copy()
    source = s.z if strategy == "dist-static" else x
    times, every = math.ceil(prop_rep * s.n), max(1, math.ceil(prop_interval * s.n))
    times += times % every
    out = np.zeros(1 + times // every)
    for k, (a, b) in enumerate(rng.integers(s.n, size=(times, 2))):
        if strategy == "permute":
            x[a], x[b] = x[b], x[a]
        else:
            x[a] = source[b]
        if k % every == 0:
            out[k // every] = stat(x)
    return out


def subsamples(s: Series, x: np.ndarray, num: int, share: float, name: str) -> np.ndarray:
    """Pieces of equal length, one in each row."""
    w = math.ceil(share * s.n)
    return x[s.rng(name).integers(0, s.n - w + 1, num)[:, None] + np.arange(w)]


def surrogates(s: Series, stat, name: str, num: int = 32, rounds: int = 128) -> np.ndarray:
    """Statistic of surrogates with the series' values and nearly its spectrum, relative to that of the series."""
    rng, own = s.rng(name), stat(s.ts, s.lag)
    ordered, size = np.sort(s.ts), np.abs(np.fft.rfft(s.ts))
    x = np.array([rng.permutation(s.ts) for _ in range(num)])
    before, going = np.full((num, s.n), -1), np.arange(num)
    for _ in range(rounds):
        y = np.fft.irfft(size * np.exp(1j * np.angle(np.fft.rfft(x[going]))), s.n)
        rank = np.argsort(np.argsort(y, axis=1, kind="stable"), axis=1, kind="stable")
        moved = (rank != before[going]).any(axis=1)
        going, rank = going[moved], rank[moved]
        if not len(going):
            break
        before[going], x[going] = rank, ordered[rank]
    return np.array([stat(row, s.lag) / own if own else NAN for row in x], float)


def detrended_acf(rows: np.ndarray) -> np.ndarray:
    """Autocorrelation of each row without its smooth trend."""
    return c.acf_rows(rows - c.super_smoother(rows))


put(
    "randomize",
    itrand_mean=lambda s, **o: progressive(s, np.mean, "itrand_mean", **o),
    itrand_sd=lambda s, **o: progressive(s, c.sd, "itrand_sd", **o),
    itrand_acf=lambda s, **o: progressive(s, lambda x: c.acf(x, 1)[0] if len(x) > 1 else NAN, "itrand_acf", **o),
    resample_std=lambda s: np.array([c.sd(x) for x in subsamples(s, s.z, 64, 0.1, "resample_std")]),
    resample_first_acf_nonpos=lambda s: np.array([c.first_where(r <= 0) for r in detrended_acf(subsamples(s, s.ts, 128, 0.2, "resample_first_acf_nonpos"))]),
    resample_first_acf_locmin=lambda s: np.array([float(a[0] + 1) if len(a := c.local_minima(r)) else NAN for r in detrended_acf(subsamples(s, s.ts, 128, 0.2, "resample_first_acf_locmin"))]),
    surr_trev=lambda s: surrogates(s, lagged_moment, "surr_trev"),
    surr_tc3=lambda s: surrogates(s, triple, "surr_tc3"),
)

# ---- landmarks: forecasts in five expanding folds

for _name, _model in models.LANDMARKS.items():
    put_many("landmarking", **{_name: lambda many, *, _f=_model, **o: models.cross_validated(many, _f, **o)})
for _name in ("model_mean", "model_linear"):
    put_many("landmarking", **{_name + "_acf_first_nonpos": lambda many, *, _f=models.LANDMARKS[_name], **o: models.cross_validated(many, _f, lambda p, y: c.first_where(c.acf(y - p) <= 0), **o)})

#: Features of arrays: where they fail, the array is empty and not a number.
SCALARS = frozenset("""length period frac_cp peak_frac trough_frac walker_cross_frac embed_in_shell emb_lag emb_dim_cao trend_strenght season_strenght sd_residuals sd_diff sd_sdiff skewness_residuals
skewness_diff skewness_sdiff kurtosis_residuals kurtosis_diff kurtosis_sdiff exp_max_lyap exp_hurst dfa corr_dim opt_boxcox_coef t_mean des_level des_trend ets_level ets_trend ets_season linearity curvature
avg_cycle_period gaussian_r_sqr ioe_std_slope ioe_std_adj_r_sqr ps_entropy low_freq_power hist_entropy hist_ent_out_diff ami_first_critpt ami_curvature approx_entropy sample_entropy control_entropy lz_complexity
test_dw test_earch test_adf test_adf_gls test_pp test_kpss test_za test_lilliefors acf_first_nonsig acf_first_nonpos first_acf_locmin trev tc3 gen_autocorr""".split())  # fmt: skip
_LAG = ("lag", "max_nlags")
_OWN_NLAGS = ("acf_first_nonsig", "acf_first_nonpos", "first_acf_locmin", "autocorr_crit_pt", "test_lb", "test_earch")


_FAILS = (ValueError, ZeroDivisionError, IndexError, FloatingPointError, OverflowError, ArithmeticError, np.linalg.LinAlgError)


def _chosen(s: Series, name: str, options: dict) -> Series:
    """The series with the embedding lag that ``options`` choose; what chooses it is taken out of them."""
    chosen = {k: options.pop(k) for k in _LAG if k in options and not (k == "max_nlags" and name in _OWN_NLAGS)}
    return s.with_lag(**chosen) if chosen else s


def compute(s: Series, name: str, options: dict | None = None):
    """The operator's value; where it fails on this series NaN, or an empty array if it gives arrays.

    ``options`` are the operator's own; ``lag`` (a number, 'ami', 'acf' or 'acf-nonsig') and ``max_nlags`` choose the embedding lag of all that have one.
    """
    options = dict(options or {})
    s = _chosen(s, name, options)
    try:
        with np.errstate(all="ignore"):
            return FEATURES[name][1](s, **options)
    except _FAILS:
        return NAN if name in SCALARS else np.empty(0)


def compute_many(many: list[Series], name: str, options: dict | None = None) -> list:
    """As ``compute``, of each series: at once where the operator can, else (or where it fails so) one by one."""
    if together := getattr(FEATURES[name][1], "together", None):
        own = dict(options or {})
        series = [_chosen(s, name, own := dict(options or {})) for s in many]
        try:
            with np.errstate(all="ignore"):
                return together(series, **own)
        except _FAILS:
            pass
    return [compute(s, name, options) for s in many]
