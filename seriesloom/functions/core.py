"""Building blocks on one series as a numpy array. Failures to be defined give NaN, never an exception."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

NAN = float("nan")


def standardize(x: np.ndarray) -> np.ndarray:
    """By mean and population deviation; a constant series becomes zeros."""
    sd = x.std()
    return (x - x.mean()) / (sd if sd > 0 else 1.0)


def standardize_in_order(x: np.ndarray) -> np.ndarray:
    """As ``standardize``, with the sum and Welford's update in the order of time, as the SQL's: what lies at equal distances on both sides of the mean is decided by their rounding."""
    mean = square = 0.0
    for k, v in enumerate(x.tolist(), 1):
        off = v - mean
        mean += off / k
        square += (v - mean) * off
    sd = math.sqrt(square / len(x)) if square == square and square < math.inf else NAN
    return (x - np.cumsum(x)[-1] / len(x)) / (sd if sd > 0 else 1.0)


def erf(x):
    return np.vectorize(math.erf, otypes=[float])(x)


def normal_cdf(x):
    return 0.5 * (1 + erf(np.asarray(x, float) / math.sqrt(2)))


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of chi-square by the regularized incomplete gamma function."""
    if not x > 0:
        return 1.0 if x == x else NAN
    a, h = k / 2, x / 2
    front = math.exp(-h + a * math.log(h) - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= h / n
            total += term
        return max(0.0, 1 - front * total)
    b, c, d = h + 1 - a, 1e300, 1 / (h + 1 - a)
    f = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * f


def acf(x: np.ndarray, nlags: int | None = None, adjusted: bool = True) -> np.ndarray:
    """Autocorrelation at lags 1..nlags (half the length by default)."""
    n = len(x)
    nlags = n // 2 if nlags is None else min(nlags, n - 1)
    d = x - x.mean() if n else x
    c0 = (d @ d) / n if n else 0.0
    if not c0 > 0:
        return np.full(max(nlags, 0), NAN)
    if nlags < 64:
        sums = np.array([d[:-k] @ d[k:] for k in range(1, nlags + 1)])
    else:  # by a transform long enough that ends don't meet
        f = np.fft.rfft(d, 1 << (2 * n - 1).bit_length())
        sums = np.fft.irfft(f * np.conj(f))[1 : nlags + 1]
    return sums / ((n - np.arange(1, nlags + 1)) if adjusted else n) / c0


def acf_rows(x: np.ndarray) -> np.ndarray:
    """``acf`` of each row."""
    n = x.shape[1]
    if n // 2 >= 64:
        return np.array([acf(row) for row in x])
    d = x - x.mean(1, keepdims=True)
    c0 = (d[:, None] @ d[:, :, None])[:, 0, 0] / n
    sums = np.array([(d[:, None, :-k] @ d[:, k:, None])[:, 0, 0] for k in range(1, n // 2 + 1)]).reshape(-1, len(x)).T
    return sums / (n - np.arange(1, n // 2 + 1)) / np.where(c0 > 0, c0, NAN)[:, None]


def pacf(x: np.ndarray, nlags: int | None = None) -> np.ndarray:
    """Partial autocorrelation: last coefficient of a regression on k lags, scaled by n / (n - k)."""
    n = len(x)
    nlags = 1 + n // 10 if nlags is None else nlags
    out = []
    for k in range(1, nlags + 1):
        if n - k <= k + 1:
            out.append(NAN)
            continue
        d = x - x.mean()
        m = np.column_stack([np.ones(n - k), *(d[k - j - 1 : n - j - 1] for j in range(k))])
        out.append(float(lstsq(m, d[k:])[-1]) * n / (n - k))
    return np.array(out)


def lstsq(m: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(m, y, rcond=None)[0]


def ols(m: np.ndarray, y: np.ndarray):
    """Coefficients, their standard errors, residuals and residual sum of squares."""
    b = lstsq(m, y)
    r = y - m @ b
    free = len(y) - m.shape[1]
    s2 = (r @ r) / free if free > 0 else NAN
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(m.T @ m)) * s2, 0))
    return b, se, r, float(r @ r)


def first_where(mask: np.ndarray) -> float:
    """1-based place of the first true, or NaN."""
    at = np.flatnonzero(mask)
    return float(at[0] + 1) if len(at) else NAN


def local_minima(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero((x[1:-1] < x[:-2]) & (x[1:-1] < x[2:])) + 1


def critical_points(x: np.ndarray, kind: str = "non-plateau") -> np.ndarray:
    """0/1 mask of interior points: min, max, plateau (a neighbour is equal), non-plateau (min or max), any."""
    if len(x) < 3:
        return np.empty(0)
    a, b = x[1:-1] - x[:-2], x[2:] - x[1:-1]
    kinds = {"min": (a < 0) & (b > 0), "max": (a > 0) & (b < 0), "plateau": (a == 0) | (b == 0)}
    kinds["non-plateau"] = kinds["min"] | kinds["max"]
    kinds["any"] = kinds["non-plateau"] | kinds["plateau"]
    return np.r_[0, kinds[kind], 0].astype(float)


def embed(x: np.ndarray, dim: int, lag: int) -> np.ndarray:
    """Delay vectors, newest coordinate first; empty where they do not fit."""
    rows = len(x) - (dim - 1) * lag
    if dim * lag > len(x) or rows < 1:
        return np.empty((0, dim))
    return np.column_stack([x[(dim - 1 - j) * lag : (dim - 1 - j) * lag + rows] for j in range(dim)])


def pairwise(a: np.ndarray, kind: str = "chebyshev") -> np.ndarray:
    d = np.zeros((len(a), len(a)))
    for j in range(a.shape[1]):
        one = np.abs(a[:, j][:, None] - a[:, j][None])
        d = np.maximum(d, one) if kind == "chebyshev" else d + one * one
    return d if kind == "chebyshev" else np.sqrt(d)


def bins_equal_width(x: np.ndarray, num: int, slack: float = 0.0) -> np.ndarray:
    """Bins open above, the last one closed; ``slack`` (of a bin) puts values on an edge into the upper one whatever their rounding."""
    lo, hi = x.min(), x.max()
    if not hi > lo:
        return np.zeros(len(x), int)
    return np.minimum(np.floor((x - lo) / (hi - lo) * num + slack), num - 1).astype(int)


def bins_equal_count(x: np.ndarray, num: int) -> np.ndarray:
    edges = np.quantile(x, np.linspace(0, 1, num + 1)[1:-1])
    return np.searchsorted(edges, x, side="right")


def entropy(counts: np.ndarray, base: float = math.e) -> float:
    p = counts[counts > 0] / counts.sum() if counts.sum() > 0 else np.empty(0)
    return float(-(p * np.log(p)).sum() / math.log(base)) + 0.0 if len(p) else NAN


def window_size(n: int, size: float = 0.1) -> int:
    """Odd window: a share of the length rounded up, one less if even."""
    w = max(1, math.ceil(size * n)) if isinstance(size, float) else min(n, size)
    return w - 1 if w % 2 == 0 else w


def windows(x: np.ndarray, w: int) -> np.ndarray:
    if w < 1 or len(x) < w:
        return np.empty((0, max(w, 1)))
    return np.lib.stride_tricks.sliding_window_view(x, w)


def tiles(x: np.ndarray, num: int = 16) -> list[np.ndarray]:
    """``num`` parts whose lengths differ by one at most, longer ones first; none if they are too short."""
    return [] if num > len(x) / 2 else np.array_split(x, num)


def skew3(x: np.ndarray, method: int = 3) -> float:
    """Skewness by method 1 (population moments), 2 (unbiased under normality) or 3 (moments with the sample deviation)."""
    n, s = len(x), x.std() if len(x) else 0.0
    if not s > 0:
        return NAN
    g = float(((x - x.mean()) ** 3).mean() / s**3)
    return g if method == 1 else (math.sqrt(n * (n - 1)) / (n - 2) * g if n > 2 else NAN) if method == 2 else g * ((n - 1) / n) ** 1.5


def kurt3(x: np.ndarray, method: int = 3) -> float:
    """Excess kurtosis by the methods of ``skew3``."""
    n, s = len(x), x.std() if len(x) else 0.0
    if not s > 0:
        return NAN
    g = float(((x - x.mean()) ** 4).mean() / s**4) - 3
    return g if method == 1 else ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6) if n > 3 else NAN) if method == 2 else (g + 3) * (1 - 1 / n) ** 2 - 3


def sd(x: np.ndarray, ddof: int = 1) -> float:
    return float(x.std(ddof=ddof)) if len(x) > ddof else NAN


# ---- smoothing and decomposition


def _windows_of(n: int, span: int) -> tuple[np.ndarray, ...]:
    """Of local lines over the ``span`` nearest points of an even grid: the grid, ends and sizes of windows, their means, and what spreads and levers need."""
    x, half = np.linspace(0, 1, n), max(1, span // 2)
    lo = np.clip(np.arange(n) - half, 0, max(0, n - 2 * half - 1))
    hi = np.minimum(lo + 2 * half + 1, n)
    m = (hi - lo).astype(float)
    c = lambda v: np.r_[0.0, np.cumsum(v)]
    part = lambda v: c(v)[hi] - c(v)[lo]
    mx = part(x) / m
    vx = part(x * x) / m - mx * mx
    safe = np.where(vx > 1e-14, vx, 1)
    lever = 1 / m + np.where(vx > 1e-14, (x - mx) ** 2 / safe / m, 0)
    return x, lo, hi, m, mx, x - mx, vx > 1e-14, safe, np.maximum(1 - lever, 1e-10)


_windows_kept = lru_cache(1024)(_windows_of)


def running_lines(y: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Local linear fits over the ``span`` nearest points of an evenly spaced grid, and what absolute residuals are divided by to leave a point out. ``y``: a series, or one in each row."""
    n = y.shape[-1]
    x, lo, hi, m, mx, off, wide, safe, left = (_windows_kept if n <= SHORT else _windows_of)(n, span)

    def part(v):
        sums = np.zeros((*v.shape[:-1], n + 1))
        np.cumsum(v, axis=-1, out=sums[..., 1:])
        return sums[..., hi] - sums[..., lo]

    my = part(y) / m
    slope = np.where(wide, (part(x * y) / m - mx * my) / safe, 0)
    return my + slope * off, left


def super_smoother(y: np.ndarray) -> np.ndarray:
    """Friedman's variable-span smoother: three spans, the best by smoothed left-one-out residuals at each point. ``y``: a series, or one in each row."""
    n = y.shape[-1]
    if n < 3:
        return y.astype(float).copy()
    spans = [max(2, round(s * n)) for s in (0.05, 0.2, 0.5)]
    fits, errors = [], []
    for s in spans:
        f, left = running_lines(y, s)
        fits.append(f)
        errors.append(running_lines(np.abs((y - f) / left), spans[1])[0])
    best = np.argmin(errors, axis=0)
    span = running_lines(np.array(spans, float)[best], spans[1])[0]
    span = np.clip(span, spans[0], spans[2])
    # Between the two fits whose spans surround the wanted one.
    j, width = (span > spans[1]).astype(int), np.array(spans, float)
    w = (span - width[j]) / np.maximum(width[j + 1] - width[j], 1)
    out = (1 - w) * np.where(j == 0, fits[0], fits[1]) + w * np.where(j == 0, fits[1], fits[2])
    return running_lines(out, spans[0])[0]


#: Series of so many points or fewer have what depends on lengths alone kept for the next one.
SHORT = 100


def _local(n: int, span: int, extend: int) -> tuple[np.ndarray, ...]:
    """Of local regression on an even grid: the grid, the points asked for, and indices and tricube weights of the neighbours of each."""
    x = np.arange(n, dtype=float)
    at = np.arange(-extend, n + extend, dtype=float)
    q = min(span, n)
    lo = np.clip(np.ceil(at - (q - 1) / 2).astype(int), 0, n - q)
    idx = lo[:, None] + np.arange(q)[None]
    d = np.abs(x[idx] - at[:, None])
    h = np.maximum(d.max(1), 1e-12) * (max(span, n) / n if span > n else 1.0)
    w = np.clip(1 - (d / (h[:, None] * 1.0001)) ** 3, 0, None) ** 3
    return x, at, idx, w / np.maximum(w.sum(1, keepdims=True), 1e-300)


def loess(y: np.ndarray, span: int, extend: int = 0) -> np.ndarray:
    """Local lines with tricube weights on an even grid, also at ``extend`` points beyond either end."""
    x, at, idx, w = _local(len(y), span, extend)
    mx = (w * x[idx]).sum(1)
    vx = (w * (x[idx] - mx[:, None]) ** 2).sum(1)
    slope = (w * (x[idx] - mx[:, None]) * y[idx]).sum(1) / np.where(vx > 1e-12, vx, np.inf)
    return (w * y[idx]).sum(1) + slope * (at - mx)


def _loess_matrix(n: int, span: int, extend: int = 0) -> np.ndarray:
    """The matrix that gives ``loess``, which is linear."""
    x, at, idx, w = _local(n, span, extend)
    mx = (w * x[idx]).sum(1, keepdims=True)
    vx = (w * (x[idx] - mx) ** 2).sum(1, keepdims=True)
    out = np.zeros((len(at), n))
    out[np.arange(len(at))[:, None], idx] = w * (1 + (x[idx] - mx) * (at[:, None] - mx) / np.where(vx > 1e-12, vx, np.inf))
    return out


def _odd(x: float) -> int:
    k = math.ceil(x)
    return k if k % 2 else k + 1


_SEASONAL, _INNER = 7, 5


def _spans(period: int) -> tuple[int, int]:
    """Spans of the low pass and of the trend."""
    return _odd(period + 1), _odd(1.5 * period / (1 - 1.5 / _SEASONAL))


def stl(y: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Trend and season by repeated loess (Cleveland and others, 1990), without robustness rounds."""
    n = len(y)
    if n <= SHORT:
        trend, season = _stl_matrices(n, period)
        return trend @ y, season @ y
    low, trend_span = _spans(period)
    trend = np.zeros(n)
    season = np.zeros(n)
    for _ in range(_INNER):
        d = y - trend
        cycle = np.empty(n + 2 * period)
        for k in range(period):
            part = d[k::period]
            cycle[k::period][: len(part) + 2] = loess(part, _SEASONAL, 1) if len(part) > 1 else np.repeat(part, 3)
        smooth = cycle
        for w in (period, period, 3):
            smooth = np.convolve(smooth, np.ones(w) / w, "valid")
        season = cycle[period : period + n] - loess(smooth, low)
        trend = loess(y - season, trend_span)
    return trend, season


@lru_cache(2048)
def _stl_matrices(n: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Every step of ``stl`` is linear, with weights of the length and the period alone: the matrices that give trend and season."""
    low, trend_span = _spans(period)
    cycle = np.zeros((n + 2 * period, n))
    for k in range(period):
        m = len(range(k, n, period))
        cycle[k::period][: m + 2, k::period] = _loess_matrix(m, _SEASONAL, 1) if m > 1 else 1.0
    smooth = cycle
    for w in (period, period, 3):
        sums = np.vstack([np.zeros((1, n)), np.cumsum(smooth, axis=0)])
        smooth = (sums[w:] - sums[:-w]) / w
    passed, local, one = cycle[period : period + n] - _loess_matrix(n, low) @ smooth, _loess_matrix(n, trend_span), np.eye(n)
    trend = season = np.zeros((n, n))
    for _ in range(_INNER):
        season = passed @ (one - trend)
        trend = local @ (one - season)
    return trend, season


def estimate_periods(rows: np.ndarray) -> list[int]:
    """Of the series in each row, the lag of the greatest absolute autocorrelation without its smooth trend."""
    if rows.shape[1] <= 1:
        return [1] * len(rows)
    return [int(np.nanargmax(r)) + 1 if len(r) and not np.isnan(r).all() else 1 for r in np.abs(acf_rows(rows - super_smoother(rows)))]


def decompose(x: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, season and rest: a super smoother without a period, else loess in both parts. A rest that is rounding alone is zero."""
    if period <= 1 or len(x) < 2 * period:
        trend, season = super_smoother(x), np.zeros(len(x))
    else:
        trend, season = stl(x, period)
    rest = x - trend - season
    return trend, season, rest if len(rest) and np.abs(rest).max() > 1e-9 * x.std() else np.zeros(len(x))


def nelder_mead(f, start: np.ndarray, step: float = 0.5, rounds: int = 200, tol: float = 1e-8) -> np.ndarray:
    """Downhill simplex of many problems (rows of ``start``) at once; enough for the few parameters of these models.

    ``f`` takes points and the problem of each, in ascending order, and gives their values.
    """
    many, k = start.shape
    if not k or not many:
        return start
    pts = np.concatenate([start[:, None], start[:, None] + step * np.eye(k)], axis=1)
    val = f(pts.reshape(-1, k), np.repeat(np.arange(many), k + 1)).reshape(many, k + 1)
    on = np.arange(many)
    for _ in range(rounds * k):
        x, v = pts[on], val[on]
        by = np.argsort(v, axis=1, kind="stable")
        x, v = np.take_along_axis(x, by[:, :, None], 1), np.take_along_axis(v, by, 1)
        pts[on], val[on] = x, v
        going = ~(np.abs(v[:, -1] - v[:, 0]) <= tol * (np.abs(v[:, 0]) + tol))
        on, x, v = on[going], x[going], v[going]
        if not len(on):
            break
        mid = x[:, :-1].mean(1)
        r = mid + (mid - x[:, -1])
        fr = f(r, on)
        best = fr < v[:, 0]
        good = ~best & (fr < v[:, -2])
        pts[on[good], -1], val[on[good], -1] = r[good], fr[good]
        if len(i := np.flatnonzero(best)):
            e = mid[i] + 2 * (mid[i] - x[i, -1])
            fe = f(e, on[i])
            pts[on[i], -1], val[on[i], -1] = np.where((fe < fr[i])[:, None], e, r[i]), np.where(fe < fr[i], fe, fr[i])
        if len(i := np.flatnonzero(~best & ~good)):
            inner = mid[i] + 0.5 * (np.where((fr[i] < v[i, -1])[:, None], r[i], x[i, -1]) - mid[i])
            fc = f(inner, on[i])
            closer = fc < np.where(v[i, -1] < fr[i], v[i, -1], fr[i])
            pts[on[i[closer]], -1], val[on[i[closer]], -1] = inner[closer], fc[closer]
            if len(i := i[~closer]):
                x = x[i, :1] + 0.5 * (x[i, 1:] - x[i, :1])
                pts[on[i], 1:], val[on[i], 1:] = x, f(x.reshape(-1, k), np.repeat(on[i], k)).reshape(-1, k)
    return pts[np.arange(many), val.argmin(1)]
