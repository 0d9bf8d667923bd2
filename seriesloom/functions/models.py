"""Forecasting models, cross-validation and unit-root tests on numpy arrays, written from the published methods."""

from __future__ import annotations

import math

import numpy as np

from . import core as c

NAN = c.NAN
FOLDS = 5


def golden(f, lo: float, hi: float, tol: float = 1e-6) -> float:
    """Least value of a function of one number by golden sections."""
    g = (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    while hi - lo > tol:
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2


#: Of so many columns or fewer, a recursion runs over numbers of one after the other; of more, over all at each time. Both round alike.
_FEW = 16


def columns(many: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Series (the longest first) as columns, with zeros at their ends, and their lengths."""
    sizes = np.array([len(x) for x in many], np.int64)
    out = np.zeros((sizes.max(initial=0), len(many)))
    for i, x in enumerate(many):
        out[: len(x), i] = x
    return out, sizes


def going(sizes: np.ndarray) -> list[int]:
    """How many of the columns go beyond each time; ``sizes`` descend."""
    return (len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes.max(initial=0)), "right")).tolist()


class Arima:
    """ARIMA by conditional sum of squares; autoregressive and moving-average parts kept stable. Fits many series at once."""

    def __init__(self, order: tuple[int, int, int], const: bool):
        self.order, self.const = order, const

    def _split(self, par):
        p, _, q = self.order
        return par[:, :p], par[:, p : p + q], par[:, p + q] if self.const else np.zeros(len(par))

    def _errors(self, par: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Errors (columns) of the series ``of``, in ascending order, with a row of parameters each; what lies beyond a series' end has no meaning."""
        ar, ma, mean = self._split(par)
        w = self.w[: self.sizes[of].max(initial=0), of] - mean
        e = w.copy()
        for i in range(self.order[0]):
            e[i + 1 :] -= ar[:, i] * w[: max(len(w) - 1 - i, 0)]
        if not self.order[2]:
            return e
        if len(of) <= _FEW:
            for m, (size, b) in enumerate(zip(self.sizes[of].tolist(), ma.tolist())):
                one = e[:size, m].tolist()
                for t in range(1, size):
                    for j in range(min(t, len(b))):
                        one[t] -= b[j] * one[t - 1 - j]
                e[:size, m] = one
            return e
        ma = np.ascontiguousarray(ma.T)
        for t, m in enumerate(going(self.sizes[of])):
            for j in range(min(t, len(ma))):
                e[t, :m] -= ma[j, :m] * e[t - 1 - j, :m]
        return e

    def _loss(self, par: np.ndarray, of: np.ndarray) -> np.ndarray:
        out = np.full(len(par), NAN)
        ar, ma, _ = self._split(par)
        for coef in (ar, -ma):
            bad = np.isnan(out) & (_greatest_root(coef) >= 0.999)
            out[bad] = 1e12 * (1 + np.abs(coef[bad]).sum(1))
        on = np.flatnonzero(np.isnan(out))
        if len(on):
            e, total, first = self._errors(par[on], of[on]), np.zeros(len(on)), self.order[0]
            e *= e
            if len(on) <= _FEW:
                for m, size in enumerate(self.sizes[of[on]].tolist()):
                    one = 0.0
                    for v in e[first:size, m].tolist():
                        one += v
                    total[m] = one
            else:
                for t, m in enumerate(going(self.sizes[of[on]])):
                    if t >= first:
                        total[:m] += e[t, :m]
            out[on] = total
        return out

    def fit(self, many: list[np.ndarray]) -> Arima:
        """``kept``: places in ``many`` of those that are long enough and of numbers, the longest first; ``par`` has their parameters."""
        p, d, q = self.order
        diffs = [np.diff(y, d) for y in many]
        self.kept = sorted((i for i, w in enumerate(diffs) if len(w) >= p + q + 2 and np.isfinite(w).all()), key=lambda i: -len(diffs[i]))
        self.y, diffs = [many[i] for i in self.kept], [diffs[i] for i in self.kept]
        self.w, self.sizes = columns(diffs)
        start = np.zeros((len(diffs), p + q + self.const))
        mean, scale = np.array([w.mean() for w in diffs]), np.array([w.std() or 1.0 for w in diffs])
        if self.const:
            start[:, p + q] = mean
        if p + q and len(diffs):
            every = np.arange(len(diffs))
            if p:
                first = start.copy()
                for i, w in enumerate(diffs):
                    lagged = np.column_stack([w[p - 1 - j : len(w) - 1 - j] for j in range(p)]) - mean[i]
                    first[i, :p] = np.clip(c.lstsq(lagged, w[p:] - mean[i]), -0.9, 0.9)
                start = np.where((self._loss(first, every) < self._loss(start, every))[:, None], first, start)
            unit = np.column_stack([np.full((len(diffs), p + q), 0.2), *([0.2 * scale] if self.const else [])])
            start = start + c.nelder_mead(lambda v, of: self._loss(start[of] + v * unit[of], of), np.zeros(start.shape), 1.0, 60) * unit
        self.par = start
        self.ar = start[:, :p]
        return self

    def forecast(self, steps: list[int]) -> list[np.ndarray | None]:
        """Forecasts of each of the series that were given, none for those without a fit. ``steps``: how many of each."""
        p, d, q = self.order
        out = [None] * len(steps)
        if not self.kept:
            return out
        errors = self._errors(self.par, np.arange(len(self.kept)))
        ars, mas, means = (x.tolist() for x in self._split(self.par))
        for m, (i, size) in enumerate(zip(self.kept, self.sizes.tolist())):
            ar, ma, mean, many = ars[m], mas[m], means[m], steps[i]
            e, w = errors[:size, m].tolist(), (self.w[:size, m] - mean).tolist()
            for _ in range(many):
                w.append(sum(ar[j] * w[-1 - j] for j in range(p)) + sum(ma[j] * e[-1 - j] for j in range(q)))
                e.append(0.0)
            ahead = np.array(w[len(w) - many :]) + mean
            for k in range(d, 0, -1):
                ahead = np.diff(self.y[m], k - 1)[-1] + ahead.cumsum()
            out[i] = ahead
        return out


def _greatest_root(coef: np.ndarray) -> np.ndarray:
    """Greatest absolute value of the roots of x^k - coef[0] x^(k - 1) - ... in each row."""
    k = coef.shape[1]
    if k == 0:
        return np.zeros(len(coef))
    if k == 1:
        return np.abs(coef[:, 0])
    if k == 2:
        a, b = coef.T
        inner = a * a + 4 * b
        return np.where(inner >= 0, (np.abs(a) + np.sqrt(np.maximum(inner, 0))) / 2, np.sqrt(np.maximum(-b, 0)))
    return np.array([np.abs(np.roots(np.r_[1, -x])).max(initial=0) for x in coef])


class Smoothing:
    """Exponential smoothing with optional additive trend (damped) and additive or multiplicative season. Fits many series at once."""

    def __init__(self, trend: bool, damped: bool = False, multiplicative: bool = False):
        self.trend, self.damped, self.multiplicative = trend, damped, multiplicative

    def _weights(self, par: np.ndarray):
        """alpha, beta, gamma and phi of parameters (rows): level, slope, then the season's where there is one, then damping."""
        s = 1 / (1 + np.exp(-np.clip(par, -30, 30)))
        alpha, beta, phi = s[:, 0], np.zeros(len(s)), np.ones(len(s))
        gamma = (1 - alpha) * s[:, 1 + self.trend] if self.seasonal else np.zeros(len(s))
        if self.trend:
            beta = alpha * s[:, 1]
            if self.damped:
                phi = 0.8 + 0.195 * s[:, -1]
        return alpha, beta, gamma, phi

    def _run(self, par: np.ndarray, of: np.ndarray):
        """Sum of squared errors, last level and slope, and seasons by time (a column each), of the series ``of`` in ascending order."""
        alpha, beta, gamma, phi = self._weights(par)
        sizes, p, times = self.sizes[of], self.period[of], self.multiplicative
        level, slope, sse = self.level[of], self.slope[of], np.zeros(len(of))
        season = np.zeros((sizes.max(initial=0) + p.max(initial=0), len(of)))
        if self.seasonal:
            season[: p.max(initial=0)] = self.start[: p.max(initial=0), of]
        else:
            season[:] = 1.0 if times else 0.0
        if len(of) <= _FEW:
            for m, (size, k, a, b, g, f) in enumerate(zip(sizes.tolist(), p.tolist(), alpha.tolist(), beta.tolist(), gamma.tolist(), phi.tolist())):
                x, y, z, s = float(level[m]), float(slope[m]), 0.0, season[:, m].tolist()
                for t, v in enumerate(self.y[:size, of[m]].tolist()):
                    old, base = s[t], x + f * y
                    e = v - (base * old if times else base + old)
                    z += e * e
                    new = a * ((v / old if old else v) if times else v - old) + (1 - a) * base
                    if self.trend:
                        y = b / a * (new - x) + (1 - b / a) * f * y
                    if self.seasonal:
                        s[t + k] = g * ((v / base if base else 1.0) if times else v - base) + (1 - g) * old
                    x = new
                level[m], slope[m], sse[m], season[:, m] = x, y, z, s
            return sse, level, slope, season
        many, flat, place = len(of), season.reshape(-1), p * len(of) + np.arange(len(of))
        share, rest, kept, fixed = beta / alpha, (1 - beta / alpha) * phi, 1 - alpha, 1 - gamma
        whole = self.y[: len(season), of]
        for t, m in enumerate(going(sizes)):
            v, old, base = whole[t, :m], season[t, :m], level[:m] + phi[:m] * slope[:m]
            e = v - (base * old if times else base + old)
            sse[:m] += e * e
            new = alpha[:m] * (np.where(old != 0, v / old, v) if times else v - old) + kept[:m] * base
            if self.trend:
                slope[:m] = share[:m] * (new - level[:m]) + rest[:m] * slope[:m]
            if self.seasonal:
                flat[place[:m] + t * many] = gamma[:m] * (np.where(base != 0, v / base, 1.0) if times else v - base) + fixed[:m] * old
            level[:m] = new
        return sse, level, slope, season

    def fit(self, many: list[np.ndarray], periods: list[int]) -> Smoothing:
        """``of``: by place in ``many`` the place of its fit, none where it is too short or not of numbers. All have a season (periods above 1) or none."""
        sized = [(len(y), p, i) for i, (y, p) in enumerate(zip(many, periods)) if len(y) >= max(3, 2 * p if p > 1 else 3) and np.isfinite(y).all()]
        sized.sort(key=lambda x: -x[0])
        self.of = {i: m for m, (_, _, i) in enumerate(sized)}
        self.seasonal = any(p > 1 for _, p, _ in sized)
        self.y, self.sizes = columns([many[i] for _, _, i in sized])
        self.period = np.array([p for _, p, _ in sized], np.int64)
        self.level, self.slope = np.zeros(len(sized)), np.zeros(len(sized))
        self.start = np.zeros((self.period.max(initial=0), len(sized)))
        for m, (n, p, i) in enumerate(sized):
            y = many[i]
            if p > 1:
                cycles = y[: n // p * p].reshape(-1, p)
                mean = cycles.mean(1)
                self.level[m] = mean[0]
                self.slope[m] = (mean[1] - mean[0]) / p if self.trend else 0.0
                self.start[:p, m] = ((cycles / np.where(mean == 0, 1, mean)[:, None]) if self.multiplicative else cycles - mean[:, None]).mean(0)
            elif self.trend:
                self.slope[m], self.level[m] = np.polyfit(np.arange(min(n, 10)), y[:10], 1)
            else:
                self.level[m] = y[:10].mean()
        start = np.zeros((len(sized), 1 + self.trend + self.seasonal + (self.trend and self.damped)))
        best = c.nelder_mead(lambda v, of: self._run(v, of)[0], start, 1.0, 60)
        self.alpha, self.beta, self.gamma, self.phi = self._weights(best) if len(best) else (np.zeros(0),) * 4
        _, self.end_level, self.end_slope, self.season = self._run(best, np.arange(len(sized))) if len(best) else (None,) * 4
        self.beta = self.beta / self.alpha * self.alpha if self.trend else np.full(len(best), NAN)
        self.gamma = self.gamma if self.seasonal else np.full(len(best), NAN)
        return self

    def forecast(self, steps: list[int]) -> list[np.ndarray | None]:
        """Forecasts of each of the series that were given, none for those without a fit. ``steps``: how many of each."""
        out = [None] * len(steps)
        for i, m in self.of.items():
            ahead, total, n, p, phi = [], 0.0, int(self.sizes[m]), int(self.period[m]), float(self.phi[m])
            level, slope, season = float(self.end_level[m]), float(self.end_slope[m]), self.season[n : n + p, m].tolist()
            for h in range(1, steps[i] + 1):
                total += phi**h
                base = level + (total if self.damped else h) * slope
                s = season[(h - 1) % p] if self.seasonal else None
                ahead.append(base if s is None else base * s if self.multiplicative else base + s)
            out[i] = np.array(ahead, float)
        return out


def _solved(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of stacked systems, and which of them have one."""
    try:
        return np.linalg.solve(a, b[:, :, None])[:, :, 0], np.ones(len(a), bool)
    except np.linalg.LinAlgError:
        out, ok = np.zeros(b.shape), np.ones(len(a), bool)
        for i in range(len(a)):
            try:
                out[i] = np.linalg.solve(a[i], b[i])
            except np.linalg.LinAlgError:
                ok[i] = False
        return out, ok


def marquardt(shape, x: np.ndarray, y: np.ndarray, start: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Least squares by damped Gauss-Newton steps with a numeric Jacobian, of rows of equal length; parameters and which rows have a fit.

    Curves are par[0] * shape(x, *par[1:-1]) + par[-1]. Normal equations change only where a step was taken.
    """
    par, mu, ok = np.array(start, float), np.full(len(start), 1e-3), np.ones(len(start), bool)
    many, k = par.shape
    at = lambda i, p: shape(x[i], *(p[:, j, None] for j in range(1, k - 1)))
    curve = at(np.arange(many), par)
    rest = par[:, :1] * curve + par[:, -1:] - y
    now = (rest**2).sum(1)
    a, damp, g = np.empty((many, k, k)), np.zeros((many, k, k)), np.empty((many, k))
    on = moved = np.arange(many)
    for _ in range(rounds):
        if len(moved):
            p, f, jac = par[moved], curve[moved], np.empty((len(moved), x.shape[1], k))
            for j in range(k):
                h = 1e-6 * (1 + np.abs(p[:, j]))
                more, less = p.copy(), p.copy()
                more[:, j] += h
                less[:, j] -= h
                up, down = (f, f) if j in (0, k - 1) else (at(moved, more), at(moved, less))
                jac[:, :, j] = ((more[:, :1] * up + more[:, -1:]) - (less[:, :1] * down + less[:, -1:])) / (2 * h[:, None])
            for i, m, r in zip(moved.tolist(), jac, rest[moved]):
                a[i], g[i] = m.T @ m, m.T @ r
            damp[moved[:, None], range(k), range(k)] = a[moved[:, None], range(k), range(k)] + 1e-12
        step, ok[on] = _solved(a[on] + mu[on, None, None] * damp[on], -g[on])
        p = par[on] + step
        f = at(on, p)
        r = p[:, :1] * f + p[:, -1:] - y[on]
        new = (r**2).sum(1)
        less = (new < now[on]) & ok[on]
        done = np.where(less, now[on] - new < 1e-12 * now[on], mu[on] * 4 > 1e12) | ~ok[on]
        moved = on[less]
        par[moved], curve[moved], rest[moved], now[moved] = p[less], f[less], r[less], new[less]
        mu[on] = np.where(less, mu[on] / 3, mu[on] * 4)
        on, moved = on[~done], on[less & ~done]
        if not len(on):
            break
    return par, ok & np.isfinite(par).all(1)


# ---- landmarks: (train t, train y, test t, series) to forecasts; those marked ``together`` take lists of each, and give none where they fail


def together(f):
    f.together = True
    return f


def _last_quarter(y: np.ndarray) -> np.ndarray:
    return y[-math.ceil(0.25 * len(y)) :]


def _fitted(shape, start):
    """Forecasts of curves of a ``shape`` (see ``marquardt``) from parameters that ``start`` gives of train t and y; folds whose training parts are equally long go together."""

    @together
    def run(tx, y, tt, s):
        out, by = [None] * len(y), {}
        for i, v in enumerate(y):
            try:
                by.setdefault(len(v), []).append((i, start(tx[i], v)))
            except (ValueError, ZeroDivisionError, IndexError, OverflowError):
                pass
        for rows in by.values():
            par, ok = marquardt(shape, np.array([tx[i] for i, _ in rows]), np.array([y[i] for i, _ in rows]), np.array([p for _, p in rows]))
            for (i, _), p, good in zip(rows, par, ok):
                out[i] = p[0] * shape(tt[i], *p[1:-1]) + p[-1] if good else None
        return out

    return run


def _sine_start(t, y):
    size = np.abs(np.fft.rfft(y - y.mean()))[1:]
    return [y.std() * math.sqrt(2), 2 * math.pi * np.fft.rfftfreq(len(y), t[1] - t[0])[1:][size.argmax()], 0.0, y.mean()]


_sine = _fitted(lambda t, w, p: np.sin(w * t + p), _sine_start)
_exponential = _fitted(lambda t, b: np.exp(np.clip(b * t, -500, 500)), lambda t, y: [0.1, y[-1] / y[-2] if y[-2] else 1.0, 0.0])


def _gaussian(tx, y, tt, s):
    k = lambda a, b: np.exp(-0.5 * (a[:, None] - b[None]) ** 2)
    return k(tt, tx) @ np.linalg.solve(k(tx, tx) + 1e-10 * np.eye(len(tx)), y)


def _linear(tx, y, tt, s):
    m = lambda t: np.column_stack([np.ones(len(t)), t])
    return m(tt) @ c.lstsq(m(tx), y)


def _linear_embedding(tx, y, tt, s):
    dim, lag = max(2, s.emb_dim + 1), s.lag
    e = c.embed(y, dim, lag)
    if len(e) < dim + 1:
        raise ValueError("too few vectors")
    b = c.lstsq(np.column_stack([np.ones(len(e)), e[:, 1:]]), e[:, 0])
    whole = np.r_[y, s.fold_y[len(y) : len(y) + len(tt)]]
    now = np.array([[whole[t - j * lag] for j in range(1, dim)] for t in range(len(y), len(whole))])
    return np.column_stack([np.ones(len(tt)), now]) @ b


def _seasonal_means(tx, y, tt, s):
    p = s.period
    if p <= 1:
        raise ValueError("no season")
    phase = np.arange(len(y)) % p
    means = np.array([y[phase == k].mean() if (phase == k).any() else y[phase == 0].mean() for k in range(p)])
    return means[(len(y) + np.arange(len(tt))) % p]


def _drift(tx, y, tt, s):
    return y[-1] + (y[-1] - y[0]) / (len(y) - 1) * np.arange(1, len(tt) + 1)


def _naive_season(tx, y, tt, s):
    p = s.period
    if p <= 1 or len(y) < p:
        raise ValueError("no season")
    return y[len(y) - p + np.arange(len(tt)) % p]


def _arima(order, const):
    return together(lambda tx, y, tt, s: Arima(order, const).fit(y).forecast([len(t) for t in tt]))


def _winters(multiplicative):
    @together
    def run(tx, y, tt, s):
        on, move = [i for i, x in enumerate(s) if x.period > 1], 1.0 if multiplicative else 0.0  # values in [1, 2]
        fit, out = Smoothing(True, True, multiplicative).fit([y[i] + move for i in on], [s[i].period for i in on]), [None] * len(y)
        for i, p in zip(on, fit.forecast([len(tt[i]) for i in on])):
            out[i] = None if p is None else p - move
        return out

    return run


LANDMARKS = {
    "model_mean": lambda tx, y, tt, s: np.full(len(tt), y.mean()),
    "model_loc_mean": lambda tx, y, tt, s: np.full(len(tt), _last_quarter(y).mean()),
    "model_loc_median": lambda tx, y, tt, s: np.full(len(tt), np.median(_last_quarter(y))),
    "model_sine": _sine,
    "model_exp": _exponential,
    "model_gaussian": _gaussian,
    "model_linear": _linear,
    "model_linear_embed": _linear_embedding,
    "model_linear_seasonal": _seasonal_means,
    "model_naive": lambda tx, y, tt, s: np.full(len(tt), y[-1]),
    "model_naive_drift": _drift,
    "model_naive_seasonal": _naive_season,
    "model_arima_100_c": _arima((1, 0, 0), True),
    "model_arima_010_c": _arima((0, 1, 0), True),
    "model_arima_110_c": _arima((1, 1, 0), True),
    "model_arima_011_nc": _arima((0, 1, 1), False),
    "model_arima_011_c": _arima((0, 1, 1), True),
    "model_arima_021_c": _arima((0, 2, 1), True),
    "model_arima_112_nc": _arima((1, 1, 2), False),
    "model_ses": together(lambda tx, y, tt, s: Smoothing(False).fit(y, [1] * len(y)).forecast([len(t) for t in tt])),
    "model_hwes_ada": _winters(False),
    "model_hwes_adm": _winters(True),
}


def mse(p, y):
    return float(((p - y) ** 2).mean())


def rmse(p, y):
    return math.sqrt(mse(p, y))


def mae(p, y):
    return float(np.abs(p - y).mean())


def smape(p, y):
    return float((np.abs(p - y) / (1e-9 + np.abs(p) + np.abs(y))).mean())


def folds(n: int, k: int = FOLDS) -> list[tuple[int, int]]:
    """(end of train, end of test) of each expanding fold; none if the series is too short."""
    size = n // (k + 1)
    return [(n - (k - i) * size, n - (k - i - 1) * size) for i in range(k)] if size else []


SCORES = {"rmse": rmse, "mse": mse, "mae": mae, "smape": smape}


def cross_validated(many, model, own=None, score="rmse", num_cv_folds: int = FOLDS, lm_sample_frac: float = 1.0) -> list[np.ndarray]:
    """Of each of many series, the score (a name or a function of prediction and values; ``own`` goes first) of each fold of the last ``lm_sample_frac`` of the series; values are scaled to [0, 1] on the fold's training part, time runs from 0 to 1."""
    judge = own or SCORES.get(score, score)
    if not callable(judge):
        raise ValueError(f"no such score: {score}")
    out, rows = [], []
    for s in many:
        if lm_sample_frac < 1:
            s = s.tail(math.ceil(s.n * lm_sample_frac))
        t, parts = np.linspace(0, 1, s.n), folds(s.n, num_cv_folds)
        out.append(np.full(len(parts), NAN))
        for k, (a, b) in enumerate(parts):
            lo, hi = s.ts[:a].min(), s.ts[:a].max()
            rows.append((out[-1], k, t[:a], (s.ts[:b] - lo) / ((hi - lo) or 1.0), t[a:b], s))
    if getattr(model, "together", False):
        found = model([r[2] for r in rows], [r[3][: len(r[2])] for r in rows], [r[4] for r in rows], [r[5] for r in rows]) if rows else []
        forecast = lambda k: found[k]
    else:

        def forecast(k: int):
            _, _, tx, y, tt, s = rows[k]
            s.fold_y = y
            return model(tx, y[: len(tx)], tt, s)

    for k, (scores, fold, tx, y, _, _) in enumerate(rows):
        try:
            p = forecast(k)
            if p is not None and np.isfinite(p := np.asarray(p, float)).all():
                scores[fold] = judge(p, y[len(tx) :])
        except (ValueError, ZeroDivisionError, IndexError, OverflowError, np.linalg.LinAlgError):
            pass
    return out


# ---- unit roots

# MacKinnon's (1994) response surfaces for one variable. Polynomials in the statistic,
# lowest power first, below and above the split; probabilities are normal tails of them.
MACKINNON = {
    "n": {"min": -19.04, "max": math.inf, "split": -1.04, "low": (0.6344, 1.2378, 0.032496), "high": (0.4797, 0.93557, -0.06999, 0.033066)},
    "c": {"min": -18.83, "max": 2.74, "split": -1.61, "low": (2.1659, 1.4412, 0.038269), "high": (1.7339, 0.93202, -0.12745, -0.010368)},
    "ct": {"min": -16.18, "max": 0.7, "split": -2.89, "low": (3.2512, 1.6047, 0.049588), "high": (2.5261, 0.61654, -0.37956, -0.060285)},
}
# KPSS (1992) critical values around a mean, and Zivot and Andrews (1992) for a break in the mean.
KPSS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
ZIVOT_ANDREWS = ((-5.34, 0.01), (-4.80, 0.05), (-4.58, 0.10), (-3.75, 0.50), (-2.99, 0.90), (-2.77, 0.95), (-2.32, 0.99))


def mackinnon(stat: float, kind: str) -> float:
    t = MACKINNON[kind]
    if not stat == stat:
        return NAN
    if stat > t["max"]:
        return 1.0
    if stat < t["min"]:
        return 0.0
    return float(c.normal_cdf(sum(b * stat**i for i, b in enumerate(t["low" if stat <= t["split"] else "high"]))))


def _df(x: np.ndarray, lags: int, kind: str, skip: int = 0) -> tuple[float, float]:
    """t statistic of the level in a Dickey-Fuller regression, and its Akaike criterion. ``skip``: rows left out for equal samples."""
    d = np.diff(x)
    a = max(lags, skip)
    y = d[a:]
    cols = [x[a:-1], *(d[a - k : len(d) - k] for k in range(1, lags + 1))]
    if kind != "n":
        cols.append(np.ones(len(y)))
    if kind == "ct":
        cols.append(np.arange(len(y), dtype=float))
    m = np.column_stack(cols)
    if len(y) <= m.shape[1] + 1:
        return NAN, math.inf
    b, se, _, ssr = c.ols(m, y)
    aic = len(y) * math.log(max(ssr, 1e-300) / len(y)) + 2 * m.shape[1]
    return (float(b[0] / se[0]) if se[0] > 0 else NAN), aic


def _best_lags(x: np.ndarray, most: int, kind: str) -> int:
    most = max(0, min(most, len(x) // 2 - 3))
    return min(range(most + 1), key=lambda k: _df(x, k, kind, most)[1])


def adf(x: np.ndarray, most: int = 16) -> float:
    if len(x) < 8 or not x.std() > 0:
        return NAN
    return mackinnon(_df(x, _best_lags(x, most, "c"), "c")[0], "c")


def adf_gls(x: np.ndarray, most: int = 16) -> float:
    """Elliott, Rothenberg and Stock: detrended at a local alternative; the distribution is that without a mean."""
    n = len(x)
    if n < 8 or not x.std() > 0:
        return NAN
    rho = 1 - 7 / n
    z = np.r_[1.0, np.full(n - 1, 1 - rho)]
    y = np.r_[x[0], x[1:] - rho * x[:-1]]
    d = x - (z @ y) / (z @ z)
    return mackinnon(_df(d, _best_lags(d, most, "n"), "n")[0], "n")


def long_run_variance(e: np.ndarray, lags: int) -> float:
    n = len(e)
    out = e @ e / n
    for k in range(1, min(lags, n - 1) + 1):
        out += 2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n
    return float(out)


def phillips_perron(x: np.ndarray, lags: int = 16) -> float:
    n = len(x) - 1
    if n < 5 or not x.std() > 0:
        return NAN
    b, se, e, ssr = c.ols(np.column_stack([x[:-1], np.ones(n)]), x[1:])
    if not ssr > 0:
        return NAN
    short, long, s2 = ssr / n, long_run_variance(e, lags), ssr / (n - 2)
    if not long > 0:
        return NAN
    t = (b[0] - 1) / se[0]
    stat = math.sqrt(short / long) * t - 0.5 * (long - short) / math.sqrt(long) * n * se[0] / math.sqrt(s2)
    return mackinnon(float(stat), "c")


def _between(stat: float, table) -> float:
    x, p = zip(*sorted(table))
    return float(np.interp(stat, x, p))


def kpss(x: np.ndarray, lags: int = 16) -> float:
    e = x - x.mean()
    v = long_run_variance(e, lags) if len(x) > 2 else 0.0
    return _between(float((e.cumsum() ** 2).sum() / len(x) ** 2 / v), KPSS) if v > 0 else NAN


def zivot_andrews(x: np.ndarray, trim: float = 0.15) -> float:
    """Least t statistic over breaks of the mean, with the lags that the unbroken regression prefers."""
    n = len(x)
    if n < 15 or not x.std() > 0:
        return NAN
    lags = _best_lags(x, min(12, n // 6), "ct")
    d = np.diff(x)
    y = d[lags:]
    base = np.column_stack([x[lags:-1], *(d[lags - k : len(d) - k] for k in range(1, lags + 1)), np.ones(len(y)), np.arange(len(y), dtype=float)])
    stats = []
    for at in range(max(2, int(trim * len(y))), int((1 - trim) * len(y))):
        m = np.column_stack([base, (np.arange(len(y)) >= at).astype(float)])
        if len(y) <= m.shape[1] + 1:
            return NAN
        b, se, _, _ = c.ols(m, y)
        if se[0] > 0:
            stats.append(b[0] / se[0])
    return _between(float(min(stats)), ZIVOT_ANDREWS) if stats else NAN
