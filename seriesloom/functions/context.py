"""What several operators need of one series, computed once and on demand."""

from __future__ import annotations

import copy
import math
import zlib
from functools import cached_property

import numpy as np

from . import core as c

NAN = c.NAN


class Series:
    """One series and its derived arrays. ``seed`` makes random operators repeatable by series."""

    def __init__(self, values, period: int | None = None, seed: int = 0, key=0):
        self.ts = np.asarray(values, float).ravel()
        if not len(self.ts):
            raise ValueError("a series needs one observation at least")
        self.n = len(self.ts)
        self._period = period
        self.seed = zlib.crc32(f"{seed}/{key}".encode())
        self.equals: list[Series] = [self]

    def rng(self, name: str) -> np.random.Generator:
        return np.random.default_rng([self.seed, zlib.crc32(name.encode())])

    def tail(self, n: int) -> Series:
        """The last ``n`` values as a series of their own, with this one's period and seed."""
        out = Series(self.ts[-n:], self.period)
        out.seed = self.seed
        return out

    @cached_property
    def z(self) -> np.ndarray:
        return c.standardize(self.ts)

    @cached_property
    def ordered_z(self) -> np.ndarray:
        return c.standardize_in_order(self.ts)

    def _at_once(self, name: str, rows):
        """A property of this series, made with those of the series in ``equals`` that lack it; ``rows`` takes a list of series."""
        many = [s for s in self.equals if name not in s.__dict__]
        many = many if self in many else [self]
        for s, x in zip(many, rows(many)):
            s.__dict__[name] = x
        return self.__dict__[name]

    @cached_property
    def period(self) -> int:
        if self._period is not None:
            return max(1, int(self._period))
        return self._at_once("period", lambda many: c.estimate_periods(np.array([s.ts for s in many])))

    @cached_property
    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return c.decompose(self.ts, self.period)

    @property
    def trend(self) -> np.ndarray:
        return self.parts[0]

    @property
    def season(self) -> np.ndarray:
        return self.parts[1]

    @property
    def resid(self) -> np.ndarray:
        return self.parts[2]

    @property
    def detrended(self) -> np.ndarray:
        return self.ts - self.trend

    @property
    def deseasonalized(self) -> np.ndarray:
        return self.ts - self.season

    @cached_property
    def acf_detrended(self) -> np.ndarray:
        return self._at_once("acf_detrended", lambda many: c.acf_rows(np.array([s.detrended for s in many])))

    def acf_of(self, nlags: int | None = None, adjusted: bool = True) -> np.ndarray:
        """Autocorrelation of the detrended series."""
        return self.acf_detrended if nlags is None and adjusted else c.acf(self.detrended, nlags, adjusted)

    def with_lag(self, lag: int | str | None = None, max_nlags: int | None = None) -> Series:
        """The same series with another embedding lag: a number, or the first lag by 'ami' (least mutual information), 'acf' (not positive) or 'acf-nonsig'."""
        out = copy.copy(self)
        for k in ("lag", "cao", "emb_dim"):
            out.__dict__.pop(k, None)
        lag = "acf-nonsig" if lag is None else lag
        if isinstance(lag, str):
            r = self.acf_of(max_nlags)
            if lag == "ami":
                at = c.local_minima(self.ami(self.detrended, max_nlags or max(0, min(64, self.n // 2))))
                first = float(at[0] + 1) if len(at) else NAN
            elif lag in ("acf", "acf-nonsig"):
                first = c.first_where(r <= 0 if lag == "acf" else np.abs(r) <= 1.96 / np.sqrt(self.n))
            else:
                raise ValueError(f"no such lag: {lag}")
            lag = 1 if np.isnan(first) else int(first)
        if lag <= 0:
            raise ValueError("a lag is positive")
        out.__dict__["lag"] = int(lag)
        return out

    @cached_property
    def lag(self) -> int:
        """Embedding lag: the first insignificant autocorrelation of the detrended series, else 1."""
        return self.with_lag().lag

    def walk(self, step_size: float = 0.1, start_point: float | None = None) -> np.ndarray:
        """Path of a walker that makes up a share of its distance from the series at each step."""
        z, w = self.z, np.empty(self.n)
        w[0] = 0.0 if start_point is None else start_point
        for i in range(1, self.n):
            w[i] = w[i - 1] + step_size * (z[i - 1] - w[i - 1])
        return w

    def neighbours(self, least: float):
        """For dimensions 1 to 16, of each delay vector that has one more coordinate: the distance to the nearest one above ``least`` (infinite if there is none) and how far apart the newest coordinates are; nothing where fewer than two fit."""
        apart = np.abs(self.z[:, None] - self.z[None])
        d = apart
        for dim in range(1, 17):
            m, first = self.n - dim * self.lag, dim * self.lag
            if m < 2 or (dim + 1) * self.lag > self.n:
                yield None
                continue
            before = first - self.lag  # as far back as the oldest coordinate so far
            d = np.maximum(d[:m, :m], apart[before : before + m, before : before + m])
            near = np.where(d <= least, np.inf, d)
            at = near.argmin(1)
            yield near[np.arange(m), at], np.abs(self.z[first : first + m] - self.z[first + at])

    @cached_property
    def cao(self) -> tuple[np.ndarray, np.ndarray]:
        """E1 and E2 of Cao's method for dimensions 1 to 15."""
        e, star = [], []
        for found in self.neighbours(np.nextafter(1e-8, 0)):
            if found is None:
                e.append(np.nan)
                star.append(np.nan)
                continue
            dist, step = found
            ok = np.isfinite(dist)
            e.append(float((np.maximum(dist, step)[ok] / dist[ok]).mean()) if ok.any() else np.nan)
            star.append(float(step[ok].mean()) if ok.any() else np.nan)
        e, star = np.array(e), np.array(star)
        with np.errstate(all="ignore"):
            return e[1:] / e[:-1], star[1:] / star[:-1]

    @cached_property
    def emb_dim(self) -> int:
        e1, e2 = self.cao
        if np.all(np.abs(e2[~np.isnan(e2)] - 1) < 0.05):
            return 1
        at = np.flatnonzero(np.abs(np.diff(e1)) <= 0.05)
        return int(at[0]) + 1 if len(at) else 1

    @cached_property
    def ioe(self) -> tuple[float, list[np.ndarray]]:
        """Step and indices that stay at each threshold on absolute values. Thresholds lie one step (5 % of the deviation) apart, the first a step above
        the least value, and reach as many steps as the greatest value has; from where less than 2 % of the points or two stay, none do."""
        a = np.abs(self.z)
        step, out = 0.05 * a.std(), []
        if not step > 0:
            return NAN, out
        at, on = a.min(), True
        for _ in range(min(1024, math.ceil(a.max() / step))):
            at += step
            idx = np.flatnonzero(a >= at)
            on = on and len(idx) >= max(2, 0.02 * self.n)
            out.append(idx if on else idx[:0])
        return float(step), out

    @cached_property
    def ioe_line(self) -> tuple[float, float]:
        """Slope and adjusted R squared of the standard error of the places that stay on the threshold in deviations; 0 where none stay."""
        y = np.array([i.std(ddof=1) / np.sqrt(len(i)) if len(i) else 0.0 for i in self.ioe[1]])
        if len(y) < 3:
            return NAN, NAN
        x = np.arange(len(y)) * 0.05
        slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
        rest = y - y.mean() - slope * (x - x.mean())
        total = ((y - y.mean()) ** 2).sum()
        r2 = 1 - (rest @ rest) / total if total > 0 else NAN
        return float(slope), float(1 - (1 - r2) * (len(y) - 1) / (len(y) - 2))

    @cached_property
    def gaussian(self) -> np.ndarray:
        """Residuals of a Gaussian process with a squared exponential kernel of unit length on [0, 1]."""
        x = np.linspace(0, 1, self.n)
        k = np.exp(-0.5 * (x[:, None] - x[None]) ** 2)
        a = np.linalg.solve(k + 1e-10 * np.eye(self.n), self.z)
        return self.z - k @ a

    @cached_property
    def spectrum(self) -> tuple[np.ndarray, np.ndarray]:
        return periodogram(self.resid, np.hamming)

    def ami(self, x: np.ndarray, lags, bins: int = 64, dist: bool = False) -> np.ndarray:
        """Mutual information (or its distance) of the series and itself at lags 1 to ``lags``, or at each of several."""
        return np.array([mutual_information(x[:-k], x[k:], bins, dist) for k in (range(1, lags + 1) if np.ndim(lags) == 0 else lags)])

    @cached_property
    def ami_lags(self) -> int:
        first = c.first_where(self.acf_detrended <= 0)
        return max(1, int(first) if not np.isnan(first) else self.n // 2)


def periodogram(x: np.ndarray, window) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided power ('spectrum' scaling, no detrending, periodic window)."""
    n = len(x)
    w = window(n + 1)[:-1]
    p = np.abs(np.fft.rfft(x * w)) ** 2 / w.sum() ** 2
    if n % 2:
        p[1:] *= 2
    else:
        p[1:-1] *= 2
    return np.fft.rfftfreq(n), p


def mutual_information(x: np.ndarray, y: np.ndarray, bins: int = 64, dist: bool = False) -> float:
    """In bits; as a distance, 1 less its share of the joint entropy."""
    if len(x) < 1:
        return np.nan
    a, b = c.bins_equal_width(x, bins), c.bins_equal_width(y, bins)
    joint = c.entropy(np.unique(a * bins + b, return_counts=True)[1].astype(float), 2)
    ami = c.entropy(np.bincount(a).astype(float), 2) + c.entropy(np.bincount(b).astype(float), 2) - joint
    return 1 - ami / joint if dist else ami
