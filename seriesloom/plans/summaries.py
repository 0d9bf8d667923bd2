"""Summaries of arrays, of many at once. Sums run in the order of the values, variances by Welford's update, so that results don't depend on what goes along."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

import numpy as np

from ..functions.models import columns, going
from ..operators import relational


class Arrays:
    """What the summaries of some arrays of numbers share; arrays are columns, the longest first."""

    def __init__(self, many: list[np.ndarray]):
        self.many = many
        self.x, self.n = columns(many)
        self.there = np.arange(len(self.x))[:, None] < self.n
        self.size = np.where(self.n > 0, self.n, np.nan)

    def sum(self, x: np.ndarray) -> np.ndarray:
        """Of each column, up to its end; NaN of none."""
        x = np.where(self.there, x, 0.0)
        return np.where(self.n > 0, np.cumsum(x, axis=0)[-1] if len(x) else 0.0, np.nan)

    @cached_property
    def mean(self) -> np.ndarray:
        return self.sum(self.x) / self.size

    def most(self, x: np.ndarray) -> np.ndarray:
        return np.where(self.n > 0, np.where(self.there, x, -np.inf).max(0, initial=-np.inf), np.nan)

    @cached_property
    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        return -self.most(-self.x), self.most(self.x)

    @cached_property
    def squares(self) -> np.ndarray:
        """Sum of squared differences from the mean."""
        mean, out = np.zeros(len(self.n)), np.zeros(len(self.n))
        for t, m in enumerate(going(self.n)):
            off = self.x[t, :m] - mean[:m]
            mean[:m] += off / (t + 1)
            out[:m] += (self.x[t, :m] - mean[:m]) * off
        return out

    def centred(self, power: int) -> np.ndarray:
        return self.sum((self.x - self.mean) ** power) / self.size

    @cached_property
    def sorted(self) -> np.ndarray:
        return np.sort(np.where(self.there, self.x, np.inf), axis=0)

    def quantile(self, p: float) -> np.ndarray:
        at = np.maximum(self.n - 1, 0) * float(p)
        low, every = np.floor(at).astype(int), np.arange(len(self.n))
        if not len(self.x):
            return np.full(len(self.n), np.nan)
        a, b = self.sorted[low, every], self.sorted[np.ceil(at).astype(int), every]
        between = (a.astype(np.longdouble) * (1 - (at - low)) + b * (at - low)).astype(float)  # rounded as by a fused sum, as the SQL's engine does
        return np.where(self.n > 0, np.where(at == low, a, between), np.nan)

    def moment(self, power: int, method: int) -> np.ndarray:
        """Skewness (3) or excess kurtosis (4) by method 1 (population moments), 2 (unbiased under normality) or 3 (moments with the sample deviation)."""
        s2, n = self.centred(2), self.size
        g = self.centred(power) / np.where(s2 > 0, s2, np.nan) ** (power / 2)
        if method == 3:
            return g * (1 - 1 / n) ** (power / 2) - (3 if power == 4 else 0)
        if power == 3:
            return g if method == 1 else np.where(n > 2, np.sqrt(n * (n - 1)) / (n - 2) * g, np.nan)
        return g - 3 if method == 1 else np.where(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (g - 3) + 6), np.nan)

    def norm(self, p: float) -> np.ndarray:
        """Vector norm; of order 0 the number of values that are not zero, of infinity the greatest absolute value, undefined below 0."""
        if p < 0:
            return np.full(len(self.n), np.nan)
        if p == 0:
            return self.sum(self.x != 0)
        return self.most(np.abs(self.x)) if p == float("inf") else self.sum(np.abs(self.x) ** p) ** (1 / p)

    def histogram(self, num: int, normalize: bool) -> list[np.ndarray]:
        lo, hi = self.ends
        at = np.where(hi > lo, np.minimum(np.floor((self.x - lo) / (hi - lo) * num), num - 1), num // 2)
        return [self.sum(at == k) / (self.size if normalize else 1) for k in range(num)]

    def of(self, plain: str, o: dict) -> list[tuple[str, np.ndarray]]:
        """(suffix, values) of one summary."""
        if plain in ("sd", "var"):
            ddof = o.get("ddof", 1)
            v = self.squares / np.where(self.n > ddof, self.n - ddof, np.nan)
            return [("", np.sqrt(v) if plain == "sd" else v)]
        if plain in ("powersum", "pnorm"):
            p = o.get("p", 2)
            one = (lambda q: self.sum(self.x**q)) if plain == "powersum" else self.norm
            return [(f".{i}", one(q)) for i, q in enumerate(p)] if isinstance(p, (list, tuple)) else [("", one(p))]
        if plain in ("skewness", "kurtosis"):
            return [("", self.moment(3 if plain == "skewness" else 4, o.get("method", 3)))]
        if plain == "histogram":
            return [(f".{k}", v) for k, v in enumerate(self.histogram(o.get("num_bins", 10), o.get("normalize", True)))]
        if plain == "quantiles":
            return [(f".{k}", self.quantile(p)) for k, p in enumerate(o.get("p", (0.0, 0.25, 0.5, 0.75, 1.0)))]
        if plain in ("max", "min", "range"):
            lo, hi = self.ends
            return [("", {"max": hi, "min": lo}[plain] if plain != "range" else hi - lo)]
        if plain == "iq_range":
            return [("", self.quantile(0.75) - self.quantile(0.25))]
        return [("", self.mean if plain == "mean" else self.sum(self.x) if plain == "sum" else self.quantile(0.5))]


def checked_summaries(names: Iterable[str]) -> list[str]:
    names = list(names)
    for name in names:
        if name not in relational.SUMMARIES and name not in relational.VECTOR_SUMMARIES:
            raise ValueError(f"no such summary: {name}")
    return names


def summaries(many: list[np.ndarray], names: Iterable[str], args: dict[str, dict] | None = None) -> list[tuple[str, np.ndarray]]:
    """(name and suffix, a value of each array) of each summary with its ``args``. NaN spoils a plain summary and is passed over by its nan form. Empty arrays have NaN, and counts of 0."""
    good = [x[~np.isnan(x)] for x in many]
    by = np.array(sorted(range(len(many)), key=lambda i: -len(good[i])), np.int64)
    a = Arrays([good[i] for i in by])
    sizes = np.array([len(x) for x in many])
    spoilt, out = sizes[by] > a.n, []
    with np.errstate(all="ignore"):
        for name in names:
            plain = name.removeprefix("nan")
            found = [("", (a.n if plain != name else sizes[by]).astype(float))] if plain == "count" else a.of(plain, (args or {}).get(name, {}))
            for suffix, v in found:
                value = np.empty(len(many))
                value[by] = np.where(spoilt, np.nan, v) if plain == name and plain != "count" else v
                out.append((name + suffix, value))
    return out
