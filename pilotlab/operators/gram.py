"""Linear models from mergeable sums of products.

One scan adds up the products of all terms per group of rows. Terms are raw: present values (less a
pivot) with nulls as zero, marks of nulls, and one indicator per category. Imputing and scaling are linear
in them, so the sums of any prepared design, of unions of groups, and the errors of any model on any
group follow from the sums, without the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import FeatureColumns
from ..sources.bindings import MISSING_CATEGORY

# Up to so many features the normal equations are solved directly, beyond by conjugate gradients.
DIRECT_FEATURES = 2048
ONE = "1"


@dataclass(frozen=True)
class Terms:
    """Dense terms in order, and the categorical columns."""

    columns: FeatureColumns
    outcomes: tuple[str, ...]
    pivots: dict[str, float]

    @property
    def values(self) -> list[str]:
        return [*self.columns.numeric, *self.columns.boolean]

    @property
    def dense(self) -> list[tuple[str, str]]:
        """``1``, then a value and a mark of nulls for each column, then the outcomes."""
        marked = [(kind, c) for c in self.values for kind in ("value", "null")]
        return [(ONE, ""), *marked, *[("outcome", y) for y in self.outcomes]]

    def place(self, kind: str, column: str) -> int:
        return self.dense.index((kind, column))


@dataclass
class Sums:
    """Sums of products over some rows; ``+`` joins those of other rows.

    ``dense`` holds the dense terms with each other, ``levels`` each category with the dense terms, ``pairs``
    the rows that two categories of different columns share.
    """

    dense: np.ndarray
    levels: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    pairs: dict[tuple[tuple[str, str], tuple[str, str]], float] = field(default_factory=dict)

    def __add__(self, other: Sums) -> Sums:
        zero = np.zeros(len(self.dense))
        return Sums(
            self.dense + other.dense,
            {k: self.levels.get(k, zero) + other.levels.get(k, zero) for k in self.levels.keys() | other.levels.keys()},
            {k: self.pairs.get(k, 0.0) + other.pairs.get(k, 0.0) for k in self.pairs.keys() | other.pairs.keys()},
        )


def _number(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def pivots(df: DataFrame, columns: FeatureColumns, outcomes: list[str]) -> dict[str, float]:
    """Means over all rows, which keep the sums of squares small; any other values give equal models."""
    names = [*columns.numeric, *outcomes]
    row = df.agg(*[F.avg(F.when(F.abs(_number(c)) < np.inf, _number(c))).alias(f"m{i}") for i, c in enumerate(names)]).first()
    return {c: row[f"m{i}"] or 0.0 for i, c in enumerate(names)}


def sums_by_group(df: DataFrame, group: Column, terms: Terms) -> dict[int, Sums]:
    """The sums of the rows of each value of ``group`` (an integer), from one scan.

    Rows with a null group or outcome take no part. A task passes on one row for each product that
    occurs in it, which are added up before and after the shuffle, so neither many categories nor a
    hot group make a large row or task. The driver receives each sum once.
    """
    size, dense, categorical = len(terms.dense), terms.dense, terms.columns.categorical
    shifted = [F.lit(1.0)]
    for kind, c in dense[1:]:
        if kind == "null":
            shifted.append(_number(c).isNull().cast("double"))
        else:
            value = _number(c) - F.lit(terms.pivots.get(c, 0.0))
            shifted.append(value if kind == "outcome" else F.coalesce(value, F.lit(0.0)))
    rows = df.where(group.isNotNull()).select(
        group.cast("int").alias("g"), *[x.alias(f"d{i}") for i, x in enumerate(shifted)],
        *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CATEGORY)).alias(f"c{i}") for i, c in enumerate(categorical)],
    ).dropna(subset=[f"d{terms.place('outcome', y)}" for y in terms.outcomes])

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        strips: dict[tuple[int, int, str], np.ndarray] = {}
        shared: dict[tuple[int, int, str, int, str], float] = {}
        for batch in batches:
            groups = batch.column(0).to_numpy()
            design = np.stack([batch.column(1 + i).to_numpy() for i in range(size)], axis=1)
            coded = [batch.column(1 + size + i).dictionary_encode() for i in range(len(categorical))]
            names = [c.dictionary.to_pylist() for c in coded]
            codes = [c.indices.to_numpy().astype(np.int64) for c in coded]
            for g in np.unique(groups).tolist():
                at = np.flatnonzero(groups == g)
                own = design[at]
                total[g] = total.get(g, 0.0) + own.T @ own
                for i in range(len(categorical)):
                    code = codes[i][at]
                    strip = np.stack([np.bincount(code, own[:, t], len(names[i])) for t in range(size)], axis=1)
                    for k in np.unique(code).tolist():
                        key = (g, i, names[i][k])
                        strips[key] = strips.get(key, 0.0) + strip[k]
                    for j in range(i):
                        both, n = np.unique(codes[j][at] * len(names[i]) + code, return_counts=True)
                        for b, count in zip(both.tolist(), n.tolist()):
                            key = (g, j, names[j][b // len(names[i])], i, names[i][b % len(names[i])])
                            shared[key] = shared.get(key, 0.0) + count
        out = [(g, -1, None, r, None, float(x)) for g, m in total.items() for r, x in enumerate(m.ravel()) if x]
        out += [(g, i, level, t, None, float(x)) for (g, i, level), row in strips.items() for t, x in enumerate(row) if x]
        out += [(g, j, one, -1 - i, other, x) for (g, j, one, i, other), x in shared.items()]
        for first in range(0, len(out), 10_000):
            columns = list(zip(*out[first : first + 10_000]))
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["g", "a", "a_level", "b", "b_level", "x"])

    parts = rows.mapInArrow(add_up, "g int, a int, a_level string, b int, b_level string, x double")
    found: dict[int, Sums] = {}
    for r in parts.groupBy("g", "a", "a_level", "b", "b_level").agg(F.sum("x").alias("x")).collect():
        sums = found.setdefault(r["g"], Sums(np.zeros((size, size))))
        if r["a"] < 0:
            sums.dense.ravel()[r["b"]] = r["x"]
        elif r["b"] >= 0:
            sums.levels.setdefault((categorical[r["a"]], r["a_level"]), np.zeros(size))[r["b"]] = r["x"]
        else:
            sums.pairs[(categorical[r["a"]], r["a_level"]), (categorical[-1 - r["b"]], r["b_level"])] = r["x"]
    return found


@dataclass(frozen=True)
class Preparation:
    """What fills and scales each column, and the categories that have a feature of their own.

    Deviations are population deviations after filling; a constant column keeps its scale. The first
    category in sort order and unknown ones have no feature.
    """

    terms: Terms
    fills: dict[str, float]
    means: dict[str, float]
    deviations: dict[str, float]
    levels: tuple[tuple[str, str], ...]

    @property
    def dense_features(self) -> np.ndarray:
        """How the dense terms make the features of numbers and booleans: (terms, features)."""
        out = np.zeros((len(self.terms.dense), len(self.terms.values)))
        for k, c in enumerate(self.terms.values):
            pivot, deviation = self.terms.pivots.get(c, 0.0), self.deviations.get(c, 1.0)
            out[self.terms.place("value", c), k] = 1 / deviation
            out[self.terms.place("null", c), k] = (self.fills[c] - pivot) / deviation
            out[0, k] = -(self.means[c] - pivot) / deviation if c in self.means else 0.0
        return out


def prepare(sums: Sums, terms: Terms, medians: dict[str, float | None]) -> Preparation:
    """Preparation of the rows that ``sums`` were taken of. A column without numbers is all zeros; a
    boolean is filled with its most frequent value, false on ties."""
    dense, n = sums.dense, sums.dense[0, 0]
    fills, means, deviations = {}, {}, {}
    for c in terms.columns.numeric:
        value, null, pivot = terms.place("value", c), terms.place("null", c), terms.pivots.get(c, 0.0)
        fills[c] = medians[c] if medians[c] is not None else 0.0
        shift = fills[c] - pivot
        mean = (dense[0, value] + shift * dense[0, null]) / n
        variance = max(0.0, (dense[value, value] + shift**2 * dense[0, null]) / n - mean**2)
        means[c] = mean + pivot
        constant = variance**0.5 <= 1e-12 * max(1.0, abs(means[c]))
        deviations[c] = 1.0 if constant else variance**0.5
    for c in terms.columns.boolean:
        present = n - dense[0, terms.place("null", c)]
        fills[c] = float(dense[0, terms.place("value", c)] > present / 2)
    levels = []
    for c in terms.columns.categorical:
        levels += sorted(k for k in sums.levels if k[0] == c)[1:]
    return Preparation(terms, fills, means, deviations, tuple(levels))


class Products:
    """Sums of products of prepared features with each other, with one and with the outcomes."""

    def __init__(self, sums: Sums, prepared: Preparation) -> None:
        make = prepared.dense_features
        strip = np.array([sums.levels.get(k, np.zeros(len(make))) for k in prepared.levels]).reshape(-1, len(make))
        outcomes = [prepared.terms.place("outcome", y) for y in prepared.terms.outcomes]
        self.n = sums.dense[0, 0]
        self.dense, self.strip = make.T @ sums.dense @ make, strip @ make
        self.totals = np.concatenate([make.T @ sums.dense[:, 0], strip[:, 0]])
        self.with_outcomes = np.concatenate([make.T @ sums.dense[:, outcomes], strip[:, outcomes]])
        self.outcomes, self.squares = sums.dense[0, outcomes], sums.dense[outcomes, outcomes]
        place = {k: i for i, k in enumerate(prepared.levels)}
        pairs = [(place[a], place[b], x) for (a, b), x in sums.pairs.items() if a in place and b in place]
        self.left, self.right = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
        self.shared = np.array([p[2] for p in pairs], float)

    def times(self, u: np.ndarray) -> np.ndarray:
        """The products of the features with each other times ``u``, without the whole matrix."""
        d, counts = len(self.dense), self.totals[len(self.dense) :]
        top, low = u[:d], u[d:]
        out = np.concatenate([self.dense @ top + self.strip.T @ low, self.strip @ top + counts * low])
        size = len(low)
        out[d:] += np.bincount(self.left, self.shared * low[self.right], size) + np.bincount(self.right, self.shared * low[self.left], size)
        return out

    def matrix(self) -> np.ndarray:
        d, size = len(self.dense), len(self.totals)
        out = np.zeros((size, size))
        out[:d, :d], out[d:, :d], out[:d, d:] = self.dense, self.strip, self.strip.T
        out[np.arange(d, size), np.arange(d, size)] = self.totals[d:]
        out[d + self.left, d + self.right] = out[d + self.right, d + self.left] = self.shared
        return out

    def ridge(self, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients (features, outcomes) and intercepts of the least squared errors plus ``alpha`` times the
        squared coefficients; intercepts are free and belong to outcomes less their pivots."""
        mean, level = self.totals / self.n, self.outcomes / self.n
        right = self.with_outcomes - np.outer(mean, self.outcomes)
        if len(mean) <= DIRECT_FEATURES:
            left = self.matrix() - self.n * np.outer(mean, mean)
            left[np.diag_indices(len(mean))] += alpha
            w = np.linalg.solve(left, right) if alpha > 0 else np.linalg.lstsq(left, right, rcond=None)[0]
        else:
            w = np.stack([self._descend(column, mean, alpha) for column in right.T], axis=1)
        return w, level - mean @ w

    def _descend(self, right: np.ndarray, mean: np.ndarray, alpha: float) -> np.ndarray:
        """Conjugate gradients, each feature scaled by its own square."""
        own = np.concatenate([np.diag(self.dense), self.totals[len(self.dense) :]]) - self.n * mean**2 + alpha
        own = np.where(own > 0, own, 1.0)
        w, r = np.zeros(len(right)), right.copy()
        z = r / own
        step, rz = z.copy(), r @ z
        for _ in range(20 * len(right)):
            if np.linalg.norm(r) <= 1e-13 * np.linalg.norm(right):
                break
            moved = self.times(step) - self.n * mean * (mean @ step) + alpha * step
            length = rz / (step @ moved)
            w, r = w + length * step, r - length * moved
            z = r / own
            rz, before = r @ z, rz
            step = z + rz / before * step
        return w

    def r2(self, w: np.ndarray, intercepts: np.ndarray) -> list[float | None]:
        """Share of the outcomes' variation on these rows that a model explains; none without variation."""
        out = []
        for k, (b, y, yy) in enumerate(zip(intercepts, self.outcomes, self.squares)):
            c = w[:, k]
            error = yy - 2 * b * y - 2 * c @ self.with_outcomes[:, k] + 2 * b * (c @ self.totals) + c @ self.times(c) + self.n * b * b
            spread = yy - y * y / self.n if self.n else 0.0
            out.append(float(1 - error / spread) if spread > 1e-12 * yy else None)
        return out

    def residuals(self, w: np.ndarray, intercepts: np.ndarray, alpha: float) -> np.ndarray:
        """Left minus right sides of the normal equations (features and intercept, outcomes); zero at the minimum."""
        slopes = np.stack([self.times(c) for c in w.T], axis=1) + np.outer(self.totals, intercepts) - self.with_outcomes + alpha * w
        return np.vstack([slopes, self.totals @ w + self.n * intercepts - self.outcomes])


@dataclass(frozen=True)
class LinearModel:
    """Prepared features, coefficients by feature and intercept of one outcome."""

    prepared: Preparation
    coefficients: np.ndarray
    intercept: float

    def expression(self) -> Column:
        """The prediction as one native expression over the raw columns."""
        terms, out = self.prepared.terms, F.lit(float(self.intercept))
        for c, w in zip(terms.values, self.coefficients):
            value = F.coalesce(_number(c), F.lit(self.prepared.fills[c]))
            if c in self.prepared.means:
                value = (value - F.lit(self.prepared.means[c])) / F.lit(self.prepared.deviations[c])
            out = out + value * F.lit(float(w))
        effects: dict[str, list[Column]] = {}
        for (c, level), w in zip(self.prepared.levels, self.coefficients[len(terms.values) :]):
            effects.setdefault(c, []).extend([F.lit(level), F.lit(float(w))])
        for c, pairs in effects.items():
            level = F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CATEGORY))
            out = out + F.coalesce(F.try_element_at(F.create_map(*pairs), level), F.lit(0.0))
        return out


def fit(sums: Sums, terms: Terms, medians: dict[str, float | None], alpha: float) -> tuple[Preparation, np.ndarray, np.ndarray]:
    prepared = prepare(sums, terms, medians)
    return prepared, *Products(sums, prepared).ridge(alpha)
