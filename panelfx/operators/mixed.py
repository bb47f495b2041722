"""Linear models with a normal intercept per cluster and, where given, a known error variance of every row.

An outcome is x'b + u + e with u of standard deviation tau, shared by the rows of a cluster, and e of variance
sigma^2 + v, where v is known (zero unless a column names it). The rows reach the likelihood only through cross products by
(cluster, v), which are made once. For any pair (sigma, tau) a cluster adds to a matrix and a log-determinant of the size of
the model, so a whole grid of pairs is one pass over the cluster table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import stage
from .design import Design
from .gram import gram, independent, product_sums, sum_partials
from .regress import INTERCEPT

SCHEMA = "term string, estimate double, std_error double, q_low double, median double, q_high double"


@dataclass
class Reduced:
    """One row per cluster: error variances and upper triangles of the cross products of (1, regressors, outcome)."""

    table: DataFrame
    names: list[str]
    n: float
    known: bool

    @property
    def width(self) -> int:
        return len(self.names) + 2

    def at(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every (sigma, tau): the matrix of (regressors, outcome) weighted with the inverse covariance, and log|V|."""
        nodes = np.atleast_2d(np.asarray(nodes, float))
        if self.known:
            return self._pass(nodes)
        # without known errors the data depend on tau / sigma only
        ratio, place = np.unique(np.round(nodes[:, 1] / nodes[:, 0], 15), return_inverse=True)
        m, logdet = self._pass(np.column_stack([np.ones(len(ratio)), ratio]))
        scale = nodes[:, 0] ** 2
        return m[place] / scale[:, None, None], logdet[place] + self.n * np.log(scale)

    def _pass(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.width
        rows, cols = np.triu_indices(w)

        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            out = None
            for b in batches:
                size = b.column("v").value_lengths().to_numpy()
                v = b.column("v").flatten().to_numpy()
                flat = b.column("g").flatten().flatten().to_numpy().reshape(len(v), -1)
                g = np.empty((len(v), w, w))
                g[:, rows, cols] = flat
                g[:, cols, rows] = flat
                first = np.cumsum(size) - size
                if out is None:
                    out = np.zeros((len(nodes), (w - 1) ** 2 + 1))
                for i, (sigma, tau) in enumerate(nodes):
                    var = sigma * sigma + v
                    c = np.add.reduceat(g / var[:, None, None], first, axis=0)
                    s, a = c[:, 0, 0], c[:, 0, 1:]
                    shrink = tau * tau / (1.0 + tau * tau * s)
                    out[i, :-1] += (c[:, 1:, 1:].sum(0) - np.einsum("c,ci,cj->ij", shrink, a, a)).ravel()
                    out[i, -1] += (g[:, 0, 0] * np.log(var)).sum() + np.log1p(tau * tau * s).sum()
            return None if out is None else out.ravel()

        got = sum_partials(self.table.select("v", "g"), run).reshape(len(nodes), -1)
        return got[:, :-1].reshape(len(nodes), w - 1, w - 1), got[:, -1]


def reduce_rows(cells: DataFrame, cluster: str, design: Design, intercept: bool = True, error: str | None = None) -> Reduced:
    """Cross products of cells (columns n, y_sum, y_sumsq) by cluster and known error variance, written once.

    ``error`` names a column that is constant in a cell. Cells without rows, without an error variance or with a NULL
    regressor are left out; collinear terms are dropped.
    """
    terms = ([(INTERCEPT, F.lit(1.0))] if intercept else []) + design.terms
    full = Design(list(terms), set(design.nullable))
    usable = (F.col("n") > 0) & F.col("y_sum").isNotNull() & full.complete()
    if error:
        usable = usable & (F.col(error) >= 0)
    keep = [F.col(cluster).alias("_cl"), (F.col(error).cast("double") if error else F.lit(0.0)).alias("_v"),
            (F.col("y_sum") / F.col("n")).alias("_y"), F.col("n").cast("double").alias("_w"), F.lit(1.0).alias("_one"),
            F.greatest(F.col("y_sumsq") - F.col("y_sum") * F.col("y_sum") / F.col("n"), F.lit(0.0)).alias("_ss")]
    base, xs = full.attach(cells.filter(usable), keep)
    base = stage(base, "mixed")
    kept = independent(gram(base, xs, "_w"))
    columns = ["_one", *[xs[i] for i in kept], "_y"]
    sums = product_sums(columns, "_w")
    # the outcome's square is the last one; what the means of the cells do not show is added
    sums[-1] = sums[-1] + F.sum("_ss")
    by_error = base.groupBy("_cl", "_v").agg(F.array(*sums).alias("g"))
    # as many rows to a cluster as it has error variances, one to a period
    table = by_error.groupBy("_cl").agg(F.array_sort(F.collect_list(F.struct("_v", "g"))).alias("l")).select(
        "_cl", F.col("l._v").alias("v"), F.col("l.g").alias("g"))
    n = base.agg(F.sum("_w")).first()[0]
    return Reduced(stage(table, "clusters"), [full.names[i] for i in kept], float(n), error is not None)


# --------------------------------------------------------------------------- likelihood and priors


@dataclass(frozen=True)
class Priors:
    """Normal coefficients around zero, an exponential tau, a half-Student sigma. ``sd`` None: flat coefficients."""

    sd: float | None = 5.0
    intercept_sd: float | None = 10.0
    tau_rate: float = 1.0
    sigma_df: float = 3.0
    sigma_scale: float = 2.5

    def precision(self, names: Sequence[str]) -> np.ndarray:
        if self.sd is None:
            return np.zeros(len(names))
        own = self.intercept_sd or self.sd
        return np.array([1.0 / (own if n == INTERCEPT else self.sd) ** 2 for n in names])

    def log_density(self, nodes: np.ndarray) -> np.ndarray:
        """Of (sigma, tau), up to a constant."""
        sigma, tau = nodes[:, 0], nodes[:, 1]
        return (-self.tau_rate * tau
                - 0.5 * (self.sigma_df + 1) * np.log1p((sigma / self.sigma_scale) ** 2 / self.sigma_df))


def conditional(r: Reduced, nodes: np.ndarray, precision: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every node: log-likelihood with the coefficients integrated out (restricted, where their prior is flat), up to
    a constant, and the coefficients' conditional means and covariances."""
    m, logdet = r.at(nodes)
    k = len(r.names)
    a, b, c = m[:, :k, :k] + np.diag(precision), m[:, :k, k], m[:, k, k]
    cov = np.linalg.inv(a)
    mean = np.einsum("nij,nj->ni", cov, b)
    log = -0.5 * (logdet + np.linalg.slogdet(a)[1] + c - np.einsum("ni,ni->n", b, mean))
    return log, mean, cov


def _box(r: Reduced, value, start: float, size: int = 13, drop: float = 20.0, rounds: int = 40) -> np.ndarray:
    """Ranges of log sigma and of tau / sigma outside which ``value`` lies ``drop`` below its maximum.

    Each round looks at a grid: the box goes on where the grid's maximum, or a value within ``drop`` of it, lies on its
    edge, and closes in on the nodes within ``drop`` otherwise.
    """
    box = np.array([[start - 2.0, start + 2.0], [0.0, 2.0]])
    for _ in range(rounds):
        axes = [np.linspace(*side, size) for side in box]
        nodes = np.array([(np.exp(x), np.exp(x) * t) for x in axes[0] for t in axes[1]])
        f = value(nodes).reshape(size, size)
        high = f >= f.max() - drop
        new = box.copy()
        for d in range(2):
            on = np.flatnonzero(high.any(1 - d))
            step = axes[d][1] - axes[d][0]
            span = box[d, 1] - box[d, 0]
            new[d] = axes[d][on[0]] - step, axes[d][on[-1]] + step
            if on[0] == 0 and (d == 0 or box[1, 0] > 0):
                new[d, 0] = box[d, 0] - span
            if on[-1] == size - 1:
                new[d, 1] = box[d, 1] + span
        new[1, 0] = max(new[1, 0], 0.0)
        if ((new[:, 1] - new[:, 0]) > 0.75 * (box[:, 1] - box[:, 0])).all() and (new >= box - 1e-12)[:, 0].all() and (new <= box + 1e-12)[:, 1].all():
            return box
        box = new
    raise RuntimeError(f"no bounded range of the two deviations after {rounds} rounds")


# --------------------------------------------------------------------------- estimates


def fit_restricted(r: Reduced, tol: float = 1e-7, size: int = 13, rounds: int = 60) -> tuple[float, float, np.ndarray, np.ndarray]:
    """sigma, tau, coefficients and their covariance at the maximum of the restricted likelihood.

    A grid closes in on the best node until its neighbours differ by ``tol`` of it.
    """
    flat = np.zeros(len(r.names))

    def value(nodes):
        return conditional(r, nodes, flat)[0]

    box = _box(r, value, _start(r), drop=8.0)
    for _ in range(rounds):
        axes = [np.linspace(*side, size) for side in box]
        nodes = np.array([(np.exp(x), np.exp(x) * t) for x in axes[0] for t in axes[1]])
        i, j = np.unravel_index(int(np.argmax(value(nodes))), (size, size))
        steps = [a[1] - a[0] for a in axes]
        if steps[0] <= tol and steps[1] <= tol * max(1.0, axes[1][j]):
            break
        # two steps to each side: the ridge of the likelihood need not follow the axes
        box = np.array([[axes[0][i] - 2 * steps[0], axes[0][i] + 2 * steps[0]], [max(axes[1][j] - 2 * steps[1], 0.0), axes[1][j] + 2 * steps[1]]])
    sigma, tau = np.exp(axes[0][i]), np.exp(axes[0][i]) * axes[1][j]
    _, mean, cov = conditional(r, [(sigma, tau)], flat)
    return float(sigma), float(tau), mean[0], cov[0]


def restricted_on_grid(r: Reduced, sigmas: Sequence[float], taus: Sequence[float]) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The same with the maximum among the given deviations; of equal ones the first, in the order of sigma and tau."""
    nodes = np.array([(s, t) for s in sorted(sigmas) for t in sorted(taus)])
    log, mean, cov = conditional(r, nodes, np.zeros(len(r.names)))
    i = int(np.argmax(log))
    return float(nodes[i, 0]), float(nodes[i, 1]), mean[i], cov[i]


def _start(r: Reduced) -> float:
    """Logarithm of the pooled residual deviation."""
    m, _ = r.at(np.array([[1.0, 0.0]]))
    k = len(r.names)
    rest = m[0, k, k] - m[0, :k, k] @ np.linalg.solve(m[0, :k, :k], m[0, :k, k])
    weight = max(r.n - k, 1.0)
    return 0.5 * float(np.log(max(rest / weight, 1e-12)))


def restricted_table(spark, r: Reduced, at: tuple[float, float, np.ndarray, np.ndarray]) -> DataFrame:
    """term, estimate, std_error of the coefficients, then the two deviations (no error)."""
    sigma, tau, mean, cov = at
    rows = [(t, float(b), float(np.sqrt(v))) for t, b, v in zip(r.names, mean, np.diag(cov))]
    return spark.createDataFrame([*rows, ("sd_cluster", tau, None), ("sigma", sigma, None)], "term string, estimate double, std_error double")


# --------------------------------------------------------------------------- posterior


@dataclass
class Posterior:
    """Nodes (sigma, tau), their share of the posterior mass, and the coefficients' laws at them."""

    names: list[str]
    nodes: np.ndarray
    log: np.ndarray
    mass: np.ndarray
    mean: np.ndarray
    cov: np.ndarray

    def table(self, spark, level: float = 0.95) -> DataFrame:
        """Posterior mean, standard deviation, central interval and median of every coefficient and of both deviations."""
        tails = (0.5 - level / 2, 0.5, 0.5 + level / 2)
        rows = []
        for i, name in enumerate(self.names):
            mu, var = self.mean[:, i], self.cov[:, i, i]
            center = float(self.mass @ mu)
            sd = float(np.sqrt(self.mass @ (var + mu ** 2) - center ** 2))
            rows.append((name, center, sd, *(_mixture_quantile(self.mass, mu, np.sqrt(var), p) for p in tails)))
        for name, x in (("sd_cluster", self.nodes[:, 1]), ("sigma", self.nodes[:, 0])):
            center = float(self.mass @ x)
            sd = float(np.sqrt(max(self.mass @ x ** 2 - center ** 2, 0.0)))
            rows.append((name, center, sd, *(_grid_quantile(self.mass, x, p) for p in tails)))
        return spark.createDataFrame(rows, SCHEMA)


def _mixture_quantile(mass: np.ndarray, mu: np.ndarray, sd: np.ndarray, p: float) -> float:
    """Quantile of a mixture of normal laws by bisection."""
    from math import erfc, sqrt

    some = mass > 1e-14
    mass, mu, sd = mass[some] / mass[some].sum(), mu[some], sd[some]
    lo, hi = float((mu - 12 * sd).min()), float((mu + 12 * sd).max())
    tail = np.frompyfunc(lambda z: 0.5 * erfc(-z / sqrt(2.0)), 1, 1)
    for _ in range(80):
        mid = (lo + hi) / 2
        if float(mass @ tail((mid - mu) / sd).astype(float)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def _grid_quantile(mass: np.ndarray, x: np.ndarray, p: float) -> float:
    """Quantile of weighted nodes, interpolated between the midpoints of their steps."""
    order = np.argsort(x, kind="stable")
    x, w = x[order], mass[order]
    own, first = np.unique(x, return_index=True)
    w = np.add.reduceat(w, first)
    middle = np.cumsum(w) - w / 2
    return float(np.interp(p, middle / w.sum(), own))


def posterior_on_grid(r: Reduced, priors: Priors, sigmas: Sequence[float], taus: Sequence[float]) -> Posterior:
    """The posterior on a given grid of deviations, each node with the same weight of its own."""
    nodes = np.array([(s, t) for s in sigmas for t in taus], float)
    return _posterior(r, priors, nodes, np.zeros(len(nodes)))


def _posterior(r: Reduced, priors: Priors, nodes: np.ndarray, log_weight: np.ndarray) -> Posterior:
    log, mean, cov = conditional(r, nodes, priors.precision(r.names))
    log = log + priors.log_density(nodes)
    mass = np.exp(log + log_weight - (log + log_weight).max())
    return Posterior(r.names, nodes, log, mass / mass.sum(), mean, cov)


def posterior(r: Reduced, priors: Priors, size: int = 41) -> Posterior:
    """The posterior by quadrature over both deviations, on a grid over the range that holds all but e^-20 of its height."""
    precision = priors.precision(r.names)

    def value(nodes):
        # density of (log sigma, tau / sigma)
        return conditional(r, nodes, precision)[0] + priors.log_density(nodes) + 2 * np.log(nodes[:, 0])

    box = _box(r, value, _start(r))
    axes = [np.linspace(*side, size) for side in box]
    nodes = np.array([(np.exp(x), np.exp(x) * t) for x in axes[0] for t in axes[1]])
    # trapezoid rule, and the area that a step takes in (sigma, tau)
    edge = [np.where((a == a[0]) | (a == a[-1]), 0.5, 1.0) for a in axes]
    weight = np.log(np.outer(*edge)).ravel() + 2 * np.log(nodes[:, 0])
    return _posterior(r, priors, nodes, weight)
