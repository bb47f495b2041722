"""Least squares on rows or on collapsed cells, with classical, robust and cluster-robust covariances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tails import chi2_p, f_p, normal_p, t_p, t_quantile
from ..plans.stage import stage
from .absorb import center_by_window
from .design import Design
from .gram import gram, grouped_gram, independent, sum_partials, unpack

INTERCEPT = "(Intercept)"
ESTIMATE_SCHEMA = ("term string, estimate double, std_error double, statistic double, p_value double, "
                   "conf_low double, conf_high double, dropped boolean")


@dataclass
class Fit:
    """Coefficients and their covariance; everything here is of the size of the model, not of the data."""

    spark: SparkSession
    terms: list[str]
    coef: np.ndarray
    cov: np.ndarray
    df: np.ndarray
    dropped: list[str]
    n: float
    rss: float
    rank: int
    vcov: str
    design: Design | None = None
    n_clusters: int | None = None
    bread: np.ndarray | None = None
    cluster_grams: DataFrame | None = field(default=None, repr=False)
    shift: np.ndarray | None = None

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0.0, None))

    def index(self, term: str) -> int:
        return self.terms.index(term)

    def weights(self, parts: Mapping[str, float]) -> np.ndarray:
        """Contrast vector; a dropped term counts as zero."""
        v = np.zeros(len(self.terms))
        for term, w in parts.items():
            if term in self.terms:
                v[self.index(term)] += w
            elif term not in self.dropped:
                raise KeyError(term)
        return v

    def joint_df(self, rows: np.ndarray) -> float:
        """Degrees of freedom of the Wishart law that stands for the covariance of the contrasts under CR2."""
        return hotelling(self.cluster_grams, self.bread, rows if self.shift is None else rows @ self.shift)

    def contrast_df(self, rows: np.ndarray) -> np.ndarray:
        if self.vcov == "CR2":
            back = rows if self.shift is None else rows @ self.shift
            return satterthwaite(self.cluster_grams, self.bread, back)
        return np.full(len(rows), self.df[0] if len(self.df) else np.inf)


def _record(label: str, est: float, var: float, df: float, level: float = 0.95) -> tuple:
    se = float(np.sqrt(max(var, 0.0)))
    if se <= 1e-12 * max(1.0, abs(est)):
        return (label, float(est), se, None, None, None, None, False)
    t = est / se
    q = t_quantile(0.5 + level / 2, df)
    return (label, float(est), se, float(t), float(t_p(t, df)), float(est - q * se), float(est + q * se), False)


def _estimates(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ESTIMATE_SCHEMA)


def tidy(fit: Fit, keep: Sequence[str] | None = None) -> DataFrame:
    """Coefficient table; terms left out for collinearity are listed with ``dropped``."""
    rows = [_record(t, fit.coef[i], fit.cov[i, i], fit.df[i]) for i, t in enumerate(fit.terms)
            if keep is None or t in keep]
    rows += [(t, None, None, None, None, None, None, True) for t in fit.dropped if keep is None or t in keep]
    return _estimates(fit.spark, rows)


def ols(df: DataFrame, y: str | None, design: Design | Sequence[str], intercept: bool = True,
        weight: str | None = None, cells: bool = False, absorb: str | None = None,
        cluster: str | None = None, vcov: str = "iid", max_levels: int = 200) -> Fit:
    """Least squares of ``y`` on the design.

    ``cells`` says that the rows are cells made by ``collapse`` (columns n, y_sum, y_sumsq); coefficients
    and all covariances are then those of the underlying rows. ``absorb`` names one fixed effect to
    remove by centering; its groups must be small (units or cells: at most one row per period).
    The rows are read two or three times, so a panel that is costly to make should be staged or
    materialised first.
    ``vcov`` is iid, HC1, CR1 or CR2. Rows whose outcome, weight or a regressor is NULL are left out.

    Under CR2 an absorbed effect whose groups lie each in one cluster needs no columns: its part of a cluster's hat matrix
    is a projection that the centered regressors are not touched by, so the adjustment follows from their cross products
    alone. Groups that lie in several clusters become 0/1 terms of the model (at most ``max_levels`` of them).
    """
    if not isinstance(design, Design):
        design = Design().main(*design)
    if vcov == "CR2" and absorb and not _nested(df, absorb, cluster):
        levels = sorted((r[0] for r in df.select(absorb).distinct().limit(max_levels + 1).collect()), key=lambda v: (v is None, v))
        if len(levels) > max_levels:
            raise ValueError(f"CR2 with more than {max_levels} groups of {absorb} that lie in several clusters")
        design = Design([*design.terms], set(design.nullable)).factor(absorb, levels, ref=levels[0])
        absorb = None
    spark = df.sparkSession
    terms = ([(INTERCEPT, F.lit(1.0))] if intercept and not absorb else []) + design.terms
    full = Design(list(terms), set(design.nullable))
    ok = full.complete()
    if cells:
        yc, wc = F.col("y_sum") / F.col("n"), F.col("n").cast("double")
        ssc = F.greatest(F.col("y_sumsq") - F.col("y_sum") * F.col("y_sum") / F.col("n"), F.lit(0.0))
    else:
        yc = F.col(y).cast("double")
        wc = F.col(weight).cast("double") if weight else F.lit(1.0)
        ssc = F.lit(0.0)
    keep = [yc.alias("_y"), F.when(ok, wc).otherwise(F.lit(0.0)).alias("_w"),
            F.when(ok, ssc).otherwise(F.lit(0.0)).alias("_ss"), ok.cast("int").alias("_ok")]
    if cluster:
        keep.append(F.col(cluster).alias("_cl"))
    if absorb:
        keep.append(F.col(absorb).alias("_fe"))
    usable = F.col("n") > 0 if cells else F.col(y).isNotNull()
    if weight and not cells:
        usable = usable & F.col(weight).isNotNull()
    base, xs = full.attach(df.filter(usable), keep)

    origin = np.zeros(len(xs) + 1)
    if absorb:
        base = center_by_window(base, [*xs, "_y"], "_fe", "_w")
    elif intercept:
        # Measuring columns that are not 0/1 from one of their own values keeps large offsets out of the sums.
        numeric = [c for c, (n, _) in zip(xs, full.terms) if n in full.nullable]
        if numeric:
            row = base.select(*numeric, "_y").first()
            at = dict(zip([*numeric, "_y"], row or ()))
            origin = np.array([float(at.get(c, 0.0)) for c in [*xs, "_y"]])
            base = base.withColumns({c: F.col(c) - F.lit(float(o)) for c, o in at.items() if o})

    m = gram(base, [*xs, "_y"], "_w")
    k = len(xs)
    kept = independent(m[:k, :k])
    used = [xs[i] for i in kept]
    scale = np.sqrt(np.diag(m)[kept])
    bread = np.linalg.inv(m[np.ix_(kept, kept)] / np.outer(scale, scale)) / np.outer(scale, scale)
    b = bread @ m[kept, k]

    fitted = sum((F.lit(float(v)) * F.col(c) for v, c in zip(b, used)), F.lit(0.0))
    res = base.withColumn("_e", F.col("_y") - fitted)
    rank = len(used)
    nested = bool(absorb and cluster and _nested(df, absorb, cluster))
    if absorb:
        rank += 1 if nested else df.select(absorb).distinct().count()
    n_col = F.col("_w") if cells else F.col("_ok").cast("double")
    rss_col = F.col("_w") * F.col("_e") * F.col("_e") + F.col("_ss")
    n_clusters, grams, dofs = None, None, None
    if vcov == "CR1":
        # one row per cluster: score, rows, residual sum of squares
        scores = res.groupBy("_cl").agg(
            *[F.sum(F.col("_w") * F.col("_e") * F.col(c)).alias(c) for c in used],
            F.lit(1.0).alias("_one"), F.sum(n_col).alias("_n"), F.sum(rss_col).alias("_rss"))
        g = gram(scores, [*used, "_one", "_n", "_rss"])
        meat, n_clusters, n, rss = g[:-3, :-3], int(round(g[-3, -3])), float(g[-3, -2]), float(g[-3, -1])
    else:
        facts = res.agg(F.sum(n_col).alias("n"), F.sum(rss_col).alias("rss")).first()
        n, rss = float(facts["n"]), float(facts["rss"])
    if vcov == "iid":
        v = bread * rss / (n - rank)
        dof = n - rank
    elif vcov == "HC1":
        if weight and not cells:
            q = F.col("_w") * F.col("_w") * F.col("_e") * F.col("_e")
        else:
            q = F.col("_w") * F.col("_e") * F.col("_e") + F.col("_ss")
        meat = gram(res.withColumn("_q", q), used, "_q")
        v = bread @ meat @ bread * n / (n - rank)
        dof = n - rank
    elif vcov == "CR1":
        v = bread @ meat @ bread * (n_clusters / (n_clusters - 1)) * ((n - 1) / (n - rank))
        dof = n_clusters - 1
    elif vcov == "CR2":
        grams = stage(grouped_gram(res, "_cl", [*used, "_e"], "_w"), "clusters")
        meat, dofs = _cr2(grams, bread)
        n_clusters = grams.count()
        v = bread @ meat @ bread
        dof = n_clusters - 1
    else:
        raise ValueError(vcov)

    names = [terms[i][0] for i in kept]
    shift = None
    if intercept and not absorb:
        shift = np.eye(len(kept))
        shift[0, 1:] = -origin[kept][1:]
        b = shift @ b
        b[0] += origin[k]
        v = shift @ v @ shift.T
        if dofs is not None:
            dofs = satterthwaite(grams, bread, shift)
    return Fit(spark, names, b, v, np.array(dofs if dofs is not None else [float(dof)] * len(b)),
               [terms[i][0] for i in range(k) if i not in kept], n, rss, rank, vcov,
               Design([terms[i] for i in kept], full.nullable), n_clusters, bread, grams, shift)


def _nested(df: DataFrame, fe: str, cluster: str) -> bool:
    """Whether every group of the fixed effect lies in one cluster."""
    if fe == cluster:
        return True
    return (df.groupBy(fe).agg(F.min(cluster).alias("a"), F.max(cluster).alias("b"))
            .filter(F.col("a") != F.col("b")).limit(1).count() == 0)


def _adjust(s: np.ndarray, low: np.ndarray) -> np.ndarray:
    """W of one cluster such that the adjusted score is s + S W s, from k x k matrices only."""
    lam, vec = np.linalg.eigh(low.T @ s @ low)
    f = np.full(lam.shape, 0.5)
    one = lam > 1.0 - 1e-8
    big = (np.abs(lam) > 1e-12) & ~one
    f[big] = (1.0 / np.sqrt(1.0 - lam[big]) - 1.0) / lam[big]
    f[one] = -1.0
    lv = low @ vec
    return (lv * f) @ lv.T


def _each_cluster(k: int, low: np.ndarray):
    """Iterate (S, s, W) over the cluster rows of a task."""
    def run(batches):
        for b in batches:
            for flat in b.column("g").to_pylist():
                m = unpack(flat, k + 1)
                s, score = m[:k, :k], m[:k, k]
                yield s, score, _adjust(s, low)
    return run


def _cr2(grams: DataFrame, bread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = len(bread)
    walk = _each_cluster(k, np.linalg.cholesky(bread))

    def meat(batches):
        total = np.zeros((k, k))
        for s, score, w in walk(batches):
            a = score + s @ w @ score
            total += np.outer(a, a)
        return total.ravel()

    return sum_partials(grams.select("g"), meat).reshape(k, k), satterthwaite(grams, bread, np.eye(k))


def satterthwaite(grams: DataFrame, bread: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Degrees of freedom of each contrast (one per row), from sums over clusters of k x k statistics."""
    k, m = len(bread), len(rows)
    walk = _each_cluster(k, np.linalg.cholesky(bread))
    right = bread @ rows.T

    def stats(batches):
        d1, d2, du = np.zeros(m), np.zeros(m), np.zeros(m)
        p = np.zeros((m, k, k))
        for s, _, w in walk(batches):
            q = (np.eye(k) + w @ s) @ right
            u = s @ q
            d = np.einsum("im,im->m", q, u)
            d1 += d
            d2 += d * d
            du += d * np.einsum("im,ij,jm->m", u, bread, u)
            p += np.einsum("im,jm->mij", u, u)
        return np.concatenate([d1, d2, du, p.ravel()])

    v = sum_partials(grams.select("g"), stats)
    d1, d2, du, p = v[:m], v[m:2 * m], v[2 * m:3 * m], v[3 * m:].reshape(m, k, k)
    out = []
    for j in range(m):
        mp = bread @ p[j]
        trace = d1[j] - np.trace(mp)
        square = d2[j] - 2.0 * du[j] + np.trace(mp @ mp)
        out.append(trace * trace / square if square > 0 else np.inf)
    return np.array(out)


def hotelling(grams: DataFrame, bread: np.ndarray, rows: np.ndarray) -> float:
    """Degrees of freedom of a joint test of the contrasts ``rows`` under bias-reduced errors.

    The estimated covariance of the contrasts is a sum of products over clusters. Its expectation E under independent
    errors comes from one walk over the clusters; a second walk, with the contrasts scaled by the inverse root of E,
    collects what its total variance needs. The Wishart law with the same expectation and total variance has the
    degrees of freedom returned here.
    """
    k, q = len(bread), len(rows)
    walk = _each_cluster(k, np.linalg.cholesky(bread))

    def products(right):
        def per(batches):
            for s, _, w in walk(batches):
                v = (np.eye(k) + w @ s) @ right
                u = s @ v
                yield v.T @ u, u.T @ bread @ u, u
        return per

    def expectation(batches):
        total = np.zeros((q, q))
        for a, b, _ in products(bread @ rows.T)(batches):
            total += a - b
        return total.ravel()

    value, vector = np.linalg.eigh(sum_partials(grams.select("g"), expectation).reshape(q, q))
    scaled = (vector / np.sqrt(value)) @ vector.T @ rows

    def spread(batches):
        own, p = 0.0, np.zeros((q, q, k, k))
        for a, b, u in products(bread @ scaled.T)(batches):
            # over pairs (s, t): what the diagonal blocks add, for products of st with ts and of ss with tt
            x, y = np.diag(a), np.diag(b)
            own += (a * a - 2.0 * a * b).sum() + x.sum() ** 2 - 2.0 * x.sum() * y.sum()
            p += np.einsum("is,jt->stij", u, u)
        return np.concatenate([[own], p.ravel()])

    v = sum_partials(grams.select("g"), spread)
    mp = np.einsum("ij,stjk->stik", bread, v[1:].reshape(q, q, k, k))
    cross = np.einsum("stij,stji->", mp, mp) + np.einsum("stij,tsji->", mp, mp)
    return float(q * (q + 1) / (v[0] + cross))


def lincom(fit: Fit, contrasts: Sequence[tuple[str, Mapping[str, float]]]) -> DataFrame:
    """Linear combinations of coefficients with standard errors and tests against zero."""
    rows = np.array([fit.weights(parts) for _, parts in contrasts])
    return contrast_table(fit, [c for c, _ in contrasts], rows)


def contrast_table(fit: Fit, labels: Sequence[str], rows: np.ndarray) -> DataFrame:
    dfs = fit.contrast_df(rows)
    return _estimates(fit.spark, [
        _record(lab, float(r @ fit.coef), float(r @ fit.cov @ r), float(d)) for lab, r, d in zip(labels, rows, dfs)])


def wald(fit: Fit, names: Sequence[str]) -> DataFrame:
    """Joint test that the named coefficients are zero (dropped ones are left out).

    Under CR2 the F statistic is the approximate Hotelling one: with eta degrees of freedom (``hotelling``) and q
    restrictions, chi2 (eta - q + 1) / (eta q) on q and eta - q + 1. It has no law where eta is below q.
    """
    idx = [fit.index(t) for t in names if t in fit.terms]
    b, v = fit.coef[idx], fit.cov[np.ix_(idx, idx)]
    pos = int(np.linalg.matrix_rank(v, hermitian=True))
    stat = float(b @ np.linalg.pinv(v, hermitian=True) @ b)
    f, dof = stat / pos, float(fit.df[0])
    if fit.vcov == "CR2":
        # a covariance of lower rank is tested in the directions that it has
        turn = np.linalg.eigh(v)[1][:, -pos:].T if pos < len(idx) else np.eye(pos)
        eta = fit.joint_df(turn @ np.eye(len(fit.terms))[idx])
        f, dof = (stat * (eta - pos + 1) / (eta * pos), eta - pos + 1) if eta > pos - 1 else (None, None)
    return fit.spark.createDataFrame(
        [(pos, stat, f, dof, chi2_p(stat, pos), None if dof is None else f_p(f, pos, dof))],
        "n_restrictions int, chi2 double, f double, df2 double, p_chi2 double, p_f double")


def predict(fit: Fit, df: DataFrame, out: str = "pred") -> DataFrame:
    """Fitted value and its standard error for any rows that have the regressor columns."""
    xs = [c for _, c in fit.design.terms]
    value = sum((F.lit(float(b)) * x for b, x in zip(fit.coef, xs)), F.lit(0.0))
    k = len(xs)
    var = sum((F.lit(float(fit.cov[i, j] * (1 if i == j else 2))) * xs[i] * xs[j]
               for i in range(k) for j in range(i, k) if fit.cov[i, j] != 0.0), F.lit(0.0))
    return df.withColumns({out: value, f"{out}_se": F.sqrt(F.greatest(var, F.lit(0.0)))})


def normal_table(spark: SparkSession, rows: Sequence[tuple[str, float, float | None]]) -> DataFrame:
    """Estimate table from (term, estimate, standard error or None) with normal intervals."""
    return _estimates(spark, [
        (t, e, s, e / s if s else None, normal_p(e / s) if s else None,
         None if s is None else e - 1.96 * s, None if s is None else e + 1.96 * s, False)
        for t, e, s in rows])
