"""SQL text for the fixtures and for least squares, used to check the Spark results."""

from __future__ import annotations

from collections.abc import Sequence

FX1 = """
fx1_out AS (
  SELECT o_custkey AS unit, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice / CAST(97531 AS DOUBLE)) AS y0
  FROM orders GROUP BY 1, 2),
fx1_years AS (SELECT CAST(unnest(range(1995, 2002)) AS INTEGER) AS year),
fx1_base AS (
  SELECT c.c_custkey AS unit, c.c_nationkey AS cluster,
         CAST(CASE c.c_nationkey % 3 WHEN 0 THEN 1997 WHEN 1 THEN 1999 END AS INTEGER) AS cohort,
         t.year, coalesce(o.y0, CAST(0 AS DOUBLE)) AS y0
  FROM customer c CROSS JOIN fx1_years t LEFT JOIN fx1_out o ON o.unit = c.c_custkey AND o.year = t.year),
fx1_tau AS (
  SELECT *, CASE WHEN year >= cohort THEN 1 ELSE 0 END AS treat,
         CAST(CASE WHEN year >= cohort THEN CASE cohort WHEN 1997 THEN 2 ELSE 1 END ELSE 0 END AS DOUBLE) AS tau
  FROM fx1_base),
fx1_cum AS (SELECT *, sum(tau) OVER (PARTITION BY unit ORDER BY year) AS tau_cum FROM fx1_tau),
fx1 AS (SELECT *, y0 + tau_cum AS y FROM fx1_cum)"""

FX2 = """
fx2_y AS (
  SELECT o_custkey AS unit, CASE WHEN year(o_orderdate) >= 1998 THEN 1 ELSE 0 END AS period,
         sum(o_totalprice / CAST(97531 AS DOUBLE)) AS y
  FROM orders GROUP BY 1, 2),
fx2 AS (
  SELECT y.unit, y.period, y.y, c.c_nationkey AS cluster, greatest(c.c_acctbal, 0) / CAST(1000 AS DOUBLE) AS dose
  FROM fx2_y y JOIN customer c ON c.c_custkey = y.unit),
fx2w AS (
  SELECT unit, dose, max(y) FILTER (WHERE period = 0) AS y0, max(y) FILTER (WHERE period = 1) AS y1,
         max(y) FILTER (WHERE period = 1) - max(y) FILTER (WHERE period = 0) AS delta_y
  FROM fx2 GROUP BY unit, dose HAVING count(*) = 2)"""

FX3 = """
fx3_cells AS (
  SELECT l_suppkey AS unit,
         CAST((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS t,
         avg(l_quantity) AS dose, avg(l_discount * CAST(100 AS DOUBLE)) AS control,
         avg(l_extendedprice / CAST(997 AS DOUBLE)) AS y
  FROM lineitem GROUP BY 1, 2),
fx3_t AS (SELECT CAST(unnest(range(0, 28)) AS INTEGER) AS t),
fx3 AS (
  SELECT s.s_suppkey AS unit, s.s_nationkey AS cluster, t.t, c.dose, c.control, c.y
  FROM supplier s CROSS JOIN fx3_t t LEFT JOIN fx3_cells c ON c.unit = s.s_suppkey AND c.t = t.t)"""

FX3D = FX3 + """,
fx3_lag AS (
  SELECT *, lag(t) OVER w AS tp, dose - lag(dose) OVER w AS d_dose, y - lag(y) OVER w AS d_y,
         control - lag(control) OVER w AS d_control, lag(dose) OVER w AS dose_lag
  FROM fx3 WINDOW w AS (PARTITION BY unit ORDER BY t)),
fx3d AS (SELECT * FROM fx3_lag WHERE t - tp = 1)"""

FX3W = FX3 + """,
fx3w AS (
  SELECT unit, t, cluster,
    y - avg(y) OVER (PARTITION BY unit) - avg(y) OVER (PARTITION BY t) + avg(y) OVER () AS y,
    dose - avg(dose) OVER (PARTITION BY unit) - avg(dose) OVER (PARTITION BY t) + avg(dose) OVER () AS dose,
    control - avg(control) OVER (PARTITION BY unit) - avg(control) OVER (PARTITION BY t) + avg(control) OVER () AS control
  FROM fx3)"""

FX4 = FX3 + """,
fx4_g AS (SELECT *, CASE WHEN cluster % 2 = 0 THEN 9 ELSE 14 END AS cohort FROM fx3),
fx4_c AS (
  SELECT *, CASE WHEN t >= cohort THEN 1 ELSE 0 END AS treat, greatest(t - cohort, 0) AS since,
         CASE WHEN cohort = 14 THEN 1 ELSE 0 END AS cohort_14 FROM fx4_g),
fx4 AS (
  SELECT unit, cluster, t, cohort, treat, t AS year0, t - cohort AS yearc, since, cohort_14,
    CAST(CASE WHEN treat = 1 THEN CASE WHEN cohort_14 = 1 THEN 4 ELSE 1 END ELSE 0 END AS DOUBLE) AS tau,
    y + treat * CAST(CASE WHEN cohort_14 = 1 THEN 3 ELSE 2 END AS DOUBLE)
      + since * CAST(CASE WHEN cohort_14 = 1 THEN 1 ELSE 0.25 END AS DOUBLE) AS y
  FROM fx4_c)"""

FX5 = """
fx5 AS (
  SELECT user_id AS unit, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) + 1 AS INTEGER) AS t, sum(value) AS y, CAST(count(*) AS DOUBLE) AS x
  FROM events GROUP BY 1, 2)"""

FX1_GRID = """
prof AS (
  SELECT cohort, count(DISTINCT unit) AS n, unnest(range(1995, 2002)) AS yr FROM fx1 GROUP BY cohort),
ct AS (SELECT cohort, year AS yr, sum(y) AS s, count(*) AS n FROM fx1 GROUP BY 1, 2),
grid AS (
  SELECT g, t, CASE WHEN t >= g THEN g - 1 ELSE t - 1 END AS b, CASE WHEN t >= g THEN 1 ELSE 0 END AS post,
         greatest(t, CASE WHEN t >= g THEN g - 1 ELSE t - 1 END) AS cut
  FROM (SELECT unnest([1997, 1999]) AS g) CROSS JOIN (SELECT unnest(range(1996, 2002)) AS t)),
gd AS (
  SELECT grid.*, a.cohort, a.n, a.s - o.s AS delta,
    CASE WHEN a.cohort = g THEN 1 WHEN a.cohort IS NULL OR (a.cohort > cut AND a.cohort <> g) THEN 2 ELSE 0 END AS role
  FROM grid JOIN ct a ON a.yr = t JOIN ct o ON o.yr = b AND a.cohort IS NOT DISTINCT FROM o.cohort),
attgt AS (
  SELECT CAST(g AS INTEGER) AS g, CAST(t AS INTEGER) AS t, CAST(t - g AS INTEGER) AS event, CAST(post AS INTEGER) AS post,
    sum(delta) FILTER (WHERE role = 1) / sum(n) FILTER (WHERE role = 1)
      - sum(delta) FILTER (WHERE role = 2) / sum(n) FILTER (WHERE role = 2) AS att,
    sum(delta) FILTER (WHERE role = 1) / sum(n) FILTER (WHERE role = 1) AS mt,
    sum(delta) FILTER (WHERE role = 2) / sum(n) FILTER (WHERE role = 2) AS mc,
    CAST(sum(n) FILTER (WHERE role = 1) AS BIGINT) AS n_treated,
    CAST(sum(n) FILTER (WHERE role = 2) AS BIGINT) AS n_control, sum(n) AS n_all
  FROM gd GROUP BY ALL)"""


def least_squares(rows: str, xs: Sequence[str], names: Sequence[str], vcov: str = "", rank: int | None = None,
                  tag: str = "") -> str:
    """Common table expressions ``ls{tag}_est`` (term, estimate, std_error) for a model.

    ``rows`` is a query with columns y, cl and the regressors. Normal equations are inverted by
    Gauss-Jordan steps in a recursive query.
    """
    k = len(xs)
    p = f"ls{tag}"
    kk = rank if rank is not None else k
    listed = ", ".join(f"CAST({x} AS DOUBLE)" for x in xs)
    named = ", ".join("'" + n.replace("'", "''") + "'" for n in names)
    out = f"""
{p}_d AS (SELECT row_number() OVER () AS rn, y, cl, [{listed}] AS x FROM ({rows}) AS src),
{p}_x AS (SELECT rn, cl, y, unnest(range(1, {k + 1})) AS j, unnest(x) AS x FROM {p}_d),
{p}_m AS (
  SELECT a.j AS i, b.j AS j, sum(a.x * b.x) AS v FROM {p}_x a JOIN {p}_x b ON a.rn = b.rn GROUP BY 1, 2
  UNION ALL SELECT i, i + {k}, 1.0 FROM (SELECT unnest(range(1, {k + 1})) AS i)
  UNION ALL SELECT i, j + {k}, 0.0 FROM (SELECT unnest(range(1, {k + 1})) AS i)
            CROSS JOIN (SELECT unnest(range(1, {k + 1})) AS j) WHERE i <> j),
{p}_g(p, i, j, v) AS (
  SELECT 0, i, j, CAST(v AS DOUBLE) FROM {p}_m
  UNION ALL
  SELECT r.p + 1, r.i, r.j, CASE WHEN r.i = r.p + 1 THEN r.v / pv.v ELSE r.v - c.v * w.v / pv.v END
  FROM {p}_g r JOIN {p}_g pv ON pv.i = r.p + 1 AND pv.j = r.p + 1
       JOIN {p}_g c ON c.i = r.i AND c.j = r.p + 1 JOIN {p}_g w ON w.i = r.p + 1 AND w.j = r.j
  WHERE r.p < {k}),
{p}_inv AS MATERIALIZED (SELECT i, j - {k} AS j, v FROM {p}_g WHERE p = {k} AND j > {k}),
{p}_xy AS (SELECT j, sum(x * y) AS v FROM {p}_x GROUP BY j),
{p}_b AS (SELECT i, sum(m.v * q.v) AS b FROM {p}_inv m JOIN {p}_xy q ON q.j = m.j GROUP BY i),
{p}_e AS (
  SELECT x.rn, x.cl, x.y - sum(x.x * b.b) AS e FROM {p}_x x JOIN {p}_b b ON b.i = x.j GROUP BY x.rn, x.cl, x.y)"""
    scalar_n = f"(SELECT count(*) FROM {p}_d)"
    if vcov == "iid":
        out += f""",
{p}_v AS (SELECT i, v * (SELECT sum(e * e) FROM {p}_e) / ({scalar_n} - {kk}) AS v FROM {p}_inv WHERE i = j)"""
    elif vcov in ("HC1", "CR1"):
        if vcov == "CR1":
            score = (f"SELECT x.cl AS k, x.j, sum(x.x * e.e) AS s FROM {p}_x x JOIN {p}_e e ON e.rn = x.rn GROUP BY 1, 2")
            g = f"(SELECT count(DISTINCT cl) FROM {p}_d)"
            adj = f"({g} / ({g} - CAST(1 AS DOUBLE)) * ({scalar_n} - 1) / ({scalar_n} - {kk}))"
        else:
            score = f"SELECT x.rn AS k, x.j, x.x * e.e AS s FROM {p}_x x JOIN {p}_e e ON e.rn = x.rn"
            adj = f"({scalar_n} / CAST({scalar_n} - {kk} AS DOUBLE))"
        out += f""",
{p}_s AS ({score}),
{p}_meat AS (SELECT a.j AS i, b.j AS j, sum(a.s * b.s) AS v FROM {p}_s a JOIN {p}_s b ON a.k = b.k GROUP BY 1, 2),
{p}_v AS (
  SELECT l.i, {adj} * sum(l.v * m.v * r.v) AS v
  FROM {p}_inv l JOIN {p}_meat m ON m.i = l.j JOIN {p}_inv r ON r.i = m.j AND r.j = l.i GROUP BY l.i)"""
    if vcov:
        out += f""",
{p}_est AS (
  SELECT list_extract([{named}], b.i) AS term, b.b AS estimate, sqrt(v.v) AS std_error
  FROM {p}_b b JOIN {p}_v v ON v.i = b.i)"""
        if vcov == "CR1":
            out += f""",
{p}_full AS (
  SELECT l.i, r.j, {adj} * sum(l.v * m.v * r.v) AS v
  FROM {p}_inv l JOIN {p}_meat m ON m.i = l.j JOIN {p}_inv r ON r.i = m.j GROUP BY 1, 2)"""
    else:
        out += f""",
{p}_est AS (SELECT list_extract([{named}], b.i) AS term, b.b AS estimate FROM {p}_b b)"""
    return out


def bias_reduced(terms: int = 240) -> str:
    """Table ``cr2`` (i, std_error, df) on top of ``least_squares``: the inverse square root of I - H of a
    cluster is expanded in powers of M S, with S the cluster's cross products and M the inverse of the total."""
    return f"""
cs AS MATERIALIZED (SELECT a.cl, a.j AS i, b.j AS l, sum(a.x * b.x) AS v FROM ls_x a JOIN ls_x b ON a.rn = b.rn GROUP BY 1, 2, 3),
ms AS MATERIALIZED (SELECT cs.cl, m.i, cs.l, sum(m.v * cs.v) AS v FROM ls_inv m JOIN cs ON cs.i = m.j GROUP BY 1, 2, 3),
sc AS (SELECT x.cl, x.j AS i, sum(x.x * e.e) AS v FROM ls_x x JOIN ls_e e ON e.rn = x.rn GROUP BY 1, 2),
sm AS (SELECT cs.cl, m.j AS c, cs.i, sum(cs.v * m.v) AS v FROM cs JOIN ls_inv m ON m.i = cs.l GROUP BY 1, 2, 3),
arg AS (SELECT cl, 0 AS c, i, v FROM sc UNION ALL SELECT cl, c, i, v FROM sm),
pw(n, cl, c, i, v) AS (
  SELECT 0, arg.cl, arg.c, m.i, sum(m.v * arg.v) FROM arg JOIN ls_inv m ON m.j = arg.i GROUP BY arg.cl, arg.c, m.i
  UNION ALL
  SELECT p.n + 1, p.cl, p.c, ms.i, sum(ms.v * p.v) FROM pw p JOIN ms ON ms.cl = p.cl AND ms.l = p.i
  WHERE p.n < {terms} GROUP BY p.n + 1, p.cl, p.c, ms.i),
wx AS (
  SELECT cl, c, i, sum(v * exp(lgamma(2 * n + 3) - 2 * lgamma(n + 2) - (n + 1) * ln(CAST(4 AS DOUBLE)))) AS v FROM pw GROUP BY 1, 2, 3),
ad AS (SELECT sc.cl, sc.i, max(sc.v) + sum(cs.v * wx.v) AS v FROM sc JOIN cs ON cs.cl = sc.cl AND cs.i = sc.i
  JOIN wx ON wx.cl = sc.cl AND wx.c = 0 AND wx.i = cs.l GROUP BY 1, 2),
qq AS (SELECT wx.cl, wx.c, wx.i, wx.v + m.v AS v FROM wx JOIN ls_inv m ON m.i = wx.i AND m.j = wx.c),
uu AS (SELECT cs.cl, qq.c, cs.i, sum(cs.v * qq.v) AS v FROM cs JOIN qq ON qq.cl = cs.cl AND qq.i = cs.l GROUP BY 1, 2, 3),
dd AS (SELECT qq.cl, qq.c, sum(qq.v * uu.v) AS v FROM qq JOIN uu ON uu.cl = qq.cl AND uu.c = qq.c AND uu.i = qq.i GROUP BY 1, 2),
mu AS (SELECT uu.cl, uu.c, m.i, sum(m.v * uu.v) AS v FROM uu JOIN ls_inv m ON m.j = uu.i GROUP BY 1, 2, 3),
om AS (SELECT a.c, a.cl AS ca, b.cl AS cb, -sum(a.v * b.v) + CASE WHEN a.cl = b.cl THEN max(dd.v) ELSE 0 END AS v
  FROM uu a JOIN mu b ON b.c = a.c AND b.i = a.i JOIN dd ON dd.cl = a.cl AND dd.c = a.c GROUP BY 1, 2, 3),
dfs AS (SELECT c AS i, sum(CASE WHEN ca = cb THEN v ELSE 0 END) * sum(CASE WHEN ca = cb THEN v ELSE 0 END) / sum(v * v) AS df FROM om GROUP BY c),
am AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM ad a JOIN ad b ON b.cl = a.cl GROUP BY 1, 2),
vs AS (SELECT l.i, sqrt(sum(l.v * am.v * r.v)) AS std_error FROM ls_inv l JOIN am ON am.i = l.j JOIN ls_inv r ON r.i = am.j AND r.j = l.i GROUP BY l.i),
cr2 AS (SELECT vs.i, std_error, df FROM vs JOIN dfs ON dfs.i = vs.i)"""


def with_list(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(p.strip() for p in parts)


def demeaned(source: str, columns: Sequence[str], key: str, keep: str) -> str:
    """Query that subtracts the mean within a key from each column."""
    return (f"SELECT {keep}, " + ", ".join(
        f"({c}) - avg({c}) OVER (PARTITION BY {key}) AS {n}" for n, c in columns) + f" FROM {source}")


def mixed_grid(rows: str, xs: Sequence[str], sigmas: Sequence[float], taus: Sequence[float], precision: Sequence[float]) -> str:
    """Tables ``mx_log`` (node, sigma, tau, v: log-likelihood without coefficients) and ``mx_b`` (node, i, b, var) of a linear
    model with an intercept per cluster, for each pair of deviations.

    ``rows`` has cl, v (known error variance), y and the regressors. Matrices are reduced by Gauss-Jordan steps in a
    recursive query; the pivots give the log-determinant.
    """
    k = len(xs)
    listed = ", ".join(f"CAST({x} AS DOUBLE)" for x in xs)
    pairs = ", ".join(f"({n}, CAST({s} AS DOUBLE), CAST({t} AS DOUBLE))" for n, (s, t) in enumerate((s, t) for s in sigmas for t in taus))
    prior = ", ".join(f"({i + 1}, CAST({v!r} AS DOUBLE))" for i, v in enumerate(precision))
    return f"""
mx_c AS MATERIALIZED (SELECT cl, v, x, CAST(count(*) AS DOUBLE) AS n, sum(y) AS sy, sum(y * y) AS syy FROM (
  SELECT cl, CAST(v AS DOUBLE) AS v, y, [CAST(1 AS DOUBLE), {listed}] AS x FROM ({rows}) AS src) GROUP BY cl, v, x),
mx_l AS (SELECT cl, v, x AS own, n, sy, unnest(range(0, {k + 1})) AS i, unnest(x) AS x FROM mx_c),
mx_p AS MATERIALIZED (
  SELECT a.cl, a.v, a.i, b.i AS j, sum(a.n * a.x * b.x) AS g FROM mx_l a JOIN mx_l b ON a.cl = b.cl AND a.v = b.v AND a.own = b.own GROUP BY ALL
  UNION ALL SELECT cl, v, i, {k + 1}, sum(x * sy) FROM mx_l GROUP BY ALL
  UNION ALL SELECT cl, v, {k + 1}, i, sum(x * sy) FROM mx_l GROUP BY ALL
  UNION ALL SELECT cl, v, {k + 1}, {k + 1}, sum(syy) FROM mx_c GROUP BY ALL),
mx_n(node, sigma, tau) AS (VALUES {pairs}),
mx_r(i, q) AS (VALUES {prior}),
mx_k AS MATERIALIZED (SELECT node, cl, i, j, max(tau) AS tau, sum(g / (sigma * sigma + v)) AS g FROM mx_p, mx_n GROUP BY ALL),
mx_s AS (SELECT node, cl, i, g FROM mx_k WHERE j = 0),
mx_o AS (SELECT node, cl, tau * tau / (1 + tau * tau * g) AS h, ln(1 + tau * tau * g) AS d FROM mx_k WHERE i = 0 AND j = 0),
mx_a AS MATERIALIZED (
  SELECT k.node, k.i, k.j, sum(k.g - o.h * a.g * b.g) + max(CASE WHEN k.i = k.j THEN coalesce(r.q, 0) ELSE 0 END) AS v
  FROM mx_k k JOIN mx_o o ON o.node = k.node AND o.cl = k.cl JOIN mx_s a ON a.node = k.node AND a.cl = k.cl AND a.i = k.i
    JOIN mx_s b ON b.node = k.node AND b.cl = k.cl AND b.i = k.j LEFT JOIN mx_r r ON r.i = k.i
  WHERE k.i > 0 AND k.j > 0 GROUP BY k.node, k.i, k.j),
mx_d AS (SELECT node, sum(d) AS d FROM (SELECT node, d FROM mx_o UNION ALL
  SELECT node, sum(n * ln(sigma * sigma + v)) FROM mx_c, mx_n GROUP BY node) GROUP BY node),
mx_e AS (SELECT unnest(range(1, {k + 1})) AS i),
mx_g(p, node, i, j, v) AS (
  SELECT 0, node, i, j, v FROM (SELECT * FROM mx_a WHERE i <= {k} UNION ALL
    SELECT node, a.i, b.i + {k + 1}, CASE WHEN a.i = b.i THEN 1.0 ELSE 0.0 END FROM mx_n, mx_e a, mx_e b)
  UNION ALL
  SELECT r.p + 1, r.node, r.i, r.j, CASE WHEN r.i = r.p + 1 THEN r.v / pv.v ELSE r.v - c.v * w.v / pv.v END
  FROM mx_g r JOIN mx_g pv ON pv.node = r.node AND pv.i = r.p + 1 AND pv.j = r.p + 1
    JOIN mx_g c ON c.node = r.node AND c.i = r.i AND c.j = r.p + 1 JOIN mx_g w ON w.node = r.node AND w.i = r.p + 1 AND w.j = r.j
  WHERE r.p < {k}),
mx_q AS MATERIALIZED (SELECT * FROM mx_g),
mx_b AS (SELECT b.node, b.i, b.v AS b, d.v AS var FROM mx_q b JOIN mx_q d ON d.p = {k} AND d.node = b.node AND d.i = b.i AND d.j = b.i + {k + 1}
  WHERE b.p = {k} AND b.j = {k + 1}),
mx_log AS (
  SELECT n.node, n.sigma, n.tau, -0.5 * (mx_d.d + pv.d + yy.v - fit.v) AS v FROM mx_n n JOIN mx_d ON mx_d.node = n.node
  JOIN (SELECT node, sum(ln(v)) AS d FROM mx_q WHERE i = p + 1 AND j = p + 1 GROUP BY node) AS pv ON pv.node = n.node
  JOIN (SELECT node, v FROM mx_a WHERE i = {k + 1} AND j = {k + 1}) AS yy ON yy.node = n.node
  JOIN (SELECT b.node, sum(b.b * a.v) AS v FROM mx_b b JOIN mx_a a ON a.node = b.node AND a.i = b.i AND a.j = {k + 1} GROUP BY b.node) AS fit ON fit.node = n.node)"""


def joint_reduced(first: int, last: int) -> str:
    """Table ``ht`` (q, chi2, eta) on top of ``bias_reduced``: joint test of coefficients ``first`` to ``last`` and the
    degrees of freedom of the Wishart law, from the covariances of all pairs of clusters."""
    q = last - first + 1

    def solve(name: str, source: str) -> str:
        return f"""{name}(p, i, j, v) AS (SELECT 0, i, j, v FROM ({source})
  UNION ALL SELECT r.p + 1, r.i, r.j, CASE WHEN r.i = r.p + 1 THEN r.v / pv.v ELSE r.v - c.v * w.v / pv.v END
  FROM {name} r JOIN {name} pv ON pv.i = r.p + 1 AND pv.j = r.p + 1 JOIN {name} c ON c.i = r.i AND c.j = r.p + 1
    JOIN {name} w ON w.i = r.p + 1 AND w.j = r.j WHERE r.p < {q})"""

    inside = f"BETWEEN {first} AND {last}"
    return f"""
ht_a AS (SELECT qq.cl, qq.c AS s, uu.c AS t, sum(qq.v * uu.v) AS v FROM qq JOIN uu ON uu.cl = qq.cl AND uu.i = qq.i
  WHERE qq.c {inside} AND uu.c {inside} GROUP BY 1, 2, 3),
ht_o AS MATERIALIZED (SELECT uu.cl AS ca, mu.cl AS cb, uu.c AS s, mu.c AS t, coalesce(max(a.v), 0) - sum(uu.v * mu.v) AS v FROM uu JOIN mu ON mu.i = uu.i
  LEFT JOIN ht_a a ON a.cl = uu.cl AND uu.cl = mu.cl AND a.s = uu.c AND a.t = mu.c WHERE uu.c {inside} AND mu.c {inside} GROUP BY 1, 2, 3, 4),
ht_e AS (SELECT s - {first - 1} AS i, t - {first - 1} AS j, sum(v) AS v FROM ht_o WHERE ca = cb GROUP BY 1, 2),
ht_n AS (SELECT unnest(range(1, {q + 1})) AS i),
{solve("ht_g", f"SELECT * FROM ht_e UNION ALL SELECT a.i, b.i + {q}, CASE WHEN a.i = b.i THEN 1.0 ELSE 0.0 END FROM ht_n a, ht_n b")},
ht_i AS MATERIALIZED (SELECT i + {first - 1} AS s, j - {q} + {first - 1} AS t, v FROM ht_g WHERE p = {q} AND j > {q}),
ht_y AS MATERIALIZED (SELECT o.ca, o.cb, m.s, o.t, sum(m.v * o.v) AS v FROM ht_i m JOIN ht_o o ON o.s = m.t GROUP BY 1, 2, 3, 4),
ht_t AS (SELECT sum(v) AS v FROM (
  SELECT sum(a.v * b.v) AS v FROM ht_y a JOIN ht_y b ON b.ca = a.ca AND b.cb = a.cb AND b.s = a.t AND b.t = a.s
  UNION ALL SELECT sum(d * d) FROM (SELECT sum(v) AS d FROM ht_y WHERE s = t GROUP BY ca, cb))),
ht_c AS (SELECT l.i - {first - 1} AS i, r.j - {first - 1} AS j, sum(l.v * am.v * r.v) AS v FROM ls_inv l JOIN am ON am.i = l.j JOIN ls_inv r ON r.i = am.j
  WHERE l.i {inside} AND r.j {inside} GROUP BY 1, 2),
{solve("ht_w", f"SELECT * FROM ht_c UNION ALL SELECT i - {first - 1}, {q + 1}, b FROM ls_b WHERE i {inside}")},
ht AS (SELECT {q} AS q, sum(b.b * w.v) AS chi2, {q * (q + 1)} / (SELECT v FROM ht_t) AS eta
  FROM ht_w w JOIN ls_b b ON b.i = w.i + {first - 1} WHERE w.p = {q} AND w.j = {q + 1})"""
