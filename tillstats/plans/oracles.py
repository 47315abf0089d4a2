"""The registered queries in SQL over the same tables, for a second engine to check."""

from __future__ import annotations

from ..sources.salesview import sql as sales_sql

_S = f"sales AS ({sales_sql()})"
_SPIKED = "spiked AS (SELECT *, CASE WHEN BOLETA % 500 = 0 THEN MONTO_APLICADO * 50 ELSE MONTO_APLICADO END AS v FROM sales)"
_AGED = """aged AS (SELECT *, CASE WHEN a BETWEEN 0 AND 110 THEN a END AS EDAD FROM (SELECT *, year(FECHA) - year(FECHA_NACIMIENTO)
  - CASE WHEN month(FECHA) * 100 + day(FECHA) < month(FECHA_NACIMIENTO) * 100 + day(FECHA_NACIMIENTO) THEN 1 ELSE 0 END AS a FROM sales))"""
_DAYS = """days AS (SELECT CAST({date} AS DATE) AS ds, sum({value}) AS y FROM {source} GROUP BY 1),
  cal AS (SELECT CAST(unnest(generate_series((SELECT min(ds) FROM days), (SELECT max(ds) FROM days), INTERVAL 1 DAY)) AS DATE) AS ds),
  series AS (SELECT cal.ds, coalesce(days.y, 0) AS y, row_number() OVER (ORDER BY cal.ds) - 1 AS i FROM cal LEFT JOIN days ON cal.ds = days.ds)"""
_SALES_DAYS = _DAYS.format(date="FECHA", value="MONTO_APLICADO", source="sales")
_EVENT_DAYS = _DAYS.format(date="ts", value="value", source="events")
_PAIRS = (("MONTO_APLICADO", "UNIDADES"), ("MONTO_APLICADO", "PORCENTAJE_DESCUENTO"), ("UNIDADES", "PORCENTAJE_DESCUENTO"))


#: Weights of Simpson's rule over 2,000 steps, with ``k`` from range(2001); the sum times step / 3 is the integral.
_SIMPSON = "CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"


def _t_two_sided(t: str, dof: str) -> str:
    """Two-sided tail of Student's t, by integrating its density from 0."""
    front = f"exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt({dof} * pi())"
    return f"(1 - 2 * {front} * abs({t}) / 6000 * (SELECT sum({_SIMPSON} * power(1 + power(abs({t}) * k / 2000, 2) / {dof}, -({dof} + 1) / 2.0)) FROM range(2001) r(k)))"


def _normal_sf(z: str) -> str:
    """Upper tail of the standard normal."""
    return f"(0.5 - sign({z}) * abs({z}) / 6000 / sqrt(2 * pi()) * (SELECT sum({_SIMPSON} * exp(-power({z} * k / 2000, 2) / 2)) FROM range(2001) r(k)))"


def _f_tail(f: str, d1: str, d2: str) -> str:
    """Upper tail of F for more than two degrees of freedom above."""
    front = f"lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0) + {d1} / 2.0 * ln({d1} / CAST({d2} AS DOUBLE))"
    return f"(1 - {f} / 6000 * (SELECT sum({_SIMPSON} * CASE WHEN k = 0 THEN 0 ELSE exp({front} + ({d1} / 2.0 - 1) * ln({f} * greatest(k, 1) / 2000) - ({d1} + {d2}) / 2.0 * ln(1 + {d1} * {f} * k / 2000 / {d2})) END) FROM range(2001) r(k)))"


def _chi_tail(x: str, dof: str) -> str:
    """Upper tail of chi-square with an even number of degrees of freedom."""
    return f"(SELECT sum(exp(-{x} / 2 + i * ln({x} / 2) - lgamma(i + 1))) FROM range(CAST({dof} // 2 AS BIGINT)) t(i))"


def _union(parts) -> str:
    return "\nUNION ALL ".join(parts)


def _describe(column: str) -> str:
    return f"""SELECT '{column}' AS variable, count({column}) AS n, round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS std,
  round(CAST(min({column}) AS DOUBLE), 6) AS min, round(CAST(quantile_cont({column}, 0.25) AS DOUBLE), 6) AS q1, round(CAST(quantile_cont({column}, 0.5) AS DOUBLE), 6) AS median,
  round(CAST(quantile_cont({column}, 0.75) AS DOUBLE), 6) AS q3, round(CAST(max({column}) AS DOUBLE), 6) AS max,
  round(avg(power({column} - m, 3)) / power(stddev_pop({column}), 3), 6) AS skewness, round(kurtosis_pop({column}), 6) AS kurtosis
  FROM aged, (SELECT avg({column}) AS m FROM aged)"""


def _pearson(i: str, j: str) -> str:
    return f"SELECT '{i}' AS var_i, '{j}' AS var_j, count(*) AS n, corr({i}, {j}) AS corr FROM sales WHERE {i} IS NOT NULL AND {j} IS NOT NULL"


def _spearman(i: str, j: str) -> str:
    ranked = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {r}" for c, r in ((i, "x"), (j, "y")))
    return f"SELECT '{i}' AS var_i, '{j}' AS var_j, count(*) AS n, corr(x, y) AS corr FROM (SELECT {ranked} FROM sales WHERE {i} IS NOT NULL AND {j} IS NOT NULL)"


def _correlations(pair) -> str:
    """Pairs with their p, and the diagonal."""
    t = "(c.corr * sqrt((c.n - 2) / (1 - c.corr * c.corr)))"
    diagonal = _union(f"SELECT '{x}', '{x}', NULL, 1.0, 0.0" for x in ("MONTO_APLICADO", "UNIDADES", "PORCENTAJE_DESCUENTO"))
    return f"WITH {_S}, c AS ({_union(pair(*p) for p in _PAIRS)}) SELECT var_i, var_j, CAST(n AS BIGINT) AS n, round(corr, 8) AS corr, round({_t_two_sided(t, '(c.n - 2)')}, 8) AS p_value FROM c UNION ALL {diagonal}"


def _anova(group: str, more: str = "") -> str:
    return f"""WITH {_S}, g AS (SELECT {group}, count(*) AS n, avg(MONTO_APLICADO) AS m, coalesce(var_samp(MONTO_APLICADO), 0) AS s2 FROM sales GROUP BY 1),
  a AS (SELECT sum(n) AS nn, sum(n * m) / sum(n) AS mm, count(*) AS k FROM g),
  f AS (SELECT (sum(n * power(m - mm, 2)) / (max(k) - 1)) / (sum((n - 1) * s2) / (max(nn) - max(k))) AS f, max(k) - 1 AS df1, CAST(max(nn) - max(k) AS BIGINT) AS df2 FROM g, a)
  SELECT round(f, 8) AS f, df1, df2{more} FROM f"""


def _ranks(rows: str) -> str:
    """CTEs up to ``u``: U of the rows with ``first`` among rows (first, v), and its standard score less the correction."""
    return f"""h AS (SELECT v, count(*) AS t FROM ({rows}) GROUP BY v),
  r AS (SELECT first, rank() OVER (ORDER BY x.v) + (h.t - 1) / 2.0 AS k FROM ({rows}) x JOIN h ON x.v = h.v),
  u0 AS (SELECT sum(k) FILTER (WHERE first) - (count(*) FILTER (WHERE first)) * ((count(*) FILTER (WHERE first)) + 1) / 2.0 AS u,
    count(*) FILTER (WHERE first) AS n_a, count(*) FILTER (WHERE NOT first) AS n_b, count(*) AS n,
    (SELECT CAST(sum(CAST(t AS DOUBLE) * t * t - t) AS DOUBLE) FROM h) AS ties FROM r),
  u1 AS (SELECT *, CAST(n_a AS DOUBLE) * n_b AS nn, sqrt(CAST(n_a AS DOUBLE) * n_b / 12 * ((n + 1) - ties / (CAST(n AS DOUBLE) * (n - 1)))) AS sd FROM u0),
  u AS (SELECT *, (u - nn / 2 - 0.5) / sd AS z_up, (greatest(u, nn - u) - nn / 2 - 0.5) / sd AS z FROM u1)"""


def _rank_test(rows: str) -> str:
    return f"{_ranks(rows)} SELECT round(u, 1) AS u, n_a, n_b, round(least(1, 2 * {_normal_sf('u.z')}), 8) AS p_value FROM u"


def _slope(source: str, x: str, y: str) -> str:
    return f"""(SELECT n, slope, intercept, r2, t, {_t_two_sided('g.t', '(g.n - 2)')} AS p FROM (SELECT CAST(regr_count({y}, {x}) AS BIGINT) AS n, regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept, regr_r2({y}, {x}) AS r2,
  sign(regr_slope({y}, {x})) * sqrt(regr_r2({y}, {x}) * (CAST(regr_count({y}, {x}) AS BIGINT) - 2)) / sqrt(1 - regr_r2({y}, {x})) AS t FROM {source}) g)"""


def _slope_row(source: str, x: str, y: str) -> str:
    return f"SELECT n, round(slope, 8) AS slope, round(intercept, 6) AS intercept, round(r2, 10) AS r_squared, round(t, 6) AS t, round(p, 8) AS p_value FROM {_slope(source, x, y)}"


_CHI = """o AS (SELECT CANAL, LOCAL, count(*) AS o FROM sales GROUP BY 1, 2), a AS (SELECT CANAL, sum(o) AS ra FROM o GROUP BY 1), b AS (SELECT LOCAL, sum(o) AS cb FROM o GROUP BY 1),
  s AS (SELECT sum(power(coalesce(o.o, 0) - e, 2) / e) AS x, (SELECT (count(DISTINCT CANAL) - 1) * (count(DISTINCT LOCAL) - 1) FROM o) AS dof FROM (SELECT a.CANAL, b.LOCAL, CAST(ra AS DOUBLE) * cb / (SELECT sum(o) FROM o) AS e FROM a, b) g LEFT JOIN o ON o.CANAL = g.CANAL AND o.LOCAL = g.LOCAL)"""


def _hypotheses() -> str:
    """The five tests; amounts are far from normal, so groups meet in the rank test."""

    def row(test: str, method: str, statistic: str, p: str, source: str, null: str, other: str) -> str:
        return f"""SELECT '{test}' AS test, '{method}' AS method, round({statistic}, 6) AS statistic, round({p}, 8) AS p_value, 0.05 AS alpha, {p} < 0.05 AS reject_h0, CASE WHEN {p} < 0.05 THEN '{other}' ELSE '{null.replace("'", "''")}' END AS interpretation FROM {source}"""

    def ranks(group: str, a: str, b: str, p: str) -> str:
        rows = f"SELECT {group} = {a} AS first, MONTO_APLICADO AS v FROM sales WHERE {group} IN ({a}, {b})"
        x, y = a.strip("'"), b.strip("'")
        return row(f"compare_MONTO_APLICADO_{x}_{y}", "mann-whitney u", "u", "p", f"(WITH {_ranks(rows)} SELECT u, {p} AS p FROM u)", f"MONTO_APLICADO doesn't differ between {x} and {y}", f"MONTO_APLICADO differs between {x} and {y}")

    def slope(x: str, y: str) -> str:
        return row(f"slope_{x}_{y}", "simple linear regression", "slope", "p", _slope("aged", x, y), f"{x} has no linear effect on {y}", f"{x} has a linear effect on {y}")

    tests = [
        ranks("CANAL", "'APP'", "'WEB'", _normal_sf("u.z_up")),
        slope("PORCENTAJE_DESCUENTO", "UNIDADES"),
        ranks("GENERO", "1", "2", f"least(1, 2 * {_normal_sf('u.z')})"),
        row("chi2_CANAL_LOCAL", "chi-square independence", "x", "p", f"(SELECT x, {_chi_tail('s.x', 's.dof')} AS p FROM s)", "no evidence that CANAL and LOCAL are associated", "CANAL and LOCAL are associated"),
        slope("EDAD", "MONTO_APLICADO"),
    ]
    return f"WITH {_S}, {_AGED}, {_CHI} " + _union(f"({t})" for t in tests)


def _normality(column: str) -> str:
    """Kolmogorov-Smirnov against the sample's own normal, over the 5,000 rows of least digest."""
    return f"""(WITH d AS (SELECT v, row_number() OVER (ORDER BY v) AS i, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS z, count(*) OVER () AS n
    FROM (SELECT CAST({column} AS DOUBLE) AS v FROM sales WHERE {column} IS NOT NULL ORDER BY md5('42|' || ROW_KEY), v LIMIT 5000)),
  q AS (SELECT i, n, 0.5 + sign(z) * abs(z) / 1200 / sqrt(2 * pi()) * sum(CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-power(z * k / 400, 2) / 2)) AS q FROM d, range(401) r(k) GROUP BY i, n, z),
  s AS (SELECT max(greatest(CAST(i AS DOUBLE) / n - q, q - (i - 1.0) / n)) AS d, max(n) AS n FROM q),
  p AS (SELECT d, n, least(1, greatest(0, (SELECT 2 * sum(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * j * j * power((sqrt(s.n) + 0.12 + 0.11 / sqrt(s.n)) * s.d, 2))) FROM range(1, 101) r(j)))) AS p FROM s)
  SELECT '{column}' AS variable, 'kolmogorov-smirnov' AS method, round(d, 8) AS statistic, round(p, 8) AS p_value, n AS n_used, p >= 0.05 AS is_normal_at_05 FROM p)"""


_PARTIAL = """z AS (SELECT i, y - (SELECT avg(y) FROM series) AS z FROM series), k AS (SELECT unnest(range(least(30, (SELECT count(*) // 2 - 1 FROM series)) + 1)) AS lag),
  cov AS (SELECT lag, (SELECT sum(a.z * b.z) FROM z a JOIN z b ON b.i = a.i - lag) AS s FROM k),
  lists AS (SELECT list(s / ((SELECT count(*) FROM series) - lag) ORDER BY lag) AS r, (SELECT count(*) FROM series) AS n, count(*) AS lags FROM cov),
  steps AS (SELECT 0 AS k, CAST([] AS DOUBLE[]) AS phi, r[1] AS err, CAST(1 AS DOUBLE) AS a, r, lags FROM lists
    UNION ALL SELECT k + 1, list_append(list_transform(range(1, len(phi) + 1), lambda j: phi[j] - a1 * phi[len(phi) + 1 - j]), a1), err * (1 - a1 * a1), a1, r, lags
    FROM (SELECT *, (r[k + 2] - coalesce(list_sum(list_transform(range(1, len(phi) + 1), lambda j: phi[j] * r[k + 2 - j])), 0)) / err AS a1 FROM steps WHERE k + 1 < lags))"""


#: Royston's coefficients (AS R94) of the last two weights, and of mean and log deviation of log(1 - W) by log n.
_LAST_WEIGHT, _SECOND_WEIGHT = (0.221157, -0.147981, -2.07119, 4.434685, -2.706056), (0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_W_MEAN, _W_DEVIATION = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def _shapiro(values: str) -> list[str]:
    """CTEs up to ``w`` (w, n): Shapiro-Wilk of rows (e) in ``values``, its normal quantiles by Newton's steps on the integrated density."""
    cte = [f"sw AS (SELECT e, row_number() OVER (ORDER BY e) AS i, count(*) OVER () AS n, avg(e) OVER () AS mean FROM ({values}))"]
    cte.append("z0 AS (SELECT *, 4.91 * (power(p, 0.14) - power(1 - p, 0.14)) AS z FROM (SELECT *, (i - 0.375) / (n + 0.25) AS p FROM sw))")
    for step in range(1, 5):
        below = "0.5 + sign(z) * abs(z) / 1200 / sqrt(2 * pi()) * sum(CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-power(z * k / 400, 2) / 2))"
        cte.append(f"z{step} AS (SELECT e, i, n, mean, p, z - ({below} - p) * sqrt(2 * pi()) * exp(z * z / 2) AS z FROM z{step - 1}, range(401) r(k) GROUP BY e, i, n, mean, p, z)")

    def powers(coefficients, first: int, x: str) -> str:
        return " + ".join(f"({c}) * power({x}, {j})" for j, c in enumerate(coefficients, first))

    cte.append("sm AS (SELECT max(n) AS n, sum(z * z) AS total, max(z) AS z1, max(z) FILTER (WHERE i = n - 1) AS z2 FROM z4)")
    cte.append(f"sa AS (SELECT *, {powers(_LAST_WEIGHT, 1, '(1 / sqrt(n))')} + z1 / sqrt(total) AS a1, {powers(_SECOND_WEIGHT, 1, '(1 / sqrt(n))')} + z2 / sqrt(total) AS a2 FROM sm)")
    cte.append("sp AS (SELECT *, (total - 2 * z1 * z1 - 2 * z2 * z2) / (1 - 2 * a1 * a1 - 2 * a2 * a2) AS phi FROM sa)")
    weight = "CASE WHEN i = 1 THEN -a1 WHEN i = 2 THEN -a2 WHEN i = z4.n - 1 THEN a2 WHEN i = z4.n THEN a1 ELSE z / sqrt(phi) END"
    cte.append(f"w0 AS (SELECT power(sum({weight} * e), 2) / sum(power(e - mean, 2)) AS w, CAST(max(z4.n) AS DOUBLE) AS n FROM z4, sp)")
    cte.append(f"w AS (SELECT w, (ln(1 - w) - ({powers(_W_MEAN, 0, 'ln(n)')})) / exp({powers(_W_DEVIATION, 0, 'ln(n)')}) AS z FROM w0)")
    return cte


def _regression(normal: bool = False) -> str:
    """The full fit by taking out one predictor after another, then putting coefficients together backwards; or its residuals' normality."""
    x = ["UNIDADES", "PORCENTAJE_DESCUENTO", "CANAL_POS", "CANAL_WEB", "LOCAL"]
    k = len(x)
    cte = [
        _S,
        "raw AS (SELECT CAST(UNIDADES AS DOUBLE) AS x0, PORCENTAJE_DESCUENTO AS x1, CASE WHEN CANAL = 'POS' THEN 1.0 ELSE 0.0 END::DOUBLE AS x2, CASE WHEN CANAL = 'WEB' THEN 1.0 ELSE 0.0 END::DOUBLE AS x3, CAST(LOCAL AS DOUBLE) AS x4, MONTO_APLICADO AS y, "
        "row_number() OVER (ORDER BY substr(md5('42|' || ROW_KEY), 1, 13)) AS place, count(*) OVER () AS n FROM sales WHERE PORCENTAJE_DESCUENTO IS NOT NULL)",
        "tr AS (SELECT * FROM raw WHERE place > ceil(0.3 * n)), te AS (SELECT * FROM raw WHERE place <= ceil(0.3 * n))",
        "mean AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in [*(f"x{i}" for i in range(k)), "y"]) + " FROM tr)",
    ]

    def taken_out(name: str, source: str, columns: list[str], targets: list[str]) -> str:
        """Residuals of ``targets`` after one column of ``columns`` at a time; CTEs name_0 ... and the slopes of each step."""
        now = source
        for step, c in enumerate(columns):
            later = [z for z in columns[step + 1 :] + targets]
            cte.append(f"{name}_s{step} AS (SELECT " + ", ".join(f"sum({c} * {z}) / sum({c} * {c}) AS b{step}_{z}" for z in later) + f" FROM {now})")
            cte.append(f"{name}_{step} AS (SELECT " + ", ".join([f"{z} - b{step}_{z} * {c} AS {z}" for z in later] + columns[: step + 1]) + f" FROM {now}, {name}_s{step})")
            now = f"{name}_{step}"
        return now

    cols = [f"x{i}" for i in range(k)]
    cte.append("centred AS (SELECT " + ", ".join(f"{c} - m_{c} AS {c}" for c in [*cols, "y"]) + " FROM tr, mean)")
    left = taken_out("f", "centred", cols, ["y"])
    slopes = ", ".join(f"f_s{i}" for i in range(k))
    # b4 first, then each earlier one less what the later ones hold of it
    names = {}
    for i in reversed(range(k)):
        source = f"c{i + 1}" if i + 1 < k else None
        expression = f"b{i}_y" + "".join(f" - c.beta{j} * b{i}_x{j}" for j in range(i + 1, k))
        held = "".join(f", c.beta{j}" for j in range(i + 1, k))
        cte.append(f"c{i} AS (SELECT {expression} AS beta{i}{held} FROM {slopes}" + (f", {source} c)" if source else ")"))
        names[i] = f"beta{i}"
    line = " + ".join(f"beta{i} * ({{t}}.x{i} - m_x{i})" for i in range(k))
    cte.append(f"te_e AS (SELECT te.y, te.y - m_y - ({line.format(t='te')}) AS e FROM te, c0, mean)")
    cte.append("met AS (SELECT count(*) AS n, sqrt(sum(e * e) / count(*)) AS rmse, avg(abs(e)) AS mae, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2 FROM te_e)")
    if normal:
        cte += _shapiro(f"SELECT tr.y - m_y - ({line.format(t='tr')}) AS e FROM tr, c0, mean WHERE place <= ceil(0.3 * n) + 5000")
        return f"WITH {', '.join(cte)} SELECT round(w, 8) AS shapiro_w, round({_normal_sf('w.z')}, 8) AS shapiro_p FROM w"
    # Breusch-Pagan: squared residuals on the same predictors
    cte.append(f"sq AS (SELECT {', '.join(f'tr.x{i} - m_x{i} AS x{i}' for i in range(k))}, power(tr.y - m_y - ({line.format(t='tr')}), 2) AS e2 FROM tr, c0, mean)")
    cte.append(f"sqc AS (SELECT {', '.join(cols)}, e2 - avg(e2) OVER () AS y FROM sq)")
    end = taken_out("h", "sqc", cols, ["y"])
    cte.append(f"bp AS (SELECT (SELECT count(*) FROM tr) * (1 - (SELECT sum(y * y) FROM {end}) / (SELECT sum(y * y) FROM sqc)) AS s)")
    # five degrees of freedom: the tail in closed form needs the normal one
    root = "sqrt(bp.s)"
    tail = f"2 * {_normal_sf(root)} + sqrt(2 / pi()) * exp(-bp.s / 2) * ({root} + power({root}, 3) / 3)"
    vifs = []
    for i in range(k):
        others = [c for c in cols if c != f"x{i}"]
        last = taken_out(f"v{i}", "centred", others, [f"x{i}"])
        vifs.append(f"SELECT 'vif {x[i]}', round((SELECT sum(x{i} * x{i}) FROM centred) / (SELECT sum(x{i} * x{i}) FROM {last}), 6)")
    intercept = "m_y - (" + " + ".join(f"beta{i} * m_x{i}" for i in range(k)) + ")"
    rows = [
        "SELECT 'rmse' AS name, round(rmse, 4) AS value FROM met", "SELECT 'mae', round(mae, 4) FROM met", "SELECT 'r2_test', round(r2, 4) FROM met",
        f"SELECT 'r2_adjusted', round(1 - (1 - r2) * (n - 1) / (n - {k} - 1), 4) FROM met", "SELECT 'n_train', CAST((SELECT count(*) FROM tr) AS DOUBLE)", "SELECT 'n_test', CAST((SELECT count(*) FROM te) AS DOUBLE)",
        *(f"SELECT 'coefficient {x[i]}', round(beta{i}, 4) FROM c0" for i in range(k)), f"SELECT 'coefficient intercept', round({intercept}, 4) FROM c0, mean", *vifs,
        f"SELECT 'breusch_pagan_p', round({tail}, 6) FROM bp",
    ]
    return f"WITH {', '.join(cte)} " + _union(rows)


_CENTRES = ((-0.8, -0.7), (0.0, 0.8), (1.2, -0.1))
_DISTANCES = [f"power(x - ({a}), 2) + power(y - ({b}), 2)" for a, b in _CENTRES]
_LABELLED = f"""p AS (SELECT CODIGO_CLIENTE, sum(MONTO_APLICADO) AS a, avg(UNIDADES) AS u FROM sales GROUP BY 1),
  xy AS (SELECT CODIGO_CLIENTE, (a - avg(a) OVER ()) / stddev_samp(a) OVER () AS x, (u - avg(u) OVER ()) / stddev_samp(u) OVER () AS y FROM p),
  dd AS (SELECT *, {', '.join(f'{d} AS d{i}' for i, d in enumerate(_DISTANCES))} FROM xy),
  lab AS (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster FROM dd)"""
#: K-means: k from 2 to 7, ten starts each by k-means++ with drawn shares, Lloyd's steps until no centre moves by 1e-4 or twenty have passed.
_SHARE = "(CAST('0x' || substr(md5('42|' || {k} || '|' || {i} || '|' || {step}), 1, 13) AS BIGINT) / 4503599627370496.0)"
_SQUARE = "power(x - p[1], 2) + power(y - p[2], 2)"
_KMEANS = f"""{_LABELLED.split("  dd AS")[0].rstrip().rstrip(",")},
  pts AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || CODIGO_CLIENTE)) - 1 AS r, count(*) OVER () AS n FROM xy),
  seeds AS (SELECT CAST(a.k AS INTEGER) AS k, CAST(b.i AS INTEGER) AS i, 1 AS step, [[x, y]] AS c FROM range(2, 8) a(k), range(10) b(i), pts WHERE r = floor({_SHARE.format(k='a.k', i='b.i', step='0')} * n)
    UNION ALL SELECT k, i, step + 1, list_append(c, [px, py]) FROM (SELECT k, i, step, any_value(c) AS c, arg_min(x, r) AS px, arg_min(y, r) AS py FROM (
      SELECT *, sum(d) OVER (PARTITION BY k, i ORDER BY r ROWS UNBOUNDED PRECEDING) AS cum, sum(d) OVER (PARTITION BY k, i) AS total FROM (
        SELECT k, i, step, c, x, y, r, list_min(list_transform(c, lambda p: {_SQUARE})) AS d FROM seeds, pts WHERE step < k))
      WHERE cum >= {_SHARE.format(k='k', i='i', step='step')} * total GROUP BY k, i, step)),
  steps AS (SELECT k, i, 0 AS it, c, CAST(1 AS DOUBLE) AS moved FROM seeds WHERE step = k
    UNION ALL SELECT k, i, it + 1, m, list_max(list_transform(range(1, k + 1), lambda j: greatest(abs(m[j][1] - c[j][1]), abs(m[j][2] - c[j][2])))) FROM (
      SELECT k, i, it, c, list_transform(range(1, k + 1), lambda j: coalesce(list_filter(l, lambda s: s.j = j)[1].m, c[j])) AS m FROM (
        SELECT k, i, it, any_value(c) AS c, list({{'j': j, 'm': [mx, my]}}) AS l FROM (
          SELECT k, i, it, any_value(c) AS c, j, avg(x) AS mx, avg(y) AS my FROM (
            SELECT k, i, it, c, x, y, list_position(d, list_min(d)) AS j FROM (
              SELECT k, i, it, c, x, y, list_transform(c, lambda p: {_SQUARE}) AS d FROM steps, pts WHERE moved > 1e-4 AND it < 20))
          GROUP BY k, i, it, j) GROUP BY k, i, it))),
  ended AS (SELECT k, i, list_sort(arg_max(c, it)) AS c FROM steps GROUP BY k, i),
  costs AS (SELECT k, i, any_value(c) AS c, sum(list_min(list_transform(c, lambda p: {_SQUARE}))) AS inertia FROM ended, pts GROUP BY k, i),
  best AS (SELECT k, arg_min(c, inertia) AS c, min(inertia) AS inertia FROM costs GROUP BY k),
  lab AS (SELECT k, r, x, y, list_position(d, list_min(d)) - 1 AS cluster FROM (SELECT k, r, x, y, list_transform(c, lambda p: {_SQUARE}) AS d FROM best, pts)),
  size AS (SELECT k, cluster, count(*) AS n FROM lab GROUP BY 1, 2),
  m AS (SELECT a.k, a.r AS id, a.cluster AS own, b.cluster AS other, sum(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) AS d FROM lab a JOIN lab b ON a.k = b.k GROUP BY 1, 2, 3, 4),
  s AS (SELECT m.k, id, max(CASE WHEN own = other THEN d / greatest(n - 1, 1) END) AS inner_, max(CASE WHEN own = other THEN n END) AS n, min(CASE WHEN own <> other THEN d / n END) AS outer_ FROM m JOIN size ON size.k = m.k AND size.cluster = m.other GROUP BY 1, 2),
  elbow AS (SELECT best.k, max(inertia) AS inertia, avg(CASE WHEN n > 1 AND greatest(inner_, outer_) > 0 THEN (outer_ - inner_) / greatest(inner_, outer_) ELSE 0 END) AS silhouette_score FROM best JOIN s ON s.k = best.k GROUP BY best.k)"""
_GROUPED = "count({v}) AS n, avg({v}) AS mean, coalesce(stddev_samp({v}), 0) AS std, quantile_cont({v}, 0.5) AS median, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.75) AS q3, min({v}) AS min, max({v}) AS max"


def _decompose(days: str, digits: int, more: str = "") -> str:
    return f"""WITH {more}{days},
  t AS (SELECT *, CASE WHEN count(*) OVER w = 7 THEN avg(y) OVER w END AS trend FROM series WINDOW w AS (ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  p AS (SELECT i % 7 AS phase, avg(y - trend) AS p FROM t GROUP BY 1), q AS (SELECT phase, p - (SELECT avg(p) FROM p) AS seasonal FROM p)
  SELECT ds, round(y, {digits}) AS observed, round(trend, {digits}) AS trend, round(seasonal, {digits}) AS seasonal, round(y - trend - seasonal, {digits}) AS resid FROM t JOIN q ON t.i % 7 = q.phase"""


_COMPLETE = "d AS (SELECT CAST(UNIDADES AS DOUBLE) AS x0, PORCENTAJE_DESCUENTO AS x1, MONTO_APLICADO AS y, BOLETA % 10 >= 3 AS train FROM sales WHERE PORCENTAJE_DESCUENTO IS NOT NULL)"
_MOMENTS = """m AS (SELECT count(*) AS n, avg(x0) AS a0, avg(x1) AS a1, avg({y}) AS ay, var_pop(x0) AS s00, var_pop(x1) AS s11, covar_pop(x0, x1) AS s01,
  covar_pop(x0, {y}) AS s0y, covar_pop(x1, {y}) AS s1y, var_pop({y}) AS syy FROM {source})"""
_FIT = "f AS (SELECT (s0y * s11 - s1y * s01) / (s00 * s11 - s01 * s01) AS b0, (s1y * s00 - s0y * s01) / (s00 * s11 - s01 * s01) AS b1, * FROM m)"
_TRAINED = f"{_S}, {_COMPLETE}, {_MOMENTS.format(y='y', source='(SELECT * FROM d WHERE train)')}, {_FIT}, b AS (SELECT b0, b1, ay - b0 * a0 - b1 * a1 AS c FROM f)"

ORACLES: dict[str, str] = {
    "sales_view_profile": f"WITH {_S} SELECT CANAL, count(*) AS n, count(DISTINCT CODIGO_CLIENTE) AS customers, round(sum(MONTO_APLICADO), 4) AS total, round(avg(MONTO_APLICADO), 4) AS mean, round(stddev_samp(MONTO_APLICADO), 4) AS std FROM sales GROUP BY CANAL",
    "null_profile": f"WITH {_S} SELECT * FROM ("
    + _union(f"SELECT '{x}' AS variable, count(*) - count({x}) AS nulls FROM sales" for x in ("FECHA", "CANAL", "SKU", "PRODUCTO", "UNIDADES", "PORCENTAJE_DESCUENTO", "MONTO_APLICADO", "BOLETA", "LOCAL", "CODIGO_CLIENTE", "FECHA_NACIMIENTO", "GENERO", "ROW_KEY"))
    + ") WHERE nulls > 0",
    "channel_levels": f"WITH {_S} SELECT DISTINCT CANAL FROM sales WHERE CANAL IS NOT NULL",
    "impute_median_discount": f"WITH {_S}, m AS (SELECT quantile_cont(PORCENTAJE_DESCUENTO, 0.5) AS median FROM sales), f AS (SELECT median, coalesce(PORCENTAJE_DESCUENTO, median) AS d FROM sales, m) SELECT max(median) AS median, count(d) AS n, round(avg(d), 9) AS mean, count(*) FILTER (WHERE d = median) AS at_median FROM f",
    "outliers_iqr": f"WITH {_S}, {_SPIKED}, q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM spiked) SELECT ROW_KEY, round(v, 4) AS MONTO_APLICADO FROM spiked, q WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)",
    "outliers_zscore": f"WITH {_S}, {_SPIKED}, q AS (SELECT avg(v) AS m, stddev_samp(v) AS s FROM spiked) SELECT ROW_KEY, round(v, 4) AS MONTO_APLICADO FROM spiked, q WHERE abs((v - m) / s) > 3",
    "unit_price": f"WITH {_S} SELECT ROW_KEY, round(MONTO_APLICADO / nullif(UNIDADES, 0), 9) AS MONTO_POR_UNIDAD FROM sales",
    "age_at_purchase": f"WITH {_S}, {_AGED} SELECT ROW_KEY, CAST(EDAD AS BIGINT) AS EDAD FROM aged",
    "purchase_frequency": f"WITH {_S}, k AS (SELECT CODIGO_CLIENTE, count(DISTINCT BOLETA) AS n FROM sales GROUP BY 1) SELECT ROW_KEY, n AS FRECUENCIA_COMPRA FROM sales LEFT JOIN k USING (CODIGO_CLIENTE)",
    "standardize": f"WITH {_S}, q AS (SELECT "
    + ", ".join(f"avg({x}) AS m{k}, stddev_samp({x}) AS s{k}" for k, x in enumerate(("MONTO_APLICADO", "UNIDADES", "PORCENTAJE_DESCUENTO")))
    + " FROM sales) SELECT ROW_KEY, "
    + ", ".join(f"round(({x} - m{k}) / s{k}, 6) AS {x}_STD" for k, x in enumerate(("MONTO_APLICADO", "UNIDADES", "PORCENTAJE_DESCUENTO")))
    + " FROM sales, q",
    "store_stats": f"WITH {_S} SELECT LOCAL, count(MONTO_APLICADO) AS n, round(avg(MONTO_APLICADO), 6) AS mean, round(coalesce(stddev_samp(MONTO_APLICADO), 0), 6) AS std, round(quantile_cont(MONTO_APLICADO, 0.5), 6) AS median, round(quantile_cont(MONTO_APLICADO, 0.25), 6) AS q1, round(quantile_cont(MONTO_APLICADO, 0.75), 6) AS q3, round(min(MONTO_APLICADO), 6) AS min, round(max(MONTO_APLICADO), 6) AS max FROM sales WHERE LOCAL IS NOT NULL AND MONTO_APLICADO IS NOT NULL GROUP BY LOCAL",
    "describe_numeric": f"WITH {_S}, {_AGED} " + _union(_describe(x) for x in ("MONTO_APLICADO", "UNIDADES", "PORCENTAJE_DESCUENTO", "EDAD")),
    "corr_pearson": _correlations(_pearson),
    "corr_spearman": _correlations(_spearman),
    "chi2_channel_store": f"WITH {_S}, {_CHI} SELECT round(x, 6) AS statistic, dof, round({_chi_tail('s.x', 's.dof')}, 8) AS p_value FROM s",
    "anova_channel": _anova("CANAL", ", round(power(df2 / (df2 + 2 * f), df2 / 2.0), 8) AS p_value"),
    "anova_store": _anova("LOCAL", f", round({_f_tail('f.f', 'f.df1', 'f.df2')}, 7) AS p_value"),
    "welch_channel": f"""WITH {_S}, g AS (SELECT count(*) FILTER (WHERE CANAL = 'APP') AS n_a, count(*) FILTER (WHERE CANAL = 'WEB') AS n_b, avg(MONTO_APLICADO) FILTER (WHERE CANAL = 'APP') - avg(MONTO_APLICADO) FILTER (WHERE CANAL = 'WEB') AS d,
  var_samp(MONTO_APLICADO) FILTER (WHERE CANAL = 'APP') AS sa, var_samp(MONTO_APLICADO) FILTER (WHERE CANAL = 'WEB') AS sb FROM sales), v AS (SELECT *, sa / n_a AS va, sb / n_b AS vb FROM g),
  w AS (SELECT d / sqrt(va + vb) AS t, power(va + vb, 2) / (power(va, 2) / (n_a - 1) + power(vb, 2) / (n_b - 1)) AS dof, n_a, n_b FROM v)
  SELECT round(t, 8) AS t, round(dof, 4) AS dof, n_a, n_b, round({_t_two_sided('w.t', 'w.dof')}, 8) AS p_value FROM w""",
    "mannwhitney_channel": f"WITH {_S}, " + _rank_test("SELECT CANAL = 'APP' AS first, MONTO_APLICADO AS v FROM sales WHERE CANAL IN ('APP', 'WEB')"),
    "mcar_probe": f"WITH {_S}, " + _rank_test("SELECT PORCENTAJE_DESCUENTO IS NULL AS first, MONTO_APLICADO AS v FROM sales"),
    "slope_discount_units": f"WITH {_S} " + _slope_row("sales", "PORCENTAJE_DESCUENTO", "UNIDADES"),
    "slope_age_amount": f"WITH {_S}, {_AGED} " + _slope_row("aged", "EDAD", "MONTO_APLICADO"),
    "daily_series": f"WITH {_S}, {_SALES_DAYS} SELECT ds, round(y, 4) AS y FROM series",
    "trim_gap": f"""WITH {_S}, {_SALES_DAYS}, q AS (SELECT ds, i, CASE WHEN i BETWEEN 1 AND 60 THEN 0 ELSE y END AS y FROM series),
  w AS (SELECT i, avg(CASE WHEN y <= 0 THEN 1 ELSE 0 END) OVER f AS z, count(*) OVER f AS n FROM q WINDOW f AS (ORDER BY ds ROWS BETWEEN CURRENT ROW AND 27 FOLLOWING)),
  s AS (SELECT coalesce(min(i), 0) AS start FROM w WHERE n = 28 AND z <= 0.5) SELECT min(ds) AS new_start, count(*) AS days, round(sum(y), 2) AS total FROM q, s WHERE i >= start""",
    "decompose": _decompose(_EVENT_DAYS, 4),
    "decompose_sales": _decompose(_SALES_DAYS, 4, f"{_S}, "),
    "acf": f"""WITH {_S}, {_SALES_DAYS}, z AS (SELECT i, y - (SELECT avg(y) FROM series) AS z FROM series), k AS (SELECT unnest(range(least(30, (SELECT count(*) // 2 - 1 FROM series)) + 1)) AS lag)
  SELECT CAST(lag AS INTEGER) AS lag, round((SELECT sum(a.z * b.z) FROM z a JOIN z b ON b.i = a.i - lag) / (SELECT sum(z * z) FROM z), 8) AS acf FROM k""",
    "customer_profile": f"""WITH {_S} SELECT CODIGO_CLIENTE, round(sum(MONTO_APLICADO), 4) AS MONTO_APLICADO_sum, round(avg(MONTO_APLICADO), 1) AS MONTO_APLICADO_mean, round(avg(UNIDADES), 6) AS UNIDADES_mean,
  round(avg(PORCENTAJE_DESCUENTO), 8) AS PORCENTAJE_DESCUENTO_mean, count(DISTINCT BOLETA) AS FRECUENCIA_COMPRA_first FROM sales GROUP BY 1""",
    "ols_fit": f"WITH {_TRAINED} SELECT 'UNIDADES' AS variable, round(b0, 4) AS coefficient FROM b UNION ALL SELECT 'PORCENTAJE_DESCUENTO', round(b1, 4) FROM b UNION ALL SELECT 'intercept', round(c, 4) FROM b",
    "vif": f"WITH {_TRAINED}, v AS (SELECT round(1 / (1 - s01 * s01 / (s00 * s11)), 8) AS vif FROM f) SELECT 'UNIDADES' AS variable, vif FROM v UNION ALL SELECT 'PORCENTAJE_DESCUENTO', vif FROM v",
    "breusch_pagan": f"WITH {_TRAINED}, e AS (SELECT x0, x1, power(y - c - b0 * x0 - b1 * x1, 2) AS e2 FROM d, b WHERE train), {_MOMENTS.format(y='e2', source='e').replace('m AS', 'm2 AS')}, "
    + "g AS (SELECT n * ((s0y * s11 - s1y * s01) * s0y + (s1y * s00 - s0y * s01) * s1y) / (s00 * s11 - s01 * s01) / syy AS s FROM m2) SELECT round(s, 4) AS statistic, round(exp(-s / 2), 8) AS p_value FROM g",
    "reg_metrics": f"WITH {_TRAINED}, e AS (SELECT y, y - c - b0 * x0 - b1 * x1 AS e FROM d, b WHERE NOT train), q AS (SELECT count(*) AS n, sum(e * e) AS sse, avg(abs(e)) AS mae, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2 FROM e) "
    + "SELECT n, round(sqrt(sse / n), 4) AS rmse, round(mae, 4) AS mae, round(r2, 8) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 8) AS r2_adjusted FROM q",
    "standardized_profile": f"WITH {_S}, p AS (SELECT CODIGO_CLIENTE, sum(MONTO_APLICADO) AS a, avg(UNIDADES) AS u FROM sales GROUP BY 1), q AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(u) AS mu, stddev_samp(u) AS su FROM p) SELECT CODIGO_CLIENTE, round((a - ma) / sa, 6) AS z_amount, round((u - mu) / su, 6) AS z_units FROM p, q",
    "hist_bins": f"""WITH {_S}, q AS (SELECT min(MONTO_APLICADO) AS lo, (max(MONTO_APLICADO) - min(MONTO_APLICADO)) / 30 AS w FROM sales), b AS (SELECT CAST(least(floor((MONTO_APLICADO - lo) / w), 29) AS INTEGER) AS bin, count(*) AS n FROM sales, q GROUP BY 1)
  SELECT CAST(k AS INTEGER) AS bin, round(lo + k * w, 4) AS low, round(lo + (k + 1) * w, 4) AS high, coalesce(n, 0) AS n FROM range(30) t(k) CROSS JOIN q LEFT JOIN b ON b.bin = k""",
    "box_stats": f"""WITH {_S}, {_SPIKED}, q AS (SELECT CANAL, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM spiked GROUP BY 1)
  SELECT CANAL, max(n) AS n, round(max(q1), 6) AS q1, round(max(median), 6) AS median, round(max(q3), 6) AS q3, round(min(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high, count(*) FILTER (WHERE NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS fliers FROM spiked JOIN q USING (CANAL) GROUP BY CANAL""",
    "store_differences": f"WITH {_S}, {_SPIKED}, a AS (SELECT LOCAL, {_GROUPED.format(v='MONTO_APLICADO')} FROM sales GROUP BY 1), b AS (SELECT LOCAL, {_GROUPED.format(v='v')} FROM spiked GROUP BY 1) SELECT coalesce(a.LOCAL, b.LOCAL) AS LOCAL FROM a FULL JOIN b ON a.LOCAL = b.LOCAL WHERE coalesce(a.n <> b.n, true) OR "
    + " OR ".join(f"abs(a.{x} - b.{x}) > 1e-9 * greatest(abs(a.{x}), abs(b.{x}))" for x in ("mean", "std", "median", "q1", "q3", "min", "max")),
    "contingency_cells": f"WITH {_S} SELECT CANAL, LOCAL, count(*) AS n FROM sales WHERE CANAL IS NOT NULL AND LOCAL IS NOT NULL GROUP BY 1, 2",
    "infinite_values": f"WITH {_S}, x AS (SELECT *, CASE WHEN BOLETA % 500 = 0 THEN CAST('infinity' AS DOUBLE) ELSE MONTO_APLICADO END AS x FROM sales) "
    + _union(f"SELECT '{c}' AS variable, count(*) FILTER (WHERE isinf(CAST({c} AS DOUBLE))) AS n FROM x" for c in ("MONTO_APLICADO", "PORCENTAJE_DESCUENTO", "UNIDADES", "x")),
    "normality": f"WITH {_S} " + _union(_normality(c) for c in ("MONTO_APLICADO", "UNIDADES", "PORCENTAJE_DESCUENTO")),
    "hypotheses": _hypotheses(),
    "pacf": f"""WITH RECURSIVE {_S}, {_SALES_DAYS}, {_PARTIAL} SELECT CAST(cov.lag AS INTEGER) AS lag, round(cov.s / (SELECT s FROM cov WHERE lag = 0), 8) AS acf, round(a, 8) AS pacf, round(1.96 / sqrt(n), 8) AS band, round(1.96 / sqrt(lists.lags), 8) AS band_ref
  FROM cov JOIN steps ON steps.k = cov.lag, lists""",
    "series_study": f"""WITH {_S}, {_SALES_DAYS},
  w AS (SELECT i, avg(CASE WHEN y <= 0 THEN 1 ELSE 0 END) OVER f AS z, count(*) OVER f AS n FROM series WINDOW f AS (ORDER BY ds ROWS BETWEEN CURRENT ROW AND 27 FOLLOWING)), g AS (SELECT coalesce(min(i), 0) AS start FROM w WHERE n = 28 AND z <= 0.5),
  u AS (SELECT ds, y, i - start AS i FROM series, g WHERE i >= start), t AS (SELECT *, CASE WHEN count(*) OVER w7 = 7 THEN avg(y) OVER w7 END AS trend FROM u WINDOW w7 AS (ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  p AS (SELECT i % 7 AS phase, avg(y - trend) AS p FROM t GROUP BY 1), e AS (SELECT y - trend - (p - (SELECT avg(p) FROM p)) AS e FROM t JOIN p ON t.i % 7 = p.phase),
  zz AS (SELECT i, y - (SELECT avg(y) FROM u) AS z FROM u), l AS (SELECT unnest(range(8)) AS lag)
  SELECT 'days' AS name, CAST((SELECT count(*) FROM series) AS DOUBLE) AS value UNION ALL SELECT 'trimmed_days', CAST(start AS DOUBLE) FROM g UNION ALL SELECT 'residuals', CAST(count(e) AS DOUBLE) FROM e UNION ALL SELECT 'residual_variance', round(avg(e * e), 2) FROM e
  UNION ALL SELECT 'acf ' || lag, round((SELECT sum(a.z * b.z) FROM zz a JOIN zz b ON b.i = a.i - lag) / (SELECT sum(z * z) FROM zz), 8) FROM l""",
    "regression_full": _regression(),
    "residual_normality": _regression(normal=True),
    "train_test_split": f"WITH {_S}, r AS (SELECT ROW_KEY, row_number() OVER (ORDER BY substr(md5('42|' || ROW_KEY), 1, 13)) AS place, count(*) OVER () AS n FROM sales WHERE PORCENTAJE_DESCUENTO IS NOT NULL) SELECT ROW_KEY, CASE WHEN place <= ceil(0.3 * n) THEN 'test' ELSE 'train' END AS part FROM r",
    "kmeans_elbow": f"WITH RECURSIVE {_S}, {_KMEANS} SELECT k, round(inertia, 4) AS inertia, round(silhouette_score, 6) AS silhouette_score FROM elbow",
    "cluster_profile": f"WITH RECURSIVE {_S}, {_KMEANS} SELECT CAST(cluster AS INTEGER) AS cluster, round(avg(x), 6) AS MONTO_APLICADO_sum, round(avg(y), 6) AS UNIDADES_mean, count(*) AS n_clientes FROM lab WHERE k = (SELECT k FROM elbow ORDER BY silhouette_score DESC, k LIMIT 1) GROUP BY 1",
    "clusters_of_centres": f"WITH {_S}, {_LABELLED} SELECT cluster, round(avg(x), 6) AS MONTO_APLICADO_sum, round(avg(y), 6) AS UNIDADES_mean, round(sum(least(d0, d1, d2)), 6) AS inertia, count(*) AS n_clientes FROM lab GROUP BY 1",
    "silhouette_of_centres": f"""WITH {_S}, {_LABELLED}, size AS (SELECT cluster, count(*) AS n FROM lab GROUP BY 1),
  m AS (SELECT a.CODIGO_CLIENTE AS id, a.cluster AS own, b.cluster AS other, sum(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) AS d FROM lab a, lab b GROUP BY 1, 2, 3),
  s AS (SELECT id, own, max(CASE WHEN own = other THEN d / greatest(n - 1, 1) END) AS inner_, max(CASE WHEN own = other THEN n END) AS n, min(CASE WHEN own <> other THEN d / n END) AS outer_ FROM m JOIN size ON size.cluster = m.other GROUP BY 1, 2)
  SELECT round(avg(CASE WHEN n > 1 AND greatest(inner_, outer_) > 0 THEN (outer_ - inner_) / greatest(inner_, outer_) ELSE 0 END), 8) AS silhouette_score FROM s""",
    "density_curve": f"""WITH {_S}, q AS (SELECT min(MONTO_APLICADO) AS lo, max(MONTO_APLICADO) AS hi, count(*) AS n, stddev_samp(MONTO_APLICADO) * power(count(*), -0.2) AS h, (max(MONTO_APLICADO) - min(MONTO_APLICADO)) / 1000 AS w FROM sales),
  b AS (SELECT CAST(least(floor((MONTO_APLICADO - lo) / w), 999) AS INTEGER) AS bin, count(*) AS c FROM sales, q GROUP BY 1), m AS (SELECT lo + (bin + 0.5) * w AS v, c FROM b, q),
  g AS (SELECT lo - 3 * h + k * (hi - lo + 6 * h) / 199 AS x, h, n FROM q, range(200) r(k))
  SELECT round(x, 4) AS x, round(sum(exp(-0.5 * power((x - v) / h, 2)) * c) / (max(n) * max(h) * sqrt(2 * pi())), 12) AS density FROM g, m GROUP BY g.x""",
    "cleaned_rows": f"WITH {_S}, {_SPIKED}, q AS (SELECT quantile_cont(PORCENTAJE_DESCUENTO, 0.5) AS median, quantile_cont(v, 0.25) AS a1, quantile_cont(v, 0.75) AS a3, quantile_cont(UNIDADES, 0.25) AS u1, quantile_cont(UNIDADES, 0.75) AS u3 FROM spiked) "
    "SELECT ROW_KEY, round(coalesce(PORCENTAJE_DESCUENTO, median), 6) AS PORCENTAJE_DESCUENTO, CAST(v < a1 - 1.5 * (a3 - a1) OR v > a3 + 1.5 * (a3 - a1) AS INTEGER) AS amount_out, CAST(UNIDADES < u1 - 1.5 * (u3 - u1) OR UNIDADES > u3 + 1.5 * (u3 - u1) AS INTEGER) AS units_out FROM spiked, q",
    "cleaning_report": f"WITH {_S}, {_SPIKED}, {_ranks('SELECT PORCENTAJE_DESCUENTO IS NULL AS first, v FROM spiked')}, q AS (SELECT quantile_cont(PORCENTAJE_DESCUENTO, 0.5) AS median, quantile_cont(v, 0.25) AS a1, quantile_cont(v, 0.75) AS a3, quantile_cont(UNIDADES, 0.25) AS u1, quantile_cont(UNIDADES, 0.75) AS u3 FROM spiked), "
    "c AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) - count(PORCENTAJE_DESCUENTO) AS DOUBLE) AS d, CAST(count(*) - count(FECHA_NACIMIENTO) AS DOUBLE) AS b, CAST(count(*) FILTER (WHERE v < a1 - 1.5 * (a3 - a1) OR v > a3 + 1.5 * (a3 - a1)) AS DOUBLE) AS ao, CAST(count(*) FILTER (WHERE UNIDADES < u1 - 1.5 * (u3 - u1) OR UNIDADES > u3 + 1.5 * (u3 - u1)) AS DOUBLE) AS uo FROM spiked, q) "
    + _union(f"SELECT '{k}' AS name, {v} AS value FROM {source}" for k, v, source in (
        ("rows_before", "n", "c"), ("rows_after", "n", "c"), ("missing PORCENTAJE_DESCUENTO", "d", "c"), ("missing FECHA_NACIMIENTO", "b", "c"), ("imputed PORCENTAJE_DESCUENTO", "CAST(median AS DOUBLE)", "q"), ("never_imputed FECHA_NACIMIENTO", "b", "c"),
        ("outliers MONTO_APLICADO", "ao", "c"), ("outliers UNIDADES", "uo", "c"), ("probe PORCENTAJE_DESCUENTO", f"round(least(1, 2 * {_normal_sf('u.z')}), 8)", "u"),
    )),
    "engineered_rows": f"WITH {_S}, {_AGED}, k AS (SELECT CODIGO_CLIENTE AS who, count(DISTINCT BOLETA) AS f FROM sales GROUP BY 1), q AS (SELECT "
    + ", ".join(f"avg({x}) AS m{k}, stddev_samp({x}) AS s{k}" for k, x in enumerate(("MONTO_APLICADO", "UNIDADES", "PORCENTAJE_DESCUENTO")))
    + " FROM sales) SELECT ROW_KEY, round(MONTO_APLICADO / nullif(UNIDADES, 0), 9) AS MONTO_POR_UNIDAD, CAST(EDAD AS BIGINT) AS EDAD, f AS FRECUENCIA_COMPRA, "
    + ", ".join(f"round(({x} - m{k}) / s{k}, 6) AS {x}_STD" for k, x in enumerate(("MONTO_APLICADO", "UNIDADES", "PORCENTAJE_DESCUENTO")))
    + " FROM aged JOIN k ON who = CODIGO_CLIENTE, q",
    "scaling": f"WITH {_S} " + _union(f"SELECT '{x}' AS variable, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std FROM sales" for x in ("MONTO_APLICADO", "UNIDADES", "PORCENTAJE_DESCUENTO")),
    "csv_scan": f"WITH {_S} SELECT CANAL, count(*) AS n, count(PORCENTAJE_DESCUENTO) AS discounts, count(b) AS births, min(b) AS first_birth, round(sum(MONTO_APLICADO), 1) AS total, CAST(sum(UNIDADES) AS BIGINT) AS units, count(DISTINCT CODIGO_CLIENTE) AS customers, max(FECHA) AS last, 'x;y' AS run, 'a ' || chr(34) || 'b' || chr(34) AS name "
    "FROM (SELECT *, CASE WHEN CODIGO_CLIENTE % 7 <> 0 THEN FECHA_NACIMIENTO END AS b FROM sales) GROUP BY CANAL",
    "saved_table": f"WITH {_S} SELECT LOCAL, count(MONTO_APLICADO) AS n, round(avg(MONTO_APLICADO), 6) AS mean, round(quantile_cont(MONTO_APLICADO, 0.5), 6) AS median FROM sales GROUP BY 1",
    "scaling_study": f"WITH {_S} SELECT CAST(j AS INTEGER) AS jobs, (SELECT count(DISTINCT LOCAL) FROM sales) AS groups FROM range(1, 3) t(j)",
    "csv_sample": f"WITH {_S}, t AS (SELECT BOLETA FROM sales ORDER BY ROW_KEY LIMIT 20) SELECT CAST(15 AS BIGINT) AS columns, count(*) FILTER (WHERE BOLETA % 3 <> 0) AS rows, count(*) FILTER (WHERE BOLETA % 3 = 0) AS skipped FROM t",
}
ORACLES["stream_days"] = f"WITH {_S} SELECT CAST(FECHA AS DATE) AS ds, round(sum(MONTO_APLICADO), 4) AS y FROM sales GROUP BY 1 HAVING CAST(FECHA AS DATE) + INTERVAL 1 DAY <= (SELECT max(FECHA) FROM sales) - INTERVAL 2 DAY"
ORACLES["saved_report"], ORACLES["saved_model"] = ORACLES["scaling"], ORACLES["ols_fit"]
ORACLES["extrapolability"] = _union(
    [
        f"SELECT 'the regression explains little (adjusted R2 below 0.3)' AS warning FROM ({ORACLES['regression_full']}) WHERE name = 'r2_adjusted' AND value < 0.3",
        f"SELECT 'predictors are collinear (largest variance inflation ' || printf('%.1f', max(value)) || ')' FROM ({ORACLES['regression_full']}) WHERE name LIKE 'vif%' HAVING max(value) > 10",
        f"SELECT 'residuals are not normal' FROM ({ORACLES['residual_normality']}) WHERE shapiro_p < 0.05",
        f"SELECT 'residual variance is not constant' FROM ({ORACLES['regression_full']}) WHERE name = 'breusch_pagan_p' AND value < 0.05",
        f"SELECT CAST(sum(value) AS BIGINT) || ' values are flagged as outliers' FROM ({ORACLES['cleaning_report']}) WHERE name LIKE 'outliers%' HAVING sum(value) > 0",
    ]
)
_FIGURE = f"(SELECT value FROM ({ORACLES['regression_full']}) WHERE name = '{{}}')"
ORACLES["validation_summary"] = f"""SELECT 'linear regression' AS modelo, 'RMSE' AS metrica_principal, {_FIGURE.format('rmse')} AS valor_principal, 'adjusted R2' AS metrica_secundaria, {_FIGURE.format('r2_adjusted')} AS valor_secundario,
  CAST({_FIGURE.format('n_train')} AS BIGINT) AS n_train, CAST({_FIGURE.format('n_test')} AS BIGINT) AS n_test
  UNION ALL SELECT 'k-means', 'silhouette', round(max(silhouette_score), 4), 'k', CAST(arg_max(k, silhouette_score) AS DOUBLE), NULL, NULL FROM ({ORACLES['kmeans_elbow']})"""
