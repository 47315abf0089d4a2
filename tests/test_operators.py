import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillstats import contract as c
from tillstats.operators import describe, features, groupstats, inference, quality, quantiles, regression, segments, timeseries

rng = np.random.default_rng(42)


def frame(spark, schema, rows):
    return spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in rows], schema).repartition(2)


# cleaning


def test_median_imputation(spark):
    df = frame(spark, "PORCENTAJE_DESCUENTO double, MONTO_APLICADO double", [(0.1, 1.0), (0.2, 2.0), (None, 3.0), (0.4, 4.0), (None, 5.0)])
    out, report = quality.handle_missing(df)
    assert sorted(r[0] for r in out.select(c.DISCOUNT).collect()) == [0.1, 0.2, 0.2, 0.2, 0.4]
    assert report.missing == {c.DISCOUNT: 2} and report.imputed == {c.DISCOUNT: 0.2}


def test_birth_dates_stay_null(spark):
    df = frame(spark, "FECHA_NACIMIENTO date, MONTO_APLICADO double", [(dt.date(1990, 1, 1), 1.0), (None, 2.0), (dt.date(1980, 1, 1), 3.0)])
    out, report = quality.handle_missing(df)
    assert out.where("FECHA_NACIMIENTO is null").count() == 1 and report.never_imputed == {c.BIRTH: 1}


@pytest.mark.parametrize("method", ["iqr", "zscore"])
def test_outliers(spark, method):
    df = frame(spark, "MONTO_APLICADO double", [(float(x),) for x in (10, 11, 9, 10, 12, 11, 10, 1000)] + [(None,)])
    rule = quality.iqr_outlier(df, c.AMOUNT) if method == "iqr" else quality.zscore_outlier(df, c.AMOUNT, 2)
    assert [r[0] for r in df.where(rule).collect()] == [1000.0]


def test_constant_and_unknown(spark):
    df = frame(spark, "X double", [(5.0,)] * 4)
    assert df.where(quality.zscore_outlier(df, "X")).count() == 0
    with pytest.raises(ValueError):
        quality.flag_outliers(df, "X", "magic")


def test_nan_counts_as_missing(spark):
    df = frame(spark, "MONTO_APLICADO double, UNIDADES long", [(math.nan, 1), (1.0, 2), (3.0, None)])
    cleaned, report = quality.clean_dataset(df)
    assert report.missing == {c.AMOUNT: 1, c.UNITS: 1} and cleaned.count() == 3 and report.outliers == {c.AMOUNT: 0, c.UNITS: 0}


def test_quantiles_against_numpy(spark):
    values = np.round(rng.lognormal(3, 2, 5_000), 2)
    df = frame(spark, "v double", [(v,) for v in values] + [(None,), (math.nan,)])
    shares = [0, 0.01, 0.25, 0.5, 0.75, 0.999, 1]
    assert quantiles.quantiles(df, "v", shares) == pytest.approx(np.quantile(values, shares).tolist())
    assert quantiles.quantiles(df.limit(0), "v", [0.5]) == [None]


# features


def test_unit_price_and_age(spark):
    df = frame(spark, "k int, MONTO_APLICADO double, UNIDADES long, FECHA timestamp, FECHA_NACIMIENTO date", [
        (1, 1000.0, 2, dt.datetime(2026, 6, 15), dt.date(1996, 12, 25)), (2, 2000.0, 4, dt.datetime(2026, 6, 15), dt.date(1996, 1, 1)),
        (3, 1000.0, 0, dt.datetime(2023, 2, 28), dt.date(2000, 2, 29)), (4, 500.0, 5, dt.datetime(2026, 6, 15), dt.date(2027, 1, 1)), (5, 1.0, None, dt.datetime(2026, 6, 15), dt.date(1700, 1, 1)),
    ])
    rows = features.age_at_purchase(features.unit_price(df)).orderBy("k").collect()
    assert [r[c.UNIT_PRICE] for r in rows] == [500.0, 500.0, None, 100.0, None]
    assert [r[c.AGE] for r in rows] == [29, 30, 22, None, None]


def test_frequency(spark):
    df = frame(spark, "CODIGO_CLIENTE string, BOLETA long", [("C1", 100), ("C1", 100), ("C1", 101), ("C2", 200), (None, 5)])
    rows = features.purchase_frequency(df).collect()
    assert sorted((r[0] or "", r[c.FREQUENCY]) for r in rows) == [("", None), ("C1", 2), ("C1", 2), ("C1", 2), ("C2", 1)]


def test_standardize(spark):
    df = frame(spark, "X double, Y double", [(x, 5.0) for x in (10.0, 20.0, 30.0, 40.0, 50.0)])
    out, p = features.standardize(df, ["X", "Y", "Z"])
    z = [r["X_STD"] for r in out.collect()]
    assert "Y_STD" not in out.columns and p["Y"][1] == 0.0 and np.mean(z) == pytest.approx(0) and np.std(z, ddof=1) == pytest.approx(1)


# groups


def test_group_stats(spark):
    rows = [(1, 5.0), (2, None), (None, 7.0)] + [(3, float(x)) for x in range(1, 10)]
    df = frame(spark, "LOCAL long, MONTO_APLICADO double", rows)
    out = {r["LOCAL"]: r for r in groupstats.group_stats(df).collect()}
    assert set(out) == {1, 3} and out[1]["std"] == 0.0 and out[3]["median"] == 5.0 and out[3]["q1"] == 3.0 and out[3]["n"] == 9
    assert out[3]["std"] == pytest.approx(np.std(range(1, 10), ddof=1))


def test_strategies_agree(spark):
    df = frame(spark, "LOCAL long, MONTO_APLICADO double", [(k, rng.normal(k, 100)) for k, n in ((1, 50), (2, 80), (3, 30)) for _ in range(n)])
    result = groupstats.benchmark(df, 2)
    assert result.groups == 3 and result.efficiency == pytest.approx(result.speedup / 2)
    assert [r["jobs"] for r in groupstats.scaling_study(df, 2, steps=(1, 2, 4)).orderBy("jobs").collect()] == [1, 2]
    other = df.withColumn("MONTO_APLICADO", F.when(F.col("LOCAL") == 2, F.col("MONTO_APLICADO") + 1).otherwise(F.col("MONTO_APLICADO")))
    assert [r[0] for r in groupstats.differences(groupstats.group_stats(df), groupstats.group_stats(other)).collect()] == [2]
    with pytest.raises(AssertionError):
        groupstats.require_equal(groupstats.group_stats(df), groupstats.group_stats(other))


# description


def test_describe(spark):
    df = frame(spark, "X double, Y double", [(float(x), None) for x in range(1, 6)])
    (row,) = describe.describe(df, ["X", "Y", "Z"]).collect()
    assert (row["n"], row["mean"], row["median"]) == (5, 3.0, 3.0) and row["skewness"] == pytest.approx(0) and row["kurtosis"] == pytest.approx(-1.3)


def test_correlations(spark):
    df = frame(spark, "A double, B double, K double", [(float(x), float(6 - x), 1.0) for x in range(1, 6)])
    for method in ("pearson", "spearman"):
        found = {(r["var_i"], r["var_j"]): r for r in describe.correlations(df, ["A", "B", "K", "missing"], method).collect()}
        assert found["A", "B"]["corr"] == pytest.approx(-1) and found["A", "B"]["p_value"] < 0.05
        assert found["A", "A"]["corr"] == 1.0 and found["A", "K"]["corr"] is None
    with pytest.raises(ValueError):
        describe.correlations(df, ["A"], "kendall")


def test_spearman_ties(spark):
    x, y = [1, 2, 2, 5, 7, 7, 7, 9], [3, 1, 4, 1, 5, 9, 2, 6]
    df = frame(spark, "x double, y double", [(float(a), float(b)) for a, b in zip(x, y, strict=True)])

    def ranks(v):
        return [sum(w < a for w in v) + (sum(w == a for w in v) + 1) / 2 for a in v]

    (row,) = describe.spearman(df, "x", "y").collect()
    assert row["corr"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])


def test_plot_data(spark):
    df = frame(spark, "g string, v double", [("a", float(x)) for x in range(1, 11)] + [("a", 100.0), ("b", 1.0), (None, 2.0)])
    bins = describe.histogram_bins(df, "v", 9).orderBy("bin").collect()
    assert sum(r["n"] for r in bins) == 13 and bins[-1]["n"] == 1 and len(bins) == 9
    box = {r["g"]: r for r in describe.box_stats(df, "v", "g").collect()}
    assert box["a"]["fliers"] == 1 and box["a"]["whisker_high"] == 10.0 and set(box) == {"a", "b"}
    curve = describe.density_curve(df, "v").orderBy("x").collect()
    assert sum((b["x"] - a["x"]) * a["density"] for a, b in zip(curve, curve[1:], strict=False)) == pytest.approx(1, abs=0.02)


def test_normality(spark):
    df = frame(spark, "n double, u double, e double", [(rng.normal(100, 15), rng.uniform(), None) for _ in range(500)])
    assert inference.normality(df, "n")["p_value"] > 0.01 and inference.normality(df, "u")["p_value"] < 0.05
    assert inference.normality(df, "e")["p_value"] is None
    large = frame(spark, "v double", [(rng.normal(),) for _ in range(600)])
    found = inference.normality(large, "v", most=500)
    assert found["method"] == "kolmogorov-smirnov" and found["n_used"] == 500 and found["p_value"] > 0.01


def test_sample_is_of_rows(spark):
    """Values with more copies than the sample are all drawn, about as often as they occur, however rows are dealt."""
    df = spark.range(40_000).selectExpr("CASE WHEN id % 8 < 4 THEN 7D WHEN id % 8 < 7 THEN 3D ELSE 5D END AS v")
    drawn = inference.sample(df, df["v"], 1_000, 42)
    share = {v: drawn.count(v) / 1_000 for v in (7.0, 3.0, 5.0)}
    assert len(drawn) == 1_000 and share == pytest.approx({7.0: 0.5, 3.0: 0.375, 5.0: 0.125}, abs=0.06)
    assert sorted(inference.sample(df.repartition(7), df["v"], 1_000, 42)) == sorted(drawn)
    distinct = spark.range(9_000).selectExpr("CAST(id AS DOUBLE) AS v")
    spread = inference.sample(distinct, distinct["v"], 3_000, 1)
    assert len(set(spread)) == 3_000 and np.mean(spread) == pytest.approx(4_500, rel=0.05)
    found = inference.normality(df, "v", most=1_000)
    assert found["statistic"] is not None and found["p_value"] < 0.01


# tests


def test_chi_square(spark):
    alike = frame(spark, "a string, b string", [("xyz"[rng.integers(3)], "pq"[rng.integers(2)]) for _ in range(2_000)])
    assert not inference.chi_square(alike, "a", "b", 0.001)["reject_h0"]
    tied = frame(spark, "a string, b string", [("x", "p")] * 140 + [("x", "q")] * 10 + [("y", "p")] * 10 + [("y", "q")] * 140 + [(None, "q")])
    found = inference.chi_square(tied, "a", "b")
    assert found["reject_h0"] and found["dof"] == 1
    assert found["statistic"] == pytest.approx(4 * (65 - 0.5) ** 2 / 75)


def test_anova(spark):
    same = frame(spark, "g string, v double", [(g, rng.normal(1000, 50)) for g in "abc" for _ in range(100)])
    assert not inference.anova(same, "v", "g", 0.001)["reject_h0"]
    apart = frame(spark, "g string, v double", [("a", rng.normal(1000, 50)) for _ in range(50)] + [("b", rng.normal(5000, 50)) for _ in range(50)] + [("c", None)])
    assert inference.anova(apart, "v", "g")["reject_h0"]


def test_two_groups(spark):
    df = frame(spark, "g string, v double", [("a", rng.normal(1000, 50)) for _ in range(300)] + [("b", rng.normal(1200, 50)) for _ in range(300)])
    found = inference.compare_two_groups(df, "v", "g", "a", "b", alternative="less")
    assert found["reject_h0"] and found["method"] in ("welch t", "mann-whitney u")
    assert inference.compare_two_groups(df, "v", "g", "a", "nobody")["p_value"] is None


def test_mann_whitney_exact_and_tied(spark):
    df = frame(spark, "g string, v double", [("f", float(v)) for v in (19, 22, 16, 29, 24)] + [("m", float(v)) for v in (20, 11, 17, 12)])
    found = inference.mann_whitney(df, "v", "g", "f", "m")
    assert found["statistic"] == 17 and found["p_value"] == pytest.approx(1 / 9)
    tied = frame(spark, "g string, v double", [("f", 1.0)] * 3 + [("m", 1.0)] * 4)
    assert inference.mann_whitney(tied, "v", "g", "f", "m")["p_value"] == 1.0


def test_slopes(spark):
    df = frame(spark, "x double, y double, k double", [(x, 5 + 10 * x + rng.normal(0, 0.1), 1.0) for x in rng.uniform(0, 1, 200)])
    found = inference.slope_test(df, "x", "y")
    assert found["reject_h0"] and found["r_squared"] > 0.9
    flat = inference.slope_test(df, "x", "k")
    assert (flat["slope"], flat["p_value"], flat["zero_variance"]) == (0.0, 1.0, True) and math.isnan(flat["r_squared"])
    assert inference.slope_test(df, "k", "y")["p_value"] is None


# time series


def days(spark, values):
    return frame(spark, "ds date, y double", [(dt.date(2025, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(values)])


def test_daily_series(spark):
    df = frame(spark, "FECHA timestamp, MONTO_APLICADO double", [(dt.datetime(2026, 1, 1, 9), 1000.0), (dt.datetime(2026, 1, 1, 18), 500.0), (dt.datetime(2026, 1, 5), 2000.0)])
    rows = timeseries.daily_series(df).orderBy("ds").collect()
    assert [r["y"] for r in rows] == [1500.0, 0.0, 0.0, 0.0, 2000.0]


def test_leading_gap(spark):
    asleep = days(spark, [100] + [0] * 149 + [100] * 50)
    assert timeseries.gap_report(asleep).trimmed_days == 136
    assert timeseries.gap_report(days(spark, [100] * 100)).trimmed_days == 0
    assert timeseries.trim_leading_gap(asleep).count() == 64


@pytest.mark.parametrize("period", [7, 4])
def test_decomposition(spark, period):
    wave = np.sin(2 * np.pi * np.arange(60) / period)
    parts = timeseries.decompose(days(spark, 100 + np.arange(60) + 10 * wave), period).orderBy("ds").collect()
    assert [r["trend"] for r in parts[10:20]] == pytest.approx(list(np.arange(110, 120)), abs=1e-6)
    assert [r["seasonal"] for r in parts] == pytest.approx(list(10 * wave), abs=1e-6)
    with pytest.raises(ValueError):
        timeseries.decompose(days(spark, [1, 2, 3]), period)


def test_autocorrelation(spark):
    y = rng.normal(100, 10, 100)
    rows = timeseries.acf_pacf(days(spark, y), 10).orderBy("lag").collect()
    z = y - y.mean()
    assert len(rows) == 11 and rows[0]["acf"] == 1.0
    assert [r["acf"] for r in rows] == pytest.approx([z[: 100 - k] @ z[k:] / (z @ z) for k in range(11)])
    g = np.array([z[: 100 - k] @ z[k:] / (100 - k) for k in range(11)])
    for k in (1, 2, 5):
        solved = np.linalg.solve(g[np.abs(np.subtract.outer(range(k), range(k)))], g[1 : k + 1])
        assert rows[k]["pacf"] == pytest.approx(solved[-1])


# regression


def test_design_matrix(spark):
    df = frame(spark, "y double, u double, k double, g string, s long", [(1.0, 1.0, 3.0, "APP", 1), (2.0, 2.0, 3.0, "POS", 2), (3.0, 5.0, 3.0, "WEB", 3), (None, 1.0, 3.0, "WEB", 4)])
    d = regression.design(df, "y", ["u", "k"], ["g", "s"])
    assert d.names == ("u", "s", "g_POS", "g_WEB") and d.dropped == ("k",) and d.rows.count() == 3


def test_regression_against_numpy(spark):
    x = rng.normal(size=(400, 3)) * [1, 10, 1000] + [0, 5, 1e6]
    y = x @ [2.0, -3.0, 0.01] + 7 + rng.normal(size=400)
    df = frame(spark, "y double, a double, b double, c double", [(v, *r) for v, r in zip(y, x, strict=True)])
    d = regression.design(df, "y", ["a", "b", "c"], [])
    model, g = regression.fit(d)
    full = np.column_stack([x, np.ones(400)])
    b = np.linalg.lstsq(full, y, rcond=None)[0]
    assert model.coefficients == pytest.approx(b[:3], rel=1e-6) and model.intercept == pytest.approx(b[3], rel=1e-4)
    e = y - full @ b
    statistic, p = regression.breusch_pagan(d.rows, d.x, F.col("y") - model.predicted())
    aux = np.linalg.lstsq(full, e**2, rcond=None)[0]
    assert statistic == pytest.approx(400 * (1 - ((e**2 - full @ aux) ** 2).sum() / ((e**2 - (e**2).mean()) ** 2).sum()), rel=1e-4) and p > 0.001
    m = regression.metrics(d.rows, model).first()
    assert m["rmse"] == pytest.approx(math.sqrt((e**2).mean())) and m["mae"] == pytest.approx(np.abs(e).mean())
    assert all(v < 1.5 for _, v in regression.vif(g, d.names))


def test_collinear_and_split(spark):
    a = rng.normal(size=500)
    df = frame(spark, "y double, a double, b double, c double", [(v, v, 2 * v + w * 0.01, 2 * v) for v, w in zip(a, rng.normal(size=500), strict=True)])
    d = regression.design(df, "y", ["a", "b", "c"], [])
    inflation = dict(regression.vif(regression.fit(d)[1], d.names))
    assert math.isinf(inflation["a"]) and inflation["b"] > 10
    train, test = regression.split(d.rows, 0.3, 1)
    assert (train.count(), test.count()) == (350, 150)
    again = regression.split(d.rows.repartition(7), 0.3, 1)[1]
    assert sorted(r["y"] for r in test.collect()) == sorted(r["y"] for r in again.collect())


def test_diagnosed_fit_repeats(spark):
    rows = [(1000 + 50 * u + rng.normal(0, 20), int(u), d, "APP POS WEB".split()[k % 3], k % 5) for k, (u, d) in enumerate(zip(rng.integers(1, 9, 300), rng.uniform(0, 0.3, 300), strict=True))]
    df = frame(spark, "MONTO_APLICADO double, UNIDADES long, PORCENTAJE_DESCUENTO double, CANAL string, LOCAL long", rows)
    one, two = regression.fit_and_diagnose(df), regression.fit_and_diagnose(df.repartition(5))
    assert one[2] == pytest.approx(two[2]) and one[0].to_dict() == pytest.approx(two[0].to_dict())
    assert one[2]["r2_test"] > 0.9 and {n for n, _ in one[1].vif} == {"UNIDADES", "PORCENTAJE_DESCUENTO", "LOCAL", "CANAL_POS", "CANAL_WEB"}


# segments


def test_profile(spark):
    df = frame(spark, "CODIGO_CLIENTE string, MONTO_APLICADO double, UNIDADES long, PORCENTAJE_DESCUENTO double", [("C1", 100.0, 1, 0.1), ("C1", 200.0, 3, None), ("C2", None, 1, 0.2), (None, 5.0, 1, 0.1)])
    found = {r[0]: r for r in segments.customer_profile(df).collect()}
    assert found["C1"]["MONTO_APLICADO_sum"] == 300 and found["C1"]["MONTO_APLICADO_mean"] == 150 and found["C2"]["MONTO_APLICADO_sum"] == 0.0 and len(found) == 2


def test_clusters(spark):
    rows = [(f"c{k}-{i}", rng.normal(10 * k, 1), rng.normal(-10 * k, 1)) for k in range(3) for i in range(30)]
    points = segments.standardized(frame(spark, "id string, f1 double, f2 double", rows), ["f1", "f2"]).persist()
    table = segments.elbow_and_silhouette(points, (2, 3, 4), n_init=2)
    found = {r["k"]: r for r in table.collect()}
    assert segments.select_k(table) == 3 and found[2]["inertia"] > found[3]["inertia"] and all(-1 <= r["silhouette_score"] <= 1 for r in found.values())
    profile = segments.cluster_profile(segments.fit_all(points, [3], n_init=2)[3].transform(points), ["f1", "f2"]).collect()
    assert sum(r["n_clientes"] for r in profile) == 90
    with pytest.raises(ValueError):
        segments.elbow_and_silhouette(points, (1, 2))
    points.unpersist()


def test_kmeans_is_a_fixed_point(spark):
    """Each k's centres are the means of the points nearest to them, the inertia is theirs, and more starts never do worse."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(c, 0.4, (60, 2)) for c in ((0, 0), (4, 0), (0, 4), (5, 5))])
    points = segments.standardized(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, f1 double, f2 double"), ["f1", "f2"]).persist()
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    few, many = segments.fit_all(points, range(2, 8), n_init=1), segments.fit_all(points, range(2, 8), n_init=10)
    for k, found in many.items():
        own = found.nearest(z)
        assert len(found.at) == k and found.inertia == pytest.approx(((z - found.at[own]) ** 2).sum()) and found.inertia <= few[k].inertia + 1e-9
        assert np.allclose(found.at, [z[own == c].mean(axis=0) for c in range(k)], atol=0.05)
        assert [r[0] for r in found.transform(points).orderBy("id").select("cluster").collect()] == own.tolist()
    assert many[4].inertia < 30
    points.unpersist()


def test_sampled_points_keep_the_shares_of_equal_ones(spark):
    rows = [(f"C{i}-{v}", float(v), 0.0) for v, n in ((0, 6_000), (1, 3_000), (2, 1_000)) for i in range(n)]
    points = segments.standardized(spark.createDataFrame(rows, "id string, f1 double, f2 double"), ["f1", "f2"])
    x = segments._points(points, 1_000, 42)
    assert len(x) == 1_000 and np.unique(x[:, 0], return_counts=True)[1] == pytest.approx([600, 300, 100], rel=0.25)


@pytest.mark.parametrize("name", ["kmeans_elbow", "cluster_profile"])
def test_registered_clusters_try_every_k_and_start(spark, monkeypatch, name):
    from tillstats.plans import queries

    fit, calls = segments.fit_all, []

    def noted(points, ks, seed=42, n_init=10, **more):
        calls.append((list(ks), n_init))
        return fit(points, ks, seed, n_init, **more)

    rows = [(f"C{i}", float(v), int(u)) for i, (v, u) in enumerate(zip(rng.normal(100, 30, 120), rng.integers(1, 50, 120), strict=True))]
    df = frame(spark, "CODIGO_CLIENTE string, MONTO_APLICADO double, UNIDADES long", rows)
    monkeypatch.setattr(segments, "fit_all", noted)
    monkeypatch.setattr(queries, "sales", lambda *_: df)
    found = queries.QUERIES[name](spark, "").collect()
    assert calls == [(list(range(2, 8)), 10)]
    if name == "kmeans_elbow":
        assert [r["k"] for r in found] == list(range(2, 8))
    else:
        assert sum(r["n_clientes"] for r in found) == 120


def test_silhouette_against_brute_force():
    x, labels = rng.normal(size=(40, 2)), rng.integers(0, 3, 40)
    labels[0] = 7  # a cluster of one
    apart = np.linalg.norm(x[:, None] - x[None], axis=2)
    scores = []
    for i in range(40):
        own = (labels == labels[i]) & (np.arange(40) != i)
        if not own.any():
            scores.append(0.0)
            continue
        a, b = apart[i][own].mean(), min(apart[i][labels == k].mean() for k in set(labels) - {labels[i]})
        scores.append((b - a) / max(a, b))
    assert segments.euclidean_silhouette(x, labels, block=7) == pytest.approx(np.mean(scores))
