"""Operators against plain versions where they narrow, halve, sum by batches or refuse."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillstats.operators import features, groupstats, inference, quantiles, ranks, regression
from tillstats.sources import csv, shared, sinks

rng = np.random.default_rng(17)


@pytest.fixture(scope="module")
def grouped(spark):
    rows = [(0, float(v)) for v in rng.normal(size=8_000)] + [(1, float(v)) for v in np.round(rng.normal(size=5_000), 1)] + [(2, float(v)) for v in rng.normal(size=7)]
    rows += [(3, 5.0), (None, 1.0), (4, None), (6, float("nan"))] + [(5, v) for v in [1.0] * 900 + [2.0] * 300]
    return rows, spark.createDataFrame(rows, "g int, v double").repartition(4).persist()


@pytest.mark.parametrize("most", [200_000, 300, 20])
def test_grouped_quantiles(monkeypatch, grouped, most):
    """The same at any bound, whether brackets are narrowed never, once or often."""
    monkeypatch.setattr(quantiles, "MOST_VALUES", most)
    rows, df = grouped
    shares = [0.25, 0.5, 0.75, 0.0, 1.0, 0.9]
    found = quantiles.grouped_quantiles(df.select("g", quantiles.clean("v").alias("v")), "g", "v", shares)
    assert "percentile(" not in found._jdf.queryExecution().executedPlan().toString()
    found = {r["g"]: [r[f"q{k}"] for k in range(len(shares))] for r in found.collect()}
    assert set(found) == {0, 1, 2, 3, 5}
    for g, own in found.items():
        assert own == pytest.approx(np.quantile([v for k, v in rows if k == g], shares).tolist())


def test_group_statistics_hold_no_group(grouped):
    plan = groupstats.group_stats(grouped[1], "g", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_grouped_quantiles_of_nothing(spark):
    assert quantiles.grouped_quantiles(spark.createDataFrame([], "g int, v double"), "g", "v", [0.5]).count() == 0


def test_ranges_by_halving(spark):
    bounds = sorted(rng.normal(size=63).tolist())
    values = [*rng.normal(size=200).tolist(), *bounds, -9.0, 9.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", ranks._range(F.col("v"), bounds, 0).alias("r"))
    assert all(r["r"] == sum(b < r["v"] for b in bounds) for r in df.collect())
    assert spark.range(1).select(ranks._range(F.col("id"), [], 0).alias("r")).first()["r"] == 0


@pytest.mark.parametrize("cells", [{("a", "x"): 30, ("a", "y"): 10, ("b", "x"): 5, ("b", "y"): 25}, {("a", "x"): 12, ("b", "x"): 3, ("b", "y"): 9}, {("a", "y"): 4, ("b", "x"): 4}])
def test_chi_square_of_four_cells(spark, cells):
    """Yates' correction cell by cell, empty cells included."""
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "p string, q string")
    row = inference.chi_square_statistic(df, "p", "q").first()
    n = sum(cells.values())
    expected = 0.0
    for a in "ab":
        for b in "xy":
            e = sum(c for k, c in cells.items() if k[0] == a) * sum(c for k, c in cells.items() if k[1] == b) / n
            gap = abs(cells.get((a, b), 0) - e)
            expected += (gap - min(0.5, gap)) ** 2 / e
    assert row["dof"] == 1 and row["statistic"] == pytest.approx(expected)


def test_chi_square_makes_no_grid(spark):
    df = spark.range(2_000).select((F.col("id") % 40).alias("p"), (F.col("id") % 50).alias("q"))
    plan = inference.chi_square_statistic(df, "p", "q")._jdf.queryExecution().optimizedPlan().toString()
    row = inference.chi_square_statistic(df, "p", "q").first()
    assert row["dof"] == 39 * 49 and "Cross" not in plan.replace("Join Cross", "", 3)


def test_sample_keeps_shares(spark):
    """A discrete column's sample holds its values as often as the column does."""
    df = spark.range(40_000).select("id", F.when(F.col("id") % 10 < 6, 1.0).when(F.col("id") % 10 < 9, 2.0).otherwise(3.0).alias("v")).repartition(5)
    one, two = (inference.sample(d, F.col("v"), 5_000, 42, F.col("id")) for d in (df, df.repartition(2)))
    assert sorted(one) == sorted(two) and len(one) == 5_000
    assert [one.count(v) / 5_000 for v in (1.0, 2.0, 3.0)] == pytest.approx([0.6, 0.3, 0.1], abs=0.03)
    found = inference.normality(df, "v", key=F.col("id"))
    assert found["method"] == "kolmogorov-smirnov" and found["statistic"] > 0.3 and found["p_value"] < 1e-6


def test_products_of_many_columns(spark, monkeypatch):
    x = rng.normal(size=(500, 6))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{k} double" for k in range(6))).repartition(3)
    names = [f"c{k}" for k in range(6)]
    narrow = regression.gram(df, names)
    monkeypatch.setattr(regression, "MOST_PRODUCTS", 3)
    wide = regression.gram(df, names)
    centred = x - x.mean(axis=0)
    assert np.allclose(narrow.cross, centred.T @ centred) and np.allclose(wide.cross, narrow.cross) and wide.n == 500


def test_levels_are_bounded(spark, monkeypatch):
    df = spark.range(60).select((F.col("id") * 1.5).alias("y"), F.col("id").cast("double").alias("x"), F.concat(F.lit("l"), F.col("id")).alias("c"))
    monkeypatch.setattr(regression, "MOST_LEVELS", 50)
    with pytest.raises(ValueError, match="levels"):
        regression.design(df, "y", ("x",), ("c",))
    monkeypatch.setattr(csv, "MOST_LEVELS", 50)
    with pytest.raises(ValueError, match="distinct"):
        csv.channel_levels(df, "c")


def test_split_is_exact_and_stable(spark):
    df = spark.range(1_001).select(F.col("id").alias("key"), F.col("id").cast("double").alias("y"))
    (train, test), (_, again) = regression.split(df, 0.3, 42), regression.split(df.repartition(7), 0.3, 42)
    ids = {r["key"] for r in test.collect()}
    assert len(ids) == math.ceil(0.3 * 1_001) and train.count() == 1_001 - len(ids) and ids == {r["key"] for r in again.collect()}


def test_frequency_replaces_its_column(spark):
    df = spark.createDataFrame([("a", 1, 9), ("a", 2, 9), ("b", 1, 9), (None, 1, 9)], "CODIGO_CLIENTE string, BOLETA long, FRECUENCIA_COMPRA long")
    out = features.purchase_frequency(df)
    assert out.columns.count("FRECUENCIA_COMPRA") == 1 and sorted(out.select("CODIGO_CLIENTE", "FRECUENCIA_COMPRA").collect(), key=str) == sorted([("a", 2), ("a", 2), ("b", 1), (None, None)], key=str)


def test_sinks_write_where_spark_does(spark):
    folder = shared.new_folder(spark, "out")
    assert "://" in folder
    path = sinks.save_table(spark.range(3), "t", folder)
    assert spark.read.csv(path, header=True).count() == 3
    report = sinks.save_json({"a": "é"}, "r", folder)
    assert spark.read.json(report, multiLine=True).first()["a"] == "é"


def test_quoted_fields_survive(spark, tmp_path):
    from tillstats import contract as c

    header = c.SEPARATOR.join(c.RAW_COLUMNS)
    row = '2026-01-01 10:00:00;WEB;1;"a ""b""; c";2;0.1;100;5;7;C1;x;n;s;1990-01-01;1'
    path = tmp_path / "s.csv"
    path.write_text(f"{header}\n{row}\n{row};more\n")
    rows = csv.load(spark, str(path)).collect()
    assert len(rows) == 1 and rows[0]["PRODUCTO"] == 'a "b"; c'
