"""Registered queries: each applies one operator to its whole input and fixes names and rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contract as c
from ..functions import dist
from ..operators import describe, features, groupstats, inference, quality, regression, segments, timeseries
from ..operators.quantiles import clean
from ..sources import shared
from ..sources.salesview import sales
from . import report

NUMERIC = (c.AMOUNT, c.UNITS, c.DISCOUNT)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _r(name: str | Column, digits: int = 6, alias: str | None = None) -> Column:
    column = F.col(name) if isinstance(name, str) else name
    return F.round(column.cast("double"), digits).alias(alias or name)


def _spiked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with some amounts far out, so that outlier flags are ever true."""
    return sales(spark, sf_dir).withColumn(c.AMOUNT, F.when(F.col(c.RECEIPT) % 500 == 0, F.col(c.AMOUNT) * 50).otherwise(F.col(c.AMOUNT)))


@query
def sales_view_profile(spark, sf_dir):
    df = sales(spark, sf_dir)
    return df.groupBy(c.CHANNEL).agg(F.count("*").alias("n"), F.countDistinct(c.CUSTOMER).alias("customers"), _r(F.sum(c.AMOUNT), 4, "total"), _r(F.avg(c.AMOUNT), 4, "mean"), _r(F.stddev_samp(c.AMOUNT), 4, "std"))


@query
def null_profile(spark, sf_dir):
    return quality.null_profile(sales(spark, sf_dir))


@query
def channel_levels(spark, sf_dir):
    from ..sources.csv import channel_levels as levels

    return spark.createDataFrame([(x,) for x in levels(sales(spark, sf_dir))], "CANAL string")


@query
def impute_median_discount(spark, sf_dir):
    df, median = quality.impute_median(sales(spark, sf_dir), c.DISCOUNT)
    return df.agg(F.lit(median).alias("median"), F.count(c.DISCOUNT).alias("n"), _r(F.avg(c.DISCOUNT), 9, "mean"), F.count_if(F.col(c.DISCOUNT) == median).alias("at_median"))


@query
def outliers_iqr(spark, sf_dir):
    return quality.flag_outliers(_spiked(spark, sf_dir), c.AMOUNT, "iqr").where("MONTO_APLICADO_ES_OUTLIER").select("ROW_KEY", _r(c.AMOUNT, 4))


@query
def outliers_zscore(spark, sf_dir):
    return quality.flag_outliers(_spiked(spark, sf_dir), c.AMOUNT, "zscore").where("MONTO_APLICADO_ES_OUTLIER").select("ROW_KEY", _r(c.AMOUNT, 4))


@query
def unit_price(spark, sf_dir):
    return features.unit_price(sales(spark, sf_dir)).select("ROW_KEY", _r(c.UNIT_PRICE, 9))


@query
def age_at_purchase(spark, sf_dir):
    return features.age_at_purchase(sales(spark, sf_dir)).select("ROW_KEY", c.AGE)


@query
def purchase_frequency(spark, sf_dir):
    return features.purchase_frequency(sales(spark, sf_dir)).select("ROW_KEY", c.FREQUENCY)


@query
def standardize(spark, sf_dir):
    df, _ = features.standardize(sales(spark, sf_dir))
    return df.select("ROW_KEY", *(_r(f"{x}_STD", 6) for x in NUMERIC))


@query
def store_stats(spark, sf_dir):
    stats = groupstats.group_stats(sales(spark, sf_dir))
    return stats.select(c.STORE, "n", *(_r(x, 6) for x in ("mean", "std", "median", "q1", "q3", "min", "max")))


@query
def describe_numeric(spark, sf_dir):
    df = features.age_at_purchase(sales(spark, sf_dir))
    found = describe.describe(df, [*NUMERIC, c.AGE])
    return found.select("variable", "n", *(_r(x, 6) for x in ("mean", "std", "min", "q1", "median", "q3", "max", "skewness", "kurtosis")))


@query
def corr_pearson(spark, sf_dir):
    return describe.correlations(sales(spark, sf_dir), NUMERIC).select("var_i", "var_j", "n", _r("corr", 8), _r("p_value", 8))


@query
def corr_spearman(spark, sf_dir):
    return describe.correlations(sales(spark, sf_dir), NUMERIC, "spearman").select("var_i", "var_j", "n", _r("corr", 8), _r("p_value", 8))


@query
def normality(spark, sf_dir):
    df = sales(spark, sf_dir)
    rows = [inference.normality(df, x, key=F.col("ROW_KEY")) for x in NUMERIC]
    found = spark.createDataFrame([tuple(r.values()) for r in rows], "variable string, method string, statistic double, p_value double, n_used long, is_normal_at_05 boolean")
    return found.withColumns({"statistic": _r("statistic", 8), "p_value": _r("p_value", 8)})


@query
def chi2_channel_store(spark, sf_dir):
    row = inference.chi_square(sales(spark, sf_dir), c.CHANNEL, c.STORE)
    return spark.createDataFrame([(round(row["statistic"], 6), int(row["dof"]), round(row["p_value"], 8))], "statistic double, dof long, p_value double")


@query
def anova_channel(spark, sf_dir):
    row = inference.anova_statistic(sales(spark, sf_dir), c.AMOUNT, c.CHANNEL).first()
    return spark.createDataFrame([(round(row["f"], 8), row["df1"], row["df2"], round(dist.f_sf(row["f"], row["df1"], row["df2"]), 8))], "f double, df1 long, df2 long, p_value double")


@query
def anova_store(spark, sf_dir):
    row = inference.anova_statistic(sales(spark, sf_dir), c.AMOUNT, c.STORE).first()
    return spark.createDataFrame([(round(row["f"], 8), row["df1"], row["df2"], round(dist.f_sf(row["f"], row["df1"], row["df2"]), 7))], "f double, df1 long, df2 long, p_value double")


@query
def welch_channel(spark, sf_dir):
    r = inference.welch(sales(spark, sf_dir), c.AMOUNT, c.CHANNEL, "APP", "WEB")
    return spark.createDataFrame([(round(r["statistic"], 8), round(r["dof"], 4), r["n_a"], r["n_b"], round(r["p_value"], 8))], "t double, dof double, n_a long, n_b long, p_value double")


def _rank_test(spark, df, group, a, b):
    r = inference.mann_whitney(df, c.AMOUNT, group, a, b)
    return spark.createDataFrame([(round(r["statistic"], 1), r["n_a"], r["n_b"], round(r["p_value"], 8))], "u double, n_a long, n_b long, p_value double")


@query
def mannwhitney_channel(spark, sf_dir):
    return _rank_test(spark, sales(spark, sf_dir), c.CHANNEL, "APP", "WEB")


@query
def mcar_probe(spark, sf_dir):
    marked = sales(spark, sf_dir).withColumn("missing", F.col(c.DISCOUNT).isNull())
    return _rank_test(spark, marked, "missing", True, False)


def _slope(df, x, y):
    row = inference.slope_statistic(df, x, y).select("n", _r("slope", 8), _r("intercept", 6), _r("r_squared", 10), _r("t", 6)).first()
    p = inference.slope_test(df, x, y)["p_value"]
    return df.sparkSession.createDataFrame([(*row, round(p, 8))], "n long, slope double, intercept double, r_squared double, t double, p_value double")


@query
def slope_discount_units(spark, sf_dir):
    return _slope(sales(spark, sf_dir), c.DISCOUNT, c.UNITS)


@query
def slope_age_amount(spark, sf_dir):
    return _slope(features.age_at_purchase(sales(spark, sf_dir)), c.AGE, c.AMOUNT)


@query
def hypotheses(spark, sf_dir):
    rows = inference.run_all(features.age_at_purchase(sales(spark, sf_dir)), key=F.col("ROW_KEY"))
    return inference.records(spark, rows).withColumns({"statistic": _r("statistic", 6), "p_value": _r("p_value", 8)})


@query
def daily_series(spark, sf_dir):
    return timeseries.daily_series(sales(spark, sf_dir)).select("ds", _r("y", 4))


def _events(spark, sf_dir):
    return timeseries.daily_series(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "value")


@query
def trim_gap(spark, sf_dir):
    # a series that sleeps for 60 days after its first one
    series = timeseries.daily_series(sales(spark, sf_dir))
    quiet = timeseries.indexed(series).select("ds", F.when(F.col("i").between(1, 60), 0.0).otherwise(F.col("y")).alias("y"))
    return timeseries.trim_leading_gap(quiet).agg(F.min("ds").alias("new_start"), F.count("*").alias("days"), _r(F.sum("y"), 2, "total"))


@query
def decompose(spark, sf_dir):
    return timeseries.decompose(_events(spark, sf_dir)).select("ds", *(_r(x, 4) for x in ("observed", "trend", "seasonal", "resid")))


@query
def decompose_sales(spark, sf_dir):
    return timeseries.decompose(timeseries.daily_series(sales(spark, sf_dir))).select("ds", *(_r(x, 4) for x in ("observed", "trend", "seasonal", "resid")))


@query
def acf(spark, sf_dir):
    return timeseries.acf(timeseries.daily_series(sales(spark, sf_dir))).select("lag", _r("acf", 8))


@query
def pacf(spark, sf_dir):
    return timeseries.acf_pacf(timeseries.daily_series(sales(spark, sf_dir))).select("lag", *(_r(x, 8) for x in ("acf", "pacf", "band", "band_ref")))


@query
def series_study(spark, sf_dir):
    """The whole time series study: gap, trimmed series' correlations and the spread of the residuals."""
    found = timeseries.analyse(sales(spark, sf_dir))
    parts = found.decomposition.agg(F.count("resid").alias("n"), F.avg(F.col("resid") ** 2).alias("m")).first()
    rows = [("days", float(found.daily.count())), ("trimmed_days", float(found.gap.trimmed_days)), ("residuals", float(parts["n"])), ("residual_variance", round(parts["m"], 2))]
    rows += [(f"acf {r['lag']}", round(r["acf"], 8)) for r in found.correlations.where("lag <= 7").collect()]
    return spark.createDataFrame(rows, "name string, value double")


@query
def customer_profile(spark, sf_dir):
    profile = segments.customer_profile(features.purchase_frequency(sales(spark, sf_dir)))
    return profile.select(c.CUSTOMER, _r("MONTO_APLICADO_sum", 4), _r("MONTO_APLICADO_mean", 1), _r("UNIDADES_mean", 6), _r("PORCENTAJE_DESCUENTO_mean", 8), F.col("FRECUENCIA_COMPRA_first").cast("long").alias("FRECUENCIA_COMPRA_first"))


def _modulo(spark, sf_dir):
    """Units and discount against the amount; receipts ending in 0, 1 or 2 are the test rows."""
    d = regression.design(sales(spark, sf_dir), c.AMOUNT, (c.UNITS, c.DISCOUNT), (), F.col(c.RECEIPT))
    return d, d.rows.where("key % 10 >= 3"), d.rows.where("key % 10 < 3")


@query
def ols_fit(spark, sf_dir):
    d, train, _ = _modulo(spark, sf_dir)
    model, _ = regression.fit(d, train)
    return spark.createDataFrame([(k, round(v, 4)) for k, v in model.to_dict().items()], "variable string, coefficient double")


@query
def vif(spark, sf_dir):
    d, train, _ = _modulo(spark, sf_dir)
    return spark.createDataFrame([(k, round(v, 8)) for k, v in regression.vif(regression.fit(d, train)[1], d.names)], "variable string, vif double")


@query
def breusch_pagan(spark, sf_dir):
    d, train, _ = _modulo(spark, sf_dir)
    model, _ = regression.fit(d, train)
    statistic, p = regression.breusch_pagan(train, d.x, F.col("y") - model.predicted())
    return spark.createDataFrame([(round(statistic, 4), round(p, 8))], "statistic double, p_value double")


@query
def reg_metrics(spark, sf_dir):
    d, train, test = _modulo(spark, sf_dir)
    found = regression.metrics(test, regression.fit(d, train)[0])
    return found.select("n", _r("rmse", 4), _r("mae", 4), _r("r2", 8), _r("r2_adjusted", 8))


@query
def regression_full(spark, sf_dir):
    _, diagnostics, found = regression.fit_and_diagnose(sales(spark, sf_dir), key=F.col("ROW_KEY"))
    rows = [*((k, round(v, 4)) for k, v in found.items()), *((f"coefficient {k}", round(v, 4)) for k, v in diagnostics.coefficients.items()), *((f"vif {k}", round(v, 6)) for k, v in diagnostics.vif), ("breusch_pagan_p", round(diagnostics.breusch_pagan_p, 6))]
    return spark.createDataFrame([(k, float(v)) for k, v in rows], "name string, value double")


@query
def residual_normality(spark, sf_dir):
    """Shapiro-Wilk of 5,000 training residuals."""
    _, diagnostics, _ = regression.fit_and_diagnose(sales(spark, sf_dir), key=F.col("ROW_KEY"))
    return spark.createDataFrame([(round(diagnostics.shapiro_w, 8), round(diagnostics.shapiro_p, 8))], "shapiro_w double, shapiro_p double")


@query
def train_test_split(spark, sf_dir):
    d = regression.design(sales(spark, sf_dir), c.AMOUNT, (c.UNITS, c.DISCOUNT), (), F.col("ROW_KEY"))
    train, test = regression.split(d.rows)
    return test.select(F.col("key").alias("ROW_KEY"), F.lit("test").alias("part")).union(train.select("key", F.lit("train")))


def _points(spark, sf_dir):
    return segments.standardized(segments.customer_profile(sales(spark, sf_dir)), segments.FEATURES)


@query
def kmeans_elbow(spark, sf_dir):
    points = _points(spark, sf_dir).persist()
    try:
        return segments.elbow_and_silhouette(points, range(2, 8)).select("k", _r("inertia", 4), _r("silhouette_score", 6))
    finally:
        points.unpersist()


@query
def cluster_profile(spark, sf_dir):
    return segments.segment(sales(spark, sf_dir)).profile.select("cluster", *(_r(x, 6) for x in segments.FEATURES), "n_clientes")


#: Centres in standard units, for the parts of the clustering that don't depend on a random start.
_CENTRES = ((-0.8, -0.7), (0.0, 0.8), (1.2, -0.1))


def _assigned(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    x = vector_to_array("x")
    apart = [(x[0] - a) ** 2 + (x[1] - b) ** 2 for a, b in _CENTRES]
    nearest = F.when((apart[0] <= apart[1]) & (apart[0] <= apart[2]), 0).when(apart[1] <= apart[2], 1).otherwise(2)
    return _points(spark, sf_dir).withColumns({"cluster": nearest, "d2": F.least(*apart)})


@query
def clusters_of_centres(spark, sf_dir):
    labelled = _assigned(spark, sf_dir)
    profile = segments.cluster_profile(labelled, segments.FEATURES)
    inertia = labelled.groupBy("cluster").agg(F.sum("d2").alias("inertia"))
    return profile.join(inertia, "cluster").select("cluster", *(_r(x, 6) for x in (*segments.FEATURES, "inertia")), "n_clientes")


@query
def silhouette_of_centres(spark, sf_dir):
    score = segments.euclidean_silhouette(*segments.sampled(_assigned(spark, sf_dir), 10_000, 42))
    return spark.createDataFrame([(round(score, 8),)], "silhouette_score double")


@query
def standardized_profile(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    v = vector_to_array("x")
    return _points(spark, sf_dir).select(c.CUSTOMER, _r(v[0], 6, "z_amount"), _r(v[1], 6, "z_units"))


@query
def hist_bins(spark, sf_dir):
    return describe.histogram_bins(sales(spark, sf_dir), c.AMOUNT, 30).select("bin", _r("low", 4), _r("high", 4), "n")


@query
def density_curve(spark, sf_dir):
    return describe.density_curve(sales(spark, sf_dir), c.AMOUNT).select(_r("x", 4), _r("density", 12))


@query
def box_stats(spark, sf_dir):
    found = describe.box_stats(_spiked(spark, sf_dir), c.AMOUNT, c.CHANNEL)
    return found.select(c.CHANNEL, "n", *(_r(x, 6) for x in ("q1", "median", "q3", "whisker_low", "whisker_high")), "fliers")


@query
def store_differences(spark, sf_dir):
    """Stores whose statistics change if amounts are spiked: the comparison of two results."""
    return groupstats.differences(groupstats.group_stats(sales(spark, sf_dir)), groupstats.group_stats(_spiked(spark, sf_dir)))


@query
def contingency_cells(spark, sf_dir):
    return inference.contingency(sales(spark, sf_dir), c.CHANNEL, c.STORE).select(F.col("a").alias("CANAL"), F.col("b").alias("LOCAL"), F.col("o").alias("n"))


@query
def infinite_values(spark, sf_dir):
    from ..sources.checks import infinite_counts

    df = sales(spark, sf_dir).withColumn("x", F.when(F.col(c.RECEIPT) % 500 == 0, F.lit(float("inf"))).otherwise(clean(c.AMOUNT)))
    return spark.createDataFrame(sorted(infinite_counts(df, [*NUMERIC, "x"]).items()), "variable string, n long")


@query
def cleaned_rows(spark, sf_dir):
    """Imputation and flags together."""
    df, _ = quality.clean_dataset(_spiked(spark, sf_dir))
    return df.select("ROW_KEY", _r(c.DISCOUNT, 6), F.col("MONTO_APLICADO_ES_OUTLIER").cast("int").alias("amount_out"), F.col("UNIDADES_ES_OUTLIER").cast("int").alias("units_out"))


@query
def cleaning_report(spark, sf_dir):
    _, r = quality.clean_dataset(_spiked(spark, sf_dir))
    rows = [("rows_before", r.rows_before), ("rows_after", r.rows_after)]
    for part in ("missing", "imputed", "never_imputed", "outliers"):
        rows += [(f"{part} {k}", v) for k, v in getattr(r, part).items()]
    rows += [(f"probe {k}", round(v["p_value"], 8)) for k, v in r.missingness_probes.items()]
    return spark.createDataFrame([(k, float(v)) for k, v in rows], "name string, value double")


@query
def engineered_rows(spark, sf_dir):
    df, _ = features.engineer(sales(spark, sf_dir))
    return df.select("ROW_KEY", _r(c.UNIT_PRICE, 9), c.AGE, c.FREQUENCY, *(_r(f"{x}_STD", 6) for x in NUMERIC))


@query
def scaling(spark, sf_dir):
    _, parameters = features.standardize(sales(spark, sf_dir))
    return spark.createDataFrame([(k, round(m, 6), round(d, 6)) for k, (m, d) in parameters.items()], "variable string, mean double, std double")


def _as_file(spark, sf_dir, folder):
    """The sales as a delimited file with the raw header, whose birth dates are partly no dates and one line too long."""
    df = sales(spark, sf_dir).withColumns({"RUN_CLIENTE": F.lit("x;y"), "NOMBRES": F.lit('a "b"'), "APELLIDOS": F.lit(None).cast("string")})
    born = F.when(F.col(c.CUSTOMER) % 7 == 0, F.lit("no date")).otherwise(F.date_format(c.BIRTH, c.BIRTH_FORMAT))
    raw = [(born if name == c.BIRTH else F.col(name)).alias(header) for header, name, _ in c.CONTRACT]
    df.select(*raw).write.mode("overwrite").csv(folder, sep=c.SEPARATOR, quote=c.QUOTE, escape=c.QUOTE, header=True)
    return folder


@query
def csv_scan(spark, sf_dir):
    from ..sources import csv

    df = csv.load(spark, _as_file(spark, sf_dir, shared.new_folder(spark, "sales")))
    return df.groupBy(c.CHANNEL).agg(
        F.count("*").alias("n"), F.count(c.DISCOUNT).alias("discounts"), F.count(c.BIRTH).alias("births"), F.min(c.BIRTH).alias("first_birth"), _r(F.sum(c.AMOUNT), 1, "total"),
        F.sum(c.UNITS).alias("units"), F.countDistinct(c.CUSTOMER).alias("customers"), F.max(c.DATE).alias("last"), F.min("RUN_CLIENTE").alias("run"), F.min("NOMBRES").alias("name"),
    )


@query
def saved_table(spark, sf_dir):
    """A table written by a sink and read again."""
    from ..sources import sinks

    path = sinks.save_table(groupstats.group_stats(sales(spark, sf_dir)), "stores", shared.new_folder(spark, "tables"))
    return spark.read.csv(path, header=True, schema="LOCAL long, n long, mean double, std double, median double, q1 double, q3 double, min double, max double").select(c.STORE, "n", _r("mean", 6), _r("median", 6))


@query
def scaling_study(spark, sf_dir):
    """Groups of the sequential and the parallel form; their times differ from run to run."""
    return groupstats.scaling_study(sales(spark, sf_dir), 2, steps=(1, 2)).select("jobs", "groups")


@query
def csv_sample(spark, sf_dir):
    """Header, well-formed and skipped lines of a file's beginning; the file has one line too long."""
    from ..sources import csv, sinks

    folder = shared.new_folder(spark, "sample")
    lines = [c.SEPARATOR.join(c.RAW_COLUMNS)]
    for r in sales(spark, sf_dir).orderBy("ROW_KEY").limit(20).select(c.RECEIPT, c.STORE).collect():
        lines.append(c.SEPARATOR.join(["", "WEB", "1", "p", "1", "0", "1", str(r[0]), str(r[1])] + [""] * (len(c.RAW_COLUMNS) - 9 + (r[0] % 3 == 0))))
    sinks.write_text("\n".join(lines) + "\n", "sales.csv", folder)
    found = csv.read_sample(spark, f"{folder}/sales.csv")
    return spark.createDataFrame([(len(found.header), found.rows, found.skipped)], "columns long, rows long, skipped long")


@query
def saved_report(spark, sf_dir):
    """A report written as JSON and read again."""
    from ..sources import sinks

    _, parameters = features.standardize(sales(spark, sf_dir))
    path = sinks.save_json({k: {"mean": m, "std": d} for k, (m, d) in parameters.items()}, "scaling", shared.new_folder(spark, "reports"))
    whole = spark.read.json(path, multiLine=True)
    return whole.select(F.explode(F.array(*(F.struct(F.lit(k).alias("variable"), F.col(f"`{k}`.mean").alias("mean"), F.col(f"`{k}`.std").alias("std")) for k in parameters))).alias("r")).select("r.variable", _r("r.mean", 6, "mean"), _r("r.std", 6, "std"))


@query
def saved_model(spark, sf_dir):
    """A fitted model written as JSON and read again."""
    from ..sources import sinks

    d, train, _ = _modulo(spark, sf_dir)
    model, _ = regression.fit(d, train)
    names = list(model.to_dict())
    whole = spark.read.json(sinks.save_model(model.to_dict(), "model", shared.new_folder(spark, "models")), multiLine=True)
    return whole.select(F.explode(F.array(*(F.struct(F.lit(k).alias("variable"), F.round(f"`{k}`", 4).alias("coefficient")) for k in names))).alias("r")).select("r.*")


@query
def extrapolability(spark, sf_dir):
    """The rules that fire for the full regression and the spiked sales' cleaning."""
    _, cleaning = quality.clean_dataset(_spiked(spark, sf_dir))
    _, diagnostics, metrics = regression.fit_and_diagnose(sales(spark, sf_dir), key=F.col("ROW_KEY"))
    return spark.createDataFrame([(w,) for w in report.extrapolability(metrics, diagnostics, cleaning)["advertencias"]], "warning string")


@query
def validation_summary(spark, sf_dir):
    df = sales(spark, sf_dir)
    _, _, metrics = regression.fit_and_diagnose(df, key=F.col("ROW_KEY"))
    found = report.validation_summary(spark, metrics, segments.segment(df))
    return found.withColumns({"valor_principal": _r("valor_principal", 4), "valor_secundario": _r("valor_secundario", 4)})


@query
def stream_days(spark, sf_dir):
    """Daily sums of the sales as a stream: the days whose watermark has passed, written once each."""
    from ..streaming import daily

    source, out, state = (shared.new_folder(spark, x) for x in ("stream", "days", "state"))
    sales(spark, sf_dir).select(c.DATE, c.AMOUNT).write.parquet(source)
    stream = spark.readStream.schema(f"{c.DATE} timestamp, {c.AMOUNT} double").parquet(source)
    daily.write(daily.daily_sums(stream), out, state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("ds date, y double").parquet(out).select("ds", _r("y", 4))
