"""Hypothesis tests: statistics by aggregation, tail probabilities on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contract
from ..functions import dist
from .quantiles import clean
from .ranks import cumulative, midranks, range_bounds

RECORD = "test string, method string, statistic double, p_value double, alpha double, reject_h0 boolean, interpretation string"
#: Values up to which the exact distribution of the rank test is used, without ties.
EXACT_RANKS = 8
_MOST_ARRANGEMENTS = 2_000_000


def record(test: str, method: str, statistic: float | None, p_value: float | None, alpha: float, null: str, other: str) -> dict[str, Any]:
    """The row of one test; an unknown p rejects nothing."""
    reject = p_value is not None and p_value < alpha
    return {"test": test, "method": method, "statistic": statistic, "p_value": p_value, "alpha": alpha, "reject_h0": reject, "interpretation": other if reject else null}


def records(spark: SparkSession, rows: list[dict[str, Any]]) -> DataFrame:
    names = [part.split(" ")[0] for part in RECORD.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], RECORD)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, o): the observed cells in long form, rows with a null left out."""
    return df.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("o"))


def chi_square_statistic(df: DataFrame, a: str, b: str) -> DataFrame:
    """(statistic, dof, n): Pearson's statistic, with Yates' correction at one degree of freedom.

    Empty cells need not exist: the sum of (o - e)^2 / e is the sum of o^2 / e, less n. At one degree of freedom one cell and the
    margins say everything, since all four cells are equally far from what is expected.
    """
    cells = contingency(df, a, b)
    rows, columns = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("cb"))
    joined = cells.join(rows, "a").join(columns, "b").agg(F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("cb")).cast("double")).alias("s"))
    total = cells.agg(F.coalesce(F.sum("o"), F.lit(0)).alias("n"), F.countDistinct("a").alias("na"), F.countDistinct("b").alias("nb"), F.min("a").alias("a0"), F.min("b").alias("b0"))
    first_row, first_column = F.col("a") == F.col("a0"), F.col("b") == F.col("b0")
    corner = cells.crossJoin(F.broadcast(total.select("a0", "b0"))).agg(
        *(F.coalesce(F.sum(F.when(c, F.col("o"))), F.lit(0)).cast("double").alias(k) for k, c in (("o", first_row & first_column), ("r", first_row), ("c", first_column)))
    )
    n = F.col("n").cast("double")
    expected = F.col("r") * F.col("c") / n
    gap = F.abs(F.col("o") - expected)
    gap = gap - F.least(F.lit(0.5), gap)
    yates = F.try_divide(gap * gap * n * n * n, F.col("r") * F.col("c") * (n - F.col("r")) * (n - F.col("c")))
    dof = (F.col("na") - 1) * (F.col("nb") - 1)
    plain = F.greatest(F.lit(0.0), F.col("n") * F.col("s") - F.col("n"))
    single = total.crossJoin(joined).crossJoin(corner)  # one row each
    return single.select(F.when(dof == 1, yates).when(dof == 0, F.lit(0.0)).otherwise(plain).alias("statistic"), dof.alias("dof"), "n")


def chi_square(df: DataFrame, a: str, b: str, alpha: float = contract.ALPHA) -> dict[str, Any]:
    row = chi_square_statistic(df, a, b).first()
    p = None if not row["n"] else 1.0 if not row["dof"] else dist.chi2_sf(row["statistic"], row["dof"])
    out = record(f"chi2_{a}_{b}", "chi-square independence", row["statistic"], p, alpha, f"no evidence that {a} and {b} are associated", f"{a} and {b} are associated")
    return out | {"dof": row["dof"]}


def anova_statistic(df: DataFrame, value: str, group: str) -> DataFrame:
    """(f, df1, df2) from each group's count, mean and variance; null keys and empty groups don't count."""
    rows = df.select(F.col(group).alias("g"), clean(value).alias("v")).where("g is not null and v is not null")
    groups = rows.groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("s2"))
    # centred on the grand mean, so that large means don't cancel
    grand = groups.agg(F.sum("n").alias("nn"), F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("mm"), F.count("*").alias("k"))
    sums = groups.crossJoin(F.broadcast(grand)).agg(F.sum(F.col("n") * (F.col("m") - F.col("mm")) ** 2).alias("ssb"), F.sum((F.col("n") - 1) * F.col("s2")).alias("ssw"), F.max("nn").alias("nn"), F.max("k").alias("k"))
    df1, df2 = F.col("k") - 1, F.col("nn") - F.col("k")
    return sums.select(F.try_divide(F.try_divide(F.col("ssb"), df1), F.try_divide(F.col("ssw"), df2)).alias("f"), df1.alias("df1"), df2.alias("df2"))


def anova(df: DataFrame, value: str, group: str, alpha: float = contract.ALPHA) -> dict[str, Any]:
    row = anova_statistic(df, value, group).first()
    p = None if row["f"] is None else dist.f_sf(row["f"], row["df1"], row["df2"])
    return record(f"anova_{value}_{group}", "one-way analysis of variance", row["f"], p, alpha, f"{value} doesn't differ between groups of {group}", f"{value} differs between groups of {group}")


def two_groups(df: DataFrame, value: str, group: str, a: Any, b: Any) -> DataFrame:
    """(first, v): values of the two groups."""
    key = F.col(group)
    return df.select((key == F.lit(a)).alias("first"), clean(value).alias("v"), key.alias("g")).where((F.col("g") == F.lit(a)) | (F.col("g") == F.lit(b))).where("v is not null").select("first", "v")


def welch_statistic(df: DataFrame, value: str, group: str, a: Any, b: Any) -> DataFrame:
    """(t, dof, n_a, n_b) for unequal variances."""
    rows = two_groups(df, value, group, a, b)
    x, y = F.when(F.col("first"), F.col("v")), F.when(~F.col("first"), F.col("v"))
    m = rows.agg(*(f(c).alias(f"{k}{s}") for s, c in (("a", x), ("b", y)) for k, f in (("n", F.count), ("m", F.avg), ("s", F.var_samp))))
    va, vb = F.try_divide(F.col("sa"), F.col("na")), F.try_divide(F.col("sb"), F.col("nb"))
    t = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(va + vb))
    dof = F.try_divide((va + vb) ** 2, F.try_divide(va**2, F.col("na") - 1) + F.try_divide(vb**2, F.col("nb") - 1))
    return m.select(t.alias("t"), dof.alias("dof"), F.col("na").alias("n_a"), F.col("nb").alias("n_b"))


def welch(df: DataFrame, value: str, group: str, a: Any, b: Any, alternative: str = "two-sided") -> dict[str, Any]:
    row = welch_statistic(df, value, group, a, b).first()
    t, dof = row["t"], row["dof"]
    p = None if t is None else dist.two_sided(dist.t_sf, t, dof) if alternative == "two-sided" else dist.t_sf(t if alternative == "greater" else -t, dof)
    return {"statistic": t, "p_value": p, "dof": dof, "n_a": row["n_a"], "n_b": row["n_b"]}


def rank_sums(df: DataFrame, value: str, group: str, a: Any, b: Any) -> DataFrame:
    """(u, n_a, n_b, ties): U of the first group and the sum of t^3 - t over tied values, from the value histogram."""
    rows = two_groups(df, value, group, a, b)
    histogram = rows.groupBy("v").agg(F.count_if("first").alias("x"), F.count("*").alias("n"))
    ranked = midranks(histogram, "v", "n", range_bounds(df, {"v": clean(value)})["v"])
    t = F.col("n").cast("double")
    sums = ranked.agg(
        F.coalesce(F.sum("x"), F.lit(0)).alias("n_a"),
        F.coalesce(F.sum(F.col("n") - F.col("x")), F.lit(0)).alias("n_b"),
        F.coalesce(F.sum(F.col("x") * F.col("rank")), F.lit(0.0)).alias("r"),
        F.coalesce(F.sum(t * t * t - t), F.lit(0.0)).alias("ties"),
    )
    return sums.select((F.col("r") - F.col("n_a") * (F.col("n_a") + 1) / 2).alias("u"), "n_a", "n_b", "ties")


def mann_whitney(df: DataFrame, value: str, group: str, a: Any, b: Any, alternative: str = "two-sided") -> dict[str, Any]:
    """U of the first group; exact for a small group without ties, else normal with tie and continuity correction."""
    row = rank_sums(df, value, group, a, b).first()
    n1, n2, u, ties = int(row["n_a"]), int(row["n_b"]), row["u"], row["ties"]
    out = {"statistic": u, "p_value": None, "n_a": n1, "n_b": n2}
    if not n1 or not n2:
        return out
    if min(n1, n2) <= EXACT_RANKS and not ties and n1 * n2 <= _MOST_ARRANGEMENTS:
        up, down = dist.mann_whitney_exact_sf(u, n1, n2), dist.mann_whitney_exact_sf(n1 * n2 - u, n1, n2)
    else:
        n = n1 + n2
        sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
        if not sd:
            return out | {"p_value": 1.0}
        up, down = (dist.normal_sf((x - n1 * n2 / 2 - 0.5) / sd) for x in (u, n1 * n2 - u))
    p = {"greater": up, "less": down, "two-sided": min(1.0, 2 * min(up, down))}[alternative]
    return out | {"p_value": p}


def drawn(seed: int, key: Column) -> Column:
    """What orders rows for sampling: a digest of the seed and the row's key, which any engine can compute."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")).cast("binary"))


def sample(df: DataFrame, value: Column, rows: int, seed: int, key: Column | None = None) -> list[float]:
    """At most ``rows`` non-null values, the same ones at every run and partitioning: rows drawn without replacement.

    With a ``key`` that tells rows apart, the rows of least digest are taken, a bounded heap in each task. Without one,
    places in the order of all values are drawn on the driver; each distinct value is taken as often as
    its rows hold one, so copies are never expanded and every row has the same chance.
    """
    if key is not None:
        keyed = df.select(drawn(seed, key).alias("h"), value.cast("double").alias("v")).where("v is not null")
        return [r["v"] for r in keyed.orderBy("h", "v").limit(rows).collect()]
    values = df.select(value.cast("double").alias("v")).where("v is not null")
    if values.limit(rows + 1).count() <= rows:
        return [r[0] for r in values.collect()]
    places = np.sort(np.random.default_rng(seed).choice(values.count(), rows, replace=False, shuffle=False))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, before = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            times = np.searchsorted(places, before + n) - np.searchsorted(places, before)
            at = np.flatnonzero(times)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(times[at])], names=["v", "times"])

    ranked = cumulative(values.groupBy("v").agg(F.count("*").alias("n")), "v", "n", range_bounds(values, {"v": F.col("v")})["v"])
    picked = ranked.select("v", "n", "n_before").mapInArrow(taken, "v double, times long").orderBy("v").collect()  # at most ``rows``
    return [r["v"] for r in picked for _ in range(r["times"])]


def normality(df: DataFrame, column: str, seed: int = 42, most: int = 5_000, key: Column | None = None) -> dict[str, Any]:
    """Shapiro-Wilk up to ``most`` values; beyond, Kolmogorov-Smirnov against the sample's own normal on a fixed sample."""
    n = df.where(clean(column).isNotNull()).count()
    values = sample(df, clean(column), most, seed, key)
    if n <= most:
        method, (statistic, p) = "shapiro-wilk", dist.shapiro_wilk(values)
    else:
        method = "kolmogorov-smirnov"
        mean = math.fsum(values) / len(values)
        sd = math.sqrt(math.fsum((v - mean) ** 2 for v in values) / (len(values) - 1))
        if sd:
            below = [1 - dist.normal_sf((v - mean) / sd) for v in sorted(values)]
            k = len(values)
            statistic = max(max((i + 1) / k - q, q - i / k) for i, q in enumerate(below))
            p = dist.kolmogorov_sf(statistic, k)
        else:
            statistic, p = math.nan, math.nan
    known = p == p
    return {"variable": column, "method": method, "statistic": statistic if known else None, "p_value": p if known else None, "n_used": len(values), "is_normal_at_0.05": bool(known and p >= 0.05)}


def compare_two_groups(df: DataFrame, value: str, group: str, a: Any, b: Any, alpha: float = contract.ALPHA, seed: int = 42, alternative: str = "two-sided", key: Column | None = None) -> dict[str, Any]:
    """Welch's test where both groups look normal, else the rank test; a null p for groups too small to test."""
    normal = [normality(df.where(F.col(group) == F.lit(x)), value, seed, key=key)["is_normal_at_0.05"] for x in (a, b)]
    if all(normal):
        method, found = "welch t", welch(df, value, group, a, b, alternative)
    else:
        method, found = "mann-whitney u", mann_whitney(df, value, group, a, b, alternative)
    return record(f"compare_{value}_{a}_{b}", method, found["statistic"], found["p_value"], alpha, f"{value} doesn't differ between {a} and {b}", f"{value} differs between {a} and {b}")


def slope_statistic(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, slope, intercept, r_squared, t): simple regression; slope 0 and null r_squared for a constant y, null for a constant x."""
    both = df.select(clean(x).alias("x"), clean(y).alias("y")).where("x is not null and y is not null")
    m = both.agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.coalesce(F.var_pop("x"), F.lit(0.0)).alias("vx"), F.coalesce(F.var_pop("y"), F.lit(0.0)).alias("vy"), F.covar_pop("x", "y").alias("c"))
    flat = F.col("vy") == 0
    slope = F.when(flat, F.lit(0.0)).otherwise(F.try_divide(F.col("c"), F.col("vx")))
    r2 = F.when(~flat, F.try_divide(F.col("c") ** 2, F.col("vx") * F.col("vy")))
    t = F.when(~flat, F.try_divide(F.signum("c") * F.sqrt(r2 * (F.col("n") - 2)), F.sqrt(F.greatest(1 - r2, F.lit(0.0)))))
    return m.select("n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), r2.alias("r_squared"), t.alias("t"))


def slope_test(df: DataFrame, x: str, y: str, alpha: float = contract.ALPHA) -> dict[str, Any]:
    row = slope_statistic(df, x, y).first()
    method, name = "simple linear regression", f"slope_{x}_{y}"
    if row["n"] and row["r_squared"] is None and row["slope"] == 0:
        out = record(name, method, 0.0, 1.0, alpha, f"not applicable: {y} is constant", f"not applicable: {y} is constant")
        return out | {"slope": 0.0, "r_squared": math.nan, "zero_variance": True}
    if row["slope"] is None or row["n"] < 3:
        p = None
    elif row["t"] is None:
        p = 0.0  # a perfect fit
    else:
        p = dist.two_sided(dist.t_sf, row["t"], row["n"] - 2)
    out = record(name, method, row["slope"], p, alpha, f"{x} has no linear effect on {y}", f"{x} has a linear effect on {y}")
    return out | {"slope": row["slope"], "r_squared": row["r_squared"], "zero_variance": False}


def run_all(df: DataFrame, seed: int = 42, key: Column | None = None) -> list[dict[str, Any]]:
    """The project's four or five hypotheses."""
    c = contract
    out = [compare_two_groups(df, c.AMOUNT, c.CHANNEL, "APP", "WEB", seed=seed, alternative="greater", key=key), slope_test(df, c.DISCOUNT, c.UNITS)]
    if c.GENDER in df.columns:
        labels = [r[0] for r in df.select(c.GENDER).where(F.col(c.GENDER).isNotNull()).distinct().orderBy(c.GENDER).limit(2).collect()]
        if len(labels) == 2:
            out.append(compare_two_groups(df, c.AMOUNT, c.GENDER, *labels, seed=seed, key=key))
    return [*out, chi_square(df, c.CHANNEL, c.STORE), slope_test(df.where(F.col(c.AGE).isNotNull()), c.AGE, c.AMOUNT)]
