"""Exact order statistics of whole columns without gathering a column in one place.

Spark's percentile sketch, whose size is fixed, brackets each wanted rank; only what lies inside a bracket
is counted exactly. A bracket that still holds too much is narrowed again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
#: Distinct values of a bracket that the driver receives at most.
MOST_VALUES = 200_000


def clean(column: str) -> Column:
    """A numeric column as double with NaN as null."""
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value), value)


def order_statistics(df: DataFrame, column: Column, ranks: Sequence[int]) -> list[float]:
    """The values of the given 0-based ranks among the non-null values."""
    values = df.select(column.alias("v0"))
    n = values.agg(F.count("v0")).first()[0]
    found = _select(values, {0: sorted(set(ranks))}, {0: n})[0]
    return [found[r] for r in ranks]


def _select(values: DataFrame, ranks: dict[int, list[int]], totals: dict[int, int]) -> dict[int, dict[int, float]]:
    """For columns v0, v1, ... the values of the wanted ranks: three passes for all of them together."""
    margin = 2.0 / ACCURACY
    wanted = [(c, r) for c, own in ranks.items() for r in own if totals[c]]
    out: dict[int, dict[int, float]] = {c: dict.fromkeys(own, math.nan) for c, own in ranks.items()}
    if not wanted:
        return out
    probes = {c: [p for r in ranks[c] for p in (max(0.0, r / totals[c] - margin), min(1.0, (r + 1) / totals[c] + margin))] for c in ranks if totals[c] and ranks[c]}
    cuts = values.agg(*(F.percentile_approx(f"v{c}", F.lit(p), F.lit(ACCURACY)).alias(f"p{c}") for c, p in probes.items()), *(f(f"v{c}").alias(f"{k}{c}") for c in probes for k, f in (("lo", F.min), ("hi", F.max)))).first()
    brackets = {}
    for c, own in ranks.items():
        for i, r in enumerate(own if c in probes else ()):
            low, high = probes[c][2 * i], probes[c][2 * i + 1]
            brackets[c, r] = (cuts[f"lo{c}"] if low <= 0 else cuts[f"p{c}"][2 * i], cuts[f"hi{c}"] if high >= 1 else cuts[f"p{c}"][2 * i + 1])
    counts = values.agg(
        *(F.count_if(F.col(f"v{c}") < brackets[c, r][0]).alias(f"b{k}") for k, (c, r) in enumerate(wanted)),
        *(F.count_if(F.col(f"v{c}").between(*brackets[c, r])).alias(f"n{k}") for k, (c, r) in enumerate(wanted)),
    ).first()
    later: list[tuple[int, int, Column, int]] = []
    fetched = []
    for k, (c, r) in enumerate(wanted):
        v, (lo, hi), place, inside = F.col(f"v{c}"), brackets[c, r], r - counts[f"b{k}"], counts[f"n{k}"]
        if place < 0:  # the sketch missed: take the side that holds the rank
            later.append((c, r, v < lo, r))
        elif place >= inside:
            later.append((c, r, v > hi, place - inside))
        elif inside > MOST_VALUES and lo < hi:
            later.append((c, r, v.between(lo, hi), place))
        elif lo == hi:
            out[c][r] = float(lo)
        else:
            fetched.append((k, c, r, place))
    if fetched:
        cells = F.array(*(F.when(F.col(f"v{c}").between(*brackets[c, r]), F.struct(F.lit(k).alias("k"), F.col(f"v{c}").cast("double").alias("v"))) for k, c, r, _ in fetched))
        rows = values.select(F.explode(F.array_compact(cells)).alias("x")).groupBy("x.k", "x.v").agg(F.count("*").alias("n")).collect()
        for k, c, r, place in fetched:
            for v, n in sorted((x["v"], x["n"]) for x in rows if x["k"] == k):
                if place < n:
                    out[c][r] = v
                    break
                place -= n
    for c, r, where, place in later:
        part = values.where(where).select(F.col(f"v{c}").alias("v0"))
        out[c][r] = _select(part, {0: [place]}, {0: part.count()})[0][place]
    return out


def quantiles_of(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation between neighbours, of all columns together; None without values."""
    values = df.select(*(clean(c).alias(f"v{k}") for k, c in enumerate(columns)))
    counts = values.agg(*(F.count(f"v{k}").alias(f"n{k}") for k in range(len(columns)))).first()
    totals = {k: counts[f"n{k}"] for k in range(len(columns))}
    places = {k: [q * (n - 1) for q in shares] if n else [] for k, n in totals.items()}
    found = _select(values, {k: sorted({x for p in own for x in (math.floor(p), math.ceil(p))}) for k, own in places.items()}, totals)
    out: dict[str, list[float | None]] = {}
    for k, c in enumerate(columns):
        v = found[k]
        out[c] = [v[math.floor(p)] + (v[math.ceil(p)] - v[math.floor(p)]) * (p - math.floor(p)) for p in places[k]] or [None] * len(shares)
    return out


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    return quantiles_of(df, [column], shares)[column]


#: Steps of the sketch that narrows a group's brackets; a step keeps three of them at most.
GRID = 1_000


def grouped_quantiles(rows: DataFrame, group: str, value: str, shares: Sequence[float]) -> DataFrame:
    """(group, q0, q1, ...): exact quantiles with linear interpolation of each group's non-null values.

    A bracket around the wanted ranks of each group is narrowed by a sketch of fixed size until it holds
    ``MOST_VALUES`` rows at most; only these meet in one place, as counts of distinct values.
    """
    base = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("g is not null and v is not null")
    counts = base.groupBy("g").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    places = [F.lit(q) * (F.col("n") - 1) for q in shares]
    if most <= MOST_VALUES:
        cells = base.groupBy("g", "v").agg(F.count("*").alias("c")).join(counts, "g").withColumn("j", F.lit(0))
        below = F.lit(0)
        wanted = {k: p for k, p in enumerate(places)}
    else:
        state = counts.select("g", "n", F.posexplode(F.array(*places)).alias("j", "place"))
        state = state.select("g", "n", "j", "place", F.lit(-math.inf).alias("lo"), F.lit(math.inf).alias("hi"))
        while most > MOST_VALUES:
            before, state = most, _narrowed(base, state)
            most = base.join(state, "g").where("v between lo and hi").groupBy("g", "j").agg(F.count("*").alias("c"), F.count_if(F.col("lo") < F.col("hi")).alias("open")).agg(F.max(F.least("c", "open"))).first()[0] or 0
            if most >= before:
                break
        inside = base.join(state, "g").where("v <= hi")
        met = inside.groupBy("g", "n", "j", "place", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
        under = met.where("v is null").select("g", "j", F.col("c").alias("under"))
        cells = met.where("v is not null").join(under, ["g", "j"], "left")
        below = F.coalesce("under", F.lit(0))
        wanted = {k: F.when(F.col("j") == k, F.col("place")) for k in range(len(shares))}
    upto = Window.partitionBy("g", "j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.withColumn("upto", F.sum("c").over(upto) + below)
    first = F.col("upto") - F.col("c")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < F.col("upto")), F.col("v")))

    ends = summed.groupBy("g").agg(*(at(f(p)).alias(f"{name}{k}") for k, p in wanted.items() for name, f in (("a", F.floor), ("b", F.ceil))), *(F.max(p).alias(f"p{k}") for k, p in wanted.items()))
    between = [(F.col(f"a{k}") + (F.col(f"b{k}") - F.col(f"a{k}")) * (F.col(f"p{k}") - F.floor(f"p{k}"))).alias(f"q{k}") for k in wanted]
    return ends.select(F.col("g").alias(group), *between)


def _narrowed(base: DataFrame, state: DataFrame) -> DataFrame:
    """``state`` (g, n, j, place, lo, hi) with closer brackets; wide by a step on either side, since the sketch errs by less."""
    steps = F.lit([k / GRID for k in range(GRID + 1)])
    met = base.join(state, "g").where("v <= hi")
    own = F.when(F.col("v") >= F.col("lo"), F.col("v"))
    found = met.groupBy("g", "n", "j", "place", "lo", "hi").agg(F.count_if(F.col("v") < F.col("lo")).alias("under"), F.count(own).alias("c"), F.percentile_approx(own, steps, F.lit(ACCURACY)).alias("p"))
    low = F.floor((F.floor("place") - F.col("under")) / F.col("c") * GRID).cast("int") - 1
    high = F.ceil((F.ceil("place") - F.col("under") + 1) / F.col("c") * GRID).cast("int") + 1
    # beyond the grid's ends the bracket stays as it is
    lo = F.when(low >= 0, F.try_element_at("p", low + 1)).otherwise(F.col("lo"))
    hi = F.when(high <= GRID, F.try_element_at("p", F.least(high, F.lit(GRID)) + 1)).otherwise(F.col("hi"))
    return found.select("g", "n", "j", "place", lo.alias("lo"), hi.alias("hi"))
