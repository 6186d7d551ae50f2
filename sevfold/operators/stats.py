"""Non-parametric comparison of two groups of scores."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from sevfold.functions.cvss import CVSS2_SCALES, partial_score
from sevfold.operators.ranking import mid_rank, with_index

# Scenarios of the comparison report.
SCENARIOS = (
    "cvss2_auth", "cvss2_conf", "cvss2_accessvect", "cvss2_avail", "cvss2_accesscomp", "cvss2_severity", "cvss2_integrity",
)
# Sample sizes up to which the method ``auto`` takes the exact distribution of tie-free samples:
# rows of the smaller group for U, pairs for W.
EXACT_U_ROWS = 8
EXACT_W_PAIRS = 50
METHODS = ("auto", "exact", "normal")


@pandas_udf(DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """Upper tail of the standard normal; runs on one row per comparison."""
    return z.map(lambda v: None if v is None or math.isnan(v) else 0.5 * math.erfc(v / math.sqrt(2)))


def _exact_u_tail(u: float, n_a: int, n_b: int) -> float:
    """P(U >= u) without ties, counted with whole numbers.

    The ways to reach each U are the coefficients of a Gaussian binomial. The distribution is
    the same for both orders of the groups and symmetric, so the loop runs over the smaller
    group and the shorter tail.
    """
    few, many = sorted((n_a, n_b))
    top = n_a * n_b
    at = math.ceil(u)
    if at <= 0:
        return 1.0
    if at > top:
        return 0.0
    reach = min(top - at, at - 1)  # P(U >= u) = P(U <= top - u); the other tail is P(U <= u - 1)
    ways = np.zeros(reach + 1, dtype=object)
    ways[0] = 1
    for i in range(1, few + 1):
        up = many + i
        if up <= reach:
            ways[up:] = ways[up:] - ways[: reach + 1 - up]
        for start in range(min(i, reach + 1)):
            ways[start::i] = np.cumsum(ways[start::i])
    tail = Fraction(int(sum(ways)), math.comb(n_a + n_b, n_a))
    return float(tail if reach == top - at else 1 - tail)


def _exact_w_tail(w: float, n: int) -> float:
    """P(W <= w) of the signed-rank sum of n pairs without ties."""
    ways = np.zeros(n * (n + 1) // 2 + 1, dtype=object)
    ways[0] = 1
    for rank in range(1, n + 1):
        ways[rank:] = ways[rank:] + ways[:-rank]
    return float(Fraction(int(sum(ways[: math.floor(w) + 1])), 2**n))


@pandas_udf(DoubleType())
def exact_u(u: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    return pd.Series([_exact_u_tail(x, int(a), int(b)) for x, a, b in zip(u, n_a, n_b)])


@pandas_udf(DoubleType())
def exact_w(w: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([_exact_w_tail(x, int(m)) for x, m in zip(w, n)])


def moments(df: DataFrame, group: str, value: str, keys: list[str]) -> DataFrame:
    """Size, mean and sample variance of groups ``A`` and ``B`` per key."""
    aggs = []
    for g in ("A", "B"):
        mine = F.when(F.col(group) == g, F.col(value))
        aggs += [F.count(mine).alias(f"n_{g}"), F.avg(mine).alias(f"mean_{g}"), F.var_samp(mine).alias(f"var_{g}")]
    return df.groupBy(*keys).agg(*aggs)


def cohen_d(df: DataFrame, group: str, value: str, keys: list[str]) -> DataFrame:
    """Absolute effect size with the pooled standard deviation."""
    n_a, n_b = F.col("n_A"), F.col("n_B")
    pooled = F.sqrt(((n_a - 1) * F.col("var_A") + (n_b - 1) * F.col("var_B")) / F.nullif(n_a + n_b - 2, F.lit(0)))
    d = F.abs(F.col("mean_A") - F.col("mean_B")) / F.nullif(pooled, F.lit(0.0))
    return moments(df, group, value, keys).withColumn("cohen_d", d)


def tie_term(n: str) -> Column:
    t = F.col(n).cast("double")
    return F.sum(t * t * t - t)


def mann_whitney(
    df: DataFrame, group: str, value: str, keys: list[str], alternative: str | None = None, buckets: int = 64,
    method: str = "auto", exact_rows: int = EXACT_U_ROWS,
) -> DataFrame:
    """U of group ``A``, its z and p value per key; null where a group is empty.

    Without ``alternative`` the side is ``greater`` where the mean of A is the smaller one,
    else ``less``: the test runs against the observed direction. z has the tie and the
    continuity correction. ``method`` is ``exact`` (tie-free samples), ``normal``, or ``auto``: exact for
    tie-free samples of which one has up to ``exact_rows`` rows, whatever the size of the other.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    in_a = F.when(F.col(group) == "A", 1).otherwise(0)
    ranks = mid_rank(df, keys, value, {"n_a": in_a}, buckets)
    n_a, n_b, n = F.col("n_A"), F.col("n_B"), F.col("n_A") + F.col("n_B")
    sums = ranks.groupBy(*keys).agg(
        F.sum("n_a").alias("n_A"),
        F.sum(F.col("n_ties") - F.col("n_a")).alias("n_B"),
        F.sum(F.col("n_a") * F.col("mid_rank")).alias("_rank_sum"),
        tie_term("n_ties").alias("_ties"),
        F.try_divide(F.sum(F.col("n_a") * F.col(value)), F.sum("n_a")).alias("_mean_a"),
        F.try_divide(F.sum((F.col("n_ties") - F.col("n_a")) * F.col(value)), F.sum(F.col("n_ties") - F.col("n_a"))).alias("_mean_b"),
    )
    product = n_a.cast("double") * n_b
    both = product > 0
    u = F.when(both, F.col("_rank_sum") - n_a.cast("double") * (n_a + 1) / 2)
    side = F.lit(alternative) if alternative else F.when(F.col("_mean_a") < F.col("_mean_b"), "greater").when(both, "less")
    u_side = (
        F.when(F.col("side") == "greater", F.col("U"))
        .when(F.col("side") == "less", product - F.col("U"))
        .otherwise(F.greatest(F.col("U"), product - F.col("U")))
    )
    spread = F.sqrt(product / 12 * (n + 1 - F.try_divide(F.col("_ties"), n.cast("double") * (n - 1))))
    tested = (
        sums.withColumn("U", u)
        .withColumn("side", side)
        .withColumn("_u", u_side)
        .withColumn("z", (F.col("_u") - product / 2 - 0.5) / F.nullif(spread, F.lit(0.0)))
    )
    size = {"auto": F.least(n_a, n_b) <= exact_rows, "exact": F.lit(True), "normal": F.lit(False)}[method]
    small = size & both & (F.col("_ties") == 0)
    sides = F.when(F.col("side") == "two-sided", 2.0).otherwise(1.0)
    tail = F.when(small, exact_u(F.when(small, F.col("_u")).otherwise(0.0), F.when(small, n_a).otherwise(1), F.when(small, n_b).otherwise(1)))
    p = F.when(both, F.least(F.lit(1.0), sides * tail.otherwise(normal_tail(F.col("z")))))
    return tested.withColumn("p_value", p).select(*keys, "n_A", "n_B", "side", "U", "z", "p_value")


def pair_up(df: DataFrame, group: str, value: str, keys: list[str], row_key: list[str], seed: int = 42) -> DataFrame:
    """Pair the i-th row of A with the i-th row of B in the seeded order of each group.

    The longer group is cut to the length of the shorter one, as a seeded sample of it.
    """
    numbered = with_index(df.select(*keys, group, value, *row_key), row_key, seed, [*keys, group])
    paired = numbered.groupBy(*keys, "row_index").agg(
        *[F.max(F.when(F.col(group) == g, F.col(value))).alias(g) for g in ("A", "B")]
    )
    return paired.filter(F.col("A").isNotNull() & F.col("B").isNotNull())


def wilcoxon(
    df: DataFrame, group: str, value: str, keys: list[str], row_key: list[str], seed: int = 42, buckets: int = 64,
    method: str = "auto", exact_pairs: int = EXACT_W_PAIRS,
) -> DataFrame:
    """Signed-rank statistic W = min(W+, W-) and two-sided p per key; equal pairs are dropped.

    ``method`` is ``exact`` (samples without ties and equal pairs), ``normal``, or ``auto``: exact
    for such samples of up to ``exact_pairs`` pairs.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    diffs = pair_up(df, group, value, keys, row_key, seed).select(*keys, (F.col("A") - F.col("B")).alias("d"))
    signed = diffs.filter(F.col("d") != 0).withColumn("abs_d", F.abs("d"))
    ranks = mid_rank(signed, keys, "abs_d", {"n_pos": F.when(F.col("d") > 0, 1).otherwise(0)}, buckets)
    sums = ranks.groupBy(*keys).agg(
        F.sum("n_ties").alias("n_pairs"),
        F.sum(F.col("n_pos") * F.col("mid_rank")).alias("w_plus"),
        F.sum((F.col("n_ties") - F.col("n_pos")) * F.col("mid_rank")).alias("w_minus"),
        tie_term("n_ties").alias("_ties"),
    )
    zeros = diffs.groupBy(*keys).agg(F.count(F.when(F.col("d") == 0, 1)).alias("n_equal"))
    n = F.col("n_pairs").cast("double")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("_ties") / 2) / 24)
    tested = (
        sums.join(zeros, keys)
        .withColumn("W", F.least("w_plus", "w_minus"))
        .withColumn("z", (F.col("W") - n * (n + 1) / 4) / F.nullif(spread, F.lit(0.0)))
    )
    size = {"auto": F.col("n_pairs") <= exact_pairs, "exact": F.lit(True), "normal": F.lit(False)}[method]
    small = size & (F.col("_ties") == 0) & (F.col("n_equal") == 0)
    exact = exact_w(F.when(small, F.col("W")).otherwise(0.0), F.when(small, F.col("n_pairs")).otherwise(1))
    p = F.least(F.lit(1.0), 2 * F.when(small, exact).otherwise(normal_tail(F.abs("z"))))
    return tested.withColumn("p_value", p).select(*keys, "n_pairs", "n_equal", "w_plus", "w_minus", "W", "z", "p_value")


def tagged(df1: DataFrame, df2: DataFrame, scenarios: list[str]) -> DataFrame:
    """Both frames as groups A and B, each row under its scenario and under ``overall``.

    ``overall`` has all rows, also those of scenarios outside the list. This is the raw data
    of the report in long form; it is never gathered into arrays.
    """
    both = df1.withColumn("group", F.lit("A")).unionByName(df2.withColumn("group", F.lit("B")))
    levels = F.explode(F.array(F.col("scenario"), F.lit("overall")))
    spread = both.withColumn("_level", levels).drop("scenario").withColumnRenamed("_level", "scenario")
    return spread.filter(F.col("scenario").isin(*scenarios, "overall"))


def compare(
    df1: DataFrame, df2: DataFrame, row_key: list[str], a: str = "A", b: str = "B", evals: tuple[str, ...] = ("mcc", "f1"),
    extra: tuple[str, ...] = (), alternative: str | None = None,
) -> DataFrame:
    """Report per scenario: means, U p-value, effect size, signed-rank p and group sizes per metric."""
    both = tagged(df1, df2, [*SCENARIOS, *extra])
    metric = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in evals]))
    long = both.select("group", "scenario", *row_key, metric).filter(F.col("value").isNotNull())
    keys = ["scenario", "metric"]
    report = (
        cohen_d(long, "group", "value", keys).select(*keys, "mean_A", "mean_B", "cohen_d", "n_A", "n_B")
        .join(mann_whitney(long, "group", "value", keys, alternative).select(*keys, F.col("p_value").alias("u")), keys, "left")
        .join(wilcoxon(long, "group", "value", keys, row_key).select(*keys, F.col("p_value").alias("w")), keys, "left")
    )
    names = {"mean_A": "mean_A_", "mean_B": "mean_B_", "u": "mwyu_", "cohen_d": "cohend_", "w": "wilcoxon_", "n_A": "n_A_", "n_B": "n_B_"}
    wide = [F.max(F.when(F.col("metric") == m, F.col(c))).alias(prefix + m) for m in evals for c, prefix in names.items()]
    return report.groupBy("scenario").agg(*wide).select("scenario", F.lit(a).alias("A"), F.lit(b).alias("B"), *[F.col(p + m) for m in evals for p in names.values()])


def cvss_distance(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Wrong CVSS-2 metrics per commit: their number, and their distance in half steps."""
    scales = CVSS2_SCALES | {name: None for name in extra}

    def wrong(name: str) -> Column:
        return F.when(F.col(name).eqNullSafe(F.col(f"{name}-pred")), 0).otherwise(1)

    def distance(name: str) -> Column:
        scale = scales[name]
        return wrong(name).cast("double") if scale is None else partial_score(F.col(name), F.col(f"{name}-pred"), scale)

    names = list(scales)
    absolute = sum((wrong(m) for m in names[1:]), wrong(names[0]))
    partial = sum((distance(m) for m in names[1:]), distance(names[0]))
    scored = df.withColumns({"score_abs": absolute, "score_partial": partial})
    first = ["commit", "score_abs", "score_partial"]
    return scored.select(*first, *[c for c in df.columns if c != "commit"])
