"""Queries on statistical comparison, from the values of clicks and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sevfold.functions.cvss import CVSS2_SCALES, IMPACT, LEVELS, partial_score
from sevfold.operators import stats as st
from sevfold.operators.ranking import mid_rank
from sevfold.plans.results import unpivot_pairs
from sevfold.queries import derived as d
from sevfold.queries.registry import Tables, query

KEYS = ["scenario"]


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


MOMENTS = f"""{d.TWO_GROUPS},
moments AS (
  SELECT scenario, count(*) FILTER (grp = 'A') AS n_a, count(*) FILTER (grp = 'B') AS n_b,
         avg(value) FILTER (grp = 'A') AS m_a, avg(value) FILTER (grp = 'B') AS m_b,
         var_samp(value) FILTER (grp = 'A') AS v_a, var_samp(value) FILTER (grp = 'B') AS v_b
  FROM two_groups GROUP BY 1)"""


@query(
    "a16_cohen_d",
    f"""WITH {MOMENTS} SELECT scenario, n_a, n_b, round(m_a, 6) AS mean_a, round(m_b, 6) AS mean_b,
        round(abs(m_a - m_b) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2)), 6) AS cohen_d FROM moments""",
)
def a16(t: Tables) -> DataFrame:
    out = st.cohen_d(d.two_groups(t), "group", "value", KEYS)
    named = out.select("scenario", F.col("n_A").alias("n_a"), F.col("n_B").alias("n_b"), F.col("mean_A").alias("mean_a"), F.col("mean_B").alias("mean_b"), "cohen_d")
    return rounded(named, "mean_a", "mean_b", "cohen_d")


RANKS = f"""{d.TWO_GROUPS},
ranked AS (
  SELECT *, rank() OVER (PARTITION BY scenario ORDER BY value) + (count(*) OVER (PARTITION BY scenario, value) - 1) / 2.0::DOUBLE AS mid_rank,
         count(*) OVER (PARTITION BY scenario, value) AS n_ties
  FROM two_groups)"""


@query("w7_mid_rank", f"WITH {RANKS} SELECT DISTINCT scenario, value, n_ties, mid_rank FROM ranked")
def w7(t: Tables) -> DataFrame:
    return mid_rank(d.two_groups(t), KEYS, "value")


@query(
    "a17_mann_whitney",
    f"""WITH {RANKS},
        sums AS (
          SELECT scenario, (count(*) FILTER (grp = 'A'))::DOUBLE AS na, (count(*) FILTER (grp = 'B'))::DOUBLE AS nb, count(*)::DOUBLE AS n,
                 sum(mid_rank) FILTER (grp = 'A') AS ra, sum(n_ties::DOUBLE * n_ties - 1) AS ties,
                 avg(value) FILTER (grp = 'A') AS ma, avg(value) FILTER (grp = 'B') AS mb
          FROM ranked GROUP BY 1),
        u AS (SELECT *, ra - na * (na + 1) / 2 AS u, CASE WHEN ma < mb THEN 'greater' ELSE 'less' END AS side FROM sums)
        SELECT scenario, CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b, side, u AS u_stat,
               round(((CASE WHEN side = 'greater' THEN u ELSE na * nb - u END) - na * nb / 2 - 0.5)
                     / sqrt(na * nb / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM u""",
)
def a17(t: Tables) -> DataFrame:
    out = st.mann_whitney(d.two_groups(t), "group", "value", KEYS)
    named = out.select("scenario", F.col("n_A").alias("n_a"), F.col("n_B").alias("n_b"), "side", F.col("U").alias("u_stat"), "z")
    return rounded(named, "z")


@query("a17_mann_whitney_p")
def a17b(t: Tables) -> DataFrame:
    return st.mann_whitney(d.two_groups(t), "group", "value", KEYS, alternative="two-sided")


PAIRS = f"""{d.TWO_GROUPS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY scenario, grp ORDER BY md5(concat_ws('|', event_id, '42'))) AS i FROM two_groups),
diffs AS (SELECT a.scenario, a.value - b.value AS diff FROM numbered a JOIN numbered b
          ON a.scenario = b.scenario AND a.i = b.i AND a.grp = 'A' AND b.grp = 'B'),
signed AS (SELECT scenario, diff, abs(diff) AS size FROM diffs WHERE diff <> 0),
ranks AS (SELECT scenario, diff, rank() OVER (PARTITION BY scenario ORDER BY size) + (count(*) OVER (PARTITION BY scenario, size) - 1) / 2.0::DOUBLE AS r FROM signed)"""


@query(
    "a18_wilcoxon",
    f"""WITH {PAIRS}, w AS (
          SELECT scenario, count(*) AS n_pairs, coalesce(sum(r) FILTER (diff > 0), 0) AS w_plus, coalesce(sum(r) FILTER (diff < 0), 0) AS w_minus
          FROM ranks GROUP BY 1)
        SELECT scenario, n_pairs, w_plus, w_minus, least(w_plus, w_minus) AS w_stat FROM w""",
)
def a18(t: Tables) -> DataFrame:
    out = st.wilcoxon(d.two_groups(t), "group", "value", KEYS, ["event_id"])
    return out.select("scenario", "n_pairs", "w_plus", "w_minus", F.col("W").alias("w_stat"))


@query("a18_wilcoxon_p")
def a18b(t: Tables) -> DataFrame:
    return st.wilcoxon(d.two_groups(t), "group", "value", KEYS, ["event_id"]).select("scenario", "z", "p_value")


def frames(t: Tables) -> tuple[DataFrame, DataFrame]:
    names = F.array(*[F.lit(s) for s in [*st.SCENARIOS, "multitask"]])
    rows = d.two_groups(t).withColumn("scenario", F.get(names, (F.col("event_id") % 8).cast("int")))
    metrics = rows.select("event_id", "group", "scenario", F.col("value").alias("mcc"), (F.col("value") % 97).alias("f1"))
    return tuple(metrics.filter(F.col("group") == g).drop("group") for g in ("A", "B"))


LEVELED = f"""{d.TWO_GROUPS},
named AS (SELECT grp, ['{"','".join([*st.SCENARIOS, "multitask"])}'][event_id % 8 + 1] AS scenario, value AS mcc, value % 97 AS f1 FROM two_groups),
leveled AS (SELECT * FROM named WHERE scenario <> 'multitask' UNION ALL SELECT grp, 'overall', mcc, f1 FROM named)"""


def _compare_sql(m: str) -> str:
    a, b = f"avg({m}) FILTER (grp = 'A')", f"avg({m}) FILTER (grp = 'B')"
    na, nb = "count(*) FILTER (grp = 'A')", "count(*) FILTER (grp = 'B')"
    pooled = f"sqrt((({na} - 1) * var_samp({m}) FILTER (grp = 'A') + ({nb} - 1) * var_samp({m}) FILTER (grp = 'B')) / ({na} + {nb} - 2))"
    return f"round({a}, 6) AS mean_a_{m}, round({b}, 6) AS mean_b_{m}, round(abs({a} - {b}) / {pooled}, 6) AS cohend_{m}, {na} AS n_a_{m}, {nb} AS n_b_{m}"


@query(
    "a19_compare",
    f"WITH {LEVELED} SELECT scenario, 'click' AS a, 'view' AS b, {_compare_sql('mcc')}, {_compare_sql('f1')} FROM leveled GROUP BY 1",
)
def a19(t: Tables) -> DataFrame:
    report = st.compare(*frames(t), ["event_id"], "click", "view")
    cols = [F.col("scenario"), F.col("A").alias("a"), F.col("B").alias("b")]
    for m in ("mcc", "f1"):
        cols += [F.round(f"mean_A_{m}", 6).alias(f"mean_a_{m}"), F.round(f"mean_B_{m}", 6).alias(f"mean_b_{m}"), F.round(f"cohend_{m}", 6).alias(f"cohend_{m}")]
        cols += [F.col(f"n_A_{m}").alias(f"n_a_{m}"), F.col(f"n_B_{m}").alias(f"n_b_{m}")]
    return report.select(*cols)


@query("a19_compare_p")
def a19b(t: Tables) -> DataFrame:
    return st.compare(*frames(t), ["event_id"], "click", "view", evals=("mcc",))


@query("a19_raw_values", f"WITH {LEVELED} SELECT grp, scenario, mcc, f1 FROM leveled")
def a19c(t: Tables) -> DataFrame:
    return st.tagged(*frames(t), st.SCENARIOS).select(F.col("group").alias("grp"), "scenario", "mcc", "f1")


SCALES = {m: scale or ("NETWORK", "LOCAL", "ADJACENT") for m, scale in CVSS2_SCALES.items()}


def pairs7(t: Tables) -> DataFrame:
    """Gold and predicted labels of the seven CVSS-2 metrics per event; some are unknown (``-``)."""
    event, user = F.col("event_id"), F.col("user_id")
    cols = [event.cast("string").alias("commit")]
    for i, (m, scale) in enumerate(SCALES.items()):
        steps = F.array(*[F.lit(s) for s in scale])
        gold = F.get(steps, ((event + i) % 3).cast("int"))
        pred = F.when(event % 11 == i, "-").otherwise(F.get(steps, ((user * (i + 1)) % 3).cast("int")))
        cols += [gold.alias(m), pred.alias(f"{m}-pred")]
    return t.events.select(*cols)


def _pair_sql() -> str:
    rows = []
    for i, (m, scale) in enumerate(SCALES.items()):
        steps = "['" + "','".join(scale) + "']"
        ordinal = "TRUE" if CVSS2_SCALES[m] else "FALSE"
        rows.append(
            f"SELECT CAST(event_id AS VARCHAR) AS commit, '{m}' AS metric, {ordinal} AS ordinal, CAST((event_id + {i}) % 3 AS INT) AS g, "
            f"CASE WHEN event_id % 11 = {i} THEN NULL ELSE CAST((user_id * {i + 1}) % 3 AS INT) END AS p, {steps} AS steps FROM events"
        )
    return " UNION ALL ".join(rows)


@query(
    "a20_cvss_distance",
    f"""WITH pairs AS ({_pair_sql()})
        SELECT commit, CAST(sum(CASE WHEN g IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) AS INT) AS score_abs,
               sum(CASE WHEN g IS NOT DISTINCT FROM p THEN 0 WHEN NOT ordinal THEN 1 WHEN p IS NULL THEN 0 ELSE abs(g - p) / 2.0::DOUBLE END)::DOUBLE AS score_partial
        FROM pairs GROUP BY 1""",
)
def a20(t: Tables) -> DataFrame:
    return st.cvss_distance(pairs7(t)).select("commit", "score_abs", "score_partial")


@query("x6_unpivot_pairs", f"WITH pairs AS ({_pair_sql()}) SELECT commit, metric, steps[g + 1] AS gold, coalesce(steps[p + 1], '-') AS pred FROM pairs")
def x6(t: Tables) -> DataFrame:
    return unpivot_pairs(pairs7(t), "commit", list(SCALES))


@query(
    "f37_partial_score",
    """SELECT event_id, abs(CAST(event_id % 3 AS INT) - CAST(user_id % 3 AS INT)) / 2.0::DOUBLE AS levels,
              CASE WHEN event_id % 4 = 3 THEN 0.0::DOUBLE ELSE abs(CAST(event_id % 4 AS INT) - CAST(user_id % 3 AS INT)) / 2.0::DOUBLE END AS impact
       FROM events""",
)
def f37(t: Tables) -> DataFrame:
    def pick(scale, i):
        return F.get(F.array(*[F.lit(s) for s in scale]), i.cast("int"))

    event, user = F.col("event_id"), F.col("user_id")
    return t.events.select(
        "event_id",
        partial_score(pick(LEVELS, event % 3), pick(LEVELS, user % 3), LEVELS).alias("levels"),
        partial_score(pick((*IMPACT, "-"), event % 4), pick(IMPACT, user % 3), IMPACT).alias("impact"),
    )
