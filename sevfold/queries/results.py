"""Queries on experiment results and training logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sevfold.plans import epochs as ep, results as rs
from sevfold.queries import derived as d
from sevfold.queries.registry import Tables, query

RUN = ["run"]
GRID_INDEX = """(CAST(split_part(parameters, '-', 1) AS INT) // 100 - 1) * 3 + CAST(split_part(parameters, '-', 2) AS INT) // 100 - 1"""
BEST_PARAMS = f"""{d.RESULTS},
means AS (SELECT classifier, parameters, avg(val_mcc) AS m FROM results GROUP BY 1, 2),
best AS (SELECT classifier, parameters, m FROM means WHERE m > 0
         QUALIFY row_number() OVER (PARTITION BY classifier ORDER BY m DESC, {GRID_INDEX}) = 1)"""


@query(
    "w1_best_per_group",
    f"""WITH {d.RESULTS}
        SELECT problem, classifier, parameters, val_mcc, event_id FROM results
        QUALIFY row_number() OVER (PARTITION BY problem ORDER BY val_mcc DESC, classifier, parameters, event_id) = 1""",
)
def w1(t: Tables) -> DataFrame:
    best = rs.best_per_group(d.results(t), ["problem", "granularity", "scope"], ties=["classifier", "parameters", "event_id"])
    return best.select("problem", "classifier", "parameters", "val_mcc", "event_id")


@query("w2_best_params", f"WITH {BEST_PARAMS} SELECT classifier, parameters, round(m, 6) AS mean_metric FROM best")
def w2(t: Tables) -> DataFrame:
    return rs.best_params(d.results(t)).withColumn("mean_metric", F.round("mean_metric", 6))


@query(
    "j5_rows_at_best",
    f"WITH {BEST_PARAMS} SELECT r.event_id, r.classifier, r.parameters, r.val_mcc FROM results r JOIN best USING (classifier, parameters)",
)
def j5(t: Tables) -> DataFrame:
    return rs.best_result_rows(d.results(t)).select("event_id", "classifier", "parameters", "val_mcc")


@query(
    "w3_best_epoch",
    f"""WITH {d.EPOCHS},
        prefix AS (SELECT *, coalesce(max(f1) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM epochs)
        SELECT run, max(CASE WHEN f1 > seen AND f1 > 0 THEN epoch END) AS best_epoch, max(CASE WHEN f1 > 0 THEN f1 END) AS best_value
        FROM prefix GROUP BY 1""",
)
def w3(t: Tables) -> DataFrame:
    return ep.best_epoch(d.epochs(t), RUN)


IDLE = f"""{d.EPOCHS},
prefix AS (SELECT *, coalesce(max(f1) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM epochs),
flagged AS (SELECT run, epoch, f1 > greatest(seen, 0) AS improved FROM prefix),
cumulated AS (SELECT *, sum(CASE WHEN improved THEN 0 ELSE 1 END) OVER w AS idle, sum(CASE WHEN improved THEN 1 ELSE 0 END) OVER w AS island
         FROM flagged WINDOW w AS (PARTITION BY run ORDER BY epoch))"""


@query(
    "w4_early_stop_cumulative",
    f"WITH {IDLE} SELECT run, min(CASE WHEN idle >= 10 THEN epoch END) AS stop_epoch FROM cumulated GROUP BY 1",
)
def w4(t: Tables) -> DataFrame:
    return ep.early_stop(d.epochs(t), RUN, patience=10)


@query(
    "w5_early_stop_consecutive",
    f"""WITH {IDLE},
        streak AS (SELECT run, epoch, sum(CASE WHEN improved THEN 0 ELSE 1 END) OVER (PARTITION BY run, island ORDER BY epoch) AS idle_run FROM cumulated)
        SELECT run, min(CASE WHEN idle_run >= 10 THEN epoch END) AS stop_epoch FROM streak GROUP BY 1""",
)
def w5(t: Tables) -> DataFrame:
    return ep.early_stop(d.epochs(t), RUN, patience=10, reset=True)


@query(
    "w6_check_log",
    f"""WITH {d.EPOCHS},
        steps AS (SELECT run, lead(epoch) OVER (PARTITION BY run ORDER BY epoch) - epoch AS step FROM epochs)
        SELECT run, count(*) AS n_epochs, CASE WHEN max(step) > 1 THEN 'epochs not consecutive' END AS _error FROM steps GROUP BY 1""",
)
def w6(t: Tables) -> DataFrame:
    return ep.check_log(d.epochs(t), RUN, n_loss=None, planned=None)


LOG_FAULTS = {
    1: "not three sections", 2: "epochs not consecutive", 3: "epochs not in order", 4: "planned epochs differ", 5: "not one loss line per epoch",
    6: "not one validation line per epoch", 7: "not one validation line in the final part",
}


@query(
    "w6_check_log_text",
    "SELECT CAST(user_id AS VARCHAR) AS file, 3::BIGINT AS n_epochs, CASE user_id % 8 "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in LOG_FAULTS.items()) + " END AS _error FROM (SELECT DISTINCT user_id FROM events)",
)
def w6_text(t: Tables) -> DataFrame:
    """Logs of three epochs, seven of eight with one fault each."""
    fault = F.col("user_id") % 8

    def unless(k: int, sound, faulty) -> Column:
        return F.when(fault == k, F.lit(faulty)).otherwise(F.lit(sound))

    def epoch(number: Column, i: int) -> Column:
        planned = unless(4, "3", str(i + 3))
        loss = unless(5, "10/10 - 7s - loss: 0.5\n", "no line\n" if i == 1 else "10/10 - 7s - loss: 0.5\n")
        val = unless(6, "Validation time: 1.5\n", "Validation time: 1.5\nValidation time: 2\n" if i == 2 else "Validation time: 1.5\n")
        return F.concat(F.lit(ep.EPOCH_MARK), number, F.lit("/"), planned, F.lit("\n"), loss, val)

    numbers = [unless(3, "1", "2"), unless(3, "2", "1"), unless(2, "3", "4")]
    last = F.concat(F.lit(ep.FINAL_MARK), unless(7, "\nValidation time: 3\n", "\nnothing\n"))
    text = F.concat(
        F.lit(f"{ep.PARTITION_MARK} 0\n{ep.RUN_MARK}0\n"), *[epoch(n, i) for i, n in enumerate(numbers)],
        F.lit(f"{ep.FINAL_MARK}\nValidation time: 2\n"), F.when(fault == 1, "").otherwise(last),
    )
    logs = t.events.select("user_id").distinct().select(F.col("user_id").cast("string").alias("file"), text.alias("text"))
    return ep.check_log(ep.parse_log(logs), ["file"]).withColumn("n_epochs", F.col("n_epochs").cast("long"))


@query(
    "a21_epoch_loss",
    """SELECT user_id AS run, CAST((CAST(floor(epoch(ts)) AS BIGINT) - 1704067200) // 43200 AS INT) + 1 AS epoch,
              round(avg(value), 6) AS mean_loss, count(*) AS n_steps FROM events GROUP BY 1, 2""",
)
def a21(t: Tables) -> DataFrame:
    steps = t.events.select(
        F.col("user_id").alias("run"), F.expr("cast(timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 43200 as int) + 1").alias("epoch"), F.col("value").alias("loss")
    )
    return ep.epoch_loss(steps, ["run", "epoch"]).withColumn("mean_loss", F.round("mean_loss", 6))


TIMES = {
    "avg_time_per_epoch": "avg(train_s)", "total_train_time_at_best_model": "sum(CASE WHEN epoch <= best THEN train_s END)",
    "total_train_time_at_finish": "sum(train_s)", "total_val_time_at_best_model": "sum(CASE WHEN epoch <= best THEN val_s END)",
    "total_val_time_at_finish": "sum(val_s)",
    "total_time_at_best_model": "sum(CASE WHEN epoch <= best THEN train_s END) + sum(CASE WHEN epoch <= best THEN val_s END)",
    "total_time_at_finish": "sum(train_s) + sum(val_s)", "final_evaluation_time": "max(final_s)",
}
TIMES_SQL = ", ".join(f"round({e}, 7) AS {c}" for c, e in TIMES.items())


def timed(t: Tables) -> DataFrame:
    best = d.epochs(t).withColumn("is_best", F.col("f1") > 0.9).withColumn("final_s", F.col("val_s") + F.col("run"))
    times = ep.run_times(best, RUN)
    return times.withColumns({c: F.round(c, 7) for c in TIMES})


RUN_TIMES = f"""WITH {d.EPOCHS}, marked AS (SELECT *, val_s + run AS final_s, max(CASE WHEN f1 > 0.9 THEN epoch END) OVER (PARTITION BY run) AS best FROM epochs)
        SELECT run, max(best) AS number_of_epoch_at_best_model, count(*) AS number_of_epoch_at_finish, {TIMES_SQL} FROM marked GROUP BY 1"""


@query("a22_run_times", RUN_TIMES)
def a22(t: Tables) -> DataFrame:
    return timed(t)


@query(
    "a22_run_times_summed",
    f"SELECT round(sum(total_time_at_finish), 2) AS total_time_at_finish, CAST(sum(number_of_epoch_at_finish) AS BIGINT) AS number_of_epoch_at_finish FROM ({RUN_TIMES})",
)
def a22b(t: Tables) -> DataFrame:
    sums = ep.summarise_runs(timed(t), "sum")
    return sums.select(F.round("total_time_at_finish", 2).alias("total_time_at_finish"), "number_of_epoch_at_finish")


def log_texts(t: Tables) -> DataFrame:
    """A training log per event: two partitions with two runs each, of up to four epochs."""
    event = F.col("event_id")

    def epoch_text(part, run, epoch):
        best = F.when(epoch == 1 + (event + run) % 3, F.lit("Saving best model at epoch\n")).otherwise(F.lit(""))
        return F.concat(
            F.lit("Epoch "), epoch.cast("string"), F.lit("/4\n100/100 [====] - "), ((event + part + run + epoch) % 60).cast("string"),
            F.lit("s - loss: 0.25 - acc: 0.9\nValidation time: "), F.format_string("%d.5", (event * 3 + epoch) % 20), F.lit("\n"), best,
        )

    def run_text(part, run):
        epochs = F.transform(F.sequence(F.lit(1).cast("bigint"), 1 + (event + run) % 4), lambda e: epoch_text(part, run, e))
        return F.concat(
            F.lit("Run # "), run.cast("string"), F.lit("\n"), F.array_join(epochs, ""),
            F.lit("Evaluating the best model on validation\nValidation time: 1.0\nEvaluating the best model on test\nValidation time: "),
            F.format_string("%d.25", (event + run) % 10), F.lit("\n"),
        )

    def part_text(part):
        runs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint")), lambda r: run_text(part, r))
        return F.concat(F.lit("Current partition: "), part.cast("string"), F.lit("\n"), F.array_join(runs, ""))

    parts = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint")), part_text)
    return t.events.select(event, F.concat(F.lit("start\n"), F.array_join(parts, "")).alias("text"))


LOGS = """parts AS (SELECT unnest(range(2)) AS partition), runs AS (SELECT unnest(range(2)) AS run), es AS (SELECT unnest(range(1, 5)) AS epoch),
log_rows AS (
  SELECT event_id, CAST(partition AS INT) AS partition, CAST(run AS INT) AS run, CAST(epoch AS INT) AS epoch,
         CAST((event_id + partition + run + epoch) % 60 AS INT) AS train_s, (event_id * 3 + epoch) % 20 + 0.5::DOUBLE AS val_s,
         (event_id + run) % 10 + 0.25::DOUBLE AS final_s, epoch = 1 + (event_id + run) % 3 AS is_best
  FROM events, parts, runs, es WHERE epoch <= 1 + (event_id + run) % 4)"""


@query("f32_parse_log", f"WITH {LOGS} SELECT event_id, partition, run, epoch, train_s, val_s, final_s, is_best FROM log_rows")
def f32(t: Tables) -> DataFrame:
    parsed = ep.parse_log(log_texts(t), "event_id")
    return parsed.select("event_id", "partition", "run", "epoch", "train_s", "val_s", "final_s", "is_best")


@query(
    "f32_log_run_times",
    f"""WITH {LOGS}, marked AS (SELECT *, max(CASE WHEN is_best THEN epoch END) OVER (PARTITION BY event_id, partition, run) AS best FROM log_rows)
        SELECT event_id, partition, run, max(best) AS best_epoch, count(*) AS n_epochs,
               CAST(sum(CASE WHEN epoch <= best THEN train_s END) AS BIGINT) AS train_to_best, sum(train_s + val_s) AS total
        FROM marked GROUP BY 1, 2, 3""",
)
def f32b(t: Tables) -> DataFrame:
    times = ep.run_times(ep.parse_log(log_texts(t), "event_id"), ["event_id", "partition", "run"])
    return times.select(
        "event_id", "partition", "run", F.col("number_of_epoch_at_best_model").alias("best_epoch"),
        F.col("number_of_epoch_at_finish").alias("n_epochs"), F.col("total_train_time_at_best_model").alias("train_to_best"),
        F.col("total_time_at_finish").alias("total"),
    )


@query(
    "w6_check_counts",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 2 END::BIGINT AS n_partitions, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS min_runs,
              CASE WHEN event_id % 3 = 0 AND (event_id % 6 = 0 OR event_id % 5 = 0) THEN 1 ELSE 2 END::BIGINT AS max_runs
       FROM events WHERE event_id % 3 = 0 OR event_id % 5 = 0""",
)
def w6b(t: Tables) -> DataFrame:
    """Logs that lack a run in the first or in both partitions, or lack the second partition."""
    runs = ep.parse_runs(log_texts(t), "event_id")
    whole = F.expr("(event_id % 3 <> 0 or run = 0 or (partition = 1 and event_id % 6 <> 0)) and (event_id % 5 <> 0 or partition = 0)")
    return ep.check_counts(runs.filter(whole), "event_id", n_partitions=2, n_runs=2)


def wide(t: Tables) -> DataFrame:
    """Multi-task results with metric columns per scenario."""
    v = F.col("value")
    return t.events.select(
        F.col("event_id").alias("run"), F.col("event_type").alias("set"), F.lit(0).alias("fold"),
        v.alias("accuracy"), (v + 1).alias("f1-score"), (v + 2).alias("mcc"), (v / 100).alias("pred_time"),
        (v + 3).alias("cvss2_conf_acc"), (v + 4).alias("cvss2_conf_f1"), (v + 5).alias("cvss2_avail_acc"), (v + 6).alias("cvss2_avail_mcc"),
    )


@query(
    "f34_wide_to_long",
    """SELECT event_id AS run, event_type AS "set", 0 AS fold, value / 100 AS time_pred, scenario,
              value + acc AS acc, value + f1 AS f1, value + mcc AS mcc
       FROM events, (VALUES ('multitask', 0, 1, 2), ('cvss2_conf', 3, 4, NULL), ('cvss2_avail', 5, NULL, 6)) s(scenario, acc, f1, mcc)""",
)
def f34(t: Tables) -> DataFrame:
    long = rs.transform_multitask(wide(t))
    return long.select("run", "set", "fold", "time_pred", "scenario", "acc", "f1", "mcc")


@query(
    "f33_reverse_names",
    """SELECT event_id AS run, event_type AS "set", 0 AS fold, value AS acc_multitask, value + 1 AS f1_multitask, value + 2 AS mcc_multitask, value / 100 AS time_pred,
              value + 3 AS acc_cvss2_conf, value + 4 AS f1_cvss2_conf, value + 5 AS acc_cvss2_avail, value + 6 AS mcc_cvss2_avail FROM events""",
)
def f33(t: Tables) -> DataFrame:
    df = wide(t)
    return df.toDF(*rs.reverse_names(df.columns))


@query(
    "f34_multitask_mean",
    """SELECT scenario, round(avg(value + acc), 6) AS acc, round(avg(value + f1), 6) AS f1, round(avg(value + mcc), 6) AS mcc
       FROM events, (VALUES ('multitask', 0, 1, 2), ('cvss2_conf', 3, 4, NULL), ('cvss2_avail', 5, NULL, 6)) s(scenario, acc, f1, mcc) GROUP BY 1""",
)
def f34b(t: Tables) -> DataFrame:
    means = rs.transform_multitask(wide(t), avg=True)
    return means.select("scenario", *[F.round(c, 6).alias(c) for c in ("acc", "f1", "mcc")])
