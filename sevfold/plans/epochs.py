"""Training logs and the series of epochs they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sevfold.operators.aggregates import summarise
from sevfold.operators.ranking import running

# Markers of the log text.
PARTITION_MARK = "Current partition:"
RUN_MARK = "Run # "
FINAL_MARK = "Evaluating the best model"
EPOCH_MARK = "Epoch "
BEST_MARK = "Saving best model at epoch"
LOSS_MARK = "loss: "
EPOCH_SECONDS = r" - (\d+)s(?= |$)"
VALIDATION_MARK = "Validation time:"
VALIDATION_SECONDS = r"Validation time: *(\d+(?:\.\d+)?)"
VALIDATION_LINE = r"Validation time:"
#: Sections of a run: training, evaluation on the validation part, final evaluation.
N_SECTIONS = 3


def parts_after(text: Column, mark: str) -> Column:
    """Pieces of a text that follow each occurrence of a mark."""
    pieces = F.split(text, rf"\Q{mark}\E")
    return F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))


def parse_runs(logs: DataFrame, log: str = "file", text: str = "text") -> DataFrame:
    """One row per run: its position, its training text and its final evaluation text."""
    parts = logs.select(log, F.posexplode(parts_after(F.col(text), PARTITION_MARK)).alias("partition", "_p"))
    runs = parts.select(log, "partition", F.posexplode(parts_after(F.col("_p"), RUN_MARK)).alias("run", "_r"))
    sections = F.split(F.col("_r"), rf"\Q{FINAL_MARK}\E")
    return runs.select(
        log, "partition", "run", sections[0].alias("train_text"), F.size(sections).alias("n_sections"),
        F.get(sections, F.lit(2)).alias("final_text"),
    )


def parse_log(logs: DataFrame, log: str = "file", text: str = "text") -> DataFrame:
    """One row per epoch of each run, with the run's final evaluation seconds repeated."""
    final = F.col("final_text")
    runs = parse_runs(logs, log, text).withColumn("final_s", first_number(final))
    runs = runs.withColumn("n_final_lines", F.coalesce(F.regexp_count(final, F.lit(VALIDATION_LINE)), F.lit(0)))
    kept = [log, "partition", "run", "n_sections", "final_s", "n_final_lines"]
    epochs = runs.select(*kept, F.posexplode(parts_after(F.col("train_text"), EPOCH_MARK)).alias("place", "_e"))
    # The text of an epoch is cut in lines once; patterns see the few lines that hold their mark.
    lines = epochs.withColumn("_l", F.filter(F.split("_e", "\n"), lambda x, i: (i == 0) | F.contains(x, F.lit(LOSS_MARK)) | F.contains(x, F.lit(VALIDATION_MARK)) | F.contains(x, F.lit(BEST_MARK))))
    head = F.split(F.regexp_extract(F.get("_l", F.lit(0)), r"^\d+/\d+", 0), "/")
    loss = F.filter("_l", lambda x: F.contains(x, F.lit(LOSS_MARK)))
    marked = F.filter("_l", lambda x: F.contains(x, F.lit(VALIDATION_MARK)))
    found = lines.select(*kept, "place", "_l", head.alias("_h"), loss.alias("_loss"), F.array_join(marked, "\n").alias("_val"))
    return found.select(
        *kept, "place",
        F.get("_h", F.lit(0)).try_cast("int").alias("epoch"),
        F.get("_h", F.lit(1)).try_cast("int").alias("n_planned"),
        F.size("_loss").alias("n_loss_lines"),
        F.regexp_extract(F.get("_loss", F.lit(0)), EPOCH_SECONDS, 1).try_cast("int").alias("train_s"),
        first_number(F.col("_val")).alias("val_s"),
        F.regexp_count("_val", F.lit(VALIDATION_LINE)).alias("n_val_lines"),
        F.exists("_l", lambda x: F.contains(x, F.lit(BEST_MARK))).alias("is_best"),
    )


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, VALIDATION_SECONDS, 1).try_cast("double")


def check_log(
    epochs: DataFrame, run: list[str], n_loss: str | None = "n_loss_lines", planned: str | None = "n_planned",
    place: str | None = "place", n_val: str | None = "n_val_lines", n_final: str | None = "n_final_lines", sections: str | None = "n_sections",
) -> DataFrame:
    """Runs with what is wrong in them: ``_error`` is null for a sound run.

    A run has three sections. Its epochs must be consecutive and stand in their order, the
    planned number is constant, each epoch has one loss line with seconds and one validation
    line with a number, and so has the final part. Without repeats, max - min + 1 = count says
    that epochs are consecutive. A check is made where the table has its column; None leaves it out.
    """
    place, n_val, n_final, sections = (c if c in epochs.columns else None for c in (place, n_val, n_final, sections))
    seconds = {c: c for c in ("train_s", "val_s", "final_s") if c in epochs.columns}

    def not_one(c: str | None, value: str | None = None) -> Column:
        if c is None:
            return F.lit(0)
        bad = F.coalesce(F.col(c) != 1, F.lit(True)) | (F.col(value).isNull() if value else F.lit(False))
        return F.max(F.when(bad, 1).otherwise(0))

    checks = [
        F.count("*").alias("n_epochs"),
        (F.max("epoch") - F.min("epoch") + 1).alias("_range"),
        F.count_distinct("epoch").alias("_distinct"),
        (F.max(planned) - F.min(planned) if planned else F.lit(0)).alias("_planned"),
        (F.max(F.col("epoch") - F.col(place)) - F.min(F.col("epoch") - F.col(place)) if place else F.lit(0)).alias("_order"),
        not_one(n_loss, seconds.get("train_s")).alias("_loss"),
        not_one(n_val, seconds.get("val_s")).alias("_val"),
        not_one(n_final, seconds.get("final_s")).alias("_final"),
        (F.max(F.when(F.col(sections) == N_SECTIONS, 0).otherwise(1)) if sections else F.lit(0)).alias("_sections"),
    ]
    found = epochs.groupBy(*run).agg(*checks)
    gap = (F.col("_range") != F.col("n_epochs")) | (F.col("_distinct") != F.col("n_epochs"))
    error = (
        F.when(F.col("_sections") > 0, "not three sections")
        .when(F.coalesce(gap, F.lit(True)), "epochs not consecutive")
        .when(F.coalesce(F.col("_order") != 0, F.lit(True)), "epochs not in order")
        .when(F.coalesce(F.col("_planned") != 0, F.lit(True)), "planned epochs differ")
        .when(F.col("_loss") > 0, "not one loss line per epoch")
        .when(F.col("_val") > 0, "not one validation line per epoch")
        .when(F.col("_final") > 0, "not one validation line in the final part")
    )
    return found.withColumn("_error", error).select(*run, "n_epochs", "_error")


def check_counts(runs: DataFrame, log: str, n_partitions: int = 10, n_runs: int = 10) -> DataFrame:
    """Logs with another number of partitions or of runs in a partition than expected."""
    per_part = runs.groupBy(log, "partition").agg(F.count_distinct("run").alias("n_runs"))
    return (
        per_part.groupBy(log)
        .agg(F.count("*").alias("n_partitions"), F.min("n_runs").alias("min_runs"), F.max("n_runs").alias("max_runs"))
        .filter((F.col("n_partitions") != n_partitions) | (F.col("min_runs") != n_runs) | (F.col("max_runs") != n_runs))
    )


def best_epoch(epochs: DataFrame, run: list[str], metric: str = "f1", epoch: str = "epoch") -> DataFrame:
    """Last epoch that improved strictly on all before it, which is the first one to reach the
    maximum. Runs that never exceed 0 have none."""
    valid = (F.col(metric) > 0) & ~F.isnan(metric)
    order = F.when(valid, F.struct(-F.col(metric), F.col(epoch)))
    best = F.min_by(F.struct(F.col(epoch).alias("best_epoch"), F.col(metric).alias("best_value")), order)
    return epochs.groupBy(*run).agg(best.alias("_b")).select(*run, "_b.*")


def with_improvement(epochs: DataFrame, run: list[str], metric: str, epoch: str, span: int = 4096) -> DataFrame:
    """Flag epochs whose metric exceeds 0 and every earlier one; NaN never does."""
    value = F.when(F.isnan(metric), F.lit(None)).otherwise(F.col(metric))
    seen = running(epochs, run, epoch, value, "max", "_seen", span, exclusive=True)
    better = F.coalesce(value > F.greatest(F.coalesce("_seen", F.lit(0.0)), F.lit(0.0)), F.lit(False))
    return seen.withColumn("improved", better).drop("_seen")


def _records(rows: Column) -> Column:
    """Places and values of the epochs of a span that exceed all before them in it."""
    start = F.struct(F.lit(None).cast("double").alias("top"), F.array().cast("array<struct<at:int,value:double>>").alias("found"))

    def step(state: Column, row: Column) -> Column:
        higher = row["value"].isNotNull() & (state["top"].isNull() | (row["value"] > state["top"]))
        entry = F.struct(row["at"].alias("at"), row["value"].alias("value"))
        return F.when(
            higher, F.struct(row["value"].alias("top"), F.concat(state["found"], F.array(entry)).alias("found"))
        ).otherwise(state)

    placed = F.transform(rows, lambda r, i: F.struct(i.alias("at"), r["value"].alias("value")))
    return F.aggregate(placed, start, step, lambda state: state["found"])


def early_stop(
    epochs: DataFrame, run: list[str], patience: int = 10, reset: bool = False, metric: str = "f1", epoch: str = "epoch", span: int = 4096
) -> DataFrame:
    """Epoch at which training stops, null where it runs to the end.

    Without ``reset`` non-improving epochs add up over the whole run; with it, an improvement
    starts the count anew. One scan: a span of at most ``span`` epochs is one row with its records,
    which of them improve follows from the best of the spans before it, and what a span adds to the
    count is a number that is summed along the run. ``epoch`` is a whole number, unique in a run.
    """
    value = F.when(F.isnan(metric), F.lit(None)).otherwise(F.col(metric)).cast("double")
    rows = epochs.select(*run, F.floor(F.col(epoch) / span).alias("_span"), F.struct(F.col(epoch).alias("epoch"), value.alias("value")).alias("_row"))
    spans = rows.groupBy(*run, "_span").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    spans = spans.withColumn("_records", _records(F.col("_rows"))).withColumn("_n", F.size("_rows"))

    earlier = Window.partitionBy(*run).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    best = F.greatest(F.coalesce(F.max(F.try_element_at(F.col("_records")["value"], F.lit(-1))).over(earlier), F.lit(0.0)), F.lit(0.0))
    spans = spans.withColumn("_best", best).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    spans = spans.withColumn("_better", F.filter("_records", lambda r: r["value"] > F.col("_best"))["at"]).drop("_records")
    if reset:
        last = F.max(F.col("_before") + F.try_element_at("_better", F.lit(-1)) + 1).over(earlier)
        idle = F.col("_before") - F.coalesce(last, F.lit(0))
        starts = F.concat(F.array((-1 - F.col("_idle")).cast("int")), F.col("_better"))
        ends = F.concat(F.col("_better"), F.array("_n"))
        reached = F.filter(
            F.zip_with(starts, ends, lambda a, e: F.when(F.greatest(a + patience, F.lit(0)) < e, F.greatest(a + patience, F.lit(0)))), lambda x: x.isNotNull()
        )
        at = F.array_min(reached)
    else:
        idle = F.coalesce(F.sum(F.col("_n") - F.size("_better")).over(earlier), F.lit(0))
        others = F.array_except(F.sequence(F.lit(0), F.col("_n") - 1), F.col("_better"))
        at = F.when(F.col("_idle") >= patience, F.lit(0)).otherwise(F.get(others, (F.lit(patience - 1) - F.col("_idle")).cast("int")))
    stopped = spans.withColumn("_idle", idle).withColumn("_at", at)
    return stopped.groupBy(*run).agg(F.min(F.get("_rows", F.col("_at"))["epoch"]).alias("stop_epoch"))


def epoch_loss(steps: DataFrame, keys: list[str], loss: str = "loss") -> DataFrame:
    """Mean loss per epoch from a table of training steps."""
    return steps.groupBy(*keys).agg(F.avg(loss).alias("mean_loss"), F.count("*").alias("n_steps"))


def run_times(epochs: DataFrame, run: list[str], best: Column | None = None) -> DataFrame:
    """Seconds per run: mean per epoch, sums up to the best epoch and to the end, final evaluation.

    The best epoch is the last one flagged ``is_best``, null where none is.
    """
    until_best = best if best is not None else F.col("_best")
    marked = epochs
    if best is None:
        last_best = epochs.filter("is_best").groupBy(*run).agg(F.max("epoch").alias("_best"))
        marked = epochs.join(last_best, run, "left")

    def to_best(c: str) -> Column:
        return F.sum(F.when(F.col("epoch") <= until_best, F.col(c)))

    train, val = F.sum("train_s"), F.sum("val_s")
    return marked.groupBy(*run).agg(
        F.avg("train_s").alias("avg_time_per_epoch"),
        F.max(until_best).alias("number_of_epoch_at_best_model"),
        F.count("*").alias("number_of_epoch_at_finish"),
        to_best("train_s").alias("total_train_time_at_best_model"),
        train.alias("total_train_time_at_finish"),
        to_best("val_s").alias("total_val_time_at_best_model"),
        val.alias("total_val_time_at_finish"),
        (to_best("train_s") + to_best("val_s")).alias("total_time_at_best_model"),
        (train + val).alias("total_time_at_finish"),
        F.max("final_s").alias("final_evaluation_time"),
    )


def summarise_runs(times: DataFrame, how: str | None = None) -> DataFrame:
    """The run table itself, or the mean or sum of its columns."""
    return times if how is None else summarise(times, how)
