"""Result analysis against published numbers, and training logs on hand-made series."""

import pathlib

import random

import pytest
from pyspark.sql import functions as F

from sevfold.plans import epochs as ep, models as md, results as rs
from sevfold.sources import readers

DATA = pathlib.Path(__file__).parent / "data"


@pytest.fixture(scope="module")
def published(spark):
    schema = "feature string, classifier string, parameters string, val_mcc double, train_time double, test_mcc double"
    keys = {"problem": F.lit("cvss3_severity"), "granularity": F.lit("method"), "scope": F.lit("whole")}
    return readers.read_result_files(spark, str(DATA), schema, "published_results").withColumns(keys)


def test_best_parameters(published):
    best = {r["classifier"]: (r["parameters"], round(r["mean_metric"], 4)) for r in rs.best_params(published).collect()}
    assert best == {"lgbm": ("300-100", 0.1435), "rf": ("200-300", 0.132)}
    chosen = {(r["classifier"], r["feature"]): r["test_mcc"] for r in rs.best_result_rows(published).collect()}
    assert chosen == {("lgbm", "codebert"): 0.102, ("lgbm", "subwords"): 0.197, ("rf", "codebert"): 0.051, ("rf", "subwords"): 0.152}


def test_best_run_per_feature(published):
    averages = rs.average_results(published)
    assert averages.count() == 60
    best = {r["feature"]: (r["classifier"], r["parameters"], r["val_mcc"], r["test_mcc"]) for r in rs.best_per_group(averages, ["problem", "granularity", "scope", "feature"]).collect()}
    assert best == {"codebert": ("lgbm", "300-100", 0.163, 0.102), "subwords": ("lgbm", "100-200", 0.131, 0.14)}


def test_best_ignores_nan_and_keeps_first_of_ties(spark):
    rows = [("p", "rf", "200-100", 0.5), ("p", "lgbm", "300-100", 0.5), ("p", "lgbm", "100-100", float("nan")), ("q", "rf", "100-100", -0.5)]
    df = spark.createDataFrame(rows, "problem string, classifier string, parameters string, val_mcc double")
    assert {r["problem"]: r["classifier"] for r in rs.best_per_group(df, ["problem"]).collect()} == {"p": "lgbm", "q": "rf"}
    assert [r["parameters"] for r in rs.best_params(df.filter("problem = 'q'")).collect()] == []
    tied = spark.createDataFrame([("rf", "300-100", 0.4), ("rf", "100-300", 0.4)], "classifier string, parameters string, val_mcc double")
    assert rs.best_params(tied).first()["parameters"] == "100-300"


def test_reverse_names():
    assert rs.reverse_names(["run", "accuracy", "f1-score", "cvss2_conf_acc", "pred_time"]) == ["run", "acc_multitask", "f1_multitask", "acc_cvss2_conf", "time_pred"]
    with pytest.raises(ValueError):
        rs.reverse_names(["cvss2_conf"])


def test_param_grid(spark):
    grid = rs.grid_of(spark.range(1), "knn").orderBy("grid_index").collect()
    assert len(grid) == 16 and grid[1]["parameters"] == "5-uniform-2" and grid[15]["grid_index"] == 15


def series(spark, *runs):
    rows = [(r, e + 1, None if v is None else float(v)) for r, values in enumerate(runs) for e, v in enumerate(values)]
    return spark.createDataFrame(rows, "run int, epoch int, f1 double")


@pytest.mark.parametrize("span", [2, 4096])
def test_early_stop(spark, span):
    df = series(
        spark, [0, 0, 0, 0], [1, 2, 3, 4], [3, 1, 4, 1, 5, 1, 6], [5, 1, 2, 3, 4], [float("nan"), 1, float("nan"), 0.5, 0.7],
    )
    cumulative = {r["run"]: r["stop_epoch"] for r in ep.early_stop(df, ["run"], 3, span=span).collect()}
    assert cumulative == {0: 3, 1: None, 2: 6, 3: 4, 4: 4}
    consecutive = {r["run"]: r["stop_epoch"] for r in ep.early_stop(df, ["run"], 3, reset=True, span=span).collect()}
    assert consecutive == {0: 3, 1: None, 2: None, 3: 4, 4: 5}
    best = {r["run"]: r["best_epoch"] for r in ep.best_epoch(df, ["run"]).collect()}
    assert best == {0: None, 1: 4, 2: 7, 3: 1, 4: 2}


def test_check_log(spark):
    df = spark.createDataFrame(
        [("ok", 1, 5, 1), ("ok", 2, 5, 1), ("gap", 1, 5, 1), ("gap", 3, 5, 1), ("plan", 1, 5, 1), ("plan", 2, 6, 1), ("loss", 1, 5, 2), ("twice", 1, 5, 1), ("twice", 1, 5, 1)],
        "run string, epoch int, n_planned int, n_loss_lines int",
    )
    errors = {r["run"]: r["_error"] for r in ep.check_log(df, ["run"]).collect()}
    assert errors == {
        "ok": None, "gap": "epochs not consecutive", "plan": "planned epochs differ",
        "loss": "not one loss line per epoch", "twice": "epochs not consecutive",
    }


def test_log_file(spark, tmp_path):
    run = "Run # 1\nEpoch 1/9\n10/10 - 5s - loss: 0.5\nValidation time: 1.5\nSaving best model at epoch 1\nEpoch 2/9\n10/10 - 7s - loss: 0.4\nValidation time: 2.5\n"
    ends = "Evaluating the best model\nEvaluating the best model\nValidation time: 3.25\n"
    (tmp_path / "train.log").write_text("head\nCurrent partition: 0\n" + run + ends + run.replace("Saving best model", "Keeping model") + ends)
    logs = readers.read_logs(spark, str(tmp_path))
    epochs = ep.parse_log(logs)
    assert [(r["run"], r["epoch"], r["n_planned"], r["train_s"], r["val_s"], r["is_best"]) for r in epochs.orderBy("run", "epoch").collect()] == [
        (0, 1, 9, 5, 1.5, True), (0, 2, 9, 7, 2.5, False), (1, 1, 9, 5, 1.5, False), (1, 2, 9, 7, 2.5, False),
    ]
    times = {r["run"]: r for r in ep.run_times(epochs, ["file", "partition", "run"]).collect()}
    assert (times[0]["number_of_epoch_at_best_model"], times[0]["total_time_at_best_model"], times[0]["total_time_at_finish"]) == (1, 6.5, 16.0)
    assert (times[1]["number_of_epoch_at_best_model"], times[1]["final_evaluation_time"]) == (None, 3.25)
    assert ep.check_counts(ep.parse_runs(logs), "file", 1, 2).count() == 0
    assert ep.check_counts(ep.parse_runs(logs), "file").count() == 1
    with pytest.raises(ValueError):
        ep.summarise_runs(epochs, "median")


def test_result_files_by_name(spark, tmp_path):
    for name in ("code_hc_word_6_x.csv", "code_hc_word.csv"):
        (tmp_path / name).write_text("run,mcc\n1,0.5\n")
    assert readers.read_results(spark, str(tmp_path), 5, "run int, mcc double").collect() == [(1, 0.5, "code", "hc", "word", "6")]
    (tmp_path / "code_hc_word_cvss3_conf_1_x.csv").write_text("run,mcc\n1,0.5\n")
    with pytest.raises(Exception, match="not a cvss2 result file"):
        readers.read_results(spark, str(tmp_path), 7, "run int, mcc double").collect()


def test_classifiers_learn(spark):
    from pyspark.ml.functions import array_to_vector

    rows = [(i, float(i % 3), [float(i % 3 == j) * 3 + 0.1 * ((i * 7 + j) % 5) for j in range(3)], ("train", "train", "train", "valid", "test")[i % 5]) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, label double, v array<double>, partition string").withColumn("features", array_to_vector("v"))
    job = {"problem": "p", "granularity": "method", "scope": "whole", "feature": "bow"}
    models = {"nb": [()], "svm": [(1,)], "lr": [(10,)], "rf": [(5, 8), (3, None)], "gbt": [(2, 4)], "knn": [(5, "distance", 2), (3, "uniform", 1)]}
    out = md.run_grid(df, job, models).collect()
    assert [r["classifier"] for r in out] == [name for name, grid in models.items() for _ in grid]
    assert all(r["val_mcc"] > 0.9 and r["test_acc"] > 0.9 for r in out)


@pytest.mark.parametrize("span", [2, 5, 4096])
def test_early_stop_same_as_a_loop(spark, span):
    rnd = random.Random(span)
    runs = {r: [rnd.choice([None, float("nan"), 0.0, -1.0, rnd.random(), rnd.random() * (i + 1) / 40]) for i in range(rnd.randint(1, 40))] for r in range(120)}
    df = spark.createDataFrame([(r, i + 3, v) for r, vs in runs.items() for i, v in enumerate(vs)], "run int, epoch int, f1 double")

    def stops(values, patience, reset):
        best, idle = 0.0, 0
        for i, v in enumerate(values):
            if v is not None and v == v and v > best:
                best, idle = v, 0 if reset else idle
            else:
                idle += 1
            if idle >= patience:
                return i + 3
        return None

    for patience in (1, 4):
        for reset in (False, True):
            out = ep.early_stop(df, ["run"], patience, reset, span=span)
            assert {r["run"]: r["stop_epoch"] for r in out.collect()} == {r: stops(vs, patience, reset) for r, vs in runs.items()}
    plan = ep.early_stop(df, ["run"], 3, True, span=span)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
