"""Tables derived from the given ones, for Spark and as common table expressions for SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sevfold.functions.code import let, split_lines
from sevfold.queries.registry import Tables

SEVERITY_SQL = (
    "CASE doc_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END"
)
PARTITION_SQL = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'valid' ELSE 'test' END"


def documents(t: Tables) -> DataFrame:
    return with_labels(t.documents)


def with_labels(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"severity": F.expr(SEVERITY_SQL), "partition": F.expr(PARTITION_SQL)})


DOCS = f"docs AS (SELECT *, {SEVERITY_SQL} AS severity, {PARTITION_SQL} AS partition FROM documents)"


def funcs(t: Tables, *keep: str) -> DataFrame:
    """Documents as functions with comments, tabs and a list of vulnerable lines; ``keep`` names more columns.

    A function without lines, of an empty or null text, lists none."""
    code = F.replace(
        F.replace(F.col("text"), F.lit(", "), F.lit(" /* c */ ")), F.lit(". "), F.lit("; // n\n\t")
    )

    def listed(n: Column) -> Column:
        place = F.col("id") % n  # taken first, so that seven times a large id is no overflow
        first, second = (place + 1).cast("string"), ((place * 7) % n + 1).cast("string")
        return F.when(n == 0, "").when(first == second, first).otherwise(F.concat_ws(" ", first, second))

    return (
        documents(t)
        .select(F.col("doc_id").alias("id"), F.col("source").alias("cve_id"), code.alias("func_before"), "lang", "n_chars", "severity", "partition", *keep)
        .withColumn("vul_line", let(F.size(split_lines(F.col("func_before"))), listed))
    )


FUNCS = f"""{DOCS},
funcs0 AS (
  SELECT doc_id AS id, source AS cve_id,
         replace(replace(text, ', ', ' /* c */ '), '. ', '; // n' || chr(10) || chr(9)) AS func_before,
         lang, n_chars, severity, partition
  FROM docs),
funcs1 AS (SELECT *, string_split(func_before, chr(10)) AS raw FROM funcs0),
funcs2 AS (
  SELECT * EXCLUDE (raw), CASE WHEN raw[len(raw)] = '' THEN list_slice(raw, 1, len(raw) - 1) ELSE raw END AS lines
  FROM funcs1),
funcs AS (
  SELECT *, CASE WHEN id % len(lines) = (id * 7) % len(lines) THEN [id % len(lines) + 1]
            ELSE [id % len(lines) + 1, (id * 7) % len(lines) + 1] END AS vul
  FROM funcs2)"""


def preds(t: Tables) -> DataFrame:
    """Two classes: quality against a rule on the length."""
    return t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select(
        "doc_id", "lang", F.col("quality").alias("gold"), F.when(F.col("n_chars") > 2000, 1).otherwise(0).alias("pred")
    )


PREDS = """preds AS (
  SELECT l.doc_id, d.lang, l.quality AS gold, CASE WHEN d.n_chars > 2000 THEN 1 ELSE 0 END AS pred
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def preds4(t: Tables) -> DataFrame:
    """Four classes: language against a rule on the length, per source."""
    pred = F.when(F.col("n_chars") % 5 == 0, "en").when(F.col("n_chars") % 7 == 0, "fr").otherwise(F.col("lang"))
    return t.documents.select("doc_id", "source", F.col("lang").alias("gold"), pred.alias("pred"))


PREDS4 = """preds4 AS (
  SELECT doc_id, source, lang AS gold,
         CASE WHEN n_chars % 5 = 0 THEN 'en' WHEN n_chars % 7 = 0 THEN 'fr' ELSE lang END AS pred
  FROM documents)"""


def results(t: Tables) -> DataFrame:
    """Experiment results: one row per event."""
    user = F.col("user_id")
    return t.events.select(
        "event_id",
        F.col("event_type").alias("problem"),
        F.lit("method").alias("granularity"),
        F.lit("whole").alias("scope"),
        F.lit("bow").alias("feature"),
        F.when(F.floor(user / 15) % 2 == 1, "rf").otherwise("lgbm").alias("classifier"),
        F.concat_ws("-", (100 * (1 + user % 5)).cast("string"), (100 * (1 + user % 3)).cast("string")).alias("parameters"),
        (F.col("value") / 500).alias("val_mcc"),
        F.col("value").alias("train_time"),
    )


RESULTS = """results AS (
  SELECT event_id, event_type AS problem, 'method' AS granularity, 'whole' AS scope, 'bow' AS feature,
         CASE WHEN (user_id // 15) % 2 = 1 THEN 'rf' ELSE 'lgbm' END AS classifier,
         concat_ws('-', 100 * (1 + user_id % 5), 100 * (1 + user_id % 3)) AS parameters,
         value / 500 AS val_mcc, value AS train_time
  FROM events)"""


def epochs(t: Tables) -> DataFrame:
    """Runs of epochs: a user is a run, and every twelve hours with events make one epoch."""
    return (
        t.events.groupBy(F.col("user_id").alias("run"), F.expr("cast(timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 43200 as int) + 1").alias("epoch"))
        .agg(
            (F.max("value") / 500).alias("f1"),
            F.sum("value").alias("train_s"),
            (F.min("value") / 10).alias("val_s"),
            F.count("*").alias("n_steps"),
        )
    )


EPOCHS = """epochs AS (
  SELECT user_id AS run, CAST((CAST(floor(epoch(ts)) AS BIGINT) - 1704067200) // 43200 AS INT) + 1 AS epoch,
         max(value) / 500 AS f1, sum(value) AS train_s, min(value) / 10 AS val_s, count(*) AS n_steps
  FROM events GROUP BY 1, 2)"""


def two_groups(t: Tables) -> DataFrame:
    """All events in two groups, clicks and errors as A, the rest as B, with a scenario per user."""
    return t.events.select(
        "event_id",
        F.when(F.col("event_type").isin("click", "error"), "A").otherwise("B").alias("group"),
        (F.col("user_id") % 7).cast("int").alias("scenario"),
        "value",
    )


TWO_GROUPS = """two_groups AS (
  SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN 'A' ELSE 'B' END AS grp,
         CAST(user_id % 7 AS INT) AS scenario, value
  FROM events)"""


def tokens_vec(t: Tables) -> DataFrame:
    """Ten word ids per document; ids without an embedding are unknown words."""
    return t.documents.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("pos")).select(
        "doc_id", "pos", ((F.col("doc_id") * 31 + F.col("pos") * 17) % 600).alias("vec_id")
    )


TOKENS_VEC = """tokens_vec AS (
  SELECT doc_id, pos, (doc_id * 31 + pos * 17) % 600 AS vec_id
  FROM documents CROSS JOIN (SELECT unnest(range(10)) AS pos))"""
