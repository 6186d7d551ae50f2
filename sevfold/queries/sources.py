"""Queries on readers and writers: what is written is read back whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sevfold.operators.relational import split_quarantine, with_quarantine
from sevfold.plans.pages import field, hrefs
from sevfold.plans.slices import slice_table
from sevfold.queries import derived as d
from sevfold.queries.registry import Tables, query
from sevfold.queries.text import SCOPE_SQL
from sevfold.sources import readers, writers
from sevfold.sources.paths import scratch


@query("s1_read_table", "SELECT doc_id, lang, source, n_chars FROM documents WHERE n_chars >= 100")
def s1(t: Tables) -> DataFrame:
    table = readers.read_table(t.spark, f"{t.sf_dir}/documents.parquet", "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return table.filter("n_chars >= 100").select("doc_id", "lang", "source", "n_chars")


@query("s2_read_csv", "SELECT doc_id, source, text FROM documents")
def s2(t: Tables) -> DataFrame:
    path = scratch(t.spark, "csv")
    writers.write_table(t.documents.select("doc_id", "source", "text"), path, "csv")
    return readers.read_csv(t.spark, path, "doc_id bigint, source string, text string", multi_line=True)


@query(
    "s3_read_jobs",
    "SELECT DISTINCT 'method' AS granularity, lang AS scope, 'cvss3_severity' AS cvss_col, source AS feature FROM documents",
)
def s3(t: Tables) -> DataFrame:
    path = scratch(t.spark, "jobs")
    jobs = t.documents.select(F.lit("method").alias("g"), F.col("lang").alias("s"), F.lit("cvss3_severity").alias("c"), F.col("source").alias("f"))
    jobs.distinct().write.csv(path)
    return readers.read_jobs(t.spark, path)



def folder_name():
    return F.regexp_extract(F.col("_metadata.file_path"), "name=([^/]*)/", 1)


@query(
    "s4_read_results_multitask",
    """SELECT event_id AS run, value AS mcc, event_type AS feature_type, 'hc' AS feature_scope, 'word' AS token,
              CAST(user_id % 5 AS VARCHAR) AS fold FROM events""",
)
def s4(t: Tables) -> DataFrame:
    path = scratch(t.spark, "results5")
    name = F.concat_ws("_", "event_type", F.lit("hc"), F.lit("word"), (F.col("user_id") % 5).cast("string"), F.lit("r.csv"))
    t.events.select(F.col("event_id").alias("run"), F.col("value").alias("mcc"), name.alias("name")).write.partitionBy("name").csv(path, header=True)
    return readers.read_results(t.spark, path, 5, "run bigint, mcc double", folder_name()).drop("name")


@query(
    "s4_read_results_sequential",
    """SELECT event_id AS run, value AS mcc, event_type AS feature_type, 'hc' AS feature_scope, 'word' AS token,
              'cvss2_' || CAST(user_id % 3 AS VARCHAR) AS scenario, CAST(user_id % 5 AS VARCHAR) AS fold
       FROM events WHERE event_type <> 'error'""",
)
def s4b(t: Tables) -> DataFrame:
    path = scratch(t.spark, "results7")
    user = F.col("user_id")
    seven = F.concat_ws(
        "_", "event_type", F.lit("hc"), F.lit("word"), F.lit("cvss2"), (user % 3).cast("string"), (user % 5).cast("string"), F.lit("r.csv")
    )
    name = F.when(F.col("event_type") == "error", "other_name.csv").otherwise(seven)
    t.events.select(F.col("event_id").alias("run"), F.col("value").alias("mcc"), name.alias("name")).write.partitionBy("name").csv(path, header=True)
    return readers.read_results(t.spark, path, 7, "run bigint, mcc double", folder_name()).drop("name")


@query(
    "s5_read_logs",
    """SELECT event_type AS log, count(*) AS n_lines, CAST(sum(length(CAST(event_id AS VARCHAR)) + 6) AS BIGINT) AS n_chars
       FROM events GROUP BY 1""",
)
def s5(t: Tables) -> DataFrame:
    path = scratch(t.spark, "logs")
    lines = t.events.select(F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("value"), F.col("event_type").alias("log"))
    lines.write.partitionBy("log").text(path)
    text = F.split(F.regexp_replace("text", "\n$", ""), "\n")
    logs = readers.read_logs(t.spark, f"{path}/log=*").select("file", "text", F.regexp_extract("path", "log=([^/]*)/", 1).alias("log"))
    per_file = logs.select("log", F.size(text).alias("n"), (F.length("text") - F.size(text)).alias("c"))
    return per_file.groupBy("log").agg(F.sum("n").alias("n_lines"), F.sum("c").alias("n_chars"))


@query("s6_write_table", f"WITH {d.DOCS} SELECT doc_id, lang, partition AS split FROM docs WHERE partition <> 'test'")
def s6(t: Tables) -> DataFrame:
    path = scratch(t.spark, "splits")
    writers.write_table(d.documents(t).select("doc_id", "lang", F.col("partition").alias("split")), path, by=["split"])
    return readers.read_table(t.spark, path, "doc_id bigint, lang string, split string").filter("split <> 'test'")


@query("s7_append_results", "SELECT event_id, event_type AS problem, value AS val_mcc FROM events WHERE event_type IN ('click', 'view')")
def s7(t: Tables) -> DataFrame:
    path = scratch(t.spark, "appended")
    rows = t.events.select("event_id", F.col("event_type").alias("problem"), F.col("value").alias("val_mcc"))
    for i, kind in enumerate(("error", "click", "view")):
        writers.append_results(rows.filter(F.col("problem") == kind), path, first=i <= 1)
    return readers.read_csv(t.spark, path, "event_id bigint, problem string, val_mcc double")


@query("s7_append_once", "SELECT event_id, event_type AS problem, value AS val_mcc FROM events")
def s7_once(t: Tables) -> DataFrame:
    """Every kind of event is appended twice; each counts once."""
    path = scratch(t.spark, "once")
    rows = t.events.select("event_id", F.col("event_type").alias("problem"), F.col("value").alias("val_mcc"))
    for kind in [r[0] for r in rows.select("problem").distinct().collect()] * 2:
        writers.append_once(rows.filter(F.col("problem") == kind), path, kind)
    return readers.read_appended(t.spark, path, "event_id bigint, problem string, val_mcc double")


@query(
    "s8_write_json",
    """SELECT url, nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS heading FROM pages""",
)
def s8(t: Tables) -> DataFrame:
    path = scratch(t.spark, "json")
    writers.write_json(t.pages.select("url", field(F.col("html"), "<h1>([^<]*)</h1>").alias("heading")), path)
    return t.spark.read.schema("url string, heading string").json(path)


@query("s9_write_predictions", f"WITH {d.PREDS} SELECT doc_id, pred, gold FROM preds")
def s9(t: Tables) -> DataFrame:
    path = scratch(t.spark, "predictions")
    writers.write_predictions(d.preds(t), path, "doc_id", "pred", "gold")
    return readers.read_csv(t.spark, path, "doc_id bigint, pred int, gold int")


@query(
    "s10_write_slices_parquet",
    f"""WITH {d.FUNCS} SELECT id AS key, severity, partition, md5({SCOPE_SQL["whole"]}) AS code FROM funcs""",
)
def s10(t: Tables) -> DataFrame:
    path = scratch(t.spark, "slices")
    f = d.funcs(t)
    writers.write_table(slice_table(f, "whole", ["severity", "partition"]), path)
    back = readers.read_table(t.spark, path, "key bigint, severity string, partition string, code string")
    return back.withColumn("code", F.md5("code"))


QUARANTINE_SQL = """
  SELECT page_id,
         CASE WHEN coalesce(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') = '' THEN 'heading'
              WHEN len(regexp_extract_all(html, '<a\\b[^>]*?\\bhref=["'']([^"'']*)["'']', 1)) < 6 THEN 'links' END AS _error
  FROM pages"""


def checked_pages(t: Tables) -> DataFrame:
    checks = {"heading": field(F.col("html"), "<h1>([^<]*)</h1>").isNotNull(), "links": F.size(hrefs(F.col("html"))) >= 6}
    return with_quarantine(t.pages, checks)


@query("s11_quarantine", QUARANTINE_SQL)
def s11(t: Tables) -> DataFrame:
    return checked_pages(t).select("page_id", "_error")


@query("s11_quarantine_rejects", f"SELECT _error, count(*) AS n FROM ({QUARANTINE_SQL}) WHERE _error IS NOT NULL GROUP BY 1")
def s11b(t: Tables) -> DataFrame:
    _, rejected = split_quarantine(checked_pages(t))
    return rejected.groupBy("_error").agg(F.count("*").alias("n"))
