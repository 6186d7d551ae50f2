"""Queries on projections, filters, joins, unions, orders and plain aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sevfold.functions.cvss import severity_code
from sevfold.operators import aggregates as agg, relational as rel
from sevfold.operators.ranking import with_index
from sevfold.operators.vocabulary import apply_label_index, label_index
from sevfold.plans.features import drop_empty_docs
from sevfold.plans.results import job_settings
from sevfold.operators.vocabulary import term_table
from sevfold.functions.text import code_tokens
from sevfold.queries import derived as d
from sevfold.queries.registry import Tables, query


@query("p1_project", "SELECT o_orderkey AS key, o_orderstatus AS severity, o_totalprice AS score FROM orders")
def p1(t: Tables) -> DataFrame:
    return rel.project(
        t.orders, ["o_orderkey", "o_orderstatus", "o_totalprice"],
        {"o_orderkey": "key", "o_orderstatus": "severity", "o_totalprice": "score"},
    )


@query(
    "p2_to_strings",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
              coalesce(o_orderpriority, 'nan') AS o_orderpriority FROM orders""",
)
def p2(t: Tables) -> DataFrame:
    return rel.to_strings(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), null_text="nan")


@query("p3_filter_equal", f"WITH {d.DOCS} SELECT doc_id, lang FROM docs WHERE severity = 'HIGH' AND partition = 'train'")
def p3(t: Tables) -> DataFrame:
    return d.documents(t).filter((F.col("severity") == "HIGH") & (F.col("partition") == "train")).select("doc_id", "lang")


@query("p4_keep_keys", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def p4(t: Tables) -> DataFrame:
    keys = t.customer.filter("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey")
    return rel.keep_keys(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), keys, "o_custkey")


@query(
    "p5_drop_null",
    "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL",
)
def p5(t: Tables) -> DataFrame:
    labelled = t.documents.join(t.labels, "doc_id", "left")
    return rel.drop_null(labelled, "quality").select("doc_id", "quality")


@query(
    "p6_column_counts",
    """SELECT count(d.doc_id) AS doc_id, count(lang) AS lang, count(quality) AS quality, count(toxic) AS toxic
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def p6(t: Tables) -> DataFrame:
    return rel.column_counts(t.documents.join(t.labels, "doc_id", "left").select("doc_id", "lang", "quality", "toxic"))


@query("p7_distinct_values", "SELECT DISTINCT source FROM documents")
def p7(t: Tables) -> DataFrame:
    return rel.distinct_values(t.documents, "source")


@query("p7_number_of_classes", "SELECT count(DISTINCT lang) AS n_classes FROM documents")
def p7b(t: Tables) -> DataFrame:
    return t.documents.agg(F.count_distinct("lang").alias("n_classes"))


@query("p8_head", "SELECT l_orderkey, l_linenumber, l_quantity, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity LIMIT 5")
def p8(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    return rel.head(rows, 5, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])


@query("p9_reorder", "SELECT s_nationkey, s_name, s_suppkey, s_acctbal FROM supplier")
def p9(t: Tables) -> DataFrame:
    return rel.reorder(t.supplier, ["s_nationkey", "s_name"])


@query(
    "p10_with_index",
    "SELECT doc_id, lang, row_number() OVER (ORDER BY md5(concat_ws('|', doc_id, '42'))) - 1 AS row_index FROM documents",
)
def p10(t: Tables) -> DataFrame:
    return with_index(t.documents.select("doc_id", "lang"), ["doc_id"])


@query(
    "p11_drop_empty_vectors",
    f"""WITH {d.FUNCS} SELECT id, lang FROM funcs WHERE regexp_matches(func_before, '[<>]|(?:^|[^a-zA-Z0-9])(?:the|de|und)(?:$|[^a-zA-Z0-9])')""",
)
def p11(t: Tables) -> DataFrame:
    f = d.funcs(t)
    known = term_table(f, ["id"], code_tokens(F.col("func_before"))).filter(F.col("term").isin("the", "de", "und", "<", ">", "<=", ">="))
    return drop_empty_docs(f.select("id", "lang"), known, "id")


@query("p12_with_constants", "SELECT p_partkey, 'method' AS granularity, 'whole' AS scope, 3 AS run FROM part")
def p12(t: Tables) -> DataFrame:
    return rel.with_constants(t.part.select("p_partkey"), granularity="method", scope="whole", run=3)


@query(
    "j1_overwrite_from",
    """WITH first_order AS (
         SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS c_acctbal, arg_min(o_orderpriority, o_orderkey) AS c_mktsegment
         FROM orders GROUP BY 1)
       SELECT c.c_custkey, c.c_name, c.c_nationkey, f.c_acctbal, f.c_mktsegment
       FROM customer c JOIN first_order f ON c.c_custkey = f.o_custkey""",
)
def j1(t: Tables) -> DataFrame:
    lookup = t.orders.select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderpriority").alias("c_mktsegment"), "o_orderkey"
    )
    return rel.overwrite_from(t.customer, lookup, "c_custkey", ["c_acctbal", "c_mktsegment"], ["o_orderkey"])


@query(
    "j2_unmatched",
    """SELECT c_nationkey FROM customer
       WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0)""",
)
def j2(t: Tables) -> DataFrame:
    gaps = t.nation.filter("n_regionkey <> 0").select(F.col("n_nationkey").alias("c_nationkey"))
    return rel.unmatched(t.customer, gaps, "c_nationkey")


@query(
    "j3_zip_columns",
    "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
)
def j3(t: Tables) -> DataFrame:
    return rel.zip_columns(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query(
    "j4_param_grid",
    """WITH jobs AS (SELECT DISTINCT lang AS scope, source AS feature FROM documents),
       grid AS (
         SELECT c.classifier, e.i * 3 + l.i AS grid_index, e.v || '-' || l.v AS parameters
         FROM (VALUES ('rf'), ('gbt')) c(classifier),
              (VALUES (0, '100'), (1, '200'), (2, '300'), (3, '400'), (4, '500')) e(i, v),
              (VALUES (0, '100'), (1, '200'), (2, '300')) l(i, v))
       SELECT scope, feature, classifier, CAST(grid_index AS INT) AS grid_index, parameters FROM jobs, grid""",
)
def j4(t: Tables) -> DataFrame:
    jobs = t.documents.select(F.col("lang").alias("scope"), F.col("source").alias("feature")).distinct()
    return job_settings(jobs)


@query(
    "j7_encode",
    f"WITH {d.DOCS} SELECT doc_id, CAST(CASE severity WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END AS INT) AS code FROM docs",
)
def j7(t: Tables) -> DataFrame:
    return d.documents(t).select("doc_id", severity_code(F.col("severity")).alias("code"))


@query(
    "j9_concat_columns",
    """WITH a AS (SELECT event_type, CAST(user_id % 7 AS INT) AS scenario, max(value) AS max_value FROM events WHERE value > 480 GROUP BY 1, 2),
            b AS (SELECT event_type, CAST(user_id % 7 AS INT) AS scenario, min(value) AS min_value FROM events WHERE value < 5 GROUP BY 1, 2)
       SELECT coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.scenario, b.scenario) AS scenario, max_value, min_value
       FROM a FULL JOIN b ON a.event_type = b.event_type AND a.scenario = b.scenario""",
)
def j9(t: Tables) -> DataFrame:
    ev = t.events.select("event_type", (F.col("user_id") % 7).cast("int").alias("scenario"), "value")
    high = ev.filter("value > 480").groupBy("event_type", "scenario").agg(F.max("value").alias("max_value"))
    low = ev.filter("value < 5").groupBy("event_type", "scenario").agg(F.min("value").alias("min_value"))
    return rel.concat_columns([high, low], ["event_type", "scenario"])


@query(
    "o1_shuffle",
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(concat_ws('|', o_orderkey, '42'))",
)
def o1(t: Tables) -> DataFrame:
    return rel.shuffle(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"])


@query(
    "u1_stack",
    """SELECT c_custkey AS key, c_acctbal AS balance, 'customer' AS side FROM customer
       UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier""",
)
def u1(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("side"))
    b = t.supplier.select(F.lit("supplier").alias("side"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return rel.stack([a, b])


@query(
    "a1_mean_by",
    f"""WITH {d.RESULTS}
        SELECT problem, classifier, parameters, round(avg(val_mcc), 6) AS val_mcc, round(avg(train_time), 6) AS train_time
        FROM results GROUP BY 1, 2, 3""",
)
def a1(t: Tables) -> DataFrame:
    means = agg.mean_by(d.results(t).drop("event_id"), ["problem", "classifier", "parameters"])
    return means.withColumns({c: F.round(c, 6) for c in ("val_mcc", "train_time")})


@query(
    "a2_summarise_mean",
    "SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount FROM lineitem",
)
def a2(t: Tables) -> DataFrame:
    means = agg.summarise(t.lineitem.select("l_quantity", "l_discount", "l_returnflag"), "mean")
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


@query("a2_summarise_sum", "SELECT sum(l_quantity) AS l_quantity, round(sum(l_tax), 4) AS l_tax FROM lineitem")
def a2b(t: Tables) -> DataFrame:
    sums = agg.summarise(t.lineitem.select("l_quantity", "l_tax"), "sum")
    return sums.select("l_quantity", F.round("l_tax", 4).alias("l_tax"))


def _profile_sql(field: str, words: str) -> str:
    points = ", ".join(f"round(quantile_cont(w, {p / 100}), 6) AS p{p}" for p in agg.PROFILE_POINTS)
    return f"SELECT '{field}' AS field, round(avg(w), 6) AS mean, {points} FROM (SELECT {words} AS w FROM documents)"


@query(
    "a3_length_profile",
    _profile_sql("text", "len(regexp_extract_all(text, '\\S+'))") + " UNION ALL " + _profile_sql("source", "len(regexp_extract_all(source, '\\S+'))"),
)
def a3(t: Tables) -> DataFrame:
    profile = agg.length_profile(t.documents, ["text", "source"])
    return profile.select("field", *[F.round(c, 6).alias(c) for c in profile.columns if c != "field"])


@query("a4_mode_of", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 1")
def a4(t: Tables) -> DataFrame:
    return agg.mode_of(t.documents, "source")


@query("a5_class_counts", f"WITH {d.DOCS} SELECT severity, count(*) AS n FROM docs GROUP BY 1")
def a5(t: Tables) -> DataFrame:
    return agg.class_counts(d.documents(t), "severity")


@query("f25_label_index", "SELECT doc_id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INT) AS code FROM documents")
def f25(t: Tables) -> DataFrame:
    return apply_label_index(t.documents.select("doc_id", "lang"), label_index(t.documents, "lang"), "lang").select("doc_id", "code")
