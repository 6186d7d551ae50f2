"""Queries on splits, stratified samples and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sevfold.operators import splits as sp
from sevfold.operators.relational import stack
from sevfold.queries import derived as d
from sevfold.queries.registry import Tables, query

T1_SQL = """WITH keys AS (SELECT DISTINCT {key} AS k FROM {table}),
ranked AS (SELECT k, row_number() OVER (ORDER BY md5(concat_ws('|', k, '42'))) AS r, count(*) OVER () AS n FROM keys),
cut AS (SELECT k, r, n, CAST(ceil(n * 0.2::DOUBLE) AS BIGINT) AS held FROM ranked),
parts AS (
  SELECT k, CASE WHEN r <= n - held THEN 'train' WHEN r <= n - held + CAST(ceil(held / 2.0) AS BIGINT) THEN 'valid' ELSE 'test' END AS split
  FROM cut)
SELECT {id}, split FROM {table} JOIN parts ON {key} = k"""


@query("t1_group_split_sources", T1_SQL.format(key="source", table="documents", id="doc_id"))
def t1(t: Tables) -> DataFrame:
    return sp.group_split(t.documents.select("doc_id", "source"), "source").select("doc_id", "split")


@query("t1_group_split_customers", T1_SQL.format(key="o_custkey", table="orders", id="o_orderkey"))
def t1b(t: Tables) -> DataFrame:
    return sp.group_split(t.orders.select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "split")


@query(
    "t1_group_split_by_hash_range",
    """SELECT o_orderkey, o_custkey, CASE WHEN place < 0.8::DOUBLE THEN 'train' WHEN place < 0.9::DOUBLE THEN 'valid' ELSE 'test' END AS split
       FROM (SELECT *, ('0x' || substr(md5(o_custkey || '|42'), 1, 8))::BIGINT::DOUBLE / 4294967296 AS place FROM orders)""",
)
def t1c(t: Tables) -> DataFrame:
    return sp.group_split(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", approx=True)


@query(
    "w8_stratified_fractions",
    f"""WITH {d.DOCS},
        ranked AS (
          SELECT doc_id, severity, row_number() OVER (PARTITION BY severity ORDER BY md5(concat_ws('|', doc_id, '42'))) AS r,
                 count(*) OVER (PARTITION BY severity) AS n FROM docs)
        SELECT doc_id, severity, ratio FROM ranked, (SELECT unnest([0.2, 0.4, 0.6, 0.8]::DOUBLE[]) AS ratio)
        WHERE r <= floor(n * ratio)""",
)
def w8(t: Tables) -> DataFrame:
    return sp.stratified_fractions(d.documents(t).select("doc_id", "severity"), "severity", "doc_id")


FOLD_ROWS = "idx AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', doc_id, '42'))) - 1 AS i, count(*) OVER () AS n FROM documents)"


@query(
    "w9_assign_folds",
    f"""WITH {FOLD_ROWS} SELECT doc_id, CAST(CASE WHEN n // 10 = 0 THEN CASE WHEN i = 0 THEN 0 ELSE 9 END
                ELSE least(greatest(i - 1, 0) // (n // 10), 9) END AS INT) AS fold FROM idx""",
)
def w9(t: Tables) -> DataFrame:
    return sp.assign_folds(t.documents.select("doc_id"), "doc_id", 10)


@query(
    "w9_assign_folds_by_share",
    f"""WITH {FOLD_ROWS}, ends AS (SELECT *, floor(n * 0.8::DOUBLE) AS e0, floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) AS e1 FROM idx)
        SELECT doc_id, CAST(CASE WHEN i <= e0 THEN 0 WHEN i <= e1 THEN 1 ELSE 2 END AS INT) AS fold FROM ends""",
)
def w9b(t: Tables) -> DataFrame:
    return sp.assign_folds(t.documents.select("doc_id"), "doc_id", [0.8, 0.1, 0.1])


@query(
    "w10_rotate_folds",
    f"""WITH {FOLD_ROWS},
        folds AS (SELECT doc_id, CAST(least(greatest(i - 1, 0) // (n // 5), 4) AS INT) AS fold FROM idx)
        SELECT doc_id, fold, rotation, CASE WHEN fold = (rotation + 1) % 5 THEN 'valid' WHEN fold = (rotation + 2) % 5 THEN 'test' ELSE 'train' END AS partition
        FROM folds, (SELECT CAST(unnest(range(5)) AS INT) AS rotation)""",
)
def w10(t: Tables) -> DataFrame:
    return sp.rotate_folds(sp.assign_folds(t.documents.select("doc_id"), "doc_id", 5), 5)


@query("t4_split_by_column", f"WITH {d.DOCS} SELECT doc_id, partition AS part FROM docs")
def t4(t: Tables) -> DataFrame:
    parts = sp.split_by_column(d.documents(t))
    return stack([df.select("doc_id", F.lit(name).alias("part")) for name, df in parts.items()])
