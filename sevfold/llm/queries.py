"""The registered queries of this package: each operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sevfold.llm import decontaminate, divergence, kdtree, langid, licenses, ngram_join, packing, periods, quality, secrets, suffixes, toxicity, warc
from sevfold.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 20, candidates all rows of other ids."""
    return kdtree.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLES["op2_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


@query
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(read(spark, sf_dir, "documents"))


@query
def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op5_warc_round_trip"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT payload_bytes, sha1(coalesce(html, '')) payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) holder FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < holder THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < holder THEN holder END refers_to
FROM g
"""


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


ORACLES["op6_license_scan"] = licenses.oracle()


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document stands for a repository, its source for the owner."""
    return secrets.find_secrets(read(spark, sf_dir, "documents"), repo="doc_id", owner="source")


@query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity of 0.9 or more."""
    return ngram_join.ngram_components(read(spark, sf_dir, "documents"), size=3, percent=90)


ORACLES["op8_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) sh
  FROM w),
e AS MATERIALIZED (SELECT doc_id, unnest(sh) g FROM s),
o AS MATERIALIZED (
  SELECT a.doc_id a, b.doc_id b, count(*) c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT o.a, o.b FROM o JOIN s x ON x.doc_id = o.a JOIN s y ON y.doc_id = o.b
  WHERE 100 * c >= 90 * (len(x.sh) + len(y.sh) - c)),
reach AS (
  SELECT doc_id, doc_id r FROM s
  UNION
  SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT s.doc_id, len(any_value(s.sh))::BIGINT n_shingles, min(r) component_id
FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id
"""


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the texts after copies are planted in a tenth of them."""
    return periods.digests(periods.periodic_runs(periods.with_planted_runs(read(spark, sf_dir, "documents"))))


ORACLES["op13_periodic_runs"] = r"""
WITH h AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
c AS (
  -- crc32 by the table of the reflected polynomial, four bits at a time
  SELECT doc_id, ws, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda ch: ascii(ch)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)) crc
  FROM h),
g AS (SELECT doc_id, ws, len(ws)::BIGINT n, xor(crc, 4294967295) h FROM c),
p AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
      ws[CASE WHEN i < (h // 10) % n THEN i + 1
         ELSE (h // 10) % n + (i - (h // 10) % n) % (1 + (n - (h // 10) % n) // (3 + (h // 10) % 8)) + 1 END])
    ELSE ws END ws
  FROM g),
w AS MATERIALIZED (SELECT doc_id, n, unnest(ws) word, unnest(range(n)) i FROM p),
m AS (
  SELECT a.doc_id, b.i - a.i q, a.i FROM w a JOIN w b
  ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
s AS (SELECT doc_id, q, min(i) start, count(*) + q length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) k FROM m) GROUP BY doc_id, q, k),
r AS MATERIALIZED (SELECT doc_id, start, length, min(q) period FROM s WHERE length >= greatest(24, 3 * q) GROUP BY ALL),
o AS (
  SELECT doc_id, count(*) n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) lines,
    arg_min(struct_pack(s := start, l := length, p := period), struct_pack(e := -length::DOUBLE / period, s := start, p := period)) b
  FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) i FROM r),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) txt FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT n_runs, b.s::BIGINT "start", b.l::BIGINT length, b.p::BIGINT period,
  (1000 * b.l // b.p)::BIGINT exponent_milli, sha256(coalesce(lines, '')) runs_sha256, sha256(coalesce(txt, '')) collapsed_sha256
FROM documents d LEFT JOIN o USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read(spark, sf_dir, "documents"))


ORACLES["op11_quality_rules"] = quality.oracle()


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"))


ORACLES["op12_source_divergence"] = divergence.ORACLE
