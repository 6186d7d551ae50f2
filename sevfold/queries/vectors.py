"""Queries on vocabularies, term tables, vectors and neighbours."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from sevfold.functions.text import code_tokens, parse_vector
from sevfold.operators.neighbours import knn, knn_vote
from sevfold.operators.relational import join_vectors
from sevfold.operators.vocabulary import count_docs, term_table, vocabulary
from sevfold.plans import features as ft, prompts as pr
from sevfold.queries import derived as d
from sevfold.queries.registry import Tables, query
from sevfold.queries.text import CODE_TOKEN_SQL, DESC_SQL, GRAMS_SQL

CODE_TERMS = f"""{d.FUNCS},
tokens AS (SELECT id, partition, unnest(regexp_extract_all(func_before, {CODE_TOKEN_SQL})) AS term FROM funcs),
terms AS (SELECT id, partition, term, count(*) AS tf FROM tokens GROUP BY 1, 2, 3)"""


@query(
    "a15_vocabulary",
    f"""WITH {CODE_TERMS}, stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM terms GROUP BY 1)
        SELECT term, df, cf FROM stats WHERE df >= 2 AND df <= 0.9::DOUBLE * (SELECT count(*) FROM funcs) ORDER BY cf DESC, term LIMIT 10000""",
)
def a15(t: Tables) -> DataFrame:
    f = d.funcs(t)
    return vocabulary(term_table(f, ["id"], code_tokens(F.col("func_before"))), count_docs(f), min_df=2, max_df=0.9)


@query(
    "a15_vocabulary_by_share",
    f"""WITH {CODE_TERMS}, stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM terms GROUP BY 1)
        SELECT term, df, cf FROM stats WHERE df >= 0.01::DOUBLE * (SELECT count(*) FROM funcs) """,
)
def a15b(t: Tables) -> DataFrame:
    f = d.funcs(t)
    return vocabulary(term_table(f, ["id"], code_tokens(F.col("func_before"))), count_docs(f), min_df=0.01, max_features=None)


@query(
    "m1_bow_counts",
    f"""WITH {CODE_TERMS}, vocab AS (SELECT term FROM terms WHERE partition = 'train' GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 10000)
        SELECT id, term, CAST(tf AS INT) AS tf FROM terms WHERE term IN (SELECT term FROM vocab)""",
)
def m1(t: Tables) -> DataFrame:
    f = d.funcs(t)
    return ft.bow_counts(f, f.filter("partition = 'train'"), "id", "func_before")


def desc_sql(hi: int) -> str:
    return f"""{d.DOCS}, words AS (SELECT doc_id, partition, {DESC_SQL} AS w FROM docs), sizes AS (SELECT unnest(range(1, {hi + 1})) AS n),
flat AS (SELECT doc_id, partition, unnest(w) AS t1, unnest(range(len(w))) AS i FROM words),
led AS (SELECT doc_id, partition, t1, lead(t1) OVER o AS t2, lead(t1, 2) OVER o AS t3, lead(t1, 3) OVER o AS t4 FROM flat WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
grams AS (SELECT doc_id, partition, CASE n WHEN 1 THEN t1 WHEN 2 THEN t1 || ' ' || t2 WHEN 3 THEN t1 || ' ' || t2 || ' ' || t3
            ELSE t1 || ' ' || t2 || ' ' || t3 || ' ' || t4 END AS term FROM led, sizes),
terms AS (SELECT doc_id, partition, term, count(*) AS tf FROM grams WHERE term IS NOT NULL GROUP BY 1, 2, 3),
train AS (SELECT count(*) AS n FROM docs WHERE partition = 'train'),
vocab AS (SELECT term, count(*) AS df FROM terms WHERE partition = 'train' GROUP BY 1 HAVING count(*) >= 0.001::DOUBLE * (SELECT n FROM train))"""


def register_desc(config: int) -> None:
    cfg = ft.DESC_CONFIGS[config]
    if cfg.tfidf:
        sql = f"""WITH {desc_sql(cfg.hi)}, weighed AS (
            SELECT doc_id, term, tf, tf * (ln((1 + (SELECT n FROM train))::DOUBLE / (1 + df)) + 1) AS w FROM terms JOIN vocab USING (term))
            SELECT doc_id, term, CAST(tf AS INT) AS tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weighed"""
    else:
        sql = f"WITH {desc_sql(cfg.hi)} SELECT doc_id, term, CAST(tf AS INT) AS tf, tf::DOUBLE AS weight FROM terms WHERE term IN (SELECT term FROM vocab)"

    @query(f"m2_desc_features_config{config}", sql)
    def weighted(t: Tables) -> DataFrame:
        docs = d.documents(t).select("doc_id", "text", "partition")
        out = ft.desc_features(docs, docs.filter("partition = 'train'"), "doc_id", "text", config)
        return out.withColumn("weight", F.round("weight", 6))


for _config in ft.DESC_CONFIGS:
    register_desc(_config)


TRAIN_GRAMS = f"""{GRAMS_SQL},
shared AS (SELECT gram FROM grams JOIN docs USING (doc_id) WHERE partition = 'train' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10),
slt AS (SELECT DISTINCT trim(gram, ' ' || chr(10)) AS term FROM shared WHERE regexp_matches(gram, '^\\s*\\S\\S+\\s*$')),
tokens AS (SELECT doc_id, partition, unnest(regexp_extract_all(text, {CODE_TOKEN_SQL})) AS term FROM docs),
all_words AS (SELECT term FROM tokens WHERE partition = 'train' GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 10000),
words AS (SELECT term FROM all_words WHERE term NOT IN (SELECT term FROM slt))"""


@query("u4_vocabulary_difference", f"WITH {d.DOCS}, {TRAIN_GRAMS} SELECT term FROM words")
def u4(t: Tables) -> DataFrame:
    train = d.documents(t).filter("partition = 'train'")
    words = vocabulary(term_table(train, ["doc_id"], code_tokens(F.col("text")))).select("term")
    return ft.vocabulary_difference(words, ft.gram_vocabulary(train, "text"))


SUBWORD_GRAMS = TRAIN_GRAMS.replace("range(3, 7)", "range(2, 7)").replace("WHERE partition = 'train' GROUP BY 1 HAVING", "WHERE partition = 'train' AND n > 2 GROUP BY 1 HAVING")


@query(
    "m3_subword_features",
    f"""WITH {d.DOCS}, {SUBWORD_GRAMS}
        SELECT doc_id, 'word' AS block, term, CAST(count(*) AS INT) AS tf FROM tokens WHERE term IN (SELECT term FROM words) GROUP BY 1, 2, 3
        UNION ALL SELECT doc_id, 'char', gram, CAST(count(*) AS INT) FROM grams WHERE gram IN (SELECT term FROM slt) GROUP BY 1, 2, 3""",
)
def m3(t: Tables) -> DataFrame:
    docs = d.documents(t).select("doc_id", "text", "partition")
    return ft.subword_features(docs, docs.filter("partition = 'train'"), "doc_id", "text")


@query(
    "m3_subword_vectors",
    f"""WITH {d.DOCS}, {SUBWORD_GRAMS},
        word_places AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS place FROM words),
        gram_places AS (SELECT term, (SELECT count(*) FROM words) + row_number() OVER (ORDER BY term) - 1 AS place FROM slt)
        SELECT doc_id, CAST(place AS INT) AS place, count(*)::DOUBLE AS n FROM tokens JOIN word_places USING (term) GROUP BY 1, 2
        UNION ALL SELECT doc_id, CAST(place AS INT), count(*)::DOUBLE FROM grams JOIN gram_places ON gram = term GROUP BY 1, 2""",
)
def m3_vectors(t: Tables) -> DataFrame:
    docs = d.documents(t).select("doc_id", "text", "partition")
    model = ft.subword_model(docs.filter("partition = 'train'"), "text")
    held = ft.subword_vectors(docs, model, ["doc_id"], "text").select("doc_id", ft.stored("features").alias("v"))
    return held.select("doc_id", F.inline(F.arrays_zip(F.col("v.indices").alias("place"), F.col("v.values").alias("n"))))


@query(
    "j6_join_vectors",
    f"WITH {d.TOKENS_VEC} SELECT doc_id, CAST(pos AS INT) AS pos, vec_id, label, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM tokens_vec JOIN embeddings USING (vec_id)",
)
def j6(t: Tables) -> DataFrame:
    found = join_vectors(d.tokens_vec(t), t.embeddings, "vec_id")
    return found.select("doc_id", "pos", "vec_id", "label", F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(
    "m6_mean_vector",
    f"""WITH {d.TOKENS_VEC},
        known AS (SELECT doc_id, unnest(range(64)) AS dim, unnest(embedding) AS e FROM tokens_vec JOIN embeddings USING (vec_id)),
        means AS (SELECT doc_id, dim, avg(e::DOUBLE) AS m FROM known GROUP BY 1, 2),
        cells AS (SELECT doc_id, unnest(range(64)) AS dim FROM documents)
        SELECT c.doc_id, CAST(c.dim AS INT) AS dim, round(coalesce(m, 0), 6) AS mean FROM cells c LEFT JOIN means USING (doc_id, dim)""",
)
def m6(t: Tables) -> DataFrame:
    means = ft.mean_vector(t.documents, d.tokens_vec(t), t.embeddings, "doc_id", "vec_id", "embedding", 64)
    cells = means.select("doc_id", F.posexplode("mean_vector").alias("dim", "mean"))
    return cells.withColumn("mean", F.round("mean", 6))


def _pairs_sql(p: int) -> str:
    gap = "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])" if p == 2 else (
        "list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: abs(z[1] - z[2])))"
    )
    return f"""pairs AS (SELECT a.vec_id, b.vec_id AS neighbour, b.label, {gap} AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM pairs QUALIFY rank <= 5)"""


@query("j8_knn_l2", f"WITH {_pairs_sql(2)} SELECT vec_id, neighbour, label, CAST(rank AS INT) AS rank, round(distance, 6) AS distance FROM near")
def j8(t: Tables) -> DataFrame:
    near = knn(t.embeddings, t.embeddings, "vec_id", "embedding", 5, p=2, carry="label", exclude_self=True)
    return near.withColumn("distance", F.round("distance", 6))


@query("j8_knn_l1", f"WITH {_pairs_sql(1)} SELECT vec_id, neighbour, label, CAST(rank AS INT) AS rank, round(distance, 6) AS distance FROM near")
def j8b(t: Tables) -> DataFrame:
    near = knn(t.embeddings, t.embeddings, "vec_id", "embedding", 5, p=1, carry="label", exclude_self=True)
    return near.withColumn("distance", F.round("distance", 6))


@query("j8_knn_probes")
def j8c(t: Tables) -> DataFrame:
    """Approximate search in 26 cells; ``is_exact`` tells whether a neighbour is among the five true ones."""
    near = knn(t.embeddings, t.embeddings, "vec_id", "embedding", 5, exclude_self=True, probes=26)
    true = knn(t.embeddings, t.embeddings, "vec_id", "embedding", 5, exclude_self=True).select("vec_id", "neighbour", F.lit(True).alias("hit"))
    return near.join(true, ["vec_id", "neighbour"], "left").select("vec_id", "neighbour", "rank", F.coalesce("hit", F.lit(False)).alias("is_exact"))


@query(
    "m13_knn_vote_uniform",
    f"""WITH {_pairs_sql(2)}, votes AS (SELECT vec_id, label, count(*) AS v FROM near GROUP BY 1, 2)
        SELECT vec_id, label AS pred FROM votes QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, label) = 1""",
)
def m13(t: Tables) -> DataFrame:
    near = knn(t.embeddings, t.embeddings, "vec_id", "embedding", 5, carry="label", exclude_self=True)
    return knn_vote(near, "vec_id", "label")


@query(
    "m13_knn_vote_distance",
    f"""WITH {_pairs_sql(2)},
        votes AS (SELECT vec_id, label, count(*) FILTER (distance = 0) AS z, sum(CASE WHEN distance > 0 THEN 1 / distance ELSE 0 END) AS v FROM near GROUP BY 1, 2)
        SELECT vec_id, label AS pred FROM votes
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, CASE WHEN z > 0 THEN 0 ELSE v END DESC, label) = 1""",
)
def m13b(t: Tables) -> DataFrame:
    near = knn(t.embeddings, t.embeddings, "vec_id", "embedding", 5, carry="label", exclude_self=True)
    return knn_vote(near, "vec_id", "label", weights="distance")


@query(
    "m15_argmax",
    """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS pred FROM embeddings""",
)
def m15(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", pr.argmax(F.col("embedding")).alias("pred"))


LABEL_WORDS = pr.LABEL_WORDS[2]
WORDS = [w for words in LABEL_WORDS.values() for w in words]


@query(
    "m16_verbalize",
    """WITH scores AS (
         SELECT vec_id, i // 2 AS pred, avg(embedding[i + 1]::DOUBLE) AS score FROM embeddings, (SELECT unnest(range(8)) AS i) GROUP BY 1, 2)
       SELECT vec_id, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][pred + 1] AS pred_class, CAST(pred AS INT) AS pred, round(score, 6) AS score
       FROM scores QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, pred) = 1""",
)
def m16(t: Tables) -> DataFrame:
    rows = F.inline(F.array(*[F.struct(F.lit(w).alias("word"), F.col("embedding")[i].cast("double").alias("score")) for i, w in enumerate(WORDS)]))
    return pr.verbalize(t.embeddings.select("vec_id", rows), "vec_id", LABEL_WORDS).withColumn("score", F.round("score", 6))


@query(
    "f24_parse_vector",
    "SELECT vec_id, CAST(unnest(range(len(embedding))) AS INT) AS dim, round(unnest(embedding::DOUBLE[]), 9) AS value FROM embeddings",
)
def f24(t: Tables) -> DataFrame:
    text = F.to_json(F.col("embedding").cast("array<double>"))
    parsed = t.embeddings.select("vec_id", text.alias("codebert")).select("vec_id", F.posexplode(parse_vector(F.col("codebert"))).alias("dim", "value"))
    return parsed.withColumn("value", F.round("value", 9))


@query("m18_embedding_features", "SELECT vec_id, label, CAST(len(embedding) AS INT) AS size, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def m18(t: Tables) -> DataFrame:
    values = vector_to_array("features")
    vectors = ft.embedding_features(t.embeddings, "embedding")
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return vectors.select("vec_id", "label", F.size(values).alias("size"), F.round(total, 6).alias("total"))
