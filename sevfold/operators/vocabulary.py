"""Terms of documents in long form, and vocabularies chosen from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sevfold.functions.text import char_ngrams, plain_text, term_counts

MAX_FEATURES = 10_000


def term_table(df: DataFrame, doc: list[str], terms: Column) -> DataFrame:
    """``doc, term, tf``: counted inside each row, so without a shuffle."""
    return df.select(*doc, F.inline(term_counts(terms)))


def char_gram_counts(df: DataFrame, text: Column, lo: int, hi: int) -> DataFrame:
    """``gram, n``: how often each of the ``char_ngrams`` of ``lo`` to ``hi`` characters stands in all texts.

    Only the longest grams are made at every place. A shorter one begins a longest one, so its count is the
    sum of theirs; what begins in the last ``hi - 1`` characters of a text has no longest one and is cut there.
    """
    longest = df.select(F.explode(char_ngrams(text, hi, hi)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    if lo == hi:
        return longest
    fronts = longest.select(F.explode(F.array(*[F.left("gram", F.lit(n)) for n in range(lo, hi + 1)])).alias("gram"), "n")
    ends = df.select(F.explode(char_ngrams(F.right(plain_text(text), F.lit(hi - 1)), lo, hi - 1)).alias("gram"), F.lit(1).cast("long").alias("n"))
    return fronts.unionByName(ends).groupBy("gram").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def vocabulary(
    terms: DataFrame, n_docs: Column | None = None, min_df: int | float = 0.0, max_df: int | float = 1.0, max_features: int | None = MAX_FEATURES
) -> DataFrame:
    """``term, df, cf`` from a term table: document and corpus frequency.

    A float bound is a share of ``n_docs``, an int a count. ``max_features`` keeps the terms
    of highest corpus frequency, the alphabet deciding ties.
    """

    def bound(limit: int | float) -> Column:
        if isinstance(limit, int):
            return F.lit(limit)
        if n_docs is None:
            raise ValueError("a share of documents needs their number")
        return F.lit(limit) * n_docs

    kept = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    if min_df:
        kept = kept.filter(F.col("df") >= bound(min_df))
    if isinstance(max_df, int) or max_df < 1.0:
        kept = kept.filter(F.col("df") <= bound(max_df))
    return kept if max_features is None else kept.orderBy(F.desc("cf"), "term").limit(max_features)


def count_docs(df: DataFrame) -> Column:
    """Number of documents as a scalar, evaluated inside the plan that uses it."""
    return df.agg(F.count("*").alias("n")).scalar()


def label_index(df: DataFrame, c: str) -> DataFrame:
    """Labels with their alphabetical codes from 0. A task has few labels, so one array holds them."""
    labels = df.filter(F.col(c).isNotNull()).select(c).distinct()
    ordered = labels.agg(F.sort_array(F.collect_list(c)).alias("_l"))
    return ordered.select(F.posexplode("_l").alias("code", c)).select(c, "code")


def apply_label_index(df: DataFrame, index: DataFrame, c: str, out: str = "code") -> DataFrame:
    """Code of each row's label, from a map of the few labels: rows are not joined. A label that the index lacks stops the job."""
    unseen = F.raise_error(F.concat(F.lit("unseen label: "), F.col(c))).cast("int")
    codes = index.agg(F.map_from_entries(F.collect_list(F.struct(c, "code"))).alias("m")).scalar()
    code = F.when(F.col(c).isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(F.try_element_at(codes, F.col(c)), unseen))
    return df.withColumn(out, code)


def index_terms(vocab: DataFrame, max_features: int) -> list[str]:
    """Terms of a vocabulary of at most ``max_features`` in alphabetical order, on the driver, for ``pyspark.ml`` models."""
    terms = sorted(r["term"] for r in vocab.select("term").limit(max_features + 1).collect())
    if len(terms) > max_features:
        raise ValueError(f"vocabulary has more than {max_features} terms")
    return terms
