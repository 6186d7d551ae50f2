"""Text features: long-form counts first, vectors only for ``pyspark.ml``."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Model
from pyspark.ml.feature import CountVectorizerModel, StringIndexer, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from sevfold.functions.code import clean_changes
from sevfold.functions.text import char_ngrams, code_tokens, desc_tokens, is_usable_gram, ngrams, parse_vector, plain_text, strip, term_counts
from sevfold.operators.lookup import Grams, Vocabulary, fits, frequent_grams, gathered, gathered_grams, gram_vectors, known_grams, known_terms, place_vectors, spelt_grams, term_places, term_vectors
from sevfold.operators.ranking import measured
from sevfold.operators.relational import join_vectors
from sevfold.operators.vocabulary import MAX_FEATURES, count_docs, index_terms, term_table, vocabulary

VECTOR_SIZE = 300
MIN_DF_SHARE = 0.001
MIN_DF_GRAMS = 10
GRAM_LO, GRAM_HI = 3, 6


@dataclass(frozen=True)
class DescConfig:
    """Counts or tf-idf over word grams up to a length."""

    tfidf: bool
    hi: int


# The eight configurations of the description baseline.
DESC_CONFIGS = {
    1: DescConfig(False, 1), 2: DescConfig(True, 1), 3: DescConfig(False, 2), 4: DescConfig(False, 3),
    5: DescConfig(False, 4), 6: DescConfig(True, 2), 7: DescConfig(True, 3), 8: DescConfig(True, 4),
}


def bow_counts(df: DataFrame, fit_on: DataFrame, doc: str, code: str, max_features: int = MAX_FEATURES) -> DataFrame:
    """Code token counts over the vocabulary of ``fit_on``; that is ``max_features`` terms at most."""
    vocab = frequent_terms(fit_on, code_tokens(F.col(code)), max_features)
    terms = term_table(df, [doc], code_tokens(F.col(code)))
    return terms.join(F.broadcast(vocab.select("term")), "term", "left_semi").select(doc, "term", "tf")


def desc_terms(c: Column, hi: int) -> Column:
    return ngrams(desc_tokens(c), 1, hi)


def desc_features(df: DataFrame, fit_on: DataFrame, doc: str, text: str, config: int) -> DataFrame:
    """``doc, term, tf, weight`` of a description configuration, fitted on ``fit_on``.

    tf-idf uses idf = ln((1 + n) / (1 + df)) + 1 and rows of length 1 in the L2 norm.
    """
    cfg = DESC_CONFIGS[config]
    vocab, small = fits(desc_vocabulary(fit_on, F.col(text), cfg.hi))
    if small:
        return known_terms(df, doc, desc_terms(F.col(text), cfg.hi), gathered(vocab, "idf" if cfg.tfidf else None))
    terms = term_table(df, [doc], desc_terms(F.col(text), cfg.hi))
    if not cfg.tfidf:
        return terms.join(vocab, "term", "left_semi").select(doc, "term", "tf", F.col("tf").cast("double").alias("weight"))
    weighed = terms.join(vocab.select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return weighed.select(doc, "term", "tf", (F.col("w") / length).alias("weight"))


def desc_vocabulary(fit_on: DataFrame, text: Column, hi: int) -> DataFrame:
    """``term, df, cf, idf`` of word grams that a thousandth of the texts share.

    That share bounds it: no more than a thousand times the distinct grams of a mean text.
    """
    n = count_docs(fit_on)
    vocab = vocabulary(fit_on.select(F.inline(term_counts(desc_terms(text, hi)))), n, min_df=MIN_DF_SHARE, max_features=None)
    return vocab.withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)


def drop_empty_docs(df: DataFrame, terms: DataFrame, doc: str) -> DataFrame:
    """Documents that hold at least one known term."""
    return df.join(terms.select(doc).distinct(), doc, "left_semi")


def stored(vec: str) -> Column:
    """Indices and values that a vector stores."""
    return F.when(F.col(vec).isNotNull(), F.struct(*[F.unwrap_udt(F.col(vec))[part].alias(part) for part in ("indices", "values")]))


def stored_values(vec: str) -> Column:
    """Values that a vector stores: the non-zero ones of a sparse vector, which is never spread out."""
    return stored(vec)["values"]


def drop_empty_vectors(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector has an element other than 0."""
    return df.filter(F.exists(stored_values(vec), lambda x: x != 0))


def gram_vocabulary(fit_on: DataFrame, code: str, min_df: int = MIN_DF_GRAMS) -> DataFrame:
    """Character grams of 3 to 6 that ``min_df`` documents share and that are one token.

    Grams are counted as hashes; only the shared ones are spelt. Where even their hashes are too
    many for that, grams are counted by their text.
    """
    texts = fit_on.select(plain_text(F.col(code)))
    spelt = spelt_grams(texts, frequent_grams(texts, min_df, GRAM_LO, GRAM_HI), GRAM_LO - 1, GRAM_HI)
    return spelt_gram_vocabulary(fit_on, code, min_df) if spelt is None else spelt


def spelt_gram_vocabulary(fit_on: DataFrame, code: str, min_df: int) -> DataFrame:
    """``gram_vocabulary`` by the text of every gram: each row sends its distinct grams."""
    grams = F.explode(F.array_distinct(char_ngrams(F.col(code), GRAM_LO, GRAM_HI))).alias("gram")
    shared = fit_on.select(grams).groupBy("gram").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df)
    return shared.filter(is_usable_gram(F.col("gram"))).select(strip(F.col("gram")).alias("term")).distinct()


def vocabulary_difference(words: DataFrame, grams: DataFrame) -> DataFrame:
    """Terms of the first vocabulary that the second one lacks."""
    return words.join(grams.select("term"), "term", "left_anti")


@dataclass
class SubwordModel:
    """Chosen words that are no gram, and the grams: each an alphabetical block of the vector."""

    words: Vocabulary
    grams: Grams


def word_and_gram_vocabularies(fit_on: DataFrame, code: str, min_df: int, max_words: int) -> tuple[DataFrame, DataFrame, bool]:
    """Words that are none of the grams, the grams, and whether these can be held by every task. Grams are counted once."""
    grams, small = fits(gram_vocabulary(fit_on, code, min_df))
    chosen = frequent_terms(fit_on, code_tokens(F.col(code)), max_words)
    return vocabulary_difference(chosen.select("term"), grams), grams, small and "hash" in grams.columns


def subword_features(
    df: DataFrame, fit_on: DataFrame, doc: str, code: str, min_df: int = MIN_DF_GRAMS, max_words: int = MAX_FEATURES
) -> DataFrame:
    """``doc, block, term, tf``: counts of shared character grams, and of words that are none of them.

    The chosen grams are counted as grams of 2 to 6 characters, since stripping may shorten them.
    """
    words, grams, small = word_and_gram_vocabularies(fit_on, code, min_df, max_words)
    if small:
        gram_rows = known_grams(df, doc, plain_text(F.col(code)), gathered_grams(grams), GRAM_LO - 1, GRAM_HI)
    else:
        gram_rows = term_table(df, [doc], char_ngrams(F.col(code), GRAM_LO - 1, GRAM_HI)).join(grams.select("term"), "term", "left_semi")
    word_rows = known_terms(df, doc, code_tokens(F.col(code)), gathered(words))  # at most max_words
    return word_rows.select(doc, F.lit("word").alias("block"), "term", "tf").unionByName(
        gram_rows.select(doc, F.lit("char").alias("block"), "term", "tf")
    )


def subword_model(fit_on: DataFrame, code: str, min_df: int = MIN_DF_GRAMS, max_words: int = MAX_FEATURES) -> SubwordModel:
    """Vocabularies for ``subword_vectors``; grams that no task can hold are an error, ``subword_features`` takes them."""
    words, grams, small = word_and_gram_vocabularies(fit_on, code, min_df, max_words)
    if not small:
        raise ValueError("too many grams for vectors; choose a larger min_df or subword_features")
    return SubwordModel(gathered(words), gathered_grams(grams))


def subword_vectors(df: DataFrame, model: SubwordModel, keep: list[str], code: str, out: str = "features") -> DataFrame:
    """Columns ``keep`` and a sparse vector of counts: words, then grams."""
    return gram_vectors(df, keep, code_tokens(F.col(code)), model.words, plain_text(F.col(code)), model.grams, GRAM_LO - 1, GRAM_HI, out)


def count_model(vocab: DataFrame, max_features: int, words: str = "words", out: str = "features") -> CountVectorizerModel:
    """Counting model over a vocabulary of at most ``max_features`` terms."""
    return CountVectorizerModel.from_vocabulary(index_terms(vocab, max_features), inputCol=words, outputCol=out)


def frequent_terms(fit_on: DataFrame, terms: Column, max_features: int) -> DataFrame:
    """The ``max_features`` terms that stand most often in all texts; without document counts, so terms need no order in a row."""
    counted = fit_on.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("cf"))
    return counted.orderBy(F.desc("cf"), "term").limit(max_features)


def bow_model(fit_on: DataFrame, code: str, max_features: int = MAX_FEATURES, out: str = "bow") -> CountVectorizerModel:
    return count_model(frequent_terms(fit_on, code_tokens(F.col(code)), max_features), max_features, "tokens", out)


def bow_vectors(df: DataFrame, model: Model, code: str) -> DataFrame:
    return model.transform(df.withColumn("tokens", code_tokens(F.col(code)))).drop("tokens")


def desc_vectors(df: DataFrame, fit_on: DataFrame, text: str, config: int, out: str = "features") -> DataFrame:
    """All columns and vectors of a description configuration, for ``pyspark.ml`` classifiers. A null text has no terms."""
    cfg = DESC_CONFIGS[config]
    vocab, small = fits(desc_vocabulary(fit_on, F.col(text), cfg.hi))
    if not small:
        raise ValueError("too many grams for vectors; desc_features takes them")
    return term_vectors(df, df.columns, [(desc_terms(F.col(text), cfg.hi), gathered(vocab, "idf" if cfg.tfidf else None))], out)


@dataclass
class GramCounts:
    """Counts of word grams inside each row (``place``, ``tf``), the vocabulary by length, then alphabet, and what each length ends at."""

    rows: DataFrame
    idf: np.ndarray
    ends: dict[int, int]


def desc_counts(df: DataFrame, fit_on: DataFrame, text: str, hi: int) -> GramCounts:
    """Counts of word grams of up to ``hi`` words for all configurations at once.

    A gram is in the vocabulary of a configuration by its own share of texts and its length, so a shorter
    limit is the front of the vocabulary.
    """
    vocab, small = fits(desc_vocabulary(fit_on, F.col(text), hi))
    if not small:
        raise ValueError("too many grams for vectors; desc_features takes them")
    table = vocab.select("term", "idf", (F.length("term") - F.length(F.replace("term", F.lit(" "))) + 1).alias("words")).toArrow().sort_by([("words", "ascending"), ("term", "ascending")])
    words = table["words"].to_numpy()
    rows = term_places(df, desc_terms(F.col(text), hi), Vocabulary(table["term"].combine_chunks()))
    return GramCounts(rows, table["idf"].to_numpy(), {n: int((words <= n).sum()) for n in range(1, hi + 1)})


def config_vectors(rows: DataFrame, counts: GramCounts, config: int) -> DataFrame:
    """``rows`` of ``GramCounts`` with the vectors of one configuration."""
    cfg = DESC_CONFIGS[config]
    return place_vectors(rows, counts.ends[cfg.hi], counts.idf if cfg.tfidf else None)


def assemble(df: DataFrame, blocks: list[str], out: str = "features") -> DataFrame:
    """Feature blocks side by side."""
    return VectorAssembler(inputCols=blocks, outputCol=out).transform(df)


def word2vec(tokens: str = "tokens", out: str = "w2v", size: int = VECTOR_SIZE, min_count: int = 2, epochs: int = 10) -> Word2Vec:
    return Word2Vec(
        vectorSize=size, windowSize=5, minCount=min_count, maxIter=epochs, seed=42, inputCol=tokens, outputCol=out
    )


def train_word_vectors(df: DataFrame, code: str, **options) -> DataFrame:
    """``word, vector`` of the code tokens, trained with skip-grams."""
    model = word2vec(**options).fit(df.select(code_tokens(F.col(code)).alias("tokens")))
    return model.getVectors()


def vectors_as_arrays(vectors: DataFrame, vec: str) -> Column:
    """A vector column of either kind as an array of doubles."""
    return F.col(vec).cast("array<double>") if dict(vectors.dtypes)[vec].startswith("array") else vector_to_array(vec)


def mean_vector(docs: DataFrame, tokens: DataFrame, vectors: DataFrame, doc: str, word: str, vec: str, size: int) -> DataFrame:
    """Mean vector of the known words of each document; zeros where no word is known.

    Word vectors that fit are broadcast, and the mean is an aggregate with partial sums: the
    tokens of a document are added up where they are. A larger table of vectors is joined by
    word, where the rows of frequent words stay where they are.
    """
    arrays, small = measured(vectors.select(word, vectors_as_arrays(vectors, vec).alias("_a")))
    words = tokens.select(doc, word)
    known = (words.join(F.broadcast(arrays), word) if small else join_vectors(words, arrays, word)).select(doc, array_to_vector("_a").alias("_v"))
    means = known.groupBy(doc).agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count("*").alias("n_known"))
    zeros = F.array_repeat(F.lit(0.0), size)
    return docs.select(doc).join(means, doc, "left").select(
        doc, F.coalesce(vector_to_array(F.col("_m")), zeros).alias("mean_vector"), F.coalesce("n_known", F.lit(0)).alias("n_known")
    )


def pair_features(df: DataFrame, key: str, prev: str, cur: str, vectors: DataFrame, bow: Model, size: int = VECTOR_SIZE) -> DataFrame:
    """Word-vector means and token counts of the text before and after a change, side by side."""
    cleaned = df.select(key, *[clean_changes(F.col(c)).alias(c) for c in (prev, cur)])
    out = cleaned
    for c in (prev, cur):
        tokens = cleaned.select(key, F.explode(code_tokens(F.col(c))).alias("word"))
        means = mean_vector(cleaned, tokens, vectors, key, "word", "vector", size)
        out = out.join(means.select(key, array_to_vector("mean_vector").alias(f"w2v_{c}")), key)
    for c in (prev, cur):
        out = bow_vectors(out, bow.copy({bow.getParam("outputCol"): f"bow_{c}"}), c)
    return assemble(out, [f"w2v_{prev}", f"w2v_{cur}", f"bow_{prev}", f"bow_{cur}"]).select(key, "features")


def side_features(df: DataFrame, key: str, side: str, bow: Model) -> DataFrame:
    """Token counts of one side of a change; an empty side has none (null)."""
    counted = bow_vectors(df.select(key, clean_changes(F.col(side)).alias(side)), bow, side)
    vector = F.col(bow.getOutputCol())
    return counted.select(key, F.when(F.size(code_tokens(F.col(side))) > 0, vector).alias("features"))


def embedding_features(df: DataFrame, embedding: str, out: str = "features") -> DataFrame:
    """Stored embeddings, as arrays or as the text of an array, as vectors."""
    is_text = dict(df.dtypes)[embedding] == "string"
    values = parse_vector(F.col(embedding)) if is_text else F.col(embedding).cast("array<double>")
    return df.withColumn(out, array_to_vector(values))


def indexed_label(c: str, out: str = "label") -> StringIndexer:
    """Alphabetical label codes; a label unseen in training is an error."""
    return StringIndexer(inputCol=c, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="error")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind, path: str):
    return kind.load(path)
