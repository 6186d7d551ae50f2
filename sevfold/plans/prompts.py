"""Prompt texts and the reading of a model's word scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sevfold.functions.text import head_words

CODE_WORDS, DESC_WORDS = 384, 64
DESC_MARK = "<desc>"

# Template texts. {a} is the code, {b} the description, {mask} the word asked for.
TEMPLATES = {
    "mixed": 'The code snippet: {a} The vulnerability description:" {b} Classify the severity: {mask}',
    "hard": 'The code snippet: {a} The vulnerability description:" {b} Classify the severity: {mask}',
    "soft": "The code snippet: {a} The vulnerability description: {b} Classify the severity: {mask}",
    "code_only": "The code snippet: {a} Classify the severity: {mask}",
    "description_only": "The vulnerability description: {b} Classify the severity: {mask}",
    "other_model": "The code snippet: {a} The vulnerability description: {b} Classify the severity: {mask}",
    "concat": "{a}<desc>{b}",
}
# Which leading words of a template are trained as soft tokens.
SOFT_PARTS = {
    "mixed": ["Classify the severity:"],
    "hard": [],
    "soft": ["The code snippet:", "The vulnerability description:", "Classify the severity:"],
    "code_only": ["Classify the severity:"],
    "description_only": ["Classify the severity:"],
    "other_model": ["Classify the severity:"],
    "concat": [],
}
# Label words per class.
LABEL_WORDS = {
    1: {"LOW": ["low"], "MEDIUM": ["medium"], "HIGH": ["high"], "CRITICAL": ["critical"]},
    2: {
        "LOW": ["low", "slight"], "MEDIUM": ["medium", "moderate"],
        "HIGH": ["high", "severe"], "CRITICAL": ["critical", "significant"],
    },
    3: {
        "LOW": ["low", "slight", "small"], "MEDIUM": ["medium", "moderate", "middle"],
        "HIGH": ["high", "severe", "big"], "CRITICAL": ["critical", "significant", "urgent"],
    },
}


def prompt_text(template: str, a: Column, b: Column, mask: str) -> Column:
    """The template as a concatenation of its fixed parts and the two texts."""
    pieces = [template]
    for mark in ("{a}", "{b}"):  # each is in a template once at most
        pieces = [x for piece in pieces for x in (_around(piece, mark) if mark in piece else [piece])]
    values = {"{a}": a, "{b}": b}
    return F.concat(*[values.get(p, F.lit(p.replace("{mask}", mask))) for p in pieces if p])


def _around(piece: str, mark: str) -> list[str]:
    before, after = piece.split(mark)
    return [before, mark, after]


def prompt_examples(df: DataFrame, guid: str, code: str, description: str, label: str) -> DataFrame:
    """``guid, text_a, text_b, tgt_text`` with both texts cut to their word limits."""
    return df.select(
        F.col(guid).alias("guid"),
        head_words(F.col(code), CODE_WORDS).alias("text_a"),
        head_words(F.col(description), DESC_WORDS).alias("text_b"),
        F.col(label).cast("int").alias("tgt_text"),
    )


def render_prompt(examples: DataFrame, variant: str, mask: str = "<mask>") -> DataFrame:
    """Add ``prompt``, the text that the variant's template makes of each example."""
    text = prompt_text(TEMPLATES[variant], F.col("text_a"), F.col("text_b"), mask)
    return examples.withColumn("prompt", text)


def prompt_pieces(variant: str) -> list[tuple[str, bool]]:
    """Pieces of a template in order, each with whether it is trained as soft tokens."""
    pieces = [(TEMPLATES[variant], False)]
    for part in SOFT_PARTS[variant]:
        cut = []
        for text, soft in pieces:
            before, found, after = (text, "", "") if soft else text.partition(part)
            cut += [(text, soft)] if not found else [(before, False), (part, True), (after, False)]
        pieces = cut
    return [(text, soft) for text, soft in pieces if text]


def render_parts(examples: DataFrame, variant: str, mask: str = "<mask>") -> DataFrame:
    """Add ``parts``: the pieces of the rendered prompt, each with whether its words are soft."""
    return examples.withColumn("parts", parts_of(variant, F.col("text_a"), F.col("text_b"), mask))


def parts_of(variant: str, a: Column, b: Column, mask: str) -> Column:
    pieces = prompt_pieces(variant)
    return F.array(*[F.struct(prompt_text(text, a, b, mask).alias("text"), F.lit(soft).alias("soft")) for text, soft in pieces])


def argmax(scores: Column) -> Column:
    """Index from 0 of the largest score, the first one in a tie."""
    return F.array_position(scores, F.array_max(scores)) - 1


def label_word_table(df: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """The verbalizer as a table ``word, class, class_index``: a dozen rows."""
    rows = [(w, c, i) for i, (c, ws) in enumerate(words.items()) for w in ws]
    return df.sparkSession.createDataFrame(rows, "word string, class string, class_index int")


def verbalize(scores: DataFrame, key: str, words: dict[str, list[str]]) -> DataFrame:
    """Class per row from ``key, word, score``: mean score of each class's words, then the largest.

    The classes are known, so one aggregate holds all their means. Keys without any known word have no row.
    """
    means = scores.groupBy(key).agg(
        *[F.avg(F.when(F.col("word").isin(ws), F.col("score"))).alias(f"_c{i}") for i, ws in enumerate(words.values())]
    )
    per_class = F.filter(
        F.array(*[F.struct(F.col(f"_c{i}").alias("score"), F.lit(-i).alias("order"), F.lit(c).alias("class")) for i, c in enumerate(words)]),
        lambda c: c["score"].isNotNull(),
    )
    best = means.withColumn("_b", F.array_max(per_class)).filter(F.col("_b").isNotNull())
    return best.select(key, F.col("_b.class").alias("pred_class"), (-F.col("_b.order")).alias("pred"), F.col("_b.score").alias("score"))
