"""A corpus cleaned in five stages and packed for training.

Every stage takes ``(spark, docs, sf_dir)``; its result is written and read
again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.llm import decontam, packing, simhash, suffix_dedup, toxicity
from framelark.llm._spark import kept, table, tune
from framelark.llm.queries import remainder


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon does not reject (score below 0.7).

    Null and empty texts stay, as do repeated rows, with all columns.
    """
    tune(spark)
    labels = table(spark, sf_dir, "labels")
    rows = toxicity.training_rows(docs, labels, lambda key: remainder(key, 3) != 1, 10_000, "doc_id", "text", "toxic")
    score = toxicity.score_udf(toxicity.learn(rows))
    return docs.where(score(F.col("text").cast("string")) < 0.7)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: at least 0.8 of the five-word shingles in common.

    The smallest id stays, a null id only alone; texts without a word are one
    group, and rows that repeat id and text are copies too.
    """
    tune(spark)
    return simhash.representatives(docs, words=5, similarity=0.8)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that also start earlier; what is emptied goes.

    Null and empty texts stay as they are; documents are ordered by id, null
    last.  ``n_chars``, if there is such a column, follows the text.
    """
    tune(spark)
    cut = suffix_dedup.cleaned(docs, width=100)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; null and empty texts contain none."""
    tune(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), words=5, threshold=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and their places in sequences of 2048; a null text is its end id."""
    import public_tokenizers

    tune(spark)
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)
    return pieces.withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", not_toxic),
    ("simhash_near_dedup", one_of_near_copies),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", not_in_benchmark),
    ("best_fit_packing", packed),
]

#: SQL can't say the stages; the tests hold each against a plain form of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``: the packed pieces of those that stay.

    What a stage stages on its way goes once its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
