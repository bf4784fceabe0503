"""The registered corpus queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.llm import ann, decontam, hilbert, html_crf, langid, packing, preference, simhash, suffix_dedup, toxicity
from framelark.llm._spark import table, tune

# Each query applies its operator to whole tables and cuts its result to the columns that are
# compared; what nulls, ties and repeated rows give is told by the operator.


def remainder(key: Column, by: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % by


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of four-word shingles and the components of links of at most 4 bits."""
    tune(spark)
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4, blocks=6)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    tune(spark)
    return html_crf.extracted(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text; every fifth document by hash is held out from learning."""
    tune(spark)
    found = langid.identify(
        table(spark, sf_dir, "documents"),
        usable=lambda key: remainder(key, 5) != 0,
        held_out=lambda key: F.coalesce(remainder(key, 5) == 0, F.lit(False)),
    )
    return found.withColumnRenamed("id", "doc_id")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces and their places in sequences of 2048."""
    import public_tokenizers

    tune(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    packed = packing.pack(table(spark, sf_dir, "documents"), path, capacity=2048, end_id=0, keep_ids=False)
    return packed.withColumnRenamed("id", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every text; every third document by hash is held out from learning."""
    tune(spark)
    found = toxicity.classify(
        table(spark, sf_dir, "documents"),
        table(spark, sf_dir, "labels"),
        usable=lambda key: remainder(key, 3) != 1,
        held_out=lambda key: F.coalesce(remainder(key, 3) == 1, F.lit(False)),
    )
    return found.withColumnRenamed("id", "doc_id")


def op6_learned_partition_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every vector whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, lambda key: F.pmod(key, F.lit(100)) == 0, k=10, target=0.95)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that stand in documents, at least 0.8 of their five-word shingles."""
    tune(spark)
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.contained(docs, items, words=5, threshold=0.8).withColumnRenamed("id", "doc_id")


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of equal counts along the curve through language, source and size."""
    dealt = hilbert.shard(table(spark, sf_dir, "documents"), shards=8, bits=5)
    return dealt.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("h").alias("curve_index"),
    )


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 as chosen and rejected, a row per turn."""
    turns = table(spark, sf_dir, "conversations")
    pair = F.shiftright("conv_id", 1)
    return preference.preferences(turns, pair, F.expr("pmod(conv_id, 2) = 0"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 100 bytes that start earlier."""
    tune(spark)
    found = suffix_dedup.summary(table(spark, sf_dir, "documents"), width=100)
    return found.withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_html_main_text": op2_html_main_text,
    "op3_language_id": op3_language_id,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_toxicity": op5_toxicity,
    "op6_learned_partition_ann": op6_learned_partition_ann,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_hilbert_shards": op8_hilbert_shards,
    "op9_preference_format": op9_preference_format,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
}

SQL: dict[str, str] = {"op9_preference_format": preference.SQL}
