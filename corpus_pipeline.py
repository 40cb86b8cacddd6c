"""Corpus pipeline: toxicity, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Each stage's result is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterforest.llm import jaccard, mixing, packing, suffixes, toxicity
from rasterforest.llm.common import materialize, numbered, table, word_count
from rasterforest.llm.queries import tokenizer_path

#: No single SQL statement expresses the learned lexicon, the components or the packing.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that the lexicon marks toxic, each by its own score."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, lexicon)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group linked by five-word shingles at a similarity of 0.8, the smallest doc_id if any."""
    return jaccard.distinct_documents(docs, n=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out bytes of strings of 200 that occur elsewhere; documents that lose all their words go."""
    done = suffixes.remove_repeats(docs, length=200, as_text=True)
    changed = F.size("spans") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    done = done.withColumn("text", text).where(~changed | (word_count(F.col("text")) > 0))
    return done.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal 150 % of all words to the sources by weight; a document comes once per take."""
    rows = numbered(docs, "mix-rows")
    mixed = mixing.mix(rows, mixing.label_quality(table(spark, sf_dir, "labels")), row="_row")
    return mixing.apply_mix(rows, mixed, "_row").withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences of at most 4096; one row per piece."""
    pieces = packing.pack_documents(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
