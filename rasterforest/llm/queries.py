"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, cover_tree, hard_negatives, html_extract, jaccard, lexical, licenses, mixing, packing, projection_search, secrets, suffixes, toxicity
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff.backoff_scores(table(spark, sf_dir, "documents"), order=3, backoff=0.4)
    return found.select("doc_id", "n_words", F.round("score", 6).alias("score"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations under limits on tokens, turns' segments and the assistant's loss-bearing tokens."""
    examples = packing.instruction_examples(table(spark, sf_dir, "conversations"), tokenizer_path())
    return packing.pack_examples(examples, packing.Limits(tokens=4096, segments=64, loss=2048))


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cover_tree.scaled(table(spark, sf_dir, "embeddings"))
    return cover_tree.top_inner_products(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, lexicon, threshold=0.3).select("doc_id", "held_out", "score", "predicted")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = mixing.label_quality(table(spark, sf_dir, "labels"))
    mixed = mixing.mix(table(spark, sf_dir, "documents"), quality)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return projection_search.nearest_neighbours(vectors.where(F.col("vec_id") % 100 == 0), vectors, k=10)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    chain = html_extract.fit(pages)
    return html_extract.extract(pages.select("page_id", "url", "html"), chain, keep_html=False).select("page_id", "url", "text", "n_chars")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = hard_negatives.whole_components(F.col("embedding").cast("array<double>"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), scaled.alias("vector"))
    return hard_negatives.mine_hard_negatives(vectors, F.col("vec_id") % 50 == 0, positives=5, negatives=3)


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"), repository=F.col("doc_id"), owner=F.col("source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_backoff": op1_backoff,
    "op2_packing": op2_packing,
    "conversation_packing": conversation_packing,
    "op3_cover_tree": op3_cover_tree,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_jaccard": op6_jaccard,
    "op7_suffixes": op7_suffixes,
    "op8_licenses": op8_licenses,
    "op9_projections": op9_projections,
    "op10_html_extract": op10_html_extract,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_lexical": op12_lexical,
    "op13_secrets": op13_secrets,
}

ORACLES: dict[str, str] = {
    "op1_backoff": backoff.ORACLE,
    "op3_cover_tree": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS vector FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.vector, c.vector)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vector) = len(c.vector) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op5_mixing": mixing.ORACLE,
    "op8_licenses": licenses.oracle(),
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_lexical": lexical.ORACLE,
    "op13_secrets": secrets.oracle(),
}
