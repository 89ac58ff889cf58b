"""The numbered queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bitslice, decontaminate, embed_dedup, jaccard, licenses, line_dedup, lm_score, pieces, secrets, shallot, suffix_dedup, toxicity, turns


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {
    "op1_license_scan": lambda s, d: licenses.scan(read(s, d, "documents")),
    "op2_toxicity": lambda s, d: toxicity.classify(read(s, d, "documents"), read(s, d, "labels")),
    "op3_decontaminate": lambda s, d: decontaminate.decontaminate(read(s, d, "documents"), read(s, d, "benchmark")),
    "op4_sentencepiece": lambda s, d: pieces.round_trip(read(s, d, "documents")),
    "op5_line_dedup": lambda s, d: line_dedup.digest(read(s, d, "documents")),
    "op6_secret_scan": lambda s, d: secrets.scan(read(s, d, "documents")),
    "op7_suffix_dedup": lambda s, d: suffix_dedup.digest(read(s, d, "documents")),
    "op8_jaccard_join": lambda s, d: jaccard.classes(read(s, d, "documents")),
    "op9_embedding_dedup": lambda s, d: embed_dedup.near_duplicates(read(s, d, "embeddings")),
    "op10_lm_score": lambda s, d: lm_score.score_quality(read(s, d, "documents"), read(s, d, "labels")),
    "op11_centroids": lambda s, d: shallot.digest(read(s, d, "embeddings")),
    "op12_conversation_repair": lambda s, d: turns.digest(read(s, d, "conversations")),
    "op13_exact_topk": lambda s, d: bitslice.top_products(read(s, d, "embeddings")),
}

ORACLE_SQL = {"op5_line_dedup": line_dedup.DIGEST_SQL, "op11_centroids": shallot.DIGEST_SQL, "op12_conversation_repair": turns.DIGEST_SQL, "op13_exact_topk": bitslice.TOP_SQL}
