"""The queries of this subpackage: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, filter_audit, language_id, toxicity
from . import quality_rules as rules
from .bpe import encode_documents
from .common import id_crc_mod3, read_table
from .embedding_dedup import near_duplicate_vectors
from .line_dedup import dedup_lines
from .line_dedup import oracle_sql as line_sql
from .mixing import mix_to_targets
from .near_dedup import near_duplicates
from .site_quality import site_quality
from .suffix_dedup import repeated_spans
from .token_files import read_tokens, write_tokens


#: Wanted shares of tokens by domain.
TARGETS = {"en": 0.5, "fr": 0.18, "de": 0.18, "es": 0.14}


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=4, percent=80)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").where(id_crc_mod3() != 1)
    index = toxicity.learn(docs, labels)
    out = toxicity.score(docs, index)
    return out.select("doc_id", F.coalesce(id_crc_mod3() == 1, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op5_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources; a source's languages stand for its paths. Labels of the held-out fold are not used."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    return site_quality(docs, read_table(spark, sf_dir, "labels").where(id_crc_mod3() != 1))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(read_table(spark, sf_dir, "documents"), least=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["stop"] - x["start"]))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains are the languages that documents outside the held-out fold are labelled with."""
    docs = read_table(spark, sf_dir, "documents")
    labelled = docs.where(id_crc_mod3() != 1).select("doc_id", F.col("lang").alias("domain"))
    return mix_to_targets(docs, labelled, TARGETS)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    langs, log_p = language_id.learn(docs.where(id_crc_mod3() != 1))
    out = language_id.identify(docs.select("doc_id", "text"), langs, log_p)
    return out.select("doc_id", F.coalesce(id_crc_mod3() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    digest = [F.sha2(F.col(a), 256).alias(b) for a, b in (("ids", "ids_sha256"), ("decoded", "decoded_sha256"))]
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), *digest)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents"), least=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_toxicity, op3_token_files, op4_quality_rules, op5_site_quality, op6_suffix_dedup, op7_embedding_near_dedup, op8_mixing, op9_language_id, op10_byte_bpe, op11_source_divergence, op12_filter_audit, op13_line_dedup)}
ORACLE_SQL: dict[str, str] = {"op4_quality_rules": rules.oracle_sql(), "op11_source_divergence": divergence.oracle_sql(), "op12_filter_audit": filter_audit.oracle_sql(), "op13_line_dedup": line_sql()}
