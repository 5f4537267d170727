"""A corpus pipeline: quality rules, near-dedup, suffix dedup, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.llm.bpe import encode_documents
from graphquarry.llm.common import id_crc_mod3, read_table, shared_folder
from graphquarry.llm.mixing import mix_to_targets
from graphquarry.llm.near_dedup import near_duplicates
from graphquarry.llm.quality_rules import MAX_REPEAT, MIN_WORDS, measure, passes
from graphquarry.llm.queries import TARGETS
from graphquarry.llm.suffix_dedup import repeated_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    m = measure(docs.select(*COLUMNS))
    good = (F.col("n_words") >= MIN_WORDS) & (F.col("n_repeat_words") * 100 <= F.col("n_words") * MAX_REPEAT) & passes()
    return m.where(good).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays: that of the smallest doc_id, each of its texts once: of equal texts the row of the least lang, source and n_chars."""
    kept = near_duplicates(docs, k=5, percent=80).where("kept").select("doc_id").distinct()
    named = docs.select(*COLUMNS).join(kept.where("doc_id IS NOT NULL").hint("merge"), "doc_id", "left_semi")
    named = named.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("r")).select("doc_id", "text", "r.lang", "r.source", "r.n_chars")
    return named.unionByName(docs.select(*COLUMNS).where("doc_id IS NULL"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated passages go; a character that a cut leaves in part goes with them. Texts may become empty."""
    rest = repeated_spans(docs, least=100, carry=("lang", "source"), texts=True)
    return rest.select("doc_id", F.col("kept_text").alias("text"), "carried.lang", "carried.source", F.length("kept_text").cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the languages want it; at these targets at least once."""
    labelled = docs.where(id_crc_mod3() != 1).select("doc_id", F.col("lang").alias("domain"))
    copies = mix_to_targets(docs, labelled, TARGETS).select("doc_id", "copies").dropDuplicates(["doc_id"])
    wanted = docs.select(*COLUMNS).join(copies.hint("merge"), "doc_id", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    return wanted.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (little-endian unsigned 32-bit) and whether they decode to it."""
    d = docs.select(*COLUMNS).withColumn("whole", F.coalesce("text", F.lit("")).cast("binary"))
    out = encode_documents(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return out.select("doc_id", "lang", "source", "n_chars", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("whole")).alias("exact"))


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("suffix dedup", suffix_dedup), ("mixing", mixing), ("byte-level BPE", tokens)]

#: SQL cannot express the sketches, the fitted rates or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark)}/pipeline-{k}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
