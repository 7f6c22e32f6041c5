"""A training-data pipeline: each stage works on all documents that the one before it kept.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. Null texts count as empty; empty tables pass through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import exact_dedup, packing, quality, simhash, suffix_dedup
from weir.llm.common import apart, fold, forget, materialize, shared_dir, small_batches, table, written
from weir.llm.queries import tokenizer

#: A passage is repeated from this many bytes on: some 30 words, so that passages of 50 words are caught with their edges.
PASSAGE = 200
#: Words whose ids a worker remembers; workers live through all stages and share their memory with the others.
WORDS_KEPT = 300_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a score of at least quality.THRESHOLD."""
    small_batches(spark)
    docs, back = apart(docs)
    space = quality.fit(docs, table(spark, sf_dir, "labels"), fold("_id", quality.FOLDS) != quality.HELD_OUT)
    scored = quality.score(docs, space, keep=docs.columns, name="_w_score")
    return scored.where(F.col("_w_score") >= quality.THRESHOLD).select(*docs.columns).withColumnsRenamed(back)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    docs, back = apart(docs)
    numbered = materialize(docs.withColumn("_w_row", F.monotonically_increasing_id()), "numbered")
    gone = exact_dedup.exact_dedup(numbered, row_id="_w_row").where("not kept").select(F.col("_rid").alias("_w_row"))
    return numbered.join(gone, "_w_row", "left_anti").select(*docs.columns).withColumnsRenamed(back)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the smallest doc_id stays."""
    small_batches(spark)
    rows, number = simhash.numbered(docs, "doc_id")
    gone = materialize(simhash.near_copies(rows, number).where("not kept").select(number), "near_copies")
    return rows.join(gone, number, "left_anti").select(*docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of PASSAGE bytes or more that occur again out of the texts; n_chars follows."""
    small_batches(spark)
    docs, back = apart(docs)
    return suffix_dedup.remove(docs, length=PASSAGE, size_col="n_chars").withColumnsRenamed(back)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    small_batches(spark)
    return packing.pack(packing.pieces(docs, tokenizer("word_bpe_49k.json"), keep=WORDS_KEPT)).withColumnRenamed("_id", "doc_id")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before = written()
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        forget(spark, before)  # the stage's own tables; its result doesn't need them any more
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
