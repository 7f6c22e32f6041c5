"""The queries of the operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat_format, lm, quality
from .common import small_batches, table
from .exact_dedup import exact_dedup
from .packing import pack, pieces
from .pieces import encode_digests
from .simhash import near_duplicates
from .suffix_dedup import removal_digests
from .token_counts import section_counts


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return removal_digests(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return section_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rule="most")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack(pieces(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))).withColumnRenamed("_id", "doc_id")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return encode_digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("_rid")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    vectors = ann.clean(table(spark, sf_dir, "embeddings"))
    return ann.search(vectors, vectors.where("_id % 100 = 0"))


def event_log(turns: DataFrame) -> DataFrame:
    """The events from which a log's reader gets the turns: what users and others say is drafted and edited; an assistant's text is streamed,
    regenerated, streamed anew, edited on the way and streamed to its end. The sequence number is the turn and a step in it."""
    text = F.coalesce("text", F.lit(""))
    n, third = F.length(text), F.floor(F.length(text) / 3).cast("int")
    a, ab, b, c = text.substr(F.lit(1), third), text.substr(F.lit(1), 2 * third), text.substr(third + 1, third), text.substr(2 * third + 1, n)
    half = text.substr(F.lit(1), F.floor(n / 2).cast("int"))
    steps = lambda *said: F.array(*[F.struct(F.lit(k).alias("step"), F.lit(kind).alias("kind"), x.cast("string").alias("text")) for k, (kind, x) in enumerate(said)])
    streamed = steps(("delta", half), ("regenerate", F.lit(None)), ("delta", a), ("delta", F.concat(b, F.lit("?"))), ("edit", ab), ("delta", c))
    drafted = steps(("message", half), ("edit", text))
    log = turns.withColumn("message", F.monotonically_increasing_id()).withColumn("e", F.explode(F.when(F.col("role") == chat_format.ASSISTANT, streamed).otherwise(drafted)))
    return log.select("conv_id", F.struct("turn", "e.step").alias("seq"), "e.kind", "message", "role", "e.text")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.digests(chat_format.format_chats(event_log(rows)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_chat_formatting": op10_chat_formatting,
}

SQL: dict[str, str] = {
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op10_chat_formatting": """
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
             e AS (SELECT *, length(regexp_replace(role, '([<\\[])(\\\\*)(/?s>|/?INST\\])', '\\1\\2\\\\\\3', 'g')) AS r,
                          length(regexp_replace(text, '([<\\[])(\\\\*)(/?s>|/?INST\\])', '\\1\\2\\\\\\3', 'g')) AS x FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(3 + sum(6 + r + 7 + x + 4) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
}
