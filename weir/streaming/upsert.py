"""Continuous upsert: JSON change files that arrive in a folder are applied batch by batch.

A checkpoint makes each file count once. A batch that is replayed after a failure is recognised by its number, which the table's manifest
keeps for each stream (named by its checkpoint): it was published with the batch's rows, so that both are there or neither.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.journal import JournalTable
from ..sources.ingest import CORRUPT, _split
from ..sources.spec import HEADER_TYPE, TableSpec


def change_stream(spark: SparkSession, path: str, spec: TableSpec, files_per_batch: int = 100) -> DataFrame:
    schema = T.StructType([T.StructField("hdr", HEADER_TYPE), T.StructField("rec", spec.record_type()), T.StructField(CORRUPT, T.StringType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("columnNameOfCorruptRecord", CORRUPT).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").json(path)


def flatten(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """The good rows of a parsed micro-batch."""
    flat = raw.select(*spec.projection(F.col("hdr"), F.col("rec")), F.col(CORRUPT).alias("_bad"))
    return _split(flat, spec, F.lit("")).good


def run_upsert(spark: SparkSession, path: str, table: JournalTable, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append every micro-batch to the journal, until what is there has been read."""

    def each(raw: DataFrame, number: int) -> None:
        rows = flatten(raw, table.spec)
        if on_batch:
            on_batch(rows, number)
        else:
            table.append(rows, batch=(checkpoint, number))
            table.maintain()

    return change_stream(spark, path, table.spec).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
