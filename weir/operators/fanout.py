"""Parse once, apply to many tables: a batch is parsed a single time into a columnar stage, then each table reads its own columns.

The stage is Parquet with one nested column a table, so a table's read is pruned to that column (mixed records are also partitioned
by `file`). Tables are applied by a bounded number of threads, each submitting its own Spark jobs into a pool of its own.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ingest
from ..sources.spec import TableSpec
from ..workdir import work_path


@dataclass
class Applied:
    table: str
    ms: float
    result: object


class FanOut:
    def __init__(self, spark: SparkSession, specs: dict[str, TableSpec], stage: str, shape: str, max_occurs: int | None = None, strict: bool = False):
        self.spark, self.specs, self.stage, self.shape, self.max_occurs, self.strict = spark, specs, stage, shape, max_occurs, strict

    @classmethod
    def from_records(cls, spark: SparkSession, path: str, specs: dict[str, TableSpec], stage: str | None = None) -> FanOut:
        """Mixed flat records."""
        out = cls(spark, specs, stage or work_path(spark, "stage"), "mixed")
        ingest.parse_mixed(spark, path, specs).withColumn("_file", F.coalesce("hdr.file", F.lit("?"))).write.partitionBy("_file").parquet(out.stage)
        return out

    @classmethod
    def from_documents(cls, spark: SparkSession, path: str, specs: dict[str, TableSpec], stage: str | None = None, max_occurs: int | None = None, strict: bool = False) -> FanOut:
        """Transaction documents. max_occurs: records of a table in a document that are taken; strict: raise where one has more."""
        out = cls(spark, specs, stage or work_path(spark, "stage"), "documents", max_occurs, strict)
        ingest.parse_documents(spark, path, specs).write.parquet(out.stage)
        if strict and max_occurs is not None:
            worst = ingest.overflow(out.parsed(), specs, max_occurs).limit(3).collect()
            if worst:
                raise ingest.LoadError(f"documents with more than {max_occurs} records of a table: {[tuple(r) for r in worst]}")
        return out

    def parsed(self) -> DataFrame:
        return self.spark.read.parquet(self.stage)

    def load(self, table: str) -> ingest.Load:
        parsed, spec = self.parsed(), self.specs[table]
        if self.shape == "mixed":
            return ingest.mixed_source(parsed.where(F.col("_file") == table), spec)
        return ingest.document_source(parsed, spec, self.max_occurs)

    def source(self, table: str) -> DataFrame:
        return self.load(table).good

    def rejects(self, table: str | None = None) -> DataFrame:
        """reason, record: the rows that one table rejects, or the lines that no table takes."""
        if table:
            return self.load(table).rejects
        parsed = self.parsed()
        if self.shape == "mixed":
            return ingest.mixed_rejects(parsed, self.specs)
        return parsed.where(F.col(ingest.CORRUPT).isNotNull()).select(F.lit("not a record of this shape").alias("reason"), F.col(ingest.CORRUPT).alias("record"))

    def reject_counts(self) -> dict[str | None, int]:
        """Rejects by table; None: lines that no table takes. One pass over the stage."""
        return ingest.reject_counts(self.parsed(), self.specs, self.shape == "documents")

    def check(self) -> None:
        """Raises if anything was rejected: to be called before the batch is applied, so that no table has changed."""
        if bad := self.reject_counts():
            raise ingest.LoadError(f"rejected: {bad}")

    def apply(self, work: Callable[[str, DataFrame], object], parallel: int = 1) -> list[Applied]:
        """work(table, rows) for each table, at most `parallel` at a time, in the order of the specifications."""

        def one(table: str) -> Applied:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fanout-{table}")
            t = time.monotonic()
            result = work(table, self.source(table))
            return Applied(table, (time.monotonic() - t) * 1000, result)

        with ThreadPoolExecutor(max(1, parallel)) as pool:
            return list(pool.map(inheritable_thread_target(self.spark)(one), self.specs))
