"""Timings and their reports."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "run int, method string, load_ms double, apply_ms double, changes long"
STEPS = "run int, parallel int, table string, ms double"


class Timer:
    """Wall-clock milliseconds of named steps."""

    def __init__(self) -> None:
        self.ms: dict[str, float] = {}

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        t = time.monotonic()
        try:
            yield
        finally:
            self.ms[name] = self.ms.get(name, 0) + (time.monotonic() - t) * 1000


def averages(runs: DataFrame) -> DataFrame:
    """method, runs, load_ms, apply_ms, total_ms (averages), rows_per_s, ratio to the best total."""
    total = F.col("load_ms") + F.col("apply_ms")
    a = runs.groupBy("method").agg(F.count("*").alias("runs"), F.avg("load_ms").alias("load_ms"), F.avg("apply_ms").alias("apply_ms"), F.avg(total).alias("total_ms"), F.avg("changes").alias("_c"))
    best = F.min("total_ms").over(Window.partitionBy())  # a row a method
    return a.select("method", "runs", "load_ms", "apply_ms", "total_ms", (F.col("_c") * 1000 / F.col("total_ms")).alias("rows_per_s"), (F.col("total_ms") / best).alias("ratio"))


def by_parallel(steps: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """table and a column p<n> of average milliseconds for each degree of parallelism."""
    levels = levels or sorted(r[0] for r in steps.select("parallel").distinct().collect())
    p = steps.groupBy("table").pivot("parallel", levels).agg(F.avg("ms"))
    return p.select("table", *[F.col(f"`{n}`").alias(f"p{n}") for n in levels])


def markdown(df: DataFrame) -> str:
    rows = df.collect()
    cell = lambda v: f"{v:,.2f}" if isinstance(v, float) else "" if v is None else str(v)
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in rows]])


def tsv(df: DataFrame) -> str:
    return "\n".join("\t".join("" if v is None else str(v) for v in r) for r in [df.columns, *df.collect()])


def frame(spark: SparkSession, rows: list[tuple], schema: str = SCHEMA) -> DataFrame:
    return spark.createDataFrame(rows, schema)
