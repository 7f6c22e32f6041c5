"""What merge and swap share: one image a key in a batch, and what a batch does."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import part_of
from ..plans.plans import merge_problems
from ..sources.spec import TableSpec
from .journal import newest
from .store import ManifestTable


class DuplicateKeys(Exception):
    """A batch has more than one change for a key."""


def compacted(delta: DataFrame, spec: TableSpec, dedup: bool = False) -> DataFrame:
    """The batch with one change a key: the last of each with dedup, else an error where one has more."""
    if dedup:
        return newest(delta, spec.key)
    twice = delta.groupBy(spec.key).count().where("count > 1").limit(5).collect()
    if twice:
        raise DuplicateKeys(f"keys with more than one change: {sorted(r[0] for r in twice)}")
    return delta


def guarded(delta: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    """Without the changes that are older than what the target has: the last writer wins."""
    stored = target.select(F.col(spec.key).alias("_k"), F.col("change_ts").alias("_ts"))
    return delta.join(stored, (F.col(spec.key) == F.col("_k")) & (F.col("change_ts") < F.col("_ts")), "left_anti")


@contextmanager
def staged(table: ManifestTable, delta: DataFrame, stage: bool = True) -> Iterator[DataFrame]:
    """A batch that is looked at several times is parsed once: written beside the table, read from there, removed at the end.
    stage=False: it is a table already. Raises where its columns aren't the table's."""
    if problems := merge_problems(table.spec, delta):
        raise ValueError(f"{table.spec.name}: {'; '.join(problems)}")
    if not stage:
        yield delta
        return
    path = f"{table.path}/stage/{uuid.uuid4().hex}"
    delta.write.parquet(path)
    try:
        yield table.spark.read.schema(delta.schema).parquet(path)
    finally:
        fs, p = table._fs(path)
        fs.delete(p, True)


def month_ranges(delta: DataFrame, key: str) -> dict[int, tuple]:
    """The months of a batch, with the first and last key of each: a row a month."""
    rows = delta.groupBy(part_of().alias("p")).agg(F.min(key).alias("a"), F.max(key).alias("b")).collect()
    return {r.p: (r.a, r.b) for r in sorted(rows, key=lambda r: (r.p is not None, r.p))}
