"""Checks of loads, batches and methods: counts and checksums."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fingerprint, split_mix


class CheckFailed(Exception):
    """A check found a difference."""


def batch_check(target: DataFrame, source: DataFrame, batch_id: int = 1, how: str = "xxhash64") -> DataFrame:
    """One row: n_rows of the target, batch_rows, target_checksum of the batch's rows there, source_checksum."""
    columns = source.columns
    batch = F.col("batch_id") == batch_id
    mine = fingerprint(target.where(batch), columns, how).select(F.col("n_rows").alias("batch_rows"), F.col("checksum").alias("target_checksum"))
    theirs = fingerprint(source, columns, how).select(F.col("checksum").alias("source_checksum"))
    # each side has one row
    return target.agg(F.count("*").alias("n_rows")).crossJoin(mine).crossJoin(theirs)


def expect_batch(target: DataFrame, source: DataFrame, rows: int, changes: int, batch_id: int = 1) -> None:
    r = batch_check(target, source, batch_id).first()
    if (r.n_rows, r.batch_rows) != (rows, changes) or r.target_checksum != r.source_checksum:
        raise CheckFailed(f"{r.asDict()}; expected {rows} rows, {changes} of the batch and equal checksums")


def check_from(base: DataFrame, delta: DataFrame, base_rows: int) -> DataFrame:
    """check_from: the first key of the month of the oldest row that changes (keys grow with created_date)."""
    first = delta.where(F.col("isn") <= base_rows).agg(F.min("created_date").alias("d"))
    month = F.trunc("d", "MM").alias("m")
    return base.join(F.broadcast(first.select(month)), F.col("created_date") >= F.col("m")).agg(F.min("isn").alias("check_from"))


def expected_rows(base_rows: int, first: int, changes: int, mix: str = "50:0:50") -> int:
    """Current rows from key `first` on, after a batch of that mix."""
    _, deletes, inserts = split_mix(changes, mix)
    return base_rows - first + 1 - deletes + inserts


def compare(currents: dict[str, DataFrame], columns: list[str] | None = None, first: int | None = None, how: str = "xxhash64") -> DataFrame:
    """method, n_rows, checksum of the current rows of each method, from key `first` on."""
    out = None
    for name, df in currents.items():
        scope = df.where(F.col("isn") >= first) if first is not None else df
        row = fingerprint(scope, columns or sorted(df.columns), how).select(F.lit(name).alias("method"), "n_rows", "checksum")
        out = row if out is None else out.unionByName(row)
    return out


def expect_equal(compared: DataFrame, rows: int | None = None) -> tuple[int, int]:
    found = {(r.n_rows, r.checksum) for r in compared.collect()}
    if len(found) != 1 or (rows is not None and next(iter(found))[0] != rows):
        raise CheckFailed(f"{sorted(found)}" + f", {rows} rows expected" * (rows is not None))
    return next(iter(found))


def sizes(tables: dict[str, tuple[object, int]]) -> list[tuple[str, bool, int, int, int]]:
    """name, present, months, n_rows, expected of each table; rows come from the manifest unless delete vectors hide some."""
    return [(n, True, len(t.parts()), t.count(), rows) if t.exists() else (n, False, 0, 0, rows) for n, (t, rows) in tables.items()]


def preflight(tables: dict[str, tuple[object, int]]) -> None:
    """tables: name to (ManifestTable, rows expected). Raises where one is missing or of another size."""
    for name, present, _, n, rows in sizes(tables):
        if not present:
            raise CheckFailed(f"{name} is missing; generate it first")
        if n != rows:
            raise CheckFailed(f"{name} has {n} rows, {rows} expected; generate it again")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, repeats counted: n_first (rows of a that b hasn't), n_both, n_second, and n_distinct rows of either. One aggregation by
    whole rows, combined before its shuffle, in place of three set operations."""
    columns = a.columns
    tagged = a.withColumns({"_a": F.lit(1), "_b": F.lit(0)}).unionByName(b.select(*columns).withColumns({"_a": F.lit(0), "_b": F.lit(1)}))
    n = tagged.groupBy(*columns).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    return n.agg(total(F.greatest(F.col("_a") - F.col("_b"), F.lit(0)))("n_first"), total(F.least("_a", "_b"))("n_both"), total(F.greatest(F.col("_b") - F.col("_a"), F.lit(0)))("n_second"), F.count("*").alias("n_distinct"))


def differences(a: DataFrame, b: DataFrame) -> Iterable:
    """Rows of either that the other hasn't, for the report of a failed check."""
    conf, name = a.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(name)
    conf.set(name, "false")  # set operations over many computed columns: inferring constraints takes exponential time
    try:
        b = b.select(*a.columns)
        return a.exceptAll(b).withColumn("_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("_in", F.lit("second"))).limit(20).collect()
    finally:
        conf.set(name, before)
