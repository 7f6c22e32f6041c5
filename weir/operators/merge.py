"""Merge by key: matched rows get the batch's image, unmatched ones are added; deletes stay as tombstones.

`vectors` writes the batch, whose files are the delete vector of its keys: its cost follows the batch. `copy` rewrites the months that hold the
batch's keys, as a table without vectors needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import part_of
from ..plans.plans import expect_nodes
from .changes import compacted, guarded, month_ranges, staged
from .journal import live
from .store import ManifestTable


def merged(target: DataFrame, delta: DataFrame, key: str = "isn") -> DataFrame:
    """The merged rows, tombstones included: an anti join and a union, with no outer join."""
    return target.join(delta.select(key), key, "left_anti").unionByName(delta.select(*target.columns))


def outer_merged(target: DataFrame, delta: DataFrame, key: str = "isn") -> DataFrame:
    """The same rows by the general plan, a full outer join that shuffles both sides whole: a check of `merged`, not a way to apply."""
    columns = target.columns
    old, new = target.select(F.struct(*columns).alias("_old")), delta.select(F.struct(*columns).alias("_new"))
    return old.join(new, F.col(f"_old.{key}") == F.col(f"_new.{key}"), "full_outer").select(F.coalesce("_new", "_old").alias("_r")).select("_r.*")


def effects(target: DataFrame, delta: DataFrame, key: str = "isn") -> DataFrame:
    """n_updated (changes with a matching row), n_inserted (the others)."""
    met = delta.select(key).join(target.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return met.agg(F.count("_hit").alias("n_updated"), (F.count("*") - F.count("_hit")).alias("n_inserted"))


#: What no keyed merge may plan.
UNKEYED = ("CartesianProduct", "BroadcastNestedLoopJoin")


def apply_merge(table: ManifestTable, delta: DataFrame, how: str = "vectors", dedup: bool = False, guard_ts: bool = False, exact: bool = False, stage: bool = True) -> int:
    """Apply a batch; the new version. exact: only keys that the table has get into the vector, which takes a scan of its keys;
    others in it do no harm."""
    key = table.spec.key
    with staged(table, delta, stage) as delta:
        delta = compacted(delta, table.spec, dedup)
        if guard_ts:
            delta = guarded(delta, table.read(), table.spec)
        if how == "vectors":
            return table.delete_and_append(delta, delta.select(key).join(table.read().select(key), key, "left_semi") if exact else None)
        if how == "copy":
            m, months = table.manifest(), month_ranges(delta, key)
            # only entries that can hold one of the keys are looked at
            hit = table.read(ranges=list(months.values())).join(delta.select(key), key, "left_semi").select(part_of().alias("p"))
            parts = sorted({*months, *(r.p for r in hit.distinct().collect())})
            rows = merged(table.read(parts), delta, key)
            expect_nodes(rows, without=UNKEYED)
            return table.swap(table.write_data(rows, m["version"] + 1), drop=parts)
    raise ValueError(how)


def current(table: ManifestTable, parts: list[int] | None = None) -> DataFrame:
    return live(table.read(parts))
