"""Swap: rebuild the month partitions that a batch touches and exchange them in one version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import part_of
from .changes import compacted, guarded, month_ranges, staged
from .store import ManifestTable


def touched(delta: DataFrame) -> DataFrame:
    """part: the months of a batch, in order."""
    return delta.select(part_of().alias("part")).distinct().orderBy("part")


def key_range(table: ManifestTable, delta: DataFrame, parts: list[int]) -> DataFrame:
    """first_isn, last_isn of the touched partitions and the batch together."""
    key = table.spec.key
    both = table.read(parts).select(key).unionByName(delta.select(key))
    return both.agg(F.min(key).alias("first_isn"), F.max(key).alias("last_isn"))


def rebuild(base: DataFrame, delta: DataFrame, key: str = "isn") -> DataFrame:
    """Partitions' new rows: what is there and doesn't change, and the batch's images without deletes."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta.where("op_code <> 'D'").select(*base.columns))


def moved(table: ManifestTable, delta: DataFrame, months: dict[int, tuple]) -> list[int]:
    """Months that the batch doesn't name but that hold one of its keys: a change moved the row. Where keys grow with the months
    no other month can hold one, and nothing is read."""
    others = [p for p in table.parts() if p not in months]
    hit = table.read(others, ranges=list(months.values())).select(table.spec.key, part_of().alias("p")).join(delta.select(table.spec.key), table.spec.key, "left_semi")
    return sorted(r.p for r in hit.select("p").distinct().collect())


def apply_swap(table: ManifestTable, delta: DataFrame, dedup: bool = False, guard_ts: bool = False, stage: bool = True) -> list[int]:
    """Apply a batch; the months that were exchanged. Deletes remove rows; a delete of an unknown key does nothing; a row whose month
    changes leaves the old one, which is rebuilt too."""
    with staged(table, delta, stage) as delta:
        delta = compacted(delta, table.spec, dedup)
        months = month_ranges(delta, table.spec.key)
        parts = sorted([*months, *moved(table, delta, months)]) if months else []
        if guard_ts:
            delta = guarded(delta, table.read(parts), table.spec)
        if parts:
            m = table.manifest()
            table.swap(table.write_data(rebuild(table.read(parts), delta, table.spec.key), m["version"] + 1), drop=parts)
        return parts


def current(table: ManifestTable, parts: list[int] | None = None) -> DataFrame:
    return table.read(parts)
