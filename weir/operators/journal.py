"""Upsert by an append-only journal: every version of a row is kept, the newest one a key is the current row.

Beside the journal, in the same manifest, there is a list of runs that hold every key's newest version. A load adds its files to both
lists in one version and writes them once; a batch of a stream carries its number there, so that it counts once; refresh() replaces the runs by one of newest versions, after which the current view reads far less than the history. Ties of
change_ts go to the larger batch, then to a hash of the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.spec import TableSpec
from .store import ManifestTable


def newest(df: DataFrame, key: str | list[str] = "isn", k: int = 1, order: list[Column] | None = None) -> DataFrame:
    """The k newest versions of each key. Catalyst limits groups before and after the shuffle."""
    keys = [key] if isinstance(key, str) else key
    order = order or [F.col("change_ts").desc(), F.col("batch_id").desc(), F.xxhash64(*df.columns).desc()]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def live(df: DataFrame) -> DataFrame:
    """Without tombstones."""
    return df.where("op_code <> 'D'")


class JournalTable:
    def __init__(self, spark: SparkSession, path: str, spec: TableSpec):
        self.spec = spec
        self.journal = ManifestTable(spark, f"{path}/journal", spec)

    def create(self, base: DataFrame | None = None) -> JournalTable:
        self.journal.create(base)
        return self

    def _manifest(self) -> dict:
        m = self.journal.manifest()
        return {"runs": {p: list(es) for p, es in m["parts"].items()}, "streams": {}} | m

    def append(self, delta: DataFrame, check: Callable[[], object] | None = None, batch: tuple[str, int] | None = None) -> bool:
        """Insert, update and delete alike: versions are added. check: called when they are written, before they are published.
        batch: a stream and the number of its batch; one that is there already changes nothing (False)."""
        m = self._manifest()
        if batch and m["streams"].get(batch[0], -1) >= batch[1]:
            return False
        written = self.journal.write_data(delta, m["version"] + 1)
        if check:
            check()
        for p, es in written.items():
            m["parts"].setdefault(p, []).extend(es)
            m["runs"].setdefault(p, []).extend(es)
        if batch:
            m["streams"][batch[0]] = batch[1]
        self.journal.publish(m)
        return True

    def versions(self, k: int = 1, parts: list[int] | None = None) -> DataFrame:
        """The k newest versions a key, tombstones included; for k = 1 from the kept runs."""
        return newest(self.journal.read(parts, which="runs" if k == 1 else "parts"), self.spec.key, k)

    def current(self, parts: list[int] | None = None) -> DataFrame:
        return live(self.versions(1, parts))

    def history(self, *keys: int) -> DataFrame:
        """All versions of some keys, or of all if none is named, oldest first."""
        rows = self.journal.read(ranges=[(k, k) for k in keys] or None)
        return (rows.where(F.col(self.spec.key).isin(*keys)) if keys else rows).orderBy(self.spec.key, "change_ts", "batch_id")

    def refresh(self) -> None:
        """Build the newest versions anew from the journal."""
        m = self._manifest()
        m["runs"] = self.journal.write_data(newest(self.journal.read(), self.spec.key), m["version"] + 1)
        self.journal.publish(m)

    def compact(self) -> None:
        """Forget the history: keep the newest version a key, tombstones included, in one run that is journal and newest versions."""
        m = self._manifest()
        m["parts"] = m["runs"] = self.journal.write_data(self.versions(), m["version"] + 1)
        self.journal.publish(m)

    def maintain(self, runs: int = 64) -> bool:
        """Refresh if a month's newest versions lie in more runs than that, so that current reads stay cheap however many batches come."""
        if max(map(len, self._manifest()["runs"].values()), default=0) <= runs:
            return False
        self.refresh()
        return True

    def clone(self, path: str) -> JournalTable:
        self.journal.clone(f"{path}/journal")
        return JournalTable(self.journal.spark, path, self.spec)
