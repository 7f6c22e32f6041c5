"""What the operators share: the shared folder, written tables, words, held-out folds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workdir import shared_root

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one only in local sessions that name none."""
    return shared_root(spark)


def forget(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that materialize wrote in this process (after the first `since`): for when results have been written."""
    while len(_WRITTEN) > since:
        p = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written() -> int:
    """How many tables materialize has written so far (see forget)."""
    return len(_WRITTEN)


def materialize(df: DataFrame, name: str, keep_shuffles: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: this cuts lineage, fixes values that a retry could change,
    and lets Spark drop the shuffle files behind it at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, str(not keep_shuffles).lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Long texts: few rows in an Arrow batch keep a Python worker's memory bounded."""
    spark.conf.set(BATCH, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def apart(docs: DataFrame, prefix: str = "_w_") -> tuple[DataFrame, dict[str, str]]:
    """docs whose columns don't begin with a prefix that operators use for their own, and the names to give back to a result."""
    taken, back = set(docs.columns), {}
    for c in docs.columns:
        if c.startswith(prefix):
            new = "w" + c
            while new in taken:
                new = "w" + new
            taken.add(new)
            back[new] = c
    return docs.withColumnsRenamed({old: new for new, old in back.items()}), back


def fold(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of


#: A longer text is cut into slices of whole words, so that a worker never holds all words of a huge text.
SLICE = 4 << 20


def word_slices(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, parted at space and 09-0D; a huge text comes in several lists."""
    if len(text) <= size:
        yield text.lower().split()
        return
    start = 0
    while start < len(text):
        end = min(len(text), start + size)
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[start:end].lower().split()
        start = end


def process_cache(key: tuple, make):
    """A value kept in a Python worker between tasks: workers are reused, and what they learnt stays valid."""
    import sys
    import types

    held = sys.modules.setdefault("_weir_process_cache", types.ModuleType("_weir_process_cache")).__dict__.setdefault("held", {})
    if key not in held:
        held[key] = make()
    return held[key]


class _Numbered(dict):
    """Gives each key that it hasn't met the next number, and lists those keys."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, word):
        self[word] = number = len(self)
        self.new.append(word)
        return number


class WordIds:
    """Ids of words that are encoded independently: each new word once, by learn(words) -> lists of ids. At most about `most`
    words are kept: memory is bounded, and the words are learnt anew after that."""

    def __init__(self, learn, most: int):
        import numpy as np

        self.learn, self.most, self.np = learn, most, np
        self._clear()

    def _clear(self) -> None:
        np = self.np
        self.known = _Numbered()
        self.ids, self.starts, self.n = np.zeros(0, np.uint32), np.zeros(1024, np.int32), 0

    def __call__(self, texts: list[list]) -> list:
        """An array of ids for each list of words."""
        from itertools import chain

        np = self.np
        if len(self.known) > self.most:
            self._clear()
        sizes = [len(words) for words in texts]
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.int32, sum(sizes))
        if new := self.known.new:
            try:
                found = self.learn(new)
            except BaseException:
                self._clear()
                raise
            self.known.new = []
            last = int(self.starts[self.n])
            ends = np.cumsum(np.fromiter(map(len, found), np.int32, len(found)), dtype=np.int32) + last
            n = int(ends[-1])
            if n > len(self.ids):
                self.ids = np.concatenate([self.ids[:last], np.zeros(max(n - last, len(self.ids)), np.uint32)])
            self.ids[last:n] = np.fromiter(chain.from_iterable(found), np.uint32, n - last)
            if self.n + len(ends) >= len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros(len(self.starts) + len(ends), np.int32)])
            self.starts[self.n + 1 : self.n + 1 + len(ends)] = ends
            self.n += len(ends)
        start = self.starts[at]
        size = self.starts[at + 1] - start
        ends = np.cumsum(size, dtype=np.int64)
        flat = self.ids[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])].tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]
