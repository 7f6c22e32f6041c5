"""Tables as manifests: which files each month partition has, and which keys are deleted from older files.

A version of a table is one small JSON file; data files are never changed. Publishing writes the next version's file under another name
and renames it, which fails if that version is there: one writer wins, and readers see a version whole or not at all (a store whose
rename is a copy can leave a part of a file: readers pass over what can't be parsed, and the next version gets the number after it).
So a partition swap, a clone, a link or a drop costs a manifest, whatever the table's size, and readers prune partitions before a
scan is planned.

An entry is [path, sequence, first key, last key, rows]. The sequence is the version that wrote or linked it; a delete vector of
sequence n (a file of keys, often the new rows' own) hides its keys in entries of smaller numbers only, and only entries whose keys it
can meet are joined with it: a read of months that no vector concerns is a plain scan. Paths go through Hadoop's file systems: any store that Spark reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import part_of
from ..sources.spec import TableSpec


class Conflict(Exception):
    """Another writer published this version first."""


def meets(entry: list, ranges: list[tuple]) -> bool:
    """Whether keys of these ranges (first, last) can be in an entry; unknown ones can."""
    lo, hi = entry[2], entry[3]
    return lo is None or any(a is None or (lo <= b and a <= hi) for a, b in ranges)


class ManifestTable:
    def __init__(self, spark: SparkSession, path: str, spec: TableSpec):
        self.spark, self.path, self.spec = spark, path.rstrip("/"), spec
        self.schema = spec.flat_schema(strict=False)

    # files

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _file(self, version: int) -> str:
        return f"{self.path}/_manifest/v{version:010d}.json"

    def _versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/_manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _parsed(self, version: int) -> dict | None:
        fs, p = self._fs(self._file(version))
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            return None
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> dict:
        """version, parts (month: entries), deletes ([[path, sequence, first key, last key], ...]) and what else was published."""
        found = self._versions() if version is None else [version]
        for v in reversed(found):
            if (m := self._parsed(v)) is not None:
                return m | {"version": found[-1]}
        return {"version": found[-1] if found else 0, "parts": {}, "deletes": []}

    def exists(self) -> bool:
        return bool(self._versions())

    def _put(self, manifest: dict, version: int) -> None:
        """Create a version's file, whole or not at all; fails if it is there."""
        jvm, text = self.spark._jvm, json.dumps(manifest | {"version": version})
        fs, p = self._fs(f"{self.path}/_manifest/.{uuid.uuid4().hex}")
        out = fs.create(p, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        once = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        once[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        to = jvm.org.apache.hadoop.fs.Path(self._file(version))
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration()).rename(p, to, once)
        except Exception as e:
            fs.delete(p, False)
            raise Conflict(f"version {version} of {self.path} is there already") from e

    def publish(self, manifest: dict) -> int:
        """Make a manifest the next version."""
        self._put(manifest, manifest["version"] + 1)
        return manifest["version"] + 1

    # data

    def write_data(self, df: DataFrame, sequence: int) -> dict[str, list]:
        """Write rows, one sorted run a month partition and task; the new entries by month. Nothing is published."""
        root, key = f"{self.path}/data/{uuid.uuid4().hex}", self.spec.key
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).withColumn("_part", part_of())
        # a hint, not a fixed number: adaptive execution splits a large month over tasks and joins small ones
        rows.hint("rebalance", "_part").sortWithinPartitions("_part", key).write.partitionBy("_part").parquet(root)
        fs, p = self._fs(root)
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("_part="))
        if not names:
            return {}
        # a scan of the written keys; a row a month comes back
        written = self.spark.read.schema(f"`{key}` bigint, _part string").option("basePath", root).parquet(*[f"{root}/{n}" for n in names])
        facts = {r["_part"]: r for r in written.groupBy("_part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n"), F.count(key).alias("k")).collect()}
        out = {}
        for n in names:
            month = n.removeprefix("_part=")
            r = facts.get(month)
            lo, hi = (r["lo"], r["hi"]) if r and r["n"] == r["k"] else (None, None)
            out[month] = [[f"{root}/{n}", sequence, lo, hi, r["n"] if r else 0]]
        return out

    def _rows(self, entries: list, sequences: bool = False) -> DataFrame:
        """Rows of entries in one scan, with _seq if asked."""
        if not entries:
            df = self.spark.createDataFrame([], self.schema)
            return df.withColumn("_seq", F.lit(0).cast("long")) if sequences else df
        df = self.spark.read.schema(self.schema).parquet(*[e[0] for e in entries])
        if not sequences:
            return df
        if len({e[1] for e in entries}) == 1:
            return df.withColumn("_seq", F.lit(entries[0][1]).cast("long"))
        of = {"/".join(e[0].split("/")[-2:]): e[1] for e in entries}  # folder and month
        where = F.url_decode(F.regexp_extract("_metadata.file_path", r"([0-9a-f]{32}/_part=[^/]*)/[^/]*$", 1))
        return df.withColumn("_seq", F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), where).cast("long"))

    def read(self, parts: list[int] | None = None, version: int | None = None, which: str = "parts", ranges: list[tuple] | None = None) -> DataFrame:
        """All rows, or those of some months, less what delete vectors hide. which: the list of entries in the manifest; ranges: only
        entries that can hold keys of these ranges (first, last)."""
        m, key = self.manifest(version), self.spec.key
        wanted = set(map(str, parts)) if parts is not None else None
        entries = [e for p, es in m.get(which, m["parts"]).items() if wanted is None or p in wanted for e in es if ranges is None or meets(e, ranges)]
        met = [e for e in entries if any(d[1] > e[1] and meets(e, [(d[2], d[3])]) for d in m["deletes"])]
        if not met:
            return self._rows(entries)
        plain = [e for e in entries if e not in met]
        vectors = [d for d in m["deletes"] if any(d[1] > e[1] and meets(e, [(d[2], d[3])]) for e in met)]
        gone, by_seq = None, {}
        for path, seq, *_ in vectors:
            by_seq.setdefault(seq, []).append(path)
        for seq, paths in by_seq.items():
            d = self.spark.read.schema(f"`{key}` bigint").parquet(*paths).withColumn("_until", F.lit(seq).cast("long"))
            gone = d if gone is None else gone.unionByName(d)
        if len(by_seq) > 1:
            gone = gone.groupBy(key).agg(F.max("_until").alias("_until"))
        rows = self._rows(met, sequences=True)
        rows = rows.join(gone.withColumnRenamed(key, "_k"), (F.col(key) == F.col("_k")) & (F.col("_seq") < F.col("_until")), "left_anti").drop("_seq")
        return rows.unionByName(self._rows(plain)) if plain else rows

    def view(self, name: str, parts: list[int] | None = None) -> DataFrame:
        """The present rows as a view of that name; a later version needs a new view."""
        df = self.read(parts)
        df.createOrReplaceTempView(name)
        return df

    def like(self, path: str) -> ManifestTable:
        """An empty table of the same specification."""
        return ManifestTable(self.spark, path, self.spec).create()

    def parts(self) -> list[int]:
        return sorted(int(p) for p, es in self.manifest()["parts"].items() if es)

    # changes of a whole version

    def create(self, df: DataFrame | None = None, check: Callable[[], object] | None = None) -> ManifestTable:
        """An empty table, or one that holds df. check: called when df is written, before it is published."""
        if self.exists():
            raise Conflict(f"{self.path} is there already")
        parts = self.write_data(df, 1) if df is not None else {}
        if check:
            check()
        self.publish({"version": 0, "parts": parts, "deletes": []})
        return self

    def append(self, df: DataFrame) -> int:
        m = self.manifest()
        for p, es in self.write_data(df, m["version"] + 1).items():
            m["parts"].setdefault(p, []).extend(es)
        return self.publish(m)

    def delete_and_append(self, df: DataFrame, keys: DataFrame | None = None) -> int:
        """Hide keys in all that is there and append rows, in one version. Without keys those of the rows: their files are the vector."""
        m, key = self.manifest(), self.spec.key
        seq = m["version"] + 1
        if keys is not None:
            path = f"{self.path}/deletes/{uuid.uuid4().hex}"
            keys.select(F.col(key).cast("long")).write.parquet(path)
            lo, hi = self.spark.read.schema(f"`{key}` bigint").parquet(path).agg(F.min(key), F.max(key)).first()
            m["deletes"] += [[path, seq, lo, hi]] if lo is not None else []
        for p, es in self.write_data(df, seq).items():
            m["parts"].setdefault(p, []).extend(es)
            if keys is None:
                m["deletes"] += [e[:4] for e in es]
        return self.publish(m)

    def swap(self, stage: dict[str, list], drop: list[int] = ()) -> int:
        """Exchange whole partitions for staged ones (see write_data), all in one version."""
        m = self.manifest()
        for p in drop:
            m["parts"].pop(str(p), None)
        m["parts"] |= stage
        return self.publish(m)

    def link(self, source: ManifestTable, parts: list[int]) -> int:
        """Take over another table's partitions without copying data. They are new here: older delete vectors don't concern them."""
        m, other = self.manifest(), source.manifest()
        if other["deletes"]:
            raise ValueError("compact the source first: its delete vectors are about its own versions")
        for p in map(str, parts):
            if p in other["parts"]:
                m["parts"][p] = [[e[0], m["version"] + 1, *e[2:]] for e in other["parts"][p]]
        return self.publish(m)

    def drop(self, parts: list[int]) -> int:
        return self.swap({}, drop=list(parts))

    def clone(self, path: str) -> ManifestTable:
        """A table of its own that shares all files so far."""
        copy = ManifestTable(self.spark, path, self.spec)
        if copy.exists():
            raise Conflict(f"{path} is there already")
        m = self.manifest()
        copy._put(m, m["version"])
        return copy

    def compact(self) -> int:
        """Rewrite the partitions that delete vectors or many runs concern, then forget the vectors."""
        m = self.manifest()
        todo = [int(p) for p, es in m["parts"].items() if len(es) > 1 or any(d[1] > e[1] and meets(e, [(d[2], d[3])]) for d in m["deletes"] for e in es)]
        stage = self.write_data(self.read(todo), m["version"] + 1) if todo else {}
        m["parts"] = {p: es for p, es in m["parts"].items() if int(p) not in todo} | stage
        m["deletes"] = []
        return self.publish(m)

    def maintain(self, runs: int = 64, vectors: int = 32) -> bool:
        """Compact if a month has more runs or the table more vectors than that, so that reads stay cheap however many batches come."""
        m = self.manifest()
        if len({d[1] for d in m["deletes"]}) <= vectors and max(map(len, m["parts"].values()), default=0) <= runs:
            return False
        self.compact()
        return True

    def destroy(self) -> None:
        fs, p = self._fs(self.path)
        fs.delete(p, True)

    def storage(self) -> DataFrame:
        """part, files, bytes of the present version."""
        rows = []
        for p, es in sorted(self.manifest()["parts"].items()):
            files = size = 0
            for path, *_ in es:
                fs, hp = self._fs(path)
                for s in fs.listStatus(hp):
                    if s.getPath().getName().endswith(".parquet"):
                        files, size = files + 1, size + s.getLen()
            rows.append((int(p), files, size))
        return self.spark.createDataFrame(rows, "part int, files int, bytes long")

    def statistics(self) -> DataFrame:
        """part, runs, n_rows (before delete vectors), first_key, last_key of the present version, from the manifest alone."""
        rows = [(int(p), len(es), sum(e[4] for e in es), min((e[2] for e in es if e[2] is not None), default=None), max((e[3] for e in es if e[3] is not None), default=None)) for p, es in sorted(self.manifest()["parts"].items())]
        return self.spark.createDataFrame(rows, "part int, runs int, n_rows long, first_key long, last_key long")

    def count(self) -> int:
        """The number of rows: from the manifest, unless delete vectors hide some."""
        m = self.manifest()
        return self.read().count() if m["deletes"] else sum(e[4] for es in m["parts"].values() for e in es)
