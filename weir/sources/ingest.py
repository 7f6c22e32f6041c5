"""Loads: JSON change records in three shapes, CSV, and what a load rejects.

Every load is one pass over the files with an explicit nested schema; Spark splits JSON Lines inside files. A record is rejected
whole if it can't be parsed or cast, lacks an envelope column, has an unknown operation or a text that is too long for its column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spec import ENVELOPE, HEADER_TYPE, OPS, TableSpec, text_limit

CORRUPT = "_corrupt_record"


class LoadError(Exception):
    """A load had rejects or another number of rows than expected."""


@dataclass
class Load:
    """good: flat rows; rejects: reason and record; both are views of one checked parse (_why: null if a row is good)."""

    good: DataFrame
    rejects: DataFrame
    checked: DataFrame

    def counts(self) -> tuple[int, int]:
        """The numbers of good rows and of rejects, in one pass."""
        return tuple(self.checked.agg(F.count_if(F.col("_why").isNull()), F.count_if(F.col("_why").isNotNull())).first())

    def check(self, expected: int | None = None) -> int:
        """The number of good rows; raises if a record was rejected or the number is not the expected one."""
        return _expect(*self.counts(), expected)

    def counted(self, expected: int | None = None) -> tuple[DataFrame, Callable[[], int]]:
        """The good rows, and a check as above that is valid after those rows were written: both counts are taken on the way."""
        seen = Observation()
        rows = self.checked.observe(seen, F.count_if(F.col("_why").isNull()).alias("good"), F.count_if(F.col("_why").isNotNull()).alias("bad"))
        return rows.where("_why is null").select(*self.good.columns), lambda: _expect(seen.get["good"], seen.get["bad"], expected)


def _expect(rows: int, bad: int, expected: int | None) -> int:
    if bad or (expected is not None and rows != expected):
        raise LoadError(f"{rows} rows" + f", {expected} expected" * (expected is not None) + f", {bad} rejected")
    return rows


def _json(spark: SparkSession, path: str | list[str], fields: list[T.StructField]) -> DataFrame:
    schema = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").json(path)


def reason(spec: TableSpec, columns: dict[str, Column] | None = None) -> Column:
    """Why a flat row is rejected; null if it isn't."""
    of = lambda c: columns[c] if columns else F.col(c)
    tests = [(of(c).isNull(), f"{c} is null") for c, _ in ENVELOPE]
    tests.append((~of("op_code").isin(*OPS), "op_code is unknown"))
    tests += [(F.length(of(c)) > n, f"{c} is too long") for c, t in spec.types.items() if (n := text_limit(t))]
    # the first of a list, not a chain of conditions: the optimizer would turn a filter on the chain inside out
    return F.get(F.filter(F.array(*[F.when(test, F.lit(why)) for test, why in tests]), lambda why: why.isNotNull()), F.lit(0))


def _split(flat: DataFrame, spec: TableSpec, record: Column) -> Load:
    why = F.when(F.col("_bad").isNotNull(), F.lit("not a record of this shape")).otherwise(reason(spec))
    checked = flat.withColumn("_why", why)
    return Load(checked.where("_why is null").select(*spec.columns), checked.where("_why is not null").select(F.col("_why").alias("reason"), F.coalesce("_bad", record).alias("record")), checked)


def read_records(spark: SparkSession, path: str | list[str], spec: TableSpec) -> Load:
    """One table: lines {"hdr": {...}, "rec": {...}}."""
    raw = _json(spark, path, [T.StructField("hdr", HEADER_TYPE), T.StructField("rec", spec.record_type())])
    flat = raw.select(*spec.projection(F.col("hdr"), F.col("rec")), F.col(CORRUPT).alias("_bad"), F.col("hdr").alias("_h"), F.col("rec").alias("_r"))
    return _split(flat, spec, F.to_json(F.struct(F.col("_h").alias("hdr"), F.col("_r").alias("rec"))))


def mixed_fields(specs: dict[str, TableSpec]) -> list[T.StructField]:
    header = T.StructType([T.StructField("file", T.StringType()), *HEADER_TYPE.fields])
    return [T.StructField("hdr", header), *(T.StructField(n, s.record_type()) for n, s in specs.items())]


def document_fields(specs: dict[str, TableSpec]) -> list[T.StructField]:
    item = lambda s: T.ArrayType(T.StructType([T.StructField("hdr", HEADER_TYPE), T.StructField("rec", s.record_type())]))
    return [T.StructField("et_id", T.LongType()), T.StructField("et_ts", T.TimestampNTZType()), *(T.StructField(n, item(s)) for n, s in specs.items())]


def parse_mixed(spark: SparkSession, path: str | list[str], specs: dict[str, TableSpec]) -> DataFrame:
    """Records of many tables in one file: hdr (with `file`), a struct for each table, _corrupt_record."""
    return _json(spark, path, mixed_fields(specs))


def parse_documents(spark: SparkSession, path: str | list[str], specs: dict[str, TableSpec]) -> DataFrame:
    """One line a transaction: et_id, et_ts, an array of records for each table, _corrupt_record."""
    return _json(spark, path, document_fields(specs))


def mixed_source(parsed: DataFrame, spec: TableSpec) -> Load:
    """One table's rows of parsed mixed records."""
    own = parsed.where(F.col(CORRUPT).isNull() & (F.col("hdr.file") == spec.name))
    flat = own.select(*spec.projection(F.col("hdr"), F.col(spec.name)), F.lit(None).cast("string").alias("_bad"), F.col("hdr").alias("_h"), F.col(spec.name).alias("_r"))
    return _split(flat, spec, F.to_json(F.struct(F.col("_h").alias("hdr"), F.col("_r").alias(spec.name))))


def mixed_rejects(parsed: DataFrame, specs: dict[str, TableSpec]) -> DataFrame:
    """Lines that no table takes: unparsable ones and those with an unknown `file`."""
    unknown = F.col("hdr.file").isNull() | ~F.col("hdr.file").isin(*specs)
    bad = parsed.where(F.col(CORRUPT).isNotNull() | unknown)
    return bad.select(F.when(F.col(CORRUPT).isNotNull(), F.lit("not a record of this shape")).otherwise(F.lit("file is unknown")).alias("reason"), F.coalesce(F.col(CORRUPT), F.to_json("hdr")).alias("record"))


def document_source(parsed: DataFrame, spec: TableSpec, max_occurs: int | None = None) -> Load:
    """One table's rows of parsed documents; with max_occurs only that many records of a document, as fixed slots would hold."""
    items = F.col(spec.name) if max_occurs is None else F.slice(spec.name, 1, max_occurs)
    own = parsed.where(F.col(CORRUPT).isNull()).select("et_id", F.explode(items).alias("_i"))
    flat = own.select(*spec.projection(F.col("_i.hdr"), F.col("_i.rec")), F.lit(None).cast("string").alias("_bad"), F.col("_i").alias("_r"))
    return _split(flat.where("isn is not null or _r is not null"), spec, F.to_json("_r"))


def reject_counts(parsed: DataFrame, specs: dict[str, TableSpec], documents: bool) -> dict[str | None, int]:
    """Rejects by table, None for lines that no table takes, in one pass over the parsed batch. Tables without rejects aren't named."""

    def bad(spec: TableSpec, header: Column, record: Column) -> Column:
        return reason(spec, dict(zip(spec.columns, spec.projection(header, record)))).isNotNull()

    def bad_items(spec: TableSpec) -> Column:
        return F.greatest(F.lit(0), F.size(F.filter(spec.name, lambda i: i.isNotNull() & bad(spec, i["hdr"], i["rec"]))))

    whole = F.col(CORRUPT).isNull()
    if documents:
        each = {n: F.sum(F.when(whole, bad_items(s))) for n, s in specs.items()}
        none = F.count_if(~whole)
    else:
        each = {n: F.count_if(whole & (F.col("hdr.file") == n) & bad(s, F.col("hdr"), F.col(n))) for n, s in specs.items()}
        none = F.count_if(~whole | F.col("hdr.file").isNull() | ~F.col("hdr.file").isin(*specs))
    # names by number: a table may be called as anything
    row = parsed.agg(none.alias("n"), *[c.alias(f"n{k}") for k, c in enumerate(each.values())]).first()
    return {t: n for t, n in zip((None, *each), row) if n}


def overflow(parsed: DataFrame, specs: dict[str, TableSpec], max_occurs: int) -> DataFrame:
    """Documents that hold more than max_occurs records of a table: et_id, table, records."""
    sizes = F.array(*[F.struct(F.lit(n).alias("table"), F.size(n).alias("records")) for n in specs])
    return parsed.select("et_id", F.explode(sizes).alias("s")).select("et_id", "s.table", "s.records").where(F.col("records") > max_occurs)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, delimiter: str = ",") -> DataFrame:
    """Delimited text; the first line that doesn't fit ends the load."""
    return spark.read.schema(schema).option("sep", delimiter).option("mode", "FAILFAST").csv(path)


def variant_items(spark: SparkSession, path: str, array: str) -> DataFrame:
    """Arrays of any length without a schema: each element of the array at a dotted path, with its place, as a variant."""
    raw = spark.read.option("singleVariantColumn", "v").json(path)
    return _variant_items(raw, array)


def _variant_items(raw: DataFrame, array: str) -> DataFrame:
    raw.createOrReplaceTempView("_weir_variant")
    return raw.sparkSession.sql(f"SELECT v, e.pos, e.value AS item FROM _weir_variant, LATERAL variant_explode(try_variant_get(v, '$.{array}', 'variant')) AS e")
