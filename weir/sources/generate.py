"""Deterministic test data: base tables, change streams, JSON in three shapes. Every value depends on the key alone."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import coprime_stride, hashed, pick, split_mix
from .spec import TableSpec, spark_type

# What generators pick from
FIRST = "Anouk;Bram;Chiara;Dmitri;Elif;Farid;Greta;Hugo;Ines".split(";")
LAST = "Abbot;Bergman;Castro;Dvorak;Eriksen;Fontaine;Grillo".split(";")
CITY = "OSLO;PORTO;LYON;GRAZ;TURIN;CORK;UTRECHT;GDANSK;BASEL;MALMO".split(";")
COUNTRY = "NO;PT;FR;AT;IT;IE;NL;PL;CH;SE".split(";")
SUFFIX = "LANE;ROW;COURT;WAY;GREEN".split(";")
DOMAIN = "post.example;letters.example;works.example".split(";")
START, SPAN_DAYS, HOT_PERCENT = "2023-01-01", 1096, 5
#: Fixed value: records of a table in a document, by (document + table) modulo 4.
PER_DOCUMENT = (0, 1, 1, 2)


def value(field, seed: int, rows: dict[str, int], how: str = "xxhash64") -> Column:
    """The column of one field for the key `isn`."""
    kind, *args = field.generator.partition("?")[0].split(":")
    h = lambda n, s=0: hashed("isn", seed + s, n, how)
    of = lambda values, s=0: pick("isn", seed + s, values, how)
    lists = {"first": FIRST, "last": LAST, "city": CITY, "country": COUNTRY}
    if kind in lists:
        return of(lists[kind])
    if kind == "pick":
        return of(args[0].split(";"))
    if kind == "street":
        return F.concat_ws(" ", 1 + h(250), of(LAST, 1), of(SUFFIX, 2))
    if kind == "phone":
        return F.concat(F.lit("+"), 1 + h(98), F.lit("-"), F.lpad(h(1000, 1), 3, "0"), F.lit("-"), F.lpad(h(10000000, 2), 7, "0"))
    if kind == "email":
        return F.concat(F.lower(of(FIRST)), F.lit("."), F.col("isn"), F.lit("@"), of(DOMAIN, 1))
    if kind == "code":
        return F.left(F.upper(F.md5(F.concat_ws("-", "isn", F.lit(seed)).cast("binary"))), F.lit(int(args[0])))
    if kind == "bool":
        return h(100) < 3
    if kind == "int":
        a, b = int(args[0]), int(args[1])
        return (a + h(b - a + 1)).cast("int")
    if kind == "num":
        a, b = int(args[0]), int(args[1])
        return ((a * 100 + h((b - a) * 100 + 1)).cast("decimal(20,2)") / 100).cast(spark_type(field.type))
    if kind == "date":
        return F.date_add(F.to_date(F.lit(args[0])), h(int(args[1])).cast("int"))
    if kind == "id":
        return F.concat(F.lit(args[0]), F.lpad(F.col("isn").cast("string"), int(args[1]), "0"))
    if kind == "ref":
        return 1 + h(rows[args[0]])
    raise ValueError(f"unknown generator {field.generator}")


def fields_of(spec: TableSpec, rows: dict[str, int], how: str = "xxhash64") -> list[Column]:
    """All generated columns; optional fields of one container share the draw that decides whether they are absent."""
    containers: dict[str, int] = {}
    out = []
    for k, f in enumerate(spec.fields):
        v = value(f, 104 + 4 * k, rows, how)
        if f.percent_null:
            n = containers.setdefault(f.container, len(containers) + 1)
            v = F.when(hashed("isn", 5000 + n, 100, how) >= f.percent_null, v)
        out.append(v.cast(spark_type(f.type)).alias(f.column))
    return out


def base(spark: SparkSession, spec: TableSpec, n: int, rows: dict[str, int] | None = None, how: str = "xxhash64", start: str = START, span_days: int = SPAN_DAYS) -> DataFrame:
    """n base rows: keys 1 to n, created evenly over span_days from start."""
    keys = spark.range(1, n + 1).select(F.col("id").alias("isn"))
    keys = keys.withColumn("created_date", F.date_add(F.to_date(F.lit(start)), F.expr(f"cast((isn - 1) * {span_days} div {n} as int)")))
    seconds = hashed("isn", 1, 86400, how).cast("int")
    ts = F.col("created_date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return keys.select("isn", F.lit("I").alias("op_code"), ts.alias("change_ts"), F.lit(0).alias("batch_id"), "created_date", *fields_of(spec, rows or {spec.name: n} | {t: n for t in ("customer", "account", "card", "policy", "employees")}, how))


def hot_window(base_rows: int, hot_percent: int = HOT_PERCENT) -> tuple[int, int, int]:
    """First key, size and stride of the newest keys, which change."""
    size = max(1, base_rows * hot_percent // 100)
    return base_rows - size + 1, size, coprime_stride(size)


def changes(spark: SparkSession, spec: TableSpec, n: int, base_rows: int, mix: str = "50:0:50", rows: dict[str, int] | None = None, how: str = "xxhash64", start: str = START, span_days: int = SPAN_DAYS, hot_percent: int = HOT_PERCENT, order: str | None = None) -> DataFrame:
    """n changes, one a key at most: updates and deletes among the newest keys, inserts with new keys on the day after the base period.
    order: a column for the place of each change, from 0."""
    n_upd, n_del, _ = split_mix(n, mix)
    lo, size, stride = hot_window(base_rows, hot_percent)
    if n_upd + n_del > size:
        raise ValueError(f"{n_upd + n_del} updates and deletes do not fit {size} keys")
    k = spark.range(n).withColumnRenamed("id", "k")
    isn = F.when(F.col("k") < n_upd + n_del, lo + F.pmod(F.col("k") * stride, F.lit(size))).otherwise(base_rows + F.col("k") - (n_upd + n_del) + 1)
    op = F.when(F.col("k") < n_upd, "U").when(F.col("k") < n_upd + n_del, "D").otherwise("I")
    d = k.select("k", isn.alias("isn"), op.alias("op_code"))
    day = F.to_date(F.lit(start))
    created = F.when(F.col("isn") <= base_rows, F.date_add(day, F.expr(f"cast((isn - 1) * {span_days} div {base_rows} as int)"))).otherwise(F.date_add(day, span_days))
    ts = F.date_add(day, span_days).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("k") / F.lit(1000000)).cast("decimal(18,6)"))
    d = d.withColumn("created_date", created).withColumn("change_ts", ts)
    return d.select(*([F.col("k").alias(order)] if order else []), "isn", "op_code", "change_ts", F.lit(1).alias("batch_id"), "created_date", *fields_of(spec, rows or {spec.name: base_rows} | {t: base_rows for t in ("customer", "account", "card", "policy", "employees")}, how))


def numbers(spark: SparkSession, n: int = 1_000_000) -> DataFrame:
    """n: 0 to n - 1."""
    return spark.range(n).withColumnRenamed("id", "n")


def numbers_by_gap_filling(spark: SparkSession, n: int = 1_000_000) -> DataFrame:
    """The same from two timestamps whose gap is filled second by second."""
    ends = spark.sql(f"SELECT timestamp_ntz'2000-01-01 00:00:00' AS a, timestamp_ntz'2000-01-01 00:00:00' + make_dt_interval(0, 0, 0, {n - 1}) AS z")
    filled = ends.select("a", F.explode(F.expr("sequence(a, z, interval 1 second)")).alias("t"))
    return filled.select(F.expr("timestampdiff(SECOND, a, t)").alias("n"))


# JSON sinks

def _ts(c: str = "change_ts") -> Column:
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _json_struct(spec: TableSpec) -> tuple[Column, Column]:
    return spec.nested({"change_ts": _ts()})


def record_lines(df: DataFrame, spec: TableSpec) -> DataFrame:
    """value: {"hdr", "rec"} lines of one table."""
    hdr, rec = _json_struct(spec)
    return df.select(F.to_json(F.struct(hdr.alias("hdr"), rec.alias("rec")), {"ignoreNullFields": "false"}).alias("value"))


def mixed_lines(tables: dict[str, DataFrame], specs: dict[str, TableSpec]) -> DataFrame:
    """value: lines of many tables, each {"hdr" with file, "<table>"}."""
    out = None
    for name, df in tables.items():
        hdr, rec = _json_struct(specs[name])
        lines = df.select(F.to_json(F.struct(F.struct(F.lit(name).alias("file"), *[hdr.getField(k).alias(k) for k in ("isn", "op", "ts", "batch")]).alias("hdr"), rec.alias(name)), {"ignoreNullFields": "false"}).alias("value"))
        out = lines if out is None else out.unionByName(lines)
    return out


def document_lines(tables: dict[str, DataFrame], specs: dict[str, TableSpec], doc: dict[str, Column]) -> DataFrame:
    """value: one line a document, with an array of records a table. doc: the document number of each table's rows."""
    joined = None
    for name, df in tables.items():
        hdr, rec = _json_struct(specs[name])
        item = F.to_json(F.struct(hdr.alias("hdr"), rec.alias("rec")), {"ignoreNullFields": "false"})
        rows = df.select(doc[name].alias("et_id"), F.lit(name).alias("t"), F.struct(F.col("isn"), item.alias("j")).alias("i"), F.col("change_ts").alias("ts"))
        joined = rows if joined is None else joined.unionByName(rows)
    grouped = joined.groupBy("et_id").agg(F.max("ts").alias("ts"), *[F.sort_array(F.collect_list(F.when(F.col("t") == n, F.col("i")))).alias(n) for n in tables])
    arrays = [F.concat(F.lit(f',"{n}":['), F.array_join(F.transform(n, lambda i: i["j"]), ","), F.lit("]")) for n in tables]
    return grouped.select(F.concat(F.lit('{"et_id":'), F.col("et_id"), F.lit(',"et_ts":"'), _ts("ts"), F.lit('"'), *arrays, F.lit("}")).alias("value"))


def document_number(k: Column, table: int) -> Column:
    """The document of a table's k-th change (from 0): documents d hold PER_DOCUMENT[(d + table) % 4] of its records."""
    cycle = [d for d in range(4) for _ in range(PER_DOCUMENT[(d + table) % 4])]
    return F.floor(k / 4).cast("long") * 4 + F.element_at(F.array(*[F.lit(d) for d in cycle]), (F.pmod(k, F.lit(4)) + 1).cast("int"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.text(path)


def write_manifest(spark: SparkSession, path: str, **facts) -> None:
    """What was generated, as one JSON line."""
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
