"""The queries of the engine's operators, each through the engine's own code, and the same in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import report
from .functions import scalars as S
from .operators import merge, swap, validate
from .operators.fanout import FanOut
from .operators.journal import JournalTable, live, newest
from .operators.store import ManifestTable
from .plans.plans import partition_plan
from .sources import generate, ingest
from .sources.spec import TableSpec, catalog, parse_spec
from .streaming.upsert import run_upsert
from .workdir import work_path

SPEC_TEXT = """
T|ord|1|Orders|fact
F|ord|acct_isn|acct_isn|BIGINT
F|ord|amount|amount|NUMERIC(15,2)
F|ord|merchant.city|city|VARCHAR(10)
F|ord|tag.0|tag_1|VARCHAR(20)
T|cust|2|Customers
F|cust|name.full|full_name|VARCHAR(40)
F|cust|balance|balance|NUMERIC(15,2)
T|supp|3|Suppliers
F|supp|name.full|full_name|VARCHAR(40)
F|supp|balance|balance|NUMERIC(15,2)
T|msg|4|Messages
F|msg|conv|conv_id|BIGINT
F|msg|role|role|VARCHAR(20)
F|msg|text|text|VARCHAR(10000000)
"""
SPECS = parse_spec(SPEC_TEXT)
ORD = SPECS["ord"]
THREE = {n: SPECS[n] for n in ("ord", "cust", "supp")}
OUT = ORD.columns


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# The derived change set over orders

BATCH_START = "timestamp_ntz'2001-09-01 00:00:00'"


def _ord(spark: SparkSession, sf: str, op: str, ts: str, batch: int, amount: str, null_tag: int) -> DataFrame:
    return _table(spark, sf, "orders").selectExpr(
        "cast(o_orderkey as bigint) as isn", f"{op} as op_code", f"cast({ts} as timestamp_ntz) as change_ts", f"{batch} as batch_id", "cast(o_orderdate as date) as created_date",
        "cast(o_custkey as bigint) as acct_isn", f"cast({amount} as decimal(15,2)) as amount", "o_orderstatus as city", f"if(o_orderkey % {null_tag} = 0, null, o_orderpriority) as tag_1",
    )


def base(spark: SparkSession, sf: str) -> DataFrame:
    return _ord(spark, sf, "'I'", "o_orderdate", 0, "o_totalprice", 3).where("isn % 10 <> 9")


def derived(spark: SparkSession, sf: str) -> DataFrame:
    op = "case o_orderkey % 10 when 0 then 'U' when 1 then 'D' else 'I' end"
    df = _ord(spark, sf, op, f"{BATCH_START} + make_dt_interval(0, 0, 0, cast(o_orderkey / 1000000 as decimal(18,6)))", 1, "o_totalprice + 100", 4)
    return df.where("isn % 10 = 9 or (isn % 10 in (0, 1) and created_date >= date'2001-01-01')")


def _load(spark: SparkSession, df: DataFrame, spec: TableSpec = ORD) -> ingest.Load:
    path = work_path(spark, "json")
    generate.write_lines(generate.record_lines(df, spec), path)
    return ingest.read_records(spark, path, spec)


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """The derived changes after a round through JSON."""
    return _load(spark, derived(spark, sf)).good


def _journal(spark: SparkSession, sf: str) -> JournalTable:
    t = JournalTable(spark, work_path(spark, "journal"), ORD).create(base(spark, sf))
    t.append(changes(spark, sf))
    return t


def _keyed(spark: SparkSession, sf: str) -> ManifestTable:
    return ManifestTable(spark, work_path(spark, "table"), ORD).create(base(spark, sf))


def cdc_json_flatten(spark, sf):
    return changes(spark, sf)


def cdc_json_rejects(spark, sf):
    lines = generate.record_lines(derived(spark, sf), ORD).withColumn("isn", F.get_json_object("value", "$.hdr.isn").cast("long"))
    broken = F.when(F.col("isn") % 50 == 9, F.expr("substring(value, 1, length(value) - 5)")).when(F.col("isn") % 50 == 19, F.regexp_replace("value", '"amount":[^,]*', '"amount":"x"'))
    broken = broken.when(F.col("isn") % 50 == 29, F.regexp_replace("value", '"op":"."', '"op":"UPD"')).when(F.col("isn") % 50 == 39, F.regexp_replace("value", '"isn":[0-9]+', '"isn":null'))
    path = work_path(spark, "json")
    generate.write_lines(lines.select(F.coalesce(broken, "value").alias("value")), path)
    got = ingest.read_records(spark, path, ORD)
    return got.rejects.groupBy("reason").agg(F.count("*").alias("n")).unionByName(got.good.agg(F.lit("good").alias("reason"), F.count("*").alias("n")))


def json_events_props(spark, sf):
    e = _table(spark, sf, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("sum_k"), F.count("p.k").alias("n"))


def csv_load(spark, sf):
    path = work_path(spark, "csv")
    _table(spark, sf, "region").select("r_regionkey", "r_name").write.csv(path)
    return ingest.read_csv(spark, path, "r_regionkey int, r_name string")


def journal_history(spark, sf):
    return _journal(spark, sf).history().select(*OUT)


def upsert_current(spark, sf):
    return _journal(spark, sf).current().select(*OUT)


def journal_compact(spark, sf):
    t = _journal(spark, sf)
    t.compact()
    return live(t.journal.read()).select(*OUT)


def stream_upsert(spark, sf):
    """The changes as files that a stream picks up."""
    path = work_path(spark, "json")
    generate.write_lines(generate.record_lines(derived(spark, sf), ORD), path)
    t = JournalTable(spark, work_path(spark, "journal"), ORD).create(base(spark, sf))
    run_upsert(spark, path, t, work_path(spark, "stream")).awaitTermination()
    return t.current().select(*OUT)


def topk_events_latest(spark, sf):
    e = _table(spark, sf, "events")
    return newest(e, "user_id", 1, [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "ts", "event_type")


def topk_k3(spark, sf):
    e = _table(spark, sf, "events")
    return newest(e, "user_id", 3, [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "ts", "event_type")


LINE = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def dedup_batch(spark, sf):
    l = _table(spark, sf, "lineitem")
    return newest(l, ["l_orderkey", "l_linenumber"], 1, [F.col(c).desc() for c in LINE]).select("l_orderkey", "l_linenumber", *LINE)


def swap_touched(spark, sf):
    return swap.touched(changes(spark, sf))


def swap_isn_range(spark, sf):
    c = changes(spark, sf)
    return swap.key_range(_keyed(spark, sf), c, [r.part for r in swap.touched(c).collect()])


def swap_rebuild(spark, sf):
    t, c = _keyed(spark, sf), changes(spark, sf)
    parts = [r.part for r in swap.touched(c).collect()]
    return swap.rebuild(t.read(parts), c).groupBy(S.part_of().alias("part")).agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def swap_current(spark, sf):
    t = _keyed(spark, sf)
    swap.apply_swap(t, changes(spark, sf))
    return swap.current(t).select(*OUT)


def swap_gap_partitions(spark, sf):
    t = _keyed(spark, sf)
    c = _load(spark, derived(spark, sf).where(S.part_of().isin(200101, 200107))).good
    swap.apply_swap(t, c)
    return swap.current(t).select(*OUT)


def _merged(spark, sf, how: str) -> ManifestTable:
    t = _keyed(spark, sf)
    merge.apply_merge(t, changes(spark, sf), how)
    return t


def merge_current(spark, sf):
    return merge.current(_merged(spark, sf, "copy")).select(*OUT)


def merge_mor_read(spark, sf):
    return merge.current(_merged(spark, sf, "vectors")).select(*OUT)


def merge_with_tombstones(spark, sf):
    return _merged(spark, sf, "vectors").read().select(*OUT)


def merge_compacted(spark, sf):
    t = _merged(spark, sf, "vectors")
    t.compact()
    return merge.current(t).select(*OUT)


def merge_updates_vs_inserts(spark, sf):
    return merge.effects(base(spark, sf), changes(spark, sf))


def merge_delete_vectors(spark, sf):
    t = _keyed(spark, sf)
    merge.apply_merge(t, changes(spark, sf), exact=True)
    paths = [d[0] for d in t.manifest()["deletes"]]
    return spark.read.parquet(*paths).agg(F.count("*").alias("n_deleted"))


def _late(spark, sf) -> DataFrame:
    d = derived(spark, sf)
    return _load(spark, d.withColumn("change_ts", F.when(F.col("isn") % 20 == 0, F.expr("timestamp_ntz'1990-01-01 00:00:00'")).otherwise(F.col("change_ts")))).good


def late_change_upsert(spark, sf):
    t = JournalTable(spark, work_path(spark, "journal"), ORD).create(base(spark, sf))
    t.append(_late(spark, sf))
    return t.current().select(*OUT)


def late_change_merge(spark, sf):
    t = _keyed(spark, sf)
    merge.apply_merge(t, _late(spark, sf))
    return merge.current(t).select(*OUT)


def late_change_guarded(spark, sf):
    t = _keyed(spark, sf)
    merge.apply_merge(t, _late(spark, sf), guard_ts=True)
    return merge.current(t).select(*OUT)


# Fan-out

SMALL = {"cust": ("customer", "c_custkey", "c_name", "c_acctbal"), "supp": ("supplier", "s_suppkey", "s_name", "s_acctbal")}


def _small(spark, sf, name: str, change: bool) -> DataFrame:
    table, key, label, amount = SMALL[name]
    op = f"case cast({key} as bigint) % 5 when 1 then 'U' when 2 then 'D' else 'I' end" if change else "'I'"
    ts = f"{BATCH_START} + make_dt_interval(0, 0, 0, cast({key} / 1000000 as decimal(18,6)))" if change else "timestamp_ntz'2001-01-01 00:00:00'"
    df = _table(spark, sf, table).selectExpr(
        f"cast({key} as bigint) as isn", f"{op} as op_code", f"{ts} as change_ts", f"{int(change)} as batch_id", f"date_add(date'2001-01-01', cast({key} % 60 as int)) as created_date",
        f"{label} as full_name", f"cast({amount} + {int(change)} as decimal(15,2)) as balance",
    )
    return df.where("isn % 5 in (0, 1, 2)" if change else "isn % 5 <> 0")


def _fan(spark, sf, shape: str) -> FanOut:
    batch = {"ord": derived(spark, sf), "cust": _small(spark, sf, "cust", True), "supp": _small(spark, sf, "supp", True)}
    path = work_path(spark, "json")
    if shape == "mixed":
        generate.write_lines(generate.mixed_lines(batch, THREE), path)
        return FanOut.from_records(spark, path, THREE)
    generate.write_lines(generate.document_lines(batch, THREE, {n: F.floor(F.col("isn") / 4) for n in THREE}), path)
    return FanOut.from_documents(spark, path, THREE)


def _fanned(shape: str, name: str) -> Callable:
    def query(spark, sf):
        bases = {"ord": base(spark, sf), "cust": _small(spark, sf, "cust", False), "supp": _small(spark, sf, "supp", False)}
        tables = {n: ManifestTable(spark, work_path(spark, n), THREE[n]).create(bases[n]) for n in THREE}
        _fan(spark, sf, shape).apply(lambda n, rows: merge.apply_merge(tables[n], rows, stage=False), parallel=3)
        return merge.current(tables[name]).select(*THREE[name].columns)

    return query


TEN, TEN_ROWS, TEN_CHANGES, TEN_MIX = catalog(), 2000, 160, "40:10:50"


def _fanned_ten(shape: str) -> Callable:
    """A batch for all ten tables in one set of files, parsed once, merged into each: count and checksum of each table's current rows."""

    def query(spark, sf):
        rows = dict.fromkeys(TEN, TEN_ROWS)
        tables = {n: ManifestTable(spark, work_path(spark, n), s).create(generate.base(spark, s, TEN_ROWS, rows, how="linear")) for n, s in TEN.items()}
        batch = {n: generate.changes(spark, s, TEN_CHANGES, TEN_ROWS, TEN_MIX, rows, how="linear", order="_k") for n, s in TEN.items()}
        path = work_path(spark, "json")
        if shape == "mixed":
            generate.write_lines(generate.mixed_lines(batch, TEN), path)
            fan = FanOut.from_records(spark, path, TEN)
        else:
            generate.write_lines(generate.document_lines(batch, TEN, {n: generate.document_number(F.col("_k"), i + 1) for i, n in enumerate(TEN)}), path)
            fan = FanOut.from_documents(spark, path, TEN, max_occurs=max(generate.PER_DOCUMENT), strict=True)
        fan.check()
        fan.apply(lambda n, rows: merge.apply_merge(tables[n], rows, stage=False), parallel=5)
        out = None
        for n, t in tables.items():
            row = S.fingerprint(merge.current(t), TEN[n].columns, how="md5").select(F.lit(n).alias("tab"), "n_rows", "checksum")
            out = row if out is None else out.unionByName(row)
        return out

    return query


def manifest_statistics(spark, sf):
    """What the manifest knows of each month without a scan."""
    return _keyed(spark, sf).statistics().select("part", "n_rows", "first_key", "last_key")


def fanout_rejects(spark, sf):
    lines = generate.mixed_lines({"ord": derived(spark, sf), "cust": _small(spark, sf, "cust", True)}, THREE)
    lines = lines.withColumn("isn", F.get_json_object("value", "$.hdr.isn").cast("long"))
    lines = lines.select(F.when(F.col("isn") % 50 == 9, F.regexp_replace("value", '"file":"[a-z]+"', '"file":"none"')).when(F.col("isn") % 50 == 10, F.lit("{")).otherwise(F.col("value")).alias("value"))
    path = work_path(spark, "json")
    generate.write_lines(lines, path)
    return FanOut.from_records(spark, path, THREE).rejects().groupBy("reason").agg(F.count("*").alias("n"))


def _conversation_documents(spark, sf) -> str:
    c = _table(spark, sf, "conversations").selectExpr(
        "turn as isn", "'I' as op_code", "timestamp_ntz'2001-01-01 00:00:00' as change_ts", "1 as batch_id", "date'2001-01-01' as created_date", "conv_id", "role", "text")
    path = work_path(spark, "json")
    generate.write_lines(generate.document_lines({"msg": c}, {"msg": SPECS["msg"]}, {"msg": F.col("conv_id")}), path)
    return path


def doc_slots_two(spark, sf):
    fan = FanOut.from_documents(spark, _conversation_documents(spark, sf), {"msg": SPECS["msg"]}, max_occurs=2)
    return fan.source("msg").select("conv_id", F.col("isn").alias("turn"), "role", "text")


def unbounded_arrays(spark, sf):
    items = ingest.variant_items(spark, _conversation_documents(spark, sf), "msg")
    return items.selectExpr("variant_get(v, '$.et_id', 'bigint') as conv_id", "cast(pos as int) as pos", "variant_get(item, '$.rec.role', 'string') as role", "variant_get(item, '$.hdr.isn', 'bigint') as turn")


def clone_isolated(spark, sf):
    t = _keyed(spark, sf)
    copy = t.clone(work_path(spark, "clone"))
    merge.apply_merge(copy, changes(spark, sf))
    return t.read().select(*OUT)


def link_and_drop(spark, sf):
    """Partitions of another table taken over, one of them dropped."""
    source = _keyed(spark, sf)
    t = ManifestTable(spark, work_path(spark, "linked"), ORD).create()
    t.link(source, [p for p in source.parts() if p >= 200001])
    t.drop([200003])
    return t.read().select(*OUT)


def view_scan(spark, sf):
    """SQL over a view of the merged table: a derived table, a scalar subquery in WHERE and two in SELECT."""
    _merged(spark, sf, "vectors").view("weir_orders")
    return spark.sql("""
        SELECT city, count(*) AS n, (SELECT count(*) FROM weir_orders) AS n_rows, (SELECT count(*) FROM weir_orders WHERE batch_id = 1) AS batch_rows
        FROM (SELECT * FROM weir_orders WHERE op_code <> 'D') cur WHERE amount > (SELECT max(amount) / 2 FROM weir_orders) GROUP BY city""")


def insert_values(spark, sf):
    """A table like another, filled by appended rows and by rows of a query."""
    t = _keyed(spark, sf).like(work_path(spark, "like"))
    t.append(spark.createDataFrame([(10**6 + k, "I", None, 0, None, k, None, "X", None) for k in range(3)], ORD.flat_schema(False)).withColumns({"created_date": F.lit("2001-01-05").cast("date"), "change_ts": F.lit("2001-01-05").cast("timestamp_ntz")}))
    t.append(base(spark, sf))
    return t.read().groupBy("city").agg(F.count("*").alias("n"), F.max("isn").alias("last"))


# Checks

def fingerprint_md5(spark, sf):
    o = _table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(15,2)").alias("price"), "o_orderdate", "o_orderpriority")
    return S.fingerprint(o, how="md5")


def batch_check(spark, sf):
    c = changes(spark, sf)
    return validate.batch_check(_merged(spark, sf, "vectors").read(), c, how="md5")


def check_from(spark, sf):
    c = changes(spark, sf)
    return validate.check_from(base(spark, sf), c, 10**9)


def cross_method_fp(spark, sf):
    t = _keyed(spark, sf)
    swap.apply_swap(t, changes(spark, sf))
    columns = [c for c in OUT if c not in ("op_code", "batch_id")]
    return validate.compare({"upsert": _journal(spark, sf).current(), "swap": swap.current(t), "merge": merge.current(_merged(spark, sf, "vectors"))}, columns, how="md5")


# Generation

ROWS = 20000


def partition_plan_query(spark, sf):
    return spark.createDataFrame([(m.part, m.first_isn, m.last_isn) for m in partition_plan(ROWS)], "part int, first_isn long, last_isn long")


def number_table(spark, sf):
    n = generate.numbers_by_gap_filling(spark, 1000)
    # 1000 x 1000 numbers: the pairing of a number table with itself is the feature
    pairs = n.alias("a").crossJoin(n.alias("b")).select((F.col("a.n") * 1000 + F.col("b.n") + 1).alias("n"))
    return pairs.agg(F.count("*").alias("n_rows"), F.min("n").alias("first"), F.max("n").alias("last"), F.sum("n").alias("total"))


GENERATED = ["isn", "change_ts", "created_date", "cust_no", "first_name", "birth_date", "risk_score", "email", "phone_1", "phone_2", "phone_3", "addr1_street", "addr2_city", "addr2_type"]


def generated_base(spark, sf):
    return generate.base(spark, catalog()["customer"], ROWS, how="linear").select(*GENERATED)


def generated_changes(spark, sf):
    c = generate.changes(spark, catalog()["loan"], 800, ROWS, "40:10:50", how="linear")
    return c.select("isn", "op_code", "change_ts", "batch_id", "created_date", "principal", "interest_rate", "coll1_value", "coll2_value")


def hot_window_perm(spark, sf):
    lo, size, stride = generate.hot_window(ROWS)
    k = spark.range(size).select((F.lit(lo) + F.pmod(F.col("id") * stride, F.lit(size))).alias("isn"))
    return k.agg(F.countDistinct("isn").alias("n_distinct"), F.min("isn").alias("first"), F.max("isn").alias("last"))


# Reports and expressions

def storage_summary(spark, sf):
    l = _table(spark, sf, "lineitem")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("l_extendedprice").cast("decimal(15,2)")), F.lit(0)).cast("decimal(25,2)").alias("total"))


RUNS = [(1, "upsert", 2040.0, 0.0, 1000000), (2, "upsert", 2100.0, 0.0, 1000000), (1, "swap", 1220.0, 14400.0, 1000000), (2, "swap", 1240.0, 14300.0, 1000000), (1, "merge", 1270.0, 860.0, 1000000)]
STEPS = [(1, 1, "txn", 930.0), (2, 1, "txn", 950.0), (1, 5, "txn", 1380.0), (1, 10, "txn", 1920.0), (1, 1, "loan", 700.0), (1, 10, "loan", 1500.0)]


def report_avg_ratio(spark, sf):
    return report.averages(report.frame(spark, RUNS)).selectExpr("method", "runs", "cast(load_ms as decimal(12,3)) load_ms", "cast(apply_ms as decimal(12,3)) apply_ms", "cast(total_ms as decimal(12,3)) total_ms", "cast(ratio as decimal(8,4)) ratio")


def report_pivot(spark, sf):
    return report.by_parallel(report.frame(spark, STEPS, report.STEPS), [1, 5, 10])


def scalar_functions(spark, sf):
    return _table(spark, sf, "orders").selectExpr(
        "o_orderkey", "cast(o_orderkey div 7 as bigint) as seventh", "cast(o_orderkey % 7 as bigint) as rest", "decode(o_orderstatus, 'F', 'final', 'O', 'open', 'other') as status",
        "lpad(cast(o_orderkey as string), 8, '0') as padded", "concat(lower(o_orderpriority), '|', upper(o_orderstatus), '|', left(o_orderpriority, 3)) as texts", "hex(o_orderkey) as hexed",
        "cast(year(o_orderdate) * 100 + month(o_orderdate) as int) as part", "add_months(cast(o_orderdate as date), 1) as next_month", "cast(trunc(cast(o_orderdate as date), 'MM') as date) as month_start",
        "date_add(cast(o_orderdate as date), 10) as later", "cast(unix_timestamp(cast(o_orderdate as timestamp)) as bigint) as epoch", "coalesce(if(o_orderkey % 3 = 0, null, o_orderstatus), '-') as filled",
        "cast(cast(cast(o_orderkey as decimal(20,2)) / 100 as decimal(15,2)) as decimal(15,2)) as cents",
    )


def predicates(spark, sf):
    o = _table(spark, sf, "orders")
    t = {
        "equal": "o_orderstatus = 'F'", "unequal": "o_orderstatus <> 'F'", "between": "o_orderkey between 100 and 500", "in": "o_orderpriority in ('1-URGENT', '5-LOW')", "like": "o_orderpriority like '%-LO_'",
        "not_like": "o_orderpriority not like '1%'", "ilike": "o_orderpriority ilike '%urgent'", "not_null": "o_orderdate is not null",
        "half_open": "(o_orderdate >= timestamp'1996-01-01 00:00:00' and o_orderdate < timestamp'1996-02-01 00:00:00') or (o_orderdate >= timestamp'1997-05-01 00:00:00' and o_orderdate < timestamp'1997-06-01 00:00:00')",
    }
    return o.agg(*[F.count(F.expr(f"case when {p} then 1 end")).alias(n) for n, p in t.items()])


def merge_outer_plan(spark, sf):
    return merge.outer_merged(base(spark, sf), changes(spark, sf)).select(*OUT)


def rows_in_common(spark, sf):
    """The base against the current rows after the changes."""
    return validate.overlap(base(spark, sf), merge.current(_merged(spark, sf, "vectors")).select(*OUT))


def preflight_tables(spark, sf):
    """What the catalog knows of a generated table, one that was merged into and one that isn't there."""
    tables = {"base": _keyed(spark, sf), "merged": _merged(spark, sf, "vectors"), "absent": ManifestTable(spark, work_path(spark, "absent"), ORD)}
    return spark.createDataFrame(validate.sizes({n: (t, 0) for n, t in tables.items()}), "tab string, present boolean, months long, n_rows long, expected long").drop("expected")


def drop_and_create(spark, sf):
    """A table dropped with its files and made again from the changes."""
    t = _keyed(spark, sf)
    t.destroy()
    return t.create(changes(spark, sf)).read().select(*OUT)


def physical_order(spark, sf):
    """Rows of a compacted table that have a smaller key than the row before them in their file."""
    t = _merged(spark, sf, "vectors")
    t.compact()
    rows = t.read().select("isn", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    before = F.lag("isn").over(Window.partitionBy("file").orderBy("at"))
    return rows.select((before > F.col("isn")).alias("late")).agg(F.count("*").alias("n_rows"), F.count_if("late").alias("n_late"))


def spec_fields(spark, sf):
    rows = [(s.name, i, f.path, f.column, f.type) for s in SPECS.values() for i, f in enumerate(s.fields)]
    return spark.createDataFrame(rows, "tab string, pos int, path string, col string, type string")


def manifest_read(spark, sf):
    """Facts of a table as a manifest keeps them, read back."""
    path, t = work_path(spark, "facts"), _keyed(spark, sf)
    generate.write_manifest(spark, path, rows=t.count(), months=len(t.parts()), mix="50:0:50")
    return spark.createDataFrame([generate.read_manifest(spark, path)], "rows long, months long, mix string")


def _report_lines(spark, sf, form) -> DataFrame:
    by_status = _table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")).orderBy("status")  # a row a status
    return spark.createDataFrame(list(enumerate(form(by_status).split("\n"))), "line int, value string")


def report_tsv(spark, sf):
    return _report_lines(spark, sf, report.tsv)


def report_markdown(spark, sf):
    return _report_lines(spark, sf, report.markdown)


def clock_and_version(spark, sf):
    return _table(spark, sf, "orders").agg(F.count_if(F.col("o_orderdate") < S.sysdate()).alias("n_past"), F.bool_and(S.version().rlike("^[0-9]+[.][0-9]+")).alias("has_version"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__.removesuffix("_query"): f
    for f in (
        upsert_current, cdc_json_flatten, cdc_json_rejects, json_events_props, csv_load, journal_history, journal_compact, stream_upsert, topk_events_latest, topk_k3, dedup_batch, swap_touched, swap_isn_range, swap_rebuild,
        swap_current, swap_gap_partitions, merge_current, merge_mor_read, merge_with_tombstones, merge_compacted, merge_updates_vs_inserts, merge_delete_vectors, late_change_upsert, late_change_merge, late_change_guarded,
        fanout_rejects, doc_slots_two, unbounded_arrays, clone_isolated, link_and_drop, view_scan, insert_values, fingerprint_md5, batch_check, check_from, cross_method_fp, partition_plan_query, number_table, generated_base, generated_changes, hot_window_perm,
        storage_summary, manifest_statistics, report_avg_ratio, report_pivot, scalar_functions, predicates,
        merge_outer_plan, rows_in_common, preflight_tables, drop_and_create, physical_order, spec_fields, manifest_read, report_tsv, report_markdown, clock_and_version,
    )
} | {f"fanout_{shape}_{n}": _fanned(shape, n) for shape in ("mixed", "docs") for n in THREE} | {f"fanout_{shape}_ten": _fanned_ten(shape) for shape in ("mixed", "docs")}


# The same in SQL

_COLS = ", ".join(OUT)
_BASE = """base AS (SELECT CAST(o_orderkey AS BIGINT) AS isn, 'I' AS op_code, CAST(o_orderdate AS TIMESTAMP) AS change_ts, CAST(0 AS INTEGER) AS batch_id, CAST(o_orderdate AS DATE) AS created_date,
    CAST(o_custkey AS BIGINT) AS acct_isn, CAST(o_totalprice AS DECIMAL(15,2)) AS amount, o_orderstatus AS city, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS tag_1 FROM orders WHERE o_orderkey % 10 <> 9)"""
_CHG = """chg AS (SELECT CAST(o_orderkey AS BIGINT) AS isn, CASE o_orderkey % 10 WHEN 0 THEN 'U' WHEN 1 THEN 'D' ELSE 'I' END AS op_code, TIMESTAMP '2001-09-01' + o_orderkey * INTERVAL '1 microsecond' AS change_ts,
    CAST(1 AS INTEGER) AS batch_id, CAST(o_orderdate AS DATE) AS created_date, CAST(o_custkey AS BIGINT) AS acct_isn, CAST(o_totalprice + 100 AS DECIMAL(15,2)) AS amount, o_orderstatus AS city,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS tag_1 FROM orders WHERE o_orderkey % 10 = 9 OR (o_orderkey % 10 IN (0, 1) AND o_orderdate >= TIMESTAMP '2001-01-01'))"""
_LATE = "late AS (SELECT * REPLACE (CASE WHEN isn % 20 = 0 THEN TIMESTAMP '1990-01-01' ELSE change_ts END AS change_ts) FROM chg)"
_WITH = f"WITH {_BASE}, {_CHG}"
_CURRENT = f"{_WITH}, allv AS (SELECT * FROM base UNION ALL SELECT * FROM chg), top AS (SELECT * FROM allv QUALIFY row_number() OVER (PARTITION BY isn ORDER BY change_ts DESC) = 1) SELECT {_COLS} FROM top WHERE op_code <> 'D'"
_TOMBS = f"{_WITH} SELECT {_COLS} FROM base WHERE NOT EXISTS (SELECT 1 FROM chg WHERE chg.isn = base.isn) UNION ALL SELECT {_COLS} FROM chg"
_PART = "CAST(year(created_date) * 100 + month(created_date) AS INTEGER)"


def _md5(columns: dict[str, str]) -> str:
    row = " || '|' || ".join(f"coalesce(CAST({x} AS VARCHAR), '~')" for x in columns.values())
    return f"CAST(sum(CAST('0x' || substr(md5({row}), 1, 15) AS BIGINT) % {S.MODULUS}) AS BIGINT)"


def _columns(names: list[str]) -> dict[str, str]:
    return {c: f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')" if c == "change_ts" else c for c in names}


def _fan_sql(name: str) -> str:
    if name == "ord":
        return _CURRENT
    table, key, label, amount = SMALL[name]
    row = lambda c: f"SELECT CAST({key} AS BIGINT) AS isn, " + (f"CASE {key} % 5 WHEN 1 THEN 'U' WHEN 2 THEN 'D' ELSE 'I' END" if c else "'I'") + " AS op_code, " + (f"TIMESTAMP '2001-09-01' + {key} * INTERVAL '1 microsecond'" if c else "TIMESTAMP '2001-01-01'") + f" AS change_ts, CAST({c} AS INTEGER) AS batch_id, DATE '2001-01-01' + CAST({key} % 60 AS INTEGER) AS created_date, {label} AS full_name, CAST({amount} + {c} AS DECIMAL(15,2)) AS balance FROM {table} WHERE {key} % 5 " + ("IN (0, 1, 2)" if c else "<> 0")
    return f"WITH b AS ({row(0)}), c AS ({row(1)}) SELECT * FROM b WHERE isn NOT IN (SELECT isn FROM c) UNION ALL SELECT * FROM c WHERE op_code <> 'D'"


def _h(seed: int, n: int) -> str:
    return f"((isn * 48271 + {seed * 69621}) % 2147483647 % {n})"


def _p(seed: int, values: list[str]) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[{_h(seed, len(values))} + 1]"


def _field_sql(f, seed: int, rows: int) -> str:
    kind, *args = f.generator.partition("?")[0].split(":")
    if kind in ("first", "last", "city", "country"):
        return _p(seed, {"first": generate.FIRST, "last": generate.LAST, "city": generate.CITY, "country": generate.COUNTRY}[kind])
    if kind == "num":
        a, b = int(args[0]), int(args[1])
        return f"CAST(CAST({a * 100} + {_h(seed, (b - a) * 100 + 1)} AS DECIMAL(20,2)) * CAST(0.01 AS DECIMAL(3,2)) AS {f.type.replace('NUMERIC', 'DECIMAL')})"
    return {
        "pick": lambda: _p(seed, args[0].split(";")),
        "street": lambda: f"(1 + {_h(seed, 250)}) || ' ' || {_p(seed + 1, generate.LAST)} || ' ' || {_p(seed + 2, generate.SUFFIX)}",
        "phone": lambda: f"'+' || (1 + {_h(seed, 98)}) || '-' || lpad(CAST({_h(seed + 1, 1000)} AS VARCHAR), 3, '0') || '-' || lpad(CAST({_h(seed + 2, 10000000)} AS VARCHAR), 7, '0')",
        "email": lambda: f"lower({_p(seed, generate.FIRST)}) || '.' || isn || '@' || {_p(seed + 1, generate.DOMAIN)}",
        "code": lambda: f"left(upper(md5(isn || '-{seed}')), {args[0]})",
        "bool": lambda: f"({_h(seed, 100)} < 3)",
        "int": lambda: f"CAST({args[0]} + {_h(seed, int(args[1]) - int(args[0]) + 1)} AS INTEGER)",
        "date": lambda: f"DATE '{args[0]}' + CAST({_h(seed, int(args[1]))} AS INTEGER)",
        "id": lambda: f"'{args[0]}' || lpad(CAST(isn AS VARCHAR), {args[1]}, '0')",
        "ref": lambda: f"CAST(1 + {_h(seed, rows)} AS BIGINT)",
    }[kind]()


def _fields_sql(spec: TableSpec, rows: int, only: list[str] | None = None) -> str:
    containers: dict[str, int] = {}
    out = []
    for i, f in enumerate(spec.fields):
        x = _field_sql(f, 104 + 4 * i, rows)
        if f.percent_null:
            x = f"CASE WHEN {_h(5000 + containers.setdefault(f.container, len(containers) + 1), 100)} < {f.percent_null} THEN NULL ELSE {x} END"
        if only is None or f.column in only:
            out.append(f"{x} AS {f.column}")
    return ", ".join(out)


def _base_sql(rows: int) -> str:
    day = f"DATE '2023-01-01' + CAST((isn - 1) * 1096 // {rows} AS INTEGER)"
    return f"SELECT isn, 'I' AS op_code, CAST({day} AS TIMESTAMP) + {_h(1, 86400)} * INTERVAL '1 second' AS change_ts, CAST(0 AS INTEGER) AS batch_id, {day} AS created_date FROM (SELECT range AS isn FROM range(1, {rows + 1}))"


def _changes_sql(n: int, rows: int, mix: str) -> str:
    lo, size, stride = generate.hot_window(rows)
    n_upd, n_del, _ = S.split_mix(n, mix)
    old = n_upd + n_del
    return f"""SELECT isn, CASE WHEN k < {n_upd} THEN 'U' WHEN k < {old} THEN 'D' ELSE 'I' END AS op_code, TIMESTAMP '2026-01-01' + k * INTERVAL '1 microsecond' AS change_ts, CAST(1 AS INTEGER) AS batch_id,
        CASE WHEN isn <= {rows} THEN DATE '2023-01-01' + CAST((isn - 1) * 1096 // {rows} AS INTEGER) ELSE DATE '2026-01-01' END AS created_date
        FROM (SELECT range AS k, CASE WHEN range < {old} THEN {lo} + range * {stride} % {size} ELSE {rows} + range - {old} + 1 END AS isn FROM range({n}))"""


def _generated_sql() -> str:
    return f"SELECT isn, change_ts, created_date, {_fields_sql(TEN['customer'], ROWS, GENERATED)} FROM ({_base_sql(ROWS)})"


def _generated_changes_sql() -> str:
    return f"SELECT isn, op_code, change_ts, batch_id, created_date, {_fields_sql(TEN['loan'], ROWS, ['principal', 'interest_rate', 'coll1_value', 'coll2_value'])} FROM ({_changes_sql(800, ROWS, '40:10:50')})"


def _ten_sql() -> str:
    keys = f"""WITH b AS ({_base_sql(TEN_ROWS)}), c AS ({_changes_sql(TEN_CHANGES, TEN_ROWS, TEN_MIX)}),
        e AS (SELECT * FROM b WHERE isn NOT IN (SELECT isn FROM c) UNION ALL SELECT * FROM c WHERE op_code <> 'D')"""
    return keys + " " + " UNION ALL ".join(f"SELECT '{n}' AS tab, count(*) AS n_rows, {_md5(_columns(s.columns))} AS checksum FROM (SELECT *, {_fields_sql(s, TEN_ROWS)} FROM e)" for n, s in TEN.items())


_CUR = f"cur AS ({_CURRENT.removeprefix(_WITH + ',').replace('allv AS', 'WITH allv AS', 1)})"
_STATUS = "WITH s AS (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1)"
_O = "CAST(o_orderdate AS DATE)"
SQL: dict[str, str] = {
    **{n: _CURRENT for n in ("upsert_current", "journal_compact", "stream_upsert", "swap_current", "merge_current", "merge_mor_read", "merge_compacted")},
    "cdc_json_flatten": f"{_WITH} SELECT {_COLS} FROM chg",
    "cdc_json_rejects": f"""{_WITH} SELECT CASE isn % 50 WHEN 9 THEN 'not a record of this shape' WHEN 19 THEN 'not a record of this shape' WHEN 29 THEN 'op_code is unknown' WHEN 39 THEN 'isn is null' ELSE 'good' END AS reason, count(*) AS n FROM chg GROUP BY 1""",
    "json_events_props": "SELECT event_type, CAST(sum(CAST(props::JSON->>'k' AS BIGINT)) AS BIGINT) AS sum_k, count(props::JSON->>'k') AS n FROM events GROUP BY 1",
    "csv_load": "SELECT r_regionkey, r_name FROM region",
    "journal_history": f"{_WITH} SELECT {_COLS} FROM (SELECT * FROM base UNION ALL SELECT * FROM chg)",
    "topk_events_latest": "SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "topk_k3": "SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3",
    "dedup_batch": f"SELECT l_orderkey, l_linenumber, {', '.join(LINE)} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in LINE)}) = 1",
    "swap_touched": f"{_WITH} SELECT DISTINCT {_PART} AS part FROM chg",
    "swap_isn_range": f"{_WITH} SELECT min(isn) AS first_isn, max(isn) AS last_isn FROM (SELECT isn FROM base WHERE {_PART} IN (SELECT {_PART} FROM chg) UNION ALL SELECT isn FROM chg)",
    "swap_rebuild": f"""{_WITH}, n AS (SELECT {_COLS} FROM base WHERE {_PART} IN (SELECT {_PART} FROM chg) AND NOT EXISTS (SELECT 1 FROM chg WHERE chg.isn = base.isn) UNION ALL SELECT {_COLS} FROM chg WHERE op_code <> 'D')
        SELECT {_PART} AS part, count(*) AS n, CAST(sum(amount) AS DECIMAL(25,2)) AS amount FROM n GROUP BY 1""",
    "swap_gap_partitions": f"{_WITH}, two AS (SELECT * FROM chg WHERE {_PART} IN (200101, 200107)) SELECT {_COLS} FROM base WHERE isn NOT IN (SELECT isn FROM two) UNION ALL SELECT {_COLS} FROM two WHERE op_code <> 'D'",
    "merge_with_tombstones": _TOMBS,
    "merge_updates_vs_inserts": f"{_WITH} SELECT count(*) FILTER (isn IN (SELECT isn FROM base)) AS n_updated, count(*) FILTER (isn NOT IN (SELECT isn FROM base)) AS n_inserted FROM chg",
    "merge_delete_vectors": f"{_WITH} SELECT count(*) AS n_deleted FROM chg WHERE isn IN (SELECT isn FROM base)",
    "late_change_upsert": f"{_WITH}, {_LATE}, top AS (SELECT * FROM (SELECT * FROM base UNION ALL SELECT * FROM late) QUALIFY row_number() OVER (PARTITION BY isn ORDER BY change_ts DESC) = 1) SELECT {_COLS} FROM top WHERE op_code <> 'D'",
    "late_change_merge": f"{_WITH}, {_LATE} SELECT {_COLS} FROM base WHERE isn NOT IN (SELECT isn FROM late) UNION ALL SELECT {_COLS} FROM late WHERE op_code <> 'D'",
    "late_change_guarded": f"{_WITH}, {_LATE}, top AS (SELECT * FROM (SELECT * FROM base UNION ALL SELECT * FROM late) QUALIFY row_number() OVER (PARTITION BY isn ORDER BY change_ts DESC) = 1) SELECT {_COLS} FROM top WHERE op_code <> 'D'",
    "fanout_rejects": f"""{_WITH}, k AS (SELECT isn FROM chg UNION ALL SELECT CAST(c_custkey AS BIGINT) FROM customer WHERE c_custkey % 5 IN (0, 1, 2))
        SELECT CASE isn % 50 WHEN 9 THEN 'file is unknown' ELSE 'not a record of this shape' END AS reason, count(*) AS n FROM k WHERE isn % 50 IN (9, 10) GROUP BY 1""",
    "doc_slots_two": "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2",
    "unbounded_arrays": "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, role, turn FROM conversations",
    "clone_isolated": f"WITH {_BASE} SELECT {_COLS} FROM base",
    "link_and_drop": f"WITH {_BASE} SELECT {_COLS} FROM base WHERE {_PART} >= 200001 AND {_PART} <> 200003",
    "view_scan": f"{_WITH}, t AS ({_TOMBS.removeprefix(_WITH)}) SELECT city, count(*) AS n, (SELECT count(*) FROM t) AS n_rows, (SELECT count(*) FROM t WHERE batch_id = 1) AS batch_rows FROM (SELECT * FROM t WHERE op_code <> 'D') WHERE amount > (SELECT max(amount) / 2 FROM t) GROUP BY city",
    "insert_values": f"WITH {_BASE} SELECT city, count(*) AS n, max(isn) AS last FROM (SELECT isn, city FROM base UNION ALL SELECT 1000000 + range, 'X' FROM range(3)) GROUP BY city",
    "fingerprint_md5": "SELECT count(*) AS n_rows, " + _md5({"a": "o_orderkey", "b": "o_custkey", "c": "o_orderstatus", "d": "CAST(o_totalprice AS DECIMAL(15,2))", "e": "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f')", "f": "o_orderpriority"}) + " AS checksum FROM orders",
    "batch_check": f"{_WITH}, t AS ({_TOMBS.removeprefix(_WITH)}) SELECT (SELECT count(*) FROM t) AS n_rows, (SELECT count(*) FROM t WHERE batch_id = 1) AS batch_rows, (SELECT {_md5(_columns(OUT))} FROM t WHERE batch_id = 1) AS target_checksum, (SELECT {_md5(_columns(OUT))} FROM chg) AS source_checksum",
    "check_from": f"{_WITH} SELECT min(isn) AS check_from FROM base WHERE created_date >= (SELECT date_trunc('month', min(created_date)) FROM chg)",
    "cross_method_fp": f"{_WITH}, cur AS ({_CURRENT.removeprefix(_WITH + ',').replace('allv AS', 'WITH allv AS', 1)}), f AS (SELECT count(*) AS n_rows, {_md5(_columns([c for c in OUT if c not in ('op_code', 'batch_id')]))} AS checksum FROM cur) SELECT m.method, f.n_rows, f.checksum FROM f, (VALUES ('upsert'), ('swap'), ('merge')) m(method)",
    "partition_plan": f"WITH r AS (SELECT range AS isn, DATE '2023-01-01' + CAST((range - 1) * 1096 // {ROWS} AS INTEGER) AS created_date FROM range(1, {ROWS + 1})) SELECT {_PART} AS part, min(isn) AS first_isn, max(isn) AS last_isn FROM r GROUP BY 1",
    "number_table": "SELECT count(*) AS n_rows, min(a.range * 1000 + b.range + 1) AS first, max(a.range * 1000 + b.range + 1) AS last, CAST(sum(a.range * 1000 + b.range + 1) AS BIGINT) AS total FROM range(1000) a, range(1000) b",
    "generated_base": _generated_sql(),
    "generated_changes": _generated_changes_sql(),
    "hot_window_perm": "SELECT count(DISTINCT isn) AS n_distinct, min(isn) AS first, max(isn) AS last FROM (SELECT {0} + range * {2} % {1} AS isn FROM range({1}))".format(*generate.hot_window(ROWS)),
    "storage_summary": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(15,2))), 0) AS DECIMAL(25,2)) AS total FROM lineitem GROUP BY 1, 2",
    "report_avg_ratio": f"""WITH r(run, method, load_ms, apply_ms, changes) AS (VALUES {', '.join(map(str, RUNS))}), a AS (SELECT method, count(*) AS runs, avg(load_ms) AS l, avg(apply_ms) AS p, avg(load_ms + apply_ms) AS t FROM r GROUP BY 1)
        SELECT method, runs, CAST(l AS DECIMAL(12,3)) AS load_ms, CAST(p AS DECIMAL(12,3)) AS apply_ms, CAST(t AS DECIMAL(12,3)) AS total_ms, CAST(CAST(t AS DOUBLE) / CAST((SELECT min(t) FROM a) AS DOUBLE) AS DECIMAL(8,4)) AS ratio FROM a""",
    "report_pivot": f"WITH s(run, parallel, tab, ms) AS (VALUES {', '.join(map(str, STEPS))}) SELECT tab AS \"table\", CAST(avg(ms) FILTER (parallel = 1) AS DOUBLE) AS p1, CAST(avg(ms) FILTER (parallel = 5) AS DOUBLE) AS p5, CAST(avg(ms) FILTER (parallel = 10) AS DOUBLE) AS p10 FROM s GROUP BY 1",
    "scalar_functions": f"""SELECT o_orderkey, CAST(o_orderkey // 7 AS BIGINT) AS seventh, CAST(o_orderkey % 7 AS BIGINT) AS rest, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS status, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS padded,
        lower(o_orderpriority) || '|' || upper(o_orderstatus) || '|' || left(o_orderpriority, 3) AS texts, to_hex(o_orderkey) AS hexed, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS part,
        CAST({_O} + INTERVAL 1 MONTH AS DATE) AS next_month, CAST(date_trunc('month', {_O}) AS DATE) AS month_start, {_O} + 10 AS later, CAST(epoch(o_orderdate) AS BIGINT) AS epoch,
        coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END, '-') AS filled, CAST(CAST(o_orderkey AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(15,2)) AS cents FROM orders""",
    "predicates": """SELECT count(*) FILTER (o_orderstatus = 'F') AS equal, count(*) FILTER (o_orderstatus <> 'F') AS unequal, count(*) FILTER (o_orderkey BETWEEN 100 AND 500) AS "between", count(*) FILTER (o_orderpriority IN ('1-URGENT', '5-LOW')) AS "in",
        count(*) FILTER (o_orderpriority LIKE '%-LO_') AS "like", count(*) FILTER (o_orderpriority NOT LIKE '1%') AS not_like, count(*) FILTER (o_orderpriority ILIKE '%urgent') AS "ilike", count(*) FILTER (o_orderdate IS NOT NULL) AS not_null,
        count(*) FILTER ((o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01') OR (o_orderdate >= TIMESTAMP '1997-05-01' AND o_orderdate < TIMESTAMP '1997-06-01')) AS half_open FROM orders""",
    "manifest_statistics": f"WITH {_BASE} SELECT {_PART} AS part, count(*) AS n_rows, min(isn) AS first_key, max(isn) AS last_key FROM base GROUP BY 1",
    "merge_outer_plan": f"{_WITH} SELECT {', '.join(f'CASE WHEN c.isn IS NULL THEN b.{c} ELSE c.{c} END AS {c}' for c in OUT)} FROM base b FULL OUTER JOIN chg c ON b.isn = c.isn",
    "rows_in_common": f"""{_WITH}, {_CUR}, a AS (SELECT {_COLS} FROM base), b AS (SELECT {_COLS} FROM cur) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS n_first,
        (SELECT count(*) FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b)) AS n_both, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS n_second, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS n_distinct""",
    "preflight_tables": f"""{_WITH}, t AS ({_TOMBS.removeprefix(_WITH)}) SELECT 'base' AS tab, true AS present, count(DISTINCT {_PART}) AS months, count(*) AS n_rows FROM base
        UNION ALL SELECT 'merged', true, count(DISTINCT {_PART}), count(*) FROM t UNION ALL SELECT 'absent', false, 0, 0""",
    "drop_and_create": f"{_WITH} SELECT {_COLS} FROM chg",
    "physical_order": f"{_WITH}, t AS ({_TOMBS.removeprefix(_WITH)}) SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_late FROM t",
    "spec_fields": f"""WITH l AS (SELECT unnest(string_split('{SPEC_TEXT.strip()}', chr(10))) AS line, generate_subscripts(string_split('{SPEC_TEXT.strip()}', chr(10)), 1) AS n), f AS (SELECT string_split(line, '|') AS p, n FROM l WHERE line[1] = 'F')
        SELECT p[2] AS tab, CAST(row_number() OVER (PARTITION BY p[2] ORDER BY n) - 1 AS INTEGER) AS pos, p[3] AS path, p[4] AS col, p[5] AS type FROM f""",
    "manifest_read": f"WITH {_BASE} SELECT count(*) AS rows, count(DISTINCT {_PART}) AS months, '50:0:50' AS mix FROM base",
    "report_tsv": f"{_STATUS} SELECT CAST(0 AS INTEGER) AS line, 'status' || chr(9) || 'n' AS value UNION ALL SELECT CAST(row_number() OVER (ORDER BY status) AS INTEGER), status || chr(9) || n FROM s",
    "report_markdown": f"{_STATUS} SELECT CAST(0 AS INTEGER) AS line, '| status | n |' AS value UNION ALL SELECT 1, '| --- | --- |' UNION ALL SELECT CAST(row_number() OVER (ORDER BY status) + 1 AS INTEGER), '| ' || status || ' | ' || n || ' |' FROM s",
    "clock_and_version": "SELECT count(*) FILTER (o_orderdate < CAST(now() AS TIMESTAMP)) AS n_past, true AS has_version FROM orders",
    **{f"fanout_{shape}_ten": _ten_sql() for shape in ("mixed", "docs")},
    **{f"fanout_{shape}_{n}": _fan_sql(n) for shape in ("mixed", "docs") for n in THREE},
}
