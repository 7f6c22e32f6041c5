import datetime as dt

from weir import queries
from weir.functions.scalars import part_of
from weir.operators import merge
from weir.operators.journal import newest
from weir.operators.store import ManifestTable
from weir.plans import plans
from weir.sources import generate, ingest
from weir.sources.spec import catalog

TXN = catalog()["txn"]


def test_partition_plan_matches_generated_months(spark):
    rows = 5000
    got = {(r.part, r.a, r.z) for r in generate.base(spark, TXN, rows).groupBy(part_of().alias("part")).agg({"isn": "min"}).withColumnRenamed("min(isn)", "a").join(generate.base(spark, TXN, rows).groupBy(part_of().alias("part")).agg({"isn": "max"}).withColumnRenamed("max(isn)", "z"), "part").collect()}
    plan = plans.partition_plan(rows)
    assert got == {(m.part, m.first_isn, m.last_isn) for m in plan} and len(plan) == 36 and plan[0].first_day == dt.date(2023, 1, 1)


def test_change_stream(spark):
    c = generate.changes(spark, TXN, 200, 10000, "40:10:50")
    ops = {r.op_code: r["count"] for r in c.groupBy("op_code").count().collect()}
    assert ops == {"U": 80, "D": 20, "I": 100} and c.select("isn").distinct().count() == 200 and c.select("change_ts").distinct().count() == 200
    assert c.where("op_code <> 'I'").agg({"isn": "min"}).first()[0] > 9500 and c.where("op_code = 'I'").agg({"isn": "min"}).first()[0] == 10001
    assert c.where("op_code = 'I'").select("created_date").distinct().collect()[0][0] == dt.date(2026, 1, 1)


def test_generated_values_fit_their_types(spark):
    for s in catalog().values():
        df = generate.base(spark, s, 300)
        assert df.columns == s.columns
        assert df.select(ingest.reason(s).alias("r")).where("r is not null").isEmpty(), s.name


def test_number_tables_agree(spark):
    a, b = generate.numbers(spark, 500), generate.numbers_by_gap_filling(spark, 500)
    assert a.exceptAll(b).isEmpty() and b.count() == 500


def test_documents_hold_zero_to_two_records(spark):
    from pyspark.sql import functions as F

    d = spark.range(80).select(generate.document_number(F.col("id"), 1).alias("d")).groupBy("d").count()
    assert {r["d"] % 4: r["count"] for r in d.collect()} == {k: n for k, n in enumerate([1, 1, 2, 0])if n}


def test_top_k_limits_groups_before_the_shuffle(spark):
    df = generate.base(spark, TXN, 100)
    plans.expect_nodes(newest(df), having=("WindowGroupLimit", "Window"))


def test_merge_has_no_outer_join(spark, tmp_path):
    t = ManifestTable(spark, f"{tmp_path}/t", TXN).create(generate.base(spark, TXN, 500))
    d = generate.changes(spark, TXN, 20, 500)
    assert plans.merge_problems(TXN, d) == []
    assert plans.merge_problems(TXN, d.drop("amount").withColumn("isn", d["isn"].cast("int"))) == ["amount is missing", "isn is int, not bigint"]
    text = plans.plan_text(merge.merged(t.read(), d))
    assert "LeftAnti" in text and "Outer" not in text
    pruned = plans.plan_text(t.read([202301]).select("isn"))
    assert "_part=202301" in pruned and "_part=202302" not in pruned and "ReadSchema: struct<isn:bigint>" in pruned


def test_bucketed_join_has_no_exchange(spark):
    df = generate.base(spark, TXN, 300).select("isn", "amount")
    plans.write_bucketed(df, "b1", 4), plans.write_bucketed(df, "b2", 4)
    j = spark.table("b1").hint("merge").join(spark.table("b2"), "isn")
    plans.expect_nodes(j, without=("Exchange",), having=("SortMergeJoin",))
    plans.analyze("b1", spark)


def test_stage_is_read_by_column(spark):
    fan = queries._fan(spark, "/root/testdata/sf0.001", "mixed")
    assert "supp" not in plans.plan_text(fan.source("cust").select("full_name")).split("ReadSchema: ")[1].splitlines()[0]
