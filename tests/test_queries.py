"""Every query against its SQL, over the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    names = list(want.columns)
    expected = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in want.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_stream_upsert_twice_counts_files_once(spark, tmp_path):
    from weir import queries as q
    from weir.operators.journal import JournalTable
    from weir.sources import generate
    from weir.streaming.upsert import run_upsert

    lines = generate.record_lines(q.derived(spark, DATA), q.ORD)
    generate.write_lines(lines, f"{tmp_path}/in")
    t = JournalTable(spark, f"{tmp_path}/t", q.ORD).create(q.base(spark, DATA))
    for _ in range(2):
        run_upsert(spark, f"{tmp_path}/in", t, f"{tmp_path}/check").awaitTermination()
    assert t.journal.read().count() == q.base(spark, DATA).count() + q.derived(spark, DATA).count()
