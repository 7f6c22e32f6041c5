import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from weir.functions.scalars import fingerprint, part_of
from weir.operators import merge, swap, validate
from weir.operators.changes import DuplicateKeys
from weir.operators.journal import JournalTable, newest
from weir.operators.store import Conflict, ManifestTable
from weir.sources.spec import parse_spec

SPEC = parse_spec("T|t|1|test\nF|t|v|v|VARCHAR(10)")["t"]
SCHEMA = SPEC.flat_schema(strict=False)


def row(isn, op="I", ts=0, batch=0, month=1, v=None):
    return (isn, op, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=ts), batch, dt.date(2024, month, 5), v or f"{op}{ts}")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def tables(spark, tmp_path, base, tag=""):
    b = frame(spark, base)
    return JournalTable(spark, f"{tmp_path}/j{tag}", SPEC).create(b), ManifestTable(spark, f"{tmp_path}/s{tag}", SPEC).create(b), ManifestTable(spark, f"{tmp_path}/m{tag}", SPEC).create(b), ManifestTable(spark, f"{tmp_path}/c{tag}", SPEC).create(b)


def rows_of(df):
    return sorted((r.isn, r.v) for r in df.collect())


def test_methods_agree_over_random_batches(spark, tmp_path):
    r = random.Random(4)
    month = {k: r.choice([1, 2, 5]) for k in range(60)}
    base = [row(k, month=month[k]) for k in range(40)]
    j, s, m, c = tables(spark, tmp_path, base)
    state = {k: "I0" for k in range(40)}
    for n in range(1, 4):
        batch = []
        for k in r.sample(range(60), 15):
            op = r.choice(["U", "D"]) if k in state else r.choice(["I", "I", "D"])
            batch.append(row(k, op, n * 100 + k, n, month[k]))
            state.pop(k, None) if op == "D" else state.update({k: f"{op}{n * 100 + k}"})
        d = frame(spark, batch)
        j.append(d), swap.apply_swap(s, d), merge.apply_merge(m, d), merge.apply_merge(c, d, "copy")
        want = sorted(state.items())
        assert rows_of(j.current()) == rows_of(swap.current(s)) == rows_of(merge.current(m)) == rows_of(merge.current(c)) == want
        columns = ["isn", "created_date", "v"]
        assert validate.expect_equal(validate.compare({"j": j.current(), "s": swap.current(s), "m": merge.current(m)}, columns))[0] == len(want)
    m.compact(), j.compact()
    assert rows_of(merge.current(m)) == rows_of(j.current()) == want and m.manifest()["deletes"] == []
    assert j.journal.read().groupBy("isn").count().where("count > 1").isEmpty()


def test_duplicates_late_changes_and_ties(spark, tmp_path):
    j, s, m, _ = tables(spark, tmp_path, [row(1, ts=50), row(2)])
    twice = frame(spark, [row(2, "U", 10, 1), row(2, "U", 20, 1)])
    for apply in (lambda: swap.apply_swap(s, twice), lambda: merge.apply_merge(m, twice)):
        with pytest.raises(DuplicateKeys):
            apply()
    swap.apply_swap(s, twice, dedup=True), merge.apply_merge(m, twice, dedup=True), j.append(twice)
    assert rows_of(swap.current(s)) == rows_of(merge.current(m)) == rows_of(j.current()) == [(1, "I50"), (2, "U20")]
    late = frame(spark, [row(1, "U", 30, 2)])
    merge.apply_merge(m, late, guard_ts=True), swap.apply_swap(s, late, guard_ts=True), j.append(late)
    assert rows_of(merge.current(m))[0] == rows_of(swap.current(s))[0] == rows_of(j.current())[0] == (1, "I50")
    merge.apply_merge(m, late)
    assert rows_of(merge.current(m))[0] == (1, "U30")
    tie = frame(spark, [row(3, "I", 5, 1, v="a"), row(3, "U", 5, 2, v="b"), row(3, "U", 5, 2, v="c")])
    assert newest(tie).count() == 1 and newest(tie).first().batch_id == 2 and newest(tie).first().v == newest(tie.orderBy("v")).first().v


def test_unknown_deletes_and_reinserts(spark, tmp_path):
    j, s, m, _ = tables(spark, tmp_path, [row(1), row(2)])
    for n, batch in enumerate([[row(1, "D", 10, 1), row(9, "D", 10, 1)], [row(1, "I", 20, 2)]]):
        d = frame(spark, batch)
        j.append(d), swap.apply_swap(s, d), merge.apply_merge(m, d)
        want = [[(2, "I0")], [(1, "I20"), (2, "I0")]][n]
        assert rows_of(j.current()) == rows_of(swap.current(s)) == rows_of(merge.current(m)) == want
    assert m.read().where("op_code = 'D'").count() == 1 and s.read().where("op_code = 'D'").isEmpty()


def test_empty_batch_and_empty_table(spark, tmp_path):
    none = frame(spark, [])
    j, s, m, _ = tables(spark, tmp_path, [row(1)])
    assert swap.apply_swap(s, none) == []
    merge.apply_merge(m, none), j.append(none)
    assert rows_of(j.current()) == rows_of(swap.current(s)) == rows_of(merge.current(m)) == [(1, "I0")]
    e = ManifestTable(spark, f"{tmp_path}/e", SPEC).create()
    assert e.read().isEmpty() and e.parts() == []
    merge.apply_merge(e, frame(spark, [row(5)]))
    assert rows_of(merge.current(e)) == [(5, "I0")]
    assert fingerprint(none).first().asDict() == {"n_rows": 0, "checksum": 0}


def test_swap_touches_only_its_months(spark, tmp_path):
    _, s, _, _ = tables(spark, tmp_path, [row(k, month=k) for k in range(1, 8)])
    before = s.manifest()["parts"]
    assert swap.apply_swap(s, frame(spark, [row(2, "U", 1, 1, 2), row(6, "D", 1, 1, 6)])) == [202402, 202406]
    after = s.manifest()["parts"]
    assert {p for p in before if before[p] != after.get(p)} == {"202402", "202406"} and "202406" not in after


def test_manifests(spark, tmp_path):
    t = ManifestTable(spark, f"{tmp_path}/t", SPEC).create(frame(spark, [row(k, month=1 + k % 3) for k in range(9)]))
    with pytest.raises(Conflict):
        t.create()
    stale = t.manifest()
    t.append(frame(spark, [row(100)]))
    with pytest.raises(Conflict):
        t.publish(stale)
    assert t.read().count() == 10 and t.read(version=1).count() == 9
    assert t.read([202402]).count() == 3 and t.parts() == [202401, 202402, 202403]
    c = t.clone(f"{tmp_path}/c")
    merge.apply_merge(c, frame(spark, [row(0, "D", 9, 1)]))
    assert t.read().count() == 10 and merge.current(c).count() == 9
    o = ManifestTable(spark, f"{tmp_path}/o", SPEC).create()
    o.link(t, [202401, 202403])
    o.drop([202403])
    assert o.read().select(part_of()).distinct().count() == 1 and o.storage().agg(F.sum("bytes")).first()[0] > 0
    with pytest.raises(ValueError):
        o.link(c, [202401])
    t.destroy()
    assert not t.exists()


def test_history_and_top_k(spark, tmp_path):
    j, *_ = tables(spark, tmp_path, [row(1), row(2)])
    j.append(frame(spark, [row(1, "U", 10, 1)])), j.append(frame(spark, [row(1, "D", 20, 2)]))
    assert [r.op_code for r in j.history(1).collect()] == ["I", "U", "D"]
    assert j.versions(2).count() == 3 and j.current().count() == 1
    j.refresh()
    assert rows_of(j.current()) == [(2, "I0")]


def test_subject_walk_through(spark):
    rows = [(1, "A", 1), (2, "B", 1), (3, "C", 1), (4, "D", 1), (2, "New B", 2)]
    t = spark.createDataFrame(rows, "subject_id int, subject string, insert_date int")
    current = newest(t, "subject_id", 1, [F.col("insert_date").desc()])
    assert sorted((r.subject_id, r.subject) for r in current.collect()) == [(1, "A"), (2, "New B"), (3, "C"), (4, "D")] and t.count() == 5


def test_batch_checks(spark, tmp_path):
    _, _, m, _ = tables(spark, tmp_path, [row(k) for k in range(5)])
    d = frame(spark, [row(1, "U", 10, 1), row(9, "I", 11, 1)])
    merge.apply_merge(m, d)
    validate.expect_batch(m.read(), d, 6, 2)
    with pytest.raises(validate.CheckFailed):
        validate.expect_batch(m.read(), d, 7, 2)
    with pytest.raises(validate.CheckFailed):
        validate.preflight({"m": (m, 99)})
    with pytest.raises(validate.CheckFailed):
        validate.expect_equal(validate.compare({"a": m.read(), "b": d}))
    assert merge.effects(frame(spark, [row(1)]), d).first().asDict() == {"n_updated": 1, "n_inserted": 1}
    assert len(list(validate.differences(m.read(), d))) == 4


def test_linked_rows_are_not_hidden_by_older_vectors(spark, tmp_path):
    t = ManifestTable(spark, f"{tmp_path}/t", SPEC).create(frame(spark, [row(1), row(2, month=2)]))
    merge.apply_merge(t, frame(spark, [row(1, "D", 5, 1)]))
    source = ManifestTable(spark, f"{tmp_path}/s", SPEC).create(frame(spark, [row(1, ts=9), row(3, ts=9)]))
    t.link(source, [202401])
    assert rows_of(merge.current(t)) == [(1, "I9"), (2, "I0"), (3, "I9")]
    merge.apply_merge(t, frame(spark, [row(3, "D", 12, 2)]))
    assert rows_of(merge.current(t)) == [(1, "I9"), (2, "I0")] and rows_of(source.read()) == [(1, "I9"), (3, "I9")]


def test_a_row_that_moves_to_another_month(spark, tmp_path):
    j, s, m, c = tables(spark, tmp_path, [row(k, month=k) for k in range(1, 6)])
    d = frame(spark, [row(1, "U", 1, 1, month=3), row(2, "D", 1, 1, month=4), row(5, "U", 1, 1, month=5)])
    j.append(d), merge.apply_merge(m, d), merge.apply_merge(c, d, "copy")
    assert swap.apply_swap(s, d) == [202401, 202402, 202403, 202404, 202405]
    want = [(1, "U1"), (3, "I0"), (4, "I0"), (5, "U1")]
    assert rows_of(s.read()) == rows_of(merge.current(m)) == rows_of(merge.current(c)) == rows_of(j.current()) == want
    assert s.parts() == [202403, 202404, 202405]


def test_a_torn_manifest_is_passed_over(spark, tmp_path):
    t = ManifestTable(spark, f"{tmp_path}/t", SPEC).create(frame(spark, [row(1)]))
    (tmp_path / "t" / "_manifest" / "v0000000002.json").write_text('{"version": 2, "par')
    assert rows_of(t.read()) == [(1, "I0")]
    t.append(frame(spark, [row(2)]))
    assert rows_of(t.read()) == [(1, "I0"), (2, "I0")] and t.manifest()["version"] == 3
    (tmp_path / "t" / "_manifest" / ".left").write_text("{")  # a writer that died before its rename
    assert t.read().count() == 2


def test_publishing_is_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    t = ManifestTable(spark, f"{tmp_path}/t", SPEC).create(frame(spark, [row(1)]))
    seen = []
    real = ManifestTable._file

    def crash(self, version):  # called between the write of the new version and its rename
        seen.append(sorted(p.name for p in (tmp_path / "t" / "_manifest").iterdir() if p.name.startswith("v")))
        raise ZeroDivisionError

    d = frame(spark, [row(2)])
    m = t.manifest() | {"parts": t.manifest()["parts"] | t.write_data(d, 2)}
    monkeypatch.setattr(ManifestTable, "_file", crash)
    with pytest.raises(ZeroDivisionError):
        t.publish(m)
    monkeypatch.setattr(ManifestTable, "_file", real)
    assert seen == [["v0000000001.json"]] and rows_of(t.read()) == [(1, "I0")]
    t.append(frame(spark, [row(3)]))
    assert rows_of(t.read()) == [(1, "I0"), (3, "I0")]


def test_a_journal_load_is_one_version(spark, tmp_path, monkeypatch):
    j, *_ = tables(spark, tmp_path, [row(1), row(2)])
    published = []
    real = ManifestTable.publish
    monkeypatch.setattr(ManifestTable, "publish", lambda self, m: published.append(self.path) or real(self, m))
    j.append(frame(spark, [row(1, "U", 10, 1)]))
    assert len(published) == 1 and j.journal.read().count() == 3 and rows_of(j.current()) == [(1, "U10"), (2, "I0")]
    j.compact()
    assert len(published) == 2 and rows_of(j.journal.read()) == rows_of(j.current())
    monkeypatch.setattr(ManifestTable, "publish", lambda self, m: 1 / 0)
    for crash in (lambda: j.append(frame(spark, [row(9)])), j.compact, j.refresh):
        with pytest.raises(ZeroDivisionError):
            crash()
    assert rows_of(j.current()) == rows_of(j.journal.read()) == [(1, "U10"), (2, "I0")]


def test_a_replayed_batch_counts_once(spark, tmp_path):
    j, *_ = tables(spark, tmp_path, [row(1)])
    d = frame(spark, [row(1, "U", 10, 1), row(2, "I", 11, 1)])
    assert j.append(d, batch=("s", 0)) and not j.append(d, batch=("s", 0)) and j.append(d, batch=("other", 0))
    assert j.journal.read().count() == 5
    assert j.append(d, batch=("s", 1)) and not j.append(d, batch=("s", 0)) and j.journal.read().count() == 7
    j.refresh()
    assert not j.append(d, batch=("s", 1)) and rows_of(j.current()) == [(1, "U10"), (2, "I11")]


def test_rejects_change_no_table(spark, tmp_path):
    from weir.sources import generate, ingest

    lines = generate.record_lines(frame(spark, [row(1, "U", 5, 1), row(2, "Q", 5, 1)]), SPEC)
    generate.write_lines(lines, f"{tmp_path}/in")
    j, s, *_ = tables(spark, tmp_path, [row(1)])
    rows, check = ingest.read_records(spark, f"{tmp_path}/in", SPEC).counted(2)
    with pytest.raises(ingest.LoadError, match="1 rows, 2 expected, 1 rejected"):
        j.append(rows, check)
    rows, check = ingest.read_records(spark, f"{tmp_path}/in", SPEC).counted()
    with pytest.raises(ingest.LoadError):
        ManifestTable(spark, f"{tmp_path}/delta", SPEC).create(rows, check)
    assert rows_of(j.current()) == [(1, "I0")] and not ManifestTable(spark, f"{tmp_path}/delta", SPEC).exists()


def test_a_batch_is_parsed_once(spark, tmp_path):
    from weir.sources import generate, ingest

    generate.write_lines(generate.record_lines(frame(spark, [row(k, "U", 5, 1) for k in range(5)]), SPEC), f"{tmp_path}/in")
    parsed = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            parsed.add(b.num_rows)
            yield b

    good = ingest.read_records(spark, f"{tmp_path}/in", SPEC).good
    _, s, m, c = tables(spark, tmp_path, [row(k) for k in range(9)])
    for apply in (lambda d: swap.apply_swap(s, d), lambda d: merge.apply_merge(m, d, exact=True), lambda d: merge.apply_merge(c, d, "copy", guard_ts=True)):
        before = parsed.value
        apply(good.mapInArrow(count, good.schema))
        assert parsed.value - before == 5
    assert not list((tmp_path / "s" / "stage").iterdir())
    with pytest.raises(ValueError, match="v is missing"):
        swap.apply_swap(s, good.drop("v"))


def test_only_months_that_a_vector_meets_are_joined(spark, tmp_path):
    from weir.plans.plans import nodes

    m = ManifestTable(spark, f"{tmp_path}/m", SPEC).create(frame(spark, [row(k, month=1 + k // 10) for k in range(60)]))
    merge.apply_merge(m, frame(spark, [row(k, "U", 9, 1, month=1 + k // 10) for k in (51, 55)]))
    assert not any("Join" in n for n in nodes(m.read([202401, 202405]))) and any("Join" in n for n in nodes(m.read()))
    assert m.read().count() == 60 and m.read(ranges=[(3, 4)]).count() == 10
    got = {r.part: r for r in m.statistics().collect()}
    assert (got[202401].n_rows, got[202401].first_key, got[202401].last_key, got[202406].runs, got[202406].n_rows) == (10, 0, 9, 2, 12)
    for n in range(3):
        merge.apply_merge(m, frame(spark, [row(n, "U", 20 + n, 2)]))
    assert not m.maintain(runs=9, vectors=9) and m.maintain(runs=9, vectors=3) and m.manifest()["deletes"] == []
    assert m.count() == 60 and {r.v for r in m.read().where("isn < 3").collect()} == {"U20", "U21", "U22"}


def test_system_date_and_version(spark):
    from weir.functions.scalars import sysdate, version

    r = spark.range(1).select(sysdate().alias("t"), version().alias("v")).first()
    assert abs((dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) - r.t).total_seconds()) < 60 and r.v.startswith(spark.version)
