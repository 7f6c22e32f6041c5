import json

import pytest
from pyspark.sql import functions as F

from weir.functions.scalars import fingerprint
from weir.operators.fanout import FanOut
from weir.sources import generate, ingest
from weir.sources.spec import catalog

TXN = catalog()["txn"]


def line(isn=1, op="U", rec=None, **hdr):
    return {"hdr": {"isn": isn, "op": op, "ts": "2026-01-01 00:00:00.000001", "batch": 1} | hdr, "rec": {"created": "2025-11-07"} | (rec or {})}


def write(tmp_path, lines, name="in.json"):
    (tmp_path / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(tmp_path / name)


def test_absent_and_short_values_are_null(spark, tmp_path):
    full = {"merchant": {"mcc": 1, "name": "n", "city": "c", "country": "DE"}, "tag": ["a", "b"], "amount": 1.5, "reversal": True, "extra": {"x": 1}}
    load = ingest.read_records(spark, write(tmp_path, [line(1, rec=full), line(2), line(3, rec={"merchant": None, "tag": None}), line(4, rec={"tag": ["a"]}), line(5, rec={"tag": [], "merchant": {"mcc": 7}})]), TXN)
    assert load.check(5) == 5
    got = {r.isn: r for r in load.good.collect()}
    assert (got[1].mcc, got[1].tag_2, str(got[1].amount), got[1].is_reversal) == (1, "b", "1.50", True)
    assert all(got[k].tag_2 is None for k in (2, 3, 4, 5)) and got[4].tag_1 == "a" and got[5].mcc == 7 and got[3].merchant_city is None
    assert load.good.columns == TXN.columns and str(got[1].change_ts) == "2026-01-01 00:00:00.000001"


def test_rejects(spark, tmp_path):
    bad = [
        '{"hdr":{"isn":9,', line(1, rec={"amount": "x"}), line(None), line(2, op="UPD"), line(3, op="X"), line(4, rec={"currency": "EURO"}), line(5, rec={"created": None}), line(6, ts=None), line(7, rec={"amount": 1e20}), line(8),
    ]
    load = ingest.read_records(spark, write(tmp_path, bad), TXN)
    reasons = sorted(r.reason for r in load.rejects.collect())
    assert reasons == sorted(["not a record of this shape"] * 3 + ["isn is null", "op_code is unknown", "op_code is unknown", "currency is too long", "created_date is null", "change_ts is null"])
    assert [r.isn for r in load.good.collect()] == [8]
    with pytest.raises(ingest.LoadError):
        load.check()
    with pytest.raises(ingest.LoadError):
        ingest.read_records(spark, write(tmp_path, [line(8)], "b.json"), TXN).check(2)


def test_round_trip_of_all_tables_in_three_shapes(spark, tmp_path):
    specs = catalog()
    batch = {}
    for n, s in specs.items():
        generate.changes(spark, s, 40, 1000, "40:10:50").write.parquet(str(tmp_path / f"b_{n}"))
        batch[n] = spark.read.parquet(str(tmp_path / f"b_{n}"))
    for n, s in specs.items():
        generate.write_lines(generate.record_lines(batch[n], s), str(tmp_path / f"r_{n}"))
        assert ingest.read_records(spark, str(tmp_path / f"r_{n}"), s).good.transform(fingerprint).first() == fingerprint(batch[n]).first()
    generate.write_lines(generate.mixed_lines(batch, specs), str(tmp_path / "mixed"))
    generate.write_lines(generate.document_lines(batch, specs, {n: F.floor(F.col("isn") / 7) for n in specs}), str(tmp_path / "docs"))
    for fan in (FanOut.from_records(spark, str(tmp_path / "mixed"), specs), FanOut.from_documents(spark, str(tmp_path / "docs"), specs)):
        assert fan.reject_counts() == {}
        for n in ("customer", "txn", "employees"):
            got = fan.source(n)
            assert got.transform(fingerprint).first() == fingerprint(batch[n]).first() and got.count() == 40


def test_unknown_file_and_overflow(spark, tmp_path):
    specs = {"txn": TXN}
    mixed = [{"hdr": {"file": "txn"} | line(1)["hdr"], "txn": line(1)["rec"]}, {"hdr": {"file": "nope"} | line(2)["hdr"]}, "{", {"hdr": {"file": "txn"} | line(None)["hdr"], "txn": line()["rec"]}]
    fan = FanOut.from_records(spark, write(tmp_path, mixed), specs)
    assert fan.source("txn").count() == 1
    assert sorted(r.reason for r in fan.rejects().collect()) == ["file is unknown", "not a record of this shape"]
    assert [r.reason for r in fan.rejects("txn").collect()] == ["isn is null"] and fan.reject_counts() == {None: 2, "txn": 1}
    docs = write(tmp_path, [{"et_id": 1, "et_ts": "2026-01-01 00:00:00", "txn": [line(k) for k in range(4)]}, {"et_id": 2, "txn": []}, {"et_id": 3, "txn": None}, {"et_id": 4}], "d.json")
    assert FanOut.from_documents(spark, docs, specs).source("txn").count() == 4
    assert FanOut.from_documents(spark, docs, specs, max_occurs=2).source("txn").count() == 2
    with pytest.raises(ingest.LoadError):
        FanOut.from_documents(spark, docs, specs, max_occurs=2, strict=True)


def test_csv_fails_fast(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,A\n2,B\n")
    assert ingest.read_csv(spark, str(tmp_path / "a.csv"), "subject_id int, subject string").count() == 2
    (tmp_path / "b.csv").write_text("1,A\nx,B\n")
    with pytest.raises(Exception):
        ingest.read_csv(spark, str(tmp_path / "b.csv"), "subject_id int, subject string").collect()
