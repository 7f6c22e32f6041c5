from collections import Counter

import pytest
from pyspark.sql import types as T

from weir.functions import scalars as S
from weir.sources.spec import catalog, parse_spec, spark_type, text_limit


def test_ten_tables():
    tables = catalog()
    assert list(tables) == ["customer", "account", "card", "loan", "payment", "txn", "policy", "claim", "employees", "vehicles"]
    assert [t.number for t in tables.values()] == list(range(11, 21)) and [n for n, t in tables.items() if t.fact] == ["txn"]
    assert {n: len(t.columns) for n, t in tables.items()} == {"customer": 23, "account": 18, "card": 18, "loan": 18, "payment": 18, "txn": 19, "policy": 18, "claim": 17, "employees": 20, "vehicles": 17}
    kinds = Counter(f.type.split("(")[0] for t in tables.values() for f in t.fields)
    assert kinds == {"VARCHAR": 53, "NUMERIC": 23, "CHAR": 23, "DATE": 15, "BIGINT": 14, "INT": 7, "BOOLEAN": 1}
    assert sum(f.percent_null > 0 for t in tables.values() for f in t.fields) == 40


def test_types_and_shapes():
    assert spark_type("NUMERIC(15,2)") == T.DecimalType(15, 2) and spark_type("timestamp") == T.TimestampNTZType() and text_limit("CHAR(3)") == 3 and text_limit("INT") is None
    with pytest.raises(ValueError):
        spark_type("BLOB")
    rec = catalog()["customer"].record_type()
    assert rec["name"].dataType == T.StructType().add("first", "string").add("last", "string")
    assert rec["phone"].dataType == T.ArrayType(T.StringType()) and rec["address"].dataType.elementType.names == ["type", "street", "city", "country"]
    assert catalog()["employees"].record_type()["income"].dataType.elementType.names == ["curr_code", "salary", "bonus"]
    flat = catalog()["txn"].flat_schema()
    assert not flat["isn"].nullable and flat["amount"].nullable and flat["amount"].dataType == T.DecimalType(15, 2)


def test_bad_specs():
    for text in ("T|a", "T|a|1|x\nT|a|2|y", "F|a|b|c|INT", "T|a|1|x\nF|a|b|c|NOPE"):
        with pytest.raises(ValueError):
            parse_spec(text)


def test_counts_and_labels():
    assert [S.parse_count(x) for x in ("10K", "1m", "1B", "7")] == [10000, 1000000, 1000000000, 7]
    assert [S.count_label(x) for x in (10**9, 5 * 10**6, 2000, 1234, 0)] == ["1B", "5M", "2K", "1234", "0"]
    assert S.split_mix(1000, "50:0:50") == (500, 0, 500) and S.split_mix(7, "40:10:50") == (2, 0, 5)
    for bad in (lambda: S.parse_count("x"), lambda: S.split_mix(1, "1:1:1")):
        with pytest.raises(ValueError):
            bad()
    assert S.rate(1000000, 2000) == "500K rows/s" and S.clock(3723000) == "1h 2m 3s" and S.seconds(1234) == "1.23"
    from math import gcd

    assert all(gcd(S.coprime_stride(n), n) == 1 for n in range(1, 300))
