import json

import pytest

from weir import cli, report
from weir.operators.store import ManifestTable
from weir.sources.generate import PER_DOCUMENT
from weir.sources.ingest import LoadError
from weir.sources.spec import parse_spec


def test_generate_run_fanout_clean(spark, tmp_path, capsys):
    spec = tmp_path / "spec.txt"
    spec.write_text("T|txn|16|facts|fact\nF|txn|amount|amount|NUMERIC(15,2)|num:1:9\nF|txn|tag.0|tag_1|VARCHAR(5)|pick:A;B?50\nT|loan|14|loans\nF|loan|terms.months|months|INT|int:1:9\n")
    go = lambda *a: cli.main(["--root", f"{tmp_path}/w", "--tables", str(spec), *a], spark)
    go("generate", "--rows", "4K", "--multi-rows", "2K", "--changes", "80", "--mix", "50:25:25")
    go("generate", "--rows", "4K", "--multi-rows", "2K", "--changes", "80", "--mix", "50:25:25")
    assert "4K rows are there" in capsys.readouterr().out
    go("run", "--full-check")
    out = capsys.readouterr().out
    assert "checked: 4000 current rows from isn 1" in out and "| merge |" in out
    go("run")
    assert "checked:" in capsys.readouterr().out
    for shape in ("mixed", "docs"):
        go("fanout", shape, "--parallel", "2,1")
        out = capsys.readouterr().out
        assert "| loan |" in out and "| table | p1 | p2 |" in out and "| 2 at a time |" in out
    docs = [json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/w/json_docs").collect()]
    assert {(len(d["txn"]), len(d["loan"])) for d in docs} == {(PER_DOCUMENT[(k + 1) % 4], PER_DOCUMENT[(k + 2) % 4]) for k in range(4)} and len(docs) == 80
    # a reject stops the batch before any table changes
    for shape, bad in (("mixed", '{"hdr": {"file": "loan", "isn": 1, "op": "?", "ts": "2026-01-01 00:00:00", "batch": 1}, "loan": {"created": "2025-11-07"}}'), ("docs", '{"et_id": 900, "loan": [{"hdr": {"isn": null}}]}')):
        (tmp_path / "w" / f"json_{shape}" / "part-bad.txt").write_text(bad + "\n")
        with pytest.raises(LoadError, match="'loan': 1"):
            go("fanout", shape)
        specs = parse_spec(spec.read_text())
        assert ManifestTable(spark, f"{tmp_path}/w/loan_fan", specs["loan"]).manifest()["version"] == ManifestTable(spark, f"{tmp_path}/w/loan_base", specs["loan"]).manifest()["version"]
    go("clean")
    assert {p.name for p in (tmp_path / "w").iterdir()} == {"txn_base", "loan_base", "json_records", "json_mixed", "json_docs", "manifest"}
    go("clean", "--all")
    assert not list((tmp_path / "w").iterdir())
    with pytest.raises(SystemExit):
        go("generate", "--rows", "1K", "--multi-rows", "1K", "--changes", "400")


def test_reports(spark):
    runs = report.frame(spark, [(1, "a", 1000.0, 500.0, 1000), (2, "a", 2000.0, 500.0, 1000), (1, "b", 1000.0, 0.0, 1000)])
    got = {r.method: r for r in report.averages(runs).collect()}
    assert got["a"].total_ms == 2000 and got["a"].ratio == 2.0 and got["b"].rows_per_s == 1000
    assert report.markdown(runs).startswith("| run | method |") and report.tsv(runs).splitlines()[1].startswith("1\ta")
