"""python -m weir.cli: generate, run (upsert, swap, merge), fanout (mixed, docs), clean."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report
from .functions.scalars import count_label, parse_count, rate, split_mix
from .operators import merge, swap, validate
from .operators.fanout import FanOut
from .operators.journal import JournalTable
from .operators.store import ManifestTable
from .sources import generate, ingest
from .sources.spec import catalog, parse_spec

METHODS = ("upsert", "swap", "merge")


def session() -> SparkSession:
    return SparkSession.builder.appName("weir").config("spark.sql.session.timeZone", "UTC").config("spark.scheduler.mode", "FAIR").getOrCreate()


def _specs(args):
    if not args.tables:
        return catalog()
    return parse_spec("\n".join(r[0] for r in args.spark.read.text(args.tables).collect()))


def _table(args, name: str, what: str) -> ManifestTable:
    return ManifestTable(args.spark, f"{args.root}/{name}_{what}", _specs(args)[name])


def cmd_generate(args) -> None:
    """Base tables, change files in three shapes and a manifest; what is there in the same size stays, unless --force."""
    spark, specs = args.spark, _specs(args)
    rows, multi, n = parse_count(args.rows), parse_count(args.multi_rows), parse_count(args.changes)
    sizes = {t: rows if s.fact else multi for t, s in specs.items()}
    n_upd, n_del, n_ins = split_mix(n, args.mix)
    if n_upd + n_del > min(sizes.values()) * args.hot_percent // 100:
        raise SystemExit(f"{n_upd + n_del} updates and deletes do not fit the newest {args.hot_percent} % of {min(sizes.values())} rows")
    if n % 4:
        raise SystemExit("the number of changes must be a multiple of 4: documents come in cycles of four")
    batches = {}
    for t, s in specs.items():
        base = _table(args, t, "base")
        if base.exists() and not args.force and base.count() == sizes[t]:
            print(f"{t}: {count_label(sizes[t])} rows are there")
        else:
            base.destroy()
            base.create(generate.base(spark, s, sizes[t], sizes))
            print(f"{t}: {count_label(sizes[t])} rows generated")
            base.statistics().show(5)
        batches[t] = generate.changes(spark, s, n, sizes[t], args.mix, sizes, hot_percent=args.hot_percent, order="_k")
    fact = next((t for t, s in specs.items() if s.fact), next(iter(specs)))
    order = [fact, *(t for t in specs if t != fact)]
    number = {t: generate.document_number(F.col("_k"), i + 1) for i, t in enumerate(order)}
    for kind, lines in (("records", generate.record_lines(batches[fact], specs[fact])), ("mixed", generate.mixed_lines(batches, specs)), ("docs", generate.document_lines({t: batches[t] for t in order}, specs, number))):
        lines.write.mode("overwrite").text(f"{args.root}/json_{kind}")
    generate.write_manifest(spark, f"{args.root}/manifest", rows=rows, multi_rows=multi, changes=n, mix=args.mix, fact=fact)
    print(f"changes: {count_label(n)} ({n_upd} updates, {n_del} deletes, {n_ins} inserts)")


def apply_batch(base: ManifestTable, path: str, lines: str, method: str, changes: int | None = None) -> tuple[report.Timer, DataFrame, DataFrame]:
    """Apply JSON changes to a clone of a table by one method: the times of load (parse and write) and apply, the current rows, the batch."""
    spark, spec, timer = base.spark, base.spec, report.Timer()
    if method == "upsert":
        target = JournalTable(spark, path, spec)
        target.journal.destroy()
        base.clone(f"{path}/journal")
    else:
        ManifestTable(spark, path, spec).destroy()
        target = base.clone(path)
    load = ingest.read_records(spark, lines, spec)
    stage = f"{path}_delta"
    with timer.step("load"):  # rejects stop the batch before it is published or applied
        rows, check = load.counted(changes)
        if method == "upsert":
            target.append(rows, check)
        else:
            rows.write.mode("overwrite").parquet(stage)
            check()
    batch = load.good if method == "upsert" else spark.read.schema(load.good.schema).parquet(stage)
    with timer.step("apply"):
        if method == "swap":
            swap.apply_swap(target, batch, stage=False)
        elif method == "merge":
            merge.apply_merge(target, batch, stage=False)
    current = target.current() if method == "upsert" else swap.current(target) if method == "swap" else merge.current(target)
    return timer, current, batch


def cmd_run(args) -> None:
    """Apply the fact table's batch by one method or all, compare their current rows, report times."""
    spark, facts = args.spark, generate.read_manifest(args.spark, f"{args.root}/manifest")
    name, n = facts["fact"], facts["changes"]
    spec, base = _specs(args)[name], _table(args, facts["fact"], "base")
    validate.preflight({name: (base, facts["rows"])})
    runs, currents = [], {}
    for run in range(1, args.runs + 1):
        for method in args.method.split(",") if args.method != "all" else METHODS:
            timer, currents[method], batch = apply_batch(base, f"{args.root}/{name}_{method}_{run}", f"{args.root}/json_records", method, n)
            runs.append((run, method, timer.ms["load"], timer.ms["apply"], n))
            print(f"run {run}, {method}: load {timer.ms['load']:.0f} ms, apply {timer.ms['apply']:.0f} ms, {rate(n, sum(timer.ms.values()))}")
        if not args.no_check:
            first = 1 if args.full_check else validate.check_from(base.read(), batch, facts["rows"]).first()[0] or 1
            columns = [c for c in spec.columns if c not in ("op_code", "batch_id")]
            rows, checksum = validate.expect_equal(validate.compare(currents, columns, first), validate.expected_rows(facts["rows"], first, n, facts["mix"]))
            print(f"checked: {rows} current rows from isn {first}, checksum {checksum}")
    print(report.markdown(report.averages(report.frame(spark, runs))))


def cmd_fanout(args) -> None:
    """Parse the batch of all tables once and merge it into each, at each of the given degrees of parallelism."""
    spark, facts, specs = args.spark, generate.read_manifest(args.spark, f"{args.root}/manifest"), _specs(args)
    steps, totals = [], []
    for parallel in [int(x) for x in str(args.parallel).split(",")]:
        for run in range(1, args.runs + 1):
            tables = {}
            for t in specs:
                ManifestTable(spark, f"{args.root}/{t}_fan", specs[t]).destroy()
                tables[t] = _table(args, t, "base").clone(f"{args.root}/{t}_fan")
            timer, stage = report.Timer(), f"{args.root}/stage_{args.shape}"
            _delete(args, stage)
            with timer.step("parse"):
                kind = FanOut.from_records if args.shape == "mixed" else FanOut.from_documents
                fan = kind(spark, f"{args.root}/json_{args.shape}", specs, stage)
                fan.check()  # rejects stop the batch before any table changes
            with timer.step("apply"):
                done = fan.apply(lambda t, rows: merge.apply_merge(tables[t], rows, stage=False), parallel)
            if not args.no_check:
                for t in specs:
                    source = fan.source(t)
                    validate.expect_batch(tables[t].read(), source, (facts["rows"] if specs[t].fact else facts["multi_rows"]) + split_mix(facts["changes"], facts["mix"])[2], source.count())
            print(f"{parallel} at a time, run {run}: parse {timer.ms['parse']:.0f} ms, merge {timer.ms['apply']:.0f} ms")
            totals.append((run, f"{parallel} at a time", timer.ms["parse"], timer.ms["apply"], facts["changes"] * len(specs)))
            steps += [(run, parallel, d.table, d.ms) for d in done]
    print(report.markdown(report.averages(report.frame(spark, totals))))
    print(report.markdown(report.by_parallel(report.frame(spark, steps, report.STEPS))))


def _delete(args, path: str) -> None:
    p = args.spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(args.spark._jsc.hadoopConfiguration()).delete(p, True)


def cmd_clean(args) -> None:
    """Remove what runs made; with --all also base tables, files and manifest."""
    fs = args.spark._jvm.org.apache.hadoop.fs.Path(args.root).getFileSystem(args.spark._jsc.hadoopConfiguration())
    root = args.spark._jvm.org.apache.hadoop.fs.Path(args.root)
    for s in fs.listStatus(root) if fs.exists(root) else []:
        name = s.getPath().getName()
        if args.all or not (name.endswith("_base") or name.startswith("json_") or name == "manifest"):
            fs.delete(s.getPath(), True)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="weir", description=__doc__)
    p.add_argument("--root", required=True, help="folder of all tables and files")
    p.add_argument("--tables", help="a specification file instead of the ten tables")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate", help=cmd_generate.__doc__)
    g.add_argument("--rows", default="10M"), g.add_argument("--multi-rows", default="1M"), g.add_argument("--changes", default="100K"), g.add_argument("--mix", default="50:0:50"), g.add_argument("--hot-percent", type=int, default=5), g.add_argument("--force", action="store_true")
    r = sub.add_parser("run", help=cmd_run.__doc__)
    r.add_argument("--method", default="all"), r.add_argument("--runs", type=int, default=1), r.add_argument("--full-check", action="store_true"), r.add_argument("--no-check", action="store_true")
    f = sub.add_parser("fanout", help=cmd_fanout.__doc__)
    f.add_argument("shape", choices=("mixed", "docs")), f.add_argument("--parallel", default="10", help="tables at a time; several, as 10,5,1, are compared"), f.add_argument("--runs", type=int, default=1), f.add_argument("--no-check", action="store_true")
    c = sub.add_parser("clean", help=cmd_clean.__doc__)
    c.add_argument("--all", action="store_true")
    args = p.parse_args(argv)
    args.spark = spark or session()
    if not args.spark.conf.get("spark.checkpoint.dir", None):
        args.spark.conf.set("spark.checkpoint.dir", f"{args.root}/work")
    {"generate": cmd_generate, "run": cmd_run, "fanout": cmd_fanout, "clean": cmd_clean}[args.command](args)


if __name__ == "__main__":
    main(sys.argv[1:])
