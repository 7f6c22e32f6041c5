"""Plans: month ranges of keys, eligibility of a merge, what a physical plan holds."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..sources.spec import TableSpec


@dataclass(frozen=True)
class MonthRange:
    part: int
    first_day: dt.date
    next_month: dt.date
    first_isn: int
    last_isn: int


def partition_plan(rows: int, start: str = "2023-01-01", span_days: int = 1096) -> list[MonthRange]:
    """The key range of each month: key k is created on day (k - 1) * span_days // rows after start."""
    begin = dt.date.fromisoformat(start)
    month, out = begin.replace(day=1), []
    while (month - begin).days < span_days:
        after = (month + dt.timedelta(days=32)).replace(day=1)
        lo, hi = max(0, (month - begin).days), min(span_days, (after - begin).days)
        first, last = -(-lo * rows // span_days) + 1, -(-hi * rows // span_days)
        if first <= last:
            out.append(MonthRange(month.year * 100 + month.month, month, after, first, last))
        month = after
    return out


def merge_problems(spec: TableSpec, delta: DataFrame) -> list[str]:
    """Why a keyed merge can't take all columns as they are: no key, missing or additional columns, other types."""
    have, want = {f.name: f.dataType for f in delta.schema}, {f.name: f.dataType for f in spec.flat_schema(False)}
    out = [] if spec.key in want else [f"the key {spec.key} is no column"]
    out += [f"{c} is missing" for c in want if c not in have] + [f"{c} is unknown" for c in have if c not in want]
    return out + [f"{c} is {have[c].simpleString()}, not {want[c].simpleString()}" for c in want if c in have and have[c] != want[c]]


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def nodes(df: DataFrame) -> list[str]:
    """The operators of the physical plan, from its tree."""
    tree = plan_text(df).split("\n\n")[0]
    return [line.split("(")[0].strip(" :+-*|") for line in tree.splitlines() if "(" in line and "Physical Plan" not in line]


def expect_nodes(df: DataFrame, without: tuple[str, ...] = (), having: tuple[str, ...] = ()) -> None:
    found = " ".join(nodes(df))
    bad = [n for n in without if n in found] + [f"no {n}" for n in having if n not in found]
    if bad:
        raise AssertionError(f"physical plan: {bad} in {found}")


def write_bucketed(df: DataFrame, name: str, buckets: int, key: str = "isn") -> None:
    """A catalog table whose buckets join on the key without an exchange."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)


def analyze(df_table: str, spark) -> None:
    spark.sql(f"ANALYZE TABLE {df_table} COMPUTE STATISTICS FOR ALL COLUMNS")
