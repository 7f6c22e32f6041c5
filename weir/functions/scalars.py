"""Scalar functions of rows, counts as people write them, fingerprints."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the modulus of checksums.
MODULUS = 1000000007


def part_of(date: str | Column = "created_date") -> Column:
    """The month partition of a date: year * 100 + month."""
    d = F.col(date) if isinstance(date, str) else date
    return (F.year(d) * 100 + F.month(d)).cast("int")


def hashed(key: str | Column, seed: int, n: int, how: str = "xxhash64") -> Column:
    """A number from 0 to n - 1 that depends on key and seed only. how: `xxhash64`, or `linear` (arithmetic that any SQL engine repeats)."""
    k = F.col(key) if isinstance(key, str) else key
    if how == "xxhash64":
        return F.pmod(F.xxhash64(k, F.lit(seed)), F.lit(n))
    if how == "linear":
        return F.pmod(F.pmod(k * F.lit(48271) + F.lit(seed * 69621), F.lit(2147483647)), F.lit(n))
    raise ValueError(how)


def pick(key: str | Column, seed: int, values: list[str], how: str = "xxhash64") -> Column:
    """One of a list of values."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (hashed(key, seed, len(values), how) + 1).cast("int"))


def parse_count(text: str) -> int:
    """10K, 1M, 1B or a plain number."""
    t = text.strip().upper()
    factor = {"K": 10**3, "M": 10**6, "B": 10**9}.get(t[-1:], 1)
    digits = t[:-1] if factor > 1 else t
    if not digits.isdigit():
        raise ValueError(f"not a number: {text!r} (for example 10M, 1M, 1B)")
    return int(digits) * factor


def count_label(n: int) -> str:
    for unit, name in ((10**9, "B"), (10**6, "M"), (10**3, "K")):
        if n and n % unit == 0:
            return f"{n // unit}{name}"
    return str(n)


def split_mix(n: int, mix: str) -> tuple[int, int, int]:
    """The updates, deletes and inserts of n changes for a mix such as 50:0:50."""
    u, d, i = map(int, mix.split(":"))
    if u + d + i != 100:
        raise ValueError(f"a mix must add up to 100: {mix}")
    return n * u // 100, n * d // 100, n - n * u // 100 - n * d // 100


def rate(rows: int, ms: float) -> str:
    per = rows * 1000 / ms if ms else 0
    return f"{per / 1e6:.2f}M rows/s" if per >= 1e6 else f"{per / 1e3:.0f}K rows/s" if per >= 1e3 else f"{per:.0f} rows/s"


def seconds(ms: float) -> str:
    return f"{ms / 1000:.2f}"


def clock(ms: float) -> str:
    s = round(ms / 1000)
    return f"{s // 3600}h {s % 3600 // 60}m {s % 60}s" if s >= 3600 else f"{s // 60}m {s % 60}s" if s >= 60 else f"{s}s"


def coprime_stride(size: int) -> int:
    """A step that visits all of 0 .. size - 1 once: about the golden part of size, and without a common divisor."""
    step = max(1, int(size * 0.6180339887))
    while gcd(step, size) != 1:
        step += 1
    return step


def as_text(column: str, kind: str) -> Column:
    """A rendering that other engines repeat: fixed decimals, ISO dates, microseconds."""
    c = F.col(column)
    if kind.startswith("timestamp"):
        c = F.date_format(c.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.coalesce(c.cast("string"), F.lit("~"))


def fingerprint(df: DataFrame, columns: list[str] | None = None, how: str = "xxhash64") -> DataFrame:
    """One row: n_rows, checksum (the sum of row hashes modulo MODULUS; 0 for no rows), the same in any row order.

    how: `xxhash64`, or `md5` over rendered columns, which other engines repeat."""
    columns = columns or df.columns
    if how == "xxhash64":
        h = F.pmod(F.xxhash64(*columns), F.lit(MODULUS))
    elif how == "md5":
        row = F.concat_ws("|", *[as_text(c, df.schema[c].dataType.simpleString()) for c in columns])
        h = F.pmod(F.conv(F.substring(F.md5(row.cast("binary")), 1, 15), 16, 10).cast("bigint"), F.lit(MODULUS))
    else:
        raise ValueError(how)
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).cast("bigint").alias("checksum"))


def sysdate() -> Column:
    """The time of the query, the default of columns that say when a row came."""
    return F.localtimestamp()


def version() -> Column:
    """The version of the engine's platform."""
    return F.version()
