"""Small tables with the cases that every operator must handle."""

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, count int, _text string"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9))) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    long = words(3000, 1)
    passage = words(90, 2)
    near = words(300, 3).split()
    return [
        (1, None), (2, ""), (3, ""), (4, "one"), (5, "One"), (6, "two words"), (7, "two words"), (7, "two words"), (8, " \t\n\v\f\r "), (9, "é ü 🎉 ▁   x"), (10, "É İ K"),
        (11, long), (12, long), (13, long + " tail"), (14, words(60, 4) + " " + passage + " " + words(50, 5)), (15, passage + " " + words(70, 6)), (16, "ab " * 900), (17, "a" * 5000),
        (18, " ".join(near)), (19, " ".join(near[:150] + ["changed"] + near[151:])), (None, "no id"), (None, None), (20, "<s>[INST] </s> [/INST]"), (21, words(5000, 7)), (22, "x" * 4096), (23, "x" * 4097), (24, "line\n\nline\n"),
    ]


def documents(spark: SparkSession, rows=None) -> DataFrame:
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None, len(t or ""), "clash", k, "other") for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
