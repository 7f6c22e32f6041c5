"""Table specifications: one description of a table from which its JSON shape, its flat columns and its generator derive."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from importlib.resources import files

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The envelope of every change record.
ENVELOPE = (("isn", "BIGINT"), ("op_code", "CHAR(1)"), ("change_ts", "TIMESTAMP"), ("batch_id", "INT"), ("created_date", "DATE"))
HEADER = (("isn", "isn"), ("op", "op_code"), ("ts", "change_ts"), ("batch", "batch_id"))
OPS = ("I", "U", "D")


def spark_type(name: str) -> T.DataType:
    m = re.fullmatch(r"(\w+)(?:\((\d+)(?:,\s*(\d+))?\))?", name.strip().upper())
    if not m:
        raise ValueError(f"not a type: {name}")
    kind, a, b = m.groups()
    if kind in ("NUMERIC", "DECIMAL"):
        return T.DecimalType(int(a or 38), int(b or 0))
    plain = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(), "BOOLEAN": T.BooleanType(), "CHAR": T.StringType(), "VARCHAR": T.StringType()}
    if kind not in plain:
        raise ValueError(f"not a type: {name}")
    return plain[kind]


def text_limit(name: str) -> int | None:
    m = re.fullmatch(r"(?:VAR)?CHAR\((\d+)\)", name.strip().upper())
    return int(m[1]) if m else None


@dataclass(frozen=True)
class Field:
    path: str
    column: str
    type: str
    generator: str = ""

    @property
    def steps(self) -> list[str]:
        return self.path.split(".")

    @property
    def percent_null(self) -> int:
        return int(self.generator.partition("?")[2] or 0)

    @property
    def container(self) -> str:
        """The group or occurrence that the field is in: optional fields of one container are absent together."""
        return self.path.rpartition(".")[0] or self.path


@dataclass(frozen=True)
class TableSpec:
    name: str
    number: int = 0
    description: str = ""
    fact: bool = False
    fields: tuple[Field, ...] = field(default_factory=tuple)
    key: str = "isn"

    @property
    def columns(self) -> list[str]:
        return [c for c, _ in ENVELOPE] + [f.column for f in self.fields]

    @property
    def types(self) -> dict[str, str]:
        return dict(ENVELOPE) | {f.column: f.type for f in self.fields}

    def flat_schema(self, strict: bool = True) -> T.StructType:
        """The columns of the table; only the envelope is NOT NULL, and for loads (strict=False) nothing is."""
        return T.StructType([T.StructField(c, spark_type(t), not (strict and c in dict(ENVELOPE))) for c, t in self.types.items()])

    def record_type(self) -> T.StructType:
        """The nested type of the JSON object `rec`: groups are structs, multiple values and periodic groups arrays."""
        tree: dict = {"created": T.DateType()}
        for f in self.fields:
            node = tree
            for s in f.steps[:-1]:
                node = node.setdefault(s, {})
            node[f.steps[-1]] = spark_type(f.type)

        def build(node) -> T.DataType:
            if not isinstance(node, dict):
                return node
            if all(k.isdigit() for k in node):
                return T.ArrayType(build(node["0"] if "0" in node else next(iter(node.values()))))
            return T.StructType([T.StructField(k, build(v)) for k, v in node.items()])

        # occurrences of a periodic group may differ in their fields: the element has all of them
        def merged(node):
            if isinstance(node, dict) and node and all(k.isdigit() for k in node) and all(isinstance(v, dict) for v in node.values()):
                every: dict = {}
                for v in node.values():
                    every |= v
                return {"0": merged(every)}
            return {k: merged(v) for k, v in node.items()} if isinstance(node, dict) else node

        return build(merged(tree))

    def projection(self, header: Column, record: Column) -> list[Column]:
        """The flat columns of a parsed record. Missing keys, nulls, missing groups and short arrays all are NULL."""
        def at(f: Field) -> Column:
            return reduce(lambda c, s: F.get(c, F.lit(int(s))) if s.isdigit() else c.getField(s), f.steps, record)

        return [*(header.getField(k).alias(c) for k, c in HEADER), record.getField("created").alias("created_date"), *(at(f).alias(f.column) for f in self.fields)]

    def nested(self, df_columns: dict[str, Column] | None = None) -> tuple[Column, Column]:
        """The reverse: the structs `hdr` and `rec` of a flat row; what is absent becomes an explicit null."""
        of = (df_columns or {}).get
        col = lambda c: of(c) if of(c) is not None else F.col(c)
        tree: dict = {"created": col("created_date")}
        for f in self.fields:
            node = tree
            for s in f.steps[:-1]:
                node = node.setdefault(s, {})
            node[f.steps[-1]] = col(f.column)

        def build(node) -> Column:
            if not isinstance(node, dict):
                return node
            if all(k.isdigit() for k in node):
                items = [node[k] for k in sorted(node, key=int)]
                if all(isinstance(i, dict) for i in items):  # occurrences may lack fields of others
                    every = list(dict.fromkeys(k for i in items for k in i))
                    items = [{k: i.get(k, F.lit(None)) for k in every} for i in items]
                return F.array(*[build(i) for i in items])
            return F.struct(*[build(v).alias(k) for k, v in node.items()])

        return F.struct(*[col(c).alias(k) for k, c in HEADER]), build(tree)


HEADER_TYPE = T.StructType([T.StructField(k, spark_type(dict(ENVELOPE)[c])) for k, c in HEADER])


def parse_spec(text: str) -> dict[str, TableSpec]:
    """Tables by name, in the order of the text; lines of other kinds and comments are skipped."""
    heads: dict[str, list[str]] = {}
    fields: dict[str, list[Field]] = {}
    for number, line in enumerate(text.splitlines(), 1):
        parts = [p.strip() for p in line.split("|")]
        if parts[0] == "T":
            if len(parts) < 4 or parts[1] in heads:
                raise ValueError(f"line {number}: a table needs a new name, a number and a description")
            heads[parts[1]] = parts
        elif parts[0] == "F":
            if len(parts) < 5 or parts[1] not in heads:
                raise ValueError(f"line {number}: a field needs a known table, a path, a column and a type")
            spark_type(parts[4])
            fields.setdefault(parts[1], []).append(Field(*parts[2:6]))
    return {n: TableSpec(n, int(h[2]), h[3], len(h) > 4 and h[4] == "fact", tuple(fields.get(n, ()))) for n, h in heads.items()}


def catalog() -> dict[str, TableSpec]:
    """The ten tables."""
    return parse_spec(files(__package__).joinpath("tables.txt").read_text())
