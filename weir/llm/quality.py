"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text is a bag of terms: its byte pairs, and how often its words, pairs of neighbouring words and lines occur: a term for each power
of two, weighted by the share of what occurs so often. No term is made for a certain kind of text. A latent-semantic space is fitted on a bounded sample of labelled rows (`SAMPLE` of each class, those
with the smallest hash of their id): weights by inverse document frequency, then the leading eigenvectors of the term Gram
matrix. The sample's vectors (at most 2 x SAMPLE rows of RANK floats) are broadcast; every document's vector is compared with all
of them by exact blocked cosine products, and its nearest NEIGHBOURS vote with weights that fall with the distance. A vote also
carries how many labelled rows of its class the sample stands for.

Only the text is an input of a score. Defined results: a null text counts as empty; a text without terms gets the share of
class 1 among labelled rows, and so does every text where only one class or nothing is labelled (0.5 where nothing is); null labels
are no labels; repeated rows get the same score; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, text_of
from .shingles import mixed, word_sequence

SAMPLE, PAIRS, RANK, NEIGHBOURS, SHARPNESS, REPEAT_WEIGHT = 3000, 1536, 64, 25, 8.0, 1.0
THRESHOLD, FOLDS, HELD_OUT = 0.7, 4, 2
_OFTEN, _KINDS = 20, 3


def _spectrum(counts: Iterable[int]):
    """Of what occurs 1, 2 to 3, 4 to 7, ... times: the share of all."""
    import numpy as np

    n = np.asarray(counts if isinstance(counts, np.ndarray) else list(counts), np.int64)
    return np.bincount(np.minimum(np.log2(n).astype(np.int64), _OFTEN - 1), n, _OFTEN) / max(1, n.sum())


def terms(text: bytes):
    """Hashed byte-pair weights and repetition terms of one text."""
    import numpy as np

    out = np.zeros(PAIRS + _OFTEN * _KINDS, np.float32)
    if not text:
        return out
    counts = np.zeros(65536, np.int64)
    for s in range(0, len(text), 1 << 22):
        b = np.frombuffer(text, np.uint8, min(len(text) - s, (1 << 22) + 1), s)
        counts += np.bincount((b[:-1].astype(np.int32) << 8) | b[1:], minlength=65536)
    hit = np.flatnonzero(counts)
    np.add.at(out, ((hit * 2654435761) >> 7) % PAIRS, np.log1p(counts[hit]))
    words = word_sequence(text)
    pairs = mixed(words[:-1]) + words[1:]
    often = [np.unique(words, return_counts=True)[1], np.unique(pairs, return_counts=True)[1], Counter(text.split(b"\n")).values()]
    for k, n in enumerate(often):
        out[PAIRS + k * _OFTEN : PAIRS + (k + 1) * _OFTEN] = _spectrum(n)
    return out


class Space:
    """A fitted latent-semantic space with its labelled vectors."""

    def __init__(self, x, labels, stands_for, rank: int = RANK):
        import numpy as np

        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.05
        w = self._weighted(x)
        values, vectors = np.linalg.eigh(w.T @ w)
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :rank]).astype(np.float32)
        self.vectors = self._unit(w @ self.basis)
        self.labels = np.asarray(labels, np.float32)
        self.votes = np.where(self.labels == 1, stands_for[1], stands_for[0]).astype(np.float32)
        self.prior = float((self.votes * self.labels).sum() / self.votes.sum())

    def _weighted(self, x):
        import numpy as np

        def unit(m):
            return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)

        w = x * self.idf
        return np.hstack([unit(w[:, :PAIRS]), REPEAT_WEIGHT * unit(x[:, PAIRS:])])

    @staticmethod
    def _unit(v):
        import numpy as np

        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, x, neighbours: int = NEIGHBOURS):
        import numpy as np

        near = self._unit(self._weighted(x) @ self.basis) @ self.vectors.T
        k = min(neighbours, near.shape[1])
        at = np.argpartition(near, -k, axis=1)[:, -k:]
        best = np.take_along_axis(near, at, 1)
        # relative to the nearest, so that an odd text's few likes outvote the many that are a little further
        weight = np.exp(-SHARPNESS * (1 - best) / np.maximum(1 - best.max(1, keepdims=True), 0.02)) * self.votes[at]
        got = (weight * self.labels[at]).sum(1) / np.maximum(weight.sum(1), 1e-30)
        return np.where(np.abs(x).sum(1) > 0, got, self.prior)


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample: int = SAMPLE):
    """A Space from at most `sample` labelled rows of each class for which `train` holds; a constant if a class is missing."""
    import numpy as np

    marked = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").where(train)
    held = {r["_y"]: r["count"] for r in marked.groupBy("_y").count().collect()}
    if len(held) < 2:
        return float(next(iter(held), 0.5))
    few = [marked.where(F.col("_y") == y).dropDuplicates(["_id"]).orderBy(F.xxhash64("_id"), "_id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(few[0].unionByName(few[1]))
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(chosen, "_id").select("_text", "_y")

    def each(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([terms(t).astype(np.float16).tobytes() for t in b.column(0).cast(pa.binary()).to_pylist()], pa.binary()), b.column(1)], ["x", "y"])

    got = texts.mapInArrow(each, "x binary, y int").toArrow()
    y = np.array(got.column("y").to_pylist(), np.int64)
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.5
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(len(y), -1).astype(np.float32)
    order = np.lexsort(tuple(x.T[:8]) + (y,))  # a task order must not change the sums' rounding
    return Space(x[order], y[order], {c: held[c] / max(1, int((y == c).sum())) for c in (0, 1)})


def score(docs: DataFrame, space, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The id, the columns of `keep` and the score (0 to 1, in column `name`) of every row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(space if isinstance(space, float) else vars(space))  # plain arrays: workers need not have this module

    def each(batches):
        import numpy as np
        import pyarrow as pa

        constant = sent.value if isinstance(sent.value, float) else None
        if constant is None:
            model = Space.__new__(Space)
            model.__dict__.update(sent.value)
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()
            if constant is not None:
                got = np.full(len(texts), constant)
            else:
                got = model.scores(np.stack([terms(t) for t in texts])) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.clip(got, 0, 1).astype(np.float64))], [*b.schema.names[:-1], name])

    columns = list(dict.fromkeys([id_col, *(keep or [])]))
    rows = docs.select(*columns, text_of(text_col).alias("_w_text"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns) + f", `{name}` double"
    return rows.mapInArrow(each, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The id, held_out, score, predicted; labels of held-out ids are not learnt from."""
    space = fit(docs, labels, fold("_id", FOLDS) != HELD_OUT, id_col, text_col)
    got = score(docs, space, id_col, text_col)
    return got.select(id_col, (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
