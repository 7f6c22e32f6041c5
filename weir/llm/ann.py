"""Approximate nearest neighbours: inverted lists of coarse centroids, product-quantised residuals, asymmetric distance tables,
exact reranking.

The index is fitted on a bounded sample (`SAMPLE` vectors, those with the smallest hash of their id) and covers every vector.
How many lists a query probes is measured: so many that `COVERAGE` of the neighbours that the sample's vectors have in the sample lie
in them. A list is stored as cells of at most about `CELL` vectors, so a list that holds a third of all vectors is many rows, dealt
over tasks; the queries of a list are packed likewise. Queries and cells meet in an equi-join on the list; a met cell is scanned with
the queries' distance tables. What is farther than a radius that the sample gives is left out (the nearest lists' best stay in any
case), the best `rerank` candidates of a query are measured exactly, in double precision, on the original vectors. Only centroids,
codebooks and sample are broadcast; their size is fixed by LISTS, PARTS, CODES and SAMPLE.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part;
rows that repeat an id count once (the smallest vector stays); ties go to the smaller id; fewer candidates than k: all that were
found; no vectors: no rows; other columns are not looked at. A query whose lists hold fewer than k candidates is searched exactly.

`exact_search` is the exact way: blocks of queries against all vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLE, LISTS, PARTS, CODES, CELL = 16384, 1024, 16, 256, 4096
COVERAGE, RERANK, K, PACK, SURE, BLOCK = 0.97, 400, 10, 64, 4, 1024


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """_id, _v of the vectors that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<float>").alias("_v")).where("_id is not null and size(_v) > 0")
    v = v.where("forall(_v, x -> x is not null and not isnan(x) and abs(x) < float('inf')) and exists(_v, x -> x <> 0)")
    size = v.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("_v") == (size[0] if size else 0)).groupBy("_id").agg(F.min("_v").alias("_v"))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([squared(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(c))
        total = np.zeros(c.shape, np.float64)
        np.add.at(total, near, x)
        c[n > 0] = (total[n > 0] / n[n > 0, None]).astype(x.dtype)
    return c


def fit(sample: np.ndarray, n_rows: int, lists: int = LISTS, parts: int = PARTS, codes: int = CODES) -> dict:
    """Coarse centroids and the residuals' codebooks."""
    d = sample.shape[1]
    parts = max(p for p in range(1, min(parts, d) + 1) if d % p == 0)
    coarse = kmeans(sample, max(1, min(lists, int(2 * n_rows**0.5), len(sample) // 8)), 8, 1)
    near = np.concatenate([squared(sample[i : i + 4096], coarse).argmin(1) for i in range(0, len(sample), 4096)])
    rest = (sample - coarse[near]).reshape(len(sample), parts, -1)
    books = [kmeans(np.ascontiguousarray(rest[:, p]), codes, 6, 2 + p) for p in range(parts)]
    # the lists, in order of distance, in which the sample's neighbours lie: what share of them how many lists cover
    some = np.unique(sample, axis=0)
    asked = some[np.linspace(0, len(some) - 1, min(512, len(some))).astype(int)]
    d = squared(asked, some)
    close = np.argsort(d, 1)[:, 1 : K + 1]
    place = squared(asked, coarse).argsort(1).argsort(1)
    of = np.concatenate([squared(some[i : i + 4096], coarse).argmin(1) for i in range(0, len(some), 4096)])
    ranks = np.take_along_axis(place, of[close], 1).ravel() if close.size else np.zeros(1)
    probes = int(np.quantile(ranks, COVERAGE)) + 1
    return {"coarse": coarse, "books": books, "parts": parts, "probes": probes, "sample": some, "rank": max(K, int(2 * RERANK * len(sample) / max(1, n_rows)))}


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float32)


def encode(vectors: DataFrame, index) -> DataFrame:
    """_id, _list, _code of every vector."""

    def each(batches):
        import pyarrow as pa

        coarse, books, parts = index.value["coarse"], index.value["books"], index.value["parts"]
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            near = squared(x, coarse).argmin(1)
            rest = (x - coarse[near]).reshape(len(x), parts, -1)
            code = np.stack([squared(rest[:, p], books[p]).argmin(1) for p in range(parts)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near, pa.int32()), pa.array([r.tobytes() for r in code], pa.binary())], ["_id", "_list", "_code"])

    return vectors.mapInArrow(each, "_id long, _list int, _code binary")


def packed(df: DataFrame, most: int, key: str, names: list[str], kinds: list[str]) -> DataFrame:
    """Rows of one _list packed by at most about `most`: _list and a binary column for each name, in order of `key`."""
    sizes = df.groupBy("_list").count().select("_list", F.ceil(F.col("count") / most).cast("int").alias("_n"))
    dealt = df.join(sizes, "_list").withColumn("_part", F.pmod(F.xxhash64(key), F.col("_n")))

    def each(group, t):
        import pyarrow as pa

        order = pa.array(np.argsort(t.column(key).to_numpy()))
        out = {"_list": pa.array([group[0].as_py()], pa.int32())}
        for name, kind in zip(names, kinds):
            c = t.column(name).take(order).combine_chunks()
            if kind == "bytes":
                data = b"".join(c.to_pylist())
            else:
                data = (c.flatten() if pa.types.is_list(c.type) else c).to_numpy(zero_copy_only=False).astype(kind).tobytes()
            out[name] = pa.array([data], pa.binary())
        return pa.table(out)

    return dealt.groupBy("_list", "_part").applyInArrow(each, "_list int, " + ", ".join(f"{n} binary" for n in names))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
    """vectors, queries: _id, _v (see clean). query_id, rank, vec_id, score of each query's k nearest; a vector of the query's
    own id is no candidate."""
    spark = vectors.sparkSession
    vectors = materialize(vectors, "vectors")
    queries = materialize(queries, "queries")
    sample = vectors.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).select("_v").toArrow().column(0)
    out = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], out)
    n_rows = vectors.count()
    index = spark.sparkContext.broadcast(fit(_matrix(sample.combine_chunks()), n_rows))

    def probe(batches):
        import pyarrow as pa

        coarse, near_sample, rank = index.value["coarse"], index.value["sample"], index.value["rank"]
        n = min(probes or index.value["probes"], len(coarse))
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            d = np.sort(squared(x, near_sample), 1)
            radius = d[:, min(rank, d.shape[1] - 1)] * 1.2  # codes blur distances
            near = squared(x, coarse).argsort(1, kind="stable")[:, :n]
            row = pa.array(np.repeat(np.arange(b.num_rows), n))
            order = np.tile(np.arange(n, dtype=np.int32), b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), b.column(0).take(row), b.column(1).take(row), pa.array(np.repeat(radius, n), pa.float32()), pa.array(order)], ["_list", "_q", "_qv", "_radius", "_order"])

    def scan(batches):
        import pyarrow as pa

        coarse, books, parts = index.value["coarse"], index.value["books"], index.value["parts"]
        for b in batches:
            qs, ids, ds = [], [], []
            column = lambda c: b.column(c).to_pylist()
            for l, q, qv, radius, place, a, c in zip(column("_list"), column("_q"), column("_qv"), column("_radius"), column("_order"), column("_ids"), column("_codes")):
                q, radius, place = np.frombuffer(q, "<i8"), np.frombuffer(radius, "<f4"), np.frombuffer(place, "<i4")
                rest = (np.frombuffer(qv, "<f4").reshape(len(q), -1) - coarse[l]).reshape(len(q), parts, -1)
                code, vec = np.frombuffer(c, np.uint8).reshape(-1, parts), np.frombuffer(a, "<i8")
                d = np.zeros((len(q), len(vec)), np.float32)
                for p in range(parts):
                    d += squared(rest[:, p], books[p])[:, code[:, p]]
                d[q[:, None] == vec[None]] = np.inf
                good = d <= radius[:, None]
                sure = np.flatnonzero(place < SURE)
                good[sure[:, None], d[sure].argsort(1, kind="stable")[:, :k]] = True
                good &= np.isfinite(d)
                i, j = np.nonzero(good)
                dist = d[i, j]
                if len(i) > rerank:  # the best of each query are enough; ties go to the smaller id
                    order = np.lexsort((vec[j], dist, i))
                    i, j, dist = i[order], j[order], dist[order]
                    keep = np.arange(len(i)) - np.searchsorted(i, i) < rerank
                    i, j, dist = i[keep], j[keep], dist[keep]
                qs.append(q[i]), ids.append(vec[j]), ds.append(dist)
            if qs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (qs, ids, ds)], ["_q", "_id", "_d"])

    stored = materialize(packed(encode(vectors, index), CELL, "_id", ["_id", "_code"], ["<i8", "bytes"]).withColumnsRenamed({"_id": "_ids", "_code": "_codes"}), "cells")
    asked = queries.mapInArrow(probe, "_list int, _q long, _qv array<float>, _radius float, _order int")
    asked = materialize(packed(asked, PACK, "_q", ["_q", "_qv", "_radius", "_order"], ["<i8", "<f4", "<f4", "<i4"]), "asked")
    met = asked.join(stored, "_list").mapInArrow(scan, "_q long, _id long, _d float")
    first = Window.partitionBy("_q").orderBy("_d", "_id")
    found = met.withColumn("_r", F.row_number().over(first)).where(f"_r <= {rerank}").select("_q", "_id")
    best = materialize(_nearest(found, vectors, queries, k), "nearest")
    short = queries.join(best.groupBy(F.col("query_id").alias("_id")).count().where(f"count >= {k}"), "_id", "left_anti")
    if not short.isEmpty():  # few lists, or few vectors at all
        short = materialize(short, "short")
        best = best.join(short.select(F.col("_id").alias("query_id")), "query_id", "left_anti").unionByName(exact_search(vectors, short, k))
    return best


def _nearest(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest of the candidates _q, _id, measured on the original vectors."""
    exact = found.join(vectors, "_id").join(queries.select(F.col("_id").alias("_q"), F.col("_v").alias("_qv")), "_q")
    exact = exact.select("_q", "_id", F.expr("sqrt(aggregate(zip_with(_v, _qv, (a, b) -> (double(a) - double(b)) * (double(a) - double(b))), 0D, (s, x) -> s + x))").alias("score"))
    last = Window.partitionBy("_q").orderBy("score", "_id")
    return exact.withColumn("rank", F.row_number().over(last)).where(f"rank <= {k}").select(F.col("_q").alias("query_id"), "rank", F.col("_id").alias("vec_id"), "score")


def exact_search(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """What search gives, without an index: all queries, in packs of some `block`, meet every pack of vectors; of each meeting a
    query's k nearest go on. The packs, and no single vectors, are dealt over the tasks."""
    n_v, n_q = vectors.count(), queries.count()
    packs_v, packs_q = max(1, -(-n_v // CELL)), max(1, -(-n_q // block))

    def dealt(df, packs: int, names: list[str]):
        cell = df.select(F.pmod(F.xxhash64("_id"), F.lit(packs)).alias("_p"), "_id", "_v").groupBy("_p").agg(F.collect_list(F.struct("_id", "_v")).alias("_l"))
        return cell.select("_p", F.col("_l._id").alias(names[0]), F.col("_l._v").alias(names[1]))

    v = dealt(vectors, packs_v, ["_vi", "_vv"])
    q = dealt(queries, packs_q, ["_qi", "_qv"]).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(packs_v - 1)).cast("array<bigint>")))

    def each(batches):
        import pyarrow as pa

        for b in batches:
            vi, vv, qi, qv = (b.column(c) for c in ("_vi", "_vv", "_qi", "_qv"))
            for r in range(b.num_rows):
                ids, asked = vi[r].values.to_numpy(), qi[r].values.to_numpy()
                x, y = _matrix(vv[r].values).astype(np.float64), _matrix(qv[r].values).astype(np.float64)
                for i, (a, row) in enumerate(zip(asked, y)):
                    d = np.sqrt(((x - row) ** 2).sum(1))
                    d[ids == a] = np.inf
                    at = np.lexsort((ids, d))[:k] if len(d) <= 4 * k else (c := np.flatnonzero(d <= np.partition(d, k)[k]))[np.lexsort((ids[c], d[c]))][:k]
                    at = at[np.isfinite(d[at])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), a)), pa.array(ids[at])], ["_q", "_id"])

    found = q.join(v, "_p").select("_vi", "_vv", "_qi", "_qv").mapInArrow(each, "_q long, _id long")
    return _nearest(found, vectors, queries, k)
