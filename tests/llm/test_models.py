import math
import random
import zlib
from collections import Counter

import numpy as np
from cases import documents, empty, texts, words

from weir.llm import ann, lm, quality


def test_lm_base_and_counts(spark):
    got = lm.score_texts(documents(spark)).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, t in texts() if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for i, t in texts())
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 1e-9 for r in got)


def test_lm_scores_held_out_texts_above_base(spark):
    got = [r for r in lm.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out and r.n_tokens > 1]
    assert len(got) > 50 and sum(r.score for r in got) > 0.99 * sum(r.base_score for r in got)  # log10: closer to zero is better
    assert np.mean([r.score > r.base_score for r in got]) > 0.85


def test_lm_learns_order(spark):
    r = random.Random(3)
    rows = []
    for i in range(400):
        w = r.choice("abcdefgh")
        out = []
        for _ in range(60):
            out.append(w)
            w = chr((ord(w) - 97 + (1 if r.random() < 0.9 else r.randint(2, 7))) % 8 + 97)
        rows.append((i, " ".join(out)))
    got = [x for x in lm.score_texts(documents(spark, rows)).collect() if x.held_out]
    assert sum(x.score for x in got) > 0.75 * sum(x.base_score for x in got)


def test_lm_learns_from_every_triple():
    k = 300
    n = np.where(np.arange(k) == 0, 1e6, 1.0)
    share = np.full(k, 1 / k)
    p = lm.start(k - 2, k - 1, share)
    got = lm.nce(p, np.arange(k), np.arange(k), np.arange(k), n, share, 0.25, 1)
    assert (np.abs(got["C1"] - p["C1"]).max(1) > 0).all() and (np.abs(got["C2"] - p["C2"]).max(1) > 0).all()
    assert lm.visits(n).min() == 1 and lm.visits(n).sum() < 2 * k


def test_lm_is_normalised(spark):
    share = np.array([0.5, 0.2, 0.2, 0.1])
    p = lm.start(2, 3, share)
    z = lm.normalisers(spark, p)
    for b in range(4):
        for a in range(4):
            s = (p["C1"][a] + p["C2"][b]) @ p["R"].T + p["bias"]
            assert abs(np.exp(s - z[b, a]).sum() - 1) < 1e-4


def test_quality(spark):
    good = [(i, words(120, i).replace(" ", ". ", 5)) for i in range(300)]
    bad = [(1000 + i, (words(1, i) + " | ") * 100 if i % 2 else words(80, i).upper().replace(" ", "!! ")) for i in range(120)]
    docs = documents(spark, [*good, *bad, (5000, None), (5001, "")])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (3, None, 1), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 422 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [r for r in got.values() if r.held_out and r.doc_id < 5000]
    assert len(held) > 50 and np.mean([r.predicted == (r.doc_id < 1000) for r in held]) > 0.95
    assert got[5000].score == got[5001].score
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


def test_quality_of_the_test_tables(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    got = quality.classify(read("documents"), read("labels")).where("held_out").join(read("labels").where("quality is not null"), "doc_id").collect()
    good, bad = [r.score for r in got if r.quality], [r.score for r in got if not r.quality]
    assert len(bad) > 100 and np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert np.mean(np.array(good) >= 0.7) > 0.99 and np.mean(np.array(bad) < 0.7) > 0.95


def test_quality_of_repeated_and_tied_texts(spark):
    rows = [(i, words(60, i % 20)) for i in range(200)] + [(i, (words(2, i % 5) + " ") * 40) for i in range(200, 300)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    again = quality.classify(docs.repartition(7), labels.repartition(5)).collect()
    by = {}
    for r in got:
        by.setdefault(dict(rows)[r.doc_id], set()).add(round(r.score, 6))
    assert all(len(s) == 1 for s in by.values())
    assert {r.doc_id: round(r.score, 4) for r in got} == {r.doc_id: round(r.score, 4) for r in again}


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(documents(spark), none).collect()} == {0.5}
    assert quality.classify(empty(spark), none).collect() == []


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[500:900] = x[7]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0]), (9005, [None] + [1.0] * 15), (9006, []), (9007, [float("inf")] * 16), (5, x[5].tolist()), (None, x[5].tolist())]
    v = ann.clean(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert v.count() == 3000
    got = ann.search(v, v.where("_id % 20 = 0")).collect()
    d = x.astype(np.float64)
    hit = n = 0
    for q in range(0, 3000, 20):
        dist = np.sqrt(((d - d[q]) ** 2).sum(1))
        dist[q] = np.inf
        best = np.lexsort((np.arange(3000), dist))[:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and all(abs(r.score - dist[r.vec_id]) < 1e-9 for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hit += len({r.vec_id for r in mine} & set(best.tolist()))
        n += 10
    assert hit / n >= 0.9
    exact = ann.exact_search(v, v.where("_id % 500 = 0"), block=2).collect()
    for q in range(0, 3000, 500):
        dist = np.sqrt(((d - d[q]) ** 2).sum(1))
        dist[q] = np.inf
        assert [r.vec_id for r in sorted((r for r in exact if r.query_id == q), key=lambda r: r.rank)] == np.lexsort((np.arange(3000), dist))[:10].tolist()


def test_queries_alone_in_their_lists(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([c * 1000 + rng.normal(size=(n, 8)) for c, n in ((1, 400), (2, 400), (-9, 1), (7, 2))]).astype(np.float32)
    v = ann.clean(spark.createDataFrame([(i, r.tolist(), "clash", 1) for i, r in enumerate(x)], "vec_id long, embedding array<float>, _q string, _list int"))
    got = ann.search(v, v.where("_id >= 795"), probes=1).collect()
    assert all(sum(r.query_id == q for r in got) == 10 for q in range(795, 803))


def test_few_vectors(spark):
    v = ann.clean(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0])], "vec_id long, embedding array<float>"))
    assert [(r.query_id, r.vec_id, r.score) for r in ann.search(v, v.where("_id = 0")).collect()] == [(0, 1, 1.0)]
    none = ann.clean(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert ann.search(none, none).collect() == []
