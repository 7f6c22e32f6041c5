import random

from cases import documents, empty, texts, words
from pyspark.sql import Row
from xxhash import xxh64_intdigest

from weir.llm import simhash
from weir.llm.components import components


def fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_documents_against_brute_force(spark):
    got = simhash.near_duplicates(documents(spark)).collect()
    rows = texts()
    assert len(got) == len(rows)
    fp = {t: fingerprint(t) for _, t in rows}
    root = roots(set(fp.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    want = {}
    for i, t in rows:
        if i is not None:
            want[root[fp[t]]] = min(want.get(root[fp[t]], i), i)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == sorted((str(i), f"{fp[t]:016x}", want.get(root[fp[t]])) for i, t in rows)


def test_links_in_dense_and_sparse_buckets(spark):
    r = random.Random(1)
    fps = {r.getrandbits(64) for _ in range(60)}
    for x in list(fps)[:20]:
        for _ in range(12):
            fps.add(x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))))
    signed = {x - (1 << 64) if x >> 63 else x for x in fps}
    df = spark.createDataFrame([Row(_fp=x) for x in signed])
    for limit in (0, 1, 2):
        want = roots(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= limit)
        for cap in (1, 3, 1000):
            got = {e.u: e.v for e in components(simhash.links(df, limit, cap)).collect()}
            assert {n: got.get(n, n) for n in signed} == want, (limit, cap)


def test_long_texts_are_sliced(monkeypatch):
    import weir.llm.simhash as m

    text = words(4000, 9).encode()
    whole = [int(x) for h in m.shingle_hashes(text) for x in h]
    real = m.word_slices
    monkeypatch.setattr(m, "word_slices", lambda t: real(t, 500))
    assert [int(x) for h in m.shingle_hashes(text) for x in h] == whole


def dropped(docs, id_col="doc_id", **more):
    """The ids of the rows that near_copies doesn't keep; all others stay."""
    rows, number = simhash.numbered(docs, id_col)
    got = simhash.near_copies(rows, number, id_col, **more)
    return sorted(r[id_col] for r in rows.join(got.where("not kept"), number).collect())


def test_near_copies(spark):
    base = words(400, 11).split()
    rows = [(100, " ".join(base)), (101, " ".join(base[:200] + ["other"] + base[201:])), (102, words(400, 12)), (103, ""), (104, None), (105, words(400, 13)), (90, " ".join(base[:399] + ["end"]))]
    assert dropped(documents(spark, rows)) == [100, 101]
    clash = documents(spark, rows).withColumnRenamed("lang", "_w_n").withColumnRenamed("source", "_n")
    assert dropped(clash) == [100, 101]


def test_near_copies_with_ids_that_name_no_row(spark):
    base = words(400, 11).split()
    near = " ".join(base[:200] + ["other"] + base[201:])
    rows = [(5, " ".join(base)), (5, near), (None, near), (None, None), (7, words(300, 14)), (7, words(300, 14))]
    docs = documents(spark, rows)
    rows, number = simhash.numbered(docs, "doc_id")
    got = rows.join(simhash.near_copies(rows, number).where("not kept").select(number), number, "left_anti").collect()
    assert sorted((str(r.doc_id), r.text is None) for r in got) == [("5", False), ("7", False), ("None", True)]
    named = docs.withColumn("doc_id", docs.doc_id.cast("string"))
    rows, number = simhash.numbered(named, "doc_id")
    assert rows.join(simhash.near_copies(rows, number).where("not kept").select(number), number, "left_anti").count() == 3


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []
    assert dropped(empty(spark)) == []


def test_near_copies_are_of_sets(spark):
    line = words(24, 500)
    rows = [(1, words(300, 501) + f" {line}" * 20), (2, words(300, 502) + f" {line}" * 20), (3, words(300, 503) + f" {line}" * 2), (4, words(300, 503) + f" {line}" * 12)]
    assert dropped(documents(spark, rows)) == [4]


def edited(text, n, seed):
    """n words replaced, 40 apart: five shingles each."""
    w = text.split()
    for i in range(n):
        w[20 + 40 * i] = f"z{seed}z{i}"
    return " ".join(w)


def test_near_copies_at_the_limit(spark):
    base = [words(404, 700 + i) for i in range(60)]  # 400 shingles; 8 edits leave 360 of 440 alike (0.818), 9 edits 355 of 445 (0.798)
    rows = [(i, t) for i, t in enumerate(base)] + [(1000 + i, edited(t, 8 + i % 2, i)) for i, t in enumerate(base)]
    assert dropped(documents(spark, rows)) == [1000 + i for i in range(0, 60, 2)]


def alike(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.encode().lower().split(), b.encode().lower().split()))
    return len(a & b) >= 0.8 * len(a | b) - 1e-9


def drifting(n, seed):
    """Texts of a chain of edits, some shorter or longer: neighbours are alike, distant ones aren't."""
    r = random.Random(seed)
    w, out = words(r.randint(8, 120), seed).split(), []
    for i in range(n):
        out.append(" ".join(w))
        w = list(w)
        w[r.randrange(len(w))] = f"edit{seed}x{i}"
        if r.random() < 0.2:
            w += [f"more{i}"] * r.randint(1, 3)
    return out


def test_near_copies_against_brute_force(spark):
    line = words(12, 900)
    some = [t for k in range(12) for t in drifting(9, k)] + [words(n % 9 + 1, 950 + n) for n in range(30)] + [words(30, 40 + k) + " " + line for k in range(20)] + ["a b c d e", "A b  c D e", "a b c", "a b c d"]
    rows = list(enumerate(some))
    root = roots(range(len(some)), lambda a, b: bool(some[a]) and alike(some[a], some[b]))
    want = [i for i in range(len(some)) if root[i] != i]
    assert dropped(documents(spark, rows)) == want and len(want) > 40
    assert dropped(documents(spark, rows).repartition(11)) == want


def test_near_copies_of_the_test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts_ = sorted((r.doc_id, r.text or "") for r in docs.collect())
    sets = {}
    for i, t in texts_:
        w = t.encode().lower().split()
        if w:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = roots(sorted(sets), lambda a, b: min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)
    assert dropped(docs) == [i for i in sorted(sets) if root[i] != i]


def test_large_buckets_are_whole(spark):
    got = simhash._all_pairs(buckets(spark, [(n, 1, 10, 0, n) for n in range(200)]), 0.8)
    assert got.count() == got.distinct().count() == 200 * 199 // 2


def buckets(spark, rows):
    return spark.createDataFrame([(*r, [0, 0]) for r in rows], "_n long, _g long, _size int, _at int, _root long, _mark array<long>")


def test_members_of_a_component_are_all_compared(spark):
    # 2 is similar to 1 but not to 0, and meets both in one bucket only
    got = simhash._all_pairs(buckets(spark, [(0, 9, 10, 0, 0), (1, 9, 10, 0, 0), (2, 9, 10, 0, 2)]), 0.8)
    assert {(r.u, r.v) for r in got.collect()} == {(0, 2), (1, 2)}
