import corpus_pipeline
from cases import documents, empty, words


def build(tmp_path, docs, labels):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_planted_cases(spark, tmp_path):
    passage = words(80, 50)
    good = [(i, words(150, i)) for i in range(200)]
    bad = [(1000 + i, (words(1, i) + " | ") * 100) for i in range(60)]
    near = words(400, 77).split()
    more = [(2000, good[3][1]), (2001, " ".join(near)), (2002, " ".join(near[:100] + ["other"] + near[101:])), (2003, words(90, 60) + " " + passage + " " + words(90, 61)), (2004, words(90, 62) + " " + passage)]
    docs = documents(spark, [*good, *bad, *more]).select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int")
    sf = build(tmp_path, docs, labels)
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert not ids[0] & set(range(1000, 1060)) and len(ids[0] & set(range(200))) >= 195
    assert ids[0] - ids[1] == ({3} & ids[0])
    assert ids[1] - ids[2] == {2002}
    texts = {r.doc_id: r.text for r in kept[3].collect()}
    assert passage not in texts[2003] and passage not in texts[2004] and texts[5] == words(150, 5)
    assert ids[4] == ids[3] == ids[2]
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in kept[:4])
    run = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in run.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in kept[4].collect())


def test_empty_tables(spark, tmp_path):
    sf = build(tmp_path, empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_nulls_and_ties_pass(spark, tmp_path):
    sf = build(tmp_path, documents(spark), spark.createDataFrame([(1, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_repeated_rows_leave_one(spark, tmp_path):
    rows = [(1, words(200, 1)), (1, words(200, 1)), (2, words(200, 2)), (3, ""), (3, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.simhash_near_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in near) == ["1", "2", "3", "3", "None"]
    exact = corpus_pipeline.exact_dedup_stage(spark, docs, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in exact) == ["1", "2", "3"]


def test_clashing_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    own = ("_w_score", "_w_row", "_w_n", "_w_k1", "_w_k2", "_w_starts", "_w_text", "_id", "_n", "_g", "_root")
    passage = words(80, 50)
    rows = [(i, words(120, i)) for i in range(30)] + [(40, words(120, 3)), (41, words(60, 90) + " " + passage), (42, passage + " " + words(60, 91))]
    plain = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs = plain.withColumns({c: F.lit(c) for c in own})
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    sf = build(tmp_path, plain, labels)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs.write.parquet(str(tmp_path / f"in_{name}"))
        docs = stage(spark, spark.read.parquet(str(tmp_path / f"in_{name}")), sf)
        assert docs.columns == [*plain.columns, *own], name
        assert all(r[c] == c for r in docs.collect() for c in own)
    assert docs.count() == 32 and not docs.where(F.contains("text", F.lit(passage))).count()
