"""Text scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are words and one end a text. All training tokens are counted; the vocabulary is a written table that grows with the
corpus and meets the texts by an equi-join on the word. The most frequent words (at most HOT, by a threshold on the counts) travel
to the tasks, so that only the others' tokens are shuffled, summed up by text.

The model predicts a class: one of the TARGETS most frequent words (the end is one where it is frequent enough), or `other`. Its
two context words are among the CONTEXTS most frequent, `other` or `begin`: score(w | a, b) = (C1[a] + C2[b]) . R[w] + bias[w]. It is
trained in numpy on the counts of all (context, class) triples of the training texts: in each round every shard of that table
makes steps of noise-contrastive estimation from the same parameters, on a shuffled walk over all its triples (each is visited in
every round, frequent ones more often, and weights make up for the rest of their counts), and the shards' parameters are averaged
(iterative parameter mixing). The number of shards is fixed and so is what comes to the driver.
Normalisers of all contexts come from batched matrix products, so the classes' probabilities add up to one. A word of class
`other` has the share (c + 0.1) of the mass of all words there, unknown ones being one more word: the text's probability is
normalised over the same events as the base score.

Defined results: null counts as empty; an empty text is its end alone; with no training texts every word is unknown, base and score
are those of certain events (0); rows that repeat are scored each; a null id is in the fold of the empty text; an empty table gives
an empty result; columns other than id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, text_of, word_slices

HOT, LONGEST, CONTEXTS, TARGETS, DIM = 200_000, 64, 510, 2047, 32
SHARDS, ROUNDS, NOISE, STEP, RATE, SMOOTH = 12, 3, 96, 2048, 0.25, 0.1
VISITS, LEAST_STEPS = 0.5, 60
FOLDS, HELD_OUT = 10, 0
END = b""  # no word is empty
_FLUSH = 250_000


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (binary, the end is empty), c: all words of all texts and an end for each."""

    def each(batches):
        import pyarrow as pa

        counts: dict[bytes, int] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                counts[END] = counts.get(END, 0) + 1
                for part in word_slices(t):
                    for w in part:
                        counts[w] = counts.get(w, 0) + 1
                    if len(counts) > _FLUSH:
                        yield out()
                        counts = {}
        if counts:
            yield out()

    return docs.select(text_of(text_col)).mapInArrow(each, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def frequent(vocabulary: DataFrame, most: int = HOT, longest: int = LONGEST) -> list[tuple[bytes, int]]:
    """At most `most` words of at most `longest` bytes, most frequent first; a threshold decides, not a global sort."""
    short = vocabulary.where(f"length(word) <= {longest}").withColumn("_b", F.floor(F.log2("c") * 64).cast("int"))
    held = sorted(((r["_b"], r["count"]) for r in short.groupBy("_b").count().collect()), reverse=True)
    total, least = 0, None
    for b, n in held:
        if total + n > most:
            break
        total, least = total + n, b
    if least is None:
        return []
    got = short.where(F.col("_b") >= least).select("word", "c").toArrow()
    return sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist()), key=lambda x: (-x[1], x[0]))


def _tokens(text: bytes, known: dict, contexts: int, targets: int, rare: dict):
    """For each slice of a text: hot numbers of its tokens (-1: not hot), classes, first and second context before each."""
    last = (contexts + 1, contexts + 1)  # the begin, twice
    slices = list(word_slices(text)) if len(text) > 1 << 22 else [text.lower().split()]
    for k, words in enumerate(slices):
        if k == len(slices) - 1:
            words.append(END)
        hot = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
        for i in np.flatnonzero(hot < 0).tolist():
            rare[words[i]] = rare.get(words[i], 0) + 1
        other = hot < 0
        cls = np.where(other | (hot >= targets), targets, hot)
        ctx = np.where(other | (hot >= contexts), contexts, hot)
        before = np.concatenate([[last[0], last[1]], ctx])
        last = (int(before[-2]), int(before[-1]))
        yield hot, cls, before[1:-1], before[:-2]


def count_triples(docs: DataFrame, words, contexts: int, targets: int, text_col: str = "text") -> DataFrame:
    """code, n of all (second context, first context, class) triples."""
    wide = contexts + 2

    def each(batches):
        import pyarrow as pa

        known = {w: k for k, w in enumerate(words.value)}
        held, size = [], 0

        def out():
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["code", "n"])

        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                for _, cls, first, second in _tokens(t, known, contexts, targets, {}):
                    held.append((second * wide + first) * (targets + 1) + cls)
                    size += len(cls)
                    if size > 3_000_000:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return docs.select(text_of(text_col)).mapInArrow(each, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def start(contexts: int, targets: int, share: np.ndarray, dim: int = DIM) -> dict:
    rng = np.random.default_rng(7)
    shape = {"C1": (contexts + 2, dim), "C2": (contexts + 2, dim), "R": (targets + 1, dim)}
    return {k: rng.normal(0, 0.05, s).astype(np.float32) for k, s in shape.items()} | {"bias": np.log(share).astype(np.float32)}


def visits(n: np.ndarray, share: float = VISITS) -> np.ndarray:
    """How often a pass comes by each triple of count n: once at least, and `share` as many visits as triples go by the counts."""
    return np.maximum(np.rint(n * (share * len(n) / n.sum())), 1).astype(np.int32)


def nce(p: dict, first, second, cls, n, share: np.ndarray, rate: float, seed: int, noise: int = NOISE, step: int = STEP) -> dict:
    """One pass of noise-contrastive steps over all triples; a visit weighs as much as the part of the count n that it stands for."""
    rng = np.random.default_rng(seed)
    p = {k: v.copy() for k, v in p.items()}
    past = {k: np.full(v.shape, 1e-2, np.float32) for k, v in p.items()}
    times = visits(n)
    walk = np.repeat(np.arange(len(n), dtype=np.int32), times)
    even = len(walk) / n.sum()
    walk = np.tile(walk, -(-LEAST_STEPS * step // len(walk)))
    rng.shuffle(walk)
    steady = np.cumsum(share)
    log_kq = np.log(noise * share).astype(np.float32)

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def add(m, at, rows):
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        m[at[first]] += np.add.reduceat(rows[order], first, axis=0)

    for i in range(0, len(walk), step):
        at = walk[i : i + step]
        w, a, b = cls[at], first[at], second[at]
        heavy = (n[at] / times[at] * even).astype(np.float32)
        z = np.minimum(np.searchsorted(steady, rng.random(noise)), len(share) - 1)
        q = p["C1"][a] + p["C2"][b]
        good = heavy * (1 - sigmoid((q * p["R"][w]).sum(1) + p["bias"][w] - log_kq[w]))
        bad = -heavy[:, None] * sigmoid(q @ p["R"][z].T + p["bias"][z] - log_kq[z])
        dq = good[:, None] * p["R"][w] + bad @ p["R"][z]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        add(g["C1"], a, dq)
        add(g["C2"], b, dq)
        add(g["R"], np.concatenate([w, z]), np.concatenate([good[:, None] * q, bad.T @ q]))
        g["bias"] += np.bincount(np.concatenate([w, z]), np.concatenate([good, bad.sum(0)]), len(share)).astype(np.float32)
        for k, v in p.items():
            d = g[k] / len(at)
            past[k] += d * d * len(at)
            v += rate * d * len(at) ** 0.5 / np.sqrt(past[k])
    return p


def train(triples: DataFrame, contexts: int, targets: int, share: np.ndarray, rounds: int = ROUNDS, shards: int = SHARDS) -> dict:
    """The parameters after `rounds` of averaged passes over all triples."""
    spark, wide = triples.sparkSession, contexts + 2
    # every shard gets its part of a frequent triple, so that the shards are alike
    own = F.array(F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int"))
    often = F.col("n") >= shards
    dealt = triples.select("code", F.when(often, F.col("n") / shards).otherwise(F.col("n")).cast("double").alias("n"), F.explode(F.when(often, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(own)).alias("s"))
    dealt = materialize(dealt, "triples")
    p = start(contexts, targets, share)
    names = list(p)
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(p)

        def each(key, t):
            import pyarrow as pa

            code, n = t.column("code").to_numpy(), t.column("n").to_numpy()
            order = np.argsort(code)
            code, n = code[order], n[order]
            cls, ctx = code % (targets + 1), code // (targets + 1)
            got = nce(sent.value, ctx % wide, ctx // wide, cls, n, share, RATE / (1 + turn), 1000 * turn + int(key[0].as_py()))
            return pa.table({"w": [float(n.sum())], **{k: [got[k].astype("<f4").tobytes()] for k in names}})

        got = dealt.groupBy("s").applyInArrow(each, "w double, " + ", ".join(f"`{k}` binary" for k in names)).toArrow()
        w = np.array(got.column("w").to_pylist())
        if not len(w):
            return p
        order = np.argsort(w, kind="stable")
        p = {k: sum(w[i] / w.sum() * np.frombuffer(got.column(k)[int(i)].as_py(), "<f4").astype(np.float64) for i in order).reshape(p[k].shape).astype(np.float32) for k in names}
    return p


def normalisers(spark, p: dict) -> np.ndarray:
    """log of the sum over classes of exp(score) for every pair of contexts, [second, first]; a matrix product a row."""
    sent, wide = spark.sparkContext.broadcast(p), len(p["C1"])

    def each(batches):
        import pyarrow as pa

        m = sent.value
        base = m["C1"] @ m["R"].T + m["bias"]
        for b in batches:
            rows = []
            for second in b.column(0).to_pylist():
                s = base + m["C2"][second] @ m["R"].T
                top = s.max(1)
                rows.append((top + np.log(np.exp(s - top[:, None]).sum(1))).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["id", "z"])

    got = spark.range(wide, numPartitions=8).mapInArrow(each, "id long, z binary").toArrow()
    out = np.zeros((wide, wide), np.float32)
    for i, z in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        out[i] = np.frombuffer(z, "<f4")
    return out


def score_texts(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities) of every text.

    held_out: of the id column `_id`; those texts are not learnt from."""
    spark = docs.sparkSession
    held_out = fold("_id", FOLDS) == HELD_OUT if held_out is None else held_out
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    learnt = rows.where(~held_out)
    vocabulary = materialize(count_words(learnt, "_text"), "vocabulary")
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    hot = frequent(vocabulary)
    targets, contexts = min(TARGETS, len(hot)), min(CONTEXTS, len(hot))
    mass = sum(c for _, c in hot[:targets])
    n_other, v_other = n - mass, v - targets
    words = spark.sparkContext.broadcast([w for w, _ in hot])
    share = np.array([c for _, c in hot[:targets]] + [max(n_other, 0) + SMOOTH * (v_other + 1)], np.float64)
    share /= share.sum()
    p = train(count_triples(learnt, words, contexts, targets, "_text"), contexts, targets, share)
    z = normalisers(spark, p)
    all_mass, other_mass = n + SMOOTH * (v + 1), n_other + SMOOTH * (v_other + 1)
    sent = spark.sparkContext.broadcast(p | {"z": z, "c": np.array([c for _, c in hot], np.float64)})

    def each(batches):
        import pyarrow as pa

        known, m = {w: k for k, w in enumerate(words.value)}, sent.value
        whole = np.append(np.log10((m["c"] + SMOOTH) / all_mass), 0.0)  # the last place is for tokens that aren't hot
        within = np.append(np.log10((m["c"] + SMOOTH) / other_mass), 0.0)
        within[:targets] = 0
        for b in batches:
            tokens, hits, base, score, rare_words, rare_n, offsets = [], [], [], [], [], [], [0]
            for t in b.column(1).cast(pa.binary()).to_pylist():
                rare: dict[bytes, int] = {}
                k = s = l = 0
                h = 0
                for hot_no, cls, first, second in _tokens(t, known, contexts, targets, rare):
                    k += len(cls)
                    h += int((hot_no >= 0).sum())
                    s += whole[hot_no].sum()
                    for i in range(0, len(cls), 65536):
                        a, d, w = first[i : i + 65536], second[i : i + 65536], cls[i : i + 65536]
                        logit = np.einsum("ij,ij->i", m["C1"][a] + m["C2"][d], m["R"][w]) + m["bias"][w] - m["z"][d, a]
                        l += logit.sum(dtype=np.float64) / np.log(10)
                    l += within[hot_no].sum()
                tokens.append(k), hits.append(h), base.append(float(s)), score.append(float(l))
                rare_words += rare.keys()
                rare_n += rare.values()
                offsets.append(len(rare_words))
            kind = pa.struct([("word", pa.binary()), ("n", pa.int64())])
            pairs = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_n, pa.int64())], fields=list(kind))
            arrays = [pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["_id", "_tokens", "_hits", "_base", "_score", "_rare"])

    kind = rows.schema["_id"].dataType.simpleString()
    half = rows.mapInArrow(each, f"_id {kind}, _tokens long, _hits long, _base double, _score double, _rare array<struct<word: binary, n: long>>")
    half = materialize(half.withColumn("_rid", F.monotonically_increasing_id()), "scored")
    left = half.select("_rid", F.explode("_rare").alias("_r")).select("_rid", F.col("_r.word").alias("word"), F.col("_r.n").alias("_n")).join(vocabulary, "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    left = left.groupBy("_rid").agg(F.sum(F.when(c > 0, F.col("_n")).otherwise(0)).alias("_k"), F.sum(F.col("_n") * F.log10((c + SMOOTH) / all_mass)).alias("_b"), F.sum(F.col("_n") * F.log10((c + SMOOTH) / other_mass)).alias("_s"))
    got = half.drop("_rare").join(left, "_rid", "left")
    zero = F.lit(0)
    return got.select(
        F.col("_id").alias(id_col), held_out.alias("held_out"), F.col("_tokens").alias("n_tokens"), (F.col("_hits") + F.coalesce("_k", zero)).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_b", F.lit(0.0))).alias("base_score"), (F.col("_score") + F.coalesce("_s", F.lit(0.0))).alias("score"),
    )
