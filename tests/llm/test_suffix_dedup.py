import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import documents, empty, texts, words

from weir.llm import suffix_dedup as S


def brute(rows, length):
    seen = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = defaultdict(list)
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out[i].append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,cap", [(400, 1 << 20), (64, 1 << 20), (64, 500)])
def test_against_brute_force(spark, length, cap, monkeypatch):
    monkeypatch.setattr(S.repeated_spans, "__defaults__", tuple(cap if x == S.CAP else x for x in S.repeated_spans.__defaults__))
    rows = [(i, (t or "").encode()) for i, t in texts()]
    got = S.removal_digests(documents(spark), length).collect()
    want = brute(rows, length)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in want[r.doc_id], r


def test_two_stage_order_and_prefixes():
    for trial in range(200):
        r = random.Random(trial)
        alphabet = r.choice([b"ab", b"a", bytes(range(256)), b"the quick"])
        b = bytes(r.choice(alphabet) for _ in range(r.randint(1, 300)))
        b = b[: len(b) // 2] * 2 + b if trial % 2 else b
        length = r.choice([8, 16, 64])
        places = S.two_stage(b, length)
        assert sorted(places.tolist()) == list(range(len(b)))
        strings = [b[i : i + length] for i in places]
        assert strings == sorted(strings)
        inside = places[places <= len(b) - length]
        for x, y, n in zip(inside, inside[1:], S.common_prefixes(b, inside, length)):
            assert n == next((k for k in range(length) if b[x + k] != b[y + k]), length)


def test_huge_texts_come_in_pieces(monkeypatch):
    r = random.Random(5)
    texts_ = [bytes(r.choice(b"abcd ") for _ in range(9000)), b"z" * 3000]
    whole = S.anchors(texts_, 100)
    monkeypatch.setattr(S, "_PART", 1000)
    parts = S.anchors(texts_, 100)

    def strings(x):
        return sorted((t, g, s) for t, g, a, z in zip(*map(np.ndarray.tolist, x)) for s in range(a, z + 1))

    assert strings(whole) == strings(parts)


def test_removed_text_is_whole_characters(spark):
    p = "é" * 150
    got = S.remove(documents(spark, [(1, "a" + p + "b"), (2, "c" + p + "d"), (3, "left alone")]), 200, size_col="n_chars").collect()
    assert {r.doc_id: (r.text, r.n_chars) for r in got} == {1: ("ab", 2), 2: ("cd", 2), 3: ("left alone", 10)}


def test_empty_table(spark):
    assert S.removal_digests(empty(spark)).collect() == []
    assert S.remove(empty(spark)).collect() == []


def masks(rows, length):
    """For each text: which bytes are covered by a string that starts anywhere else too; by polynomial hashes of all strings."""
    base = 0xD1342543DE82EF95
    sums = []
    for t in rows:
        b = np.frombuffer(t, np.uint8).astype(np.uint64) + np.uint64(3)
        if len(b) < length:
            sums.append(np.zeros(0, np.uint64))
            continue
        power, inverse = (np.cumprod(np.array([1] + [x] * len(b), np.uint64), dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * power[:-1], dtype=np.uint64)])
        sums.append((upto[length:] - upto[:-length]) * inverse[: len(b) - length + 1])
    values, n = np.unique(np.concatenate(sums), return_counts=True)
    out = []
    for t, h in zip(rows, sums):
        edge = np.zeros(len(t) + 1, np.int64)
        if len(h):
            at = np.flatnonzero(n[np.searchsorted(values, h)] > 1)
            np.add.at(edge, at, 1), np.add.at(edge, at + length, -1)
        out.append(np.cumsum(edge)[: len(t)] > 0)
    return out


def test_the_test_tables_over_many_partitions(spark):
    """All of documents, with one passage of 3,000 bytes in a fifth of them, over 211 partitions."""
    passage = words(600, 8)[:3000]
    docs = [(r.doc_id, (r.text or "") + (" " + passage if r.doc_id % 5 == 0 else "")) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    df = documents(spark, docs).repartition(211)
    bytes_ = [t.encode() for _, t in docs]
    want = {}
    for (i, _), t, gone in zip(docs, bytes_, masks(bytes_, 400)):
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i] = (len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.removal_digests(df).collect()}
    assert got == want and sum(x[1] > 0 for x in want.values()) > 200
    cut = {}
    for (i, _), t, gone in zip(docs, bytes_, masks(bytes_, 200)):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        kept, last = b"", 0
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
            while x < y and t[x] & 0xC0 == 0x80:
                x += 1
            while y > x and y < len(t) and t[y] & 0xC0 == 0x80:
                y -= 1
            kept, last = kept + t[last:x], y
        cut[i] = (kept + t[last:]).decode()
    assert {r.doc_id: r.text for r in S.remove(df, 200).collect()} == cut
