import hashlib
import zlib

import numpy as np
import public_tokenizers as P
from cases import documents, empty, texts, words
from hypothesis import given, settings
from hypothesis import strategies as st

from weir.llm import packing, pieces, token_counts


def test_pieces_and_sequences(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    got = packing.pack(packing.pieces(documents(spark), path, capacity=512), capacity=512, group=20).collect()
    want = []
    for i, x in texts():
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, k, k * 512, len(p), zlib.crc32(p.tobytes())) for k in range(-(-len(ids) // 512)) for p in [ids[k * 512 : (k + 1) * 512]]]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r._id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 512
    assert len(bins) <= -(-sum(r[3] for r in want) // 512) + 2  # groups of 20 items waste more than production ones


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_packing_keeps_every_item(lengths):
    bins = packing.best_fit(lengths, 100)
    better = packing.improve([list(b) for b in bins], lengths, 100)
    assert sorted(i for b in better for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 100 for b in better) and len(better) <= len(bins)


def test_local_search_empties_a_bin():
    lengths = [60, 60, 40, 30, 30, 30, 30, 20, 20]
    bins = [[0, 3], [1, 4], [2, 5, 7], [6, 8]]  # 90, 90, 90, 50: 320 in all
    assert len(packing.improve(bins, lengths, 110)) == 3


def test_sentencepiece_matches_the_library(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    got = pieces.encode_documents(documents(spark), path).collect()
    want = sorted((str(i), m.encode(t or "", add_bos=True, add_eos=True)) for i, t in texts())
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    assert all(r.decoded == m.decode(r.ids) for r in got)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab the▁ \n\té🎉<s></s>Zz9."), max_size=80))
def test_agenda_on_odd_texts(text):
    v = pieces.process_cache(("test",), lambda: pieces.MergeVocabulary(P.path("piece_bpe_32k.model")))
    assert pieces.encoder(v)([text])[0].tolist() == v.model.encode(text, add_bos=True, add_eos=True)
    parts = [v.symbols[c] for c in "internationalization" if c in v.symbols]
    assert v.agenda(parts) == v.merge_together(np.array([parts], np.int32))[0]


def test_section_counts(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    for rule in token_counts.RULES:
        got = token_counts.section_counts(documents(spark), path, P.PATTERN, rule).collect()
        for i, t in texts():
            own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)
            if i is None or i == 7:
                continue
            assert [r.section for r in own] == list(range((t or "").count("\n") + 1))
            assert sum(r.n_bytes for r in own) == len((t or "").encode()) and abs(sum(r.n_tokens for r in own) - own[0].doc_tokens) < 1e-6


def by_hand(encoding, text, rule):
    """The tokens of each line, one token and one byte after another."""
    lines = text.encode().split(b"\n")
    owner = [k for k, line in enumerate(lines) for _ in range(len(line) + (k < len(lines) - 1))]
    counts, at = [0.0] * len(lines), 0
    for i in encoding.encode_ordinary(text):
        mine = owner[at : at + len(encoding.decode_single_token_bytes(i))]
        at += len(mine)
        if rule == "start":
            counts[mine[0]] += 1
        elif rule == "end":
            counts[mine[-1]] += 1
        elif rule == "most":
            counts[max(dict.fromkeys(mine), key=lambda k: (mine.count(k), -k))] += 1
        else:
            for k in mine:
                counts[k] += 1 / len(mine)
    return counts


def test_section_counts_against_a_count_by_hand(spark):
    import base64

    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    odd = ["a\n\n\n  b\n\n\n\n", "\n", "x = 1;\n\n\n\ny", "é🎉\n\n é🎉\n", words(200, 31).replace(" a", "\n\n  a"), "", "\n\n\n\n\n\n\n\nend"]
    rows = [(k, t) for k, t in enumerate(odd)]
    crossed = 0
    for rule in token_counts.RULES:
        got = token_counts.section_counts(documents(spark, rows), path, P.PATTERN, rule).collect()
        for i, t in rows:
            own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)
            assert np.allclose([r.n_tokens for r in own], by_hand(encoding, t, rule)), (rule, t)
            assert {r.doc_tokens for r in own} == {len(encoding.encode_ordinary(t))}
            crossed += sum(r.n_crossing for r in own)
    assert crossed > 0


def test_a_very_long_text(spark):
    text = " ".join(words(2000, 50) for _ in range(450))  # over the four MB that are looked at together
    assert len(text) > 4 << 20
    docs = documents(spark, [(1, text), (2, "short"), (3, text[:300])])
    got = {r.doc_id: r for r in pieces.encode_digests(docs, P.path("piece_bpe_32k.model")).collect()}
    assert got[1].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[1].n_tokens > 900_000
    packed = packing.pack(packing.pieces(docs, P.path("word_bpe_49k.json"))).collect()
    mine = sorted((r for r in packed if r["_id"] == 1), key=lambda r: r.piece)
    assert all(r.length == 4096 for r in mine[:-1]) and [r.start for r in mine] == list(range(0, 4096 * len(mine), 4096))
    total = token_counts.section_counts(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).where("doc_id = 1").first()
    assert total.n_tokens == total.doc_tokens > 900_000


def test_boundary_rules():
    ends, bounds = np.array([3, 9, 10]), np.array([4, 4, 7, 10])
    assert token_counts.allocate(ends, bounds, "start")[0].tolist() == [2, 0, 0, 1]
    assert token_counts.allocate(ends, bounds, "end")[0].tolist() == [1, 0, 0, 2]
    assert token_counts.allocate(ends, bounds, "most")[0].tolist() == [1, 0, 1, 1]
    counts, crossing = token_counts.allocate(ends, bounds, "share")
    assert np.allclose(counts, [1 + 1 / 6, 0, 3 / 6, 2 / 6 + 1]) and crossing.tolist() == [1, 1, 1, 0]


def test_fields_as_sections(spark):
    from pyspark.sql import functions as F

    got = token_counts.section_counts(documents(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, parts=F.array("lang", F.lit(": "), "text")).where("doc_id = 11").orderBy("section").collect()
    assert len(got) == 3 and got[2].n_bytes == len(words(3000, 1))


def test_empty_tables(spark):
    assert packing.pack(packing.pieces(empty(spark), P.path("word_bpe_49k.json"))).collect() == []
    assert pieces.encode_digests(empty(spark), P.path("piece_bpe_32k.model")).collect() == []
    assert token_counts.section_counts(empty(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []


def test_functions_reach_workers_without_the_package():
    """What runs on executors travels by value: a worker needs not have the package."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from weir.llm import quality, simhash
docs = spark.createDataFrame([(i, f"some words of text {{i}} and more") for i in range(20)], "doc_id long, text string")
labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
rows, n = simhash.numbered(docs, "doc_id")
print(quality.classify(docs, labels).count(), simhash.near_copies(rows, n).count() >= 0)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd="/", timeout=300)
    assert done.stdout.split() == ["20", "True"], done.stderr[-2000:]
