"""Best-fit packing of token sequences with a swap-based local search.

Texts are tokenized once, whole, in Arrow batches; only pieces' lengths and checksums go on. Pieces are dealt into bounded
groups. Each group is packed best-fit decreasing; then the emptiest bins are donors: an item moves, or is exchanged one for one
or two for one, into another underfull bin whenever that makes the sum of squared fills larger, until the donor is empty. The
emptiest bins, of at most half of a group's items, are then dissolved and meet in fewer groups, until one group is left: what all
groups together waste is little more than what one last group wastes.

Defined results: a null text counts as empty and is its end mark alone; repeated rows and ids are packed once a row; an empty
table gives an empty result; columns other than id and text are not looked at.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIds, materialize, process_cache, text_of

CAPACITY, GROUP, END_ID = 4096, 8192, 1
#: First bytes of the UTF-8 of combining marks: where one may be, letters are not lower-cased ahead of the tokenizer.
_MARKS = (b"\xcc", b"\xcd", b"\xe1\xaa", b"\xe1\xab", b"\xe1\xb7", b"\xe2\x83", b"\xef\xb8")
_WORDS_KEPT = 1_400_000


def word_encoder(path: str, keep: int = _WORDS_KEPT) -> Callable[[list[bytes]], list]:
    """Texts to arrays of ids, for tokenizers that drop white space: a word between ASCII white space is encoded once and its
    ids are kept; lower-casing ahead only where it can't change what the tokenizer's own normalization gives."""
    def make() -> WordIds:
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the threads
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        ends = np.zeros(tokenizer.get_vocab_size() + 1, bool)
        ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

        def learn(words: list[bytes]) -> list:
            """A word of letters is one unit and so has one last token: such words are encoded as one text and cut apart."""
            texts = [w.decode() for w in words]
            whole = [k for k, t in enumerate(texts) if t.isalpha()]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(texts[k] for k in whole)], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.flatnonzero(ends[ids]) + 1
            if len(cuts) != len(whole):  # a letter whose lower case has a mark of its own
                whole, cuts = [], cuts[:0]
            found: list = [None] * len(words)
            flat, last = ids.tolist(), 0
            for k, cut in zip(whole, cuts.tolist()):
                found[k] = flat[last:cut]
                last = cut
            rest = [k for k, f in enumerate(found) if f is None]
            for k, e in zip(rest, tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
                found[k] = e.ids
            return found

        return WordIds(learn, keep)

    ids_of = process_cache(("words", path, keep), make)

    def encode(texts: list[bytes]) -> list:
        return ids_of([(t if any(m in t for m in _MARKS) else t.lower()).split() for t in texts])

    return encode


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep: int = _WORDS_KEPT) -> DataFrame:
    """_id, piece, start, length, ids_crc32 of every piece of every text. keep: words whose ids a worker remembers."""

    def each(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        encode = word_encoder(path, keep)
        for b in batches:
            at, number, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(encode(b.column(1).cast(pa.binary()).to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, s in enumerate(range(0, len(ids), capacity)):
                    part = ids[s : s + capacity]
                    at.append(row), number.append(k), start.append(s), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
            ids_of = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_of, pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    return rows.mapInArrow(each, f"_id {rows.schema['_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: Iterable[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, best-fit decreasing."""
    lengths = list(lengths)
    bins: list[list[int]] = []
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has r left
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[i]
        if fits := mask >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := room - size:
            open_by_room[left].append(b)
            mask |= 1 << left
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int, give_up: int = 4) -> list[list[int]]:
    """Empties underfull bins by moves and swaps that raise the sum of squared fills; ends when `give_up` donors stay."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    stuck = 0
    order = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: (fill[b], b))
    for donor in order:
        if stuck >= give_up:
            break
        if sum(capacity - fill[b] for b in order if bins[b] and b != donor) < fill[donor]:
            break  # there isn't room for it
        moved = True
        while moved and bins[donor]:
            moved = False
            for target in sorted((b for b in order if bins[b] and b != donor), key=lambda b: (-fill[b], b)):
                while bins[donor] and fill[target] < capacity:
                    room = capacity - fill[target]
                    have = sorted((lengths[i], i) for i in bins[donor])
                    best = (0, None, None)  # gain, out of the donor, back into it
                    k = bisect.bisect_right(have, (room, 1 << 62))
                    if k:
                        best = (have[k - 1][0], [have[k - 1][1]], [])
                    for j in bins[target]:
                        most = room + lengths[j]
                        k = bisect.bisect_right(have, (most, 1 << 62))
                        if k and have[k - 1][0] - lengths[j] > best[0]:
                            best = (have[k - 1][0] - lengths[j], [have[k - 1][1]], [j])
                        lo, hi = 0, len(have) - 1
                        while lo < hi:
                            two = have[lo][0] + have[hi][0]
                            if two > most:
                                hi -= 1
                                continue
                            if two - lengths[j] > best[0]:
                                best = (two - lengths[j], [have[lo][1], have[hi][1]], [j])
                            lo += 1
                    gain, out, back = best
                    if not gain or (fill[target] + gain) ** 2 + (fill[donor] - gain) ** 2 <= fill[target] ** 2 + fill[donor] ** 2:
                        break
                    bins[donor] = [i for i in bins[donor] if i not in out] + back
                    bins[target] = [i for i in bins[target] if i not in back] + out
                    moved = True
                    fill[donor] -= gain
                    fill[target] += gain
                if not bins[donor]:
                    break
        stuck += bool(bins[donor])
    return [b for b in bins if b]


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """items: any columns and `length` (1 to capacity). Adds sequence_id and offset."""
    left = materialize(items, "items")
    columns, done, turn = items.columns, None, 0
    slack = max(1, capacity // 256)  # a bin with less room is as good as full
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long, _open boolean"
    while True:
        groups = max(1, -(-left.count() // group))

        number = turn

        def each(key, pdf):
            lengths = pdf["length"].tolist()
            bins = improve(best_fit(lengths, capacity), lengths, capacity)
            fill = [sum(lengths[i] for i in b) for b in bins]
            again, room = set(), len(lengths) // 2  # what is dissolved at least halves, so the turns end
            for k in sorted(range(len(bins)), key=lambda k: (fill[k], k)):
                if fill[k] > capacity - slack or len(bins[k]) > room:
                    break
                again.add(k)
                room -= len(bins[k])
            rows, seq, offset, still = [], [], [], []
            for k, b in enumerate(bins):
                at = 0
                for i in b:
                    rows.append(i), seq.append((number << 56) + (int(key[0]) << 20) + k), offset.append(at), still.append(k in again)
                    at += lengths[i]
            return pdf.drop(columns="_group").iloc[rows].assign(sequence_id=seq, offset=offset, _open=still)

        dealt = left.select(*columns, F.pmod(F.xxhash64(*[c for c in columns if c in ("_id", "piece", "start", "ids_crc32")] or columns), F.lit(groups)).alias("_group"))
        packed = materialize(dealt.groupBy("_group").applyInPandas(each, schema), f"packed{turn}")
        closed = packed if groups == 1 else packed.where("not _open")
        done = closed if done is None else done.unionByName(closed)
        if groups == 1:
            return done.drop("_open")
        left = packed.where("_open").select(*columns)
        turn += 1
