"""SentencePiece encoding of merge-type vocabularies and decoding.

Encoding is a score-ordered agenda of adjacent symbol pairs: the pair whose joint piece has the highest score merges first, the
leftmost of equal ones, until no adjacent pair is a piece. No piece holds a space mark after another character, nor a line
break, so a text's words are independent and a word is encoded once in a batch of a task. New words go through the agenda
together, as arrays: words of one length are a matrix, and in each round every word that still has a pair makes its best merge.
Long words use a heap. Characters outside the vocabulary become their bytes' pieces. The words that are
new in an Arrow batch are checked against the library's own ids for a text of all of them; decoding is the library's.

Defined results: a null text counts as empty; an empty text has the begin and end ids alone and decodes to the empty text;
repeated rows give repeated results; an empty table gives an empty result; columns other than id and text are not looked at.
"""

from __future__ import annotations

import heapq
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIds, process_cache, text_of

SPACE = "▁"
_LONG, _WORDS_KEPT = 48, 1_000_000


class MergeVocabulary:
    """A merge-type vocabulary with byte fallback, identity normalization and a leading space mark."""

    def __init__(self, path: str):
        import numpy as np
        import sentencepiece

        self.path = path
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos = m.bos_id(), m.eos_id()
        normal = {m.id_to_piece(i): i for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        assert not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal), "words are not independent under this vocabulary"
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        symbols = {s: k for k, s in enumerate(dict.fromkeys([*normal, *(c for p in normal for c in p)]))}
        self.symbols, self.text = symbols, list(symbols)
        self.n = len(symbols)
        by_score = {s: r for r, s in enumerate(sorted({m.get_score(i) for i in normal.values()}, reverse=True))}
        found = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                if p[:k] in symbols and p[k:] in symbols:
                    found[symbols[p[:k]] * self.n + symbols[p[k:]]] = (by_score[m.get_score(i)], symbols[p])
        self.found = found
        self.keys = np.array(sorted(found), np.int64)
        self.none = len(by_score)
        self.ranks = np.array([found[k][0] for k in self.keys.tolist()] + [self.none], np.int32)
        self.merged = np.array([found[k][1] for k in self.keys.tolist()] + [0], np.int32)
        self.ids = [[normal[s]] if s in normal else [self.bytes[b] for b in s.encode()] for s in self.text]

    def pairs(self, left, right):
        """Places in ranks and merged of pairs of symbols; the last place is for pairs that aren't pieces."""
        import numpy as np

        key = left.astype(np.int64) * self.n + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, len(self.keys))

    def agenda(self, word: list[int]) -> list[int]:
        """The symbols of one word after all merges, by a heap."""
        symbol = list(word)
        after, before = [*range(1, len(word)), -1], [-1, *range(len(word) - 1)]
        heap = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (hit := self.found.get(symbol[a] * self.n + symbol[b])):
                heapq.heappush(heap, (hit[0], a, b, symbol[a], symbol[b], hit[1]))

        for k in range(len(word) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, x, y, joint = heapq.heappop(heap)
            if symbol[a] != x or symbol[b] != y or after[a] != b:
                continue
            symbol[a], symbol[b] = joint, -1
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in symbol if s >= 0]

    def merge_together(self, words) -> list[list[int]]:
        """The symbols of words of one length, a matrix, after all merges."""
        import numpy as np

        out: list = [None] * len(words)
        who, s = np.arange(len(words)), words
        place = self.pairs(s[:, :-1], s[:, 1:]) if s.shape[1] > 1 else None
        while True:
            if place is None or not place.shape[1]:
                for k, row in zip(who.tolist(), s.tolist()):
                    out[k] = row
                return out
            rank = self.ranks[place]
            best = rank.argmin(1)
            rows = np.arange(len(s))
            active = rank[rows, best] < self.none
            if not active.all():
                rest = ~active
                for k, row in zip(who[rest].tolist(), s[rest].tolist()):
                    out[k] = row
                who, s, place, best = who[active], s[active], place[active], best[active]
                if not len(s):
                    return out
                rows = np.arange(len(s))
            s[rows, best] = self.merged[place[rows, best]]
            keep = np.ones(s.shape, bool)
            keep[rows, best + 1] = False
            s = s[keep].reshape(len(s), -1)
            keep = np.ones(place.shape, bool)
            keep[rows, best] = False
            place = place[keep].reshape(len(s), -1)
            if place.shape[1]:
                l = best > 0
                place[rows[l], best[l] - 1] = self.pairs(s[rows[l], best[l] - 1], s[rows[l], best[l]])
                r = best < s.shape[1] - 1
                place[rows[r], best[r]] = self.pairs(s[rows[r], best[r]], s[rows[r], best[r] + 1])

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of words, each encoded by itself."""
        import numpy as np

        out: list = [None] * len(words)
        by_length: dict[int, list] = {}
        for k, w in enumerate(words):
            try:
                symbols = [self.symbols[c] for c in w]
            except KeyError:
                out[k] = self._with_others(w)
                continue
            if len(w) > _LONG:
                out[k] = [i for s in self.agenda(symbols) for i in self.ids[s]]
            else:
                by_length.setdefault(len(w), []).append((k, symbols))
        for group in by_length.values():
            for (k, _), done in zip(group, self.merge_together(np.array([s for _, s in group], np.int32))):
                out[k] = [i for s in done for i in self.ids[s]]
        return out

    def checked(self, words: list[str]) -> list[list[int]]:
        """encode_words, compared with the library's ids for one text that has all the words, a line each."""
        found = self.encode_words(words)
        mark, line = self.encode_words([SPACE, "\n"])
        want = [*mark, *(i for ids in found for i in (*line, *ids))]
        if want != self.model.encode("\n" + "\n".join(words).replace(SPACE, " ")):
            raise ValueError("the agenda's ids differ from the library's")
        return found

    def _with_others(self, word: str) -> list[int]:
        """A word with characters outside the vocabulary, which never merge."""
        ids, run = [], []
        for c in [*word, None]:
            if c is not None and c in self.symbols:
                run.append(self.symbols[c])
                continue
            ids += [i for s in self.agenda(run) for i in self.ids[s]]
            run = []
            if c is not None:
                ids += [self.bytes[b] for b in c.encode()]
        return ids


def encoder(vocabulary: MergeVocabulary, check: bool = True):
    """A function of lists of texts; ids as arrays, begin and end ids included."""
    import numpy as np

    parts = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+").findall
    ids_of = process_cache(("pieces", vocabulary.path, check), lambda: WordIds(vocabulary.checked if check else vocabulary.encode_words, _WORDS_KEPT))

    def encode(texts: list[str]) -> list:
        found = ids_of([parts(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts])
        return [np.concatenate([[vocabulary.bos], ids, [vocabulary.eos]]).astype(np.uint32) for ids in found]

    return encode


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """The id, ids (array<int>) and decoded text of every text. check: fail where the library's own ids differ."""
    return _encoded(docs, path, id_col, text_col, check, digest=False)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """The id, n_tokens, ids_sha256, decoded_sha256 of what encode_documents gives, without moving it out of the worker."""
    return _encoded(docs, path, id_col, text_col, check, digest=True)


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, check: bool, digest: bool) -> DataFrame:
    def each(batches):
        from hashlib import sha256

        import pyarrow as pa

        vocabulary = process_cache(("vocabulary", path), lambda: MergeVocabulary(path))
        encode = encoder(vocabulary, check)
        for b in batches:
            texts = b.column(1).to_pylist()
            arrays = encode(texts)
            ids = [a.tolist() for a in arrays]
            said = vocabulary.model.decode(ids, num_threads=1)
            if digest:
                columns = [pa.array(map(len, ids), pa.int64()), pa.array(sha256(a.astype("<u4").tobytes()).hexdigest() for a in arrays), pa.array(sha256(t.encode()).hexdigest() for t in said)]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(said, pa.string())], ["_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return rows.mapInArrow(each, f"_id {kind}, {schema}").withColumnRenamed("_id", id_col)
