"""Hashes of word shingles for many texts at once, in array operations.

Words are parted at space and 09-0D, A-Z lower-cased. A word's hash is a polynomial of its bytes, mixed; a shingle's hash mixes its
words' in turn. Equal 64-bit hashes count as equal shingles. A text with fewer words than the shingle is one shingle, one without
words has none.
"""

from __future__ import annotations

from .common import process_cache

_BASE = 0x9E3779B97F4A7C15 | 1
_GAPS = b"\t\n\x0b\x0c\r "
_GAPS_EACH = [bytes([c]) for c in _GAPS]
_STEP = 1 << 20  # bytes that are looked at together: a handful of arrays of eight bytes for each


def _tables() -> tuple:
    import numpy as np

    lower = np.arange(256, dtype=np.uint64) + np.uint64(1)
    lower[65:91] += np.uint64(32)
    gap = np.zeros(256, bool)
    gap[list(_GAPS)] = True
    return lower, gap


def _powers(n: int) -> tuple:
    import numpy as np

    def of(base: int):
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        return np.cumprod(p, dtype=np.uint64)

    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


def mixed(h):
    """Every bit of the result depends on every bit of h."""
    import numpy as np

    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(buf: bytes):
    """The hash and start of each word of a buffer."""
    import numpy as np

    if len(buf) > 2 * _STEP:  # one huge word
        from xxhash import xxh64_intdigest

        return np.array([xxh64_intdigest(buf.strip(_GAPS).lower())], np.uint64), np.array([0])
    lower, gap = process_cache(("shingle tables",), _tables)
    power, inverse = process_cache(("shingle powers", _STEP), lambda: _powers(2 * _STEP))
    b = np.frombuffer(buf, np.uint8)
    inside = np.concatenate([[False], ~gap[b], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    upto = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(lower[b] * power[: len(b)], dtype=np.uint64, out=upto[1:])
    return mixed((upto[ends] - upto[starts]) * inverse[starts]), starts


def _parts(texts: list[bytes]):
    """Lists of (number, bytes) that are looked at together; a huge text comes in pieces that end between words, a huge word alone."""
    held, size = [], 0
    for k, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = min(len(t), at + _STEP)
            while end < len(t) and t[end] not in _GAPS:
                end += 1
            if end - at > 2 * _STEP:
                gap = max(t.rfind(c, at, at + _STEP) for c in _GAPS_EACH)
                end = gap + 1 if gap >= at else end
            if held and size + end - at > _STEP:
                yield held
                held, size = [], 0
            held.append((k, t[at:end]))
            size += end - at
            at = end
    if held:
        yield held


def word_sequence(text: bytes):
    """The hashes of a text's words in order."""
    import numpy as np

    found = [word_hashes(b"\n".join(x for _, x in held))[0] for held in _parts([text])]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_sets(texts: list[bytes], words: int):
    """Arrays number (of the text) and hash: the distinct shingles of each text, in order of both."""
    import numpy as np

    whose, found = [], []
    for held in _parts(texts):
        h, starts = word_hashes(b"\n".join(x for _, x in held))
        begins = np.cumsum([0, *(len(x) + 1 for _, x in held[:-1])])
        whose.append(np.array([k for k, _ in held])[np.searchsorted(begins, starts, side="right") - 1])
        found.append(h)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w, who = np.concatenate(found), np.concatenate(whose)
    first = np.concatenate([[0], np.flatnonzero(np.diff(who)) + 1]) if len(who) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(who)))
    size = np.minimum(np.repeat(count, count), words)  # of the shingles of a word's text
    h, length = np.zeros(len(w), np.uint64), len(w)
    for k in range(words):
        part = np.zeros(length, np.uint64)
        part[: length - k] = w[k:]
        h = np.where(size > k, mixed(h * np.uint64(_BASE) + part), h)
    place = np.arange(length) - np.repeat(first, count)
    real = place <= np.repeat(np.maximum(count - words, 0), count)
    h, who = h[real], who[real]
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    return who[new].astype(np.int64), h[new]
