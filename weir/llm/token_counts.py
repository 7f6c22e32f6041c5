"""Token counts of fields and sections from one encoding of the whole document.

A document is encoded once, whole. Tokens of a byte-level vocabulary cover the text's bytes without gaps, so the running sum of
their lengths gives every token's span; spans are interval-joined to the sections (two sorted lists, one binary search a token).
A token that crosses a boundary is allocated by one of four rules: `start` (the section of its first byte), `end` (of its last
byte), `most` (the section with most of its bytes, the earlier of equal ones), `share` (to each section the share of its bytes).
Under every rule the sections of a document add up to its tokens.

Sections are the lines of a text (a line break belongs to the line it ends), or the fields of a row, rendered one after another.

Defined results: null counts as empty; an empty text is one empty section without tokens, and so is an empty field; repeated rows
give repeated results; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

RULES = ("start", "end", "most", "share")


def allocate(ends, bounds, rule: str):
    """Tokens of each section. ends: where tokens end; bounds: where sections end, the last at the text's end. Both in bytes.
    Also the number of tokens that cross a boundary at each section's end."""
    import numpy as np

    n = len(bounds)
    crossing = np.zeros(n, np.int64)
    if not len(ends):
        return np.zeros(n), crossing
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(bounds, starts, "right")
    last = np.searchsorted(bounds, ends - 1, "right")
    one = first == last
    counts = np.bincount(first[one] if rule in ("most", "share") else (first if rule == "start" else last), minlength=n).astype(float)
    for t in np.flatnonzero(~one).tolist():
        edges = [int(starts[t]), *bounds[first[t] : last[t]].tolist(), int(ends[t])]
        parts = np.diff(edges)
        crossing[first[t] : last[t]] += 1
        if rule == "share":
            counts[first[t] : last[t] + 1] += parts / parts.sum()
        elif rule == "most":
            counts[first[t] + int(parts.argmax())] += 1
    return counts, crossing


def section_counts(docs: DataFrame, path: str, pattern: str, rule: str = "most", id_col: str = "doc_id", parts: Column | None = None, text_col: str = "text") -> DataFrame:
    """One row a section: the id, section (from 0), n_bytes, n_tokens (double), n_crossing, doc_tokens.

    parts: an array of the strings that make up a document; the lines of the text if none. path, pattern: a vocabulary of ranks."""
    assert rule in RULES, rule

    def each(batches):
        import base64

        import numpy as np
        import pyarrow as pa
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for k, v in ranks.items():
            size[v] = len(k)
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            at, number, n_bytes, tokens, crossing, whole = [], [], [], [], [], []
            for row, x in enumerate(b.column(1).to_pylist()):
                text = "".join(x) if isinstance(x, list) else x
                sizes = [len(p.encode()) for p in x] if isinstance(x, list) else [len(p) + 1 for p in x.encode().split(b"\n")]
                if not isinstance(x, list):
                    sizes[-1] -= 1
                bounds = np.cumsum(sizes or [0])
                ids = encoding.encode_to_numpy(text, disallowed_special=())
                ends = np.cumsum(size[ids])
                counts, cross = allocate(ends, bounds, rule)
                at += [row] * len(bounds)
                number += range(len(bounds))
                n_bytes += np.diff(bounds, prepend=0).tolist()
                tokens += counts.tolist()
                crossing += cross.tolist()
                whole += [len(ids)] * len(bounds)
            arrays = [pa.array(number, pa.int32()), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.float64()), pa.array(crossing, pa.int64()), pa.array(whole, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *arrays], ["_id", "section", "n_bytes", "n_tokens", "n_crossing", "doc_tokens"])

    text = F.transform(parts, lambda p: F.coalesce(p, F.lit(""))) if parts is not None else text_of(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, section int, n_bytes long, n_tokens double, n_crossing long, doc_tokens long"
    return rows.mapInArrow(each, schema).withColumnRenamed("_id", id_col)
