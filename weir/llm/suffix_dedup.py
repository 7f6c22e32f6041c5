"""Removal of repeated passages by suffix arrays, sorted in two stages.

Every byte that is covered by a string of `length` bytes which also starts anywhere else, in another text or the same, is removed.

Strings that are equal must meet. Each string of `length` bytes has an anchor: the leftmost of its GRAM-byte grams with the
smallest hash. Equal strings have equal anchors, so only anchors that occur twice matter, and consecutive strings of a text
mostly share one: their text is a snippet. Snippets of an anchor go to one bucket; equal snippets are one, with a count.

In a bucket the snippets' suffixes are sorted in two stages. Suffixes smaller than their successors are sorted directly, by
their first `length` bytes; all others are induced by scanning the character buckets in order: a suffix's predecessor that is larger
than it is the next of its own bucket. Then adjacent common prefixes are computed, and strings with a neighbour that shares
`length` bytes are repeated ones.

An anchor whose distinct snippets have more than CAP bytes does not fit a bucket; its strings are compared by 128-bit hashes in
a shuffle, which splits them by content, however many there are. The result is the same.

Texts are shuffled twice (to the anchors that repeat, to the spans); written tables hold anchors (about 2 / length of the bytes)
and snippets of repeated anchors only.

Defined results: null counts as empty; a text shorter than `length` keeps all; a row that is repeated in full is a repetition of its
text; matches never cross texts; an empty table gives an empty result; columns other than id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

LENGTH, GRAM = 400, 32
BUCKET, CAP = 512 << 10, 1 << 20
_PART = 1 << 20  # bytes that are looked at together: a dozen arrays of eight bytes for each


def _words8(buf: bytes, n: int, order: str):
    """The eight bytes at each of n places, as integers."""
    import numpy as np

    return np.ascontiguousarray(np.ndarray((n,), order + "u8", buf, 0, (1,)))


def anchors(texts: list[bytes], length: int):
    """Arrays text, anchor (hash), first start, last start, for the runs of strings with one anchor, of all texts."""
    import numpy as np

    grams = length - GRAM + 1
    found = []

    def look(part: list[tuple[int, int, bytes]]) -> None:  # number, place in the text, bytes
        buf = b"".join(x[2] for x in part)
        n = len(buf)
        w = _words8(buf + bytes(8), n, "<")
        m = n - GRAM + 1
        a = np.uint64(0x9E3779B97F4A7C15)
        h = np.zeros(m, np.uint64)
        for k in range(0, GRAM, 8):
            h = (h + w[k : k + m]) * a
            h ^= h >> np.uint64(31)
        key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(m, dtype=np.uint64)
        rows = -(-m // grams)
        padded = np.full(rows * grams, ~np.uint64(0))
        padded[:m] = key
        padded = padded.reshape(rows, grams)
        upto = np.minimum.accumulate(padded, 1).ravel()
        since = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
        starts = m - grams + 1
        at = (np.minimum(since[:starts], upto[grams - 1 : grams - 1 + starts]) & np.uint64(0xFFFFFF)).astype(np.int64)
        sizes = np.array([len(x[2]) for x in part])
        begins = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(part)), sizes)[:starts]
        s = np.flatnonzero(np.arange(starts) + length <= (begins + sizes)[owner])  # strings within one text
        at, owner = at[s], owner[s]
        if not len(s):
            return
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
        last = np.concatenate([new[1:] - 1, [len(s) - 1]])
        number, place = np.array([x[0] for x in part]), np.array([x[1] for x in part])
        o = owner[new]
        found.append((number[o], h[at[new]].view(np.int64), s[new] - begins[o] + place[o], s[last] - begins[o] + place[o]))

    part, size = [], 0
    for k, t in enumerate(texts):
        if len(t) < length:
            continue
        step = _PART
        for p in range(0, max(1, len(t) - length + 1), step):  # a huge text comes in pieces that share length - 1 bytes
            piece = t[p : p + step + length - 1]
            if size + len(piece) > _PART and part:
                look(part)
                part, size = [], 0
            part.append((k, p, piece))
            size += len(piece)
    if part:
        look(part)
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found))


def two_stage(buf: bytes, length: int):
    """The places of buf in the order of their suffixes, compared by at least `length` bytes."""
    import numpy as np

    n = len(buf)
    b = np.frombuffer(buf, np.uint8)
    step = np.sign(np.diff(b.astype(np.int16), append=-1))
    step[-1] = -1
    decides = np.where(step != 0, np.arange(n), n)
    decides = np.minimum.accumulate(decides[::-1])[::-1]
    small = step[decides] > 0  # smaller than its successor

    direct = np.flatnonzero(small)
    key = _words8(buf + bytes(16), n, ">").astype(np.uint64)
    order = direct[np.argsort(key[direct], kind="stable")]
    k = key[order]
    same = np.flatnonzero(k[1:] == k[:-1])
    if len(same):
        new = np.flatnonzero(np.diff(same, prepend=-2) > 1)
        begins, ends = same[new], np.append(same[new[1:] - 1], same[-1]) + 2
        for s, e in zip(begins.tolist(), ends.tolist()):
            run = order[s:e].tolist()
            run.sort(key=lambda i: buf[i : i + length])
            order[s:e] = run
    of = np.searchsorted(b[order], np.arange(257))

    ahead: list[list] = [[] for _ in range(256)]
    ahead[b[-1]].append(np.array([n - 1]))
    out = []

    def push(places, c: int):
        """Deals the larger predecessors to their buckets; those of bucket c are returned."""
        p = places[places > 0] - 1
        p = p[~small[p]]
        if not len(p):
            return p
        chars = b[p]
        s = np.argsort(chars, kind="stable")
        p, chars = p[s], chars[s]
        cuts = np.flatnonzero(np.diff(chars)) + 1
        own = p[:0]
        for group in np.split(p, cuts):
            if b[group[0]] == c:
                own = group
            else:
                ahead[b[group[0]]].append(group)
        return own

    for c in range(256):
        queue = np.concatenate(ahead[c]) if ahead[c] else np.zeros(0, np.int64)
        while len(queue):
            out.append(queue)
            queue = push(queue, c)
        bucket = order[of[c] : of[c + 1]]
        if len(bucket):
            out.append(bucket)
            push(bucket, c)
    return np.concatenate(out)


def common_prefixes(buf: bytes, places, length: int):
    """For neighbours in places: the bytes that they share, at most `length`."""
    import numpy as np

    key = _words8(buf + bytes(length + 16), len(buf) + length, ">")
    x, y = places[:-1], places[1:]
    shared = np.zeros(len(x), np.int64)
    live = np.arange(len(x))
    for k in range(0, length, 8):
        differ = key[x[live] + k] ^ key[y[live] + k]
        same = differ == 0
        stop = differ[~same]
        lead = np.zeros(len(stop), np.int64)
        for bit in (32, 16, 8):  # whole equal bytes before the first difference
            zero = (stop >> np.uint64(64 - bit)) == 0
            lead += np.where(zero, bit // 8, 0)
            stop = np.where(zero, stop << np.uint64(bit), stop)
        shared[live[~same]] = k + lead
        live = live[same]
    shared[live] = length
    return np.minimum(shared, length)


def repeated(snippets: list[bytes], length: int) -> list:
    """For each snippet: which of its strings of `length` bytes occur again in these snippets, as booleans."""
    import numpy as np

    buf = b"".join(snippets)
    sizes = np.array([len(s) for s in snippets])
    begins = np.cumsum(sizes) - sizes
    mine = np.zeros(len(buf), bool)
    for s, z in zip(begins.tolist(), sizes.tolist()):
        mine[s : s + z - length + 1] = True
    places = two_stage(buf, length)
    places = places[mine[places]]
    hit = np.flatnonzero(common_prefixes(buf, places, length) >= length)
    flag = np.zeros(len(buf), bool)
    flag[places[hit]] = flag[places[hit + 1]] = True
    return [flag[s : s + z - length + 1] for s, z in zip(begins.tolist(), sizes.tolist())]


def _runs(flags) -> tuple[list[int], list[int]]:
    import numpy as np

    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2].tolist(), edge[1::2].tolist()


RUNS = "_s1 long, _s2 long, _from array<int>, _to array<int>"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_w_k1, _w_k2 (128 bits that name a row by what it holds: the same in every pass, whatever the partitions), _id, _text."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    return rows.select(F.xxhash64("_id", "_text").alias("_w_k1"), F.xxhash64("_text", F.lit(1), "_id").alias("_w_k2"), "_id", "_text")


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, cap: int = CAP) -> DataFrame:
    """_w_k1, _w_k2 (see keyed), _w_starts, _w_ends: the maximal byte spans to remove of each text that has any."""
    rows = keyed(docs, id_col, text_col)

    def find(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            texts = b.column(2).cast(pa.binary()).to_pylist()
            number, g, _, _ = anchors(texts, length)
            if not len(g):
                continue
            order = np.lexsort((g, number))
            number, g = number[order], g[order]
            new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (number[1:] != number[:-1])]))
            at = pa.array(number[new])
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(g[new]), pa.array(np.diff(np.append(new, len(g))).astype(np.int32))], ["_w_k1", "_w_k2", "_g", "_n"])

    found = materialize(rows.select("_w_k1", "_w_k2", "_text").mapInArrow(find, "_w_k1 long, _w_k2 long, _g long, _n int"), "anchors")
    again = found.groupBy("_g").agg(F.sum("_n").alias("_m")).where("_m > 1").select("_g")
    wanted = found.join(again, "_g").groupBy("_w_k1", "_w_k2").agg(F.collect_set("_g").alias("_gs"))

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_intdigest

        for b in batches:
            texts = b.column("_text").cast(pa.binary()).to_pylist()
            number, g, first, last = anchors(texts, length)
            keep = np.zeros(len(g), bool)
            gs = [np.array(x, np.int64) for x in b.column("_gs").to_pylist()]
            edges = np.searchsorted(number, np.arange(len(texts) + 1))
            for k in range(len(texts)):
                keep[edges[k] : edges[k + 1]] = np.isin(g[edges[k] : edges[k + 1]], gs[k])
            held: dict = {}  # of one text and snippet: the starts
            for k, a, s, e in zip(number[keep].tolist(), g[keep].tolist(), first[keep].tolist(), last[keep].tolist()):
                snippet = texts[k][s : e + length]
                held.setdefault((k, xxh3_128_intdigest(snippet)), (a, snippet, []))[2].append(s)
            at = pa.array([k for k, _ in held], pa.int64())
            signed = lambda x: x - (1 << 64) if x >> 63 else x
            yield pa.RecordBatch.from_arrays(
                [b.column("_w_k1").take(at), b.column("_w_k2").take(at), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([signed(h >> 64) for _, h in held], pa.int64()),
                 pa.array([signed(h & ((1 << 64) - 1)) for _, h in held], pa.int64()), pa.array([v[1] for v in held.values()], pa.binary()), pa.array([v[2] for v in held.values()], pa.list_(pa.int64()))],
                ["_w_k1", "_w_k2", "_g", "_s1", "_s2", "_snippet", "_at"],
            )

    texts = rows.select("_w_k1", "_w_k2", "_text").join(wanted, ["_w_k1", "_w_k2"])
    cuts = materialize(texts.mapInArrow(cut, "_w_k1 long, _w_k2 long, _g long, _s1 long, _s2 long, _snippet binary, _at array<long>"), "cuts")
    snippets = materialize(cuts.groupBy("_g", "_s1", "_s2", "_snippet").agg(F.sum(F.size("_at")).alias("_n")), "snippets")
    sizes = snippets.groupBy("_g").agg(F.sum(F.length("_snippet")).alias("_b"), F.count("*").alias("_m"))
    total = snippets.agg(F.coalesce(F.sum(F.length("_snippet")), F.lit(0))).first()[0]
    large = materialize(sizes.where(f"_b > {cap} and _m > 1").select("_g"), "large")

    def sort(key, t):
        import numpy as np
        import pyarrow as pa

        g, n, text = t.column("_g").to_numpy(), t.column("_n").to_numpy(), t.column("_snippet").to_pylist()
        order = np.argsort(g, kind="stable")
        shared = np.isin(g, (u := np.unique(g, return_counts=True))[0][u[1] > 1])
        todo = [int(i) for i in order if shared[i]]
        flags: dict = {}
        part, size = [], 0
        for k, i in enumerate([*todo, -1]):
            # anchors stay together; a part ends where the next anchor would make it too large
            if part and (i < 0 or (size > bucket and g[i] != g[part[-1]])):
                flags.update(zip(part, repeated([text[j] for j in part], length)))
                part, size = [], 0
            if i >= 0:
                part.append(i)
                size += len(text[i])
        a, z = [], []
        for i in range(len(g)):
            x, y = ([0], [len(text[i]) - length + 1]) if n[i] > 1 else _runs(flags[i]) if i in flags else ([], [])
            a.append(x), z.append(y)
        out = pa.table({"_s1": t.column("_s1"), "_s2": t.column("_s2"), "_from": pa.array(a, pa.list_(pa.int32())), "_to": pa.array(z, pa.list_(pa.int32()))})
        return out.filter(pa.array([bool(x) for x in a], pa.bool_()))

    buckets = max(1, int(total // bucket))
    marks = snippets.join(large, "_g", "left_anti").withColumn("_bucket", F.pmod(F.xxhash64("_g"), F.lit(buckets))).groupBy("_bucket").applyInArrow(sort, RUNS)
    if not large.isEmpty():
        marks = marks.unionByName(_by_hash(snippets.join(large, "_g", "left_semi"), length))
    marks = materialize(marks, "marks")

    def join(key, t):
        import numpy as np
        import pyarrow as pa

        s, e = [], []
        for at, a, z in zip(t.column("_at").to_pylist(), t.column("_from").to_pylist(), t.column("_to").to_pylist()):
            at = np.array(at)[:, None]
            s.append((at + np.array(a)).ravel()), e.append((at + np.array(z) + length - 1).ravel())
        s, e = np.concatenate(s), np.concatenate(e)
        order = np.argsort(s, kind="stable")
        s, e = s[order], np.maximum.accumulate(e[order])
        new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
        return pa.table({"_w_k1": [key[0].as_py()], "_w_k2": [key[1].as_py()], "_w_starts": pa.array([s[new].tolist()], pa.list_(pa.int64())), "_w_ends": pa.array([e[np.append(new[1:] - 1, len(e) - 1)].tolist()], pa.list_(pa.int64()))})

    met = cuts.select("_w_k1", "_w_k2", "_s1", "_s2", "_at").join(marks, ["_s1", "_s2"]).select("_w_k1", "_w_k2", "_at", "_from", "_to")
    return met.groupBy("_w_k1", "_w_k2").applyInArrow(join, "_w_k1 long, _w_k2 long, _w_starts array<long>, _w_ends array<long>")


def _by_hash(snippets: DataFrame, length: int) -> DataFrame:
    """What the sort gives, for snippets of anchors that don't fit a bucket."""

    def strings(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for b in batches:
            for s1, s2, text in zip(b.column("_s1").to_pylist(), b.column("_s2").to_pylist(), b.column("_snippet").to_pylist()):
                n = len(text) - length + 1
                h = np.frombuffer(b"".join(xxh3_128_digest(text[i : i + length]) for i in range(n)), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, s1)), pa.array(np.full(n, s2)), pa.array(np.arange(n, dtype=np.int32)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["_s1", "_s2", "_i", "_h1", "_h2"])

    one = materialize(snippets.select("_s1", "_s2", "_snippet").mapInArrow(strings, "_s1 long, _s2 long, _i int, _h1 long, _h2 long"), "strings")
    often = one.groupBy("_h1", "_h2").count().where("count > 1").select("_h1", "_h2")
    hit = one.join(often, ["_h1", "_h2"]).select("_s1", "_s2", F.struct(F.col("_i").alias("a"), (F.col("_i") + 1).alias("z")).alias("_r"))
    copies = snippets.where("_n > 1").select("_s1", "_s2", F.struct(F.lit(0).alias("a"), (F.length("_snippet") - length + 1).alias("z")).alias("_r"))
    runs = hit.unionByName(copies).groupBy("_s1", "_s2").agg(F.sort_array(F.collect_list("_r")).alias("_r"))
    return runs.select("_s1", "_s2", F.expr("transform(_r, r -> r.a)").alias("_from"), F.expr("transform(_r, r -> r.z)").alias("_to"))


def _apply(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, schema: str, make) -> DataFrame:
    rows = keyed(docs, id_col, text_col)
    return rows.join(spans, ["_w_k1", "_w_k2"], "left").select("_id", "_text", "_w_starts", "_w_ends").mapInArrow(make, f"_id {rows.schema['_id'].dataType.simpleString()}, {schema}")


def removal_digests(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def each(batches):
        from hashlib import sha256

        import pyarrow as pa

        for b in batches:
            size, gone, number, kept = [], [], [], []
            for t, s, e in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                s, e = s or [], e or []
                size.append(len(t)), gone.append(sum(e) - sum(s)), number.append(len(s))
                digest = sha256()
                for x, y in zip([0, *e], [*s, len(t)]):
                    digest.update(t[x:y])
                kept.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, number)), pa.array(kept, pa.string())], ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    spans = repeated_spans(docs, length, id_col, text_col)
    return _apply(docs, spans, id_col, text_col, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", each).withColumnRenamed("_id", id_col)


def remove(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """docs with the repeated passages cut out of its texts; size_col gets the new number of characters. A cut is drawn in to
    whole characters, so that what is left is text."""
    columns = docs.columns
    kind = docs.schema[text_col].dataType.simpleString()
    spans = repeated_spans(docs, length, id_col, text_col)
    rows = docs.select(*[F.col(c) for c in columns], F.xxhash64(id_col, text_of(text_col)).alias("_w_k1"), F.xxhash64(text_of(text_col), F.lit(1), id_col).alias("_w_k2"))
    met = rows.join(spans, ["_w_k1", "_w_k2"], "left").select(*columns, "_w_starts", "_w_ends")

    def each(batches):
        import pyarrow as pa

        at = columns.index(text_col)
        for b in batches:
            out = []
            for t, s, e in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(len(columns)).to_pylist(), b.column(len(columns) + 1).to_pylist()):
                if not s:
                    out.append(t)
                    continue
                kept, last = [], 0
                for x, y in zip(s, e):
                    while x < y and t[x] & 0xC0 == 0x80:
                        x += 1
                    while y > x and y < len(t) and t[y] & 0xC0 == 0x80:
                        y -= 1
                    kept.append(t[last:x])
                    last = y
                out.append(b"".join([*kept, t[last:]]))
            arrays = [pa.array(out, pa.binary()).cast(pa.string()) if k == at else c for k, c in enumerate(b.columns[: len(columns)])]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    assert kind == "string", kind
    got = met.mapInArrow(each, docs.schema)
    return got.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType)) if size_col and size_col in columns else got
