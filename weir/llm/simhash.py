"""Near duplicates by SimHash fingerprints and pivot distance tables.

A fingerprint bit is 1 if it is set in over half of the shingles' XXH64 values. Reference fingerprints (pivots) are patterns on
the four 16-bit blocks of a fingerprint; the table of distances to them is computed once for each distinct fingerprint.
If two fingerprints differ in at most two bits, two of the four blocks are equal and so are all distances to those blocks'
pivots: candidates are found by joining on the distances of two blocks. Pairs with a coordinate that differs by more than the
limit are discarded (triangle inequality), survivors are verified by their Hamming distance.

A bucket of more than `cap` distinct fingerprints is not joined with itself: two fingerprints differ in at most two bits
exactly when some 64-bit value is within one bit of both, so those fingerprints meet at such values, of which each has at most
65 fingerprints. No link is lost and no group's pairs are emitted.

Defined results: null counts as empty; a text with no words has fingerprint zero and links like any other; fewer words than
the shingle: the whole sequence is the one shingle; repeated rows have one fingerprint; null ids never name a component unless
all ids of it are null; an empty table gives an empty result; columns other than id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of, word_slices
from .components import components
from .shingles import shingle_sets

SEED, WORDS, LIMIT = 42, 3, 2
BLOCKS, BLOCK_BITS, PIVOTS = 4, 16, 12
CAP = 64


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> Iterator:
    """Arrays of the XXH64 of all shingles of a text, repeats included."""
    import numpy as np
    from xxhash import xxh64_intdigest

    kept: list[bytes] = []
    some = False
    for part in word_slices(text):
        kept += part
        if len(kept) < words:
            continue
        some = True
        joined = b" ".join(kept)
        ends = list(accumulate(len(w) + 1 for w in kept))
        starts = [0, *ends[: len(kept) - words]]
        yield np.fromiter((xxh64_intdigest(joined[s : e - 1], seed) for s, e in zip(starts, ends[words - 1 :])), dtype=np.uint64, count=len(starts))
        kept = kept[len(kept) - words + 1 :]
    if kept and not some:
        yield np.array([xxh64_intdigest(b" ".join(kept), seed)], dtype=np.uint64)


def majority(hashes: Iterator, table) -> int:
    """The bits set in over half the hashes, as a signed 64-bit integer. table: the bits of each byte."""
    import numpy as np

    counts, n = np.zeros((8, 256), dtype=np.int64), 0
    for h in hashes:
        n += len(h)
        codes = h.view(np.uint8).reshape(-1, 8).astype(np.uint16) + (np.arange(8, dtype=np.uint16) << 8)
        counts += np.bincount(codes.ravel(), minlength=2048).reshape(8, 256)
    bits = (counts @ table).ravel() * 2 > n
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """_id and _fp (long) of every row."""

    def each(batches):
        import numpy as np
        import pyarrow as pa

        table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        for b in batches:
            found = [majority(shingle_hashes(t, words), table) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["_id", "_fp"])

    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    return rows.mapInArrow(each, f"_id {rows.schema['_id'].dataType.simpleString()}, _fp long")


def pivots() -> list[list[int]]:
    """The reference patterns of each block, from a rule: the first 16 bits of SHA-256 of the block's and pattern's numbers."""
    return [[int.from_bytes(hashlib.sha256(f"pivot {b} {j}".encode()).digest()[:2], "big") for j in range(PIVOTS)] for b in range(BLOCKS)]


def pivot_table(fps: DataFrame) -> DataFrame:
    """Adds _s0.._s3: the distances of each block to its pivots, five bits each."""
    def packed(b: int, refs: list[int]) -> str:
        block = f"(shiftrightunsigned(_fp, {b * BLOCK_BITS}) & 65535)"
        return " | ".join(f"shiftleft(cast(bit_count({block} ^ {r}L) as bigint), {5 * j})" for j, r in enumerate(refs))

    return fps.select("*", *[F.expr(packed(b, refs)).alias(f"_s{b}") for b, refs in enumerate(pivots())])


def links(fps: DataFrame, limit: int = LIMIT, cap: int = CAP) -> DataFrame:
    """fps: distinct _fp. Pairs u, v that connect exactly what fingerprints of at most `limit` (0 to 2) differing bits connect."""
    assert 0 <= limit <= 2, "two equal blocks of four are certain up to two differing bits"
    table = pivot_table(fps.select("_fp"))
    two = list(combinations(range(BLOCKS), 2))
    keyed = table.select("*", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"_s{a}").alias("a"), F.col(f"_s{b}").alias("b")) for t, (a, b) in enumerate(two)])).alias("_k"))
    keyed = keyed.select("_fp", *[f"_s{b}" for b in range(BLOCKS)], F.col("_k.t").alias("_t"), F.col("_k.a").alias("_a"), F.col("_k.b").alias("_b"))
    key = ["_t", "_a", "_b"]
    sizes = keyed.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    met = materialize(keyed.join(sizes, key), "buckets")
    cold = met.where(f"_n <= {cap}")
    other = cold.select(*key, *[F.col(c).alias(f"{c}y") for c in ["_fp", *(f"_s{b}" for b in range(BLOCKS))]])
    far = [f"abs((shiftrightunsigned(_s{b}, {5 * j}) & 31) - (shiftrightunsigned(_s{b}y, {5 * j}) & 31))" for b in range(BLOCKS) for j in range(PIVOTS)]
    pairs = cold.join(other, key).where("_fp < _fpy").where(f"greatest({', '.join(far)}) <= {limit}").where(f"bit_count(_fp ^ _fpy) <= {limit}")
    found = pairs.select(F.col("_fp").alias("u"), F.col("_fpy").alias("v"))

    hot = met.where(f"_n > {cap}").select("_fp").distinct()
    if limit == 2:
        near = hot.select("_fp", F.explode(F.expr("concat(array(_fp), transform(sequence(0, 63), i -> _fp ^ shiftleft(1L, i)))")).alias("_at"))
        stars = near.groupBy("_at").agg(F.collect_set("_fp").alias("_l")).where("size(_l) > 1").withColumn("_at", F.array_min("_l"))
    else:  # one bit: the two meet at the value that has the bit cleared, which is one of them
        bits = F.expr("concat(array(_fp), transform(sequence(0, 63), i -> _fp & ~shiftleft(1L, i)))") if limit else F.array("_fp")
        near = hot.select("_fp", F.explode(bits).alias("_at"))
        stars = near.groupBy("_at").agg(F.collect_set("_fp").alias("_l")).where("size(_l) > 1 and array_contains(_l, _at)")
    stars = stars.select(F.col("_at").alias("u"), F.explode("_l").alias("v")).where("u <> v")
    return found.unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, limit: int = LIMIT, cap: int = CAP) -> DataFrame:
    """One row per row of docs: the id, fingerprint (16 hex digits), component_id (the smallest id reachable by links)."""
    rows = materialize(fingerprints(docs, id_col, text_col, words), "fps")
    fps = materialize(rows.groupBy("_fp").agg(F.min("_id").alias("_least")), "distinct")
    roots = components(links(fps, limit, cap)).select(F.col("u").alias("_fp"), F.col("v").alias("_root"))
    rooted = materialize(fps.join(roots, "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp")), "rooted")
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = rooted.join(least, "_root").select("_fp", "component_id")
    return rows.join(named, "_fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by similarity: sets of shingles

FINE_WORDS, SIMILARITY, CHUNK, SLICES = 5, 0.8, 64, 3
MARK, REFERENCES = 1024, 32


def references(n: int = REFERENCES, bits: int = MARK) -> list[bytes]:
    """The reference fingerprints that marks are measured against, from a rule: SHAKE-256 of their numbers."""
    return [hashlib.shake_256(f"reference {j}".encode()).digest(bits // 8) for j in range(n)]


def numbered(docs: DataFrame, id_col: str, name: str = "_w_n") -> tuple[DataFrame, str]:
    """docs with a column that numbers its rows, and that column's name: the id where it is a different integer in each row,
    else a written copy's row numbers. Both are the same in every later scan."""
    while name in docs.columns:
        name += "_"
    if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        if docs.groupBy(F.col(id_col)).agg(F.count("*").alias("_m")).where(f"_m > 1 or `{id_col}` is null").isEmpty():
            return docs.withColumn(name, F.col(id_col).cast("long")), name
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _spare(size, similarity: float):
    """How many shingles of a set can be missing in a set of this similarity: it has size * similarity or more of them."""
    import numpy as np

    return size - np.ceil(size * similarity - 1e-9).astype(np.int64)


def _sliced(rows: DataFrame, words: int, similarity: float, slices: int) -> DataFrame:
    """_n, _left, _g: of every text the shingles of one slice of all hashes; _left: how many more of them could be missing elsewhere
    than the slice has. A text that has none to spare is marked by a _g below MARK."""

    def each(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            row, h = shingle_sets(b.column(1).cast(pa.binary()).to_pylist(), words)
            size = np.bincount(row, minlength=b.num_rows)
            part = (h >> np.uint64(20)) % np.uint64(slices) == 0
            row, h = row[part], h[part]
            left = _spare(size, similarity) - np.bincount(row, minlength=b.num_rows)
            always = np.flatnonzero((left >= 0) & (size > 0))
            n = b.column(0).to_numpy(zero_copy_only=False)
            at = np.concatenate([row, always])
            yield pa.RecordBatch.from_arrays([pa.array(n[at]), pa.array(left[at]), pa.array(np.concatenate([h.view(np.int64), n[always] & (MARK - 1)]))], ["_n", "_left", "_g"])

    return rows.select("_n", "_text").mapInArrow(each, "_n long, _left long, _g long")


def _in_question(rows: DataFrame, words: int, similarity: float, slices: int = SLICES) -> DataFrame:
    """_n of the texts that can have a similar one. Already in a slice of the hashes, most texts have more shingles that no other
    text has than a similar text could lack; only the others are looked at any further."""
    sliced = _sliced(rows, words, similarity, slices)
    again = materialize(sliced.groupBy("_g").count().where(f"count > 1 or (_g >= 0 and _g < {MARK})").select("_g"), "again")
    met = sliced.join(again, "_g", "left_semi").groupBy("_n").agg(F.count("*").alias("_m"), F.first("_left").alias("_left"))
    return materialize(met.where("_m + _left >= 0").select("_n"), "in_question")


def similar_sets(rows: DataFrame, words: int, kind: str) -> DataFrame:
    """_n, _id, _size, _set (hashes of distinct shingles), _name (128 bits of the set), _fp (SimHash), _mark (the parity of the number
    of shingles in each of MARK cells: two sets differ in no more cells than in shingles), _far (the mark's distances to the references)."""

    def each(batches):
        import numpy as np
        import pyarrow as pa

        refs = np.unpackbits(np.frombuffer(b"".join(references()), np.uint8).reshape(REFERENCES, -1), axis=1, bitorder="little").astype(np.float32)
        for b in batches:
            row, h = shingle_sets(b.column(2).cast(pa.binary()).to_pylist(), words)
            size = np.bincount(row, minlength=b.num_rows)
            ends = np.cumsum(np.append(0, size))
            names, fps = [], np.zeros(b.num_rows, np.int64)
            for k, (s, e) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
                names.append(hashlib.blake2b(h[s:e].tobytes(), digest_size=16).digest())
                ones = sum(np.unpackbits(h[x : min(x + 65536, e)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for x in range(s, e, 65536))
                fps[k] = np.packbits(np.broadcast_to(ones, 64) * 2 > e - s, bitorder="little").view("<i8")[0]
            odd = np.bincount(row * MARK + (h & np.uint64(MARK - 1)).astype(np.int64), minlength=b.num_rows * MARK).reshape(-1, MARK) % 2
            far = odd.sum(1)[:, None] + refs.sum(1)[None, :] - 2 * (odd.astype(np.float32) @ refs.T)
            lists = lambda flat, each: pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * each), pa.array(flat))
            mark = lists(np.packbits(odd.astype(bool), axis=1, bitorder="little").view("<i8").ravel(), MARK // 64)
            sets = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(size.astype(np.int32)), sets, pa.array(names, pa.binary()), pa.array(fps), mark, lists(far.astype(np.int16).ravel(), REFERENCES)], ["_n", "_id", "_size", "_set", "_name", "_fp", "_mark", "_far"])

    return rows.select("_n", "_id", "_text").mapInArrow(each, f"_n long, _id {kind}, _size int, _set array<bigint>, _name binary, _fp long, _mark array<bigint>, _far array<smallint>")


def _heads(sets: DataFrame, similarity: float) -> DataFrame:
    """_n, _size, _at, _g: the first shingles of each set, those first that the fewest sets have, without those that no other set has.

    Two sets of this similarity have one of their first shingles in common: a set can't lack more than _spare of its shingles in the
    other, so in an order that is the same for all sets its first _spare + 1 can't all be missing there."""
    each = sets.select("_n", "_size", F.explode("_set").alias("_g"))
    often = each.groupBy("_g").agg(F.count("*").alias("_c")).where("_c > 1")
    lists = each.join(often, "_g").groupBy("_n", "_size").agg(F.sort_array(F.collect_list(F.struct("_c", "_g"))).alias("_l"))
    lists = lists.withColumn("_own", F.col("_size") - F.size("_l")).withColumn("_need", F.expr(f"_size - cast(ceil(_size * {similarity!r}D - 1e-9D) as int) + 1 - _own")).where("_need > 0")
    return lists.select("_n", "_size", "_own", F.posexplode(F.expr("slice(_l, 1, _need)")).alias("_p", "_e")).select("_n", "_size", (F.col("_own") + F.col("_p")).alias("_at"), "_e._g")


def _several(rows: DataFrame) -> DataFrame:
    """The rows of buckets in which several components meet."""
    several = rows.groupBy("_g").agg(F.min("_root").alias("_a"), F.max("_root").alias("_b")).where("_a <> _b").select("_g")
    return rows.join(several, "_g")


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """Pairs of sets whose SimHash fingerprints differ in at most LIMIT bits, found by the pivot tables; equal ones through their first."""
    firsts = materialize(sets.groupBy("_fp").agg(F.min("_n").alias("_first")), "firsts")
    equal = sets.select("_n", "_fp").join(firsts, "_fp").where("_n <> _first").select(*_pair("_n", "_first"))
    u, v = firsts.select(F.col("_fp").alias("u"), F.col("_first").alias("_nu")), firsts.select(F.col("_fp").alias("v"), F.col("_first").alias("_nv"))
    return links(firsts).join(u, "u").join(v, "v").select(*_pair("_nu", "_nv")).unionByName(equal)


def _star_pairs(rows: DataFrame) -> DataFrame:
    """One of the members of a bucket, another in each bucket, with each other member."""
    middle = rows.groupBy("_g").agg(F.min_by("_n", F.xxhash64("_n", "_g")).alias("_m"))
    return rows.join(middle, "_g").where("_n <> _m").select(*_pair("_n", "_m"))


def _limit(similarity: float, sizes: str) -> str:
    """In how many shingles two sets of this similarity can differ. Doubles: decimal literals would round."""
    return f"{(1 - similarity) / (1 + similarity)!r}D * ({sizes}) + 1e-6D"


def _differ(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (p, q) -> bit_count(p ^ q)), 0, (s, p) -> s + p)"


def _all_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """rows: _n, _g, _size, _at, _root, _mark. The pairs of a bucket whose members are of different components and can be similar by
    their sizes, places and marks: blocks of some CHUNK members are compared, so that only such pairs become rows.

    The first shingle that two sets share has what they share behind it: they can't share more than the shorter of the two rests that begin with it."""
    sizes = rows.groupBy("_g").agg(F.ceil(F.count("*") / CHUNK).alias("_m"))
    lists = rows.join(sizes, "_g").withColumn("_c", F.pmod(F.xxhash64("_n"), F.col("_m"))).groupBy("_g", "_c").agg(F.collect_list(F.struct("_n", "_size", "_at", "_root", "_mark")).alias("_l"))
    lists = materialize(lists, "lists")
    other = lists.select("_g", F.col("_c").alias("_d"), F.col("_l").alias("_k"))
    once = "x._root <> y._root and (_c < _d or x._n < y._n)"
    fits = f"least(x._size - x._at, y._size - y._at) >= {similarity / (1 + similarity)!r}D * (x._size + y._size) - 1e-6D"
    close = f"{_differ('x._mark', 'y._mark')} <= {_limit(similarity, 'x._size + y._size')}"
    near = F.expr(f"flatten(transform(_l, x -> transform(filter(_k, y -> {once} and {fits} and {close}), y -> struct(least(x._n, y._n) as u, greatest(x._n, y._n) as v))))")
    return lists.join(other, "_g").where("_c <= _d").select(F.explode(near).alias("_e")).select("_e.u", "_e.v")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets have this Jaccard similarity or more. Marks of such sets differ in at most as many cells as the sets do in
    shingles, and so do their distances to any reference (triangle inequality): what differs more is discarded, and no such pair is lost."""
    a = sets.select(F.col("_n").alias("u"), F.col("_size").alias("_za"), F.col("_far").alias("_fa"), F.col("_mark").alias("_ma"))
    b = sets.select(F.col("_n").alias("v"), F.col("_size").alias("_zb"), F.col("_far").alias("_fb"), F.col("_mark").alias("_mb"))
    limit = _limit(similarity, "_za + _zb")
    apart = "aggregate(zip_with(_fa, _fb, (x, y) -> abs(x - y)), 0, (s, x) -> greatest(s, cast(x as int)))"
    close = pairs.distinct().join(a, "u").join(b, "v").where(f"{apart} <= {limit}").where(f"{_differ('_ma', '_mb')} <= {limit}")
    close = materialize(close.select("u", "v", "_za", "_zb"), "close")
    both = close.join(sets.select(F.col("_n").alias("u"), F.col("_set").alias("_sa")), "u").join(sets.select(F.col("_n").alias("v"), F.col("_set").alias("_sb")), "v")
    return materialize(both.where(f"size(array_intersect(_sa, _sb)) * {1 + similarity!r}D >= {similarity!r}D * (_za + _zb) - 1e-6D").select("u", "v"), "links")


def near_copies(rows: DataFrame, number: str, id_col: str = "doc_id", text_col: str = "text", words: int = FINE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """rows: with a column that numbers them (see numbered). The number, _group and kept of each row that is in a group of near copies.

    Sets of distinct shingles with a Jaccard similarity of at least `similarity` are linked, all and none else; of a group the row with the
    smallest id (nulls last, then the smallest number) is kept. A text without words is in no group.

    Fingerprints that differ in at most LIMIT bits give the first candidates; similar sets may differ in more, so that what shares a
    shingle of its heads follows: each member of such a bucket meets one other, and at last all pairs of a bucket that aren't yet of one
    component. Each round's pairs pass the references, the marks and the sets."""
    rows = rows.select(F.col(number).alias("_n"), F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    asked = _in_question(rows, words, similarity)
    sets = materialize(similar_sets(rows.join(asked, "_n", "left_semi"), words, rows.schema["_id"].dataType.simpleString()), "sets")
    named = sets.groupBy("_name").agg(F.min("_n").alias("v"), F.count("*").alias("_m")).where("_m > 1").select("_name", "v")
    same = materialize(sets.select("_name", F.col("_n").alias("u")).join(named, "_name").where("u <> v").select("u", "v"), "same")
    firsts = sets.join(same.select(F.col("u").alias("_n")), "_n", "left_anti")

    heads = materialize(_heads(firsts.select("_n", "_size", "_set"), similarity), "heads")
    shared = materialize(_several(heads.withColumn("_root", F.col("_n"))), "shared")
    pairs = _fingerprint_pairs(firsts.select("_n", "_fp")).unionByName(_star_pairs(shared))
    found = same.unionByName(_verified(pairs, sets, similarity))
    roots = components(found).select(F.col("u").alias("_n"), F.col("v").alias("_to"))
    rooted = shared.drop("_root").join(roots, "_n", "left").withColumn("_root", F.coalesce("_to", "_n")).drop("_to")
    shared = _several(rooted).join(sets.select("_n", "_mark"), "_n")
    linked = components(found.unionByName(_verified(_all_pairs(shared, similarity), sets, similarity)))

    group = linked.select(F.col("u").alias("_n"), F.col("v").alias("_group")).unionByName(linked.select(F.col("v").alias("_n"), F.col("v").alias("_group")).distinct())
    group = materialize(group.join(sets.select("_n", "_id"), "_n"), "grouped")
    least = group.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("id"), F.col("_n").alias("n"))).alias("_k"))
    return group.join(least, "_group").select(F.col("_n").alias(number), "_group", (F.col("_n") == F.col("_k.n")).alias("kept"))
