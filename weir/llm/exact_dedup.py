"""Exact duplicates by deterministic block naming.

Texts are cut into fixed-size blocks. The distinct blocks are sorted and get integer names; then names of adjacent pairs
are named again, level by level, until a text has one name. Two texts have the same (level, name) exactly when their
bytes are equal. A 64-bit hash only routes a block to its name; hashes shared by different blocks are found and those
blocks are joined by content, so no collision can merge two texts.

Scale: each distinct block is shuffled once (copies collapse before the shuffle); all else is a few integers a block.
Joins on names are plain equi-joins, which adaptive execution splits when one name is hot.

Defined results: a null text counts as empty; empty texts are equal to each other; rows repeated in full are copies, one of
which stays; of equal ids the row that was read first stays; null ids lose against any id; an empty table gives an empty result;
columns other than id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

BLOCK = 4096


def _blocks(block: int, each: str) -> Column:
    last = f"greatest(cast((length(_b) - 1) div {block} as int), 0)"
    return F.expr(f"transform(sequence(0, {last}), i -> {each.format(f'substring(_b, i * {block} + 1, {block})')})")


def block_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, row_id: str | None = None) -> DataFrame:
    """One row per row of docs: _rid (row_id if given, else a number), _id, _sha (of the text), _level and _name.

    (_level, _name) is the identity of the text: equal if and only if the bytes are."""
    bytes_of = text_of(text_col).cast("binary")
    rid = F.col(row_id) if row_id else F.monotonically_increasing_id()
    rows = docs.select(rid.alias("_rid"), F.col(id_col).alias("_id"), bytes_of.alias("_b"))
    rows = materialize(rows.select("_rid", "_id", F.sha2("_b", 256).alias("_sha"), _blocks(block, "xxhash64({})").alias("_hs")), "blocks")

    contents = docs.select(bytes_of.alias("_b")).select(F.explode(_blocks(block, "{}")).alias("_block"))
    contents = contents.select(F.xxhash64("_block").alias("_h"), "_block")
    names = materialize(contents.distinct().sortWithinPartitions("_block").select("_h", F.monotonically_increasing_id().alias("_name")), "names")
    shared = names.groupBy("_h").count().where("count > 1").select("_h")

    at = rows.select("_rid", F.size("_hs").alias("_m"), F.posexplode("_hs").alias("_pos", "_h"))
    if shared.isEmpty():
        level = at.join(names, "_h").select("_rid", "_m", "_pos", "_name")
    elif not row_id:  # a second pass over the texts needs numbers that a new scan can't change
        numbered = materialize(docs.select(F.monotonically_increasing_id().alias("_n"), F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), "numbered")
        return block_identities(numbered, "_id", "_t", block, "_n")
    else:
        shared = materialize(shared, "shared")
        odd = contents.join(shared, "_h", "left_semi")
        odd_names = materialize(odd.distinct().sortWithinPartitions("_block").select("_h", "_block", (-2 - F.monotonically_increasing_id()).alias("_name")), "odd")
        here = docs.select(rid.alias("_rid"), bytes_of.alias("_b")).select("_rid", F.posexplode(_blocks(block, "{}")).alias("_pos", "_block"))
        here = here.withColumn("_h", F.xxhash64("_block")).join(odd_names, ["_h", "_block"]).select("_rid", "_pos", "_name")
        plain = at.join(names.join(shared, "_h", "left_anti"), "_h").select("_rid", "_m", "_pos", "_name")
        level = plain.unionByName(at.join(here, ["_rid", "_pos"]).select("_rid", "_m", "_pos", "_name"))

    longest = rows.agg(F.max(F.size("_hs"))).first()[0] or 1
    done, k = [], 0
    level = materialize(level, "level0")
    while True:
        done.append(level.where("_m = 1").select("_rid", F.lit(k).alias("_level"), "_name"))
        if longest <= 1:
            break
        right = F.max(F.expr("if(_pos % 2 = 1, _name, null)"))
        pairs = level.where("_m > 1").groupBy("_rid", "_m", F.expr("_pos div 2").alias("_pos")).agg(F.max(F.expr("if(_pos % 2 = 0, _name, null)")).alias("_l"), F.coalesce(right, F.lit(-1)).alias("_r"))
        pairs = materialize(pairs, "pairs")
        named = materialize(pairs.select("_l", "_r").distinct().sortWithinPartitions("_l", "_r").select("_l", "_r", F.monotonically_increasing_id().alias("_name")), "named")
        k, longest = k + 1, (longest + 1) // 2
        level = materialize(pairs.join(named, ["_l", "_r"]).select("_rid", F.expr("cast((_m + 1) div 2 as int)").alias("_m"), F.col("_pos").cast("int").alias("_pos"), "_name"), f"level{k}")
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    return materialize(rows.drop("_hs").join(found, "_rid"), "identities")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, row_id: str | None = None) -> DataFrame:
    """_rid, the id, keep_id, group_size, kept, text_sha256: of equal texts the row with the largest id stays."""
    rows = block_identities(docs, id_col, text_col, block, row_id)
    groups = rows.groupBy("_level", "_name").agg(F.max(F.struct(F.col("_id").alias("id"), (-F.col("_rid")).alias("r"))).alias("_k"), F.count("*").alias("group_size"))
    joined = rows.join(groups, ["_level", "_name"])
    return joined.select("_rid", F.col("_id").alias(id_col), F.col("_k.id").alias("keep_id"), "group_size", (F.col("_rid") == -F.col("_k.r")).alias("kept"), F.col("_sha").alias("text_sha256"))
