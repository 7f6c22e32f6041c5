import hashlib
from collections import defaultdict

import pytest
from cases import documents, empty, texts

from weir.llm.exact_dedup import block_identities, exact_dedup


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_against_brute_force(spark, block):
    got = exact_dedup(documents(spark), block=block).collect()
    rows = texts()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and len({r.text_sha256 for r in kept}) == len(groups)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.doc_id in ids and r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id


def test_blocks_whose_hashes_collide_are_told_apart(spark, monkeypatch):
    import weir.llm.exact_dedup as m
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(m, "_blocks", lambda block, each, f=m._blocks: f(block, each.replace("xxhash64({})", "xxhash64({}) % 3")))
    monkeypatch.setattr(m.F, "xxhash64", lambda *c: real(*c) % 3 if c == ("_block",) else real(*c))
    got = m.exact_dedup(documents(spark), block=256).collect()
    assert sum(r.kept for r in got) == len({t or "" for _, t in texts()})


def test_empty_table(spark):
    assert exact_dedup(empty(spark)).collect() == []
    assert block_identities(empty(spark)).count() == 0
