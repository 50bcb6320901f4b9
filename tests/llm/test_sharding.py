"""Groups that a shard can't hold take no room from those it can."""

from __future__ import annotations

import collections

from terravane.llm.sharding import sharded


def shards_of_groups(docs):
    """Shards that each text of several rows is in."""
    got = sharded(docs).select("text_crc32", "shard").collect()
    sizes = collections.Counter(r.text_crc32 for r in got)
    where = collections.defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    return {k: (sizes[k], len(where[k])) for k in sizes if sizes[k] > 1}


def test_a_group_larger_than_a_quota(spark):
    texts = ["large"] * 450 + [f"three {k // 3}" for k in range(1500)] + [f"alone {k}" for k in range(1250)]
    found = shards_of_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert len(found) == 501
    assert next(n for size, n in found.values() if size == 450) <= 6  # of 200 rows each
    assert sum(n > 1 for size, n in found.values() if size == 3) <= 5
