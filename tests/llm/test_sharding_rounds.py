"""Groups of copies stay whole where they fit a shard, however many rows are copies."""

import random
from collections import Counter, defaultdict

from graphloom.llm import sharding


def placed(spark, texts):
    got = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    groups, load = defaultdict(Counter), Counter()
    for r in got:
        groups[texts[r["doc_id"]]][r["shard"]] += 1
        load[r["shard"]] += r["size"]
    return groups, load


def test_a_third_of_the_rows_are_copies(spark):
    r = random.Random(3)
    texts = [f"group {g} " + "w" * 60 for g in range(20) for _ in range(r.randint(2, 51))]
    texts += [f"alone {i} " + "w" * 60 for i in range(2 * len(texts))]
    groups, load = placed(spark, texts)
    assert all(len(c) == 1 for c in groups.values())
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 8


def test_only_the_group_that_fits_no_shard_is_cut(spark):
    texts = ["the largest group of all"] * 400 + [f"group {g} of this small text" for g in range(40) for _ in range(10)]
    groups, load = placed(spark, texts)
    assert [t for t, c in groups.items() if len(c) > 1] == ["the largest group of all"]
    assert max(load.values()) <= 1.05 * sum(load.values()) / 8
