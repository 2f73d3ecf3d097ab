"""What the similarity join leaves on disk, and how many candidates it makes."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.llm import jaccard_join
from tests.llm.test_brute_force import components


def near_copies(n, seed=3):
    """Near copies of a few texts, in chains that centres alone do not close."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = [[r.choice(words) for _ in range(60)] for _ in range(8)]
    out = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.randrange(4)):
            w[r.randrange(60)] = r.choice(words)
        out.append((i, " ".join(w)))
    return out


def files_of(top):
    return {os.path.join(d, f) for d, _, names in os.walk(top) for f in names}


@pytest.fixture
def shuffle_files(spark):
    tops = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    return lambda: {f for t in tops for f in files_of(str(t)) if os.path.basename(f).startswith("shuffle_") and f.endswith(".data")}


def test_join_deletes_what_it_has_used(spark):
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared))
    got = jaccard_join.jaccard_components(spark.createDataFrame(near_copies(120), "doc_id long, text string"))
    assert sorted(x.rpartition("-")[0] for x in set(os.listdir(shared)) - before) == ["cc-labels", "jac-classes", "jac-summary"]
    assert got.count() == 120


def test_shuffle_files_go_with_the_step(spark, shuffle_files):
    before = shuffle_files()
    kept = jaccard_join.kept(spark.range(4000).groupBy((F.col("id") % 1000).alias("k")).count(), "step")
    for _ in range(50):
        if not (left := shuffle_files() - before):
            break
        time.sleep(0.1)
    assert not left and kept.count() == 1000


def test_rare_tokens_lead(spark, monkeypatch):
    """A passage in fewer sets than LEAST_FREQUENT makes no candidates among sets whose other tokens are their own."""
    seen, centres = [], jaccard_join._centres
    monkeypatch.setattr(jaccard_join, "_centres", lambda runs: seen.append(runs.count()) or centres(runs))
    passage = " ".join(f"p{k}" for k in range(16))
    docs = [(i, " ".join([passage] + [f"w{i}x{k}" for k in range(60)])) for i in range(jaccard_join.LEAST_FREQUENT - 4)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r["doc_id"] == r["component_id"] for r in got) and len(got) == len(docs)
    assert seen[0] <= len(docs) // 10  # 299 before; a few cells may hold two tokens


@pytest.mark.parametrize("cells", [1, 6, 25])
def test_any_order_gives_the_links(spark, monkeypatch, cells):
    monkeypatch.setattr(jaccard_join, "CELLS", cells)
    monkeypatch.setattr(jaccard_join, "RANGE_TOKENS", 1 << 9)
    docs = near_copies(120)
    got = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(docs)
