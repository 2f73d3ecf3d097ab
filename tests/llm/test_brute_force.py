"""Operators that SQL can't express, on whole small tables against plain Python."""

import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from graphloom.llm import bytewords, decontamination, jaccard_join, sharding, token_counts, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text):
    w = [x.translate(LOWER) for x in WORDS.findall(text or "")]
    return frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


def components(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=160):
    """Copies, near copies in chains, a passage that many share, and very short texts."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[r.choice(words) for _ in range(r.choice([3, 5, 9, 40, 120]))] for _ in range(12)]
    passage = [r.choice(words) for _ in range(60)]
    out = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(words)
        if r.random() < 0.3:
            w = passage + [r.choice(words) for _ in range(r.choice([2, 10, 60]))]
        out.append((i, r.choice([" ", "\n"]).join(w).title() if r.random() < 0.5 else " ".join(w)))
    return out + [(n, None), (n + 1, "")]


@pytest.mark.parametrize(("seed", "settings_"), [(1, {}), (2, {"BLOCK": 4}), (3, {"BLOCK": 4, "SPLIT": 3, "LEAST_FREQUENT": 2, "BITMAP": 15})])
def test_jaccard_join_is_exact(spark, monkeypatch, seed, settings_):
    for k, v in settings_.items():
        monkeypatch.setattr(jaccard_join, k, v)
    docs = corpus(seed)
    got = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(docs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=4), min_size=1, max_size=6))
def test_fm_index_finds_all(s, phrases):
    index = decontamination.FMIndex(np.array([*s, 0], np.int64), sample=3)
    width = max(map(len, phrases))
    rows = np.zeros((len(phrases), width), np.int64)
    for i, p in enumerate(phrases):
        rows[i, width - len(p) :] = p
    known = np.array([max(p) < len(index.smaller) - 1 for p in phrases])
    low, high = index.search(np.where(known[:, None], rows, 0), np.array([len(p) for p in phrases]))
    for p, k, a, b in zip(phrases, known, low, high):
        if k:
            want = [i for i in range(len(s) - len(p) + 1) if s[i : i + len(p)] == p]
            assert sorted(index.locate(np.arange(a, max(a, b)))) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB 1\n\x0bé日_-", max_size=12)), max_size=5))
def test_byte_words_are_the_pattern(texts):
    for table, pattern in ((bytewords.BLANK_CUT, r"[^\x20\x09-\x0D]+"), (bytewords.ALNUM_CUT, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        raw, bounds = bytewords.buffer_of(pa.array(texts, pa.string()))
        starts, ends, h, first = bytewords.words_of(raw, bounds, table)
        got = [[bytes(bytewords.LOWER[raw[a:b]]).decode() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first, first[1:])]
        want = [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]
        assert got == want
        flat = [w for x in want for w in x]
        assert len(set(flat)) == len(set(h.tolist())) and len(set(zip(flat, h.tolist()))) == len(set(flat))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 1.\n'é", max_size=60), st.lists(st.tuples(st.integers(-1, 70), st.integers(-1, 20), st.text(alphabet="a \n1't", max_size=9)), max_size=4))
def test_edits_count_like_a_new_text(text, edits):
    count = test_edits_count_like_a_new_text.__dict__.setdefault("count", token_counts.Counter())
    tree = token_counts.grown(text, count)
    for at, cut, new in edits:
        text, _ = token_counts.edited(text, tree, at, cut, new, count)
        assert tree.total == len(count.encode(text)) and sum(tree.leaves()[0]) == len(text)
        assert token_counts.Tree.of(*tree.flat()).flat() == tree.flat()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=300), st.lists(st.tuples(st.floats(0, 1), st.floats(0, 1), st.lists(st.integers(1, 9), max_size=90)), max_size=6))
def test_tree_keeps_sums_through_splits_and_joins(leaves, changes):
    def checked(node):
        if node[3] is not None:
            assert len(node[3]) <= token_counts.FAN and len({checked(k) for k in node[3]}) <= 1  # all leaves are as deep
            assert node[:3] == [sum(k[i] for k in node[3]) for i in range(3)]
        return 1 + max((checked(k) for k in node[3] or ()), default=0)

    tree = token_counts.Tree(leaves, [2 * x for x in leaves])
    for a, b, new in changes:
        lo, hi = sorted((int(a * len(leaves)), int(b * len(leaves))))
        tree.replace(lo, hi, new, [2 * x for x in new])
        leaves = leaves[:lo] + new + leaves[hi:]
        assert tree.leaves() == (leaves, [2 * x for x in leaves]) and tree.n == len(leaves)
        checked(tree.root)
        for at in range(0, sum(leaves), 7):
            number, start = tree.leaf_at(at)
            assert sum(leaves[:number]) == start <= at < start + leaves[number]


def test_token_query_counts_what_a_tokenizer_counts(spark):
    """The query's own rows against encoding the texts and the edited texts anew."""
    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("no tables here")
    count = token_counts.Counter()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()}
    for r in token_counts.query(spark, at).collect():
        t = texts[r["doc_id"]]
        n = len(t)
        new = t
        for pos, cut, insert in ((n // 4, 8, "[MASKED]"), (n // 2, 0, " (note: checked) "), (n * 3 // 4, 24, "")):
            pos = min(pos, len(new))
            new = new[:pos] + insert + new[pos + cut :]
        assert (r["n_tokens"], r["n_tokens_edited"], r["n_chars_edited"]) == (len(count.encode(t)), len(count.encode(new)), len(new))


def test_shards_are_even_and_keep_links(spark):
    r = random.Random(5)
    rows = [(i, "x" * r.choice([1, 10, 50]) + str(i if i % 4 else i % 40)) for i in range(1200)]
    rows += [(5000 + i, "the same text again") for i in range(600)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    load = Counter()
    for x in got:
        load[x["shard"]] += x["size"]
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 8
    groups = defaultdict(Counter)
    for x in got:
        groups[x["text_crc32"]][x["shard"]] += 1
    pairs = [c for c in groups.values() if 1 < sum(c.values()) < 50]
    # at random about two fifths of such a group would share its commonest shard
    assert sum(max(c.values()) for c in pairs) > 0.65 * sum(sum(c.values()) for c in pairs)
    text = dict(rows)
    assert all(x["size"] == len(text[x["doc_id"]]) + 1 and x["text_crc32"] == zlib.crc32(text[x["doc_id"]].encode()) for x in got)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents with toxic ones, near copies and benchmark passages, and labels of the toxic ones."""
    r = random.Random(9)
    words = [a + b for a in "bcdfglmnprst" for b in ("ara", "elo", "imu", "onta", "uri")]
    at = tmp_path_factory.mktemp("tables")
    bench = [" ".join(r.choice(words) for _ in range(30)) for _ in range(3)]
    docs, labels = [], []
    for i in range(600):
        w = [r.choice(words) for _ in range(r.randrange(30, 80))]
        toxic = i % 6 == 0
        if toxic:
            for bad in ("vermin", "filth", "vermin"):
                w.insert(r.randrange(len(w)), bad if i % 12 else bad.replace("i", "1"))
        if i % 50 == 7:
            w[5:5] = bench[i % 3].split()
        docs.append((i, " ".join(w), "en", f"s{i % 3}", None))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, docs[i][1] + " more", "en", "s0", None) for i in range(1, 40)] + [(2000, None, "en", None, None), (2001, "", "en", "s1", None)]
    docs = [(a, b, c, d, None if b is None else len(b)) for a, b, c, d, _ in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return f"file://{at}"


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab1!i0.", min_size=1, max_size=7), st.integers(0, 5))
def test_viterbi_is_the_best_of_all_readings(token, seed):
    lm = np.random.default_rng(seed).uniform(0.1, 8, 1 << 18).astype(np.float32)

    def cost(ways):
        state, total = 0, 0.0
        for letters, extra in ways:
            total += extra
            for c in toxicity.codes_of(letters).tolist() if letters else ():
                total += float(lm[(state << 6) | c])
                state = ((state << 6) | c) & 4095
        return total + float(lm[state << 6]), "".join(x for x, _ in ways)

    best = min(cost(ways) for ways in itertools.product(*toxicity.readings(token)))
    got = toxicity.decoded(token, lm)
    assert min(cost(ways)[0] for ways in itertools.product(*toxicity.readings(token)) if "".join(x for x, _ in ways) == got) == pytest.approx(best[0], abs=1e-4)


def test_toxicity_held_out(spark, sf_dir):
    got = toxicity.query(spark, sf_dir).collect()
    held = [x for x in got if x["held_out"] and x["doc_id"] < 600]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in got)
    assert sum(x["predicted"] == (x["doc_id"] % 6 == 0) for x in held) > 0.97 * len(held)


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, bench = docs.columns, [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean, kept_, cut, mixed, shards = None, None, None, None, None
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.kept(stage(spark, docs, sf_dir), name)
        tables.append(docs)
    clean, kept_, cut, mixed, shards = ([r.asDict() for r in t.collect()] for t in tables)
    assert all(t.columns == columns for t in tables[:-1])
    # toxic ones go and clean ones stay
    assert not [r for r in clean if r["doc_id"] < 600 and r["doc_id"] % 6 == 0 and r["doc_id"] % 12] and len([r for r in clean if r["doc_id"] < 600]) >= 495
    # one of each component of what was kept
    want = components([(r["doc_id"], r["text"]) for r in clean])
    assert sorted(r["doc_id"] for r in kept_) == sorted(i for i, (_, c) in want.items() if c == i)
    # passages are gone, all else is there
    assert len(cut) == len(kept_) and not [r for r in cut if any(b in (r["text"] or "") for b in bench)]
    before = {r["doc_id"]: r["text"] for r in kept_}
    for r in cut:
        words = (before[r["doc_id"]] or "").split()
        for b in bench:
            n = len(b.split())
            for i in range(len(words) - n + 1):
                if words[i : i + n] == b.split():
                    words[i : i + n] = [None] * n
        assert (r["text"] or "").split() == [w for w in words if w]
    # the mix repeats whole documents, near the targets
    size = lambda t: len(WORDS.findall(t or ""))
    copies = Counter(r["doc_id"] for r in mixed)
    assert set(copies) <= {r["doc_id"] for r in cut} and max(copies.values()) <= 3
    total = sum(size(r["text"]) for r in cut)
    assert abs(sum(size(r["text"]) for r in mixed) - total) < 0.05 * total
    assert sorted((r["doc_id"]) for r in shards) == sorted(r["doc_id"] for r in mixed)
    load = Counter()
    for r in shards:
        load[r["shard"]] += r["size"]
    assert len(load) == 8 and max(load.values()) - min(load.values()) < 0.1 * sum(load.values()) / 8
