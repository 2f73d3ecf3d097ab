"""Benchmark decontamination by an FM-index for each training shard.

A shard is as many whole documents as have about `SHARD_BYTES` bytes of text. Its words (A-Z lower-cased) become
symbols of the shard's own alphabet, documents are kept apart by a symbol that no phrase has, and an index is
built: suffixes sorted by doubling, the Burrows-Wheeler transform in a wavelet matrix whose levels are bit vectors
with counts, and every `SAMPLE`-th position of the text. All windows of all benchmark items are searched backwards
together; found intervals are located by stepping to sampled positions, and overlapping windows merge to spans.

An index lives only while its shard is searched: a task holds one shard, and a lost executor costs its shards'
time. Phrases are broadcast in blocks of at most `BLOCK_BYTES` bytes of items; a shard's index is built once and searched for
all blocks, one after the other. Words are compared by 64-bit hashes; a false hit needs two words that collide
next to nine equal ones.

Null texts have no words. Items without words, or null, have no windows; items of fewer than ten words are one
window. A null item id counts as the empty string. Repeated documents are judged each, repeated items count once.
Without documents or items the results are empty, or clean. All columns of the documents pass through, unless they
have a name of the results, which then replace them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import ALNUM_CUT, buffer_of, words_of
from .common import pieces

WINDOW, SHARD_BYTES, BLOCK_BYTES, SAMPLE = 10, 4 << 20, 1 << 20, 16


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of s (non-negative, the last one the only 0) by the order of the suffixes there; sorts only what is still tied."""
    n = len(s)
    key = s.astype(np.uint64) << np.uint64(32)
    key[:-1] |= s[1:].astype(np.uint64)
    order = np.argsort(key)
    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    rank = np.empty(n, np.int64)
    size = np.diff(np.r_[first, n])
    rank[order] = np.repeat(first, size)
    tied = np.flatnonzero(np.repeat(size > 1, size))  # places in order
    h = 2
    while len(tied):
        at = order[tied]
        group = rank[at]
        ahead = at + h
        follow = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1) + 1
        key = (group.astype(np.uint64) << np.uint64(32)) | follow.astype(np.uint64)
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[tied] = at
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(tied)])
        rank[at] = np.repeat(tied[first], size)
        tied = tied[np.repeat(size > 1, size)]
        h *= 2
    return order


class Bits:
    """A bit vector with counts: how many ones lie before each of many places."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.r_[packed, np.zeros(-len(packed) % 8 + 8, np.uint8)].view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = n - int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class FMIndex:
    def __init__(self, s: np.ndarray, sample: int = SAMPLE):
        """s: symbols, the last one the only 0."""
        order = suffix_array(s)
        bwt = s[order - 1]
        self.levels, self.bits = [], max(1, int(s.max()).bit_length())
        self.smaller = np.zeros(int(s.max()) + 2, np.int64)
        np.cumsum(np.bincount(s, minlength=len(self.smaller) - 1), out=self.smaller[1:])
        now = bwt
        for b in range(self.bits - 1, -1, -1):
            ones = (now >> b) & 1 == 1
            self.levels.append(Bits(ones))
            now = np.concatenate([now[~ones], now[ones]])
        self.marked = Bits(order % sample == 0)
        self.samples = order[order % sample == 0]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of each symbol stand before place i of the transform."""
        low = np.zeros(len(i), np.int64)
        for b, level in zip(range(self.bits - 1, -1, -1), self.levels):
            one = (symbol >> b) & 1 == 1
            r, l = level.rank(i), level.rank(low)
            i, low = np.where(one, level.zeros + r, i - r), np.where(one, level.zeros + l, low - l)
        return i - low

    def back(self, i: np.ndarray) -> np.ndarray:
        """From the place of a suffix to that of the suffix one symbol longer."""
        at, symbol, low = i, np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for level in self.levels:
            one = level.get(at)
            r, l = level.rank(at), level.rank(low)
            at, low = np.where(one, level.zeros + r, at - r), np.where(one, level.zeros + l, low - l)
            symbol = symbol * 2 + one
        return self.smaller[symbol] + at - low

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that start with each phrase; phrases are right-aligned rows."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.smaller[-1])
        width = phrases.shape[1]
        for j in range(width - 1, -1, -1):
            go = np.flatnonzero((low < high) & (lengths >= width - j))
            if not len(go):
                break
            c = phrases[go, j]
            low[go], high[go] = self.smaller[c] + self.rank(c, low[go]), self.smaller[c] + self.rank(c, high[go])
        return low, high

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes at places i."""
        out, todo, steps, at = np.empty(len(i), np.int64), np.arange(len(i)), 0, i.copy()
        while len(todo):
            found = self.marked.get(at)
            out[todo[found]] = self.samples[self.marked.rank(at[found])] + steps
            todo, at = todo[~found], self.back(at[~found])
            steps += 1
        return out


def phrases_of(items: list[tuple[str, str]], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, list[list[int]], list[str]]:
    """Distinct windows as right-aligned rows of word hashes, their lengths, the items that have each, and the items' ids."""
    ids = sorted({i for i, _ in items})
    number = {x: k for k, x in enumerate(ids)}
    _, _, h, first = words_of(*buffer_of(pa.array([t for _, t in items], pa.large_string())), ALNUM_CUT)
    owners: dict[tuple, set] = defaultdict(set)
    for k, (i, _) in enumerate(items):
        own = h[first[k] : first[k + 1]].tolist()
        for j in range(max(1, len(own) - window + 1) if own else 0):
            owners[tuple(own[j : j + window])].add(number[i])
    rows = np.zeros((len(owners), window), np.uint64)
    for r, phrase in enumerate(owners):
        rows[r, window - len(phrase) :] = phrase
    return rows, np.array([len(p) for p in owners], np.int64), [sorted(x) for x in owners.values()], ids


class Shard:
    """Whole documents as one string of symbols, with an index that is built when a phrase first needs it."""

    def __init__(self, texts: pa.Array):
        self.starts, self.ends, self.h, self.first = words_of(*buffer_of(texts), ALNUM_CUT)
        self.n_docs = len(texts)
        self.alphabet, self.symbols = np.unique(self.h, return_inverse=True)
        self.index = None

    def built(self) -> FMIndex:
        if self.index is None:
            # 0 ends the shard, 1 ends a document
            s = np.ones(len(self.h) + self.n_docs + 1, np.int64)
            s[np.arange(len(self.h)) + np.repeat(np.arange(self.n_docs), np.diff(self.first))] = self.symbols + 2
            s[-1] = 0
            self.index = FMIndex(s)
        return self.index

    def find(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word in it, and phrase of each hit."""
        none = np.zeros(0, np.int64)
        if not len(self.h) or not len(phrases):
            return none, none, none
        place = np.searchsorted(self.alphabet, phrases)
        known = (place < len(self.alphabet)) & (self.alphabet[np.minimum(place, len(self.alphabet) - 1)] == phrases)
        usable = np.flatnonzero((known | (np.arange(phrases.shape[1]) < phrases.shape[1] - lengths[:, None])).all(1))
        if not len(usable):
            return none, none, none
        index = self.built()
        low, high = index.search(place[usable] + 2, lengths[usable])
        found = high - low
        which = np.repeat(usable, found)
        spots = index.locate(np.repeat(low, found) + np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found))
        base = self.first[:-1] + np.arange(self.n_docs)  # where each document begins in the symbols
        doc = np.searchsorted(base, spots, side="right") - 1
        return doc, spots - base[doc], which


SPAN = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    """Half-open ranges that overlap or touch, as one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, spans (words first to last, exclusive; bytes start to end of the UTF-8 text) and items (ids as strings)."""
    spark = docs.sparkSession
    rows = items.where(F.col(item_text).isNotNull()).select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + F.octet_length("id") + 16)).first()[0] or 0
    blocks = max(1, -(-2 * size // BLOCK_BYTES)) if size > BLOCK_BYTES else 1
    rest = [c for c in docs.columns if c not in {"n_words", "spans", "items"}]
    out = docs.select(*[F.col(f"`{c}`") for c in rest], F.lit(0).cast("long").alias("n_words"), F.array().cast(SPAN).alias("spans"), F.array().cast("array<string>").alias("items"))
    phrases = []
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else rows
        phrases.append(spark.sparkContext.broadcast(phrases_of([(r[0], r[1]) for r in part.collect()], window)))
    return out.mapInArrow(_searcher(phrases, rest.index(text)), out.schema)


def _once(block):
    """A broadcast's value, which the worker forgets again: it holds one block of phrases at a time."""
    value = block.value
    block.__dict__.pop("_value", None)
    return value


def _searcher(phrases: list, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = phrases[0].value if len(phrases) == 1 else None
        held, size = [], 0
        for batch in pieces(batches):
            held.append(batch)
            size += batch.column(at).nbytes
            if size >= SHARD_BYTES:
                yield from searched(held, one)
                held, size = [], 0
        if held:
            yield from searched(held, one)

    def searched(held, one):
        table = pa.Table.from_batches(held).combine_chunks()
        texts = table.column(at).combine_chunks() if table.num_rows else pa.array([], table.schema.field(at).type)
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        shard = Shard(texts)
        hits: dict[int, list] = defaultdict(list)
        owned: dict[int, set] = defaultdict(set)
        for block in phrases:
            rows, lengths, owners, ids = one or _once(block)
            for d, w, p in zip(*(x.tolist() for x in shard.find(rows, lengths))):
                hits[d].append((w, w + int(lengths[p])))
                owned[d].update(ids[i] for i in owners[p])
        first, (_, bounds) = shard.first, buffer_of(texts)
        columns = [pa.array(np.diff(first), pa.int64()), table.column(-2), table.column(-1)]
        if hits:
            spans, items = table.column(-2).to_pylist(), table.column(-1).to_pylist()
            for d, own in hits.items():
                spans[d] = [{"first": a, "last": b, "start": int(shard.starts[first[d] + a] - bounds[d]), "end": int(shard.ends[first[d] + b - 1] - bounds[d])} for a, b in merged(own)]
                items[d] = sorted(owned[d])
            columns[1:] = [pa.array(spans, table.column(-2).type), pa.array(items, table.column(-1).type)]
        for k, column in zip((3, 2, 1), columns):
            table = table.set_column(table.num_columns - k, table.schema.field(table.num_columns - k), column)
        yield from table.to_batches()

    return run


def without_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (with spans) without what the spans cover; native slices of the UTF-8 bytes."""
    raw = F.col(text).cast("binary")
    n = F.size("spans")
    keep = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.decode(
            F.substring(raw, F.when(i == 0, F.lit(1)).otherwise(F.get("spans", i - 1)["end"] + 1).cast("int"), (F.when(i == n, F.octet_length(text).cast("long")).otherwise(F.get("spans", i)["start"]) - F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1)["end"])).cast("int")),
            "UTF-8",
        ),
    )
    return docs.withColumn(text, F.when(n > 0, F.array_join(keep, "")).otherwise(F.col(text)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; documents stay."""
    columns = docs.columns
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    cut = without_spans(found)
    return cut.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


ORACLE = rf"""
    WITH d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
    b AS (SELECT coalesce(item_id::varchar, '') id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
    p AS (SELECT DISTINCT id, least(len(w), {WINDOW}) n, array_to_string(w[i:i + {WINDOW - 1}], ' ') x FROM (SELECT id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) i FROM b WHERE len(w) > 0)),
    v AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) i FROM d), (SELECT DISTINCT n FROM p) WHERE i + n - 1 <= len(w)),
    h AS (SELECT r, i, n, id FROM v JOIN p USING (n, x)),
    c AS (SELECT r, count(DISTINCT k) n_hit FROM (SELECT r, unnest(range(i, i + n)) k FROM h) GROUP BY r),
    t AS (SELECT r, count(*) n_items, string_agg(id, ',' ORDER BY id) ids FROM (SELECT DISTINCT r, id FROM h) GROUP BY r)
    SELECT doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""
