"""Exact n-gram Jaccard self-join with a token-group matrix.

Documents are sets of hashed word shingles. Equal sets are one class from the start. Two sets of n and m tokens can
only reach similarity t if they share k tokens among each one's first n - ceil(t n) + k in any one order of all
tokens; k grows with the set, so a few shared passages don't make a candidate. The order here puts tokens that
many documents have last, by powers of two of their counts, and goes by hash otherwise; the counts come from all
documents, and only order is at stake, never results. What common tokens cost grows with the square of the sets that lead with them,
so rarer ones are told apart as well, by cells of hashes; the more tokens a cell holds, the fewer.

1. `_described`: one pass over the texts gives each document's set size and digest, and token counts as sorted blobs
   by hash range. `_frequent` sums these; at most `MOST_FREQUENT` tokens are kept, as the least count that makes a
   token frequent grows with the number of tokens. All tokens are counted by cell, of at most 2^`CELLS`; a token that isn't
   kept has the place of what its cell holds over the mean.
2. `_postings`, `_runs`: the leading tokens of each set, by hash range; a token that only one set leads with is dropped.
   A token of very many sets is cut by set into parts of about `SPLIT`, so that no task holds it whole.
3. Groups: a set goes to the centre (the smallest set of a token's run) that it shares most leading tokens with. A
   group is first held against its centre alone; sets that are similar to it get one label. Groups are then cut into
   blocks of at most `BLOCK` sets and about `BLOCK_TOKENS` tokens, sets of one label apart from those still alone.
4. Matrix: two blocks that share k leading tokens in the union, and aren't of one label throughout, are a pair. For
   each block that is asked, the union of all its sets' tokens is stored as its row of the matrix; a set of the other block
   asks it only if at least t n of its n tokens are in that row (`_bound`). Only blocks that qualify are opened (`_open`) and their sets
   compared; a block is opened for itself too. All links but those to a group's centre come from opened blocks.

No pair of a large group is enumerated: centres are compared once with each set, a block's links are a spanning
forest, and blocks of one label never meet. Tokens travel as hashes (8 bytes each), never as texts. Sets that may be needed are picked
by a bitmap of at most 2^`BITMAP` bits, at every size; a false hit is dropped by the join that follows.

Null and empty texts, and texts without words, have empty sets, linked with nothing. Repeated and null ids are rows of their
own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import BLANK_CUT, buffer_of, shingles, words_of
from .common import dropped, kept_lean as kept, kept_small, pieces
from .components import components

WORDS, SIMILAR = 5, (4, 5)  # shingle length; similarity as a fraction
MOST_FREQUENT, LEAST_FREQUENT = 1 << 21, 64
CELLS = 25
BLOCK, BLOCK_TOKENS = 128, 1 << 20
RANGE_TOKENS, SPLIT = 1 << 20, 1 << 17
FLUSH = 1 << 20
BITMAP = 27
SPLIT_PART = 1 << 44  # parts from here on are cuts of one frequent token


def needed(n: np.ndarray) -> np.ndarray:
    """ceil(t n) in whole numbers."""
    p, q = SIMILAR
    return (n * p + q - 1) // q


def depth(n: np.ndarray) -> np.ndarray:
    """k: how many leading tokens must be shared, where n is the smaller set's size."""
    return 1 + n // 16


def similar(overlap, n, m):
    p, q = SIMILAR
    return q * overlap >= p * (n + m - overlap)


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, bounds = buffer_of(texts)
    _, _, h, first = words_of(raw, bounds, BLANK_CUT)
    tokens, at = shingles(h, first, WORDS)
    for i in range(len(texts)):
        yield np.unique(tokens[at[i] : at[i + 1]])


def _key(tokens: np.ndarray) -> tuple[str, int]:
    """The set's name, 128 bits, and a number for joins, 64 bits."""
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return d.hex(), int.from_bytes(d[:8], "little", signed=True)


def _range_of(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(tokens), np.int64)


DESCRIBED = "doc_id long, n long, name string, key long, part long, tokens binary, again binary, counts binary"


def _described(docs: DataFrame, bits: int) -> DataFrame:
    """A row for each document (doc_id, n, name, key; part null), and rows of token counts by range (part, tokens, again, counts).

    A counted token is its range and the next 24 bits; blobs hold these 24 bits, and counts over one with their places.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in DESCRIBED.split(", ")]
    batch_of = lambda cols, n: pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(cols, kinds)], names)

    def counted(held):
        tokens, counts = np.unique((np.concatenate(held) >> np.uint64(40 - bits)), return_counts=True)
        part = (tokens >> np.uint64(24)).astype(np.int64)
        cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
        low = np.ascontiguousarray((tokens & np.uint64(0xFFFFFF)).astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :3]
        out: list[list] = [[], [], [], []]
        for a, b in zip(cuts[:-1], cuts[1:]):
            again = np.flatnonzero(counts[a:b] > 1)
            for column, value in zip(out, (int(part[a]), low[a:b].tobytes(), again.astype("<u4").tobytes(), (counts[a:b][again] - 1).astype("<u4").tobytes())):
                column.append(value)
        return batch_of([None] * 4 + out, len(out[0]))

    def run(batches):
        held, size = [], 0
        for batch in pieces(batches):
            n, names_, keys = [], [], []
            for tokens in _sets(batch.column(1)):
                name, key = _key(tokens) if len(tokens) else (None, None)
                n.append(len(tokens)), names_.append(name), keys.append(key), held.append(tokens)
                size += len(tokens)
            yield batch_of([batch.column(0), n, names_, keys] + [None] * 4, batch.num_rows)
            if size >= FLUSH:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    return docs.mapInArrow(run, DESCRIBED)


def _cells(total: int, bits: int) -> int:
    """Cells are named by so many leading bits of a hash: two to four a token, up to 2^CELLS, and two to a range at least."""
    return max(bits + 1, min(CELLS, bits + 24, total.bit_length() + 1))


def _frequent(blobs: DataFrame, total: int, bits: int) -> DataFrame:
    """(token, count) of frequent tokens, each as its range and 24 bits; and by range (token) the ranks of its cells, 4 bits each, with no count."""
    least = max(LEAST_FREQUENT, -(-total // MOST_FREQUENT))
    inside = _cells(total, bits) - bits
    mean = total >> (inside + bits)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        low, extra = [], []
        for tokens, again, counts in zip(*(table.column(c).to_pylist() for c in ("tokens", "again", "counts"))):
            b = np.zeros((len(tokens) // 3, 4), np.uint8)
            b[:, :3] = np.frombuffer(tokens, np.uint8).reshape(-1, 3)
            low.append(b.view("<u4").ravel())
            extra.append(np.repeat(low[-1][np.frombuffer(again, "<u4")], np.frombuffer(counts, "<u4")))
        tokens, counts = np.unique(np.concatenate(low + extra), return_counts=True)
        held = np.bincount(tokens >> np.uint32(24 - inside), counts, 1 << inside)
        rank = np.minimum(np.log2(np.maximum(held - mean, 0) + 1), 15).astype(np.uint8)
        many = counts >= least
        token = np.r_[tokens[many].astype(np.int64) + (key[0].as_py() << 24), key[0].as_py()]
        n = len(token) - 1
        return pa.table({"token": pa.array(token), "count": pa.array([*counts[many].tolist(), None], pa.int64()), "ranks": pa.array([None] * n + [(rank[::2] | rank[1::2] << 4).tobytes()], pa.binary())})

    return blobs.groupBy("part").applyInArrow(add, "token long, count long, ranks binary")


def _order(blobs: DataFrame, total: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of _frequent: the frequent tokens in order, their counts, the ranks of all cells, two a byte, and the bits that name a cell."""
    got = _frequent(blobs, total, bits).toArrow().sort_by("token")
    hot, ranges = got.filter(pc.is_valid(got["count"])), got.filter(pc.is_null(got["count"]))
    cells = _cells(total, bits)
    ranks = np.zeros(1 << (cells - 1), np.uint8)
    size = 1 << (cells - bits - 1)
    for part, blob in zip(ranges["token"].to_pylist(), ranges["ranks"]):
        ranks[part * size : (part + 1) * size] = np.frombuffer(blob.as_buffer(), np.uint8)
    return hot["token"].to_numpy().astype(np.uint64), hot["count"].to_numpy(), ranks, cells


def _postings(docs: DataFrame, bits: int, frequent) -> DataFrame:
    """(part, tokens, keys, sizes): the leading tokens of all sets, with their sets' keys and sizes, as blobs by part; copies of a task count once."""

    def run(batches):
        hot, count, ranks, cells = frequent.value
        rank = np.log2(np.maximum(count, 1)).astype(np.int64)
        held: list[tuple] = []
        size = 0

        def flush():
            tokens, keys, sizes = (np.concatenate(x) for x in zip(*held))
            by = np.lexsort((keys, tokens))
            by = by[np.r_[True, (np.diff(tokens[by].view(np.int64)) != 0) | (np.diff(keys[by]) != 0)]]
            tokens, keys, sizes = tokens[by], keys[by], sizes[by]
            part = _range_of(tokens, bits)
            if len(hot):
                short = tokens >> np.uint64(40 - bits)
                i = np.minimum(np.searchsorted(hot, short), len(hot) - 1)
                cut = (hot[i] == short) & (count[i] > SPLIT)
                if cut.any():
                    parts = -(-count[i[cut]] // SPLIT)
                    part[cut] = SPLIT_PART + (i[cut].astype(np.int64) << 20) + (keys[cut].view(np.uint64) % parts.astype(np.uint64)).astype(np.int64)
                    by = np.argsort(part, kind="stable")
                    tokens, keys, sizes, part = tokens[by], keys[by], sizes[by], part[by]
            cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
            out = [[int(part[a]) for a in cuts[:-1]]] + [[x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])] for x in (tokens, keys, sizes)]
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64())] + [pa.array(x, pa.binary()) for x in out[1:]], ["part", "tokens", "keys", "sizes"])

        for batch in pieces(batches):
            for tokens in _sets(batch.column(1)):
                n = len(tokens)
                if not n:
                    continue
                take = min(n, int(n - needed(n) + depth(n)))
                cell = (tokens >> np.uint64(64 - cells)).astype(np.int64)
                late = (ranks[cell >> 1] >> ((cell & 1) << 2).astype(np.uint8)) & 15
                if len(hot):
                    short = tokens >> np.uint64(40 - bits)
                    i = np.minimum(np.searchsorted(hot, short), len(hot) - 1)
                    late = np.where(hot[i] == short, rank[i], late)
                lead = tokens[np.argsort(late, kind="stable")[:take]]
                held.append((lead, np.full(take, _key(tokens)[1], np.int64), np.full(take, n, np.int32)))
                size += take
            if size >= FLUSH // 2:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "part long, tokens binary, keys binary, sizes binary")


def _close(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sizes that allow the similarity."""
    p, q = SIMILAR
    return np.minimum(n, m) * q >= np.maximum(n, m) * p


def _runs(key: tuple, table: pa.Table) -> pa.Table:
    """Of one part: (centre a, set b, shared tokens) for the sets of each token's run (kind 1); postings (token a, set b, size na) of
    tokens of several sets (2); and the centre of a cut token, which the other cuts don't know (3)."""
    join = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    tokens, keys, sizes = join("tokens", np.uint64), join("keys", np.int64), join("sizes", np.int32)
    by = np.lexsort((keys, tokens))
    tokens, keys, sizes = tokens[by], keys[by], sizes[by].astype(np.int64)
    own = np.r_[True, (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])]  # copies count once
    tokens, keys, sizes = tokens[own], keys[own], sizes[own]
    first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    length = np.diff(np.r_[first, len(tokens)])
    cut = key[0].as_py() >= SPLIT_PART
    many = length > (0 if cut else 1)
    start, n = first[many], length[many]
    where = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    centre = np.repeat(start, n)
    use = (centre != where) & _close(sizes[centre], sizes[where])
    pair = np.rec.fromarrays([keys[centre[use]], keys[where[use]]], names="a,b")
    got, at, shared = np.unique(pair, return_index=True, return_counts=True)
    kinds = [(got.a, got.b, sizes[centre[use]][at], sizes[where[use]][at], shared, np.full(len(got), 1, np.int8))]
    zeros = np.zeros(len(where), np.int64)
    kinds.append((tokens[where].view(np.int64), keys[where], sizes[where], zeros, zeros, np.full(len(where), 2, np.int8)))
    if cut:
        kinds.append((tokens[start].view(np.int64), keys[start], sizes[start], zeros[: len(start)], zeros[: len(start)], np.full(len(start), 3, np.int8)))
    cols = [np.concatenate(x) for x in zip(*kinds)]
    return pa.table({c: pa.array(x.astype(t)) for c, x, t in zip(("a", "b", "na", "nb", "shared", "kind"), cols, [np.int64] * 5 + [np.int8])})


RUNS = "a long, b long, na long, nb long, shared long, kind byte"


def _centres(runs: DataFrame) -> DataFrame:
    """(a, b, na, nb, shared): centre and set, with the leading tokens that they are known to share. Cuts of one token meet by their centres."""
    cuts = runs.where("kind = 3").select(F.col("a").alias("token"), "b", "na")
    least = cuts.groupBy("token").agg(F.min(F.struct("b", "na")).alias("_m"))
    joined = cuts.join(least, "token").where("b <> _m.b").select(F.col("_m.b").alias("a"), "b", F.col("_m.na").alias("na"), F.col("na").alias("nb"), F.lit(1).cast("long").alias("shared"))
    all_ = runs.where("kind = 1").select("a", "b", "na", "nb", "shared").unionByName(joined)
    return all_.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"))


def _bitmap(spark: SparkSession, keys: DataFrame, distinct: int) -> tuple[object, int]:
    """A broadcast bitmap of keys (key), and its size in bits less one."""
    bits = min(BITMAP, max(15, (32 * distinct).bit_length()))
    place = F.pmod(F.col("key"), F.lit(1 << bits)) + 1  # buckets and bits are numbered from 1
    blobs = keys.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toArrow()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for at, blob in zip(blobs.column(0).to_pylist(), blobs.column(1).to_pylist()):
        start = (at - 1) * 4096
        out[start : start + 4096] |= np.frombuffer(blob, np.uint8)[: len(out) - start]
    return spark.sparkContext.broadcast(out), (1 << bits) - 1


def _chosen_sets(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, n, tokens) of the sets of keys (key), a written table that goes, and of others that share a bit with one; written."""
    chosen, mask = _bitmap(docs.sparkSession, keys, keys.count())

    def run(batches):
        done: set[int] = set()
        for batch in pieces(batches):
            out = []
            for tokens in _sets(batch.column(1)):
                if len(tokens):
                    key = _key(tokens)[1]
                    at = key & mask
                    if chosen.value[at >> 3] >> (at & 7) & 1 and key not in done:
                        done.add(key)
                        out.append((key, len(tokens), tokens.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["key", "n", "tokens"])

    # one row a key: copies in other tasks are hashed apart, and the first is as good as any
    got = docs.mapInArrow(run, "key long, n long, tokens binary").groupBy("key").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    got = kept_small(got, "jac-sets")
    chosen.destroy()
    dropped(docs.sparkSession, keys)
    return got


def _rows_of(table: pa.Table, *columns: str) -> list[tuple]:
    return list(zip(*(table.column(c).to_pylist() for c in columns)))


def _against_centre(key: tuple, table: pa.Table) -> pa.Table:
    """A group, or a cut of it: the centre (role 0) and the sets to compare with it (role 1); links that hold."""
    rows = _rows_of(table, "role", "key", "n", "tokens")
    hub = next((np.frombuffer(t, np.uint64) for role, _, _, t in rows if role == 0), None)
    out = []
    if hub is not None:
        for role, other, n, tokens in rows:
            if role == 1:
                both = np.isin(np.frombuffer(tokens, np.uint64), hub, assume_unique=True, kind="sort").sum()
                if similar(int(both), n, len(hub)):
                    out.append(other)
    return pa.table({"a": pa.array([key[0].as_py()] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})


def _salted(rows: DataFrame, by: str, once: DataFrame, sets: DataFrame, at_once: int) -> DataFrame:
    """rows (by, key) as role 1, dealt by hash into tasks of about at_once each, and to each task a copy of once (by, key) as role 0; with their sets."""
    size = rows.groupBy(by).agg(F.greatest(F.ceil(F.count(F.lit(1)) / at_once), F.lit(1)).cast("int").alias("_parts"))
    ask = rows.join(size, by).select(by, "key", F.pmod(F.xxhash64("key"), F.col("_parts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    own = once.join(size, by).select(by, "key", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("salt"), F.lit(0).alias("role"))
    return ask.union(own).join(sets, "key")


def _centre_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of pairs that are similar."""
    once = pairs.select("a", F.col("a").alias("key")).distinct()
    rows = _salted(pairs.select("a", F.col("b").alias("key")), "a", once, sets, BLOCK)
    return rows.select("a", "salt", "role", "key", "n", "tokens").groupBy("a", "salt").applyInArrow(_against_centre, "a long, b long")


def _union(key: tuple, table: pa.Table) -> pa.Table:
    """A row of the matrix: the tokens of a block's sets."""
    got = np.unique(np.concatenate([np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "tokens": pa.array([got.tobytes()], pa.binary())})


def _bound(key: tuple, table: pa.Table) -> pa.Table:
    """The sets (role 1) that have enough tokens in a block's row of the matrix (role 0) to be similar to one of its sets."""
    rows = _rows_of(table, "role", "key", "n", "tokens")
    union = next((np.frombuffer(t, np.uint64) for role, _, _, t in rows if role == 0), None)
    out = []
    if union is not None:
        for role, k, n, t in rows:
            if role == 1:
                tokens = np.frombuffer(t, np.uint64)
                at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
                if (union[at] == tokens).sum() >= needed(n):
                    out.append(k)
    return pa.table({"block": pa.array([key[0].as_py()] * len(out), pa.int64()), "key": pa.array(out, pa.int64())})


def _overlaps(tokens: np.ndarray, pool: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Of each of n sets, pooled in one sorted array, how many of the tokens it has."""
    low, high = np.searchsorted(pool, tokens, "left"), np.searchsorted(pool, tokens, "right")
    size = high - low
    at = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.bincount(owner[at], minlength=n)


def _open(key: tuple, table: pa.Table) -> pa.Table:
    """An opened block: its sets (role 0) and those that ask it (role 1); links that join what has been apart."""
    rows = _rows_of(table, "role", "key", "n", "tokens", "linked")
    own = {k: (n, np.frombuffer(t, np.uint64), c) for role, k, n, t, c in rows if role == 0}
    names, out, up = list(own), [], {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    if own:
        pool = np.concatenate([t for _, t, _ in own.values()])
        owner = np.repeat(np.arange(len(own)), [len(t) for _, t, _ in own.values()])
        by = np.argsort(pool, kind="stable")
        pool, owner = pool[by], owner[by]
        sizes, linked = np.array([n for n, _, _ in own.values()]), np.array([c for _, _, c in own.values()])
        for role, k, n, t, c in rows:
            if role == 1:
                both = _overlaps(np.frombuffer(t, np.uint64), pool, owner, len(own))
                good = np.flatnonzero(similar(both, n, sizes) & (linked != c))
                for i in good[np.unique(linked[good], return_index=True)[1]]:  # one link joins all sets of a label
                    x, y = top(int(linked[i])), top(c)
                    if x != y:
                        up[x] = y
                        out.append((names[i], k))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _blocks(post: DataFrame, centres: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, n, linked, block) of the sets in post: groups by label, and sets still alone by the centre they share most with, cut by hash."""
    best = centres.groupBy(F.col("b").alias("key")).agg(F.max(F.struct("shared", (-F.col("a")).alias("a"))).alias("_m")).select("key", (-F.col("_m.a")).alias("_hub"))
    of = labels.select(F.col("node").alias("_hub"), F.col("comp").alias("_label"))
    member = post.select("key", "n", "linked", "alone").distinct().join(best, "key", "left").withColumn("_hub", F.coalesce("_hub", "key")).join(of, "_hub", "left")
    member = member.select("key", "n", "linked", "alone", F.when(F.col("alone"), F.coalesce("_label", "_hub")).otherwise(F.col("linked")).alias("group"))
    parts = member.groupBy("group", "alone").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("_parts"))
    return member.join(parts, ["group", "alone"]).select("key", "n", "linked", F.xxhash64("group", "alone", F.pmod(F.xxhash64("key"), F.col("_parts"))).alias("block"))


def _block_pairs(post: DataFrame, member: DataFrame) -> DataFrame:
    """(block, other), block <= other: blocks whose sets may be similar by the leading tokens that they share; written."""
    p, q = SIMILAR
    of = post.select("token", "key").join(member, "key").groupBy("token", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("linked").alias("x"), F.max("linked").alias("y"), F.count(F.lit(1)).alias("sets"))
    of = kept(of, "jac-leads")
    other = of.select("token", *[F.col(c).alias("_" + c) for c in ("block", "low", "high", "x", "y")])
    fits = (F.col("_high") * q >= F.col("low") * p) & (F.col("high") * q >= F.col("_low") * p)
    apart = (F.col("x") != F.col("y")) | (F.col("_x") != F.col("_y")) | (F.col("x") != F.col("_x"))
    some = (F.col("block") < F.col("_block")) | ((F.col("block") == F.col("_block")) & (F.col("sets") > 1))
    pairs = of.join(other, "token").where(some & fits & apart)
    pairs = pairs.groupBy("block", F.col("_block").alias("other")).agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("low", "_low")).alias("low"))
    pairs = kept(pairs.where(F.col("shared") >= 1 + F.floor(F.col("low") / 16)).select("block", "other"), "jac-pairs")
    dropped(post.sparkSession, of)
    return pairs


def _matrix_links(docs: DataFrame, runs: DataFrame, centres: DataFrame, labels: DataFrame) -> DataFrame | None:
    """Links by the token-group matrix, written; None if no blocks can have any. Deletes runs and centres, and its own tables once they are used."""
    spark = docs.sparkSession
    post = runs.where("kind = 2").select(F.col("a").alias("token"), F.col("b").alias("key"), F.col("na").alias("n"))
    post = post.join(labels.select(F.col("node").alias("key"), F.col("comp").alias("linked")), "key", "left").withColumn("alone", F.col("linked").isNull()).withColumn("linked", F.coalesce("linked", "key"))
    mixed = post.groupBy("token").agg(F.min("linked").alias("_x"), F.max("linked").alias("_y")).where("_x <> _y").select("token")
    post = kept(post.join(mixed, "token", "left_semi"), "jac-mixed")
    blocks = kept(_blocks(post, centres, labels), "jac-blocks")
    for done in (runs, centres):
        dropped(spark, done)
    pairs = _block_pairs(post, blocks)
    dropped(spark, post)
    if pairs.isEmpty():
        for done in (blocks, pairs):
            dropped(spark, done)
        return None
    met = pairs.select("block").union(pairs.select("other")).distinct()
    member = kept(blocks.join(met, "block", "left_semi"), "jac-met")
    dropped(spark, blocks)
    sets = _chosen_sets(docs, kept(member.select("key"), "jac-keys"))
    cross = pairs.where("block <> other")
    asked = cross.select(F.col("other").alias("block")).distinct()
    matrix = kept(member.join(asked, "block", "left_semi").select("block", "key").join(sets, "key").select("block", "tokens").groupBy("block").applyInArrow(_union, "block long, tokens binary"), "jac-matrix")
    asks = cross.join(member.select("block", "key"), "block").select(F.col("other").alias("block"), "key")
    # a matrix row goes in the place of a set, under its block's number
    size = asks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).cast("int").alias("_parts"))
    query = asks.join(size, "block").select("block", "key", F.pmod(F.xxhash64("key"), F.col("_parts")).cast("int").alias("salt")).join(sets, "key").select("block", "salt", F.lit(1).alias("role"), "key", "n", "tokens")
    row = matrix.join(size, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("salt"), F.lit(0).alias("role"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("n"), "tokens")
    qualified = query.union(row).groupBy("block", "salt").applyInArrow(_bound, "block long, key long")
    itself = pairs.where("block = other").select("block").join(member.select("block", "key"), "block")
    asks = kept(qualified.union(itself.select("block", "key")), "jac-asks")
    dropped(spark, matrix)
    opened = asks.select("block").distinct()
    rows = _salted(asks, "block", member.join(opened, "block", "left_semi").select("block", "key"), sets, 2 * BLOCK).join(member.select("key", "linked"), "key")
    links = kept(rows.select("block", "salt", "role", "key", "n", "tokens", "linked").groupBy("block", "salt").applyInArrow(_open, "a long, b long"), "jac-links")
    for done in (sets, asks, member, pairs):
        dropped(spark, done)
    return links


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), class_id (smallest id of the equal set) of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    estimate = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    bits = min(36, max(0, (estimate // RANGE_TOKENS).bit_length()))
    described = kept_small(_described(docs, bits), "jac-described")
    summary = kept(described.where("part IS NULL").select("doc_id", "n", "name", "key"), "jac-summary")
    classes = kept(summary.where("n > 0").groupBy("name", "key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "jac-classes")
    total = summary.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = spark.sparkContext.broadcast(_order(described.where("part IS NOT NULL").select("part", "tokens", "again", "counts"), total, bits))
    dropped(spark, described)
    runs = kept_small(_postings(docs, bits, frequent).groupBy("part").applyInArrow(_runs, RUNS), "jac-runs")
    frequent.destroy()
    centres = kept(_centres(runs), "jac-centres")
    near = centres.where(F.col("shared") >= 1 + F.floor(F.least("na", "nb") / 16)).select("a", "b")
    keys = kept(near.select(F.col("a").alias("key")).union(near.select("b")).distinct(), "jac-keys")
    sets = _chosen_sets(docs, keys)
    links = kept(_centre_links(near, sets), "jac-links")
    dropped(spark, sets)
    labels = components(links)
    more = _matrix_links(docs, runs, centres, labels)
    if more is not None:
        if not more.isEmpty():
            dropped(spark, labels)
            labels = components(links.union(more))
        dropped(spark, more)
    dropped(spark, links)
    named = classes.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    least_id = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(least_id, "comp").select("name", "rep", "component_id")
    return summary.join(named, "name", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that with the smallest id (all rows of it, if it repeats); documents without words all stay."""
    keep = jaccard_components(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


ORACLE = None
