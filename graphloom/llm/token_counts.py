"""Edit-aware token counts: a segment tree of pre-tokens for every document.

A tokenizer first cuts a text into pre-tokens and then encodes each by itself, so a document's count is a sum over
pre-tokens. Leaves hold about `LEAF` pre-tokens with their characters and tokens; inner nodes hold the sums, and are kept with
the document. An edit
(position, characters to delete, text to insert) finds its leaf by the character sums, re-encodes from the start of
the leaf that holds the pre-token before it, and goes on until a new pre-token ends where an old leaf did, beyond
the edit: a pre-token depends on what follows its start alone, plus `LOOK` characters that the pattern peeks at, so
from there on nothing changes. Only the touched leaves and the sums above them are written anew.

Null texts have no tokens and no leaves; edits of them insert into an empty text, and null edits are skipped.
Positions and lengths beyond the text are cut to it, a null insertion is empty; edits of a document apply in the order of
their list. Repeated rows are separate documents. An empty table gives an empty result. Other columns pass through
unless they have a name of the results.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces

VOCABULARY = os.environ.get("GRAPHLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF, LOOK, FAN, REMEMBERED = 64, 2, 16, 200_000


class Counter:
    """Tokens of pre-tokens, remembered up to a bound."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = regex.compile(PATTERN).findall
        self.finditer = regex.compile(PATTERN).finditer
        self.known: dict[str, int] = {}

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(self.encode(piece))
        return n


class Tree:
    """A B-tree of leaves (characters, tokens). A node is [characters, tokens, leaves, children]; a leaf's children are None.

    New leaves in the place of old ones change the nodes above them alone: nodes are split beyond `FAN` children and
    joined with a neighbour where both fit into one.
    """

    def __init__(self, chars: list[int], tokens: list[int]):
        nodes = [[c, t, 1, None] for c, t in zip(chars, tokens)]
        while len(nodes) > 1 or not nodes or nodes[0][3] is None:
            nodes = self._over(nodes) or [[0, 0, 0, []]]
        self.root = nodes[0]

    @staticmethod
    def _over(kids: list) -> list:
        """Nodes over kids, as even as may be."""
        if not kids:
            return []
        n = -(-len(kids) // FAN)
        cuts = [len(kids) * i // n for i in range(n + 1)]
        return [Tree._summed(kids[a:b]) for a, b in zip(cuts, cuts[1:])]

    @staticmethod
    def _summed(kids: list) -> list:
        return [sum(k[0] for k in kids), sum(k[1] for k in kids), sum(k[2] for k in kids), kids]

    @property
    def n(self) -> int:
        return self.root[2]

    @property
    def total(self) -> int:
        return self.root[1]

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The number of the leaf with a character position, and where it starts; positions past the end are of the last leaf."""
        node, number, start = self.root, 0, 0
        while node[3]:
            for i, kid in enumerate(node[3]):
                if position < start + kid[0] or i == len(node[3]) - 1:
                    break
                start += kid[0]
                number += kid[2]
            node = kid
        return number, start

    def from_leaf(self, number: int) -> Iterator[list]:
        """Leaves in order, from one on."""

        def walk(node, skip):
            if node[3] is None:
                yield node
                return
            for kid in node[3]:
                if skip >= kid[2]:
                    skip -= kid[2]
                else:
                    yield from walk(kid, skip)
                    skip = 0

        yield from walk(self.root, number)

    def replace(self, first: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """New leaves for those from first to last, exclusive."""
        nodes = self._spliced(self.root, first, last, [[c, t, 1, None] for c, t in zip(chars, tokens)])
        while len(nodes) > 1:
            nodes = self._over(nodes)
        self.root = nodes[0] if nodes else [0, 0, 0, []]
        while len(self.root[3]) == 1 and self.root[3][0][3] is not None:
            self.root = self.root[3][0]

    def _spliced(self, node: list, lo: int, hi: int, new: list) -> list:
        """Nodes in the place of node, whose leaves from lo to hi become new."""
        kids = node[3]
        if not kids or kids[0][3] is None:
            return self._over(kids[:lo] + new + kids[hi:])
        out, at = [], 0
        for i, kid in enumerate(kids):
            a, b = max(lo - at, 0), min(hi - at, kid[2])
            here = new is not None and (lo - at < kid[2] or i == len(kids) - 1)
            if here or (a < b and hi > at):
                got = self._spliced(kid, min(a, kid[2]), max(min(a, kid[2]), b), new if here else [])
                new = None if here else new
            else:
                got = [kid]
            at += kid[2]
            for x in got:
                if out and len(out[-1][3]) + len(x[3]) <= FAN // 2:
                    out[-1] = self._summed(out[-1][3] + x[3])
                else:
                    out.append(x)
        return self._over(out)

    def leaves(self) -> tuple[list[int], list[int]]:
        got = list(self.from_leaf(0))
        return [x[0] for x in got], [x[1] for x in got]

    def flat(self) -> tuple[list[int], list[int], list[int]]:
        """Characters, tokens and children of all nodes, each before its children; a leaf has no children."""
        out: tuple[list, list, list] = ([], [], [])
        todo = [self.root]
        while todo:
            node = todo.pop()
            for column, value in zip(out, (node[0], node[1], len(node[3] or ()))):
                column.append(value)
            todo += reversed(node[3] or ())
        return out

    @classmethod
    def of(cls, chars: list[int], tokens: list[int], kids: list[int]) -> Tree:
        """The tree that flat() has written: sums are read, not made anew."""
        tree = cls.__new__(cls)
        nodes: list = []
        for c, t, k in zip(reversed(chars), reversed(tokens), reversed(kids)):
            own = [nodes.pop() for _ in range(k)]
            nodes.append([c, t, sum(x[2] for x in own), own] if k else [c, t, 1, None])
        tree.root = nodes[0] if nodes else [0, 0, 0, []]
        if tree.root[3] is None:
            tree.root = [0, 0, 0, []]  # the root of an empty text is written without children
        return tree


def grown(text: str, count: Counter) -> Tree:
    pieces = count.pieces(text)
    chars, tokens = [], []
    for i in range(0, len(pieces), LEAF):
        part = pieces[i : i + LEAF]
        chars.append(sum(map(len, part)))
        tokens.append(sum(map(count, part)))
    return Tree(chars, tokens)


def edited(text: str, tree: Tree, position: int, delete: int, insert: str, count: Counter) -> tuple[str, int]:
    """The new text, and how many characters were encoded again; the tree is changed in place."""
    position = min(max(position, 0), len(text))
    end = min(position + max(delete, 0), len(text))
    new = text[:position] + insert + text[end:]
    if not tree.n or not new:
        tree.__init__(*grown(new, count).leaves())
        return new, len(new)
    first, start = tree.leaf_at(max(0, position - LOOK))
    if first:  # the pre-token before may reach up to here: the leaf before holds it whole
        first -= 1
        start -= next(tree.from_leaf(first))[0]
    # ends of old leaves beyond the edit, in places of the new text
    shift = len(new) - len(text)
    old, leaf, place = tree.from_leaf(first), first, start
    while leaf < tree.n and place < end:
        place += next(old)[0]
        leaf += 1
    at, chars, tokens, c, t, n = start, [], [], 0, 0, 0
    for m in count.finditer(new, start):
        piece = m.group()
        at, c, t, n = m.end(), c + len(piece), t + count(piece), n + 1
        while leaf < tree.n and place + shift < at:
            place += next(old)[0]
            leaf += 1
        synced = place + shift == at and place >= end
        if n == LEAF or synced:
            chars.append(c), tokens.append(t)
            c = t = n = 0
        if synced:
            break
    else:
        leaf = tree.n
        if n:
            chars.append(c), tokens.append(t)
    tree.replace(first, leaf, chars, tokens)
    return new, at - start


TREE = {"n_tokens": "long", "node_chars": "array<int>", "node_tokens": "array<int>", "node_children": "array<int>"}


def _ints() -> pa.DataType:
    return pa.list_(pa.int32())


def _schema(df: DataFrame, own: dict[str, str]) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"{k} {t}" for k, t in own.items())])


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with n_tokens and the whole tree, inner sums included, as arrays of its nodes in preorder."""
    rest = [c for c in docs.columns if c not in TREE]
    docs = docs.select(*[F.col(f"`{c}`") for c in rest])
    at = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(vocabulary)
        for b in pieces(batches):
            trees = [grown(x.as_py() or "", count) for x in b.column(at)]
            flat = [t.flat() for t in trees]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t.total for t in trees], pa.int64()), *(pa.array([f[i] for f in flat], _ints()) for i in range(3))], names=[*rest, *TREE])

    return docs.mapInArrow(run, _schema(docs, TREE))


def with_edits(counted: DataFrame, edits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """counted with the list of each document's edits (doc_id, seq, pos, n_delete, insert), in the order of seq.

    One document's edits become one row's list, so they have to fit a task, like its text.
    """
    listed = edits.groupBy(F.col(doc_id).alias("_id")).agg(F.sort_array(F.collect_list(F.struct("seq", "pos", "n_delete", "insert"))).alias("edits"))
    listed = listed.select("_id", F.transform("edits", lambda e: F.struct(e["pos"].cast("long").alias("pos"), e["n_delete"].cast("long").alias("n_delete"), e["insert"].alias("insert"))).alias("edits"))
    return counted.drop("edits").join(listed, F.col(doc_id).eqNullSafe(F.col("_id")), "left").drop("_id")


def apply_edits(counted: DataFrame, text: str = "text", edits: str = "edits", vocabulary: str = VOCABULARY) -> DataFrame:
    """counted (with n_tokens, leaves and edits) after the edits, with reencoded: characters that were encoded again."""
    own = {text, edits, *TREE, "reencoded"}
    rest = [c for c in counted.columns if c not in own]
    rows = counted.select(*[F.col(f"`{c}`") for c in rest], text, *TREE, edits)
    out = rows.drop(edits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(vocabulary)
        k = len(rest)
        for b in pieces(batches):
            texts, n, flat, again = [], [], [], []
            for x, *nodes, todo in zip(*(b.column(k + i).to_pylist() for i in (0, 2, 3, 4, 5))):
                tree, new, work = Tree.of(*(v or [] for v in nodes)), x or "", 0
                for e in todo or []:
                    if e is not None and e["pos"] is not None:
                        new, more = edited(new, tree, e["pos"], e["n_delete"] or 0, e["insert"] or "", count)
                        work += more
                texts.append(new if x is not None or todo else None), n.append(tree.total), flat.append(tree.flat()), again.append(work)
            cols = [pa.array(texts, pa.string()), pa.array(n, pa.int64()), *(pa.array([f[i] for f in flat], _ints()) for i in range(3)), pa.array(again, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *cols], names=[*rest, text, *TREE, "reencoded"])

    return rows.mapInArrow(run, _schema(out, {"reencoded": "long"}))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and after three edits: a mask at a quarter, a note in the middle, a cut at three quarters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = count_tokens(docs).withColumn("n_before", F.col("n_tokens"))
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda pos, cut, new: F.struct(pos.cast("long").alias("pos"), F.lit(cut).cast("long").alias("n_delete"), F.lit(new).alias("insert"))
    edits = F.array(edit(F.floor(n / 4), 8, "[MASKED]"), edit(F.floor(n / 2), 0, " (note: checked) "), edit(F.floor(n * 3 / 4), 24, ""))
    done = apply_edits(counted.withColumn("edits", edits))
    return done.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.length("text").cast("long").alias("n_chars_edited"), "reencoded")


ORACLE = None
