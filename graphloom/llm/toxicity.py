"""Toxicity with noisy-channel deobfuscation.

1. A character trigram model is counted over all documents (native sums of what tasks count with numpy).
2. Tokens that look disguised (digits or signs among letters, runs of three equal letters, letters and signs set apart by
   blanks or dots) become lattices: a sign may stand for letters it resembles, a run for one or two letters, a
   separator for nothing. Viterbi decoding finds the likeliest reading under the trigram model and the costs of the
   channel. Other tokens, also those whose only oddity is a doubled letter, have one reading, themselves.
3. Restored tokens give features: the word, and its beginnings of 3 to 8 letters, as stems are toxic in inflected
   languages. Weights are smoothed log odds, for features that at least `MIN_DOCUMENTS` toxic documents have.
4. A logistic model of a document's numbers (sum, largest and second weight of its distinct tokens, how many have any,
   whether any reaches each of `STEPS`) gives the score. It is fitted on both halves of the labelled rows, each with weights
   from the other half; scoring takes weights from both. All tokens of whole texts count.

Fitting takes `FIT_ROWS` labelled rows at most, those with the least hashes, a documented bound, which bounds the
features too; everything else is counted over all documents. Labels, languages, sources and ids are no inputs of a score; ids only select rows for
fitting and the held-out third.

Null and empty texts have no tokens: the model's score of an empty text. Null labels and labels without documents
don't count; of several labels of an id the largest holds. Without any toxic labels, or without others, all scores
are the share of toxic labels. Repeated rows are scored alike. Empty tables give empty results. Columns pass through
`scored` unless they have a name of the results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import dropped, kept, pieces

FIT_ROWS, MIN_DOCUMENTS, MIN_WEIGHT, THRESHOLD = 16_000, 4, 3.0, 0.7
STEPS = (4, 5, 6)
SHORTEST, LONGEST = 3, 8
#: Letters that a sign is often written for.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
SEPARATORS = frozenset(".-_*~'`^,:;/\\")
COST_SIGN, COST_DROP, COST_RUN, COST_KEPT_SIGN = 1.0, 0.5, 0.5, 6.0
MEMO = 100_000

# letters to 6-bit codes: a-z, Latin letters of two bytes, other letters, and 0 for all else
_CODES = np.zeros(0x250, np.uint8)
for _c in range(0x250):
    _l = chr(_c).lower()
    if len(_l) == 1 and _l.isalpha():
        _CODES[_c] = ord(_l) - 96 if "a" <= _l <= "z" else 27 + (ord(_l) - 0xDF) if 0xDF <= ord(_l) <= 0xFF else 60


def codes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < len(_CODES), _CODES[np.minimum(points, len(_CODES) - 1)], 60)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) over all texts; a gram is three 6-bit codes, and there are 2 ** 18 of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 18, np.int64)
        for b in pieces(batches):
            c = codes_of("  ".join(x for x in b.column(0).to_pylist() if x) + "  ").astype(np.int32)
            c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]  # one gap between words
            if len(c) > 2:
                total += np.bincount((c[:-2] << 12) | (c[1:-1] << 6) | c[2:], minlength=1 << 18)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """-log P(third | first two), backed off by adding one sixth of a count for each of 64 codes."""
    n = np.zeros(1 << 18)
    n[grams] = counts
    n = n.reshape(4096, 64) + 1 / 6
    return -np.log(n / n.sum(1, keepdims=True)).astype(np.float32).reshape(-1)


_RUN = re.compile(r"(.)\1\1+")
_APART = re.compile(r"(?<!\S)[\w$@!|+€](?:(?:[ \t]{1,2}|[.\-_*])[\w$@!|+€]){2,}(?!\S)")


def readings(token: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each sign or run of a token the letters it may stand for, with the channel's costs; letters between are one part."""
    out: list[list[tuple[str, float]]] = []
    plain = ""
    for m in re.finditer(r"(.)\1*", token, re.S):
        c, n = m.group(1), len(m.group())
        if n == 1 and c.isalpha():
            plain += c
            continue
        if plain:
            out.append([(plain, 0.0)])
            plain = ""
        if c.isalpha():
            out.append([(c * 2, 0.0), (c, COST_RUN)] if n == 2 else [(c, COST_RUN), (c * 2, COST_RUN), (c * n, COST_KEPT_SIGN)])
            continue
        for _ in range(n):
            ways = [(x, COST_SIGN) for x in LOOKS_LIKE.get(c, "")]
            if c in SEPARATORS or c in "!|":
                ways.append(("", COST_DROP))
            out.append(ways or [("", COST_KEPT_SIGN)])
    if plain:
        out.append([(plain, 0.0)])
    return out


@lru_cache(maxsize=1 << 14)
def _letters(letters: str) -> tuple[int, ...]:
    return tuple(codes_of(letters).tolist())


def decoded(token: str, lm: Sequence[float]) -> str:
    """Viterbi over the lattice; a state is the last two codes."""
    best: dict[int, tuple[float, str]] = {0: (0.0, "")}
    for ways in readings(token):
        new: dict[int, tuple[float, str]] = {}
        for state, (cost, text) in best.items():
            for letters, extra in ways:
                s, total = state, cost + extra
                for c in _letters(letters):
                    s = (s << 6) | c
                    total += lm[s]
                    s &= 4095
                if s not in new or total < new[s][0]:
                    new[s] = (total, text + letters)
        best = new
    return min((cost + lm[s << 6], text) for s, (cost, text) in best.items())[1]


def words_in(token: str, lm: Sequence[float]) -> tuple[str, ...]:
    """The words of one token between blanks, restored where they look disguised."""
    token = token.strip("\"()[]{}<>,.;:?#%&*=~`^'-_/\\")
    core = token if token.isalpha() else token.rstrip("!|$+@")
    if core.isalpha() and not _RUN.search(core):
        return (core,)
    if not any(c.isalpha() for c in token):
        return ()
    parts = tuple(p for p in re.split(r"[^\w]+", token) if p.isalpha())
    return tuple(dict.fromkeys((*parts, decoded(token, lm))))


def beginnings(word: str) -> Iterator[str]:
    """Features of a word: itself, marked, and its beginnings."""
    yield word + "$"
    for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
        yield word[:n]


class Reader:
    """Texts to restored words, with what was read before remembered up to a bound."""

    def __init__(self, lm: np.ndarray, value, most: int = MEMO):
        self.lm, self.value, self.memo, self.most = lm.tolist(), value, {}, most  # plain floats: they are read one by one

    def token(self, token: str):
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) >= self.most:
                self.memo.clear()
            got = self.memo[token] = self.value(words_in(token, self.lm))
        return got

    def spread(self, text: str) -> list:
        """Values of letters set apart: each place may begin a word."""
        out = []
        for m in _APART.finditer(text):
            word = decoded(re.sub(r"[ \t.\-_*]", "", m.group()), self.lm)
            if not word.isdigit():
                out += [self.value((word[i:],)) for i in range(len(word) - SHORTEST + 1)]
        return out

    def text(self, text: str | None) -> list:
        if not text:
            return []
        text = text.lower()
        return [self.token(t) for t in set(text.split())] + self.spread(text)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _features_of(words: tuple[str, ...]) -> frozenset[str]:
    return frozenset(f for w in words for f in beginnings(w))


def _counts(rows: DataFrame, lm, only) -> DataFrame:
    """(feature, half, n): in how many rows (text, half) a feature occurs; only: the features that count, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        reader = Reader(lm.value, _features_of, MEMO // 4)
        for b in pieces(batches):
            for text, half in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = frozenset().union(*reader.text(text))
                found[half].update(own if only is None else own & only.value)
        for half, c in found.items():
            names = list(c)
            for i in range(0, len(names), 20_000):
                part = names[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([c[x] for x in part], pa.int64()), pa.array([half] * len(part), pa.int32())], ["feature", "n", "half"])

    return rows.mapInArrow(run, "feature string, n long, half int").groupBy("feature", "half").agg(F.sum("n").alias("n"))


def _numbers(weights: list[float]) -> tuple[float, ...]:
    """Of a document's distinct tokens: sum, largest and second weight, how many have any, and whether any reaches each step."""
    own = sorted((w for w in weights if w > 0), reverse=True)
    most = own[0] if own else 0.0
    return math.log1p(sum(own)), most, own[1] if len(own) > 1 else 0.0, math.log1p(len(own)), *(float(most >= k) for k in STEPS)


NUMBERS = 4 + len(STEPS)


def _weights(toxic: dict[str, int], clean: dict[str, int], size: tuple[int, int]) -> dict[str, float]:
    """Log odds of features in toxic and clean documents, of which there are size."""
    out = {}
    for f, n in toxic.items():
        if n >= MIN_DOCUMENTS:
            w = math.log((n + 0.5) / (size[0] + 1)) - math.log((clean.get(f, 0) + 0.5) / (size[1] + 1))
            if w >= MIN_WEIGHT:
                out[f] = w
    return out


def _rated(words: tuple[str, ...], weight: dict[str, float]) -> float:
    return max((weight.get(f, 0.0) for w in words for f in beginnings(w)), default=0.0)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-1) -> np.ndarray:
    """Newton's method; the intercept comes last."""
    x = np.c_[x, np.ones(len(x))]
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b += step
        if abs(step).max() < 1e-6:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, rows_at_most: int = FIT_ROWS) -> tuple[np.ndarray, dict[str, float], np.ndarray]:
    """The language model, the features' weights and the logistic model. Labels of the held-out third are not read."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id"), F.col("text"))
    grams = trigram_counts(docs).toArrow()
    lm = spark.sparkContext.broadcast(language_model(grams.column(0).to_numpy(), grams.column(1).to_numpy()))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("_h", F.md5(F.col("doc_id").cast("string"))).orderBy("_h").limit(rows_at_most).withColumn("half", (F.conv(F.substring("_h", -1, 1), 16, 10).cast("int") % 2))
    fitted = kept(docs.join(known.drop("_h"), "doc_id").select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).cast("int").alias("toxic"), "half"), "tox-fit")
    size = {(r[0], r[1]): r[2] for r in fitted.groupBy("toxic", "half").count().collect()}
    by_half: list[dict[str, float]] = [{}, {}]
    weight: dict[str, float] = {}
    if {t for t, _ in size} == {0, 1}:
        read = lambda rows: _split_counts(rows.select("feature", "half", "n").toArrow())
        few = F.sum("n").over(W.partitionBy("feature")) >= MIN_DOCUMENTS
        toxic = read(_counts(fitted.where("toxic = 1").select("text", "half"), lm, None).withColumn("_few", few).where("_few"))
        only = spark.sparkContext.broadcast(frozenset(toxic[0]) | frozenset(toxic[1]))
        clean = read(_counts(fitted.where("toxic = 0").select("text", "half"), lm, only))
        by_half = [_weights(toxic[h], clean[h], (size.get((1, h), 0), size.get((0, h), 0))) for h in (0, 1)]
        both = [Counter(x[0]) + Counter(x[1]) for x in (toxic, clean)]
        weight = _weights(*both, tuple(size.get((t, 0), 0) + size.get((t, 1), 0) for t in (1, 0)))
        only.destroy()
    sent = spark.sparkContext.broadcast(by_half)
    names = [f"x{i}" for i in range(NUMBERS)]

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row is rated by the weights of the half that it isn't in
        readers = [Reader(lm.value, lambda words, own=own: _rated(words, own)) for own in reversed(sent.value)]
        for b in pieces(batches):
            got = [_numbers(readers[h].text(t)) for t, h in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(pa.array([g[i] for g in got], pa.float64()) for i in range(NUMBERS)), b.column(1)], [*names, "toxic"])

    rows = fitted.select("text", "toxic", "half").mapInArrow(numbers, ", ".join(f"{n} double" for n in names) + ", toxic int").toArrow()
    y = rows.column(NUMBERS).to_numpy().astype(float)
    if len(y) and 0 < y.mean() < 1:
        model = _logistic(np.stack([rows.column(i).to_numpy() for i in range(NUMBERS)], 1), y)
    else:
        p = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        model = np.array([0.0] * NUMBERS + [math.log(p / (1 - p))])
    found = lm.value, weight, model
    for b in (lm, sent):
        b.destroy()
    dropped(spark, fitted)
    return found


def _split_counts(table: pa.Table) -> list[dict[str, int]]:
    """Counts by feature of each half."""
    out: list[dict[str, int]] = [{}, {}]
    for f, h, n in zip(*(table.column(i).to_pylist() for i in range(3))):
        out[h][f] = n
    return out


def scored(docs: DataFrame, model: tuple[np.ndarray, dict[str, float], np.ndarray], text: str = "text") -> DataFrame:
    """docs with score and predicted."""
    rest = [c for c in docs.columns if c not in {"score", "predicted"}]
    docs = docs.select(*[F.col(f"`{c}`") for c in rest])
    at = rest.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, weight, b = sent.value
        reader = Reader(lm, lambda words: _rated(words, weight))
        for batch in pieces(batches):
            x = np.array([_numbers(w) for w in map(reader.text, batch.column(at).to_pylist())]).reshape(-1, NUMBERS)
            p = 1 / (1 + np.exp(-np.clip(x @ b[:-1] + b[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[*rest, "score", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double", "predicted int"])
    return docs.mapInArrow(run, schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).where("predicted = 0").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


ORACLE = None
