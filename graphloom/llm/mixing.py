"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Sources share all words by weight; a target stops at `cap` times its source's words and what is over is shared
anew among the others (water filling). Within a source, documents are not equally likely: expected copies rise with a
power of the length class (the binary digits of the number of words), since fragments teach less than long texts. A
source's target is shared among its classes like the whole among sources, each class by its words times its weight and up to
`cap` times its words. A class's share by its words is the expected number of copies of its documents: the whole part is
allocated for certain, the rest is the inclusion probability p of one copy more. Every document gets a random number u
from its id; the odds u / (1 - u) divided by the odds p / (1 - p) rank it, and the sample is the start of that order as far as
the source's words that are still needed reach, so its size in words is fixed.
Words left over because the next document in order is too long are filled in `ROUNDS` - 1 further passes down the
same order by documents that fit. A source's error is thus below its shortest document that was left out, or what
remains after those passes. No document is taken more than `cap` times.

No source is collected: ranks are cut into buckets of their logarithm, which the logistic distribution of log-odds fills
evenly where a sample ends. Buckets are summed, and only the bucket in which the words run out is put in order.
A source's decision is one row of thresholds, which each document is then held against. Windows without a key hold one row
a source, those by source one row for each of at most 64 length classes, or one row a bucket.

Null texts and texts without words have size 0 and add nothing. Null sources are a source of their own, the last.
Repeated rows and rows of one id and length rank alike and are taken alike, so a source may exceed its target by a repeat.
An empty table gives an empty mix. Columns beside those named pass through `mix` unless they have a name of its
results, which then replace them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import kept, n_words, unit_random

WEIGHTS, CAP, SEED, ROUNDS = (5.0, 2.0, 1.0), 3, 17, 3
LENGTH_POWER = 0.25
CLASS_WEIGHTS = [2.0 ** (LENGTH_POWER * k) for k in range(64)]
ROWS_A_BUCKET = 2000


def _shared(rows: DataFrame, by: list[str], total: Column, weight: Column, cap: Column, tie: list[Column], out: str) -> DataFrame:
    """Adds out: total, the same in all rows of by, shared among them by weight, none above its cap."""
    inside = W.partitionBy(*by)
    before, every = inside.orderBy(F.try_divide(cap, weight).asc_nulls_last(), *tie).rowsBetween(W.unboundedPreceding, -1), inside
    rows = rows.withColumn("_w", weight).withColumn("_c", cap).withColumn("_t", total).withColumn("_ws", F.sum("_w").over(every))
    past = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))  # noqa: E731
    rows = rows.withColumn("_full", F.col("_w") * (F.col("_t") - past("_c")) >= F.col("_c") * (F.col("_ws") - past("_w")))
    used = lambda c: F.coalesce(F.sum(F.when(F.col("_full"), F.col(c))).over(every), F.lit(0))  # noqa: E731
    share = F.col("_w") * (F.col("_t") - used("_c")) / F.nullif(F.col("_ws") - used("_w"), F.lit(0.0))
    rows = rows.withColumn(out, F.when(F.col("_full"), F.col("_c").cast("double")).otherwise(F.coalesce(share, F.lit(0.0))))
    return rows.drop("_w", "_c", "_t", "_ws", "_full")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target). One row a source, so one task holds them."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_weight", weight).withColumn("_all", F.sum("source_size").over(W.partitionBy()))
    rows = _shared(rows, [], F.col("_all"), F.col("_weight"), F.col("source_size") * cap, [F.col("source").asc_nulls_last()], "target")
    return rows.select("source", "source_size", "target")


def class_of(size: Column) -> Column:
    """How many binary digits a size has; 1 for 0 and 1."""
    return F.length(F.bin(size))


def classes(sized: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, size) of every document to (source, class, source_size, target, whole, p, need): a row for each length class."""
    words = kept(sized.groupBy("source", class_of(F.col("size")).alias("class")).agg(F.sum("size").alias("words")), "mix-words")
    goal = targets(words.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap).withColumnRenamed("source", "_s")
    rows = words.join(goal, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    weight = F.element_at(F.array(*[F.lit(w) for w in CLASS_WEIGHTS]), F.col("class")) * F.col("words")
    rows = _shared(rows, ["source"], F.col("target"), weight, F.col("words") * cap, [F.col("class")], "_share")
    copies = F.when(F.col("words") > 0, F.col("_share") / F.col("words")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(copies).cast("long")).withColumn("p", copies - F.floor(copies))
    need = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(W.partitionBy("source"))
    return kept(rows.withColumn("need", need).select("source", "class", "source_size", "target", "whole", "p", "need"), "mix-classes")


def rank(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds."""
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return (u / (1 - u)) / (p / (1 - p))


def _ranked(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (source, size, u, key) with their class's columns and q."""
    table = table.select(F.col("source").alias("_s"), F.col("class").alias("_class"), "source_size", "target", "whole", "p")
    rows = rows.join(table, F.col("source").eqNullSafe(F.col("_s")) & (class_of(F.col("size")) == F.col("_class")))
    return rows.withColumn("q", rank(F.col("u"), F.col("p"))).drop("_s", "_class", "p")


def _taken(r: int, cap: int) -> Column:
    """Whether a document passes one of the first r thresholds of its source."""
    hit = F.lit(False)
    for i in range(r):
        hit = hit | F.coalesce((F.col("size") > 0) & (F.col("whole") < cap) & (F.col("size") <= F.col(f"lim{i}")) & (F.struct("q", "key") <= F.col(f"cut{i}")), F.lit(False))
    return hit


def plan(ranked: DataFrame, table: DataFrame, cap: int = CAP) -> DataFrame:
    """Ranked documents to one row for each source: _s, and in each round the words that are left (lim) and the last rank that is taken (cut)."""
    buckets = max(1, -(-ranked.count() // ROWS_A_BUCKET))
    sources = table.groupBy(F.col("source").alias("_s")).agg(F.first("need").alias("lim0"))
    for r in range(ROUNDS):
        lim = F.col(f"lim{r}")
        now = ranked.select("source", "size", "whole", "q", "key").join(sources, F.col("source").eqNullSafe(F.col("_s")))
        # log-odds have a density of at most 1/4, so that a bucket gets at most two in `buckets` of a class
        now = now.where(~_taken(r, cap) & (F.col("size") > 0) & (F.col("whole") < cap) & (F.col("size") <= lim)).withColumn("_bucket", F.floor(F.ln("q") * (buckets / 8)).cast("long"))
        sums = now.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"), F.first(lim).alias("_lim"), F.max(F.struct("q", "key")).alias("_last"))
        by = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
        sums = kept(sums.withColumn("_run", F.sum("_sum").over(by)), "mix-buckets")
        # buckets that fit as a whole, then the first that doesn't, in order
        full = sums.where("_run <= _lim").groupBy("source").agg(F.max("_run").alias("_run"), F.max("_last").alias("_last"))
        edge = sums.where("_run > _lim").groupBy("source").agg(F.min(F.struct("_bucket", (F.col("_run") - F.col("_sum")).alias("_before"))).alias("_e")).select(F.col("source").alias("_t"), "_e.*")
        rows = now.select("source", "_bucket", "q", "key", "size", lim.alias("_lim")).withColumnRenamed("_bucket", "_b").join(edge, F.col("source").eqNullSafe(F.col("_t")) & (F.col("_b") == F.col("_bucket")))
        inside = W.partitionBy("source").orderBy("q", "key").rowsBetween(W.unboundedPreceding, 0)
        part = rows.withColumn("_run", F.col("_before") + F.sum("size").over(inside)).where("_run <= _lim").groupBy("source").agg(F.max("_run").alias("_run"), F.max(F.struct("q", "key")).alias("_last"))
        cut = full.unionByName(part).groupBy(F.col("source").alias("_c")).agg(F.max("_run").alias("_got"), F.max("_last").alias(f"cut{r}"))
        sources = sources.join(cut, F.col("_s").eqNullSafe(F.col("_c")), "left").drop("_c").withColumn(f"lim{r + 1}", lim - F.coalesce("_got", F.lit(0))).drop("_got")
        sources = kept(sources, "mix-plan")
    return sources


def _columns(doc_id: str, source: str, text: str, seed: int) -> dict[str, Column]:
    return {"source": F.col(source), "size": n_words(F.col(text)), "u": unit_random(F.lit(seed), F.col(doc_id)), "key": F.coalesce(F.col(doc_id).cast("string"), F.lit(""))}


def decide(ranked: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """Adds copies to ranked documents."""
    rows = ranked.join(sources, F.col("source").eqNullSafe(F.col("_s")))
    return rows.withColumn("copies", F.col("whole") + _taken(ROUNDS, cap).cast("long"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP, seed: int = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs with size, source_size, target and copies; explode by copies for the mix itself. Texts are not shuffled."""
    own = _columns(doc_id, source, text, seed)
    sized = kept(docs.select(*[c.alias(n) for n, c in own.items()]), "mix-sized")
    table = classes(sized, weights, cap)
    sources = plan(_ranked(sized, table), table, cap)
    rest = [c for c in docs.columns if c not in {"size", "source_size", "target", "copies"}]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), *[c.alias(n) for n, c in own.items()])
    return decide(_ranked(rows, table), sources, cap).select("_row.*", "size", "source_size", "target", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: every document as often as it is taken."""
    columns = docs.columns
    return mix(docs).where(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = _columns("doc_id", "source", "text", SEED)
    sized = kept(docs.select("doc_id", *[c.alias(n) for n, c in own.items()]), "mix-sized")
    table = classes(sized)
    ranked = _ranked(sized, table)
    return decide(ranked, plan(ranked, table)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _shared_sql(by: str, total: str, weight: str, cap: str, tie: str, rows: str, out: str) -> str:
    """Two selects that share total among the rows of by."""
    over = f"PARTITION BY {by}" if by else ""
    return f"""(SELECT * EXCLUDE (w, c, t, f), CASE WHEN f THEN c::double ELSE coalesce(w * (t - coalesce(sum(c) FILTER (f) OVER ({over}), 0)::double) / nullif(sum(w) OVER ({over}) - coalesce(sum(w) FILTER (f) OVER ({over}), 0), 0), 0) END AS {out}
        FROM (SELECT *, w * (t - coalesce(sum(c) OVER o, 0)::double) >= c * (sum(w) OVER ({over}) - coalesce(sum(w) OVER o, 0)) AS f FROM (SELECT *, {weight} AS w, {cap} AS c, ({total})::double AS t FROM {rows})
        WINDOW o AS ({over} ORDER BY c / w, {tie} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


def _oracle() -> str:
    rounds, hit = "", "false"
    for r in range(ROUNDS):
        rounds += f""",
        c{r} AS (SELECT source cs, max({{'q': q, 'key': key}}) cut{r}, max(run) got{r} FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, key ROWS UNBOUNDED PRECEDING) run
            FROM r{r} WHERE NOT ({hit}) AND size > 0 AND whole < {CAP} AND size <= lim{r}) WHERE run <= lim{r} GROUP BY source),
        r{r + 1} AS (SELECT r{r}.*, cut{r}, lim{r} - coalesce(got{r}, 0) AS lim{r + 1} FROM r{r} LEFT JOIN c{r} ON source IS NOT DISTINCT FROM cs)"""
        hit += f" OR coalesce(size > 0 AND whole < {CAP} AND size <= lim{r} AND {{'q': q, 'key': key}} <= cut{r}, false)"
    weights, lengths = (", ".join(map(repr, x)) for x in (WEIGHTS, CLASS_WEIGHTS))
    goal = _shared_sql("", "sum(source_size) OVER ()", f"([{weights}]::double[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::int]", f"source_size * {CAP}", "source NULLS LAST", "a", "target")
    parts = _shared_sql("source", "target", f"([{lengths}]::double[])[class] * words", f"words * {CAP}", "class", "b", "part")
    return rf"""
    WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ 	-]+')), 0)::bigint size, coalesce(doc_id::varchar, '') AS key,
            (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint::double + 0.5) / {float(1 << 48)}::double u FROM documents),
    a0 AS (SELECT source, length(bin(size))::int AS class, sum(size)::bigint words FROM sized GROUP BY ALL),
    a AS (SELECT source, sum(words)::bigint source_size FROM a0 GROUP BY source),
    goal AS {goal},
    b AS (SELECT a0.*, source_size, target FROM a0 JOIN goal ON a0.source IS NOT DISTINCT FROM goal.source),
    share AS (SELECT *, CASE WHEN words > 0 THEN part / words ELSE 0.0 END AS copies FROM {parts}),
    class AS (SELECT *, floor(copies)::bigint whole, copies - floor(copies) AS p, target - sum(floor(copies)::bigint * words) OVER (PARTITION BY source) AS lim0 FROM share),
    r0 AS (SELECT x.*, source_size, target, whole, lim0, (u / (1 - u)) / (pp / (1 - pp)) q FROM sized x JOIN (SELECT *, least(greatest(p, 1e-6::double), 1 - 1e-6::double) pp FROM class) c
        ON x.source IS NOT DISTINCT FROM c.source AND length(bin(x.size)) = c.class){rounds}
    SELECT doc_id, size, source_size, target, (whole + CASE WHEN {hit} THEN 1 ELSE 0 END) * size AS taken FROM r{ROUNDS}"""


ORACLE = _oracle()
