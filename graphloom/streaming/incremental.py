"""Edits: only changed files are parsed again, and findings are kept current as deltas.

`update` is a batch; `watch` runs it for every micro-batch of a stream of (path, text), for instance of
`spark.readStream` over a folder. Both rest on the same law: an updated graph equals a clean build.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.passes import STANDARD, derive_layers, resolve_calls
from ..plans.fixpoint import reached
from ..plans.graph import Graph
from ..plans.storage import kept
from ..sources.frontends import build_graph, with_language

FINDING_KEY = ["method", "sink", "sink_line", "origin"]


def changed_files(graph: Graph, files: DataFrame) -> DataFrame:
    """files (path, text) whose content differs from what the graph was built from, or that are new."""
    digests = with_language(files).select("path", "text", "digest")
    return digests.join(graph.files.select("path", "digest"), ["path", "digest"], "left_anti").select("path", "text")


def update(graph: Graph, files: DataFrame, removed: DataFrame | None = None) -> Graph:
    """The graph after files (path, text) changed and removed (path) went.

    Layers within methods are derived for the changed files alone. Calls are resolved anew in those files, and elsewhere where a
    name is called that a changed or removed file defines or has defined; all calls, if such a file has types or members, which
    decide about receivers anywhere.
    """
    changed = kept(changed_files(graph, files), "changed")
    gone = with_language(changed).select("file_id")
    if removed is not None:
        gone = gone.unionByName(graph.files.join(removed, "path", "left_semi").select("file_id"))
    gone = kept(gone.distinct(), "gone")
    before = graph.nodes.join(gone, "file_id", "left_semi").where("kind IN ('METHOD', 'TYPE_DECL', 'MEMBER')").select("kind", "name")
    base, fresh = graph.without_files(gone), build_graph(changed)
    touched = kept(before.unionByName(fresh.of_kind("METHOD", "TYPE_DECL", "MEMBER").select("kind", "name")).distinct(), "touched")
    merged = Graph(base.nodes.unionByName(fresh.nodes), base.edges.unionByName(fresh.edges), base.files.unionByName(fresh.files), graph.authoritative)
    layers = {p.edge: p.layer for p in STANDARD}
    own = [p for p in STANDARD if p.edge != "CALL" and p.layer not in graph.authoritative]
    merged = merged.with_edges(derive_layers(fresh, own).e(*(p.edge for p in own))) if own else merged
    if layers["CALL"] in graph.authoritative:
        return merged
    calls = merged.calls()
    if touched.where("kind <> 'METHOD'").isEmpty():
        names = touched.select("name").distinct()
        again = calls.join(names, "name", "left_semi").select("id").unionByName(fresh.calls().select("id")).distinct()
    else:
        again = calls.select("id")
    again = kept(again, "again")
    kept_edges = merged.e("CALL").join(again.withColumnRenamed("id", "src"), "src", "left_anti").select(*merged.edges.columns)
    return merged.without_edges("CALL").with_edges(kept_edges, kept(resolve_calls(merged, only=again), "call"))


def callers_of(graph: Graph, names: DataFrame) -> DataFrame:
    """(file_id) of files with calls of any of the names."""
    return graph.calls().join(names.select("name").distinct(), "name", "left_semi").select("file_id").distinct()


def affected_summaries(dependencies: DataFrame, changed: DataFrame) -> DataFrame:
    """(fqn) to compute again: the changed ones and all that depend on them; dependencies (caller_fqn, callee_fqn)."""
    return reached(changed.select("fqn"), dependencies.select(F.col("callee_fqn").alias("src"), F.col("caller_fqn").alias("dst"))).select(F.col("node").alias("fqn"))


def delta(before: DataFrame, after: DataFrame, key: list[str] = FINDING_KEY) -> DataFrame:
    """(key..., change): what was added and removed; nulls are equal."""
    a, b = before.select(*key).distinct(), after.select(*key).distinct()
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))


class Subscription:
    """Findings of a scan, with what changed since the last refresh."""

    def __init__(self, scan: Callable[[Graph], DataFrame], key: list[str] = FINDING_KEY):
        self.scan, self.key, self.last = scan, key, None

    def refresh(self, graph: Graph) -> DataFrame:
        now = kept(self.scan(graph).select(*self.key).distinct(), "findings")
        out = delta(self.last, now, self.key) if self.last is not None else now.withColumn("change", F.lit("added"))
        self.last = now
        return out


def watch(stream: DataFrame, graph: Graph, then: Callable[[Graph, int], None], checkpoint: str):
    """Starts a query that updates the graph with every micro-batch of (path, text) and hands it to `then`.

    Of a file that comes more than once in a batch the version with the latest `time` holds, if the stream has such a column, else
    the greatest text. The graph is saved after each batch beside the stream's own checkpoint, and a restart goes on
    from there; graph is where the first start begins.
    """
    spark, at = stream.sparkSession, f"{checkpoint.rstrip('/')}/graph"
    latest = F.max_by("text", "time") if "time" in stream.columns else F.max("text")

    def run(batch: DataFrame, number: int) -> None:
        done = _saved(spark, at)
        if number not in done:  # a batch may be run again after a failure
            old = Graph.load(spark, f"{at}/{max(done)}") if done else graph
            update(old, batch.groupBy("path").agg(latest.alias("text"))).save(f"{at}/{number}")
        then(Graph.load(spark, f"{at}/{number}"), number)
        for n in sorted(done)[:-1]:
            _folder(spark, f"{at}/{n}", delete=True)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{checkpoint.rstrip('/')}/stream").start()


def _folder(spark, path: str, delete: bool = False) -> list[str]:
    """Names in a folder, or none; or deletes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if delete:
        files.delete(at, True)
        return []
    return [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []


def _saved(spark, at: str) -> list[int]:
    """Batches whose graphs are whole; a save writes its layers last."""
    return [int(n) for n in _folder(spark, at) if n.isdigit() and "_SUCCESS" in _folder(spark, f"{at}/{n}/layers")]
