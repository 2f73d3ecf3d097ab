"""Graphs and findings as text: DOT, GraphML, JSON, SARIF, NDJSON snapshots and feature vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as fn
from ..plans.graph import Graph

REPRESENTATIONS = {"ast": ("AST",), "cfg": ("CFG",), "ddg": ("REACHING_DEF", "DDG"), "cpg14": ("AST", "CFG", "REACHING_DEF", "DDG"), "all": None}


def per_method(graph: Graph, representation: str = "ast") -> tuple[DataFrame, DataFrame]:
    """(unit, node columns) and (unit, src, dst, kind): a unit is a method with edges inside it, or null for `all`."""
    kinds = REPRESENTATIONS[representation]
    if kinds is None:
        return graph.nodes.withColumn("unit", F.lit(None).cast("long")), graph.edges.select(F.lit(None).cast("long").alias("unit"), "src", "dst", "kind")
    own = graph.nodes.where("method_id IS NOT NULL").select("id", "method_id")
    e = graph.e(*kinds).join(own.withColumnRenamed("id", "src"), "src").join(own.select(F.col("id").alias("dst"), F.col("method_id").alias("_m")), "dst").where("method_id = _m")
    return graph.nodes.where("method_id IS NOT NULL").withColumn("unit", F.col("method_id")), e.select(F.col("method_id").alias("unit"), "src", "dst", "kind")


def unit_files(graph: Graph, ending: str) -> DataFrame:
    """(unit, file): safe names, with underscores added where names repeat."""
    names = graph.methods().select(F.col("id").alias("unit"), fn.file_name(F.coalesce("full_name", "name", F.lit("method"))).alias("f"))
    n = F.row_number().over(W.partitionBy("f").orderBy("unit")) - 1
    return names.select("unit", F.concat("f", F.repeat(F.lit("_"), n), F.lit(f".{ending}")).alias("file"))


def dot(graph: Graph, representation: str = "ast") -> DataFrame:
    """(unit, text): one DOT document for each unit, with its lines in order."""
    nodes, edges = per_method(graph, representation)
    label = F.concat("kind", F.when(F.coalesce("code", "name").isNotNull(), F.concat(F.lit(": "), F.substring(F.coalesce("code", "name"), 1, 40))).otherwise(""))
    lines = nodes.select("unit", F.struct(F.lit(0).alias("o"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.format_string('  "%d" [label="%s"]', "id", fn.dot_escape(label)).alias("line")).alias("l"))
    lines = lines.unionByName(edges.select("unit", F.struct(F.lit(1).alias("o"), F.col("src").alias("a"), F.col("dst").alias("b"), F.format_string('  "%d" -> "%d" [label="%s"]', "src", "dst", "kind").alias("line")).alias("l")))
    return lines.groupBy("unit").agg(F.concat(F.lit("digraph g {\n"), F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["line"]), "\n"), F.lit("\n}\n")).alias("text"))


def graphml(graph: Graph, representation: str = "ast") -> DataFrame:
    nodes, edges = per_method(graph, representation)
    data = lambda key, c: F.when(c.isNotNull(), F.concat(F.lit(f'<data key="{key}">'), fn.xml_escape(c), F.lit("</data>"))).otherwise("")
    row = F.concat(F.format_string('<node id="%d">', "id"), data("kind", F.col("kind")), data("name", F.col("name")), data("code", F.col("code")), F.lit("</node>"))
    lines = nodes.select("unit", F.struct(F.lit(0).alias("o"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), row.alias("line")).alias("l"))
    edge = F.concat(F.format_string('<edge source="%d" target="%d">', "src", "dst"), data("kind", F.col("kind")), F.lit("</edge>"))
    lines = lines.unionByName(edges.select("unit", F.struct(F.lit(1).alias("o"), F.col("src").alias("a"), F.col("dst").alias("b"), edge.alias("line")).alias("l")))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">\n'
    return lines.groupBy("unit").agg(F.concat(F.lit(head), F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["line"]), "\n"), F.lit("\n</graph></graphml>\n")).alias("text"))


def node_json() -> F.Column:
    return F.to_json(F.struct("code", F.col("file_id").alias("file"), "id", "kind", "line", "name"))


def json_units(graph: Graph, representation: str = "ast") -> DataFrame:
    """(unit, text): {"edges": [...], "nodes": [...]} for each unit."""
    nodes, edges = per_method(graph, representation)
    n = nodes.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("id", node_json().alias("j")))).alias("n"))
    e = edges.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("src", "dst", F.to_json(F.struct("dst", "kind", "src")).alias("j")))).alias("e"))
    join = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["j"]), ","), F.lit(""))
    return n.join(e.withColumnRenamed("unit", "_u"), F.col("unit").eqNullSafe(F.col("_u")), "left").select("unit", F.concat(F.lit('{"edges":['), join("e"), F.lit('],"nodes":['), join("n"), F.lit("]}")).alias("text"))


def snapshot(graph: Graph) -> DataFrame:
    """(value): records BEGIN, NODE, EDGE, END as lines of JSON; df.write.text writes them in parallel, sorted by `at`."""
    n = graph.nodes.select(F.struct(F.lit(1).alias("o"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).alias("at"), F.to_json(F.struct(F.lit("NODE").alias("record"), "*")).alias("value"))
    e = graph.edges.select(F.struct(F.lit(2).alias("o"), F.col("src").alias("a"), F.col("dst").alias("b")).alias("at"), F.to_json(F.struct(F.lit("EDGE").alias("record"), "*")).alias("value"))
    ends = graph.nodes.sparkSession.range(2).select(F.struct((F.col("id") * 3).cast("int").alias("o"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("at"), F.when(F.col("id") == 0, '{"record":"BEGIN"}').otherwise('{"record":"END"}').alias("value"))
    return ends.unionByName(n).unionByName(e)


def vectors(graph: Graph, dimensions: int | None = None) -> DataFrame:
    """(id, features): how often each `key:value` occurs at a node; or hashed to a number of dimensions."""
    keys = {"id": F.col("id").cast("string"), "code": F.col("code"), "full_name": F.col("full_name"), "name": F.col("name"), "label": F.col("kind")}
    pairs = F.filter(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{k}:"), c)) for k, c in keys.items()]), lambda x: x.isNotNull())
    rows = graph.nodes.select(F.col("id").alias("node"), F.explode(pairs).alias("feature"))
    if dimensions:
        rows = rows.withColumn("feature", (fn.feature_hash(F.col("feature")) % dimensions).cast("string"))
    return rows.groupBy(F.col("node").alias("id"), "feature").agg(F.count(F.lit(1)).alias("n"))


def sarif_results(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, level, message, uri, line): flat results; rules (id, severity, description)."""
    r = rules.select(F.col("id").alias("rule_id"), "severity", "description")
    return findings.join(r, "rule_id", "left").select("rule_id", fn.sarif_level(F.coalesce("severity", F.lit("medium"))).alias("level"), F.concat_ws(": ", F.nullif(F.col("description"), F.lit("")), F.concat(F.col("origin"), F.lit(" reaches "), F.col("sink"))).alias("message"), fn.path_to_uri(F.coalesce("sink_file", F.lit(""))).alias("uri"), F.col("sink_line").alias("line"))


def sarif(findings: DataFrame, rules: DataFrame, tool: str = "graphloom") -> DataFrame:
    """(text): one SARIF 2.1.0 document; rules without findings are listed too."""
    place = F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    rows = sarif_results(findings, rules).select(F.struct("rule_id", "uri", "line", "message").alias("k"), F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations")).alias("r"))
    results = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", F.to_json("r").alias("j")))), lambda x: x["j"]).alias("results"))
    listed = rules.agg(F.sort_array(F.collect_list(F.to_json(F.struct("id", F.struct(F.col("description").alias("text")).alias("shortDescription"))))).alias("rules"))
    return results.crossJoin(listed).select(
        F.concat(F.lit('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"' + tool + '","rules":['), F.array_join("rules", ","), F.lit(']}},"results":['), F.array_join("results", ","), F.lit("]}]}")).alias("text")
    )


def schema_violations(nodes: DataFrame, edges: DataFrame, allowed: DataFrame, kinds: list[str], edge_kinds: list[str]) -> DataFrame:
    """(violation, id, detail): duplicate ids, unknown kinds, edges without ends or between kinds that aren't allowed.

    allowed (kind, src_kind, dst_kind) lists legal ends; edge kinds it doesn't name may join anything.
    """
    v = lambda df, name, i, detail: df.select(F.lit(name).alias("violation"), i.cast("long").alias("id"), detail.cast("string").alias("detail"))
    out = v(nodes.groupBy("id").count().where("count > 1"), "duplicate-id", F.col("id"), F.col("count"))
    out = out.unionByName(v(nodes.where(F.col("id").isNull()), "missing-id", F.lit(None), F.col("kind")))
    out = out.unionByName(v(nodes.where(~F.coalesce(F.col("kind").isin(kinds), F.lit(False))), "unknown-node-kind", F.col("id"), F.col("kind")))
    out = out.unionByName(v(edges.where(~F.coalesce(F.col("kind").isin(edge_kinds), F.lit(False))), "unknown-edge-kind", F.col("src"), F.col("kind")))
    # edges meet the nodes once by each end, and all that is wrong with an edge is told from that one row
    ids = nodes.groupBy("id").agg(F.first("kind").alias("_k"))
    end = lambda e: ids.select(F.col("id").alias(e), F.col("_k").alias(f"{e}_kind"), F.lit(True).alias(f"_{e}"))
    seen = edges.select("src", "dst", "kind").join(F.broadcast(allowed.select("kind").distinct().withColumn("_ruled", F.lit(True))), "kind", "left")
    # on the way to the other end, only edges whose kinds are ruled or that lack a source need to tell it
    seen = seen.join(end("src"), "src", "left").withColumn("_told", F.col("_ruled").isNotNull() | F.col("_src").isNull())
    seen = seen.select("dst", "kind", F.when(F.col("_told"), F.col("src")).alias("src"), F.when(F.col("_ruled"), F.col("src_kind")).alias("src_kind"), "_ruled", "_src")
    seen = seen.join(end("dst"), "dst", "left").join(F.broadcast(allowed.select("kind", "src_kind", "dst_kind").distinct().withColumn("_legal", F.lit(True))), ["kind", "src_kind", "dst_kind"], "left")
    wrong = lambda when, name, i, detail: F.when(when, F.struct(F.lit(name).alias("violation"), F.col(i).alias("id"), detail.alias("detail")))
    illegal = F.col("_ruled").isNotNull() & F.col("_src").isNotNull() & F.col("_dst").isNotNull() & F.col("_legal").isNull()
    found = F.array(
        wrong(F.col("_src").isNull(), "dangling-src", "src", F.col("kind")), wrong(F.col("_dst").isNull(), "dangling-dst", "dst", F.col("kind")),
        wrong(illegal, "illegal-ends", "src", F.concat_ws(" ", "kind", "src_kind", "dst_kind")),
    )
    return out.unionByName(seen.where(F.col("_src").isNull() | F.col("_dst").isNull() | illegal).select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_v")).select("_v.*"))
