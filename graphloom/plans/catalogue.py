"""Queries over derived graphs with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as fn
from ..sources import derive
from ..sources.frontends import dominant_language, with_language
from ..sources.derive import CLASSES_SQL, CODE, CONTAINMENT_SQL, EVENTS_SQL, ROUTES_SQL, TRADE_PROGRAM_SQL, TRADE_SQL, UNIT
from .fixpoint import closure, reach, shortest_paths
from .graph import EDGES, NODES, Graph, frozen, shaped
from .storage import kept
from .traversal import query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
GRAPHS = {"g1": derive.containment, "g2": derive.events, "g3": derive.trade, "g4": derive.classes, "g5": derive.trade_program, "g6": derive.routes}
VIEWS = {"g1": CONTAINMENT_SQL, "g2": EVENTS_SQL, "g3": TRADE_SQL, "g4": CLASSES_SQL, "g5": TRADE_PROGRAM_SQL, "g6": ROUTES_SQL}


def on(graph: str, sql: str | None = None, more: str = ""):
    """Registers f(graph) under its name; sql is a select over g1n, g1e, ... of the graph."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(GRAPHS[graph](spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if more.startswith('R:') else ''}{VIEWS[graph]}{', ' + more.removeprefix('R:') if more else ''} {sql}"
        return f

    return add


def traversal(name: str, graph: str, text: str, sql: str, columns: list[str] | None = None, more: str = "") -> None:
    """Registers a query of the traversal language; columns of the nodes to return, or the single value. more is `tables` if sql
    needs no view of the graph."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = query(GRAPHS[graph](spark, sf_dir), text)
        return got.rows.select(*columns) if columns else got.rows

    QUERIES[name] = run
    ORACLES[name] = sql if more == "tables" else f"WITH {'RECURSIVE ' if more.startswith('R:') else ''}{VIEWS[graph]}{', ' + more.removeprefix('R:') if more else ''} {sql}"


NATION, CUSTOMER, ORDER, LINE, USER = (CODE[k] * UNIT for k in ("nation", "customer", "orders", "line", "user"))


# scans and accessors
@on("g1", "SELECT kind, count(*) n FROM g1n GROUP BY kind")
def nodes_of_kind_counts(g):
    return g.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@on("g1", "SELECT kind, count(*) n FROM g1e GROUP BY kind")
def edges_of_kind_counts(g):
    return g.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@on("g1", "SELECT id, name FROM g1n WHERE kind = 'METHOD' AND (name = 'BUILDING' OR full_name = 'BUILDING')")
def method_named(g):
    return g.method_named("BUILDING").select("id", "name")


@on("g2", "SELECT id, line FROM g2n WHERE kind = 'CALL' AND name = 'purchase'")
def calls_named(g):
    return g.calls_named("purchase").select("id", "line")


@on("g1", "SELECT src AS call, dst AS id, ord AS position, argument_index FROM g1e JOIN g1n ON dst = id WHERE g1e.kind = 'ARGUMENT'")
def arguments_of_indexed(g):
    return g.arguments().select("call", "id", "position", "argument_index")


@on("g3", "SELECT src AS call, dst AS target FROM g3e WHERE ord = 1")
def first_call_target(g):
    return g.call_target()


@on("g3", "SELECT src AS call, dst AS target, ord FROM g3e")
def all_call_targets(g):
    return g.call_targets()


@on("g3", "SELECT src AS id, array_to_string(list(dst ORDER BY ord), ',') AS targets FROM g3e GROUP BY src")
def frozen_out_edges(g):
    return frozen(g, "CALL").select("id", F.array_join(F.transform("targets", lambda x: x.cast("string")), ",").alias("targets"))


@on("g1", f"SELECT parent, id, index FROM (SELECT up AS parent, id, row_number() OVER (PARTITION BY up ORDER BY id) - 1 AS index FROM g1n WHERE kind = 'METHOD')")
def parameters_of_ordered(g):
    # customers stand for the parameters of their nations
    from dataclasses import replace

    renamed = g.nodes.withColumn("order_", F.when(F.col("kind") == "METHOD", F.lit(1)).otherwise(F.col("order_"))).withColumn("kind", F.when(F.col("kind") == "METHOD", "METHOD_PARAMETER_IN").otherwise(F.col("kind")))
    return replace(g, nodes=renamed).parameters().select(F.col("method").alias("parent"), "id", F.col("index").cast("long").alias("index"))


@on("g1", "SELECT kind, 2 * count(*) AS n, 2 * count(DISTINCT id) AS ids FROM g1n GROUP BY kind UNION ALL SELECT 'edge ' || kind, 2 * count(*), 2 * count(DISTINCT (src, dst)) FROM g1e GROUP BY kind")
def absorb_counts(g):
    """The graph and a copy of it under other ids; edges that lost an end on the way would not be counted."""
    # what is counted is written, so that the tables are joined once; edges meet their sources last and are told apart where they then lie
    slim = Graph(shaped(kept(g.nodes.select("id", "kind"), "absorbed"), NODES), shaped(kept(g.edges.select("src", "dst", "kind"), "absorbed"), EDGES))
    both = slim.absorb(slim, 10**15)
    told = lambda df, *key: df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("ids"))
    ends = both.edges.join(both.nodes.select(F.col("id").alias("dst")), "dst", "left_semi").join(both.nodes.select(F.col("id").alias("src")), "src", "left_semi")
    return told(both.nodes, "kind", "id").unionByName(told(ends, "kind", "src", "dst").withColumn("kind", F.concat(F.lit("edge "), "kind")))


@on("g2", "SELECT count(*) AS nodes, (SELECT count(*) FROM g2e JOIN g2n a ON a.id = src JOIN g2n b ON b.id = dst WHERE a.method_id % 2 = 1 AND b.method_id % 2 = 1) AS edges FROM g2n WHERE method_id % 2 = 1")
def remove_file_counts(g):
    from dataclasses import replace

    filed = replace(g, nodes=g.nodes.withColumn("file_id", F.col("method_id") % 2))
    left = filed.without_files(g.nodes.sparkSession.range(1).select(F.col("id").alias("file_id")))
    return left.nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(left.edges.agg(F.count(F.lit(1)).alias("edges")))


# traversals
traversal("calls_named_regex", "g2", 'cpg.call.name("p.*|error")', "SELECT id, name FROM g2n WHERE kind = 'CALL' AND regexp_full_match(name, 'p.*|error')", ["id", "name"])
traversal("name_exact_in", "g1", 'cpg.typeDecl.nameExact("NATION_3", "NATION_7", "NATION_9")', "SELECT id, name FROM g1n WHERE kind = 'TYPE_DECL' AND name IN ('NATION_3', 'NATION_7', 'NATION_9')", ["id", "name"])
traversal("call_by_code", "g1", 'cpg.call.code("use\\\\(1, .*").code', "SELECT code AS value FROM g1n WHERE kind = 'CALL' AND regexp_full_match(code, 'use\\(1, .*')")
traversal("callee_hop", "g3", 'cpg.method.name("NATION_1.*").callee.name', "SELECT b.name AS value FROM g3n a JOIN g3e ON src = a.id JOIN g3n b ON dst = b.id WHERE starts_with(a.name, 'NATION_1')")
traversal("caller_hop", "g3", "cpg.method.caller.name", "SELECT a.name AS value FROM g3n a JOIN g3e ON src = a.id")
traversal("callee_twice", "g3", "cpg.method.callee.callee.name", "SELECT c.name AS value FROM g3e x JOIN g3e y ON x.dst = y.src JOIN g3n c ON y.dst = c.id")
traversal("in_call", "g1", 'cpg.typ.name("ECONOMY.*").inCall.name', "SELECT lower(l_returnflag) || '_' || lower(l_linestatus) AS value FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type LIKE 'ECONOMY%'", more="tables")
traversal("argument_by_index", "g1", 'cpg.call("a_f").argument(2).name', "SELECT t.name AS value FROM g1n c JOIN g1e e ON e.src = c.id AND e.kind = 'ARGUMENT' JOIN g1n t ON t.id = e.dst WHERE c.kind = 'CALL' AND c.name = 'a_f' AND t.argument_index = 2")
traversal("ast_parent", "g1", "cpg.block.astParent.name", "SELECT c_name AS value FROM orders JOIN customer ON o_custkey = c_custkey", more="tables")
traversal("ast_children", "g1", 'cpg.namespace.name("ASIA").astChildren.name', "SELECT n_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'", more="tables")
traversal("enclosing_method", "g1", 'cpg.call.name("r_f").method.name', "SELECT c_name AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R' AND l_linestatus = 'F'", more="tables")
traversal("calls_in_method", "g2", 'cpg.method.name("user1.*").call.name', "SELECT c.name AS value FROM g2n m JOIN g2n c ON c.method_id = m.id AND c.kind = 'CALL' WHERE m.kind = 'METHOD' AND m.name LIKE 'user1%'")
traversal("refs_to", "g1", 'cpg.call.name("n_o").refsTo.fullName', "SELECT p_brand AS value FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'N' AND l_linestatus = 'O'", more="tables")
traversal("eval_type_dedup", "g1", 'cpg.call.name("a_f").evalType.dedup.name', "SELECT DISTINCT t.name AS value FROM g1n c JOIN g1e e ON e.src = c.id AND e.kind = 'EVAL_TYPE' JOIN g1n t ON t.id = e.dst WHERE c.name = 'a_f'")
traversal("where_has_call", "g2", 'cpg.method.where(_.call.name("purchase")).name', "SELECT name AS value FROM g2n m WHERE kind = 'METHOD' AND EXISTS (FROM g2n c WHERE c.method_id = m.id AND c.kind = 'CALL' AND c.name = 'purchase')")
traversal("filter_not_has_call", "g1", 'cpg.method.filterNot(_.call.name("r_f")).name', "SELECT c_name AS value FROM customer ANTI JOIN (SELECT DISTINCT o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_linestatus = 'F') ON o_custkey = c_custkey", more="tables")
traversal("where_or", "g1", 'cpg.block.or(_.name("1-URGENT"), _.astChildren.name("r_f")).id', "SELECT id AS value FROM g1n b WHERE kind = 'BLOCK' AND (name = '1-URGENT' OR EXISTS (FROM g1n c WHERE c.up = b.id AND c.name = 'r_f'))")
traversal("where_and", "g1", 'cpg.block.and(_.astChildren.name("a_f"), _.astChildren.name("r_f")).id', "SELECT 4000000000000 + o_orderkey AS value FROM orders SEMI JOIN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'A' AND l_linestatus = 'F') AND bool_or(l_returnflag = 'R' AND l_linestatus = 'F')) ON l_orderkey = o_orderkey", more="tables")
traversal("dedup_names", "g2", "cpg.call.name.dedup", "SELECT DISTINCT name AS value FROM g2n WHERE kind = 'CALL'")
traversal("limit_first_n", "g1", "cpg.block.limit(20).id", "SELECT id AS value FROM g1n WHERE kind = 'BLOCK' ORDER BY id LIMIT 20")
traversal("size_of_traversal", "g1", 'cpg.call.where(_.refsTo.name("PROMO.*")).size', "SELECT count(*) AS value FROM g1n c WHERE c.kind = 'CALL' AND EXISTS (FROM g1e e JOIN g1n t ON t.id = e.dst WHERE e.src = c.id AND e.kind = 'REF' AND t.name LIKE 'PROMO%')")
traversal("labels_of_children", "g1", "cpg.method.astChildren.label", "SELECT 'BLOCK' AS value FROM orders JOIN customer ON o_custkey = c_custkey", more="tables")
traversal("is_kind_filter", "g1", 'cpg.all.name(".*1.*").isMethod.name', "SELECT name AS value FROM g1n WHERE kind = 'METHOD' AND name LIKE '%1%'")
traversal("table_of_calls", "g2", 'cpg.call.name("error").p', "SELECT id, kind AS label, line AS location, name, name || '()' AS code FROM g2n WHERE kind = 'CALL' AND name = 'error'")
traversal("json_of_namespaces", "g1", "cpg.namespace.toJson", """SELECT '{"id":' || id || ',"kind":"' || kind || '","name":"' || name || '","full_name":"' || full_name || '"}' AS value FROM g1n WHERE kind = 'NAMESPACE'""")
traversal("ast_closure", "g1", 'cpg.namespace.name("AFRICA").ast.label', "SELECT kind AS value FROM t", more="R:t AS (SELECT id, kind FROM g1n WHERE kind = 'NAMESPACE' AND name = 'AFRICA' UNION ALL SELECT c.id, c.kind FROM t JOIN g1n c ON c.up = t.id)")
traversal("repeat_times", "g3", 'cpg.method.name("NATION_2").repeat(_.callee)(times(3)).name', "SELECT n.name AS value FROM g3n a JOIN g3e x ON x.src = a.id JOIN g3e y ON y.src = x.dst JOIN g3e z ON z.src = y.dst JOIN g3n n ON n.id = z.dst WHERE a.name = 'NATION_2'")
traversal("repeat_emit_max_depth", "g1", 'cpg.namespace.repeat(_.astChildren)(emit.maxDepth(2)).name', "SELECT name AS value FROM g1n WHERE kind IN ('NAMESPACE', 'TYPE_DECL', 'METHOD')")
traversal("repeat_emit_but_first", "g1", 'cpg.namespace.repeat(_.astChildren)(emitAllButFirst.times(2)).name', "SELECT name AS value FROM g1n WHERE kind IN ('TYPE_DECL', 'METHOD')")
traversal("repeat_until", "g1", 'cpg.block.name("1-URGENT").repeat(_.astParent)(until(_.isTypeDecl)).name', "SELECT n_name AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderpriority = '1-URGENT'", more="tables")
traversal("cfg_next_names", "g2", 'cpg.call.name("signup").cfgNext.name', "SELECT coalesce(nx, 'RET') AS value FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) nx FROM events) WHERE event_type = 'signup'", more="tables")


# fixpoints
_CLOSE = "R:t AS (SELECT src a, dst b FROM g3e UNION SELECT t.a, e.dst FROM t JOIN g3e e ON e.src = t.b)"


@on("g3", "SELECT a, b FROM t", _CLOSE)
def transitive_closure(g):
    return closure(g.e("CALL").select(F.col("src").alias("a"), F.col("dst").alias("b")))


@on("g3", f"SELECT DISTINCT node FROM (SELECT a AS node FROM t WHERE b = {NATION + 5} UNION ALL SELECT {NATION + 5})", _CLOSE)
def reverse_reachable(g):
    seed = g.nodes.where(F.col("id") == NATION + 5).select(F.col("id").alias("origin"), F.col("id").alias("node"))
    return reach(seed, g.e("CALL").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("node")


@on("g3", "SELECT node FROM t", f"R:t AS (SELECT {NATION}::bigint node UNION SELECT e.dst FROM t JOIN g3e e ON e.src = t.node WHERE e.dst NOT IN ({NATION + 6}, {NATION + 18}))")
def reaches_avoiding(g):
    seed = g.nodes.where(F.col("id") == NATION).select(F.col("id").alias("origin"), F.col("id").alias("node"))
    return reach(seed, g.e("CALL"), blocked=g.nodes.where(F.col("id").isin(NATION + 6, NATION + 18)).select("id")).select("node")


@on("g3", "SELECT node, min(d)::int AS depth FROM t GROUP BY node", f"R:t AS (SELECT {NATION}::bigint node, 0 d UNION SELECT e.dst, d + 1 FROM t JOIN g3e e ON e.src = t.node WHERE d < 3)")
def reach_with_depth(g):
    seed = g.nodes.where(F.col("id") == NATION).select(F.col("id").alias("origin"), F.col("id").alias("node"))
    return reach(seed, g.e("CALL"), max_depth=3).select("node", "depth")


@on("g3", "SELECT b AS node, depth, array_to_string(path, '>') AS path FROM (SELECT *, len(path) - 1 AS depth FROM t) QUALIFY row_number() OVER (PARTITION BY b ORDER BY depth, path) = 1", f"R:t AS (SELECT {NATION}::bigint b, [{NATION}::bigint] path UNION ALL SELECT e.dst, list_append(path, e.dst) FROM t JOIN g3e e ON e.src = t.b WHERE NOT list_contains(path, e.dst) AND len(path) < 9)")
def shortest_call_paths(g):
    seed = g.nodes.where(F.col("id") == NATION).select(F.col("id").alias("origin"), F.col("id").alias("node"))
    got = shortest_paths(seed, g.e("CALL"), g.nodes.select("id"))
    return got.select("node", F.col("depth").cast("long").alias("depth"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


# as-of and ranked joins
@on("g2", "SELECT e.id, a.id AS before_id FROM (SELECT * FROM g_ev WHERE name = 'purchase') e ASOF LEFT JOIN (SELECT * FROM g_ev WHERE name = 'signup') a ON a.method_id = e.method_id AND a.line <= e.line")
def nearest_preceding_method(g):
    last = F.last(F.when(F.col("name") == "signup", F.col("id")), ignorenulls=True).over(W.partitionBy("method_id").orderBy("line"))
    return g.calls().withColumn("before_id", last).where("name = 'purchase'").select("id", "before_id")


@on("g2", "SELECT e.id, min(a.line)::int AS within FROM g_ev e JOIN g_ev a ON a.method_id = e.method_id AND a.name = 'error' AND a.line BETWEEN e.line + 1 AND e.line + 3 WHERE e.name = 'view' GROUP BY e.id")
def decorated_within_three_lines(g):
    nxt = F.first(F.when(F.col("name") == "error", F.col("line")), ignorenulls=True).over(W.partitionBy("method_id").orderBy("line").rangeBetween(1, 3))
    return g.calls().withColumn("within", nxt).where("name = 'view' AND within IS NOT NULL").select("id", "within")


# scalar functions, over names of documents' words and of parts
def _scalar(name: str, spark_expr: Callable, sql: str, table: str = "part", column: str = "p_type") -> None:
    def run(spark, sf_dir):
        return derive.read(spark, sf_dir, table).select(F.col(column).alias("input"), spark_expr(F.col(column)).alias("output"))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT {column} AS input, {sql} AS output FROM {table}"


_scalar("glob_match", lambda c: fn.glob_match(c, "*BRASS?STEEL*") | fn.glob_match(c, "PROMO*"), "regexp_full_match(p_type, '.*BRASS.STEEL.*') OR p_type LIKE 'PROMO%'")
_scalar("pat_match", lambda c: fn.pat_match(c, "*1*"), "c_name LIKE '%1%'", "customer", "c_name")
_scalar("word_tokens", lambda c: F.array_join(fn.word_tokens(F.concat(F.lit("getHTTPName_"), c)), " "), "array_to_string(list_filter(regexp_split_to_array('get http name ' || lower(regexp_replace(c_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> ''), ' ')", "customer", "c_name")
_scalar("lc_first", fn.lc_first, "lower(left(p_type, 1)) || substr(p_type, 2)")
_scalar("type_base", lambda c: fn.type_base(F.concat(F.lit("std::vec."), c, F.lit("*"))), "regexp_extract(c_name, '([^.:/*&]*)$', 1)", "customer", "c_name")
_scalar("spec_name_normalize", lambda c: fn.spec_name(F.concat(F.lit("::recv."), c, F.lit("@2"))), "regexp_extract(c_name, '([^.]*)$', 1)", "customer", "c_name")
_scalar("spec_index", lambda c: fn.spec_index(F.concat(F.lit("f@"), F.when(c.endswith("1"), "out").otherwise(""), F.when(c.endswith("2"), "x").otherwise(F.right(c, F.lit(3))))), "CASE WHEN c_name LIKE '%2' THEN NULL ELSE try_cast(right(c_name, 3) AS int) END", "customer", "c_name")
_scalar("is_invocation", lambda c: fn.is_invocation(F.concat(F.lit("x = "), c, F.lit("(1)")), F.lit("purchase")), "event_type = 'purchase'", "events", "event_type")
_scalar("qualified_spelling", lambda c: fn.qualified_spelling(F.concat(F.lit("a.b."), c, F.lit(" (1, f(2))"))), "'a.b.' || event_type", "events", "event_type")
_scalar("literal_string", lambda c: fn.literal_string(F.when(c.startswith("PROMO"), c).when(c.startswith("SMALL"), F.concat(F.lit("'"), c, F.lit("\""))).when(c.startswith("LARGE"), F.concat(F.lit("`"), c, F.lit("\n`"))).otherwise(F.concat(F.lit('"'), c, F.lit('"')))), "CASE WHEN p_type LIKE 'PROMO%' OR p_type LIKE 'SMALL%' THEN NULL WHEN p_type LIKE 'LARGE%' THEN p_type || chr(10) ELSE p_type END")
_scalar("sarif_level", lambda c: fn.sarif_level(F.when(c.startswith("1"), "critical").when(c.startswith("2"), "medium").otherwise("low")), "CASE left(o_orderpriority, 1) WHEN '1' THEN 'error' WHEN '2' THEN 'warning' ELSE 'note' END", "orders", "o_orderpriority")
_scalar("is_operator", lambda c: fn.is_operator(F.when(c.startswith("S"), F.concat(F.lit("<operator>."), c)).when(c.startswith("M"), F.lit("+")).otherwise(c)), "left(p_type, 1) IN ('S', 'M')")
_scalar("xml_escape", lambda c: fn.xml_escape(F.concat(c, F.lit("<&>\""))), "r_name || '&lt;&amp;&gt;&quot;'", "region", "r_name")
_scalar("dot_escape", lambda c: fn.dot_escape(F.concat(c, F.lit("\"\\\n"))), "r_name || '\\\"\\\\\\n'", "region", "r_name")
_scalar("file_name_sanitize", lambda c: fn.file_name(F.concat(c, F.lit("/a b"))), "regexp_replace(r_name, '[^A-Za-z0-9_.\\-]', '_', 'g') || '_a_b'", "region", "r_name")
_scalar("feature_hash", fn.feature_hash, "(SELECT list_reduce(list_prepend(2166136261::ubigint, list_transform(range(1, length(r_name) + 1), lambda i: ascii(substr(r_name, i, 1))::ubigint)), lambda h, b: (xor(h, b) * 16777619) % 4294967296))::bigint", "region", "r_name")
_scalar("positional_spec", lambda c: F.concat_ws("|", fn.positional(F.concat(c, F.lit("@src/a.c:12"))).getField("name"), fn.positional(F.concat(c, F.lit("@src/a.c:12"))).getField("line").cast("string")), "event_type || '|12'", "events", "event_type")
_scalar("capacity_call", lambda c: fn.is_capacity_call(F.when(c.startswith("PROMO"), "::growBuffer").when(c.startswith("SMALL"), "outgrow").when(c.startswith("LARGE"), "ensureTheCapacity").when(c.startswith("MEDIUM"), "luaZ_prepbuffsize").otherwise(c)), "regexp_matches(p_type, '^(PROMO|LARGE|MEDIUM)')")
_scalar("content_digest", lambda c: F.sha2(c, 256), "sha256(text)", "documents", "text")


LANGUAGES = {"en": "py", "de": "c", "fr": "java", "es": "go"}


def language_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, whose extension stands for their language: how many files each language has, and which one leads."""
    ext = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.col("lang"))
    files = derive.read(spark, sf_dir, "documents").select(F.concat_ws(".", F.concat_ws("/", "source", F.col("doc_id").cast("string")), ext).alias("path"), F.lit("").alias("text"))
    lead = dominant_language(files)
    return with_language(files).groupBy("language").agg(F.count(F.lit(1)).alias("files")).withColumn("leads", F.col("language") == lead)


QUERIES["language_census"] = language_census
ORACLES["language_census"] = "SELECT language, files, row_number() OVER (ORDER BY files DESC, list_position(['c', 'cpp', 'java', 'go', 'javascript', 'typescript', 'python'], language)) = 1 AS leads FROM (SELECT CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'java' WHEN 'es' THEN 'go' ELSE 'c' END AS language, count(*) AS files FROM documents GROUP BY 1)"
