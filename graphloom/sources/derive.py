"""Graphs derived from relational tables, so that graph queries have a relational answer to be held against.

containment: region > nation > customer > order > line as NAMESPACE > TYPE_DECL > METHOD > BLOCK > CALL, with REF to
parts and EVAL_TYPE to suppliers. events: a METHOD for each user, a CALL for each event, CFG in time order. trade: a
METHOD for each nation that calls the three nations it buys most from. SQL states the same graphs for DuckDB.
Ids are a code for the kind times 10^12 plus the table's key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.graph import EDGES, NODES, Graph, shaped
from ..plans.storage import kept

CODE = {"region": 1, "nation": 2, "customer": 3, "orders": 4, "line": 5, "part": 6, "supplier": 7, "user": 10, "event": 11, "exit": 12, "parameter": 21, "return": 22, "trade": 23, "good": 24, "region_type": 25, "nation_type": 26, "page": 31, "route": 32, "handler": 33, "handled": 34}
UNIT = 10**12


def _id(table: str, key) -> F.Column:
    return (F.lit(CODE[table] * UNIT) + key.cast("long")).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _union(frames: list[DataFrame], schema) -> DataFrame:
    out = shaped(frames[0], schema)
    for f in frames[1:]:
        out = out.unionByName(shaped(f, schema))
    return out


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with an id: its rank within the order, as line numbers repeat."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    li = read(spark, sf_dir, "lineitem")
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order))
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", n.alias("n")).withColumn("id", _id("line", F.col("l_orderkey") * 1000 + F.col("n")))


def containment(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda n: read(spark, sf_dir, n)
    lit = F.lit
    region = t("region").select(_id("region", F.col("r_regionkey")).alias("id"), lit("NAMESPACE").alias("kind"), F.col("r_name").alias("name"), F.col("r_name").alias("full_name"))
    nation = t("nation").select(_id("nation", F.col("n_nationkey")).alias("id"), lit("TYPE_DECL").alias("kind"), F.col("n_name").alias("name"), F.col("n_name").alias("full_name"), _id("region", F.col("n_regionkey")).alias("up"))
    customer = t("customer").select(_id("customer", F.col("c_custkey")).alias("id"), lit("METHOD").alias("kind"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("full_name"), _id("customer", F.col("c_custkey")).alias("method_id"), _id("nation", F.col("c_nationkey")).alias("up"))
    orders = t("orders").select(_id("orders", F.col("o_orderkey")).alias("id"), lit("BLOCK").alias("kind"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("code"), _id("customer", F.col("o_custkey")).alias("method_id"), _id("customer", F.col("o_custkey")).alias("up"))
    li = lines(spark, sf_dir)
    call = li.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select(
        "id", lit("CALL").alias("kind"), F.concat_ws("_", F.lower("l_returnflag"), F.lower("l_linestatus")).alias("name"), F.concat(lit("use("), F.col("l_partkey"), lit(", "), F.col("l_suppkey"), lit(")")).alias("code"),
        F.col("n").alias("line"), _id("customer", F.col("o_custkey")).alias("method_id"), _id("orders", F.col("l_orderkey")).alias("up"), F.col("n").alias("order_"),
    )
    part = t("part").select(_id("part", F.col("p_partkey")).alias("id"), lit("TYPE").alias("kind"), F.col("p_type").alias("name"), F.col("p_brand").alias("full_name"), lit(1).alias("argument_index"))
    supplier = t("supplier").select(_id("supplier", F.col("s_suppkey")).alias("id"), lit("MEMBER").alias("kind"), F.col("s_name").alias("name"), lit(2).alias("argument_index"))
    nodes = _union([region, nation, customer, orders, call, part, supplier], NODES)
    ast = [
        df.select(F.col("up").alias("src"), F.col("id").alias("dst"), lit("AST").alias("kind"), F.row_number().over(W.partitionBy("up").orderBy("id")).alias("ord")) for df in (nation, customer, orders)
    ] + [li.select(_id("orders", F.col("l_orderkey")).alias("src"), F.col("id").alias("dst"), lit("AST").alias("kind"), F.col("n").alias("ord"))]
    ref = li.select(F.col("id").alias("src"), _id("part", F.col("l_partkey")).alias("dst"), lit("REF").alias("kind"), lit(1).alias("ord"))
    use = li.select(F.col("id").alias("src"), _id("supplier", F.col("l_suppkey")).alias("dst"), lit("EVAL_TYPE").alias("kind"), lit(1).alias("ord"))
    args = [ref.withColumn("kind", lit("ARGUMENT")), use.withColumn("kind", lit("ARGUMENT")).withColumn("ord", lit(2))]
    return Graph(nodes, _union([*ast, ref, use, *args], EDGES))


def events(spark: SparkSession, sf_dir: str) -> Graph:
    ev = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    ev = ev.withColumn("line", F.row_number().over(by)).withColumn("next", F.lead("event_id").over(by)).withColumn("id", _id("event", F.col("event_id"))).withColumn("method_id", _id("user", F.col("user_id")))
    users = ev.select("user_id", "method_id").distinct()
    method = users.select(F.col("method_id").alias("id"), F.lit("METHOD").alias("kind"), F.concat(F.lit("user"), F.col("user_id")).alias("name"), "method_id")
    leave = users.select(_id("exit", F.col("user_id")).alias("id"), F.lit("METHOD_RETURN").alias("kind"), F.lit("RET").alias("name"), "method_id")
    call = ev.select("id", F.lit("CALL").alias("kind"), F.col("event_type").alias("name"), F.concat(F.col("event_type"), F.lit("()")).alias("code"), "line", "method_id", F.col("line").alias("order_"))
    edge = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))
    exit_ = _id("exit", F.col("user_id"))
    flow = edge(ev, F.col("id"), F.coalesce(_id("event", F.col("next")), exit_), "CFG").unionByName(edge(ev.where("line = 1"), F.col("method_id"), F.col("id"), "CFG"))
    tree = edge(ev, F.col("method_id"), F.col("id"), "AST").unionByName(edge(users, F.col("method_id"), exit_, "AST"))
    return Graph(_union([method, leave, call], NODES), _union([flow, tree], EDGES))


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations come before the join of the fact tables, so that these shuffle once and come out as counts of pairs of nations. What
    each nation buys is written, as walks read their edges many times and would read the fact tables as often."""
    t = lambda n: read(spark, sf_dir, n)
    sold = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("b")), "l_suppkey").select(F.col("l_orderkey").alias("o_orderkey"), "b")
    bought = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("a")), "o_custkey").select("o_orderkey", "a")
    pairs = sold.join(bought, "o_orderkey").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    top = kept(pairs.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("n"), "b"))).where("r <= 3"), "trade")
    nodes = t("nation").select(_id("nation", F.col("n_nationkey")).alias("id"), F.lit("METHOD").alias("kind"), F.col("n_name").alias("name"), F.concat(F.lit("world."), F.col("n_name")).alias("full_name"), _id("nation", F.col("n_nationkey")).alias("method_id"))
    edges = top.select(_id("nation", F.col("a")).alias("src"), _id("nation", F.col("b")).alias("dst"), F.lit("CALL").alias("kind"), F.col("r").alias("ord"))
    return Graph(shaped(nodes, NODES), shaped(edges, EDGES))


def classes(spark: SparkSession, sf_dir: str) -> Graph:
    """Calls with receiver types: a METHOD for each part, named by brand and size, owned by a nation, a region or nobody, with 0 to 3
    parameters; a CALL for each line of such a method, with a nation, a region or nothing as hint and 0 to 3 arguments.
    Nations are types derived from regions, regions from WORLD. A nation's file is a test, if it lies in region 4."""
    t = lambda n: read(spark, sf_dir, n)
    lit = F.lit
    nation, region = t("nation"), t("region")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("file_id"), "n_name", "r_name", "n_regionkey")
    files = place.select("file_id", F.concat(F.when(F.col("n_regionkey") == 4, "tests/n").otherwise("src/n"), F.col("file_id"), lit(".c")).alias("path"), lit("c").alias("language"), lit("").alias("digest"))
    types = place.select(_id("nation_type", F.col("file_id")).alias("id"), lit("TYPE_DECL").alias("kind"), F.col("n_name").alias("name"), F.array("r_name").alias("bases"))
    types = types.unionByName(region.select(_id("region_type", F.col("r_regionkey")).alias("id"), lit("TYPE_DECL").alias("kind"), F.col("r_name").alias("name"), F.array(lit("WORLD")).alias("bases")))
    called = F.concat_ws("_", F.col("p_brand"), F.col("p_size").cast("string"))
    part = t("part").withColumn("file_id", F.pmod("p_partkey", lit(25)).cast("long")).join(place, "file_id")
    owner = F.when(F.col("p_type").startswith("PROMO"), lit(None)).when(F.col("p_type").startswith("ECONOMY"), F.col("r_name")).otherwise(F.col("n_name"))
    part = part.select(_id("part", F.col("p_partkey")).alias("id"), lit("METHOD").alias("kind"), called.alias("name"), owner.alias("type_full_name"), "file_id", F.pmod("p_size", lit(4)).alias("n"))
    params = part.where("n > 0").select(F.col("id").alias("src"), F.explode(F.sequence(lit(1), F.col("n"))).alias("order_")).withColumn("id", F.col("src") * 4 + F.col("order_"))
    nodes = [types, part, params.select("id", lit("METHOD_PARAMETER_IN").alias("kind"), "order_")]
    li = lines(spark, sf_dir).withColumn("file_id", F.pmod("l_suppkey", lit(25)).cast("long")).join(t("part").select(F.col("p_partkey").alias("l_partkey"), called.alias("name")), "l_partkey").join(place, "file_id")
    hint = F.when(F.col("l_returnflag") == "R", F.col("n_name")).when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), F.col("r_name"))
    li = li.select("id", lit("CALL").alias("kind"), "name", hint.alias("type_full_name"), "file_id", F.pmod("n", lit(4)).alias("n"))
    args = li.where("n > 0").select(F.col("id").alias("src"), F.explode(F.sequence(lit(1), F.col("n"))).alias("ord")).select("src", F.col("src").alias("dst"), lit("ARGUMENT").alias("kind"), "ord")
    return Graph(_union([*nodes, li], NODES), _union([params.select("src", F.col("id").alias("dst"), lit("AST").alias("kind"), F.col("order_").alias("ord")), args], EDGES), files)


def trade_program(spark: SparkSession, sf_dir: str) -> Graph:
    """trade as a program: a nation is a method of one parameter, that hands it to the three nations it calls. A call's result goes
    into the next call's argument; the first call's result is returned, and the parameter itself by every third nation."""
    g = trade(spark, sf_dir)
    key = F.col("id") - CODE["nation"] * UNIT
    nation = g.nodes.select("id", "name", "full_name", key.alias("k"))
    lit, none = F.lit, F.lit(None).cast("string")
    method = nation.select("id", lit("METHOD").alias("kind"), "name", "full_name", F.col("id").alias("method_id"))
    param = nation.select(_id("parameter", F.col("k")).alias("id"), lit("METHOD_PARAMETER_IN").alias("kind"), lit("goods").alias("name"), lit(1).alias("order_"), F.col("id").alias("method_id"))
    leave = nation.select(_id("return", F.col("k")).alias("id"), lit("METHOD_RETURN").alias("kind"), lit("RET").alias("name"), F.col("id").alias("method_id"))
    e = g.edges.join(nation.select(F.col("id").alias("src"), F.col("k").alias("a")), "src").join(nation.select(F.col("id").alias("dst"), F.col("k").alias("b"), F.col("name").alias("to")), "dst").select("a", "b", F.col("ord").alias("r"), "src", "dst", "to")
    at = lambda table, shift=0: _id(table, F.col("a") * 10 + F.col("r") + shift)
    call = e.select(at("trade").alias("id"), lit("CALL").alias("kind"), F.col("to").alias("name"), F.concat("to", lit("(goods)")).alias("code"), F.col("r").alias("line"), F.col("src").alias("method_id"))
    good = e.select(at("good").alias("id"), lit("IDENTIFIER").alias("kind"), lit("goods").alias("name"), lit(1).alias("argument_index"), F.col("src").alias("method_id"))
    edge = lambda df, src, dst, kind, place=1, p=none: df.select(src.alias("src"), dst.alias("dst"), lit(kind).alias("kind"), lit(place).alias("ord"), p.alias("property"))
    own, var, ret = _id("parameter", F.col("a")), lit("goods"), lit("<RET>")
    edges = [
        edge(nation, F.col("id"), _id("parameter", F.col("k")), "AST"), edge(nation, F.col("id"), _id("return", F.col("k")), "AST", 9), edge(e, F.col("src"), at("trade"), "AST", 2),
        edge(e, at("trade"), at("good"), "ARGUMENT"), edge(e, at("trade"), F.col("dst"), "CALL", 0),
        edge(e, own, at("good"), "REACHING_DEF", p=var), edge(e, at("good"), at("trade"), "REACHING_DEF", p=var), edge(e.where("r < 3"), at("trade"), at("good", 1), "REACHING_DEF", p=var),
        edge(e.where("r = 1"), at("trade"), _id("return", F.col("a")), "REACHING_DEF", p=ret), edge(nation.where("k % 3 = 0"), _id("parameter", F.col("k")), _id("return", F.col("k")), "REACHING_DEF", p=ret),
    ]
    return Graph(kept(_union([method, param, leave, call, good], NODES), "trade-nodes"), kept(_union(edges, EDGES), "trade-edges"))


def routes(spark: SparkSession, sf_dir: str) -> Graph:
    """Pages as registrations: a call with the url's path as its first argument and a handler named after the path's first part."""
    url = F.col("url")
    page = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, r"://[^/?#]*(/[^?#]*)", 1).alias("path"), F.startswith(url, F.lit("https")).alias("safe"))
    page = page.withColumn("part", F.regexp_extract("path", "^/([^/]*)", 1)).withColumn("handler", F.concat(F.lit("on_"), "part"))
    lit = F.lit
    call = page.select(_id("page", F.col("page_id")).alias("id"), lit("CALL").alias("kind"), F.when(F.col("safe"), "get").otherwise("HandleFunc").alias("name"), F.col("page_id").cast("int").alias("line"))
    route = page.select(_id("route", F.col("page_id")).alias("id"), lit("LITERAL").alias("kind"), F.concat(lit('"'), "path", lit('"')).alias("code"))
    handler = page.select(_id("handler", F.col("page_id")).alias("id"), lit("IDENTIFIER").alias("kind"), F.col("handler").alias("name"))
    method = page.where("part <> 'es'").groupBy("handler").agg(F.min("page_id").alias("k")).select(_id("handled", F.col("k")).alias("id"), lit("METHOD").alias("kind"), F.col("handler").alias("name"))
    arg = lambda table, k: page.select(_id("page", F.col("page_id")).alias("src"), _id(table, F.col("page_id")).alias("dst"), lit("ARGUMENT").alias("kind"), lit(k).alias("ord"))
    return Graph(_union([call, route, handler, method], NODES), _union([arg("route", 1), arg("handler", 2)], EDGES))


def _sql_id(table: str, key: str) -> str:
    return f"({CODE[table] * UNIT}::bigint + {key})"


_LINES = f"""g_lines AS (SELECT *, {_sql_id('line', 'l_orderkey * 1000 + n')} id FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice)::int n FROM lineitem))"""
CONTAINMENT_SQL = f"""{_LINES},
g1n AS (SELECT {_sql_id('region', 'r_regionkey')} id, 'NAMESPACE' kind, r_name AS name, r_name full_name, NULL code, NULL::int line, NULL::bigint method_id, NULL::bigint up, NULL::int argument_index FROM region
    UNION ALL SELECT {_sql_id('nation', 'n_nationkey')}, 'TYPE_DECL', n_name, n_name, NULL, NULL, NULL, {_sql_id('region', 'n_regionkey')}, NULL FROM nation
    UNION ALL SELECT {_sql_id('customer', 'c_custkey')}, 'METHOD', c_name, c_mktsegment, NULL, NULL, {_sql_id('customer', 'c_custkey')}, {_sql_id('nation', 'c_nationkey')}, NULL FROM customer
    UNION ALL SELECT {_sql_id('orders', 'o_orderkey')}, 'BLOCK', o_orderpriority, NULL, o_orderstatus, NULL, {_sql_id('customer', 'o_custkey')}, {_sql_id('customer', 'o_custkey')}, NULL FROM orders
    UNION ALL SELECT id, 'CALL', lower(l_returnflag) || '_' || lower(l_linestatus), NULL, 'use(' || l_partkey || ', ' || l_suppkey || ')', n, {_sql_id('customer', 'o_custkey')}, {_sql_id('orders', 'l_orderkey')}, NULL FROM g_lines JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT {_sql_id('part', 'p_partkey')}, 'TYPE', p_type, p_brand, NULL, NULL, NULL, NULL, 1 FROM part
    UNION ALL SELECT {_sql_id('supplier', 's_suppkey')}, 'MEMBER', s_name, NULL, NULL, NULL, NULL, NULL, 2 FROM supplier),
g1e AS (SELECT up src, id dst, 'AST' kind, row_number() OVER (PARTITION BY up ORDER BY id)::int ord FROM g1n WHERE up IS NOT NULL
    UNION ALL SELECT id, {_sql_id('part', 'l_partkey')}, 'REF', 1 FROM g_lines UNION ALL SELECT id, {_sql_id('supplier', 'l_suppkey')}, 'EVAL_TYPE', 1 FROM g_lines
    UNION ALL SELECT id, {_sql_id('part', 'l_partkey')}, 'ARGUMENT', 1 FROM g_lines UNION ALL SELECT id, {_sql_id('supplier', 'l_suppkey')}, 'ARGUMENT', 2 FROM g_lines)"""
EVENTS_SQL = f"""g_ev AS (SELECT {_sql_id('event', 'event_id')} id, user_id, {_sql_id('user', 'user_id')} method_id, {_sql_id('exit', 'user_id')} leave, event_type AS name, ts, event_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::int line, lead({_sql_id('event', 'event_id')}) OVER (PARTITION BY user_id ORDER BY ts, event_id) nxt FROM events),
g2n AS (SELECT id, 'CALL' kind, name, line, method_id FROM g_ev UNION ALL SELECT DISTINCT method_id, 'METHOD', 'user' || user_id, NULL, method_id FROM g_ev UNION ALL SELECT DISTINCT leave, 'METHOD_RETURN', 'RET', NULL, method_id FROM g_ev),
g2e AS (SELECT id src, coalesce(nxt, leave) dst, 'CFG' kind FROM g_ev UNION ALL SELECT method_id, id, 'CFG' FROM g_ev WHERE line = 1 UNION ALL SELECT method_id, id, 'AST' FROM g_ev UNION ALL SELECT DISTINCT method_id, leave, 'AST' FROM g_ev)"""
TRADE_SQL = f"""g_top AS (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b)::int r FROM (SELECT c_nationkey a, s_nationkey b, count(*) n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL) QUALIFY r <= 3),
g3n AS (SELECT {_sql_id('nation', 'n_nationkey')} id, n_name AS name, 'world.' || n_name full_name FROM nation), g3e AS (SELECT {_sql_id('nation', 'a')} src, {_sql_id('nation', 'b')} dst, r ord FROM g_top)"""
CLASSES_SQL = f"""{_LINES},
g4k AS (SELECT n_name a, r_name b FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region UNION ALL SELECT n_name, 'WORLD' FROM nation),
g4p AS (SELECT n_nationkey file, n_name, r_name, n_regionkey = 4 AS test FROM nation JOIN region ON n_regionkey = r_regionkey),
g4m AS (SELECT {_sql_id('part', 'p_partkey')} target, p_brand || '_' || p_size AS name, CASE WHEN p_type LIKE 'PROMO%' THEN NULL WHEN p_type LIKE 'ECONOMY%' THEN r_name ELSE n_name END AS owner, file, test, p_size % 4 AS n FROM part JOIN g4p ON file = p_partkey % 25),
g4c AS (SELECT id AS call, p_brand || '_' || p_size AS name, CASE WHEN l_returnflag = 'R' THEN n_name WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN r_name END AS hint, file, test, n % 4 AS n FROM g_lines JOIN part ON l_partkey = p_partkey JOIN g4p ON file = l_suppkey % 25)"""
_K = lambda table, shift=0: _sql_id(table, f"a * 10 + r + {shift}")
#: g5f: nations whose parameter comes back, some calls being cut; g5s: steps of a value with the state (0 may still climb) before and after.
TRADE_PROGRAM_SQL = f"""{TRADE_SQL},
g5 AS (SELECT a, b, r, n_name AS called FROM g_top JOIN nation ON n_nationkey = b), g5k AS (SELECT n_nationkey::bigint k FROM nation),
g5rd AS (SELECT {_sql_id('parameter', 'a')} src, {_K('good')} dst FROM g5 UNION ALL SELECT {_K('good')}, {_K('trade')} FROM g5 UNION ALL SELECT {_K('trade')}, {_K('good', 1)} FROM g5 WHERE r < 3
    UNION ALL SELECT {_K('trade')}, {_sql_id('return', 'a')} FROM g5 WHERE r = 1 UNION ALL SELECT {_sql_id('parameter', 'k')}, {_sql_id('return', 'k')} FROM g5k WHERE k % 3 = 0),
g5dd AS (SELECT * FROM g5rd WHERE (src, dst) NOT IN (SELECT ({_K('good')}, {_K('trade')}) FROM g5)),
g5down AS (SELECT {_K('good')} src, {_sql_id('parameter', 'b')} dst FROM g5), g5up AS (SELECT {_sql_id('return', 'b')} src, {_K('trade')} dst FROM g5)"""


def returned_sql(cut: str = "''") -> str:
    """Recursive g5f: nations (k) whose parameter is returned, where calls of names in cut return nothing."""
    return f"g5f AS (SELECT k FROM g5k WHERE k % 3 = 0 UNION SELECT a FROM g5f JOIN g5 ON b = k AND r = 1 AND called NOT IN ({cut}))"


def steps_sql(cut: str = "''") -> str:
    """g5s (src, x, dst, y): steps that don't touch the calls of names in cut."""
    return f"""g5all AS (SELECT src, 0 x, dst, 0 y FROM g5dd UNION ALL SELECT src, 1, dst, 1 FROM g5dd UNION ALL SELECT {_K('good')}, s, {_K('trade')}, s FROM g5 JOIN g5f ON b = k, range(2) q(s)
        UNION ALL SELECT src, 0, dst, 0 FROM g5up UNION ALL SELECT src, 0, dst, 1 FROM g5down UNION ALL SELECT src, 1, dst, 1 FROM g5down),
    g5cut AS (SELECT {_K('trade')} id FROM g5 WHERE called IN ({cut})), g5s AS (SELECT * FROM g5all WHERE src NOT IN (SELECT id FROM g5cut) AND dst NOT IN (SELECT id FROM g5cut))"""


ROUTES_SQL = r"""g6 AS (SELECT page_id, regexp_extract(url, '://[^/?#]*(/[^?#]*)', 1) AS path, starts_with(url, 'https') AS safe FROM pages),
g6h AS (SELECT *, 'on_' || regexp_extract(path, '^/([^/]*)', 1) AS handler FROM g6)"""
