"""Interface files: proto RPC names, thrift services, routes files, function models and schema fragments."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as fn
from ..plans.fixpoint import closure
from ..plans.graph import Graph


def proto_rpcs(lines: DataFrame) -> DataFrame:
    """lines (value) of proto files to (name) of RPCs."""
    name = F.regexp_extract("value", r"^\s*rpc\s+(\w+)\s*\(", 1)
    return lines.select(name.alias("name")).where("name <> ''").distinct()


def play_routes(lines: DataFrame) -> DataFrame:
    """lines (value) `VERB /path package.Class.method(args)` to (verb, path, class, method)."""
    p = r"^\s*(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(/\S*)\s+@?([\w.$]+)\.(\w+)"
    part = lambda i: F.regexp_extract("value", p, i)
    rows = lines.where(~F.trim("value").rlike(r"^(#|\+|->)")).select(part(1).alias("verb"), part(2).alias("path"), F.element_at(F.split(part(3), r"\."), -1).alias("class"), part(4).alias("method"))
    return rows.where("verb <> ''")


def play_entries(graph: Graph, routes: DataFrame) -> DataFrame:
    """routes with the method's id; null where no method of the class has the name."""
    methods = graph.methods().select(fn.type_base(F.col("type_full_name")).alias("class"), F.col("name").alias("method"), F.col("id"))
    return routes.join(methods, ["class", "method"], "left")


@F.udtf(returnType="service: string, parent: string, method: string")
class _Thrift:
    def eval(self, text: str):
        text = re.sub(r"/\*.*?\*/|//[^\n]*|#[^\n]*", " ", text or "", flags=re.S)
        for m in re.finditer(r"\bservice\s+(\w+)\s*(?:extends\s+([\w.]+)\s*)?\{", text):
            depth, j = 1, m.end()
            while j < len(text) and depth:
                depth += (text[j] == "{") - (text[j] == "}")
                j += 1
            body, out, depth, last = text[m.end() : j - 1], [], 0, ""
            for k, c in enumerate(body):
                if c == "(" and depth == 0:
                    name = re.search(r"(\w+)\s*$", body[:k])
                    if name and name.group(1) != "throws":
                        out.append(name.group(1))
                depth += (c == "(") - (c == ")")
            del last
            parent = (m.group(2) or "").rpartition(".")[2] or None
            for name in out or [None]:
                yield m.group(1), parent, name


def thrift_services(texts: DataFrame) -> DataFrame:
    """texts (text) of thrift files to (service, method), with what services take from those they extend."""
    spark = texts.sparkSession
    spark.udtf.register("thrift_services", _Thrift)
    texts.select("text").createOrReplaceTempView("_thrift_texts")
    rows = spark.sql("SELECT s.* FROM _thrift_texts, LATERAL thrift_services(text) s")
    own = rows.where("method IS NOT NULL").select("service", "method")
    up = closure(rows.where("parent IS NOT NULL").select(F.col("service").alias("a"), F.col("parent").alias("b")))
    inherited = up.join(own, F.col("b") == F.col("service")).select(F.col("a").alias("service"), "method")
    return own.unionByName(inherited).distinct()


def thrift_entries(graph: Graph, services: DataFrame, most: int = 8) -> DataFrame:
    """(service, method, id): methods of classes that implement a service's `If` or `Null`, clients and mocks apart."""
    types = graph.of_kind("TYPE_DECL").where("bases IS NOT NULL").select(F.col("name").alias("class"), F.explode("bases").alias("base"))
    types = types.where(~F.col("class").rlike("Client$|^Mock")).withColumn("service", F.regexp_extract("base", r"^(\w+?)(?:S?v?If|Null)$", 1)).where("service <> ''")
    methods = graph.methods().select(F.col("type_full_name").alias("class"), F.col("name").alias("method"), "id")
    rows = services.join(types, "service").join(methods, ["class", "method"])
    few = rows.groupBy("service", "method").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)
    return rows.join(few, ["service", "method"], "left_semi").select("service", "method", "id")


_MODEL = T.StructType(
    [
        T.StructField("functionDeclaration", T.StructType([T.StructField("language", T.StringType()), T.StructField("methodName", T.StringType())])),
        T.StructField("dataFlows", T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("from", "to", "via", "sanitizer", "kind")] + [T.StructField("labels", T.ArrayType(T.StringType()))]))),
        T.StructField("callReturns", T.ArrayType(T.StructType([T.StructField("call", T.StringType()), T.StructField("via", T.StringType())]))),
        T.StructField("receiverModeled", T.BooleanType()),
    ]
)


def function_models(spark: SparkSession, texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """texts (text) of JSON lists to summary_flow, summary_call_return and summary_meta."""
    rows = texts.select(F.explode(F.from_json("text", T.ArrayType(_MODEL))).alias("m")).select(F.col("m.functionDeclaration.methodName").alias("fqn"), "m.*")
    flow = rows.select("fqn", F.explode("dataFlows").alias("f"))
    label = F.regexp_extract(F.element_at(F.filter("f.labels", lambda x: x.startswith("sanitized:")), 1), "^sanitized:(.*)$", 1)
    via = F.coalesce("f.via", "f.sanitizer", label, F.when(F.col("f.kind") == "sanitized", "sanitized"))
    kind = lambda c: F.when(c.rlike(r"^param\d+$"), "param").when(c.isin("recv", "receiver"), "recv").otherwise(c)
    flows = flow.select("fqn", kind(F.col("f.from")).alias("from_kind"), F.nullif(F.regexp_extract("f.from", r"^param(\d+)$", 1), F.lit("")).cast("int").alias("from_idx"), kind(F.col("f.to")).alias("to_kind"), via.alias("via"))
    returns = rows.select("fqn", F.explode("callReturns").alias("c")).select("fqn", "c.call", "c.via")
    receiver = flows.where("from_kind = 'recv'").select("fqn").distinct().withColumn("_r", F.lit(True))
    meta = rows.select("fqn", "receiverModeled").join(receiver, "fqn", "left").select("fqn", F.lit("external").alias("origin"), (F.coalesce("receiverModeled", F.lit(False)) | F.coalesce("_r", F.lit(False))).alias("models_receiver"))
    return flows, returns, meta
