"""The graph: typed nodes and edges as two DataFrames, and its accessors as plans."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: The closed vocabularies of the graph.
NODE_KINDS = (
    "FILE NAMESPACE TYPE_DECL MEMBER METHOD METHOD_PARAMETER_IN METHOD_RETURN BLOCK CALL IDENTIFIER LITERAL LOCAL FIELD_IDENTIFIER CONTROL_STRUCTURE RETURN METHOD_REF UNKNOWN "
    "METHOD_PARAMETER_OUT TYPE_REF JUMP_TARGET MODIFIER NAMESPACE_BLOCK TYPE META_DATA BINDING CLOSURE_BINDING ANNOTATION ANNOTATION_LITERAL ANNOTATION_PARAMETER "
    "ANNOTATION_PARAMETER_ASSIGN ARRAY_INITIALIZER COMMENT CONFIG_FILE DEPENDENCY FINDING IMPORT JUMP_LABEL KEY_VALUE_PAIR TAG TAG_NODE_PAIR TEMPLATE_DOM TYPE_ARGUMENT"
).split()
EDGE_KINDS = (
    "AST CFG CALL REF DDG ARGUMENT RECEIVER CONTAINS REACHING_DEF CONDITION TRUE_BODY FALSE_BODY FOR_INIT FOR_UPDATE FOR_BODY DO_BODY EVAL_TYPE SOURCE_FILE PARAMETER_LINK "
    "BINDS DOMINATE POST_DOMINATE INHERITS_FROM CAPTURE IMPORTS"
).split()
LAYERS = ("Ast", "SymbolRef", "CallGraph", "Cfg", "Ddg", "Summaries")
FORMAT = 1

_STRINGS, _LONGS = T.ArrayType(T.StringType()), T.ArrayType(T.LongType())
NODES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("file_id", T.LongType()),
        T.StructField("method_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("full_name", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("type_full_name", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("bases", _STRINGS),
        T.StructField("receiver_name", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("column_number", T.IntegerType()),
        T.StructField("order_", T.IntegerType()),
        T.StructField("order_presence", T.StringType()),
        T.StructField("argument_index", T.IntegerType()),
        T.StructField("is_external", T.BooleanType()),
        T.StructField("modifier_type", T.StringType()),
        T.StructField("imported_entity", T.StringType()),
        T.StructField("imported_as", T.StringType()),
        T.StructField("dependency_group_id", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("external_label", T.StringType()),
        T.StructField("props_str", T.MapType(T.StringType(), _STRINGS)),
        T.StructField("props_int", T.MapType(T.StringType(), _LONGS)),
    ]
)
EDGES = T.StructType(
    [T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("ord", T.IntegerType()), T.StructField("property", T.StringType())]
)
FILES = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("language", T.StringType()), T.StructField("digest", T.StringType())])


def shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with all columns of a schema, null where it has none."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


@dataclass(frozen=True)
class Graph:
    """nodes and edges; files and the names of layers that passes must leave alone."""

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame | None = None
    authoritative: frozenset[str] = frozenset()

    # scans
    def of_kind(self, *kinds: str) -> DataFrame:
        return self.nodes.where(F.col("kind").isin(*kinds))

    def e(self, *kinds: str) -> DataFrame:
        return self.edges.where(F.col("kind").isin(*kinds))

    def methods(self) -> DataFrame:
        return self.of_kind("METHOD")

    def calls(self) -> DataFrame:
        return self.of_kind("CALL")

    def method_named(self, name: str) -> DataFrame:
        return self.methods().where((F.col("name") == name) | (F.col("full_name") == name))

    def calls_named(self, name: str) -> DataFrame:
        return self.calls().where(F.col("name") == name)

    def analysis_methods(self) -> DataFrame:
        return self.methods().where(is_analysis_method(F.col("name")))

    # hops
    def out(self, start: DataFrame, kind: str, key: str = "id") -> DataFrame:
        """(origin, node columns, ord): the nodes that edges of a kind lead to from ids."""
        hop = self.e(kind).select(F.col("src").alias("origin"), F.col("dst").alias("id"), "ord")
        return start.select(F.col(key).alias("origin")).join(hop, "origin").join(self.nodes, "id")

    def into(self, start: DataFrame, kind: str, key: str = "id") -> DataFrame:
        hop = self.e(kind).select(F.col("dst").alias("origin"), F.col("src").alias("id"), "ord")
        return start.select(F.col(key).alias("origin")).join(hop, "origin").join(self.nodes, "id")

    def parameters(self) -> DataFrame:
        """(method, id, name, index): parameters with a positive order, numbered from 0."""
        p = self.of_kind("METHOD_PARAMETER_IN").where("order_ > 0").select("id", "name", "order_")
        rows = self.e("AST").select(F.col("src").alias("method"), F.col("dst").alias("id")).join(p, "id")
        return rows.withColumn("index", F.row_number().over(W.partitionBy("method").orderBy("order_", "id")) - 1)

    def arguments(self) -> DataFrame:
        """(call, id, argument_index, position), in the order of the index."""
        a = self.e("ARGUMENT").select(F.col("src").alias("call"), F.col("dst").alias("id"), F.coalesce("ord", F.lit(0)).alias("_o"))
        rows = a.join(self.nodes.select("id", F.col("argument_index")), "id")
        return rows.withColumn("position", F.row_number().over(W.partitionBy("call").orderBy("argument_index", "_o", "id"))).drop("_o")

    def call_targets(self) -> DataFrame:
        return self.e("CALL").select(F.col("src").alias("call"), F.col("dst").alias("target"), "ord")

    def call_target(self) -> DataFrame:
        """The first target of each call."""
        return self.call_targets().groupBy("call").agg(F.min(F.struct("ord", "target")).alias("_m")).select("call", F.col("_m.target").alias("target"))

    # changes
    def without_files(self, file_ids: DataFrame) -> Graph:
        """All but the nodes of files, and no edge of such a node."""
        gone = self.nodes.join(file_ids.select("file_id"), "file_id", "left_semi").select("id")
        edges = self.edges
        for end in ("src", "dst"):
            edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
        files = None if self.files is None else self.files.join(file_ids, "file_id", "left_anti")
        return replace(self, nodes=self.nodes.join(file_ids.select("file_id"), "file_id", "left_anti"), edges=edges.select(*EDGES.names), files=files)

    def absorb(self, other: Graph, offset: int = 0) -> Graph:
        """Both graphs; the other's ids move by offset, those of files too. Ids by hash of a path, as the frontends give them, need none."""
        moved = lambda df, *columns: df.withColumns({c: F.col(c) + offset for c in columns}) if offset else df
        nodes, edges = moved(other.nodes, "id", "method_id", "file_id"), moved(other.edges, "src", "dst")
        more = None if other.files is None else moved(other.files, "file_id")
        files = self.files if more is None else more if self.files is None else self.files.unionByName(more)
        return replace(self, nodes=self.nodes.unionByName(nodes), edges=self.edges.unionByName(edges), files=files, authoritative=self.authoritative | other.authoritative)

    def with_edges(self, *more: DataFrame) -> Graph:
        edges = self.edges
        for m in more:
            edges = edges.unionByName(shaped(m, EDGES))
        return replace(self, edges=edges)

    def without_edges(self, *kinds: str) -> Graph:
        return replace(self, edges=self.edges.where(~F.col("kind").isin(*kinds)))

    # storage
    def save(self, path: str) -> None:
        """Parquet, partitioned by kind, so that scans of a kind read its files alone."""
        self.nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/edges")
        spark = self.nodes.sparkSession
        files = self.files if self.files is not None else spark.createDataFrame([], FILES)
        files.write.mode("overwrite").parquet(f"{path}/files")
        spark.createDataFrame([(FORMAT, x, x in self.authoritative) for x in LAYERS], "format int, layer string, authoritative boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/layers")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Graph:
        layers = spark.read.parquet(f"{path}/layers").collect()
        if any(r["format"] > FORMAT for r in layers):
            raise ValueError("the graph was saved in a newer format")
        nodes, edges = (spark.read.schema(s).parquet(f"{path}/{n}").select(*s.names) for n, s in (("nodes", NODES), ("edges", EDGES)))
        return Graph(nodes, edges, spark.read.parquet(f"{path}/files"), frozenset(r["layer"] for r in layers if r["authoritative"]))


def is_analysis_method(name: Column) -> Column:
    return (name != "<global>") & ~name.startswith("<operator>")


def frozen(graph: Graph, kind: str) -> DataFrame:
    """Out-edges of one kind as arrays (id, targets), in edge order: the compact form that grouped kernels take."""
    return graph.e(kind).groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("ord", "dst"))).alias("_t")).select("id", F.transform("_t", lambda x: x["dst"]).alias("targets"))
