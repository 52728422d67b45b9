"""The driver's relational tables as a property graph (FIXTURES.md, part B)."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoweft.plans.graph import Graph

# Entity kinds and the id spaces of entities and edges.
KINDS = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "orders": 6, "embeddings": 7, "documents": 8}
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "embeddings": "vec_id", "documents": "doc_id"}
KIND_BASE, EDGE_BASE = 10**9, 10**17


def _long(c):
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def eid(kind: str, key):
    return F.lit(KINDS[kind] * KIND_BASE).cast("long") + _long(key)


def _all(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# Schemas of the driver's tables; stating them saves a job per table.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
}


def _edge(label, suffix, source, target, df):
    return df.select(
        (F.lit(label * EDGE_BASE).cast("long") + _long(suffix)).alias("id"), source.alias("source"), target.alias("target"), F.lit(label).alias("label")
    )


def _position(kind, x, y, df):
    return df.select(eid(kind, KEYS[kind]).alias("entity_id"), x.cast("float").alias("x"), y.cast("float").alias("y"))


def _scatter(key):
    return (_long(key) * F.lit(7919).cast("long") % F.lit(20001).cast("long")) / F.lit(10000.0) - F.lit(1.0)


def _prop(kind, key, tag, value, df):
    v = {k: F.lit(None).cast(t) for k, t in (("value_int", "long"), ("value_float", "double"), ("value_text", "string"))}
    name = {2: "value_float", 3: "value_text"}.get(tag, "value_int")
    v[name] = value.cast({"value_int": "long", "value_float": "double", "value_text": "string"}[name])
    return df.select(eid(kind, KEYS[kind]).alias("entity_id"), F.lit(key).alias("key"), F.lit(tag).alias("value_type"), *[c.alias(k) for k, c in v.items()])


class TableGraph(Graph):
    """Each table is planned only when a request needs it. No key dangles in these tables,
    so edges and positions count as resolved."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def entities(self) -> DataFrame:
        return _all([self.table(k).select(eid(k, KEYS[k]).alias("id")) for k in KINDS])

    @cached_property
    def edges(self) -> DataFrame:
        t, li, ten = self.table, self.table("lineitem"), lambda n: F.lit(10**n).cast("long")
        keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
        order, line, part, supp = map(_long, keys)
        w = Window.partitionBy(*keys).orderBy("l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
        suffix5 = (((order * ten(1) + line) * ten(5) + part) * ten(4) + supp) * ten(1) + F.row_number().over(w).cast("long") - F.lit(1).cast("long")
        pairs = li.select("l_partkey", "l_suppkey").distinct()
        return _all([
            _edge(1, "n_nationkey", eid("region", "n_regionkey"), eid("nation", "n_nationkey"), t("nation")),
            _edge(2, "c_custkey", eid("nation", "c_nationkey"), eid("customer", "c_custkey"), t("customer")),
            _edge(3, "s_suppkey", eid("nation", "s_nationkey"), eid("supplier", "s_suppkey"), t("supplier")),
            _edge(4, "o_orderkey", eid("customer", "o_custkey"), eid("orders", "o_orderkey"), t("orders")),
            _edge(5, suffix5, eid("orders", "l_orderkey"), eid("part", "l_partkey"), li),
            _edge(6, _long("l_partkey") * ten(4) + _long("l_suppkey"), eid("part", "l_partkey"), eid("supplier", "l_suppkey"), pairs),
        ])

    @property
    def raw_edges(self) -> DataFrame:
        return self.edges

    @cached_property
    def positions(self) -> DataFrame:
        t = self.table
        return _all([
            _position("customer", F.col("c_acctbal") / F.lit(10000.0), _scatter("c_custkey"), t("customer")),
            _position("orders", F.col("o_totalprice") / F.lit(250000.0) - F.lit(1.0), _scatter("o_orderkey"), t("orders")),
            _position("embeddings", F.col("embedding")[0], F.col("embedding")[1], t("embeddings")),
        ])

    @cached_property
    def properties(self) -> DataFrame:
        t, c = self.table, F.col
        return _all([
            _prop("part", "size", 1, c("p_size"), t("part")),
            _prop("embeddings", "label", 1, c("label"), t("embeddings")),
            _prop("documents", "n_chars", 1, c("n_chars"), t("documents")),
            _prop("documents", "quality", 1, c("quality"), t("labels")),
            _prop("customer", "acctbal", 2, c("c_acctbal"), t("customer")),
            _prop("orders", "totalprice", 2, c("o_totalprice"), t("orders")),
            _prop("customer", "mktsegment", 3, c("c_mktsegment"), t("customer")),
            _prop("orders", "orderpriority", 3, c("o_orderpriority"), t("orders")),
            _prop("part", "brand", 3, c("p_brand"), t("part")),
            _prop("documents", "lang", 3, c("lang"), t("documents")),
            _prop("documents", "toxic", 4, c("toxic"), t("labels")),
            _prop("documents", "body", 5, _text_hash(), t("documents")),
        ])

    @cached_property
    def blobs(self) -> DataFrame:
        return self.table("documents").select(
            eid("documents", "doc_id").alias("entity_id"), F.lit("body").alias("key"), _text_hash().alias("hash"), F.lit("text/plain").alias("mime"),
            F.octet_length("text").cast("long").alias("size_bytes"), F.col("text").cast("binary").alias("data"),
        )


def _text_hash():
    return F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long")


def graph(spark: SparkSession, sf_dir: str) -> TableGraph:
    return TableGraph(spark, sf_dir)
