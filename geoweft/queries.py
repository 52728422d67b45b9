"""The engine's registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

import math
import uuid
from functools import reduce
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions import scalar as S
from geoweft.operators import blobs as B
from geoweft.operators import edges as E
from geoweft.operators import lookup, spatial, stats, tiles
from geoweft.plans.graph import Graph
from geoweft.plans.lineage import shared_dir
from geoweft.schema import TABLES
from geoweft.sources import mapping, sinks, sqlite, synthetic
from geoweft.streaming import messages

REGION0, NATION3, CUSTOMER7 = 1_000_000_000, 2_000_000_003, 3_000_000_007
VIEWPORTS = {"full": (-1, -1, 1, 1), "mid": (-0.5, -0.5, 0.5, 0.5), "small": (-0.25, -0.25, 0.25, 0.25), "ll": (-1, -1, 0, 0), "ur": (0, 0, 1, 1)}
SMALL_CHUNK = 512

Q: dict = {}
SQL: dict[str, str] = {}

_ENTITY = "entity AS (" + " UNION ALL ".join(f"SELECT ({k} * 1000000000::BIGINT + {mapping.KEYS[t]})::BIGINT AS id FROM {t}" for t, k in mapping.KINDS.items()) + ")"
_LI5 = """SELECT (500000000000000000::BIGINT + (((l_orderkey::BIGINT*10 + l_linenumber)*100000 + l_partkey)*10000 + l_suppkey)*10 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1)::BIGINT, 6000000000 + l_orderkey, 5000000000 + l_partkey, 5 FROM lineitem"""
_EDGE = f"""edge(id, source, target, label) AS (
 SELECT 100000000000000000::BIGINT + n_nationkey, 1000000000::BIGINT + n_regionkey, 2000000000::BIGINT + n_nationkey, 1 FROM nation
 UNION ALL SELECT 200000000000000000::BIGINT + c_custkey, 2000000000::BIGINT + c_nationkey, 3000000000 + c_custkey, 2 FROM customer
 UNION ALL SELECT 300000000000000000::BIGINT + s_suppkey, 2000000000::BIGINT + s_nationkey, 4000000000 + s_suppkey, 3 FROM supplier
 UNION ALL SELECT 400000000000000000::BIGINT + o_orderkey, 3000000000 + o_custkey, 6000000000 + o_orderkey, 4 FROM orders
 UNION ALL {_LI5}
 UNION ALL SELECT DISTINCT 600000000000000000::BIGINT + l_partkey*10000 + l_suppkey, 5000000000 + l_partkey, 4000000000 + l_suppkey, 6 FROM lineitem)"""
_POS = """pos AS (
 SELECT 3000000000 + c_custkey AS entity_id, (c_acctbal / 10000::DOUBLE)::FLOAT AS x, (((c_custkey*7919) % 20001) / 10000::DOUBLE - 1::DOUBLE)::FLOAT AS y FROM customer
 UNION ALL SELECT 6000000000 + o_orderkey, (o_totalprice / 250000::DOUBLE - 1::DOUBLE)::FLOAT, (((o_orderkey*7919) % 20001) / 10000::DOUBLE - 1::DOUBLE)::FLOAT FROM orders
 UNION ALL SELECT 7000000000 + vec_id, embedding[1]::FLOAT, embedding[2]::FLOAT FROM embeddings)"""
_GRID = f"""{_ENTITY}, {_POS}, b AS (SELECT greatest(4, least(8, round(log2(count(*)) / 2)))::INT AS bits FROM entity),
 cells AS (SELECT p.*, greatest(0, least(pow(2, bits) - 1, floor((x + 1::FLOAT)::DOUBLE / 2 * pow(2, bits))))::INT AS gx, greatest(0, least(pow(2, bits) - 1, floor((y + 1::FLOAT)::DOUBLE / 2 * pow(2, bits))))::INT AS gy FROM pos p, b)"""
_HASH = "('0x' || substr(md5(text), 1, 15))::BIGINT"
_PROP = f"""prop(entity_id, key, value_type, value_int, value_float, value_text) AS (
 SELECT 5000000000 + p_partkey, 'size', 1, p_size::BIGINT, NULL::DOUBLE, NULL::VARCHAR FROM part
 UNION ALL SELECT 7000000000 + vec_id, 'label', 1, label::BIGINT, NULL, NULL FROM embeddings
 UNION ALL SELECT 8000000000 + doc_id, 'n_chars', 1, n_chars, NULL, NULL FROM documents
 UNION ALL SELECT 8000000000 + doc_id, 'quality', 1, quality::BIGINT, NULL, NULL FROM labels
 UNION ALL SELECT 3000000000 + c_custkey, 'acctbal', 2, NULL, c_acctbal, NULL FROM customer
 UNION ALL SELECT 6000000000 + o_orderkey, 'totalprice', 2, NULL, o_totalprice, NULL FROM orders
 UNION ALL SELECT 3000000000 + c_custkey, 'mktsegment', 3, NULL, NULL, c_mktsegment FROM customer
 UNION ALL SELECT 6000000000 + o_orderkey, 'orderpriority', 3, NULL, NULL, o_orderpriority FROM orders
 UNION ALL SELECT 5000000000 + p_partkey, 'brand', 3, NULL, NULL, p_brand FROM part
 UNION ALL SELECT 8000000000 + doc_id, 'lang', 3, NULL, NULL, lang FROM documents
 UNION ALL SELECT 8000000000 + doc_id, 'toxic', 4, toxic::BIGINT, NULL, NULL FROM labels
 UNION ALL SELECT 8000000000 + doc_id, 'body', 5, {_HASH}, NULL, NULL FROM documents)"""


def _add(name: str, sql: str | None = None):
    def put(f):
        Q[name] = lambda spark, sf_dir: f(mapping.graph(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return put


def _requests(g: Graph, rows, schema) -> DataFrame:
    return g.spark.createDataFrame(rows, schema)


_add("graph_stats", f"WITH {_ENTITY}, {_EDGE} SELECT (SELECT count(*) FROM entity) AS entities, (SELECT count(*) FROM edge) AS edges, (SELECT count(*) FROM documents) AS blobs, (SELECT coalesce(sum(strlen(text)), 0)::BIGINT FROM documents) AS blob_bytes")(lambda g: g.stats())
_add("entity_scan", f"WITH {_ENTITY} SELECT id FROM entity")(lambda g: g.entities)


@_add("edge_scan_resolved", f"WITH {_ENTITY}, {_EDGE} SELECT id, source, target, label & 65535 AS label FROM edge WHERE source IN (SELECT id FROM entity) AND target IN (SELECT id FROM entity)")
def _(g: Graph) -> DataFrame:
    return Graph(g.entities, g.raw_edges, g.positions, g.properties, g.blobs).edges


_add("edge_page", f"WITH {_EDGE} SELECT * FROM edge ORDER BY id LIMIT 50 OFFSET 1000")(lambda g: g.edge_page(1000, 50))
for _end, _name in (("source", "out_degree"), ("target", "in_degree")):
    _add(_name, f"WITH {_EDGE} SELECT {_end} AS id, count(*) AS degree FROM edge GROUP BY 1")(lambda g, end=_end: E.degrees(g.edges, end))


@_add("get_entity_properties", f"WITH {_PROP} SELECT entity_id AS id, key, value_type AS type, CASE WHEN value_type IN (1, 5) THEN value_int END AS int, CASE WHEN value_type = 2 THEN value_float END AS float, CASE WHEN value_type = 3 THEN value_text END AS text, CASE WHEN value_type = 4 THEN value_int <> 0 END AS bool FROM prop WHERE entity_id IN (3000000007, 5000000003, 8000000011)")
def _(g: Graph) -> DataFrame:
    e = g.get_entities(g._ids(CUSTOMER7, 5_000_000_003, 8_000_000_011, 42), properties=True)
    v = e.select("id", F.explode("properties").alias("p")).select("id", "p.key", "p.value")
    return v.select("id", "key", F.col("value.type").cast("int").alias("type"), F.coalesce("value.int", "value.blob.hash").alias("int"), "value.float", "value.text", "value.bool")


@_add("get_entity_blob_refs", f"SELECT 8000000000 + doc_id AS id, 'body' AS key, {_HASH} AS hash, strlen(text)::BIGINT AS size FROM documents WHERE doc_id IN (0, 5, 11)")
def _(g: Graph) -> DataFrame:
    e = g.get_entities(g._ids(8_000_000_000, 8_000_000_005, 8_000_000_011), blobs=True)
    return e.select("id", F.explode("blob_refs").alias("b")).select("id", "b.key", "b.hash", "b.size")


@_add("decode_value", f"WITH {_PROP} SELECT entity_id, key, value_type AS type, CASE WHEN value_type = 1 THEN coalesce(value_int, 0) END AS int, CASE WHEN value_type = 2 THEN coalesce(value_float, 0) END AS float, CASE WHEN value_type = 3 THEN coalesce(value_text, '') END AS text, CASE WHEN value_type = 4 THEN coalesce(value_int <> 0, false) END AS bool, CASE WHEN value_type = 5 THEN value_int END AS blob_hash FROM prop")
def _(g: Graph) -> DataFrame:
    v = lookup.decoded_properties(g.properties)
    return v.select("entity_id", "key", F.col("value.type").cast("int").alias("type"), "value.int", "value.float", "value.text", "value.bool", F.col("value.blob.hash").alias("blob_hash"))


_OUT = "SELECT id, source, target, label FROM edge WHERE source = {0}"
_IN = "SELECT id, source, target, label FROM edge WHERE target = {0}"
_add("edges_outgoing", f"WITH {_EDGE} {_OUT.format(NATION3)}")(lambda g: g.get_edges(NATION3, "outgoing"))
_add("edges_incoming", f"WITH {_EDGE} {_IN.format(5_000_000_003)}")(lambda g: g.get_edges(5_000_000_003, "incoming"))
_add("edges_both", f"WITH {_EDGE} {_OUT.format(5_000_000_003)} UNION ALL {_IN.format(5_000_000_003)}")(lambda g: g.get_edges(5_000_000_003, "both"))
_add("edges_label_filtered", f"WITH {_EDGE} {_OUT.format(NATION3)} AND label IN (3)")(lambda g: g.get_edges(NATION3, "outgoing", [3]))
_REQ = [(1, NATION3, "outgoing", [3], 40), (2, 5_000_000_003, "both", [6], 25), (3, CUSTOMER7, "both", [], 3), (4, NATION3, "both", [2, 1], 30), (5, 5_000_000_001, "incoming", [5], 0)]
_REQ_SQL = ", ".join(f"({r}, {e}::BIGINT, '{d}', {lb}::INT[], {n})" for r, e, d, lb, n in _REQ)


def _limited_sql(before: str, after: str) -> str:
    return f"""WITH {_EDGE}, req(request_id, entity_id, direction, labels, lim) AS (VALUES {_REQ_SQL}),
 o AS (SELECT request_id, 0 AS side, row_number() OVER (PARTITION BY request_id ORDER BY target, id) AS rn, id, source, target, label, labels, lim FROM edge JOIN req ON source = entity_id WHERE direction IN ('outgoing', 'both') AND {before}),
 ok AS (SELECT * FROM o WHERE rn <= lim AND {after}), used AS (SELECT request_id, count(*) AS u FROM ok GROUP BY 1),
 i AS (SELECT request_id, 1 AS side, row_number() OVER (PARTITION BY request_id ORDER BY source, id) AS rn, id, source, target, label, labels, lim FROM edge JOIN req ON target = entity_id WHERE direction IN ('incoming', 'both') AND {before}),
 ik AS (SELECT i.* FROM i LEFT JOIN used USING (request_id) WHERE rn <= lim - coalesce(u, 0) AND {after})
 SELECT request_id::BIGINT AS request_id, side, rn::BIGINT AS rn, id, source, target, label FROM (SELECT * FROM ok UNION ALL SELECT * FROM ik)"""


_PASS = "(len(labels) = 0 OR list_contains(labels, label))"
for _mode, _sql in (("scanned", _limited_sql("true", _PASS)), ("matched", _limited_sql(_PASS, "true"))):
    _add(f"edges_limit_{_mode}", _sql)(lambda g, m=_mode: g.get_edges_batch(_requests(g, _REQ, "request_id long, entity_id long, direction string, labels array<int>, limit int"), m))


def _bfs_sql(starts: str, depth: int, labels: str = "true", tail: str = "SELECT id, depth FROM best") -> str:
    return f"""WITH RECURSIVE {_ENTITY}, {_EDGE}, e AS (SELECT source, target FROM edge WHERE {labels}),
 walk(request_id, id, depth, path) AS (SELECT request_id::BIGINT, id, 0, [id] FROM (VALUES {starts}) s(request_id, start_id) JOIN entity ON id = start_id
 UNION ALL SELECT request_id, target, depth + 1, list_append(path, target) FROM walk JOIN e ON e.source = walk.id WHERE depth < {depth}),
 best AS (SELECT request_id, id, min(depth) AS depth, min({{'d': depth, 'p': path}}) AS k FROM walk GROUP BY 1, 2) {tail}"""


_START = f"(0, {REGION0}::BIGINT)"
_add("bfs_depth1", _bfs_sql(_START, 1))(lambda g: g.traverse(REGION0, 1))
_add("bfs_depth2", _bfs_sql(_START, 2))(lambda g: g.traverse(REGION0, 2))
_add("bfs_depth3_labels", _bfs_sql(_START, 3, "label IN (1, 2, 4)"))(lambda g: g.traverse(REGION0, 3, [1, 2, 4]))
_add("bfs_limit", _bfs_sql(_START, 2, "true", "SELECT id, depth, (row_number() OVER (ORDER BY k))::INT AS ord FROM best QUALIFY ord <= 40"))(lambda g: g.traverse(REGION0, 2, limit=40))
_add("bfs_unknown_start", _bfs_sql("(0, 999::BIGINT)", 2))(lambda g: g.traverse(999, 2))
_STARTS = [(1, REGION0), (2, NATION3), (3, CUSTOMER7), (4, 6_000_000_010), (5, 999)]
_add("bfs_batch", _bfs_sql(", ".join(f"({r}, {s}::BIGINT)" for r, s in _STARTS), 2, "true", "SELECT request_id, id, depth FROM best"))(lambda g: g.traverse_batch(_requests(g, _STARTS, "request_id long, start_id long"), 2))
_add("var_length_path_1_2", _bfs_sql(f"(0, {NATION3}::BIGINT)", 2, "true", "SELECT DISTINCT id FROM walk WHERE depth > 0"))(lambda g: g.traverse(NATION3, 2, min_depth=1).select("id"))
_BATCHES = "SELECT id, ((row_number() OVER (ORDER BY k) - 1) // 64)::INT AS batch FROM best"
_add("bfs_response_batches", _bfs_sql(_START, 2, "true", _BATCHES))(lambda g: g.traverse(REGION0, 2, ordered=True).select("id", F.floor((F.col("ord") - 1) / 64).cast("int").alias("batch")))

_add("world_to_tile", f"WITH {_GRID} SELECT entity_id, gx, gy FROM cells")(lambda g: g.cells.select("entity_id", "gx", "gy"))
_add("grid_cell_counts", f"WITH {_GRID} SELECT gx, gy, count(*) AS n FROM cells GROUP BY 1, 2")(lambda g: spatial.grid_cell_counts(g.cells))
_add("grid_offsets", f"WITH {_GRID}, c AS (SELECT gx, gy, count(*) AS n FROM cells GROUP BY 1, 2) SELECT gx, gy, n, coalesce(sum(n) OVER (ORDER BY gy, gx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM c")(lambda g: spatial.grid_offsets(g.cells))
_add("grid_metadata", f"WITH {_GRID} SELECT bits, (1 << bits)::INT AS grid_size, (SELECT count(*) FROM pos) AS len FROM b")(lambda g: g.positions.agg(F.count("*").alias("len")).select(F.lit(g.bits).alias("bits"), F.lit(1 << g.bits).alias("grid_size"), "len"))
_add("cell_get", f"WITH {_GRID} SELECT entity_id FROM cells , b WHERE gx = (1 << bits) // 2 AND gy = (1 << bits) // 2")(lambda g: spatial.cell(g.cells, 1 << (g.bits - 1), 1 << (g.bits - 1)).select("entity_id"))
for _name, _b in VIEWPORTS.items():
    _add(f"spatial_{_name}", f"WITH {_POS} SELECT entity_id AS id FROM pos WHERE x >= {_b[0]}::FLOAT AND x <= {_b[2]}::FLOAT AND y >= {_b[1]}::FLOAT AND y <= {_b[3]}::FLOAT")(lambda g, b=_b: g.search_spatial(*b))
_add("spatial_limit_lod", f"WITH {_GRID} SELECT entity_id AS id FROM cells ORDER BY gy >> 1, gx >> 1, gy, gx, entity_id LIMIT 100")(lambda g: g.search_spatial(-1, -1, 1, 1, limit=100))
_add("spatial_limit_full_lod", f"WITH {_GRID} SELECT entity_id AS id FROM cells WHERE x BETWEEN -0.25::FLOAT AND 0.25::FLOAT AND y BETWEEN -0.25::FLOAT AND 0.25::FLOAT ORDER BY gy, gx, entity_id LIMIT 100")(lambda g: g.search_spatial(-0.25, -0.25, 0.25, 0.25, limit=100))
_add("spatial_bounds_coarse", f"WITH {_GRID} SELECT entity_id FROM cells, b WHERE (gx >> (bits - 4)) BETWEEN 4 AND 11 AND (gy >> (bits - 4)) BETWEEN 6 AND 9")(lambda g: spatial.coarse_bounds(g.cells, (-0.5, -0.25, 0.4, 0.2), g.bits, 4).select("entity_id"))
_RECTS = [(i, *map(float, b)) for i, b in enumerate(VIEWPORTS.values())] + [(9, 0.5, 0.5, 0.1, 0.9)]
_add("spatial_batch", f"WITH {_POS}, r(request_id, a, b, c, d) AS (VALUES {', '.join(f'({i}::BIGINT, {a}::FLOAT, {b}::FLOAT, {c}::FLOAT, {d}::FLOAT)' for i, a, b, c, d in _RECTS)}) SELECT request_id, entity_id FROM pos JOIN r ON x >= a AND x <= c AND y >= b AND y <= d")(lambda g: g.search_spatial_batch(_requests(g, _RECTS, "request_id long, min_x double, min_y double, max_x double, max_y double")))
_add("tile_range", "SELECT 1 AS min_tx, 3 AS min_ty, 6 AS max_tx, 7 AS max_ty, 3 AS center_tx, 5 AS center_ty")(lambda g: _requests(g, [tuple(spatial.tile_range(-0.6, -0.2, 0.7, 0.8, 3).values())], "min_tx int, min_ty int, max_tx int, max_ty int, center_tx int, center_ty int"))
_add("tile_distance_topk", f"WITH {_GRID}, r AS (SELECT greatest(0, least(pow(2, bits) - 1, floor(0.5::DOUBLE / 2 * pow(2, bits))))::INT AS lo, greatest(0, least(pow(2, bits) - 1, floor(1.5::DOUBLE / 2 * pow(2, bits))))::INT AS hi FROM b), t AS (SELECT gx, gy, count(*) AS n, any_value((lo + hi) // 2) AS c FROM cells, r WHERE gx BETWEEN lo AND hi AND gy BETWEEN lo AND hi GROUP BY 1, 2) SELECT gx, gy, n, ((gx - c) * (gx - c) + (gy - c) * (gy - c))::BIGINT AS distance FROM t ORDER BY distance, gy, gx LIMIT 20")(lambda g: spatial.nearest_tiles(g.cells, (-0.5, -0.5, 0.5, 0.5), g.bits, 20))
_IDS = [CUSTOMER7, 6_000_000_001, 7_000_000_009, 8_000_000_001, 5]
_add("position_multiget", f"WITH {_POS} SELECT entity_id, x, y FROM pos WHERE entity_id IN ({', '.join(map(str, _IDS))})")(lambda g: g.positions_of(g._ids(*_IDS)))

_add("property_key_search", f"WITH {_PROP} SELECT DISTINCT entity_id AS id FROM prop WHERE key = 'mktsegment'")(lambda g: g.search_property_key("mktsegment"))
_add("property_key_limit", f"WITH {_PROP} SELECT DISTINCT entity_id AS id FROM prop WHERE key = 'size' ORDER BY 1 LIMIT 100")(lambda g: g.search_property_key("size", 100))
_add("property_eq_search", f"WITH {_PROP} SELECT DISTINCT entity_id AS id FROM prop WHERE key = 'lang' AND value_text = 'fr'")(lambda g: g.search_property_eq("lang", "fr"))
_add("property_range_search", f"WITH {_PROP} SELECT DISTINCT entity_id AS id FROM prop WHERE key = 'acctbal' AND value_float BETWEEN 100 AND 2500.5")(lambda g: g.search_property_range("acctbal", 100, 2500.5))

_DOC3 = "(SELECT " + _HASH + " FROM documents WHERE doc_id = 3)"


def _hash_of(g: Graph, entity_id: int) -> int:
    return g.blobs.where(F.col("entity_id") == entity_id).select("hash").first()[0]


_add("blob_by_hash", f"SELECT 8000000000 + min(doc_id) AS entity_id, 'text/plain' AS mime, strlen(any_value(text))::BIGINT AS size_bytes, {_DOC3} AS hash FROM documents WHERE {_HASH} = {_DOC3}")(lambda g: g.get_blob(_hash_of(g, 8_000_000_003)).select("entity_id", "mime", "size_bytes", "hash"))
_add("blob_chunks", f"SELECT {_HASH} AS hash, off.o AS \"offset\", strlen(text)::BIGINT AS total_size, substr(hex(encode(text)), (2 * off.o + 1)::BIGINT, {2 * SMALL_CHUNK}) AS data FROM (SELECT DISTINCT text FROM documents), unnest(range(0, strlen(text)::BIGINT, {SMALL_CHUNK})) off(o)")(lambda g: B.chunks(B.distinct_blobs(g.blobs, "size_bytes", "data"), 0, SMALL_CHUNK).withColumn("data", F.hex("data")))
_add("blob_byte_range", f"SELECT {_DOC3} AS hash, substr(hex(encode(text)), 201, 128) AS data FROM documents WHERE doc_id = 3")(lambda g: B.byte_range(g.blobs, _hash_of(g, 8_000_000_003), 100, 64).withColumn("data", F.hex("data")))

_add("codec_contains", "SELECT c::INT AS codecs, w::INT AS wanted, (c & w) <> 0 AS contains FROM range(0, 8) t(c), range(1, 8) u(w)")(lambda g: g.spark.range(56).select((F.col("id") % 8).cast("int").alias("codecs"), (F.floor(F.col("id") / 8) + 1).cast("int").alias("wanted")).withColumn("contains", S.codec_contains("codecs", F.col("wanted"))))


# The storage byte is the signed top of the long; the parts share no bits, so they add up.
@_add("pointer_pack_unpack", "SELECT e.event_id AS \"index\", (event_id % 65536)::BIGINT AS epoch, (event_id % 256)::BIGINT AS storage, (event_id + (event_id % 65536) * 1099511627776 + (CASE WHEN event_id % 256 < 128 THEN event_id % 256 ELSE event_id % 256 - 256 END) * 72057594037927936)::BIGINT AS packed FROM events e")
def _(g: Graph) -> DataFrame:
    p = g.spark.read.parquet(f"{g.sf_dir}/events.parquet").select(S.pack_pointer("event_id", F.col("event_id") % 65536, F.col("event_id") % 256).alias("packed"))
    u = S.unpack_pointer("packed")
    return p.select(*[u[k].alias(k) for k in ("index", "epoch", "storage")], "packed")


def _samples(g: Graph) -> DataFrame:
    return g.spark.read.parquet(f"{g.sf_dir}/events.parquet").select(F.col("event_type").alias("label"), F.col("value").alias("ns"), (F.col("user_id") % 2).alias("system"))


_PCT = "list_sort(list(value))[(round(p * (count(*) - 1)))::INT + 1]"
_STATS = "avg(value) AS mean_ns, min(value) AS min_ns, max(value) AS max_ns, coalesce(stddev_samp(value), 0) AS stddev_ns, count(*) AS sample_count, " + ", ".join(f"{_PCT.replace('p *', f'{p} *')} AS {k}" for k, p in (("p50_ns", 0.5), ("p95_ns", 0.95), ("p99_ns", 0.99), ("median_ns", 0.5)))
_ROUND = ["mean_ns", "stddev_ns"]


def _rounded(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.round(c, 4).alias(c) if c in cols else c for c in df.columns])


def _round_sql(sql: str, cols, every) -> str:
    return "SELECT " + ", ".join(f"round({c}, 4) AS {c}" if c in cols else c for c in every) + f" FROM ({sql})"


_LAT = ["label", "mean_ns", "min_ns", "max_ns", "stddev_ns", "sample_count", "p50_ns", "p95_ns", "p99_ns", "median_ns"]
_add("latency_stats", _round_sql(f"SELECT event_type AS label, {_STATS} FROM events GROUP BY 1", _ROUND, _LAT))(lambda g: _rounded(stats.latency_stats(_samples(g), ["label"]), _ROUND))
_BY = f"SELECT user_id % 2 AS system, CASE WHEN event_type < 'm' THEN 'entity_get_' || event_type ELSE 'bfs_' || event_type END AS label, {_STATS} FROM events GROUP BY 1, 2"
_OPK = "CASE WHEN starts_with(label, 'entity_get') THEN 'entity_get' ELSE 'bfs_depth2' END"


def _labelled(g: Graph) -> DataFrame:
    s = _samples(g).withColumn("label", F.concat(F.when(F.col("label") < "m", "entity_get_").otherwise("bfs_"), "label"))
    return stats.latency_stats(s, ["system", "label"])


_OPS = ["op_key", "mean_ns", "p95_ns", "p99_ns", "sample_count"]
_add("latency_by_op", _round_sql(f"SELECT {_OPK} AS op_key, avg(mean_ns) AS mean_ns, avg(p95_ns) AS p95_ns, avg(p99_ns) AS p99_ns, count(*) AS sample_count FROM ({_BY}) GROUP BY 1", _OPS[1:4], _OPS))(lambda g: _rounded(stats.by_operation(_labelled(g)), _OPS[1:4]))
_CMP = ["op_key", "own_ns", "other_ns", "speedup"]
_add("system_comparison", _round_sql(f"WITH s AS (SELECT system, {_OPK} AS op_key, avg(mean_ns) AS m FROM ({_BY}) GROUP BY 1, 2) SELECT a.op_key, a.m AS own_ns, b.m AS other_ns, b.m / greatest(a.m, 1.0) AS speedup FROM s a LEFT JOIN s b ON a.op_key = b.op_key AND b.system = 1 WHERE a.system = 0", _CMP[1:], _CMP))(lambda g: _rounded(stats.compare(_labelled(g).where("system = 0"), _labelled(g).where("system = 1")), _CMP[1:]))


@_add("tile_codec_roundtrip", f"WITH {_GRID} SELECT gx AS tx, gy AS ty, 1 AS layer, 1 AS codec, least(count(*), 65535)::INT AS node_count, 0 AS edge_count, md5(string_agg(entity_id::VARCHAR, ',' ORDER BY entity_id)) AS payload FROM cells GROUP BY gx, gy")
def _(g: Graph) -> DataFrame:
    c = g.cells.groupBy(F.col("gx").alias("tx"), F.col("gy").alias("ty")).agg(F.count("*").cast("int").alias("node_count"), F.array_join(F.sort_array(F.collect_list("entity_id")).cast("array<string>"), ",").alias("p"))
    t = c.select(F.lit(7).cast("long").alias("request_id"), F.lit(g.bits).alias("lod"), "tx", "ty", F.lit(1).alias("layer"), F.lit(1).alias("codec"), "node_count", F.lit(0).alias("edge_count"), F.md5("p").cast("binary").alias("payload"))
    return tiles.decode(tiles.encode(t)).select("tx", "ty", "layer", "codec", "node_count", "edge_count", F.col("payload").cast("string").alias("payload"))


# Dangling copies of every edge and position beside the real ones: none of them may stay.
_FAR = 10**15


def _dangling(g: Graph) -> Graph:
    far = lambda c: (F.col(c) + F.lit(_FAR)).alias(c)
    e = g.raw_edges.unionByName(g.raw_edges.select("id", far("source"), "target", "label")).unionByName(g.raw_edges.select("id", "source", far("target"), "label"))
    return Graph(g.entities, e, g.positions.unionByName(g.positions.select(far("entity_id"), "x", "y")), g.properties, g.blobs)


_add("dangling_edges_dropped", f"WITH {_EDGE} SELECT id, source, target, label FROM edge")(lambda g: _dangling(g).edges)
_add("dangling_positions_dropped", f"WITH {_POS} SELECT entity_id, x, y FROM pos")(lambda g: _dangling(g).positions)
_add("adjacency", f"WITH {_EDGE} SELECT id, source, target, label FROM edge")(lambda g: E.adjacency(g.edges, "target"))
_add("bfs_depth4", _bfs_sql(_START, 4, "label IN (1, 2, 4, 5)"))(lambda g: g.traverse(REGION0, 4, [1, 2, 4, 5]))
_add("bfs_ordered", _bfs_sql(_START, 2, "true", "SELECT id, depth, (row_number() OVER (ORDER BY k))::INT AS ord FROM best"))(lambda g: g.traverse(REGION0, 2, ordered=True))
_add("edges_batch_unlimited", f"WITH {_EDGE}, req(request_id, entity_id, direction, labels) AS (VALUES {', '.join(f'({r}, {e}::BIGINT, {d!r}, {lb}::INT[])' for r, e, d, lb, _ in _REQ)}) SELECT request_id::BIGINT AS request_id, side, id, source, target, label FROM (SELECT request_id, 0 AS side, edge.*, labels FROM edge JOIN req ON source = entity_id WHERE direction IN ('outgoing', 'both') UNION ALL SELECT request_id, 1, edge.*, labels FROM edge JOIN req ON target = entity_id WHERE direction IN ('incoming', 'both')) WHERE {_PASS}")(lambda g: g.get_edges_batch(_requests(g, [(*r[:4], None) for r in _REQ], "request_id long, entity_id long, direction string, labels array<int>, limit int")).drop("rn"))
_add("position_get", f"WITH {_POS} SELECT entity_id, x, y FROM pos WHERE entity_id = {CUSTOMER7}")(lambda g: g.position(CUSTOMER7))
_add("known_entities", f"WITH {_ENTITY} SELECT i AS id, i IN (SELECT id FROM entity) AS known FROM (VALUES {', '.join(f'({i}::BIGINT)' for i in _IDS)}) t(i)")(lambda g: lookup.known(g.entities, g._ids(*_IDS)))
_COUNTS = f"WITH {_ENTITY}, {_EDGE} SELECT %s(SELECT count(*) FROM entity) AS entities, (SELECT count(*) FROM edge) AS edges, %s(SELECT coalesce(sum(strlen(text)), 0)::BIGINT FROM documents) AS blob_bytes%s"
_add("hello", _COUNTS % ("", "", ", 7 AS supported_codecs"))(lambda g: g.hello())
_add("health", _COUNTS % ("true AS ok, ", "(SELECT count(*) FROM documents) AS blobs, ", ""))(lambda g: g.health())
_add("blob_last_chunk", f"SELECT {_HASH} AS hash, ((strlen(text) - 1) // {SMALL_CHUNK} * {SMALL_CHUNK})::BIGINT AS \"offset\", strlen(text)::BIGINT AS total_size, substr(hex(encode(text)), (2 * ((strlen(text) - 1) // {SMALL_CHUNK} * {SMALL_CHUNK}) + 1)::BIGINT, {2 * SMALL_CHUNK}) AS data FROM (SELECT DISTINCT text FROM documents WHERE strlen(text) > 0)")(lambda g: B.chunks(B.distinct_blobs(g.blobs, "size_bytes", "data"), 0, SMALL_CHUNK, last=True).withColumn("data", F.hex("data")))
_add("blob_whole", f"SELECT {_DOC3} AS hash, hex(encode(text)) AS data FROM documents WHERE doc_id = 3")(lambda g: g.get_blob(_hash_of(g, 8_000_000_003)).select("hash", F.hex("data").alias("data")))
_add("hash_render", f"SELECT 8000000000 + doc_id AS entity_id, lower(printf('%x', {_HASH})) AS hash FROM documents")(lambda g: g.blobs.select("entity_id", S.hash_hex("hash").alias("hash")))


# Answers decoded again: ids of a traversal's batches, and the edges of a request.
_add("message_traverse", _bfs_sql(_START, 2, "true", _BATCHES.replace("AS batch", "AS seq")))(lambda g: messages.answer(g, 5, messages.encode(messages.Traverse(REGION0, 2))).where(F.col("seq") < messages.LAST).select(F.explode(F.from_json("message", "ids array<long>")["ids"]).alias("id"), F.col("seq").cast("int").alias("seq")))
_add("message_edges", f"WITH {_EDGE} {_OUT.format(NATION3)}")(lambda g: messages.answer(g, 6, messages.encode(messages.GetEdges(NATION3))).where("seq is null").select(F.from_json("message", "id long, source long, target long, label int").alias("m")).select("m.*"))


def _events(g: Graph) -> DataFrame:
    return g.spark.read.parquet(f"{g.sf_dir}/events.parquet")


_add("csv_fields", "SELECT event_id, CASE WHEN regexp_matches(props, '[,\"\n]') THEN '\"' || replace(props, '\"', '\"\"') || '\"' ELSE props END AS field FROM events")(lambda g: _events(g).select("event_id", S.csv_field("props").alias("field")))
_NS = "(abs(value) + 0.001) * pow(10, event_id % 11)"
_add("duration_texts", f"SELECT event_id, CASE WHEN n >= 1e9 THEN printf('%.2f s', n / 1e9) WHEN n >= 1e6 THEN printf('%.2f ms', n / 1e6) WHEN n >= 1e3 THEN printf('%.2f μs', n / 1e3) ELSE printf('%.0f ns', n) END AS duration FROM (SELECT event_id, {_NS} AS n FROM events)")(lambda g: _events(g).select("event_id", S.duration_text(F.expr(_NS)).alias("duration")))
_LABELS = ["entity_get_5", "spatial_[-1.00_-1.00_1.00_1.00]", "spatial_[-0.50_-0.50_0.50_0.50]", "spatial_[0.00_0.00_1.00_1.00]", "spatial_x", "bfs_depth2_from_7", "full_scan", "another_operation_of_a_long_name"]
_NAMES = ["Entity get (hot)", "Spatial [full]", "Spatial [mid]", "Spatial [UR]", "Spatial query", "BFS depth=2", "Full scan", "another_operation_of_a_long_name"[:21]]
_add("operation_names", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in zip(_LABELS, _NAMES, strict=True)) + ") t(label, name)")(lambda g: _requests(g, [(x,) for x in _LABELS], "label string").select("label", S.op_name(S.op_key("label")).alias("name")))
_SCALE = f"SELECT user_id % 3 AS scale, event_type AS label, {_STATS} FROM events GROUP BY 1, 2"
_BYSCALE = ["scale", *_OPS]
_add("latency_by_scale", _round_sql(f"SELECT scale, label AS op_key, avg(mean_ns) AS mean_ns, avg(p95_ns) AS p95_ns, avg(p99_ns) AS p99_ns, count(*) AS sample_count FROM ({_SCALE}) GROUP BY 1, 2", _OPS[1:4], _BYSCALE))(lambda g: _rounded(stats.by_operation(stats.latency_stats(_events(g).select((F.col("user_id") % 3).alias("scale"), F.col("event_type").alias("label"), F.col("value").alias("ns")), ["scale", "label"]), ("scale",)), _OPS[1:4]))


def _sqlite(g: Graph, *tables: str) -> Graph:
    """The whole graph, or the tables that a result is made of, written to files of a folder in the shared one, by all executors, and read from there."""
    place = urlparse(shared_dir(g.spark))
    if place.scheme not in ("", "file"):
        raise ValueError(f"SQLite files need a mounted folder, not {place.scheme}")
    path = f"{place.path}/cut-{uuid.uuid4().hex}"
    sqlite.write_files(g, path, tables or tuple(TABLES))
    return Graph.from_sqlite(g.spark, path)


_add("sqlite_edges", f"WITH {_EDGE} SELECT id, source, target, label FROM edge")(lambda g: _sqlite(g).edges)
_add("sqlite_properties", f"WITH {_PROP} SELECT entity_id, key, value_type, value_int, value_float, value_text FROM prop")(lambda g: _sqlite(g, "property").properties)
_add("sqlite_positions", f"WITH {_POS} SELECT entity_id, x, y FROM pos")(lambda g: _sqlite(g, "entity", "position").positions)


def _csv(g: Graph) -> tuple[DataFrame, DataFrame]:
    path = f"{shared_dir(g.spark)}/cut-{uuid.uuid4().hex}"
    kind = (F.col("entity_id") / mapping.KIND_BASE).cast("int")
    sinks.write_graph_csv(g.positions.select(F.col("entity_id").alias("id"), "x", "y", kind.alias("cluster")), g.edges, path)
    return sinks.read_graph_csv(g.spark, path)


_add("csv_nodes", f"WITH {_POS} SELECT entity_id AS id, printf('%.6f', x::DOUBLE)::DOUBLE AS x, printf('%.6f', y::DOUBLE)::DOUBLE AS y, (entity_id // 1000000000)::INT AS cluster FROM pos")(lambda g: _csv(g)[0])
_add("csv_edges", f"WITH {_EDGE} SELECT source, target, 'CONNECTS' AS type FROM edge")(lambda g: _csv(g)[1])


@_add("synthetic_graph", "SELECT scale, n AS nodes, 0 AS loops, 0 AS unknown_ends, 0 AS outside, true AS enough_edges, true AS most_in_cluster, true AS around_centres FROM (VALUES ('1K', 1000::BIGINT), ('10K', 10000), ('100K', 100000)) t(scale, n)")
def _(g: Graph) -> DataFrame:
    """What the generator promises, counted on three presets (every draw is a hash, so SQL can't repeat the rows)."""
    rows = []
    for scale in ("1K", "10K", "100K"):
        n, degree, clusters, _shape = synthetic.PRESETS[scale]
        s = synthetic.graph(g.spark, scale)
        own = (F.col("source") % clusters) == (F.col("target") % clusters)
        e = s.edges.agg(
            F.sum((F.col("source") == F.col("target")).cast("int")).cast("int").alias("loops"), F.sum((~F.col("target").between(0, n - 1) | ~F.col("source").between(0, n - 1)).cast("int")).cast("int").alias("unknown_ends"),
            F.count("*").between(n * degree // 2, n * degree).alias("enough_edges"), (F.avg(own.cast("int")) > synthetic.SAME_CLUSTER - 0.05).alias("most_in_cluster"),
        )
        at = synthetic.nodes(g.spark, n, clusters)
        angle = F.col("cluster") * F.lit(2 * math.pi / clusters)
        off = F.greatest(F.abs(F.col("x") - synthetic.RADIUS * F.cos(angle)), F.abs(F.col("y") - synthetic.RADIUS * F.sin(angle)))
        v = at.agg(F.count("*").alias("nodes"), F.sum(((F.abs("x") > 1) | (F.abs("y") > 1)).cast("int")).cast("int").alias("outside"), (F.max(off) <= synthetic.SPREAD + 1e-6).alias("around_centres"))
        rows.append(v.select(F.lit(scale).alias("scale"), "*").join(F.broadcast(e)))  # one row each
    return reduce(DataFrame.unionByName, rows).select("scale", "nodes", "loops", "unknown_ends", "outside", "enough_edges", "most_in_cluster", "around_centres")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: two hops from a region."""
    return Q["bfs_depth2"](spark, sf_dir)
