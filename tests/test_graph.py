import random
from collections import deque

import pytest

from geoweft.functions import scalar as S
from geoweft.operators import edges as E
from geoweft.operators import spatial, stats, tiles
from geoweft.plans.graph import Graph
from geoweft.schema import TABLES, BlobNotFound, EntityNotFound
from geoweft.sources import sinks, sqlite, synthetic


def build(spark, entities, edges, positions=(), properties=(), blobs=()):
    frames = [[(i,) for i in entities], list(edges), list(positions), list(properties), list(blobs)]
    return Graph(*[spark.createDataFrame(rows, s) for rows, s in zip(frames, TABLES.values(), strict=True)])


@pytest.fixture(scope="module")
def multi(spark):
    r = random.Random(5)
    edges = [(i, r.randrange(62), r.randrange(60), r.choice([1, 2, 3, 65537])) for i in range(220)] + [(900, 7, 7, 2)]
    return build(spark, range(60), edges), edges


def known(edges, n=60):
    return [(i, s, t, lb & 65535) for i, s, t, lb in edges if s < n and t < n]


def queue_bfs(edges, start, depth, labels, n=60):
    if not 0 <= start < n:
        return []
    seen, order, q = {start}, [(start, 0)], deque([(start, 0)])
    while q:
        v, d = q.popleft()
        if d == depth:
            continue
        for t in sorted(t for _, s, t, lb in edges if s == v and (not labels or lb in labels)):
            if t not in seen:
                seen.add(t)
                order.append((t, d + 1))
                q.append((t, d + 1))
    return order


@pytest.mark.parametrize("depth,labels,limit", [(0, [], None), (1, [], 5), (2, [1, 2], None), (3, [], 17), (5, [1], 30), (2, [], 0)])
def test_bfs_order(multi, depth, labels, limit):
    g, edges = multi
    for start in (0, 7, 999):
        want = queue_bfs(known(edges), start, depth, labels)
        want = want if limit is None else want[:limit]
        rows = g.traverse(start, depth, labels, limit, ordered=True).orderBy("ord").collect()
        assert [(r.id, r.depth) for r in rows] == want


def scan_edges(edges, eid, direction, labels, limit):
    ok = lambda lb: not labels or lb in labels
    out = []
    if direction in ("outgoing", "both"):
        side = sorted((e for e in edges if e[1] == eid), key=lambda e: (e[2], e[0]))[:limit]
        out += [e for e in side if ok(e[3])]
    if direction in ("incoming", "both"):
        side = sorted((e for e in edges if e[2] == eid), key=lambda e: (e[1], e[0]))[: limit - len(out)]
        out += [e for e in side if ok(e[3])]
    return out


def test_edges_against_scan(spark, multi):
    g, edges = multi
    r = random.Random(1)
    reqs = [(i, r.randrange(60), r.choice(E.DIRECTIONS), r.choice([[], [1], [2, 3]]), r.choice([0, 1, 2, 4, 100])) for i in range(60)]
    df = spark.createDataFrame(reqs, "request_id long, entity_id long, direction string, labels array<int>, limit int")
    got = {}
    for x in g.get_edges_batch(df).orderBy("request_id", "side", "rn").collect():
        got.setdefault(x.request_id, []).append((x.id, x.source, x.target, x.label))
    for rid, eid, d, labels, limit in reqs:
        assert got.get(rid, []) == scan_edges(known(edges), eid, d, labels, limit)
    assert [tuple(x) for x in g.get_edges(7, "both").collect()] == scan_edges(known(edges), 7, "both", [], 10**9)
    with pytest.raises(EntityNotFound):
        g.get_edges(5000)


def test_scans_and_stats(spark):
    g = build(spark, [1, 2], [(1, 1, 2, 1), (2, 2, 1, 2), (3, 1, 99, 1)])
    assert g.stats().first().asDict() == {"entities": 2, "edges": 3, "blobs": 0, "blob_bytes": 0}
    assert g.edges.count() == 2
    assert [r.id for o in (0, 1) for r in g.edge_page(o, 1).collect()] == [1, 2]
    p = build(spark, [1, 2], [], [(1, 0.0, 0.5), (2, 1.0, -0.5), (3, 0.0, 0.0)])
    assert p.positions_of(p._ids(1, 2, 3)).count() == 2 and p.positions_of(p._ids()).count() == 0


def test_tile_math(spark):
    assert [spatial.tile_of(v, 4) for v in (-2, -1, 0, 1, 2)] == [0, 0, 2, 3, 3]
    vals = [-2.0, -1.0, 0.0, 1.0, 2.0, float("nan"), float("inf"), float("-inf"), 0.1]
    df = spark.createDataFrame([(v,) for v in vals], "v double").select("v", S.world_to_tile("v", 4).alias("t"))
    assert [r.t for r in df.collect()] == [spatial.tile_of(v, 4) for v in vals]
    r = spatial.tile_range(-0.6, -0.2, 0.7, 0.8, 3)
    assert (r["min_tx"], r["max_tx"], r["min_ty"], r["max_ty"]) == (1, 6, 3, 7)
    assert [spark.range(1).select(S.tile_distance(*[S.F.lit(v) for v in (x, y, 5, 5)])).first()[0] for x, y in ((5, 5), (7, 5), (7, 8))] == [0, 4, 13]


def test_spatial(spark):
    pts = [(1, -0.5, -0.5), (2, 0.0, 0.0), (3, 0.75, 0.75)]
    g = build(spark, [1, 2, 3], [], pts)
    assert g.bits == 4 and g.cells.count() == 3
    assert spatial.cell(g.cells, 4, 4).count() == 1
    assert spatial.coarse_bounds(g.cells, (-1, -1, 0, 0), 4).count() == 2 and spatial.coarse_bounds(g.cells, (-1, -1, 1, 1), 4).count() == 3
    nan = float("nan")
    assert g.search_spatial(nan, 0, 1, 1).count() == 0 and g.search_spatial(1, 1, 0, 0).count() == 0 and g.search_spatial(-1, -1, 1, 1, 0).count() == 0


def test_viewport_order(spark):
    r = random.Random(3)
    pts = [(i, spatial.f32(r.uniform(-1.2, 1.2)), spatial.f32(r.uniform(-1.2, 1.2))) for i in range(900)] + [(900, float("nan"), 0.0)]
    g = build(spark, range(901), [], pts)
    n = 1 << g.bits
    for b, limit in (((-1, -1, 1, 1), 50), ((-0.4, -0.3, 0.2, 0.1), 20), ((-2, -2, 2, 2), 2000)):
        f = [spatial.f32(v) for v in b]
        s = g.bits - spatial.choose_lod(b, g.bits, limit)
        hit = [(i, spatial.tile_of(x, n), spatial.tile_of(y, n)) for i, x, y in pts if f[0] <= x <= f[2] and f[1] <= y <= f[3]]
        want = [i for i, gx, gy in sorted(hit, key=lambda h: (h[2] >> s, h[1] >> s, h[2], h[1], h[0]))][:limit]
        assert [x.id for x in g.search_spatial(*b, limit=limit).collect()] == want


def test_properties_and_decode(spark):
    rows = [(1, "a", 1, 5, None, None), (1, "n", 1, None, None, None), (1, "f", 2, None, 1.5, None), (1, "t", 3, None, None, "x"), (1, "b", 4, 1, None, None), (1, "h", 5, 77, None, None), (1, "u", 9, 3, None, None), (8, "a", 1, 6, None, None)]
    g = build(spark, [1, 2], [], properties=rows)
    e = g.get_entity(1, properties=True).first()
    v = {p.key: p.value for p in e.properties}
    assert v["a"].int == 5 and v["n"].int == 0 and v["f"].float == 1.5 and v["t"].text == "x" and v["b"].bool is True and v["h"].blob.hash == 77 and v["u"].text == ""
    assert [p.key for p in e.properties] == sorted(v) and e.blob_refs == []
    assert g.get_entity(2, True, True).first().properties == []
    with pytest.raises(EntityNotFound, match="entity not found: 8"):
        g.get_entity(8)
    assert sorted(r.id for r in g.search_property_key("a").collect()) == [1, 8]
    assert [r.id for r in g.search_property_eq("a", 6).collect()] == [8] and [r.id for r in g.search_property_range("a", 0, 5.5).collect()] == [1]


def test_blobs(spark):
    data = bytes(range(256)) * 300
    g = build(spark, [1, 2], [], blobs=[(2, "k", 9, None, len(data), data), (1, "z", 9, "m", len(data), data), (1, "n", 10, "", 5, None)])
    got = g.blob_chunks(9, 100, 65536).orderBy("offset").collect()
    assert b"".join(bytes(c.data) for c in got) == data[100:] and [c.offset for c in got] == [100, 65636]
    assert g.get_blob(9).first().entity_id == 1
    assert g.blob_chunks(9, 0, 0).count() == 0 and g.blob_chunks(9, len(data)).count() == 0 and g.blob_chunks(10).count() == 0
    with pytest.raises(BlobNotFound, match="blob not found: ff"):
        g.get_blob(255)


def test_tile_frames():
    t = [(100, 200, 1, 0, 10, 0, b"\0\1\2\3"), (105, 203, 2, 1, 0, 5, b"\4\5")]
    f = tiles.encode_frame(7, 3, t)
    assert tiles.decode_frame(f) == (7, 3, t) and tiles.decode_frame(tiles.encode_frame(1, 2, [])) == (1, 2, [])
    assert tiles.decode_frame(b"\0" + f[1:]) is None and tiles.decode_frame(f[:4]) is None and tiles.decode_frame(f[:4] + b"\2" + f[5:]) is None and tiles.decode_frame(f[:-1]) is None
    many = [(i, 0, 0, 1, 70000, 1, b"x") for i in range(600)]
    assert sum(len(tiles.decode_frame(x)[2]) for x in tiles.encode_frames(1, 1, many)) == 600


def test_pointers_and_codecs(spark):
    p = spark.range(1).select(S.pack_pointer(S.F.lit(1), S.F.lit(2), S.F.lit(3)).alias("p"))
    u = S.unpack_pointer(S.pointer_with_epoch("p", S.F.lit(5)))
    assert [p.select(u[k]).first()[0] for k in ("index", "epoch", "storage")] == [1, 5, 3]
    assert sum(S.POINTER_64) == 64 and sum(S.POINTER_32) == 32


def test_latency(spark):
    vals = [i / 7 for i in range(100)]
    s = spark.createDataFrame([("a", v) for v in vals] + [("b", 3.0)], "label string, ns double")
    got = {r.label: r for r in stats.latency_stats(s, ["label"]).collect()}
    assert got["a"].p95_ns == vals[94] and got["a"].p50_ns == vals[50] and got["b"].stddev_ns == 0.0 and got["b"].sample_count == 1
    assert stats.latency_stats(s.where("false"), ["label"]).count() == 0
    d = spark.createDataFrame([(2.5e9,), (1.5e6,), (2e3,), (5.0,)], "v double").select(S.duration_text("v"))
    assert [r[0] for r in d.collect()] == ["2.50 s", "1.50 ms", "2.00 μs", "5 ns"]
    k = spark.createDataFrame([("spatial_[-0.50_-0.50_0.50_0.50]",), ("bfs_x",), ("spatial_q",), ("zz",)], "v string").select(S.op_key("v"))
    assert [r[0] for r in k.collect()] == ["spatial_mid", "bfs_depth2", "spatial", "zz"]


def test_sqlite_round_trip(spark, tmp_path):
    g = build(spark, [1, 2, -3], [(1, 1, 2, 1)], [(1, 0.5, 0.25)], [(1, "k", 3, None, None, "v")], [(1, "b", 5, "m", 2, b"hi")])
    sqlite.write_file(g, f"{tmp_path}/g.db")
    h = Graph.from_sqlite(spark, f"{tmp_path}/g.db")
    assert sorted(r.id for r in h.entities.collect()) == [-3, 1, 2] and h.edges.count() == 1 and bytes(h.blobs.first().data) == b"hi"
    g.save(f"{tmp_path}/p")
    assert Graph.from_parquet(spark, f"{tmp_path}/p").stats().first() == g.stats().first()


def test_sqlite_folder(spark, monkeypatch, tmp_path):
    """Many files, rows split inside a file, repeated ids, an empty table; nothing is gathered."""
    from pyspark.sql.classic.dataframe import DataFrame

    from geoweft import queries

    def gathered(*_, **__):
        raise AssertionError("rows pass the driver")

    edges = [(i % 400, i % 7, i % 5, i % 3) for i in range(1000)]
    g = build(spark, range(7), edges, [(1, 0.5, None), (2, 0.1, 0.25), (2, 0.1, 0.25)], [(1, "k", 2, None, 0.1, None), (1, None, 3, None, None, "\u00e4\0v")], [(1, "b", 5, None, 3, b"h\0i")])
    g.raw_edges = g.raw_edges.repartition(3)
    monkeypatch.setattr(DataFrame, "toLocalIterator", gathered)
    monkeypatch.setattr(DataFrame, "collect", gathered)
    h = queries._sqlite(g)
    monkeypatch.undo()
    for name in ("entities", "raw_edges", "positions", "properties", "blobs"):
        rows = lambda x, n=name: sorted(map(repr, getattr(x, n).collect()))
        assert rows(h) == rows(g) and rows(g), name
    sqlite.write_files(build(spark, [1], []), f"{tmp_path}/e")
    assert Graph.from_sqlite(spark, f"{tmp_path}/e").edges.count() == 0

    sqlite.write_files(g, f"{tmp_path}/g")
    monkeypatch.setattr(sqlite, "SPLIT_ROWS", 100)
    reader = sqlite._Reader({"path": f"{tmp_path}/g", "table": "edge"}, TABLES["edge"])
    got = [tuple(r.values()) for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert len(reader.partitions()) >= 10 and sorted(got) == sorted(edges)


def test_synthetic_and_sinks(spark, tmp_path):
    g = synthetic.graph(spark, "1K")
    e = g.edges.collect()
    assert g.entities.count() == 1000 and 0 < len(e) <= 5000 and all(x.source != x.target for x in e) and len({x.id for x in e}) == len(e)
    assert g.positions.where("abs(x) > 1 or abs(y) > 1").count() == 0
    assert sorted(map(tuple, synthetic.graph(spark, "1K").edges.collect())) == sorted(map(tuple, e))
    sinks.write_graph_csv(synthetic.nodes(spark, 10, 2), g.edges, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/nodes").columns == sinks.NODE_HEADER
    row = {c: 1.0 for c in sinks.REPORT_COLUMNS} | {"scale": "1K", "operation": 'full,"scan'}
    rep = spark.createDataFrame([row | {"system": "a"}, row | {"system": "b", "mean_ns": 4.0}])
    assert "4.0x" in sinks.markdown(rep, "a", "b")
    assert '"full,""scan"' in sinks.report_csv_lines(rep).first().line


def test_streamed_requests(spark, tmp_path, multi):
    from geoweft.streaming.requests import serve

    g, edges = multi
    spark.createDataFrame([(1, 0), (2, 7)], "request_id long, start_id long").write.parquet(f"{tmp_path}/in")
    req = spark.readStream.schema("request_id long, start_id long").parquet(f"{tmp_path}/in")
    serve(req, lambda b: g.traverse_batch(b, 1), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").where("request_id = 2").count()
    assert got == len(queue_bfs(known(edges), 7, 1, []))


def test_all_pointers(spark):
    from geoweft.queries import Q

    rows = Q["pointer_pack_unpack"](spark, "/root/testdata/sf0.001").collect()
    ids = [x.event_id for x in spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id").collect()]
    want = []
    for i in ids:
        raw = (i & ((1 << 40) - 1)) | (i % 65536) << 40 | (i % 256) << 56
        want.append((i, i % 65536, i % 256, raw - (1 << 64) if raw >> 63 else raw))
    assert sorted(map(tuple, rows)) == sorted(want) and any(x.packed < 0 for x in rows)


def test_hub_edges_are_ranked_in_parts(spark):
    """A hub with a limit, none, and a literal bound; no task ranks all its edges."""
    n = 20_000
    edges = spark.range(n).selectExpr("id", "cast(7 as long) as source", "id % 5000 as target", "cast(id % 3 as int) as label")
    schema = "request_id long, entity_id long, direction string, labels array<int>, limit int"
    want = sorted(((i % 5000, i) for i in range(n)))
    req = spark.createDataFrame([(1, 7, "outgoing", [], 9), (2, 7, "both", [1], None), (3, 8, "outgoing", [], 5)], schema)
    for most in (None, 9):
        got = E.get_edges_batch(edges, req, most=most)
        rows = got.collect()
        assert [(x.target, x.id) for x in sorted((x for x in rows if x.request_id == 1), key=lambda x: x.rn)] == want[:9]
        free = [x for x in rows if x.request_id == 2]
        assert len([x for x in free if x.side == 0]) == sum(i % 3 == 1 for i in range(n)) and all(x.rn is None for x in free)
    plan = E.get_edges_batch(edges, req.where("limit is not null"), most=9)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    # the parts of the first ranking
    parts = edges.groupBy(S.F.pmod(S.F.xxhash64("id"), S.F.lit(E.SALTS))).count().collect()
    assert len(parts) == E.SALTS and max(x["count"] for x in parts) < n / 20


def test_percentiles_of_large_groups(spark):
    """Brackets hold the exact nearest rank: heavy ties, outliers and continuous values."""
    r = random.Random(4)
    vals = {"ties": [float(r.choice([1, 2, 2, 2, 3, 1000])) for _ in range(30_000)], "spread": [r.random() ** 9 * 1e9 for _ in range(25_000)], "same": [5.0] * 12_000, "few": [3.0, 1.0, 2.0], None: [1.0, 2.0]}
    s = spark.createDataFrame([(k, v) for k, x in vals.items() for v in x] + [("few", None)], "label string, ns double")
    got = {x.label: x for x in stats.latency_stats(s, ["label"]).collect()}
    assert len(got) == len(vals)
    for k, x in vals.items():
        x = sorted(x)
        for name, p in stats.PERCENTILES.items():
            rank = int(p * (len(x) - 1) + 0.5)
            assert got[k][name] == x[rank], (k, name)
        assert got[k].sample_count == len(x)


def test_viewports_by_size(spark, monkeypatch):
    """Small, middle and whole-world requests, broadcast and shuffled, against a scan."""
    r = random.Random(8)
    pts = [(i, spatial.f32(r.uniform(-1.3, 1.3)), spatial.f32(r.gauss(0, 0.1))) for i in range(1500)] + [(1500, float("nan"), 0.0)]
    g = build(spark, range(1501), [], pts)
    rects = []
    for i in range(60):
        x, y, w = r.uniform(-1.2, 1.2), r.uniform(-0.3, 0.3), r.choice([0.001, 0.02, 0.3, 3.0])
        rects.append((i, spatial.f32(x), spatial.f32(y), spatial.f32(x + w), spatial.f32(y + w)))
    rects += [(99, 1.0, 0.0, 0.0, 1.0), (98, float("nan"), 0.0, 1.0, 1.0), (97, -9.0, -9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rects, "request_id long, min_x double, min_y double, max_x double, max_y double")
    want = sorted((i, e) for i, a, b, c, d in rects for e, x, y in pts if a <= x <= c and b <= y <= d)
    assert sorted(map(tuple, g.search_spatial_batch(df).collect())) == want
    monkeypatch.setattr(spatial, "broadcast_if_small", lambda df, _: df)
    assert sorted(map(tuple, g.search_spatial_batch(df).collect())) == want


def test_requests_out_of_range(spark):
    from geoweft.schema import BadRequest

    g = build(spark, [1], [])
    for call in (lambda: g.traverse(1, -1), lambda: g.traverse(1, 1, limit=-1), lambda: g.edge_page(-1, 1), lambda: g.get_edges(1, limit=-2), lambda: g.search_spatial(0, 0, 1, 1, -1), lambda: g.blob_chunks(1, -1), lambda: g.get_edges(1, "up")):
        with pytest.raises(BadRequest):
            call()


def test_last_chunk_and_snapshots(spark):
    data = bytes(range(256)) * 5
    g = build(spark, [1], [], blobs=[(1, "k", 9, None, len(data), data), (1, "n", 10, "", 5, None)])
    for offset, size in ((0, 500), (100, 64), (1279, 9), (0, 1280)):
        every = g.blob_chunks(9, offset, size).orderBy("offset").collect()
        assert g.last_chunk(9, offset, size).collect() == every[-1:]
    assert g.last_chunk(9, 1280).count() == 0 and g.last_chunk(10).count() == 0
    assert g.hello().first().asDict() == {"entities": 1, "edges": 0, "blob_bytes": 1285, "supported_codecs": 7}
    assert g.health().first().ok and not g.is_loaded() and g.persist().is_loaded()


def test_shared_folder(spark, tmp_path):
    from geoweft.plans import lineage

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_dir(Cluster)
    lineage.cut(spark.range(3)).count()
    assert lineage.sweep(spark, 3600) == [] or all(x.startswith(lineage.PREFIXES) for x in lineage.sweep(spark, 3600))


def test_messages(spark, multi):
    import json

    from geoweft.schema import BadRequest
    from geoweft.streaming import messages as M

    g, edges = multi
    data = bytes(range(200))
    b = build(spark, [1, 2], [(1, 1, 2, 1)], [(1, 0.5, 0.5)], [(1, "a", 1, 5, None, None)], [(1, "k", 9, None, 200, data)])
    requests = [M.GetEntity(1, True, True), M.GetEdges(1), M.Traverse(1, 1), M.SearchSpatial(0, 0, 1, 1), M.SearchProperty("a"), M.SearchProperty("a", 5), M.SearchProperty("a", low=1.0), M.GetBlob(9, 0, 150)]
    want = [["entity"], ["edge"], ["batch"], ["entity"], ["entity"], ["entity"], ["entity"], ["chunk", "chunk"]]
    for r, kinds in zip(requests, want, strict=True):
        assert M.decode(M.encode(r)) == r
        rows = M.answer(b, 3, M.encode(r)).orderBy("seq").collect()
        got = [json.loads(x.message) for x in rows]
        assert [x["kind"] for x in got] == [*kinds, "done"] and {x.query_id for x in rows} == {3}
    ids = [i for x in M.answer(g, 4, M.encode(M.Traverse(0, 3))).orderBy("seq").collect() for i in json.loads(x.message).get("ids", [])]
    assert ids == [i for i, _ in queue_bfs(known(edges), 0, 3, [])]
    assert [json.loads(x.message)["kind"] for x in M.answer(b, 8, M.encode(M.GetEntity(77))).collect()] == ["error", "done"]
    for bad in ("", "[]", "{}", '{"kind": "nope"}', '{"kind": "entity"}', '{"kind": "entity", "id": "x"}', '{"kind": "entity", "id": true}', '{"kind": "edges", "entity_id": 1, "labels": ["a"]}', '{"kind": "blob", "hash": 1, "more": 2}'):
        rows = M.answer(b, 9, bad).collect()
        assert len(rows) == 1 and rows[0].query_id == 0 and json.loads(rows[0].message)["message"].startswith("decode: ")
        with pytest.raises(BadRequest):
            M.decode(bad)
    assert json.loads(M.hello(b).first().message)["entities"] == 2
