"""Readers and writers."""

import json
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import geodesy
from ridgeline.operators import corrections, raster
from ridgeline.plans import jobs
from ridgeline.sinks.files import in_ranges, write_corrections, write_geopackages
from ridgeline.sources import footprints, rasters, tables


def test_nodes_are_read_strictly(spark, tmp_path):
    (tmp_path / "n.csv").write_text("20251031,7,1.5,2.5,3.0,True\n20251031,8,1.5,2.5,3.0,False\n")
    got = tables.read_nodes(spark, str(tmp_path / "n.csv")).orderBy("idx").collect()
    assert [(r.database_line, r.active) for r in got] == [(7, True), (8, False)]
    (tmp_path / "bad.csv").write_text("20251031,7,1.5,2.5,3.0,true\n")
    with pytest.raises(Exception, match="not True or False"):
        tables.read_nodes(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "worse.csv").write_text("20251031,x,1.5,2.5,3.0,True\n")
    with pytest.raises(Exception):
        tables.read_nodes(spark, str(tmp_path / "worse.csv")).collect()


def test_points_are_read_tolerantly(spark, tmp_path):
    (tmp_path / "p.csv").write_text("X,Y\n1, 2\n\n3\nnope,4\n5,6,extra\n")
    assert [(r.x, r.y) for r in tables.read_points(spark, str(tmp_path / "p.csv")).orderBy("point_id").collect()] == [(1, 2), (5, 6)]


def test_batches(spark, tmp_path):
    for source, head, tail in (("tower", ",nature_id", ",11"), ("building", "", "")):
        (tmp_path / source).mkdir()
        for b in (0, 1):
            (tmp_path / source / f"{b}.csv").write_text(f"date,line,tile_id,lon,lat,height{head}\n20251031,{b}1,0650_6861,2.3,48.8,{'' if b else 'junk'}{tail}\n\n20251031,{b}2,0650_6861,2.4,48.9,30{tail}\n")
    got = tables.read_batches(spark, str(tmp_path / "*" / "*.csv")).orderBy("input", "batch", "idx").collect()
    assert [(r.input, r.batch, r.idx, r.database_line) for r in got][:3] == [("building", "0", 0, 1), ("building", "0", 1, 2), ("building", "1", 0, 11)]
    assert {r.nature for r in got} == {None, 11}
    assert np.isnan(got[0].altitude) and got[2].altitude == 0
    assert tables.read_batch(spark, str(tmp_path), "tower", "1").count() == 2
    (tmp_path / "tower" / "2.csv").write_text("line,date\n1,2\n")
    with pytest.raises(Exception, match="unexpected header"):
        tables.read_batch(spark, str(tmp_path), "tower", "2").collect()


def test_corrections_there_and_back(spark, tmp_path):
    towers = spark.createDataFrame([(0, "20251031", 5), (1, "20251031", 6), (2, "20251031", 7)], "idx long, database_date string, database_line long")
    folded = spark.createDataFrame([(5, "bad", None, None, None), (7, "changed", 0.1, 0.0, 2.0)], "database_line long, status string, d_lon double, d_lat double, d_alt double")
    path = write_corrections(corrections.serialize(towers, folded), str(tmp_path), "tower", "me", "0")
    lines = tables.read_corrections(spark, path)
    assert [r.line for r in lines.orderBy("seq").collect()] == ["20251031,5,false", "20251031,7,0.1,0.0,2.0"]
    got = corrections.parse(lines, towers).orderBy("idx").collect()
    assert [(r.idx, r.action, r.d_lon) for r in got] == [(0, "bad", None), (2, "changed", 0.1)]
    other = towers.selectExpr("idx", "'20240101' AS database_date", "database_line")
    with pytest.raises(Exception, match="dates do not match"):
        corrections.parse(lines, other).collect()
    assert tables.read_corrections(spark, str(tmp_path / "absent")).count() == 0


def test_departments(spark, tmp_path):
    square = [[0, 0], [1, 0], [1, 1], [0, 0]]
    features = [{"properties": {"code": "75"}, "geometry": {"type": "Polygon", "coordinates": [square]}}, {"properties": {"code": "2A"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}}]
    (tmp_path / "d.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = tables.read_departments(spark, str(tmp_path / "d.geojson")).collect()
    assert sorted(r.code for r in got) == ["2A", "2A", "75"]
    assert tuple(got[0].ring[1]) == (1.0, 0.0)


def test_rasters(spark, tmp_path):
    h = np.arange(36, dtype=np.float32).reshape(6, 6)
    h[0, 0] = np.nan
    assert np.array_equal(rasters.decode_tiff(rasters.encode_tiff(h)), h, equal_nan=True)
    with pytest.raises(ValueError):
        rasters.decode_tiff(b"II*\0nothing at all")
    (tmp_path / "LHD_FXX_0650_6861_MNS_O_0M50_LAMB93_IGN69.tif").write_bytes(rasters.encode_tiff(h))
    got = rasters.read_tiles(spark, str(tmp_path), 6, 4)
    long = spark.createDataFrame([(650, 6861, x, y, float(h[5 - y, x])) for x in range(6) for y in range(6)], "tile_x int, tile_y int, px int, py int, h float")
    key = lambda d: sorted((r.tile_x, r.tile_y, r.bx, r.by, str(r.heights), r.top) for r in d.collect())
    assert key(got) == key(raster.to_blocks(long, 4))


def packed_lzw(data):
    """A plain encoder: the longest string known so far, then one more byte."""
    bits, table, width, now = [], {}, 9, b""

    def put(code):
        bits.extend(code >> k & 1 for k in range(width - 1, -1, -1))

    put(256)
    table = {bytes([k]): k for k in range(256)} | {None: 256, False: 257}
    for b in data:
        if now + bytes([b]) in table:
            now += bytes([b])
            continue
        put(table[now])
        table[now + bytes([b])] = len(table)
        width = 9 if len(table) < 512 else 10 if len(table) < 1024 else 11 if len(table) < 2048 else 12
        now = bytes([b])
        if len(table) >= 4094:
            put(table[now])
            put(256)
            table, width, now = {bytes([k]): k for k in range(256)} | {None: 256, False: 257}, 9, b""
    if now:
        put(table[now])
        width = min(12, max(9, (len(table) + 1).bit_length()))
    put(257)
    bits += [0] * (-len(bits) % 8)
    return bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, len(bits), 8))


def packed_bits(data):
    return b"".join(bytes([len(data[k : k + 100]) - 1]) + data[k : k + 100] for k in range(0, len(data), 100)) + bytes([128, 0])


def tiff(h, compression, predictor):
    if predictor == 2:
        v = h.view(np.uint32)
        data = np.diff(v, axis=1, prepend=np.zeros((len(h), 1), np.uint32)).astype("<u4").tobytes()
    elif predictor == 3:
        rows = h.astype(">f4").view(np.uint8).reshape(*h.shape, 4).swapaxes(1, 2).reshape(len(h), -1)
        data = np.diff(rows, axis=1, prepend=np.zeros((len(h), 1), np.uint8)).astype(np.uint8).tobytes()
    else:
        data = h.astype("<f4").tobytes()
    import zlib

    data = {1: bytes, 5: packed_lzw, 8: zlib.compress, 32773: packed_bits}[compression](data)
    entries = [(256, 4, h.shape[1]), (257, 4, h.shape[0]), (258, 3, 32), (259, 3, compression), (273, 4, 8), (277, 3, 1), (278, 4, h.shape[0]), (279, 4, len(data)), (317, 3, predictor), (339, 3, 3)]
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in entries) + b"\0\0\0\0"


@pytest.mark.parametrize("predictor", [1, 2, 3])
@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
def test_rasters_of_every_packing(compression, predictor):
    rng = np.random.default_rng(1)
    h = (np.round(rng.standard_normal((60, 70)).cumsum(axis=1) * 4) / 4 + 50).astype(np.float32)
    h[3, 4] = np.nan
    assert np.array_equal(rasters.decode_tiff(tiff(h, compression, predictor)), h, equal_nan=True)


def wkb(*rings):
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in rings)


def test_holes_are_read():
    blob = b"GP\0\x01" + struct.pack("<i", 2154) + wkb(square(0, 0), square(2, 2, 3.0))
    assert footprints.geopackage_rings(blob) == [[square(0, 0), square(2, 2, 3.0)]]


def geopackage(path, rings):
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('batiment', 'geom')")
        db.execute("CREATE TABLE batiment (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT)")
        for ring in rings:
            db.execute("INSERT INTO batiment (geom) VALUES (?)", (b"GP\0\x01" + struct.pack("<i", 2154) + wkb(ring),))
        db.execute("INSERT INTO batiment (geom) VALUES (NULL)")


def square(x, y, side=10.0):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]


def test_footprints_and_the_snapping_job(spark, tmp_path):
    geopackage(tmp_path / "a.gpkg", [square(0, 0), square(100, 0)])
    (tmp_path / "broken.gpkg").write_bytes(b"no database")
    paths = [str(tmp_path / "a.gpkg"), str(tmp_path / "broken.gpkg")]
    assert footprints.read_footprints(spark, paths).count() == 2
    assert footprints.read_footprints(spark, paths, (90, -5, 120, 5)).count() == 1
    with pytest.raises(ValueError):
        footprints.require_some(footprints.read_footprints(spark, paths[1:]))
    (tmp_path / "points.csv").write_text("X,Y\n5,5\n15,5\n50,50\n120.5,5\n")
    got = jobs.snap_job(spark, str(tmp_path / "points.csv"), paths, str(tmp_path / "out")).orderBy("point_id").collect()
    assert [(r.snapped_x, r.snapped_y) for r in got] == [(5, 5), (10, 5), (None, None), (110, 5)]
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["x", "y"] and back.where("x is not null").count() == 3


def test_the_sight_job(spark, tmp_path):
    folder = tmp_path / "tiles"
    folder.mkdir()
    h = np.zeros((20, 20), np.float32)
    h[:, 10] = 50
    name = "LHD_FXX_0000_0001_MNS_O_0M50_LAMB93_IGN69.tif"
    (tmp_path / "nodes.csv").write_text("1,1,100,500,20,True\n1,2,400,500,20,True\n1,3,900,500,20,False\n")
    (folder / f"temp_{name}").write_bytes(b"")
    with pytest.raises(Exception, match="missing tile"):
        jobs.sight_job(spark, str(tmp_path / "nodes.csv"), str(folder), str(tmp_path / "out"), ppt=20, size=5)
    (folder / name).write_bytes(rasters.encode_tiff(h))
    # A tile outside the region isn't opened: this one couldn't be.
    (folder / name.replace("0000", "0009")).write_bytes(b"no raster")
    got = jobs.sight_job(spark, str(tmp_path / "nodes.csv"), str(folder), str(tmp_path / "out"), ppt=20, size=5)
    assert {(r.id1, r.id2): r.is_free for r in got.collect()} == {(2, 1): True, (3, 1): False, (3, 2): False}
    assert spark.read.csv(str(tmp_path / "out" / "blocked.csv")).count() == 2
    assert rasters.delete_partial_tiles(spark, str(folder)) == 1
    assert rasters.list_files(spark, str(folder)).count() == 2


def test_the_command_line(spark, tmp_path):
    own = jobs.parser().parse_args("sight --nodes n --tiles t --output o -m 250.5 -r here".split())
    assert (own.job, own.nodes, own.tiles, own.output, own.max_link_length, own.region, own.pixels) == ("sight", "n", "t", "o", 250.5, "here", 2000)
    assert jobs.parser().parse_args("sight --nodes n --tiles t --output o".split()).max_link_length == float("inf")
    own = jobs.parser().parse_args("snap --points p --footprints a b --output o --crs 4326".split())
    assert (own.footprints, own.crs, own.reach) == (["a", "b"], 4326, 20.0)
    with pytest.raises(SystemExit):
        jobs.parser().parse_args(["snap"])
    (tmp_path / "nodes").mkdir()
    (tmp_path / "tiles" / "here").mkdir(parents=True)
    (tmp_path / "nodes" / "here.csv").write_text("1,1,100,500,20,True\n1,2,400,500,20,True\n")
    (tmp_path / "tiles" / "here" / "LHD_FXX_0000_0001_MNS_O_0M50_LAMB93_IGN69.tif").write_bytes(rasters.encode_tiff(np.zeros((20, 20), np.float32)))
    got = jobs.main(f"sight --nodes {tmp_path}/nodes --tiles {tmp_path}/tiles --output {tmp_path}/out -r here --pixels 20 --block 5".split())
    assert [(r.id1, r.id2, r.is_free) for r in got.collect()] == [(2, 1, True)]


def test_databases_around_the_points(spark, tmp_path):
    """Departments in degrees, points in UTM: the one database that is needed is found, or named."""
    ring = [[2.0, 48.0], [3.0, 48.0], [3.0, 49.0], [2.0, 49.0], [2.0, 48.0]]
    away = [[x + 3, y] for x, y in ring]
    features = [{"properties": {"code": c}, "geometry": {"type": "Polygon", "coordinates": [r]}} for c, r in (("75", ring), ("2A", away))]
    (tmp_path / "d.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (tmp_path / "p.csv").write_text("448251.795,5411932.678\n")
    args = f"snap --points {tmp_path}/p.csv --crs 32631 --databases {tmp_path} --departments {tmp_path}/d.geojson --output {tmp_path}/out".split()
    with pytest.raises(ValueError, match="missing databases: .*D075"):
        jobs.main(args)
    deep = tmp_path / "BDTOPO_3-5_TOUSTHEMES_GPKG_LAMB93_D075_2025-12-15" / "BDTOPO_3-5_TOUSTHEMES_GPKG_LAMB93_D075_2025-12-15" / "1_DONNEES" / "first"
    deep.mkdir(parents=True)
    x, y = spark.range(1).select(*geodesy.to_lambert93(F.lit(2.2945), F.lit(48.8582))).first()
    geopackage(deep / "x.gpkg", [square(x + 5, y - 10, 20.0)])
    got = jobs.main(args).collect()
    assert len(got) == 1 and abs(got[0].moved - 5) < 3 and spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["x", "y"]


def test_database_folder(tmp_path):
    deep = tmp_path / "db" / "db" / "1_DONNEES" / "first"
    deep.mkdir(parents=True)
    (deep / "x.gpkg").write_bytes(b"")
    (tmp_path / "db" / "db" / "0_DOCS").mkdir()
    assert footprints.database_file(str(tmp_path), "db") == str(deep / "x.gpkg")


def test_footprints_pass_through_files_in_batches(spark, tmp_path):
    """Sources in any order, many to a file; no task holds a source's rows."""
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    rows = [(f"s{i % 3}", i, [(x + i, y) for x, y in square]) for i in range(5000)]
    own = spark.createDataFrame(rows, "source string, fid long, ring array<struct<x: double, y: double>>").repartition(5)
    written = write_geopackages(own, str(tmp_path))
    assert "FlatMapGroups" not in written._jdf.queryExecution().toString()
    paths = {r.path: r.n for r in written.collect()}
    assert sorted(paths.values()) == [1666, 1667, 1667]
    back = footprints.read_footprints(spark, sorted(paths)).select("source", "fid", "x0", "x1").collect()
    assert sorted((r.source[-7:-5], r.fid, r.x0, r.x1) for r in back) == sorted((s, i, float(i), i + 1.0) for s, i, _ in rows)


def test_corrections_are_put_in_order_by_ranges(spark, tmp_path):
    lines = spark.createDataFrame([((i * 7919) % 5000, f"{(i * 7919) % 5000}") for i in range(5000)], "idx long, line string").repartition(6)
    assert "rangepartitioning" in in_ranges(lines)._jdf.queryExecution().toString()
    path = write_corrections(lines, str(tmp_path), "tower", "me", "0")
    files = list(__import__("pathlib").Path(path).glob("part-*"))
    assert len(files) == 1 and files[0].read_text().split()[1:] == [str(i) for i in range(5000)]
