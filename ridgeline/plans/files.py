"""Queries that go through files: what is written, read again. Files lie in the shared folder."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import inputs
from ridgeline.checkpoints import scratch
from ridgeline.functions import geodesy, text
from ridgeline.operators import links, neighbours, raster, snapping, tiles
from ridgeline.plans import jobs, sight, sites
from ridgeline.sinks.files import local, write_batches, write_corrections, write_geopackages, write_links, write_snapped
from ridgeline.sources import footprints, rasters, tables
from ridgeline.sources.tables import read_corrections, read_nodes


def _folder(spark: SparkSession) -> str:
    return scratch(spark, "files")


def nodes_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC1, SF21."""
    path = f"{_folder(spark)}/nodes"
    n = inputs.nodes(spark, sf_dir).withColumn("active", F.initcap(F.col("active").cast("string")))
    n.select("database_date", "database_line", "x", "y", "z", "active").write.csv(path)
    return read_nodes(spark, path).drop("idx")


def links_through_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK1: both files, read again."""
    folder = _folder(spark)
    write_links(sight.line_of_sight(spark, sf_dir), folder)
    return _links_of(spark, folder)


def snapped_through_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK2: how many points snapped, and the sums of where to."""
    path = f"{_folder(spark)}/snapped"
    write_snapped(sites.snapped_points(spark, sf_dir), path)
    return _snapped_sums(spark, path)


def corrections_through_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK3-SK4, SC19: lines of a corrections file, written twice and read once."""
    lines = sites.corrections_lines(spark, sf_dir)
    folder = _folder(spark)
    for _ in range(2):
        path = write_corrections(lines, folder, "tower", "user", "0")
    parts = F.split("line", ",")
    return read_corrections(spark, path).select(parts[1].cast("long").alias("database_line"), (parts[2] == "false").alias("bad"))


def _tile_folder(spark: SparkSession, sf_dir: str) -> tuple[str, list[str]]:
    folder = _folder(spark)
    written = rasters.write_tiles(raster.to_blocks(sight._pixels(spark, sf_dir), sight.BLOCK), folder, sight.PPT, sight.BLOCK)
    return folder, [r.file_name for r in written.collect()]  # a row for each tile of the region


def tiles_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC2-SC3, SF39: the derived raster as GeoTIFFs, read back as blocks."""
    folder, names = _tile_folder(spark, sf_dir)
    return sight.block_sums(rasters.read_tiles(spark, folder, sight.PPT, sight.BLOCK, names))


def sight_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KN7, SC1-SC3, SC9, SC20, SK1: nodes and GeoTIFFs in, clear and blocked links out, as on the command line."""
    folder, _ = _tile_folder(spark, sf_dir)
    nodes, out = _folder(spark), _folder(spark)
    n = inputs.nodes(spark, sf_dir).withColumn("active", F.initcap(F.col("active").cast("string")))
    # Links name the later node first, so the file is in order.
    n.select("database_date", "database_line", "x", "y", "z", "active").coalesce(1).sortWithinPartitions("database_line").write.csv(nodes)
    jobs.main(["sight", "--nodes", nodes, "--tiles", folder, "--output", out, "-m", str(sight.LINK_M), "--pixels", str(sight.PPT), "--block", str(sight.BLOCK)])
    return _links_of(spark, out)


def _links_of(spark: SparkSession, folder: str) -> DataFrame:
    read = lambda name: spark.read.schema("id1 long, id2 long, length_m double").csv(f"{folder}/{name}.csv")
    both = read("clear").withColumn("is_free", F.lit(True)).unionByName(read("blocked").withColumn("is_free", F.lit(False)))
    return both.withColumn("length_m", F.round("length_m", 5))


def partial_tiles_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC9-SC10: a folder of tiles, of which every third is there and every fifth is partial, after partial ones are deleted."""
    folder = local(_folder(spark))
    os.makedirs(folder)
    own = tiles.tile_files(sight._tiles(spark, sf_dir)).withColumn("k", F.col("tile_x") * 3 + F.col("tile_y"))
    for r in own.collect():
        for there, name in ((r.k % 3 == 0, r.file_name), (r.k % 5 == 0, f"temp_{r.file_name}")):
            if there:
                open(f"{folder}/{name}", "wb").close()
    n = rasters.delete_partial_tiles(spark, folder)
    return rasters.list_files(spark, folder).select("file_name", F.lit(n).cast("long").alias("deleted"))


def _points_file(spark: SparkSession, sf_dir: str) -> str:
    """Points with a header, further fields, rows that are none and blank lines."""
    path = _folder(spark)
    own = inputs.nodes(spark, sf_dir).select("database_line", F.concat_ws(",", "x", "y", F.lit("more")).alias("line"))
    junk = own.where("database_line % 10 = 0").select("database_line", F.explode(F.array(F.lit("n/a,1"), F.lit(""), F.lit("12"))).alias("line"))
    head = spark.createDataFrame([(-1, "X,Y,Z")], "database_line long, line string")
    head.unionByName(own).unionByName(junk).coalesce(1).sortWithinPartitions("database_line").select("line").write.text(path)
    return path


def points_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC11."""
    return tables.read_points(spark, _points_file(spark, sf_dir)).select("x", "y")


def _footprint_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Four files of footprints, and one that is no database."""
    folder = _folder(spark)
    own = sites._buildings(spark, sf_dir).select(F.format_string("part-%d", F.col("building_id") % 4).alias("source"), F.col("building_id").alias("fid"), "ring")
    paths = [r.path for r in write_geopackages(own, folder).collect()]
    broken = f"{local(folder)}/broken.gpkg"
    with open(broken, "wb") as f:
        f.write(b"no database")
    return [*paths, broken]


def footprints_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC12, PR13, SO1, AG12: footprints around a place out of all files that can be read."""
    x, y, r = 651_000.0, 6_861_000.0, 150.0
    found = footprints.require_some(footprints.read_footprints(spark, _footprint_files(spark, sf_dir), (x - r, y - r, x + r, y + r)))
    return found.select(F.col("fid").alias("building_id"), "x0", "y0", "x1", "y1")


def snap_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KN6, SC11-SC12, SC21, SK2: points and footprints in, snapped points out, as on the command line."""
    out = _folder(spark)
    jobs.main(["snap", "--points", _points_file(spark, sf_dir), "--footprints", *_footprint_files(spark, sf_dir), "--output", out])
    return _snapped_sums(spark, out)


def _snapped_sums(spark: SparkSession, path: str) -> DataFrame:
    back = spark.read.option("header", True).schema("x double, y double").csv(path)
    return back.agg(F.count("*").alias("points"), F.count("x").alias("snapped"), F.round(F.sum("x"), 1).alias("sum_x"), F.round(F.sum("y"), 1).alias("sum_y"))


def databases_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC13-SC15, JN10: departments of a GeoJSON file in degrees, databases of those even codes whose folders are there."""
    root = local(_folder(spark))
    os.makedirs(root)
    degrees = lambda v: F.struct(*[c.alias(n) for c, n in zip(geodesy.from_lambert93(v["x"], v["y"]), "xy")])
    own = sites._departments(spark, sf_dir).withColumn("ring", F.transform("ring", degrees)).withColumn("database", text.footprint_database(text.department(F.col("code")))).collect()  # a row for each department
    features = [{"type": "Feature", "properties": {"code": r.code}, "geometry": {"type": "Polygon", "coordinates": [[[p.x, p.y] for p in [*r.ring, r.ring[0]]]]}} for r in own]
    with open(f"{root}/departments.geojson", "w") as f:
        json.dump({"type": "FeatureCollection", "features": features}, f)
    for r in own:
        deep = f"{root}/{r.database}/{r.database}"
        os.makedirs(f"{deep}/0_DOCS")
        if int(r.code) % 2 == 0:
            os.makedirs(f"{deep}/1_DONNEES/first")
            open(f"{deep}/1_DONNEES/first/one.gpkg", "wb").close()
    have = footprints.present_databases(spark, root, [r.database for r in own])
    return snapping.databases(snapping.bounds(sites._points(spark, sf_dir)), tables.read_departments(spark, f"{root}/departments.geojson", 4326), have)


def _batch_root(spark: SparkSession, sf_dir: str) -> str:
    root = _folder(spark)
    t = neighbours.batches(links.number_rows(inputs.towers(spark, sf_dir).drop("idx"), "database_line"))
    write_batches(t.withColumn("tile_id", F.lit("0650_6861")), root).collect()
    return root


def batches_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC16-SC18: all batches, read back."""
    got = tables.read_batches(spark, f"{_batch_root(spark, sf_dir)}/*/*.csv")
    return got.select("input", F.col("batch").cast("int").alias("batch"), "idx", "database_date", "database_line", "tile_id", F.round("lng", 8).alias("lng"), F.round("lat", 8).alias("lat"), "altitude", "nature")


def batch_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC18: one batch by input and number; no other file is opened."""
    return tables.read_batch(spark, _batch_root(spark, sf_dir), "tower", "1").select("batch", "idx", "database_line")


def refused_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR15: what is said of inputs without anything to work on."""
    folder, said = _folder(spark), []
    spark.createDataFrame([("X,Y",)], "value string").write.text(f"{folder}/points")
    paths = _footprint_files(spark, sf_dir)
    for name, run in (
        ("points", lambda: jobs.snap_job(spark, f"{folder}/points", paths, f"{folder}/out")),
        ("footprints", lambda: footprints.require_some(footprints.read_footprints(spark, paths[-1:]))),
    ):
        try:
            run()
        except ValueError as e:
            said.append((name, str(e)))
    return spark.createDataFrame(said, "input string, error string")


QUERIES = {
    f.__name__: f
    for f in (
        nodes_from_file, links_through_files, snapped_through_files, corrections_through_files, tiles_from_files, sight_from_files, partial_tiles_deleted,
        points_from_file, footprints_from_files, snap_from_files, databases_from_files, batches_from_files, batch_from_file, refused_inputs,
    )
}
SQL = {
    "tiles_from_files": sight.SQL["raster_blocks"],
    "sight_from_files": sight.SQL["line_of_sight"],
    "partial_tiles_deleted": f"{sight._STATES} SELECT file_name, (SELECT count(*) FILTER (part) FROM named) AS deleted FROM named WHERE have",
    "points_from_file": f"SELECT x, y FROM ({inputs.NODES_SQL})",
    "footprints_from_files": sites.SQL["footprints_in_view"],
    "databases_from_files": sites.SQL["needed_databases"],
    "batches_from_files": f"""WITH t AS (SELECT *, row_number() OVER (ORDER BY database_line) - 1 AS i FROM ({inputs.TOWERS_SQL}))
SELECT 'tower' AS input, CAST(i // 100 AS INTEGER) AS batch, i % 100 AS idx, database_date, database_line, '0650_6861' AS tile_id, round(lng, 8) AS lng, round(lat, 8) AS lat, altitude, nature FROM t""",
    "batch_from_file": f"""WITH t AS (SELECT *, row_number() OVER (ORDER BY database_line) - 1 AS i FROM ({inputs.TOWERS_SQL}))
SELECT '1' AS batch, i % 100 AS idx, database_line FROM t WHERE i // 100 = 1""",
    "refused_inputs": "SELECT * FROM (VALUES ('points', 'no point to snap'), ('footprints', 'no footprint could be read')) v(input, error)",
    "snap_from_files": f"SELECT count(*) AS points, count(snapped_x) AS snapped, round(sum(snapped_x), 1) AS sum_x, round(sum(snapped_y), 1) AS sum_y FROM ({sites.SQL['snapped_points']})",
    "nodes_from_file": f"SELECT database_date, database_line, x, y, z, active FROM ({inputs.NODES_SQL})",
    "links_through_files": sight.SQL["line_of_sight"],
    "snapped_through_files": f"SELECT count(*) AS points, count(snapped_x) AS snapped, round(sum(snapped_x), 1) AS sum_x, round(sum(snapped_y), 1) AS sum_y FROM ({sites.SQL['snapped_points']})",
    "corrections_through_files": f"SELECT database_line, bad FROM ({sites.SQL['serialized_changes']})",
}
