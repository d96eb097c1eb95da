"""Queries of the line-of-sight part, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import inputs
from ridgeline.functions import rays, text, transforms
from ridgeline.functions import traversal as tv
from ridgeline.operators import crossings, links, raster, tile_rays, tiles, visibility

LINK_M = 300.0
PPT, BLOCK = inputs.PPT, 10


def _links(spark: SparkSession, sf_dir: str, limit: float = LINK_M) -> DataFrame:
    return links.link_nodes(inputs.nodes(spark, sf_dir), limit)


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.region_tiles(links.region(inputs.nodes(spark, sf_dir)))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.pixels(_tiles(spark, sf_dir))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_rays.clip_to_tiles(_links(spark, sf_dir), PPT)


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def node_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC1, JN1-JN2, PR1-PR3, PR6, SF1-SF2, SF19."""
    return _rounded(_links(spark, sf_dir, 1000.0).select("id1", "id2", "length_m"))


def node_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR3-PR4, SF9-SF11: rays, their middles' sub-rays and ends in pixels."""
    d = _links(spark, sf_dir)
    r = rays.Ray(*[F.col(c) for c in ("sx", "sy", "dx", "dy", "sz", "dz")])
    half = r.sub(F.lit(0.5), F.lit(1.0)).scale_xy(float(PPT))
    ex, ey, ez = half.end()
    flat = half.flat()
    return _rounded(d.select("id1", "id2", half.sx.alias("half_x"), half.sy.alias("half_y"), half.sz.alias("half_z"), ex.alias("end_x"), ey.alias("end_y"), ez.alias("end_z"), flat.length().alias("half_length")), 4)


def node_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG1, AG8, SF5."""
    return links.region(inputs.nodes(spark, sf_dir))


def region_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO3, SC5-SC7: tiles with their file names and requested bounds."""
    b = text.tile_bounds(F.col("tile_x"), F.col("tile_y"))
    return tiles.tile_files(_tiles(spark, sf_dir)).withColumns({k: v.cast("double") for k, v in b.items()})


def coordinate_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF2-SF6, SF39: every node in every space, and back."""
    n = inputs.nodes(spark, sf_dir)
    x, y = F.col("x"), transforms.node_y(F.col("y"))
    tx, ty = transforms.model_to_tile(x, y)
    px, py = transforms.model_to_pixel(x, y)
    tile_x, in_x = transforms.split(tx)
    tile_y, in_y = transforms.split(ty)
    bx, by = transforms.tile_to_model(transforms.combine(tile_x, in_x), transforms.combine(tile_y, in_y))
    index = transforms.raster_index(F.floor(in_x), F.floor(in_y), 2000, 2000)
    return _rounded(
        n.select(
            "database_line", tx.alias("tile_space_x"), ty.alias("tile_space_y"), px.alias("pixel_x"), py.alias("pixel_y"), tile_x.alias("tile_x"), tile_y.alias("tile_y"),
            in_x.alias("in_x"), in_y.alias("in_y"), bx.alias("back_x"), by.alias("back_y"), index.cast("long").alias("raster_index"),
        ),
        4,
    )


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF4, SF39-SF40: pixels to tiles and back, places in a raster and back, wheel turns to metres."""
    n = inputs.nodes(spark, sf_dir)
    px, py = transforms.model_to_pixel(F.col("x"), transforms.node_y(F.col("y")))
    tx, ty = transforms.pixel_to_tile(px, py)
    bx, by = transforms.tile_to_pixel(tx, ty)
    column, row = transforms.raster_position(F.col("database_line") % (2000 * 2000), 2000, 2000)
    wheel = text.wheel_altitude((F.col("database_line") % 700).cast("double") - 350)
    return _rounded(n.select("database_line", tx.alias("tile_x"), ty.alias("tile_y"), bx.alias("back_x"), by.alias("back_y"), column.cast("long").alias("column"), row.cast("long").alias("row"), wheel.alias("altitude_step")), 5)


def tile_ray_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN3-JN4, SF7-SF8, SF17, PR5."""
    return _rounded(_pieces(spark, sf_dir), 5)


def curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF7 at the quarter, middle and end of each link."""
    d = _links(spark, sf_dir)
    return _rounded(d.select("id1", "id2", *[rays.curvature_drop(F.lit(t), F.col("length_m")).alias(n) for n, t in (("quarter", 0.25), ("middle", 0.5), ("end", 1.0))]), 8)


def traversal_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF12-SF16: what a traversal of each piece starts from."""
    d = _pieces(spark, sf_dir)
    sx, sy, dx, dy = (F.col(c) for c in ("px", "py", "pdx", "pdy"))
    tx, ty = tv.first_t(sx, dx), tv.first_t(sy, dy)
    return _rounded(
        d.select(
            "id1", "id2", "tile_x", "tile_y", tv.first_pixel(sx, dx).alias("pixel_x"), tv.first_pixel(sy, dy).alias("pixel_y"), tv.step(dx).alias("step_x"), tv.step(dy).alias("step_y"),
            tv.integers_between(sx, sx + dx).alias("crossings_x"), tv.integers_between(sy, sy + dy).alias("crossings_y"),
            F.round(F.least(tx, ty), 6).alias("first_t"), tv.boundary_type(tx, ty).alias("first_boundary"),
        )
    )


def pixel_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KN1-KN2, WN3-WN4, SO2: pixels per piece, in set form with running sums."""
    key = ["id1", "id2", "tile_x", "tile_y"]
    seg = crossings.pixel_segments(_pieces(spark, sf_dir), key, "px", "py", "pdx", "pdy")
    return seg.groupBy(*key).agg(F.count("*").alias("pixels"), F.sum("pixel_x").alias("sum_x"), F.sum("pixel_y").alias("sum_y"), F.round(F.sum(F.col("end_t") - F.col("start_t")), 6).alias("covered"))


def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KN3, JN5-JN6, SF18, AG5, LM1: where each piece first meets the raster."""
    hits = visibility.first_hits(_pieces(spark, sf_dir), _pixels(spark, sf_dir), PPT)
    return hits.select("id1", "id2", "tile_x", "tile_y", F.round("hit_t", 5).alias("hit_t"))


def raster_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG3, KN5: levels 50, 10 and 8."""
    return raster.pyramid(_pixels(spark, sf_dir), (50, 10, 8)).withColumn("h", F.col("h").cast("double"))


def raster_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KN5, SF39: blocks as arrays, told by sum, first and last height."""
    return block_sums(raster.to_blocks(_pixels(spark, sf_dir), BLOCK))


def block_sums(b: DataFrame) -> DataFrame:
    total = F.aggregate("heights", F.lit(0.0), lambda a, h: a + h)
    return b.select("tile_x", "tile_y", "bx", "by", total.alias("total"), F.element_at("heights", 1).cast("double").alias("first_h"), F.element_at("heights", -1).cast("double").alias("last_h"), F.col("top").cast("double").alias("top"))


def heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK5, SF37."""
    return raster.heat_map(_pixels(spark, sf_dir), 60.0).groupBy("tile_x", "tile_y", "red", "green", "blue").agg(F.count("*").alias("n"))


def _sight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.sight_of_nodes(inputs.nodes(spark, sf_dir), raster.to_blocks(_pixels(spark, sf_dir), BLOCK), LINK_M, PPT, BLOCK)


def line_of_sight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KN4, KN7, AG4, JN7: the flagship, through the cascade."""
    return _rounded(_sight(spark, sf_dir), 5)


def line_of_sight_by_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KN3, AG4: every pixel, no cascade."""
    return _rounded(visibility.line_of_sight_by_pixel(_links(spark, sf_dir), _pixels(spark, sf_dir), PPT), 5)


def clear_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR7, SK1."""
    return _rounded(visibility.clear_links(_sight(spark, sf_dir)), 5)


def blocked_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR7, SK1."""
    return _rounded(visibility.blocked_links(_sight(spark, sf_dir)), 5)


def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG6-AG7, SK6."""
    return visibility.run_statistics(visibility.count_sight(inputs.nodes(spark, sf_dir), raster.to_blocks(_pixels(spark, sf_dir), BLOCK), LINK_M, PPT, BLOCK))


def tile_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC9, JN15, SO4: of the derived files every third is there and every fifth is partial."""
    own = tiles.tile_files(_tiles(spark, sf_dir)).withColumn("k", F.col("tile_x") * 3 + F.col("tile_y"))
    files = own.where("k % 3 = 0").select("file_name").unionByName(own.where("k % 5 = 0").select(F.concat(F.lit("temp_"), "file_name").alias("file_name")))
    return tiles.availability(_tiles(spark, sf_dir), files)


def missing_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG9, SF38."""
    return tiles.missing_size(tile_availability(spark, sf_dir))


def map_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC6: one request for each tile."""
    return _tiles(spark, sf_dir).select("tile_x", "tile_y", text.map_request("https://maps.example.org/wms", "SURFACE", F.col("tile_x"), F.col("tile_y")).alias("request"))


QUERIES = {
    f.__name__: f
    for f in (
        line_of_sight, node_links, node_rays, node_region, region_tiles, coordinate_spaces, scalar_functions, tile_ray_pieces, curvature, traversal_variables, pixel_segments,
        first_hits, raster_pyramid, raster_blocks, heat_map, line_of_sight_by_pixel, clear_links, blocked_links, run_statistics,
        tile_availability, missing_tiles, map_requests,
    )
}

_NODES = f"WITH nodes AS (SELECT *, (x + 0.25e0) / 1000e0 AS tx, (y + 1000e0) / 1000e0 AS ty FROM ({inputs.NODES_SQL}))"


def _links_sql(limit: float) -> str:
    return f"""{_NODES}, links AS (
    SELECT a.database_line AS id1, b.database_line AS id2, a.tx AS sx, a.ty AS sy, a.z AS sz, b.tx - a.tx AS dx, b.ty - a.ty AS dy, b.z - a.z AS dz,
           sqrt((b.tx - a.tx) * (b.tx - a.tx) + (b.ty - a.ty) * (b.ty - a.ty)) * 1000e0 AS length_m
    FROM nodes a JOIN nodes b ON a.idx > b.idx AND (a.active OR b.active)
     AND (b.tx - a.tx) * (b.tx - a.tx) + (b.ty - a.ty) * (b.ty - a.ty) <= {limit / 1000}e0 * {limit / 1000}e0
)"""


_DROP = "{t} * length_m * (1e0 - {t}) * length_m * (0.5e0 / (6371000e0 * 1.13e0))"
_TILES = f"""{_NODES}, tiles AS (
    SELECT CAST(tile_x AS INTEGER) AS tile_x, CAST(unnest(range(y0, y1 + 1)) AS INTEGER) AS tile_y
    FROM (SELECT unnest(range(x0, x1 + 1)) AS tile_x, y0, y1
          FROM (SELECT CAST(floor(min(tx)) AS BIGINT) AS x0, CAST(floor(max(tx)) AS BIGINT) AS x1, CAST(floor(min(ty)) AS BIGINT) AS y0, CAST(floor(max(ty)) AS BIGINT) AS y1 FROM nodes))
)"""
_PIXELS = f"""{_TILES}, pixels AS (
    SELECT tile_x, tile_y, px, py, {inputs.HEIGHT_SQL} AS h
    FROM (SELECT tile_x, tile_y, px, py, CAST(tile_x AS BIGINT) * {PPT} + px AS gx, CAST(tile_y AS BIGINT) * {PPT} + py AS gy
          FROM tiles, (SELECT unnest(range(0, {PPT})) AS px), (SELECT unnest(range(0, {PPT})) AS py))
)"""


def _into(s: str, e: str, d: str, tile: str) -> tuple[str, str]:
    return (
        f"CASE WHEN {s} < {tile} THEN abs(1e0 / {d}) * ({tile} - {s}) WHEN {s} > {tile} + 1 THEN abs(1e0 / {d}) * ({s} - ({tile} + 1)) ELSE 0e0 END",
        f"CASE WHEN {e} < {tile} THEN 1e0 - abs(1e0 / {d}) * ({tile} - {e}) WHEN {e} > {tile} + 1 THEN 1e0 - abs(1e0 / {d}) * ({e} - ({tile} + 1)) ELSE 1e0 END",
    )


_IX, _OX = _into("sx", "ex", "dx", "tile_x")
_IY, _OY = _into("sy", "ey", "dy", "tile_y")


def _at(s: str, d: str, tile: str, t: str) -> str:
    return f"greatest(0e0, least({PPT}e0, (({s} + {t} * {d}) - {tile}) * {PPT}e0))"


_PIECES = f"""{_links_sql(LINK_M)}, spans AS (
    SELECT *, sx + dx AS ex, sy + dy AS ey FROM links
), crossed AS (
    SELECT *, unnest(range(CAST(floor(least(sy, ey)) AS BIGINT), CAST(floor(greatest(sy, ey)) AS BIGINT) + 1)) AS tile_y
    FROM (SELECT *, unnest(range(CAST(floor(least(sx, ex)) AS BIGINT), CAST(floor(greatest(sx, ex)) AS BIGINT) + 1)) AS tile_x FROM spans)
), clipped AS (
    SELECT *, greatest(0e0, {_IX}, {_IY}) AS start_t, least(1e0, {_OX}, {_OY}) AS end_t FROM crossed
), placed AS (
    SELECT id1, id2, tile_x, tile_y, start_t, end_t,
           {_at('sx', 'dx', 'tile_x', 'start_t')} AS px, {_at('sy', 'dy', 'tile_y', 'start_t')} AS py,
           {_at('sx', 'dx', 'tile_x', 'end_t')} AS qx, {_at('sy', 'dy', 'tile_y', 'end_t')} AS qy,
           sz + dz * start_t - {_DROP.format(t='start_t')} AS pz, sz + dz * end_t - {_DROP.format(t='end_t')} AS qz
    FROM clipped WHERE start_t + 1e-9 < end_t
), pieces AS (
    SELECT id1, id2, CAST(tile_x AS INTEGER) AS tile_x, CAST(tile_y AS INTEGER) AS tile_y, start_t, end_t, px, py, pz, qx - px AS pdx, qy - py AS pdy, qz - pz AS pdz FROM placed
)"""


def _crossings(axis: str) -> str:
    s, d = f"p{axis}", f"pd{axis}"
    dist = f"CASE WHEN {d} >= 0 THEN floor({s}) - {s} + 1e0 ELSE {s} - ceil({s}) + 1e0 END"
    n = f"greatest(0, CAST(ceil(greatest({s}, {s} + {d})) - floor(least({s}, {s} + {d})) - 1 AS BIGINT))"
    return f"SELECT p, abs(1e0 / {d}) * ({dist}) + k * abs(1e0 / {d}) AS t FROM (SELECT *, unnest(range(0, {n})) AS k FROM numbered WHERE {d} <> 0)"


_SEGMENTS = f"""{_PIECES}, numbered AS (
    SELECT *, row_number() OVER (ORDER BY id1, id2, tile_x, tile_y) AS p FROM pieces
), times AS (
    SELECT p, 0e0 AS t FROM numbered UNION SELECT * FROM ({_crossings('x')}) WHERE t > 0 AND t < 1 UNION SELECT * FROM ({_crossings('y')}) WHERE t > 0 AND t < 1
), stretches AS (
    SELECT p, t AS t0, coalesce(lead(t) OVER (PARTITION BY p ORDER BY t), 1e0) AS t1 FROM times
), segments AS (
    SELECT n.id1, n.id2, n.tile_x, n.tile_y, s.t0, s.t1,
           CAST(greatest(0, least({PPT - 1}, floor(n.px + (s.t0 + s.t1) / 2 * n.pdx))) AS BIGINT) AS px,
           CAST(greatest(0, least({PPT - 1}, floor(n.py + (s.t0 + s.t1) / 2 * n.pdy))) AS BIGINT) AS py,
           n.pz + CASE WHEN n.pdz >= 0 THEN s.t0 ELSE s.t1 END * n.pdz AS low
    FROM stretches s JOIN numbered n USING (p)
), heights AS (
    SELECT *, {inputs.HEIGHT_SQL} AS h FROM (SELECT *, CAST(tile_x AS BIGINT) * {PPT} + px AS gx, CAST(tile_y AS BIGINT) * {PPT} + py AS gy FROM segments)
)"""
_SIGHT = f"""{_SEGMENTS}, met AS (
    SELECT DISTINCT id1, id2 FROM heights WHERE h >= CAST(low AS FLOAT)
), sight AS (
    SELECT l.id1, l.id2, l.length_m, m.id1 IS NULL AS is_free FROM links l LEFT JOIN met m ON l.id1 = m.id1 AND l.id2 = m.id2
)"""
_FILE = "printf('LHD_FXX_%04d_%04d_MNS_O_0M50_LAMB93_IGN69.tif', tile_x, tile_y)"
_STATES = f"""{_TILES}, named AS (
    SELECT *, {_FILE} AS file_name, (tile_x * 3 + tile_y) % 3 = 0 AS have, (tile_x * 3 + tile_y) % 5 = 0 AS part FROM tiles
), states AS (
    SELECT tile_x, tile_y, file_name, CASE WHEN have THEN 'present' WHEN part THEN 'partial' ELSE 'missing' END AS state FROM named
)"""


def _pyramid_sql() -> str:
    parts = [
        f"SELECT tile_x, tile_y, {k} AS level, CAST(px // {k} AS INTEGER) AS bx, CAST(py // {k} AS INTEGER) AS by, CAST(max(h) AS DOUBLE) AS h FROM pixels GROUP BY ALL"
        for k in (50, 10, 8)
    ]
    return f"{_PIXELS} " + " UNION ALL ".join(parts)


_LENGTH = "round(length_m, 5) AS length_m"
SQL = {
    "node_links": f"{_links_sql(1000.0)} SELECT id1, id2, round(length_m, 6) AS length_m FROM links",
    "node_rays": f"""{_links_sql(LINK_M)}
SELECT id1, id2, round((sx + 0.5e0 * dx) * {PPT}, 4) AS half_x, round((sy + 0.5e0 * dy) * {PPT}, 4) AS half_y, round(sz + 0.5e0 * dz, 4) AS half_z,
       round((sx + dx) * {PPT}, 4) AS end_x, round((sy + dy) * {PPT}, 4) AS end_y, round(sz + dz, 4) AS end_z, round(length_m / 2000e0 * {PPT}, 4) AS half_length FROM links""",
    "node_region": f"""{_NODES}, r AS (SELECT CAST(floor(min(tx)) AS INTEGER) AS x_min, CAST(floor(max(tx)) AS INTEGER) AS x_max, CAST(floor(min(ty)) AS INTEGER) AS y_min, CAST(floor(max(ty)) AS INTEGER) AS y_max FROM nodes)
SELECT *, CAST(x_max - x_min + 1 AS BIGINT) * (y_max - y_min + 1) AS area FROM r""",
    "region_tiles": f"""{_TILES} SELECT tile_x, tile_y, {_FILE} AS file_name,
       CAST(CAST(tile_x * 1000 AS FLOAT) - CAST(0.25 AS FLOAT) AS DOUBLE) AS x_min, CAST(CAST((tile_y - 1) * 1000 AS FLOAT) + CAST(0.25 AS FLOAT) AS DOUBLE) AS y_min,
       CAST(CAST((tile_x + 1) * 1000 AS FLOAT) - CAST(0.25 AS FLOAT) AS DOUBLE) AS x_max, CAST(CAST(tile_y * 1000 AS FLOAT) + CAST(0.25 AS FLOAT) AS DOUBLE) AS y_max FROM tiles""",
    "coordinate_spaces": f"""{_NODES}, t AS (SELECT *, floor(tx) AS fx, floor(ty) AS fy FROM nodes)
SELECT database_line, round(tx, 4) AS tile_space_x, round(ty, 4) AS tile_space_y, round((x + 0.25e0) * 2e0, 4) AS pixel_x, round((y + 1000e0) * 2e0, 4) AS pixel_y,
       CAST(fx AS INTEGER) AS tile_x, CAST(fy AS INTEGER) AS tile_y, round((tx - fx) * 2000e0, 4) AS in_x, round((ty - fy) * 2000e0, 4) AS in_y,
       round(x, 4) AS back_x, round(y + 1000e0, 4) AS back_y,
       CAST((1999 - floor((ty - fy) * 2000e0)) * 2000 + floor((tx - fx) * 2000e0) AS BIGINT) AS raster_index FROM t""",
    "scalar_functions": f"""{_NODES} SELECT database_line, round((x + 0.25e0) * 2e0 / 2000e0, 5) AS tile_x, round((y + 1000e0) * 2e0 / 2000e0, 5) AS tile_y, round((x + 0.25e0) * 2e0, 5) AS back_x, round((y + 1000e0) * 2e0, 5) AS back_y,
       database_line % 4000000 % 2000 AS "column", 1999 - database_line % 4000000 // 2000 AS "row", round((database_line % 700 - 350) / 80e0, 5) AS altitude_step FROM nodes""",
    "tile_ray_pieces": f"""{_PIECES} SELECT id1, id2, tile_x, tile_y, {', '.join(f'round({c}, 5) AS {c}' for c in ('start_t', 'end_t', 'px', 'py', 'pz', 'pdx', 'pdy', 'pdz'))} FROM pieces""",
    "curvature": f"""{_links_sql(LINK_M)} SELECT id1, id2, {', '.join(f'round({_DROP.format(t=t)}, 8) AS {n}' for n, t in (('quarter', '0.25e0'), ('middle', '0.5e0'), ('"end"', '1e0')))} FROM links""",
    "traversal_variables": f"""{_PIECES}, v AS (
    SELECT *, abs(1e0 / pdx) * CASE WHEN pdx >= 0 THEN floor(px) - px + 1 ELSE px - ceil(px) + 1 END AS t_x, abs(1e0 / pdy) * CASE WHEN pdy >= 0 THEN floor(py) - py + 1 ELSE py - ceil(py) + 1 END AS t_y FROM pieces
)
SELECT id1, id2, tile_x, tile_y, CAST(CASE WHEN pdx >= 0 THEN floor(px) ELSE ceil(px) - 1 END AS INTEGER) AS pixel_x, CAST(CASE WHEN pdy >= 0 THEN floor(py) ELSE ceil(py) - 1 END AS INTEGER) AS pixel_y,
       CASE WHEN pdx < 0 THEN -1 ELSE 1 END AS step_x, CASE WHEN pdy < 0 THEN -1 ELSE 1 END AS step_y,
       CAST(greatest(0, ceil(greatest(px, px + pdx)) - floor(least(px, px + pdx)) - 1) AS INTEGER) AS crossings_x, CAST(greatest(0, ceil(greatest(py, py + pdy)) - floor(least(py, py + pdy)) - 1) AS INTEGER) AS crossings_y,
       round(least(t_x, t_y), 6) AS first_t, CASE WHEN isnan(t_x) OR isnan(t_y) THEN 'XY' WHEN t_x < t_y THEN 'X' WHEN t_x > t_y THEN 'Y' ELSE 'XY' END AS first_boundary FROM v""",
    "pixel_segments": f"""{_SEGMENTS} SELECT id1, id2, tile_x, tile_y, count(*) AS pixels, CAST(sum(px) AS BIGINT) AS sum_x, CAST(sum(py) AS BIGINT) AS sum_y, round(sum(t1 - t0), 6) AS covered FROM segments GROUP BY ALL""",
    "first_hits": f"""{_SEGMENTS} SELECT id1, id2, tile_x, tile_y, round(min(t0), 5) AS hit_t FROM heights WHERE h >= CAST(low AS FLOAT) GROUP BY ALL""",
    "raster_pyramid": _pyramid_sql(),
    "raster_blocks": f"""{_PIXELS} SELECT tile_x, tile_y, CAST(px // {BLOCK} AS INTEGER) AS bx, CAST(py // {BLOCK} AS INTEGER) AS by, CAST(sum(h) AS DOUBLE) AS total,
       CAST(min_by(h, py * {PPT} + px) AS DOUBLE) AS first_h, CAST(max_by(h, py * {PPT} + px) AS DOUBLE) AS last_h, CAST(max(h) AS DOUBLE) AS top
FROM (SELECT tile_x, tile_y, px, py, h FROM pixels) GROUP BY tile_x, tile_y, px // {BLOCK}, py // {BLOCK}""",
    "heat_map": f"""{_PIXELS}, s AS (SELECT tile_x, tile_y, h >= 60 AS hot, CAST(least(255, greatest(0, floor(CAST(h AS DOUBLE) / 60e0 * 255))) AS INTEGER) AS g FROM pixels)
SELECT tile_x, tile_y, CASE WHEN hot THEN 255 ELSE g END AS red, CASE WHEN hot THEN 0 ELSE g END AS green, CASE WHEN hot THEN 0 ELSE g END AS blue, count(*) AS n FROM s GROUP BY ALL""",
    "line_of_sight": f"{_SIGHT} SELECT id1, id2, {_LENGTH}, is_free FROM sight",
    "line_of_sight_by_pixel": f"{_SIGHT} SELECT id1, id2, {_LENGTH}, is_free FROM sight",
    "clear_links": f"{_SIGHT} SELECT id1, id2, {_LENGTH} FROM sight WHERE is_free",
    "blocked_links": f"{_SIGHT} SELECT id1, id2, {_LENGTH} FROM sight WHERE NOT is_free",
    "run_statistics": f"""{_SIGHT}, a AS (SELECT count(*) AS links, count(*) FILTER (is_free) AS free FROM sight), b AS (SELECT count(*) AS tile_rays FROM pieces)
SELECT links, free, round(free / links * 100e0, 6) AS free_percent, tile_rays, round(tile_rays / links, 6) AS tile_rays_per_link FROM a, b""",
    "tile_availability": f"{_STATES} SELECT * FROM states",
    "missing_tiles": f"""{_STATES}, c AS (SELECT count(*) AS total_tiles, count(*) FILTER (state <> 'present') AS missing_tiles, count(*) FILTER (state = 'partial') AS partial_tiles FROM states)
SELECT *, missing_tiles * 16000000 AS missing_bytes,
       CASE WHEN missing_tiles * 16000000 >= 1000000000 THEN printf('%.2f GB', missing_tiles * 16000000 / 1e9) WHEN missing_tiles > 0 THEN printf('%.2f MB', missing_tiles * 16000000 / 1e6) ELSE '0 B' END AS missing_size FROM c""",
    "map_requests": f"""{_TILES} SELECT tile_x, tile_y,
       'https://maps.example.org/wms?SERVICE=WMS&VERSION=1.3.0&REQUEST=GetMap&FORMAT=image/geotiff&LAYERS=SURFACE&CRS=EPSG:2154&WIDTH=2000&HEIGHT=2000&STYLES=&BBOX='
       || printf('%.2f,%.2f,%.2f,%.2f', CAST(CAST(tile_x * 1000 AS FLOAT) - CAST(0.25 AS FLOAT) AS DOUBLE), CAST(CAST((tile_y - 1) * 1000 AS FLOAT) + CAST(0.25 AS FLOAT) AS DOUBLE),
                 CAST(CAST((tile_x + 1) * 1000 AS FLOAT) - CAST(0.25 AS FLOAT) AS DOUBLE), CAST(CAST(tile_y * 1000 AS FLOAT) + CAST(0.25 AS FLOAT) AS DOUBLE))
       || '&FILENAME=' || {_FILE} AS request FROM tiles""",
}
