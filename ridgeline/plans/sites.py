"""Queries of sites: neighbours, corrections, snapping and the link graph, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import inputs
from ridgeline.functions import geodesy, geometry, text
from ridgeline.operators import corrections, graph, links, neighbours, pair_counts, snapping
from ridgeline.plans.sight import _links_sql
from ridgeline.sources.natures import natures, rows

RADIUS_M = 100.0
GRAPH_M = 110.0


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def site_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN11, PR9-PR10, SF29-SF32."""
    return _rounded(neighbours.neighbours(inputs.towers(spark, sf_dir), RADIUS_M), 5)


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view for every tower, up to 44 m north of it: some are out of reach."""
    t = inputs.towers(spark, sf_dir)
    return t.select(F.col("database_line").alias("view_id"), (F.col("lat") + (F.col("database_line") % 5) * 0.0001).alias("lat"), F.col("lng"))


def nearest_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN14, SF30-SF31, SF36: the view of each tower and its address."""
    found = neighbours.nearest_view(inputs.towers(spark, sf_dir), _views(spark, sf_dir))
    address = text.view_address("https://view.example.org/embed", text.fixed(F.col("view_lat"), 5), text.fixed(F.col("view_lng"), 5), text.fixed(F.col("heading_deg"), 2), text.fixed(F.col("pitch_deg"), 2))
    return _rounded(found.select("database_line", "view_id", "distance_m", "heading_deg", "pitch_deg", address.alias("address")), 5)


def site_natures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN12: towers with their kind of support, null where the code is unknown."""
    return neighbours.with_nature(inputs.towers(spark, sf_dir), natures(spark)).select("database_line", "nature", "fr", "en")


def site_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LM3, WN1-WN2: batches of 100 in input order, with the cyclic neighbours in each."""
    t = links.number_rows(inputs.towers(spark, sf_dir).drop("idx"), "database_line")
    return neighbours.cyclic(neighbours.batches(t), ["batch"], "index", "database_line").select("database_line", "batch", "index", "next_database_line", "previous_database_line")


def lambert_93(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF24: towers projected and back, with the tile they lie in."""
    t = inputs.towers(spark, sf_dir)
    x, y = geodesy.to_lambert93(F.col("lng"), F.col("lat"))
    t = t.withColumns({"x": x, "y": y})
    lng, lat = geodesy.from_lambert93(F.col("x"), F.col("y"))
    tile = F.format_string("%04d_%04d", F.floor(F.col("x") / 1000), F.floor(F.col("y") / 1000) + 1)
    return t.select("database_line", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(lng, 8).alias("lng"), F.round(lat, 8).alias("lat"), tile.alias("tile_id"))


def folded_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG10."""
    return _rounded(corrections.fold_changes(inputs.changes(spark, sf_dir)), 8)


def changed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF33, SF35."""
    out = corrections.changed_positions(inputs.towers(spark, sf_dir), corrections.fold_changes(inputs.changes(spark, sf_dir)))
    label = F.when(F.col("status") == "bad", "Bad tower").when(F.col("status") == "changed", text.change_label(F.col("new_lat"), F.col("new_lng"), F.col("new_altitude")))
    return _rounded(out.withColumn("label", label), 8)


def stored_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF34: offsets of a chosen centre."""
    t = inputs.towers(spark, sf_dir)
    centres = t.select("database_line", (F.col("lat") + 0.0001).alias("lat"), (F.col("lng") - 0.0002).alias("lng"))
    return _rounded(corrections.offsets_from_centre(t, centres), 8)


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = links.number_rows(inputs.towers(spark, sf_dir).drop("idx"), "database_line")
    return t, corrections.serialize(t, corrections.fold_changes(inputs.changes(spark, sf_dir)))


def corrections_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir)[1]


def serialized_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK3, PR11, told by site: date, line number and what follows."""
    parts = F.split("line", ",")
    number = lambda k: F.round(F.try_element_at(parts, F.lit(k)).try_cast("double"), 8)
    return _files(spark, sf_dir)[1].select("idx", parts[0].alias("date"), parts[1].cast("long").alias("database_line"), (parts[2] == "false").alias("bad"), number(3).alias("d_lon"), number(4).alias("d_lat"), number(5).alias("d_alt"))


def parsed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN13, PR12, PR16, SC19: what was written, read back."""
    t, lines = _files(spark, sf_dir)
    return _rounded(corrections.parse(lines.withColumnRenamed("idx", "seq"), t), 8)


def parsed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG11, WN6."""
    t, lines = _files(spark, sf_dir)
    return corrections.parsed_summary(corrections.parse(lines.withColumnRenamed("idx", "seq"), t), t.count())


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.nodes(spark, sf_dir).select(F.col("database_line").alias("point_id"), "x", "y")


def _buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = inputs.buildings(spark, sf_dir).withColumns({"x1": F.col("x0") + F.col("w"), "y1": F.col("y0") + F.col("d")})
    return b.withColumn("ring", geometry.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


def point_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG2."""
    return _rounded(snapping.bounds(_points(spark, sf_dir)))


def nearest_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN8, SF25-SF26."""
    return _rounded(snapping.nearest_buildings(_points(spark, sf_dir), _buildings(spark, sf_dir)), 5)


def snapped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KN6, JN9, SF27, WN5."""
    return _rounded(snapping.snap(_points(spark, sf_dir), _buildings(spark, sf_dir)), 5)


def footprints_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR8: footprints that touch the view around a place, 150 m each way."""
    x, y, r = 651_000.0, 6_861_000.0, 150.0
    return snapping.in_box(_buildings(spark, sf_dir), x - r, y - r, x + r, y + r).select("building_id", "x0", "y0", "x1", "y1")


def _departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("k", F.col("n_nationkey").cast("double"))
    x0, y0 = 646_000.0 + (F.col("k") % 5) * 2000.0, 6_856_000.0 + F.floor(F.col("k") / 5) * 2000.0
    return n.select(F.col("n_nationkey").cast("string").alias("code"), geometry.box_ring(x0, y0, x0 + 1500.0, y0 + 1500.0).alias("ring"))


def needed_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC14, JN10, SF22-SF23, SF28, SO4: databases around the points; those of even codes are there."""
    d = _departments(spark, sf_dir)
    have = d.where("cast(code as int) % 2 = 0").select(text.footprint_database(text.department(F.col("code"))).alias("database"))
    return snapping.databases(snapping.bounds(_points(spark, sf_dir)), d, have)


def _graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.link_nodes(inputs.nodes(spark, sf_dir), GRAPH_M)


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(_graph_links(spark, sf_dir).select(F.col("id1").alias("a"), F.col("id2").alias("b")))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR2."""
    return _components(spark, sf_dir)


def region_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR1: nodes of each tile and the links that start there."""
    n = links.place_nodes(inputs.nodes(spark, sf_dir)).select(F.col("database_line").alias("id1"), F.floor("tx").cast("int").alias("tile_x"), F.floor("ty").cast("int").alias("tile_y"))
    per = _graph_links(spark, sf_dir).groupBy("id1").agg(F.count("*").alias("links"))
    return n.join(per, "id1", "left").groupBy("tile_x", "tile_y").agg(F.count("*").alias("nodes"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))


def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR5."""
    return pair_counts.node_degrees(inputs.nodes(spark, sf_dir), 300.0)


def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR5."""
    return pair_counts.link_lengths(inputs.nodes(spark, sf_dir), 1000.0, 20)


def component_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR3: outline of each component; sequential geometry, so rows only."""
    placed = _components(spark, sf_dir).join(inputs.nodes(spark, sf_dir).select(F.col("database_line").alias("node"), "x", "y"), "node")
    return graph.component_hulls(placed)


def edge_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR4: how many links part each component; an iterative algorithm, so rows only."""
    edges = _graph_links(spark, sf_dir).select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    return graph.edge_connectivity(edges, _components(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        site_neighbours, nearest_views, site_natures, site_batches, lambert_93, folded_changes, changed_positions, stored_offsets, serialized_changes,
        parsed_changes, parsed_summary, point_bounds, nearest_buildings, snapped_points, footprints_in_view, needed_databases,
        components, region_graph, node_degrees, length_histogram, component_hulls, edge_connectivity,
    )
}

_TOWERS = f"WITH towers AS ({inputs.TOWERS_SQL})"


def _distance(a: str, b: str) -> str:
    return (
        f"2 * 6378137e0 * asin(sqrt(least(1e0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2)"
        f" + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2))))"
    )


def _bearing(a: str, b: str) -> str:
    """In [-180, 180): due south is -180."""
    d = f"radians({b}.lng - {a}.lng)"
    angle = (
        f"degrees(atan2(sin({d}) * cos(radians({b}.lat)), cos(radians({a}.lat)) * sin(radians({b}.lat))"
        f" - sin(radians({a}.lat)) * cos(radians({b}.lat)) * cos({d})))"
    )
    return f"(CASE WHEN {angle} >= 180 THEN -180e0 ELSE {angle} END)"


def _near(a: str, b: str, r: float) -> str:
    return f"abs({b}.lat - {a}.lat) <= {r} / 111000e0 AND abs({b}.lng - {a}.lng) <= {r} / (111000e0 * cos(radians({a}.lat))) AND {_distance(a, b)} <= {r}"


_FOLD = f"""changes AS ({inputs.CHANGES_SQL}), epochs AS (
    SELECT *, sum(CASE WHEN action IN ('bad', 'reset') THEN 1 ELSE 0 END) OVER (PARTITION BY database_line ORDER BY seq ROWS UNBOUNDED PRECEDING) AS epoch FROM changes
), latest AS (
    SELECT database_line, max(epoch) AS epoch FROM epochs GROUP BY database_line
), agg AS (
    SELECT database_line, count(*) FILTER (action = 'changed') AS edits, bool_or(action = 'bad') AS bad, max_by(d_lon, seq) FILTER (action = 'changed') AS d_lon,
           max_by(d_lat, seq) FILTER (action = 'changed') AS d_lat, sum(d_alt) FILTER (action = 'changed') AS d_alt
    FROM epochs JOIN latest USING (database_line, epoch) GROUP BY database_line
), folded AS (
    SELECT database_line, CASE WHEN edits > 0 THEN 'changed' ELSE 'bad' END AS status, d_lon, d_lat, d_alt FROM agg WHERE edits > 0 OR bad
)"""
_FILE = f"""{_TOWERS}, {_FOLD}, numbered AS (SELECT *, row_number() OVER (ORDER BY database_line) - 1 AS i FROM towers), written AS (
    SELECT t.i, t.database_date, f.* FROM numbered t JOIN folded f USING (database_line)
)"""
_SNAP = f"""WITH points AS (SELECT database_line AS point_id, x, y FROM ({inputs.NODES_SQL})), buildings AS (
    SELECT building_id, x0, y0, x0 + w AS x1, y0 + d AS y1 FROM ({inputs.BUILDINGS_SQL})
), near AS (
    SELECT p.point_id, b.building_id, p.x AS px, p.y AS py, least(greatest(p.x, b.x0), b.x1) AS x, least(greatest(p.y, b.y0), b.y1) AS y
    FROM points p JOIN buildings b ON p.x BETWEEN b.x0 - 20 AND b.x1 + 20 AND p.y BETWEEN b.y0 - 20 AND b.y1 + 20
), within AS (
    SELECT *, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS distance FROM near WHERE (px - x) * (px - x) + (py - y) * (py - y) <= 400e0
)"""
_E, _N, _C = geodesy._E, geodesy._N, geodesy._C
_GRAPH = _links_sql(GRAPH_M)

SQL = {
    "site_neighbours": f"""{_TOWERS} SELECT a.database_line, b.database_line AS other_line, round({_distance('a', 'b')}, 5) AS distance_m,
       round({_bearing('b', 'a')}, 5) AS bearing_deg, round(degrees(atan2(5e0, {_distance('a', 'b')})), 5) AS pitch_deg
FROM towers a JOIN towers b ON a.database_line <> b.database_line AND {_near('a', 'b', 100.0)}""",
    "nearest_views": f"""{_TOWERS}, views AS (SELECT database_line AS view_id, lat + (database_line % 5) * 0.0001e0 AS lat, lng FROM towers), met AS (
    SELECT a.database_line, b.view_id, {_distance('a', 'b')} AS d, {_bearing('b', 'a')} AS h, b.lat, b.lng FROM towers a JOIN views b ON {_near('a', 'b', 30.0)}
), best AS (SELECT *, degrees(atan2(5e0, d)) AS p, row_number() OVER (PARTITION BY database_line ORDER BY round(d, 6), view_id) AS nth FROM met)
SELECT database_line, view_id, round(d, 5) AS distance_m, round(h, 5) AS heading_deg, round(p, 5) AS pitch_deg,
       'https://view.example.org/embed?location=' || printf('%.5f', lat) || '%2C' || printf('%.5f', lng) || '&heading=' || printf('%.2f', h) || '&pitch=' || printf('%.2f', p) || '&fov=90' AS address
FROM best WHERE nth = 1""",
    "site_natures": f"""{_TOWERS}, natures(nature, fr, en) AS (VALUES {', '.join("({}, '{}', '{}')".format(i, fr.replace("'", "''"), en.replace("'", "''")) for i, fr, en, _ in rows())})
SELECT t.database_line, t.nature, n.fr, n.en FROM towers t LEFT JOIN natures n USING (nature)""",
    "site_batches": f"""{_TOWERS}, n AS (SELECT database_line, row_number() OVER (ORDER BY database_line) - 1 AS i FROM towers), b AS (SELECT database_line, CAST(i // 100 AS INTEGER) AS batch, CAST(i % 100 AS INTEGER) AS index FROM n)
SELECT *, coalesce(lead(database_line) OVER w, min(database_line) OVER (PARTITION BY batch)) AS next_database_line, coalesce(lag(database_line) OVER w, max(database_line) OVER (PARTITION BY batch)) AS previous_database_line
FROM b WINDOW w AS (PARTITION BY batch ORDER BY index)""",
    "lambert_93": f"""{_TOWERS}, r AS (
    SELECT *, {_C}e0 * exp(-{_N}e0 * (ln(tan(pi() / 4 + radians(lat) / 2)) + {_E}e0 / 2 * ln((1 - {_E}e0 * sin(radians(lat))) / (1 + {_E}e0 * sin(radians(lat)))))) AS r, {_N}e0 * radians(lng - 3) AS a FROM towers
), xy AS (SELECT *, {geodesy._X0}e0 + r * sin(a) AS x, {geodesy._Y0}e0 - r * cos(a) AS y FROM r)
SELECT database_line, round(x, 4) AS x, round(y, 4) AS y, round(lng, 8) AS lng, round(lat, 8) AS lat, printf('%04d_%04d', CAST(floor(x / 1000) AS BIGINT), CAST(floor(y / 1000) + 1 AS BIGINT)) AS tile_id FROM xy""",
    "folded_changes": f"WITH {_FOLD} SELECT database_line, status, round(d_lon, 8) AS d_lon, round(d_lat, 8) AS d_lat, round(d_alt, 8) AS d_alt FROM folded",
    "changed_positions": f"""{_TOWERS}, {_FOLD} SELECT t.database_line, f.status, round(t.lat + f.d_lat, 8) AS new_lat, round(t.lng + f.d_lon, 8) AS new_lng, round(t.altitude + f.d_alt, 8) AS new_altitude,
       CASE f.status WHEN 'bad' THEN 'Bad tower' WHEN 'changed' THEN printf('%.5f, %.5f, %.1fm', t.lat + f.d_lat, t.lng + f.d_lon, t.altitude + f.d_alt) END AS label FROM towers t LEFT JOIN folded f USING (database_line)""",
    "stored_offsets": f"{_TOWERS} SELECT database_line, round(lng - 0.0002e0 - lng, 8) AS d_lon, round(lat + 0.0001e0 - lat, 8) AS d_lat FROM towers",
    "serialized_changes": f"{_FILE} SELECT i AS idx, database_date AS date, database_line, status = 'bad' AS bad, round(d_lon, 8) AS d_lon, round(d_lat, 8) AS d_lat, round(d_alt, 8) AS d_alt FROM written",
    "parsed_changes": f"{_FILE} SELECT i AS seq, i AS idx, database_line, status AS action, round(d_lon, 8) AS d_lon, round(d_lat, 8) AS d_lat, round(d_alt, 8) AS d_alt FROM written",
    "parsed_summary": f"{_FILE} SELECT count(*) AS n, min(i) AS first_index, max(i) AS last_index, (max(i) + 1) % (SELECT count(*) FROM towers) AS go_on_at FROM written",
    "point_bounds": f"{_SNAP} SELECT round(min(x) - 20, 6) AS x0, round(min(y) - 20, 6) AS y0, round(max(x) + 20, 6) AS x1, round(max(y) + 20, 6) AS y1 FROM points",
    "nearest_buildings": f"{_SNAP} SELECT point_id, building_id, round(distance, 5) AS distance, round(x, 5) AS x, round(y, 5) AS y FROM within",
    "snapped_points": f"""{_SNAP}, best AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(distance, 6), building_id) AS nth FROM within)
SELECT p.point_id, round(p.x, 5) AS x, round(p.y, 5) AS y, round(b.x, 5) AS snapped_x, round(b.y, 5) AS snapped_y, b.building_id, round(sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)), 5) AS moved
FROM points p LEFT JOIN best b ON p.point_id = b.point_id AND b.nth = 1""",
    "footprints_in_view": f"{_SNAP} SELECT building_id, x0, y0, x1, y1 FROM buildings WHERE x1 >= 650850 AND x0 <= 651150 AND y1 >= 6860850 AND y0 <= 6861150",
    "needed_databases": f"""{_SNAP}, box AS (SELECT min(x) - 20 AS x0, min(y) - 20 AS y0, max(x) + 20 AS x1, max(y) + 20 AS y1 FROM points), d AS (
    SELECT CAST(n_nationkey AS VARCHAR) AS code, n_nationkey % 2 = 0 AS present, 646000e0 + n_nationkey % 5 * 2000e0 AS dx, 6856000e0 + n_nationkey // 5 * 2000e0 AS dy FROM nation
)
SELECT code, 'D' || lpad(code, CAST(greatest(3, length(code)) AS INTEGER), '0') AS target, 'BDTOPO_3-5_TOUSTHEMES_GPKG_LAMB93_D' || lpad(code, CAST(greatest(3, length(code)) AS INTEGER), '0') || '_2025-12-15' AS database, present
FROM d, box WHERE dx <= box.x1 AND dx + 1500 >= box.x0 AND dy <= box.y1 AND dy + 1500 >= box.y0""",
    "components": _GRAPH.replace("WITH nodes", "WITH RECURSIVE nodes", 1) + """, edges AS (SELECT id1 AS a, id2 AS b FROM links UNION SELECT id2, id1 FROM links), reach(node, other) AS (
    SELECT a, a FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other
) SELECT node, min(other) AS root FROM reach GROUP BY node""",
    "region_graph": f"""{_GRAPH}, per AS (SELECT id1, count(*) AS n FROM links GROUP BY id1)
SELECT CAST(floor(tx) AS INTEGER) AS tile_x, CAST(floor(ty) AS INTEGER) AS tile_y, count(*) AS nodes, CAST(coalesce(sum(n), 0) AS BIGINT) AS links FROM nodes LEFT JOIN per ON id1 = database_line GROUP BY 1, 2""",
    "node_degrees": f"{_links_sql(300.0)} SELECT node, count(*) AS degree FROM (SELECT id1 AS node FROM links UNION ALL SELECT id2 FROM links) GROUP BY node",
    "length_histogram": f"{_links_sql(1000.0)}, b AS (SELECT CAST(least(20, floor(length_m / 50e0) + 1) AS INTEGER) AS bin FROM links) SELECT bin, count(*) AS n, (bin - 1) * 50e0 AS from_m FROM b GROUP BY bin",
}
