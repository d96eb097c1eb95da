"""Corrections, components, neighbours, snapping to polygons, and the streaming fold, against plain code."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import geodesy
from ridgeline.operators import corrections, graph, links, neighbours, snapping
from ridgeline.streaming.corrections import fold_event, fold_stream

ACTIONS = ["changed", "move", "altitude", "verified", "bad", "reset"]


def log_rows(seed, n=400):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, 1.0, -0.5, 0.25])
    return [(i, rng.randrange(40), rng.choice(ACTIONS), value(), value(), value()) for i in range(n)]


def plain(rows):
    state = {}
    for _, line, action, *offsets in sorted(rows):
        state[line] = fold_event(state.get(line, (None, 0.0, 0.0, 0.0)), action, *offsets)
    return {k: v if v[0] == "changed" else ("bad", None, None, None) for k, v in state.items() if v[0]}


LOG = "seq long, database_line long, action string, d_lon double, d_lat double, d_alt double"


@pytest.mark.parametrize("seed", [1, 2])
def test_fold(spark, seed):
    rows = log_rows(seed)
    got = {r.database_line: tuple(r)[1:] for r in corrections.fold_changes(spark.createDataFrame(rows, LOG)).collect()}
    assert got == plain(rows)


def test_fold_of_nothing(spark):
    assert corrections.fold_changes(spark.createDataFrame([], LOG)).count() == 0


def test_streaming_fold(spark, tmp_path):
    rows = log_rows(3)
    for k in range(0, 400, 100):
        spark.createDataFrame(rows[k : k + 100], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    state = {}
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "log"))
    keep = lambda df, _: state.update({r.database_line: tuple(r)[1:] for r in df.collect()})
    query = fold_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {k: v for k, v in state.items() if v[0]} == plain(rows)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: find(a) for a in parent}


def test_least_cut():
    ring = np.array([(0, 1), (1, 2), (2, 3), (3, 0)])
    assert graph.least_cut(4, ring) == 2
    assert graph.least_cut(4, np.vstack([ring, [(0, 2), (1, 3)], ring[:, ::-1], [(2, 2)]])) == 3
    assert graph.least_cut(1, np.zeros((0, 2), int)) == graph.least_cut(3, np.array([(0, 1)])) == 0


@pytest.mark.parametrize("seed", range(30))
def test_least_cut_against_every_cut(seed):
    rng = random.Random(seed)
    n = rng.randint(2, 9)
    edges = [(a, b) for a in range(n) for b in range(a) if rng.random() < rng.choice([0.3, 0.6, 0.9])]
    want = min(sum((s >> a & 1) != (s >> b & 1) for a, b in edges) for s in range(1, (1 << n) - 1))
    assert graph.least_cut(n, np.array(edges or [(0, 0)])) == want


def test_least_cut_of_a_large_component():
    """Two dense halves that three edges join."""
    rng = random.Random(1)
    edges = [(h + a, h + rng.randrange(4000)) for h in (0, 4000) for a in range(4000) for _ in range(6)] + [(0, 4000), (1, 4001), (2, 4002)]
    assert graph.least_cut(8000, np.array(edges)) == 3


def area(ring):
    x, y = np.asarray(ring, float).T
    return abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def test_outlines():
    """Points in convex position keep their hull; an L is dug out, and every point is on it or inside."""
    circle = np.array([(math.cos(k), math.sin(k)) for k in np.linspace(0, 6, 14)])
    assert sorted(map(tuple, graph.concave_outline(circle))) == sorted(map(tuple, circle))
    corner = np.array([(x, y) for x in range(11) for y in range(11) if x < 4 or y < 4], float)
    got = graph.concave_outline(corner)
    assert area(got) < 0.75 * area(corner[graph._convex(corner)]) and area(got) >= 51
    assert {tuple(p) for p in got} <= {tuple(p) for p in corner}
    assert len(graph.concave_outline(np.array([(1.0, 2.0)]))) == 1 and len(graph.concave_outline(np.array([(1.0, 2.0), (3.0, 4.0), (1.0, 2.0)]))) == 2


def test_row_numbers(spark):
    rows = [(v, -v) for v in random.Random(3).sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7)
    assert [(r.a, r.idx) for r in links.number_rows(df, "a").orderBy("a").collect()] == [(a, i) for i, a in enumerate(sorted(a for a, _ in rows))]
    assert links.number_rows(df.limit(0), "a").columns == ["a", "b", "idx"]


def test_neighbours_against_brute_force(spark):
    rng = random.Random(6)
    sites = [(i, 48.8 + rng.uniform(0, 0.01), 2.3 + rng.uniform(0, 0.01)) for i in range(200)]
    df = spark.createDataFrame(sites, "database_line long, lat double, lng double")
    got = {(r.database_line, r.other_line) for r in neighbours.neighbours(df).collect()}

    def metres(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6378137 * math.asin(math.sqrt(h))

    assert got == {(a[0], b[0]) for a in sites for b in sites if a[0] != b[0] and metres(a, b) <= 100}


def test_lambert_93(spark):
    x, y = geodesy.to_lambert93(F.lit(2.578521), F.lit(49.206509))
    lng, lat = geodesy.from_lambert93(x, y)
    got = spark.range(1).select(x, y, lng, lat).first()
    assert tuple(got) == pytest.approx((669282.3687, 6900836.7895, 2.578521, 49.206509), abs=1e-3)


@pytest.mark.parametrize("crs,x,y,lng,lat", [(32631, 448251.795, 5411932.678, 2.2945, 48.8582), (3857, 261848.15, 6250566.72, 2.3522, 48.8566), (4326, 2.5, 49.0, 2.5, 49.0), (3950, 1700000.0, 9200000.0, 3.0, 50.0), (3944, 1700000.0, 3200000.0, 3.0, 44.0), (2154, 700000.0, 6600000.0, 3.0, 46.5)])
def test_reference_systems(spark, crs, x, y, lng, lat):
    got = spark.range(1).select(*geodesy.to_lng_lat(crs, F.lit(x), F.lit(y))).first()
    assert tuple(got) == pytest.approx((lng, lat), abs=5e-5)
    with pytest.raises(ValueError):
        geodesy.to_lng_lat(27572, F.lit(0.0), F.lit(0.0))


def test_courtyards(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    kinds = "building_id long, x0 double, y0 double, x1 double, y1 double, ring array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>"
    b = spark.createDataFrame([(1, 0.0, 0.0, 30.0, 30.0, square(0.0, 30.0), [square(10.0, 20.0)]), (2, 100.0, 0.0, 130.0, 30.0, [(100.0, 0.0), (130.0, 0.0), (130.0, 30.0), (100.0, 30.0)], None)], kinds)
    points = spark.createDataFrame([(1, 12.0, 15.0), (2, 5.0, 5.0), (3, 115.0, 15.0)], "point_id long, x double, y double")
    got = {r.point_id: (r.snapped_x, r.snapped_y, r.moved) for r in snapping.snap(points, b).collect()}
    assert got == {1: (10, 15, 2), 2: (5, 5, 0), 3: (115, 15, 0)}


def test_snapping_to_polygons(spark):
    ring = [(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (15.0, 10.0), (0.0, 30.0)]
    rows = [(2, 0.0, 0.0, 30.0, 30.0, ring), (1, 60.0, 0.0, 70.0, 10.0, [(60.0, 0.0), (70.0, 0.0), (70.0, 10.0), (60.0, 10.0)])]
    b = spark.createDataFrame(rows, "building_id long, x0 double, y0 double, x1 double, y1 double, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 15.0, 5.0), (2, 15.0, 20.0), (3, 45.0, 5.0), (4, -20.0, 0.0), (5, -20.1, 0.0), (6, 200.0, 200.0)], "point_id long, x double, y double")
    got = {r.point_id: r for r in snapping.snap(points, b).collect()}
    assert (got[1].snapped_x, got[1].moved) == (15, 0)
    assert 0 < got[2].moved < 10 and got[2].building_id == 2
    assert got[3].building_id == 1 and got[3].snapped_x == 60
    assert got[4].snapped_x == 0 and got[5].snapped_x is None and got[6].building_id is None


def _sites_and_views(rng, n=300):
    """Sites in a dense spot and far ones; views of which some are equally near."""
    lat, lng = 48.8, 2.3
    sites = [(i, lat + rng.uniform(0, 2e-4), lng + rng.uniform(0, 2e-4)) for i in range(n)] + [(n + i, lat + 0.01 + i * 1e-3, lng) for i in range(5)]
    views = [(7 * i % 1009, *s[1:]) for i, s in enumerate(sites[: n // 2])] + [(5000 + i, s[1], s[2]) for i, s in enumerate(sites[: n // 2])] + [(9000 + i, lat + 0.01 + i * 1e-3 + 2e-4, lng) for i in range(3)]
    return sites, views


def test_the_nearest_view_is_that_of_all_pairs(spark, monkeypatch):
    """Near ones are found without those further away: pairs that are looked at stay far below all within the radius."""
    sites, views = _sites_and_views(random.Random(2))
    t = spark.createDataFrame(sites, "database_line long, lat double, lng double").cache()
    v = spark.createDataFrame(views, "view_id long, lat double, lng double").cache()
    want, looked = {}, []
    for r in sorted(neighbours.within_radius(t, v, 30.0, "database_line", "view_id").collect(), key=lambda r: (round(r.distance_m, 6), r.b_id)):
        want.setdefault(r.a_id, r.b_id)
    plain = neighbours.within_radius
    monkeypatch.setattr(neighbours, "within_radius", lambda *a, **k: (looked.append(plain(*a, **k)), looked[-1])[1])
    got = {r.database_line: r.view_id for r in neighbours.nearest_view(t, v, 30.0).collect()}
    assert got == want and len(got) == 303
    assert sum(d.count() for d in looked) < plain(t, v, 30.0, "database_line", "view_id").count() / 4


def test_snapping_is_that_of_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    ring = lambda x, y, w, d: [(x, y), (x + w, y), (x + w, y + d), (x, y + d)]
    boxes = [(i % 37 * 100 + i, *(5.0 * rng.randrange(30) for _ in range(2)), 5.0, 10.0) for i in range(400)]
    rows = [(i, x, y, x + w, y + d, ring(x, y, w, d) + ([(x, y)] if i % 2 else [])) for i, x, y, w, d in boxes] + [(9000, 300.0, 0.0, 330.0, 30.0, [(300.0, 0.0), (330.0, 0.0), (315.0, 30.0)])]
    b = spark.createDataFrame(rows, "building_id long, x0 double, y0 double, x1 double, y1 double, ring array<struct<x: double, y: double>>").cache()
    points = [(i, 2.5 * rng.randrange(60), 2.5 * rng.randrange(60)) for i in range(300)] + [(1000, 302.0, 29.0), (1001, 340.0, 2.5), (1002, 500.0, 0.0), (1003, 350.0, 0.0)]
    p = spark.createDataFrame(points, "point_id long, x double, y double").cache()
    pairs = snapping.nearest_buildings(p, b).collect()
    assert len({(r.point_id, r.building_id) for r in pairs}) == len(pairs)
    want, looked = {}, []
    for r in sorted(pairs, key=lambda r: (round(r.distance, 6), r.building_id)):
        want.setdefault(r.point_id, (r.building_id, r.x, r.y))
    held = {(r.point_id, r.building_id): (round(r.distance, 6), r.x, r.y) for r in pairs}
    for i, x, y in points:  # rectangles against plain code
        for n, x0, y0, x1, y1, _ in rows[:-1]:
            qx, qy = min(max(x, x0), x1), min(max(y, y0), y1)
            d = math.hypot(x - qx, y - qy)
            assert held.get((i, n)) == ((round(d, 6), qx, qy) if d <= 20 else None)
    plain = snapping.nearest_buildings
    monkeypatch.setattr(snapping, "nearest_buildings", lambda *a, **k: (looked.append(plain(*a, **k)), looked[-1])[1])
    got = {r.point_id: (r.building_id, r.snapped_x, r.snapped_y) for r in snapping.snap(p, b).collect()}
    assert got == {i: want.get(i, (None, None, None)) for i, _, _ in points}
    assert sum(d.count() for d in looked) < len(pairs) / 2
