"""Geodata derived from the benchmark's business tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES_SQL = """
SELECT CAST(20251031 AS BIGINT) AS database_date, c_custkey AS database_line,
       650000.37e0 + CAST((c_custkey * 7919) % 3001 AS DOUBLE) AS x,
       6860000.61e0 + CAST((c_custkey * 104729) % 2999 AS DOUBLE) AS y,
       60e0 + CAST((c_custkey * 31) % 40 AS DOUBLE) AS z,
       c_mktsegment IN ('BUILDING', 'MACHINERY') AS active, c_custkey AS idx, c_nationkey AS nation
FROM customer
"""
#: gx, gy: pixel over all tiles.
HEIGHT_SQL = """CAST(30 + CASE WHEN (gx * 7919 + gy * 104729 + gx * gy) % 211 = 0 THEN 60 ELSE (gx * 31 + gy * 17) % 23 END AS FLOAT)"""
BUILDINGS_SQL = """
SELECT p_partkey AS building_id,
       650000e0 + CAST((p_partkey * 6007) % 3000 AS DOUBLE) AS x0,
       6860000e0 + CAST((p_partkey * 7001) % 2990 AS DOUBLE) AS y0,
       5e0 + CAST(p_size % 15 AS DOUBLE) AS w, 5e0 + CAST(p_partkey % 11 AS DOUBLE) AS d
FROM part
"""
CHANGES_SQL = """
SELECT event_id AS seq, user_id AS database_line,
       CASE event_type WHEN 'error' THEN 'bad' WHEN 'signup' THEN 'reset' ELSE 'changed' END AS action,
       CAST(event_id % 21 - 10 AS DOUBLE) / 100000e0 AS d_lon,
       CAST(event_id % 17 - 8 AS DOUBLE) / 100000e0 AS d_lat,
       CAST(event_id % 5 - 2 AS DOUBLE) AS d_alt
FROM events
"""
#: Sites in degrees, some of which lie within 100 m of each other.
TOWERS_SQL = """
SELECT CAST(20251031 AS VARCHAR) AS database_date, c_custkey AS database_line,
       2.3e0 + CAST((c_custkey * 7919) % 3001 AS DOUBLE) / 75000e0 AS lng,
       48.8e0 + CAST((c_custkey * 104729) % 2999 AS DOUBLE) / 111000e0 AS lat,
       60e0 + CAST((c_custkey * 31) % 40 AS DOUBLE) AS altitude,
       CAST(c_custkey % 60 AS INTEGER) AS nature, c_custkey AS idx
FROM customer
"""
#: Pixels to a tile's side in the derived raster (10 m each).
PPT = 100


def _sql(spark: SparkSession, sf_dir: str, table: str, query: str) -> DataFrame:
    query = query.replace("VARCHAR", "STRING").replace(f"FROM {table}", "FROM {t}")
    return spark.sql(query, t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "customer", NODES_SQL)


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "part", BUILDINGS_SQL)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "events", CHANGES_SQL)


def towers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "customer", TOWERS_SQL)


def pixels(tiles: DataFrame, ppt: int = PPT) -> DataFrame:
    """The derived raster of some tiles: tile_x, tile_y, px, py, h."""
    side = F.sequence(F.lit(0), F.lit(ppt - 1))
    rows = tiles.select("tile_x", "tile_y", F.explode(side).alias("px")).select("tile_x", "tile_y", "px", F.explode(side).alias("py"))
    placed = rows.withColumns({"gx": F.col("tile_x").cast("long") * ppt + F.col("px"), "gy": F.col("tile_y").cast("long") * ppt + F.col("py")})
    return placed.select("tile_x", "tile_y", "px", "py", F.expr(HEIGHT_SQL).alias("h"))
