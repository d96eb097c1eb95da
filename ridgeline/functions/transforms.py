"""Coordinate spaces (survey SF1-SF6, SF39).

model   Lambert-93 metres
pixel   raster pixels over all tiles, ``ppt`` to a tile's side (2000 by default)
tile    tiles of 1000 m; the integer part names the tile
in-tile pixels from a tile's corner
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE_M = 1000.0
#: The raster's pixel centres lie a quarter metre off the tile grid in x.
X_OFFSET_M = 0.25
PIXELS_PER_TILE = 2000


def node_y(y: Column) -> Column:
    """Tiles are named by their upper edge, so nodes move up by one tile (SF1)."""
    return y + TILE_M


def model_to_tile(x: Column, y: Column) -> tuple[Column, Column]:
    return (x + X_OFFSET_M) / TILE_M, y / TILE_M


def tile_to_model(tx: Column, ty: Column) -> tuple[Column, Column]:
    return tx * TILE_M - X_OFFSET_M, ty * TILE_M


def model_to_pixel(x: Column, y: Column, ppt: int = PIXELS_PER_TILE) -> tuple[Column, Column]:
    s = ppt / TILE_M
    return (x + X_OFFSET_M) * s, y * s


def pixel_to_model(px: Column, py: Column, ppt: int = PIXELS_PER_TILE) -> tuple[Column, Column]:
    s = ppt / TILE_M
    return px / s - X_OFFSET_M, py / s


def pixel_to_tile(px: Column, py: Column, ppt: int = PIXELS_PER_TILE) -> tuple[Column, Column]:
    return px / float(ppt), py / float(ppt)


def tile_to_pixel(tx: Column, ty: Column, ppt: int = PIXELS_PER_TILE) -> tuple[Column, Column]:
    return tx * float(ppt), ty * float(ppt)


def tile_index(t: Column) -> Column:
    """The tile a tile-space coordinate lies in (SF5)."""
    return F.floor(t).cast("int")


def position_in(t: Column, tile: Column, ppt: int = PIXELS_PER_TILE) -> Column:
    """In-tile pixel position of a tile-space coordinate, clamped to the tile (SF6)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(float(ppt)), (t - tile) * float(ppt)))


def split(t: Column, ppt: int = PIXELS_PER_TILE) -> tuple[Column, Column]:
    """(tile, in-tile pixel position) of a tile-space coordinate."""
    tile = tile_index(t)
    return tile, position_in(t, tile, ppt)


def combine(tile: Column, inside: Column, ppt: int = PIXELS_PER_TILE) -> Column:
    return tile + inside / float(ppt)


def raster_index(px: Column, py: Column, width: int, height: int) -> Column:
    """Place of a pixel in a row-major raster whose first row is the upper one (SF39)."""
    return (F.lit(height - 1) - py) * width + px


def raster_position(index: Column, width: int, height: int) -> tuple[Column, Column]:
    return F.pmod(index, F.lit(width)), F.lit(height - 1) - F.floor(index / width)
