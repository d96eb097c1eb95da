"""Candidate links between nodes, and the region they span (survey JN1-JN2, PR1-PR6, AG1, SO3, WN1).

A distance predicate alone would make Spark compare all pairs. Nodes are put in
square cells as wide as the longest link instead; one side is repeated in its own
cell and four of the eight around it, so that each pair meets once, in an equi-join
on the cell. A dense cell's nodes are cut into chunks of a bounded number, and a chunk
is what a task takes. Without a limit on length all pairs are wanted, and a cross join is what that means.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.checkpoints import cut
from ridgeline.functions import transforms as tr

#: Nodes of a cell that are one task's; a cell with more is shared out.
CHUNK = 4096
#: The cells whose nodes a cell meets: with those that meet it, all nine.
AROUND = [(0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]


def number_rows(df: DataFrame, order: str | Column, name: str = "idx") -> DataFrame:
    """Adds the row's place in a given order, from 0 without gaps (WN1); rows equal in it are numbered as they come.

    Rows are sorted in ranges of the order, one task each; a range's numbers begin where the
    counts of those before it end. What reaches the driver is one count a range.
    """
    own = order if isinstance(order, Column) else F.col(order)
    ranges = cut(df.repartitionByRange(own).sortWithinPartitions(own).withColumn(name, F.monotonically_increasing_id()))
    part, at = F.shiftright(name, 33), F.col(name).bitwiseAND((1 << 33) - 1)
    total, starts = 0, []
    for r in ranges.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts += [F.lit(r["part"]), F.lit(total)]
        total += r["count"]
    if not starts:
        return ranges
    return ranges.withColumn(name, F.element_at(F.create_map(*starts), part).cast("long") + at)


def place_nodes(nodes: DataFrame) -> DataFrame:
    """Adds tile-space coordinates (tx, ty)."""
    tx, ty = tr.model_to_tile(F.col("x"), tr.node_y(F.col("y")))
    return nodes.withColumns({"tx": tx, "ty": ty})


def cell_side(max_length_m: float) -> float:
    """A cell's width in tiles: a little more than the limit, so that rounding at an edge loses no pair."""
    return max_length_m / 1000.0 * (1 + 1e-9) + 1e-12


def of_size(chunk: int) -> Callable[[Column], Column]:
    """As many chunks for a cell of n nodes as none needs more than ``chunk``, about."""
    return lambda n: F.ceil(n / chunk)


def in_chunks(placed: DataFrame, side: float, chunks: Callable[[Column], Column], around: list[tuple[int, int]] = AROUND) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placed nodes by chunk, the nodes that each chunk meets, and how many chunks a cell has (cx, cy, chunks).

    The first two have cx, cy and chunk as well, the second also ``same``: whether the node is of the chunk's own cell.
    Of the pairs within a cell each is met from both ends, of all others each once (with all nine cells around: also from both).
    """
    own = placed.withColumns({"cx": F.floor(F.col("tx") / side), "cy": F.floor(F.col("ty") / side)})
    cells = own.groupBy("cx", "cy").agg(chunks(F.count("*")).cast("int").alias("chunks"))
    held = own.join(cells, ["cx", "cy"]).withColumn("chunk", F.pmod(F.xxhash64("idx"), F.col("chunks")).cast("int")).drop("chunks")
    beside = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in around])
    o = own.withColumn("o", F.explode(beside)).withColumns({"cx": F.col("cx") - F.col("o.i"), "cy": F.col("cy") - F.col("o.j"), "same": (F.col("o.i") == 0) & (F.col("o.j") == 0)}).drop("o")
    met = o.join(cells, ["cx", "cy"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    return held, met, cells


def link_nodes(nodes: DataFrame, max_length_m: float = math.inf, chunk: int = CHUNK) -> DataFrame:
    """One row per link: ids, tile-space ray and length in metres.

    ``nodes`` has idx, database_line, x, y, z, active. A pair is a link if either
    node is active and the horizontal distance is at most ``max_length_m`` (equal
    is kept, heights don't count). id1 is the later node of the input.
    """
    limit = max_length_m / 1000.0
    keep = ["idx", "database_line", "tx", "ty", "z", "active"]
    placed = place_nodes(nodes).select(*keep)
    names = lambda d, p: d.select(*[F.col(c).alias(f"{p}_{c}") if c in keep else c for c in d.columns])
    pick = lambda c: (F.col(f"a_{c}"), F.col(f"b_{c}"))
    active = F.col("a_active") | F.col("b_active")
    if math.isinf(max_length_m):
        joined = names(placed, "a").join(names(placed, "b"), (F.col("a_idx") > F.col("b_idx")) & active)
    else:
        dx, dy = F.col("v_tx") - F.col("u_tx"), F.col("v_ty") - F.col("u_ty")
        near = (F.col("u_active") | F.col("v_active")) & (dx * dx + dy * dy <= limit * limit)
        once = (F.col("u_idx") > F.col("v_idx")) | (~F.col("same") & (F.col("u_idx") < F.col("v_idx")))
        # Pairs grow with the square of a cell's rows: by bytes, small inputs would be coalesced into one task.
        tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        key = ["cx", "cy", "chunk"]
        held, met, _ = in_chunks(placed, cell_side(max_length_m), of_size(chunk))
        left, right = names(held, "u").repartition(tasks, *key), names(met, "v").repartition(tasks, *key)
        joined = left.hint("shuffle_hash").join(right, key).where(once & near)
        pick = lambda c: tuple(F.when(F.col("u_idx") > F.col("v_idx"), F.col(f"{p}_{c}")).otherwise(F.col(f"{q}_{c}")) for p, q in ("uv", "vu"))
    (id1, id2), (ax, bx), (ay, by), (az, bz) = (pick(c) for c in ("database_line", "tx", "ty", "z"))
    return joined.select(
        id1.alias("id1"),
        id2.alias("id2"),
        ax.alias("sx"),
        ay.alias("sy"),
        az.cast("double").alias("sz"),
        (bx - ax).alias("dx"),
        (by - ay).alias("dy"),
        (bz - az).cast("double").alias("dz"),
    ).withColumn("length_m", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) * 1000.0)


def region(nodes: DataFrame) -> DataFrame:
    """One row: the inclusive tile bounds of all nodes, and how many tiles that is (AG1, AG8)."""
    placed = place_nodes(nodes)
    t = tr.tile_index
    out = placed.agg(t(F.min("tx")).alias("x_min"), t(F.max("tx")).alias("x_max"), t(F.min("ty")).alias("y_min"), t(F.max("ty")).alias("y_max"))
    area = (F.col("x_max") - F.col("x_min") + 1).cast("long") * (F.col("y_max") - F.col("y_min") + 1)
    return out.withColumn("area", area)


def region_tiles(bounds: DataFrame) -> DataFrame:
    """One row per tile of a region (SO3)."""
    return bounds.where("x_min is not null").select(F.explode(F.sequence("x_min", "x_max")).alias("tile_x"), "y_min", "y_max").select("tile_x", F.explode(F.sequence("y_min", "y_max")).alias("tile_y"))
