"""Logs of manual corrections to site positions (survey AG10-AG11, JN13, PR11, PR16, SF33-SF35, SK3, WN6).

An action is
  changed   sets either offset that isn't null, adds the altitude offset that isn't null
  move      sets offsets only; has no effect on a site marked bad
  altitude  adds to the altitude offset
  verified  makes an empty correction: the position was looked at and is right
  bad       marks the site bad
  reset     forgets all
After bad or reset the next correction starts from zero offsets. Bad and reset
divide a site's log into epochs, and the last epoch is all that counts: a running
count, then one grouped aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_changes(log: DataFrame) -> DataFrame:
    """One row per site that has a state: database_line, status (changed or bad), d_lon, d_lat, d_alt (null for bad)."""
    w = Window.partitionBy("database_line").orderBy("seq")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    breaks = F.col("action").isin("bad", "reset")
    epochs = log.withColumn("epoch", F.sum(breaks.cast("int")).over(past)).withColumn("opened_by", F.last(F.when(breaks, F.col("action")), ignorenulls=True).over(past))
    inside = Window.partitionBy("database_line", "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    edits = F.col("action").isin("changed", "altitude", "verified")
    started = F.coalesce(F.max(edits.cast("int")).over(inside), F.lit(0)) == 1
    counts = ~breaks & ~((F.col("action") == "move") & (F.col("opened_by") == "bad") & ~started)
    last = F.max("epoch").over(Window.partitionBy("database_line"))
    held = epochs.withColumn("counts", F.coalesce(counts, edits | (F.col("action") == "move"))).withColumn("last_epoch", last).where("epoch = last_epoch")
    use = lambda c, *kinds: F.when(F.col("counts") & F.col("action").isin(*kinds), F.col(c))
    latest = lambda c: F.coalesce(F.max_by(use(c, "changed", "move"), F.when(use(c, "changed", "move").isNotNull(), F.col("seq"))), F.lit(0.0))
    agg = held.groupBy("database_line").agg(
        F.max("opened_by").alias("opened_by"), F.bool_or("counts").alias("edited"), latest("d_lon").alias("d_lon"), latest("d_lat").alias("d_lat"),
        F.coalesce(F.sum(use("d_alt", "changed", "altitude")), F.lit(0.0)).alias("d_alt"),
    )
    status = F.when(F.col("edited"), "changed").when(F.col("opened_by") == "bad", "bad")
    out = agg.withColumn("status", status).where("status is not null")
    offset = lambda c: F.when(F.col("status") == "changed", F.col(c)).alias(c)
    return out.select("database_line", "status", offset("d_lon"), offset("d_lat"), offset("d_alt"))


def changed_positions(towers: DataFrame, folded: DataFrame) -> DataFrame:
    """Every tower with its corrected position: null if it has no correction or is bad."""
    joined = towers.join(folded, "database_line", "left")
    moved = lambda c, d: F.when(F.col("status") == "changed", F.col(c) + F.col(d))
    return joined.select("database_line", "status", moved("lat", "d_lat").alias("new_lat"), moved("lng", "d_lon").alias("new_lng"), moved("altitude", "d_alt").alias("new_altitude"))


def offsets_from_centre(towers: DataFrame, centres: DataFrame) -> DataFrame:
    """What to store for a chosen centre (lat, lng): its offsets from the tower's position."""
    c = centres.select("database_line", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    return towers.join(c, "database_line").select("database_line", (F.col("c_lng") - F.col("lng")).alias("d_lon"), (F.col("c_lat") - F.col("lat")).alias("d_lat"))


def serialize(towers: DataFrame, folded: DataFrame) -> DataFrame:
    """Lines of a corrections file, keyed by site: idx, line ("date,line,lon,lat,height" or "date,line,false").

    Sites without a state have no line. Rows belong to the site they are keyed by, whatever gaps come before.
    """
    joined = towers.select("idx", "database_date", "database_line").join(folded, "database_line")
    head = [F.col("database_date").cast("string"), F.col("database_line").cast("string")]
    values = [F.col(c).cast("string") for c in ("d_lon", "d_lat", "d_alt")]
    line = F.when(F.col("status") == "bad", F.concat_ws(",", *head, F.lit("false"))).otherwise(F.concat_ws(",", *head, *values))
    return joined.select("idx", line.alias("line"))


def _field(parts: Column, k: int) -> Column:
    return F.try_element_at(parts, F.lit(k))


def parse(lines: DataFrame, towers: DataFrame) -> DataFrame:
    """Corrections as read back: seq, idx, database_line, action, d_lon, d_lat, d_alt.

    ``lines`` has seq and line, without the header. Blank lines and those that say
    undefined are skipped, sites not among the towers are ignored, a date other
    than the tower's fails the query. Of towers that share a line number the last counts.
    """
    parts = F.split("line", ",")
    raw = lines.where(F.trim("line") != "").select("seq", _field(parts, 1).alias("date"), F.expr("try_cast(try_element_at(split(line, ','), 2) as bigint)").alias("database_line"), *[_field(parts, k).alias(f"v{k}") for k in (3, 4, 5)])
    last = towers.groupBy("database_line").agg(F.max_by("database_date", "idx").alias("own_date"), F.max("idx").alias("idx"))
    joined = raw.join(last, "database_line")
    action = F.when(F.col("v3") == "false", "bad").when(F.col("v3") == "undefined", None).otherwise("changed")
    wrong = F.coalesce(F.col("date") != F.col("own_date").cast("string"), F.lit(True))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("dates do not match at line "), F.col("database_line").cast("string"))).cast("string")).otherwise(action)
    number = lambda k: F.when(F.col("action") == "changed", F.expr(f"try_cast(v{k} as double)"))
    return joined.withColumn("action", checked).where("action is not null").select("seq", "idx", "database_line", "action", number(3).alias("d_lon"), number(4).alias("d_lat"), number(5).alias("d_alt"))


def parsed_summary(parsed: DataFrame, n_towers: int) -> DataFrame:
    """One row: how many corrections were read, the indices of the first and the last, and where to go on.

    More corrections than towers fail the query.
    """
    agg = parsed.agg(F.count("*").alias("n"), F.min_by("idx", "seq").alias("first_index"), F.max_by("idx", "seq").alias("last_index"))
    n = F.when(F.col("n") > n_towers, F.raise_error(F.lit("more corrections than towers")).cast("long")).otherwise(F.col("n"))
    after = F.when(F.col("n") > 0, F.pmod(F.col("last_index") + 1, F.lit(n_towers))).otherwise(0)
    return agg.select(n.alias("n"), "first_index", "last_index", after.cast("long").alias("go_on_at"))
