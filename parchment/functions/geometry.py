"""Colours, rectangles and positional folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Where elements without a rectangle of their own go (x, y, w, h as parts of the slide).
TITLE_RECT = (0.05, 0.04, 0.9, 0.14)
PICTURE_RECT = (0.1, 0.2, 0.8, 0.6)
TABLE_RECT = (0.05, 0.2, 0.9, 0.6)


def rgb_of_hex(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("int")


def swap_red_blue(bgr: Column) -> Column:
    return F.shiftleft(bgr.bitwiseAND(0xFF), 16).bitwiseOR(bgr.bitwiseAND(0xFF00)).bitwiseOR(F.shiftright(bgr, 16).bitwiseAND(0xFF))


def _channels(rgb: Column, f) -> Column:
    """f on each channel, as a part of 1 in single precision; the result is clamped and rounded half up."""
    out = F.lit(0)
    for shift in (16, 8, 0):
        x = f((F.shiftright(rgb, shift).bitwiseAND(0xFF) / 255).cast("float"))  # division is done in double precision
        byte = F.floor(F.least(F.greatest(x.cast("float"), F.lit(0.0).cast("float")), F.lit(1.0).cast("float")) * F.lit(255.0).cast("float") + F.lit(0.5).cast("float")).cast("int")
        out = out.bitwiseOR(F.shiftleft(byte, shift))
    return out


def adjust_colour(rgb: Column, mod: Column, off: Column, tint: Column, shade: Column) -> Column:
    """Luminance factor, luminance offset, tint and shade, in this order, each in 1/100000; null changes nothing."""
    part = lambda v: (v / 100000).cast("float")
    one = F.lit(1.0).cast("float")
    for v, f in ((mod, lambda x: x * part(mod)), (off, lambda x: x + part(off)), (tint, lambda x: x * part(tint) + (one - part(tint))), (shade, lambda x: x * part(shade))):
        rgb = F.when(v.isNull(), rgb).otherwise(_channels(rgb, f))
    return rgb


def normalize_rect(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Lengths as parts of the slide."""
    return F.struct((x / width).alias("x"), (y / height).alias("y"), (w / width).alias("w"), (h / height).alias("h"))


def map_to_group(v: Column, origin: Column, child_origin: Column, extent: Column, child_extent: Column) -> Column:
    """A coordinate of a group's child in those of the group's parent; whole numbers."""
    scaled, whole = ((v - child_origin) * extent).cast("long"), F.greatest(child_extent, F.lit(1)).cast("long")
    return origin + F.call_function("div", scaled, whole)  # towards zero


def layout_cursor(elements: Column, unit: int = 1000) -> Column:
    """The cursor after a list of struct<y,h> in 1/unit: below the last text box with a height, 0.9 at most, 0.05 at first."""
    low, high, gap = unit * 5 // 100, unit * 9 // 10, unit * 2 // 100
    return F.aggregate(elements, F.lit(low).cast("long"), lambda a, e: F.when(e["h"] > 0, F.least(F.lit(high).cast("long"), e["y"] + e["h"] + gap)).otherwise(a))


def visible(records: Column) -> Column:
    """Of ordered struct<level,ctrl,...>, those outside excluded controls; one hides the deeper records after it."""
    state = F.aggregate(
        records, F.struct(F.lit(-1).alias("skip"), F.array().cast("array<int>").alias("shown")),
        lambda a, r: F.struct(
            F.when(r["ctrl"] & ((a["skip"] < 0) | (r["level"] <= a["skip"])), r["level"]).when(r["level"] <= a["skip"], -1).otherwise(a["skip"]).alias("skip"),
            F.when((a["skip"] >= 0) & (r["level"] > a["skip"]), a["shown"]).otherwise(F.concat(a["shown"], F.array(r["pos"]))).alias("shown")))
    return state["shown"]


def resolve_path(base: Column, target: Column) -> Column:
    """A part's path from a relation: absolute, relative with .. steps, or below base."""
    parts = F.split(F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), target), "/")
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return (F.when(target.startswith("/"), F.substr(target, F.lit(2))).when(target.startswith("../"), F.array_join(up, "/"))
            .when(target.startswith("ppt/"), target).otherwise(F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), target)))


def segment_runs(runs: DataFrame, key: str, start: str, length: Column, text: Column) -> DataFrame:
    """Adds the text from each run's start to the next one's; the last goes to the end."""
    end = F.lead(start).over(W.partitionBy(key).orderBy(start))
    return runs.withColumn("segment", F.substr(text, F.col(start) + 1, F.coalesce(end, length) - F.col(start)))


def fill_columns(cells: DataFrame, row: list[str], order: str, ref_col: str) -> DataFrame:
    """Adds the column of each cell of a row: its own, or the one after the cell before."""
    w = W.partitionBy(*row).orderBy(order)
    seen = w.rowsBetween(W.unboundedPreceding, 0)
    island = F.count(ref_col).over(seen)
    cells = cells.withColumn("__island", island)
    nth = F.row_number().over(W.partitionBy(*row, "__island").orderBy(order))
    base = F.first(ref_col, ignorenulls=True).over(W.partitionBy(*row, "__island").orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return cells.withColumn("col", F.when(F.col("__island") == 0, nth - 1).otherwise(base + nth - 1).cast("int")).drop("__island")
