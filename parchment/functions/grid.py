"""Expressions over cells, rows and grids (array<array<string>>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions.text import blank, strip

MAX_ROWS, MAX_COLS = 400, 40
_LONG = 9.2e18


def format_number(raw: Column) -> Column:
    """A stored number without floating-point residue; what is no number, or too large to round, stays."""
    d = raw.try_cast("double")
    r = F.floor(d * 10000 + 0.5) / 10000
    tidy = F.when(r == F.floor(r), r.cast("long").cast("string")).otherwise(r.cast("string"))
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) * 10000 > _LONG), raw).when((F.length(raw) > 15) | F.contains(raw, F.lit(".")), tidy).otherwise(raw)


def truth(raw: Column) -> Column:
    return F.when(raw == "1", "TRUE").otherwise("FALSE")


def column_index(ref: Column) -> Column:
    """B3 -> 1; without letters or reference -1."""
    letters = F.regexp_extract(F.upper(F.coalesce(ref, F.lit(""))), "^([A-Z]*)", 1)
    return F.when(letters == "", -1).otherwise(F.aggregate(F.split(letters, ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1)


def display_units(line: Column) -> Column:
    """Width of a line, wide characters counting twice."""
    return F.length(line) + F.length(F.regexp_replace(line, r"[\x{0000}-\x{2E80}]", ""))


def column_width(lines: Column, first: Column) -> Column:
    """Pixels of a column from the lines of all its cells; first: the first of at least two columns."""
    widest = F.coalesce(F.array_max(F.transform(lines, display_units)), F.lit(0))
    return F.least(F.greatest(widest * 8 + 20, F.when(first, 88).otherwise(72)), F.lit(280))


def column_widths(lines: DataFrame, keys: list[str], line: str, first: Column) -> DataFrame:
    """(keys, width) of columns from rows of lines; first: as for column_width.  A grouped maximum, so nothing is gathered."""
    w = lines.withColumn("__f", first).groupBy(*keys).agg(F.max(display_units(F.col(line))).alias("__w"), F.max("__f").alias("__f"))
    return w.select(*keys, F.least(F.greatest(F.col("__w") * 8 + 20, F.when(F.col("__f"), 88).otherwise(72)), F.lit(280)).cast("int").alias("width"))


def grid_width(grid: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(grid, F.size)), F.lit(0))


def cell(grid: Column, row: Column, col: Column) -> Column:
    """A cell of a ragged grid; beyond a row's end it is empty."""
    return F.coalesce(F.get(F.get(grid, row), col), F.lit(""))


def pad_rows(grid: Column) -> Column:
    """All rows as wide as the widest."""
    width = grid_width(grid)
    return F.transform(grid, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def is_label(col: Column, columns: Column, text: Column) -> Column:
    """A short cell in the first of several columns."""
    return (col == 0) & (columns >= 2) & (F.length(text) <= 12)


def drop_empty_rows(grid: Column) -> Column:
    return F.filter(grid, lambda r: F.exists(r, lambda x: ~blank(x)))


def compact_grid(grid: Column) -> Column:
    """Without rows and then columns that are blank throughout; as many columns as the first row kept."""
    rows = drop_empty_rows(grid)
    cols = F.filter(F.sequence(F.lit(0), F.size(F.get(rows, 0)) - 1), lambda c: F.exists(rows, lambda r: ~blank(F.get(r, c))))
    return F.when(F.size(rows) == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(rows, lambda r: F.transform(cols, lambda c: F.get(r, c))))


def dense_row(cells: Column, limit: int = MAX_COLS) -> Column:
    """map<int,string> -> array<string> up to the last column, gaps empty."""
    width = F.least(F.array_max(F.map_keys(cells)) + 1, F.lit(limit))
    return F.when(F.size(cells) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.coalesce(F.try_element_at(cells, c), F.lit(""))))


def limit_rows(grid: Column, rows: int = MAX_ROWS, cols: int = MAX_COLS) -> Column:
    """struct(rows, truncated)."""
    return F.struct(F.transform(F.slice(grid, 1, rows), lambda r: F.slice(r, 1, cols)).alias("rows"), (F.size(grid) > rows).alias("truncated"))


def grid_text(grid: Column) -> Column:
    return F.array_join(F.transform(grid, lambda r: F.array_join(r, "\t")), "\n")


def blocks_text(blocks: Column) -> Column:
    """Plain text of array<struct<kind,text,bullet,runs,rows>>: a line a block, cells by tabs, no images."""
    body = lambda b: (F.when(b["kind"] == "image", None).when(b["kind"] == "table", grid_text(b["rows"]))
                      .when(b["kind"] == "rich", F.array_join(F.transform(b["runs"], lambda r: r["text"]), ""))
                      .otherwise(F.concat(F.when((b["kind"] == "para") & F.coalesce(b["bullet"], F.lit(False)), "• ").otherwise(""), b["text"])))
    return strip(F.array_join(F.transform(blocks, body), "\n"))
