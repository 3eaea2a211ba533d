"""The document catalog and file synchronisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions.text import FORMATS


def upsert(catalog: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows and the rows of the catalog whose key is not among them."""
    return new.unionByName(catalog.join(new.select(key), key, "left_anti"))


def remove(catalog: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The catalog without the keys of gone."""
    return catalog.join(gone.select(key), key, "left_anti")


def others(catalog: DataFrame, key: str, value: object) -> DataFrame:
    return catalog.where(F.col(key) != F.lit(value))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key; a grouped maximum, so it is combined before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("__r"))
    return best.select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def known_format(fmt: Column) -> Column:
    return F.when(fmt.isin(*[f for f, _, _ in FORMATS]), fmt).otherwise("UNKNOWN")


def base_name(name: Column) -> Column:
    """Without a copy number before .md."""
    return F.regexp_replace(name, r" \(\d+\)(?=\.md$)", "")


def latest_by_name(listing: DataFrame) -> DataFrame:
    """(base, name, mtime) of the newest file of each base name, ignoring case; of equally new ones the one without a number, then the first by name."""
    base = base_name(F.col("name"))
    r = listing.select(F.lower(base).alias("base"), "name", "mtime", (F.lower("name") == F.lower(base)).alias("own"))
    best = r.groupBy("base").agg(F.max(F.struct("mtime", "own")).alias("top"))
    first = r.groupBy("base", "mtime", "own").agg(F.min("name").alias("name"))
    return first.join(best, "base").where((F.col("mtime") == F.col("top.mtime")) & (F.col("own") == F.col("top.own"))).select("base", "name", "mtime")


def reconcile(listing: DataFrame) -> DataFrame:
    """(base, name, mtime, action) of numbered copies: the newest replaces its base if that is older or missing, the others go."""
    base = base_name(F.col("name"))
    r = listing.select(F.lower(base).alias("base"), "name", "mtime", (F.lower("name") == F.lower(base)).alias("own"))
    own = r.where("own").groupBy(F.col("base").alias("b")).agg(F.max("mtime").alias("base_mtime"))
    top = r.where("not own").groupBy(F.col("base").alias("t")).agg(F.max(F.struct("mtime", "name")).alias("top"))
    r = r.where("not own").join(own, F.col("base") == F.col("b"), "left").join(top, F.col("base") == F.col("t"))
    newest = (F.col("top.mtime") == F.col("mtime")) & (F.col("top.name") == F.col("name"))
    older = F.col("base_mtime").isNull() | (F.col("base_mtime") < F.col("mtime"))
    return r.select("base", "name", "mtime", F.when(newest & older, "replace").otherwise("delete").alias("action"))
