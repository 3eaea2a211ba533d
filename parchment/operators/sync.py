"""Synchronisation of Markdown documents between folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.operators import files
from parchment.operators.catalog import base_name, latest_by_name, reconcile


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(name, mtime, path) of the Markdown files directly in folder."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("mtime"), "path")


def collect(spark: SparkSession, source: str, inbox: str) -> DataFrame:
    """(base, done, message): of each base name the newest file of source, copied to inbox under that name; repeating it changes nothing more."""
    found = listing(spark, source)
    newest = latest_by_name(found.select("name", "mtime")).join(found, ["name", "mtime"])
    rows = newest.select(base_name(F.col("name")).alias("base"), "path")
    return files.each(rows, "base", lambda r: files.copy(r["path"], f"{inbox}/{r['base']}"))


def clean(spark: SparkSession, inbox: str) -> DataFrame:
    """(name, done, message): what reconcile() says of the numbered copies in inbox, carried out.

    A copy that is newer takes its base's place in one step, the others are deleted; so whenever this ends, the newest document of each
    base is there, and running it again does what is left.
    """
    found = listing(spark, inbox)
    actions = reconcile(found.select("name", "mtime")).join(found.select("name", "path"), "name").select("name", "action", "path", base_name(F.col("name")).alias("to"))

    def do(r: dict) -> None:
        if r["action"] == "replace":
            files.move(r["path"], f"{r['path'].rpartition('/')[0]}/{r['to']}")
        else:
            files.delete(r["path"])

    return files.each(actions, "name", do)
