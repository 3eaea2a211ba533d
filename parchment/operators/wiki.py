"""Markdown documents with front matter, and where they are written."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions.text import blank, format_label, slug, stem
from parchment.operators import files
from parchment.plans.summary import summarize

MAX_BODY = 200_000
#: Versions of a table of documents from which on a stream makes one of them.
VERSIONS = 64
PRODUCER = "parchment"


def wiki_documents(docs: DataFrame, key: str, name: str, fmt: str, text: str, now: Column, producer: str = PRODUCER) -> DataFrame:
    """(key, file_name, markdown) of the documents with text; now: yyyy-MM-dd HH:mm."""
    d = docs.where(~blank(F.col(text))).select(key, F.col(name).alias("__name"), F.col(fmt).alias("__fmt"), F.col(text).alias("__text"), now.alias("__now"))
    s = summarize(d, key, "__text", 6, keep=("__name", "__fmt", "__text", "__now"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit("'")), F.lit('"'))
    title, n = stem(F.col("__name")), F.length("__text")
    # Keys, headings and the note of the document.
    lines = [
        F.lit("---"), F.concat(F.lit("title: "), quoted(title)), F.lit("type: source"), F.concat(F.lit("format: "), format_label(F.col("__fmt"))),
        F.lit(f"source: {producer}"), F.concat(F.lit("original: "), quoted(F.col("__name"))), F.concat(F.lit("collected: "), "__now"),
        F.concat(F.lit("updated: "), F.left("__now", F.lit(10))), F.lit(f"tags: [{producer}, auto-collected]"), F.lit("status: draft"), F.lit("---"), F.lit(""),
        F.concat(F.lit("# "), title), F.lit(""), F.lit("## 자동 요약"), F.lit(""), F.col("summary"), F.lit(""), F.lit("## 전문"), F.lit(""), F.left("__text", F.lit(MAX_BODY)),
        F.when(n > MAX_BODY, F.concat(F.lit("\n> ⚠ 본문이 길어 일부만 저장되었습니다 (원본 "), n.cast("string"), F.lit("자).")))]
    return s.select(key, slug(F.col("__name")).alias("file_name"), F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("markdown"))


def newest_by_file(docs: DataFrame, order: str) -> DataFrame:
    """One document a file name: documents of one name overwrite each other."""
    best = docs.groupBy("file_name").agg(F.max(F.struct(order, "markdown")).alias("b"))
    return best.select("file_name", F.col("b.markdown").alias("markdown"))


def write_wiki(docs: DataFrame, path: str, version: int | None = None) -> None:
    """Adds documents to the table at ``path``, in place of those with the same file name (read_wiki).

    Each call writes a version of its own beside the others and rewrites none, so it costs as much as its documents, and a job that is lost on the
    way leaves the table as it was.  version: later ones count more; by default the time.
    """
    docs.select("file_name", "markdown").write.mode("overwrite").parquet(f"{path}/version={time.time_ns() if version is None else version}")


def _versions(spark: SparkSession, path: str) -> list[int]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
    done = [v for v in found if v.startswith("version=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{v}/_SUCCESS"))]
    return sorted(int(v.partition("=")[2]) for v in done)


def read_wiki(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, markdown) of the newest version of each document; no rows where nothing was written."""
    schema, versions = "file_name string, markdown string", _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", path).schema(f"{schema}, version bigint").parquet(*[f"{path}/version={v}" for v in versions])
    if len(versions) == 1:
        return rows.drop("version")
    # of names alone, so that texts are shuffled once, by the join
    newest = rows.groupBy("file_name").agg(F.max("version").alias("version"))
    return rows.join(newest, ["file_name", "version"]).select("file_name", "markdown")


def compact_wiki(spark: SparkSession, path: str, most: int = 1) -> None:
    """One version in place of all, if there are more than ``most``.  It is whole before an old one goes, so whenever this ends, read_wiki gives the same documents."""
    versions = _versions(spark, path)
    if len(versions) > most:
        write_wiki(read_wiki(spark, path), path, versions[-1] + 1)
        for v in versions:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_markdown(docs: DataFrame, folder: str) -> DataFrame:
    """(file_name, done, message): each document as a file of its own in ``folder``, in place of one with its name; of several with one name the largest by text."""
    one = docs.groupBy("file_name").agg(F.max("markdown").alias("markdown"))
    return files.each(one, "file_name", lambda r: files.write(f"{folder}/{r['file_name']}", r["markdown"].encode()))
