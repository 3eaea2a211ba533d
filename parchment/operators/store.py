"""What is kept: the catalog as JSON, media of files, edited texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment import schemas
from parchment.functions.text import detect_format, editable
from parchment.operators.catalog import known_format
from parchment.sources.registry import display_name

# Messages of an edit.
SAVED = "저장되었습니다."
NOT_SAVED = "저장 실패 (읽기 전용 문서일 수 있습니다. 문서를 다시 추가해 주세요): "

_JSON = "id string, uri string, name string, format string, importedAt bigint"


def imported(raw: DataFrame, at: Column) -> DataFrame:
    """Catalog rows of files, with an id that a second import of the same address gives again."""
    name = display_name(F.col("name"), F.col("uri"))
    return raw.select(F.sha2(F.col("uri").cast("binary"), 256).alias("id"), "uri", name.alias("name"), detect_format(name, F.col("mime")).alias("format"), at.alias("imported_at"))


def to_json(catalog: DataFrame) -> DataFrame:
    """(json): a catalog row as an object; times in milliseconds."""
    return catalog.select(F.to_json(F.struct("id", "uri", "name", "format", F.unix_millis("imported_at").alias("importedAt"))).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    """CATALOG rows of (json); an unknown format becomes UNKNOWN, what is no object with an address goes."""
    r = rows.select(F.from_json("json", _JSON).alias("r")).where(F.col("r.uri").isNotNull())
    return r.select("r.id", "r.uri", "r.name", known_format(F.col("r.format")).alias("format"), F.timestamp_millis("r.importedAt").alias("imported_at"))


def save_catalog(catalog: DataFrame, path: str) -> None:
    """Rewrites the catalog; path must not be what catalog is read from."""
    to_json(catalog).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The newest first; where nothing was saved, no rows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schemas.CATALOG)
    return from_json(spark.read.text(path).select(F.col("value").alias("json"))).orderBy(F.desc("imported_at"))


def write_media(media: DataFrame, path: str) -> None:
    """Adds media that aren't stored yet, by the hash of their file's address and their base name."""
    spark = media.sparkSession
    m = media.select(F.sha2(F.col("uri").cast("binary"), 256).alias("key"), F.element_at(F.split("media_name", "/"), -1).alias("media_name"), "data")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        m = m.join(spark.read.parquet(path).select("key", "media_name"), ["key", "media_name"], "left_anti")
    m.dropDuplicates(["key", "media_name"]).write.mode("append").parquet(path)


def write_texts(edits: DataFrame, write: Callable[[str, bytes], None]) -> DataFrame:
    """(uri, saved, message) of edits (uri, format, text).

    Only text and Markdown files are written, as UTF-8; write(uri, bytes) replaces a file and is called on the executors.
    """
    d = edits.select("uri", editable(F.col("format")).alias("may"), "text")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = []
            for uri, may, text in zip(p["uri"], p["may"], p["text"], strict=True):
                try:
                    if not may:
                        raise PermissionError("format")
                    write(uri, (text or "").encode())
                    rows.append((uri, True, SAVED))
                except Exception as e:  # noqa: BLE001  of one file, not of the job
                    rows.append((uri, False, f"{NOT_SAVED}{e}"))
            yield pd.DataFrame(rows, columns=["uri", "saved", "message"])

    return d.mapInPandas(run, "uri string, saved boolean, message string")
