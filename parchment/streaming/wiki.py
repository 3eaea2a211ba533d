"""Files that arrive in a folder become Markdown documents, as a stream.

Each batch is parsed and written as a version of the table of documents (operators.wiki), so a batch that is repeated after a failure changes nothing;
the checkpoint keeps what was read.  With ``once`` the stream ends when it has read all there is, for scheduled runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parchment.functions.text import detect_format
from parchment.operators.wiki import VERSIONS, compact_wiki, newest_by_file, wiki_documents, write_wiki
from parchment.sources.registry import parse, raw_of

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def documents(raw: DataFrame, providers: dict | None = None) -> DataFrame:
    """(file_name, markdown) of RAW rows; of files with one name the newest."""
    content = parse(raw, providers).select("uri", "plain_text")
    d = raw.select("uri", "name", "modified_at", detect_format(F.col("name"), F.col("mime")).alias("format")).join(content, "uri")
    d = d.withColumn("now", F.date_format("modified_at", "yyyy-MM-dd HH:mm"))
    made = wiki_documents(d, "uri", "name", "format", "plain_text", F.col("now"))
    made = made.join(raw.select("uri", "modified_at"), "uri").select("file_name", "markdown", F.struct("modified_at", "uri").alias("at"))
    return newest_by_file(made, "at")


def stream_wiki(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, providers: dict | None = None, once: bool = True) -> StreamingQuery:
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.*").load(in_dir)

    def batch(df: DataFrame, _: int) -> None:
        write_wiki(documents(raw_of(df), providers), out_dir)
        compact_wiki(spark, out_dir, VERSIONS)

    w = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 hour")).start()
