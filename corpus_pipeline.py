"""From raw documents to token ids: five stages, each over all rows its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, whatever they are named.  Null ids,
null and empty texts and repeated rows: language ID drops texts without a letter; of the copies of a document one stays, rows with a
null id all stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import decontaminate, jaccard, langid, pieces, pii
from llm.common import cut, fresh, mark, maybe_broadcast, sweep_since, table

#: Least share of a text's n-grams with a letter that the best language has; short texts (langid.ENOUGH) stay without it.
LANGUAGE_SCORE = 0.35


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose (doc, key) is in gone; key is the hash of doc_id and text."""
    key, doc = fresh(docs, "gone_key"), fresh(docs, "gone_doc")
    gone = cut(gone.select(F.col("key").alias(key), F.col("doc").alias(doc)).distinct(), "gone")
    own = F.xxhash64(docs["doc_id"], docs["text"])
    return docs.join(maybe_broadcast(gone, gone.count(), 24), (own == F.col(key)) & docs["doc_id"].eqNullSafe(F.col(doc)), "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language."""
    return langid.keep_identified(docs, langid.fit(docs), LANGUAGE_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the smallest doc_id, once; documents without an id all stay."""
    found = cut(jaccard.jaccard_components(docs), "components")
    n, ids = found.agg(F.count("doc"), F.countDistinct("doc")).first()
    name = fresh(docs, "gone")
    gone = cut(found.where(F.col("doc") != F.col("component")).select(F.col("doc").alias(name)).distinct(), "gone")
    kept = docs.join(maybe_broadcast(gone, gone.count(), 16), docs["doc_id"] == F.col(name), "left_anti")
    if n == ids:
        return kept
    text = fresh(docs, "text_key")
    known = kept.where(F.col("doc_id").isNotNull()).withColumn(text, F.xxhash64("text")).dropDuplicates(["doc_id", text]).drop(text)
    return known.unionByName(kept.where(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window."""
    return _without(docs, decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where(F.col("n_hit") > 0))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts."""
    out = pii.redact_pii(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids, ids_sha256, round_trip)."""
    return pieces.encode(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("sentencepiece", tokenize),
]
#: The stages can't be written in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of the documents that are kept.  Each stage's output is written; what was written before it is then deleted."""
    docs, before = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        sweep_since(before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
