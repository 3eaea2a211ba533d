"""Extractive summaries: the sentences whose words are the document's most frequent.

A document is a row: its sentences are split by expressions, scored together in a vectorised function that gets nothing but them,
and put together by expressions again.  So no text is shuffled, and rows with one key, or none, have each their own summary.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions.text import STOPWORDS, sentence_list, strip, token_list, topical

# Fixed value: what stands for the summary of nothing.
NOTHING = "요약할 텍스트가 없습니다."

_TOKEN = regex.compile(r"[\p{L}\p{N}]+")
_STOP = frozenset(STOPWORDS)


def _clean(df: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """(key, keep, clean, sents)."""
    d = df.select(key, *keep, strip(F.coalesce(F.col(text), F.lit(""))).alias("clean"))
    return d.withColumn("sents", sentence_list(F.col("clean")))


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, sentence)."""
    return df.select(key, F.posexplode(sentence_list(F.col(text))).alias("idx", "sentence"))


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, token): the topical tokens of each sentence."""
    t = sentences(df, key, text).select(key, "idx", F.explode(token_list(F.col("sentence"))).alias("token"))
    return t.where(topical(F.col("token")))


def word_frequency(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, n)."""
    return tokens(df, key, text).groupBy(key, F.col("token").alias("word")).agg(F.count("*").alias("n"))


def scores_of(sents: list[str]) -> list[float | None]:
    """Of each sentence the mean frequency in the document of its topical tokens, or None where it has none."""
    words = [[w for w in _TOKEN.findall(s.lower()) if len(w) > 1 and w not in _STOP] for s in sents]
    count = Counter(w for own in words for w in own)
    return [sum(map(count.__getitem__, own)) / len(own) if own else None for own in words]


def best_of(sents: list[str], k: int) -> list[int] | None:
    """Places, in order, of the k sentences with the highest scores, the first of equal ones; those without a score fill up.  None if none has one."""
    scores = scores_of(sents)
    ranked = sorted((i for i, x in enumerate(scores) if x is not None), key=lambda i: (-scores[i], i))
    if not ranked:
        return None
    rest = (i for i, x in enumerate(scores) if x is None)
    best = ranked[:k]
    return sorted(best + [i for i, _ in zip(rest, range(k - len(best)))])


def _scores(sents: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(sents: pa.Array) -> pa.Array:
        return pa.array([None if s is None else [x or 0.0 for x in scores_of(s)] for s in sents.to_pylist()], pa.list_(pa.float64()))

    return run(sents)


def _best(sents: Column, k: int) -> Column:
    @F.arrow_udf("array<int>")
    def run(sents: pa.Array) -> pa.Array:
        return pa.array([None if s is None else best_of(s, k) for s in sents.to_pylist()], pa.list_(pa.int32()))

    return run(sents)


def sentence_scores(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, sentence, score); a sentence without topical tokens has 0."""
    d = _clean(df, key, text).select(key, "sents").withColumn("scores", _scores(F.col("sents")))
    return d.select(key, F.posexplode(F.arrays_zip("sents", "scores")).alias("idx", "s")).select(key, "idx", F.col("s.sents").alias("sentence"), F.col("s.scores").alias("score"))


def summarize(df: DataFrame, key: str, text: str, max_sentences: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, summary); the columns of keep are taken along."""
    k = max_sentences
    d = _clean(df, key, text, *keep)
    # only what has too many sentences is scored
    d = d.withColumn("best", _best(F.when(F.size("sents") > k, F.col("sents")), k))
    lines = F.array_join(F.transform("best", lambda i: F.concat(F.lit("• "), strip(F.get("sents", i)))), "\n")
    out = (F.when(F.col("clean") == "", NOTHING).when(F.size("sents") <= k, F.col("clean"))
           .when(F.col("best").isNull(), F.array_join(F.slice("sents", 1, k), " ")).otherwise(lines))
    return d.select(key, *keep, out.alias("summary"))


def key_points(df: DataFrame, key: str, text: str, count: int = 5) -> DataFrame:
    """(key, pos, point): the lines of the summary without their dots."""
    s = summarize(df, key, text, count)
    points = F.filter(F.transform(F.split(F.col("summary"), "\r\n|\n|\r"), lambda x: strip(F.regexp_replace(x, "^• ", ""))), lambda x: x != "")
    return s.select(key, F.posexplode(points).alias("pos", "point"))
