"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Each text is cut into words, its K-word grams are hashed, and of every window of W grams
the smallest hash is kept.  A span of N = K + W - 1 words holds exactly W grams, so two texts that share
such a span keep the same hash there: joining the kept hashes of documents and benchmark
finds a part of every shared span.  Each hit is then extended: all N-word windows around it
are compared, as text, with the windows of the benchmark items, so false hits vanish.

Items of fewer than N words have one window, the whole item.  Winnowing promises nothing
about so short a span, so for the (at most N - 1) lengths that occur every gram of that
length is joined.

Nulls: a null text has no words.  An item with a null id still marks words but is in no item
list.  Repeated rows: every row gets its own result row; rows equal in doc_id and text get
equal ones.  Other columns are ignored.  Empty tables: no rows, or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import cut, maybe_broadcast, table

N, K = 10, 5
W = N - K + 1
#: What separates words: every ASCII character that is no letter or digit (in lower-cased text, capitals too).
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_words(text: Column) -> Column:
    """Words in their own case."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def words(text: Column) -> Column:
    """Words with A-Z lower-cased, other letters as they are."""
    return raw_words(F.translate(text, _UP, _LOW))


def _grams(h: Column, n: int) -> Column:
    """(31-bit hash << 32 | position) of each run of n word hashes."""
    top = F.size(h) - n
    return F.when(top >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(top, F.lit(0))),
        lambda i: F.shiftleft(F.xxhash64(F.lit(n), *[F.get(h, i + j) for j in range(n)]).bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(i.cast("long")),
    )).otherwise(F.array().cast("array<bigint>"))


def _winnow(g: Column) -> Column:
    """The smallest gram of every W; all of them fall on one where a window slides without change."""
    top = F.size(g) - W
    return F.when(top >= 0, F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.greatest(top, F.lit(0))), lambda i: F.least(*[F.get(g, i + j) for j in range(W)])
    ))).otherwise(F.array().cast("array<bigint>"))


def _hashed(df: DataFrame, text: str) -> DataFrame:
    """Columns h (hashes of lower-cased words) and g (all K-grams), each a projection of its own."""
    df = df.withColumn("w", raw_words(F.col(text)))
    return df.withColumn("h", F.transform("w", lambda w: F.xxhash64(F.lower(w)))).drop("w")


def item_windows(items: DataFrame) -> DataFrame:
    """(window, n, item_ids): the distinct windows of items (item, text)."""
    w = items.select("item", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.select("item", F.least(F.size("w"), F.lit(N)).alias("n"), "w")
    w = w.select("item", "n", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("w") - F.col("n")), lambda i: F.array_join(F.slice("w", i + 1, F.col("n")), " "))).alias("window"))
    return w.groupBy("window", "n").agg(F.collect_set("item").alias("item_ids"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, key, n_words, n_hit, item_ids) for each row of docs; key hashes doc and text."""
    docs = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc", "text"))
    items = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))

    windows = cut(item_windows(items), "windows")
    short = sorted(r.n for r in windows.where(F.col("n") < N).select("n").distinct().collect())  # at most N - 1 values
    bench = _hashed(items.where(F.size(raw_words(F.col("text"))) > 0).select("text"), "text")
    n = F.size("h")
    marks = bench.where(n >= N).withColumn("g", _grams(F.col("h"), K)).select(F.lit(0).alias("len"), F.explode(_winnow(F.col("g"))).alias("v"))
    for k in short:
        marks = marks.unionByName(bench.where(n == k).select(F.lit(k).alias("len"), F.explode(_grams(F.col("h"), k)).alias("v")))
    marks = cut(marks.select(F.shiftright("v", 32).alias("m"), "len").distinct(), "marks")
    marks = maybe_broadcast(marks, marks.count(), 32)

    hashed = _hashed(docs, "text").withColumn("g", _grams(F.col("h"), K))
    kept = [F.array(F.lit(-1).cast("long")), _winnow(F.col("g")), *[_grams(F.col("h"), k) for k in short]]
    found = hashed.select("doc", "key", F.size("h").alias("n_words"), F.explode(F.concat(*kept)).alias("v"))
    # a document's own row, which joins with nothing, has a key below zero of its own, so that a shuffled join spreads them
    found = found.withColumn("m", F.when(F.col("v") >= 0, F.shiftright("v", 32)).otherwise(-1 - F.xxhash64("key").bitwiseAND(F.lit((1 << 62) - 1)))).join(marks, "m", "left")
    found = found.where(F.col("v").eqNullSafe(-1) | F.col("len").isNotNull())
    found = cut(found.select("doc", "key", "n_words", F.when(F.col("v") >= 0, F.col("v").bitwiseAND(F.lit(0xFFFFFFFF))).cast("int").alias("at"), "len"), "hits")

    rows = found.where(F.col("at").isNull()).select("doc", "key", "n_words")
    hits = found.where(F.col("at").isNotNull()).groupBy(F.col("key").alias("hit_key")).agg(F.collect_set(F.struct("at", "len")).alias("hits"))
    size = found.where(F.col("at").isNotNull()).count()
    near = docs.join(maybe_broadcast(hits, size, 64), F.col("key") == F.col("hit_key")).select("doc", "key", "hits", words(F.col("text")).alias("w"))
    # a hit of a kept gram extends to the windows that hold it, a hit of a short gram is its own window
    spans = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.when(
        x["len"] > 0, F.array(F.struct(x["at"].alias("s"), x["len"].alias("n")))
    ).otherwise(F.transform(
        F.sequence(F.greatest(x["at"] - (W - 1), F.lit(0)), F.least(x["at"], F.size("w") - N)), lambda s: F.struct(s.alias("s"), F.lit(N).alias("n")))))))
    near = near.select("doc", "key", F.explode(F.transform(spans, lambda x: F.struct(
        x["s"].alias("s"), x["n"].alias("n"), F.array_join(F.slice("w", x["s"] + 1, x["n"]), " ").alias("window")))).alias("x"))
    near = near.select("doc", "key", F.col("x.s").alias("s"), F.col("x.n").alias("n"), F.col("x.window").alias("window"))
    sure = near.join(maybe_broadcast(windows, windows.count(), 512), ["window", "n"]).groupBy("doc", "key").agg(
        F.array_sort(F.collect_set(F.struct("s", (F.col("s") + F.col("n")).alias("e")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(
        F.greatest(a["end"], x["e"]).alias("end"),
        (a["n"] + F.greatest(x["e"] - F.greatest(a["end"], x["s"]), F.lit(0))).alias("n")))
    sure = sure.select(F.col("doc").alias("sure_doc"), F.col("key").alias("sure_key"), covered["n"].alias("n_hit"), "item_ids")
    out = rows.join(sure, (F.col("key") == F.col("sure_key")) & F.col("doc").eqNullSafe(F.col("sure_doc")), "left")
    return out.select("doc", "key", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select(
        F.col("doc").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The same by joining every window of every document, without fingerprints.
SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0))),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, win)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
