"""Document fingerprints: every hash below a fixed fraction of the hash range is kept.

The shingles are the GRAM-byte substrings of a text (a shorter text, but not an empty one, is one
shingle), so that short texts too have some.  Of their 64-bit hashes those below
FRACTION of the range are kept, without a bound on their number: sketches of parts merge by union, and the
kept hashes of two texts of very different length are still samples of the same universe.  Likeness is the
estimated containment of the smaller sketch in the larger, |A & B| / min(|A|, |B|).

A fingerprint is ``<hash of the whole text>.<kept hashes, 5 bytes each, sorted, base64>``.  Where one sketch
is empty likeness is 0, where both are it is 1 for equal fingerprints and 0 for others; equal
fingerprints always have 1.

The next document: rows are ordered by doc_id (nulls first), then by a hash of the text and the text; the last row's next is the
first row.  Rows are dealt to parts by ranges of doc_id, an id that fills several by ranges of the hash too, and the first rows of each part go to
the part before it as well, so each text is shuffled once.  Nulls are empty texts.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import default_parallelism, map_arrow, table
from llm.kernels import _pow, mix, pieces, span_hashes

GRAM = 16
FRACTION = 16
_FIRST = -(1 << 63)


def sketches(data: np.ndarray, offsets: np.ndarray, gram: int = GRAM, fraction: int = FRACTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each whole row, kept 40-bit hashes sorted within rows, their bounds)."""
    n, rows = len(data), len(offsets) - 1
    whole = span_hashes(data, offsets[:-1], offsets[1:]) if n else np.full(rows, mix(np.zeros(1, np.uint64))[0])
    limit = np.uint64((1 << 64) // fraction)
    size = np.diff(offsets)
    if n >= gram:
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _pow("up", n)[:n], out=prefix[1:])
        g = mix((prefix[gram:] - prefix[:-gram]) * _pow("down", n)[: n - gram + 1])
        at = np.flatnonzero(g < limit)
        row = np.searchsorted(offsets, at, "right") - 1
        ok = at + gram <= offsets[row + 1]
        row, h = row[ok], g[at[ok]]
    else:
        row, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((size > 0) & (size < gram) & (whole < limit))
    row, h = np.concatenate([row, short]), np.concatenate([h, whole[short]])
    h = h & np.uint64((1 << 40) - 1)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    row, h = row[keep], h[keep]
    return whole, h, np.searchsorted(row, np.arange(rows + 1))


def _strings(whole: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> list[str]:
    raw = np.ascontiguousarray(h.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
    return [f"{w:016x}.{base64.b64encode(raw[5 * a : 5 * b]).decode()}" for w, a, b in zip(whole.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _keys(h: np.ndarray, bounds: np.ndarray, rows: slice) -> np.ndarray:
    a, b = bounds[rows.start], bounds[rows.stop]
    return (np.repeat(np.arange(rows.stop - rows.start, dtype=np.uint64), np.diff(bounds[rows.start : rows.stop + 1])) << np.uint64(40)) | h[a:b]


def _likeness(x: tuple, y: tuple, n: int, shift: int) -> np.ndarray:
    """Of row i of x and row i + shift of y, for n rows."""
    (wx, hx, bx), (wy, hy, by) = x, y
    a, b = _keys(hx, bx, slice(0, n)), _keys(hy, by, slice(shift, n + shift))
    both = np.bincount((np.intersect1d(a, b, assume_unique=True) >> np.uint64(40)).astype(np.int64), minlength=n)
    least = np.minimum(np.diff(bx)[:n], np.diff(by)[shift : n + shift])
    return np.where(wx[:n] == wy[shift : n + shift], 1.0, both / np.maximum(least, 1))


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (doc, text) and a last row that is only a next one."""
    texts = [t for _, t in rows]
    edited = [t[: len(t) - len(t) // 4] + after[: len(t) // 4] for t, after in zip(texts[:-1], texts[1:], strict=True)]
    # every piece of the sketches covers whole rows, so pieces can be put together
    def of(values: list[str]) -> tuple:
        parts = [sketches(data, offsets) for _, _, data, offsets in pieces(pa.array(values, pa.large_string()))]
        bounds = np.cumsum(np.concatenate([[0], *[np.diff(p[2]) for p in parts]]))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), bounds
    own, new, n = of(texts), of(edited), len(edited)
    return pa.RecordBatch.from_arrays([
        pa.array([d for d, _ in rows[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array(_strings(own[0][:n], own[1], own[2][: n + 1])), pa.array(_strings(*new)),
        pa.array(_likeness(own, new, n, 0)), pa.array(_likeness(own, own, n, 1))],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, tail, id, doc, text) sorted by the first three and text."""
    last, rows, size = None, [], 0
    for batch in it:
        for part, tail, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if part != last:
                if len(rows) > 1:
                    yield _pairs(rows)
                last, rows, size, ended = part, [], 0, False
            elif ended:
                continue
            rows.append((doc, text))
            ended = bool(tail)
            size += len(text)
            if size > 1 << 21 and len(rows) > 1:
                yield _pairs(rows)
                rows, size = rows[-1:], len(text)
    if len(rows) > 1:
        yield _pairs(rows)


def _bounds(quantiles: list[int]) -> list[tuple[int, int]]:
    """Sorted first (id, hash) of all parts but the first; an id that is several quantiles has as many parts."""
    return [(v, _FIRST + k * (1 << 64) // n) for v, n in sorted(Counter(quantiles).items()) for k in range(n)]


def _part(id_: Column, hash_: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many of the sorted bounds are at most (id, hash), looked up in two steps."""
    if not bounds:
        return F.lit(0)
    fan = math.isqrt(len(bounds)) + 1
    groups = [bounds[i : i + fan] for i in range(0, len(bounds), fan)]
    pair = lambda b: F.struct(F.lit(b[0]).cast("long").alias("id"), F.lit(b[1]).cast("long").alias("h"))
    heads = F.array(*[pair(g[0]) for g in groups])
    rest = F.array(*[F.array(*map(pair, g)) for g in groups])
    count = lambda a: F.size(F.filter(a, lambda b: (b["id"] < id_) | (b["id"] == id_) & (b["h"] <= hash_)))
    c = count(heads)
    return F.when(c == 0, 0).otherwise((c - 1) * fan + count(F.get(rest, c - 1)))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The fingerprint of each row and of its edited text, and their likenesses."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_FIRST)).alias("id"), F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = 3 * default_parallelism(spark)
    bounds = _bounds([int(x) for x in docs.select(F.col("id").cast("double")).approxQuantile("id", [i / parts for i in range(1, parts)], 0.1 / parts)]) if parts > 1 else []
    docs = docs.withColumn("hash", F.xxhash64("text"))
    docs = docs.withColumn("part", _part(F.col("id"), F.col("hash"), bounds))
    first = sorted((r.part, r.at.id, r.at.hash) for r in docs.groupBy("part").agg(F.min(F.struct("id", "hash")).alias("at")).collect())  # one row a part
    before = [(i, h, first[k - 1][0], 0 if k else 1) for k, (_, i, h) in enumerate(first)]
    tails = spark.createDataFrame(before, "first_id long, first_hash long, to int, wraps int")
    docs = docs.join(F.broadcast(tails), (F.col("id") == F.col("first_id")) & (F.col("hash") == F.col("first_hash")), "left")
    to = F.explode(F.when(F.col("to").isNull(), F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("tail")))).otherwise(
        F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("tail")), F.struct(F.col("to").alias("part"), F.lit(1).alias("tail")))))
    docs = docs.select(to.alias("x"), "id", "doc", "text", "hash").select("x.part", "x.tail", "id", "doc", "text", "hash")
    # each part is a task's
    docs = docs.repartitionById(len(bounds) + 1, F.col("part").cast("int")).sortWithinPartitions("part", "tail", "id", "hash", "text").drop("hash")
    return map_arrow(docs, _run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
