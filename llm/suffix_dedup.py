"""Removal of repeated byte strings with a suffix array built in two stages.

A byte goes if a SPAN-byte string that covers it also starts anywhere else, in any document.

Only few suffixes are sorted directly.  Of every SPAN-byte window the GRAM-byte gram with the
smallest hash is an anchor: like the suffixes smaller than their successors in two-stage sorting, anchors are
local minima that the text itself picks, so every copy of a window has its anchor at the same place.

1. Anchors (hash, text, position) of all texts, about one in 170 bytes.  An anchor whose hash occurs
   once lies in no repeated window.  Texts that are equal count once here; if they have SPAN bytes
   they are removed whole.
2. Each remaining anchor takes its context along, SPAN - GRAM bytes before it and SPAN bytes
   from it on, to the task of its hash.  There the anchors' suffixes are sorted and the common prefixes of neighbours
   measured.  All other suffixes are induced: those one byte further left are the same
   suffixes after a stable scan into the buckets of the new first byte, their common prefixes the minimum
   over the skipped neighbours plus one.  A suffix that shares SPAN bytes with a neighbour is a repeat.
3. An anchor with more than HOT occurrences is split before it is sorted: its windows by how many bytes they have before the anchor, in
   ranges, and the windows of a range by the bytes that all of them hold (128 bits of hashes), as windows that differ there are
   no repeats of each other.  What is still more than HOT is split in finer ranges; in a range of one place the
   windows of one key are equal and none is left to sort.  Keys are counted before the shuffle, and those of one place go.
4. The covered stretches of each text are merged and cut out.

Nulls are empty texts.  Repeated rows are other places: their texts are repeats.  A null doc_id stays null.
Other columns are ignored.  A text is known by a 64-bit hash, or, where several texts have it, by a second one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import cut, default_parallelism, lean_group, map_arrow, maybe_broadcast, ship, table
from llm.kernels import _pow, buffers, mix, pieces, regroup

SPAN, GRAM = 400, 64
#: Occurrences of an anchor, or of a key, from which on it is split.
HOT = 10_000
#: Into how many ranges at each step.
PARTS = 8
#: Contexts that one task gathers, about.
GATHER = 16_000


def find_anchors(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(rows, positions, hashes, contexts' starts, ends and hashes) of the anchors of all windows that lie within one row."""
    n, w = len(data), span - gram + 1
    inside = np.zeros(max(n - span, 0) + 2, np.int64)
    long = np.diff(offsets) >= span
    if not long.any():
        zero = np.zeros(0, np.int64)
        return zero, zero, zero.view(np.uint64), zero, zero, zero.view(np.uint64)
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - span + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _pow("up", n)[:n], out=prefix[1:])
    g = mix((prefix[gram:] - prefix[:-gram]) * _pow("down", n)[: n - gram + 1])
    low = np.uint64((1 << max(21, n.bit_length())) - 1)
    best = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    size = 1
    while size * 2 <= w:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < w:
        best = np.minimum(best[: len(best) - (w - size)], best[w - size :])
    best = best[inside[: len(best)]]
    at = np.unique(best[np.concatenate([[True], best[1:] != best[:-1]])] & low).astype(np.int64)
    row = np.searchsorted(offsets, at, "right") - 1
    start, end = np.maximum(at - (span - gram), offsets[row]), np.minimum(at + span, offsets[row + 1])
    context = mix(mix((prefix[end] - prefix[start]) * _pow("down", n)[start]) + (end - start).astype(np.uint64) + ((at - start).astype(np.uint64) << np.uint64(32)))
    return row, at, g[at], start, end, context


def _anchor_rows(span: int, gram: int):
    """(h, tid, at, end): an anchor, where end is null, or a stretch from at to end that is repeated.

    Of anchors with equal contexts in one batch one stays, as repeats in rows of the same words have one for each of
    them: all windows of such contexts are repeats.
    """
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regroup(it):
            tids = batch.column(0).to_numpy()
            seen: set[int] = set()
            parts, texts, size = [], [], 0
            for a, b, data, offsets in pieces(batch.column(1)):
                row, at, h, start, end, context = find_anchors(data, offsets, span, gram)
                if not len(at):
                    continue
                fresh = np.array([not (t in seen or seen.add(t)) for t in tids[a:b].tolist()], bool)[row]
                row, base = row[fresh], offsets[row[fresh]]
                parts.append((h[fresh], tids[a:b][row], at[fresh] - base, start[fresh] - base, end[fresh] - base, mix(context[fresh] ^ h[fresh]), start[fresh] + size))
                texts.append(data)
                size += len(data)
            if not parts:
                continue
            h, tid, at, start, end, context, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            data = memoryview(np.concatenate(texts) if len(texts) > 1 else texts[0])
            order = np.lexsort((start, tid, context))
            c, t, s = context[order], tid[order], start[order]
            new = np.concatenate([[True], c[1:] != c[:-1]])
            same = np.flatnonzero(~new)
            x, y = place[order[same]].tolist(), place[order[same - 1]].tolist()
            n = (end - start)[order[same]].tolist()
            new[same[[data[i : i + k] != data[j : j + k] for i, j, k in zip(x, y, n, strict=True)]]] = True  # equal hashes of other bytes
            other = np.concatenate([[True], new[1:] | (t[1:] != t[:-1]) | (s[1:] != s[:-1])])  # another place
            group = np.cumsum(new) - 1
            often = (np.bincount(group, other) > 1)[group]
            keep, gone = order[new | ~often], order[often & (end - start >= span)[order]]
            gone = gone[np.lexsort((start[gone], tid[gone]))]
            t, s, e = tid[gone], start[gone], end[gone]  # in a text, later starts have later ends
            run_ = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] > e[:-1])])) if len(t) else np.zeros(0, np.int64)
            last = np.append(run_[1:], len(t)) - 1 if len(t) else run_
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(tid[keep]), pa.array(at[keep]), pa.nulls(len(keep), pa.int64())], names=["h", "tid", "at", "end"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(run_), pa.int64()), pa.array(t[run_]), pa.array(s[run_]), pa.array(e[last])], names=["h", "tid", "at", "end"])

    return run


def _contexts(span: int, gram: int):
    """(h, tid, at, before, ctx) of each anchor listed for a text."""
    left = span - gram

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            seen: set[int] = set()
            data, offsets = buffers(batch.column(1))
            h, tid, at, before, ctx, size = [], [], [], [], [], 0
            for i, (t, marks) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                if t in seen:
                    continue
                seen.add(t)
                raw = data[offsets[i] : offsets[i + 1]]
                marks = marks.values
                for hash_, p in zip(marks.field(0).to_pylist(), marks.field(1).to_pylist(), strict=True):
                    x = raw[max(0, p - left) : p + span].tobytes()
                    h.append(hash_)
                    tid.append(t)
                    at.append(p)
                    before.append(min(p, left))
                    ctx.append(x)
                    size += len(x)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(tid, pa.int64()), pa.array(at, pa.int64()), pa.array(before, pa.int32()), pa.array(ctx, pa.binary())], names=["h", "tid", "at", "before", "ctx"])
                    h, tid, at, before, ctx, size = [], [], [], [], [], 0
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(tid, pa.int64()), pa.array(at, pa.int64()), pa.array(before, pa.int32()), pa.array(ctx, pa.binary())], names=["h", "tid", "at", "before", "ctx"])

    return run


def _matrix(ctx: pa.Array, before: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(contexts in rows with the anchor in column span - gram, bytes from the anchor on)."""
    data, offsets = buffers(ctx)
    left, width = span - gram, 2 * span - gram
    length = np.diff(offsets)
    m = np.zeros((len(length), width), np.uint8)
    row = np.repeat(np.arange(len(length)), length)
    m[row, np.arange(len(data)) - offsets[:-1][row] + left - before[row]] = data
    return m, length - before


def repeats(group: np.ndarray, m: np.ndarray, before: np.ndarray, after: np.ndarray, span: int = SPAN, gram: int = GRAM, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each context, the largest and the smallest number of bytes before the anchor, from low to high, at which a repeated window starts (-1: none)."""
    n, left = len(m), span - gram
    high = left if high is None else high
    most, least = np.full(n, -1), np.full(n, -1)
    if n < 2:
        return most, least
    # sorted directly: the suffixes low bytes before the anchors
    suffix = np.ascontiguousarray(m[:, left - low : left - low + span])
    order = np.lexsort((suffix.view(f"S{span}").ravel(), group))
    after = np.minimum(after + low, span)
    lcp = np.zeros(n + 1, np.int64)
    for a in range(1, n, 4096):
        b = min(n, a + 4096)
        x, y = order[a - 1 : b - 1], order[a:b]
        differ = suffix[x] != suffix[y]
        common = np.where(differ.any(1), differ.argmax(1), span)
        lcp[a:b] = np.where(group[x] == group[y], np.minimum(common, np.minimum(after[x], after[y])), 0)
    x = low
    while True:
        hit = lcp[: len(order)] >= span
        hit[:-1] |= hit[1:].copy()  # a neighbour on either side
        who = order[hit]
        most[who] = x
        least[who[least[who] < 0]] = x
        x += 1
        if x > high:
            return most, least
        # the suffixes one byte further left, induced by a stable scan into the buckets of their first byte
        ok = np.flatnonzero(before[order] >= x)
        if len(ok) < 2:
            return most, least
        first = m[order[ok], left - x]
        rank = np.argsort(first, kind="stable")
        first, old = first[rank], ok[rank]
        same = np.flatnonzero(first[1:] == first[:-1])
        new = np.zeros(len(old) + 1, np.int64)
        if len(same):
            spans = np.empty(2 * len(same), np.int64)
            spans[0::2], spans[1::2] = old[same] + 1, old[same + 1] + 1
            new[same + 1] = np.minimum.reduceat(lcp, spans)[::2]
            new[same + 1] += new[same + 1] > 0
        order, lcp = order[old], new


def _group_repeats(span: int, gram: int):
    """(tid, start, end) of what is repeated in groups of contexts: rows (k1, k2, low, high, tid, at, before, ctx)."""
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        cols = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("low", "high", "k1", "k2", "tid", "at")])
        cols, once = np.unique(cols, axis=1, return_index=True)  # a text can come from several tasks
        low, high, k1, k2, tid, at = cols
        before = t.column("before").to_numpy().astype(np.int64)[once]
        ctx = t.column("ctx").combine_chunks().take(pa.array(once))
        del t
        m, after = _matrix(ctx, before, span, gram)
        del ctx
        edge = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        out = []
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(low)], strict=True):
            group = np.cumsum(np.concatenate([[True], (k1[a + 1 : b] != k1[a : b - 1]) | (k2[a + 1 : b] != k2[a : b - 1])]))
            most, least = repeats(group, m[a:b], before[a:b], after[a:b], span, gram, int(low[a]), int(high[a]))
            ok = most >= 0
            out.append((tid[a:b][ok], at[a:b][ok] - most[ok], at[a:b][ok] + span - least[ok]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["tid", "start", "end"])

    return run


def _hash_at(m: np.ndarray, start: int, end: int, add: int) -> np.ndarray:
    """A hash of the bytes from start to end of each row."""
    x = m[:, start:end].astype(np.uint64) + np.uint64(add)
    return mix((x * _pow("up", m.shape[1])[: end - start]).sum(1, dtype=np.uint64))


def ranges(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    """The range from low to high, both included, in so many parts at most."""
    edges = np.linspace(low, high + 1, min(parts, high - low + 1) + 1).astype(int).tolist()
    return [(a, b - 1) for a, b in zip(edges, edges[1:])]


def _keys(span: int, gram: int, parts: int):
    """(low, high, k1, k2, tid, at) for each finer range of rows (low, high, tid, at, before, ctx): windows of the range that are equal have the same key."""
    left = span - gram

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                old = np.stack([part.column(0).to_numpy(), part.column(1).to_numpy()])
                before = part.column(4).to_numpy().astype(np.int64)
                m, after = _matrix(part.column(5), before, span, gram)
                for low0, high0 in np.unique(old, axis=1).T.tolist():
                    here = (old[0] == low0) & (old[1] == high0)
                    for low, high in ranges(low0, high0, parts):
                        ok = np.flatnonzero(here & (low <= before) & (span - high <= after))
                        if not len(ok):
                            continue
                        keys = [_hash_at(m[ok], left - low, left + span - high, add).view(np.int64) for add in (1, 977)]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(ok), low, np.int32)), pa.array(np.full(len(ok), high, np.int32)), *map(pa.array, keys),
                            pa.array(part.column(2).to_numpy()[ok]), pa.array(part.column(3).to_numpy()[ok])], names=["low", "high", "k1", "k2", "tid", "at"])

    return run


def _split(ctx: DataFrame, span: int, gram: int, hot: int) -> tuple[list[DataFrame], list[DataFrame], int]:
    """Groups of at most hot contexts (k1, k2, low, high, tid, at, before, ctx) of those (tid, at, before, ctx) of hot anchors, (tid, start, end) of equal windows, and how many contexts the groups have."""
    live = ctx.select(F.lit(0).alias("low"), F.lit(span - gram).alias("high"), "tid", "at", "before", "ctx")
    groups, equal, rows = [], [], 0
    slim = ctx.select(F.col("tid").alias("t"), F.col("at").alias("p"), "before", "ctx")
    widest = span - gram + 1
    while True:
        keys = cut(map_arrow(live, _keys(span, gram, PARTS), "low int, high int, k1 long, k2 long, tid long, at long"), "keys")
        by = ["low", "high", "k1", "k2"]
        place = F.xxhash64("tid", "at")
        count = keys.groupBy(*by).agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("c")).where(F.col("a") < F.col("b")).select(*by, "c")
        count = cut(count, "again")
        keys = keys.join(maybe_broadcast(count, count.count(), 48), by)
        widest = -(-widest // PARTS)
        single = F.col("low") == F.col("high")
        equal.append(keys.where(single).select("tid", (F.col("at") - F.col("low")).alias("start"), (F.col("at") - F.col("low") + span).alias("end")).distinct())
        if widest == 1:
            return groups, equal, rows
        rows += count.where(~single & (F.col("c") <= hot)).agg(F.sum("c")).first()[0] or 0
        match = [F.col("tid") == F.col("t"), F.col("at") == F.col("p")]
        groups.append(keys.where(~single & (F.col("c") <= hot)).join(slim, match).select(*by, "tid", "at", "before", "ctx"))
        more = count.where(~single & (F.col("c") > hot))
        if more.isEmpty():
            return groups, equal, rows
        live = keys.where(~single & (F.col("c") > hot)).select("low", "high", "tid", "at").distinct().join(slim, match).select("low", "high", "tid", "at", "before", "ctx")


def _remove(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        data, offsets = buffers(batch.column(1))
        size, gone, runs, digest = [], [], [], []
        for i, spans in enumerate(batch.column(2).to_pylist()):
            raw = data[offsets[i] : offsets[i + 1]]
            end, removed, n, kept = 0, 0, 0, []
            last = -1
            for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
                if s > last:  # a new run; touching ones are one
                    n += 1
                    kept.append(raw[end:s])
                    removed += e - s
                    last = end = e
                elif e > last:
                    removed += e - last
                    last = end = e
            kept.append(raw[end:])
            size.append(len(raw))
            gone.append(removed)
            runs.append(n)
            h = hashlib.sha256()
            for x in kept:
                h.update(x.tobytes())
            digest.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest)], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, copies: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(tid, start, end) of stretches of bytes to remove from docs (tid, w, text); they may overlap.

    copies: (tid, c, n, w), how often each text stands there, its size, and the mark w of one of its rows.
    """
    spark = docs.sparkSession
    ship(spark)
    first = cut(map_arrow(docs.select("tid", "text"), _anchor_rows(span, gram), "h long, tid long, at long, end long"), "anchors")
    anchors = first.where(F.col("end").isNull()).drop("end")
    place = F.xxhash64("tid", "at")
    twice = anchors.groupBy(F.col("h").alias("dup")).agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("c")).where(F.col("a") < F.col("b")).select("dup", "c")
    twice = cut(twice, "twice")  # a table, so that the join can be split where an anchor is frequent
    marked = cut(anchors.join(twice, F.col("h") == F.col("dup")).select("tid", "h", "at", "c"), "marked")
    n = marked.count()
    marks = marked.groupBy(F.col("tid").alias("t")).agg(F.collect_list(F.struct("h", "at")).alias("marks"))
    # of a text's copies one row brings the contexts, so copies are dealt out by more than their text; as marks grow with the texts, this join is shuffled at every size
    marks = marks.join(copies.select("tid", F.col("w").alias("one")), F.col("t") == F.col("tid")).drop("tid")
    near = docs.join(marks, (F.col("tid") == F.col("t")) & (F.col("w") == F.col("one"))).select("tid", "text", "marks")
    ctx = map_arrow(near, _contexts(span, gram), "h long, tid long, at long, before int, ctx binary")
    much = marked.where(F.col("c") > hot).select(F.col("h").alias("hot_h")).distinct()
    n_hot = much.count()
    parts = [first.where(F.col("end").isNotNull()).select("tid", F.col("at").alias("start"), "end"),
             copies.where((F.col("c") > 1) & (F.col("n") >= span)).select("tid", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))]
    groups = []
    if n_hot:
        ctx = cut(ctx.join(maybe_broadcast(much, n_hot, 16), F.col("h") == F.col("hot_h"), "left"), "contexts")
        groups, equal, rows = _split(ctx.where(F.col("hot_h").isNotNull()).select("tid", "at", "before", "ctx"), span, gram, hot)
        parts += equal
        n += rows
        ctx = ctx.where(F.col("hot_h").isNull()).drop("hot_h")
    groups.append(ctx.select(F.col("h").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).alias("low"), F.lit(span - gram).alias("high"), "tid", "at", "before", "ctx"))
    groups = reduce(DataFrame.unionByName, groups)
    buckets = max(default_parallelism(spark), n // GATHER + 1)
    parts.append(groups.withColumn("bucket", F.pmod("k1", F.lit(buckets))).groupBy("bucket").applyInArrow(lean_group(_group_repeats(span, gram)), "tid long, start long, end long"))
    return reduce(DataFrame.unionByName, parts)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, hot: int = HOT, bits: int = 64) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs; bits: of a text's hash, fewer for tests."""
    text_ = F.coalesce(F.col(text), F.lit(""))
    tid = F.xxhash64(text_) if bits == 64 else F.xxhash64(text_).bitwiseAND(F.lit((1 << bits) - 1))
    docs = docs.select(tid.alias("tid"), F.xxhash64(text_, F.lit(1)).alias("other"), text_.alias("text"), F.col(doc_id).alias("doc")).withColumn("w", F.xxhash64("doc"))
    copies = cut(docs.groupBy("tid", "other").agg(F.count("*").alias("c"), F.max(F.octet_length("text").cast("long")).alias("n"), F.min("w").alias("w")), "texts")
    # hashes of two texts or more: of ten thousand million texts, two or three
    clash = [r.tid for r in copies.groupBy("tid").count().where(F.col("count") > 1).select("tid").collect()]
    own = lambda df: df.withColumn("tid", F.when(F.col("tid").isin(clash), F.col("other")).otherwise(F.col("tid")) if clash else F.col("tid")).drop("other")
    docs, copies = own(docs), own(copies)
    found = repeated_spans(docs.select("tid", "w", "text"), copies, span, gram, hot)
    found = cut(found.groupBy(F.col("tid").alias("t")).agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    rows = docs.join(found, F.col("tid") == F.col("t"), "left").select("doc", "text", "spans")
    kind = docs.schema["doc"].dataType.simpleString()
    return map_arrow(rows, _remove, f"doc {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")
