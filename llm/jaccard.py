"""N-gram Jaccard join: documents whose 5-word shingle sets have a Jaccard likeness of at least 0.8.

1. Documents with equal sets form a class; only one set of each class goes on.
2. Of each set only the shingles smallest by hash take part in the search, as many (about two fifths)
   as hold a fixed number of the common ones of any two linked sets.  Their document frequency is counted: hashes
   travel packed, by bucket, and a bucket returns to each set those that other sets have too.
   Shingles in a thousandth of all documents or more (at most 1000 times the mean set size of
   them, so few enough to send to all tasks) skip the count and rank as the most frequent.
3. Global order: rare shingles first.  Two linked sets share a shingle in their prefixes in that order.  Sets whose
   own shingles fill the prefix have no partner; the others meet in coarse groups, the
   components of "shares a prefix shingle and a level of size", and their whole sets are read again.  A level holds
   sizes up to twice the least, and those a link away from them, so small sets, of which many hang together, tie no large ones to each other.
4. In each coarse group the sets, now ordered from the group's most frequent shingle to the rarest, are
   stored in a prefix tree.  A probe walks the tree once, sharing the overlap of common prefixes, and
   leaves a subtree when neither its own nor the subtree's remaining length can reach the
   threshold, or when all of the subtree is already in its component.  A group of more than
   BLOCK sets is split by the shingles of the prefixes, or in blocks if that copies sets less often, so no task holds more than two blocks.  Up to
   STAR blocks all pairs of them meet, so no set is copied more often.  Of more each meets the first one; after that only sets outside the group's largest component meet others
   again, so many near copies of one text, which all are linked to some in the first block, are compared a number of times that grows as they do.
5. The links found span the same components as all links; they give the classes.

Nulls and texts without words have the empty set and no links.  Repeated rows: each keeps a row.
Other columns are ignored.  A 64-bit hash names a shingle; 40 bits of it and the bucket do in the search.  A set is named by a 64-bit hash,
or, where several sets have it, by a second one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import cut, default_parallelism, discard, lean_group, map_arrow, maybe_broadcast, ship, table
from llm.components import components
from llm.kernels import mix, pieces, regroup, shingles

K = 5
#: Linked: NUM * intersection >= DEN * (size a + size b), that is intersection >= 0.8 * union.
NUM, DEN = 9, 4
BLOCK = 500
#: Blocks of a group from which on not all pairs of them meet.
STAR = 4
#: Shingles of a bucket, about.
BUCKET = 2_500_000
HOT_SHARE = 1000
#: Bytes of text of a task that are looked at together.
TOGETHER = 16 << 20
_LOW40 = np.uint64((1 << 40) - 1)


def _set_ids(grams: np.ndarray, bounds: np.ndarray, salt: int = 0x5851F42D4C957F2D) -> np.ndarray:
    total = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mix(grams ^ np.uint64(salt)), out=total[1:])
    n = np.diff(bounds).astype(np.uint64)
    return mix(total[bounds[1:]] - total[bounds[:-1]] + n).view(np.int64)


class Ids:
    """Ids of sets: a hash of as many bits, but for the hashes of several sets in ``clash``, which are told apart by a second one.

    fewer bits than 64 are for tests.
    """

    def __init__(self, bits: int = 64, clash: tuple[int, ...] = ()):
        self.bits, self.clash = bits, np.array(sorted(clash), np.int64)

    def both(self, grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = _set_ids(grams, bounds)
        return first if self.bits == 64 else first & np.int64((1 << self.bits) - 1), _set_ids(grams, bounds, 0x14057B7EF767814F)

    def __call__(self, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        first, second = self.both(grams, bounds)
        return np.where(np.isin(first, self.clash), second, first) if len(self.clash) else first


def _sets(batch: pa.RecordBatch, ids: Ids) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for a, b, data, offsets in pieces(batch.column(batch.schema.get_field_index("text"))):
        grams, bounds = shingles(data, offsets, K)
        yield a, b, grams, bounds, ids(grams, bounds)


def _document_rows(ids: Ids):
    """A row of each document with both hashes of its set, and (hot, df) rows of the shingles frequent in a batch."""
    names = ["doc", "tid", "sid", "other", "n", "hot", "df"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regroup(it, TOGETHER):
            parts = []
            for _, _, data, offsets in pieces(batch.column(2)):
                grams, bounds = shingles(data, offsets, K)
                parts.append((grams, bounds, *ids.both(grams, bounds)))
            if not parts:
                continue
            n = np.concatenate([np.diff(x[1]) for x in parts]).astype(np.int32)
            sid, other = (np.concatenate([x[k] for x in parts]) for k in (2, 3))
            rows = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sid), pa.array(other), pa.array(n), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())], names=names)
            _, first = np.unique(other, return_index=True)  # a set counts once
            once = np.zeros(rows, bool)
            once[first] = True
            at = np.cumsum([0, *[len(x[2]) for x in parts]])
            grams = np.sort(np.concatenate([x[0][np.repeat(once[a:b], np.diff(x[1]))] for x, a, b in zip(parts, at[:-1], at[1:], strict=True)]))
            edge = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, int)
            df = np.diff(np.append(edge, len(grams)))
            hot = df >= max(4, len(first) // (2 * HOT_SHARE))
            if hot.any():
                k = int(hot.sum())
                yield pa.RecordBatch.from_arrays([*[pa.nulls(k, x) for x in types[:5]], pa.array(grams[edge[hot]].view(np.int64)), pa.array(df[hot])], names=names)

    return run


def _kept(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of a set of n that take part in the search, tokens that two linked sets share among those at least).

    In hash order, the i-th common token of two linked sets has at most n - ceil(0.8 n) + i - 1 tokens
    before it, so the first n - ceil(0.8 n) + m of both hold the first m common ones.
    """
    m = np.maximum(n // 5, 1)
    least = -(-4 * n // 5)  # the smallest partner, and the least overlap with any
    return np.minimum(n - least + m, n), np.maximum(least // 5, 1)


def _packed(buckets: int, hot: np.ndarray, ids: Ids):
    """To (bucket, cold, hot, blob) rows: pairs of the searched tokens and their sets, in as many bytes at any size."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regroup(it, TOGETHER):
            kept: dict[int, list] = {}
            seen: set[int] = set()
            for _, _, grams, bounds, sid in _sets(batch, ids):
                n = np.diff(bounds)
                fresh = np.array([not (s in seen or seen.add(s)) for s in sid.tolist()], bool) & (n > 0)
                own = np.repeat(np.arange(len(sid)), n)
                use = fresh[own] & (np.arange(len(grams)) - bounds[:-1][own] < _kept(n)[0][own])
                grams, own = grams[use], sid[own[use]]
                is_hot = np.zeros(len(grams), bool)
                if len(hot) and len(grams):
                    is_hot = hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams
                # hot tokens need no count: they go where their set's hash says
                bucket = np.where(is_hot, mix(own.view(np.uint64)), mix(grams)) % np.uint64(buckets)
                order = np.lexsort((is_hot, bucket.astype(np.int32)))
                bucket, grams, own, is_hot = bucket[order].astype(np.int32), (grams & _LOW40)[order], own[order], is_hot[order]
                edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
                for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)], strict=True) if len(edge) else ():
                    c = b - int(is_hot[a:b].sum())
                    kept.setdefault(int(bucket[a]), []).append((grams[a:c].astype(np.uint32), (grams[a:c] >> np.uint64(32)).astype(np.uint8), own[a:c], grams[c:b], own[c:b]))
            rows = []
            for k, parts in kept.items():
                cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
                rows.append((k, len(cols[0]), len(cols[3]), b"".join(c.tobytes() for c in cols)))
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows[i : i + 64]], pa.int32()), pa.array([r[1] for r in rows[i : i + 64]], pa.int32()),
                    pa.array([r[2] for r in rows[i : i + 64]], pa.int32()), pa.array([r[3] for r in rows[i : i + 64]], pa.binary())], names=["bucket", "cold", "hot", "blob"])

    return run


def _shared(parts: int):
    """Of one bucket: to each set its tokens that at least two sets have, as (class of df, bucket, low bits), packed by the set's part."""
    def run(key: tuple, t: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        low, high, cold, value, warm = [], [], [], [], []
        for a, b, blob in zip(t.column("cold").to_pylist(), t.column("hot").to_pylist(), t.column("blob"), strict=True):
            raw = np.frombuffer(blob.as_buffer(), np.uint8)
            cuts = np.cumsum([0, 4 * a, a, 8 * a, 8 * b, 8 * b])
            for to, x, y, kind in zip((low, high, cold, value, warm), cuts[:-1], cuts[1:], (np.uint32, np.uint8, np.int64, np.uint64, np.int64), strict=True):
                to.append(np.frombuffer(raw[x:y].tobytes(), kind))
        tok = np.concatenate(low).astype(np.uint64) | (np.concatenate(high).astype(np.uint64) << np.uint64(32))
        own = np.concatenate(cold)
        del low, high, cold
        order = np.argsort(tok, kind="stable")
        tok, own = tok[order], own[order]
        edge = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.zeros(0, int)
        df = np.repeat(np.diff(np.append(edge, len(tok))), np.diff(np.append(edge, len(tok))))
        tok, own = tok[df > 1], own[df > 1]
        order = np.lexsort((own, tok))
        tok, own = tok[order], own[order]
        keep = np.ones(len(tok), bool)
        keep[1:] = (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])  # a set can come from several tasks
        tok, own = tok[keep], own[keep]
        edge = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.zeros(0, int)
        df = np.repeat(np.diff(np.append(edge, len(tok))), np.diff(np.append(edge, len(tok))))
        tok, own, df = tok[df > 1], own[df > 1], df[df > 1]
        level = np.minimum(np.floor(2 * np.log2(np.maximum(df, 1))).astype(np.uint64), np.uint64(62))
        # what is left of the 64 bits after the class of df
        tok = (level << np.uint64(58)) | (mix((np.uint64(bucket) << np.uint64(40)) ^ tok) >> np.uint64(6))
        tok = np.concatenate([tok, (np.uint64(63) << np.uint64(58)) | np.concatenate(value)])
        own = np.concatenate([own, *warm])
        part = (mix(own.view(np.uint64)) >> np.uint64(20)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        tok, own, part = tok[order], own[order], part[order].astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, int)
        ends = np.append(edge[1:], len(part))
        return pa.table([pa.array(part[edge]), pa.array([own[a:b].tobytes() + tok[a:b].tobytes() for a, b in zip(edge, ends, strict=True)] if len(edge) else [], pa.binary())], names=["part", "blob"])

    return run


def _gather(t: pa.Table) -> pa.Table:
    """Of one part: each set's shared tokens in global order."""
    own, tok = [], []
    for blob in t.column("blob"):
        raw = np.frombuffer(blob.as_buffer(), np.int64)
        own.append(raw[: len(raw) // 2])
        tok.append(raw[len(raw) // 2 :].view(np.uint64))
    own, tok = np.concatenate(own), np.concatenate(tok)
    order = np.lexsort((tok, own))
    own, tok = own[order], tok[order]
    keep = np.ones(len(tok), bool)
    keep[1:] = (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])
    own, tok = own[keep], tok[keep]
    edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    ends = np.append(edge[1:], len(own))
    return pa.table([pa.array(own[edge]), pa.array([tok[a:b].tobytes() for a, b in zip(edge, ends, strict=True)], pa.binary())], names=["sid", "toks"])


def _levels_of(n: int) -> set[int]:
    """As _levels()."""
    return {n.bit_length() - 1, (n * 5 // 4).bit_length() - 1}


def _levels(n: Column) -> Column:
    """The levels of a size; as the larger of two linked sets has at most 5/4 of the size of the smaller, both have the level of the larger."""
    level = lambda x: (F.length(F.bin(x)) - 1).cast("int")
    n = n.cast("long")
    return F.array_distinct(F.array(level(n), level(F.floor(n * 5 / 4))))


def _prefixes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tok, sid, level) for the shared tokens in each set's prefix, unless tokens of its own fill that, and the set's levels."""
    for batch in it:
        sid, toks, levels = [], [], []
        sizes = batch.column(1).to_numpy().astype(np.int64)
        kept, shared = _kept(sizes)
        for s, n, k, m, raw in zip(batch.column(0).to_pylist(), sizes.tolist(), kept.tolist(), shared.tolist(), batch.column(2).to_pylist(), strict=True):
            t = np.frombuffer(raw, np.int64)
            t = t[: max(0, k - m + 1 - (k - len(t)))]
            for level in _levels_of(n):
                toks.append(t)
                sid.append(np.full(len(t), s, np.int64))
                levels.append(np.full(len(t), level, np.int32))
        if toks:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (toks, sid, levels)], names=["tok", "sid", "level"])


def _whole(ids: Ids):
    """(sid, places, toks) of the texts of sets that meet others, of a text's copies in one task once."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in it:
            want, places = batch.column(1).to_numpy(), batch.column(2)
            for a, b, grams, bounds, sid in _sets(batch, ids):
                ok = np.array([i for i in np.flatnonzero(sid == want[a:b]).tolist() if not (sid[i] in seen or seen.add(sid[i]))], np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(sid[ok]), places.slice(a, b - a).take(pa.array(ok)), pa.array([grams[bounds[i] : bounds[i + 1]].tobytes() for i in ok.tolist()], pa.binary())], names=["sid", "places", "toks"])

    return run


class Node:
    """A stretch of a path: its ranks, what follows, the sets that end here, and sizes and component of the subtree."""

    __slots__ = ("seg", "next", "ends", "least", "most", "comp")

    def __init__(self, seg, least, most, comp):
        self.seg, self.next, self.ends, self.least, self.most, self.comp = seg, {}, [], least, most, comp


def trie_links(sizes: list[int], sets: list[np.ndarray], every: bool = False) -> list[tuple[int, int]]:
    """Links between sets (by index) that span the same components as all links, or every link.

    sizes: of the whole sets; sets: their shingles that may occur in another set.
    """
    if len(sets) < 2:
        return []
    flat = np.concatenate(sets)
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    wide = int((count > 1).sum())  # ranks from here on occur in one set only
    ranks, at = [], 0
    for s in sets:
        r = np.sort(rank[inverse[at : at + len(s)]])
        ranks.append(r[: np.searchsorted(r, wide)])
        at += len(s)
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links: list[tuple[int, int]] = []
    mask = np.zeros(wide, bool)
    root = Node(np.zeros(0, np.int64), 1 << 60, 0, None)
    for me in sorted(range(len(sets)), key=sizes.__getitem__):
        mine, size = ranks[me], sizes[me]
        mask[mine] = True
        stack = [(child, 0, 0) for child in root.next.values()]
        while stack:
            node, shared, depth = stack.pop()
            if NUM * size < DEN * (size + node.least) or 5 * node.most < 4 * size + 9 * (depth - shared):
                continue
            if not every and node.comp is not None and find(node.comp) == find(me):
                continue
            seg = node.seg
            shared += int(np.count_nonzero(mask[seg]))
            depth += len(seg)
            left = len(mine) - int(np.searchsorted(mine, seg[-1], "right"))
            if NUM * (shared + left) < DEN * (size + node.least) or 5 * node.most < 4 * size + 9 * (depth - shared):
                continue
            for other in node.ends:
                if NUM * shared >= DEN * (size + sizes[other]) and (every or find(other) != find(me)):
                    links.append((me, other))
                    parent[find(other)] = find(me)
            stack.extend((child, shared, depth) for child in node.next.values())
        mask[mine] = False
        _insert(root, me, mine, size, find)
    return links


def _insert(root: Node, me: int, mine: np.ndarray, size: int, find) -> None:
    node, at = root, 0
    while at < len(mine):
        child = node.next.get(int(mine[at]))
        if child is None:
            leaf = Node(mine[at:], size, size, me)
            leaf.ends.append(me)
            node.next[int(mine[at])] = leaf
            return
        seg = child.seg
        n = min(len(seg), len(mine) - at)
        off = np.flatnonzero(seg[:n] != mine[at : at + n])
        same = int(off[0]) if len(off) else n
        if same < len(seg):
            top = Node(seg[:same], child.least, child.most, child.comp)
            child.seg = seg[same:]
            top.next[int(child.seg[0])] = child
            node.next[int(mine[at])] = top
            child = top
        child.least, child.most = min(child.least, size), max(child.most, size)
        if child.comp is not None and find(child.comp) != find(me):
            child.comp = None
        node, at = child, at + same
    if node is not root:
        node.ends.append(me)


def _group_links(t: pa.Table, every: bool) -> pa.Table:
    """Links within each coarse group of one task's sets."""
    groups: dict[int, dict[int, int]] = {}
    for i, (g, s) in enumerate(zip(t.column("coarse").to_pylist(), t.column("sid").to_pylist(), strict=True)):
        groups.setdefault(g, {})[s] = i
    toks = t.column("toks")
    a, b = [], []
    for rows in groups.values():
        sids = sorted(rows)
        sets = [np.frombuffer(toks[rows[s]].as_py(), np.uint64) for s in sids]
        for x, y in trie_links(list(map(len, sets)), sets, every):
            a.append(sids[x])
            b.append(sids[y])
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _join_groups(t: pa.Table) -> pa.Table:
    return _group_links(t, False)


def _join_every(t: pa.Table) -> pa.Table:
    return _group_links(t, True)


def _linked(docs: DataFrame, doc_id: str, text: str, block: int, every: bool, bits: int, star: int | None) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """Rows (doc, tid, sid, n), classes of equal sets (sid, n, at, rep), every link (a, b) between them or else their components (id, root), and tables that are only read for that."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tid"), F.col(text).alias("text"))
    first = cut(map_arrow(docs, _document_rows(Ids(bits)), "doc long, tid long, sid long, other long, n int, hot long, df long"), "sets")
    rows = first.where(F.col("hot").isNull()).select("doc", "tid", "sid", "other", "n")
    n_docs, tokens = rows.agg(F.count("*"), F.sum(F.col("n").cast("long"))).first()
    # hashes of two sets or more: of ten thousand million sets, two or three
    clash = rows.groupBy("sid").agg(F.min("other").alias("a"), F.max("other").alias("b")).where(F.col("a") < F.col("b")).select("sid")
    ids = Ids(bits, tuple(r.sid for r in clash.collect()))
    rows = rows.withColumn("sid", F.when(F.col("sid").isin(ids.clash.tolist()), F.col("other")).otherwise(F.col("sid"))).drop("other")
    hot = first.where(F.col("hot").isNotNull()).groupBy("hot").agg(F.sum("df").alias("df")).where(F.col("df") >= max(64, n_docs // HOT_SHARE))
    hot = np.sort(np.array([r.hot for r in hot.select("hot").collect()], np.int64).view(np.uint64))  # at most HOT_SHARE * mean set size
    buckets = max(default_parallelism(spark), -(-(tokens or 0) // BUCKET))

    packed = map_arrow(docs.select("text"), _packed(buckets, hot, ids), "bucket int, cold int, hot int, blob binary")
    shared = packed.groupBy("bucket").applyInArrow(lean_group(_shared(buckets)), "part long, blob binary").groupBy("part").applyInArrow(lean_group(_gather), "sid long, toks binary")
    shared = cut(shared, "shared")  # so that no task runs two Python operators
    classes = cut(rows.where(F.col("n") > 0).groupBy("sid").agg(F.first("n").alias("n"), F.min(F.struct("tid", "doc")).alias("at"), F.min("doc").alias("rep")), "classes")
    alike = shared.join(classes.select(F.col("sid").alias("id"), "n"), F.col("sid") == F.col("id")).select("sid", "n", "toks")
    prefix = cut(map_arrow(alike, _prefixes, "tok long, sid long, level int"), "prefix")
    pivot = prefix.groupBy("tok", "level").agg(F.min("sid").alias("pivot"), F.max("sid").alias("last")).where(F.col("pivot") < F.col("last")).select("tok", "level", "pivot")
    edges = prefix.join(pivot, ["tok", "level"]).where(F.col("sid") > F.col("pivot")).select(F.xxhash64("sid", "level").alias("a"), F.xxhash64("pivot", "level").alias("b")).distinct()
    coarse = components(edges).select(F.col("id").alias("met"), F.col("component").alias("coarse"))
    # a row of each set and level
    leveled = classes.select("sid", F.col("at.tid").alias("rep_tid"), F.col("at.doc").alias("rep_doc"), "n", F.explode(_levels(F.col("n"))).alias("level"))
    coarse = cut(coarse.join(leveled, F.col("met") == F.xxhash64("sid", "level")).drop("met"), "coarse")
    n_met = coarse.count()

    places, toks, starred, extra = _places(coarse, prefix, block, n_met, star)
    links = _meet(docs, places, ids, every)
    tables = [shared, prefix, coarse, *extra]
    if every:
        return rows, classes, links, tables
    linked = cut(components(links).select("id", F.col("component").alias("root")), "linked")
    if starred is not None and not starred.isEmpty():
        more = _rest(coarse, toks, starred, linked, block, n_met)
        if more is not None:
            links = _meet(docs, more[0], ids, every).unionByName(linked.select(F.col("id").alias("a"), F.col("root").alias("b")))
            tables += [linked, *more]
            linked = cut(components(links).select("id", F.col("component").alias("root")), "linked")
    return rows, classes, linked, tables


def _meet(docs: DataFrame, places: DataFrame, ids: Ids, every: bool) -> DataFrame:
    """The links (a, b) found where sets meet: places (sid, rep_tid, rep_doc, places)."""
    n, total = places.agg(F.count("*"), F.sum(F.size("places").cast("long"))).first()
    # one row brings each set: a text and an id that have it; only rows with the same of both bring it again, and _group_links takes it once
    places = places.withColumnRenamed("sid", "want")
    met = maybe_broadcast(places, 48 * n + 40 * (total or 0), 1)
    if met is places:  # the join is shuffled, so only texts that may be wanted go there
        docs = _wanted(docs, places, n)
    sets = docs.join(met, (F.col("tid") == F.col("rep_tid")) & F.col("doc").eqNullSafe(F.col("rep_doc"))).select("text", "want", "places")
    sets = map_arrow(sets, _whole(ids), f"sid long, places {_PLACES}, toks binary").select("sid", "toks", F.inline("places"))
    return sets.groupBy("g", "i", "j").applyInArrow(lean_group(_join_every if every else _join_groups), "a long, b long")


def _wanted(docs: DataFrame, places: DataFrame, n: int) -> DataFrame:
    """The rows of docs whose text one of n places has, and about a thirtieth of the others: a bitmap of hashes goes to all tasks, 4 to 8 bytes a place."""
    bits = max(1 << 16, 1 << (32 * n - 1).bit_length())
    # a row for each byte of the bitmap that has a bit
    byte, bit = (F.expr(f"pmod(rep_tid, {bits}L) {x}") for x in ("div 8", "% 8"))
    found = places.groupBy(byte.alias("byte")).agg(F.bit_or(F.pow(F.lit(2), bit).cast("int")).alias("mask")).toArrow()
    bitmap = np.zeros(bits // 8, np.uint8)
    bitmap[found.column("byte").to_numpy()] = found.column("mask").to_numpy().astype(np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at = batch.column(1).to_numpy() & (bits - 1)
            yield batch.filter(pa.array((sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))

    return map_arrow(docs, run, docs.schema)


_PLACES = "array<struct<coarse:bigint,g:bigint,i:int,j:int>>"


def _place(group: Column, g: Column, i: Column, j: Column) -> Column:
    return F.struct(group.alias("coarse"), g.alias("g"), i.cast("int").alias("i"), j.cast("int").alias("j"))


def _one(group: Column, tasks: int) -> Column:
    """The place of a set in a group that is not split; such groups share tasks."""
    return F.array(_place(group, F.pmod(F.xxhash64(group), F.lit(tasks)), F.lit(-1), F.lit(-1)))


def _upto(n: Column, f) -> Column:
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f)


def _same(by: list[str], toks: DataFrame, *more: Column) -> DataFrame:
    """(by, tok, level, n, more) of shingles that two sets or more have, of those that the same sets have one."""
    alike = toks.groupBy(*by, "tok", "level").agg(F.count("*").alias("n"), *more, F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y")).where(F.col("n") > 1)
    rest = [c for c in alike.columns if c not in ("tok", "level")]
    return alike.groupBy(*rest).agg(F.min(F.struct("tok", "level")).alias("t")).select(*[c for c in rest if c not in "xy"], "t.tok", "t.level")


def _with(toks: DataFrame, used: DataFrame) -> DataFrame:
    """The rows of toks whose shingle is used, with n and what else used has."""
    used = used.withColumnsRenamed({"coarse": "of", "tok": "u", "level": "l"})
    return toks.join(used, (F.col("tok") == F.col("u")) & (F.col("level") == F.col("l")) & (F.col("coarse") == F.col("of"))).drop("of", "u", "l")


def _places(coarse: DataFrame, prefix: DataFrame, block: int, n_met: int, star: int | None) -> tuple[DataFrame, DataFrame | None, DataFrame | None, list[DataFrame]]:
    """(sid, rep_tid, rep_doc, places): the tasks in which each set meets others; shingles of the sets of large groups; the large groups that are starred; tables read for it.

    A coarse group of up to block sets meets in one task.  A larger one is split in one of two ways, by whichever copies sets less often.  By the
    shingles of the prefixes: only sets that share one, with sizes that allow a link, meet; of shingles that the same sets have
    one is used; one of more than block sets is split in pairs of blocks.  Or by blocks of its sets: in all pairs, or, if it has more than star blocks,
    only in those with the first block, which leaves the rest to _rest().
    """
    tasks = max(default_parallelism(coarse.sparkSession), n_met // 1000 + 1)
    many = cut(coarse.groupBy(F.col("coarse").alias("c")).agg(F.count("*").alias("all")).where(F.col("all") > block), "many")
    n_many = many.count()
    met = coarse.join(maybe_broadcast(many, n_many, 16), F.col("coarse") == F.col("c"), "left").drop("c")

    def pairs(group: Column, of: Column, n: int, star: int | None) -> Column:
        """The places of a set in a group of ``of`` sets: one of n tasks, or those of its block."""
        parts = F.ceil(of / block)
        own = F.pmod(F.xxhash64("sid"), parts)
        every = _upto(parts, lambda x: _place(group, group, F.least(x, own), F.greatest(x, own)))
        first = F.when(own == 0, every).otherwise(F.array(_place(group, group, F.lit(0), own)))
        return F.when(of <= block, _one(group, n)).otherwise(every if star is None else F.when(parts > star, first).otherwise(every))

    copies = lambda n: n * F.ceil(n / block)
    places = F.when(F.col("all").isNull(), _one(F.col("coarse"), tasks)).otherwise(pairs(F.col("coarse"), F.col("all"), tasks, star))
    of_set = lambda met: met.groupBy("sid", "rep_tid", "rep_doc").agg(F.flatten(F.collect_list("places")).alias("places"))
    if not n_many:
        return of_set(met.withColumn("places", places)), None, None, [many]
    big = met.where(F.col("all").isNotNull()).select(F.col("sid").alias("s"), F.col("level").alias("l"), "coarse", "all")
    toks = cut(prefix.join(big, (F.col("sid") == F.col("s")) & (F.col("level") == F.col("l"))).select("tok", "sid", "coarse", "all", "level"), "toks")
    used = cut(_same(["coarse", "all"], toks), "used")
    made = [many, toks, used]
    is_star = F.lit(False) if star is None else F.ceil(F.col("all") / block) > star
    limit = F.when(is_star, 4 * F.col("all")).otherwise(copies(F.col("all")))
    cheap = used.groupBy("coarse", "all").agg(F.sum(copies(F.col("n"))).alias("cost")).where(F.col("cost") < limit).select(F.col("coarse").alias("cheap"))
    cheap = cut(cheap, "cheap")
    made.append(cheap)
    n_cheap = cheap.count()
    starred = None if star is None else many.where(is_star).select("c")
    if not n_cheap:
        return of_set(met.withColumn("places", places)), toks, starred, made
    cheap = maybe_broadcast(cheap, n_cheap, 8)
    if starred is not None:
        starred = starred.join(cheap, F.col("c") == F.col("cheap"), "left_anti")
    used = used.join(cheap, F.col("coarse") == F.col("cheap")).select("coarse", "n", "tok", "level")
    tasks += (used.agg(F.sum("n")).first()[0] or 0) // 1000
    here = _with(toks, used).select("sid", F.col("coarse").alias("within"), F.inline(pairs(F.xxhash64("coarse", "tok", "level"), F.col("n"), tasks, None)))
    here = here.groupBy(F.col("sid").alias("in"), "within").agg(F.collect_list(F.struct("coarse", "g", "i", "j")).alias("own"))
    met = met.join(cheap, F.col("coarse") == F.col("cheap"), "left").join(here, (F.col("sid") == F.col("in")) & (F.col("coarse") == F.col("within")), "left")
    places = F.when(F.col("cheap").isNotNull(), F.coalesce("own", F.array().cast(_PLACES))).otherwise(places)
    met = cut(of_set(met.withColumn("places", places)), "places")
    return met, toks, starred, [*made, met]


def _rest(coarse: DataFrame, toks: DataFrame, starred: DataFrame, linked: DataFrame, block: int, n_met: int) -> tuple[DataFrame, ...] | None:
    """Where the sets of starred groups still have to meet, and tables read for it; None if nowhere.

    Of each group the largest component is left alone: only a set outside it can have a link that joins components.  Such loose sets meet all that
    share a shingle of their prefix, or all of the group if that copies sets less often.
    """
    members = coarse.select("sid", "coarse").join(starred, F.col("coarse") == F.col("c")).join(linked, F.col("sid") == F.col("id"), "left")
    members = cut(members.select("sid", "coarse", F.coalesce("root", "sid").alias("root")), "members")
    size = members.groupBy(F.col("coarse").alias("g"), "root").agg(F.count("*").alias("n"))
    most = size.groupBy("g").agg(F.max_by("root", F.struct("n", "root")).alias("most"))
    loose = members.join(most, F.col("coarse") == F.col("g")).where(F.col("root") != F.col("most")).select(F.col("sid").alias("loose"), "g")
    loose = cut(loose, "loose")
    n_loose = loose.count()
    if not n_loose:
        discard(members, loose)
        return None
    loose_ = maybe_broadcast(loose, n_loose, 16)
    is_loose = (F.col("sid") == F.col("loose")) & (F.col("coarse") == F.col("g"))
    parts, loose_parts = F.ceil(F.col("n") / block), F.ceil(F.col("loose_n") / block)
    copies = F.when(F.col("n") <= block, F.col("n")).otherwise(F.col("n") * loose_parts + F.col("loose_n") * parts)
    all_of = members.join(loose_, is_loose, "left").select("sid", "coarse", "loose")
    whole = cut(all_of.groupBy("coarse").agg(F.count("*").alias("n"), F.count("loose").alias("loose_n")).where(F.col("loose_n") > 0), "whole")
    own = toks.join(starred, F.col("coarse") == F.col("c"), "left_semi").join(loose_, is_loose, "left").select("tok", "sid", "coarse", "level", "loose")
    used = cut(_same(["coarse"], own, F.count("loose").alias("loose_n")).where(F.col("loose_n") > 0), "used")
    cost = used.groupBy(F.col("coarse").alias("k")).agg(F.sum(copies).alias("cost"))
    by_tok = cut(whole.join(cost, F.col("coarse") == F.col("k"), "left").where(F.coalesce("cost", F.lit(0)) < copies).select("coarse"), "by_tok")
    used = used.join(by_tok, "coarse", "left_semi")
    whole_ = whole.join(by_tok, "coarse", "left_anti").select(F.col("coarse").alias("of"), "n", "loose_n")
    tasks = max(default_parallelism(coarse.sparkSession), (used.agg(F.sum("n")).first()[0] or 0) // 1000 + 1)
    meet = _with(own, used).select("sid", "coarse", "tok", "level", "loose", "n", "loose_n").unionByName(
        all_of.join(whole_, F.col("coarse") == F.col("of")).select("sid", "coarse", F.lit(0).cast("long").alias("tok"), F.lit(-1).alias("level"), "loose", "n", "loose_n"))
    group = F.xxhash64("coarse", "tok", "level")
    mine, loose_mine = F.pmod(F.xxhash64("sid"), parts), F.pmod(F.xxhash64("sid", F.lit(1)), loose_parts)
    # a loose set meets every block of all, any set every block of loose ones
    all_ = _upto(loose_parts, lambda x: _place(group, group, x, mine))
    as_loose = F.when(F.col("loose").isNotNull(), _upto(parts, lambda x: _place(group, group, loose_mine, x))).otherwise(F.array().cast(_PLACES))
    places = F.when(F.col("n") <= block, _one(group, tasks)).otherwise(F.array_distinct(F.concat(all_, as_loose)))
    here = meet.select("sid", F.inline(places)).groupBy(F.col("sid").alias("in")).agg(F.collect_list(F.struct("coarse", "g", "i", "j")).alias("places"))
    places = cut(coarse.select("sid", "rep_tid", "rep_doc").distinct().join(here, F.col("sid") == F.col("in")).drop("in"), "places")
    return places, members, loose, whole, by_tok


def jaccard_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, bits: int = 64) -> DataFrame:
    """(a, b): every link between documents with different sets, each set by the smallest id that has it; a and b in the order of their sets' hashes."""
    _, classes, links, tables = _linked(docs, doc_id, text, block, True, bits, None)
    links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    discard(*tables)
    of = lambda c: classes.select(F.col("sid").alias(f"sid_{c}"), F.col("rep").alias(f"doc_{c}"))
    links = links.join(of("a"), F.col("a") == F.col("sid_a")).join(of("b"), F.col("b") == F.col("sid_b"))
    return links.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, bits: int = 64, star: int = STAR) -> DataFrame:
    """(doc, n, component) of each row of docs."""
    rows, classes, linked, tables = _linked(docs, doc_id, text, block, False, bits, star)

    best = linked.join(classes, F.col("id") == F.col("sid")).groupBy("root").agg(F.min("rep").alias("best"))
    best = linked.join(best, "root").select(F.col("id").alias("best_id"), "best")
    final = cut(classes.join(best, F.col("sid") == F.col("best_id"), "left").select(F.col("sid").alias("id"), F.coalesce("best", "rep").alias("component")), "final")
    out = rows.join(final, F.col("sid") == F.col("id"), "left")
    discard(*tables, linked)
    return out.select("doc", "n", F.coalesce("component", "doc").alias("component"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = jaccard_components(table(spark, sf_dir, "documents"))
    return d.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


#: The same by counting the common shingles of all pairs that have one.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS h, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY x) USING (doc_id)
"""
