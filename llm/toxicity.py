"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A text is cut into words, a word's input is the embedding of its hash beside the largest values, place by place, of the embeddings
of its byte n-grams (SIZES, with a mark at either end), so that a stem shows in any form of a word.  Windows of WINDOW words begin every STEP words, so
they overlap and cover the whole text; each is read in both directions, the states are pooled by
attention and give one logit.  A text's logit is the largest of its windows; its score is the logistic function of
that after a shift and scale fitted to the labels.

Training is multiple-instance: of a bounded sample (PER_CLASS labelled rows a class, those with the smallest hash
of doc_id) each text is known by the window that the network finds most toxic at the time.
The first coordinate of the embeddings starts with the log odds of word and n-gram in the sample, shrunk
where they are uncertain, and at first the window with the highest of them stands for a text.  Labels can be
wrong: later, texts of class 1 that the network finds harmless, DOUBT of the class at most, are left out, or it would
learn them by heart.

Null and empty texts have one empty window.  Labels that are null or belong to no document teach nothing, nor do null ids; of rows with
one id the first text does, and with both labels it counts for both; without labels of both classes, or documents, every score is 0.  Repeated rows: each keeps a row.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import cut, map_arrow, sample_of_each, table
from llm.kernels import LOWER, pieces, span_hashes, word_bounds

#: Labelled rows of each class that the network is trained on.
PER_CLASS = 2000
WINDOW, STEP = 32, 16
SIZES = (3, 4, 5)
GRAM_BITS = 16
WORDS, GRAMS = 1 << 16, 1 << GRAM_BITS
EMBED, HIDDEN, ATTEND = 12, 12, 12
EPOCHS, BATCH, RATE = 6, 128, 0.01
#: Batches that a small sample is trained on at least, about.
STEPS = 110
#: Empty texts of class 0 that are added to the sample.
EMPTY = 40
#: Part of the texts of class 1 whose labels may be wrong.
DOUBT = 0.2
#: Misses that a false alarm is worth.
ALARM = 2.0

_SEP = np.ones(256, bool)
_SEP[48:58] = _SEP[97:123] = _SEP[0x80:] = False
_SEP[65:91] = False


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Words:
    """The distinct words of some texts, with their hash buckets and n-grams, and the sequence of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = LOWER[data]
        starts, ends, self.first = word_bounds(low, offsets, _SEP)
        hashes = span_hashes(low, starts, ends)
        names, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        self.sequence = inverse.astype(np.int32)
        self.bucket = (names % np.uint64(WORDS)).astype(np.int32)
        s, e = starts[at], ends[at]
        # a word's n-grams of bytes for each n of SIZES, with a mark at either end
        size = e - s + 2
        begin = np.cumsum(size) - size
        text = np.ones(int(size.sum()), np.uint8)
        inside = np.repeat(s - begin - 1, size) + np.arange(len(text))
        edge = np.zeros(len(text), bool)
        edge[begin] = edge[begin + size - 1] = True
        text[~edge] = np.where(_SEP[low], 1, low)[inside[~edge]] if len(low) else 1
        parts, owner = [], []
        for n in SIZES:
            if len(text) < n:
                continue
            h = np.full(len(text) - n + 1, n, np.uint32)
            for j in range(n):
                h = (h ^ text[j : len(text) - n + 1 + j]) * np.uint32(0x01000193)
            which = np.repeat(np.arange(len(size)), size)
            ok = which[: len(h)] == which[n - 1 :]
            h = h[ok]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            parts.append((h >> np.uint32(32 - GRAM_BITS)).astype(np.int32))
            owner.append(which[: len(ok)][ok])
        grams, owner = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (parts, owner))
        self.grams = grams[np.argsort(owner, kind="stable")]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(size)))])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(word of each place of each window, or the number of words where the text is over; the text of each window)."""
        count = np.diff(self.first)
        n = np.maximum(1, -(-(count - WINDOW) // STEP) + 1)
        text = np.repeat(np.arange(len(count)), n)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STEP + self.first[:-1][text]
        place = begin[:, None] + np.arange(WINDOW)
        ok = place < self.first[1:][text][:, None]
        out = np.full(place.shape, len(self.bucket), np.int32)
        out[ok] = self.sequence[place[ok]]
        return out, text


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *shape, s=0.3: r.normal(0, s, shape).astype(np.float32)
        self.p = {"ew": f(WORDS, EMBED, s=0.05), "ec": f(GRAMS, EMBED, s=0.05), "wa": f(2 * HIDDEN, ATTEND), "ba": np.zeros(ATTEND, np.float32), "va": f(ATTEND), "wo": f(2 * HIDDEN), "bo": np.full(1, -1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": f(2 * EMBED, 3 * HIDDEN), f"u{d}": f(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.shift, self.scale = 0.0, 1.0

    def inputs(self, bucket: np.ndarray, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows of inputs of words, and one of zeros."""
        x = np.zeros((len(bucket) + 1, 2 * EMBED), np.float32)
        x[:-1, :EMBED] = self.p["ew"][bucket]
        for a in range(0, len(bucket), 4096):
            b = min(a + 4096, len(bucket))
            x[a:b, EMBED:] = np.maximum.reduceat(self.p["ec"][grams[bounds[a] : bounds[b]]], bounds[a:b] - bounds[a])
        return x

    def _read(self, g: np.ndarray, idx: np.ndarray, u: np.ndarray, back: bool, keep: list | None) -> np.ndarray:
        """States (places, windows, HIDDEN) of one direction."""
        n, length = idx.shape
        end = len(g) - 1
        states = np.zeros((length, n, HIDDEN), np.float32)
        h = np.zeros((n, HIDDEN), np.float32)
        uz, uc = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
        for t in range(length - 1, -1, -1) if back else range(length):
            i = idx[:, t]
            x = g[i]
            zr = _sigmoid(x[:, : 2 * HIDDEN] + h @ uz)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            rh = r * h
            c = np.tanh(x[:, 2 * HIDDEN :] + rh @ uc)
            new = h + z * (c - h)
            over = i == end
            if over.any():
                new = np.where(over[:, None], h, new)
            if keep is not None:
                keep.append((t, h, z, r, c, rh, over))
            states[t] = h = new
        return states

    def forward(self, x: np.ndarray, idx: np.ndarray, keep: dict | None = None) -> np.ndarray:
        p = self.p
        parts = []
        for d in "fb":
            steps = [] if keep is not None else None
            parts.append(self._read(x @ p[f"x{d}"] + p[f"b{d}"], idx, p[f"u{d}"], d == "b", steps))
            if keep is not None:
                keep[d] = steps
        s = np.concatenate(parts, 2)
        a = np.tanh(s @ p["wa"] + p["ba"])
        e = a @ p["va"]
        over = (idx == len(x) - 1).T
        e[over] = -1e9
        w = np.exp(e - e.max(0))
        w[over] = 0
        w /= np.maximum(w.sum(0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", w, s)
        if keep is not None:
            keep |= {"s": s, "a": a, "w": w, "pooled": pooled, "over": over}
        return pooled @ p["wo"] + p["bo"][0]

    def gradients(self, x: np.ndarray, idx: np.ndarray, goal: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss; "x" is that of the inputs."""
        p, k = self.p, {}
        n = len(idx)
        dl = ((_sigmoid(self.forward(x, idx, k)) - goal) / n).astype(np.float32)
        out = {"bo": dl.sum(keepdims=True), "wo": k["pooled"].T @ dl}
        dp = dl[:, None] * p["wo"]
        ds = k["w"][:, :, None] * dp
        dw = np.einsum("nh,tnh->tn", dp, k["s"])
        de = k["w"] * (dw - (k["w"] * dw).sum(0))
        da = de[:, :, None] * p["va"] * (1 - k["a"] ** 2)
        out["va"] = np.einsum("tn,tna->a", de, k["a"])
        out["wa"] = np.einsum("tnh,tna->ha", k["s"], da)
        out["ba"] = da.sum((0, 1))
        ds = ds + da @ p["wa"].T
        dx = np.zeros_like(x)
        for d, part in (("f", ds[:, :, :HIDDEN]), ("b", ds[:, :, HIDDEN:])):
            u = p[f"u{d}"]
            du, dg = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), np.float32)
            dh = np.zeros((n, HIDDEN), np.float32)
            for t, h, z, r, c, rh, over in reversed(k[d]):
                dh = dh + part[t]
                go = np.where(over[:, None], 0, dh)
                dc = go * z * (1 - c * c)
                dz = go * (c - h) * z * (1 - z)
                drh = dc @ u[:, 2 * HIDDEN :].T
                dr = drh * h * r * (1 - r)
                gate = np.concatenate([dz, dr], 1)
                du[:, : 2 * HIDDEN] += h.T @ gate
                du[:, 2 * HIDDEN :] += rh.T @ dc
                np.add.at(dg, idx[:, t], np.concatenate([gate, dc], 1))
                dh = np.where(over[:, None], dh, dh * (1 - z) + drh * r + gate @ u[:, : 2 * HIDDEN].T)
            out[f"u{d}"], out[f"b{d}"], out[f"x{d}"] = du, dg.sum(0), x.T @ dg
            dx += dg @ p[f"x{d}"].T
        return out | {"x": dx}

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The largest logit of each text's windows."""
        words = Words(data, offsets)
        idx, text = words.windows()
        x = self.inputs(words.bucket, words.grams, words.bounds)
        out = np.full(len(offsets) - 1, -np.inf, np.float32)
        for a in range(0, len(idx), 8192):
            np.maximum.at(out, text[a : a + 8192], self.forward(x, idx[a : a + 8192]))
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.logits(data, offsets).astype(float) - self.shift) * self.scale, -30, 30)))


def _odds(places: Callable[[int, int], tuple[np.ndarray, np.ndarray]], goal: np.ndarray, size: int) -> np.ndarray:
    """Shrunk log odds of class 1 for texts that have each kind; places(a, b): (kinds, their texts) in texts a to b."""
    have = np.zeros((2, size))
    for first in range(0, len(goal), 100):
        kind, text = places(first, min(first + 100, len(goal)))
        pair = np.unique(text.astype(np.int64) * size + kind)
        for c in (0, 1):
            have[c] += np.bincount(pair[goal[pair // size] == c] % size, minlength=size)
    b, a = have
    odds = np.log((a + 0.5) / (goal.sum() + 1)) - np.log((b + 0.5) / ((goal == 0).sum() + 1))
    z2 = odds**2 / (1 / (a + 0.5) + 1 / (b + 0.5))
    return np.clip(odds * z2 / (z2 + 9), -4, 4).astype(np.float32)


def train(texts: list[str], goal: np.ndarray, share: float, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """A network for texts of classes 0 and 1; share: of class 1 among all labelled rows."""
    net, r = Network(seed), np.random.default_rng(seed)
    texts, goal = [*texts, *[""] * EMPTY], np.append(goal, np.zeros(EMPTY, int))
    raw = [t.encode() for t in texts]
    words = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    idx, text = words.windows()
    aside = np.arange(len(texts)) % 4 == 3  # trained on the others, the shift is fitted to these
    size = np.diff(words.bounds)

    def own_words(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (word, text) of texts a to b that aren't set aside."""
        x = words.sequence[words.first[a] : words.first[b]]
        text = np.repeat(np.arange(a, b), np.diff(words.first[a : b + 1]))
        use = ~aside[text]
        pair = np.unique(text[use].astype(np.int64) * len(size) + x[use]) if len(size) else np.zeros(0, np.int64)
        return pair % max(len(size), 1), pair // max(len(size), 1)

    def own_grams(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        x, text = own_words(a, b)
        n = size[x]
        return words.grams[np.repeat(words.bounds[:-1][x] - (np.cumsum(n) - n), n) + np.arange(n.sum())], np.repeat(text, n)

    net.p["ew"][:, 0] = _odds(lambda a, b: (words.bucket[own_words(a, b)[0]], own_words(a, b)[1]), goal, WORDS)
    net.p["ec"][:, 0] = 0.5 * _odds(own_grams, goal, GRAMS)
    for d in "fb":
        net.p[f"x{d}"][0, 2 * HIDDEN :] = 0.5
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for _ in range(max(epochs, -(-STEPS * BATCH // len(texts)))):
        early = step < STEPS // 8
        if not early:
            every = net.inputs(words.bucket, words.grams, words.bounds)
            logit = np.concatenate([net.forward(every, idx[a : a + 8192]) for a in range(0, len(idx), 8192)])
        else:  # the network knows little yet: the window with the most telling word
            logit = np.append(net.p["ew"][words.bucket, 0], -9)[idx].max(1)
        best = np.lexsort((-logit, text))[np.searchsorted(text, np.arange(len(texts)))]
        if not early:  # a text of class 1 that looks harmless is taken for a wrong label, but not most of them
            best = best[(goal == 0) | (logit[best] >= min(0, np.quantile(logit[best][goal == 1], DOUBT)))]
        spare = r.integers(0, len(idx), len(texts))
        chosen = r.permutation(np.concatenate([best, spare[goal[text[spare]] == 0]]))
        chosen = chosen[~aside[text[chosen]]]
        for a in range(0, len(chosen), BATCH):
            w = chosen[a : a + BATCH]
            names, local = np.unique(idx[w], return_inverse=True)
            real = names[names < len(words.bucket)]
            local = local.reshape(idx[w].shape).astype(np.int32)
            n = np.diff(words.bounds)[real]
            bounds = np.concatenate([[0], np.cumsum(n)])
            grams = words.grams[np.repeat(words.bounds[:-1][real] - bounds[:-1], n) + np.arange(bounds[-1])]
            own = net.inputs(words.bucket[real], grams, bounds)
            g = net.gradients(own, local, goal[text[w]].astype(np.float32))
            dx = g.pop("x")[: len(real)]
            g["ew"], g["ec"] = np.zeros_like(net.p["ew"]), np.zeros_like(net.p["ec"])
            np.add.at(g["ew"], words.bucket[real], dx[:, :EMBED])
            highest = net.p["ec"][grams] == np.repeat(own[:-1, EMBED:][: len(real)], n, axis=0)
            np.add.at(g["ec"], grams, np.where(highest, np.repeat(dx[:, EMBED:], n, axis=0), 0))
            step += 1
            for k, v in g.items():
                m, s = moment[k]
                m += 0.1 * (v - m)
                s += 0.01 * (v * v - s)
                net.p[k] -= (RATE * (0.1 if k in ("ew", "ec") else 1) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    every = net.inputs(words.bucket, words.grams, words.bounds)
    top = np.full(len(texts), -np.inf, np.float32)
    for a in range(0, len(idx), 8192):
        np.maximum.at(top, text[a : a + 8192], net.forward(every, idx[a : a + 8192]))
    # the shift that costs least if class 1 has its share and a false alarm costs ALARM misses, in the middle of the gap it falls in
    if len(set(goal[aside].tolist())) == 2:
        top, goal = top[aside], goal[aside]
    order = np.argsort(top, kind="stable")
    weight = np.where(goal[order] == 1, -share / max((goal == 1).sum(), 1), ALARM * (1 - share) / max((goal == 0).sum(), 1))
    right = np.concatenate([[0], np.cumsum(weight)])
    cut = int(right.argmax())
    near = top[order[max(cut - 1, 0)]], top[order[min(cut, len(order) - 1)]]
    net.shift = float((near[0] + near[1]) / 2)
    spread = float(np.std(top)) or 1.0
    net.scale = 3.0 / spread
    return net


def _learnable(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) != 0


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, epochs: int = EPOCHS) -> Network | None:
    """docs (doc_id, text), labels (doc_id, toxic)."""
    known = labels.select(F.col("doc_id").alias("id"), "toxic").where(_learnable(F.col("id")) & F.col("toxic").isin(0, 1)).distinct()
    count = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}  # two at most
    if len(count) < 2:
        return None
    own = docs.select(F.col("doc_id").alias("id"), "text").where(F.col("id").isNotNull())
    # which documents, by their ids alone; their texts come with a join of that bounded list
    ids = own.select("id").distinct().join(known, "id").select("id", "toxic", F.lit("").alias("text"))
    pick = cut(sample_of_each(ids, "toxic", per_class).select("id", "toxic"), "pick")
    rows = own.where(F.col("text").isNotNull()).join(F.broadcast(pick), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).toPandas()  # per_class rows a class
    rows = rows.sort_values(["id", "toxic"])
    goal = rows.toxic.to_numpy(int)
    if len(set(goal.tolist())) < 2:
        return None
    return train(rows.text.tolist(), goal, count[1] / (count[0] + count[1]), epochs)


def _score(net: Network | None):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            parts = [np.zeros(len(offsets) - 1) if net is None else net.scores(data, offsets) for _, _, data, offsets in pieces(batch.column(1), 1 << 20)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, net: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of each row."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, _score(net), f"doc_id {kind}, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(~_learnable(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
