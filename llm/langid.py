"""Language identification by n-gram filters that answer for all languages at once.

Of a bounded sample (PER_LANG rows a language, those with the smallest hash of doc_id) the
byte n-grams of each language are counted.  An n-gram goes into the filter of a language if it is seen often
enough there and at least SHARE times as often as in the language that has it most.  The
Bloom filters are bit-sliced: slot i holds one bit for each language, so an n-gram's slots, and-ed, are
the mask of all languages that have it.  Of a text's n-grams that hold a letter (a byte from 0x80 on counts as one),
the hits of each language are counted and corrected for the filter's false positives, ``(hits / n - p) / (1 - p)``;
the highest share decides and is the score.  Fewer than ENOUGH of them are too few to reject a text by its score.

Null texts and texts without a letter are "und" with score 0.  Rows with a null language, id or
text teach nothing, and of rows with one id and language one does.  Languages with equal shares: the first by name.  Repeated rows: each keeps a row.  With no row to learn from, every row is "und".
Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import map_arrow, sample_of_each, table
from llm.kernels import LOWER, pieces

#: Rows a language that the filters are fitted on.
PER_LANG = 1500
SIZES = (3, 4, 5)
SLOTS = 1 << 20
LEAST, SHARE = 3, 0.35
#: N-grams with a letter, of about 100 bytes, from which on a low score speaks against a text.
ENOUGH = 300

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0x80:] = True
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True


def _codes(data: np.ndarray, size: int) -> np.ndarray:
    """A 32-bit hash of the size bytes from each place on."""
    n = len(data) - size + 1
    h = np.full(max(n, 0), size * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for j in range(size):
        h = (h ^ data[j : n + j]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h & np.uint32(SLOTS - 1), ((h * np.uint32(0x297A2D39)) >> np.uint32(12)) & np.uint32(SLOTS - 1)


class Filters:
    """Languages, the slots' masks, and the share of set bits of each language's filter."""

    def __init__(self, langs: list[str], counts: list[dict[int, tuple[np.ndarray, np.ndarray]]], totals: list[int]):
        self.langs = langs
        words = -(-len(langs) // 64)
        bits = next(b for b in (8, 16, 32, 64) if len(langs) <= b) if words == 1 else 64
        self.masks = np.zeros((words, SLOTS), f"uint{bits}")
        for size in SIZES:
            every = np.concatenate([c[size][0] for c in counts])
            rate = np.concatenate([c[size][1] / max(t, 1) for c, t in zip(counts, totals, strict=True)])
            seen = np.concatenate([c[size][1] for c in counts])
            lang = np.repeat(np.arange(len(langs)), [len(c[size][0]) for c in counts])
            grams, at = np.unique(every, return_inverse=True)
            top = np.zeros(len(grams))
            np.maximum.at(top, at, rate)
            keep = (seen >= LEAST) & (rate >= SHARE * top[at])
            for k in range(len(langs)):
                bit = self.masks.dtype.type(1 << (k % bits))
                for s in _slots(every[keep & (lang == k)]):
                    self.masks[k // 64, s] |= bit
        self.bits = bits
        fill = [float(np.mean((self.masks[k // 64] >> self.masks.dtype.type(k % bits)) & self.masks.dtype.type(1))) for k in range(len(langs))]
        self.false = np.array(fill) ** 2

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(rows, languages): corrected shares of n-grams that each language has."""
        return self.judge(data, offsets)[0]

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """shares(), and the number of n-grams with a letter of each row."""
        data = LOWER[data]
        rows = len(offsets) - 1
        hits, n = np.zeros((rows, len(self.langs))), np.zeros(rows)
        letter = _LETTER[data]
        for size in SIZES:
            if len(data) < size:
                continue
            h = _codes(data, size)
            a, b = _slots(h)
            inside = np.ones(len(h), bool)
            for j in range(1, size):  # n-grams that run over the end of a row
                e = offsets[1:-1] - j
                inside[e[(e >= 0) & (e < len(h))]] = False
            held = letter[: len(h)].copy()
            for j in range(1, size):
                held |= letter[j : len(h) + j]
            inside &= held
            stops = np.minimum(offsets, len(h))
            total = np.zeros(len(h) + 1, np.int64)
            np.cumsum(inside, dtype=np.int64, out=total[1:])
            n += total[stops[1:]] - total[stops[:-1]]
            for w in range(len(self.masks)):
                m = self.masks[w][a] & self.masks[w][b]
                m[~inside] = 0
                for k in range(w * 64, min(len(self.langs), w * 64 + 64)):
                    total = np.zeros(len(h) + 1, np.int64)
                    np.cumsum((m >> m.dtype.type(k % self.bits)) & m.dtype.type(1), dtype=np.int64, out=total[1:])
                    hits[:, k] += total[stops[1:]] - total[stops[:-1]]
        return np.clip((hits / np.maximum(n, 1)[:, None] - self.false) / (1 - self.false), 0, 1), n


def _learnable(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2


def fit(docs: DataFrame, per_lang: int = PER_LANG, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Filters | None:
    """Filters learnt from at most per_lang rows of each language."""
    d = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(_learnable(F.col("id")))
    rows = sample_of_each(d, "lang", per_lang).select("lang", "text").toArrow()  # per_lang rows a language
    return learn(zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist(), strict=True))


def learn(rows: Iterable[tuple[str, str]]) -> Filters | None:
    """Filters of (language, text); a line counts once, and one of several languages, a passage passed on, not at all."""
    lines: dict[str, set[str]] = {}
    for x, text in rows:
        lines.setdefault(x, set()).update(text.split("\n"))
    seen = Counter(line for own in lines.values() for line in own)
    langs = sorted(lines)
    counts, totals = [], []
    for x in langs:
        data = np.frombuffer("\n".join(sorted(line for line in lines[x] if seen[line] == 1)).encode(), np.uint8)
        counts.append({size: np.unique(_codes(LOWER[data], size), return_counts=True) for size in SIZES})
        totals.append(len(data))
    return Filters(langs, counts, totals) if langs else None


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that have a letter."""
    ascii_ = np.concatenate([[0], np.cumsum(_ASCII[data])])
    some = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    for i in np.flatnonzero(~some & (np.diff(offsets) > 0)).tolist():
        some[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return some


def _judged(filters: Filters | None, texts: pa.Array) -> tuple[list[str], list[float], list[float]]:
    """Language, score and number of n-grams with a letter of each text."""
    best, score, grams = [], [], []
    for _, _, data, offsets in pieces(texts):
        some = _letters(data, offsets)
        if filters is None:
            some[:] = False
            share, n = np.zeros((len(some), 1)), np.zeros(len(some))
        else:
            share, n = filters.judge(data, offsets)
        top = share.argmax(1)
        s = np.where(some, share[np.arange(len(top)), top], 0.0)
        best += [filters.langs[k] if ok else "und" for k, ok in zip(top.tolist(), some.tolist(), strict=True)]
        score += s.tolist()
        grams += n.tolist()
    return best, score, grams


def predictor(filters: Filters | None, at: int):
    """Adds lang_pred and score to batches with the text in column at."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            best, score, _ = _judged(filters, batch.column(at))
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], pa.array(best, pa.string()), pa.array(score, pa.float64())],
                                             names=[*[x for i, x in enumerate(batch.schema.names) if i != at], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, filters: Filters | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, predictor(filters, 1), f"doc_id {kind}, lang_pred string, score double")


def _keep(filters: Filters | None, at: int, least: float):
    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                best, score, grams = _judged(filters, batch.column(at))
                ok = (np.array(best) != "und") & ((np.array(score) >= least) | (np.array(grams) < ENOUGH))
                yield batch.filter(pa.array(ok))

    return keep


def keep_identified(docs: DataFrame, filters: Filters | None, least: float = 0.0, text: str = "text") -> DataFrame:
    """The rows of docs whose language is found with a score of at least ``least``, or that have a letter but too few n-grams to judge by; all columns stay."""
    return map_arrow(docs, _keep(filters, docs.columns.index(text), least), docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    held = F.coalesce(~_learnable(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
