"""SentencePiece encoding and decoding by a streaming Viterbi search.

The vocabulary file gives pieces with scores (where it holds merges, whose scores are only their ranks, the score is
the logarithm of a probability by Zipf's law, -log(rank)), in whole multiples of 2**-32, so that sums are exact.  The ids of a text are
the segmentation with the highest sum of scores, and among equal ones the one whose last piece is longest at
the first place (from the end) where they differ.  Characters in no piece are written as their UTF-8 bytes.

The search keeps back pointers for a window only: a piece spans at most ``longest`` characters, so the
states that can still be extended are the last ``longest`` ones.  As soon as the back paths of all of them meet
in one boundary, the ids up to there can't change any more; they are committed and the window moves on.  Between two characters that stand
side by side in no piece all paths meet whatever the scores are; a stretch between two such places is a window of its own.
So stretches are searched side by side, all of them one character further at each step, and one that is seen again gets the ids it
got before (from a bounded table that starts anew when full).  A stretch of more than LANE characters goes on alone, committed
where its paths meet (``stream``), which gives the same ids for any text as a whole.  Memory is bounded by the distance between
boundaries, not by the text.

Decoding joins the pieces' bytes and takes off the leading space that encoding puts in front; it returns
exactly the text that was encoded.  Stretches and pieces are known by 64-bit hashes; a text that does not decode to itself is searched
again without them.  A null text has null ids; an empty text has none.  Repeated rows: each keeps
a row.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import map_arrow, table
from llm.kernels import _pow, mix, pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stretches in the table of one worker.
HELD = 400_000
#: Longest stretch, in characters, that is searched beside others.
LANE = 64
#: Stretches that are searched side by side.
LANES = 8192
#: Characters of a text that are handled at once, about; a longer text is cut before a space.
PART = 1 << 20
#: Bytes of texts that are encoded together, about.
TOGETHER = 1 << 19
UNIT = 1 << 32
_NONE = -(1 << 62)
_MARK, _OWN, _CODES = 0x2581, 0x110000, 0x110001


def _fields(raw: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(field, wire type, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, kind, raw[at : at + size]
            at += size


def load(model: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id; types: 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte."""
    out = []
    with open(model, "rb") as f:
        raw = f.read()
    kinds = [v for field, _, spec in _fields(raw) if field == 2 for k, _, v in _fields(spec) if k == 3]
    for field, _, value in _fields(raw):
        if field == 1:
            piece, score, kind = "", 0.0, 1
            for k, _, v in _fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    (score,) = struct.unpack("<f", v)
                elif k == 3:
                    kind = v
            if kinds and kinds[-1] == 2:  # a vocabulary of merges, by rank
                score = -math.log(len(out) + 1)
            out.append((piece, score, kind))
    return out


class Coder:
    """Encoder and decoder of one vocabulary; picklable."""

    def __init__(self, vocabulary: list[tuple[str, float, int]]):
        self.score = {p: (round(s * UNIT), i) for i, (p, s, k) in enumerate(vocabulary) if k in (1, 4) and p}
        self.byte = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(vocabulary) if k == 6}
        if len(self.byte) != 256:
            raise ValueError("the vocabulary has no piece for each byte")
        self.longest = max(map(len, self.score))
        self.unknown = min(s for s, _ in self.score.values()) - 10 * UNIT
        ends: dict[str, set[int]] = {}
        for p in self.score:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {c: sorted(x, reverse=True) for c, x in ends.items()}  # of pieces that end in two characters
        self.raw = [bytes([int(p[1:-1], 16)]) if k == 6 else b"" if k in (2, 3) else p.replace(SPACE, " ").encode() for p, _, k in vocabulary]
        self.sizes = np.array([len(x) for x in self.raw])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self._tables()
        self._forget()

    def _tables(self) -> None:
        """Pieces by length and hash, and which characters stand side by side in one."""
        self.scores = np.zeros(len(self.raw), np.int64)
        for s, i in self.score.values():
            self.scores[i] = s
        self.single = np.full(_CODES, -1, np.int32)
        for p, (_, i) in self.score.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        letters = sorted({c for p in self.score if len(p) > 1 for c in p})
        self.kind = np.zeros(_CODES, np.uint16)
        self.kind[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.kinds = len(letters) + 1
        pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.beside = np.zeros(self.kinds**2, bool)
        self.beside[[int(self.kind[ord(x)]) * self.kinds + int(self.kind[ord(y)]) for x, y in pairs]] = True
        self.by_length = {}
        self.maybe = np.zeros(1 << 21, bool)
        for n in range(2, self.longest + 1):
            own = [p for p in self.score if len(p) == n]
            if own:
                codes = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)
                keys = _hashes(_prefix(codes), np.arange(0, len(codes), n), n)
                order = np.argsort(keys)
                self.by_length[n] = keys[order], np.array([self.score[p][1] for p in own], np.int32)[order]
                self.maybe[keys & np.uint64(len(self.maybe) - 1)] = True

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)  # hashes, begins and numbers of ids
        self.held: list[np.ndarray] = []
        self.held_ids = 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "held", "held_ids")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._forget()

    def stream(self, chars: str | list[str]) -> Iterator[int]:
        """Ids of a text whose spaces are marks, committed as soon as they are certain.

        chars may be a list in which a mark that stood in the text itself is written as an empty string.
        """
        best, back, ids = [0], [0], [()]
        done, start = 0, 0  # done: the last boundary committed; lists begin there
        text, longest = chars, self.longest
        for end in range(1, len(text) + 1):
            top, at, got = self._best(text, end, start, best)
            best.append(top)
            back.append(at)
            ids.append(got)
            if end - start >= 4 * longest:  # does every path that can go on pass one boundary?
                live = {back[i - start] if i > done else done for i in range(max(done, end - longest + 1), end + 1)} | {end}
                while len(live) > 1:
                    high = max(live)
                    live.discard(high)
                    live.add(back[high - start] if high > done else done)
                meet = live.pop()
                if meet > done:
                    yield from self._path(back, ids, start, done, meet)
                    best, back, ids = best[meet - start :], back[meet - start :], ids[meet - start :]
                    done = start = meet
        yield from self._path(back, ids, start, done, len(text))

    @staticmethod
    def _path(back: list[int], ids: list[tuple], start: int, low: int, end: int) -> Iterator[int]:
        parts = []
        while end > low:
            parts.append(ids[end - start])
            end = back[end - start]
        for p in reversed(parts):
            yield from p

    def _best(self, text: str | list[str], end: int, start: int, best: list[int]) -> tuple[int, int, tuple[int, ...]]:
        """(score, begin, ids) of the best last step of a path to end."""
        score, last = self.score, text[end - 1]
        top, at, got = _NONE, end - 1, ()
        one = score.get(last) if last else None
        pair = text[end - 2 : end] if end > 1 else ""
        for n in self.lengths.get(pair if isinstance(pair, str) else "".join(pair) if all(pair) else "", ()):
            b = end - n
            if b < start:
                continue
            hit = score.get(text[b:end] if isinstance(text, str) else "".join(text[b:end]) if all(text[b:end]) else "")
            if hit is not None and best[b - start] + hit[0] > top:
                top, at, got = best[b - start] + hit[0], b, (hit[1],)
        alone = best[end - 1 - start] + (one[0] if one else self.unknown)
        if alone > top:
            return alone, end - 1, (one[1],) if one else tuple(self.byte[x] for x in (last or SPACE).encode())
        return top, at, got

    def _lanes(self, codes: np.ndarray, prefix: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of them a stretch) of stretches of LANE characters at most; the steps that stream() takes, for all of them at once."""
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        n, high = len(size), int(size[0])
        active = np.searchsorted(-size, -np.arange(high + 1), "right")  # stretches that have so many characters
        best = np.zeros((high + 1, n), np.int64)
        step = np.zeros((high + 1, n), np.int8)
        piece = np.zeros((high + 1, n), np.int32)
        for end in range(1, high + 1):
            k = active[end]
            to = begin[:k] + end
            top = np.full(k, _NONE)
            for m in range(min(end, self.longest), 1, -1):
                if m not in self.by_length:
                    continue
                h = _hashes(prefix, to - m, m)
                some = np.flatnonzero(self.maybe[h & np.uint64(len(self.maybe) - 1)])
                if not len(some):
                    continue
                keys, ids = self.by_length[m]
                at = np.minimum(np.searchsorted(keys, h[some]), len(keys) - 1)
                hit = keys[at] == h[some]
                some, got = some[hit], ids[at[hit]]
                total = best[end - m, some] + self.scores[got]
                more = total > top[some]
                some, got = some[more], got[more]
                top[some], step[end, some], piece[end, some] = total[more], m, got
            got = self.single[codes[to - 1]]
            total = best[end - 1, :k] + np.where(got >= 0, self.scores[got], self.unknown)
            more = total > top
            best[end, :k] = np.where(more, total, top)
            step[end, :k][more], piece[end, :k][more] = 1, got[more]
        back, rows = [], np.arange(n)
        at = size.copy()
        live = rows
        while len(live):
            back.append((live, piece[at[live], live]))
            at[live] -= step[at[live], live]
            live = live[at[live] > 0]
        count = np.zeros(n, np.int64)
        for who, _ in back:
            count[who] += 1
        place = np.zeros(n, np.int64)
        place[order] = count
        ends = np.cumsum(place)
        last = ends[order] - 1  # each stretch's ids stand in the order of the input
        out = np.empty(int(ends[-1]), np.int32)
        for j, (who, got) in enumerate(back):
            out[last[who] - j] = got
        return out, place

    def _search(self, codes: np.ndarray, prefix: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of them a stretch) of stretches; one of a character in no piece is that character."""
        alone = self.single[codes[begin]] < 0
        parts: list[np.ndarray | None] = [None] * len(begin)
        for i in np.flatnonzero(alone | (size > LANE)).tolist():
            if alone[i]:
                c = int(codes[begin[i]])
                parts[i] = np.array([self.byte[x] for x in (SPACE if c == _OWN else chr(c)).encode()], np.int32)
            else:
                parts[i] = np.fromiter(self.stream(codes[begin[i] : begin[i] + size[i]].tobytes().decode("utf-32-le")), np.int32)
        rest = np.flatnonzero(~alone & (size <= LANE))
        count = np.array([0 if x is None else len(x) for x in parts], np.int64)
        found = []
        for a in range(0, len(rest), LANES):
            ids, n = self._lanes(codes, prefix, begin[rest[a : a + LANES]], size[rest[a : a + LANES]])
            found.append(ids)
            count[rest[a : a + LANES]] = n
        begins = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        if found:
            out[_spread(begins[rest], count[rest])] = np.concatenate(found)
        for i, x in enumerate(parts):
            if x is not None:
                out[begins[i] : begins[i] + len(x)] = x
        return out, count

    def _looked_up(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each stretch begin, number of them)."""
        prefix = _prefix(codes)
        keys, first, which = np.unique(_hashes(prefix, begin, size), return_index=True, return_inverse=True)
        if len(self.known[0]) + len(keys) > HELD:
            self._forget()
        have, at, n = self.known
        spot = np.searchsorted(have, keys)
        old = (have[np.minimum(spot, len(have) - 1)] == keys) if len(have) else np.zeros(len(keys), bool)
        if not old.all():
            new = np.flatnonzero(~old)
            ids, count = self._search(codes, prefix, begin[first[new]], size[first[new]])
            starts = self.held_ids + np.cumsum(count) - count
            self.held.append(ids)
            self.held_ids += len(ids)
            have, at, n = (np.insert(x, spot[new], y) for x, y in ((have, keys[new]), (at, starts), (n, count)))
            self.known = have, at, n
            spot = np.searchsorted(have, keys)
        if len(self.held) > 1:
            self.held = [np.concatenate(self.held)]
        return self.held[0], at[spot[which]], n[spot[which]]

    def _ids(self, parts: list[str], lead: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their bounds) of parts of texts; lead: whether a space goes in front."""
        raw = "".join(f" {p}" if x else p for p, x in zip(parts, lead, strict=True))
        size = np.array([len(p) + x for p, x in zip(parts, lead, strict=True)])
        codes = np.frombuffer(raw.encode("utf-32-le"), np.uint32).copy()
        codes[codes == _MARK] = _OWN  # a mark of the text's own goes as bytes
        codes[codes == 32] = _MARK
        edge = np.ones(len(codes), bool)
        kind = self.kind[codes].astype(np.int64)
        edge[1:] = ~self.beside[kind[:-1] * self.kinds + kind[1:]]
        starts = np.cumsum(size) - size
        edge[starts[size > 0]] = True
        begin = np.flatnonzero(edge)
        ids, at, n = self._looked_up(codes, begin, np.diff(np.append(begin, len(codes))))
        out = ids[_spread(at, n)]
        total = np.concatenate([[0], np.cumsum(n)])
        return out, total[np.searchsorted(begin, np.append(starts, len(codes)))]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their bounds) of texts."""
        parts, lead, owner = [], [], []
        for i, t in enumerate(texts):
            for k, p in enumerate(_parts(t)):
                parts.append(p)
                lead.append(k == 0)
                owner.append(i)
        ids, sizes = [], np.zeros(len(texts), np.int64)
        at = 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (end == at or size + len(parts[end]) <= PART):
                size += len(parts[end])
                end += 1
            got, bounds = self._ids(parts[at:end], lead[at:end])
            ids.append(got)
            np.add.at(sizes, owner[at:end], np.diff(bounds))
            at = end
        every, bounds = np.concatenate(ids) if ids else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(sizes)])
        wrong = [i for i, ok in enumerate(self.equal(every, texts, bounds)) if not ok]
        if wrong:  # two hashes were equal
            rows = [every[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for i in wrong:
                rows[i] = np.fromiter(self.stream([SPACE, *("" if c == SPACE else SPACE if c == " " else c for c in texts[i])]), np.int32)
            every, bounds = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        return every, bounds

    def encode(self, text: str) -> bytes:
        """The ids, as packed 32-bit integers."""
        return self.encode_all([text])[0].tobytes()

    def equal(self, ids: np.ndarray, texts: list[str], bounds: np.ndarray) -> list[bool]:
        """Whether the ids between bounds decode to each text; the same bytes as decode() gives, for many texts at once."""
        size = self.sizes[ids]
        ends = np.cumsum(size)
        out = self.bytes[np.repeat(self.begins[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.concatenate([[0], ends])[bounds]
        raw = out.tobytes()
        return [raw[a + (b > a) : b] == t.encode() for a, b, t in zip(at[:-1].tolist(), at[1:].tolist(), texts, strict=True)]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw[1:].decode("utf-8", "replace")


def _prefix(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _pow("up", len(codes))[: len(codes)], out=out[1:])
    return out


def _hashes(prefix: np.ndarray, begin: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Hashes of the stretches of size characters from each begin on."""
    return mix((prefix[begin + size] - prefix[begin]) * _pow("down", len(prefix))[begin] + np.asarray(size, np.uint64))


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] places, and so on."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about PART characters, cut where a space follows another character."""
    at = 0
    while len(text) - at > PART:
        cut = at + PART
        while (cut := text.find(" ", cut)) >= 0 and text[cut - 1] == " ":
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    if text:
        yield text[at:]


def _encode(coder: Coder):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b, _, _ in pieces(batch.column(1), TOGETHER):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                whole = [t or "" for t in texts]
                every, bounds = coder.encode_all(whole)
                exact = coder.equal(every, whole, bounds)
                offsets = bounds.astype(np.int32)
                null = np.array([t is None for t in texts] + [False])
                ids = pa.ListArray.from_arrays(pa.array(offsets, mask=null) if null.any() else pa.array(offsets), pa.array(every))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), ids,
                    pa.array([hashlib.sha256(every[x:y]).hexdigest() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]), pa.array(exact)],
                    names=["doc_id", "n_ids", "ids", "ids_sha256", "round_trip"])

    return run


def encode(docs: DataFrame, model: str = MODEL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids, ids_sha256, round_trip): the ids, and whether decoding them gave back the text."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, _encode(Coder(load(model))), f"doc_id {kind}, n_ids long, ids array<int>, ids_sha256 string, round_trip boolean")


def _decode(coder: Coder):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [None if x is None else coder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(rows: DataFrame, model: str = MODEL, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    rows = rows.select(F.col(doc_id).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, _decode(Coder(load(model))), f"doc_id {kind}, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
