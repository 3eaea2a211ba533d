"""Personal data by anchor expansion.

One Aho-Corasick pass over a text, in lower case, finds anchors: at-signs, plus signs before digits, points before digits, pairs of
digits, scheme separators, cues of identifiers and country codes before digits.  A small parser for each kind expands an
anchor to both sides and validates what it finds.  Base kinds, equal to the leftmost non-overlapping
matches of their patterns:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
    card   [0-9]([\\x20-]?[0-9])+, 13 to 19 digits that pass the Luhn test
    phone  \\+[0-9][\\x20().0-9-]+[0-9], 9 to 15 digits

A match that fails its test is dropped and consumes its characters.  Added kinds: ``account`` (an IBAN that
has its country's length and passes its check digits, wherever it stands, or an identifier with digits after a cue such as
"account number" in any case) and ``login`` (a
URL with user information).  Every expansion starts no further left than the end of the last match
of its kind, so the work is linear in the text.

Nulls are empty texts.  Positions count code points, ends are exclusive.  Repeated rows: each
keeps a row.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import map_arrow, table

KINDS = ("email", "ip", "card", "phone")
MORE = ("account", "login")
#: Words that announce an identifier.
CUES = ("account number", "account no", "account id", "customer id", "customer number", "passport number", "passport no", "social security number", "ssn", "iban", "kontonummer", "numéro de compte", "número de cuenta")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DIGITS = frozenset("0123456789")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Countries with IBANs and their lengths.
IBANS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 "
    "JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20")
_IBAN = {x[:2]: re.compile(rf"{x[:2]}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{int(x[2:]) - 4}}}(?![A-Za-z0-9])") for x in IBANS.split()}
_IDENTIFIER = re.compile(r"[\x20:#.=]{0,4}([A-Z0-9](?:[A-Z0-9-]{4,32})[A-Z0-9])(?![A-Za-z0-9])")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_USER = re.compile(r"[^\s/@:<>\"']+(?::[^\s/@<>\"']*)?@[A-Za-z0-9.-]+[^\s<>\"']*")

_held: list = []


def _automaton():
    if not _held:
        a = ahocorasick.Automaton()
        for d in "0123456789":
            a.add_word("." + d, ("ip", 2))
            a.add_word("+" + d, ("phone", 2))
            for e in "0123456789":
                for sep in ("", " ", "-"):
                    a.add_word(d + sep + e, ("card", 2 + len(sep)))
            for country in _IBAN:
                a.add_word(country.lower() + d, ("iban", 3))
        a.add_word("@", ("email", 1))
        a.add_word("://", ("login", 3))
        for cue in CUES:
            a.add_word(cue, ("account", len(cue)))
        a.make_automaton()
        _held.append(a)
    return _held[0]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban_at(text: str, at: int) -> tuple[int, int] | None:
    pattern = _IBAN.get(text[at : at + 2])
    m = pattern.match(text, at) if pattern else None
    return m.span() if m and _iban(m[0]) else None


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind, from left to right."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS + MORE}
    done = dict.fromkeys(out, 0)
    small = text.lower()
    if len(small) != len(text):  # a character whose lower case has two
        small = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    for last, (kind, size) in _automaton().iter(small):
        at, end = last - size + 1, last + 1
        low = done["account" if kind == "iban" else kind]
        if at < low:
            continue
        if kind == "email":
            s = at
            while s > low and text[s - 1] in _LOCAL:
                s -= 1
            m = _DOMAIN.match(text, end) if s < at else None
            if m:
                out[kind].append((s, m.end()))
                done[kind] = m.end()
        elif kind == "ip":
            s = at
            while s > low and text[s - 1] in _DIGITS:
                s -= 1
            m = _IP.match(text, s) if s < at else None
            if m:
                done[kind] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                    out[kind].append(m.span())
        elif kind == "card":
            m = _CARD.match(text, at)
            done[kind] = m.end()
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - at <= 40 else ""
            if 13 <= len(digits) <= 19 and luhn(digits):
                out[kind].append(m.span())
        elif kind == "phone":
            m = _PHONE.match(text, at)
            if m:
                done[kind] = m.end()
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    out[kind].append(m.span())
        elif kind == "account":
            head = at and text[at - 1].isalnum()
            m = None if head else _IDENTIFIER.match(text, end)
            if m and any(c in _DIGITS for c in m[1]) and not _iban_at(text, m.start(1)):
                out[kind].append(m.span(1))
                done[kind] = m.end()
        elif kind == "iban":
            m = None if at and text[at - 1].isalnum() else _iban_at(text, at)
            if m:
                out["account"].append(m)
                done["account"] = m[1]
        else:
            s = at
            while s > low and at - s < 32 and text[s - 1] in _SCHEME:
                s -= 1
            m = _USER.match(text, end) if s < at else None
            if m:
                stop = m.start() + len(m[0].rstrip(".,;:!?)]}"))
                out[kind].append((s, stop))
                done[kind] = stop
    return out


def redact(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span, or union of overlapping spans, replaced by the kind of the one that starts first."""
    spans = sorted((s, e, k) for k, xs in found.items() for s, e in xs)
    out, end = [], 0
    for s, e, k in spans:
        if s >= end:
            out += [text[end:s], f"<{k.upper()}>"]
        end = max(end, e)
    return "".join(out) + text[end:]


def _spans(found: dict, kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        counts, base, spans = [[], [], [], []], [], []
        for text in batch.column(1).to_pylist():
            f = find(text or "")
            for c, k in zip(counts, KINDS, strict=True):
                c.append(len(f[k]))
            base.append(hashlib.sha256(_spans(f, KINDS).encode()).hexdigest())
            spans.append(_spans(f, KINDS + MORE))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(base, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, _rows, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _clean(at: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [None if t is None else redact(t, find(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(texts, pa.string()))

    return run


def redact_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with its text redacted; all columns stay, null texts stay null."""
    return map_arrow(docs, _clean(docs.columns.index(text)), docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
