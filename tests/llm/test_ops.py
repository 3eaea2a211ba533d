import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import components, decontaminate, fingerprint, html_text, jaccard, kernels, langid, pieces, pii, suffix_dedup, toxicity, warc
from tests.llm import brute
from tests.oracle import same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def family(r, n=60, copies=6):
    """Near and exact copies of a text, with their edits."""
    base = words(r, n).split()
    out = []
    for _ in range(copies):
        t = list(base)
        for _ in range(r.randrange(4)):
            t[r.randrange(n)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(t))
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    t = [x for n in (8, 20, 60, 120) for x in family(r, n)] + [words(r, r.randrange(1, 90)) for _ in range(40)]
    t += [None, "", " \t\n", "one", "One", "a b c d", "A b c d", "the " * 300, "the " * 300, "é ü ß " * 40, "x" * 5000, "  nbsp word ",
          t[12] + " " + t[20], t[12].upper(), "\x0b".join(t[13].split())]
    order = list(range(len(t)))
    r.shuffle(order)
    return [(i, t[k]) for i, k in enumerate(order)]


def test_hashes_tell_words_apart():
    t = pa.array(["ab abc b", "", None, "b ab", "Ü ü Ab"])
    data, offsets = kernels.buffers(t)
    s, e, first = kernels.word_bounds(data, offsets)
    assert list(first) == [0, 3, 3, 3, 5, 8]
    h = kernels.span_hashes(data, s, e)
    assert h[0] == h[4] and h[2] == h[3] and len(set(h.tolist())) == 6
    assert [x[:2] for x in kernels.pieces(pa.array(["a" * 10, "b" * 10, "c"]), 12)] == [(0, 1), (1, 3)]
    sliced = pa.array(["zz", "ab", None, "b"]).slice(1)
    assert kernels.buffers(sliced)[0].tobytes() == b"abb"


# ---- 1


def plain_windows(docs, items):
    cut = lambda t: [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))]
    wins = {}
    for i, t in items:
        w = cut(t)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[x]
        ids = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def op1(spark, docs, items):
    d = decontaminate.decontaminate(docs, items)
    return sorted(map(tuple, d.select("doc", "n_words", "n_hit", F.size("item_ids"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256), F.col("n_hit") > 0).collect()), key=str)


def test_decontamination(spark):
    r = random.Random(5)
    items = [(i, words(r, n, 30)) for i, n in enumerate((1, 3, 4, 5, 7, 9, 10, 10, 11, 25, 40))] + [(11, None), (12, "..."), (13, "Σίσυφος É é ΑΣ.Β b c d e f g h i j k"), (14, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (10, "again an id " * 5)]
    docs = [(i, words(r, r.randrange(0, 120), 30)) for i in range(60)]
    docs += [(100 + i, f"{words(r, 20)} {t.upper() if i % 2 else t}; {words(r, 5)}") for i, (_, t) in enumerate(items) if t] + [(200, None), (201, ""), (202, "w1 " * 500), (100, docs[3][1]), (100, docs[3][1]), (None, items[9][1])]
    d = frame(spark, [(i, t, "x", "y") for i, t in docs], "doc_id long, text string, window string, item_ids string")
    assert op1(spark, d, frame(spark, items, "item_id long, text string")) == sorted(plain_windows(docs, items), key=str)
    assert op1(spark, d.limit(0), frame(spark, items, "item_id long, text string")) == []
    assert all(not x[5] for x in op1(spark, d, frame(spark, [], "item_id long, text string")))


def test_decontamination_sql(spark, sf_dir):
    same(decontaminate.op1_decontamination(spark, sf_dir), decontaminate.SQL, sf_dir)


def test_decontamination_stays_in_the_engine(spark, sf_dir):
    plan = decontaminate.op1_decontamination(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 2


@pytest.mark.parametrize("hot, bits", [(10**6, 64), (2, 64), (5, 64), (10**6, 2), (1, 3)])
def test_suffix_dedup(spark, hot, bits):
    r = random.Random(7)
    para = ["".join(r.choice("abcd ") for _ in range(n)) for n in (30, 39, 40, 41, 60, 90)]
    docs = [(i, "".join(r.choice(para) if r.random() < 0.4 else "".join(r.choice("efgh é") for _ in range(r.randrange(50))) for _ in range(6))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "a" * 300), (53, "ab" * 100), (54, docs[0][1]), (54, docs[0][1]), (55, "q" * 39), (56, "q" * 39), (57, "\0" * 90), (None, para[5]), (58, "x" + "Is on. " * 30), (59, "yz" + "Is on. " * 40 + "end"), (60, "Is on. " * 5), (61, "Is on. " * 7)]
    got = suffix_dedup.remove_repeats(frame(spark, [(*d, 1, "s") for d in docs], "doc_id long, text string, tid long, spans string"), span=40, gram=8, hot=hot, bits=bits)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute.remove_repeats(docs, 40), key=str)
    assert suffix_dedup.remove_repeats(frame(spark, [])).collect() == []


def test_suffix_dedup_of_a_hot_anchor(spark):
    """Many texts share a passage and differ beside it in ways that make some of them repeats there too; the passage's anchors are split to single places."""
    r = random.Random(17)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    passage, heads, tails = word(50), [word(30) for _ in range(4)], [word(30) for _ in range(4)]
    docs = [(i, word(r.randrange(25)) + r.choice(heads)[r.randrange(25) :] + passage + r.choice(tails)[: r.randrange(25)] + word(r.randrange(25))) for i in range(150)]
    docs += [(200 + i, word(60)) for i in range(20)]
    want = sorted(brute.remove_repeats(docs, 40), key=str)
    for hot in (1, 4, 20, 60):
        assert sorted(map(tuple, suffix_dedup.remove_repeats(frame(spark, docs), span=40, gram=8, hot=hot).collect()), key=str) == want


def test_suffix_ranges():
    for low, high in ((0, 336), (5, 5), (3, 9), (0, 7)):
        parts = suffix_dedup.ranges(low, high, 8)
        assert [x for a, b in parts for x in range(a, b + 1)] == list(range(low, high + 1)) and len(parts) <= 8 and max(b - a for a, b in parts) + 1 <= -(-(high - low + 1) // 8) + 0


# ---- 3


def text_hash(t):
    import xxhash

    h = xxhash.xxh64_intdigest(t.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_fingerprints_of_one_id(spark):
    """An id that most rows have is dealt to several parts, and each row still has the next one."""
    r = random.Random(31)
    rows = [(7, words(r, r.randrange(1, 30))) for _ in range(300)] + [(i, words(r, 9)) for i in range(14)] + [(7, "same")] * 20
    got = fingerprint.fingerprints(frame(spark, rows)).collect()
    order = sorted(rows, key=lambda x: (x[0], text_hash(x[1]), x[1]))
    want = sorted((i, hashlib.sha256((t[: len(t) - len(t) // 4] + order[(k + 1) % len(order)][1][: len(t) // 4]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    assert sorted((x.doc_id, x.edited_sha256) for x in got) == want
    assert fingerprint._bounds([1, 7, 7, 7, 9]) == [(1, -(1 << 63)), (7, -(1 << 63)), (7, -(1 << 63) + (1 << 64) // 3), (7, -(1 << 63) + 2 * (1 << 64) // 3), (9, -(1 << 63))]


def test_fingerprints(spark, texts):
    docs = [(i * 7 - 100, t) for i, t in texts] + [(3, "tie b"), (3, "tie a"), (3, "tie a"), (None, "null id")]
    got = fingerprint.fingerprints(frame(spark, [(*d, "p") for d in docs], "doc_id long, text string, part string")).collect()
    order = sorted(((i is not None, i or 0, text_hash(t or ""), t or ""), (i, t or "")) for i, t in docs)
    order = [x for _, x in order]
    want = sorted((str(i), len(t), hashlib.sha256((t[: len(t) - len(t) // 4] + order[(k + 1) % len(order)][1][: len(t) // 4]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == want
    by = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by.setdefault(r.doc_id, r)
    same_text = [i for i, t in docs if t == "the " * 300]
    assert len({by[i].fingerprint for i in same_text}) == 1
    one = fingerprint.fingerprints(frame(spark, [(5, "alone " * 30)])).first()
    assert one.near_next == 1.0
    assert fingerprint.fingerprints(frame(spark, [])).collect() == []


def plain_sketch(text):
    """The same sketch shingle by shingle."""
    top = (1 << 64) - 1
    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & top
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & top
        return x ^ (x >> 31)
    raw, b = text.encode(), 0x9E3779B97F4A7C15
    parts = [raw[i : i + 16] for i in range(len(raw) - 15)]
    hashes = {mixed(sum((c + 1) * pow(b, k, 1 << 64) for k, c in enumerate(p)) & top) for p in parts}
    if 0 < len(raw) < 16:
        hashes = {mixed((sum((c + 1) * pow(b, k, 1 << 64) for k, c in enumerate(raw)) ^ (len(raw) << 48)) & top)}
    return {h & ((1 << 40) - 1) for h in hashes if h < (1 << 64) // fingerprint.FRACTION}


def test_fingerprint_likeness_against_plain(spark, texts):
    import base64

    docs = sorted({(i, t or "") for i, t in texts})
    got = {r.doc_id: r for r in fingerprint.fingerprints(frame(spark, docs)).collect()}
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r = got[i]
        for text, print_ in ((t, r.fingerprint), (edited, r.edited_fingerprint)):
            raw = base64.b64decode(print_.split(".")[1])
            assert [int.from_bytes(raw[j : j + 5], "big") for j in range(0, len(raw), 5)] == sorted(plain_sketch(text))
        for x, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = plain_sketch(t), plain_sketch(x)
            assert near == pytest.approx(1 if t == x else len(a & b) / max(min(len(a), len(b)), 1))


def test_sketches_merge_and_contain():
    r = random.Random(1)
    a, b = (" ".join(f"v{r.randrange(10**9)}" for _ in range(n)) for n in (300, 9000))
    def sketch(t):
        return set(fingerprint.sketches(*kernels.buffers(pa.array([t])))[1].tolist())
    assert sketch(a) <= sketch(b + " " + a) and len(sketch(a) & sketch(b)) == 0
    assert 0.5 < len(sketch(b)) * fingerprint.FRACTION / len(b) < 1.5


# ---- 4


def full_search(c, text):
    """Best segmentation over the whole text at once, and its score."""
    chars = [pieces.SPACE, *("" if x == pieces.SPACE else pieces.SPACE if x == " " else x for x in text)]
    best = [(0.0, None, ())] + [None] * len(chars)
    for e in range(1, len(chars) + 1):
        for b in range(max(0, e - c.longest), e):
            s = "".join(chars[b:e]) if all(chars[b:e]) else ""
            if s in c.score and (best[e] is None or best[b][0] + c.score[s][0] > best[e][0]):
                best[e] = (best[b][0] + c.score[s][0], b, (c.score[s][1],))
        if (chars[e - 1] or "-") not in c.score or not chars[e - 1]:
            x = best[e - 1][0] + c.unknown
            if best[e] is None or x > best[e][0]:
                best[e] = (x, e - 1, tuple(c.byte[y] for y in (chars[e - 1] or pieces.SPACE).encode()))
    ids, e = [], len(chars)
    while e:
        ids = [*best[e][2], *ids]
        e = best[e][1]
    return ids


@pytest.fixture(scope="module")
def coder():
    return pieces.Coder(pieces.load())


def test_pieces(coder):
    r = random.Random(2)
    samples = ["a", " ", "  a  b ", "hello world", "line\nbreak\ttab", "▁mark ▁▁ x", "日本語 한국어 😀", "a\nb c\n\nd", "\n", "\n\n", "x \ny", "x\n y", "one two\nthree four five\n", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 4, "\0\x7f", "x" + "=" * 300 + "y", " " * 100, "nohaltinginthisverylongword" * 20]
    samples += ["".join(r.choice("etaoin shrdluéß\n▁") for _ in range(150)) for _ in range(30)]
    for t in samples:
        ids = np.frombuffer(coder.encode(t), np.int32).tolist()
        assert coder.decode(ids) == t
        assert ids == full_search(coder, t), t
    assert coder.encode("") == b"" and coder.decode([]) == ""


def test_pieces_window_is_bounded(coder):
    r = random.Random(4)
    long = "".join(r.choice("abcdefghijklmnop") for _ in range(20000))
    n = iter(coder.stream(long))
    first = [next(n) for _ in range(50)]
    assert first == list(coder.stream(long))[:50]
    assert list(coder.stream(pieces.SPACE + long)) == np.frombuffer(coder.encode(long), np.int32).tolist()


def marked(t):
    return [pieces.SPACE, *("" if x == pieces.SPACE else pieces.SPACE if x == " " else x for x in t)] if t else []


def test_pieces_side_by_side_or_one_by_one(coder, sf_dir):
    """The ids of texts encoded together are those of one search over each whole text."""
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column(0).to_pylist()][:120]
    texts += ["%%%", "%" * 200, "ab " * 300, " ", "", "▁▁", "x" * 65, "x" * 64, "= " * 80, "  two  spaces  \n \n", "\u00a0\u3000"]
    fresh = pieces.Coder(pieces.load())
    for _ in range(2):  # searched, then looked up
        ids, bounds = fresh.encode_all(texts)
        for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
            assert ids[a:b].tolist() == list(coder.stream(marked(t))), t[:80]


def test_pieces_tie(coder):
    """Of equal sums the longest last piece: scores are whole numbers, so ab + cd, a + bcd and abc + d tie exactly."""
    names = ["<unk>", "<s>", "</s>", *[f"<0x{i:02X}>" for i in range(256)], pieces.SPACE, "a", "b", "c", "d", "ab", "cd", "bcd", "abc"]
    scores = dict.fromkeys(names, 0.0) | {"a": -0.1, "b": -9, "c": -9, "d": -0.3, "ab": -0.1, "cd": -0.3, "bcd": -0.3, "abc": -0.1, pieces.SPACE: -0.7}
    own = pieces.Coder([(n, scores[n], 2 if n == "<unk>" else 3 if n in ("<s>", "</s>") else 6 if n.startswith("<0x") else 1) for n in names])
    want = [names.index(x) for x in (pieces.SPACE, "a", "bcd")]
    for t in ("abcd", "abcd" * 40):
        got = np.frombuffer(own.encode(t), np.int32).tolist()
        assert got == list(own.stream(pieces.SPACE + t)) == full_search(own, t) and got[-2:] == want[-2:] and own.decode(got) == t


def test_pieces_long_texts_and_equal_hashes(coder, monkeypatch):
    r = random.Random(3)
    long = " ".join("".join(r.choice("abcdefg  é") for _ in range(r.randrange(1, 12))) for _ in range(4000)) + " " * 40 + "x" * 300
    whole = coder.encode(long)
    monkeypatch.setattr(pieces, "PART", 1000)
    assert coder.encode(long) == whole and "".join(pieces._parts(long)) == long and max(map(len, pieces._parts(long))) < 1500
    # every stretch takes the ids of the first: the text is searched again
    own = pieces.Coder(pieces.load())
    monkeypatch.setattr(pieces, "_hashes", lambda prefix, begin, size: np.full(len(begin), 7, np.uint64))
    assert own.encode(long[:600]) == np.array(list(coder.stream(marked(long[:600]))), np.int32).tobytes()


def test_encode(spark, texts):
    got = {r.doc_id: r for r in pieces.encode(frame(spark, [(*t, 1) for t in texts], "doc_id long, text string, ids int")).collect()}
    assert all(r.round_trip for r in got.values()) and len(got) == len(texts)
    for i, t in texts:
        assert (got[i].ids is None) == (t is None) and got[i].n_ids == len(got[i].ids or ())
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(frame(spark, texts))).collect()}
    assert back == dict(texts)
    assert pieces.encode(frame(spark, [])).collect() == []


# ---- 5


def plain_pii(t):
    out = [("email", m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", m.span()))
    out += [("phone", m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_pii_base_against_patterns():
    r = random.Random(6)
    samples = ["", "a@b.c", "é x.y@z-1.co.uk, a@b@c.d.e a@b@c.d", "1.2.3.4.5.6.7.8", "256.1.1.1 1.256.1.1 01.002.03.255", "4111 1111 1111 1111", "4111-1111--1111", "+1 (555) 123-4567.", "++1+22 333 4444 55", "12:34", "٣٤@x.y", "5105105105105100 4111111111111111",
               "1" * 50 + ".1.1.1", "@" * 50, "a" * 999 + "@b", "1 " * 200, "+" + "1" * 30, "+1.2.3.4"]
    samples += ["".join(r.choice("a@.1+-() 47é_%\n") for _ in range(60)) for _ in range(3000)]
    samples += ["".join(r.choice("0123456789 -.+") for _ in range(60)) for _ in range(2000)]
    for t in samples:
        f = pii.find(t)
        assert [(k, s) for k in pii.KINDS for s in f[k]] == plain_pii(t), t


def test_pii_added_kinds_and_redaction():
    t = "IBAN: DE89 3704 0044 0532 0130 00 ok, Account number: AB-12345-X. see https://bob:pw@host.example/x, mail bob@host.example or http://plain.example/"
    f = pii.find(t)
    assert [t[a:b] for a, b in f["account"]] == ["DE89 3704 0044 0532 0130 00", "AB-12345-X"] and [t[a:b] for a, b in f["login"]] == ["https://bob:pw@host.example/x"]
    clean = pii.redact(t, f)
    assert "bob" not in clean and "3704" not in clean and "http://plain.example/" in clean and clean.startswith("IBAN: <ACCOUNT> ok, Account number: <ACCOUNT>. see <LOGIN>")
    assert pii.find("my account number is secret and ssn too")["account"] == []
    t = "Pay to DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432; not DE89 3704 0044 0532 0130 01, xDE89370400440532013000 or NL91ABNA0417164300X. KontoNummer: 7788-X İ ACCOUNT Number 99-1234-5"
    assert [t[a:b] for a, b in pii.find(t)["account"]] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "7788-X", "99-1234-5"]


def test_pii_rows(spark, texts):
    rows = [*texts, (900, "mail a@b.cc é 10.0.0.1"), (900, "mail a@b.cc é 10.0.0.1")]
    got = pii.find_pii(frame(spark, [(*t, "s") for t in rows], "doc_id long, text string, spans string")).collect()
    assert len(got) == len(rows)
    mail = [r for r in got if r.doc_id == 900]
    assert len(mail) == 2 and mail[0] == mail[1] and mail[0].n_email == 1 and mail[0].spans == "email:5:11,ip:14:22" and mail[0].base_sha256 == hashlib.sha256(b"email:5:11,ip:14:22").hexdigest()
    assert pii.find_pii(frame(spark, [])).collect() == []
    kept = pii.redact_pii(frame(spark, [(1, None, "en"), (2, "x a@b.cc", None)], "doc_id long, text string, lang string"))
    assert sorted(map(tuple, kept.collect())) == [(1, None, "en"), (2, "x <EMAIL>", None)]


# ---- 6


def spoken(r, lang):
    return " ".join("".join(r.choice({"xx": "abcde", "yy": "fghij", "zz": "éüßñ"}[lang]) for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(5, 60)))


def test_language(spark):
    r = random.Random(8)
    rows = [(i, spoken(r, lang), lang, f"s{i}", 1) for i, lang in enumerate(r.choice(["xx", "xx", "yy", "zz"]) for _ in range(300))]
    rows += [(900, None, "xx", "s", 0), (901, "", "xx", "s", 0), (902, "123 ... ###", "yy", "s", 0), (903, spoken(r, "yy"), None, "s", 0), (904, "a", "xx", "s", 0), (905, "é", "zz", "s", 0), (906, "日本", None, "s", 0), (None, spoken(r, "xx"), "xx", "s", 0)]
    docs = frame(spark, rows, SCHEMA)
    filters = langid.fit(docs)
    assert filters.langs == ["xx", "yy", "zz"]
    got = {x.doc_id: x for x in langid.identify(docs, filters).collect()}
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got.values())
    held = [x for x in rows[:300] if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert sum(got[x[0]].lang_pred == x[2] for x in held) >= 0.98 * len(held) > 0
    assert [got[i].lang_pred for i in (900, 901, 902, 903, 906)][:4] == ["und", "und", "und", "yy"] and got[906].lang_pred != "und"
    assert langid.keep_identified(docs, filters, 0.35).count() >= 300
    assert {x.lang_pred for x in langid.identify(docs, None).collect()} == {"und"}
    assert langid.fit(docs.limit(0)) is None


def test_language_keeps_what_it_cannot_judge(spark):
    r = random.Random(9)
    docs = frame(spark, [(i, spoken(r, lang), lang, "s", 1) for i, lang in enumerate(["xx", "yy", "zz"] * 60)], SCHEMA)
    filters = langid.fit(docs)
    text = " ".join(spoken(r, "xx") for _ in range(5))
    numbers = " ".join(str(r.randrange(10**15, 10**16)) for _ in range(len(text) // 4))
    foreign = " ".join("".join(r.choice("klmnopqrst") for _ in range(6)) for _ in range(60))
    rows = [(1, "A."), (2, "q"), (3, "é"), (4, "A.\nAll rights reserved."), (5, f"{text} {numbers}"), (6, foreign), (7, "12. 34!"), (8, ""), (9, None), (10, text)]
    kept = {x.doc_id for x in langid.keep_identified(frame(spark, rows), filters, 0.35).collect()}
    assert kept == {1, 2, 3, 4, 5, 10}
    score = {x.doc_id: x.score for x in langid.identify(frame(spark, rows), filters).collect()}
    assert abs(score[5] - score[10]) < 0.02


def plain_language(filters, text):
    """(language, score) n-gram by n-gram; filters as learnt."""
    m32 = (1 << 32) - 1
    raw = text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    n, hits = 0, [0] * len(filters.langs)
    for size in langid.SIZES:
        for i in range(len(raw) - size + 1):
            g = raw[i : i + size]
            if not any(97 <= c <= 122 or c >= 128 for c in g):
                continue
            n += 1
            h = size * 0x9E3779B1 & m32
            for c in g:
                h = (h ^ c) * 0x01000193 & m32
            h ^= h >> 15
            h = h * 0x2C1B3C6D & m32
            h ^= h >> 12
            a, b = h & (langid.SLOTS - 1), (h * 0x297A2D39 & m32) >> 12 & (langid.SLOTS - 1)
            for k in range(len(hits)):
                both = int(filters.masks[k // 64][a]) & int(filters.masks[k // 64][b])
                hits[k] += both >> k % filters.bits & 1
    if not any(map(str.isalpha, text)):
        return "und", 0.0
    shares = [min(max((x / max(n, 1) - p) / (1 - p), 0), 1) for x, p in zip(hits, filters.false.tolist(), strict=True)]
    best = max(shares)
    return filters.langs[shares.index(best)], best


def test_language_against_plain(spark):
    r = random.Random(10)
    rows = [(lang, spoken(r, lang)) for lang in ["xx", "yy", "zz"] * 40]
    filters = langid.learn(rows)
    # no false negative: what is frequent enough in a language is in its filter
    from collections import Counter

    count = {x: Counter() for x in filters.langs}
    for lang, t in rows:
        for line in t.split("\n"):
            raw = line.lower().encode()
            count[lang].update(raw[i : i + 4] for i in range(len(raw) - 3))
    often = [(x, g) for x, c in count.items() for g, n in c.items() if n >= 20 and not any(g in d for y, d in count.items() if y != x)]
    assert len(often) > 50
    for lang, g in often[:300]:
        h = langid._codes(np.frombuffer(g, np.uint8), 4)
        a, b = langid._slots(h)
        assert int(filters.masks[0][a[0]] & filters.masks[0][b[0]]) >> filters.langs.index(lang) & 1
    texts = ["", "a", "A1", "12 3", "É", "abc éü", "a" * 50, "日本 語", *[spoken(r, x) + " " + spoken(r, y) for x in filters.langs for y in filters.langs], None]
    got = {x.doc_id: x for x in langid.identify(frame(spark, list(enumerate(texts))), filters).collect()}
    for i, t in enumerate(texts):
        lang, score = plain_language(filters, t or "")
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score), t


def test_language_many(spark):
    langs = [f"l{i}" for i in range(70)]
    counts = [{n: np.unique(langid._codes(np.frombuffer(f"{x * 20}".encode(), np.uint8), n), return_counts=True) for n in langid.SIZES} for x in langs]
    f = langid.Filters(langs, counts, [60] * 70)
    data, offsets = kernels.buffers(pa.array([x * 9 for x in langs]))
    assert f.masks.shape[0] == 2 and (f.shares(data, offsets).argmax(1) == np.arange(70)).all()


# ---- 7


def test_warc(spark):
    schema = "id long, seq long, type string, url string, etag string, digest string, headers map<string,string>, near int"
    h = {"etag": "a", "date": "1", "server": "s"}
    u = "http://www.Ex.com:80/a/?b=2&utm_source=x&a=1#f"
    rows = [(1, 10, "response", u, "a", "d1", h, 0), (2, 20, "revisit", "https://ex.com/a?a=1&b=2", "a", "d1", {"date": "2", "set-cookie": "no", "etag": "a"}, 0), (3, 5, "revisit", u, "a", "d1", {}, 0),
            (4, 30, "revisit", u, "b", "d1", None, 0), (5, 25, "response", u, "b", "d2", None, 0), (6, 99999, "revisit", u, "b", None, None, 0), (7, None, "revisit", u, "a", None, None, 0), (8, 1, "revisit", None, "a", "d", None, 0),
            (9, 50, "revisit", u, None, None, None, 0), (10, 60, None, u, "x", "y", None, 0), (2, 20, "revisit", "https://ex.com/a?a=1&b=2", "a", "d1", {"date": "2", "set-cookie": "no", "etag": "a"}, 0)]
    for slice_ in (1 << 16, 7):
        got = [(r.id, r.state, r.ref_id, r.headers) for r in warc.resolve(frame(spark, rows, schema), slice_).orderBy("id").collect()]
        assert [(a, b, c) for a, b, c, _ in got] == [(1, "full", None), (2, "resolved", 1), (2, "resolved", 1), (3, "no_response", None), (4, "mismatch", None), (5, "full", None), (6, "resolved", 5), (7, "no_response", None), (8, "no_url", None), (9, "mismatch", None), (10, "full", None)]
        assert got[1][3] == {"server": "s", "date": "2", "etag": "a"}
    assert warc.resolve(frame(spark, [], schema)).collect() == []


def test_warc_validators(spark):
    """All pairs of a revisit's and a response's validators, against the rules written down one by one."""
    schema = "id long, seq long, type string, url string, etag string, digest string, headers map<string,string>"
    tags, digests, days = (None, "x", "W/x", "y"), (None, "d", "e"), (None, "mon", "tue")
    rows, want = [], {}
    for n, (e, d, m, f, g, o) in enumerate((e, d, m, f, g, o) for e in tags for d in digests for m in days for f in tags for g in digests for o in days):
        h = lambda day: None if day is None else {"last-modified": day}
        rows += [(2 * n, 1, "response", f"u{n}", e, d, h(m)), (2 * n + 1, 2, "revisit", f"u{n}", f, g, h(o))]
        checks = [d == g] if d and g else []
        if e and f:
            checks.append(e.removeprefix("W/") == f.removeprefix("W/"))
        elif m and o:
            checks.append(m == o)
        want[2 * n + 1] = "resolved" if checks and all(checks) else "mismatch"
    rows += [(10**6 + i, None if i % 2 else i, "response" if i % 3 else "revisit", None if i % 2 == 0 or i % 5 else "u0", "x", "d", None) for i in range(50)]
    got = {r.id: r.state for r in warc.resolve(frame(spark, rows, schema)).collect()}
    assert len(got) == len(rows) and {i: got[i] for i in want} == want
    assert {got[i] for i in got if i >= 10**6} == {"full", "no_url", "no_response"}


def test_warc_sql(spark, sf_dir):
    states = {r.state for r in warc.op7_warc_revisits(spark, sf_dir).select("state").distinct().collect()}
    assert states >= {"full", "resolved", "mismatch", "no_url"}
    same(warc.op7_warc_revisits(spark, sf_dir), warc.SQL, sf_dir)


# ---- 8


def test_network_gradients():
    r = np.random.default_rng(0)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = np.vstack([r.normal(size=(6, 2 * toxicity.EMBED)), np.zeros((1, 2 * toxicity.EMBED))])
    idx = r.integers(0, 6, (4, 5))
    idx[1, 3:] = idx[2, :] = 6
    goal = np.array([0, 1, 1, 0.0])
    toxicity_sigmoid = lambda z: 1 / (1 + np.exp(-z))
    def loss():
        p = toxicity_sigmoid(net.forward(x, idx))
        return -np.mean(goal * np.log(p) + (1 - goal) * np.log(1 - p))
    g = net.gradients(x, idx, goal)
    for k in ("xf", "ub", "bf", "wa", "va", "ba", "wo", "bo", "uf"):
        flat, at = net.p[k].reshape(-1), r.integers(0, net.p[k].size)
        old = flat[at]
        flat[at] = old + 1e-3
        a = loss()
        flat[at] = old - 1e-3
        b = loss()
        flat[at] = old
        assert g[k].reshape(-1)[at] == pytest.approx((a - b) / 2e-3, abs=2e-4), k


def test_windows_cover_all_words():
    t = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 31, 32, 33, 48, 49, 100)]
    data, offsets = kernels.buffers(pa.array(t))
    w = toxicity.Words(data, offsets)
    idx, text = w.windows()
    for k in range(len(t)):
        seen = {x for x in idx[text == k].reshape(-1).tolist() if x < len(w.bucket)}
        assert seen == set(w.sequence[w.first[k] : w.first[k + 1]].tolist()) and (text == k).any()


def test_toxicity(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        t, bad = words(r, r.randrange(5, 150), 200).split(), i % 3 == 0
        if bad:
            t[r.randrange(len(t))] = r.choice(["vile", "Rotten"])
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(bad)))
    rows += [(900, None), (901, ""), (902, "..."), (None, "w1 w2"), (5, rows[5][1])]
    labels += [(901, 1, None), (999, 0, 1), (5, 0, 0)]
    docs, labels = frame(spark, rows), frame(spark, labels, "doc_id long, quality int, toxic int")
    net = toxicity.fit(docs, labels, 150)
    got = toxicity.score(docs, net).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    by = {x.doc_id: x.score for x in got}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((by[i] >= 0.5) == (i % 3 == 0) for i in held) >= 0.9 * len(held)
    assert by[900] == by[901] < 0.5
    assert toxicity.fit(docs, labels.limit(0)) is None and {x.score for x in toxicity.score(docs, None).collect()} == {0.0}


def plain_logit(net, text):
    """The network word by word and window by window."""
    top = (1 << 64) - 1
    raw = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    words_ = re.findall(rb"[0-9a-z\x80-\xff]+", raw)

    def bucket(w):
        x = sum((c + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(w)) & top ^ (len(w) << 48)
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & top
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & top
        return (x ^ (x >> 31)) % toxicity.WORDS

    def grams(w):
        w = b"\1" + w + b"\1"
        for n in toxicity.SIZES:
            for i in range(len(w) - n + 1):
                h = n
                for c in w[i : i + n]:
                    h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
                h ^= h >> 15
                yield (h * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - toxicity.GRAM_BITS)

    p, size = {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))
    inputs = [np.concatenate([p["ew"][bucket(w)], np.max([p["ec"][g] for g in grams(w)], axis=0)]) for w in words_]
    best = -np.inf
    for a in range(0, max(1, len(inputs) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP):
        window = inputs[a : a + toxicity.WINDOW]
        states = []
        for d in "fb":
            h, own = np.zeros(size), []
            for x in window if d == "f" else window[::-1]:
                g = x @ p[f"x{d}"] + p[f"b{d}"]
                zr = sig(g[: 2 * size] + h @ p[f"u{d}"][:, : 2 * size])
                z, r = zr[:size], zr[size:]
                h = h + z * (np.tanh(g[2 * size :] + (r * h) @ p[f"u{d}"][:, 2 * size :]) - h)
                own.append(h)
            states.append(own if d == "f" else own[::-1])
        s = np.array([np.concatenate(x) for x in zip(*states, strict=True)]).reshape(-1, 2 * size)
        e = np.tanh(s @ p["wa"] + p["ba"]) @ p["va"]
        w = np.exp(e - e.max()) if len(e) else e
        pooled = (w / w.sum()) @ s if len(e) else np.zeros(2 * size)
        best = max(best, pooled @ p["wo"] + p["bo"][0])
    return best


def test_toxicity_against_plain(spark):
    r = random.Random(14)
    net = toxicity.Network(3)
    net.p["ew"] *= 20
    net.p["ec"] *= 20
    net.shift, net.scale = 0.1, 2.0
    texts = ["", None, "one", "A b-c É", "... !", *[words(r, n, 90).title() for n in (5, 31, 32, 33, 47, 48, 49, 100, 300)]]
    got = {x.doc_id: x.score for x in toxicity.score(frame(spark, list(enumerate(texts))), net).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(plain_logit(net, t) - 0.1) * 2)), abs=1e-4), t
    assert toxicity.score(frame(spark, []), net).collect() == []


def test_toxicity_learns_from_one_row_an_id(spark):
    rows = [(1, "w " * 5)] * 40 + [(i, f"t{i} " * 6) for i in range(2, 60)] + [(None, "x")] * 30
    labels = [(i, i % 2) for i in range(1, 60)] * 3 + [(None, 1)] * 9
    docs, labels = frame(spark, rows), frame(spark, labels, "doc_id long, toxic int")
    known = labels.select(F.col("doc_id").alias("id"), "toxic").distinct()
    from llm.common import sample_of_each

    picked = sample_of_each(docs.select(F.col("doc_id").alias("id"), "text").join(known, "id"), "toxic", 10).collect()
    assert len(picked) == len({x.id for x in picked}) == 20 and {x.toxic for x in picked} == {0, 1}


# ---- 9

PAGE = """<!doctype html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="</p>";</script></head><body class="menu">
<nav><ul><li>Menu<li>More</ul></nav><header>Top</header><div class="ad box">Buy</div><div id="cookie-notice"><div>We</div>use</div>
%s<!-- hidden <p>no</p> --><aside>side</aside><form><input value="a>b">Send</form><div class='user-comments'><p>I think</p></div><footer>&copy; x</footer></body></html>"""


def main_text(page):
    return html_text.main_text(html_text.parse(page), set(), set(), set())


def test_html_blocks():
    main = "<article><h1>Head  &lt;1&gt;</h1><p>one <b>bold</b>er<br>two\n three<p>four&nbsp;&#233;<table><tr><td>a<td>b</table><div class=share>no</div><p class=uncommented>yes</article>"
    assert main_text(PAGE % main) == "Head <1> one bolder two three four é a b yes"
    assert main_text(PAGE % "<div class=content><p>body text</div>") == "body text"
    for bad in ("", "<", "<p", "<!--", "a < b", "</p></p>", "<p>x</div></p>y", "<script>x", "<nav>only", "<p title='a>b'>z", "&bogus; &#x110000;", "<article>cut &am"):
        main_text(bad)
    assert main_text("<p title='a>b'>z") == "z"
    assert main_text("<b>" * 5000 + "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after") == "deep after"
    long = " ".join(f"word{i}" for i in range(200_000))
    assert main_text(f"<nav>{long}</nav><p>{long}") == long


def test_html_skip_ends_where_html_closes():
    for page, want in (
        ("<body><p>one<p class=share>Share<p>two<p>three</body>", "one two three"),
        ("<article><h1>T</h1><p class=related-work>Related work matters</p><p class=related-posts>More</p><h2 class=header>H</h2><p>x</p></article>", "T Related work matters H x"),
        ("<article><p>a<p class=notice>We moved<p>Main text</p></article>", "a Main text"),
        ("<article><p class=notice>We <b>moved<div>Main</div><p>text</article>", "Main text"),
        ("<article><p>a<div class=ad>Buy<p>now</article><p>b", "a"),
        ("<div class=page><div class=ad>Buy<table><tr><td>x</div>y</table></div>Main</div>", "Main"),
        ("<div><div class=ad>Buy<p>now</p></div>Main</div>", "Main"),
        ("<section><div class=ad>Buy</section><p>Main", "Main"),
        ("<p>a <span class=ad>Buy<p>Main", "a Main"),
        ("<div><span class=ad>Buy <span>now</span> or</span> Main</div>", "Main"),
        ("<ul><li>a<li class=ad>Buy<ul><li>x<li>y</ul>z<li>b</ul>c", "a b c"),
        ("<dl><dt>a<dd class=ad>Buy<dt>b<dd>c</dl>", "a b c"),
        ("<table><tr><td>a<td class=ad>Buy<table><tr><td>x</table><td>b<tr class=ad><td>c<td>d<tr><td>e</table>", "a b e"),
        ("<head><meta charset=utf-8><title>t</title><body><p>Main", "Main"),
        ("<div><nav><b><div>x</b>y</div>z</nav>Main</div>", "Main"),
        ("<main><h2 class=promo>Buy<h2>Main</h2>text</main>", "Main text"),
    ):
        assert main_text(page) == want, page


def test_html_style_tree(spark):
    rows = [(i, f"http://h.example/{i}", f"<div class=x><p>same promise on every page</p></div><div class=y><p>text number {i}</p></div>") for i in range(8)]
    rows += [(20, "http://few.example/", "<div class=x><p>same promise on every page</p></div>"), (21, None, None), (22, "x", ""), (0, rows[0][1], rows[0][2]), (30, "https://u@H.example:1/z", PAGE % "<main>m</main>")]
    got = sorted(map(tuple, html_text.extract(frame(spark, [(*r, "p") for r in rows], "page_id long, url string, html string, host string")).collect()), key=str)
    want = {i: f"text number {i}" for i in range(8)} | {20: "same promise on every page", 21: "", 22: "", 30: "m"}
    assert len(got) == len(rows) and all(t == want[i] and n == len(t) for i, _, t, n in got)
    assert html_text.extract(frame(spark, [], "page_id long, url string, html string")).collect() == []


def plain_tree(pages):
    """The same importances by walking over all pages of a host; pages: (host, html)."""
    from collections import defaultdict
    from math import log

    texts, weight, above = defaultdict(list), defaultdict(float), {}
    for k, (host, html) in enumerate(pages):
        p = html_text.parse(html or "")
        own = defaultdict(set)
        for n, t in p.blocks:
            own[n].add(t)
        for n, contents in own.items():
            x = p.nodes[n]
            key = host, x.id
            texts[key].append((p.article() if x.main else k, contents))
            weight[key] = max(weight[key], p.weight(n))
            above[key] = [(p.nodes[a].id, p.nodes[a].main != x.main) for a in p.above(n)]
    importance, composite, shared = {}, defaultdict(float), {}
    for key, seen in texts.items():
        by_page = dict(seen)
        m, count = len(by_page), defaultdict(int)
        for c in {(page, c) for page, contents in seen for c in contents}:
            count[c[1]] += 1
        importance[key] = weight[key] * (1 if m < html_text.PAGES else max(0, 1 - sum(n * log(n) for n in count.values()) / (sum(count.values()) * log(m))))
        shared |= {(*key, c): 1 - n / m for c, n in count.items() if n >= html_text.PAGES}
        for a, other in [(key[1], False), *above[key]]:
            if other or m >= html_text.PAGES:
                composite[key[0], a] = max(composite[key[0], a], 1 if other else importance[key])
    return importance, dict(composite), shared


@pytest.mark.parametrize("seed", range(3))
def test_html_style_tree_against_plain(spark, seed):
    r = random.Random(seed)
    def part(k):
        return r.choice([f"<p>text {r.randrange(10**6)}</p>", "<p>same notice</p>", f"<div class=a{k}>{part(k - 1)}</div>" if k else "x", "<article>%s</article>" % (part(k - 1) if k else "<h1>t</h1>same"), f"<div id=n{k}>{r.choice('uvw')}</div>", "<nav>menu</nav>", "<h2>Again</h2>"])
    rows = [(i, f"http://{r.choice(['a', 'b', 'b', 'b'])}/{i}", "".join(part(3) for _ in range(r.randrange(1, 6)))) for i in range(80)]
    rows += [(100, "http://a/", None), (101, None, ""), (7, *rows[7][1:])]
    pages = html_text.with_host(frame(spark, rows, "page_id long, url string, html string"))
    tree, shared = html_text.style_tree(pages)
    got = {(x.host, x.node): x for x in tree.collect()}
    importance, composite, often = plain_tree([(h.host, h.html) for h in pages.collect()])
    assert {k: x.importance for k, x in got.items() if x.importance is not None} == pytest.approx(importance)
    assert {k: x.composite for k, x in got.items() if x.composite is not None} == pytest.approx(composite)
    assert {(x.host, x.node, x.content): x.importance for x in shared.collect()} == pytest.approx({(h, n, html_text._hash(c)): v for (h, n, c), v in often.items()})
    def low(host):
        own = {n for (h, n), x in importance.items() if h == host and x < html_text.LOW and got[h, n].pages >= html_text.PAGES}
        return own, {n for (h, n), x in composite.items() if h == host and x < html_text.LOW}, {(n, html_text._hash(c)) for (h, n, c), x in often.items() if h == host and x < html_text.LOW}
    texts = {x.page_id: x.text for x in html_text.extract(pages).collect()}
    plain = {x.page_id: html_text.main_text(html_text.parse(x.html or ""), *low(x.host)) for x in pages.collect()}
    assert texts == plain
    assert texts != {x.page_id: main_text(x.html or "") for x in pages.collect()}  # without the tree


def test_html_style_tree_of_articles(spark):
    page = "<body><div class=x>our promise</div>%s</body>"
    notice = "<div class=z><p>We moved, see the new address</p></div>"
    rows = [(i, f"http://h.example/{i}", page % f"<article><h1>Report</h1>{notice}<p>text number {i}</p></article>") for i in range(8)]
    # a repeated article is no notice, however often it stands
    rows += [(100 + i, f"http://copies.example/{i}", page % f"<article><h1>Report</h1>{notice}<p>one text</p></article>") for i in range(8)]
    rows += [(200 + i, f"http://short.example/{i}", page % f"<main><div>same</div>{'<nav>n</nav>' * i}{f'<p>{i}</p>' if i else ''}</main>") for i in range(8)]
    # the only plain page: the branch stands on the article pages as well
    rows += [(300, "http://h.example/plain", page % "<p>plain text</p>")]
    # text beside the articles, repeated, does not take the plain page below the same node along
    rows += [(400 + i, f"http://beside.example/{i}", f"<body>all rights<article><p>text {i}</p></article></body>") for i in range(8)] + [(408, "http://beside.example/8", "<body>all rights<p>plain</p></body>")]
    got = {i: t for i, _, t, _ in html_text.extract(frame(spark, rows, "page_id long, url string, html string")).collect()}
    want = {i: f"Report text number {i}" for i in range(8)} | {100 + i: "Report We moved, see the new address one text" for i in range(8)}
    want |= {200: "same"} | {200 + i: str(i) for i in range(1, 8)} | {300: "plain text"} | {400 + i: f"text {i}" for i in range(8)} | {408: "plain"}
    assert got == want


# ---- 10


@pytest.mark.parametrize("block", [2000, 3])
def test_jaccard(spark, texts, block):
    rows = [*texts, (texts[0][0], texts[0][1]), (500, texts[5][1])]
    got = jaccard.jaccard_components(frame(spark, [(*t, 1, "n") for t in rows], "doc_id long, text string, sid long, component string"), block=block)
    assert sorted(map(tuple, got.collect())) == sorted(brute.jaccard_components(rows))
    if block > 3:
        assert jaccard.jaccard_components(frame(spark, [])).collect() == []


def test_jaccard_of_large_groups(spark, monkeypatch):
    """Groups that hang together by what all share: many near copies of one text, some that only lie near copies of others, some that share a passage and nothing else."""
    r = random.Random(23)
    passage = words(r, 30, 10**6).split()
    base = words(r, 40, 10**6).split()
    def edit(t, n):
        t = list(t)
        for _ in range(n):
            t[r.randrange(len(t))] = f"e{r.randrange(10**6)}"
        return t
    rows = [(i, " ".join(edit(base, r.randrange(2)) + passage)) for i in range(40)]
    chain = base
    for i in range(100, 115):  # each is a near copy of the one before
        chain = edit(chain, 1)
        rows.append((i, " ".join(chain + passage)))
    for i in range(200, 260):
        rows.append((i, " ".join(words(r, r.randrange(3, 60), 10**6).split() + passage)))
    rows += [(300 + i, " ".join(edit(rows[-1 - i][1].split(), 1))) for i in range(30)]
    want = sorted(brute.jaccard_components(rows))
    assert len({c for _, _, c in want}) > 30
    got = jaccard.jaccard_components(frame(spark, rows), block=12, star=1)
    assert sorted(map(tuple, got.collect())) == want
    # by blocks alone: no group is cheaper by its shingles
    monkeypatch.setattr(jaccard, "_same", lambda by, toks, *more, same=jaccard._same: same(by, toks, *more).withColumn("n", F.col("n") + (10**6 if by == ["coarse", "all"] else 0)))
    again = []
    monkeypatch.setattr(jaccard, "_rest", lambda *args, rest=jaccard._rest: again.append(rest(*args)) or again[-1])
    got = jaccard.jaccard_components(frame(spark, rows), block=5, star=2)
    assert sorted(map(tuple, got.collect())) == want and again and again[0] is not None


def test_jaccard_small_sets_dont_tie_large_ones(spark, monkeypatch):
    """A chain of small sets that also share shingles with large ones: a large set isn't copied for each shingle of its prefix."""
    r = random.Random(3)
    passage = [" ".join(f"p{k}w{i}" for i in range(20)) for k in range(60)]
    rows = [(k, f"{passage[k]} {passage[(k + 1) % 60]}") for k in range(60)]
    for kind in range(4):
        base = [f"f{kind}w{i}" for i in range(500)]
        for copy in range(6):
            t = list(base)
            for i in r.sample(range(500), 6):
                t[i] = f"e{r.random()}"
            rows.append((100 + 10 * kind + copy, " ".join([*t, *passage[kind * 15 : kind * 15 + 2 * (copy == 0)]])))
    most = []
    meet = jaccard._meet
    monkeypatch.setattr(jaccard, "_meet", lambda docs, places, *args: most.append({r.rep_doc: len(r.places) for r in places.collect()}) or meet(docs, places, *args))
    got = jaccard.jaccard_components(frame(spark, rows), block=8)
    assert sorted(map(tuple, got.collect())) == sorted(brute.jaccard_components(rows))
    assert max(n for doc, n in most[0].items() if doc >= 100) <= 2


def test_jaccard_many_near_copies_are_copied_as_often_as_few(spark, monkeypatch):
    """Sets of a group of many blocks meet the first one, and texts that no place wants aren't shuffled to where sets meet."""
    r = random.Random(29)
    rows = [(i, " ".join(words(r, 30, 10**6).split())) for i in range(200, 260)]
    base = words(r, 80, 10**6).split()
    for i in range(60):
        t = list(base)
        t[r.randrange(80)] = f"e{i}"
        rows.append((i, " ".join(t)))
    found, read = [], []
    meet, wanted = jaccard._meet, jaccard._wanted
    monkeypatch.setattr(jaccard, "_meet", lambda docs, places, *args: found.append([len(r.places) for r in places.collect()]) or meet(docs, places, *args))
    monkeypatch.setattr(jaccard, "_wanted", lambda *args: read.append(wanted(*args)) or read[-1])
    monkeypatch.setattr("llm.common.BROADCAST_BYTES", 0)
    got = jaccard.jaccard_components(frame(spark, rows), block=5)
    assert sorted(map(tuple, got.collect())) == sorted(brute.jaccard_components(rows))
    assert sum(found[0]) <= 4 * len(found[0])
    assert 60 <= read[0].count() < 70


def test_jaccard_sets_with_equal_hashes(spark, texts):
    """With five bits for a set's hash nearly all sets share theirs with another."""
    got = jaccard.jaccard_components(frame(spark, texts), bits=5)
    assert sorted(map(tuple, got.collect())) == sorted(brute.jaccard_components(texts))


@pytest.mark.parametrize("block", [2000, 3])
def test_jaccard_links_are_all(spark, texts, block):
    sets = {}
    for i, t in sorted(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        s = frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else None
        if s and s not in sets.values():
            sets[i] = s
    want = {frozenset((i, j)) for i, s in sets.items() for j, t in sets.items() if i < j and 100 * len(s & t) >= 80 * len(s | t)}
    got = [frozenset((x.a, x.b)) for x in jaccard.jaccard_links(frame(spark, texts), block=block).collect()]
    spanned = {c for _, _, c in brute.jaccard_components(list(texts))}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > len(sets) - len(spanned)


def test_jaccard_sql(spark, sf_dir):
    same(jaccard.op10_ngram_jaccard(spark, sf_dir), jaccard.SQL, sf_dir)


def test_jaccard_threshold_is_exact():
    r = random.Random(11)
    for _ in range(300):
        base = r.sample(range(1000), r.randrange(5, 40))
        sets, sizes = [], []
        for _ in range(8):
            s = set(base) - set(r.sample(base, r.randrange(0, 1 + len(base) // 4))) | {r.randrange(2000, 9000) for _ in range(r.randrange(0, 4))}
            sets.append(np.array(sorted(s), np.uint64))
            sizes.append(len(s))
        want = components_of(8, [(i, j) for i in range(8) for j in range(i) if 100 * len(a := set(sets[i].tolist()) & set(sets[j].tolist())) >= 80 * (sizes[i] + sizes[j] - len(a))])
        got = jaccard.trie_links(sizes, sets)
        assert components_of(8, got) == want
        for i, j in got:
            a = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            assert 100 * a >= 80 * (sizes[i] + sizes[j] - a)


def test_jaccard_kept_tokens_suffice():
    n = np.arange(1, 3000)
    kept, shared = jaccard._kept(n)
    assert (kept <= n).all() and (kept >= shared).all()
    for a in (1, 2, 5, 9, 10, 11, 99, 100, 1001):
        for b in range(-(-4 * a // 5), 5 * a // 4 + 1):
            common = -(-4 * (a + b) // 9)
            m = min(max(a // 5, 1), max(b // 5, 1))
            assert shared[a - 1] <= m and shared[b - 1] <= m <= common
            assert kept[a - 1] >= min(a, a - common + m) and kept[b - 1] >= min(b, b - common + m)


def components_of(n, links):
    p = list(range(n))
    def find(i):
        while p[i] != i:
            i = p[i]
        return i
    for a, b in links:
        p[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(12)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(40)] + [(300, i) for i in range(301, 340)] + [(7, 7), (500, 500), (None, 3)]
    got = dict(map(tuple, components.components(frame(spark, edges, "a long, b long")).collect()))
    p = components_of(600, [e for e in edges if e[0] is not None])
    assert got == {v: p[v] for e in edges if e[0] is not None for v in e}
    assert components.components(frame(spark, [], "a long, b long")).collect() == []


def test_tables_can_be_swept(spark):
    import os

    from llm import common

    t = common.cut(spark.range(3), "some")
    assert t.count() == 3 and os.path.isdir(t.cut_path.removeprefix("file://"))
    common.sweep(spark)
    assert not os.path.isdir(t.cut_path.removeprefix("file://"))


# ---- texts longer than what is handled at once


def test_long_texts(spark):
    """Every operator over rows of which some are longer than a chunk, against what must come out."""
    r = random.Random(21)
    plain = " ".join(f"w{r.randrange(10**7)}" for _ in range(180_000))  # 1.5 MB
    assert len(plain) > kernels.CHUNK_BYTES
    item = "ten words of a test that nobody should ever have seen"
    near = plain[: len(plain) // 2] + "§some other words here§" + plain[len(plain) // 2 :]
    rows = [(1, plain), (2, near), (3, "short text"), (4, f"{plain[:2000]} {item} a.b@example.org {plain[3000:]}"), (5, None), (6, ""), (7, plain)]
    docs = frame(spark, [(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    hit = {x.doc: x for x in decontaminate.decontaminate(docs, frame(spark, [(9, item)], "item_id long, text string")).collect()}
    assert hit[4].n_hit == 11 and hit[1].n_words == 180_000 and not any(hit[i].n_hit for i in (1, 2, 3, 5, 6, 7))
    gone = {x.doc: x for x in suffix_dedup.remove_repeats(docs).collect()}
    assert gone[1].n_removed == len(plain) == gone[7].n_removed and gone[2].n_removed == len(plain) and gone[3].n_removed == 0 and gone[2].n_spans == 2
    prints = {x.doc_id: x for x in fingerprint.fingerprints(docs).collect()}
    assert prints[1].fingerprint == prints[7].fingerprint and prints[1].near_next > 0.99 and prints[1].n_chars == len(plain)
    ids = {x.doc_id: x for x in pieces.encode(docs).collect()}
    assert all(x.round_trip for x in ids.values()) and ids[1].ids_sha256 == ids[7].ids_sha256 and ids[1].n_ids > 180_000
    found = {x.doc_id: x for x in pii.find_pii(docs).collect()}
    assert found[4].n_email == 1 and found[1].n_email == 0
    filters = langid.learn([("en", plain[:50_000]), ("xx", "zq zq zqq " * 900)])
    assert {x.doc_id: x.lang_pred for x in langid.identify(docs, filters).collect()} == {1: "en", 2: "en", 3: langid.identify(docs.where("doc_id = 3"), filters).first().lang_pred, 4: "en", 5: "und", 6: "und", 7: "en"}
    net = toxicity.Network(2)
    score = {x.doc_id: x.score for x in toxicity.score(docs, net).collect()}
    assert score[1] == score[7] and score[5] == score[6]
    data, offsets = kernels.buffers(pa.array([plain]))
    assert score[1] == pytest.approx(float(net.scores(data, offsets)[0]), abs=1e-6)
    comp = {x.doc: x.component for x in jaccard.jaccard_components(docs).collect()}
    assert comp == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6, 7: 1}
    page = {x.page_id: x.n_chars for x in html_text.extract(frame(spark, [(1, "http://a/", f"<nav>x</nav><article><p>{plain}</article>")], "page_id long, url string, html string")).collect()}
    assert page == {1: len(plain)}


def test_tables_need_a_shared_folder():
    from types import SimpleNamespace as Bag

    from llm import common

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(Bag(conf=Bag(get=lambda k, d=None: d), sparkContext=Bag(master=master)))
    there = Bag(conf=Bag(get=lambda k, d=None: "hdfs:/shared"), sparkContext=Bag(master="yarn"))
    assert common.shared_dir(there) == "hdfs:/shared"


def test_names_that_no_column_has(spark):
    from llm import common

    d = spark.range(1).selectExpr("id as gone", "id as GONE_0", "id as other")
    assert common.fresh(d, "gone") == "gone_1" and common.fresh(d, "new") == "new"


def test_sample_is_bounded_and_the_same_each_time(spark):
    from llm.common import sample_of_each

    d = spark.range(20000).selectExpr("id", "cast(id % 3 as string) as kind", "concat('t', id) as text")
    d = d.unionByName(d.where("id = 5").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("n"))
    d = d.unionByName(frame(spark, [(None, "0", "x"), (50000, None, "x"), (50001, "0", None), (50002, "rare", "x")], "id long, kind string, text string"))
    one, two = ({(x.id, x.kind, x.text) for x in sample_of_each(d.repartition(n), "kind", 100).collect()} for n in (1, 7))
    assert one == two and len(one) == 301 and (50002, "rare", "x") in one and all(sum(k == kind for _, k, _ in one) == 100 for kind in "012")
