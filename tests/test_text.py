from collections import Counter
import random
import re

from pyspark.sql import functions as F

from parchment import catalogue
from parchment.functions import geometry, grid
from parchment.functions import text as tx
from parchment.plans import summary


def one(spark, c, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(c).first()[0]


def plain_summary(text, k):
    clean = text.strip()
    if not clean:
        return summary.NOTHING
    sents = [s.strip() for s in re.split(r"(?<=[.!?。])\s+|\n+", clean.replace("\r", ""))]
    sents = [s for s in sents if len(s) > 1]
    if len(sents) <= k:
        return clean
    words = lambda s: [w for w in re.split(r"[\W_]+", s.lower()) if len(w) >= 2 and w not in tx.STOPWORDS]
    n = Counter(w for s in sents for w in words(s))
    if not n:
        return " ".join(sents[:k])
    score = [sum(n[w] for w in words(s)) / len(words(s)) if words(s) else 0.0 for s in sents]
    best = sorted(sorted(range(len(sents)), key=lambda i: (-score[i], i))[:k])
    return "\n".join("• " + sents[i] for i in best)


def test_summary_against_plain(spark):
    texts = ["", "  \n ", "One. Two.", "문장 하나입니다. 둘째 문장은 길다。 셋째 문장!\r\n넷째 문장? 다섯째 문장은 길다. 여섯째. 일곱째 문장은 길다.",
             "a. b. c. d. e. f. g. h.", "the of. to in. on for. is are. was were. be as. at by.", "x1 x1. x2. x1 x2. y. x2 x2 z. q. x1.\n\nx1 w.", "!! ?? .. -- ,, ;; :: ''\n1\n2\n33\n44\n55\n66"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for k in (1, 3, 5):
        got = {r.id: r.summary for r in summary.summarize(df, "id", "text", k).collect()}
        assert got == {i: plain_summary(t, k) for i, t in enumerate(texts)}


def test_decode(spark):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    rows = [("﻿abc".encode(),), ("한글".encode(),), ("한글".encode("euc-kr"),), (b"",)]
    got = [r[0] for r in spark.createDataFrame(rows, "c binary").select(tx.decode_bytes(F.col("c"))).collect()]
    assert got == ["abc", "한글", "한글", ""]


def test_formats(spark):
    rows = [("a.DOCX", None, "DOCX"), ("a.b", "image/webp", "IMAGE"), ("noext", "text/markdown", "TXT"), ("x", "application/msword", "UNKNOWN"), ("x", "application/vnd.google-apps.sheet", "GOOGLE"), (None, None, "UNKNOWN"), (".md", None, "MARKDOWN")]
    d = spark.createDataFrame(rows, "n string, m string, f string")
    assert d.where(~tx.detect_format(F.col("n"), F.col("m")).eqNullSafe(F.col("f"))).count() == 0


def test_markup(spark):
    xml = '<w:p><w:instrText x="1">HIDE</w:instrText><w:t>a &lt;b&gt; &amp;lt;</w:t><w:tab/>c  </w:p><W:BR/>d<wp:posOffset>12345</wp:posOffset></w:p>\n\n\n\n<text:p>e</text:p>'
    assert one(spark, tx.markup_text(F.col("x")), x=xml) == "a <b> &lt;\tc\n\nd\n\ne"


def test_numbers(spark):
    for raw, want in (("1155000000.0000001", "1155000000"), ("0.30000000000000004", "0.3"), ("12", "12"), ("abc", "abc"), ("1.5", "1.5"), ("1e300", "1e300"), ("-2.5", "-2.5"), ("", ""), ("3.00005", "3.0001")):
        assert one(spark, grid.format_number(F.col("x")), x=raw) == want


def test_grids(spark):
    g = F.array(F.array(F.lit("a"), F.lit(" "), F.lit("")), F.array(F.lit(""), F.lit("")), F.array(F.lit("b"), F.lit(""), F.lit("c")))
    r = spark.range(1).select(grid.compact_grid(g).alias("c"), grid.pad_rows(g).alias("p"), grid.drop_empty_rows(g).alias("d"), grid.display_units(F.lit("한a")).alias("u")).first()
    assert r.c == [["a", ""], ["b", "c"]] and [len(x) for x in r.p] == [3, 3, 3] and len(r.d) == 2 and r.u == 3


def test_geometry(spark):
    n = F.lit(None).cast("int")
    assert one(spark, geometry.adjust_colour(F.lit(0x808080), F.lit(50000), n, n, n)) == 0x404040
    assert one(spark, geometry.adjust_colour(F.lit(0x000000), n, n, F.lit(25000), n)) == 0xBFBFBF
    assert one(spark, geometry.swap_red_blue(F.lit(0x010203))) == 0x030201
    assert one(spark, geometry.map_to_group(F.lit(-7), F.lit(100), F.lit(0), F.lit(1), F.lit(2))) == 97
    assert one(spark, geometry.resolve_path(F.lit("ppt/slides/"), F.lit("../a/../b.xml"))) == "ppt/b.xml"


def test_markdown_spans(spark):
    r = random.Random(6)
    lines = ["a **b** *c* `d` e*f", "**x", "", "****", "***a**", "* *", "**a*b`", *("".join(r.choice("ab*`") for _ in range(n % 25)) for n in range(400))]
    d = spark.createDataFrame(list(enumerate(lines)), "i int, x string").select("i", tx.markdown_spans(F.col("x")).alias("s"))
    got = {x.i: [tuple(y) for y in x.s] for x in d.collect()}
    assert got[0] == [("a ", "plain"), ("b", "bold"), (" ", "plain"), ("c", "italic"), (" ", "plain"), ("d", "code"), (" e*f", "plain")]
    assert got[1] == [("**x", "plain")] and got[2] == []
    assert all(got[i] == plain_spans(x) for i, x in enumerate(lines))


def plain_spans(line):
    """Spans place by place."""
    out, at = [], 0
    while at < len(line):
        for style, mark in (("bold", "**"), ("italic", "*"), ("code", "`")):
            if line[at : at + len(mark)] == mark:
                ends = [e for e in range(at + len(mark), len(line)) if line[e : e + len(mark)] == mark]
                if ends:
                    out.append((line[at + len(mark) : ends[0]], style))
                    at = ends[0] + len(mark)
                    break
                out.append((line[at], "plain"))
                at += 1
                break
        else:
            out.append((line[at], "plain"))
            at += 1
    joined = []
    for text, style in out:
        if style == "plain" and joined and joined[-1][1] == "plain":
            joined[-1] = (joined[-1][0] + text, style)
        else:
            joined.append((text, style))
    return joined


def test_markdown_spans_of_whole_texts(spark, tmp_path):
    r = random.Random(5)
    texts = ["", "\n\n", "one line", "**", "`a` *b", *("".join(r.choice("ab *`\n") for _ in range(n)) for n in (30, 60, 200, 900, 900)), "x" * 300 + " **late** and `code`\r\nlast *line*", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in enumerate(texts):
        mark, block = ("**", "*", "`")[i % 3], ("# ", "- ", "12. ", "### ", "")[i % 5]
        for k, x in enumerate((block + t.replace("\r", "")).split("\n") if t is not None else ()):
            h = len(x) // 2
            want += [(i, k, n, *s) for n, s in enumerate(plain_spans(mark + x[:h] + mark + x[h:] + "*"))]
    got = catalogue.QUERIES["markdown_spans"](spark, str(tmp_path)).select("doc_id", "line_pos", "pos", "text", "style").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_settings(monkeypatch):
    from parchment.operators.model import settings_of

    monkeypatch.setenv("PARCHMENT_MODEL_KEY_GROK", " k ")
    s = settings_of("GROK", model=" m ")
    assert s.ready and s.model == "m" and s.url == "https://api.x.ai/v1/chat/completions"
    assert settings_of("nonsense").base_url.startswith("https://api.openai.com") and not settings_of("GEMINI").ready
