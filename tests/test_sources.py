import io
import struct
import zipfile
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parchment.operators.model import complete
from parchment.sources import hangul, office, registry
from parchment.sources.markup import Broken, CompoundFile

PNG = b"\x89PNG\r\n\x1a\n" + bytes(20)
W = 'xmlns:w="w" xmlns:a="a" xmlns:r="r" xmlns:mc="mc" xmlns:p="p"'


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


DOCX = archive({
    "word/document.xml": f"""<w:document {W}><w:body>
<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>
<w:p><w:pPr><w:outlineLvl w:val="6"/></w:pPr><w:r><w:t>Deep</w:t></w:r></w:p>
<w:p><w:pPr><w:numPr/><w:jc w:val="center"/></w:pPr><w:hyperlink><w:r><w:rPr><w:b/><w:i w:val="0"/><w:sz w:val="24"/><w:color w:val="FF0000"/></w:rPr><w:t>item</w:t><w:tab/><w:br/></w:r></w:hyperlink></w:p>
<w:p><w:r><w:rPr><w:color w:val="000000"/><w:sz w:val="1"/></w:rPr><w:t>black</w:t></w:r><mc:Fallback><w:r><w:t>twice</w:t></w:r></mc:Fallback><a:blip r:embed="r1"/><a:blip r:embed="none"/></w:p>
<w:sdt><w:p><w:r><w:t>control</w:t></w:r></w:p></w:sdt>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc><w:tc/></w:tr><w:tr/></w:tbl>
</w:body></w:document>""",
    "word/_rels/document.xml.rels": '<Relationships><Relationship Id="r1" Target="media/image1.png"/></Relationships>',
    "word/media/image1.png": PNG, "word/media/image2.emf": b"no"})


def test_docx():
    c, media = office.docx(DOCX, "u")
    kinds = [(b["kind"], b["text"], b["level"]) for b in c["blocks"]]
    assert kinds[:2] == [("heading", "Title", 2), ("heading", "Deep", 4)] and [k for k, _, _ in kinds] == ["heading", "heading", "rich", "rich", "image", "table"]
    bullet, item = c["blocks"][2]["runs"]
    assert bullet["text"] == "•  " and bullet["bold"] and item["text"] == "item\t\n" and item["size_pt"] == 12 and item["color_rgb"] == 0xFF0000 and not item["italic"] and c["blocks"][2]["align"] == 3
    assert c["blocks"][3]["runs"][0]["color_rgb"] is None and c["blocks"][3]["runs"][0]["size_pt"] == 4
    assert c["blocks"][5]["rows"] == [["x\ny", ""]] and list(media) == ["word/media/image1.png"] and "control" not in c["plain_text"]


def sheet(rows):
    return f'<worksheet xmlns="s"><sheetData>{rows}</sheetData></worksheet>'


XLSX = archive({
    "xl/workbook.xml": '<workbook xmlns="s"><sheets><sheet name="First"/><sheet name="Second"/></sheets></workbook>',
    "xl/sharedStrings.xml": '<sst xmlns="s"><si><r><t>he</t></r><r><t>llo</t></r></si></sst>',
    "xl/worksheets/sheet10.xml": sheet('<row><c r="A1"><v>10</v></c></row>'),
    "xl/worksheets/sheet2.xml": sheet("".join(f'<row><c><v>{i}</v></c></row>' for i in range(401))),
    "xl/worksheets/sheet1.xml": sheet('<row><c r="B1" t="s"><v>0</v></c><c><v>0.30000000000000004</v></c><c r="E1" t="b"><v>1</v></c><c r="AO1"><v>far</v></c></row><row><c t="s"><v>9</v></c><c t="inlineStr"><is><t>in</t></is></c></row><row><c r="A3"><v> </v></c></row>')})


def test_xlsx():
    c, _ = office.xlsx(XLSX, "u")
    b = c["blocks"]
    assert [x["text"] for x in b if x["kind"] == "heading"] == ["시트: First", "시트: Second", "시트: Sheet10"]
    assert b[1]["rows"] == [["", "hello", "0.3", "", "TRUE"], ["9", "in"]]
    assert len(b[3]["rows"]) == 400 and b[4]["kind"] == "note"


def slide(shapes, bg=""):
    return f'<p:sld {W}><p:cSld>{bg}<p:spTree>{shapes}</p:spTree></p:cSld></p:sld>'


def box(text, frame="", extra="", ph=""):
    return f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr>{frame}{extra}</p:spPr><p:txBody><a:p><a:pPr lvl="1"><a:buChar/></a:pPr><a:r><a:rPr sz="1800" b="1"/><a:t>{text}</a:t></a:r><a:br/></a:p><a:p/></p:txBody></p:sp>'


FRAME = '<a:xfrm><a:off x="100" y="50"/><a:ext cx="500" cy="100"/></a:xfrm>'
PPTX = archive({
    "ppt/presentation.xml": f'<p:presentation {W}><p:sldSz cx="1000" cy="500"/></p:presentation>',
    "ppt/theme/theme1.xml": f'<a:theme {W}><a:clrScheme><a:dk1><a:sysClr lastClr="000000"/></a:dk1><a:lt1><a:srgbClr val="FFFFFF"/></a:lt1><a:accent1><a:srgbClr val="808080"/></a:accent1></a:clrScheme></a:theme>',
    "ppt/slides/slide2.xml": slide(box("two", FRAME)),
    "ppt/slides/slide10.xml": slide(box("ten")),
    "ppt/slides/slide1.xml": slide(
        box("title", ph='<p:ph type="title"/>') + box("body")
        + '<p:sp><p:spPr>' + FRAME + '<a:prstGeom prst="ellipse"/><a:solidFill><a:schemeClr val="accent1"><a:lumMod val="50000"/></a:schemeClr></a:solidFill><a:ln w="25400"><a:noFill/></a:ln></p:spPr></p:sp>'
        + '<p:grpSp><p:grpSpPr><a:xfrm><a:off x="100" y="100"/><a:ext cx="200" cy="200"/><a:chOff x="0" y="0"/><a:chExt cx="400" cy="400"/></a:xfrm></p:grpSpPr><p:pic><p:blipFill><a:blip r:embed="r2"/></p:blipFill><p:spPr>'
        + FRAME + '</p:spPr></p:pic></p:grpSp>'
        + '<p:graphicFrame><a:tbl><a:tr><a:tc><a:t>c1</a:t><a:t>c2</a:t></a:tc></a:tr></a:tbl></p:graphicFrame>'),
    "ppt/slides/_rels/slide1.xml.rels": '<Relationships><Relationship Id="r1" Target="../slideLayouts/slideLayout1.xml"/><Relationship Id="r2" Target="../media/i.png"/></Relationships>',
    "ppt/slideLayouts/slideLayout1.xml": f'<p:sldLayout {W}/>',
    "ppt/slideLayouts/_rels/slideLayout1.xml.rels": '<Relationships><Relationship Id="r1" Target="../slideMasters/slideMaster1.xml"/></Relationships>',
    "ppt/slideMasters/slideMaster1.xml": f'<p:sldMaster {W}><p:bg><p:bgPr><a:solidFill><a:srgbClr val="112233"/></a:solidFill></p:bgPr></p:bg></p:sldMaster>',
    "ppt/notesSlides/notesSlide2.xml": f'<p:notes {W}><a:t>say</a:t><a:t>this</a:t></p:notes>',
    "ppt/media/i.png": PNG})


def test_pptx():
    c, media = office.pptx(PPTX, "u")
    s = c["slide_deck"]["slides"]
    assert [x["number"] for x in s] == [1, 2, 10] and s[1]["note"] == "say this" and s[0]["background_rgb"] == 0x112233 and s[1]["background_rgb"] == 0xFFFFFF
    e = s[0]["elements"]
    assert [x["kind"] for x in e] == ["text", "text", "shape", "picture", "table"]
    assert (e[0]["x"], e[0]["h"]) == (0.05, 0.14) and e[1]["y"] == pytest.approx(0.2) and e[2]["fill_rgb"] == 0x404040 and e[2]["shape"] == "ELLIPSE" and e[2]["stroke_rgb"] is None
    assert (e[3]["x"], e[3]["y"], e[3]["w"], e[3]["h"]) == (0.15, 0.25, 0.25, 0.1) and e[4]["rows"] == [["c1 c2"]]
    assert s[1]["elements"][0]["x"] == 0.1 and s[1]["elements"][0]["paragraphs"][0]["bullet"] and "[발표자 노트] say this" in c["plain_text"] and list(media) == ["ppt/media/i.png"]


def compound(streams):
    """A small compound file; all streams in full sectors of 512 bytes."""
    storages = sorted({p[0] for p in streams if len(p) == 2})
    entries = [("Root Entry", 5, None, b"")]
    tops = [p for p in streams if len(p) == 1]
    order = [(p[0], 2, None, streams[p]) for p in tops] + [(s, 1, None, b"") for s in storages] + [(p[1], 2, p[0], streams[p]) for p in streams if len(p) == 2]
    entries += order
    none = 0xFFFFFFFF
    sib = [[none, none, none] for _ in entries]
    def chain(ids):
        for a, b in zip(ids, ids[1:]):
            sib[a][1] = b
        return ids[0] if ids else none
    sib[0][2] = chain([i for i, e in enumerate(entries) if i and e[2] is None])
    for s in storages:
        i = next(k for k, e in enumerate(entries) if e[0] == s and e[1] == 1)
        sib[i][2] = chain([k for k, e in enumerate(entries) if e[2] == s])
    n_dir = -(-len(entries) // 4)
    fat, body, at = [], [], 1 + n_dir
    starts = []
    for e in entries:
        n = -(-len(e[3]) // 512)
        starts.append(at if n else 0xFFFFFFFE)
        body.append(e[3].ljust(n * 512, b"\0"))
        fat += [at + i + 1 for i in range(n - 1)] + [0xFFFFFFFE] * (n > 0)
        at += n
    table = [0xFFFFFFFD] + [i + 2 for i in range(n_dir - 1)] + [0xFFFFFFFE] + fat
    assert len(table) <= 128
    directory = b""
    for (name, kind, _, data), (left, right, below), start in zip(entries, sib, starts):
        raw = name.encode("utf-16-le") + b"\0\0"
        directory += raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<III", left, right, below) + bytes(36) + struct.pack("<IQ", start, len(data))
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<IIIIIIII", 1, 1, 0, 0, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", 0, *[none] * 108)
    return head + struct.pack("<128I", *table, *[none] * (128 - len(table))) + directory.ljust(n_dir * 512, b"\0") + b"".join(body)


def record(tag, level, payload):
    return struct.pack("<I", tag | level << 10 | (min(len(payload), 0xFFF) << 20)) + (struct.pack("<I", len(payload)) if len(payload) >= 0xFFF else b"") + payload


def text(s):
    return s.encode("utf-16-le")


def hwp_file(flags=1):
    shape = lambda size, attr, bgr: bytes(42) + struct.pack("<ii", size, attr) + bytes(2) + bgr + bytes(8)
    info = record(21, 0, shape(1000, 2, b"\0\0\0\0")) + record(21, 0, shape(2000, 1, b"\0\0\0\xff")[:55] + b"\xff") + record(25, 0, struct.pack("<I", 3 << 2) + bytes(8) + struct.pack("<i", 400))
    info += record(18, 0, struct.pack("<HH", 1, 3) + text("png") + struct.pack("<H", 1))
    para = record(66, 0, bytes(8) + struct.pack("<H", 0))
    body = para + record(67, 1, struct.pack("<8H", 2, *[0] * 7) + text("ab한\r")) + record(68, 1, struct.pack("<iiii", 0, 0, 9, 1))
    body += record(71, 1, b"daeh") + record(67, 2, text("header text")) + record(66, 0, bytes(10))
    body += record(71, 1, b" lbt") + record(77, 2, struct.pack("<IHH", 0, 2, 2))
    for col, row, t in ((0, 0, "c00"), (1, 1, "c11"), (9, 9, "seq")):
        body += record(72, 2, bytes(8) + struct.pack("<HH", col, row)) + record(67, 3, text(t))
    body += record(66, 0, bytes(10)) + record(67, 1, text("after")) + record(85, 1, struct.pack("<i", 21000) + bytes(64) + struct.pack("<H", 1) + bytes(2))
    def pack(b):
        c = zlib.compressobj(9, zlib.DEFLATED, -15)
        return c.compress(b) + c.flush()

    f = pack if flags & 1 else bytes
    head = b"HWP Document File".ljust(36, b"\0") + struct.pack("<I", flags) + bytes(216)
    return compound({("FileHeader",): head, ("DocInfo",): f(info), ("BodyText", "Section0"): f(body), ("BinData", "BIN0001.png"): f(PNG)})


@pytest.mark.parametrize("flags", [0, 1])
def test_hwp(flags):
    c, media = hangul.hwp(hwp_file(flags), "u")
    assert "warning" not in c, c
    kinds = [b["kind"] for b in c["blocks"]]
    assert kinds == ["rich", "table", "rich", "image"]
    runs = c["blocks"][0]["runs"]
    assert [r["text"] for r in runs] == ["a", "b한"] and runs[0]["bold"] and runs[0]["size_pt"] == 10 and runs[1]["italic"] and runs[1]["size_pt"] == 20
    assert c["blocks"][0]["align"] == 3 and c["blocks"][0]["spacing"] == 2.0
    assert c["blocks"][1]["rows"] == [["c00", "seq"], ["", "c11"]] or c["blocks"][1]["rows"] == [["c00", ""], ["seq", "c11"]]
    assert "header" not in c["plain_text"] and c["blocks"][3]["path"] == "bin0001.png" and c["blocks"][3]["width_fraction"] == 0.5 and list(media) == ["bin0001.png"]


def test_hwp_warnings():
    assert hangul.hwp(hwp_file(2), "u")[0]["warning"] == hangul.ENCRYPTED and hangul.hwp(hwp_file(4), "u")[0]["warning"] == hangul.PROTECTED
    assert hangul.hwp(b"junk", "u")[0]["warning"].startswith("HWP 파싱 실패")
    with pytest.raises(Broken):
        CompoundFile(b"\xd0\xcf" * 400)
    for cut in range(0, 6000, 500):
        hangul.hwp(hwp_file(0)[:cut], "u")


def raw(spark, rows):
    return spark.createDataFrame([(f"file:/d/{n}", n, m, None, c) for n, m, c in rows], "uri string, name string, mime string, modified_at timestamp, content binary")


def test_parse_never_fails(spark):
    odt = archive({"content.xml": "<o><text:p>one</text:p><text:p>two<text:tab/>x</text:p></o>"})
    hwpx = archive({f"Contents/section{i}.xml": f"<hp:p>s{i}</hp:p>" for i in (10, 2, 0)})
    rows = [("a.docx", None, DOCX), ("a.xlsx", None, XLSX), ("a.pptx", None, PPTX), ("a.odt", None, odt), ("a.hwpx", None, hwpx), ("a.hwp", None, hwp_file()),
            ("bom.txt", None, "﻿hi".encode()), ("kr.log", None, "한글".encode("euc-kr")), ("m.md", None, b"# x"), ("old.doc", None, b"x"), ("x.zip", None, b"x"), ("e.docx", None, b""),
            ("b.xlsx", None, DOCX), ("bad.docx", None, archive({"word/document.xml": "<a>"})), ("p.pdf", None, b"%PDF"), ("i.png", None, PNG), ("g", "application/vnd.google-apps.document", None), ("n.txt", None, None)]
    got = {r.uri.rpartition("/")[2]: r for r in registry.parse(raw(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert got["a.odt"].plain_text == "one\ntwo\tx" and got["a.hwpx"].plain_text == "s0\n\ns2\n\ns10" and got["bom.txt"].plain_text == "hi" and got["kr.log"].plain_text == "한글" and got["m.md"].is_markdown
    for n in ("old.doc", "x.zip", "e.docx", "b.xlsx", "bad.docx", "p.pdf", "i.png", "g"):
        assert got[n].warning and not got[n].plain_text, n
    assert got["p.pdf"].renderable_uri and got["a.docx"].warning is None and got["n.txt"].plain_text == ""
    content = registry.parse(raw(spark, rows))
    assert registry.explode_cells(content).where("value = 'hello'").select("row", "col").collect() == [(0, 1)]
    assert [r.number for r in registry.explode_slides(content).orderBy("number").collect()] == [1, 2, 10]
    assert registry.explode_elements(content).where("number = 1").orderBy("z", "pos").first().kind == "shape"
    assert sorted(r.media_name for r in registry.media(raw(spark, rows)).collect()) == ["bin0001.png", "ppt/media/i.png", "word/media/image1.png"]
    assert registry.entries(raw(spark, rows), r"word/.*\.xml").where("uri like '%a.docx'").count() == 1


def test_providers(spark):
    p = {"pdf": lambda c: (c.decode(), 3), "ocr": lambda c: [["a", "b"], ["c"]], "export": lambda uri: b"exported"}
    got = {r.uri[-1]: r for r in registry.parse(raw(spark, [("p.pdf#f", "application/pdf", b"text"), ("i.x#g", "image/png", PNG), ("g#h", "application/vnd.google-apps.document", None)]), p).collect()}
    assert (got["f"].plain_text, got["f"].page_count) == ("text", 3) and got["g"].plain_text == "a\nb\n\nc" and got["h"].plain_text == "exported"


def test_model_calls(spark):
    def transport(request):
        import json

        r = json.loads(request)
        user = r["messages"][1]["content"]
        if user == "boom":
            raise TimeoutError("slow")
        if user == "no":
            return 500, "x" * 400
        return 200, json.dumps({"choices": [{"message": {"content": f" {r['model']} {user} "}}]})

    d = spark.createDataFrame([(1, "s", "hi"), (2, "s", "no"), (3, "s", "boom")], "k long, system string, user string")
    got = {r.k: r for r in complete(d, "k", "m", transport).collect()}
    assert got[1].answer == "m hi" and got[1].error is None and got[2].error == "오류: LLM 요청 실패 (500): " + "x" * 300 and got[3].error == "오류: slow"


def test_catalog(spark):
    from parchment.operators import catalog

    c = spark.createDataFrame([("a", 1), ("b", 1)], "uri string, v int")
    assert sorted(map(tuple, catalog.upsert(c, spark.createDataFrame([("b", 2), ("c", 3)], c.schema), "uri").collect())) == [("a", 1), ("b", 2), ("c", 3)]
    n = spark.createDataFrame([("a.md", 2), ("a (1).md", 2), ("A (2).md", 1), ("b (1).md", 5)], "name string, mtime int")
    assert sorted(map(tuple, catalog.latest_by_name(n).collect())) == [("a.md", "a.md", 2), ("b.md", "b (1).md", 5)]
    assert {r.name: r.action for r in catalog.reconcile(n).collect()} == {"a (1).md": "delete", "A (2).md": "delete", "b (1).md": "replace"}
    assert spark.range(1).select(catalog.known_format(F.lit("zzz"))).first()[0] == "UNKNOWN"


def test_stream(spark, tmp_path):
    from parchment.operators.wiki import read_wiki
    from parchment.streaming.wiki import stream_wiki

    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    (src / "a.txt").write_text("One text.")
    (src / "blank.txt").write_text("  ")
    (src / "d.docx").write_bytes(DOCX)
    stream_wiki(spark, str(src), out, ck).awaitTermination()
    rows = {r.file_name: r.markdown for r in read_wiki(spark, out).collect()}
    assert set(rows) == {"a.txt.md", "d.docx.md"} and "# a\n" in rows["a.txt.md"] and "One text." in rows["a.txt.md"]
    (src / "b.md").write_text("# B")
    for _ in range(2):  # the second time there is nothing to do
        stream_wiki(spark, str(src), out, ck).awaitTermination()
    assert {r.file_name for r in read_wiki(spark, out).collect()} == {"a.txt.md", "b.md.md", "d.docx.md"}


def test_store(spark, tmp_path):
    from parchment import schemas
    from parchment.operators import store

    rows = [("1", "u1", "a", "PDF", None), ("2", "u2", "b", "NONSENSE", None)]
    c = spark.createDataFrame(rows, schemas.CATALOG).withColumn("imported_at", F.timestamp_seconds(F.col("id").cast("long")))
    assert store.load_catalog(spark, str(tmp_path / "none")).count() == 0
    store.save_catalog(c, str(tmp_path / "c"))
    assert [(r.id, r.format) for r in store.load_catalog(spark, str(tmp_path / "c")).collect()] == [("2", "UNKNOWN"), ("1", "PDF")]
    assert store.from_json(spark.createDataFrame([("{broken",), ("[]",), ("{}",)], "json string")).count() == 0
    m = spark.createDataFrame([("u", "word/media/i.png", bytearray(b"1")), ("u", "word/media/i.png", bytearray(b"1")), ("v", "i.png", bytearray(b"2"))], schemas.MEDIA)
    for _ in range(2):
        store.write_media(m, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    out = str(tmp_path)

    def write(uri, data):
        if uri == "bad":
            raise OSError("read-only")
        with open(f"{out}/{uri}", "wb") as f:
            f.write(data)

    e = spark.createDataFrame([("t", "TXT", "한"), ("p", "PDF", "x"), ("bad", "MARKDOWN", "x")], "uri string, format string, text string")
    got = {r.uri: r for r in store.write_texts(e, write).collect()}
    assert got["t"].saved and (tmp_path / "t").read_bytes() == "한".encode() and not got["p"].saved and "read-only" in got["bad"].message


def test_wiki_table_outlives_lost_jobs(spark, tmp_path, monkeypatch):
    from parchment.operators import wiki

    path = str(tmp_path / "wiki")
    def docs(**texts):
        return spark.createDataFrame(sorted(texts.items()), "file_name string, markdown string")
    def stored():
        return {r.file_name: r.markdown for r in wiki.read_wiki(spark, path).collect()}
    assert stored() == {}
    wiki.write_wiki(docs(a="1", b="1"), path)
    wiki.write_wiki(docs(b="2", c="2"), path)
    want = {"a": "1", "b": "2", "c": "2"}
    assert stored() == want
    # a job that fails while it writes
    with pytest.raises(Exception):
        wiki.write_wiki(docs(a="9").withColumn("markdown", F.raise_error(F.lit("lost"))), path)
    (tmp_path / "wiki" / "version=9999999999999999999999" / "_temporary").mkdir(parents=True)
    assert stored() == want
    # compaction that ends before each of its steps
    files = [0]
    write = wiki.write_wiki
    def lost(*args):
        raise RuntimeError("lost")
    monkeypatch.setattr(wiki, "write_wiki", lost)
    with pytest.raises(RuntimeError):
        wiki.compact_wiki(spark, path)
    assert stored() == want
    monkeypatch.setattr(wiki, "write_wiki", lambda *args: (write(*args), lost()))
    with pytest.raises(RuntimeError):  # the new version is there, the old ones too
        wiki.compact_wiki(spark, path)
    assert stored() == want and len(wiki._versions(spark, path)) == 3
    monkeypatch.setattr(wiki, "write_wiki", write)
    wiki.compact_wiki(spark, path)
    assert stored() == want and len(wiki._versions(spark, path)) == 1
    wiki.write_wiki(docs(c="3"), path)
    assert stored() == want | {"c": "3"}


def test_markdown_files_and_sync(spark, tmp_path, monkeypatch):
    import os

    from parchment.operators import files, sync, wiki

    out, inbox = tmp_path / "out", tmp_path / "inbox"
    d = spark.createDataFrame([("한 글.md", "# 한"), ("b.md", "one"), ("n" * 300 + ".md", "long")], "file_name string, markdown string")
    for _ in range(2):
        got = {r.file_name: r for r in wiki.write_markdown(d, f"file://{out}").collect()}
        assert got["한 글.md"].done and not got["n" * 300 + ".md"].done and (out / "한 글.md").read_text() == "# 한"
    assert sorted(x.name for x in out.iterdir()) == ["b.md", "한 글.md"]

    def put(folder, name, text, at):
        folder.mkdir(exist_ok=True)
        (folder / name).write_text(text)
        os.utime(folder / name, (at, at))

    source = tmp_path / "device"
    for name, text, at in (("a.md", "old", 100), ("a (1).md", "new", 200), ("A (2).md", "older", 50), ("b (3).md", "only", 10)):
        put(source, name, text, at)
    put(inbox, "k.md", "kept", 300)
    put(inbox, "k (1).md", "less", 200)
    put(inbox, "m (1).md", "m1", 100)
    put(inbox, "m (2).md", "m2", 200)
    put(inbox, "plain (x).md", "no copy", 1)
    for _ in range(2):
        assert all(r.done for r in sync.collect(spark, f"file://{source}", f"file://{inbox}").collect())
    assert (inbox / "a.md").read_text() == "new" and (inbox / "b.md").read_text() == "only"
    # a run that ends after one action, then one that does the rest
    rows = files.each
    monkeypatch.setattr(files, "each", lambda d, *a: rows(d.orderBy("name").limit(1), *a))
    sync.clean(spark, f"file://{inbox}").collect()
    monkeypatch.setattr(files, "each", rows)
    assert all(r.done for r in sync.clean(spark, f"file://{inbox}").collect())
    assert sync.clean(spark, f"file://{inbox}").count() == 0
    assert {x.name: x.read_text() for x in inbox.iterdir() if not x.name.startswith(".")} == {"a.md": "new", "b.md": "only", "k.md": "kept", "m.md": "m2", "plain (x).md": "no copy"}


def test_http_transport(spark, monkeypatch):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from parchment.operators import model

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers["Authorization"], self.headers["Content-Type"], body["model"]))
            user = body["messages"][1]["content"]
            data = json.dumps({"choices": [{"message": {"content": f" said {user} "}}]}).encode() if user != "no" else "거절".encode()
            self.send_response(200 if user != "no" else 403)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    s = model.settings_of("CUSTOM", f"http://127.0.0.1:{server.server_port}/v1/", "m")
    send = model.http_transport(s)
    monkeypatch.setenv("PARCHMENT_MODEL_KEY", " key ")
    status, body = send('{"model": "m", "messages": [{}, {"content": "hi"}]}')
    assert status == 200 and json.loads(body)["choices"] and seen == [("/v1/chat/completions", "Bearer key", "application/json", "m")]
    d = spark.createDataFrame([(1, "s", "hi"), (2, "s", "no")], "k long, system string, user string")
    got = {r.k: r for r in complete(d, "k", "m", send).collect()}
    assert got[1].answer == "said hi" and got[2].error == "오류: LLM 요청 실패 (403): 거절"
    server.shutdown()


def test_pages_are_limited(spark):
    c = spark.createDataFrame([("a", 120), ("b", 3), ("c", 0)], "uri string, page_count int")
    got = registry.pages(c).groupBy("uri").agg(F.count("*").alias("n"), F.max("page").alias("last")).collect()
    assert {r.uri: (r.n, r.last) for r in got} == {"a": (50, 49), "b": (3, 2)}


def test_pdf_text():
    import random

    from parchment.sources import pdf, writers

    turns = [{"turn": i, "role": f"r{i}", "text": f"a (b) \\ {i}\nnext  line é"} for i in range(3)]
    whole = writers.pdf_of(1, turns)
    assert pdf.extract(whole) == ("\n".join(f"r{i}\na (b) \\ {i}\nnext  line é" for i in range(3)), 3)
    # objects within a stream, inherited resources, codes with names of their own, strings of all kinds, a picture in the text, a form
    first = b"4 0 5 80 "
    inner = first + b"<< /Type /Font /Encoding << /Differences [65 /uni00C4 /space /b] >> >>".ljust(80) + b"<< /Type /Catalog /Pages 6 0 R >>"
    body = rb"BT /F#31 9 Tf 1 0 0 1 10 700 Tm (A\101\050\)" + b"\\\r\nB) Tj 0 -12 Td <43> Tj ET BI /W 1 ID xyz(( EI BT 10 600 Td [(C) -250 (C) 20 (C)] TJ ET /X Do"
    form = b"BT 10 500 Td (C) Tj ET"
    parts = {3: b"<< /Type /ObjStm /N 2 /First 9 /Length 1 0 R >>\nstream\n" + inner + b"\nendstream", 6: b"<< /Type /Pages /Kids [7 0 R 99 0 R] /Resources << /Font << /F1 4 0 R >> /XObject << /X 9 0 R >> >> >>",
             7: b"<< /Type /Page /Contents [8 0 R] >>", 8: b"<< /Length 9999 >>\nstream\r\n" + body + b"\nendstream", 9: b"<< /Subtype /Form >> % comment\nstream\n" + form + b"\nendstream"}
    file = b"%PDF-1.7\n" + b"".join(str(n).encode() + b" 0 obj " + x + b" endobj\n" for n, x in parts.items())
    assert pdf.extract(file) == ("ÄÄ()\nb\nb bb\nb", 1)
    with pytest.raises(Broken, match="encrypted"):
        pdf.extract(whole.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R"))
    with pytest.raises(Broken):
        pdf.extract(b"junk")
    r = random.Random(1)
    for _ in range(300):  # damage of any kind ends in some text or a warning
        bad = bytearray(whole[: r.randrange(20, len(whole))] if r.random() < 0.5 else whole)
        for _ in range(r.randrange(1, 30)):
            bad[r.randrange(9, len(bad))] = r.randrange(256)
        content, _ = registry.read_one("PDF", bytes(bad), "u", {})
        assert "plain_text" in content or content["warning"].startswith(registry.NO_PDF_TEXT)


def test_small_files_share_batches(spark):
    """Small files go out together, a large one ends its batch, and none is lost or out of order."""
    schema = to_arrow_schema(StructType.fromDDL(registry._OUT))
    contents = [XLSX] * 1200 + [b"x" * (registry.BATCH_BYTES + 1)] * 2 + [XLSX] * 3 + [None]
    kinds = ["XLSX"] * 1200 + ["TXT"] * 2 + ["XLSX"] * 4
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(kinds))]), pa.array(kinds), pa.array(contents, pa.binary())], names=["uri", "format", "content"])
    out = list(registry._reader({}, schema)(iter([batch])))
    assert [x for b in out for x in b.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert len(out) < 60 and max(b.num_rows for b in out) <= registry.BATCH_ROWS
    want = pa.RecordBatch.from_pylist([dict.fromkeys(schema.names) | {"uri": "0", "format": "XLSX", "is_markdown": False} | office.xlsx(XLSX, "0")[0]], schema=schema)
    assert out[0].slice(0, 1).equals(want)
