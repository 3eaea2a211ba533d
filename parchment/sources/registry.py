"""Files to normalised content: one pass over the files, each read by the parser of its format.

A parser is a function (content, uri) -> (columns of CONTENT, media by name).  Text recognition and
the export of online documents need engines of their own; they are given as providers, and another engine for PDF text may be:

    pdf(content) -> (text, pages)      ocr(content) -> list of blocks, each a list of lines      export(uri) -> PDF bytes

A provider is called on the executors and has to be picklable.  What fails becomes the row's warning, never the job's error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parchment import schemas
from parchment.functions import text as tx
from parchment.sources import hangul, office
from parchment.sources import pdf as pdf_text
from parchment.sources.markup import Broken

#: Pages of a file that are shown.
MAX_PAGES = 50

# Warnings.
NO_DOC = "DOC(구 바이너리) 파싱은 다음 업데이트에서 지원됩니다. Word에서 DOCX로 저장 후 열어주세요."
NO_FORMAT = "지원하지 않는 형식입니다: "
NO_PDF_TEXT = "PDF 텍스트 추출 실패(스캔 이미지 PDF일 수 있음): "
NO_EXPORT = "Google 문서를 PDF로 내보낼 수 없습니다. Drive 앱이 설치되어 있는지 확인해주세요."
EXPORT_FAILED = ("Google 문서 내보내기 실패: ", "\n네트워크 연결과 Drive 앱 로그인 상태를 확인해주세요.")
EXPORT_NO_TEXT = "내보낸 PDF의 텍스트 추출에 실패했습니다: "
NO_IMAGE_TEXT = "이미지에서 텍스트를 찾지 못했습니다. (사진·그림만 있는 이미지일 수 있음)"
OCR_FAILED = "이미지 OCR 실패: "

PARSERS: dict[str, Callable[[bytes, str], tuple[dict, dict[str, bytes]]]] = {
    "DOCX": office.docx, "XLSX": office.xlsx, "PPTX": office.pptx, "ODF": office.odf, "HWPX": office.hwpx, "HWP": hangul.hwp,
}
TEXTS = ("TXT", "MARKDOWN")


def scan(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """RAW rows of the files below path."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (r.option("pathGlobFilter", glob) if glob else r).load(path)
    return raw_of(files)


def raw_of(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("uri"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(None).cast("string").alias("mime"), F.col("modificationTime").alias("modified_at"), "content")


def display_name(name, uri):
    """A name for every file: its own, else the last part of its address."""
    last = F.element_at(F.split(uri, "/"), -1)
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(last, F.lit("")), F.lit("문서"))


def _pdf(content: bytes, pdf, warning: str) -> dict:
    try:
        text, pages = (pdf or pdf_text.extract)(content)
        return {"plain_text": text, "page_count": pages}
    except Exception as e:  # noqa: BLE001  whatever a provider raises is about this file
        return {"page_count": 0, "warning": f"{warning}{e}"}


def read_one(fmt: str, content: bytes | None, uri: str, providers: dict) -> tuple[dict, dict[str, bytes]]:
    """(content columns, media) of one file."""
    content = content or b""
    if fmt in PARSERS:
        try:
            return PARSERS[fmt](content, uri)
        except Broken as e:
            return {"warning": f"{fmt}: {e}"}, {}
        except RecursionError:
            return {"warning": f"{fmt}: nested too deeply"}, {}
    if fmt == "PDF":
        return {"renderable_uri": uri} | _pdf(content, providers.get("pdf"), NO_PDF_TEXT), {}
    if fmt == "GOOGLE":
        export = providers.get("export")
        if export is None:
            return {"warning": NO_EXPORT}, {}
        try:
            exported = export(uri)
        except Exception as e:  # noqa: BLE001
            return {"warning": str(e).join(EXPORT_FAILED)}, {}
        return {"renderable_uri": uri} | _pdf(exported, providers.get("pdf"), EXPORT_NO_TEXT), {}
    if fmt == "IMAGE":
        out = {"renderable_image_uri": uri}
        try:
            if providers.get("ocr") is None:
                raise Broken("no OCR provider")
            text = "\n\n".join("\n".join(lines) for lines in providers["ocr"](content))
            return out | ({"plain_text": text} if text.strip() else {"plain_text": text, "warning": NO_IMAGE_TEXT}), {}
        except Exception as e:  # noqa: BLE001
            return out | {"warning": f"{OCR_FAILED}{e}"}, {}
    if fmt == "DOC":
        return {"warning": NO_DOC}, {}
    labels = {k: label for k, label, _ in tx.FORMATS}
    return {"warning": NO_FORMAT + labels.get(fmt, fmt)}, {}


_OUT = schemas.CONTENT + ", markup array<string>, bytes binary"


#: Rows of a batch at most, and bytes of files and their text from which on it goes out.
BATCH_ROWS, BATCH_BYTES = 500, 1 << 20


def _reader(providers: dict, schema: pa.Schema):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows, size = [], 0
            for i in range(batch.num_rows):  # files can be large: one is read at a time
                uri, fmt, content = (batch.column(k)[i].as_py() for k in range(3))
                row = dict.fromkeys(schema.names) | {"uri": uri, "format": fmt, "is_markdown": fmt == "MARKDOWN"}
                row |= {"bytes": content} if fmt in TEXTS else read_one(fmt, content, uri, providers)[0]
                rows.append(row)
                size += len(content or b"") + len(row["plain_text"] or "")
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def allow_charsets(spark: SparkSession) -> None:
    """Let the session decode EUC-KR; read when a query runs, so it stays."""
    if spark.conf.get("spark.sql.legacy.javaCharsets") != "true":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def parse(raw: DataFrame, providers: dict | None = None) -> DataFrame:
    """CONTENT rows of RAW rows."""
    allow_charsets(raw.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(_OUT))
    d = raw.select("uri", tx.detect_format(display_name(F.col("name"), F.col("uri")), F.col("mime")).alias("format"), "content")
    d = d.mapInArrow(_reader(providers or {}, schema), _OUT)
    text = F.coalesce("plain_text", tx.decode_bytes(F.col("bytes")), F.array_join(F.transform("markup", tx.markup_text), "\n\n"), F.lit(""))
    return d.withColumns({"plain_text": text, "page_count": F.coalesce("page_count", F.lit(0))}).drop("markup", "bytes")


def _media(providers: dict, schema: pa.Schema):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                uri, fmt, content = (batch.column(k)[i].as_py() for k in range(3))
                for name, data in read_one(fmt, content, uri, providers)[1].items():
                    yield pa.RecordBatch.from_pylist([{"uri": uri, "media_name": name, "data": data}], schema=schema)

    return run


def media(raw: DataFrame) -> DataFrame:
    """MEDIA rows: the images stored in files."""
    d = raw.select("uri", tx.detect_format(display_name(F.col("name"), F.col("uri")), F.col("mime")).alias("format"), "content").where(F.col("format").isin(*PARSERS))
    return d.mapInArrow(_media({}, to_arrow_schema(StructType.fromDDL(schemas.MEDIA))), schemas.MEDIA)


def pages(content: DataFrame, limit: int = MAX_PAGES) -> DataFrame:
    """(uri, page) of the pages that are shown of files with pages: the first ``limit``, numbered from 0."""
    shown = F.slice(F.sequence(F.lit(0), F.greatest("page_count", F.lit(1)) - 1), 1, limit)
    return content.where("page_count > 0").select("uri", F.explode(shown).alias("page"))


def explode_blocks(content: DataFrame) -> DataFrame:
    """(uri, pos, columns of the block)."""
    return content.select("uri", F.posexplode("blocks").alias("pos", "b")).select("uri", "pos", "b.*")


def explode_cells(content: DataFrame) -> DataFrame:
    """(uri, pos, row, col, value) of the cells of all tables."""
    t = explode_blocks(content).where("kind = 'table'").select("uri", "pos", F.posexplode("rows").alias("row", "r"))
    return t.select("uri", "pos", "row", F.posexplode("r").alias("col", "value"))


def explode_slides(content: DataFrame) -> DataFrame:
    return content.select("uri", F.explode("slide_deck.slides").alias("s")).select("uri", "s.number", "s.note", "s.background_rgb", "s.elements")


def explode_elements(content: DataFrame) -> DataFrame:
    """(uri, number, pos, columns of the element), with z: shapes lie below pictures, tables and text."""
    e = explode_slides(content).select("uri", "number", F.posexplode("elements").alias("pos", "e")).select("uri", "number", "pos", "e.*")
    return e.withColumn("z", F.when(F.col("kind") == "shape", 0).when(F.col("kind") == "picture", 1).when(F.col("kind") == "table", 2).otherwise(3))


def entries(raw: DataFrame, pattern: str) -> DataFrame:
    """(uri, name, data) of the zip entries whose names match; what is no zip file has none."""
    import re

    from parchment.sources.markup import unzip

    wanted = re.compile(pattern)
    schema = to_arrow_schema(StructType.fromDDL("uri string, name string, data binary"))

    def run(it):
        for batch in it:
            for uri, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found = unzip(content.as_py() or b"", lambda n: bool(wanted.fullmatch(n)))
                except Broken:
                    continue
                for name, data in found.items():
                    yield pa.RecordBatch.from_pylist([{"uri": uri, "name": name, "data": data}], schema=schema)

    return raw.select("uri", "content").mapInArrow(run, "uri string, name string, data binary")
