"""Text expressions: trimming, sentences, tokens, markup, Markdown, names and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic, Korean and English.
STOPWORDS = (
    "그리고", "그러나", "하지만", "또한", "그런데", "그래서", "이는", "있다", "없다",
    "이다", "한다", "에서", "으로", "에게", "까지", "부터", "이와", "그리하여", "또는",
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "for", "is", "are",
    "was", "were", "be", "as", "at", "by", "it", "this", "that", "with", "from",
)

# Name, label and file extensions of each format.
FORMATS = (
    ("HWP", "HWP", ("hwp",)),
    ("HWPX", "HWPX", ("hwpx",)),
    ("DOC", "DOC", ("doc",)),
    ("DOCX", "DOCX", ("docx",)),
    ("PPTX", "PPTX", ("pptx",)),
    ("XLSX", "XLSX", ("xlsx",)),
    ("ODF", "OpenDocument", ("odt", "ods", "odp")),
    ("PDF", "PDF", ("pdf",)),
    ("TXT", "TXT", ("txt", "log", "csv")),
    ("MARKDOWN", "Markdown", ("md", "markdown")),
    ("IMAGE", "이미지", ("jpg", "jpeg", "png", "webp", "bmp", "gif")),
    ("GOOGLE", "Google 문서", ()),
    ("UNKNOWN", "Unknown", ()),
)

# Badge and colour of each format.
BADGES = {"HWP": "한", "HWPX": "한", "DOC": "W", "DOCX": "W", "PPTX": "P", "XLSX": "X", "ODF": "OD", "PDF": "PDF", "TXT": "TXT", "MARKDOWN": "MD", "IMAGE": "IMG", "GOOGLE": "G", "UNKNOWN": "?"}
COLOURS = {
    "HWP": 0x00A2E8, "HWPX": 0x00A2E8, "DOC": 0x2B579A, "DOCX": 0x2B579A, "PPTX": 0xD24726, "XLSX": 0x217346, "ODF": 0x0E85CD,
    "PDF": 0xD93025, "TXT": 0x607D8B, "MARKDOWN": 0x37474F, "IMAGE": 0x7B1FA2, "GOOGLE": 0x4285F4, "UNKNOWN": 0x9E9E9E,
}

# Exact media types; the families are in detect_mime.
MEDIA_TYPES = {
    "application/pdf": "PDF",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "DOCX",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "PPTX",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "XLSX",
    "application/vnd.oasis.opendocument.text": "ODF",
    "application/vnd.oasis.opendocument.spreadsheet": "ODF",
    "application/vnd.oasis.opendocument.presentation": "ODF",
}

# Markup that is never shown, tags that end a line, tags that are a tab, entities in the order they are decoded.
HIDDEN = (
    r"(?s)<w:instrText[^>]*>.*?</w:instrText>",
    r"(?s)<w:delText[^>]*>.*?</w:delText>",
    r"(?s)<mc:Fallback>.*?</mc:Fallback>",
    r"(?s)<w:fldData[^>]*>.*?</w:fldData>",
    r"<((?:wp|wp14|a|pic|v|o|w10|w14|w15):(?:posOffset|pctPosHOffset|pctPosVOffset|pctWidth|pctHeight))[^>]*>[^<]*</\1>",
)
LINE_ENDS = ("</w:p>", "<w:br/>", "<w:br />", "</a:p>", "<a:br/>", "<a:br />", "</hp:p>", "</p>", "<hp:lineBreak/>", "</text:p>", "</text:h>", "<text:line-break/>")
TABS = ("<w:tab/>", "<w:tab />", "<text:tab/>")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))

_EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, _EDGES, "")


def blank(c: Column) -> Column:
    """Null or nothing but white space."""
    return F.coalesce(strip(c) == "", F.lit(True))


def sentence_list(text: Column) -> Column:
    """Sentences of more than one character; they end after . ! ? or an ideographic full stop with white space, or at a line end."""
    parts = F.split(F.regexp_replace(strip(text), "\r", ""), r"(?<=[.!?。])\s+|\n+")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > 1)


def token_list(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def topical(token: Column) -> Column:
    return (F.length(token) >= 2) & ~token.isin(*STOPWORDS)


def markup_text(xml: Column) -> Column:
    """Readable text of word-processor or web markup; nothing but the five named entities is decoded."""
    c = xml
    for pattern in HIDDEN:
        c = F.regexp_replace(c, pattern, "")
    for tags, mark in ((LINE_ENDS, "\n"), (TABS, "\t")):
        c = F.regexp_replace(c, "(?i)" + "|".join(tags), mark)
    c = F.regexp_replace(c, "<[^>]*>", "")
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[\t\x0B\f\p{Z}\x1C-\x1F]+(?=\n|$)", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def format_of_name(name: Column) -> Column:
    ext, out = extension(name), None
    for kind, _, exts in FORMATS:
        if exts:
            out = F.when(ext.isin(*exts), kind) if out is None else out.when(ext.isin(*exts), kind)
    return out.otherwise("UNKNOWN")


def format_of_mime(mime: Column) -> Column:
    exact = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return (F.when(mime.isNull(), "UNKNOWN").when(mime.startswith("application/vnd.google-apps."), "GOOGLE").when(mime.startswith("image/"), "IMAGE")
            .otherwise(F.coalesce(F.element_at(exact, mime), F.when(mime.startswith("text/"), "TXT"), F.lit("UNKNOWN"))))


def detect_format(name: Column, mime: Column) -> Column:
    """By name, and by media type where the name says nothing."""
    by_name = format_of_name(F.coalesce(name, F.lit("")))
    return F.when(by_name != "UNKNOWN", by_name).otherwise(format_of_mime(mime))


def format_label(fmt: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kind, label, _ in FORMATS for x in (kind, label)]), fmt)


def badge(fmt: Column) -> Column:
    """struct(badge, rgb)."""
    pick = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), fmt)
    return F.struct(pick(BADGES).alias("badge"), pick(COLOURS).alias("rgb"))


def stem(name: Column) -> Column:
    """Before the last point."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def slug(name: Column) -> Column:
    """A file name for any name."""
    return F.concat(strip(F.regexp_replace(name, r'[\\/:*?"<>|]', "_")), F.lit(".md"))


def line_class(line: Column) -> Column:
    """What a line of Markdown is."""
    return (F.when(strip(line) == "", "blank").when(line.startswith("### "), "h3").when(line.startswith("## "), "h2").when(line.startswith("# "), "h1")
            .when(line.startswith("- ") | line.startswith("* "), "bullet").when(line.rlike(r"^\d+\.\s"), "number").otherwise("text"))


def line_text(line: Column) -> Column:
    """A line of Markdown without its marker; bullets get a dot."""
    kind = line_class(line)
    return (F.when(kind == "h3", F.substr(line, F.lit(5))).when(kind == "h2", F.substr(line, F.lit(4))).when(kind == "h1", F.substr(line, F.lit(3)))
            .when(kind == "bullet", F.concat(F.lit("• "), F.substr(line, F.lit(3)))).when(kind == "blank", "").otherwise(line))


def decode_bytes(content: Column) -> Column:
    """UTF-8 with or without a mark, else EUC-KR, else UTF-8 with replacements (needs spark.sql.legacy.javaCharsets for EUC-KR)."""
    marked = F.substring(content, 1, 3) == F.unhex(F.lit("EFBBBF"))
    raw = content.cast("string")
    return F.when(marked, F.regexp_replace(F.make_valid_utf8(raw), "^\ufeff", "")).otherwise(F.coalesce(F.try_validate_utf8(raw), F.decode(content, "EUC-KR"), F.make_valid_utf8(raw)))


# First bytes of image files.
def image_type(content: Column) -> Column:
    head = lambda h: F.substring(content, 1, len(h) // 2) == F.unhex(F.lit(h))
    return (F.when(F.octet_length(content) < 4, None).when(head("89504E47"), "png").when(head("FFD8"), "jpg").when(head("474946"), "gif").when(head("424D"), "bmp")
            .when((F.octet_length(content) >= 12) & head("52") & (F.substring(content, 9, 1) == F.unhex(F.lit("57"))), "webp"))


def view_mode(image_uri: Column, pdf_uri: Column, has_deck: Column, is_markdown: Column, has_blocks: Column) -> Column:
    """How a document is shown; the first that applies."""
    return (F.when(image_uri.isNotNull(), "image").when(pdf_uri.isNotNull(), "pdf").when(has_deck, "slides").when(is_markdown, "markdown").when(has_blocks, "blocks").otherwise("text"))


def heading_level(style: Column, outline: Column) -> Column:
    """1..4, or 0 for a paragraph that is no heading."""
    named = F.regexp_extract(style, r"(?i)heading\s*(\d)|^제목\s*(\d)", 0)
    number = F.regexp_extract(named, r"(\d)$", 1).try_cast("int")
    level = F.when(number.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(4), number)))
    below = F.when(outline.try_cast("int").isNotNull(), F.greatest(F.lit(1), F.least(F.lit(4), outline.try_cast("int") + 1)))
    return F.coalesce(level, below, F.lit(0))


def alignment(code: Column) -> Column:
    return F.when(code == "center", 3).when(code.isin("right", "end"), 2).when(code.isin("both", "distribute", "justify"), 0).otherwise(1)


def toggle(present: Column, value: Column) -> Column:
    """A flag element is on unless its value says no."""
    return F.coalesce(present, F.lit(False)) & (value.isNull() | ~value.isin("false", "0", "none"))


def caption(label: Column, at: Column) -> Column:
    """Label and day, as lists show them."""
    return F.concat(label, F.lit(" · "), F.date_format(at, "M월 d일"))


def editable(fmt: Column) -> Column:
    return fmt.isin("TXT", "MARKDOWN")


#: Bold, italic and code, from left to right; a marker without its partner is text.
SPAN = r"(?s)\*\*.*?\*\*|\*[^*]+\*|`[^`]*`"


def markdown_spans(line: Column) -> Column:
    """array<struct<text,style>> of a line: marked stretches without their marks, and what stands between them."""
    marked = F.regexp_extract_all(line, F.lit(SPAN), 0)
    inner = lambda m, n: F.substr(m, F.lit(n + 1), F.length(m) - 2 * n)
    span = lambda m: (F.when(m.startswith("**"), F.struct(inner(m, 2).alias("text"), F.lit("bold").alias("style")))
                      .when(m.startswith("*"), F.struct(inner(m, 1).alias("text"), F.lit("italic").alias("style"))).otherwise(F.struct(inner(m, 1).alias("text"), F.lit("code").alias("style"))))
    both = F.zip_with(F.split(line, SPAN), marked, lambda p, m: F.array(F.struct(p.alias("text"), F.lit("plain").alias("style")), F.when(m.isNotNull(), span(m))))
    return F.filter(F.flatten(both), lambda x: x.isNotNull() & ((x["style"] != "plain") | (x["text"] != "")))
