"""Every query of the engine by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions import geometry, grid
from parchment.functions import text as tx
from parchment.operators import catalog, model, store, wiki
from parchment.plans import prompts, summary
from parchment.sources import registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lit(s: str) -> str:
    """A SQL string."""
    return "'" + s.replace("'", "''") + "'"


_STOP = ", ".join(lit(w) for w in tx.STOPWORDS)
#: Sentences and topical tokens of documents; the split after an end mark is done by line ends.
_SENTS = r"""
c AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS clean FROM documents),
p AS (SELECT doc_id, clean, list_filter(list_transform(string_split_regex(regexp_replace(replace(clean, chr(13), ''), '([.!?。])\s+', '\1' || chr(10), 'g'), '\n+'),
  lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: length(x) > 1) AS sents FROM c),
s AS (SELECT doc_id, CAST(unnest(range(len(sents))) AS INT) AS idx, unnest(sents) AS sentence FROM p),
"""
_TOKENS = _SENTS + r"""
t AS (SELECT doc_id, idx, w FROM (SELECT doc_id, idx, unnest(string_split_regex(lower(sentence), '[^\p{L}\p{N}]+')) AS w FROM s)
  WHERE length(w) >= 2 AND w NOT IN (STOP)),
f AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY doc_id, w),
g AS (SELECT doc_id, idx, sum(n) / count(*) AS score FROM t JOIN f USING (doc_id, w) GROUP BY doc_id, idx),
h AS (SELECT s.doc_id, s.idx, sentence, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM s LEFT JOIN g USING (doc_id, idx)),
""".replace("STOP", _STOP)


def _summary(k: int) -> str:
    return _TOKENS + rf"""
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS r FROM h),
b AS (SELECT doc_id, string_agg('• ' || sentence, chr(10) ORDER BY idx) AS best FROM r WHERE r <= {k} GROUP BY doc_id),
sm AS (SELECT p.doc_id, CASE WHEN clean = '' THEN {lit(summary.NOTHING)} WHEN len(sents) <= {k} THEN clean
  WHEN p.doc_id NOT IN (SELECT doc_id FROM t) THEN array_to_string(sents[1:{k}], ' ') ELSE best END AS summary FROM p LEFT JOIN b USING (doc_id))
"""


@query("WITH" + _summary(5) + "SELECT doc_id, summary FROM sm")
def summarize_documents(spark, d):
    return summary.summarize(read(spark, d, "documents"), "doc_id", "text")


@query("WITH" + _summary(5) + r""", k AS (SELECT doc_id, list_filter(list_transform(string_split(summary, chr(10)),
  lambda x: regexp_replace(regexp_replace(x, '^• ', ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '') AS l FROM sm)
SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS point FROM k""")
def key_points(spark, d):
    return summary.key_points(read(spark, d, "documents"), "doc_id", "text")


@query("WITH" + _SENTS.rstrip(",\n ") + " SELECT doc_id, idx, sentence FROM s")
def sentences(spark, d):
    return summary.sentences(read(spark, d, "documents"), "doc_id", "text")


@query("WITH" + _TOKENS.rstrip(",\n ") + " SELECT doc_id, idx, w AS token FROM t")
def tokens(spark, d):
    return summary.tokens(read(spark, d, "documents"), "doc_id", "text")


@query("WITH" + _TOKENS.rstrip(",\n ") + " SELECT doc_id, idx, sentence, score FROM h")
def sentence_scores(spark, d):
    return summary.sentence_scores(read(spark, d, "documents"), "doc_id", "text")


@query("WITH" + _TOKENS.rstrip(",\n ") + " SELECT doc_id, w AS word, n FROM f")
def word_frequency(spark, d):
    return summary.word_frequency(read(spark, d, "documents"), "doc_id", "text")


def _markup_sql(col: str) -> str:
    for name in ("w:instrText", "w:delText", "w:fldData"):
        col = f"regexp_replace({col}, '<{name}[^>]*>.*?</{name}>', '', 'gs')"
    col = f"regexp_replace({col}, '<mc:Fallback>.*?</mc:Fallback>', '', 'gs')"
    for prefix in ("wp", "wp14", "a", "pic", "v", "o", "w10", "w14", "w15"):
        for name in ("posOffset", "pctPosHOffset", "pctPosVOffset", "pctWidth", "pctHeight"):
            if prefix == "wp":  # of the expanded back references, those that can stand in a page
                col = f"regexp_replace({col}, '<{prefix}:{name}[^>]*>[^<]*</{prefix}:{name}>', '', 'g')"
    col = f"regexp_replace({col}, '{'|'.join(tx.LINE_ENDS)}', chr(10), 'gi')"
    col = f"regexp_replace({col}, '{'|'.join(tx.TABS)}', chr(9), 'gi')"
    col = f"regexp_replace({col}, '<[^>]*>', '', 'g')"
    for name, char in tx.ENTITIES:
        col = f"replace({col}, {lit(name)}, {lit(char)})"
    col = rf"regexp_replace({col}, '\r\n?', chr(10), 'g')"
    col = rf"regexp_replace({col}, '[\t\x0B\f\p{{Z}}\x1C-\x1F]+(\n|$)', '\1', 'g')"
    col = rf"regexp_replace({col}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({col}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query("SELECT page_id, " + _markup_sql("html") + " AS text FROM pages")
def extract_markup(spark, d):
    return read(spark, d, "pages").select("page_id", tx.markup_text(F.col("html")).alias("text"))


_TRANSCRIPT = "tr AS (SELECT conv_id, left(string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn), 12000) AS text FROM conversations GROUP BY conv_id)"


def _transcripts(spark, d):
    return prompts.transcript(read(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query(f"WITH {_TRANSCRIPT} SELECT conv_id, text FROM tr")
def transcript_context(spark, d):
    return _transcripts(spark, d)


@query(f'WITH {_TRANSCRIPT} SELECT conv_id, {lit(prompts.MINUTES_SYSTEM)} AS "system", {lit(prompts.MINUTES_USER)} || text AS "user" FROM tr')
def minutes_prompt(spark, d):
    return prompts.minutes(_transcripts(spark, d), "conv_id", "text")


@query(f'''SELECT doc_id, {lit(prompts.ASK_SYSTEM)} AS "system", {lit(prompts.ASK_USER[0])} || left(text, 12000) || {lit(prompts.ASK_USER[1])} || q AS "user"
FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE 'Who is ' || source || '?' END AS q FROM documents) WHERE trim(q) <> \'\'''')
def ask_prompt(spark, d):
    docs = read(spark, d, "documents")
    return prompts.ask(docs, "doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.concat(F.lit("Who is "), "source", F.lit("?"))))


@query(f'SELECT doc_id, {lit(prompts.TECH_SYSTEM)} AS "system", {lit(prompts.TECH_USER)} || left(text, 12000) AS "user" FROM documents')
def tech_prompt(spark, d):
    return prompts.tech(read(spark, d, "documents"), "doc_id", "text")


@query(f'''SELECT doc_id, {lit(prompts.SUMMARY_SYSTEM)} AS "system", {lit(prompts.SUMMARY_USER)} || left(text, 12000) AS "user" FROM documents WHERE trim(text) <> \'\'''')
def summary_prompt(spark, d):
    return prompts.summary(read(spark, d, "documents"), "doc_id", "text")


@query("WITH" + _summary(6) + f"SELECT doc_id, CASE WHEN clean = '' THEN {lit(prompts.SUMMARY_EMPTY)} ELSE summary || {lit(prompts.SUMMARY_LOCAL)} END AS answer FROM sm JOIN p USING (doc_id)")
def summary_without_model(spark, d):
    return prompts.summary_without_model(read(spark, d, "documents"), "doc_id", "text")


@query(f'''SELECT x.doc_id AS a, y.doc_id AS b, {lit(prompts.COMPARE_SYSTEM)} AS "system",
{lit(prompts.COMPARE_USER[0])} || left(x.text, 6000) || {lit(prompts.COMPARE_USER[1])} || left(y.text, 6000) AS "user"
FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1''')
def compare_prompt(spark, d):
    docs = read(spark, d, "documents")
    return prompts.compare(docs, docs.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")), "doc_id", "text")


@query("""WITH b AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN role WHEN 1 THEN '• ' || text WHEN 2 THEN role || chr(9) || text WHEN 3 THEN role || text END AS l FROM conversations)
SELECT conv_id, regexp_replace(string_agg(l, chr(10) ORDER BY turn), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS text FROM b GROUP BY conv_id""".replace("\\\\", "\\"))
def blocks_to_text(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("heading", "para", "table", "rich"))), (F.col("turn") % 4 + 1).cast("int"))
    runs = F.array(F.struct(F.col("role").alias("text")), F.struct(F.col("text").alias("text")))
    block = F.struct("turn", kind.alias("kind"), F.when(F.col("turn") % 4 == 0, F.col("role")).otherwise(F.col("text")).alias("text"), F.lit(True).alias("bullet"),
                     runs.alias("runs"), F.array(F.array("role", "text")).alias("rows"))
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    return c.select("conv_id", grid.blocks_text(F.col("blocks")).alias("text"))


_EXTS = ("hwp", "HWPX", "doc", "docx", "pptx", "xlsx", "odt", "ods", "pdf", "txt", "log", "csv", "md", "markdown", "JPG", "png", "zip", "")
_MIMES = (None, "application/vnd.google-apps.document", "image/png", "application/pdf", "text/markdown", "application/msword", *tx.MEDIA_TYPES)


def _named(spark, d):
    """documents with a derived file name and media type."""
    ext = F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("doc_id") % len(_EXTS) + 1).cast("int"))
    mime = F.element_at(F.array(*map(F.lit, _MIMES)), (F.col("doc_id") % len(_MIMES) + 1).cast("int"))
    name = F.concat(F.lit('doc "'), F.col("doc_id").cast("string"), F.lit('"'), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    return read(spark, d, "documents").withColumns({"name": name, "mime": mime})


_NAMED = f"""nm AS (SELECT *, 'doc "' || doc_id || '"' || CASE WHEN e = '' THEN '' ELSE '.' || e END AS name FROM (
  SELECT *, ([{', '.join(lit(x) for x in _EXTS)}])[doc_id % {len(_EXTS)} + 1] AS e, ([{', '.join('NULL' if x is None else lit(x) for x in _MIMES)}])[doc_id % {len(_MIMES)} + 1] AS mime FROM documents))"""
_BY_NAME = "CASE lower(e) " + " ".join(f"WHEN {lit(x)} THEN {lit(kind)}" for kind, _, exts in tx.FORMATS for x in exts) + " ELSE 'UNKNOWN' END"
_BY_MIME = ("CASE WHEN mime IS NULL THEN 'UNKNOWN' WHEN mime LIKE 'application/vnd.google-apps.%' THEN 'GOOGLE' WHEN mime LIKE 'image/%' THEN 'IMAGE' "
            + " ".join(f"WHEN mime = {lit(m)} THEN {lit(k)}" for m, k in tx.MEDIA_TYPES.items()) + " WHEN mime LIKE 'text/%' THEN 'TXT' ELSE 'UNKNOWN' END")
_DETECT = f"CASE WHEN {_BY_NAME} <> 'UNKNOWN' THEN {_BY_NAME} ELSE {_BY_MIME} END"


@query(f"WITH {_NAMED} SELECT doc_id, name, {_BY_NAME} AS format FROM nm")
def detect_format_name(spark, d):
    return _named(spark, d).select("doc_id", "name", tx.format_of_name(F.col("name")).alias("format"))


@query(f"WITH {_NAMED} SELECT doc_id, mime, {_BY_MIME} AS format FROM nm")
def detect_format_mime(spark, d):
    return _named(spark, d).select("doc_id", "mime", tx.format_of_mime(F.col("mime")).alias("format"))


@query(f"WITH {_NAMED} SELECT doc_id, {_DETECT} AS format FROM nm")
def detect_format(spark, d):
    return _named(spark, d).select("doc_id", tx.detect_format(F.col("name"), F.col("mime")).alias("format"))


_LABEL = "CASE f " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v, _ in tx.FORMATS) + " END"
_TITLE = r"regexp_replace(name, '\.[^.]*$', '')"


@query("WITH" + _summary(6) + f""", {_NAMED},
w AS (SELECT nm.*, {_DETECT} AS f, summary FROM nm JOIN sm USING (doc_id) WHERE trim(text) <> '')
SELECT doc_id, regexp_replace(name, '[\\\\/:*?"<>|]', '_', 'g') || '.md' AS file_name,
array_to_string(['---', 'title: "' || replace({_TITLE}, '"', '''') || '"', 'type: source', 'format: ' || {_LABEL}, 'source: {wiki.PRODUCER}', 'original: "' || replace(name, '"', '''') || '"',
'collected: 2024-01-02 03:04', 'updated: 2024-01-02', 'tags: [{wiki.PRODUCER}, auto-collected]', 'status: draft', '---', '', '# ' || {_TITLE}, '', '## 자동 요약', '', summary, '', '## 전문', '',
left(text, 200000), ''], chr(10)) AS markdown FROM w""")
def wiki_markdown(spark, d):
    docs = _named(spark, d).withColumn("format", tx.detect_format(F.col("name"), F.col("mime")))
    return wiki.wiki_documents(docs, "doc_id", "name", "format", "text", F.lit("2024-01-02 03:04"))


@query(r"""SELECT page_id, trim(regexp_replace(url, '[\\/:*?"<>|]', '_', 'g')) || '.md' AS file_name FROM pages""")
def slug_name(spark, d):
    return read(spark, d, "pages").select("page_id", tx.slug(F.col("url")).alias("file_name"))


_LATEST = "(SELECT * EXCLUDE (r) FROM (SELECT user_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE {}) WHERE r = 1)"


def _events(spark, d, where: str):
    return catalog.latest(read(spark, d, "events").where(where).select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id")


@query(f"""WITH c AS {_LATEST.format('event_id % 2 = 0 OR user_id % 3 > 0')}, n AS {_LATEST.format('event_id % 2 = 1 AND user_id % 3 = 0')}
SELECT user_id, event_id, event_type FROM n UNION ALL SELECT user_id, event_id, event_type FROM c WHERE user_id NOT IN (SELECT user_id FROM n)""")
def catalog_upsert(spark, d):
    """The odd events of every third user are new, all others are in the catalog."""
    return catalog.upsert(_events(spark, d, "event_id % 2 = 0 OR user_id % 3 > 0"), _events(spark, d, "event_id % 2 = 1 AND user_id % 3 = 0"), "user_id").select("user_id", "event_id", "event_type")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def catalog_remove(spark, d):
    gone = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return catalog.remove(read(spark, d, "orders"), "o_orderkey", gone).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey <> 7")
def other_documents(spark, d):
    return catalog.others(read(spark, d, "orders"), "o_orderkey", 7).select("o_orderkey", "o_orderstatus")


_LISTING = "li AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'Note ' ELSE 'note ' END || (user_id // 2) || CASE WHEN event_id % 3 > 0 THEN ' (' || (event_id % 3) || ')' ELSE '' END || '.md' AS name, date_trunc('hour', ts) AS mtime FROM events)"


def _listing(spark, d):
    copy = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit(" ("), (F.col("event_id") % 3).cast("string"), F.lit(")"))).otherwise("")
    name = F.concat(F.when(F.col("user_id") % 2 == 0, "Note ").otherwise("note "), F.floor(F.col("user_id") / 2).cast("string"), copy, F.lit(".md"))
    return read(spark, d, "events").select(name.alias("name"), F.date_trunc("hour", "ts").alias("mtime"))


_BASE = r"lower(regexp_replace(name, ' \(\d+\)\.md$', '.md'))"


@query(rf"""WITH {_LISTING}, b AS (SELECT {_BASE} AS base, name, mtime, row_number() OVER (PARTITION BY {_BASE} ORDER BY mtime DESC, lower(name) = {_BASE} DESC, name) AS r FROM li)
SELECT base, name, CAST(epoch(mtime) AS BIGINT) AS mtime FROM b WHERE r = 1""")
def sync_newest(spark, d):
    r = catalog.latest_by_name(_listing(spark, d))
    return r.select("base", "name", F.unix_timestamp("mtime").alias("mtime"))


@query(rf"""WITH {_LISTING}, x AS (SELECT DISTINCT {_BASE} AS base, name, mtime, lower(name) = {_BASE} AS own FROM li),
o AS (SELECT base, max(mtime) AS bm FROM x WHERE own GROUP BY base),
n AS (SELECT x.*, row_number() OVER (PARTITION BY base ORDER BY mtime DESC, name DESC) AS r FROM x WHERE NOT own)
SELECT base, name, CAST(epoch(mtime) AS BIGINT) AS mtime, CASE WHEN r = 1 AND (bm IS NULL OR bm < mtime) THEN 'replace' ELSE 'delete' END AS action FROM n LEFT JOIN o USING (base)""")
def sync_residual(spark, d):
    r = catalog.reconcile(_listing(spark, d).distinct())
    return r.select("base", "name", F.unix_timestamp("mtime").alias("mtime"), "action")


_LINES = "ln AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(CASE doc_id % 5 WHEN 0 THEN '# ' WHEN 1 THEN '- ' WHEN 2 THEN '12. ' WHEN 3 THEN '### ' ELSE '' END || replace(text, chr(13), ''), chr(10)) AS l FROM documents))"


def _lines(spark, d):
    mark = F.element_at(F.array(*map(F.lit, ("# ", "- ", "12. ", "### ", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    return read(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.concat(mark, F.regexp_replace("text", "\r", "")), "\n")).alias("pos", "line"))


@query(rf"""WITH {_LINES}, k AS (SELECT *, CASE WHEN trim(line) = '' THEN 'blank' WHEN line LIKE '### %' THEN 'h3' WHEN line LIKE '## %' THEN 'h2' WHEN line LIKE '# %' THEN 'h1'
WHEN line LIKE '- %' OR line LIKE '* %' THEN 'bullet' WHEN regexp_matches(line, '^\d+\.\s') THEN 'number' ELSE 'text' END AS kind FROM ln)
SELECT doc_id, pos, kind, CASE kind WHEN 'h3' THEN line[5:] WHEN 'h2' THEN line[4:] WHEN 'h1' THEN line[3:] WHEN 'bullet' THEN '• ' || line[3:] WHEN 'blank' THEN '' ELSE line END AS text FROM k""")
def markdown_lines(spark, d):
    return _lines(spark, d).select("doc_id", "pos", tx.line_class(F.col("line")).alias("kind"), tx.line_text(F.col("line")).alias("text"))


@query(f"""WITH {_LINES} SELECT doc_id, CAST(least(greatest(max(length(line) + length(regexp_replace(line, '[\\x{{0000}}-\\x{{2E80}}]', '', 'g'))) * 8 + 20, CASE WHEN doc_id % 2 = 0 THEN 88 ELSE 72 END), 280) AS INT) AS width
FROM ln GROUP BY doc_id""")
def column_width(spark, d):
    return grid.column_widths(_lines(spark, d), ["doc_id"], "line", F.col("doc_id") % 2 == 0)


_CELLS = "ce AS (SELECT l_orderkey, l_linenumber AS c, max(l_quantity) AS q FROM lineitem GROUP BY ALL)"


def _cells(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("c")).agg(F.max("l_quantity").alias("q"))


@query(f"""WITH {_CELLS}, r AS (SELECT l_orderkey, map_from_entries(list({{'k': c, 'v': CAST(CAST(q AS INT) AS VARCHAR)}})) AS m, least(max(c) + 1, 5) AS w FROM ce GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_transform(range(w), lambda i: coalesce(m[CAST(i AS INT)], '')), '|') AS cells FROM r""")
def dense_row(spark, d):
    rows = _cells(spark, d).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("c", F.col("q").cast("int").cast("string")))).alias("m"))
    return rows.select("l_orderkey", F.array_join(grid.dense_row(F.col("m"), 5), "|").alias("cells"))


@query(f"""WITH {_CELLS} SELECT l_orderkey, CAST(least(count(*), 3) AS INT) AS kept, count(*) > 3 AS truncated FROM ce GROUP BY l_orderkey""")
def row_limit(spark, d):
    rows = _cells(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.array(F.col("c").cast("string"), F.col("q").cast("string")))).alias("g"))
    cut = rows.select("l_orderkey", grid.limit_rows(F.col("g"), 3, 2).alias("x"))
    return cut.select("l_orderkey", F.size("x.rows").alias("kept"), "x.truncated")


@query(f"""WITH {_CELLS}, g AS (SELECT l_orderkey, c, [CASE WHEN c % 2 = 0 THEN ' ' ELSE 'a' || c END, CASE WHEN c % 4 = 3 THEN 'b' ELSE '' END, ''] AS r FROM ce),
k AS (SELECT * FROM g WHERE trim(r[1]) <> '' OR r[2] <> ''),
u AS (SELECT l_orderkey, bool_or(trim(r[1]) <> '') AS one, bool_or(r[2] <> '') AS two FROM k GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(string_agg(array_to_string(list_concat(CASE WHEN one THEN [r[1]] ELSE [] END, CASE WHEN two THEN [r[2]] ELSE [] END), chr(9)), chr(10) ORDER BY c), '') AS cells
FROM (SELECT DISTINCT l_orderkey FROM ce) LEFT JOIN u USING (l_orderkey) LEFT JOIN k USING (l_orderkey) GROUP BY l_orderkey""")
def compact_grid(spark, d):
    c = F.col("c")
    row = F.array(F.when(c % 2 == 0, " ").otherwise(F.concat(F.lit("a"), c.cast("string"))), F.when(c % 4 == 3, "b").otherwise(""), F.lit(""))
    rows = _cells(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("c", row.alias("r")))).alias("g"))
    return rows.select("l_orderkey", grid.grid_text(grid.compact_grid(F.transform("g", lambda x: x["r"]))).alias("cells"))


@query("""WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS VARCHAR) || CASE WHEN l_linenumber = 1 THEN '00000001' ELSE '' END AS raw FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, raw, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS text
FROM (SELECT *, floor(CAST(raw AS DOUBLE) * 10000 + 0.5) / 10000 AS v FROM r)""")
def format_number(spark, d):
    raw = F.concat(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.when(F.col("l_linenumber") == 1, "00000001").otherwise(""))
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", raw.alias("raw")).withColumn("text", grid.format_number(F.col("raw")))


@query("""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CASE WHEN p_partkey >= 26 THEN chr(CAST(64 + p_partkey // 26 % 26 + 1 AS INT)) ELSE '' END || chr(CAST(65 + p_partkey % 26 AS INT)) || p_size END AS ref,
CAST(CASE WHEN p_partkey >= 26 THEN (p_partkey // 26 % 26 + 1) * 26 ELSE 0 END + p_partkey % 26 AS INT) AS i FROM part)
SELECT p_partkey, ref, CASE WHEN ref IS NULL THEN -1 ELSE i END AS col FROM r""")
def column_ref(spark, d):
    k = F.col("p_partkey")
    ref = F.concat(F.when(k >= 26, F.char((F.floor(k / 26) % 26 + 65).cast("int"))).otherwise(""), F.char((k % 26 + 65).cast("int")), F.col("p_size").cast("string"))
    return read(spark, d, "part").select("p_partkey", F.when(k % 7 == 0, None).otherwise(ref).alias("ref")).withColumn("col", grid.column_index(F.col("ref")))


@query("""WITH r AS (SELECT item_id, text, CAST(s AS INT) AS s, coalesce(lead(s) OVER (PARTITION BY item_id ORDER BY s), length(text)) AS e FROM (
SELECT item_id, text, unnest([0, length(text) // 3, length(text) // 3 * 2]) AS s FROM benchmark))
SELECT item_id, s, substr(text, s + 1, e - s) AS segment, CASE WHEN s = 0 THEN 12.0 ELSE 10.5 END::DOUBLE AS size_pt FROM r""")
def run_segmentation(spark, d):
    third = F.floor(F.length("text") / 3).cast("int")
    runs = read(spark, d, "benchmark").select("item_id", "text", F.explode(F.array(F.lit(0), third, third * 2)).alias("s"))
    shapes = F.array(F.lit(12.0), F.lit(10.5))
    out = geometry.segment_runs(runs, "item_id", "s", F.length("text"), F.col("text"))
    return out.select("item_id", "s", "segment", F.coalesce(F.get(shapes, F.when(F.col("s") == 0, 0).otherwise(1)), F.lit(10.0)).alias("size_pt"))


def _channel_sql(rgb: str, f: str) -> str:
    part = lambda s: f"CAST(floor(least(greatest({f.format(x=f'CAST(({rgb} >> {s}) & 255 AS FLOAT) / 255::FLOAT')}, 0::FLOAT), 1::FLOAT) * 255::FLOAT + 0.5::FLOAT) AS INT)"
    return f"(({part(16)} << 16) | ({part(8)} << 8) | {part(0)})"


_RGB = "CAST(p_partkey * 7919 % 16777216 AS INT)"


@query(f"""WITH a AS (SELECT p_partkey, {_RGB} AS rgb, CASE WHEN p_size % 3 > 0 THEN p_size * 2000 END AS m, CASE WHEN p_size % 3 = 1 THEN p_size * 500 END AS o FROM part),
b AS (SELECT *, CASE WHEN m IS NULL THEN rgb ELSE {_channel_sql('rgb', '({x} * (CAST(m AS FLOAT) / 100000::FLOAT))')} END AS r1 FROM a),
c AS (SELECT *, CASE WHEN o IS NULL THEN r1 ELSE {_channel_sql('r1', '({x} + (CAST(o AS FLOAT) / 100000::FLOAT))')} END AS r2 FROM b)
SELECT p_partkey, CAST(r2 AS INT) AS rgb FROM c""")
def color_transform(spark, d):
    rgb = (F.col("p_partkey") * 7919 % 16777216).cast("int")
    none = F.lit(None).cast("int")
    mod = F.when(F.col("p_size") % 3 > 0, F.col("p_size") * 2000)
    off = F.when(F.col("p_size") % 3 == 1, F.col("p_size") * 500)
    return read(spark, d, "part").select("p_partkey", geometry.adjust_colour(rgb, mod, off, none, none).alias("rgb"))


@query(f"SELECT p_partkey, CAST((({_RGB} & 255) << 16) | ({_RGB} & 65280) | (({_RGB} >> 16) & 255) AS INT) AS rgb FROM part")
def bgr_to_rgb(spark, d):
    return read(spark, d, "part").select("p_partkey", geometry.swap_red_blue((F.col("p_partkey") * 7919 % 16777216).cast("int")).alias("rgb"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_partkey * 100) / 12192000.0::DOUBLE AS x, (l_suppkey * 50) / 6858000.0::DOUBLE AS y,
(l_quantity * 10000) / 12192000.0::DOUBLE AS w, (l_linenumber * 90000) / 6858000.0::DOUBLE AS h FROM lineitem""")
def rect_normalize(spark, d):
    r = geometry.normalize_rect(F.col("l_partkey") * 100, F.col("l_suppkey") * 50, F.col("l_quantity") * 10000, F.col("l_linenumber") * 90000, F.lit(12192000.0), F.lit(6858000.0))
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r.alias("r")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "r.*")


@query("""WITH RECURSIVE e AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn * 37 % 500 AS y, CASE WHEN turn % 3 = 0 THEN 0 ELSE length(text) % 300 END AS h FROM conversations),
f AS (SELECT conv_id, 0::BIGINT AS i, 50::BIGINT AS a FROM (SELECT DISTINCT conv_id FROM e)
UNION ALL SELECT f.conv_id, e.i, CASE WHEN e.h > 0 THEN least(900, e.y + e.h + 20) ELSE f.a END FROM f JOIN e ON e.conv_id = f.conv_id AND e.i = f.i + 1)
SELECT conv_id, arg_max(a, i) AS cursor FROM f GROUP BY conv_id""")
def layout_cursor(spark, d):
    e = F.struct("turn", (F.col("turn") * 37 % 500).alias("y"), F.when(F.col("turn") % 3 == 0, 0).otherwise(F.length("text") % 300).alias("h"))
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(e)).alias("e"))
    return c.select("conv_id", geometry.layout_cursor(F.col("e")).alias("cursor"))


@query("""WITH RECURSIVE e AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CAST(length(text) % 4 AS INT) AS level, length(text) % 5 = 0 AS ctrl FROM conversations),
f AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS turn, -1 AS skip, FALSE AS shown FROM (SELECT DISTINCT conv_id FROM e)
UNION ALL SELECT f.conv_id, e.i, e.turn, CASE WHEN ctrl AND (skip < 0 OR level <= skip) THEN level WHEN level <= skip THEN -1 ELSE skip END, NOT (skip >= 0 AND level > skip)
FROM f JOIN e ON e.conv_id = f.conv_id AND e.i = f.i + 1)
SELECT conv_id, CAST(turn AS INT) AS turn FROM f WHERE i > 0 AND shown""")
def excluded_scope(spark, d):
    r = F.struct("turn", F.col("turn").cast("int").alias("pos"), (F.length("text") % 4).cast("int").alias("level"), (F.length("text") % 5 == 0).alias("ctrl"))
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(r)).alias("r"))
    return c.select("conv_id", F.explode(geometry.visible(F.col("r"))).alias("turn"))


@query(f"""WITH RECURSIVE {_CELLS}, e AS (SELECT l_orderkey, c, CASE WHEN CAST(q AS INT) % 3 = 0 THEN c * 2 END AS ref, row_number() OVER (PARTITION BY l_orderkey ORDER BY c) AS i FROM ce),
f AS (SELECT l_orderkey, c, i, coalesce(ref, 0) AS col FROM e WHERE i = 1
UNION ALL SELECT e.l_orderkey, e.c, e.i, coalesce(e.ref, f.col + 1) FROM f JOIN e ON e.l_orderkey = f.l_orderkey AND e.i = f.i + 1)
SELECT l_orderkey, c, CAST(col AS INT) AS col FROM f""")
def column_cursor(spark, d):
    cells = _cells(spark, d).select("l_orderkey", "c", F.when(F.col("q").cast("int") % 3 == 0, F.col("c") * 2).alias("ref"))
    return geometry.fill_columns(cells, ["l_orderkey"], "c", "ref").select("l_orderkey", "c", "col")


@query(r"""WITH t AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '../media/' WHEN 1 THEN '/ppt/' WHEN 2 THEN 'ppt/' ELSE '' END || split_part(url, '/', 3) || CASE WHEN page_id % 8 = 0 THEN '/../x.xml' ELSE '.xml' END AS t FROM pages)
SELECT page_id, t AS target, CASE page_id % 4 WHEN 0 THEN CASE WHEN page_id % 8 = 0 THEN 'ppt/media/x.xml' ELSE 'ppt/media/' || t[10:] END WHEN 1 THEN t[2:] WHEN 2 THEN t ELSE 'ppt/slides/' || t END AS path FROM t""")
def rels_resolve(spark, d):
    k = F.col("page_id")
    lead = F.element_at(F.array(*map(F.lit, ("../media/", "/ppt/", "ppt/", ""))), (k % 4 + 1).cast("int"))
    t = F.concat(lead, F.split_part("url", F.lit("/"), F.lit(3)), F.when(k % 8 == 0, "/../x.xml").otherwise(".xml"))
    return read(spark, d, "pages").select("page_id", t.alias("target")).withColumn("path", geometry.resolve_path(F.lit("ppt/slides/"), F.col("target")))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN regexp_replace(text, '[^\x00-\x7F]', '한', 'g') || '가나다 끝' ELSE text END AS text FROM documents")
def decode_text(spark, d):
    """Stored as UTF-8 with a mark, UTF-8 and EUC-KR; that has Korean in place of other letters."""
    registry.allow_charsets(spark)
    korean = F.concat(F.regexp_replace("text", r"[^\x00-\x7F]", "한"), F.lit("가나다 끝"))
    utf8 = F.encode("text", "UTF-8")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).when(F.col("doc_id") % 3 == 1, utf8).otherwise(F.encode(korean, "EUC-KR"))
    return read(spark, d, "documents").select("doc_id", tx.decode_bytes(raw).alias("text"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' WHEN 3 THEN 'bmp' WHEN 4 THEN 'webp' END AS type FROM part""")
def magic_type(spark, d):
    heads = ("89504E470D0A1A0A", "FFD8FFE0", "47494638", "424D0000", "52494646000000005745425000", "00112233")
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", tx.image_type(F.unhex(head)).alias("type"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'image' WHEN doc_id % 5 = 0 THEN 'pdf' WHEN doc_id % 3 = 0 THEN 'slides' WHEN doc_id % 2 = 0 THEN 'markdown' WHEN lang = 'de' THEN 'blocks' ELSE 'text' END AS view_mode FROM documents""")
def view_mode(spark, d):
    k = F.col("doc_id")
    return read(spark, d, "documents").select("doc_id", tx.view_mode(F.when(k % 7 == 0, "i"), F.when(k % 5 == 0, "p"), k % 3 == 0, k % 2 == 0, F.col("lang") == "de").alias("view_mode"))


@query(f"WITH {_NAMED}, x AS (SELECT doc_id, {_DETECT} AS f FROM nm) SELECT doc_id, {_LABEL} AS label FROM x")
def format_label(spark, d):
    return _named(spark, d).select("doc_id", tx.format_label(tx.detect_format(F.col("name"), F.col("mime"))).alias("label"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE 0 END AS level,
CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 WHEN 'P' THEN 0 ELSE 1 END AS align, o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 AS bold FROM orders""")
def paragraph_style(spark, d):
    k = F.col("o_orderkey")
    style = F.element_at(F.array(*map(F.lit, ("Heading 2", "heading9", "제목 3", "Normal", "Normal"))), (k % 5 + 1).cast("int"))
    outline = F.when(k % 5 == 3, "0")
    code = F.when(F.col("o_orderstatus") == "F", "center").when(F.col("o_orderstatus") == "O", "end").when(F.col("o_orderstatus") == "P", "both")
    return read(spark, d, "orders").select("o_orderkey", tx.heading_level(style, outline).alias("level"), tx.alignment(code).alias("align"),
                                           tx.toggle(k % 2 == 0, F.when(k % 3 == 0, "0")).alias("bold"))


@query(f"""WITH {_CELLS}, g AS (SELECT l_orderkey, max(c) AS w, count(*) AS n FROM ce GROUP BY l_orderkey)
SELECT l_orderkey, c, CASE WHEN c = 1 THEN 'x' ELSE '' END AS second, c - 1 = 0 AND w >= 2 AS label FROM ce JOIN g USING (l_orderkey)""")
def cell_roles(spark, d):
    cells = _cells(spark, d)
    widths = cells.groupBy("l_orderkey").agg(F.max("c").alias("w"))
    g = F.array(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("x")))
    c = cells.join(widths, "l_orderkey")
    return c.select("l_orderkey", "c", grid.cell(g, F.when(F.col("c") == 1, 1).otherwise(0), F.lit(1)).alias("second"), grid.is_label(F.col("c") - 1, F.col("w"), F.lit("short")).alias("label"))


# ---- parts of files, settings and model calls


@query("SELECT o_orderkey, coalesce(nullif(trim(k), ''), 'default-model') AS model FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' m' || o_orderkey || ' ' END AS k FROM orders)")
def settings_defaults(spark, d):
    k = F.col("o_orderkey")
    value = F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.concat(F.lit(" m"), k.cast("string"), F.lit(" ")))
    return read(spark, d, "orders").select("o_orderkey", model.setting(value, F.lit("default-model")).alias("model"))


@query(f"""WITH {_TRANSCRIPT} SELECT conv_id, CAST(to_json({{'model': 'm', 'temperature': 0.2::DOUBLE, 'messages': [{{'role': 'system', 'content': {lit(prompts.MINUTES_SYSTEM)}}}, {{'role': 'user', 'content': {lit(prompts.MINUTES_USER)} || text}}]}}) AS VARCHAR) AS request FROM tr""")
def model_request(spark, d):
    p = prompts.minutes(_transcripts(spark, d), "conv_id", "text")
    return p.select("conv_id", model.request("m", F.col("system"), F.col("user")).alias("request"))


@query("""SELECT conv_id, CASE WHEN conv_id % 7 <> 0 THEN trim(text) END AS answer, CASE WHEN conv_id % 7 = 0 THEN '오류: LLM 요청 실패 (500): ' || left(repeat('no ', 200), 300) END AS error
FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id)""")
def model_answer(spark, d):
    """Answers of a model that repeats the prompt and is down for every seventh conversation."""
    first = read(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    p = first.select("conv_id", F.when(F.col("conv_id") % 7 == 0, "down").otherwise("up").alias("system"), F.col("text").alias("user"))
    return model.complete(p, "conv_id", "m", _echo)


def _echo(request: str) -> tuple[int, str]:
    import json

    system, user = (m["content"] for m in json.loads(request)["messages"])
    return (500, "no " * 200) if system == "down" else (200, json.dumps({"choices": [{"message": {"content": f" {user} "}}]}))


@query("SELECT event_id, event_type || ' · ' || month(ts) || '월 ' || day(ts) || '일' AS caption FROM events")
def list_caption(spark, d):
    return read(spark, d, "events").select("event_id", tx.caption(F.col("event_type"), F.col("ts")).alias("caption"))


@query(rf"WITH {_LISTING} SELECT count(DISTINCT {_BASE}) AS n FROM li")
def synced_count(spark, d):
    return catalog.latest_by_name(_listing(spark, d)).agg(F.count("*").alias("n"))


@query("SELECT doc_id, text FROM documents WHERE doc_id % 18 IN (9, 10, 11, 12, 13)")
def edit_gate(spark, d):
    """Only text and Markdown may be written back."""
    return _named(spark, d).where(tx.editable(tx.format_of_name(F.col("name")))).select("doc_id", "text")


@query("SELECT doc_id, coalesce(text, '문서를 찾을 수 없습니다.') AS text FROM (SELECT 17 AS doc_id UNION ALL SELECT -1) x LEFT JOIN documents USING (doc_id)")
def point_lookup(spark, d):
    wanted = spark.createDataFrame([(17,), (-1,)], "doc_id long")
    found = read(spark, d, "documents").where(F.col("doc_id").isin(17, -1)).select("doc_id", "text")
    return wanted.join(found, "doc_id", "left").select(F.col("doc_id").cast("int").alias("doc_id"), F.coalesce("text", F.lit("문서를 찾을 수 없습니다.")).alias("text"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'DOCX' WHEN 1 THEN 'ODF' WHEN 2 THEN 'HWPX' WHEN 3 THEN 'TXT' ELSE 'MARKDOWN' END AS format,
CASE doc_id % 5 WHEN 3 THEN array_to_string(l, chr(10)) WHEN 4 THEN array_to_string(l, chr(10)) WHEN 0 THEN regexp_replace(array_to_string(list_filter(l, lambda x: trim(x) <> ''), chr(10)), '^\\s+|\\s+$', '', 'g')
ELSE regexp_replace(regexp_replace(array_to_string(list_transform(l, lambda x: regexp_replace(x, '[\\t ]+$', '')), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') END AS plain_text, CAST(NULL AS VARCHAR) AS warning FROM l""".replace("\\\\", "\\"))
def parse_containers(spark, d):
    """documents written as files of five formats and parsed back."""
    from parchment.sources import registry, writers

    raw = writers.as_files(read(spark, d, "documents"), "doc_id", "text")
    c = registry.parse(raw)
    return c.select(F.regexp_extract("uri", r"(\d+)\.\w+$", 1).cast("long").alias("doc_id"), "format", "plain_text", "warning")


@query("SELECT doc_id, 'word/document.xml' AS name FROM documents WHERE doc_id % 5 = 0")
def zip_entries(spark, d):
    from parchment.sources import registry, writers

    raw = writers.as_files(read(spark, d, "documents"), "doc_id", "text")
    return registry.entries(raw, r"word/.*\.xml").select(F.regexp_extract("uri", r"(\d+)\.\w+$", 1).cast("long").alias("doc_id"), "name")


_SPAN = r"(?s)\*\*.*?\*\*|\*[^*]+\*|`[^`]*`"


@query(f"""WITH {_LINES}, h AS (SELECT doc_id, pos AS line_pos, ['**', '*', '`'][doc_id % 3 + 1] AS m, line, CAST(floor(length(line) / 2) AS INT) AS half FROM ln),
l AS (SELECT doc_id, line_pos, m || left(line, half) || m || substr(line, half + 1) || '*' AS line FROM h),
x AS (SELECT doc_id, line_pos, string_split_regex(line, {lit(_SPAN)}) AS plain, regexp_extract_all(line, {lit(_SPAN)}) AS marked FROM l),
s AS (SELECT doc_id, line_pos, unnest(range(len(plain))) AS i, unnest(plain) AS p, unnest(list_concat(marked, [NULL])) AS q FROM x),
u AS (SELECT doc_id, line_pos, 2 * i AS i, p AS text, 'plain' AS style FROM s WHERE p <> '' UNION ALL
  SELECT doc_id, line_pos, 2 * i + 1, CASE WHEN q LIKE '**%' THEN substr(q, 3, length(q) - 4) ELSE substr(q, 2, length(q) - 2) END, CASE WHEN q LIKE '**%' THEN 'bold' WHEN q LIKE '*%' THEN 'italic' ELSE 'code' END FROM s WHERE q IS NOT NULL)
SELECT doc_id, line_pos, CAST(row_number() OVER (PARTITION BY doc_id, line_pos ORDER BY i) - 1 AS INT) AS pos, text, style FROM u""")
def markdown_spans(spark, d):
    """Bold, italic and code stretches of all Markdown lines, whose first half gets a mark."""
    mark = F.element_at(F.array(*map(F.lit, ("**", "*", "`"))), (F.col("doc_id") % 3 + 1).cast("int"))
    half = F.floor(F.length("line") / 2).cast("int")
    line = F.concat(mark, F.left("line", half), mark, F.substr("line", half + 1), F.lit("*"))
    lines = _lines(spark, d).select("doc_id", F.col("pos").alias("line_pos"), line.alias("line"))
    return lines.select("doc_id", "line_pos", F.posexplode(tx.markdown_spans(F.col("line"))).alias("pos", "s")).select("doc_id", "line_pos", "pos", "s.text", "s.style")


@query(f"WITH {_NAMED}, x AS (SELECT doc_id, {_DETECT} AS f FROM nm) SELECT doc_id, CASE f " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in tx.BADGES.items())
       + " END AS badge, CASE f " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in tx.COLOURS.items()) + " END AS rgb FROM x")
def format_badge(spark, d):
    return _named(spark, d).select("doc_id", tx.badge(tx.detect_format(F.col("name"), F.col("mime"))).alias("b")).select("doc_id", "b.*")


@query(f"""WITH {_NAMED} SELECT sha256('drive:/' || name) AS id, 'drive:/' || name AS uri, name, CASE WHEN doc_id % 10 = 9 THEN 'UNKNOWN' ELSE {_DETECT} END AS format, doc_id * 1000 AS imported_at FROM nm""")
def catalog_json(spark, d):
    """Imported files, written as JSON with some formats no longer known, and read back."""
    n = _named(spark, d).select(F.concat(F.lit("drive:/"), "name").alias("uri"), "name", "mime", "doc_id")
    c = store.imported(n.drop("doc_id"), F.lit(None).cast("timestamp")).drop("imported_at").join(n.select("uri", "doc_id"), "uri")
    c = c.select("id", "uri", "name", F.when(F.col("doc_id") % 10 == 9, "WORDSTAR").otherwise(F.col("format")).alias("format"), F.timestamp_seconds("doc_id").alias("imported_at"))
    back = store.from_json(store.to_json(c))
    return back.withColumn("imported_at", F.unix_millis("imported_at"))


from parchment import file_queries  # noqa: E402, F401  registers the queries over files
