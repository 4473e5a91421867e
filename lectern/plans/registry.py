"""Registered queries of the engine's own operators, each with its SQL for DuckDB.

The driver's documents have no Indic text and no verse markers, so lookups run on
a derived corpus: every seventh line becomes a verse header and every fortieth a
chapter header, by the same rule in both engines.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import lexicon as lex
from lectern.functions import questions as qs
from lectern.functions import regexes as rx
from lectern.functions import text as tx
from lectern.operators import cells, chunking, index, routing, search, structure, vectors
from lectern.plans import documents as plans
from lectern.sources import files as src
from lectern.sources import ocr, pages

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a stored table, in the shared folder of the session; the warehouse's where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


# Pieces of SQL that several oracles share.
def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{rx.SPACE}+|{rx.SPACE}+$', '', 'g')"


def sql_terms(c: str, longer: int = 0) -> str:
    found = f"regexp_extract_all(lower({c}), '{rx.WORD}+')"
    return f"list_filter({found}, lambda t: length(t) > {longer})" if longer else found


def sql_count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def sql_sentences(c: str) -> str:
    flat = f"trim(regexp_replace({c}, '{rx.SPACE}+', ' ', 'g'))"
    return f"(CASE WHEN {flat} = '' THEN [] ELSE string_split(regexp_replace({flat}, '([.!?।॥])\\s+', '\\1' || chr(1), 'g'), chr(1)) END)"


LINES_SQL = f"""
split AS (SELECT doc_id, string_split(regexp_replace(text, '{rx.LINE}', chr(1), 'g'), chr(1)) AS parts FROM documents),
raw AS (SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS part FROM split),
lines AS (SELECT doc_id, line_no::INT AS line_no, {sql_strip("part")} AS line FROM raw WHERE {sql_strip("part")} NOT IN ('', '---'))"""
MARKED_SQL = f"""{LINES_SQL},
marked AS (SELECT doc_id, line_no, CASE WHEN line_no % 40 = 3 THEN 'chapter ' || (line_no // 40 + 1) || ' ' || line WHEN line_no % 7 = 1 THEN 'Verse ' || translate(CASE WHEN line_no % 3 = 0 THEN '0' ELSE '' END || (line_no // 7 + 1)::VARCHAR, '0123456789', '{lex.GUJARATI_DIGITS}') || ': ' || line ELSE line END AS line FROM lines),
plain AS (SELECT *, translate(line, '{lex.GUJARATI_DIGITS}{lex.DEVANAGARI_DIGITS}', '01234567890123456789') AS p FROM marked)"""


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tx.line_stream(docs_of(spark, sf_dir), "doc_id")
    number = lambda n: (F.floor(F.col("line_no") / n) + 1).cast("string")
    chapter = F.concat(F.lit("chapter "), number(40), F.lit(" "), "line")
    # Some numbers have a zero in front: nobody asks for these.
    padded = F.concat(F.when(F.col("line_no") % 3 == 0, "0").otherwise(""), number(7))
    verse = F.concat(F.lit("Verse "), F.translate(padded, "0123456789", lex.GUJARATI_DIGITS), F.lit(": "), "line")
    return lines.withColumn("line", F.when(F.col("line_no") % 40 == 3, chapter).when(F.col("line_no") % 7 == 1, verse).otherwise(F.col("line")))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of a search: user turns of the conversations whose id is divisible by 50."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'user' AND conv_id % 50 = 0")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")


ASKED_SQL = "asked AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user' AND conv_id % 50 = 0)"


# --- Text -----------------------------------------------------------------


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, line FROM lines")
def line_stream(spark, sf_dir):
    return tx.line_stream(docs_of(spark, sf_dir), "doc_id")


@query(f"SELECT doc_id, md5(translate(translate(text, '0123456789', '{lex.GUJARATI_DIGITS}') || ' {lex.DEVANAGARI_DIGITS}', '{lex.GUJARATI_DIGITS}{lex.DEVANAGARI_DIGITS}', '01234567890123456789')) AS digest FROM documents")
def normalize_digits(spark, sf_dir):
    written = F.concat(F.translate("text", "0123456789", lex.GUJARATI_DIGITS), F.lit(" " + lex.DEVANAGARI_DIGITS))
    return docs_of(spark, sf_dir).select("doc_id", F.md5(tx.normalize_digits(written)).alias("digest"))


@query(f"SELECT doc_id, {sql_count('text', rx.TOKEN)} AS n_tokens, len({sql_terms('text')}) AS n_terms, len(list_distinct({sql_terms('text', 2)})) AS n_distinct FROM documents")
def token_counts(spark, sf_dir):
    c = F.col("text")
    return docs_of(spark, sf_dir).select("doc_id", tx.token_count(c).cast("long").alias("n_tokens"), F.size(tx.terms(c)).cast("long").alias("n_terms"), F.size(F.array_distinct(tx.terms(c, 2))).cast("long").alias("n_distinct"))


@query(f"WITH s AS (SELECT doc_id, {sql_sentences('text')} AS s FROM documents) SELECT doc_id, unnest(range(len(s)))::INT AS sent_no, unnest(s) AS sentence FROM s")
def sentence_split(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("sent_no", "sentence"))


GARBLED_SQL = f"(NOT regexp_matches(text, '{rx.NOT_SPACE}') OR w / greatest(length(text), 1) > 0.03 OR (i / greatest(length(text), 1) < 0.01 AND w / greatest(length(text), 1) > 0.01))"


@query(f"WITH c AS (SELECT doc_id, text, {sql_count('text', rx.WEIRD)} AS w, {sql_count('text', rx.INDIC)} AS i FROM documents) SELECT doc_id, w AS weird, {GARBLED_SQL} AS garbled FROM c")
def garbled_docs(spark, sf_dir):
    c = F.col("text")
    return docs_of(spark, sf_dir).select("doc_id", F.regexp_count(c, F.lit(rx.WEIRD)).cast("long").alias("weird"), tx.garbled(c).alias("garbled"))


SCRIPT_CASES = ("", "plain ascii words", "શ્લોક ૧", "ÐØÆ mojibake", "naïve café résumé", "શ્લોક ÐØÆ")


@query(f"WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - i, x FROM (VALUES {', '.join(f'({i}, {chr(39)}{x}{chr(39)})' for i, x in enumerate(SCRIPT_CASES))}) v(i, x)), c AS (SELECT *, {sql_count('text', rx.WEIRD)} AS w, {sql_count('text', rx.INDIC)} AS i FROM t) SELECT doc_id, regexp_matches(text, '{rx.INDIC}') AND NOT {GARBLED_SQL} AS preferred FROM c")
def script_filter(spark, sf_dir):
    cases = spark.createDataFrame([(-1 - i, x) for i, x in enumerate(SCRIPT_CASES)], "doc_id long, text string")
    return docs_of(spark, sf_dir).unionByName(cases).select("doc_id", tx.preferred_script(F.col("text")).alias("preferred"))


@query(f"WITH {LINES_SQL} SELECT doc_id, count(*) FILTER (regexp_matches(lower(line), '{lex.any_of(lex.VERSE_TERMS)}')) AS n_verse, count(*) FILTER (regexp_matches(lower(line), '{lex.any_of(lex.CHAPTER_TERMS)}')) AS n_chapter FROM lines GROUP BY doc_id")
def marker_terms(spark, sf_dir):
    lines = tx.line_stream(docs_of(spark, sf_dir), "doc_id")
    return lines.groupBy("doc_id").agg(F.count_if(tx.has_verse_term(F.col("line"))).alias("n_verse"), F.count_if(tx.has_chapter_term(F.col("line"))).alias("n_chapter"))


NORMAL_SQL = f"""
split AS (SELECT doc_id, string_split(regexp_replace(text, '{rx.LINE}', chr(1), 'g'), chr(1)) AS parts FROM documents),
raw AS (SELECT doc_id, unnest(range(len(parts)))::INT AS line_no, unnest(parts) AS part FROM split),
norm AS (SELECT doc_id, line_no, {sql_strip(f"regexp_replace(regexp_replace(replace({sql_strip('part')}, chr(160), ' '), '[ \t]+', ' ', 'g'), '^{rx.SPACE}*(?i:page){rx.SPACE}+{rx.DIGIT}+{rx.SPACE}*$', '')")} AS text FROM raw),
clean AS (SELECT * FROM norm WHERE text <> '')"""


def sql_type(tall: str = "false") -> str:
    return f"""CASE WHEN regexp_matches(text, '{rx.BULLET}') THEN 'bullet'
  WHEN length(text) <= 140 AND (regexp_matches(lower(text), '{rx.NUMBERED}') OR (NOT regexp_matches(text, '{rx.NOT_TITLE}') AND {sql_count("text", rx.NOT_SPACE + "+")} <= 8)
    OR (upper(text) = text AND {sql_count("text", rx.NOT_SPACE + "+")} <= 10 AND length(text) <= 90) OR text LIKE '%:' OR {tall}) THEN 'heading'
  WHEN regexp_matches(text, '{rx.TABLE_ROW}') THEN 'table' ELSE 'paragraph' END"""


LEVEL_SQL = f"""CASE WHEN line_type <> 'heading' THEN NULL WHEN lower(text) LIKE 'chapter%' THEN 1 WHEN regexp_extract(lower(text), '{rx.LEADING_NUMBER}', 1) <> '' THEN least(len(string_split(regexp_extract(lower(text), '{rx.LEADING_NUMBER}', 1), '.')) + 1, 4) ELSE 2 END::INT"""
TYPED_SQL = f"""{NORMAL_SQL},
typed AS (SELECT doc_id, line_no, text, {sql_type()} AS line_type FROM clean),
leveled AS (SELECT *, {LEVEL_SQL} AS level FROM typed)"""
BLOCKS_SQL = f"""{TYPED_SQL},
lagged AS (SELECT *, CASE WHEN line_type = 'paragraph' AND lag(line_type) OVER (PARTITION BY doc_id ORDER BY line_no) = 'paragraph' THEN 0 ELSE 1 END AS new FROM leveled),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS grp FROM lagged),
merged AS (SELECT doc_id, grp, any_value(line_type) AS block_type, any_value(level) AS level, string_agg(CASE WHEN line_type = 'bullet' THEN regexp_replace(text, '{rx.BULLET}', '') ELSE text END, ' ' ORDER BY line_no) AS text FROM grouped GROUP BY doc_id, grp),
blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp)::INT AS block_no, block_type, level, text FROM merged WHERE block_type <> 'bullet' OR text <> '')"""


def cleaned(spark, sf_dir, compatibility=True):
    return src.clean_text_lines(docs_of(spark, sf_dir), "doc_id", compatibility=compatibility)


@query(f"WITH {NORMAL_SQL} SELECT doc_id, line_no, text FROM clean")
def clean_lines(spark, sf_dir):
    return cleaned(spark, sf_dir).select("doc_id", "line_no", "text")


# --- Structure ------------------------------------------------------------


@query(f"WITH {TYPED_SQL} SELECT doc_id, line_no, line_type FROM leveled")
def line_types(spark, sf_dir):
    return structure.classify(cleaned(spark, sf_dir)).select("doc_id", "line_no", "line_type")


@query(f"WITH {TYPED_SQL} SELECT doc_id, line_no, level, text FROM leveled WHERE line_type = 'heading'")
def heading_levels(spark, sf_dir):
    return structure.classify(cleaned(spark, sf_dir)).filter("line_type = 'heading'").select("doc_id", "line_no", "level", "text")


@query(f"WITH {BLOCKS_SQL} SELECT * FROM blocks")
def blocks(spark, sf_dir):
    return plans.text_blocks(docs_of(spark, sf_dir)).select("doc_id", "block_no", "block_type", "level", "text")


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, string_agg(CASE block_type WHEN 'heading' THEN repeat('#', least(greatest(coalesce(level, 1), 1), 6)) || ' ' || text WHEN 'bullet' THEN '- ' || text ELSE text END, chr(10) || chr(10) ORDER BY block_no) AS markdown FROM blocks GROUP BY doc_id")
def markdown_render(spark, sf_dir):
    return plans.process_text(docs_of(spark, sf_dir))


#: The documents' lines as an engine would read them, six to a page: words out of order, odd confidences, tall lines.
WORDS_SQL = f"""{LINES_SQL},
cut AS (SELECT doc_id, line_no AS i, string_split(line, ' ') AS w FROM lines), said AS (SELECT doc_id, i, unnest(range(len(w))) AS j, unnest(w) AS text FROM cut),
words AS (SELECT doc_id, (i // 6 + 1)::INT AS page_number, j::INT AS seq, (i % 6 // 3 + 1)::INT AS block_num, (i % 3 // 2 + 1)::INT AS par_num, (i % 3 + 1)::INT AS line_num, text,
  (j * 37 % 1000)::INT AS l, (i % 6 * 40 + j % 3)::INT AS top, (5 * length(text))::INT AS width, (CASE WHEN i % 11 = 4 THEN 30 ELSE 10 END + j % 4)::INT AS height,
  CASE (i + j) % 17 WHEN 0 THEN '-1' WHEN 1 THEN 'n/a' WHEN 2 THEN '0' ELSE (50 + (i * 7 + j * 3) % 50) || '.5' END AS conf FROM said),
sure AS (SELECT *, coalesce(try_cast(conf AS DOUBLE), -1) AS c FROM words),
ocr AS (SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY block_num, par_num, line_num)::INT AS line_no, string_agg(trim(text), ' ' ORDER BY l, seq) AS text, min(l) AS x0, min(top) AS y0, max(l + width) AS x1, max(top + height) AS y1, avg(c) AS confidence FROM sure WHERE trim(text) <> '' AND c >= 0 GROUP BY doc_id, page_number, block_num, par_num, line_num)"""
OCR_BLOCKS_SQL = f"""{WORDS_SQL},
heights AS (SELECT doc_id, page_number, median(greatest(y1 - y0, 1)::DOUBLE) AS median_height FROM ocr GROUP BY ALL),
typed AS (SELECT *, {sql_type(f"y1 - y0 >= median_height * {structure.TALL}")} AS line_type FROM (SELECT * REPLACE ({sql_strip("text")} AS text) FROM ocr) JOIN heights USING (doc_id, page_number)),
leveled AS (SELECT *, {LEVEL_SQL} AS level, row_number() OVER w AS n, lag(line_type) OVER w AS before, lag(page_number) OVER w AS page FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, y0, x0, line_no)),
grouped AS (SELECT *, sum(CASE WHEN line_type = 'paragraph' AND before = 'paragraph' AND page = page_number THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM leveled),
merged AS (SELECT doc_id, grp, 1 AS side, any_value(line_type) AS block_type, any_value(level) AS level, string_agg(CASE WHEN line_type = 'bullet' THEN regexp_replace(text, '{rx.BULLET}', '') ELSE text END, ' ' ORDER BY n) AS text, min(page_number) AS page_number FROM grouped GROUP BY doc_id, grp
  UNION ALL SELECT doc_id, grp, 0, 'page_break', NULL, 'Page ' || page, page FROM grouped WHERE page <> page_number),
ocr_blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp, side)::INT AS block_no, block_type, level, text, page_number FROM merged WHERE block_type <> 'bullet' OR text <> '')"""


def ocr_words(spark, sf_dir):
    """Words that lie with their document, so lines and blocks of them need no shuffle of words."""
    i, j = F.col("line_no"), F.col("seq")
    words = tx.line_stream(src.dealt(docs_of(spark, sf_dir)), "doc_id").select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("seq", "text"))
    conf = F.when((i + j) % 17 == 0, "-1").when((i + j) % 17 == 1, "n/a").when((i + j) % 17 == 2, "0").otherwise(F.concat((50 + (i * 7 + j * 3) % 50).cast("string"), F.lit(".5")))
    numbers = {
        "page_number": F.floor(i / 6) + 1, "seq": j, "block_num": F.floor(i % 6 / 3) + 1, "par_num": F.floor(i % 3 / 2) + 1, "line_num": i % 3 + 1,
        "left": j * 37 % 1000, "top": i % 6 * 40 + j % 3, "width": 5 * F.char_length("text"), "height": F.when(i % 11 == 4, 30).otherwise(10) + j % 4,
    }
    return words.select("doc_id", "text", conf.alias("conf"), *(c.cast("int").alias(k) for k, c in numbers.items()))


def ocr_lines(spark, sf_dir):
    return ocr.lines_of_words(ocr_words(spark, sf_dir))


def scanned_blocks(spark, sf_dir):
    return structure.assemble(structure.classify(ocr_lines(spark, sf_dir), dealt=True))


@query(f"WITH {WORDS_SQL} SELECT doc_id, page_number, line_no, text, concat_ws(',', x0, y0, x1, y1) AS bbox, round(confidence, 6) AS confidence FROM ocr")
def ocr_line_group(spark, sf_dir):
    return ocr_lines(spark, sf_dir).withColumns({"bbox": F.concat_ws(",", F.col("bbox").cast("array<string>")), "confidence": F.round("confidence", 6)})


@query(f"WITH {WORDS_SQL} SELECT doc_id, page_number, median(greatest(y1 - y0, 1)::DOUBLE) AS median_height FROM ocr GROUP BY ALL")
def page_median_height(spark, sf_dir):
    return structure.page_median_heights(ocr_lines(spark, sf_dir))


@query(f"WITH {WORDS_SQL}, pages AS (SELECT DISTINCT doc_id, unnest(range(1, i // 6 + 3))::INT AS page_number FROM said) SELECT doc_id, page_number, 'Page ' || page_number || ': no OCR lines found; check scan quality or OCR backend availability.' AS note FROM pages ANTI JOIN ocr USING (doc_id, page_number)")
def pages_without_lines(spark, sf_dir):
    """Every document is one page longer than its text; pages of blanks and of doubtful words alone have no lines, either."""
    last = tx.line_stream(docs_of(spark, sf_dir), "doc_id").groupBy("doc_id").agg((F.floor(F.max("line_no") / 6) + 2).cast("int").alias("pages"))
    pages = last.select("doc_id", F.explode(F.sequence(F.lit(1), "pages")).alias("page_number"))
    return src.pages_without_lines(pages, ocr_lines(spark, sf_dir))


@query(f"WITH {OCR_BLOCKS_SQL} SELECT * FROM ocr_blocks")
def ocr_blocks(spark, sf_dir):
    return scanned_blocks(spark, sf_dir).select("doc_id", "block_no", "block_type", "level", "text", "page_number")


@query(f"WITH {WORDS_SQL} SELECT doc_id, page_number, line_no, concat_ws(',', trunc(x0 - 0.5)::INT, y0, trunc(x1 + 1.75)::INT, y1 + 3) AS bbox FROM ocr")
def engine_line_boxes(spark, sf_dir):
    """Engines that give four corners of a skewed line: its box is of their least and greatest."""
    x = lambda i, by: F.get("bbox", F.lit(i)).cast("double") + by
    corners = F.array(F.array(x(0, 0.0), x(1, 0.0)), F.array(x(2, 1.75), x(1, 2.5)), F.array(x(2, 1.0), x(3, 3.0)), F.array(x(0, -0.5), x(3, 1.0)))
    boxes = ocr_lines(spark, sf_dir).select("doc_id", "page_number", "line_no", ocr.polygon_bbox(corners).alias("b"))
    return boxes.select("doc_id", "page_number", "line_no", F.concat_ws(",", F.col("b").cast("array<string>")).alias("bbox"))


@query("SELECT md5(html) AS digest, count(*) AS n FROM pages GROUP BY 1")
def page_files(spark, sf_dir):
    """The table of pages as files of many pages each, read by shares."""
    found = pages.read_pages(spark, f"{sf_dir}/pages.parquet", pages.ParquetRows(column="html"), name="parquet-pages", part_bytes=1 << 20, suffixes=[".parquet"])
    return found.groupBy(F.md5("content").alias("digest")).agg(F.count("*").alias("n"))


#: Each document asks for languages, and its machine has some, by its id.
HINTS = ("eng", "GU", "sa", "xx", "guj", "en", "San")
HAVE = ("eng", "guj", "san")


def sql_distinct(c: str) -> str:
    """The different items of a list in their order."""
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def sql_known(c: str, words: dict) -> str:
    pairs = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items())
    return f"list_transform({c}, lambda x: CASE lower(x) {pairs} END)"


@query(f"""WITH h AS (SELECT doc_id, list_filter({list(HINTS)}, lambda x, i: (doc_id // (2 ** (i - 1))::BIGINT) % 2 = 1) AS hints, list_filter({list(HAVE)}, lambda x, i: (doc_id // (3 ** i)::BIGINT) % 2 = 1) AS have FROM documents),
k AS (SELECT *, list_filter({sql_known("hints", lex.LANGUAGE_ALIASES)}, lambda x: x IS NOT NULL) AS known, list_transform({sql_known("hints", lex.EASYOCR_LANGUAGES)}, lambda x: coalesce(x, 'en')) AS easy FROM h),
d AS (SELECT *, CASE WHEN len(known) > 0 THEN {sql_distinct("known")} ELSE ['eng'] END AS wanted, CASE WHEN len(easy) > 0 THEN {sql_distinct("easy")} ELSE ['en'] END AS e FROM k),
b AS (SELECT *, list_filter(wanted, lambda x: list_contains(have, x)) AS both_ FROM d)
SELECT doc_id, array_to_string(wanted, ',') AS languages, array_to_string(e, ',') AS easyocr, array_to_string(CASE WHEN len(both_) > 0 THEN both_ WHEN list_contains(have, 'eng') THEN ['eng'] ELSE wanted[1:1] END, ',') AS usable FROM b""")
def ocr_languages(spark, sf_dir):
    chosen = lambda words, base, at: F.filter(F.array(*map(F.lit, words)), lambda x, i: F.floor(F.col("doc_id") / F.pow(F.lit(base), i + at)) % 2 == 1)
    rows = docs_of(spark, sf_dir).select("doc_id", chosen(HINTS, 2, 0).alias("hints"), chosen(HAVE, 3, 1).alias("available"))
    return rows.select("doc_id", *(F.array_join(c, ",").alias(k) for k, c in (("languages", ocr.normal_languages(F.col("hints"))), ("easyocr", ocr.easyocr_languages(F.col("hints"))), ("usable", ocr.usable_languages(F.col("hints"), F.col("available"))))))


# --- Chunks ---------------------------------------------------------------

MB_SQL = f"""mb AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INT AS block_no, CASE WHEN line LIKE '#%' THEN 'heading' WHEN line LIKE '- %' THEN 'bullet' ELSE 'paragraph' END AS block_type, CASE WHEN line LIKE '#%' THEN length(regexp_extract(line, '^(#+)', 1)) END::INT AS level, CASE WHEN line LIKE '#%' THEN {sql_strip("regexp_replace(line, '^#+', '')")} WHEN line LIKE '- %' THEN substr(line, 3) ELSE line END AS text, 1 AS page_number FROM md)"""
#: Documents as Markdown: every tenth line from the third is a heading of a level from 1 to 4.
AS_MARKDOWN_SQL = f"""{LINES_SQL},
md AS (SELECT doc_id, line_no, CASE WHEN line_no % 10 = 2 THEN repeat('#', (line_no // 10 % 4 + 1)::INT) || ' ' || line WHEN line_no % 10 = 5 THEN '- ' || line ELSE line END AS line FROM lines),
{MB_SQL}"""


def as_markdown(spark, sf_dir):
    lines = tx.line_stream(docs_of(spark, sf_dir), "doc_id")
    n = F.col("line_no")
    line = F.when(n % 10 == 2, F.concat(F.repeat(F.lit("#"), (F.floor(n / 10) % 4 + 1).cast("int")), F.lit(" "), "line")).when(n % 10 == 5, F.concat(F.lit("- "), "line")).otherwise(F.col("line"))
    lines = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", line.alias("l")))).alias("x"))
    return lines.select("doc_id", F.array_join(F.transform("x", lambda x: x["l"]), "\n").alias("text"))


@query(f"WITH {AS_MARKDOWN_SQL} SELECT * EXCLUDE (page_number) FROM mb")
def markdown_blocks(spark, sf_dir):
    return chunking.markdown_blocks(as_markdown(spark, sf_dir)).drop("page_number")


BLOCK_PATHS_SQL = """heads AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS section, level, CASE WHEN block_type = 'heading' THEN text ELSE '' END AS text FROM mb WHERE block_type IN ('heading', 'page_break')),
paths AS (SELECT doc_id, 0::BIGINT AS section, []::VARCHAR[] AS path FROM (SELECT DISTINCT doc_id FROM mb) UNION ALL SELECT h.doc_id, h.section, CASE WHEN h.text = '' THEN p.path ELSE list_append(p.path[1:greatest(h.level - 1, 0)], h.text) END FROM paths p JOIN heads h ON h.doc_id = p.doc_id AND h.section = p.section + 1)"""
PATHS_SQL = f"RECURSIVE {AS_MARKDOWN_SQL}, {BLOCK_PATHS_SQL}"
SECTION_SQL = "sections AS (SELECT *, sum((block_type IN ('heading', 'page_break'))::INT) OVER (PARTITION BY doc_id ORDER BY block_no) AS section FROM mb)"


@query(f"WITH {PATHS_SQL}, {SECTION_SQL} SELECT DISTINCT s.doc_id, s.section::BIGINT AS section, array_to_string(p.path, ' > ') AS section_path FROM sections s JOIN paths p ON p.doc_id = s.doc_id AND p.section = s.section")
def section_paths(spark, sf_dir):
    found = chunking.section_paths(chunking.markdown_blocks(as_markdown(spark, sf_dir)))
    return found.select("doc_id", "section", F.array_join("section_path", " > ").alias("section_path"))


WINDOW_CONFIG = chunking.ChunkConfig(max_tokens=60, overlap_tokens=15)


@query(f"WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '{rx.TOKEN}') AS t FROM documents), w AS (SELECT doc_id, CASE WHEN len(t) <= 60 THEN [text] ELSE list_transform(range(0, ceil((len(t) - 60) / 45)::INT + 1), lambda i: array_to_string(t[i * 45 + 1 : i * 45 + 60], ' ')) END AS parts FROM t) SELECT doc_id, unnest(range(len(parts)))::INT AS part_no, unnest(parts) AS part FROM w")
def token_windows(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.posexplode(chunking.token_windows(F.col("text"), WINDOW_CONFIG)).alias("part_no", "part"))


_stretch = f"(?:(?:{rx.TOKEN}){rx.SPACE}*)"


@query(f"""WITH s AS (SELECT doc_id, text, length(regexp_extract(text, '^{rx.SPACE}*')) AS lead, regexp_extract_all(text, '{_stretch}{{1,45}}') AS s, regexp_extract_all(text, '{rx.TOKEN}') AS t FROM documents),
w AS (SELECT doc_id, text, s, lead, unnest(range(0, greatest(ceil((len(t) - 60) / 45)::INT, 0) + 1)) AS i FROM s WHERE len(t) > 0),
b AS (SELECT doc_id, text, i, (lead + length(array_to_string(s[1:i], '')))::INT AS start, regexp_extract(array_to_string(s[i + 1 : i + 2], ''), '^{_stretch}{{0,59}}(?:{rx.TOKEN})') AS part FROM w)
SELECT doc_id, i::INT AS part_no, start, start + length(part)::INT AS stop, part, substr(text, start + 1, length(part)) = part AS verbatim FROM b""")
def verbatim_windows(spark, sf_dir):
    """The token windows as they stand in their documents, with where."""
    w = F.posexplode(chunking.verbatim_windows(F.col("text"), WINDOW_CONFIG)).alias("part_no", "w")
    found = docs_of(spark, sf_dir).select("doc_id", "text", w).select("doc_id", "text", "part_no", "w.*")
    return found.select("doc_id", "part_no", "start", "stop", "part", (F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start")) == F.col("part")).alias("verbatim"))


CHUNK_CONFIG = chunking.ChunkConfig(max_tokens=80, overlap_tokens=20)

def sql_chunks(most: int, step: int) -> str:
    return f"""body AS (SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id, section ORDER BY block_no) AS i, block_no, text, {sql_count("text", rx.TOKEN)} AS n FROM sections WHERE block_type NOT IN ('heading', 'page_break') AND text <> ''),
packed AS (SELECT doc_id, section, i, block_no, text, n AS total, 0 AS bin, n AS held FROM body WHERE i = 1 UNION ALL SELECT b.doc_id, b.section, b.i, b.block_no, b.text, p.total + b.n, CASE WHEN p.held >= {most} THEN p.bin + 1 ELSE p.bin END, CASE WHEN p.held >= {most} THEN b.n ELSE p.held + b.n END FROM packed p JOIN body b ON b.doc_id = p.doc_id AND b.section = p.section AND b.i = p.i + 1),
bins AS (SELECT doc_id, section, bin, max(held) >= {most} AS full_bin, max(block_no) AS last, string_agg(text, ' ' ORDER BY i) AS text FROM packed GROUP BY ALL),
toks AS (SELECT *, regexp_extract_all(text, '{rx.TOKEN}') AS t FROM bins),
parts AS (SELECT doc_id, section, bin, full_bin, last, CASE WHEN len(t) <= {most} THEN [text] ELSE list_transform(range(0, ceil((len(t) - {most}) / {step})::INT + 1), lambda i: array_to_string(t[i * {step} + 1 : i * {step} + {most}], ' ')) END AS parts FROM toks),
counted AS (SELECT *, coalesce(sum(CASE WHEN full_bin THEN len(parts) ELSE 0 END) OVER w, 0) + 1 AS counter, coalesce(sum(len(parts)) OVER w, 0) AS done FROM parts WINDOW w AS (PARTITION BY doc_id ORDER BY section, bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (SELECT doc_id, section, min(block_no) AS b FROM sections GROUP BY ALL), ended AS (SELECT doc_id, max(block_no) AS b FROM mb GROUP BY doc_id),
turned AS (SELECT doc_id, page_number, min(block_no) AS b FROM mb GROUP BY ALL),
upto AS (SELECT k.doc_id, k.section, k.bin, string_agg(page_number::VARCHAR, ',' ORDER BY t.b) AS page_numbers FROM counted k LEFT JOIN opened o ON o.doc_id = k.doc_id AND o.section = k.section + 1 JOIN ended d ON d.doc_id = k.doc_id
  JOIN turned t ON t.doc_id = k.doc_id AND t.b <= CASE WHEN full_bin THEN last ELSE coalesce(o.b, d.b) END GROUP BY ALL),
exploded AS (SELECT *, unnest(range(len(parts))) AS part_no, unnest(parts) AS part FROM counted),
chunks AS (SELECT e.doc_id, (done + part_no + 1)::BIGINT AS chunk_no, 'document-chunk-' || (counter + part_no)::BIGINT AS chunk_id, part AS text, array_to_string(p.path, ' > ') AS section_path, page_numbers FROM exploded e JOIN paths p ON p.doc_id = e.doc_id AND p.section = e.section JOIN upto u ON u.doc_id = e.doc_id AND u.section = e.section AND u.bin = e.bin)"""


CHUNKS_SQL = f"{PATHS_SQL}, {SECTION_SQL}, {sql_chunks(80, 60)}"


def chunks_of(spark, sf_dir):
    return chunking.structural_chunks(chunking.markdown_blocks(as_markdown(spark, sf_dir)), CHUNK_CONFIG)


def flat_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "chunk_no", "chunk_id", "text", F.array_join("section_path", " > ").alias("section_path"), F.array_join(F.col("page_numbers").cast("array<string>"), ",").alias("page_numbers"))


@query(f"WITH {CHUNKS_SQL} SELECT * FROM chunks")
def structural_chunks(spark, sf_dir):
    return flat_chunks(chunks_of(spark, sf_dir))


@query(f"WITH RECURSIVE {OCR_BLOCKS_SQL}, mb AS (SELECT * FROM ocr_blocks), {BLOCK_PATHS_SQL}, {SECTION_SQL}, {sql_chunks(80, 60)} SELECT * FROM chunks")
def page_chunks(spark, sf_dir):
    """Chunks of scanned documents of several pages, with the pages that each has come to."""
    return flat_chunks(chunking.structural_chunks(scanned_blocks(spark, sf_dir), CHUNK_CONFIG))


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, count(*) AS n_chunks, count(DISTINCT chunk_id) AS n_ids FROM chunks GROUP BY doc_id")
def chunk_ids(spark, sf_dir):
    return chunks_of(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("chunk_id").alias("n_ids"))


@query(f"WITH s AS (SELECT doc_id, {sql_sentences('text')} AS s FROM documents), w AS (SELECT doc_id, unnest(range(1, greatest(len(s) - 2, 1) + 1))::INT AS chunk_no, s FROM s WHERE len(s) > 0) SELECT doc_id, chunk_no, array_to_string(s[chunk_no : chunk_no + 2], ' ') AS text FROM w")
def sentence_windows(spark, sf_dir):
    return chunking.sentence_windows(docs_of(spark, sf_dir))


# --- Vectors and search ---------------------------------------------------


@query(f"WITH t AS (SELECT doc_id, unnest({sql_terms('text')}) AS term FROM documents), b AS (SELECT doc_id, (('0x' || substr(md5(term), 1, 8))::BIGINT % 128)::INT AS bucket, count(*) AS n FROM t GROUP BY ALL) SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 9) AS weight FROM b")
def hash_embed(spark, sf_dir):
    return vectors.hash_vectors(docs_of(spark, sf_dir), "doc_id").withColumn("weight", F.round("weight", 9))


@query("WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings) SELECT vec_id, unnest(range(len(v)))::INT AS i, round(unnest(list_transform(v, lambda x: CASE WHEN norm = 0 THEN x ELSE x / norm END)), 9) AS x FROM n")
def l2_normalize(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalize(v)).alias("i", "x")).withColumn("x", F.round("x", 9))


@query("WITH n AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / CASE WHEN norm = 0 THEN 1 ELSE norm END) AS v FROM (SELECT *, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)), s AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_inner_product(q.v, i.v), 6) + 0 AS score FROM n q, n i WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM s) SELECT query_id, rank, item_id, score FROM r WHERE rank <= 5")
def vector_topk(spark, sf_dir):
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("v"))
    return vectors.vector_search(items, items.filter("item_id % 50 = 0").withColumnRenamed("item_id", "query_id"), decimals=6)


_topk = ORACLE_SQL["vector_topk"]


@query(_topk)
def vector_topk_cells(spark, sf_dir):
    """As ``vector_topk``, from the cells that can hold one of the best."""
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("v"))
    found = cells.Cells.build(items, scratch(spark, "cells"))
    return found.search(items.filter("item_id % 50 = 0").withColumnRenamed("item_id", "query_id"), decimals=6)


def hits_sql(items: str, keys: str, longer: int, distinct: bool = False) -> str:
    own = sql_terms("text")
    return f"""{ASKED_SQL}, q AS (SELECT query_id, list_distinct({sql_terms("text", longer)}) AS t FROM asked), qt AS (SELECT query_id, unnest(t) AS term, len(t) AS nt FROM q),
ti AS (SELECT {keys}, unnest({f"list_distinct({own})" if distinct else own}) AS term FROM {items}), tf AS (SELECT {keys}, term, count(*) AS tf FROM ti GROUP BY ALL),
sc AS (SELECT query_id, {keys}, round(sum(tf) / any_value(nt), 9) AS score FROM tf JOIN qt USING (term) GROUP BY query_id, {keys}),
hits AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {keys})::INT AS rank, {keys}, score FROM sc) WHERE rank <= 5)"""


@query(f"WITH {LINES_SQL}, li AS (SELECT doc_id, line_no, line AS text FROM lines), {hits_sql('li', 'doc_id, line_no', 1, True)} SELECT * FROM hits")
def keyword_lines_topk(spark, sf_dir):
    lines = tx.line_stream(docs_of(spark, sf_dir), "doc_id").withColumnRenamed("line", "text")
    return search.keyword_search(lines, asked(spark, sf_dir), "doc_id", "line_no", longer_than=1, distinct=True)


@query(f"WITH {CHUNKS_SQL}, {hits_sql('chunks', 'doc_id, chunk_no', 2)} SELECT * FROM hits")
def keyword_chunks_topk(spark, sf_dir):
    return search.keyword_search(chunks_of(spark, sf_dir), asked(spark, sf_dir), "doc_id", "chunk_no")


def hit_texts(spark, sf_dir, words=False):
    """query_id, rank, doc_id, score, text of the hits; with ``words`` also q, the query's words."""
    docs = docs_of(spark, sf_dir)
    hits, path = search.keyword_search(docs, asked(spark, sf_dir), "doc_id"), scratch(spark, "hits")
    if words:
        hits = hits.join(search.query_words(asked(spark, sf_dir)), "query_id")
    # Few rows of a known size: read again, they are broadcast to their texts, and nothing is searched twice.
    hits.write.parquet(path)
    return spark.read.schema(hits.schema).parquet(path).join(docs, "doc_id")


HIT_TEXTS_SQL = f"{hits_sql('documents', 'doc_id', 2)}, ht AS (SELECT query_id, rank, text FROM hits JOIN documents USING (doc_id))"


@query(f"""WITH {HIT_TEXTS_SQL}, qd AS (SELECT query_id, list_distinct({sql_terms("text", 2)}) AS q FROM asked),
se AS (SELECT query_id, rank, unnest(range(len(s))) AS n, unnest(s) AS sentence FROM (SELECT query_id, rank, {sql_sentences("text")} AS s FROM ht)),
ss AS (SELECT query_id, rank, n, sentence, round(len(list_intersect(q, list_distinct({sql_terms("sentence")}))) / greatest(sqrt(len(list_distinct({sql_terms("sentence")}))), 1.0), 9) AS score FROM se JOIN qd USING (query_id)),
best AS (SELECT query_id, sentence, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, n) AS r FROM ss WHERE score > 0),
ans AS (SELECT query_id, string_agg({sql_strip("sentence")}, ' ' ORDER BY r) AS answer FROM best WHERE r <= 3 GROUP BY query_id),
fb AS (SELECT query_id, substr(text, 1, 500) AS t FROM ht WHERE rank = 1)
SELECT query_id, coalesce(answer, t, '{search.NOTHING_FOUND}') AS answer FROM asked LEFT JOIN ans USING (query_id) LEFT JOIN fb USING (query_id)""")
def extractive_answer(spark, sf_dir):
    return search.answers_of(hit_texts(spark, sf_dir, words=True), asked(spark, sf_dir))


@query(f"""WITH {HIT_TEXTS_SQL}, ctx AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS c FROM ht GROUP BY query_id)
SELECT query_id, md5('You are a careful multilingual textbook assistant.' || chr(10) || 'Answer only from the provided context. If the answer is not present, say so.' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Context:' || chr(10) || c || chr(10)) AS prompt FROM asked JOIN ctx USING (query_id)""")
def context_prompt(spark, sf_dir):
    found = asked(spark, sf_dir).join(search.contexts(hit_texts(spark, sf_dir)), "query_id")
    return found.select("query_id", F.md5(search.grounding_prompt(F.col("text"), F.col("context"))).alias("prompt"))


# --- Questions and routes ---------------------------------------------------

QUESTIONS = ("aama 1 shlok kayo che ?", "શ્લોક ૨", "pehlo shlok", "bijo adyay su kehva mange che ?", "adhyay 3 meaning", "what should be shlok", "3 adhyay matlab")


def questions(spark, sf_dir):
    fixed = spark.createDataFrame([(-1 - i, q) for i, q in enumerate(QUESTIONS)], "query_id long, query string")
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return fixed.unionByName(turns)


QUESTIONS_SQL = f"""questions AS (SELECT (-1 - i)::BIGINT AS query_id, q AS query FROM (VALUES {", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS))}) v(i, q) UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations WHERE role = 'user'),
low AS (SELECT query_id, lower(query) AS lq, translate(lower(query), '{lex.GUJARATI_DIGITS}{lex.DEVANAGARI_DIGITS}', '01234567890123456789') AS p FROM questions)"""


def sql_map(words: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v!r}" for k, v in words.items()) + "}"


def sql_first_known(words: dict) -> str:
    return f"list_filter(list_transform(regexp_extract_all(p, '[a-zA-Z]+'), lambda t: {sql_map(words)}[t]), lambda v: v IS NOT NULL)[1]"


NUMBER_SQL = f"coalesce(try_cast(regexp_extract(p, '{rx.whole_word(rx.DIGIT + '{1,3}')}', 2) AS INT), {sql_first_known(lex.NUMBER_WORDS)})"


@query(f"WITH {QUESTIONS_SQL} SELECT query_id, {NUMBER_SQL} AS number FROM low")
def requested_number(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", qs.requested_number(F.col("query")).alias("number"))


_names = lex.any_of(sorted(lex.CHAPTER_WORDS, key=len, reverse=True))


CHAPTER_SQL = f"coalesce(try_cast(regexp_extract(p, '(^|{rx.NOT_WORD})({_names}){rx.SPACE}*({rx.DIGIT}{{1,3}})({rx.NOT_WORD}|$)', 3) AS INT), {sql_first_known(lex.ORDINAL_WORDS)})"


@query(f"WITH {QUESTIONS_SQL} SELECT query_id, {CHAPTER_SQL} AS chapter FROM low")
def requested_chapter(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", qs.requested_chapter(F.col("query")).alias("chapter"))


INTENT_SQL = f"regexp_matches(lq, '{qs.CHAPTER_PATTERN}') AND regexp_matches(lq, '{qs.MEANING_PATTERN}')"


@query(f"WITH {QUESTIONS_SQL} SELECT query_id, {INTENT_SQL} AS chapter_intent FROM low")
def query_intent(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", qs.chapter_intent(F.col("query")).alias("chapter_intent"))


EXPANDED_SQL = f"coalesce(array_to_string(flatten(list_transform(regexp_extract_all(lq, '{rx.TOKEN}'), lambda t: CASE WHEN {sql_map(lex.TERM_ALIASES)}[t] IS NULL THEN [t] ELSE [t, {sql_map(lex.TERM_ALIASES)}[t]] END)), ' '), '')"


@query(f"WITH {QUESTIONS_SQL} SELECT query_id, {EXPANDED_SQL} AS expanded FROM low")
def query_expand(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", qs.expanded(F.col("query")).alias("expanded"))


NUMBERS_SQL = f"list_distinct(list_transform(list_filter(string_split(regexp_replace(p, '{rx.NOT_WORD}+', ' ', 'g'), ' '), lambda t: regexp_matches(t, '^(0|[1-9][0-9]*)$')), lambda t: try_cast(t AS INT)))"
_verse, _chapter = lex.any_of(lex.VERSE_TERMS), lex.any_of(lex.CHAPTER_TERMS)


def sql_blocks(marker: str, stop: str, most: int) -> str:
    ahead = f"coalesce(list(struct_pack(l := line, s := {stop})) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND {most - 1} FOLLOWING), [])"
    return f"""WITH {MARKED_SQL}, f AS (SELECT *, {ahead} AS nxt FROM plain), c AS (SELECT *, list_position(list_transform(nxt, lambda x: x.s), true) AS cut FROM f WHERE regexp_matches(lower(line), '{marker}'))
SELECT doc_id, line_no, unnest({NUMBERS_SQL}) AS number, array_to_string(list_concat([line], list_transform(CASE WHEN coalesce(cut, 0) > 0 THEN nxt[1:cut - 1] ELSE nxt END, lambda x: x.l)), chr(10)) AS text FROM c"""


@query(f"WITH {MARKED_SQL} SELECT doc_id, line_no, unnest({NUMBERS_SQL}) AS number, line AS text FROM plain WHERE regexp_matches(lower(line), '{_verse}')")
def verse_lines(spark, sf_dir):
    return routing.verse_lines(marked_lines(spark, sf_dir))


@query(sql_blocks(_verse, f"(regexp_matches(lower(line), '{_verse}') AND regexp_matches(p, '{rx.ANY_NUMBER}')) OR line LIKE '#%'", 4))
def verse_blocks(spark, sf_dir):
    return routing.verse_blocks(marked_lines(spark, sf_dir))


@query(sql_blocks(_chapter, f"regexp_matches(lower(line), '{_chapter}') AND regexp_matches(p, '{rx.ANY_NUMBER}')", 8))
def chapter_blocks(spark, sf_dir):
    return routing.chapter_blocks(marked_lines(spark, sf_dir))


#: Every document under Indic headers; every question is asked of each.
HEADERS = "અધ્યાય ૧\nશ્લોક ૧\nધર્મક્ષેત્રે કુરુક્ષેત્રે સમવેતા\nશ્લોક ૨\nસંજય ઉવાચ\n"


def sql_entries(source: str, keys: str) -> str:
    """The non-zero entries of the normalised hash vectors of a CTE's text."""
    return f"""(SELECT {keys}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {keys})) AS w FROM (SELECT {keys}, (('0x' || substr(md5(term), 1, 8))::BIGINT % {vectors.DIM})::INT AS bucket, count(*) AS n FROM (SELECT {keys}, unnest({sql_terms("text")}) AS term FROM {source}) GROUP BY ALL))"""


def sql_block(stop: str, most: int) -> str:
    near = f"nxt[1:{most - 1}]"
    cut = f"coalesce(list_position(list_transform({near}, lambda x: x.{stop}), true), 0)"
    return f"array_to_string(list_concat([line], list_transform(CASE WHEN {cut} > 0 THEN nxt[1:{cut} - 1] ELSE {near} END, lambda x: x.l)), chr(10))"


def sql_fixed(texts: tuple) -> str:
    return "[" + ", ".join(f"'{x}'" for x in texts) + "]"


_stops = f"regexp_matches(p, '{rx.ANY_NUMBER}')"
ROUTES_SQL = f"""WITH RECURSIVE corpus AS (SELECT doc_id, '{HEADERS}' || text AS text FROM documents), {LINES_SQL.replace("FROM documents", "FROM corpus")},
md AS (SELECT doc_id, line_no, {sql_strip("part")} AS line FROM raw WHERE {sql_strip("part")} <> ''), {MB_SQL}, {BLOCK_PATHS_SQL}, {SECTION_SQL}, {sql_chunks(routing.SNIPPET_CHUNKS.max_tokens, routing.SNIPPET_CHUNKS.max_tokens - routing.SNIPPET_CHUNKS.overlap_tokens)},
asked AS (SELECT i AS n, q AS query FROM (VALUES {", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS))}) v(i, q)),
low AS (SELECT *, lower(query) AS lq, translate(lower(query), '{lex.GUJARATI_DIGITS}{lex.DEVANAGARI_DIGITS}', '01234567890123456789') AS p FROM asked),
known AS (SELECT n, {NUMBER_SQL} AS number, {CHAPTER_SQL} AS chapter, {INTENT_SQL} AS wants_chapter, regexp_matches(lq, '{_verse}') AS wants_verse, {EXPANDED_SQL} AS text FROM low),
terms AS (SELECT *, list_distinct({sql_terms("text", 1)}) AS t FROM known),
q AS (SELECT doc_id * 100 + n AS query_id, doc_id, terms.* EXCLUDE (text) FROM terms, documents),
plain AS (SELECT *, translate(line, '{lex.GUJARATI_DIGITS}{lex.DEVANAGARI_DIGITS}', '01234567890123456789') AS p FROM lines),
f AS (SELECT *, coalesce(list(struct_pack(l := line, v := (regexp_matches(lower(line), '{_verse}') AND {_stops}) OR line LIKE '#%', c := regexp_matches(lower(line), '{_chapter}') AND {_stops})) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING), []) AS nxt FROM plain),
u AS (SELECT doc_id, line_no, line, {NUMBERS_SQL} AS numbers, regexp_matches(lower(line), '{_verse}') AS verse, regexp_matches(lower(line), '{_chapter}') AS chapter_line, {sql_block("v", routing.VERSE_LINES)} AS verse_block, {sql_block("c", routing.CHAPTER_LINES)} AS chapter_block, list_distinct({sql_terms("line", 1)}) AS own FROM f),
m AS (SELECT query_id, u.*, wants_chapter, wants_verse, number, chapter, len(list_intersect(own, t)) / greatest(len(t), 1) AS overlap FROM q JOIN u USING (doc_id)),
ce AS {sql_entries("chunks", "doc_id, chunk_no")}, qe AS {sql_entries("terms", "n")},
dots AS (SELECT doc_id, chunk_no, n, sum(ce.w * qe.w) AS dot FROM ce JOIN qe USING (bucket) GROUP BY ALL),
sem AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(dot, 0), 9) DESC, chunk_no) AS r, text FROM q JOIN chunks USING (doc_id) LEFT JOIN dots USING (doc_id, chunk_no, n) WHERE NOT wants_chapter),
kw AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(overlap, 9) DESC, line_no) AS r, line FROM m WHERE NOT wants_chapter AND overlap > 0),
hits AS (SELECT query_id, 1 AS priority, line_no AS r, chapter_block AS text FROM m WHERE wants_chapter AND chapter_line AND list_contains(numbers, chapter)
  UNION ALL SELECT query_id, 2, line_no, verse_block FROM m WHERE NOT wants_chapter AND wants_verse AND verse AND list_contains(numbers, number)
  UNION ALL SELECT query_id, 3, line_no, line FROM m WHERE NOT wants_chapter AND wants_verse AND verse AND list_contains(numbers, number)
  UNION ALL SELECT query_id, 4, r, text FROM sem WHERE r <= {routing.MOST[4]} UNION ALL SELECT query_id, 5, r, line FROM kw WHERE r <= {routing.MOST[5]}),
weighed AS (SELECT *, {sql_count("text", rx.WEIRD)} AS w, {sql_count("text", rx.INDIC)} AS i FROM hits),
good AS (SELECT * FROM weighed WHERE i > 0 AND NOT {GARBLED_SQL}),
best AS (SELECT query_id, min(priority) AS priority FROM good GROUP BY query_id),
found AS (SELECT query_id, priority, list(text ORDER BY r) AS texts FROM good JOIN best USING (query_id, priority) GROUP BY ALL)
SELECT query_id, CASE WHEN priority IS NOT NULL THEN {list(routing.MODES)}[priority] WHEN wants_chapter THEN 'chapter-not-found' ELSE 'not-found-or-low-quality' END AS mode,
  array_to_string(CASE WHEN priority IS NOT NULL THEN texts WHEN wants_chapter THEN {sql_fixed(routing.CHAPTER_NOT_FOUND)} ELSE {sql_fixed(routing.NOT_FOUND)} END, chr(10) || '|' || chr(10)) AS responses
FROM q LEFT JOIN found USING (query_id)"""


def asked_of_each(spark, sf_dir):
    """The documents under Indic headers, and every question to each of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(HEADERS), F.col("text")).alias("text"))
    queries = docs.select("doc_id", F.posexplode(F.array(*map(F.lit, QUESTIONS))).alias("n", "query"))
    return docs, queries.select((F.col("doc_id") * 100 + F.col("n")).alias("query_id"), "doc_id", "query")


def flat(answers: DataFrame) -> DataFrame:
    return answers.withColumn("responses", F.array_join("responses", "\n|\n"))


@query(ROUTES_SQL)
def answer_routing(spark, sf_dir):
    return flat(routing.answers(*asked_of_each(spark, sf_dir)))


def stored_index(spark: SparkSession, docs: DataFrame) -> index.Index:
    """An index of other texts, with some documents missing and some too many, merged with ``docs``."""
    found = index.Index(spark, scratch(spark, "index"))
    before = docs.filter("doc_id % 50 <> 3").withColumn("text", F.when(F.col("doc_id") % 20 == 0, F.concat(F.lit("Before: "), "text")).otherwise(F.col("text")))
    found.merge(before.unionByName(docs.filter("doc_id % 100 = 7").withColumn("doc_id", -1 - F.col("doc_id"))))
    found.merge(docs)
    return found


@query(ROUTES_SQL)
def index_routing(spark, sf_dir):
    docs, queries = asked_of_each(spark, sf_dir)
    return flat(stored_index(spark, docs).answers(queries))


SNIPPET_CHUNKS_SQL = f"""RECURSIVE {LINES_SQL}, md AS (SELECT doc_id, line_no, {sql_strip("part")} AS line FROM raw WHERE {sql_strip("part")} <> ''), {MB_SQL}, {BLOCK_PATHS_SQL}, {SECTION_SQL},
{sql_chunks(routing.SNIPPET_CHUNKS.max_tokens, routing.SNIPPET_CHUNKS.max_tokens - routing.SNIPPET_CHUNKS.overlap_tokens)}"""


@query(f"WITH {SNIPPET_CHUNKS_SQL}, {hits_sql('chunks', 'doc_id, chunk_no', 2)} SELECT * FROM hits")
def index_keyword_topk(spark, sf_dir):
    return stored_index(spark, docs_of(spark, sf_dir)).keyword_search(asked(spark, sf_dir))


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower('{HEADERS}' || text), '{rx.MARKED_WORD}') AS t FROM documents)
SELECT doc_id, len(t)::BIGINT AS n_terms, md5(array_to_string(t, ' ')) AS digest FROM t""")
def mark_aware_terms(spark, sf_dir):
    docs, _ = asked_of_each(spark, sf_dir)
    found = tx.terms(F.col("text"), mark_aware=True)
    return docs.select("doc_id", F.size(found).cast("long").alias("n_terms"), F.md5(F.array_join(found, " ")).alias("digest"))


#: Each document as a transcript, a text layer or a scan, by its id; accented languages make garbled text layers.
SOURCES = {
    "transcript": "CASE WHEN doc_id % 5 = 0 THEN ' ' || text || ' ' WHEN doc_id % 5 = 1 THEN ' ' END",
    "text_layer": "CASE WHEN doc_id % 5 < 3 THEN text WHEN doc_id % 5 = 3 THEN '' END",
    "ocr_markdown": "CASE WHEN doc_id % 7 > 1 THEN upper(lang) || ' scan of ' || doc_id WHEN doc_id % 7 = 1 THEN ' ' END",
}
_some = lambda c: f"CASE WHEN regexp_matches({c}, '{rx.NOT_SPACE}') THEN {sql_strip(c)} END"


@query(f"""WITH s AS (SELECT doc_id, {", ".join(f"{v} AS {k}" for k, v in SOURCES.items())} FROM documents),
c AS (SELECT *, {sql_count("text_layer", rx.WEIRD)} AS w, {sql_count("text_layer", rx.INDIC)} AS i FROM s),
u AS (SELECT doc_id, {_some("transcript")} AS t, CASE WHEN NOT {GARBLED_SQL.replace("text", "text_layer")} THEN text_layer END AS l, {_some("ocr_markdown")} AS o FROM c)
SELECT doc_id, md5(coalesce(t, l, o, '')) AS digest, CASE WHEN t IS NOT NULL THEN 'transcript' WHEN l IS NOT NULL THEN 'text-layer' WHEN o IS NOT NULL THEN 'ocr' ELSE 'extraction-failed' END AS origin FROM u""")
def source_priority(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = src.choose_text(docs.select("doc_id", *(F.expr(v).alias(k) for k, v in SOURCES.items())))
    return found.select("doc_id", F.md5("text").alias("digest"), "origin")
