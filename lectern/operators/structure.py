"""Reconstruction of a document's hierarchy from its lines.

Lines are rows of doc_id, page_number, line_no, text, bbox array<int> and
confidence.  Assembly is gaps and islands over the reading order, so nothing but
a document's own lines meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import regexes as rx
from lectern.functions import text as tx

TALL, LONGEST_HEADING = 1.2, 140


def reading_order() -> list:
    """Page, top, left, then the given order; a line without a bbox is at the top left."""
    top, left = (F.coalesce(F.get("bbox", F.lit(i)), F.lit(0)) for i in (1, 0))
    return [F.col("page_number"), top, left, F.col("line_no")]


def is_bullet(c: Column) -> Column:
    return tx.strip(c).rlike(rx.BULLET)


def strip_bullet(c: Column) -> Column:
    return F.regexp_replace(tx.strip(c), rx.BULLET, "")


def is_table_row(c: Column) -> Column:
    # As ``rx.TABLE_ROW``, which only texts meet that have three characters in a row other than visible ASCII.
    return c.contains("|") | c.contains("\t") | (c.rlike("[^!-~]{3}") & c.rlike(f"{rx.SPACE}{{3,}}"))


def line_height(bbox: Column) -> Column:
    return F.when(F.array_size(bbox) == 4, F.get(bbox, F.lit(3)) - F.get(bbox, F.lit(1)))


def is_heading(c: Column, height: Column, median: Column) -> Column:
    """A short line that is numbered, in title or upper case, ends with a colon, or is taller than the body."""
    words = tx.word_count(c)
    title = ~c.rlike(rx.NOT_TITLE) & (words <= 8)
    # Changing the case of a text takes long; a small ASCII letter tells that it isn't upper case.
    upper = ~c.rlike("[a-z]") & (F.char_length(c) <= 90) & (F.upper(c) == c) & (words <= 10)
    numbered = c.rlike(rx.NUMBERED.replace("chapter", "(?i:chapter)"))
    tall = F.coalesce((median > 0) & (F.coalesce(height, F.lit(0)) >= median * TALL), F.lit(False))
    return (c != "") & (F.char_length(c) <= LONGEST_HEADING) & (numbered | title | upper | c.endswith(":") | tall)


def heading_level(c: Column) -> Column:
    text = F.lower(tx.strip(c))
    number = F.regexp_extract(text, rx.LEADING_NUMBER, 1)
    return F.when(text.startswith("chapter"), 1).when(number != "", F.least(F.size(F.split(number, r"\.")) + 1, F.lit(4))).otherwise(2)


def page_median_heights(lines: DataFrame) -> DataFrame:
    """doc_id, page_number, median_height over lines with a whole bbox; heights count as 1 at least."""
    height = line_height(F.col("bbox"))
    return lines.filter(height.isNotNull()).groupBy("doc_id", "page_number").agg(F.median(F.greatest(height, F.lit(1)).cast("double")).alias("median_height"))


def classify(lines: DataFrame, *, dealt: bool = False) -> DataFrame:
    """``lines`` with line_type (bullet, heading, table, paragraph) and level.

    Dealt out by document once, unless they are ``dealt`` already: the windows here and of ``assemble`` need no other shuffle.
    """
    height = F.greatest(line_height(F.col("bbox")), F.lit(1)).cast("double")
    median = F.median(F.when(line_height(F.col("bbox")).isNotNull(), height)).over(Window.partitionBy("doc_id", "page_number"))
    # Stripped once, for all that looks at it.
    df = (lines if dealt else lines.repartition("doc_id")).withColumn("median_height", median).withColumn("_text", tx.strip(F.col("text")))
    text = F.col("_text")
    kind = F.when(is_bullet(text), "bullet").when(is_heading(text, line_height(F.col("bbox")), F.col("median_height")), "heading").when(is_table_row(F.col("text")), "table").otherwise("paragraph")
    return df.withColumn("line_type", kind).withColumn("level", F.when(F.col("line_type") == "heading", heading_level(text))).drop("median_height", "_text")


def assemble(classified: DataFrame) -> DataFrame:
    """doc_id, block_no, block_type, level, text, page_number, bbox, confidence.

    Neighbouring paragraph lines of a page merge; every other line is a block of
    its own; a change of page adds a block that names the page just ended.
    """
    doc = Window.partitionBy("doc_id")
    order = doc.orderBy(*reading_order())
    first_page = F.min(F.struct("line_no", "page_number")).over(doc)["page_number"]
    df = classified.withColumns({"_page": F.coalesce(F.lag("page_number").over(order), first_page), "_type": F.lag("line_type").over(order), "_n": F.row_number().over(order)})
    turned = F.col("_page") != F.col("page_number")
    joins = (F.col("line_type") == "paragraph") & (F.col("_type") == "paragraph") & ~turned
    df = df.withColumn("_grp", F.sum(F.when(joins, 0).otherwise(1)).over(order))
    text = F.when(F.col("line_type") == "bullet", strip_bullet(F.col("text"))).otherwise(F.col("text"))
    own = F.col("line_type").isin("heading", "table")
    lines = F.sort_array(F.collect_list(F.struct("_n", text.alias("t"))))
    one = [F.first(F.when(own, F.col(k)) if k in ("bbox", "confidence") else F.col(k)).alias(k) for k in ("level", "page_number", "bbox", "confidence")]
    ended = F.max(F.when(turned, F.col("_page"))).alias("_ended")
    blocks = df.groupBy("doc_id", "_grp", F.col("line_type").alias("block_type")).agg(tx.strip(F.array_join(F.transform(lines, lambda x: x["t"]), " ")).alias("text"), *one, ended)
    # A turn of the page begins a group, so the break goes before the group's own block, out of one row.
    null = {"level": "int", "bbox": "array<int>", "confidence": "double"}
    break_ = F.struct(F.lit(0).alias("_side"), F.lit("page_break").alias("block_type"), *(F.lit(None).cast(kind).alias(k) for k, kind in null.items()), F.concat(F.lit("Page "), "_ended").alias("text"), F.col("_ended").alias("page_number"))
    block = F.struct(F.lit(1).alias("_side"), "block_type", *null, "text", "page_number")
    some = F.array_compact(F.array(F.when(F.col("_ended").isNotNull(), break_), F.when((F.col("block_type") != "bullet") | (F.col("text") != ""), block)))
    every = blocks.select("doc_id", "_grp", F.explode(some).alias("x")).select("doc_id", "_grp", "x.*").withColumn("block_no", F.row_number().over(doc.orderBy("_grp", "_side")))
    return every.select("doc_id", "block_no", "block_type", "level", "text", "page_number", "bbox", "confidence")


def render_markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, markdown."""
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(6))
    part = (
        F.when(F.col("block_type") == "page_break", F.concat(F.lit("\n---\n\n> "), "text"))
        .when(F.col("block_type") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "text"))
        .when(F.col("block_type") == "bullet", F.concat(F.lit("- "), "text"))
        .otherwise(F.col("text"))
    )
    parts = F.sort_array(F.collect_list(F.struct("block_no", part.alias("p"))))
    return blocks.groupBy("doc_id").agg(tx.strip(F.array_join(F.transform(parts, lambda x: x["p"]), "\n\n")).alias("markdown"))
