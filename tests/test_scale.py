"""What is done once for each text, and what is shuffled."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import regexes as rx
from lectern.functions import text as tx
from lectern.operators import chunking, search, structure
from lectern.plans import registry
from lectern.sources import files as src

TEXTS = [
    "ﬁne exam-\nple\n  Page 12 \nx\t y ", " Ａ  ｂ\x85\xa0Page 7 é é\r\n¨ x\n̈y", "page 3", "", None, "CHAPTER 1 ROMANS", "1.2) Results follow here", "ÄÖÜ ΣΑΣ", "KELVIN STRASSE ß",
    "İstanbul 12", "chapter 3 of all", "Chapter 3: Of all", "a|b", "a   b", "one line:", "x" * 141, "x" * 139 + ":", "ALL " * 10, "ALL " * 11, "- point", "ǅungla Ǆ", "१.२ शीर्ष", "a \t b",
]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("n", [None, 7])
def test_a_text_is_cut_into_tokens_once(spark, n):
    config = chunking.ChunkConfig(max_tokens=5, overlap_tokens=2)
    found = spark.createDataFrame([("a b  c d, e f",)], "text string").select(chunking.token_windows(F.col("text"), config, n and F.lit(n)).alias("w"))
    assert found.first().w == ["a b c d ,", "d , e f"]
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    kept = spark.createDataFrame([("a  b",)], "text string").select(chunking.token_windows(F.col("text"), config, F.lit(2)).alias("w"))
    assert kept.first().w == ["a  b"]


def test_texts_take_their_compatibility_form_as_a_whole(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = src.clean_text_lines(docs, "doc_id")
    assert sorted(found.collect()) == sorted(src.clean_lines(src.text_lines(docs, "doc_id")).collect())
    assert plan(found).index("Generate") < plan(found).index("ArrowEvalPython")


def test_headings_and_tables_as_before(spark):
    c, none = F.col("c"), F.lit(None).cast("double")
    words = tx.word_count(c)
    upper = (F.upper(c) == c) & (words <= 10) & (F.char_length(c) <= 90)
    heading = (c != "") & (F.char_length(c) <= 140) & (F.lower(c).rlike(rx.NUMBERED) | (~c.rlike(rx.NOT_TITLE) & (words <= 8)) | upper | c.endswith(":"))
    rows = spark.createDataFrame([(t,) for t in TEXTS], "c string")
    own = rows.select("c", structure.is_heading(c, none.cast("int"), none).alias("h"), structure.is_table_row(c).alias("t"))
    assert own.filter(~F.col("h").eqNullSafe(heading) | ~F.col("t").eqNullSafe(c.rlike(rx.TABLE_ROW))).collect() == []
    assert "lower(" not in own.select("h")._jdf.queryExecution().analyzed().toString()


def test_words_are_not_shuffled(spark):
    """Documents are dealt out once; lines, blocks and chunks of their words need no other exchange."""
    for name in ("ocr_line_group", "ocr_blocks", "page_chunks"):
        found = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        physical = found._jdf.queryExecution().executedPlan().toString()
        assert physical.count("Exchange ") == 1 and physical.index("Generate") < physical.index("Exchange "), name


def test_hits_give_their_best_sentences_where_texts_are_read(spark):
    """No sentence is a row of a shuffle; ties go to the better hit, then to the earlier sentence."""
    hits = spark.createDataFrame([(1, 1, "Stone river. No such word here. River again."), (1, 2, "River stone! " + "Filler words only. " * 50), (2, 1, "Nothing of it.")], "query_id long, rank int, text string")
    queries = spark.createDataFrame([(1, "river stone"), (2, "cloud"), (3, "delta")], "query_id long, text string")
    found = search.extractive_answers(hits, queries)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert dict(found.collect()) == {1: "Stone river. River stone! River again.", 2: "Nothing of it.", 3: search.NOTHING_FOUND}
