"""Scalar text functions as columns.  Only compatibility normalisation needs Python."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import lexicon as lex
from lectern.functions import regexes as rx


@lru_cache(maxsize=1)
def unsettled() -> str:
    """A class of the characters that a compatibility form may change, move, or join with what comes before.

    These are characters with a form other than themselves, those that stand second in
    a composition, and those that are put in order by a combining class.
    """
    second = {p[1] for c in map(chr, range(0x80, sys.maxunicode + 1)) if len(p := unicodedata.decomposition(c).split(" ")) == 2 and not p[0].startswith("<")}
    joins = {int(x, 16) for x in second} | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    found = [i for i in range(0x80, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and (i in joins or unicodedata.combining(chr(i)) or unicodedata.normalize("NFKC", chr(i)) != chr(i))]
    return char_class(found)


def char_class(points) -> str:
    """A class of code points given in order, without its brackets."""
    ranges: list[list[int]] = []
    for i in points:
        if ranges and ranges[-1][1] == i - 1:
            ranges[-1][1] = i
        else:
            ranges.append([i, i])
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


@lru_cache(maxsize=1)
def usual() -> str:
    """A short class of settled characters that most texts are of: Latin, Devanagari and Gujarati."""
    open_ = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", unsettled()) + "]")
    return char_class(i for block in (range(0x250), range(0x900, 0x980), range(0xA80, 0xB00)) for i in block if not open_.match(chr(i)))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


# Called so, the optimizer evaluates it once, not again in each filter on its result.
_nfkc_once = _nfkc.asNondeterministic()


def nfkc(c: Column) -> Column:
    """Compatibility forms; only text with a character that may change is sent to Python."""
    # Classes of many ranges are slow, so only characters beyond ASCII meet them, and the long one only text with an unusual one.
    beyond = r"(?![\x00-\x7F])"
    may = (F.octet_length(c) != F.char_length(c)) & c.rlike(f"{beyond}[^{usual()}]") & c.rlike(f"{beyond}[{unsettled()}]")
    return F.coalesce(_nfkc_once(F.when(may, c)), c)


def strip(c: Column) -> Column:
    """Without the white space at its ends; trimming looks at no other character."""
    return F.btrim(c, F.lit(rx.SPACES))


def squeeze(c: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{rx.SPACE}+", " "))


def normalize_text(c: Column, compatibility: bool = True) -> Column:
    """Line cleanup: compatibility forms, hyphen repair, blanks, page-number lines, ends.

    ``compatibility=False`` leaves out the step that needs Python, for text known to be normalised.
    """
    c = F.replace(nfkc(c) if compatibility else c, F.lit("\xa0"), F.lit(" "))
    # Most texts have nothing to repair, and looking for that takes no expression.
    c = F.when(c.contains("-\n"), F.regexp_replace(c, f"({rx.WORD})-\n({rx.WORD})", "$1$2")).otherwise(c)
    # A single blank stays as it is.
    c = F.when(c.contains("  ") | c.contains("\t"), F.regexp_replace(c, "\t[ \t]*| [ \t]+", " ")).otherwise(c)
    c = F.regexp_replace(c, rf"(?imd)^{rx.SPACE}*Page{rx.SPACE}+{rx.DIGIT}+{rx.SPACE}*$", "")
    return strip(c)


def normalize_digits(c: Column) -> Column:
    return F.translate(c, lex.GUJARATI_DIGITS + lex.DEVANAGARI_DIGITS, "0123456789" * 2)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(rx.TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rx.TOKEN))


def terms(c: Column, longer_than: int = 0, mark_aware: bool = False) -> Column:
    """Lower-cased words longer than so many characters, with repeats.

    Combining marks end a word, so words of Indic scripts fall into pieces.  With
    ``mark_aware`` marks and joiners belong to their word, and characters are grapheme
    clusters with whole conjuncts.
    """
    found = F.regexp_extract_all(F.lower(c), F.lit(rx.MARKED_WORD if mark_aware else f"{rx.WORD}+"), F.lit(0))
    size = (lambda t: F.size(graphemes(t))) if mark_aware else F.char_length
    return F.filter(found, lambda t: size(t) > longer_than) if longer_than else found


def graphemes(c: Column) -> Column:
    """Extended grapheme clusters, with the consonants of Indic conjuncts together."""
    return F.regexp_extract_all(c, F.lit(rx.CLUSTER), F.lit(0))


def latin_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[a-zA-Z]+"), F.lit(0))


def word_count(c: Column) -> Column:
    """Runs between white space."""
    return F.regexp_count(c, F.lit(f"{rx.NOT_SPACE}+"))


def sentences(c: Column) -> Column:
    flat = squeeze(c)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, rx.SENTENCE))


def is_blank(c: Column) -> Column:
    return ~c.rlike(rx.NOT_SPACE)


def garbled(c: Column) -> Column:
    """Blank, or with so many odd characters that its font encoding must be broken."""
    size = F.greatest(F.char_length(c), F.lit(1))
    weird, indic = (F.regexp_count(c, F.lit(p)) / size for p in (rx.WEIRD, rx.INDIC))
    return is_blank(c) | (weird > 0.03) | ((indic < 0.01) & (weird > 0.01))


def preferred_script(c: Column) -> Column:
    return c.rlike(rx.INDIC) & ~garbled(c)


def keep_preferred(items: Column) -> Column:
    """The items of an array that are clean text in a preferred script."""
    return F.filter(items, preferred_script)


def has_verse_term(c: Column) -> Column:
    return F.lower(c).rlike(lex.any_of(lex.VERSE_TERMS))


def has_chapter_term(c: Column) -> Column:
    return F.lower(c).rlike(lex.any_of(lex.CHAPTER_TERMS))


def has_number(c: Column) -> Column:
    return c.rlike(rx.ANY_NUMBER)


def numbers(c: Column) -> Column:
    """All numbers that stand as words of their own, as text."""
    padded = F.regexp_replace(c, f"{rx.NOT_WORD}+", " ")
    return F.filter(F.split(padded, " "), lambda t: t.rlike(f"^{rx.DIGIT}+$"))


def line_stream(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` columns, line_no and line: stripped lines but blanks and rules."""
    lines = docs.select(*keep, F.posexplode(F.split(text, rx.LINE)).alias("line_no", "line"))
    return lines.withColumn("line", strip(F.col("line"))).filter((F.col("line") != "") & (F.col("line") != "---"))
