"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' fifth powers, so it doesn't change with the
order of the letters, and one inserted, deleted or replaced letter changes it by the
letter's value or the difference of two values.  Words meet where their keys agree
after one of them, or both, gives up one letter: that covers every addition,
removal and exchange value without trying the alphabet.  As a single edit leaves
one half of a word as it is, the shared half is part of what they meet by; so anagrams of one set
of letters, however many, don't all meet each other, and each pair is met once.
Then the order of the letters is verified by edit distance.

The form of a word is its most frequent near word, if that is far more frequent;
roots follow forms by doubling joins.

Defined cases: a null text has no words, a null id counts as the empty string; ties
in frequency go to the smallest word in code-point order; a word without a form is
its own root; repeated rows count again; an empty table has no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import checked, forget, partitions, raw_texts, stored, text_chunks

#: Code points of a word, and its occurrences, at least; how many times as frequent as the word its form is.
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: One in so many words of a document loses a letter.
DROP = 31
POWER = 5
RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")
#: Words that a task counts before it hands them on.
HELD_WORDS = 1 << 18


def word_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: runs of letters of all texts, of which one in ``DROP`` has lost a letter; stored."""
    own = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))

    def packed(total: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for chunk in text_chunks(batches, "text"):
            for doc, raw in zip(chunk.column("doc_id").to_pylist(), raw_texts(chunk.column("text")), strict=True):
                begun = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                # Lower-casing bytes changes A-Z alone; a run shorter than a word can't become one.
                for word, n in Counter(RUN.findall(raw.lower().decode("utf-8", "replace"))).items():
                    h = zlib.crc32(word.encode(), begun)
                    if h % DROP == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                    total[word] += n
                if len(total) >= HELD_WORDS:
                    yield packed(total)
        yield packed(total)

    counted = own.mapInArrow(run, "word string, n long").repartition(partitions(docs), "word").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counted.filter(F.col("n") >= LEAST_COUNT), "words")


def slots(word: str) -> Iterator[tuple[bool, int, bytes]]:
    """Whether a letter was given up, the half that is kept, and what words meet by."""
    total = sum(ord(c) ** POWER for c in word)
    for gives, rest in ((False, len(word)), (True, len(word) - 1)):
        half = rest // 2
        # The half that both words share, and the letters of which one may be given up.
        for last, kept, other in ((0, word[:half], word[half:]), (1, word[len(word) - rest + half :], word[: len(word) - rest + half])):
            for value in {ord(c) ** POWER for c in other} if gives else (0,):
                yield gives, last, f"{total - value} {rest} {last} {kept}".encode()


def near_pairs(words: DataFrame, parts: int) -> DataFrame:
    """a, a_n, b, b_n: each pair of ``words`` (word, n) that one inserted, deleted or replaced code point tells apart, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(xxhash.xxh3_64_intdigest(slot), gives, last, i) for i, word in enumerate(batch.column("word").to_pylist()) for gives, last, slot in slots(word)]
            at = pa.array([x[3] for x in out], pa.int32())
            slot = pa.array([x[0] - (1 << 63) for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([slot, pa.array([x[1] for x in out], pa.bool_()), pa.array([x[2] for x in out], pa.int32()), batch.column("word").take(at), batch.column("n").take(at)], names=["slot", "gives", "last", "word", "n"])

    dealt = words.select("word", "n").mapInArrow(run, "slot long, gives boolean, last int, word string, n long").repartition(parts, "slot")
    a, b = (dealt.toDF("slot", *(f"{side}_{k}" for k in ("gives", "last", "word", "n"))) for side in "ab")
    half = ((F.char_length("a_word") - 1) / 2).cast("int")
    # The second half counts only where the first ones differ, as the pair is met by them otherwise.
    once = (F.col("a_last") == 0) | (F.substring("a_word", F.lit(1), half) != F.substring("b_word", F.lit(1), half))
    order = ~F.col("b_gives") | (F.col("a_word") < F.col("b_word"))
    met = a.filter("a_gives").join(b, "slot").filter((F.col("a_last") == F.col("b_last")) & order & once)
    near = met.filter(F.levenshtein("a_word", "b_word", 1) == 1)
    return near.select(F.col("a_word").alias("a"), F.col("a_n"), F.col("b_word").alias("b"), F.col("b_n"))


def variants(words: DataFrame, *, times: int = TIMES, parts: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for all ``words`` (word, n; stored)."""
    parts = parts or partitions(words)
    pairs = near_pairs(words, parts)
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    rows = pairs.select(sides.alias("x")).select("x.*").unionByName(words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word"))))
    found = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    often = -F.col("best.less") >= times * F.col("n")
    found = stored(found.select("word", "n", "n_near", F.when(often, F.col("best.word")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")), "variants")
    root = roots(found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(checked(root), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms of each word end; stored.  Forms have no cycles, as each is more frequent than its word."""
    links = stored(forms.toDF("word", "root"), "roots")
    while True:
        further = checked(links).select(F.col("word").alias("root"), F.col("root").alias("_further"))
        both = links.join(further, "root", "left")
        old, links = links, stored(both.select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("went")), "roots")
        forget(old)
        if links.filter("went").isEmpty():
            return links
        links = _without(links, "went")


def _without(table: DataFrame, name: str) -> DataFrame:
    out = table.drop(name)
    out.stored_at = table.stored_at
    return out
