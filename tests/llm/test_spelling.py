"""Spelling variants against brute force over all pairs of words."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from lectern.llm import spelling
from lectern.llm.common import stored
from lectern.llm.queries import op13_spelling_variants

DOCS = "doc_id long, text string, word string, n long, slot long, root string"


def edit_of_one(a, b):
    """Whether one inserted, deleted or replaced character tells a and b apart, by trying all of them."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    total = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            total[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return brute_variants({w: n for w, n in total.items() if len(w) >= 7 and n >= 2})


def brute_variants(words):
    near = {w: [] for w in words}
    for a, b in itertools.combinations(sorted(words), 2):
        if abs(len(a) - len(b)) < 2 and edit_of_one(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def corpus(seed, n=40):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdéß÷") for _ in range(r.randrange(6, 11))) for _ in range(30)]
    texts = []
    for _ in range(n):
        words = [r.choice(base[:3] * 20 + base) for _ in range(60)]
        for _ in range(15):
            w = r.choice(words)
            at = r.randrange(len(w))
            words.append(w[:at] + r.choice(["", "a", "ß" + w[at : at + 1], "é"]) + w[at + 1 :])
        texts.append(r.choice(["a ", "1", "·"]).join(x if r.random() < 0.5 else x.upper() for x in words))
    return list(enumerate(texts))


ODD = [(100, None), (101, ""), (102, "123 !!"), (103, "x" * 30_000 + " " + "x" * 30_000 + " " + "x" * 29_999 + "y " * 2), (103, "x" * 29_999 + " " + "x" * 29_999), (None, "without without withoutt withoutt"), (104, "ÀÉÎÕÜ×÷ ÀÉÎÕÜ×÷ àéîõü×÷ àéîõü×÷")]


@pytest.mark.parametrize("seed", [0, 1])
def test_query_equals_brute_force(spark, tmp_path, seed):
    docs = corpus(seed) + ODD
    spark.createDataFrame([(*d, "clash", 1, 2, "clash") for d in docs], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = op13_spelling_variants(spark, str(tmp_path))
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    wanted = brute(docs)
    assert found(got) == wanted
    assert any(x[3] > 1 for x in wanted.values()) and any(x[0] for x in wanted.values())


def test_every_edit_of_one_is_met_once_and_chains_are_followed(spark):
    """All words of three letters over long stems, anagrams among them, with frequencies that chain."""
    r = random.Random(3)
    words = {"".join(x): 2 for x in itertools.islice(itertools.permutations("abcdefg"), 0, 5040, 9)}
    words |= {"aaabbbb" + "".join(x): 3 for n in (1, 2, 3) for x in itertools.product("abß", repeat=n)}
    words |= {"chainsaw": 1_000_000, "chainsax": 90_000, "chainsxx": 9_000, "chainxxx": 800, "chaixxxx": 70, "chaxxxxx": 7, "chaxxxxxx": 7, "tietie1"[:6] + "ab": 5}
    rows = list(words.items())
    r.shuffle(rows)
    own = stored(spark.createDataFrame(rows, "word string, n long"), "test-words")
    got, wanted = found(spelling.variants(own)), brute_variants(words)
    assert got == wanted
    assert wanted["chaxxxxx"][1] == "chainsaw"


def test_words_held_in_small_amounts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    docs = corpus(5, 10)
    own = spelling.word_counts(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.word: r.n for r in own.collect()} == {w: x[2] for w, x in brute(docs).items()}


def test_empty_table(spark):
    assert spelling.variants(spelling.word_counts(spark.createDataFrame([], DOCS))).count() == 0
