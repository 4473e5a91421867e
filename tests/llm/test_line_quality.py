"""The chain against all label sequences, its gradient, and the classifier on planted and held-out documents."""

import itertools
import os
import random
import zlib

import numpy as np
import pytest

from lectern.llm import line_quality as lq
from lectern.llm.queries import op11_quality_classifier

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, quality int, score double, _label int, model string"


def brute(score, moves):
    """Marginals, expected pairs and log partition function of one chain, over all label sequences."""
    share, pairs, total = np.zeros(len(score)), np.zeros((2, 2)), 0.0
    for y in itertools.product((0, 1), repeat=len(score)):
        p = np.exp(sum(s for s, k in zip(score, y, strict=True) if k) + sum(moves[a, b] for a, b in itertools.pairwise(y)))
        total += p
        share += p * np.array(y)
        for a, b in itertools.pairwise(y):
            pairs[a, b] += p
    return share / total, pairs / total, np.log(total)


def test_chains_equal_all_label_sequences():
    r = np.random.default_rng(1)
    for _ in range(20):
        sizes = r.integers(1, 9, 4)
        score, moves = r.normal(0, 3, sizes.sum()), r.normal(0, 2, (2, 2))
        number = np.concatenate([np.arange(n) for n in sizes])
        got = lq.chains(score, moves, number)
        cuts = np.cumsum(sizes)[:-1]
        wanted = [brute(x, moves) for x in np.split(score, cuts)]
        assert np.allclose(got[0], np.concatenate([x[0] for x in wanted]))
        assert np.allclose(got[1], sum(x[1] for x in wanted)) and np.isclose(got[2], sum(x[2] for x in wanted))


def test_long_chains_do_not_underflow():
    score = np.where(np.arange(200_000) < 100_000, 5.0, -5.0)
    share, _, total = lq.chains(score, np.array([[3.0, -3.0], [-3.0, 3.0]]), np.arange(200_000))
    assert np.isfinite(total) and share[:99_990].min() > 0.99 and share[100_010:].max() < 0.01


def test_minimum_is_found():
    a = np.diag([1.0, 10.0, 100.0])
    x = lq.minimised(lambda x: (float(0.5 * x @ a @ x - x.sum()), a @ x - 1), np.zeros(3))
    assert np.allclose(x, [1, 0.1, 0.01], atol=1e-4)


def test_features_of_lines():
    features, number, chars = lq.lines_of(["Ab c1.\n\nAb c1.\nx x x".encode(), b"", "é##".encode()])
    assert number.tolist() == [0, 1, 2, 3, 0, 0] and chars.tolist() == [6, 0, 6, 5, 0, 3]
    assert features[:, 13].tolist() == [0, 0, 1, 0, 0, 0] and features[:, 14].tolist() == [1, 0, 1, 0, 0, 0] and features[:, 16].tolist() == [0, 1, 0, 0, 1, 0]
    assert features[5, 1 + lq.SYMBOL] == pytest.approx(2 / 3) and features[3, 11] == pytest.approx(2 / 3)
    before, after = lq.neighbours(features, number)
    assert not before[[0, 4, 5]].any() and (before[1] == features[0]).all() and not after[[3, 4, 5]].any() and (after[2] == features[3]).all()


def good(r):
    return " ".join("".join(r.choice("aeionrst") for _ in range(r.randrange(2, 8))) for _ in range(14)).capitalize() + "."


def bad(r):
    return " ".join("".join(r.choice("aeionrst") for _ in range(r.randrange(2, 8))) + r.choice(["###", "$$$", "|"]) for _ in range(14))


def planted(seed, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        # Bad documents have good lines, too.
        kinds = [good] * 8 if i % 2 else [bad] * 5 + [good] * 3
        r.shuffle(kinds)
        rows.append((i, "\n".join(f(r) for f in kinds), i % 2))
    return rows


ODD = [None, "", "\n\n\n", " \t", "a", "x" * 200_000, "y\n" * 100_000, "same", "same"]


def test_planted_documents_and_odd_rows(spark):
    rows = planted(1)
    r = random.Random(9)
    texts = ODD + [good(r) + "\n" + good(r), bad(r) + "\n" + bad(r)]
    docs = spark.createDataFrame([(i, t, "en", 1 - y, 0.5, 3, "x") for i, t, y in rows] + [(1000 + i, t, None, None, None, None, None) for i, t in enumerate(texts)], DOCS)
    marks = [(i, y, 0) for i, _, y in rows if i < 300] + [(None, 1, 0), (5, None, 0), (1000, None, 1), (99_999, 1, 0), (1, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, score int")
    model = lq.train(docs, labels)
    got = {r.doc_id: r.score for r in lq.score_documents(docs, model).collect()}
    assert len(got) == len(rows) + len(texts) and all(0 <= x <= 1 for x in got.values())
    assert np.mean([(got[i] >= 0.5) == (y == 1) for i, _, y in rows if i >= 300]) >= 0.97
    assert got[1007] == got[1008] and got[1000] == got[1001]
    assert got[1000 + len(ODD)] > 0.8 > 0.2 > got[1001 + len(ODD)]
    # Lines of a bad document that are good are known as such.
    number = np.arange(8)
    features, _, _ = lq.lines_of([rows[0][1].encode()])
    score = sum(part @ w for part, w in zip((features, *lq.neighbours(features, number)), model.weights.reshape(3, -1), strict=True))
    share = lq.chains(score, model.moves, number)[0]
    assert [x > 0.5 for x in share] == ["#" not in line and "$" not in line and "|" not in line for line in rows[0][1].split("\n")]


def test_sample_is_bounded_and_the_same_again(spark):
    docs = spark.createDataFrame(planted(2), "doc_id long, text string, quality int").repartition(3)
    a, b = (lq.train(docs, docs.select("doc_id", "quality"), max_train_docs=100, max_train_lines=500) for _ in range(2))
    assert np.allclose(a.weights, b.weights) and a.slope == b.slope
    texts = [t.encode() for _, t, _ in planted(3, 100)]
    assert np.mean((lq.scored(a, texts) >= 0.5) == (np.arange(100) % 2 == 1)) >= 0.9


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    assert lq.train(docs, none) is None
    assert [r.score for r in lq.score_documents(docs, None).collect()] == [0.5, 0.5]
    one = lq.train(docs, spark.createDataFrame([(1, 1, 0)], none.schema))
    assert all(0 <= r.score <= 1 for r in lq.score_documents(docs, one).collect())
    assert lq.score_documents(docs.limit(0), one).count() == 0
    assert lq.train(docs, spark.createDataFrame([(7, 1, 0)], none.schema)) is None


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_held_out_quality(spark):
    got = {r.doc_id: r for r in op11_quality_classifier(spark, DATA).collect()}
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    labels = [(r.quality, got[r.doc_id]) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()]
    held = [(y, r.predicted) for y, r in labels if r.held_out]
    assert len(held) > 50 and np.mean([y == p for y, p in held]) >= 0.97
