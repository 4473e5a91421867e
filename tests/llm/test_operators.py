"""The operators against brute force, exact round trips and planted cases, with odd rows in every table."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import bpe, chat_format, decontamination, graph, html_extraction, jaccard_join, language_id, line_dedup, lm_scoring, quality, token_counts
from lectern.llm.common import fold_is, stored
from lectern.llm.queries import PIECES, WORD_BPE, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, score double"
WORDS = "the of and to in a is that for it on was with be by as at from this have an are not which or but all one had their we they you were her she there would can".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "ing", "ed", ","]) for _ in range(n))


#: Null, empty, blank, repeated rows, no spaces, odd characters, very long, short.
ODD = [None, "", " \n\t ", "same row", "same row", "x" * 30_000, "Été ½ ǅ 日本語 \u0085 é <|endoftext|>'s", prose(1, 40_000), "a b c"]


def table(spark, texts, lang="en"):
    # Extra columns whose names the operators use themselves.
    return spark.createDataFrame([(i, t, lang, "s", None, "clash", 0.5) for i, t in enumerate(texts)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def near(text: str, at: int) -> str:
    words = text.split()
    words[at] = "changed"
    return " ".join(words)


# --- BPE and token counts ---------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path(WORD_BPE))


def test_bpe_equals_the_library(spark, library):
    texts = [*ODD, "don't 'S've <|startoftext|><|endoftext|", "😀😀 ａ１２３ ́x", prose(3, 300)]
    got = {r.doc_id: r for r in bpe.encode_documents(table(spark, texts), tokenizer_path(WORD_BPE)).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
    digest = {r.doc_id: r for r in bpe.encode_digests(table(spark, texts), tokenizer_path(WORD_BPE), with_ids=True).collect()}
    assert all(digest[i].n_tokens == len(got[i].ids) == len(digest[i].ids) and digest[i].decoded_sha256 == hashlib.sha256(got[i].decoded.encode()).hexdigest() for i in got)
    assert bpe.encode_digests(empty(spark), tokenizer_path(WORD_BPE)).count() == 0


def test_bpe_words_equal_plain_merges():
    encoder, _ = bpe.loaded(tokenizer_path(WORD_BPE))
    r = random.Random(5)
    for _ in range(3000):
        word = "".join(r.choice("abcdeeinorst") for _ in range(r.randrange(1, 14)))
        symbols = word[:-1] + chr(ord(word[-1]) + bpe.LAST)
        assert encoder.encode_symbols(symbols) == [encoder.ids[t] for t in encoder._merged(symbols)]


def test_token_counts_equal_the_library(spark, library):
    got = {r.doc_id: r for r in token_counts.token_counts(table(spark, ODD), tokenizer_path(WORD_BPE)).collect()}
    for i, text in enumerate(ODD):
        n = len(library.encode(text or "", add_special_tokens=False))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 2048)
    assert token_counts.token_counts(empty(spark), tokenizer_path(WORD_BPE)).count() == 0


def test_many_special_strings_and_long_texts_without_spaces(spark, library):
    r = random.Random(31)
    signs = "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(60_000))
    texts = ["<|endoftext|>" * 100_000, signs, "。".join(signs[i : i + 30] for i in range(0, 30_000, 30)), "ab" * 20_000, "<|startoftext|>x<|endoftext|>" * 50]
    docs = table(spark, texts)
    got = {x.doc_id: x for x in bpe.encode_digests(docs, tokenizer_path(WORD_BPE), with_ids=True).collect()}
    counts = {x.doc_id: x.n_tokens for x in token_counts.token_counts(docs, tokenizer_path(WORD_BPE)).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i].ids == ids and counts[i] == len(ids)


# --- Decontamination ----------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_contamination(texts, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        words = WORD.findall(lowered(text))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            windows[tuple(words[i : i + window])].add(str(item))
    out = []
    for text in texts:
        words, hit, found = WORD.findall(lowered(text)), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if names := windows.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        out.append((len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination(spark, block_bytes):
    item = prose(11, 30)
    items = [(1, item), (2, item), (10, "Only five WORDS in here"), (3, None), (4, ""), (5, "!!"), (6, prose(12, 25)), (6, prose(13, 12))]
    texts = [*ODD, item, f"before {item.upper()}; after", " ".join(item.split()[5:15]), " ".join(item.split()[5:14]), "x only five words, in here y", f"{item} {item}", prose(12, 25)[3:]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.digest(decontamination.contaminated_documents(table(spark, texts), benchmark, block_bytes=block_bytes))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == brute_contamination(texts, items)
    assert decontamination.contaminated_documents(empty(spark), benchmark).count() == 0
    clean = decontamination.digest(decontamination.contaminated_documents(table(spark, texts), benchmark.limit(0)))
    assert clean.filter("contaminated").count() == 0 and clean.count() == len(texts)


def test_proximity_equals_brute_force(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(0, 60))) for _ in range(30)]
    index = decontamination.build_index(table(spark, texts).select("doc_id", "text"))
    queries = {(b"a", b"b", b"c"): ["x"], (b"d", b"d", b"e"): ["y", "w"], (b"z", b"a"): ["z"]}
    got = {tuple(row) for row in decontamination.proximity_matches(index, queries, 5).collect()}
    wanted = Counter()
    for d, text in enumerate(texts):
        words = text.encode().split()
        for terms, names in queries.items():
            for i in range(len(words)):
                if words[i] in terms and set(terms) <= set(words[i : i + 5]):
                    wanted.update((d, name) for name in names)
    assert got == {(*k, n) for k, n in wanted.items()}
    everything = decontamination.build_index(table(spark, ["a b a"]).select("doc_id", "text")).first()
    assert len(np.frombuffer(everything.positions, "<i4")) == 3


def test_shuffled_passages_are_near(spark):
    item = " ".join(f"w{i}" for i in range(10))
    texts = [item, " ".join(reversed(item.split())), " x y ".join(item.split()), " x ".join(item.split()), prose(4, 50), None]
    found = decontamination.near_documents(table(spark, texts), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(0, "7"), (1, "7"), (3, "7")]
    assert decontamination.near_documents(empty(spark), spark.createDataFrame([], "item_id long, text string")).count() == 0


# --- Similarity join ------------------------------------------------------------


def brute_components(texts, percent=75, width=5):
    sets = []
    for text in texts:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    union = graph.Union(len(sets))
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            union.join(i, j)
    return [(len(s), union.find(i)) for i, s in enumerate(sets)]


def family(seed, n, copies):
    """Variants of one text around the threshold."""
    r, base = random.Random(seed), prose(seed, n).split()
    for _ in range(copies):
        words = list(base)
        for _ in range(r.randrange(0, max(2, n // 20))):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        yield " ".join(words[: r.randrange(max(1, len(words) * 4 // 5), len(words) + 1)])


def test_jaccard_join_equals_brute_force(spark):
    texts = [*ODD, "A b C", "one two three four", "one two three four five"]
    for seed, n in enumerate((3, 6, 7, 8, 9, 11, 14, 20, 30, 45, 70, 110, 300)):
        texts += family(100 + seed, n, 14)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)
    assert jaccard_join.similar_documents(empty(spark)).count() == 0


def test_families_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "verified_links", lambda members, compare, parts: graph.verified_links(members, compare, parts, block=4))
    texts = [*family(7, 60, 40), *family(8, 200, 40)]
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_documents(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in brute_components(texts)]


def test_sets_that_no_probe_covers_are_compared_with_all(spark):
    texts = [*family(21, 40, 12)]
    docs = table(spark, texts).select("doc_id", "text")
    sets = jaccard_join.document_sets(docs, 5)
    reps = sets.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    links = jaccard_join.links_of_uncovered(docs, sets, reps, reps.select("node"), 5, 75)
    node = {r.node: r.doc_id for r in reps.collect()}
    union = graph.Union(len(texts))
    for i, r in ((r.doc_id, r.node) for r in sets.collect()):
        union.join(i, node[r])
    for r in links.collect():
        union.join(node[r.a], node[r.b])
    assert [union.find(i) for i in range(len(texts))] == [c for _, c in brute_components(texts)]


@pytest.mark.parametrize("hot_sets", [100_000, 2, 1])
def test_rows_of_sets_with_many_copies(spark, hot_sets):
    """Whichever sets are broadcast to their rows: each row is there once, with the class of its set."""
    sets = stored(spark.createDataFrame([(i, 3, 7) for i in range(6)] + [(6, 2, 8), (7, 2, 8), (8, 1, 9), (9, 0, 0), (10, 0, 0), (None, 0, 0)], jaccard_join.SETS), "sets")
    first = stored(spark.createDataFrame([(7, 6, 0), (8, 2, 0), (9, 1, 8)], "node long, copies long, component_id long"), "first")
    found = jaccard_join.classes_of_rows(sets, first, hot_sets)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=repr)
    assert got == sorted([(i, 3, 0) for i in range(6)] + [(6, 2, 0), (7, 2, 0), (8, 1, 8), (9, 0, 9), (10, 0, 10), (None, 0, None)], key=repr)


def test_segment_allocation_covers_every_pair():
    """The pigeonhole itself: each similar pair of random sets shares a key that the larger one probes."""
    bands, r = jaccard_join.Bands.of(75), np.random.default_rng(4)
    for n in (3, 4, 5, 7, 10, 16, 25, 40, 63, 64, 90, 200):
        for _ in range(60):
            a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            drop, add = sorted(r.integers(0, n // 4 + 1, 2))
            b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**63, add, dtype=np.uint64)]))
            if not len(b) or not jaccard_join.similar(a, b, 75):
                continue
            sizes, nodes = np.array([len(a), len(b)]), np.array([1, 2], np.uint64)
            node, key, role, hard = jaccard_join.entries(np.concatenate([a, b]), sizes, nodes, bands)
            large, small = (1, 2) if len(a) >= len(b) else (2, 1)
            probed = set(key[(node == large) & (role & jaccard_join.PROBE > 0)].tolist())
            indexed = set(key[(node == small) & (role & jaccard_join.INDEX > 0)].tolist())
            assert probed & indexed or large in hard.tolist()


def test_rows_of_one_id_keep_their_own_sets(spark):
    texts = [prose(700, 60), prose(701, 60)]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, near(texts[0], 30)), (3, near(texts[1], 30))], "doc_id long, text string").coalesce(1)
    sets = jaccard_join.document_sets(docs, 5)
    wanted = sets.filter("doc_id = 1").select("doc_id", "node")
    got = {r.node: r.hashes for r in jaccard_join.sets_of(docs, wanted, 5).collect()}
    expected = {}
    for text in texts:
        hashes, sizes = jaccard_join.shingle_sets([text.encode()], 5)
        expected[int(jaccard_join.set_nodes(hashes, sizes).view(np.int64)[0])] = hashes.tobytes()
    assert {k: bytes(v) for k, v in got.items()} == expected
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join.similar_documents(docs).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1)]


@pytest.mark.parametrize("at_once", [0, 1_000_000])
def test_components(spark, at_once):
    """By contraction alone, and by one task as the graph is small: a path of ordered ids, a star, a loop."""
    edges = [(i, i + 1) for i in range(20, 60)] + [(5, 3), (3, 9), (100, 7), (7, 7), (8, 8)] + [(500, i) for i in range(501, 540)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), at_once).collect()}
    assert got == {i: 20 for i in range(20, 61)} | {5: 3, 3: 3, 9: 3, 100: 7, 7: 7} | {i: 500 for i in range(500, 540)}
    assert graph.components(spark.createDataFrame([], "a long, b long"), at_once).count() == 0


def test_local_components_equal_union_find():
    r = random.Random(12)
    for n in (2, 10, 200):
        pairs = [(r.randrange(n) * 7, r.randrange(n) * 7) for _ in range(n)]
        union = graph.Union(7 * n)
        for a, b in pairs:
            union.join(a, b)
        node, label = graph.local_components(*np.array(pairs).T)
        assert dict(zip(node.tolist(), label.tolist(), strict=True)) == {x: union.find(x) for p in pairs for x in p}


def test_edges_of_families_follow_the_nodes_not_the_parts(spark):
    """However many parts deal out the keys of a family of near copies, its edges stay about as many as its nodes."""
    base, r, texts = prose(640, 300).split(), random.Random(64), []
    for i in range(200):
        words = list(base)
        words[r.randrange(300)] = f"own{i}"
        texts.append(" ".join(words))
    docs = table(spark, texts).select("doc_id", "text")
    for parts in (4, 64):
        blobs = jaccard_join.key_blobs(docs, parts, jaccard_join.Bands.of(75), 5)
        edges = jaccard_join.family_edges(jaccard_join.candidate_groups(blobs, parts).filter("role > 0"))
        assert 199 <= edges.count() < 400


# --- Lines ------------------------------------------------------------------------


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_distance_equals_the_plain_table():
    r = random.Random(3)
    for _ in range(2000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(0, 12))) for _ in range(2))
        most = r.randrange(0, 12)
        assert line_dedup.edit_distance(a, b, most) == min(levenshtein(a, b), most + 1)


def test_edits_of_many_pairs_equal_the_plain_table():
    r = random.Random(11)
    for letters in ("abc", "ab\u0939\U0001f600"):
        a, b = ([], [])
        for _ in range(300):
            text = [r.choice(letters) for _ in range(r.randrange(0, 40))]
            a.append("".join(text))
            for _ in range(r.randrange(0, 9)):
                at = r.randrange(0, len(text) + 1)
                text[at : at + r.randrange(0, 2)] = r.choice(["", r.choice(letters)])
            b.append("".join(text) if r.random() < 0.8 else "".join(r.choice(letters) for _ in range(30)))
        most = np.array([r.randrange(0, 12) for _ in a])
        assert line_dedup.edits(a, b, most).tolist() == [levenshtein(x, y) <= k for x, y, k in zip(a, b, most.tolist(), strict=True)]
        want = [levenshtein(x, y) <= int(0.15 * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b, strict=True)]
        assert line_dedup.all_alike(a, b, 0.85).tolist() == want and 0 < sum(want) < len(want)
    # Wide bands take numbers of two bytes.
    long = "".join(r.choice("abc") for _ in range(3000))
    assert line_dedup.edits([long] * 3, [long[300:], long[301:], long[:-300]], np.array([300, 300, 300])).tolist() == [True, False, True]
    assert line_dedup.all_alike([], [], 0.85).tolist() == []


def test_many_pairs_of_long_lines_are_refused_in_a_fraction_of_the_time():
    """Lines of the same words in another order: every one of them was compared alone."""
    r = random.Random(12)
    words = ["".join(r.choice("etaoinsh") for _ in range(r.randrange(2, 9))) for _ in range(60)]
    lines = [" ".join(r.sample(words, 60)) for _ in range(401)]
    start = time.perf_counter()
    assert not line_dedup.all_alike(lines[:-1], lines[1:], 0.85).any()
    at_once = time.perf_counter() - start
    start = time.perf_counter()
    for a, b in itertools.pairwise(lines):
        most = int(0.15 * max(len(a), len(b)))
        assert line_dedup.changed(a.split(" "), b.split(" "), most) > most and line_dedup.edit_distance(a, b, most) > most
    assert at_once < (time.perf_counter() - start) / 2


def test_small_families_are_compared_together(spark, tmp_path):
    rows = [(n // 3, n, n % 3) for n in range(150)] + [(50, 1000 + n, n % 2) for n in range(20)]
    members = stored(spark.createDataFrame(rows, "family long, node long, kind long"), "members-of-test")

    def links(together):
        seen = tmp_path / str(together)
        seen.mkdir()

        def compare(unit, across):
            (seen / f"{unit.column('node')[0]}-{unit.column('_lo')[0]}-{unit.column('_side')[0]}-{unit.num_rows}").touch()
            kind = unit.column("kind").to_numpy()
            return list(zip(*np.nonzero(across & (kind[:, None] == kind[None, :])), strict=True))

        found = {(x.a, x.b) for x in graph.verified_links(members, compare, 2, block=8, together=together).collect()}
        return found, len(list(seen.iterdir()))

    (alone, n_alone), (both, n_both) = links(False), links(True)
    assert both == alone and len(alone) > 50 and n_both < n_alone / 2


def plainly_normalised(line):
    """The normal form, written without the module's tables."""
    words = "".join(c.lower() if c.isascii() else c for c in line if not c.isascii() or c.isalnum() or c in " \t\v\f\r")
    words = re.sub("[ \t\v\f\r]+", " ", words).strip(" ").split(" ")
    return " ".join(words if len(words) >= 5 else re.sub("[ \t\v\f\r]+", " ", "".join(c.lower() if c.isascii() else c for c in line)).strip(" ").split(" "))


def brute_lines(texts, least=0.85):
    """All pairs of lines by plain edit similarity; no hash, sketch or candidate search."""
    first, places = {}, []
    for d, text in enumerate(texts):
        for i, line in enumerate((text or "").split("\n")):
            if key := plainly_normalised(line):
                places.append((d, i, key))
                first.setdefault(key, (d, i))
    keys = list(first)
    union = graph.Union(len(keys))
    for i, j in itertools.combinations(range(len(keys)), 2):
        a, b = keys[i], keys[j]
        most = int((1 - least) * max(len(a), len(b)) + 1e-9)
        if min(len(a), len(b)) >= line_dedup.LEAST_CHARS and abs(len(a) - len(b)) <= most and re.search("[a-z\x80-\U0010ffff]", a) and levenshtein(a, b) <= most:
            union.join(i, j)
    number = {k: i for i, k in enumerate(keys)}
    keep = {}
    for k, place in first.items():
        root = union.find(number[k])
        keep[root] = min(keep.get(root, place), place)
    cut = {(d, i) for d, i, k in places if keep[union.find(number[k])] != (d, i)}
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in cut) for d, t in enumerate(texts)]


def test_line_dedup_equals_brute_force(spark):
    base = [prose(s, 24) for s in range(12)]
    long = prose(99, 120)
    texts = [t for t in ODD if t is None or len(t) < 1000]
    texts += ["\n".join([base[i], f"{base[i + 1].upper()}!", near(base[i + 2], i), prose(50 + i, 9), near(long, 10 * i), "short line"]) for i in range(10)]
    docs = table(spark, texts)
    got = {r.doc_id: r for r in line_dedup.deduplicated(docs, drop_empty=False).collect()}
    assert [got[i].text for i in range(len(texts))] == brute_lines(texts)
    assert got[0].n_lines == 0 and got[0].words == "clash" and sum(r.n_cut for r in got.values()) > 15
    left = {r.doc_id for r in line_dedup.deduplicated(docs).collect()}
    assert left == {i for i, r in got.items() if not r.n_cut or r.text.strip()}
    assert line_dedup.deduplicated(empty(spark)).count() == 0


def test_line_dedup_does_not_depend_on_the_dealing(spark):
    """One chunk, or each document a chunk of its own: exact copies and families larger than a block are cut alike."""
    one = prose(55, 30)
    texts = ["\n".join([prose(4, 12), near(one, i % 30), f"own {prose(900 + i, 8)}", prose(4, 12)]) for i in range(60)]
    docs = table(spark, texts).select("doc_id", "text")
    found = [sorted((r.doc_id, r.text) for r in line_dedup.deduplicated(docs.repartition(n), drop_empty=False).collect()) for n in (1, 60)]
    assert found[0] == found[1]
    assert sum(text.count("\n") + 1 for _, text in found[0]) == 2 + 60


def test_lines_that_a_leader_refuses_meet_each_other(spark):
    """Halves that change places keep sketch and keys, but not the edit similarity."""
    texts = []
    for i in range(24):
        one, two = prose(7000 + i, 60), prose(8000 + i, 60)
        texts += [f"{one} {two}", f"{two} {one}", f"{two} {one} end"]
    docs = table(spark, texts).select("doc_id", "text")
    got = {r.doc_id: r.n_cut for r in line_dedup.deduplicated(docs, drop_empty=False).collect()}
    assert [got[i] for i in range(len(texts))] == [0, 0, 1] * 24


def test_what_near_entries_of_a_key_connect_stays_connected(monkeypatch):
    r = np.random.default_rng(3)
    monkeypatch.setattr(line_dedup, "PAIRS", 50)
    n, key = 400, r.integers(0, 12, 400)
    sim = r.integers(0, 1 << 63, 12, dtype=np.uint64)[key]
    for _ in range(16):
        sim ^= np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64)
    node, size = np.repeat(r.integers(0, 1 << 63, n // 2, dtype=np.uint64) * np.uint64(2), 2), r.integers(50, 57, n).astype(np.uint8)
    sim, size = np.repeat(sim[::2], 2), np.repeat(size[::2], 2)
    a, b = (np.concatenate(x).astype(np.int64) for x in zip(*line_dedup.met(key.astype(np.uint32), node, sim, size), strict=True))
    assert (a < b).all() and len(a) < n + 12 * 12
    group = dict(zip(*(x.tolist() for x in graph.local_components(a, b)), strict=True))
    pairs = [(i, j) for i, j in itertools.combinations(range(n), 2) if key[i] == key[j] and node[i] != node[j]]
    pairs = [(i, j) for i, j in pairs if int(sim[i] ^ sim[j]).bit_count() <= line_dedup.BITS and abs(int(size[i]) - int(size[j])) <= line_dedup.STEPS]
    signed = node.astype(np.int64).tolist()
    assert len(pairs) > 300 and all(group[signed[i]] == group[signed[j]] for i, j in pairs)


def test_clashing_columns_and_rows_without_an_id(spark):
    line = prose(5, 10)
    rows = [(1, f"{line}\nfirst", 7, "a", 1, None, 3), (None, f"{line}\n{line}", 8, "b", 2, None, 4), (None, "own words", 9, "c", 3, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, cut long, key string, n_cut int, at string, n_chars int")
    got = sorted(line_dedup.deduplicated(docs, drop_empty=False, report=False, n_chars="n_chars").collect(), key=lambda r: r.cut)
    assert got[0].asDict().keys() == {"doc_id", "text", "cut", "key", "n_cut", "at", "n_chars"}
    # The rows without an id are one document, the first of all.
    assert [(r.text, r.n_cut, r.n_chars) for r in got] == [("first", 1, 5), (line, 2, len(line)), ("own words", 3, 5)]


def test_every_line_takes_part_in_exact_deduplication(spark):
    lines = ["All rights reserved.", "Step 1", "12 345 67", "你好世界，今天天气很好", "***", "Step 2"]
    docs = table(spark, ["\n".join([*lines[:5], "first own", "", " "]), "\n".join([*lines, "second own", "", " "])]).select("doc_id", "text")
    got = {r.doc_id: r for r in line_dedup.deduplicated(docs).collect()}
    assert got[0].n_cut == 0 and got[1].text == "Step 2\nsecond own\n\n " and got[1].n_cut == 5


def test_lines_that_differ_in_numbers_are_kept(spark):
    texts = ["On 12.03.2019 he paid 400 dollars for it", "On 07.11.1987 he paid 9 dollars for it", "Room 12, floor 3, building 8 of the main campus", "Room 94, floor 7, building 1 of the main campus"]
    got = line_dedup.deduplicated(table(spark, texts).select("doc_id", "text")).collect()
    assert sorted((r.doc_id, r.n_cut) for r in got) == [(0, 0), (1, 0), (2, 0), (3, 0)]


def edited(text, share, r, alphabet):
    chars = list(text)
    for i in r.sample(range(len(chars)), max(1, round(share * len(chars)))):
        chars[i] = r.choice(alphabet)
    return "".join(chars)


@pytest.mark.parametrize(("share", "least"), [(0.01, 0.98), (0.03, 0.95), (0.05, 0.8), (0.1, 0.15)])
def test_recall_of_edited_lines(spark, share, least):
    """Lines of 5 to 40 words and lines without spaces, edited at random, against plain edit similarity."""
    r, pairs = random.Random(6), []
    letters, signs = "abcdefghijklmnopqrstuvwxyz", [chr(0x4E00 + k) for k in range(2000)]
    for i in range(400):
        if i % 5:
            text, alphabet = " ".join("".join(r.choice(letters) for _ in range(r.randrange(3, 8))) for _ in range(r.randrange(5, 41))), letters
        else:
            text, alphabet = "".join(r.choice(signs) for _ in range(r.randrange(30, 80))), signs
        other = edited(text, share, r, alphabet)
        if text != other and levenshtein(text, other) <= 0.15 * max(len(text), len(other)):
            pairs.append((text, other))
    docs = table(spark, [x for pair in pairs for x in pair]).select("doc_id", "text")
    cut = {x.doc_id for x in line_dedup.deduplicated(docs, drop_empty=False).filter("n_cut > 0").collect()}
    found = sum(2 * i + 1 in cut for i in range(len(pairs)))
    assert len(pairs) > 350 and not any(2 * i in cut for i in range(len(pairs)))
    assert found >= least * len(pairs)


# --- Language models ----------------------------------------------------------------


def test_marginal_probability_sums_over_all_segmentations():
    from lectern.llm import lattice as lat

    lattice = lat.loaded(tokenizer_path(PIECES))
    step = lattice.step(lattice.prior)[:, None]
    pieces = lattice.pieces

    def plain(text):
        """Every segmentation, one by one."""
        if not text:
            return 1.0
        return sum(math.exp(step[pieces[text[:n]], 0]) * plain(text[n:]) for n in range(1, len(text) + 1) if text[:n] in pieces)

    for word in ("a", "the", "nation", "thtion", "été"):
        assert math.isclose(lat.word_log_p(lattice, [word.encode()], step)[0, 0], math.log(plain(lat.MARK + word)), rel_tol=1e-9)
    uses = lat.expected_uses(lattice, [b"nation"], np.array([[3.0]]), step)
    covered = sum(uses[i, 0] * len(p) for p, i in pieces.items() if uses[i, 0])
    assert math.isclose(covered, 3 * len("▁nation"), rel_tol=1e-9)


def test_lm_scores(spark):
    texts = [*ODD, *(prose(s, 60) for s in range(30)), "tabs\tand\x0bfeeds naïve"]
    docs = table(spark, texts).select("doc_id", fold_is(F.col("doc_id"), 5, 1).alias("held_out"), "text")
    got = {r.doc_id: r for r in lm_scoring.score_documents(docs, tokenizer_path(PIECES), part_bytes=2000).collect()}
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    count = Counter(t for own, h in zip(tokens, held, strict=True) if not h for t in own)
    total = sum(count.values())
    for i, own in enumerate(tokens):
        base = sum(math.log10((count[t] + 0.5) / (total + 0.5 * (len(count) + 1))) for t in own)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(own), sum(count[t] > 0 for t in own), total)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9) and got[i].score <= 0
    assert got[3].score == got[4].score
    nothing = lm_scoring.score_documents(docs.withColumn("held_out", F.lit(True)), tokenizer_path(PIECES)).first()
    assert nothing.train_tokens == 0 and nothing.base_score == 0
    assert lm_scoring.score_documents(docs.limit(0), tokenizer_path(PIECES)).count() == 0


def test_lm_score_sums_all_segmentations(spark):
    """Piece probabilities by the same rounds, and every segmentation of every word one by one."""
    from lectern.llm import lattice as lat

    texts = ["the cat sat", "a catalogue of cats", "Ünï x", "", "the theatre", "cat"]
    docs = spark.createDataFrame([(i, i == 4, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string")
    got = {r.doc_id: r.score for r in lm_scoring.score_documents(docs, tokenizer_path(PIECES)).collect()}
    lattice = lat.loaded(tokenizer_path(PIECES))

    def segmentations(word, at=0):
        if at == len(word):
            yield ()
        for end in range(at + 1, len(word) + 1):
            piece = lattice.pieces.get(word[at:end], lattice.unknown if end == at + 1 else None)
            if piece is not None:
                for rest in segmentations(word, end):
                    yield (piece, *rest)

    count = Counter(w for i, t in enumerate(texts) if i != 4 for w in t.encode().lower().split())
    log_p, log_end = lattice.prior, 0.0
    for _ in range(2):
        step, uses = lattice.step(log_p), np.full(lattice.size + 1, lm_scoring.SMOOTHING)
        for word, n in count.items():
            every = list(segmentations(lat.MARK + word.decode()))
            p = np.array([np.exp(sum(step[x] for x in own)) for own in every])
            for own, share in zip(every, p / p.sum(), strict=True):
                for x in own:
                    uses[x] += n * share
        uses[-1] += 5
        log_p, log_end = np.log(uses[:-1] / uses.sum()), np.log(uses[-1] / uses.sum())
    step = lattice.step(log_p)
    for i, text in enumerate(texts):
        words = text.encode().lower().split()
        wanted = log_end + sum(np.log(sum(np.exp(sum(step[x] for x in own)) for own in segmentations(lat.MARK + w.decode()))) for w in words)
        assert math.isclose(got[i], wanted / math.log(10), rel_tol=1e-9)


def test_language_identification(spark):
    languages = {"en": "the of and to in that", "de": "der die und nicht ein ist schön", "fr": "le la les dans une été"}
    r, rows = random.Random(9), []
    for i in range(120):
        lang = sorted(languages)[i % 3]
        rows.append((i, " ".join(r.choice(languages[lang].split()) for _ in range(r.randrange(3, 40))), lang, "s", 0, "x", 0.0))
    odd = [(1000 + i, t, None, None, None, None, None) for i, t in enumerate([None, "", "123 456 !!", "der die und " * 5000])]
    docs = spark.createDataFrame(rows + odd, DOCS)
    model = language_id.train(docs.filter(~fold_is(F.col("doc_id"), 5, 0)), tokenizer_path(PIECES), max_train_docs=10_000)
    got = {r.doc_id: r for r in language_id.identify(docs, model, keep=("doc_id", "lang")).collect()}
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].lang_pred == rows[i][2] for i in held) and all(0 <= x.score <= 1 for x in got.values())
    assert [got[1000 + i].lang_pred for i in range(4)] == ["und", "und", "und", "de"] and got[1000].score == 0
    untrained = language_id.train(docs.limit(0), tokenizer_path(PIECES))
    assert language_id.identify(docs, untrained).filter("lang_pred <> 'und'").count() == 0


def test_language_scores_equal_brute_force(spark):
    """Every segmentation of every word, one by one, in each language's model."""
    rows = [(i, t, lang, "s", 0, "x", 0.0) for i, (t, lang) in enumerate([("the cat and the hat", "en"), ("der hut und die katze", "de"), ("the hen", "en"), ("der hahn", "de")] * 6)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.train(docs, tokenizer_path(PIECES))
    from lectern.llm import lattice as lat

    pieces = lat.loaded(model.path).pieces

    def plain(text, k):
        return sum(math.exp(model.step[pieces[text[:n]], k]) * plain(text[n:], k) for n in range(1, len(text) + 1) if text[:n] in pieces) if text else 1.0

    for text in ("the hat", "die katze und", "cat hut"):
        sums = [sum(math.log(plain(lat.MARK + w, k)) for w in text.split()) for k in range(len(model.languages))]
        predicted, score = language_id.predict(model, [text.encode()])
        assert predicted == [model.languages[int(np.argmax(sums))]]
        assert math.isclose(score[0], 1 / sum(math.exp(x - max(sums)) for x in sums), rel_tol=1e-9)
    assert language_id.predict(model, ["½ ² 12 ʹ!".replace("ʹ", "").encode(), b"", "é".encode()])[0][:2] == ["und", "und"]


def test_rare_languages_are_in_the_sample(spark):
    rows = [(i, f"common words number {i}", "en", "s", 0, "x", 0.0) for i in range(2000)] + [(5000 + i, "sanat ovat harvinaisia", "fi", "s", 0, "x", 0.0) for i in range(3)]
    docs = spark.createDataFrame(rows, DOCS)
    found = Counter(r["_lang"] for r in language_id.sampled(docs, "text", "lang", "doc_id", 200).collect())
    assert found["fi"] == 3 and 50 < found["en"] < 150


# --- Quality ---------------------------------------------------------------------------


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    texts = [*ODD, "a b c a b c\na b c a b c\n\n \n", "# $$ <b>| x", *(prose(s, 80) for s in range(120)), *(" ### ".join(prose(s, 60).split()) for s in range(5))]
    got = {r.doc_id: r for r in quality.judged(table(spark, texts)).collect()}
    for i, text in enumerate(texts):
        g, own = got[i], brute_statistics(text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == own
        assert g.base_failed == (own[0] < 50 or 100 * own[4] > 50 * own[0])
    start = len(ODD) + 2
    assert all(got[i].kept for i in range(start, start + 120)) and not any(got[i].kept for i in range(start + 120, start + 125))
    assert not got[0].kept and got[3].distance == got[4].distance
    assert quality.judged(empty(spark)).count() == 0


def test_repeats_alone_make_outliers(spark):
    """Where a group has next to none, repeated lines and words within the base rules are rejected."""
    texts = [prose(3000 + s, 80) for s in range(150)]
    for s in range(5):
        own = prose(4000 + s, 100).split()
        texts.append("\n".join(f"{' '.join(own[i : i + 5])}\nok" if i < 55 else " ".join(own[i : i + 5]) for i in range(0, 100, 5)))
    for s in range(5):
        again = " ".join(prose(5000 + s, 15).split())
        texts.append(f"{again} {prose(5100 + s, 40)} {again} {prose(5200 + s, 30)}")
    got = {r.doc_id: r for r in quality.judged(table(spark, texts)).collect()}
    for i in range(150, 160):
        assert not got[i].base_failed and not got[i].kept
    assert all(0.3 <= got[i].n_dup_lines / 31 <= 0.75 and got[i].n_repeat_words < 0.2 * got[i].n_words for i in range(150, 155))
    assert all(0.2 <= got[i].n_repeat_words / got[i].n_words <= 0.5 and got[i].n_dup_lines == 0 for i in range(155, 160))
    assert sum(got[i].kept for i in range(150)) >= 145


def test_estimates_are_robust_and_native(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.multivariate_normal([1, 2, 0, 0], np.diag([0.5, 0.3, 0.4, 0.2]) ** 2, 800), r.normal(9, 0.1, (150, 4))])
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "group string, x0 double, x1 double, x2 double, x3 double")
    p = quality.robust_estimates(rows, list(quality.FLOORS)).first()
    assert abs(p.m0 - 1) < 0.1 and abs(p.m1 - 2) < 0.1 and abs(p.l00 - 0.5) < 0.1
    plan = quality.judged(table(spark, ["a"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert math.isclose(quality.chi2_cdf(quality.chi2_quantile(0.75, 4), 4), 0.75, rel_tol=1e-9)


# --- Chats -------------------------------------------------------------------------------

MESSAGES = "conv long, msg long, parent long, role string, text string, score double"


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", None, 0.5), (1, 5, 99, "user", "orphan", 0.2), (2, 1, 2, "user", "loop", 1.0), (2, 2, 1, "user", "loop", 1.0), (None, 1, 0, None, "null conv", 0.0)]
    found = chat_format.branches(spark.createDataFrame(rows, MESSAGES), top=None)
    got = {(r.conv, r.branch): [t.text for t in r.turns] for r in found.collect()}
    assert got == {(1, 1): ["q", "good", None], (1, 2): ["orphan"], (1, 3): ["q", "bad"], (None, 1): ["null conv"]}
    long = [(3, i, i - 1, "user", str(i), 0.0) for i in range(1, 300)]
    best = chat_format.branches(spark.createDataFrame(rows + long, MESSAGES))
    turns = {r.conv: [t.text for t in r.turns] for r in best.collect()}
    assert turns[3] == [str(i) for i in range(1, 300)] and turns[1] == ["q", "good", None]
    assert chat_format.branches(spark.createDataFrame([], MESSAGES)).count() == 0


def test_formatting_is_reversible():
    r = random.Random(8)
    bits = [*chat_format.CONTROL, "\\", "n", "<", "|", "[", "\n", "x", "é"]
    for _ in range(2000):
        turns = [("".join(r.choices(bits, k=r.randrange(0, 4))) if r.random() < 0.3 else r.choice(["user", "assistant"]), "".join(r.choices(bits, k=r.randrange(0, 9)))) for _ in range(r.randrange(0, 5))]
        text, mask = chat_format.formatted(turns)
        assert chat_format.read_back(text) == turns
        assert [chat_format.unescape(text[a:b]) for a, b in mask] == [t for role, t in turns if role == "assistant"]
        assert text.count(chat_format.START) == text.count(chat_format.STOP) == len(turns)


# --- Pages --------------------------------------------------------------------------------


def page(i, body, menu="Home"):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li>{menu}</ul></nav><header><h2>Site</h2></header><div class='sidebar'>side {i}</div><div id=top><p>Welcome to our site</p></div><article><header><h1>Title {i}</h1></header>{body}<div class='comments'><article><p>nice!</p></article></div><div class=hint>Read more here</div></article><form>f<input></form><aside>a</aside><footer>&copy; {i}</footer></body></html>"


def test_pages(spark):
    bodies = [f"<p>First &amp; <b>bo</b>ld {i}<p>Second\n  line&nbsp;{i}<br>after<!-- no --><ul><li>one<li>two</ul>" for i in range(12)]
    rows = [(i, f"http://a.example/{i}", page(i, b)) for i, b in enumerate(bodies)]
    rows += [(100, None, None), (101, "http://b.example/", ""), (102, "http://c.example/", "<div>only <i>t</i>ext</div><p>more"), (103, "http://c.example/2", "<main><p>main part</main><p>tail"), (104, "x", "<p title='a>b\">q</p><" + "<div>" * 3000 + "deep"), (0, "http://a.example/0", rows[0][2])]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = defaultdict(set)
    for r in html_extraction.extract_pages(docs).collect():
        got[r.page_id].add((r.text, r.n_chars))
    for i in range(12):
        text = f"Title {i} First & bold {i} Second line {i} after one two"
        assert got[i] == {(text, len(text))}
    assert got[100] == got[101] == {("", 0)}
    assert got[102] == {("only text more", 14)} and got[103] == {("main part", 9)}
    assert next(iter(got[104]))[0].endswith("deep")
    assert html_extraction.extract_pages(docs.limit(0)).count() == 0


def test_templates_mark_constant_nodes():
    pages = [page(i, f"<p>own {i}</p>") for i in range(6)]
    wrapper = html_extraction.learn(pages)
    tree = html_extraction.parse(pages[0])
    html_extraction.mark(wrapper, tree)
    queue, constant = [tree], []
    while queue:
        node = queue.pop()
        queue += node.children()
        if node.template:
            constant.append(node.own_text())
    assert "Welcome to our site" in constant and "Read more here" in constant and "own 0" not in constant


def test_names_that_only_mention_something_else():
    read = lambda page: html_extraction.extract(page, None)
    assert read('<div class="layout no-sidebar"><h1>T</h1><p>Body text here</p></div>') == "T Body text here"
    assert read('<div class="post ad-free"><p>Text</p></div>') == "Text"
    assert read('<p data-id="share">Text</p><p class="share">More</p>') == "Text More"
    assert read('<div data-role="navigation"><p>Text</p></div>') == "Text"
    assert read("<main><p>Intro</p><article>Teaser</article><p>Rest</p></main>") == "Intro Teaser Rest"
    assert read('<div class="cookie-banner">We use cookies</div><div role="navigation">Home</div><p>Text</p>') == "Text"
    assert read('<article>One</article><article>Two</article><div>Side</div>') == "One Two"


def extracted(spark, hosts):
    """Texts by host of pages given as host to list of html."""
    rows = [(1000 * n + i, f"http://{host}/{i}", page) for n, (host, pages) in enumerate(hosts.items()) for i, page in enumerate(pages)]
    got = {r.page_id: r.text for r in html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return {host: [got[1000 * n + i] for i in range(len(pages))] for n, (host, pages) in enumerate(hosts.items())}


def test_all_pages_of_a_host_count(spark):
    """A block on a third of the pages, and hosts of four pages."""
    club = "<section class=club><h3>Join the club today</h3></section>"
    many = [f"<article><h1>Title {i}</h1>{club if i % 3 == 2 else ''}<p>A text of its own that goes on for long, {prose(i, 20)}</p></article>" for i in range(60)]
    few = {f"few{h}": [f"<article><h1>Page {i} {h}</h1>{club}<p>{prose(100 * h + i, 20)}</p></article>" for i in range(4)] for h in range(8)}
    got = extracted(spark, {"many": many, **few})
    assert not any("club" in text for texts in got.values() for text in texts)
    assert all(got["many"][i].startswith(f"Title {i} A text") for i in range(60))


def test_blocks_in_runs_of_siblings_are_template(spark):
    bodies = [f"<div id=top>Welcome all</div><div id=body{i}><h1>T {i}</h1><p>own {i} <b>and</b> {prose(i, 20)}</p><p>Subscribe to <a>our letter</a></p><p>more {i}</p></div><div id=foot>Contact us</div>" for i in range(6)]
    got = extracted(spark, {"plain": bodies})["plain"]
    assert got == [" ".join(f"T {i} own {i} and {prose(i, 20)} more {i}".split()) for i in range(6)]


def test_templates_hold_whatever_their_length(spark):
    """Short articles under long boilerplate lose it; copies of one page keep their text."""
    legal = f"<div class=x><p>{prose(77, 200)}</p></div>"
    short = [f"<section><p>Short {i}</p></section>{legal}" for i in range(6)]
    copies = [f"<!-- {i} --><article><p>{prose(78, 50)}</p></article>" for i in range(6)]
    got = extracted(spark, {"short": short, "copies": copies})
    assert got["short"] == [f"Short {i}" for i in range(6)]
    assert got["copies"] == [prose(78, 50)] * 6


def test_robust_estimates_equal_numpy(spark):
    """The same starts and steps over all rows, and no greater a determinant than that of many random starts."""
    r = np.random.default_rng(5)
    dims, groups = list(quality.FLOORS), {}
    for g, n in (("a", 400), ("b", 90), ("c", 60)):
        x = r.normal([1.6, 0.3, 0.2, 0.4], [0.2, 0.15, 0.3, 0.25], (n, 4))
        x[:, 3] += 0.8 * x[:, 0]
        x[: n // 5] += [3, 1, 0, 2]  # outliers in a place of their own
        groups[g] = x
    rows = spark.createDataFrame([(g, *map(float, v)) for g, x in groups.items() for v in x], "group string, " + ", ".join(f"{d} double" for d in dims)).repartition(5)
    got = {row.group: row for row in quality.robust_estimates(rows, dims).collect()}
    share, scale = quality.SHARE, quality.SHARE / quality.chi2_cdf(quality.chi2_quantile(quality.SHARE, 4), 6)
    floors = np.array(list(quality.FLOORS.values())) ** 2

    def floored(s):
        s = s.copy()
        np.fill_diagonal(s, np.maximum(np.diag(s), floors))
        return s

    def step(x, m, s):
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
        bins = np.floor(np.log(d + 1e-9) * quality.BINS)
        cut = min(b for b in set(bins) if (bins <= b).sum() >= share * len(x))
        core = x[bins <= cut]
        return core.mean(axis=0), floored(scale * np.cov(core.T, bias=True))

    def settled(x, m, s, n):
        for _ in range(n):
            m, s = step(x, m, s)
        return m, s

    for g, x in groups.items():
        q = np.percentile(x, [25, 50, 75], axis=0, method="inverted_cdf")
        trials = [settled(x, q[1], s, quality.TRIALS) for s in (np.diag(floors), floored(np.diag(((q[2] - q[0]) / 1.349) ** 2)))]
        m, s = settled(x, *min(trials, key=lambda p: np.linalg.det(p[1])), 40)
        lower = np.array([[got[g][f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        assert np.allclose([got[g][f"m{i}"] for i in range(4)], m, atol=1e-7) and np.allclose(lower @ lower.T, s, atol=1e-7)
        others = [settled(x, x[k].mean(axis=0), floored(np.cov(x[k].T)), 20)[1] for k in (r.choice(len(x), 6, replace=False) for _ in range(60))]
        assert np.linalg.det(s) <= 1.05 * min(map(np.linalg.det, others))


def test_entries_of_sets_stay_small_however_many_parts(spark):
    docs = spark.createDataFrame([(i, prose(i, 400)) for i in range(60)] + [(60, prose(60, 30_000))], "doc_id long, text string")
    bands = jaccard_join.Bands.of(75)
    hashes, sizes = jaccard_join.shingle_sets([r.text.encode() for r in docs.sort("doc_id").collect()])
    n = len(jaccard_join.entries(hashes, sizes, jaccard_join.set_nodes(hashes, sizes), bands)[0])
    for parts, most in ((2, 5.5), (4000, 14.5)):
        blobs = jaccard_join.key_blobs(docs, parts, bands, jaccard_join.WIDTH).filter("part >= 0")
        size = blobs.agg(F.sum(sum(F.octet_length(c) for c in blobs.columns if c != "part"))).first()[0]
        assert size <= most * n
    node = np.repeat(np.array([3, 5, 9], np.uint64), [1, 600, 255])
    assert jaccard_join.run_starts(node).tolist() == [0, 1, 256, 511, 601]


def test_keys_of_large_inputs_are_dealt_out_to_few_parts(spark, monkeypatch):
    """A set costs its node in each part, so parts are an eighth of those of the input; what is found in slices is the same."""
    docs = spark.createDataFrame([(i, " ".join([prose(i // 3, 200), f"own{i}"])) for i in range(60)], "doc_id long, text string")
    seen, own = [], jaccard_join.key_blobs
    monkeypatch.setattr(jaccard_join, "key_blobs", lambda docs, parts, *rest: seen.append(parts) or own(docs, parts, *rest))
    monkeypatch.setattr(jaccard_join, "partitions", lambda docs: 600)
    blobs = jaccard_join.similar_documents(docs)
    assert seen == [75]
    assert {r.component_id for r in blobs.collect()} == set(range(0, 60, 3))
    found = []
    for slices in (1, 8):
        monkeypatch.setattr(jaccard_join, "SLICES", slices)
        groups = jaccard_join.candidate_groups(own(docs, 4, jaccard_join.Bands.of(75), 5), 4)
        found.append(sorted((r.gid, r.node, r.role) for r in groups.collect()))
    assert found[0] == found[1] and found[0]
