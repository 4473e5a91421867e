"""The trie against brute force over all prefixes, with many ranges and odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm import prefix_trie
from lectern.llm.common import stored
from lectern.llm.queries import op12_prefix_trie, rebuilt_paths

TURNS = "conv_id long, turn long, role string, text string, conv string, path string, part int, key string"


def table(spark, rows):
    # Extra columns whose names the operator uses itself.
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], TURNS)


def in_order(rows):
    def key(r):
        role, text = ((x or "").encode() for x in r[2:])
        return r[1] is not None, r[1] or 0, hashlib.md5(f"{len(role)}:".encode() + role + text).digest()

    out = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        out[r[0]].append((r[2] or "", r[3] or ""))
    return dict(out)


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = convs.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])
        out[c] = base[:h] + own[h:]
    return out


def brute(convs):
    """depth, prefix: all that is asked of its node, from every prefix of every conversation."""
    members = defaultdict(set)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].add(c)
    children = defaultdict(set)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].add(prefix)
    out = []
    for prefix, own in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        ends = sorted(c for c in own if len(convs[c]) == len(prefix))
        out.append((
            min(own), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(own), len(children[prefix]), sum(not children[p] for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def found(nodes):
    return sorted((tuple(r) for r in nodes.collect()), key=repr)


def some_turns(seed, n=60, texts=3, longest=7):
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "bot"]), r.choice("aéx"[:texts]) * r.randrange(1, 3)) for c in range(n) for t in range(r.randrange(longest + 1))]
    return rows


ODD = [(90, None, "user", "null first"), (90, 0, None, None), (90, 0, None, None), (90, 0, "user", ""), (-3, 5, "user", "b"), (-1, 1, "user", "a"), (None, 1, "user", "a"), (91, 1, "user" * 30_000, "long" * 100_000)]


@pytest.mark.parametrize("parts", [1, 4, 13])
@pytest.mark.parametrize("seed", [0, 1])
def test_trie_equals_brute_force(spark, parts, seed):
    rows = some_turns(seed) + ODD
    paths = stored(prefix_trie.conversation_paths(table(spark, rows)), "test-paths")
    assert found(prefix_trie.prefix_nodes(paths, parts=parts)) == brute(in_order(rows))


def test_one_common_conversation_and_nested_ones(spark, monkeypatch):
    """A third of all conversations alike, in packed rows of few ids, and paths that are each other's prefixes."""
    monkeypatch.setattr(prefix_trie, "PACK", 7)
    rows = [(c, t, "user", f"turn {t}") for c in range(100, 150) for t in range(5)] + [(c, t, "user", f"turn {t}") for c in range(40) for t in range(c)]
    paths = stored(prefix_trie.conversation_paths(table(spark, rows)), "test-paths")
    for parts in (1, 6):
        assert found(prefix_trie.prefix_nodes(paths, parts=parts)) == brute(in_order(rows))


def test_ranges_of_any_cut_give_the_same_nodes():
    """Ranges of one or two paths each: nearly all nodes are open."""
    import pyarrow as pa

    r = random.Random(4)
    every = sorted({tuple(bytes([r.randrange(3)]) for _ in range(r.randrange(8))) for _ in range(80)})
    rows = [{"path": list(p), "sizes": [1 + x[0] for x in p], "n": 1 + i % 3, "conv": i, "ends": f"e{i}"} for i, p in enumerate(every)]
    whole = prefix_trie.nodes_of_range(pa.Table.from_pylist(rows), None, None)
    assert not any(whole["open"]) and whole["parent_conv"].count(None) == 1
    wanted = sorted(zip(*(whole[k] for k in ("depth", "conv", "n", "children", "leaves", "saved", "ends")), strict=True))
    for size in (1, 2, 5, 79):
        merged, got = {}, []
        for at in range(0, len(rows), size):
            near = [rows[i]["path"] if 0 <= i < len(rows) else None for i in (at - 1, at + size)]
            part = prefix_trie.nodes_of_range(pa.Table.from_pylist(rows[at : at + size][::-1]), *near)
            for key, open_, *node in zip(*(part[k] for k in ("key", "open", "depth", "conv", "n", "children", "leaves", "saved", "ends")), strict=True):
                if not open_:
                    got.append(tuple(node))
                elif key in merged:
                    a = merged[key]
                    merged[key] = (node[0], min(a[1], node[1]), *(x + y for x, y in zip(a[2:6], node[2:6], strict=True)), max(a[6], node[6]))
                else:
                    merged[key] = tuple(node)
        assert sorted(got + list(merged.values())) == wanted


def test_query_equals_brute_force(spark, tmp_path):
    rows = some_turns(7, 120, longest=12) + ODD
    table(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = op12_prefix_trie(spark, str(tmp_path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {k for n, k in got.dtypes if n != "ends_sha256"} == {"bigint"}
    assert found(got) == brute(rebuilt(in_order(rows)))


def test_rebuilt_conversations_without_a_turn(spark, tmp_path):
    rows = [(c, 1, "user", "x") for c in (6, 7, 8, 9)]
    paths = prefix_trie.conversation_paths(table(spark, rows))
    got = {r.conv: len(r.steps) for r in rebuilt_paths(paths).collect()}
    assert got == {c: len(p) for c, p in rebuilt(in_order(rows)).items()} and 0 in got.values()
    table(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    assert found(op12_prefix_trie(spark, str(tmp_path))) == brute(rebuilt(in_order(rows)))


def test_empty_table_has_no_node(spark, tmp_path):
    table(spark, []).write.parquet(str(tmp_path / "conversations.parquet"))
    assert op12_prefix_trie(spark, str(tmp_path)).filter(F.lit(True)).count() == 0
