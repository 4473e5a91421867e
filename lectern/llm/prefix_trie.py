"""Prefix trie of conversations by Patricia construction.

A conversation is a path of turn digests.  Equal paths are counted before they are
dealt out by range, so paths that share a prefix come to lie side by side and no
prefix, however common, is a task of its own.  Each range then makes its part of
the compressed trie in one pass over its sorted paths: points only where paths
branch, end, or are childless, from the lengths of the prefixes that neighbours
share.  Aggregates are computed on the points, and unary nodes are expanded from
sums of bytes along the edges.

A node whose paths reach into the next range is open.  Its aggregates are sums and
minima over ranges, as every node counts as begun in one range alone, that of its
first path; so one aggregation by digest merges them.  There are as many open
nodes as ranges times turns, not as conversations.

Defined cases: a null role or text is the empty string; turns go by number, null
first, and turns of one number by their digest; repeated rows are turns of their
own; a conversation without a turn belongs to the root and ends there; rows
without a conversation are left out; an empty table has no node.  One conversation
is held by one task (20 bytes a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import checked, forget, partitions, stored

#: Ids of one packed row.
PACK = 2048
NO_ENDS = hashlib.sha256().hexdigest()
NODES = "depth long, key binary, parent_key binary, conv long, parent_conv long, n long, children long, leaves long, saved long, ends string, open boolean"


def conversation_paths(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, steps: the digest of role and text, and the text's bytes, of each turn in order."""
    role, text = (F.coalesce(turns[k].cast("string"), F.lit("")) for k in (role, text))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    number = turns[turn].cast("long")
    rows = turns.select(turns[conv].cast("long").alias("conv"), F.struct(number.isNotNull().alias("numbered"), F.coalesce(number, F.lit(0)).alias("number"), digest.alias("digest"), F.octet_length(text).alias("size")).alias("turn"))
    ordered = F.array_sort(F.collect_list("turn"))
    return rows.filter("conv IS NOT NULL").groupBy("conv").agg(F.transform(ordered, lambda x: F.struct(x.digest.alias("digest"), x.size.alias("size"))).alias("steps"))


def ends_digests(members: DataFrame, parts: int) -> DataFrame:
    """key, ends: SHA-256 of the ids (conv) of each key in order.

    Ids are sorted over all tasks and packed before those of one key meet, and are
    hashed as they stream by.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, last = [], None
            for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist(), strict=True):
                if key != last or len(out[-1][2]) >= PACK:
                    out.append((key, conv, []))
                out[-1][2].append(str(conv))
                last = key
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([",".join(x[2]) for x in out], pa.string())], names=["key", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        for batch in batches:
            out = []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key == last:
                    sha.update(b"," + ids.encode())
                    continue
                if last is not None:
                    out.append((last, sha.hexdigest()))
                last, sha = key, hashlib.sha256(ids.encode())
            yield _ends(out)
        yield _ends([] if last is None else [(last, sha.hexdigest())])

    packed = members.repartitionByRange(parts, "key", "conv").sortWithinPartitions("key", "conv").mapInArrow(pack, "key string, first long, ids string")
    return packed.repartition(parts, "key").sortWithinPartitions("key", "first").mapInArrow(digest, "key string, ends string")


def _ends(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.string()) for k in (0, 1)], names=["key", "ends"])


def shared(a: list[bytes], b: list[bytes]) -> int:
    """How many steps two paths begin with in common."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


class Trie:
    """Points of the compressed trie of sorted, distinct paths: where they branch, end, or are childless."""

    def __init__(self, paths: list[list[bytes]]):
        #: Of each point: steps from the root, the first and last of its paths, its parent, and the path that ends there.
        self.depth, self.first, self.last, self.parent, self.end = [0], [0], [len(paths) - 1], [-1], [-1]
        stack = [0]
        for i, path in enumerate(paths):
            common = shared(paths[i - 1], path) if i else 0
            while self.depth[stack[-1]] > common:
                below = stack.pop()
                self.last[below] = i - 1
                if self.depth[stack[-1]] < common:
                    self.parent[below] = self._point(common, self.first[below], stack[-1])
                    stack.append(self.parent[below])
            if len(path):
                stack.append(self._point(len(path), i, stack[-1]))
            self.end[stack[-1]] = i

    def _point(self, depth: int, first: int, parent: int) -> int:
        for of, value in ((self.depth, depth), (self.first, first), (self.last, None), (self.parent, parent), (self.end, -1)):
            of.append(value)
        return len(self.depth) - 1

    def close(self, n: int) -> None:
        """Points that reach to the end."""
        self.last = [n - 1 if x is None else x for x in self.last]

    def upwards(self) -> list[int]:
        """All points, children before their parents."""
        return sorted(range(len(self.depth)), key=self.depth.__getitem__, reverse=True)


def nodes_of_range(rows: pa.Table, before: list[bytes] | None, after: list[bytes] | None) -> dict[str, list]:
    """All nodes of a range of paths, as columns of ``NODES``; ``before`` and ``after`` are its neighbours' paths."""
    rows = rows.take(pa.array(sorted(range(rows.num_rows), key=(paths := rows.column("path").to_pylist()).__getitem__)))
    paths.sort()
    count, low, ends = (rows.column(k).to_pylist() for k in ("n", "conv", "ends"))
    #: Bytes of the first d texts of each path.
    bytes_to = [[0, *accumulate(x)] for x in rows.column("sizes").to_pylist()]
    # To which depth the nodes of the first and of the last path are open.
    left = -1 if before is None else shared(before, paths[0])
    right = -1 if after is None else shared(paths[-1], after)
    trie = Trie(paths)
    trie.close(len(paths))
    size = len(trie.depth)
    n, conv, children, leaves, saved, own = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size, [""] * size

    inner = set(trie.parent)

    def begun(v: int) -> int:
        """Nodes of this edge down to here began in an earlier range."""
        return left if trie.first[v] == 0 else -1

    def along(v: int, start: int, stop: int) -> int:
        """What the nodes of edge ``v`` at depths after ``start`` to ``stop`` save; each counts as one less where it begins."""
        to = bytes_to[trie.first[v]]
        return n[v] * (to[stop] - to[start]) - (to[stop] - to[min(stop, max(start, begun(v)))])

    for v in trie.upwards():
        if (i := trie.end[v]) >= 0:
            n[v] += count[i]
            conv[v] = low[i] if conv[v] is None else min(conv[v], low[i])
            own[v] = ends[i]
        # The last path may go on in the next range.
        if v not in inner and not (trie.last[v] == len(paths) - 1 and right >= trie.depth[v]):
            leaves[v] = 1
        if (up := trie.parent[v]) >= 0:
            n[up] += n[v]
            conv[up] = conv[v] if conv[up] is None else min(conv[up], conv[v])
            leaves[up] += leaves[v]
            children[up] += begun(v) <= trie.depth[up]
            saved[up] += saved[v] + along(v, trie.depth[up], trie.depth[v])

    out: dict[str, list] = {x.split(" ")[0]: [] for x in NODES.split(", ")}
    for v in range(size):
        path, start, stop = paths[trie.first[v]], trie.depth[trie.parent[v]] if v else -1, trie.depth[v]
        # The edge's nodes down to this depth are open: the last path's are where it ends here, the first path's where it begins.
        reach = max(begun(v), right if trie.last[v] == len(paths) - 1 else -1)
        digest = hashlib.md5(b"".join(path[: max(start, 0)]))
        # An open node's parent is open, too.
        above = digest.digest() if start >= 0 and start <= reach_of(trie, trie.parent[v], left, right, len(paths)) else None
        for depth in range(start + 1, stop + 1):
            key = None
            if depth <= reach:
                if depth:
                    digest.update(path[depth - 1])
                key = digest.digest()
            known = depth > 0 and above is None
            out["depth"].append(depth)
            out["key"].append(key)
            out["parent_key"].append(above)
            out["conv"].append(conv[v])
            out["parent_conv"].append((conv[trie.parent[v]] if depth == start + 1 else conv[v]) if known else None)
            out["n"].append(n[v])
            out["children"].append(children[v] if depth == stop else int(begun(v) <= depth))
            out["leaves"].append(leaves[v])
            out["saved"].append(saved[v] + (along(v, depth - 1, stop) if depth else 0))
            out["ends"].append(own[v] if depth == stop else "")
            out["open"].append(depth <= reach)
            above = key
    return out


def reach_of(trie: Trie, v: int, left: int, right: int, n: int) -> int:
    """To which depth the nodes above and at point ``v`` are open."""
    return max(left if trie.first[v] == 0 else -1, right if trie.last[v] == n - 1 else -1)


def prefix_nodes(paths: DataFrame, *, parts: int | None = None) -> DataFrame:
    """One row for each node of the trie of ``paths`` (conv, steps as ``conversation_paths`` gives them; stored).

    conv (smallest member), depth, parent_conv, n (members), children, leaves (below or
    at it), saved (sum over its subtree of the bytes of each node's last text, once for
    each member but one) and ends (SHA-256 of the members that end there).
    """
    parts = parts or partitions(paths)
    listed = paths.select("conv", F.col("steps.digest").alias("path"), F.col("steps.size").alias("sizes"))
    key = F.md5(F.array_join(F.transform("path", F.hex), ""))
    # Equal digests have texts of equal size.
    counted = listed.groupBy("path").agg(F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv").alias("conv")).withColumn("key", key)
    distinct = counted.join(ends_digests(listed.select(key.alias("key"), "conv"), parts), "key").drop("key")
    ranged = stored(distinct.repartitionByRange(parts, "path").withColumn("part", F.spark_partition_id()), "trie-paths")
    # A row for each range.
    order = Window.orderBy("part")
    bounds = ranged.groupBy("part").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    bounds = bounds.select("part", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))

    def run(rows: pa.Table, bound: pa.Table) -> pa.Table:
        found = nodes_of_range(rows, *(bound.column(k)[0].as_py() for k in ("before", "after")))
        kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
        return pa.table({k: pa.array(found[k], kinds[kind]) for k, kind in (x.split(" ") for x in NODES.split(", "))})

    nodes = stored(ranged.groupBy("part").cogroup(bounds.groupBy("part")).applyInArrow(run, NODES), "trie-nodes")
    sums = [F.sum(k).alias(k) for k in ("n", "children", "leaves", "saved")]
    merged = nodes.filter("open").groupBy("key", "depth").agg(F.first("parent_key").alias("parent_key"), F.min("conv").alias("conv"), *sums, F.max("ends").alias("ends"))
    merged = stored(merged, "trie-open")
    forget(ranged)
    names = ["conv", "depth", "parent_conv", "n", "children", "leaves", "saved", "ends"]
    closed = nodes.filter("NOT open")
    above = checked(merged).select(F.col("key").alias("parent_key"), F.col("conv").alias("_conv"))
    below = merged.select("parent_key", *(k for k in names if k != "parent_conv")).unionByName(closed.filter("parent_key IS NOT NULL").select("parent_key", *(k for k in names if k != "parent_conv")))
    below = below.join(above, "parent_key", "left").withColumnRenamed("_conv", "parent_conv")
    return closed.filter("parent_key IS NULL").select(names).unionByName(below.select(names)).withColumn("ends", F.when(F.col("ends") == "", NO_ENDS).otherwise(F.col("ends")))
