"""Connected components, and verification of candidate families in bounded blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import checked, forget, renamed, stored

#: Nodes of one block: a task compares two blocks of a family at most.
BLOCK = 256
#: Edges for each file of the tables that a round of ``components`` writes; edges that one task solves (16 MB).
EDGES_A_FILE, EDGES_A_TASK = 500_000, 1_000_000
LABELS = "node long, label long"


def _simple(edges: DataFrame, files: int | None = None) -> DataFrame:
    """Each edge once, from its smaller node; no loops."""
    return stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", files=files)


def components(edges: DataFrame, at_once: int = EDGES_A_TASK) -> DataFrame:
    """node, component (its smallest node) for all nodes of ``edges`` (a long, b long); a ``stored`` table.

    Each round hooks every node to its first neighbour, shortens the hooks once, and
    contracts the graph to the nodes hooked to, so edges shrink from round to round;
    what is left is solved by one task as soon as it is no more than ``at_once``
    edges.  First is the smallest in the first round, which ends stars at once, and
    after that a hash's smallest, so that no order of the ids makes long chains.  The
    hooks are mergeable aggregates and their table is broadcast or joined with skew
    handling, so a node with very many edges is no task of its own.  Only counts reach
    the driver.
    """
    edges, hooks = stored(edges.filter("a <> b"), "edges"), []
    while (n := edges.count()) > at_once:
        order = F.xxhash64 if hooks else lambda node, _: F.col(node)
        seed, files = F.lit(len(hooks)), 1 + n // EDGES_A_FILE
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", order("b", seed)).alias("b"))
        up = stored(first.select("node", F.when(order("b", seed) < order("node", seed), F.col("b")).otherwise(F.col("node")).alias("up")), "hooks", files=files)
        top = checked(up).select(F.col("node").alias("up"), F.col("up").alias("label"))
        hooks.append(stored(up.join(top, "up").select("node", "label"), "labels", files=files))
        to = checked(hooks[-1])
        ends = [to.select(F.col("node").alias(end), F.col("label").alias(f"_{end}")) for end in ("a", "b")]
        old, edges = edges, _simple(edges.join(ends[0], "a").join(ends[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")), files)
        forget(old, up)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.empty((2, 0), np.int64), *(np.stack([batch.column(k).to_numpy() for k in ("a", "b")]) for batch in batches)]
        node, label = local_components(*np.concatenate(own, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], names=["node", "label"])

    label = stored(edges.coalesce(1).mapInArrow(solve, LABELS), "labels")
    forget(edges)
    # From the last round back: where the node that each node was hooked to has ended.
    for hook in reversed(hooks):
        end = checked(label).select(F.col("node").alias("label"), F.col("label").alias("end"))
        old, label = label, stored(hook.join(end, "label", "left").select("node", F.coalesce("end", "label").alias("label")), "labels")
        forget(old, hook)
    if not hooks:
        return renamed(label, "node", "component")
    least = stored(label.groupBy("label").agg(F.min("node").alias("component")), "least")
    out = stored(label.join(checked(least), "label").select("node", "component"), "components")
    forget(label, least)
    return out


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes, and the smallest node that edges a, b connect with each."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(node))
    while len(a):
        low = np.minimum(label[a], label[b])
        for end in (label[a], label[b]):
            np.minimum.at(label, end, low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return node, node[label]


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def linked(candidates: Iterator[tuple[int, int]], n: int, similar: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Links that connect what the candidates connect; pairs that are connected already aren't compared."""
    union, out = Union(n), []
    for i, j in candidates:
        if union.find(i) != union.find(j) and similar(i, j):
            union.join(i, j)
            out.append((i, j))
    return out


Compare = Callable[[pa.Table, np.ndarray], list[tuple[int, int]]]


def verified_links(members: DataFrame, compare: Compare, parts: int, block: int = BLOCK, center: str = "node", together: bool = False) -> DataFrame:
    """a, b: links within families.  ``members`` (stored) has family, node and what ``compare`` needs.

    ``compare`` gets the rows of a unit and a mask of the pairs that are its own; with
    ``together``, those of several families of one block each at once.  A
    family of more than ``block`` nodes is split into blocks.  First every block is
    compared in itself and with the family's center, its first node by ``center``; only
    nodes that this hasn't connected to the center are then compared with all other blocks.  A
    family of near copies so costs as much as it has nodes, not their square, and
    no link between what isn't connected is lost.
    """
    counted = members.groupBy("family").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"), F.min_by("node", F.struct(center, "node")).alias("_center"))
    sizes = stored(counted, "family-sizes")
    dealt = members.join(checked(sizes), "family").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    everywhere = F.when(F.col("node") == F.col("_center"), F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(F.array("_own"))
    whole = dealt.withColumn("_lo", F.explode(everywhere)).withColumns({"_hi": F.lit(0), "_side": F.lit(0)})
    first = stored(_units(whole.drop("_own"), compare, parts, 2 * block if together else 0), "links")
    links = first.filter("b IS NOT NULL")
    rest = stored(first.filter("b IS NULL").select(F.col("a").alias("node")), "rest")
    if rest.isEmpty():
        return links
    large = dealt.filter("_blocks > 1")
    alone = large.join(checked(rest), "node", "left_semi")
    many = stored(alone.groupBy("family").agg(F.ceil(F.count("*") / block).cast("int").alias("_rest")), "rest-sizes")
    one = alone.join(checked(many), "family").withColumns({"_lo": F.pmod(F.xxhash64("node"), F.col("_rest")).cast("int"), "_hi": F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)), "_side": F.lit(1)})
    # A node's own block has been compared with it.
    one = one.filter("_hi <> _own")
    other = large.join(checked(many), "family").withColumns({"_lo": F.explode(F.sequence(F.lit(0), F.col("_rest") - 1)), "_hi": F.col("_own"), "_side": F.lit(2)})
    names = [*members.columns, "_blocks", "_center", "_lo", "_hi", "_side"]
    return links.union(_units(one.select(names).union(other.select(names)), compare, parts).filter("b IS NOT NULL"))


def _units(dealt: DataFrame, compare: Compare, parts: int, most: int = 0) -> DataFrame:
    """a, b: links of each unit (family, _lo, _hi); for one of several whole blocks also a, null for what isn't connected to _center.

    Whole families are compared several at once as long as they have ``most`` rows together.
    """
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("family", "_lo", "_hi"), F.lit(parts)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by([(k, "ascending") for k in ("family", "_lo", "_hi", "_side", "node")])
        keys = np.stack([rows.column(k).to_numpy() for k in ("family", "_lo", "_hi")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        whole = (rows.column("_blocks").to_numpy() == 1) & (rows.column("_side").to_numpy() == 0)
        ends: list[tuple[int, int]] = []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), rows.num_rows], strict=True):
            if ends and whole[ends[-1][0]] and whole[lo] and hi - ends[-1][0] <= most:
                lo, _ = ends.pop()
            ends.append((lo, hi))
        for lo, hi in ends:
            unit = rows.slice(lo, hi - lo)
            side = unit.column("_side").to_numpy()
            node = unit.column("node").to_pylist()
            own = keys[0, lo:hi]
            across = np.triu(own[:, None] == own[None, :], 1) if not side.any() else side[:, None] < side[None, :]
            pairs = compare(unit, across)
            out = [(node[i], node[j]) for i, j in pairs]
            if not side.any() and unit.column("_blocks")[0].as_py() > 1:
                union, center = Union(hi - lo), node.index(unit.column("_center")[0].as_py())
                for i, j in pairs:
                    union.join(i, j)
                out += [(x, None) for i, x in enumerate(node) if union.find(i) != union.find(center)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.repartition(parts, "_part").groupBy("_part").applyInArrow(run, "a long, b long")
