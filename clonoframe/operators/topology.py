"""Lineage trees as edge tables (tree_id, from_v, to_v, weight) and their topology.

Walks go level by level, each an equi-join on (tree, vertex) whose result is written to the
shared folder. A walk that goes deeper than its largest tree has vertices is an error: the
edges have a cycle. Labels are tables of tree_id, v and value; a vertex without a row has a
null label, which is excluded where None is among the excluded labels.

Permuted labels are computed, not dealt: a vertex has a place among its tree's, a keyed
permutation of 0 to n - 1 maps places to positions in the tree's labels in their order, and
so the label of any vertex in any iteration follows from its place and its tree's counts of
labels. Permutation tests move each pair of vertices once, whatever the number of iterations.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import Rounds

#: Levels between two looks at whether a walk still makes sense.
LOOK = 64
#: Different labels of a tree up to which its counts of labels go with each of its rows; for the others a row for each iteration is joined with its label.
LABELS = 64
#: Rounds of the keyed permutation of FEW places or more, and of fewer, where each round mixes less.
ROUNDS, ROUNDS_FEW, FEW = 8, 24, 1024
#: Pairs of labels in a batch that are counted in an array.
PAIRS = 1 << 20

_GOLD, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


def excluded(value: Column, exclude: Iterable | None) -> Column:
    exclude = list(exclude or ())
    known = [x for x in exclude if x is not None]
    hit = F.coalesce(value.isin(*known), F.lit(False)) if known else F.lit(False)
    return hit | value.isNull() if None in exclude else hit


def _vertices(edges: DataFrame) -> DataFrame:
    return edges.select("tree_id", F.col("from_v").alias("v")).union(edges.select("tree_id", F.col("to_v").alias("v"))).distinct()


def _marked(edges: DataFrame, labels: DataFrame | None, exclude: Iterable | None) -> DataFrame:
    """tree_id, from_v, to_v, w, and whether to_v is skipped."""
    e = edges.select("tree_id", "from_v", "to_v", F.coalesce("weight", F.lit(0.0)).alias("w"))
    if labels is None or not exclude:
        return e.withColumn("skip", F.lit(False))
    value = labels.select("tree_id", F.col("v").alias("to_v"), F.col("value").alias("_value"))
    return e.join(value, ["tree_id", "to_v"], "left").select("tree_id", "from_v", "to_v", "w", excluded(F.col("_value"), exclude).alias("skip"))


def _levels(edges: DataFrame, level: DataFrame, step, name: str, narrow=None) -> list[DataFrame]:
    """The levels of a walk: step makes the next one from the last (column desc) joined with the edges; narrow takes the rows of a level from which the walk goes on."""
    rounds = Rounds(edges.sparkSession, name)
    edges = rounds.write(edges)
    out = []
    while True:
        level = rounds.write(level)
        if level.isEmpty():
            return out or [level]
        out.append(level)
        if len(out) % LOOK == 0 and len(out) > (edges.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0) + 1:
            raise ValueError("the edges have a cycle")
        e = edges.withColumnsRenamed({"tree_id": "_t", "from_v": "_f"})
        front = narrow(level, rounds) if narrow else level
        level = step(front.join(e, (F.col("tree_id") == F.col("_t")) & (F.col("desc") == F.col("_f"))))


def _all(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def closure(edges: DataFrame, start: DataFrame | None = None, labels: DataFrame | None = None, exclude: Iterable | None = None) -> DataFrame:
    """tree_id, anc, desc, steps, distance for every vertex (or those of start: tree_id, v) as anc; steps to skipped vertices don't count."""
    v = start if start is not None else _vertices(edges)
    level = v.select("tree_id", F.col("v").alias("anc"), F.col("v").alias("desc"), F.lit(0).alias("steps"), F.lit(0.0).alias("distance"))
    step = lambda x: x.select("tree_id", "anc", F.col("to_v").alias("desc"), (F.col("steps") + (~F.col("skip")).cast("int")).alias("steps"), (F.col("distance") + F.col("w")).alias("distance"))
    return _all(_levels(_marked(edges, labels, exclude), level, step, "closure"))


def path_lengths(edges: DataFrame, root: str = "Germline", labels: DataFrame | None = None, exclude: Iterable | None = None) -> DataFrame:
    """tree_id, name, steps (vertices with an excluded label don't count) and weighted distance from the root; null where it doesn't reach."""
    roots = edges.select("tree_id").distinct().withColumn("v", F.lit(root))
    c = closure(edges, roots, labels, exclude).select("tree_id", F.col("desc").alias("name"), "steps", "distance")
    return _vertices(edges).withColumnRenamed("v", "name").join(c, ["tree_id", "name"], "left")


def _nearest(edges: DataFrame, path: str, root: str, labels: DataFrame | None, exclude: Iterable | None) -> DataFrame:
    """tree_id, name, steps, distance: a walk from the root that holds every vertex that can be an MRCA.

    It doesn't go on below what is farther than the nearest candidate so far, unless weights below zero may lead nearer again.
    """
    if path == "distance" and not edges.filter("weight < 0").isEmpty():
        return path_lengths(edges, root, labels, exclude)
    best = []

    def narrow(level: DataFrame, rounds: Rounds) -> DataFrame:
        near = level.filter((F.col("desc") != root) & ~F.col("skip")).select("tree_id", F.col(path).alias("_best"))
        best[:] = [rounds.write((near.union(best[0]) if best else near).groupBy("tree_id").agg(F.min("_best").alias("_best")))]
        return level.join(best[0], "tree_id", "left").filter(F.col("_best").isNull() | (F.col(path) <= F.col("_best"))).withColumnRenamed("skip", "_skip")

    level = edges.select("tree_id").distinct().select("tree_id", F.lit(root).alias("desc"), F.lit(0).alias("steps"), F.lit(0.0).alias("distance"), F.lit(False).alias("skip"))
    step = lambda x: x.select("tree_id", F.col("to_v").alias("desc"), (F.col("steps") + (~F.col("skip")).cast("int")).alias("steps"), (F.col("distance") + F.col("w")).alias("distance"), "skip")
    return _all(_levels(_marked(edges, labels, exclude), level, step, "nearest", narrow)).select("tree_id", F.col("desc").alias("name"), "steps", "distance")


def mrca(edges: DataFrame, path: str = "distance", root: str = "Germline", labels: DataFrame | None = None, exclude: Iterable | None = None) -> DataFrame:
    """The vertices nearest the root in each tree, all ties, without the root and excluded labels; with labels, their value."""
    p = _nearest(edges, path, root, labels, exclude).filter((F.col("name") != root) & F.col(path).isNotNull())
    if labels is not None:
        p = p.join(labels.select("tree_id", F.col("v").alias("name"), "value"), ["tree_id", "name"], "left").filter(~excluded(F.col("value"), exclude))
    return p.withColumn("r", F.rank().over(Window.partitionBy("tree_id").orderBy(path))).filter("r = 1").drop("r")


def subtrees(edges: DataFrame) -> DataFrame:
    """Per vertex: parent, outdegree, size, depth, pathlength, and each but parent over its tree's figure.

    A walk down gives each vertex its level; the figures are then summed level by level on the
    way up, so the work is linear in the vertices.
    """
    rounds = Rounds(edges.sparkSession, "subtrees")
    top = _vertices(edges).join(edges.select("tree_id", F.col("to_v").alias("v")), ["tree_id", "v"], "left_anti")
    level = top.select("tree_id", F.col("v").alias("desc"), F.lit(None).cast(edges.schema["from_v"].dataType).alias("parent"), F.lit(0.0).alias("w"))
    step = lambda x: x.select("tree_id", F.col("to_v").alias("desc"), F.col("_f").alias("parent"), F.col("w2").alias("w"))
    marked = _marked(edges, None, None).drop("skip").withColumnRenamed("w", "w2")
    done, below = [], None
    for x in reversed(_levels(marked, level, step, "down")):
        one = {"size": F.lit(1).cast("long"), "depth": F.lit(1), "pathlength": F.lit(0.0), "outdegree": F.lit(0).cast("long")}
        if below is None:
            x = x.withColumns(one)
        else:
            up = below.groupBy("tree_id", F.col("parent").alias("desc")).agg(F.sum("size").alias("_s"), F.max("depth").alias("_d"), F.max(F.col("pathlength") + F.col("w")).alias("_p"), F.count(F.lit(1)).alias("_o"))
            x = x.join(up, ["tree_id", "desc"], "left").withColumns({"size": one["size"] + F.coalesce("_s", F.lit(0)), "depth": one["depth"] + F.coalesce("_d", F.lit(0)), "pathlength": F.coalesce("_p", F.lit(0.0)), "outdegree": F.coalesce("_o", F.lit(0).cast("long"))}).drop("_s", "_d", "_p", "_o")
        below = rounds.write(x)
        done.append(below)
    s = _all(done).select("tree_id", F.col("desc").alias("name"), "size", "depth", "pathlength", "outdegree", "parent")
    w = Window.partitionBy("tree_id")
    return s.withColumns({
        "outdegree_norm": F.try_divide(F.col("outdegree"), F.sum("outdegree").over(w)), "size_norm": F.col("size") / F.max("size").over(w),
        "depth_norm": F.col("depth") / F.max("depth").over(w), "pathlength_norm": F.try_divide(F.col("pathlength"), F.max("pathlength").over(w)),
    })


def vertex_pairs(edges: DataFrame, labels: DataFrame, indirect: bool = False, exclude: Iterable | None = ()) -> DataFrame:
    """tree_id, anc, child: the ends of edges, or of paths with one vertex besides anc that isn't skipped (as often as there are such paths)."""
    e = _marked(edges, labels, exclude)
    up = labels.select("tree_id", F.col("v").alias("anc"), F.col("value").alias("_value"))
    kept = lambda x: x.join(up, ["tree_id", "anc"], "left").filter(~excluded(F.col("_value"), exclude)).drop("_value") if exclude else x
    if not indirect:
        return kept(e.filter("not skip").select("tree_id", F.col("from_v").alias("anc"), F.col("to_v").alias("child")))
    value = labels.select("tree_id", F.col("v").alias("from_v"), F.col("value").alias("_value"))
    e = e.select("tree_id", "from_v", "to_v", "skip").join(value, ["tree_id", "from_v"], "left").select("tree_id", "from_v", "to_v", "skip", excluded(F.col("_value"), exclude).alias("below"))
    e = Rounds(edges.sparkSession, "ends").write(e)
    level = e.filter("not below").select("tree_id", F.col("from_v").alias("anc"), F.col("to_v").alias("desc"), F.when(~F.col("skip"), F.col("to_v")).alias("child"))
    # Longer paths go on only into skipped vertices or out of them.
    e = e.filter("skip or below").drop("below")
    # A path with two such vertices can't become one with one again.
    step = lambda x: x.filter(F.col("skip") | F.col("child").isNull()).select("tree_id", "anc", F.col("to_v").alias("desc"), F.when(F.col("skip"), F.col("child")).otherwise(F.col("to_v")).alias("child"))
    return _all(_levels(e, level, step, "indirect")).filter("child is not null").select("tree_id", "anc", "child")


def _labelled(pairs: DataFrame, labels: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    up = labels.select(*by, "tree_id", F.col("v").alias("anc"), F.col("value").alias("parent"))
    down = labels.select(*by, "tree_id", F.col("v").alias("_c"), F.col("value").alias("_child")).withColumnRenamed("_c", "child")
    x = pairs.join(up, ["tree_id", "anc"], how).join(down, [*by, "tree_id", "child"], how)
    return x.groupBy(*by, "parent", F.col("_child").alias("child_label")).agg(F.count(F.lit(1)).alias("count")).withColumnRenamed("child_label", "child")


def table_edges(edges: DataFrame, labels: DataFrame, indirect: bool = False, exclude: Iterable | None = ()) -> DataFrame:
    """Counts of (parent, child) labels over edges, or over paths whose other vertices are all excluded."""
    return _labelled(vertex_pairs(edges, labels, indirect, exclude), labels, [])


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(33))) * _M1
    z = (z ^ (z >> np.uint64(29))) * _M2
    return z >> np.uint64(32)


def _grid(n: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each n a power of two (its bits and mask) and the least columns of that height that hold n."""
    bits = (np.ceil(np.log2(n)).astype(np.uint64) + np.uint64(1)) >> np.uint64(1)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    n = n.astype(np.uint64)
    return n, bits, mask, (n + mask) >> bits


def _shuffled(k: np.ndarray, key: np.ndarray, grid: tuple[np.ndarray, ...]) -> np.ndarray:
    """Where a permutation of 0 to n - 1, given by its key and _grid(n), takes k; row by row, or with one key and n for all.

    A Feistel network over the grid; what leaves 0 to n - 1 goes through it again.
    """
    few = grid[0] < FEW
    if few.any() and not few.all():
        out = np.empty(len(k), np.int64)
        for some in (few, ~few):
            out[some] = _shuffled(k[some], key[some], tuple(x[some] for x in grid))
        return out
    rounds = ROUNDS_FEW if few.any() else ROUNDS

    def through(x, key, n, bits, mask, cols):
        low, high = x & mask, x >> bits
        for _ in range(0, rounds, 2):
            key = key + _GOLD
            low = (low + _mix(high + key)) & mask
            key = key + _GOLD
            high = high + ((_mix(low + key) * cols) >> np.uint64(32))
            high = high - cols * (high >= cols)
        return low | (high << bits)

    x = through(k.astype(np.uint64), key, *grid)
    while len(again := np.flatnonzero(x >= grid[0])):
        x[again] = through(x[again], *(y[again] if len(y) > 1 else y for y in (key, *grid)))
    return x.astype(np.int64)


def _iteration(key: np.ndarray, i: int) -> np.ndarray:
    """The trees' keys in one iteration."""
    z = key + np.uint64((i + 1) * 0xD1B54A32D192ED03 % 2**64)
    return (_mix(z) << np.uint64(32)) | _mix(z ^ _GOLD)


def _places(labels: DataFrame, exclude: Iterable | None) -> DataFrame:
    """labels with k, the place of each vertex among those of its tree whose labels are permuted; null for the others."""
    fixed = excluded(F.col("value"), exclude)
    return labels.select("tree_id", "v", "value", F.when(~fixed, F.row_number().over(Window.partitionBy("tree_id", fixed).orderBy("v")) - 1).cast("long").alias("k"))


def _trees(labels: DataFrame, seed: int, exclude: Iterable | None, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """tree_id, key, kinds and slots (upto:code, the labels in their order, each after the position below which it ends) by tree; and code, value."""
    n = rounds.write(labels.filter(~excluded(F.col("value"), exclude)).groupBy("tree_id", "value").agg(F.count(F.lit(1)).alias("n")))
    codes = rounds.write(n.select("value").distinct().select(F.monotonically_increasing_id().alias("code"), "value"))
    upto = F.sum("n").over(Window.partitionBy("tree_id").orderBy("value")).alias("upto")
    x = n.join(codes.withColumnRenamed("value", "_value"), F.col("value").eqNullSafe(F.col("_value"))).select("tree_id", "code", upto)
    slots = F.transform(F.sort_array(F.collect_list(F.struct("upto", "code"))), lambda x: F.concat(x["upto"], F.lit(":"), x["code"]))
    return rounds.write(x.groupBy("tree_id").agg(F.count(F.lit(1)).alias("kinds"), F.concat_ws(",", slots).alias("slots")).withColumn("key", F.xxhash64(F.lit(seed), "tree_id"))), codes


class _Batch:
    """Rows of a batch by tree, and the labels that their places have in an iteration."""

    def __init__(self, key: pa.Array, slots: pa.Array):
        keys, first, self.of = np.unique(key.to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
        own = [[tuple(map(int, x.split(":"))) for x in s.split(",")] for s in slots.take(pa.array(first)).to_pylist()]
        self.keys, self.width, self.first = keys.astype(np.uint64), max(map(len, own)), pa.array(first)
        padded = np.array([s + s[-1:] * (self.width - len(s)) for s in own], np.int64)
        self.codes, local = np.unique(padded[:, :, 1], return_inverse=True)
        self.local = local.ravel()
        if len(keys) == 1:
            self.of = self.of[:1]
        self.grid = _grid(padded[:, -1, 0])
        self.grid = tuple(x[self.of] for x in self.grid)
        self.ends = [padded[self.of, j, 0] for j in range(self.width - 1)]

    def drawn(self, k: np.ndarray, i: int) -> np.ndarray:
        """The labels, as indexes of codes, of the rows' places k in iteration i."""
        x = _shuffled(k, _iteration(self.keys, i)[self.of], self.grid)
        slot = self.of * self.width
        for end in self.ends:
            slot = slot + (x >= end)
        return self.local[slot]


def permute_labels(labels: DataFrame, nperm: int, seed: int = 0, exclude: Iterable | None = ()) -> DataFrame:
    """tree_id, v, value, iter: labels dealt anew within each tree by a keyed permutation of their places, excluded ones in place."""
    fixed = excluded(F.col("value"), exclude)
    free = _places(labels.filter(~fixed), ())
    kinds = {c: labels.schema[c].dataType.simpleString() for c in ("tree_id", "v")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, n, key = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k", "n", "key"))
            grid, key = _grid(n), key.astype(np.uint64)
            for i in range(nperm):
                at = _shuffled(k, _iteration(key, i), grid)
                yield pa.RecordBatch.from_arrays([b.column("tree_id"), b.column("v"), pa.array(np.full(len(k), i, np.int32)), pa.array(at)], ["tree_id", "v", "iter", "at"])

    sizes = free.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.xxhash64(F.lit(seed), "tree_id"))
    rows = free.join(sizes, "tree_id").select("tree_id", "v", "k", "n", "key").mapInArrow(run, f"tree_id {kinds['tree_id']}, v {kinds['v']}, iter int, at long")
    order = free.select("tree_id", "value", (F.row_number().over(Window.partitionBy("tree_id").orderBy("value")) - 1).cast("long").alias("at"))
    every = labels.filter(fixed).withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(nperm - 1))))
    return rows.join(order, ["tree_id", "at"]).select("tree_id", "v", "value", "iter").union(every.select("tree_id", "v", "value", "iter"))


def _ends(edges: DataFrame, labels: DataFrame, indirect: bool, exclude: Iterable | None) -> DataFrame:
    """tree_id, parent, child (labels) and their places kp, kc, of each pair of vertices."""
    pairs = vertex_pairs(edges, labels, True, exclude) if indirect else edges.select("tree_id", F.col("from_v").alias("anc"), F.col("to_v").alias("child"))
    at = _places(labels, exclude)
    for v, value, k in (("anc", "parent", "kp"), ("child", "_child", "kc")):
        pairs = pairs.join(at.select("tree_id", F.col("v").alias(v), F.col("value").alias(value), F.col("k").alias(k)), ["tree_id", v], "left")
        if exclude and not indirect:
            pairs = pairs.filter(~excluded(F.col(value), exclude))
    return pairs.select("tree_id", "parent", F.col("_child").alias("child"), "kp", "kc")


def _drawn_pairs(ends: DataFrame, labels: DataFrame, nperm: int, seed: int, exclude: Iterable | None, rounds: Rounds) -> DataFrame:
    """iter, parent, child, count under permuted labels, of pairs of places (tree_id, kp, kc)."""
    trees, codes = _trees(labels, seed, exclude, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _Batch(b.column("key"), b.column("slots"))
            up, down = (b.column(c).to_numpy(zero_copy_only=False) for c in ("kp", "kc"))
            many = len(x.codes)
            for i in range(nperm):
                pair = x.drawn(up, i) * many + x.drawn(down, i)
                if many * many <= PAIRS:
                    count = np.bincount(pair, minlength=many * many)
                    pair = np.flatnonzero(count)
                    count = count[pair]
                else:
                    pair, count = np.unique(pair, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), i, np.int32)), pa.array(x.codes[pair // many]), pa.array(x.codes[pair % many]), pa.array(count)], ["iter", "p", "c", "n"])

    both = ends.filter("kp is not null and kc is not null").select("tree_id", "kp", "kc")
    few = both.join(trees.filter(F.col("kinds") <= LABELS), "tree_id").select("key", "slots", "kp", "kc")
    n = few.mapInArrow(run, "iter int, p long, c long, n long").groupBy("iter", "p", "c").agg(F.sum("n").alias("count"))
    for c, value in (("p", "parent"), ("c", "child")):
        n = n.join(codes.select(F.col("code").alias(c), F.col("value").alias(value)), c)
    n = n.select("iter", "parent", "child", "count")
    many = trees.filter(F.col("kinds") > LABELS).select("tree_id")
    if not many.isEmpty():
        own = labels.join(many, "tree_id", "left_semi")
        at = _places(own, exclude).filter("k is not null")
        pairs = both.join(at.select("tree_id", F.col("k").alias("kp"), F.col("v").alias("anc")), ["tree_id", "kp"]).join(at.select("tree_id", F.col("k").alias("kc"), F.col("v").alias("child")), ["tree_id", "kc"])
        rows = _labelled(pairs.select("tree_id", "anc", "child"), permute_labels(own, nperm, seed, exclude), ["iter"], "inner")
        n = n.unionByName(rows.select("iter", "parent", "child", "count")).groupBy("iter", "parent", "child").agg(F.sum("count").alias("count"))
    return rounds.write(n)


def _tested(observed: DataFrame, drawn: DataFrame, keys: list[str]) -> DataFrame:
    t = observed.join(drawn.withColumnRenamed("count", "d"), keys, "left")
    return t.groupBy(*keys, "count").agg(F.avg("d").alias("expected"), (1 - F.avg((F.col("d") <= F.col("count")).cast("double"))).alias("pvalue"))


def edge_permutations(edges: DataFrame, labels: DataFrame, nperm: int = 200, seed: int = 0, indirect: bool = False, exclude: Iterable | None = ("Germline", None)) -> DataFrame:
    """iter, parent, child, count under permuted labels. Excluded labels stay in place, so which vertices make a pair is the same in all."""
    return _drawn_pairs(_ends(edges, labels, indirect, exclude), labels, nperm, seed, exclude, Rounds(edges.sparkSession, "permuted"))


def test_edges(edges: DataFrame, labels: DataFrame, nperm: int = 200, seed: int = 0, indirect: bool = False, exclude: Iterable | None = ("Germline", None)) -> DataFrame:
    """Observed counts of label pairs against label permutations within trees."""
    rounds = Rounds(edges.sparkSession, "permuted")
    ends = rounds.write(_ends(edges, labels, indirect, exclude))
    seen = ends.groupBy("parent", "child").agg(F.count(F.lit(1)).alias("count"))
    return _tested(seen, _drawn_pairs(ends, labels, nperm, seed, exclude, rounds), ["parent", "child"])


def _founders(top: DataFrame, by: list[str]) -> DataFrame:
    one = top.groupBy(*by, "tree_id").agg(F.countDistinct("value").alias("k"), F.first("value").alias("value")).filter("k = 1")
    return one.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("count"))


def mrca_permutations(edges: DataFrame, labels: DataFrame, root: str = "Germline", nperm: int = 200, seed: int = 0, exclude: Iterable | None = ("Germline", None)) -> DataFrame:
    """iter, value, count: the trees whose nearest vertices have one label only, under permuted labels."""
    rounds = Rounds(edges.sparkSession, "permuted")
    trees, codes = _trees(labels, seed, exclude, rounds)
    at = mrca(edges, "distance", root, labels, exclude).select("tree_id", F.col("name").alias("v")).join(_places(labels, exclude).filter("k is not null").select("tree_id", "v", "k"), ["tree_id", "v"])
    at = rounds.write(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _Batch(b.column("key"), b.column("slots"))
            k, tree, many = b.column("k").to_numpy(zero_copy_only=False), b.column("tree_id").take(x.first), len(x.codes)
            for i in range(nperm):
                own = np.unique(x.of * many + x.drawn(k, i))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i, np.int32)), tree.take(pa.array(own // many)), pa.array(x.codes[own % many])], ["iter", "tree_id", "code"])

    few = at.join(trees.filter(F.col("kinds") <= LABELS), "tree_id").select("tree_id", "key", "slots", "k")
    top = few.mapInArrow(run, f"iter int, tree_id {labels.schema['tree_id'].dataType.simpleString()}, code long").join(codes, "code").select("iter", "tree_id", "value")
    many = trees.filter(F.col("kinds") > LABELS).select("tree_id")
    if not many.isEmpty():
        rows = permute_labels(labels.join(many, "tree_id", "left_semi"), nperm, seed, exclude)
        top = top.unionByName(at.join(rows, ["tree_id", "v"]).select("iter", "tree_id", "value"))
    return rounds.write(_founders(top, ["iter"]))


def test_mrca(edges: DataFrame, labels: DataFrame, root: str = "Germline", nperm: int = 200, seed: int = 0, exclude: Iterable | None = ("Germline", None)) -> DataFrame:
    """How often a label is the only one among a tree's MRCAs, against permutations."""
    seen = _founders(mrca(edges, "distance", root, labels, exclude), [])
    return _tested(seen, mrca_permutations(edges, labels, root, nperm, seed, exclude), ["value"])
