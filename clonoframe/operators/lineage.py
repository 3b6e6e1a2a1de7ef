"""Maximum-parsimony lineage trees of clones: one grouped call a clone, all trees as one table of records.

Sets of bases are held as whole numbers with four bits a site, so that Fitch's step over all
sites of a vertex is a few operations on whole numbers. What a subtree costs at each place of
a tree is read off the sets on both sides of every edge, so one walk down and one up tell the
best place among all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import IUPAC_DNA

_BIT = np.full(256, 15, np.uint8)
for _c, _bases in IUPAC_DNA.items():
    _BIT[ord(_c)] = sum(1 << "ACGT".index(b) for b in _bases)
#: Sweeps over all subtrees, at most; the order of joining is tried in so many ways.
SWEEPS, ORDERS = 30, 3
ROOT = "Germline"


def base_sets(seq: str) -> int:
    """Four bits for each site, the first site lowest."""
    x = _BIT[np.frombuffer(seq.encode(), np.uint8)]
    x = np.append(x, np.zeros(len(x) % 2, np.uint8))
    return int.from_bytes((x[0::2] | x[1::2] << 4).tobytes(), "little")


class Tree:
    """A rooted tree: leaf 0 hangs above vertex `top`, all other vertices are leaves or have two children."""

    def __init__(self, leaves: list[int], sites: int):
        self.leaves = leaves
        self.ones = int("1" * sites, 16) if sites else 0
        self.kids: dict[int, tuple[int, int]] = {}
        self.up: dict[int, int] = {1: 0} if len(leaves) > 1 else {}
        self.top, self.spare = 1, len(leaves)

    def meet(self, a: int, b: int) -> tuple[int, int]:
        """Fitch's step: the common bases of each site or else all of both, and the sites without common ones."""
        both = a & b
        some = both | both >> 1
        none = ~(some | some >> 2) & self.ones
        return both | (a | b) & none * 15, none

    def apart(self, a: int, b: int) -> int:
        both = a & b
        some = both | both >> 1
        return (~(some | some >> 2) & self.ones).bit_count()

    def _order(self, v: int) -> list[int]:
        """The vertices below v, parents first."""
        out = [v]
        for x in out:
            out.extend(self.kids.get(x, ()))
        return out

    def sets(self) -> tuple[int, dict[int, int], dict[int, int], list[int]]:
        """Length, the sets below each vertex, those on its edge (both sides met), and the vertices."""
        order, below, total = self._order(self.top), {}, 0
        for v in reversed(order):
            if v in self.kids:
                a, b = self.kids[v]
                below[v], none = self.meet(below[a], below[b])
                total += none.bit_count()
            else:
                below[v] = self.leaves[v]
        total += self.apart(below[self.top], self.leaves[0])
        above, edge = {self.top: self.leaves[0]}, {}
        for v in order:
            edge[v] = self.meet(above[v], below[v])[0]
            if v in self.kids:
                a, b = self.kids[v]
                above[a], above[b] = self.meet(above[v], below[b])[0], self.meet(above[v], below[a])[0]
        return total, below, edge, order

    def best(self, moved: int, edge: dict[int, int], order: list[int]) -> tuple[int, int]:
        """The least cost of hanging a set on an edge, and the vertex below that edge (the first of the order)."""
        return min(((self.apart(edge[v], moved), i) for i, v in enumerate(order)), default=(0, 0))

    def insert(self, x: int, at: int) -> None:
        p, mid = self.up[at], self.spare
        self.spare += 1
        self.kids[mid] = (at, x)
        self.up.update({at: mid, x: mid, mid: p})
        if at == self.top:
            self.top = mid
        else:
            self.kids[p] = tuple(mid if k == at else k for k in self.kids[p])

    def remove(self, x: int) -> int:
        """Takes the subtree of x away; returns the vertex whose edge it hung on."""
        p = self.up.pop(x)
        a, b = self.kids.pop(p)
        other = b if a == x else a
        g = self.up.pop(p)
        self.up[other] = g
        if p == self.top:
            self.top = other
        else:
            self.kids[g] = tuple(other if k == p else k for k in self.kids[g])
        return other


def _stepwise(leaves: list[int], sites: int, order: list[int]) -> tuple[int, Tree]:
    names = [0, *order]
    tree = Tree([leaves[i] for i in names], sites)
    for i in range(2, len(names)):
        _, _, edge, places = tree.sets()
        tree.insert(i, places[tree.best(tree.leaves[i], edge, places)[1]])
    # Back to the numbers of the leaves.
    name = lambda v: names[v] if v < len(names) else v
    tree.leaves = leaves
    tree.kids = {v: (name(a), name(b)) for v, (a, b) in tree.kids.items()}
    tree.up = {name(v): name(p) for v, p in tree.up.items()}
    tree.top = name(tree.top)
    return tree.sets()[0], tree


def search(seqs: list[str]) -> tuple[int, Tree]:
    """The shortest tree found and its length: leaves join at their cheapest edge, near ones first, far ones
    first, or in the order given; then subtrees move to cheaper edges while that shortens the tree.
    (An exchange of two neighbouring subtrees is such a move.) Ties go to the first place: the result is fixed.
    """
    leaves, sites = [base_sets(s) for s in seqs], len(seqs[0])
    tree = Tree(leaves, sites)
    given = list(range(1, len(seqs)))
    near = sorted(given, key=lambda i: (tree.apart(leaves[0], leaves[i]), i))
    cost, tree = min((_stepwise(leaves, sites, o) for o in (near, near[::-1], given)[: ORDERS if len(seqs) > 3 else 1]), key=lambda x: x[0])
    for _ in range(SWEEPS if len(seqs) > 3 else 0):
        before = cost
        for v in [v for v in tree._order(tree.top) if v != tree.top]:
            if v not in tree.up or v == tree.top:
                continue
            moved = tree.sets()[1][v]
            back = tree.remove(v)
            rest, _, edge, places = tree.sets()
            inside = cost - rest
            # The subtree's own length counts in both.
            own = inside - tree.apart(edge[back], moved)
            least, at = tree.best(moved, edge, places)
            tree.insert(v, places[at] if rest + own + least < cost else back)
            cost = min(cost, rest + own + least)
        if cost == before:
            break
    return cost, tree


def reconstruct(tree: Tree, sites: int) -> dict[int, str]:
    """A base for each site of the inner vertices: the parent's where that is among the vertex's, else the first."""
    _, below, _, order = tree.sets()
    nibbles = lambda x: np.array([x >> 4 * i & 15 for i in range(sites)], np.uint8)
    lowest = lambda x: x & (~x + 1)
    germ = nibbles(tree.leaves[0])
    state, out = {0: germ}, {}
    letter = np.array([ord("N")] * 16, np.uint8)
    letter[[1, 2, 4, 8]] = list(b"ACGT")
    for v in order:
        if v in tree.kids:
            own, above = nibbles(below[v]), state[tree.up[v]]
            both = own & above
            state[v] = lowest(np.where(both > 0, both, own))
            out[v] = letter[state[v]].tobytes().decode()
    return out


def _weight(a: str, b: str) -> int:
    return int((_BIT[np.frombuffer(a.encode(), np.uint8)] & _BIT[np.frombuffer(b.encode(), np.uint8)] == 0).sum())


def lineage(names: list[str], seqs: list[str], collapse: bool = True) -> tuple[list[tuple[str, str, int]], dict[str, str]]:
    """Edges (parent, child, mutations) from ROOT, whose sequence is the first, and every vertex's sequence.

    collapse: an inferred parent without a mutation to a child becomes that child.
    """
    _, tree = search(seqs)
    made = reconstruct(tree, len(seqs[0]))
    order = [v for v in tree._order(tree.top) if v in made]
    name = {i: n for i, n in enumerate(names)} | {v: f"Inferred{i + 1}" for i, v in enumerate(order)}
    text = dict(zip(names, seqs, strict=True)) | {name[v]: s for v, s in made.items()}
    edges = [(name[tree.up[v]], name[v]) for v in tree._order(tree.top)]
    inferred = {name[v] for v in order}
    while collapse:
        gone = next(((p, c) for p, c in edges if p in inferred and _weight(text[p], text[c]) == 0), None)
        if gone is None:
            break
        p, c = gone
        edges = [(c if a == p else a, c if b == p else b) for a, b in edges if (a, b) != gone]
        inferred.discard(p)
        text.pop(p)
    return [(a, b, _weight(text[a], text[b])) for a, b in edges], text


TREE = "tree_id string, record_type string, name string, sequence string, from_v string, to_v string, weight double"


def build_trees(df: DataFrame, clone: str = "clone_id", key: str = "sequence_id", seq: str = "sequence_alignment", germline: str = "germline_alignment", branch_length: str = "mutations") -> DataFrame:
    """Records of the trees of all clones with two distinct sequences or more: vertices (V: name, sequence) and edges
    (E: from_v, to_v, weight). With branch_length `distance` inferred vertices without mutations stay.

    Of equal sequences the least key counts; clones whose sequences differ in length are left out. Clones that
    can have no tree are dropped before rows are grouped.
    """
    if branch_length not in ("mutations", "distance"):
        raise ValueError("branch_length must be mutations or distance")
    clean = lambda c: F.translate(F.col(c), "-.", "NN")
    rows = df.filter(F.col(seq).isNotNull() & F.col(germline).isNotNull() & F.col(clone).isNotNull())
    rows = rows.groupBy(F.col(clone).cast("string").alias("tree_id"), clean(seq).alias("s")).agg(F.min(F.col(key)).alias("k"), F.min_by(clean(germline), F.col(key)).alias("g"))
    fit = rows.groupBy("tree_id").agg(F.count(F.lit(1)).alias("c"), F.min(F.char_length("s")).alias("lo"), F.max(F.char_length("s")).alias("hi"), F.max(F.char_length("g")).alias("gl"), F.min(F.char_length("g")).alias("gs"))
    rows = rows.join(fit.filter("c > 1 and lo = hi and gl = lo and gs = lo and lo > 0").select("tree_id"), "tree_id", "left_semi")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        edges, text = lineage([ROOT, *pdf["k"].astype(str)], [pdf["g"].iat[0], *pdf["s"]], branch_length == "mutations")
        none = None
        v = [("V", n, s, none, none, none) for n, s in text.items()] + [("E", none, none, a, b, float(w)) for a, b, w in edges]
        out = pd.DataFrame(v, columns=["record_type", "name", "sequence", "from_v", "to_v", "weight"]).astype({c: object for c in ("record_type", "name", "sequence", "from_v", "to_v")})
        out.insert(0, "tree_id", pdf["tree_id"].iat[0])
        return out

    # A number of partitions of its own: small clones take long, and few bytes would be put into one task.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "tree_id").groupBy("tree_id").applyInPandas(one, TREE)


def build_lineage(df: DataFrame, clone: str = "clone_id", key: str = "sequence_id", seq: str = "sequence_alignment", germline: str = "germline_alignment", branch_length: str = "mutations") -> DataFrame:
    """tree_id, from_v, to_v, weight of the trees that build_trees makes."""
    return build_trees(df, clone, key, seq, germline, branch_length).filter("record_type = 'E'").select("tree_id", "from_v", "to_v", "weight")


def tree_vertices(trees: DataFrame, clones: DataFrame, key: str = "sequence_id", fields: list[str] = ()) -> DataFrame:
    """tree_id, name, sequence and the clones' fields (tree_id, key, fields; null for the root and inferred vertices)."""
    v = trees.filter("record_type = 'V'").select("tree_id", "name", "sequence")
    return v.join(clones.select(F.col("tree_id").cast("string").alias("tree_id"), F.col(key).cast("string").alias("name"), *fields), ["tree_id", "name"], "left")
