"""Operators of the repertoire library against known values and DuckDB."""

import copy
import math
import random
from collections import Counter
from statistics import NormalDist

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clonoframe import fixtures
from clonoframe.functions import aminoacids, genes, sequences
from clonoframe.operators import base_quality, clones, diversity, junctions, lineage, plotting, statistics, topology, usage
from clonoframe.operators import sequences as seqs
from clonoframe.plans import catalog
from clonoframe.sources import changeo, fastq, igphyml, newick
from clonoframe.streaming.usage import windowed_usage

SF = "/root/testdata/sf0.001"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_gene_calls(spark):
    k = "Homsap IGKV1D-39*01 F,Homsap IGKV1-39*02 F"
    assert one(spark, k, genes.get_allele) == "IGKV1-39*01"
    assert one(spark, k, genes.get_gene) == "IGKV1-39"
    assert one(spark, k, genes.get_family) == "IGKV1"
    assert one(spark, k, genes.get_chain) == "VL"
    d = "Homsap IGHV1-69*01 F,Homsap IGHV1-69D*01 F"
    assert one(spark, d, lambda c: genes.get_gene(c, first=False)) == "IGHV1-69"
    assert one(spark, d, lambda c: genes.get_gene(c, first=False, strip_d=False)) == "IGHV1-69,IGHV1-69D"
    assert one(spark, None, genes.get_gene) is None


def test_sequences(spark):
    assert one(spark, "TGTGCGAGA", sequences.translate_dna) == "CAR"
    assert one(spark, "TG", sequences.translate_dna) is None
    assert one(spark, "ATG-C", sequences.mask_gaps) == "ATGNC"
    assert one(spark, "--ATG-C-", lambda c: sequences.mask_gaps(c, outer_only=True)) == "NNATG-CN"
    for a, b, d in (("ATGGC", "ATGGG", 1), ("ATGGC", "ATG??", 2), ("ATGGC", "AT--C", 1)):
        assert spark.createDataFrame([(a, b)], "a string, b string").select(sequences.seq_dist(F.col("a"), F.col("b"))).first()[0] == d


def test_valid_and_empty(spark):
    got = [one(spark, x, aminoacids.is_valid) for x in ("CARDRSTPWRRGIASTTVRTSW", "XXTQMYVR--XX", "CARJ", "10", None, "")]
    assert got == [True, True, False, False, False, True]
    assert one(spark, None, aminoacids.gravy) is None


def test_collapse_drops_ambiguous(spark):
    rows = [(1, 1, "CCCCTGGG"), (2, 1, "CCCCTGGN"), (3, 1, "NAACTGGN"), (4, 1, "NNNCTGNN")]
    df = spark.createDataFrame(rows, "sequence_id long, clone_id long, s string")
    got = seqs.collapse_duplicates(df, "sequence_id", "s", ["clone_id"]).collect()
    assert sorted((r["sequence_id"], r["collapse_count"]) for r in got) == [(1, 2), (3, 1)]


def shortest(seqs):
    """The length of the shortest tree among all topologies."""
    best = []

    def grow(tree, i):
        if i == len(seqs):
            best.append(tree.sets()[0])
            return
        for v in list(tree._order(tree.top)):
            t = copy.deepcopy(tree)
            t.insert(i, v)
            grow(t, i + 1)

    grow(lineage.Tree([lineage.base_sets(s) for s in seqs], len(seqs[0])), 2)
    return min(best)


def test_parsimony_against_all_trees():
    r = random.Random(3)
    off = 0
    for _ in range(40):
        n, sites = r.randrange(3, 7), r.randrange(1, 12)
        seqs_ = ["".join(r.choice("ACGTN") for _ in range(sites)) for _ in range(n)]
        cost, tree = lineage.search(seqs_)
        edges, text = lineage.lineage(["Germline", *map(str, range(1, n))], seqs_, collapse=False)
        assert cost == tree.sets()[0] == sum(w for *_, w in edges) and len(edges) == 2 * n - 3 and all(len(t) == sites for t in text.values())
        off += cost - shortest(seqs_)
    assert off <= 2
    assert lineage.search(["AAAA", "AAAC", "AACC", "ACCC"])[0] == 3


def test_inferred_vertices_collapse():
    names, seqs_ = ["Germline", "a", "b", "c"], ["AAAA", "AAAC", "AACC", "ACCC"]
    edges, text = lineage.lineage(names, seqs_)
    assert edges == [("Germline", "a", 1), ("a", "b", 1), ("b", "c", 1)] or sorted(edges) == [("Germline", "a", 1), ("a", "b", 1), ("b", "c", 1)]
    assert set(text) == set(names)
    kept, _ = lineage.lineage(names, seqs_, collapse=False)
    assert sum(b.startswith("Inferred") for _, b, _ in kept) == 2


def test_tree_vertices(spark):
    df = spark.createDataFrame([(2, 2, "ACGT", "ACGA", "x"), (2, 3, "AAAA", "ACGA", "y")], "clone_id long, sequence_id long, sequence_alignment string, germline_alignment string, s string")
    trees = lineage.build_trees(df)
    got = {r["name"]: (r["sequence"], r["s"]) for r in lineage.tree_vertices(trees, df.withColumnRenamed("clone_id", "tree_id"), fields=["s"]).collect()}
    assert got == {"Germline": ("ACGA", None), "2": ("ACGT", "x"), "3": ("AAAA", "y")} | {k: v for k, v in got.items() if k.startswith("Inferred")}
    assert lineage.build_trees(df.limit(0)).count() == 0 == lineage.build_lineage(df.filter("sequence_id = 2")).count()


def test_newick():
    assert newick.parse("((A:1,B:2):3,C:4)R;") == [("node1", "A", 1.0), ("node1", "B", 2.0), ("R", "node1", 3.0), ("R", "C", 4.0)]


def test_changeo_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "atg", None), ("b", "ccc", "x")], "SEQUENCE_ID string, JUNCTION string, V_CALL string")
    changeo.write(df, str(tmp_path / "t"))
    got = sorted(map(tuple, changeo.read(spark, str(tmp_path / "t")).collect()))
    assert got == [("a", "ATG", None), ("b", "CCC", "x")]


def test_fastq(spark, tmp_path):
    text = "@a|X=1\nACGT\n+\n@!+5\n\n@b\nAC\n+b\nII\n"
    (tmp_path / "r.fastq").write_text(text)
    got = {r["sequence_id"]: (r["sequence"], list(r["quality"])) for r in fastq.read_fastq(spark, str(tmp_path / "r.fastq")).collect()}
    assert got == {"a|X=1": ("ACGT", [31, 0, 10, 20]), "b": ("AC", [40, 40])}
    for name, broken in (("short", text + "@c\nACG\n+\n"), ("head", text.replace("@b", "b")), ("length", text.replace("II", "I"))):
        (tmp_path / name).write_text(broken)
        with pytest.raises(Exception, match="malformed FASTQ"):
            fastq.read_fastq(spark, str(tmp_path / name)).collect()


def test_fastq_in_many_splits(spark, tmp_path):
    (tmp_path / "r").mkdir()
    for f in range(3):
        (tmp_path / "r" / f"{f}.fastq").write_text("".join(f"@{f}-{i}\n{'ACGT' * (i % 7 + 1)}\n+\n{'@+II' * (i % 7 + 1)}\n" for i in range(300)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = fastq.read_fastq(spark, str(tmp_path / "r")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["sequence_id"] for r in got} == {f"{f}-{i}" for f in range(3) for i in range(300)} and len(got) == 900
    assert all(len(r["sequence"]) == len(r["quality"]) for r in got)


def test_alignment_quality_must_fit(spark):
    row = spark.createDataFrame([("s", "ACGT", "AC-G", "IIII", "1,2,3,4", "3=1S", None, None, 0, 0, 3, 0)], "sequence_id string, sequence string, sequence_alignment string, quality string, quality_num string, v_cigar string, d_cigar string, j_cigar string, np1_length int, np2_length int, v_sequence_end int, d_sequence_end int")
    assert base_quality.alignment_quality(row).first()["quality_alignment_num"] == "1,2,NA,3"
    with pytest.raises(Exception, match="CIGAR"):
        base_quality.alignment_quality(row.withColumn("sequence_alignment", F.lit("AC-T"))).collect()
    assert base_quality.alignment_quality(row.withColumn("quality_num", F.lit(None).cast("string")), style="num").first()["quality_alignment_num"] is None
    with pytest.raises(Exception, match="different length"):
        base_quality.position_quality(row.withColumn("q", F.lit("1,2")), quality_num="q").collect()


def test_junction_alignment(spark):
    germlines = spark.createDataFrame([("IGHV1-1*01", "A" * 320 + "."), ("IGHJ1*01", "TTTTGGGG")], "allele string, germline string")
    kind = "sequence_id string, v_call string, d_call string, j_call string, v_germline_start int, v_germline_end int, d_germline_start int, d_germline_end int, j_germline_start int, j_germline_end int, junction string, junction_length int, sequence_alignment string"
    row = ("s", "IGHV1-1*01", None, "IGHJ1*01", 1, 316, None, None, 3, 8, "x", 15, "A" * 309 + "ACGTACG" + "CC" + "TTGGGG")
    x = spark.createDataFrame([row, (*row[:10], None, 15, row[12])], kind)
    a, b = (r.asDict() for r in junctions.junction_alignment(x, germlines).collect())
    cols = ("e3v_length", "e5d_length", "e3d_length", "e5j_length", "v_cdr3_length", "j_cdr3_length")
    assert [a[c] for c in cols] == [4, None, None, 2, 4, 3] and [b[c] for c in cols] == [4, None, None, 2, None, None]
    with pytest.raises(Exception, match="isn't among the germlines"):
        junctions.junction_alignment(x.withColumn("v_call", F.lit("IGHV9-9*01")), germlines).collect()


def test_cells(spark):
    kind = "sequence_id long, cell string, locus string, v_call string, j_call string"
    rows = [(1, "a", "IGH", "IGHV1-1*01", "IGHJ1*01"), (2, "a", "IGK", "IGKV1-1*01", "IGKJ1*01"), (3, "b", "IGH", "IGHV2-1*01", "IGHJ1*01"), (4, "c", "IGH", "IGHV1-1*01,IGHV3-1*01", "IGHJ1*01")]
    group = lambda r: {x["sequence_id"]: x["v_group"] for x in usage.group_genes(spark.createDataFrame(r, kind), cell_id="cell").collect()}
    assert group(rows) == {1: "G1", 2: "G1", 3: "G2", 4: "G1"}
    # With rows without a cell, these are one cell, and light chains alone have no group.
    assert group([*rows, (5, None, "IGH", "IGHV2-1*01", "IGHJ1*01"), (6, None, "IGH", "IGHV3-1*01", "IGHJ1*01"), (7, "d", "IGL", "IGLV1-1*01", "IGLJ1*01"), (8, None, "IGK", "x", "y")]) == {1: "G1", 2: "G1", 3: "G1", 4: "G1", 5: "G1", 6: "G1", 7: None, 8: None}
    for bad, what in (((9, "a", "IGH", "IGHV1-1*01", "IGHJ1*01"), "only one heavy"), ((9, "z", "IGK", "IGKV1-1*01", "IGKJ1*01"), "without a heavy"), ((9, "z", "XYZ", "a", "b"), "no loci")):
        with pytest.raises(ValueError, match=what):
            group([*rows, bad])
    with pytest.raises(Exception, match="one to one"):
        usage.group_genes(spark.createDataFrame([(1, "a", "IGH", "IGHV1-1*01;IGHV2-1*01", "IGHJ1*01")], kind)).collect()


def test_walks(spark):
    tree = spark.createDataFrame([(1, "Germline", "a", 1.0), (1, "a", "b", 2.0), (1, "a", "c", None), (2, "Germline", "x", 1.0)], "tree_id long, from_v string, to_v string, weight double")
    got = {(r["tree_id"], r["name"]): (r["size"], r["depth"], r["pathlength"], r["outdegree"], r["parent"]) for r in topology.subtrees(tree).collect()}
    assert got == {(1, "Germline"): (4, 3, 3.0, 1, None), (1, "a"): (3, 2, 2.0, 2, "Germline"), (1, "b"): (1, 1, 0.0, 0, "a"), (1, "c"): (1, 1, 0.0, 0, "a"), (2, "Germline"): (2, 2, 1.0, 1, None), (2, "x"): (1, 1, 0.0, 0, "Germline")}
    apart = tree.union(spark.createDataFrame([(2, "p", "q", 1.0)], tree.schema))
    assert {r["name"]: r["steps"] for r in topology.path_lengths(apart).filter("tree_id = 2").collect()} == {"Germline": 0, "x": 1, "p": None, "q": None}
    ring = spark.createDataFrame([(1, "a", "b", 1.0), (1, "b", "a", 1.0)], tree.schema)
    looked, topology.LOOK = topology.LOOK, 4
    try:
        with pytest.raises(ValueError, match="cycle"):
            topology.closure(ring)
    finally:
        topology.LOOK = looked
    assert topology.subtrees(tree.limit(0)).count() == 0
    xy = {r["name"]: (r["x"], r["y"]) for r in plotting.tree_layout(tree).filter("tree_id = 1").collect()}
    assert xy == {"Germline": (0.5, 0), "a": (0.5, -1), "b": (0.0, -2), "c": (1.0, -2)}


def forest(spark, sizes, seed=1):
    """Random trees of these sizes as edges and labels, some of which are null or missing."""
    rng = random.Random(seed)
    e = [(t, "Germline" if i == 1 else f"S{rng.randint(1, i - 1)}", f"S{i}", 1.0) for t, n in enumerate(sizes) for i in range(1, n + 1)]
    n = [(t, v, rng.choice(["a", "b", "c", None])) for t, _, v, _ in e if rng.random() < 0.95]
    return spark.createDataFrame(e, "tree_id long, from_v string, to_v string, weight double"), spark.createDataFrame(n, "tree_id long, v string, value string")


def shuffled_bytes(spark, run):
    """What tasks write for others while run() runs."""
    sc = spark.sparkContext._jsc.sc()

    def now():
        sc.listenerBus().waitUntilEmpty(30_000)
        e = sc.statusStore().executorList(False)
        return sum(e.apply(i).totalShuffleWrite() for i in range(e.size()))

    before = now()
    run()
    return now() - before


def test_permuted_places():
    """Every permutation of a few places is as likely as the others, and so are the pairs of many; places of other trees don't matter."""
    rng = np.random.default_rng(1)
    for n, m in ((1, 9), (2, 20_000), (3, 20_000), (4, 20_000), (5, 100_000)):
        key = rng.integers(0, 2**63, m).astype(np.uint64).repeat(n)
        got = topology._shuffled(np.tile(np.arange(n), m), key, topology._grid(np.full(m * n, n))).reshape(m, n)
        assert (np.sort(got, axis=1) == np.arange(n)).all()
        seen, k = np.unique(got, axis=0, return_counts=True)[1], math.factorial(n)
        assert len(seen) == k and (seen == m if k == 1 else ((seen - m / k) ** 2 / (m / k)).sum() < k - 1 + 5 * math.sqrt(2 * (k - 1)))
    for n in (topology.FEW - 1, topology.FEW, 5000):
        keys = topology._iteration(np.full(400, 7, np.uint64) + np.arange(400, dtype=np.uint64), 3)
        got = topology._shuffled(np.tile(np.arange(n), 400), keys.repeat(n), topology._grid(np.full(400 * n, n))).reshape(400, n)
        assert (np.sort(got, axis=1) == np.arange(n)).all()
        seen = np.bincount(((got[:, 1:] - got[:, :-1]) % n * 16 // n).ravel(), minlength=16)
        assert ((seen - seen.mean()) ** 2 / seen.mean()).sum() < 100
    n = np.array([5, 5000, 3, 3, 2000])
    key, k = np.arange(5, dtype=np.uint64), np.array([4, 17, 0, 1, 1999])
    assert [int(topology._shuffled(k[[i]], key[[i]], topology._grid(n[[i]]))[0]) for i in range(5)] == topology._shuffled(k, key, topology._grid(n)).tolist()


@pytest.mark.parametrize("exclude", [("Germline", None), ("b",), ()])
def test_permuted_pairs(spark, exclude):
    """The counts of pairs are those that the permuted labels give, however many labels a tree may have before its rows are joined."""
    edges, labels = forest(spark, [1, 3, 8, 40, 300])
    rows = [tuple(r) for r in topology.permute_labels(labels, 4, 3, exclude).collect()]
    own = sorted((t, str(x)) for t, _, x in labels.collect())
    assert all(sorted((t, str(x)) for t, _, x, j in rows if j == i) == own for i in range(4))
    drawn, limit = {(i, t, v): x for t, v, x, i in rows}, topology.LABELS
    for indirect in (False, True):
        want = Counter()
        for t, a, c in topology.vertex_pairs(edges, labels, indirect, exclude).collect():
            want.update((i, drawn[i, t, a], drawn[i, t, c]) for i in range(4) if (i, t, a) in drawn and (i, t, c) in drawn)
        try:
            for topology.LABELS in (limit, 2, 0):
                assert {tuple(r)[:3]: r[3] for r in topology.edge_permutations(edges, labels, 4, 3, indirect, exclude).collect()} == want
        finally:
            topology.LABELS = limit


def test_histogram_of_many_permutations(spark):
    """What is shuffled doesn't grow with the iterations."""
    edges, labels = forest(spark, [3000, 3000])
    few, many = (shuffled_bytes(spark, lambda n=n: plotting.histogram(topology.edge_permutations(edges, labels, n, 1), "count").collect()) for n in (5, 100))
    assert 0 < many < 3 * few


def test_ecdf_of_many_permutations(spark):
    """What is shuffled doesn't grow with the iterations, and the shares are those of the counts."""
    edges, labels = forest(spark, [3000, 3000])
    few, many = (shuffled_bytes(spark, lambda n=n: plotting.ecdf(topology.edge_permutations(edges, labels, n, 1), "count").collect()) for n in (5, 100))
    assert 0 < many < 3 * few
    counts = sorted(r["count"] for r in topology.edge_permutations(edges, labels, 10, 1).collect())
    got = {r["count"]: r["ecdf"] for r in plotting.ecdf(topology.edge_permutations(edges, labels, 10, 1), "count").collect()}
    assert got.keys() == set(counts) and all(abs(y - sum(c <= x for c in counts) / len(counts)) < 1e-12 for x, y in got.items())


def test_many_permutations_of_edges(spark):
    """What is shuffled doesn't grow with the iterations, and what is seen is what table_edges counts."""
    edges, labels = forest(spark, [3000, 3000])
    few, many = (shuffled_bytes(spark, lambda n=n: topology.test_edges(edges, labels, n, 1).collect()) for n in (5, 100))
    assert 0 < many < 3 * few
    for exclude in (("b",), ()):
        seen = {(r["parent"], r["child"]): r["count"] for r in topology.test_edges(edges, labels, 2, 1, exclude=exclude).collect()}
        assert seen == {(r["parent"], r["child"]): r["count"] for r in topology.table_edges(edges, labels, exclude=exclude).collect()}


@pytest.mark.parametrize("exclude", [("Germline", None), ("b",)])
def test_permuted_founders(spark, exclude):
    """The labels that are the only ones among a tree's nearest vertices are those that the permuted labels give."""
    edges, labels = forest(spark, [1, 3, 8, 40, 300])
    edges = edges.withColumn("weight", F.when(F.expr("tree_id = 3"), F.lit(0.0)).otherwise(F.col("weight")))
    labels = labels.fillna("d")
    drawn, limit = {}, topology.LABELS
    for t, v, x, i in topology.permute_labels(labels, 4, 3, exclude).collect():
        drawn[i, t, v] = x
    of = {}
    for r in topology.mrca(edges, "distance", "Germline", labels, exclude).collect():
        for i in range(4):
            if (i, r["tree_id"], r["name"]) in drawn:
                of.setdefault((i, r["tree_id"]), set()).add(drawn[i, r["tree_id"], r["name"]])
    want = Counter((i, *x) for (i, _), x in of.items() if len(x) == 1)
    try:
        for topology.LABELS in (limit, 2):
            assert {tuple(r)[:2]: r[2] for r in topology.mrca_permutations(edges, labels, nperm=4, seed=3, exclude=exclude).collect()} == want
    finally:
        topology.LABELS = limit


def test_nearest(spark, monkeypatch):
    """The walk for the nearest vertices ends early, but for weights below zero, and finds what a whole walk finds."""
    edges, labels = forest(spark, [1, 3, 8, 40, 60], 2)
    some, below = F.expr("case crc32(to_v) % 4 when 0 then 0.0 when 1 then null else 1.0 end"), F.expr("crc32(to_v) % 5 - 2.0")
    for w, path, exclude in ((some, "distance", ("Germline", None)), (some, "steps", ("b",)), (below, "distance", ("b",))):
        e = edges.withColumn("weight", w)
        got = {(r["tree_id"], r["name"], r["steps"], r["distance"]) for r in topology.mrca(e, path, "Germline", labels, exclude).collect()}
        value, best = {(r["tree_id"], r["v"]): r["value"] for r in labels.collect()}, {}
        for r in topology.path_lengths(e, "Germline", labels, exclude).collect():
            x = value.get((r["tree_id"], r["name"]))
            if r["name"] != "Germline" and x not in exclude:
                best.setdefault(r["tree_id"], []).append((r[path], (r["tree_id"], r["name"], r["steps"], r["distance"])))
        assert got == {x for rows in best.values() for p, x in rows if p == min(rows)[0]}
    chain = spark.createDataFrame([(1, "Germline" if i == 1 else f"S{i - 1}", f"S{i}", 1.0) for i in range(1, 41)], "tree_id long, from_v string, to_v string, weight double")
    walked, levels = [], topology._levels
    monkeypatch.setattr(topology, "_levels", lambda *a: walked.append(levels(*a)) or walked[-1])
    assert [r["name"] for r in topology.mrca(chain).collect()] == ["S1"] and len(walked[0]) <= 3


def test_many_permutations_of_founders(spark):
    """What is shuffled doesn't grow with the iterations."""
    edges, labels = forest(spark, [3000, 3000])
    few, many = (shuffled_bytes(spark, lambda n=n: topology.mrca_permutations(edges, labels, nperm=n, seed=1).collect()) for n in (5, 100))
    assert 0 < many < 3 * few


def test_many_permutations_of_indirect_edges(spark):
    """Pairs over skipped vertices are those of a plain search, and what is shuffled doesn't grow with the iterations."""
    edges, labels = forest(spark, [1, 3, 40, 400], 3)
    value, kids = {(t, v): x for t, v, x in labels.collect()}, {}
    for t, a, b, _ in edges.collect():
        kids.setdefault((t, a), []).append(b)
    for exclude in (("b", None), ("b", "c"), ()):
        skipped, want = lambda t, v, x=exclude: value.get((t, v)) in x, Counter()
        for t, a in kids:
            todo = [] if skipped(t, a) else [(b, None) for b in kids[t, a]]
            while todo:
                v, child = todo.pop()
                if skipped(t, v) or child is None:
                    child = child if skipped(t, v) else v
                    want[t, a, child] += child is not None
                    todo += [(b, child) for b in kids.get((t, v), [])]
        assert Counter(map(tuple, topology.vertex_pairs(edges, labels, True, exclude).collect())) == +want
    edges, labels = forest(spark, [3000, 3000])
    few, many = (shuffled_bytes(spark, lambda n=n: topology.test_edges(edges, labels, n, 1, True, ("c", None)).collect()) for n in (5, 100))
    assert 0 < many < 3 * few


def test_statistics(spark):
    df = spark.createDataFrame([("g", 0.1, 5.0), ("g", 0.05, 10.0), ("g", 0.3, 1.0), ("g", None, 1.0), ("h", 0.5, 1.0)], "k string, p double, w double")
    n = NormalDist()
    x, w = [n.inv_cdf(1 - p) for p in (0.1, 0.05, 0.3)], (5, 10, 1)
    for weights, column in ((w, "w"), ((1, 1, 1), None)):
        z = sum(a * b for a, b in zip(x, weights)) / math.sqrt(sum(b * b for b in weights))
        got = {r["k"]: r for r in statistics.stouffer(df, ["k"], "p", column).collect()}
        assert abs(got["g"]["z"] - z) < 1e-9 and abs(got["g"]["pvalue"] - (1 - n.cdf(z))) < 1e-9 and abs(got["h"]["pvalue"] - 0.5) < 1e-12
    t = df.withColumn("e", F.lit(None).cast("string"))
    assert statistics.check_columns(t, ["k", "p"]) is True and statistics.check_columns(t, ["e", "k"], "any") is True
    assert "not found" in statistics.check_columns(t, ["k", "zz"]) and "no data" in statistics.check_columns(t, ["k", "e"])
    assert "at least one" in statistics.check_columns(t, ["zz"], "any") and "None of" in statistics.check_columns(t, ["e"], "any")


def test_draws_in_parts(spark):
    """Drawing parts first, then clones within them, keeps every resampling at its depth and the shares where they belong."""
    rows = [(g, f"c{i}") for g in "xy" for i in range(30) for _ in range(i + 1)]
    df = spark.createDataFrame(rows, "g string, clone_id string")
    whole, diversity.PART = diversity.PART, 7
    try:
        _, draws = diversity._draws(df, "g", 30, None, True, 50, 3, "clone_id")
        got = draws.collect()
        again = diversity._draws(df.repartition(7), "g", 30, None, True, 50, 3, "clone_id")[1].collect()
    finally:
        diversity.PART = whole
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    total, mean = {}, {}
    for r in got:
        total[r["g"], r["boot"]] = total.get((r["g"], r["boot"]), 0) + r["p"]
        mean[r["g"], r["clone_id"]] = mean.get((r["g"], r["clone_id"]), 0) + r["p"] / 50
    assert len(total) == 100 and all(abs(v - 1) < 1e-9 for v in total.values())
    want = {(r["g"], r["clone_id"]): r["p"] for r in diversity.complete_abundance(df, "g").collect()}
    assert all(abs(mean.get(k, 0) - p) < 0.015 for k, p in want.items())
    copies = diversity.estimate_abundance(spark.createDataFrame([("x", "a", 90), ("x", "b", 10), ("x", "b", 20)], "g string, clone_id string, n int"), "g", nboot=20, copy="n").collect()
    assert {r["clone_id"]: round(r["p"], 1) for r in copies if not r["clone_id"].startswith("U")} == {"a": 0.8, "b": 0.2} or abs(sum(r["p"] for r in copies) - 1) < 1e-9


def test_usage_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "IGHV1-1*01"), ("2024-01-01 00:50:00", "IGHV1-1*02"), ("2024-01-01 01:10:00", "IGHV2-1*01"), ("2024-01-01 01:20:00", None)]
    df = spark.createDataFrame(rows, "t string, v_call string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_usage(stream, "t", "v_call").writeStream.format("memory").queryName("usage_of_a_stream").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {(r["window"]["start"].hour, r["gene"]): r["seq_count"] for r in spark.table("usage_of_a_stream").collect()}
    assert got == {(0, "IGHV1-1"): 2, (1, "IGHV2-1"): 1}


def test_igphyml(spark, tmp_path):
    (tmp_path / "ig.tab").write_text("CLONE\tNSEQ\tNSITE\tLHOOD\tTREE\nREPERTOIRE\t0\t0\t-100.5\tigphyml --run\n1\t3\t100\t-50.2\t(seq1:0.1,seq2:0.2,1_GERM:0.0);\n2\t4\t100\tx\t((seqA:0.3,seqB:0.1)k:0.05,2_GERM:0.0);\n")
    ig = igphyml.read(spark, str(tmp_path / "ig.tab"), id="d")
    assert ig.command == "igphyml --run" and dict(ig.params.dtypes)["nseq"] == "double" and dict(ig.params.dtypes)["lhood"] == "string"
    assert {(r["clone"], r["name"]) for r in ig.germlines.collect()} == {("1", "1_GERM"), ("2", "2_GERM")}
    assert ("2", "k", "seqA", 30.0) in {tuple(r) for r in ig.trees.collect()}
    bare = igphyml.read(spark, str(tmp_path / "ig.tab"), collapse=True, branches="distance")
    assert ("2", "node1", "seqA", 0.3) in {tuple(r) for r in bare.trees.collect()}
    assert [r["id"] for r in igphyml.combine([ig, ig]).collect()] == ["d", "d"]
    with pytest.raises(ValueError, match="id"):
        igphyml.combine([bare])
    (tmp_path / "two.tab").write_text("CLONE\tNSEQ\tNSITE\tTREE\n1\t3\t100\t(1_GERM:0.1,x1_GERM:0.2);\n")
    with pytest.raises(Exception, match="germline tip"):
        igphyml.read(spark, str(tmp_path / "two.tab")).germlines.collect()


def test_clones_must_fit(spark):
    kind = "clone_id long, sequence_id long, sequence_alignment string, germline_alignment string, v_call string, j_call string, junction_length int, locus string"
    rows = [(1, 1, "AC-T", "AC-T", "IGHV1-1*01", "IGHJ1*01", 9, "IGH"), (1, 2, "ACG", "AC-T", "IGHV1-1*01", "IGHJ1*01", 9, "IGH")]
    df = spark.createDataFrame(rows, kind)
    with pytest.raises(Exception, match="one length"):
        clones.make_clones(df).collect()
    with pytest.raises(Exception, match="IGH is allowed"):
        clones.make_clones(df.limit(1).withColumn("locus", F.lit("IGK"))).collect()
    got = clones.make_clones(df, pad_end=True).collect()
    assert {(r["sequence_id"], r["sequence"], r["collapse_count"], r["germline"], r["v_gene"]) for r in got} == {(1, "ACNTNN", 2, "ACNTNN", "IGHV1-1")} or len(got) == 1


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, duck, name):
    a = catalog.QUERIES[name](spark, SF)
    b = duck.execute(catalog.ORACLE[name])
    cols = [c[0] for c in b.description]
    assert sorted(a.columns) == sorted(cols)
    x = sorted(map(repr, (tuple(r) for r in a.select(*cols).collect())))
    assert x == sorted(map(repr, b.fetchall()))


def test_lineages_of_all_clones(spark, duck):
    got = {r[0] for r in catalog.QUERIES["build_lineage"](spark, SF).select("tree_id").distinct().collect()}
    sql = f"SELECT CAST(clone_id AS VARCHAR) FROM ({fixtures.ALIGNED}) x GROUP BY 1 HAVING count(DISTINCT translate(sequence_alignment, '-.', 'NN')) > 1"
    assert got == {r[0] for r in duck.execute(sql).fetchall()}
    small = spark.createDataFrame([(1, 1, "ACGT", "ACGA"), (2, 2, "ACGT", "ACGA"), (2, 3, "AAAA", "ACGA")], "clone_id long, sequence_id long, sequence_alignment string, germline_alignment string")
    assert {r["tree_id"] for r in lineage.build_lineage(small).collect()} == {"2"}


BIG = "/root/testdata/sf0.01"


def test_views_have_all_events(spark):
    n = spark.read.parquet(f"{BIG}/events.parquet").count()
    assert n > 2000 and [fixtures.view(spark, BIG, v).count() for v in (fixtures.ALIGNED, fixtures.TREES)] == [n, n]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
