"""The registered queries over the derived views, and the SQL that each is compared with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..constants import BULKINESS, CODONS, HYDROPATHY, IUPAC_AA, IUPAC_DNA, PK, POLARITY
from ..functions import aminoacids as aa
from ..functions import genes, quality, sequences
from ..operators import base_quality, clones, diversity, junctions, lineage, phylo, plotting, statistics, topology, usage
from ..operators import sequences as seqs
from ..sources import changeo, fastq, igphyml, newick
from ..workspace import folder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, over: str = ""):
    """Registers a query over a view (repertoire, clones, aligned, trees; none: the spark session and folder), and its SQL."""
    view = {"repertoire": fx.REPERTOIRE, "clones": fx.CLONES, "aligned": fx.ALIGNED, "trees": fx.TREES}.get(over)

    def add(f):
        QUERIES[name] = (lambda spark, sf_dir: f(fx.view(spark, sf_dir, view))) if view else f
        if sql:
            ORACLE[name] = f"WITH {over} AS ({view}) {sql}" if view else sql
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Gene calls.
def _seg(p: str, call: str = "v_call", first: bool = True, strip: bool = True) -> str:
    x = f"regexp_replace({call}, '[^,]*{p}[^,]*', '\\1', 'g')"
    if strip:
        x = f"regexp_replace({x}, '([A-Z0-9][0-9])D(\\*|-|,|$)', '\\1\\2', 'g')"
    return f"regexp_replace({x}, ',.*$', '')" if first else x


_CHAIN = f"regexp_replace(regexp_replace({_seg(genes.LOCUS)}, 'IGH|TRB|TRD', 'VH', 'g'), 'IGK|IGL|TRA|TRG', 'VL', 'g')"
for _n, _f, _x in (("allele", genes.get_allele, _seg(genes.ALLELE)), ("gene", genes.get_gene, _seg(genes.GENE)), ("family", genes.get_family, _seg(genes.FAMILY)), ("locus", genes.get_locus, _seg(genes.LOCUS)), ("chain", genes.get_chain, _CHAIN)):
    query(f"get_{_n}", f"SELECT sequence_id, {_x} AS call FROM repertoire", "repertoire")(lambda d, f=_f: d.select("sequence_id", f(F.col("v_call")).alias("call")))
query("get_gene_all", f"SELECT sequence_id, {_seg(genes.GENE, first=False)} AS call FROM repertoire", "repertoire")(lambda d: d.select("sequence_id", genes.get_gene(F.col("v_call"), first=False, collapse=False).alias("call")))
_TWO = _seg(genes.GENE, first=False)
query("get_gene_collapsed", f"SELECT sequence_id, CASE WHEN split_part({_TWO}, ',', 1) = split_part({_TWO}, ',', 2) THEN split_part({_TWO}, ',', 1) ELSE {_TWO} END AS call FROM repertoire", "repertoire")(lambda d: d.select("sequence_id", genes.get_gene(F.col("v_call"), first=False).alias("call")))
query("sort_genes", f"SELECT allele, row_number() OVER (ORDER BY {_seg(genes.FAMILY, 'allele', strip=False)}, CAST(regexp_extract(allele, '-([0-9]+)D?\\*', 1) || CASE WHEN allele LIKE '%D*%' THEN '99' ELSE '' END AS INT), CAST(regexp_extract(allele, '\\*(\\w+)', 1) AS INT), allele) AS rank FROM (SELECT DISTINCT unnest(string_split({_seg(genes.ALLELE, first=False, strip=False)}, ',')) AS allele FROM repertoire) a", "repertoire")(
    lambda d: usage.sort_genes(d, "v_call").withColumn("rank", F.col("rank").cast("long"))
)
_KEYS = f"{_seg(genes.FAMILY, 'allele', strip=False)} AS f, CAST(regexp_extract(allele, '-([0-9]+)D?\\*', 1) || CASE WHEN allele LIKE '%D*%' THEN '99' ELSE '' END AS INT) AS g, CAST(regexp_extract(allele, '\\*(\\w+)', 1) AS INT) AS a"
query("sort_genes_position", f"SELECT allele, row_number() OVER (ORDER BY g DESC, f, a, allele) AS rank FROM (SELECT allele, {_KEYS} FROM (SELECT DISTINCT unnest(string_split({_seg(genes.ALLELE, first=False, strip=False)}, ',')) AS allele FROM repertoire) x) y", "repertoire")(
    lambda d: usage.sort_genes(d, "v_call", "position").withColumn("rank", F.col("rank").cast("long"))
)
_NL = "CASE WHEN sequence_id % 4 = 0 THEN concat('Homsap IGHV3-NL1*01 F,', v_call) WHEN sequence_id % 4 = 1 THEN concat(v_call, ',Homsap IGHV10-NL2*01 F') ELSE v_call END"
_LOCAL = f"regexp_replace(regexp_replace(c, '[^,]*{genes.ALLELE}[^,]*', '\\1', 'g'), '[^,]*{genes.NON_LOCALIZED}[^,]*(,|$)', '', 'g')"
query("get_gene_omit_nl", f"SELECT sequence_id, {_seg(genes.GENE, 'l')} AS call FROM (SELECT sequence_id, {_LOCAL} AS l FROM (SELECT sequence_id, {_NL} AS c FROM repertoire) x) y", "repertoire")(lambda d: d.select("sequence_id", genes.get_gene(F.expr(_NL), omit_nl=True).alias("call")))

# Usage and clones.
for _m, _p in (("family", genes.FAMILY), ("gene", genes.GENE), ("allele", genes.ALLELE)):
    query(f"count_genes_{_m}", f"SELECT sample_id, locus, gene, seq_count, CAST(sum(seq_count) OVER (PARTITION BY sample_id, locus) AS BIGINT) AS locus_count, round(seq_count / sum(seq_count) OVER (PARTITION BY sample_id, locus), 6) AS seq_freq FROM (SELECT sample_id, substr({_seg(_p)}, 1, 3) AS locus, {_seg(_p)} AS gene, count(*) AS seq_count FROM repertoire GROUP BY ALL) x", "repertoire")(
        lambda d, m=_m: _rounded(usage.count_genes(d, "v_call", ["sample_id"], mode=m))
    )
query("count_genes_copy", f"SELECT *, round(seq_count / sum(seq_count) OVER w, 6) AS seq_freq, round(copy_count / sum(copy_count) OVER w, 6) AS copy_freq FROM (SELECT sample_id, 'IGH' AS locus, {_seg(genes.FAMILY)} AS gene, count(*) AS seq_count, CAST(sum(duplicate_count) AS BIGINT) AS copy_count FROM repertoire GROUP BY ALL) x WINDOW w AS (PARTITION BY sample_id)", "repertoire")(
    lambda d: _rounded(usage.count_genes(d, "v_call", ["sample_id"], copy="duplicate_count", mode="family"))
)
query("count_genes_clone", f"SELECT sample_id, locus, gene, clone_count, CAST(sum(clone_count) OVER (PARTITION BY sample_id) AS BIGINT) AS locus_clone_count, round(clone_count / sum(clone_count) OVER (PARTITION BY sample_id), 6) AS clone_freq FROM (SELECT sample_id, 'IGH' AS locus, gene, count(*) AS clone_count FROM (SELECT sample_id, clone_id, gene, row_number() OVER (PARTITION BY sample_id, clone_id ORDER BY n DESC, gene) AS r FROM (SELECT sample_id, clone_id, {_seg(genes.GENE)} AS gene, count(*) AS n FROM repertoire GROUP BY ALL) a) b WHERE r = 1 GROUP BY ALL) c", "repertoire")(
    lambda d: _rounded(usage.count_genes(d, "v_call", ["sample_id"], clone="clone_id"))
)
query("count_genes_fill", f", g AS (SELECT sample_id, {_seg(genes.ALLELE)} AS gene, count(*) AS n FROM repertoire GROUP BY ALL), e AS (SELECT DISTINCT a.sample_id, b.gene FROM g a, g b) SELECT e.sample_id, e.gene, 'IGH' AS locus, coalesce(n, 0) AS seq_count, CASE WHEN n IS NOT NULL THEN CAST(sum(n) OVER (PARTITION BY e.sample_id) AS BIGINT) END AS locus_count, round(coalesce(n / sum(n) OVER (PARTITION BY e.sample_id), 0), 6) AS seq_freq FROM e LEFT JOIN g USING (sample_id, gene)", "repertoire")(
    lambda d: _rounded(usage.count_genes(d, "v_call", ["sample_id"], mode="allele", fill=True))
)
query("count_clones", "SELECT sample_id, clone_id, count(*) AS seq_count, round(count(*) / sum(count(*)) OVER (PARTITION BY sample_id), 6) AS seq_freq FROM clones GROUP BY sample_id, clone_id", "clones")(lambda d: _rounded(usage.count_clones(d, ["sample_id"])))
query("count_clones_copy", "SELECT sample_id, clone_id, count(*) AS seq_count, CAST(sum(duplicate_count) AS BIGINT) AS copy_count, round(count(*) / sum(count(*)) OVER (PARTITION BY sample_id), 6) AS seq_freq, round(sum(duplicate_count) / sum(sum(duplicate_count)) OVER (PARTITION BY sample_id), 6) AS copy_freq FROM repertoire GROUP BY sample_id, clone_id", "repertoire")(
    lambda d: _rounded(usage.count_clones(d, ["sample_id"], copy="duplicate_count"))
)


def _grouping(first: bool = False, extra: str = "", of: str = "repertoire") -> str:
    """Rows and the least key of their V/J class, from a recursive walk over distinct token sets."""
    v, j = _seg(genes.GENE, first=first), _seg(genes.GENE, "j_call", first=first)
    return f", t AS (SELECT DISTINCT sequence_id, unnest(string_split({v}, ',')) || '@' || {j}{extra} AS token FROM {of}), s AS (SELECT sequence_id, string_agg(token, '|' ORDER BY token) AS k FROM t GROUP BY 1), m AS (SELECT DISTINCT k, token FROM s JOIN t USING (sequence_id)), RECUR, l AS (SELECT k, min(k2) AS c FROM r GROUP BY 1), found AS (SELECT sequence_id, min(sequence_id) OVER (PARTITION BY c) AS group_key FROM s JOIN l USING (k))".replace("RECUR", "r AS (SELECT k, k AS k2 FROM s UNION SELECT r.k, b.k FROM r JOIN m a ON a.k = r.k2 JOIN m b ON a.token = b.token)")


for _first in (False, True):
    query("group_genes_first" if _first else "group_genes", None, "repertoire")(lambda d, first=_first: usage.group_genes(d, first=first).select("sequence_id", "group_key"))
    ORACLE["group_genes_first" if _first else "group_genes"] = f"WITH RECURSIVE repertoire AS ({fx.REPERTOIRE}) {_grouping(_first)} SELECT * FROM found"
query("group_genes_len", None, "repertoire")(lambda d: usage.group_genes(d.withColumn("n", F.expr("30 + 3 * (sequence_id % 3)")), junc_len="n").select("sequence_id", "group_key"))
_LENGTH = " || '@' || CAST(30 + 3 * (sequence_id % 3) AS VARCHAR)"
ORACLE["group_genes_len"] = f"WITH RECURSIVE repertoire AS ({fx.REPERTOIRE}) {_grouping(extra=_LENGTH)} SELECT * FROM found"
query("group_genes_cell", None, "repertoire")(
    lambda d: usage.group_genes(d.withColumns({"cell": F.expr("sequence_id div 2"), "locus": F.expr("CASE WHEN sequence_id % 2 = 0 THEN 'IGH' ELSE 'IGK' END")}), cell_id="cell").select("sequence_id", "group_key")
)
ORACLE["group_genes_cell"] = f"WITH RECURSIVE repertoire AS ({fx.REPERTOIRE}), heavy AS (SELECT * FROM repertoire WHERE sequence_id % 2 = 0) {_grouping(of='heavy')} SELECT a.sequence_id, group_key FROM repertoire a LEFT JOIN found f ON f.sequence_id = a.sequence_id - a.sequence_id % 2"

# Coverage, abundance, diversity.
_COUNTS = ", c AS (SELECT sample_id, clone_id, count(*) AS x FROM clones GROUP BY ALL), s AS (SELECT sample_id, CAST(sum(x) AS DOUBLE) AS n, CAST(count(*) FILTER (x=1) AS DOUBLE) AS f1, CAST(count(*) FILTER (x=2) AS DOUBLE) AS f2, CAST(count(*) FILTER (x=3) AS DOUBLE) AS f3, CAST(sum(CASE WHEN x >= 2 THEN x*x END) AS DOUBLE) AS s2 FROM c GROUP BY 1), v AS (SELECT *, 1 - f1/n * (CASE WHEN f2 > 0 THEN (n-1)*f1/((n-1)*f1+2*f2) ELSE (n-1)*(f1-1)/((n-1)*(f1-1)+2) END) AS cov, CAST(ceil(CASE WHEN f2 > 0 THEN (n-1)*f1*f1/(n*2*f2) ELSE (n-1)*f1*(f1-1)/(n*2) END) AS BIGINT) AS f0 FROM s)"
query("coverage_r1", f"{_COUNTS} SELECT sample_id, round(cov, 6) AS coverage FROM v", "clones")(lambda d: _rounded(diversity.coverage(d, "sample_id")))
query("coverage_r2", f"{_COUNTS} SELECT sample_id, CASE WHEN f2 > 0 AND f3 > 0 THEN round(1 - 2*f2/s2 * pow((n-2)*f2/((n-2)*f2+3*f3), 2), 6) END AS coverage FROM v", "clones")(lambda d: _rounded(diversity.coverage(d, "sample_id", 2)))
query("complete_abundance", f"{_COUNTS}, l AS (SELECT sample_id, sum(x/n*exp(-x)) AS z FROM c JOIN v USING (sample_id) GROUP BY 1) SELECT sample_id, CAST(clone_id AS VARCHAR) AS clone_id, round(x/n*(1-(1-cov)/z*exp(-x)), 6) AS p FROM c JOIN v USING (sample_id) JOIN l USING (sample_id) UNION ALL SELECT sample_id, 'U' || CAST(i AS VARCHAR), round((1-cov)/f0, 6) FROM (SELECT sample_id, cov, f0, unnest(range(1, f0+1)) AS i FROM v) u", "clones")(
    lambda d: _rounded(diversity.complete_abundance(d, "sample_id"))
)
query("hill", f"{_COUNTS} SELECT sample_id, q, round(pow(sum(pow(x/n, e)), 1/(1-e)), 4) AS d FROM c JOIN s USING (sample_id), (SELECT unnest([0.0::DOUBLE, 1.0, 2.0]) AS q, unnest([0.0::DOUBLE, 0.9999, 2.0]) AS e) o GROUP BY sample_id, q, e", "clones")(
    lambda d: _rounded(diversity.hill(usage.count_clones(d, ["sample_id"]).withColumn("p", F.col("seq_freq")), ["sample_id"], [0, 1, 2]), 4)
)
query("estimate_abundance", None, "repertoire")(lambda d: diversity.estimate_abundance(d, "sample_id", nboot=200, seed=1))
query("estimate_abundance_copy", None, "repertoire")(lambda d: diversity.estimate_abundance(d, "sample_id", nboot=20, seed=1, copy="duplicate_count"))
query("alpha_diversity", None, "repertoire")(lambda d: diversity.alpha_diversity(d, "sample_id", [x / 2 for x in range(9)], nboot=200, seed=1))
query("diversity_test", None, "repertoire")(lambda d: diversity.diversity_test(d, "sample_id", 2.0, nboot=200, seed=1))

# Translation and amino acids.
_CASE = "CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CODONS.items()) + " ELSE 'X' END"
_AA = f"SELECT sequence_id, string_agg({_CASE}, '' ORDER BY i) AS aa FROM (SELECT sequence_id, i, substr(junction, 3*i+1, 3) AS c FROM (SELECT sequence_id, junction, unnest(range(0, length(junction)//3)) AS i FROM repertoire) a) b GROUP BY 1"
query("translate", _AA, "repertoire")(lambda d: d.select("sequence_id", sequences.translate_dna(F.col("junction")).alias("aa")))
query("translate_trim", _AA.replace("SELECT sequence_id, junction, unnest", "SELECT sequence_id, substr(junction, 4, length(junction)-6) AS junction, unnest").replace("length(junction)//3", "(length(junction)-6)//3"), "repertoire")(lambda d: d.select("sequence_id", sequences.translate_dna(F.col("junction"), trim=True).alias("aa")))
_N = lambda letters: f"(length(aa) - length(translate(aa, '{letters}', '')))"
_I = "nullif(length(translate(aa, 'X.*-', '')), 0)"
_TOTAL = lambda t: "(" + " + ".join(f"({v}) * {_N(k)}" for k, v in t.items()) + f") / {_I}"
_CHARGE = " + ".join(f"{1 / (1 + 10 ** (7.4 - PK[a]))!r} * {_N(a)}" for a in "RHK") + "".join(f" - {1 / (1 + 10 ** -(7.4 - PK[a]))!r} * {_N(a)}" for a in "DECY")
_PROPS = {
    "length": "CAST(length(aa) AS DOUBLE)", "gravy": _TOTAL(HYDROPATHY), "bulk": _TOTAL(BULKINESS), "aliphatic": f"({_N('A')} + 2.9*{_N('V')} + 3.9*{_N('LI')}) / {_I}",
    "polarity": _TOTAL(POLARITY), "charge": _CHARGE, "basic": f"{_N('RHK')} / {_I}", "acidic": f"{_N('DE')} / {_I}", "aromatic": f"{_N('FWHY')} / {_I}",
}
query("aa_properties", f", t AS ({_AA}) SELECT sequence_id, " + ", ".join(f"round(CAST({x} AS DOUBLE), 6) AS junction_aa_{k}" for k, x in _PROPS.items()) + " FROM t", "repertoire")(
    lambda d: _rounded(d.withColumn("aa", sequences.translate_dna(F.col("junction"))).select("sequence_id", *[c.alias(k) for k, c in aa.properties(F.col("aa"), "junction").items()]))
)
for _n in ("gravy", "bulk", "polar", "aliphatic", "charge"):
    query(_n, f", t AS ({_AA}) SELECT sequence_id, round(CAST({_PROPS['polarity' if _n == 'polar' else _n]} AS DOUBLE), 6) AS score FROM t", "repertoire")(
        lambda d, n=_n: d.withColumn("aa", sequences.translate_dna(F.col("junction"))).select("sequence_id", F.round(getattr(aa, n)(F.col("aa")), 6).alias("score"))
    )
query("valid_aa", "SELECT sequence_id, regexp_full_match(junction, '[ARNDCQEGHILKMFPSTWYVX.*-]*') AS valid, regexp_full_match(v_call, '[ARNDCQEGHILKMFPSTWYVX.*-]*') AS call_valid FROM repertoire", "repertoire")(lambda d: d.select("sequence_id", aa.is_valid(F.col("junction")).alias("valid"), aa.is_valid(F.col("v_call")).alias("call_valid")))
query("count_patterns", f", t AS ({_AA}) SELECT sequence_id, round(len(regexp_extract_all(aa, 'A')) / length(aa), 6) AS arg, round(len(regexp_extract_all(aa, '[ST]')) / length(aa), 6) AS st FROM t", "repertoire")(
    lambda d: _rounded(d.withColumn("aa", sequences.translate_dna(F.col("junction"))).select("sequence_id", *[c.alias(k) for k, c in aa.count_patterns(F.col("aa"), {"arg": "A", "st": "[ST]"}).items()]))
)

# Sequences.
query("mask_gaps", "SELECT sequence_id, translate(sequence_alignment, '-.', 'NN') AS masked FROM aligned", "aligned")(lambda d: d.select("sequence_id", sequences.mask_gaps(F.col("sequence_alignment")).alias("masked")))
query("mask_gaps_outer", "SELECT sequence_id, repeat('N', length(s) - length(ltrim(s, '-.'))) || trim(s, '-.') || repeat('N', length(s) - length(rtrim(s, '-.'))) AS masked FROM (SELECT sequence_id, sequence_alignment AS s FROM aligned) x", "aligned")(lambda d: d.select("sequence_id", sequences.mask_gaps(F.col("sequence_alignment"), outer_only=True).alias("masked")))
query("mask_ends", ", x AS (SELECT *, max(length(s) - length(ltrim(s, 'N'))) OVER (PARTITION BY clone_id) AS l, max(length(s) - length(rtrim(s, 'N'))) OVER (PARTITION BY clone_id) AS r FROM (SELECT sequence_id, clone_id, translate(sequence_alignment, '-.', 'NN') AS s FROM aligned) y) SELECT sequence_id, repeat('N', l) || substr(s, l+1, length(s)-l-r) || repeat('N', r) AS masked FROM x", "aligned")(
    lambda d: seqs.mask_ends(d.withColumn("s", sequences.mask_gaps(F.col("sequence_alignment"))), "s", ["clone_id"]).select("sequence_id", "masked")
)
query("pad_ends", "SELECT sequence_id, rpad(s, CAST(ceil(max(length(s)) OVER (PARTITION BY clone_id) / 3) * 3 AS INT), 'N') AS padded FROM (SELECT sequence_id, clone_id, substr(sequence_alignment, 1, CAST(20 + sequence_id % 9 AS INT)) AS s FROM aligned) x", "aligned")(
    lambda d: seqs.pad_ends(d.withColumn("s", F.expr("substr(sequence_alignment, 1, cast(20 + sequence_id % 9 as int))")), "s", ["clone_id"]).select("sequence_id", "padded")
)
query("extract_region", "SELECT sequence_id, substr(s, 1, 78) AS fwr1, substr(s, 79, 36) AS cdr1, substr(s, 115, 51) AS fwr2, substr(s, 166, 30) AS cdr2, substr(s, 196, 117) AS fwr3 FROM (SELECT sequence_id, repeat(sequence_alignment, 11) AS s FROM aligned) x", "aligned")(
    lambda d: d.select("sequence_id", *[sequences.extract_region(F.repeat("sequence_alignment", F.lit(11)), r).alias(r) for r in ("fwr1", "cdr1", "fwr2", "cdr2", "fwr3")])
)
_IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "N": "ACGT"}


def _class(gap: str) -> str:
    """A string of classes of two aligned sequences of A, C, G, T, N and gaps: 1 different, g gap against base, 0 equal."""
    return "list_transform(range(1, length(p)+1), lambda i: CASE WHEN substr(p,i,1) IN ('-','.') AND substr(q,i,1) IN ('-','.') THEN '0' WHEN substr(p,i,1) IN ('-','.') OR substr(q,i,1) IN ('-','.') THEN 'g' WHEN substr(p,i,1)=substr(q,i,1) OR 'N' IN (substr(p,i,1), substr(q,i,1)) THEN '0' ELSE '1' END)"


_DIST_SQL = f"(len(list_filter(k, lambda x: x='1')) + len(regexp_extract_all(array_to_string(k, ''), 'g+')))"
query("seq_dist", f"SELECT sequence_id, CAST({_DIST_SQL} AS DOUBLE) AS dist FROM (SELECT sequence_id, {_class('g')} AS k FROM (SELECT sequence_id, sequence_alignment AS p, germline_alignment AS q FROM aligned) a) b", "aligned")(lambda d: d.select("sequence_id", sequences.seq_dist(F.col("sequence_alignment"), F.col("germline_alignment")).alias("dist")))
query("seq_equal", f"SELECT sequence_id, len(list_filter(k, lambda x: x='1')) = 0 AS equal FROM (SELECT sequence_id, {_class('g')} AS k FROM (SELECT sequence_id, sequence_alignment AS p, germline_alignment AS q FROM aligned) a) b", "aligned")(lambda d: d.select("sequence_id", sequences.seq_equal(F.col("sequence_alignment"), F.col("germline_alignment")).alias("equal")))
_PAIRS = f"SELECT clone_id, id_i, id_j, {_class('g')} AS k FROM (SELECT a.clone_id, a.sequence_id AS id_i, b.sequence_id AS id_j, a.sequence_alignment AS p, b.sequence_alignment AS q FROM aligned a JOIN aligned b ON a.clone_id = b.clone_id AND a.sequence_id < b.sequence_id) x"
query("pairwise_dist", f"SELECT clone_id, id_i, id_j, CAST({_DIST_SQL} AS DOUBLE) AS dist FROM ({_PAIRS}) y", "aligned")(lambda d: seqs.pairwise_dist(d, "sequence_id", "sequence_alignment", ["clone_id"]))
query("pairwise_equal", f"SELECT clone_id, id_i, id_j, len(list_filter(k, lambda x: x='1')) = 0 AS equal FROM ({_PAIRS}) y", "aligned")(lambda d: seqs.pairwise_equal(d, "sequence_id", "sequence_alignment", ["clone_id"]))
query("nonsquare_dist", f"SELECT clone_id, id_i, id_j, CASE WHEN id_i = id_j THEN 0 ELSE CAST({_DIST_SQL} AS DOUBLE) END AS dist FROM (SELECT clone_id, id_i, id_j, {_class('g')} AS k FROM (SELECT a.clone_id, a.sequence_id AS id_i, b.sequence_id AS id_j, a.sequence_alignment AS p, b.sequence_alignment AS q FROM aligned a JOIN aligned b ON a.clone_id = b.clone_id AND a.sequence_alignment LIKE '%-%') x) y", "aligned")(
    lambda d: seqs.nonsquare_dist(d, "sequence_id", "sequence_alignment", ["clone_id"], F.col("sequence_alignment").contains("-"))
)


def _collapsed(of: str, seq: str) -> str:
    """Common tables u (distinct sequences), near, clear and out: what collapsing the duplicates of a clone leaves."""
    same = f"len(list_filter(range(1, length(p)+1), lambda i: substr(p,i,1) <> substr(q,i,1) AND substr(p,i,1) NOT IN ('N','-','.','?') AND substr(q,i,1) NOT IN ('N','-','.','?'))) = 0"
    return f"""u AS (SELECT clone_id, {seq} AS s, min(sequence_id) AS i FROM {of} GROUP BY ALL), near AS (SELECT i, j FROM (SELECT a.i AS i, b.i AS j, a.s AS p, b.s AS q FROM u a JOIN u b ON a.clone_id = b.clone_id AND length(a.s) = length(b.s)) x WHERE {same}),
 bad AS (SELECT DISTINCT a.i FROM near a JOIN near b ON a.i = b.i LEFT JOIN near c ON c.i = a.j AND c.j = b.j WHERE c.i IS NULL), cls AS (SELECT i, min(j) AS c FROM near WHERE i NOT IN (SELECT i FROM bad) GROUP BY 1),
 rows_ AS (SELECT r.*, c, row_number() OVER (PARTITION BY r.clone_id, c ORDER BY length(translate(r.{seq}, 'N-.?', '')) DESC, r.sequence_id) AS k, count(*) OVER (PARTITION BY r.clone_id, c) AS collapse_count FROM {of} r JOIN u ON u.clone_id = r.clone_id AND u.s = r.{seq} JOIN cls ON cls.i = u.i)"""


query("collapse_duplicates", f", {_collapsed('aligned', 'sequence_alignment')} SELECT clone_id, sequence_id, sequence_alignment, germline_alignment, collapse_count FROM rows_ WHERE k = 1", "aligned")(lambda d: seqs.collapse_duplicates(d, "sequence_id", "sequence_alignment", ["clone_id"]))
_TEXT = "(SELECT clone_id, c, string_agg(DISTINCT w, ',' ORDER BY w) AS label FROM (SELECT clone_id, c, unnest(string_split(label, ',')) AS w FROM rows_) x GROUP BY 1, 2)"
_FIELDS = "CASE WHEN sequence_id % 5 = 0 THEN 'b,a' WHEN sequence_id % 5 = 1 THEN NULL ELSE 'c' END AS label, CAST(1 + sequence_id % 9 AS DOUBLE) AS copies"
query("collapse_duplicates_fields", f", labelled AS (SELECT *, {_FIELDS} FROM aligned), {_collapsed('labelled', 'sequence_alignment')} SELECT r.clone_id, r.sequence_id, r.sequence_alignment, CASE WHEN r.collapse_count = 1 THEN r.label ELSE t.label END AS label, s.copies, r.collapse_count FROM rows_ r LEFT JOIN {_TEXT} t ON t.clone_id = r.clone_id AND t.c = r.c JOIN (SELECT clone_id, c, sum(copies) AS copies FROM rows_ GROUP BY 1, 2) s ON s.clone_id = r.clone_id AND s.c = r.c WHERE k = 1", "aligned")(
    lambda d: seqs.collapse_duplicates(d.selectExpr("*", *_split_fields()), "sequence_id", "sequence_alignment", ["clone_id"], text=["label"], num=["copies"]).drop("germline_alignment")
)


def _split_fields() -> list[str]:
    return [_FIELDS[: _FIELDS.index(", CAST")], _FIELDS[_FIELDS.index("CAST") :]]


_ANNOTATED = fx.ALIGNED.replace("SELECT event_id AS sequence_id, user_id AS clone_id,", "SELECT event_id AS sequence_id, user_id AS clone_id, concat('Homsap IGHV', CAST(1+user_id%7 AS STRING), '-', CAST(1+event_id%40 AS STRING), '*01 F') AS v_call, concat('Homsap IGHJ', CAST(1+user_id%6 AS STRING), '*01 F') AS j_call, CAST(30 + event_id % 3 AS INT) AS junction_length, 'IGH' AS locus,")
QUERIES["make_clones"] = lambda spark, sf_dir: clones.make_clones(fx.view(spark, sf_dir, _ANNOTATED), max_mask=2)
_ENDS = "x AS (SELECT *, least(2, max(length(m) - length(ltrim(m, 'N'))) OVER (PARTITION BY clone_id)) AS l, least(2, max(length(m) - length(rtrim(m, 'N'))) OVER (PARTITION BY clone_id)) AS r FROM (SELECT *, translate(sequence_alignment, '-.', 'NN') AS m FROM a) y), masked AS (SELECT clone_id, sequence_id, repeat('N', l) || substr(m, l+1, length(m)-l-r) || repeat('N', r) AS sequence FROM x)"
ORACLE["make_clones"] = f"WITH a AS ({_ANNOTATED}), {_ENDS}, {_collapsed('masked', 'sequence')}, g AS (SELECT clone_id, translate(arg_min(germline_alignment, sequence_id), '-.', 'NN') AS germline, arg_min({_seg(genes.GENE)}, sequence_id) AS v_gene, arg_min({_seg(genes.GENE, 'j_call')}, sequence_id) AS j_gene, arg_min(junction_length, sequence_id) AS junc_len FROM a GROUP BY 1) SELECT r.clone_id, r.sequence_id, r.sequence, r.collapse_count, germline, v_gene, j_gene, junc_len FROM rows_ r JOIN g USING (clone_id) WHERE k = 1"


def _matrix(codes: dict[str, str], one_gap: str, question: bool) -> str:
    """Every pair of characters and their distance; codes: the readings of each."""
    rows = ", ".join(f"('{c}', '{r}')" for c, r in codes.items()) + ", ('-', NULL), ('.', NULL)" + (", ('?', NULL)" if question else "")
    gap = lambda c: f"{c}.c IN ('-', '.')"
    asked = "WHEN (a.c = '?') <> (b.c = '?') THEN 1 WHEN a.c = '?' THEN 0" if question else ""
    both = "0" if question else one_gap
    return f"WITH v(c, r) AS (VALUES {rows}) SELECT a.c AS c1, b.c AS c2, CAST(CASE WHEN {gap('a')} AND {gap('b')} THEN {both} {asked} WHEN {gap('a')} OR {gap('b')} THEN {one_gap} WHEN len(list_intersect(string_split(a.r, ''), string_split(b.r, ''))) > 0 THEN 0 ELSE 1 END AS DOUBLE) AS dist FROM v a, v b"


QUERIES["dna_matrix"] = lambda spark, sf_dir: seqs.distance_matrix(spark, "dna")
QUERIES["aa_matrix"] = lambda spark, sf_dir: seqs.distance_matrix(spark, "aa")
ORACLE["dna_matrix"], ORACLE["aa_matrix"] = _matrix(IUPAC_DNA, "-1", True), _matrix(IUPAC_AA, "0", False)

# Base qualities and junctions. A read has two bases before its 30 of the alignment, which has a gap of three after the sixth.
_Q = "(sequence_id * 7 + {} * 11) % 41"
_READ = "concat('GG', junction) AS sequence, concat(substr(junction, 1, 6), '...', substr(junction, 7)) AS sequence_alignment, '2S12=' AS v_cigar, '17S5=' AS d_cigar, '24S4=1N4=' AS j_cigar, 3 AS np1_length, 2 AS np2_length, 14 AS v_sequence_end, 22 AS d_sequence_end"
_READS = lambda d: d.selectExpr("sequence_id", *_READ.split(", '2S")[0].replace(") AS sequence, ", ") AS sequence; ").split("; "), *("'2S" + _READ.split(", '2S")[1]).split(", "))
_NUMS = "array_join(transform(sequence(1, 32), i -> cast(" + _Q.format("i") + " AS string)), ',')"
_CHARS = "array_join(transform(sequence(1, 32), i -> char(33 + " + _Q.format("i") + ")), '')"
_ALIGNED_Q = "array_to_string(list_transform(range(1, 34), lambda i: CASE WHEN i BETWEEN 7 AND 9 THEN '{0}' ELSE {1} END), '{2}')"
_ALIGNED_NUM = _ALIGNED_Q.format("NA", f"CAST({_Q.format('(CASE WHEN i < 7 THEN i + 2 ELSE i - 1 END)')} AS VARCHAR)", ",")
_ALIGNED_CHR = _ALIGNED_Q.format(" ", f"chr(CAST(33 + {_Q.format('(CASE WHEN i < 7 THEN i + 2 ELSE i - 1 END)')} AS INT))", "")
query("alignment_quality", f"SELECT sequence_id, {_ALIGNED_NUM} AS quality_alignment_num, {_ALIGNED_CHR} AS quality_alignment FROM repertoire", "repertoire")(
    lambda d: base_quality.alignment_quality(_READS(d).withColumns({"quality_num": F.expr(_NUMS), "quality": F.expr(_CHARS)})).select("sequence_id", "quality_alignment_num", "quality_alignment")
)


@query("read_fastq_db", f"SELECT sequence_id, {_ALIGNED_NUM} AS quality_alignment_num, {_ALIGNED_CHR} AS quality_alignment FROM repertoire", "repertoire")
def _fastq_db(d: DataFrame) -> DataFrame:
    """Reads written as FASTQ, read again and joined."""
    path = f"{folder(d.sparkSession)}/rounds/fastq-{uuid.uuid4().hex}"
    reads = _READS(d)
    reads.selectExpr(f"concat('@', sequence_id, '|CONSCOUNT=2\n', sequence, '\n+\n', {_CHARS}) AS value").write.text(path)
    return fastq.read_fastq_db(reads, path, style="both").select("sequence_id", "quality_alignment_num", "quality_alignment")


@query("changeo_roundtrip", "SELECT CAST(sequence_id AS VARCHAR) AS \"SEQUENCE_ID\", CASE WHEN sequence_id % 5 > 0 THEN v_call END AS \"V_CALL\", junction AS \"JUNCTION\" FROM repertoire", "repertoire")
def _changeo(d: DataFrame) -> DataFrame:
    """A table written in the Change-O form and read again."""
    path = f"{folder(d.sparkSession)}/rounds/changeo-{uuid.uuid4().hex}"
    changeo.write(d.selectExpr("sequence_id AS SEQUENCE_ID", "CASE WHEN sequence_id % 5 > 0 THEN v_call END AS V_CALL", "lower(junction) AS JUNCTION", "sample_id AS SAMPLE"), path)
    return changeo.read(d.sparkSession, path, drop=["SAMPLE"])


_SOME_Q = "array_join(transform(sequence(1, 30), i -> CASE WHEN (sequence_id + i) % 13 = 0 THEN 'NA' ELSE cast(" + _Q.format("i") + " AS string) END), ',')"
_PLACES = f"SELECT sequence_id, i, substr(junction, i, 1) AS nt, CASE WHEN (sequence_id + i) % 13 > 0 THEN {_Q.format('i')} END AS q FROM (SELECT sequence_id, junction, unnest(range(1, 31)) AS i FROM repertoire) x"
query("position_quality", f"SELECT CAST(i AS INT) AS position, CAST(q AS DOUBLE) AS q, sequence_id, nt FROM ({_PLACES}) y", "repertoire")(lambda d: base_quality.position_quality(d.withColumn("q", F.expr(_SOME_Q)), sequence="junction", quality_num="q"))
query("mask_by_quality", f"SELECT sequence_id, string_agg(CASE WHEN q < 20 THEN 'N' ELSE nt END, '' ORDER BY i) AS junction_masked FROM ({_PLACES}) y GROUP BY 1", "repertoire")(
    lambda d: base_quality.mask_positions(d.withColumn("q", F.expr(_SOME_Q)), 20, "junction", "q").select("sequence_id", "junction_masked")
)
_ALLELES = "SELECT DISTINCT allele, rpad('', 320, translate(md5(allele), '0123456789abcdef', 'ACGT.ACGTACGTACG')) AS germline"
_JUNCTION = "concat(repeat(junction, 10), substr(junction, 1, 15), '--', substr(junction, 16), junction, junction) AS sequence_alignment, 'IGHD1-1*01' AS d_call, 1 AS v_germline_start, CAST(315 + sequence_id % 5 AS INT) AS v_germline_end, CAST(1 + sequence_id % 5 AS INT) AS d_germline_start, CAST(10 + sequence_id % 7 AS INT) AS d_germline_end, CAST(1 + sequence_id % 4 AS INT) AS j_germline_start, 50 AS j_germline_end, CAST(CASE WHEN sequence_id % 11 = 0 THEN 6 ELSE 30 + 3 * (sequence_id % 3) END AS INT) AS junction_length"


@query("junction_alignment", None, "repertoire")
def _junctions(d: DataFrame) -> DataFrame:
    """Germlines are made up from the alleles' names."""
    d = d.selectExpr("sequence_id", "v_call", "j_call", "junction", *_JUNCTION.replace(" AS sequence_alignment, ", " AS sequence_alignment; ").replace(", CAST", "; CAST").replace(", 1 AS", "; 1 AS").replace(", 50 AS", "; 50 AS").replace(", 'IGHD", "; 'IGHD").split("; "))
    names = None
    for c in ("v_call", "j_call", "d_call"):
        x = d.select(genes.get_allele(F.col(c)).alias("allele"))
        names = x if names is None else names.union(x)
    text = F.translate(F.md5("allele"), "0123456789abcdef", "ACGT.ACGTACGTACG")
    germlines = names.distinct().withColumn("germline", F.rpad(F.repeat(text, F.lit(10)), 320, "A"))
    return junctions.junction_alignment(d, germlines).select("sequence_id", "e3v_length", "e5d_length", "e3d_length", "e5j_length", "v_cdr3_length", "j_cdr3_length")


_GERM = lambda a: f"substr(repeat(translate(md5({a}), '0123456789abcdef', 'ACGT.ACGTACGTACG'), 10), 1, 320)"
_BARE = lambda x, gaps: f"length(translate({x}, '{gaps}', ''))"
_END = "coalesce(list_filter(range(310, length(sequence_alignment)+1), lambda i: length(translate(substr(sequence_alignment, 310, i-309), '.-', '')) > junction_length)[1] - 1, length(sequence_alignment))"
_J_START = "length(sequence_alignment) - (j_germline_end - j_germline_start + 1) + 1"
ORACLE["junction_alignment"] = f"""WITH repertoire AS ({fx.REPERTOIRE}), d AS (SELECT sequence_id, {_seg(genes.ALLELE)} AS va, {_seg(genes.ALLELE, 'j_call')} AS ja, {_JUNCTION} FROM repertoire), e AS (SELECT *, {_END} AS stop FROM d)
 SELECT sequence_id, {_BARE(f"substr({_GERM('va')}, v_germline_end + 1)", '.')} AS e3v_length, {_BARE(f"substr({_GERM('d_call')}, 1, d_germline_start - 1)", '.')} AS e5d_length, {_BARE(f"substr({_GERM('d_call')}, d_germline_end + 1)", '.')} AS e3d_length, {_BARE(f"substr({_GERM('ja')}, 1, j_germline_start - 1)", '.')} AS e5j_length,
 CASE WHEN junction_length > 6 THEN {_BARE("substr(sequence_alignment, 313, v_germline_end - v_germline_start + 1 - 312)", '.-')} END AS v_cdr3_length, CASE WHEN junction_length > 6 THEN {_BARE(f"substr(sequence_alignment, {_J_START}, greatest(stop - 3 - ({_J_START}) + 1, 0))", '-')} END AS j_cdr3_length FROM e"""
query("explode_cigar", "SELECT sequence_id, unnest(regexp_extract_all(c, '(\\d+)([MIDNSHP=X])', 2)) AS op, CAST(unnest(regexp_extract_all(c, '(\\d+)([MIDNSHP=X])', 1)) AS INT) AS n FROM (SELECT sequence_id, concat(CAST(sequence_id % 50 + 1 AS STRING), '=', CAST(sequence_id % 7 + 1 AS STRING), 'N12S') AS c FROM repertoire) x", "repertoire")(
    lambda d: d.select("sequence_id", F.inline(quality.explode_cigar(F.expr("concat(sequence_id % 50 + 1, '=', sequence_id % 7 + 1, 'N12S')"))))
)
query("translate_strings", "SELECT sequence_id, CASE WHEN sample_id IN ('click', 'view') THEN 'seen' ELSE sample_id END AS label FROM repertoire", "repertoire")(lambda d: d.select("sequence_id", quality.translate_strings(F.col("sample_id"), {"seen": ["click", "view"]}).alias("label")))

# Trees.
_DOWN = "RECURSIVE trees AS ({t}), r AS (SELECT tree_id, 'Germline' AS name, 0 AS steps, CAST(0 AS DOUBLE) AS distance FROM trees GROUP BY 1 UNION ALL SELECT r.tree_id, to_v, steps+1, distance+weight FROM r JOIN trees e ON e.tree_id = r.tree_id AND e.from_v = r.name)".format(t=fx.TREES)
_LABELS = lambda d: d.select("tree_id", F.col("to_v").alias("v"), F.col("sample_id").alias("value"))
query("path_lengths", None, "trees")(lambda d: topology.path_lengths(d))
ORACLE["path_lengths"] = f"WITH {_DOWN} SELECT * FROM r"
query("mrca", None, "trees")(lambda d: topology.mrca(d))
ORACLE["mrca"] = f"WITH {_DOWN} SELECT tree_id, name, steps, distance FROM (SELECT *, rank() OVER (PARTITION BY tree_id ORDER BY distance) AS k FROM r WHERE name <> 'Germline') x WHERE k = 1"
_ALL = f"RECURSIVE trees AS ({fx.TREES}), v AS (SELECT tree_id, from_v AS v FROM trees UNION SELECT tree_id, to_v FROM trees), c AS (SELECT tree_id, v AS anc, v AS dsc, 0 AS steps, CAST(0 AS DOUBLE) AS distance FROM v UNION ALL SELECT c.tree_id, anc, to_v, steps+1, distance+weight FROM c JOIN trees e ON e.tree_id = c.tree_id AND e.from_v = c.dsc)"
query("subtrees", None, "trees")(lambda d: _rounded(topology.subtrees(d)))
ORACLE["subtrees"] = f"WITH {_ALL}, s AS (SELECT tree_id, anc AS name, count(*) AS size, max(steps)+1 AS depth, max(distance) AS pathlength FROM c GROUP BY ALL), o AS (SELECT tree_id, from_v AS name, count(*) AS o FROM trees GROUP BY ALL) SELECT tree_id, name, size, depth, pathlength, coalesce(o, 0) AS outdegree, t.from_v AS parent, round(coalesce(o,0) / sum(coalesce(o,0)) OVER w, 6) AS outdegree_norm, round(size / max(size) OVER w, 6) AS size_norm, round(depth / max(depth) OVER w, 6) AS depth_norm, round(pathlength / nullif(max(pathlength) OVER w, 0), 6) AS pathlength_norm FROM s LEFT JOIN o USING (tree_id, name) LEFT JOIN (SELECT tree_id, to_v AS name, from_v FROM trees) t USING (tree_id, name) WINDOW w AS (PARTITION BY tree_id)"
query("table_edges", "SELECT u.sample_id AS parent, e.sample_id AS child, count(*) AS count FROM trees e LEFT JOIN trees u ON u.tree_id = e.tree_id AND u.to_v = e.from_v GROUP BY 1, 2", "trees")(lambda d: topology.table_edges(d, _LABELS(d)))
query("table_edges_indirect", None, "trees")(lambda d: topology.table_edges(d, _LABELS(d), indirect=True, exclude=("click",)))
_SKIP = "e.sample_id = 'click'"
ORACLE["table_edges_indirect"] = f"WITH RECURSIVE trees AS ({fx.TREES}), v AS (SELECT tree_id, from_v AS v FROM trees UNION SELECT tree_id, to_v FROM trees), l AS (SELECT v.tree_id, v, sample_id FROM v LEFT JOIN trees t ON t.tree_id = v.tree_id AND t.to_v = v.v), c AS (SELECT tree_id, v AS dsc, sample_id AS parent, 0 AS n, CAST(NULL AS VARCHAR) AS child FROM l WHERE coalesce(sample_id, '') <> 'click' UNION ALL SELECT c.tree_id, to_v, parent, n + CASE WHEN {_SKIP} THEN 0 ELSE 1 END, CASE WHEN {_SKIP} THEN child ELSE e.sample_id END FROM c JOIN trees e ON e.tree_id = c.tree_id AND e.from_v = c.dsc WHERE n + CASE WHEN {_SKIP} THEN 0 ELSE 1 END <= 1) SELECT parent, child, count(*) AS count FROM c WHERE n = 1 GROUP BY 1, 2"
query("path_lengths_excluded", None, "trees")(lambda d: topology.path_lengths(d, labels=_LABELS(d), exclude=["click", "view"]))
_SOME = _DOWN.replace("0 AS steps,", "0 AS steps, CAST(NULL AS VARCHAR) AS value,").replace("steps+1,", "steps + CASE WHEN sample_id IN ('click', 'view') THEN 0 ELSE 1 END, sample_id,")
ORACLE["path_lengths_excluded"] = f"WITH {_SOME} SELECT tree_id, name, steps, distance FROM r"
query("mrca_excluded", None, "trees")(lambda d: topology.mrca(d, labels=_LABELS(d), exclude=["click", "view"]))
ORACLE["mrca_excluded"] = f"WITH {_SOME} SELECT tree_id, name, steps, distance, value FROM (SELECT *, rank() OVER (PARTITION BY tree_id ORDER BY distance) AS k FROM r WHERE name <> 'Germline' AND value NOT IN ('click', 'view')) x WHERE k = 1"
query("permute_labels", None, "trees")(lambda d: topology.permute_labels(_LABELS(d), 5, seed=1))
query("test_edges", None, "trees")(lambda d: topology.test_edges(d, _LABELS(d), nperm=50, seed=1))
query("test_mrca", None, "trees")(lambda d: topology.test_mrca(d, _LABELS(d), nperm=50, seed=1))
query("test_edges_indirect", None, "trees")(lambda d: topology.test_edges(d, _LABELS(d), nperm=20, seed=1, indirect=True, exclude=("click", None)))
query("build_lineage", None, "aligned")(lambda d: lineage.build_lineage(d))
query("build_trees_distance", None, "aligned")(lambda d: lineage.build_trees(d, branch_length="distance"))
query("phylo_roundtrip", "SELECT tree_id, from_v, to_v, weight FROM trees", "trees")(lambda d: phylo.from_phylo(*phylo.to_phylo(d)))
query("newick", "SELECT CAST(tree_id AS VARCHAR) AS tree_id, 'Germline' AS from_v, to_v, weight FROM trees", "trees")(lambda d: newick.edges(d.groupBy("tree_id").agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "to_v", F.col("weight").cast("string")))), ","), F.lit(")Germline;")).alias("newick"))))

# What the plots show.
query("usage_topk", f"SELECT gene, CAST(count(*) AS BIGINT) AS value FROM (SELECT {_seg(genes.GENE)} AS gene FROM repertoire) x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "repertoire")(
    lambda d: usage.count_genes(d, "v_call", ["sample_id"]).groupBy("gene").agg(F.sum("seq_count").alias("value")).orderBy(F.desc("value"), "gene").limit(20)
)
query("ecdf", "SELECT DISTINCT weight, round(cume_dist() OVER (ORDER BY weight), 6) AS ecdf FROM trees", "trees")(lambda d: _rounded(plotting.ecdf(d, "weight")))
query("box_stats", "SELECT sample_id, count(weight) AS n, min(weight) AS least, round(quantile_cont(weight, 0.25), 6) AS q1, round(quantile_cont(weight, 0.5), 6) AS q2, round(quantile_cont(weight, 0.75), 6) AS q3, max(weight) AS most FROM trees GROUP BY 1", "trees")(lambda d: _rounded(plotting.box_stats(d, "sample_id", "weight")))
query("histogram", "SELECT bin, round(lo + bin * w, 6) AS low, round(lo + (bin + 1) * w, 6) AS high, coalesce(n, 0) AS count FROM (SELECT min(x) AS lo, (max(x) - min(x)) / 50 AS w, unnest(range(0, 50)) AS bin FROM d) b LEFT JOIN (SELECT least(CAST(floor((x - lo) / w) AS BIGINT), 49) AS bin, count(*) AS n FROM d, (SELECT min(x) AS lo, (max(x) - min(x)) / 50 AS w FROM d) m GROUP BY 1) c USING (bin)".replace("FROM d", "FROM (SELECT CAST(1 + sequence_id % 977 AS DOUBLE) AS x FROM repertoire)"), "repertoire")(
    lambda d: _rounded(plotting.histogram(d.selectExpr("cast(1 + sequence_id % 977 AS double) AS x"), "x"))
)
query("subtree_boxes", None, "trees")(lambda d: _rounded(plotting.subtree_boxes(d, _LABELS(d), "size")))
ORACLE["subtree_boxes"] = f"WITH {_ALL}, s AS (SELECT tree_id, anc AS name, count(*) AS size FROM c GROUP BY ALL), y AS (SELECT sample_id AS value, size / max(size) OVER (PARTITION BY tree_id) AS y FROM s LEFT JOIN (SELECT tree_id, to_v AS name, sample_id FROM trees) t USING (tree_id, name)) SELECT value, count(*) AS n, round(min(y), 6) AS least, round(quantile_cont(y, 0.25), 6) AS q1, round(quantile_cont(y, 0.5), 6) AS q2, round(quantile_cont(y, 0.75), 6) AS q3, round(max(y), 6) AS most FROM y WHERE value IS NOT NULL GROUP BY 1"
query("edge_test_histogram", None, "trees")(lambda d: plotting.histogram(topology.edge_permutations(d, _LABELS(d), 20, 1), "count"))
query("edge_test_ecdf", None, "trees")(lambda d: plotting.ecdf(topology.edge_permutations(d, _LABELS(d), 20, 1), "count"))
query("mrca_test_histogram", None, "trees")(lambda d: plotting.histogram(topology.mrca_permutations(d, _LABELS(d), nperm=20, seed=1), "count"))
query("tree_layout", None, "trees")(lambda d: plotting.tree_layout(d))
query("abundance_series", None, "repertoire")(lambda d: plotting.abundance_series(diversity.estimate_abundance(d, "sample_id", nboot=20, seed=1), "sample_id"))
query("diversity_series", None, "repertoire")(lambda d: plotting.diversity_series(diversity.alpha_diversity(d, "sample_id", [0, 1, 2], nboot=20, seed=1), "sample_id"))
query("diversity_at", None, "repertoire")(lambda d: plotting.diversity_at(diversity.alpha_diversity(d, "sample_id", [0, 1, 2], nboot=20, seed=1), "sample_id", 2))
query("stouffer", None, "repertoire")(lambda d: statistics.stouffer(d.selectExpr("sample_id", "(1 + sequence_id % 97) / 98D AS p", "duplicate_count AS w"), ["sample_id"], "p", "w"))


# IgPhyML tables, inline.
_IGPHYML = [
    ("REPERTOIRE", "0", "0", "-{0}0.5", "0.{0}", "igphyml --run"), ("1", "3", "100", "-50.2", "0.4", "(seq1:0.1,seq2:0.2,1_GERM:0.0);"),
    ("2", "4", "100", "-60.1", "0.{0}5", "((seqA:0.3,seqB:0.1):0.05,2_GERM:0.0);"),
]


def _igphyml(spark, i: int) -> igphyml.IgPhyML:
    rows = [tuple(x.format(i) for x in r) for r in _IGPHYML]
    return igphyml.from_table(spark.createDataFrame(rows, "CLONE string, NSEQ string, NSITE string, LHOOD string, OMEGA_CDR_MLE string, TREE string"), id=f"donor{i}")


QUERIES["igphyml_long"] = lambda spark, sf_dir: igphyml.combine([_igphyml(spark, 1), _igphyml(spark, 2)], "long")
ORACLE["igphyml_long"] = "SELECT id, variable, CAST(value AS DOUBLE) AS value, CAST(position AS INT) AS position FROM (VALUES " + ", ".join(f"('donor{i}', '{v}', {x}, {p})" for i in (1, 2) for p, (v, x) in enumerate((("nseq", 0), ("nsite", 0), ("lhood", -10.0 * i - 0.5), ("omega_cdr_mle", i / 10)), 1)) + ") t(id, variable, value, position)"
QUERIES["igphyml_trees"] = lambda spark, sf_dir: _igphyml(spark, 1).trees
ORACLE["igphyml_trees"] = "SELECT clone, from_v, to_v, CAST(weight AS DOUBLE) AS weight FROM (VALUES ('1', 'node1', 'seq1', 10.0), ('1', 'node1', 'seq2', 20.0), ('1', 'node1', '1_GERM', 0.0), ('2', 'node1', 'seqA', 30.0), ('2', 'node1', 'seqB', 10.0), ('2', 'node2', 'node1', 5.0), ('2', 'node2', '2_GERM', 0.0)) t(clone, from_v, to_v, weight)"
