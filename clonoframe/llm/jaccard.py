"""Near-duplicate classes by a grouped prefix join on shingle sets.

A document's set holds its distinct shingles of five words (the whole sequence, if shorter).
Two documents link if their Jaccard similarity reaches the threshold; the result is each
document's component. The steps:

1. One pass over the texts counts all shingles; they are ordered by rarity, ties by hash. Two
   sets that reach the threshold share a token in their prefixes (PPJoin).
2. Documents with the same prefix and set size form one group. Only groups enter the join.
   Tokens that no other document has are left out of the prefixes that are written.
3. In a token's list, every group is paired with a few centres of the list, and inside a
   group every class of equal sets with the first class: a number of pairs linear in the
   lists. They are verified on whole sets, and their components taken, round by round.
4. What is left are pairs of groups in different components. Lists within one component,
   such as those of thousands of copies, fall away; the others are joined under the length
   and positional bounds (tokens that no other document has can't be common, so they count as passed), expanded to their classes, and verified. No pair that may link
   two components is left out, so the components are exact.

Shingles are compared by 58-bit hashes within a pair of sets, and classes of equal sets by
128-bit ones. Defined cases: null text, or text without words, has an empty set and links
with nothing; rows with a null key link with nothing and get a null component; repeated rows
are equal sets; rows of one key and different texts (with words) are linked, so that a key has one component;
ties of rarity go by hash; an empty table gives no rows; extra columns are ignored. Memory in a worker is bounded by one batch, or by
the longest text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BITS, Scratch, bitmap, chunks, held, release, small_batches, trim
from .components import components
from .tokens import Words, mix, windows

WIDTH = 5
#: Threshold as a fraction of whole numbers.
NUM, DEN = 4, 5
#: Centres of a list in each round of stars; rows of the lists that get a second round and more; the pairs for
#: each new link above which the exact join follows at once.
CENTRES, LONG, FEW = (1, 16, 64), 12, 200
_RANK_BITS = 6


def shingle_sets(col: pa.Array):
    """For each text, the hashes (with repeats) of its shingles; an iterator of arrays."""
    w = Words(col, lower=True)
    h = w.hashes()
    runs = windows(h, WIDTH)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            yield runs[a : b - WIDTH + 1]
        elif b > a:
            yield windows(h[a:b], b - a)
        else:
            yield runs[:0]


class Frequencies:
    """How often shingles occur over all documents, in arrays of fixed size.

    cells: for each of 2**24 ranges of the hash, the largest log2 count among its shingles (0
    below 4); shared: a packed bitmap of 2**27 ranges in which a shingle occurs twice or more.
    Both err only towards "frequent", which costs time, never a link.
    """

    CELL_BITS, SHARED_BITS, LOW = 24, 27, 30

    def __init__(self, cells: np.ndarray, shared: np.ndarray):
        self.cells, self.shared = cells, shared

    def rank(self, s: np.ndarray) -> np.ndarray:
        return self.cells[(s >> np.uint64(64 - self.CELL_BITS)).astype(np.int64)]

    def is_shared(self, s: np.ndarray) -> np.ndarray:
        return held(self.shared, (s >> np.uint64(64 - self.SHARED_BITS)).astype(np.int64))

def _packed(x: np.ndarray) -> bytes:
    """Sorted 30-bit numbers as compressed differences, a byte plane at a time (about 3 bytes each)."""
    d = np.diff(x.astype(np.uint32), prepend=np.uint32(0))
    planes = d.view(np.uint8).reshape(-1, 4).T.copy()
    return len(x).to_bytes(4, "little") + pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def _unpacked(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(b[4:], 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(planes.T.copy().view(np.uint32).reshape(-1), dtype=np.uint32)


def frequencies(docs: DataFrame, text: str) -> Frequencies:
    """Counts every shingle of every document, by its leading bits.

    A task sorts the hashes of half a million shingles and sends each range of them as one
    compressed blob, so the shuffle takes about 3 bytes a shingle; the number of ranges
    follows the input's size, so that what meets in a task stays small.
    """
    spark, low, cells, shared = docs.sparkSession, Frequencies.LOW, Frequencies.CELL_BITS, Frequencies.SHARED_BITS
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    top = min(20, max(10, math.ceil(math.log2(size / (4 << 20) + 1))))

    def local(batches):
        kept, n = [], 0

        def flush():
            x = np.sort(np.concatenate(kept) >> np.uint64(64 - top - low))
            block = (x >> np.uint64(low)).astype(np.int64)
            ends = np.flatnonzero(np.diff(block, append=-1)) + 1
            starts = np.concatenate([[0], ends[:-1]])
            tail = (x & np.uint64((1 << low) - 1)).astype(np.uint32)
            return pa.RecordBatch.from_pydict({"block": pa.array(block[starts], pa.int32()), "v": pa.array([_packed(tail[i:j]) for i, j in zip(starts, ends, strict=True)], pa.binary())})

        for batch in batches:
            for part in chunks(batch, "t"):
                made = [np.unique(s) for s in shingle_sets(part.column(0))]
                kept.append(np.concatenate(made))
                n += len(kept[-1])
                del made
                if n > 500_000:
                    yield flush()
                    kept, n = [], 0
        if n:
            yield flush()
        kept = []
        trim()

    def merge(key, t):
        x = np.sort(np.concatenate([_unpacked(b) for b in t.column("v").to_pylist()]))
        first = np.flatnonzero(np.diff(x, prepend=np.uint32(1 << 31)))
        count = np.diff(first, append=len(x))
        x, count = x[first], count
        some = count > 1
        bits = np.zeros(1 << (shared - top), bool)
        bits[(x[some] >> np.uint32(low - shared + top)).astype(np.int64)] = True
        rank = np.zeros(1 << (cells - top), np.uint8)
        some = count > 3
        np.maximum.at(rank, (x[some] >> np.uint32(low - cells + top)).astype(np.int64), np.log2(count[some]).astype(np.uint8))
        zip_ = lambda a: pa.Codec("zstd").compress(a.tobytes(), asbytes=True)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "shared": pa.array([zip_(np.packbits(bits))], pa.binary()), "rank": pa.array([zip_(rank)], pa.binary())})

    rows = docs.select(F.col(text).alias("t")).mapInArrow(local, "block int, v binary").groupBy("block").applyInArrow(merge, "block int, shared binary, rank binary")
    out_cells, out_shared = np.zeros((1 << top, 1 << (cells - top)), np.uint8), np.zeros((1 << top, (1 << (shared - top)) // 8), np.uint8)
    with small_batches(spark):
        for r in rows.toLocalIterator():
            out_cells[r["block"]] = np.frombuffer(pa.Codec("zstd").decompress(bytes(r["rank"]), out_cells.shape[1], asbytes=True), np.uint8)
            out_shared[r["block"]] = np.frombuffer(pa.Codec("zstd").decompress(bytes(r["shared"]), out_shared.shape[1], asbytes=True), np.uint8)
    return Frequencies(out_cells.reshape(-1), out_shared.reshape(-1))


def ordered_set(s: np.ndarray, freq: Frequencies) -> np.ndarray:
    """Distinct shingles as sorted tokens: the rarity rank in the high bits, then the hash."""
    s = np.unique(s)
    return np.sort(freq.rank(s).astype(np.uint64) << np.uint64(64 - _RANK_BITS) | (s >> np.uint64(_RANK_BITS)))


def _hash_of(token: np.ndarray) -> np.ndarray:
    """The leading bits of a token's shingle hash."""
    return token << np.uint64(_RANK_BITS)


def prefix_length(n: int) -> int:
    return n - -(-n * NUM // DEN) + 1


def _may_reach(n: Column, m: Column, common: Column) -> Column:
    """Whether sets of n and m tokens whose prefixes have `common` tokens in common can reach the threshold.

    The prefix that ends first in the order meets the other set within the other's prefix, so
    the overlap is at most the common tokens and what that set has besides its prefix.
    """
    beside = lambda k: F.ceil(k * NUM / DEN) - 1
    return (common + F.greatest(beside(n), beside(m))) * (NUM + DEN) >= (n + m) * NUM


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _describe(docs: DataFrame, key: str, text: str, shared) -> DataFrame:
    """Per row: doc, n, two hashes of the set, the group (prefix and size), and those tokens of the
    prefix that another document may have, each with the number of such tokens from it to the
    set's end: what a first common token there leaves possible as overlap."""

    def run(batches):
        freq = shared.value
        for batch in batches:
            for part in chunks(batch, "t"):
                n, f1, f2, g, token, place = [], [], [], [], [], []
                for s in shingle_sets(part.column(1)):
                    a = ordered_set(s, freq)
                    p = a[: prefix_length(len(a))] if len(a) else a
                    m = mix(a)
                    n.append(len(a))
                    f1.append(m.sum(dtype=np.uint64))
                    f2.append(mix(a ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                    g.append(mix(mix(p).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(a)))[0])
                    met = freq.is_shared(_hash_of(a))
                    at = np.flatnonzero(met[: len(p)])
                    token.append(p[at].tobytes())
                    place.append((met.sum() - np.arange(len(at))).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), *[pa.array(_signed(x), pa.int64()) for x in (f1, f2, g)], pa.array(token, pa.binary()), pa.array(place, pa.binary())],
                    names=["doc", "n", "f1", "f2", "grp", "prefix", "places"],
                )
        trim()

    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("t")).mapInArrow(run, "doc long, n long, f1 long, f2 long, grp long, prefix binary, places binary")


def _postings(rows: DataFrame) -> DataFrame:
    """A row for each token of a prefix: token, grp, n, rest."""

    def run(batches):
        for batch in batches:
            held_ = batch.column(2).to_pylist()
            size = np.array([len(x) // 8 for x in held_], np.int64)
            token = np.frombuffer(b"".join(held_), np.int64)
            pos = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int32)
            grp, n = (np.repeat(batch.column(i).to_numpy(), size) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(grp), pa.array(n, pa.int32()), pa.array(pos)], names=["token", "grp", "n", "rest"])

    return rows.select("grp", "n", "prefix", "places").mapInArrow(run, "token long, grp long, n int, rest int")


def _sets(docs: DataFrame, keys: DataFrame, key: str, text: str, shared) -> DataFrame:
    """k, s: the whole sets of the documents in keys (a fixed-size bitmap tells the others early; the few it lets through do no harm)."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(keys))

    def run(batches):
        freq = shared.value
        for batch in batches:
            batch = batch.filter(pa.array(held(bits.value, batch.column(2).to_numpy())))
            for part in chunks(batch, "t"):
                made = [ordered_set(s, freq).tobytes() for s in shingle_sets(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["k", "s"])
        trim()

    cell = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(BITS)).cast("long")
    texts = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), cell.alias("c"))
    return texts.mapInArrow(run, "k long, s binary")


def _verified(pairs: DataFrame, pool: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """pairs (a, b: keys of class members) -> those whose whole sets (in pool) reach the threshold.

    b should be the end with fewer different documents. A document in many pairs is a skewed
    key of a plain join, which the adaptive plan splits.
    """

    def check(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                if min(len(p), len(q)) * DEN < max(len(p), len(q)) * NUM:
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok[i] = both * DEN >= (len(p) + len(q) - both) * NUM
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["u", "v"])
        trim()

    left = pairs.join(pool.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(pool.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")
    # Few rows a batch: the sets of very long documents are large.
    return scratch.write(both.mapInArrow(check, "u long, v long"), f"{name}-links", rows=64)


def _open(rows: DataFrame, sides: DataFrame, least: int) -> DataFrame:
    """Rows of the lists (tokens) of at least so many rows in which two components meet, with comp and lead."""
    mixed = rows.join(sides, "grp")
    lists = mixed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).filter(f"lo <> hi and c >= {least}").select("token")
    return mixed.join(lists, "token", "left_semi")


def _stars(mixed: DataFrame, salt: int, centres: int, count: bool) -> DataFrame:
    """Candidate pairs (a, b), linear in the lists: each side of a list and a few centres that are drawn for the list
    by hash, in another component. count: only the centre with most lists in common, if those are enough."""
    pick = [F.min(F.struct(F.xxhash64(F.lit(salt), F.lit(k), F.col("grp")).alias("h"), "lead", "n", "comp")) for k in range(centres)]
    drawn = mixed.groupBy("token").agg(F.array_distinct(F.transform(F.array(*pick), lambda d: d.dropFields("h"))).alias("drawn"))
    other = F.filter("drawn", lambda d: (d["comp"] != F.col("comp")) & (F.least("n", d["n"]) * DEN >= F.greatest("n", d["n"]) * NUM))
    each = mixed.join(drawn, "token").select("lead", "n", "rest", F.explode(other).alias("d"))
    each = each.filter(F.col("rest") * (NUM + DEN) >= (F.col("n") + F.col("d.n")) * NUM) if not count else each
    if not count:
        return each.select(F.col("lead").alias("a"), F.col("d.lead").alias("b")).distinct()
    each = each.groupBy("lead", "n", F.col("d.lead").alias("centre"), F.col("d.n").alias("m")).agg(F.count(F.lit(1)).alias("c"), F.max("rest").alias("rest"))
    # Some common tokens may have other centres, so half as many again are allowed for.
    each = each.filter((F.col("rest") * (NUM + DEN) >= (F.col("n") + F.col("m")) * NUM) & _may_reach(F.col("n"), F.col("m"), F.col("c") + F.shiftright("c", 1)))
    return each.groupBy("lead").agg(F.max_by("centre", F.struct("c", "centre")).alias("b")).select(F.col("lead").alias("a"), "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles, component_id (the least key that it reaches by links, itself included)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    shared = spark.sparkContext.broadcast(frequencies(docs, text))
    release(spark)
    rows = scratch.write(_describe(docs, key, text, shared), "rows", "lz4")
    full = rows.filter("n > 0 and doc is not null")
    classes = scratch.write(full.groupBy("f1", "f2", "n").agg(F.min("doc").alias("rep"), F.first("grp").alias("grp")), "classes")
    groups = classes.groupBy("grp").agg(F.min("rep").alias("lead"), F.min("n").alias("n"))

    # Tokens of two groups or more.
    post = scratch.write(_postings(full).distinct(), "postings-all")
    lists = post.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).filter("lo <> hi").select("token")
    post = post.join(lists, "token", "left_semi")
    post = scratch.write(post, "postings")
    scratch.drop("postings-all")
    del lists
    release(spark)

    # Rows of one key: the classes of its texts are linked, whatever their similarity.
    several = full.groupBy("doc").agg(F.min(F.struct("f1", "f2", "n")).alias("lo"), F.max(F.struct("f1", "f2", "n")).alias("hi")).filter("lo <> hi").select("doc")
    texts = full.select("doc", "f1", "f2", "n").join(several, "doc", "left_semi").join(classes.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"])
    ends = texts.groupBy("doc").agg(F.min("rep").alias("v"))
    links = scratch.write(texts.join(ends, "doc").select(F.col("rep").alias("u"), "v").filter("u <> v").distinct(), "same-key")
    del several, texts, ends

    # Stars: each group with centres of its lists, each class with its group's first, until no more components meet.
    lead = groups.select("grp", "lead")
    sides = lead.withColumn("comp", F.col("lead"))
    near = post.filter(F.col("rest") * DEN >= F.col("n") * NUM)
    several = classes.groupBy("grp").count().filter("count > 1").select("grp")
    taken = classes.join(near.select("grp").union(several).distinct(), "grp", "left_semi").select("rep")
    pool = scratch.write(_sets(docs, taken, key, text, shared), "pool", "uncompressed")
    for i, centres in enumerate(CENTRES):
        # From the second round on, only long lists, and tokens that may be the first that two sets have in common.
        mixed = scratch.write(_open(near if i else post, sides, LONG if i else 2), f"mixed-{i}")
        if i and mixed.isEmpty():
            break
        pairs = _stars(mixed, i, centres, count=i == 0)
        if i == 0:
            inner = classes.join(lead, "grp").filter("rep <> lead")
            pairs = pairs.union(inner.select(F.col("rep").alias("a"), F.col("lead").alias("b"))).distinct()
        pairs = scratch.write(pairs, f"pairs-{i}")
        release(spark)
        new = _verified(pairs, pool, scratch, f"star-{i}")
        links = links.union(new)
        release(spark)
        comp = components(links, scratch, f"cc{i}")
        member = classes.join(comp, F.col("rep") == F.col("node"), "left").select("grp", "rep", "n", F.coalesce("comp", "rep").alias("comp"))
        member = scratch.write(member, f"members-{i}")
        sides = member.groupBy("grp", "comp").agg(F.min("rep").alias("lead"))
        found, tried = new.count(), pairs.count()
        scratch.drop(f"mixed-{i}", f"pairs-{i}")
        release(spark)
        if i and found * FEW < tried:
            break

    # The exact rest: groups of one list, in different components.
    mixed = scratch.write(_open(near, sides, 2), "mixed")
    x = mixed.select("token", *[F.col(c).alias(f"{c}_x") for c in ("grp", "n", "rest", "comp")])
    y = mixed.select("token", *[F.col(c).alias(f"{c}_y") for c in ("grp", "n", "rest", "comp")])
    # The places of a first common token bound the overlap.
    asked = (F.col("n_x") + F.col("n_y")) * NUM
    possible = F.least("rest_x", "rest_y") * (NUM + DEN)
    apart = x.join(y, "token").filter((F.col("comp_x") < F.col("comp_y")) & (possible >= asked) & (F.least("n_x", "n_y") * DEN >= F.greatest("n_x", "n_y") * NUM))
    apart = scratch.write(apart.select("grp_x", "comp_x", "grp_y", "comp_y").distinct(), "apart")
    one = lambda s: member.select(F.col("grp").alias(f"grp_{s}"), F.col("comp").alias(f"comp_{s}"), F.col("rep").alias(f"rep_{s}"))
    rest = apart.join(one("x"), ["grp_x", "comp_x"]).join(one("y"), ["grp_y", "comp_y"]).select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b"))
    # Classes of one group that the first class did not link.
    split = sides.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("grp")
    inside = member.join(split, "grp", "left_semi")
    inside = inside.select("grp", F.col("rep").alias("a"), F.col("comp").alias("ca")).join(inside.select("grp", F.col("rep").alias("b"), F.col("comp").alias("cb")), "grp").filter("ca < cb").select("a", "b")
    rest = scratch.write(rest.union(inside).distinct(), "pairs-rest")
    del x, y, inside, split
    scratch.drop("mixed", "postings", "apart")
    release(spark)
    more = _verified(rest, pool, scratch, "rest")
    scratch.drop("pool", "pairs-rest")
    release(spark)
    comp = components(links.union(more), scratch, "cc")

    final = classes.join(comp, F.col("rep") == F.col("node"), "left").select(F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), F.col("n").alias("_n"), F.coalesce("comp", "rep").alias("component_id"))
    final = scratch.write(final, "final")
    out = rows.drop("prefix", "grp").join(final, (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2")) & (F.col("n") == F.col("_n")), "left")
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).alias("component_id"))
