"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is over characters (Unicode code points, as they are), of order 5: one for each
language, and one of all trusted text for documents whose language has none. Its tables grow
with the trusted text and are never gathered: counts, discounts and interpolation are joins and
aggregates on (language, gram), and scoring is a join on the gram's key, sharded by it.

Scoring reads the documents once. They travel as compressed blocks of about BLOCK bytes of
text, dealt evenly. A block asks for each gram that it holds once, however often it occurs, so
that frequent grams cost no more than rare ones; the answers come back to the block, which sums
them over each text's positions.

A document's figure is its perplexity for a character. Every FOLD-th trusted document, by a
hash of its key, is held out of the training. A document is rejected if it is above two limits
of its language, both of which are the same high quantile (QUANTILE) over the documents held
out: that of the perplexity, and that of the distance from the middle times the root of the
length, as the figures of short texts vary more.

Defined cases: null or empty text has no perplexity and is rejected; a null language, or one
without trusted text, uses the model and the limits of all trusted text; a language with fewer
than FEW documents held out takes the wider of its own and the common limits; without any document held
out all documents with text stay; the label of a key that is given twice is the worse one;
repeated rows count one by one; an empty table gives no rows; extra columns are ignored, or kept
as they are by keep_good, whatever their names. A quantile is that of the least bin that
reaches it, so ties fall on the accepted side.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import BITS, Scratch, bitmap, chunks, held, release, trim
from .tokens import mix, raw

ORDER = 5
#: Stands before a text's first character.
START = 2
#: All characters that there may be: the base of the interpolation is one of so many.
UNIVERSE = 0x110000
#: Bytes of text of a block, and of a piece of it that is hashed at once.
BLOCK, PIECE = 16 << 20, 1 << 20
#: Every so many-th trusted document is held out; the quantile of the limits; documents held out that make a language's limits its own.
FOLD, QUANTILE, FEW = 5, 0.99, 50
#: Bins of a bit in the histograms that the quantiles are taken from: of perplexities, and of distances times the root of the length.
BINS, WIDE_BINS = 1000, 20
POOLED = "\x00"
KEY_BITS = 48
_STEP = [np.uint64(int(x) | 1) for x in np.random.default_rng(5).integers(1 << 61, 1 << 63, ORDER, dtype=np.uint64)]


def salt(name: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little"))


def symbols(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after ORDER - 1 starts, and the number of characters of each text."""
    data, off = raw(col)
    s = data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace")
    points = np.frombuffer(s, np.uint32)
    first = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=first[1:])
    size = np.diff(first[off])
    if len(points) != first[-1]:  # bytes that are no UTF-8
        each = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)]
        points, size = np.frombuffer("".join(each).encode("utf-32-le", "replace"), np.uint32), np.array([len(x) for x in each], np.int64)
    out = np.full(len(points) + (ORDER - 1) * len(size), START, np.uint32)
    out[_places(size)] = points
    return out, size


def _places(size: np.ndarray) -> np.ndarray:
    """Where the characters of the texts are among symbols() of them."""
    return np.arange(size.sum()) + (ORDER - 1) * (np.repeat(np.arange(len(size)), size) + 1)


class Grams:
    """The different grams of the highest order of some texts: mark (64 bits), points [n, ORDER], salts; of each position, which of them it ends (at)."""

    def __init__(self, col: pa.Array, salts: np.ndarray):
        s, self.size = symbols(col)
        place = _places(self.size)
        wide = s.astype(np.uint64)
        total = wide * _STEP[0]
        for k in range(1, ORDER):
            total[k:] += wide[: len(wide) - k] * _STEP[k]
        salted = np.repeat(salts, self.size)
        codes = pa.array(mix(total[place] + salted)).dictionary_encode()
        self.mark, self.at = codes.dictionary.to_numpy(), codes.indices.to_numpy()
        first = _first(self.at, len(self.mark))
        self.points = s[place[first][:, None] + np.arange(1 - ORDER, 1)] if len(first) else np.zeros((0, ORDER), np.uint32)
        self.salts = salted[first]


def gram_key(points: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Keys of KEY_BITS bits of the grams in the rows of points (any order, 0 included)."""
    total = salts + np.uint64(points.shape[1])
    for k in range(points.shape[1]):
        total = total + (points[:, points.shape[1] - 1 - k].astype(np.uint64) + np.uint64(1)) * _STEP[k]
    return mix(total) >> np.uint64(64 - KEY_BITS)


def each_key(points: np.ndarray, salts: np.ndarray):
    """For grams of the highest order: keys of their endings by order from 1, then of the contexts of these; one array at a time."""
    for end in (ORDER, ORDER - 1):
        for k in range(1, ORDER + 1):
            yield gram_key(points[:, ORDER - k : end], salts)


def _first(at: np.ndarray, n: int) -> np.ndarray:
    """Where each of n numbers occurs first."""
    out = np.zeros(n, np.int32)
    out[at[::-1]] = np.arange(len(at) - 1, -1, -1, dtype=np.int32)
    return out


def merged(parts: list[Grams]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """points and salts of the different grams of several pieces, and for each piece which of them its grams are."""
    if not parts:
        return np.zeros((0, ORDER), np.uint32), np.zeros(0, np.uint64), []
    codes = pa.array(np.concatenate([g.mark for g in parts])).dictionary_encode()
    at = codes.indices.to_numpy()
    first = _first(at, len(codes.dictionary))
    which = np.split(at, np.cumsum([len(g.mark) for g in parts])[:-1])
    return np.concatenate([g.points for g in parts])[first], np.concatenate([g.salts for g in parts])[first], which


class Asked:
    """The sorted keys of all orders that some grams ask for, and which of them each gram's endings and their contexts are."""

    def __init__(self, points: np.ndarray, salts: np.ndarray):
        different, at = [], []
        for x in each_key(points, salts):
            codes = pa.array(x).dictionary_encode()
            different.append(codes.dictionary.to_numpy())
            at.append(codes.indices.to_numpy())
        del x, codes
        ends = np.cumsum([len(x) for x in different])[:-1]
        different = np.concatenate(different)
        self.keys, which = np.unique(different, return_inverse=True)
        del different
        which = np.split(which.astype(np.int32), ends)
        self.where = []
        for x in which:
            i = at.pop(0)
            self.where.append(x[i] if len(x) else np.zeros(0, np.int32))

    def bits(self, p: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Of each gram, from the answers to the keys: the longest ending that was seen, lowered for each longer context that was."""
        value = np.full(len(self.where[0]), -math.log2(UNIVERSE))
        for end, context in zip(self.where[:ORDER], self.where[ORDER:], strict=True):
            own = p[end]
            value = np.where(own <= 0, own, value + back[context])
        return -value


def _strings(points: np.ndarray) -> pa.Array:
    """The rows of points as strings."""
    wide = 1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(wide.sum(1))]).astype(np.int32)
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.Array.from_buffers(pa.string(), len(points), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, gram, n over all rows (lang, t): a task counts before it shuffles."""

    def run(batches):
        kept: list = []
        names: dict[str | None, int] = {}
        size = 0

        def flush():
            mark, at = np.unique(np.concatenate([x[0] for x in kept]), return_inverse=True)
            first = np.zeros(len(mark), np.int64)
            first[at[::-1]] = np.arange(len(at))[::-1]
            n = np.bincount(at, np.concatenate([x[1] for x in kept]), len(mark)).astype(np.int64)
            return mark, n, np.concatenate([x[2] for x in kept])[first], np.concatenate([x[3] for x in kept])[first]

        def out():
            _, n, points, which = flush()
            known = pa.array(list(names), pa.string())
            for a in range(0, len(n), 1 << 16):
                lang = pa.DictionaryArray.from_arrays(pa.array(which[a : a + (1 << 16)], pa.int32()), known).cast(pa.string())
                yield pa.RecordBatch.from_arrays([lang, _strings(points[a : a + (1 << 16)]), pa.array(n[a : a + (1 << 16)])], names=["lang", "gram", "n"])

        for batch in batches:
            for part in chunks(batch, "t", PIECE):
                of = np.array([names.setdefault(v, len(names)) for v in part.column(0).to_pylist()], np.uint64)
                g = Grams(part.column(1), mix(of + np.uint64(1)))
                back = dict(zip(mix(np.unique(of) + np.uint64(1)).tolist(), np.unique(of).tolist(), strict=True))
                kept.append((g.mark, np.bincount(g.at, minlength=len(g.mark)), g.points, np.array([back[v] for v in g.salts.tolist()], np.int32)))
                size += len(g.mark)
                if size > 1 << 20:
                    kept = [flush()]
                    size = len(kept[0][0])
                    if size > 1 << 19:
                        yield from out()
                        kept, size = [], 0
        if kept:
            yield from out()
        trim()

    return rows.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(tables: dict[int, DataFrame]) -> DataFrame:
    """lang, k, d1, d2, d3: what modified Kneser-Ney takes off counts of one, two, and three or more."""
    out = None
    for k, t in tables.items():
        n = t.groupBy("lang").agg(*[F.sum((F.col("n") == j).cast("double")).alias(f"n{j}") for j in range(1, 5)]).withColumn("k", F.lit(k))
        out = n if out is None else out.union(n)
    y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
    step = lambda j: F.greatest(F.lit(0.05), F.least(F.lit(j - 0.05), F.coalesce(F.lit(float(j)) - (j + 1) * y * F.try_divide(F.col(f"n{j + 1}"), F.col(f"n{j}")), F.lit(0.5))))
    return out.select("lang", "k", *[step(j).alias(f"d{j}") for j in (1, 2, 3)])


def probabilities(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, gram (of any order), p (of a seen gram's last character, in bits below 0), back (of a context: what the shorter gram's p is lowered by, in bits).

    Order ORDER has the counts of the text, lower orders the numbers of different left
    neighbours. Each order is two joins, on (lang, context) and on (lang, shorter gram).
    """
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = scratch.write(tables[k + 1].groupBy("lang", F.expr(f"substring(gram, 2, {k})").alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"order{k}", rows=16384)
    discounts = scratch.write(_discounts(tables), "discounts")
    lower, out = None, []
    for k in range(1, ORDER + 1):
        t = tables[k].withColumn("ctx", F.expr(f"substring(gram, 1, {k - 1})"))
        # A row for each language, written before: the join needs no exchange by language.
        t = t.join(discounts.filter(f"k = {k}").drop("k"), "lang").withColumn("cut", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        sums = t.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("back"))
        t = t.join(sums, ["lang", "ctx"]).withColumn("own", (F.col("n") - F.col("cut")) / F.col("total"))
        if lower is None:
            t = t.withColumn("p", F.col("own") + F.col("back") / UNIVERSE)
        else:
            shorter = lower.select("lang", F.col("gram").alias("short"), F.col("p").alias("under"))
            t = t.withColumn("short", F.expr(f"substring(gram, 2, {k - 1})")).join(shorter, ["lang", "short"]).withColumn("p", F.col("own") + F.col("back") * F.col("under"))
        lower = scratch.write(t.select("lang", "gram", "ctx", "p", "back"), f"p{k}", rows=16384)
        none = F.lit(None).cast("double")
        out.append(lower.select("lang", "gram", F.log2("p").alias("p"), none.alias("back")))
        out.append(lower.groupBy("lang", F.col("ctx").alias("gram")).agg(none.alias("p"), F.log2(F.first("back")).alias("back")))
    rows = out[0]
    for t in out[1:]:
        rows = rows.union(t)
    return rows.groupBy("lang", "gram").agg(F.max("p").alias("p"), F.max("back").alias("back"))


def keyed(probs: DataFrame, shift: int) -> DataFrame:
    """shard, key, p, back: the model as scoring joins it; shard: the key without `shift` bits."""

    def run(batches):
        salts: dict[str, np.uint64] = {}
        for b in batches:
            names, size = b.column(0).to_pylist(), np.array([len(x) for x in b.column(1).to_pylist()], np.int64)
            each = np.array([salts.setdefault(v, salt(v)) for v in names], np.uint64)
            points = np.frombuffer("".join(b.column(1).to_pylist()).encode("utf-32-le"), np.uint32)
            start, key = np.cumsum(size) - size, np.zeros(len(size), np.uint64)
            for k in np.unique(size):
                at = np.flatnonzero(size == k)
                key[at] = gram_key(points[start[at][:, None] + np.arange(k)] if k else np.zeros((len(at), 0), np.uint32), each[at])
            yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(shift)).astype(np.int32)), pa.array(key.astype(np.int64)), b.column(2), b.column(3)], names=["shard", "key", "p", "back"])

    return probs.select("lang", "gram", "p", "back").mapInArrow(run, "shard int, key long, p double, back double")


def _packed(x: np.ndarray) -> bytes:
    """An array of numbers as compressed byte planes."""
    return len(x).to_bytes(4, "little") + pa.Codec("zstd").compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes(), asbytes=True)


def _unpacked(b: bytes, kind) -> np.ndarray:
    n, kind = int.from_bytes(b[:4], "little"), np.dtype(kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(b[4:], kind.itemsize * n, asbytes=True), np.uint8)
    return planes.reshape(kind.itemsize, n).T.copy().view(kind).reshape(-1)


def _light(g: Grams, *names: str) -> Grams:
    """g without the arrays of these names: those of a block's pieces add up."""
    for name in names:
        delattr(g, name)
    return g


def _pieces(t: pa.Table):
    """Grams of the pieces of a block, with each piece's rows."""
    salts: dict[str, np.uint64] = {}
    for batch in t.select(["text", "model"]).combine_chunks().to_batches():
        for part in chunks(batch, "text", PIECE):
            each = np.array([salts.setdefault(v, salt(v)) for v in part.column(1).to_pylist()], np.uint64)
            yield Grams(part.column(0), each), part.num_rows


def pack(batches):
    """Blocks of rows: block, blob (an Arrow stream)."""
    kept: list = []
    size = seq = 0

    def out():
        t = pa.Table.from_batches(kept).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
            w.write_table(t)
        place = TaskContext.get()
        name = hashlib.blake2b(f"{place.partitionId() if place else 0} {seq}".encode(), digest_size=8).digest()
        return pa.RecordBatch.from_arrays([pa.array([int.from_bytes(name, "little", signed=True)]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "blob"])

    for batch in batches:
        for part in chunks(batch, "text", BLOCK):
            n = part.nbytes
            if kept and size + n > BLOCK:
                yield out()
                kept, size, seq = [], 0, seq + 1
            kept.append(part)
            size += n
    if kept:
        yield out()
    kept = []
    trim()


def _rows_of(blob: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(blob.as_buffer()).read_all()


def asking(shift: int):
    """What blocks ask for: block, shard, keys (packed differences of the sorted keys of a shard)."""

    def run(batches):
        for b in batches:
            for block, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                grams = merged([_light(g, "at") for g, _ in _pieces(_rows_of(blob))])[:2]
                keys = np.unique(np.concatenate([pa.array(x).unique().to_numpy() for x in each_key(*grams)]))
                del grams
                shard = (keys >> np.uint64(shift)).astype(np.int64)
                starts = np.flatnonzero(np.diff(shard, prepend=-1))
                packed = [_packed(np.diff(keys[i:j], prepend=np.uint64(0))) for i, j in zip(starts, [*starts[1:], len(keys)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), block)), pa.array(shard[starts], pa.int32()), pa.array(packed, pa.binary())], names=["block", "shard", "keys"])
        trim()

    return run


def answers(left: pa.Table, right: pa.Table) -> pa.Table:
    """One shard: for each block, p and back of the keys it asks for, in their order (0 above any p: not seen)."""
    key = right.column("key").to_numpy().astype(np.uint64)
    order = np.argsort(key)
    key = np.append(key[order], np.uint64(1 << 63))
    nothing = lambda name, other: np.append(np.nan_to_num(right.column(name).to_numpy()[order], nan=other), other).astype(np.float32)
    p, back = nothing("p", 1.0), nothing("back", 0.0)
    out = []
    for blob in left.column("keys"):
        asked = np.cumsum(_unpacked(blob.as_buffer().to_pybytes(), np.uint64), dtype=np.uint64)
        at = np.searchsorted(key, asked)
        at[key[at] != asked] = len(key) - 1
        out.append(_packed(np.concatenate([p[at], back[at]])))
    return pa.table({"block": left.column("block"), "shard": left.column("shard"), "values": pa.array(out, pa.binary())})


def score(left: pa.Table, right: pa.Table, names: list[str]) -> pa.Table:
    """One block: its rows with chars and bits (mean for a character; null without text)."""
    out = []
    right = right.sort_by("shard")
    both = [_unpacked(x.as_buffer().to_pybytes(), np.float32) for x in right.column("values")]
    p = np.concatenate([x[: len(x) // 2] for x in both] or [np.zeros(0, np.float32)])
    back = np.concatenate([x[len(x) // 2 :] for x in both] or [np.zeros(0, np.float32)])
    for blob in left.column("blob"):
        t = _rows_of(blob)
        pieces = list(_pieces(t))
        *grams, which = merged([g for g, _ in pieces])
        for g, _ in pieces:
            _light(g, "mark", "points", "salts")
        asked = Asked(*grams)
        del grams
        if len(asked.keys) != len(p):
            raise RuntimeError("a block's answers don't belong to it")
        bits = asked.bits(p, back)
        total, size = [], []
        for (g, n), at in zip(pieces, which, strict=True):
            each = bits[at][g.at] if len(g.at) else np.zeros(0)
            size.append(g.size)
            total.append(np.bincount(np.repeat(np.arange(n), g.size), each, n))
        size = np.concatenate(size) if size else np.zeros(0, np.int64)
        total = np.concatenate(total) if total else np.zeros(0)
        mean = pa.array(total / np.maximum(size, 1), pa.float64(), mask=size == 0)
        out.append(pa.table([*[t.column(c) for c in names], t.column("model"), pa.array(size), mean], names=[*names, "model", "chars", "bits"]))
    trim()
    return pa.concat_tables(out) if out else pa.table({})


def _unit(x: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("held out"), x), F.lit(FOLD)) == 0


def trusted_keys(labels: DataFrame, scratch: Scratch) -> DataFrame:
    """k, out: keys that labels call good and not toxic, and whether they are held out of the training."""
    k = labels.groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x"))
    return scratch.write(k.filter("q = 1 and x = 0 and k is not null").select("k", _unit(F.col("k")).alias("out")), "trusted", rows=16384)


def train(rows: DataFrame, trusted: DataFrame, scratch: Scratch, shift: int) -> tuple[DataFrame, DataFrame]:
    """From all trusted rows (key, lang, text) that aren't held out: the model by key, and the languages that have one.

    Texts of other documents are left out by a fixed-size bitmap of the trusted keys before
    the exact join, so only trusted text is shuffled.
    """
    spark = rows.sparkSession
    learnt = trusted.filter("not out").select("k")
    bits = spark.sparkContext.broadcast(bitmap(learnt))

    def some(batches):
        for batch in batches:
            yield batch.filter(pa.array(held(bits.value, batch.column(3).to_numpy()))).select(["k", "lang", "t"])
        trim()

    cell = F.pmod(F.xxhash64("key"), F.lit(BITS)).cast("long")
    taught = rows.filter("key is not null and text is not null").select(F.col("key").alias("k"), "lang", F.col("text").alias("t"), cell.alias("c"))
    # Written, for the two steps in Python in one stage would take twice the workers, and these stay with their memory.
    taught = scratch.write(taught.mapInArrow(some, "k long, lang string, t string").join(learnt, "k", "left_semi").select("lang", "t"), "taught")
    counts = scratch.write(gram_counts(taught), "counts", rows=16384)
    scratch.drop("taught")
    bits.destroy()
    del taught
    release(spark)
    own = counts.filter("lang is not null")
    langs = scratch.write(own.select("lang").distinct(), "langs")
    pooled = counts.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("lang"), "gram", "n")
    alone = not rows.select("lang").distinct().join(langs, "lang", "left_anti").isEmpty()
    probs = scratch.write(probabilities(scratch.write(own.union(pooled), "all") if alone else own, scratch), "probabilities", rows=16384)
    model = scratch.write(keyed(probs, shift), "model", rows=16384)
    scratch.drop("counts", "all", "probabilities", *[f"order{k}" for k in range(1, ORDER)], *[f"p{k}" for k in range(1, ORDER + 1)])
    release(spark)
    return model, langs


def limits(figures: DataFrame, scratch: Scratch) -> DataFrame:
    """model, middle, high, wide: by model and, as POOLED, of all, from the figures (model, chars, bits) of the documents held out."""
    own = figures.filter("bits is not null")
    own = scratch.write(own.filter(F.col("model") != POOLED).unionByName(own.withColumn("model", F.lit(POOLED))), "held")

    def quantile(rows: DataFrame, value: Column, bins: int, q: float, name: str) -> DataFrame:
        h = rows.groupBy("model", F.floor(value * bins).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        each = Window.partitionBy("model")
        h = h.withColumns({"upto": F.sum("n").over(each.orderBy("b")), "of": F.sum("n").over(each)})
        return h.groupBy("model").agg(((F.min(F.when(F.col("upto") >= F.col("of") * q, F.col("b"))) + 1) / bins).alias(name), F.max("of").alias(f"{name}_n"))

    middle = quantile(own, F.col("bits"), BINS, 0.5, "middle")
    high = quantile(own, F.col("bits"), BINS, QUANTILE, "high")
    away = own.join(middle, "model").withColumn("z", (F.col("bits") - F.col("middle")) * F.sqrt("chars"))
    wide = quantile(away, F.col("z"), WIDE_BINS, QUANTILE, "wide")
    return scratch.write(middle.join(high, "model").join(wide, "model").select("model", "middle", "high", "wide", F.col("high_n").alias("n")), "limits")


def judged(docs: DataFrame, labels: DataFrame, keep: list[str], key: str, text: str, lang: str) -> DataFrame:
    """Per row: c0, c1, ... (the columns in keep), chars, bits, threshold (in bits), kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    shift = KEY_BITS - min(20, max(6, math.ceil(math.log2(size / (32 << 20) + 1))))
    field = lambda c: F.col(f"`{c}`")
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[field(c).alias(n) for c, n in zip(keep, names, strict=True)], field(key).cast("long").alias("key"), field(lang).cast("string").alias("lang"), field(text).alias("text"))
    trusted = trusted_keys(labels, scratch)
    model, langs = train(rows.select("key", "lang", "text"), trusted, scratch, shift)

    rows = rows.join(langs.select("lang", F.col("lang").alias("own")), "lang", "left").withColumn("model", F.coalesce("own", F.lit(POOLED))).drop("own", "lang")
    packed = rows.select(*names, "key", "text", "model").mapInArrow(pack, "block long, blob binary")
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = packed.repartition(n, "block")
    asked = dealt.mapInArrow(asking(shift), "block long, shard int, keys binary")
    values = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(answers, "block long, shard int, values binary")
    fields = [T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep, strict=True)]
    out = T.StructType([*fields, T.StructField("key", T.LongType()), T.StructField("model", T.StringType()), T.StructField("chars", T.LongType()), T.StructField("bits", T.DoubleType())])
    wanted = [*names, "key"]
    empty = pa.schema([])

    def run(left, right):
        return score(left, right, wanted) if left.num_rows else empty.empty_table()

    scored = dealt.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(run, out)
    scored = scratch.write(scored, "scored")
    scratch.drop("model")
    del packed, dealt, asked, values, rows
    release(spark)

    away = scored.select("key", "model", "chars", "bits").join(trusted.filter("out").select(F.col("k").alias("key")), "key", "left_semi")
    cut = limits(away.select("model", "chars", "bits"), scratch)
    common = cut.filter(F.col("model") == POOLED).first()
    cut = cut.select(F.col("model").alias("m"), "middle", "high", "wide", "n")
    scored = scored.join(cut, F.col("model") == F.col("m"), "left")
    limit = F.greatest(F.col("high"), F.col("middle") + F.col("wide") / F.sqrt("chars"))
    limit0 = F.greatest(F.lit(common["high"]), F.lit(common["middle"]) + F.lit(common["wide"]) / F.sqrt("chars")) if common else F.lit(None).cast("double")
    limit = F.when(F.coalesce(F.col("n"), F.lit(0)) >= FEW, limit).otherwise(F.greatest(limit, limit0))
    scored = scored.withColumn("threshold", F.when(F.col("chars") > 0, limit))
    return scored.withColumn("kept", (F.col("chars") > 0) & F.coalesce(F.col("bits") <= F.col("threshold"), F.lit(True))).drop("m", "middle", "high", "wide", "n", "model")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: key, n_chars, perplexity (for a character), threshold (its language's, for its length), kept."""
    rows = judged(docs, labels, [key], key, text, lang)
    return rows.select(F.col("c0").alias(key), F.col("chars").alias("n_chars"), F.pow(F.lit(2.0), "bits").alias("perplexity"), F.pow(F.lit(2.0), "threshold").alias("threshold"), "kept")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that classify() keeps, with all their columns."""
    rows = judged(docs, labels, docs.columns, key, text, lang).filter("kept")
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
