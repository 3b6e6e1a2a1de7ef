"""Benchmark decontamination by a prefix-filtered join with exact windows.

Every window of an item (WINDOW consecutive words; the whole item, if shorter) is held as a
set of places for its words. The words are ordered by rarity, counted over all documents; as
containment asks for every word, the prefix that a document must share is the window's
rarest word. Document words join the windows on that word; the window must then lie within
the document (length bound) at the place the word has in it (positional bound), and all its
words are compared.

The item side is a stated query set: it is read in blocks of at most BLOCK windows, each
broadcast (its size is bounded by the block), whatever the table's size.

Defined cases: null or empty text has no words, and items without words match nothing; the
windows of an item with a null id hit words as others do, but it isn't counted or named; items of equal id count once; repeated document rows give
repeated results; an empty table of either kind gives no rows or no hits; extra columns are
ignored. Memory in a worker is bounded by a batch of texts, or the longest text, and by PAIRS,
however many windows share their rarest word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, small_batches, trim
from .tokens import NOT_ALNUM, Words

WINDOW = 10
#: Windows of one broadcast block (about 100 bytes each).
BLOCK = 500_000
#: Pairs of a document word and a window that are compared at once (more only if one word is the prefix of more windows).
PAIRS = 1 << 18


class Block:
    """Windows of some items: word hashes, lengths, the items of each, and its prefix word."""

    def __init__(self, items: list[tuple[str, np.ndarray]], width: int):
        found: dict[bytes, list[str]] = {}
        for name, h in items:
            for i in range(max(1, len(h) - width + 1)):
                found.setdefault(h[i : i + width].tobytes(), []).append(name)
        self.size = np.array([len(k) // 8 for k in found], np.int64)
        self.word = np.zeros((len(found), width), np.uint64)
        for row, k in zip(self.word, found, strict=True):
            row[: len(k) // 8] = np.frombuffer(k, np.uint64)
        self.items = [sorted({n for n in v if n is not None}) for v in found.values()]
        self.vocabulary = np.unique(np.concatenate([self.word[i, : self.size[i]] for i in range(len(found))])) if found else np.zeros(0, np.uint64)

    def set_prefix(self, count: np.ndarray) -> None:
        """count: occurrences in all documents of each word of the vocabulary. Ties go to the lesser hash."""
        inside = np.arange(self.word.shape[1]) < self.size[:, None]
        rarity = np.where(inside, count[np.minimum(np.searchsorted(self.vocabulary, self.word), max(0, len(count) - 1))] if len(count) else 0, np.iinfo(np.int64).max)
        self.place = rarity.argmin(1)
        first = self.word[np.arange(len(self.word)), self.place]
        self.by = np.argsort(first, kind="stable")
        self.token, at = np.unique(first[self.by], return_index=True)
        self.start = np.append(at, len(first))

    def matches(self, h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows (numbers) and their starts among the word hashes h; lo, hi: the text's bounds for each word."""
        if not len(self.token) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.token, h), len(self.token) - 1)
        word = np.flatnonzero(self.token[at] == h)
        many = self.start[at[word] + 1] - self.start[at[word]]
        ends = np.cumsum(many)
        out_w, out_s = [], []
        a = 0
        while a < len(word):
            to = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            n = many[a:to]
            pos = np.repeat(word[a:to], n)
            w = self.by[np.repeat(self.start[at[word[a:to]]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            a = to
            s = pos - self.place[w]
            fits = (s >= lo[pos]) & (s + self.size[w] <= hi[pos])
            w, s = w[fits], s[fits]
            for k in range(self.word.shape[1]):
                same = (k >= self.size[w]) | (h[np.minimum(s + k, len(h) - 1)] == self.word[w, k])
                w, s = w[same], s[same]
            out_w.append(w)
            out_s.append(s)
        return np.concatenate(out_w) if out_w else np.zeros(0, np.int64), np.concatenate(out_s) if out_s else np.zeros(0, np.int64)


def _blocks(items: DataFrame, item_key: str, text: str, width: int):
    some, n = [], 0
    rows = items.filter(F.col(text).isNotNull()).select(F.col(item_key).cast("string"), F.col(text))
    for name, t in rows.toLocalIterator():
        h = Words(pa.array([t]), NOT_ALNUM, lower=True).hashes()
        if len(h):
            some.append((name, h))
            n += max(1, len(h) - width + 1)
        if n > BLOCK:
            yield Block(some, width)
            some, n = [], 0
    if some:
        yield Block(some, width)


def _word_counts(docs: DataFrame, text: str, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of each word of the vocabulary (sorted hashes) in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        v = shared.value
        total = np.zeros(len(v), np.int64)
        for batch in batches:
            for part in chunks(batch, "t"):
                h = Words(part.column(0), NOT_ALNUM, lower=True).hashes()
                at = np.minimum(np.searchsorted(v, h), len(v) - 1)
                total += np.bincount(at[v[at] == h], minlength=len(v))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"w": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})
        trim()

    out = np.zeros(len(vocabulary), np.int64)
    with small_batches(docs.sparkSession):
        for w, n in docs.select(F.col(text).alias("t")).mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n")).collect():
            out[w] = n
    return out


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """Per row: key, n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256, contaminated.

    Two passes over the documents, without a shuffle of texts or words. With more than one
    block of items, rows with hits are summed by key and text hash and joined back.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    blocks = []
    for block in _blocks(items, item_key, item_text, width):
        block.set_prefix(_word_counts(docs, text, block.vocabulary))
        blocks.append(spark.sparkContext.broadcast(block))

    def described(shared) -> DataFrame:
        def run(batches):
            block = shared.value if shared else None
            for batch in batches:
                for part in chunks(batch, "t"):
                    w = Words(part.column(1), NOT_ALNUM, lower=True)
                    n = np.diff(w.first)
                    spans: list[list[int]] = [[] for _ in n]
                    names: list[set] = [set() for _ in n]
                    if block is not None:
                        h = w.hashes()
                        win, start = block.matches(h, np.repeat(w.first[:-1], n), np.repeat(w.first[1:], n))
                        doc = np.searchsorted(w.first, start, "right") - 1
                        cover = np.zeros(len(h) + 1, np.int64)
                        np.add.at(cover, start, 1)
                        np.add.at(cover, start + block.size[win], -1)
                        hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
                        n_hit = hit[w.first[1:]] - hit[w.first[:-1]]
                        for d, x in set(zip(doc.tolist(), win.tolist(), strict=True)):
                            names[d].update(block.items[x])
                        if many:
                            for d, s, x in zip(doc.tolist(), start.tolist(), win.tolist(), strict=True):
                                spans[d] += [int(s - w.first[d]), int(s - w.first[d] + block.size[x])]
                    else:
                        n_hit = np.zeros(len(n), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(sorted, names), pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))],
                        names=["key", "text_hash", "n_words", "n_hit", "items", "spans"],
                    )
            trim()

        rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("text_hash"))
        return rows.mapInArrow(run, f"key {kind}, text_hash long, n_words long, n_hit long, items array<string>, spans array<long>")

    many = len(blocks) > 1
    if not many:
        out = described(blocks[0] if blocks else None)
    else:
        scratch = Scratch(spark, "windows")
        base = scratch.write(described(None).select("key", "text_hash", "n_words"), "base")
        parts = [scratch.write(described(b).filter("n_hit > 0").dropDuplicates(["key", "text_hash"]), f"hits-{i}") for i, b in enumerate(blocks)]
        hits = parts[0]
        for p in parts[1:]:
            hits = hits.unionByName(p)
        hits = hits.groupBy("key", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
        hits = hits.mapInArrow(_merged, f"k2 {kind}, h2 long, n_hit long, items array<string>")
        out = base.join(hits, F.col("key").eqNullSafe(F.col("k2")) & F.col("text_hash").eqNullSafe(F.col("h2")), "left")
        out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select(
        F.col("key").alias(key), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def _merged(batches):
    for b in batches:
        n = []
        for flat in b.column(3).to_pylist():
            spans = sorted(zip(flat[::2], flat[1::2], strict=True))
            total = end = 0
            for s, e in spans:
                total += max(0, e - max(s, end))
                end = max(end, e)
            n.append(total)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), b.column(2)], names=["k2", "h2", "n_hit", "items"])


def digest(items: list[str]) -> str:
    """What items_sha256 holds, for tests and callers."""
    return hashlib.sha256(",".join(sorted(set(items))).encode()).hexdigest()
