"""Token counts by rank-synchronous merging of byte-pair symbols.

The pre-tokens of a batch are held as one ragged array of symbol ids. In each round
every unfinished pre-token looks up the merge ranks of its adjacent pairs and applies all
occurrences of its own lowest-ranked pair at once; the symbols that survive are counted.

Defined cases: null or empty text has 0 tokens; the vocabulary's special strings count as
one token each where they occur (the library's default); extra columns are ignored;
repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: Fixed value: the pattern that splits text before merging, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose counts a worker remembers; the memory is bounded, the counts don't depend on it.
REMEMBERED = 300_000
_NONE = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others follow from U+0100 in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merges:
    """The merge table of a byte-level BPE vocabulary file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.byte = np.array([ids[c] for c in byte_symbols()], np.int64)
        keys = np.array([(ids[a] << 20) | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (a large number if it has none) and its place in the table."""
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE), at

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty byte string once no pair has a rank."""
        length = np.array([len(t) for t in texts], np.int64)
        left = length.copy()
        sym = self.byte[np.frombuffer(b"".join(texts), np.uint8)]
        who = np.arange(len(texts))
        while len(sym):
            start = np.cumsum(length) - length
            rank = np.full(len(sym), _NONE)
            place = np.zeros(len(sym), np.int64)
            inner = np.ones(len(sym), bool)
            inner[start + length - 1] = False
            i = np.flatnonzero(inner)
            rank[i], place[i] = self.find(sym[i], sym[i + 1])
            least = np.minimum.reduceat(rank, start)
            on = least < _NONE
            left[who[~on]] = length[~on]
            owner = np.repeat(np.arange(len(length)), length)
            hit = on[owner] & (rank == least[owner])
            at = np.flatnonzero(hit)
            # A pair of equal symbols overlaps itself in a run: every second hit of the run counts.
            fresh = np.ones(len(at), bool)
            fresh[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            sym[at] = self.made[place[at]]
            keep = on[owner]
            keep[at + 1] = False
            length = (length - np.bincount(owner[at], minlength=len(length)))[on]
            who, sym = who[on], sym[keep]
        return left


class Counter:
    """Tokens of whole texts; remembers the counts of a bounded number of pre-tokens."""

    def __init__(self, merges: Merges):
        self.merges, self.known = merges, {}
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None

    def __call__(self, texts: list[str]) -> list[int]:
        held, extra = [], []
        for t in texts:
            parts = self.special.split(t) if self.special else [t]
            extra.append(len(parts) - 1)
            held.append([p for part in parts for p in self.split(part)])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({p for ps in held for p in ps}.difference(self.known))
        for i in range(0, len(new), 1 << 16):
            some = new[i : i + (1 << 16)]
            self.known.update(zip(some, self.merges.count([p.encode() for p in some]).tolist(), strict=True))
        return [n + sum(map(self.known.__getitem__, ps)) for n, ps in zip(extra, held, strict=True)]


def count_tokens(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Per row: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens above limit). One map pass, no shuffle.

    tokenizer_path: a byte-level BPE file in the JSON form of public tokenizers. Its merge
    table, of fixed size, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Merges(tokenizer_path))
    field = docs.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(shared.value)
        for batch in batches:
            for part in chunks(batch, "_text", 1 << 20):
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = count(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                    names=[key, "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"{key} {field.dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
