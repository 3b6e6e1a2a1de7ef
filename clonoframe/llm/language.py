"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary, learned by
expectation-maximisation over all segmentations of its training words. A word's probability
in a language is the sum over all its segmentations into pieces, by the forward algorithm;
a text's is the product over its words. Pieces work on UTF-8 bytes, every single byte is a
piece, so every word has a probability. Words are taken whole, however long: a long one is
divided only where no piece that it holds reaches across, so that every segmentation has a
break there and the sum is a product; what can't be divided is summed in logarithms.

The classifier is fitted on a bounded sample: about SAMPLE documents of each language, those
with the lowest hashes of the key among the rows that the caller allows. Prediction reads
every whole text.

Defined cases: null text, or a text without letters, is `und` with score 0; rows without a
language teach nothing; without any training row everything is `und`; of equally likely languages the
first by name is taken; repeated rows give repeated results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches
from .tokens import Words, mix

#: Training documents of each language, about.
SAMPLE = 400
#: Longer words are divided where no piece reaches across, and what is longer still is summed in logarithms (both in bytes).
LONG = 32
#: Pieces longer than this are looked for only where their first so many bytes occur.
COMMON = 10
ROUNDS = 3
#: Words, of LONG bytes at most, whose probabilities a worker remembers.
REMEMBERED = 400_000

NOT_LETTER = np.zeros(256, bool)
NOT_LETTER[:0x80] = True
NOT_LETTER[0x41:0x5B] = NOT_LETTER[0x61:0x7B] = False
_STEP = [np.uint64(int(x) * 2 + 1) for x in np.random.default_rng(7).integers(1 << 60, 1 << 62, 256)]


def public_pieces(path: str) -> list[bytes]:
    """The vocabulary's pieces that words can hold, as bytes, a word's start as one space: those of lower-case ASCII letters
    and bytes from 0x80 (words have nothing else), and every byte."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = {bytes([b]) for b in range(256)}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        p = sp.id_to_piece(i).replace("▁", " ").encode()
        if p == p.lower() and b" " not in p[1:] and all(c >= 0x61 and c <= 0x7A or c >= 0x80 for c in p.lstrip(b" ")):
            kept.add(p)
    return sorted(kept)


class Lattice:
    """Looks up all pieces inside words that are held as rows of bytes."""

    def __init__(self, pieces: list[bytes]):
        code = np.array([self._one(p) for p in pieces], np.uint64)
        order = np.argsort(code)
        self.code, self.number = code[order], order.astype(np.int32)
        self.longest = max(map(len, pieces))
        self.heads = np.unique(np.array([self._one(p[:COMMON]) for p in pieces if len(p) > COMMON], np.uint64))

    @staticmethod
    def _one(p: bytes) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for k, b in enumerate(p):
            h = h + mix(np.array([b + 1], np.uint64)) * _STEP[k]
        return (h + np.uint64(len(p)))[0]

    def _found(self, code: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.number[at], np.int32(-1))

    def pieces_of(self, rows: np.ndarray) -> list[np.ndarray]:
        """rows [n, length] of bytes -> for each piece length l, an array [n, length - l + 1] of piece numbers, -1 for none."""
        x = mix(rows.astype(np.uint64) + np.uint64(1))
        n, length = rows.shape
        h, out, some = np.zeros((n, length + 1), np.uint64), [], None
        for k in range(min(self.longest, length)):
            h = h[:, : length - k] + x[:, k:] * _STEP[k]
            if k < COMMON:
                out.append(self._found(h + np.uint64(k + 1)))
                if k == COMMON - 1:
                    some = np.isin(h + np.uint64(k + 1), self.heads) if len(self.heads) else np.zeros(h.shape, bool)
            else:
                some = some[:, : length - k]
                if not some.any():
                    break
                found = np.full(h.shape, -1, np.int32)
                found[some] = self._found(h[some] + np.uint64(k + 1))
                out.append(found)
        return out

    def divided(self, word: bytes) -> list[bytes]:
        """The parts of a word between places that no piece in it reaches across."""
        covered = np.zeros(len(word) + 1, np.int64)
        for k, ids in enumerate(self.pieces_of(np.frombuffer(word, np.uint8).reshape(1, -1)), 1):
            at = np.flatnonzero(ids[0] >= 0) if k > 1 else ()
            np.add.at(covered, np.asarray(at, np.int64) + 1, 1)
            np.add.at(covered, np.asarray(at, np.int64) + k, -1)
        free = [0, *(np.flatnonzero(np.cumsum(covered[:-1])[1:] == 0) + 1).tolist(), len(word)]
        return [word[i:j] for i, j in zip(free[:-1], free[1:], strict=True)]

    def parts(self, words: list[bytes]):
        """The words, or their parts, as byte rows of equal length: (indices of the words, rows)."""
        groups: dict[int, tuple[list, list]] = {}
        for i, w in enumerate(words):
            for s in self.divided(w) if len(w) > LONG else (w,):
                g = groups.setdefault(len(s), ([], []))
                g[0].append(i)
                g[1].append(s)
        for length, (who, rows) in groups.items():
            step = max(1, 640_000 // max(length, 1))
            for a in range(0, len(who), step):
                yield np.array(who[a : a + step]), np.frombuffer(b"".join(rows[a : a + step]), np.uint8).reshape(-1, length)


def forward(ids: list[np.ndarray], p: np.ndarray, length: int) -> list[np.ndarray]:
    """Sums over segmentations, for every language: alpha [length + 1][n, languages]. p has a last row of zeros."""
    alpha = [np.ones((ids[0].shape[0], p.shape[1]))]
    for j in range(1, length + 1):
        total = 0.0
        for k in range(1, min(j, len(ids)) + 1):
            total = total + alpha[j - k] * p[ids[k - 1][:, j - k]]
        alpha.append(total)
    return alpha


def log_forward(ids: list[np.ndarray], logs: np.ndarray, length: int, keep: bool = False) -> list[np.ndarray]:
    """The same in logarithms, for any length; only what the next step needs is held, unless keep."""
    alpha = [np.zeros((ids[0].shape[0], logs.shape[1]))]
    for j in range(1, length + 1):
        most = min(j, len(ids))
        alpha.append(np.logaddexp.reduce([alpha[-k] + logs[ids[k - 1][:, j - k]] for k in range(1, most + 1)], axis=0))
        if not keep and len(alpha) > len(ids):
            alpha.pop(0)
    return alpha


class Model:
    def __init__(self, pieces: list[bytes], langs: list[str], p: np.ndarray):
        self.lattice, self.langs = Lattice(pieces), langs
        self.p = np.vstack([p, np.zeros((1, len(langs)))]).astype(np.float64)

    def score(self, words: list[bytes]) -> np.ndarray:
        """Log-probability of each word in each language."""
        out = np.zeros((len(words), len(self.langs)))
        with np.errstate(divide="ignore"):
            logs = np.log(self.p)
        for who, rows in self.lattice.parts(words):
            ids, length = self.lattice.pieces_of(rows), rows.shape[1]
            if length <= LONG:
                made = np.log(np.maximum(forward(ids, self.p, length)[-1], 1e-300))
            else:
                made = log_forward(ids, logs, length)[-1]
            np.add.at(out, who, made)
        return out


def _expected(ids: list[np.ndarray], length: int, p: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Expected counts of the pieces (and of none, last) over all segmentations of rows that occur n times."""
    seen = np.zeros(size)
    if length <= LONG:
        alpha = [a[:, 0] for a in forward(ids, p[:, None], length)]
        beta = [np.ones(len(n))]
        for j in range(length - 1, -1, -1):
            beta.insert(0, sum(p[ids[k - 1][:, j]] * beta[k - 1] for k in range(1, min(length - j, len(ids)) + 1)))
        weight = lambda j, k, at: alpha[j] * p[at] * beta[j + k] / alpha[length]
    else:
        with np.errstate(divide="ignore"):
            logs = np.log(p)[:, None]
        alpha = log_forward(ids, logs, length, keep=True)
        back = [x[:, ::-1] for x in ids]
        beta = log_forward(back, logs, length, keep=True)[::-1]
        weight = lambda j, k, at: np.exp(alpha[j] + logs[at] + beta[j + k] - alpha[length])[:, 0]
    for j in range(length):
        for k in range(1, min(length - j, len(ids)) + 1):
            at = ids[k - 1][:, j]
            seen += np.bincount(at % size, weight(j, k, at) * n, size)
    return seen


def learn(pieces: list[bytes], samples: dict[str, tuple[list[bytes], np.ndarray]], rounds: int = ROUNDS) -> Model:
    """samples: for each language, distinct words and their counts. Expected piece counts by forward and backward sums."""
    lattice, langs = Lattice(pieces), sorted(samples)
    size = np.array([len(p) for p in pieces])
    table = np.zeros((len(pieces), len(langs)))
    for c, lang in enumerate(langs):
        words, count = samples[lang]
        groups = [(count[who], lattice.pieces_of(rows), rows.shape[1]) for who, rows in lattice.parts(words)]
        p = np.append(np.full(len(pieces), 1.0) * 4.0 ** -(size - 1.0), 0.0)
        p /= p.sum()
        for _ in range(rounds):
            seen = sum((_expected(ids, length, p, n, len(pieces) + 1) for n, ids, length in groups), np.zeros(len(pieces) + 1))
            p[:-1] = (seen[:-1] + 0.05) / (seen[:-1].sum() + 0.05 * len(pieces))
        table[:, c] = p[:-1]
    return Model(pieces, langs, table)


def _cut(w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    return w.data.tobytes(), w.start, w.end


def train(docs: DataFrame, allowed: Column, tokenizer_path: str, key: str, text: str, lang: str, sample: int = SAMPLE) -> Model:
    """Fits the model on about `sample` documents of each language; only their word counts reach the driver."""
    fit = docs.filter(allowed & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(lang).cast("string").alias("l"), F.col(text).alias("t"))
    counts = {r["l"]: r["n"] for r in fit.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    pieces = public_pieces(tokenizer_path)
    if not counts:
        return Model(pieces, [], np.zeros((len(pieces), 0)))
    share = F.coalesce(*[F.when(F.col("l") == v, F.lit(min(1.0, sample / n))) for v, n in sorted(counts.items())])
    some = fit.filter(F.pmod(F.xxhash64(F.lit("train"), "k"), F.lit(1 << 30)) < share * (1 << 30))

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "t"):
                w = Words(part.column(1), NOT_LETTER, lower=True)
                data, start, end = _cut(w)
                for i, name in enumerate(part.column(0).to_pylist()):
                    a, b = w.first[i], w.first[i + 1]
                    held, n = np.unique(np.array([data[s:e] for s, e in zip(start[a:b], end[a:b], strict=True)], object), return_counts=True) if b > a else ([], [])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(list(held), pa.binary()), pa.array(n, pa.int64())], names=["l", "w", "n"])

    with small_batches(docs.sparkSession):
        rows = some.select("l", "t").mapInArrow(run, "l string, w binary, n long").groupBy("l", "w").agg(F.sum("n").alias("n")).toArrow()
    samples = {}
    names, words, n = np.array(rows["l"].to_pylist(), object), rows["w"].to_pylist(), rows["n"].to_numpy()
    for v in counts:
        at = np.flatnonzero(names == v) if len(names) else np.zeros(0, int)
        samples[v] = ([b" " + words[i] for i in at], n[at].astype(float))
    return learn(pieces, samples)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, `keep`, lang_pred, score. One map pass; the model's size is fixed by vocabulary and languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in (key, *keep)]

    def run(batches):
        m = shared.value
        known: dict[bytes, int] = {}
        table = np.zeros((0, len(m.langs)))
        for batch in batches:
            for part in chunks(batch, "_text"):
                col = part.column(part.num_columns - 1)
                w = Words(col, NOT_LETTER, lower=True)
                h = w.hashes()
                _, at, back = np.unique(h, return_index=True, return_inverse=True)
                data = w.data.tobytes()
                words = [b" " + data[s:e] for s, e in zip(w.start[at], w.end[at], strict=True)]
                if len(known) > REMEMBERED:
                    known, table = {}, table[:0]
                new = [x for x in words if len(x) <= LONG and x not in known]
                if new and m.langs:
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                    table = np.vstack([table, m.score(new)])
                long = [x for x in words if len(x) > LONG]
                own = dict(zip(long, range(len(known), len(known) + len(long)), strict=True))
                first, n = w.first, len(col)
                total = np.zeros((n, len(m.langs)))
                if m.langs and len(h):
                    both = np.vstack([table, m.score(long)]) if long else table
                    each = both[np.array([known[x] if len(x) <= LONG else own[x] for x in words])][back.reshape(-1)]
                    doc = np.repeat(np.arange(n), np.diff(first))
                    for c in range(len(m.langs)):
                        total[:, c] = np.bincount(doc, each[:, c], n)
                letters = np.diff(first) > 0
                ascii_letter = np.zeros(len(w.data) + 1, np.int64)
                np.cumsum(~NOT_LETTER[w.data] & (w.data < 0x80), out=ascii_letter[1:])
                plain = ascii_letter[w.offsets[1:]] > ascii_letter[w.offsets[:-1]]
                for i in np.flatnonzero(letters & ~plain):
                    letters[i] = any(map(str.isalpha, col[int(i)].as_py()))
                pred, score = ["und"] * n, np.zeros(n)
                if m.langs:
                    best = total.argmax(1)
                    post = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                    pred = [m.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                    score = np.where(letters, post, 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(pred), pa.array(score)], names=[f.name for f in fields] + ["lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*[F.col(f.name) for f in fields], F.col(text).alias("_text")).mapInArrow(run, f"{schema}, lang_pred string, score double")


def identify_held_out(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Per row: key, held_out, lang_pred, score; learned only from rows whose crc32 of the key as text leaves no 1 by 3."""
    out = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    model = train(docs, ~out & F.col(key).isNotNull(), tokenizer_path, key, text, lang, sample)
    rows = identify(docs.withColumn("held_out", out), model, key, text, ("held_out",))
    return rows.select(key, "held_out", "lang_pred", "score")
