"""What the workers of the corpus operators hold at once."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from clonoframe.llm import decontaminate, kneser_ney
from clonoframe.llm.sharding import kd_shards

SCHEMA = "doc_id long, text string, lang string, source string"


def block_of(texts):
    rows = pa.RecordBatch.from_pydict({"key": pa.array(range(len(texts)), pa.int64()), "text": texts, "model": pa.array(["en"] * len(texts))})
    return pa.Table.from_batches(list(kneser_ney.pack([rows])))


def test_a_block_is_scored_in_little_memory():
    """The arrays of a block's pieces go as soon as they are merged, and keys are encoded one order at a time."""
    r = random.Random(3)
    block = block_of(["".join(r.choices("abcdefghijklmnopqrstuvwxyz     ", k=2000)) for _ in range(2000)])
    asked = [b for x in block.to_batches() for b in kneser_ney.asking(40)([x])]
    model = pa.table({"key": pa.array([], pa.int64()), "p": pa.array([], pa.float64()), "back": pa.array([], pa.float64())})
    right = kneser_ney.answers(pa.Table.from_batches(asked), model)
    tracemalloc.start()
    out = kneser_ney.score(block, right, ["key"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 2000 and set(out.column("chars").to_pylist()) == {2000}
    assert out.column("bits").to_pylist() == pytest.approx([kneser_ney.math.log2(kneser_ney.UNIVERSE)] * 2000)
    assert peak < 125 * 4_000_000


def test_training_needs_one_worker_a_task(spark, monkeypatch):
    """The texts to be counted are read, not made by another step in Python in the same stage."""
    plans, counts = [], kneser_ney.gram_counts
    monkeypatch.setattr(kneser_ney, "gram_counts", lambda rows: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), counts(rows))[1])
    docs = spark.createDataFrame([(i, f"the river and the stone {i}", "en", "a") for i in range(40)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert kneser_ney.classify(docs, labels).count() == 40
    assert len(plans) == 1 and "MapInArrow" not in plans[0]


def test_sharding_starts_no_python_worker(spark, monkeypatch):
    """Small tables of the driver reach the executors without Python workers of their own."""
    docs = spark.createDataFrame([(i, "copy" if i < 40 else f"text {i} " * (i % 7), "en", "ab"[i % 2]) for i in range(120)], SCHEMA)
    monkeypatch.setattr(spark.sparkContext, "parallelize", None)
    rows = kd_shards(docs, shards=4).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(120)) and {r["shard"] for r in rows} == {0, 1, 2, 3}


def test_windows_of_few_words_are_compared_in_little_memory():
    """Hundreds of windows share their rarest word, and each second word of the text is that word."""
    r = np.random.default_rng(5)
    item, text = r.integers(1, 3, 4000).astype(np.uint64), r.integers(1, 3, 40_000).astype(np.uint64)
    block = decontaminate.Block([("a", item)], 10)
    block.set_prefix(np.array([(text == w).sum() for w in block.vocabulary]))
    tracemalloc.start()
    win, start = block.matches(text, np.zeros(len(text), np.int64), np.full(len(text), len(text)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    of = {w.tobytes(): i for i, w in enumerate(block.word)}
    right = {(of[k], s) for s in range(len(text) - 9) if (k := text[s : s + 10].tobytes()) in of}
    assert len(win) == len(right) and set(zip(win.tolist(), start.tolist(), strict=True)) == right
    assert peak < 40_000_000
