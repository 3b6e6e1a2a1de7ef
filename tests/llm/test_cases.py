"""Defined cases of the corpus operators: very long texts, ties, repeated rows, clashing columns, empty tables, and the pipeline's stages by brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clonoframe.llm import language
from clonoframe.llm.decontaminate import decontaminate
from clonoframe.llm.jaccard import near_duplicates
from clonoframe.llm.kneser_ney import keep_good
from clonoframe.llm.language import identify_held_out
from clonoframe.llm.mixing import mix_sources
from clonoframe.llm.quality_rules import quality_rules
from clonoframe.llm.secrets import scan_secrets
from clonoframe.llm.sharding import kd_shards
from clonoframe.llm.token_counts import count_tokens
from clonoframe.llm.wrappers import extract_pages

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Columns with the names that operators and stages use inside.
CLASH = "c0 string, c1 long, key string, k long, n string, t string, text_hash long, cell long, drop string, copy long, model string, lang2 string, _key string, _k string, _bits string, _text string, _rank long, size string, place string, doc string, hash string"


def table(spark, rows):
    """rows: doc_id, text, lang, source; with every clashing column."""
    extra = (None, 1, "x", 2, "n", "t", 3, 4, "d", 5, "m", "l", "q", "z", "b", "w", 6, "s", "p", "o", "h")
    return spark.createDataFrame([(*r[:4], len(r[1] or ""), *extra) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


def base_spans(t):
    """The base kinds, by Python's scanner."""
    found = []
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for rank, (kind, pattern, group, least) in enumerate((("assign", assign, 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32))):
        found += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t) if len(m[group]) >= least]
    return [s for *_, s in sorted(found)]


def test_secrets_against_a_scanner(spark):
    r = random.Random(11)
    bits = ["password", "Secret", "TOKEN", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abcdefgh", "A1b2C3d4", "AKIA", "QWERTY12345678", "deadbeef" * 4, "0123456789abcdef" * 2, "é", "漢", "\n", "-", "_", "/", "."]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(400)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(5, texts[5], "en", "s")]
    got = scan_secrets(table(spark, rows)).collect()
    assert len(got) == 401
    for x in got:
        want = base_spans(texts[x["doc_id"]])
        assert x["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[x["doc_id"]]
        assert set(want) <= set(x["spans"].split(",")) | {""}
        assert [x["n_assign"], x["n_access"], x["n_hex"]] == [sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex")]


def test_secrets_in_very_long_runs(spark):
    n = 1_000_000
    runs = ["a-" * (n // 2) + "b12c", "a/1" * (n // 3), "Z" * n, "0" * n, "0f" * (n // 2), "-" * n + "9x", "password=" + "q" * n, "token" + " " * n + "=abcdefgh", "AKIA" * (n // 4), "=" * n + "1", "a1" * 1000 + " " * n]
    got = {x["doc_id"]: x for x in scan_secrets(table(spark, [(i, t, None, None) for i, t in enumerate(runs)])).collect()}
    for i, t in enumerate(runs):
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest(), i


def test_language_sums_all_segmentations():
    r = random.Random(2)
    pieces = sorted({bytes([b]) for b in range(256)} | {b"ab", b"abc", b"ba", b" a", b"abcabcabcabca", b"bcab", b"aaaa", b"abababababab"})
    p = np.array([[r.random(), r.random()] for _ in pieces])
    p /= p.sum(0)
    model, number = language.Model(pieces, ["x", "y"], p), {q: i for i, q in enumerate(pieces)}

    def by_places(w):
        logs = [[0.0, 0.0]]
        for j in range(1, len(w) + 1):
            terms = [[logs[j - k][c] + math.log(p[number[w[j - k : j]]][c]) for k in range(1, min(j, 30) + 1) if w[j - k : j] in number] for c in range(2)]
            logs.append([max(t) + math.log(sum(math.exp(a - max(t)) for a in t)) for t in terms])
        return logs[-1]

    words = [b" " + bytes(r.choice(b"abc") for _ in range(n)) for n in (1, 5, 20, 31, 32, 40, 100, 700)] + [b" " + b"a" * 90, b" " + bytes(r.randrange(256) for _ in range(500))]
    for w, got in zip(words, model.score(words), strict=True):
        assert np.allclose(got, by_places(w), rtol=1e-9)

    def segmentations(w):
        for k in range(1, len(w) + 1):
            if w[:k] in number:
                yield from ([w[:k], *s] for s in segmentations(w[k:])) if k < len(w) else [[w]]

    one, w = np.append(p[:, 0], 0), b" abcabab"
    want = np.zeros(len(pieces))
    for s in segmentations(w):
        for q in s:
            want[number[q]] += math.prod(one[number[q]] for q in s)
    want /= sum(math.prod(one[number[q]] for q in s) for s in segmentations(w))
    kept = language.LONG
    for language.LONG in (kept, 3):
        parts = [language._expected(model.lattice.pieces_of(x), x.shape[1], one, np.ones(len(who)), len(pieces) + 1) for who, x in model.lattice.parts([w])]
        assert np.allclose(sum(parts)[:-1], want)
    language.LONG = kept


def test_language_of_long_words_and_clashes(spark):
    r = random.Random(4)
    letters = {"ja": "あいうえおかきくけこさし", "ko": "가나다라마바사아자차카타"}
    rows = [(i, "".join(r.choice(letters[v]) for _ in range(200)), v, "s") for i in range(120) for v in [("ja", "ko")[i % 2]]]
    rows += [(500, "".join(r.choice(letters["ja"]) for _ in range(30_000)), None, "s"), (501, "z" * 100_000, None, "s"), (0, *rows[0][1:])]
    got = [(x["doc_id"], x["lang_pred"]) for x in identify_held_out(table(spark, rows), PIECES).collect()]
    assert len(got) == 123 and {k: v for k, v in got if k < 500} == {i: ("ja", "ko")[i % 2] for i in range(120)} and dict(got)[500] == "ja" and dict(got)[501] in ("ja", "ko")


def targets(sizes):
    """Capped shares by weight, by rounds over plain numbers."""
    names = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    weight = {k: (1, 2, 3)[i % 3] for i, k in enumerate(names)}
    full = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[k] for k in full)
        free = sum(weight[k] for k in names if k not in full)
        over = {k for k in names if k not in full and rest * weight[k] / free > 3 * sizes[k]} if free else set()
        if not over:
            return {k: 3 * sizes[k] if k in full else rest * weight[k] / free for k in names}
        full |= over


def test_mixing_targets(spark):
    r = random.Random(8)
    rows = [(i, " ".join("w" * (1 + k % 3) for k in range(int(math.exp(r.uniform(0, 6))))), "en", r.choice([None, "é", "a", "b", "B", "tiny" if i < 40 else "a"])) for i in range(800)] + [(1000, None, "en", "empty"), (1001, "", None, None)]
    rows += [rows[7]] * 3
    got = mix_sources(table(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, source = targets(sizes), {k: s for k, _, _, s in rows}
    taken = Counter()
    for x in got:
        s = source[x["doc_id"]]
        assert x["source_size"] == sizes[s] and abs(x["target"] - want[s]) < 1e-6 and x["taken"] <= 3 * x["size"]
        taken[s] += x["taken"]
    assert all(abs(taken[s] - t) <= 0.02 * t + 1 for s, t in want.items()), (taken, want)


def test_shards_against_plain_figures(spark):
    r = random.Random(9)
    rows = [(i, "".join(r.choice("abé漢 ") for _ in range(r.randrange(400))), r.choice([None, "en", "de"]), r.choice(["https://a.example/x", "https://a.example/y", "語", None, "z"])) for i in range(1500)]
    rows += [(2000 + i, "copy of one text", "en", "z") for i in range(40)] + [(3000, None, None, None), (3001, "", "en", "z"), (1, *rows[1][1:])]
    got = kd_shards(table(spark, rows), shards=8).collect()
    text = {k: t or "" for k, t, _, _ in rows}
    load, of = Counter(), defaultdict(set)
    for x in got:
        b = text[x["doc_id"]].encode()
        assert (x["size"], x["text_crc32"], x["law"], x["grown_shard"]) == (len(b) + 1, zlib.crc32(b), "bytes", None)
        load[x["shard"]] += x["size"]
        of[text[x["doc_id"]]].add(x["shard"])
    assert len(got) == len(rows) and set(load) == set(range(8)) and max(map(len, of.values())) == 1
    mean = sum(load.values()) / 8
    assert max(load.values()) - mean < 0.05 * mean and mean - min(load.values()) < 0.05 * mean
    for s in range(8):
        assert sorted(x["slot"] for x in got if x["shard"] == s) == list(range(sum(x["shard"] == s for x in got)))


def test_shards_of_one_large_group(spark):
    rows = [(i, "the same text " * 3, "en", "s") for i in range(900)] + [(1000 + i, f"other {i}", "en", "s") for i in range(100)]
    load = Counter()
    for x in kd_shards(table(spark, rows), shards=4).collect():
        load[x["shard"]] += x["size"]
    assert set(load) == set(range(4)) and max(load.values()) - min(load.values()) < 0.15 * sum(load.values())


def test_one_key_has_one_component(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "north south east west up down")
    rows = [(1, a), (2, b), (5, a), (5, b), (7, c), (9, ""), (9, c), (None, a)]
    got = sorted(((x["doc_id"], x["component_id"]) for x in near_duplicates(table(spark, [(k, t, None, None) for k, t in rows])).collect()), key=repr)
    assert got == sorted([(1, 1), (2, 1), (5, 1), (5, 1), (7, 7), (9, 7), (9, 9), (None, None)], key=repr)


def test_very_long_texts(spark):
    r = random.Random(12)
    long = " ".join(str(r.randrange(10**6)) for _ in range(150_000))
    near = long + " and a few more words at the end"
    rows = [(1, long, "en", "s"), (2, near, "en", "s"), (3, "x" * 1_000_000, "en", "s"), (4, "short one", "en", "s"), (5, " " * 500_000, "en", "s")]
    docs = table(spark, rows)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_duplicates(docs).collect()} == {1: (len({tuple(w) for w in zip(*[long.split()[i:] for i in range(5)])}), 1), 2: (len({tuple(w) for w in zip(*[near.split()[i:] for i in range(5)])}), 1), 3: (1, 3), 4: (1, 4), 5: (0, 5)}
    bench = spark.createDataFrame([(1, " ".join(long.split()[100_000:100_010])), (2, "short one")], "item_id long, text string")
    assert {x["doc_id"]: (x["n_words"], x["n_hit"]) for x in decontaminate(docs, bench).collect()} == {1: (150_000, 10), 2: (len(near.split()), 10), 3: (1, 0), 4: (2, 2), 5: (0, 0)}
    assert {x["doc_id"]: x["n_bytes"] for x in count_tokens(docs, BPE).collect()} == {k: len(t) for k, t, _, _ in rows}
    assert {x["doc_id"]: x["n_words"] for x in quality_rules(docs).collect()} == {k: len(t.split()) for k, t, _, _ in rows}
    assert {x["doc_id"]: x["size"] for x in kd_shards(docs, shards=2).collect()} == {k: len(t) + 1 for k, t, _, _ in rows}


def test_items_without_an_id_still_hit(spark):
    docs = table(spark, [(1, "one two three", None, None), (2, "four", None, None)])
    bench = spark.createDataFrame([(None, "two"), (7, "Four"), (8, "four")], "item_id long, text string")
    got = {x["doc_id"]: tuple(x)[1:] for x in decontaminate(docs, bench).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {1: (3, 1, 0, sha(""), True), 2: (1, 1, 2, sha("7,8"), True)}


def test_pages(spark):
    html = lambda i, n: "<html><body><nav><a>Home</a></nav>" + "".join(f"<div class=b{k}>block {k}</div>" for k in range(n)) + f"<article><h1>Head {i}</h1>" + "".join(f"<p>part {i} {k}</p>" for k in range(5)) + "</article></body></html>"
    rows = [(i, f"http://h.example/{i}", html(i, 5000), "x", 1) for i in range(7)] + [(3, "http://h.example/3", html(3, 5000), "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _key string, wrapper long")
    want = {i: "\n".join([f"Head {i}", *[f"part {i} {k}" for k in range(5)]]) for i in range(7)}
    got = extract_pages(df).collect()
    assert len(got) == 8 and all(x["text"] == want[x["page_id"]] and x["n_chars"] == len(x["text"]) for x in got)
    assert extract_pages(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(21)
    words = "stone river green window letter machine seven house cloud night walked under before again morning people water light".split()
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    item = prose(14)
    rows = [(i, prose(r.randrange(20, 90)), ("en", "de")[i % 2], ("a", "b", None, "c")[i % 4]) for i in range(150)]
    rows += [(200 + i, rows[i][1] + " changed", *rows[i][2:]) for i in range(20)] + [(300 + i, prose(10) + " " + item + " " + prose(10), "en", "a") for i in range(5)]
    rows += [(400 + i, "".join(r.choice("@#~^%&*§") for _ in range(300)), "en", "b") for i in range(10)] + [(500, None, "en", "a"), (501, "", None, None), rows[60]]
    path = str(tmp_path_factory.mktemp("sf"))
    table(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 150, 2)] + [(400, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("q1", item), ("q2", "no such thing in any document at all here today")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def components_of(texts):
    sets = {}
    for k, t in texts:
        w = WORD.findall(t.lower())
        sets.setdefault(k, set()).update({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if label[a] != label[b] and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_pipeline_stages(spark, corpus):
    """Each stage on what the one before kept, with columns whose names clash."""
    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, path)
    assert good.columns == docs.columns
    kept = [tuple(x) for x in good.collect()]
    ids = {x[0] for x in kept}
    assert not ids & {*range(400, 410), 500, 501} and set(range(150)) - ids <= {x for x in range(150) if x % 2} and len(set(range(150)) - ids) < 8
    by_key = {x[0]: x for x in map(tuple, docs.collect())}
    assert all(x == by_key[x[0]] for x in kept) and Counter(x[0] for x in kept)[rows[-1][0]] == 2

    one = corpus_pipeline.near_duplicate(spark, good, path)
    rest = [tuple(x) for x in one.collect()]
    label = components_of([(x[0], x[1]) for x in kept])
    assert sorted(x[0] for x in rest) == sorted(set(label.values())) and one.columns == docs.columns

    clean = corpus_pipeline.decontamination(spark, one, path)
    item = spark.read.parquet(f"{path}/benchmark.parquet").filter("item_id = 'q1'").first()["text"].split()
    hit = {x[0] for x in rest if any(x[1].split()[i : i + 10] == item[j : j + 10] for i in range(len(x[1].split())) for j in range(5))}
    assert hit and {x["doc_id"] for x in clean.collect()} == {x[0] for x in rest} - hit and clean.columns == docs.columns

    mixed = corpus_pipeline.mixing(spark, clean, path)
    sizes, out = defaultdict(int), Counter()
    for x in clean.collect():
        sizes[x["source"]] += len(x["text"].split())
    for x in mixed.collect():
        out[x["source"]] += len(x["text"].split())
    longest = max(len(x["text"].split()) for x in clean.collect())
    assert mixed.columns == docs.columns and all(abs(out[s] - t) <= longest for s, t in targets(sizes).items())

    shards = corpus_pipeline.sharding(spark, mixed, path).collect()
    text = {x["doc_id"]: x["text"] for x in mixed.collect()}
    assert Counter(x["doc_id"] for x in shards) == Counter(x["doc_id"] for x in mixed.collect())
    assert all(x["size"] == len(text[x["doc_id"]].encode()) + 1 and x["text_crc32"] == zlib.crc32(text[x["doc_id"]].encode()) for x in shards)
    assert all(sorted(x["slot"] for x in shards if x["shard"] == s) == list(range(sum(x["shard"] == s for x in shards))) for s in range(8))
    whole = corpus_pipeline.run(spark, path)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, shards))


def test_pipeline_of_nothing(spark, corpus, tmp_path):
    path, _ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert keep_good(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).filter(F.length("text") > 0).count() == docs.filter(F.length("text") > 0).count()
