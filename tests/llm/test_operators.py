"""Corpus operators against brute force on small tables: nulls, empty texts, repeats, clashing columns, empty tables."""

import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clonoframe.llm import decontaminate as leak
from clonoframe.llm.common import Scratch
from clonoframe.llm.components import components
from clonoframe.llm.jaccard import near_duplicates
from clonoframe.llm.kneser_ney import classify, keep_good
from clonoframe.llm.language import identify_held_out
from clonoframe.llm.mixing import mix_sources
from clonoframe.llm.quality_rules import quality_rules
from clonoframe.llm.secrets import scan_secrets
from clonoframe.llm.sharding import kd_shards
from clonoframe.llm.token_counts import Merges, count_tokens
from clonoframe.llm.wrappers import extract_pages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, t string, grp string, _key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = "the of and river stone cloud machine letter house green seven window".split()


def corpus():
    r = random.Random(5)
    texts = [" ".join(r.choice(VOCABULARY) + str(r.randrange(30)) for _ in range(r.randrange(1, 80))) for _ in range(60)]
    for i in range(20):
        w = texts[i].split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += texts[:5] + ["", None, "one", "one", "a b c", "A  B\tc", "spam ham " * 40, "x " * 3000, "line\nline\nline two", "漢字 かな é b"]
    return [(i, t, (None, "en", "de")[i % 3], (None, "a", "b", "a")[i % 4], None, "n", "t", "g", "k") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame(rows + [rows[3]], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_quality_rules(docs, none):
    texts = texts_of(docs)
    for r in quality_rules(docs).collect():
        t = texts[r["doc_id"]] or ""
        w = WORD.findall(t)
        runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        inside = {i + k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))
        assert tuple(r)[1:6] == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(inside) > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality_rules(docs).count() == docs.count() and quality_rules(none).count() == 0


def classes(texts):
    sets = {}
    for k, t in texts.items():
        w = WORD.findall(lower(t))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if sets[a] and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n) and n and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {k: (len(sets[k]), label[k]) for k in sets}


def test_near_duplicates(docs, none):
    want = classes(texts_of(docs))
    got = near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert near_duplicates(none).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 50), (50, 200), (7, 7)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test"), "cc").collect()}
    assert {got[i] for i in range(1, 31)} == {1} and {got[100 + i] for i in range(20)} == {100} and got[200] == 50


def kneser_ney(texts):
    """log2 probability of a character after others, by the recursion over plain counters."""
    from clonoframe.llm.kneser_ney import ORDER, START, UNIVERSE

    pad = chr(START) * (ORDER - 1)
    n = {ORDER: Counter(s[i : i + ORDER] for s in (pad + t for t in texts) for i in range(len(s) - ORDER + 1))}
    for k in range(ORDER - 1, 0, -1):
        n[k] = Counter(g[1:] for g in n[k + 1])
    of = {k: {} for k in n}
    for k, c in n.items():
        for g, v in c.items():
            of[k].setdefault(g[:-1], []).append(v)

    def cuts(c):
        c = Counter(c.values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + 2 * c[2] else 0.5
        return [max(0.05, min(j - 0.05, j - (j + 1) * y * c[j + 1] / c[j] if c[j] else 0.5)) for j in (1, 2, 3)]

    d = {k: cuts(c) for k, c in n.items()}

    def prob(g):
        k = len(g)
        under = prob(g[1:]) if k > 1 else 1 / UNIVERSE
        all_ = of[k].get(g[:-1])
        if not all_:
            return under
        cut = lambda v: d[k][min(v, 3) - 1]
        v = n[k][g]
        return ((v - cut(v)) if v else 0) / sum(all_) + sum(map(cut, all_)) / sum(all_) * under

    return lambda t: -sum(math.log2(prob((pad + t)[i : i + ORDER])) for i in range(len(t))) / len(t)


def test_quality_classifier_against_brute_force(spark, docs, none):
    """Perplexities, limits and verdicts by joins are those of the recursion and of sorted lists."""
    from clonoframe.llm import kneser_ney as kn

    labels = [(i, 1, 0) for i in range(70)] + [(None, 1, 0), (3, 1, 0), (4, 0, 0), (5, 1, 1)]
    junk = [(1000 + i, t, "en" if i % 2 else "xx", "a", None, "n", "t", "g", "k") for i, t in enumerate(("@@!!\x01\x02~~`^^" * 40, "\U0001f600 漢" * 9, "ab" * 50_000, "the river"))]
    all_ = docs.union(spark.createDataFrame(junk, SCHEMA))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = [tuple(r) for r in all_.select("doc_id", "text", "lang").collect()]
    good = set(range(70)) - {4, 5}
    out = {r[0] for r in spark.createDataFrame([(i,) for i in good], "k long").filter(kn._unit(F.col("k"))).collect()}
    taught = [r for r in rows if r[0] in good - out and r[1]]
    models = {v: kneser_ney([t for _, t, lang in taught if lang == v or v is None]) for v in ("en", "de", None)}
    figure = [(k, t, lang if lang in models else None, models[lang if lang in models else None](t) if t else None) for k, t, lang in rows]

    def quantile(x, q, bins):
        b = sorted(math.floor(v * bins) for v in x)
        return (b[math.ceil(len(b) * q - 1e-9) - 1] + 1) / bins

    def cut(v, n):
        x = [(f, len(t)) for k, t, m, f in figure if k in out and t and (m == v or v is None)]
        middle = quantile([f for f, _ in x], 0.5, kn.BINS)
        return max(quantile([f for f, _ in x], kn.QUANTILE, kn.BINS), middle + quantile([(f - middle) * math.sqrt(c) for f, c in x], kn.QUANTILE, kn.WIDE_BINS) / math.sqrt(n))

    got = sorted(classify(all_, table).collect(), key=lambda r: (r["doc_id"], r["n_chars"]))
    figure.sort(key=lambda r: (r[0], len(r[1] or "")))
    assert [(r["doc_id"], r["n_chars"]) for r in got] == [(k, len(t or "")) for k, t, _, _ in figure]
    for r, (_, t, m, f) in zip(got, figure, strict=True):
        if not t:
            assert r["perplexity"] is None and r["threshold"] is None and not r["kept"]
            continue
        limit = cut(None, len(t)) if m is None else max(cut(m, len(t)), cut(None, len(t)))
        assert abs(math.log2(r["perplexity"]) - f) < 1e-5 and abs(math.log2(r["threshold"]) - limit) < 1e-3
        assert r["kept"] == (f <= limit)
    assert not {1000, 1001} & {r["doc_id"] for r in got if r["kept"]}
    kept = keep_good(all_, table)
    assert kept.columns == all_.columns and sorted(map(tuple, kept.select("doc_id", "text", "n", "_key").collect()), key=repr) == sorted([(k, t, "n", "k") for (k, t, _, _), r in zip(figure, got, strict=True) if r["kept"]], key=repr)
    assert classify(none, table).count() == 0 and keep_good(none, table).columns == none.columns
    assert classify(docs, table.limit(0)).filter("kept").count() == docs.filter("length(text) > 0").count()


def test_quality_classifier_reads_past_a_word(spark):
    """Words of the trained language in an order that it doesn't have score worse."""
    r = random.Random(7)
    good = lambda: " ".join(f"{a} {b}" for a, b in (r.choice([("a", "sea"), ("an", "oak"), ("the", "tree"), ("to", "go")]) for _ in range(60)))
    rows = [(i, good(), "en") for i in range(60)] + [(100 + i, " ".join(r.choice(["a", "an", "the", "to"]) + " " + r.choice(["sea", "oak", "tree", "go"]) for _ in range(60)), "en") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in classify(docs, spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")).collect()}
    assert max(got[i]["perplexity"] for i in range(40, 60)) < min(got[100 + i]["perplexity"] for i in range(3)) / 1.15


def test_mixing(docs, none):
    got = mix_sources(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix_sources(docs).collect()), key=repr)
    texts = texts_of(docs)
    sizes = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        assert r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-6
    of = {}
    for r in got:
        of.setdefault((r["source_size"], r["target"]), []).append(r)
    assert abs(sum(t for _, t in of) - sum(r["size"] for r in got)) < 1e-6
    for (_, target), rs in of.items():
        assert abs(sum(r["taken"] for r in rs) - target) <= max(r["size"] for r in rs)
    assert texts and mix_sources(none).count() == 0


def test_decontamination(spark, docs, none):
    texts = texts_of(docs)
    long = next(t for t in texts.values() if t and len(t.split()) > 30)
    items = [(1, " ".join(long.split()[3:25])), (2, "one"), (3, None), (4, "!!"), (5, "B c"), (None, "seven"), (5, "B c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    for block in (500_000, 5):
        leak.BLOCK, before = block, leak.BLOCK
        got = leak.decontaminate(docs, bench).collect()
        leak.BLOCK = before
        assert len(got) == docs.count()
        for r in got:
            w, hit, names = find(lower(texts[r["doc_id"]])), set(), set()
            for name, t in items:
                x = find(lower(t))
                if name is None or not x:
                    continue
                for run in {tuple(x[i : i + 10]) for i in range(max(1, len(x) - 9))}:
                    for i in range(len(w) - len(run) + 1):
                        if tuple(w[i : i + len(run)]) == run:
                            hit.update(range(i, i + len(run)))
                            names.add(str(name))
            sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
            assert tuple(r) == (r["doc_id"], len(w), len(hit), len(names), sha, bool(hit))
    assert leak.decontaminate(none, bench).count() == 0 and leak.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_token_counts(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = texts_of(docs)
    for r in count_tokens(docs, path).collect():
        x = texts[r["doc_id"]] or ""
        n = len(t.encode(x, add_special_tokens=False).ids)
        assert tuple(r) == (r["doc_id"], len(x.encode()), n, n > 512)
    assert count_tokens(none, path).count() == 0
    assert Merges(path).count([b"a" * 1000]).tolist() == [len(t.encode("a" * 1000, add_special_tokens=False).ids)]


def test_secrets(spark, none):
    schema = "doc_id long, text string"
    rows = [(1, "é token = \"abcdefgh1\" x"), (2, None), (3, "token=api_key: longvalue123"), (4, "AKIA" + "Q" * 11 + " AKIA" + "Z9" * 8), (5, "0" * 31 + " " + "deadbeef" * 4), (6, "id 123e4567-e89b-12d3-a456-426614174000 k9Xz7Qw2Lm4Rt8Vb1Nc5"), (7, "password: 12345678," * 700)]
    got = {r["doc_id"]: r for r in scan_secrets(spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["spans"] == "assign:2:20" and got[2]["spans"] == "" and got[3]["n_assign"] == 0
    assert got[4]["n_access"] == 1 and got[5]["n_hex"] == 1 and got[7]["n_assign"] == 700
    assert got[6]["spans"].split(":")[0] == "entropy_base64" and "," not in got[6]["spans"]
    assert got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and scan_secrets(none).count() == 0


def test_wrappers(spark):
    page = lambda i: f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a>Menu</a></nav><div class='cookie notice'>ok?</div><article><h1>Head {i}</h1><p>One &amp;\n two {i}<p>Three<b> {i}</b><div class='comments'><p>me too</p></div></article><aside>side</aside><script>x='<p>'</script><footer>foot</footer></body></html>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(8)] + [(8, None, page(8)), (9, "http://h.example/x", None), (10, "http://h.example/x", "plain text"), (0, "http://h.example/0", page(0))]
    got = [tuple(r) for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    want = {i: f"Head {i}\nOne & two {i}\nThree {i}" for i in range(9)} | {9: "", 10: "plain text"}
    assert len(got) == 12 and all(t == want[i] and n == len(t) for i, _, t, n in got)


def pages_text(spark, rows):
    """The text by page of rows (host, html)."""
    df = spark.createDataFrame([(i, f"http://{h}/{i}", x) for i, (h, x) in enumerate(rows)], "page_id long, url string, html string")
    return [r["text"] for r in sorted(extract_pages(df).collect(), key=lambda r: r["page_id"])]


def test_wrappers_decide_without_names(spark):
    plain = lambda i: f"<body><div class=x1><div class=x2>Start Help</div><div class=x3><h1>Head {i}</h1><p>Text {i}</p><div class=q>Buy our lamp</div><p>More {i}</p></div></div></body>"
    named = lambda i: f"<body><article><h1>Head {i}</h1><p>Text {i}</p><div class=q>Buy our lamp</div><p>More {i}</p></article><div>Start Help</div></body>"
    rows = [("plain.example", plain(i)) for i in range(8)] + [("named.example", named(i)) for i in range(8)] + [("copies.example", named(7))] * 8 + [("few.example", named(i)) for i in range(2)]
    got = pages_text(spark, rows)
    want = [f"Head {i}\nText {i}\nMore {i}" for i in range(8)]
    assert got[:16] == want * 2
    assert got[16:24] == ["Head 7\nText 7\nBuy our lamp\nMore 7"] * 8
    assert got[24:] == [f"Head {i}\nText {i}\nBuy our lamp\nMore {i}" for i in range(2)]


def test_wrappers_keep_whole_articles(spark):
    pages = [
        ("<body><div class=post><h1>T</h1><p>intro</p><section><p>a long section of text</p></section></div></body>", "T\nintro\na long section of text"),
        ("<h1>T</h1><p>a</p><p>b</p>", "T\na\nb"),
        ("<body><article class=teaser><p>see</p></article><div id=content><h1>T</h1><p>a long text</p></div></body>", "see\nT\na long text"),
        ("<body><div class='content has-sidebar'><h1>T</h1><p>a</p></div><div class='cookie-banner'>ok?</div></body>", "T\na"),
        ("<body><div class=layout-nav><p>a</p><ul><li>b<li>c</ul></div><div class=footer2>x</div></body>", "a\nb\nc"),
        ("<body>" + "".join(f"<div class=c{i}><p>part {i}</p></div>" for i in range(500)) + "</body>", "\n".join(f"part {i}" for i in range(500))),
    ]
    got = pages_text(spark, [(f"h{i}.example", x) for i, (x, _) in enumerate(pages)])
    assert got == [want for _, want in pages]


def test_sharding(docs, none):
    got = kd_shards(docs, shards=4).collect()
    assert len(got) == docs.count()
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert {r["law"] for r in got} == {"bytes"} and kd_shards(none).count() == 0


def test_language(spark, none):
    r = random.Random(3)
    of = {"en": "the of and with that have this from".split(), "de": "der und das nicht mit schön über eine".split()}
    rows = [(i, " ".join(r.choice(of[v]) for _ in range(30)), v if i % 7 else None, v) for i in range(300) for v in [("en", "de")[i % 2]]]
    rows += [(1000, None, "en", "en"), (1001, "123 — !!", "de", "de"), (1002, "", None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x["doc_id"]: x for x in identify_held_out(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert all(got[i]["lang_pred"] == v for i, _, _, v in rows[:300])
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert identify_held_out(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, sf)
    assert kept.columns == docs.columns
    one = corpus_pipeline.near_duplicate(spark, kept, sf).cache()
    label = classes({x["doc_id"]: x["text"] for x in kept.collect()})
    assert sorted(x["doc_id"] for x in one.collect()) == sorted({v for _, v in label.values()})
    mixed = corpus_pipeline.mixing(spark, one, sf)
    taken = {x["doc_id"]: x["copies"] for x in mix_sources(one).collect()}
    assert Counter(x["doc_id"] for x in mixed.collect()) == Counter({k: n for k, n in taken.items() if n})
    shards = corpus_pipeline.sharding(spark, mixed, sf)
    assert shards.count() == sum(taken.values()) and shards.select("shard").distinct().count() == 8
