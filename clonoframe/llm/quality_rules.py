"""Host-level quality rules, in DataFrame functions only.

Each document is held against a few rules; failures are summed by host (the source column),
the failure rates of hosts are shrunk towards an empirical beta prior fitted over all hosts
by moments, and a host whose shrunk rate is high drops those of its documents that fail a
soft rule. Documents without any failure always stay.

Defined cases: null or empty text has no words and fails the base rules; documents of a
null host form one host; a host with few documents keeps close to the prior; repeated rows
count one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch

MIN_WORDS = 10
REPEATED_PER_100 = 20
WINDOW = 5
#: Soft rules: at most so many symbols and repeated words per 100 words, repeated lines per 100 lines, and mean word length within bounds.
SYMBOLS_PER_100 = 10
SOFT_REPEATED_PER_100 = 10
DUP_LINES_PER_100 = 30
MEAN_WORD = (2.0, 20.0)
#: A host whose shrunk rate of failing documents is above this is a bad host.
HOST_RATE = 0.5


def words_of(text: Column) -> Column:
    """The words of a text (no null) as an array."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def with_repeated_words(df: DataFrame, codes: str, out: str, width: int = WINDOW) -> DataFrame:
    """Adds the words inside windows of `width` that occur twice or more in a text, first occurrence included.

    codes: column with the hashes of the text's words. Windows are compared by 64-bit hashes
    within one text. A text without repeated windows ends at a count of distinct hashes; the
    others sort (hash, place) pairs once: n log n in the text's words, nothing is shuffled.
    """
    n = F.size(codes)
    runs = F.transform(F.slice(codes, 1, F.greatest(n - width + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(codes, i + k) for k in range(1, width)]))
    df = df.withColumn("_runs", runs)
    df = df.withColumn("_again", F.size(F.array_distinct("_runs")) < F.size("_runs"))
    placed = F.array_sort(F.transform("_runs", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn("_placed", F.when(F.col("_again"), placed))
    same = lambda x, j: F.coalesce(F.get("_placed", j)["x"] == x["x"], F.lit(False))
    at = F.array_sort(F.transform(F.filter("_placed", lambda x, j: F.when(j > 0, same(x, j - 1)).otherwise(F.lit(False)) | same(x, j + 1)), lambda x: x["i"]))
    df = df.withColumn("_at", F.when(F.col("_again"), at))
    spans = F.transform("_at", lambda x, j: F.least(F.lit(width), F.coalesce(F.get("_at", j + 1) - x, F.lit(width))).cast("long"))
    total = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn(out, F.coalesce(F.when(F.col("_again"), total), F.lit(0).cast("long"))).drop("_runs", "_again", "_placed", "_at")


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """_key, _host, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words per row, in one map pass."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = words_of(t)
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    one = docs.select(F.col(key).alias("_key"), F.col(host).cast("string").alias("_host"), t.alias("_t"), lines.alias("_lines"), F.transform(words, lambda w: F.xxhash64(w)).alias("_codes"))
    one = with_repeated_words(one, "_codes", "n_repeat_words")
    return one.select(
        "_key", "_host", F.size("_codes").cast("long").alias("n_words"),
        F.char_length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"), "n_repeat_words",
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED_PER_100)


def soft_failed() -> Column:
    mean = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return (
        (F.col("n_symbols") * 100 > F.col("n_words") * SYMBOLS_PER_100)
        | (F.col("n_repeat_words") * 100 > F.col("n_words") * SOFT_REPEATED_PER_100)
        | (F.col("n_dup_lines") * 100 > F.col("n_lines") * DUP_LINES_PER_100)
        | ~mean.between(*MEAN_WORD)
    )


def host_verdicts(rows: DataFrame) -> DataFrame:
    """rows (_host, failed) -> _host, host_docs, host_rate (shrunk), bad_host.

    Prior by moments over the hosts' rates: mean m, variance v, a + b = m (1 - m) / v - 1,
    at least 1; only these two figures reach the driver. The sums by host combine before the
    shuffle, so a hot host costs one row for each task.
    """
    hosts = rows.groupBy("_host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("_k"))
    m, v = hosts.agg(F.avg(F.col("_k") / F.col("host_docs")), F.var_pop(F.col("_k") / F.col("host_docs"))).first()
    m = m or 0.0
    strength = max(1.0, m * (1 - m) / v - 1) if v else 1.0
    rate = (F.col("_k") + F.lit(m * strength)) / (F.col("host_docs") + F.lit(strength))
    return hosts.select("_host", "host_docs", rate.alias("host_rate"), (rate > HOST_RATE).alias("bad_host"))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and host_rate.

    The texts are read once; the narrow features are written to the shared folder, summed by
    host, and joined with the verdicts (a hot host's rows are split by the adaptive join).
    """
    scratch = Scratch(docs.sparkSession, "rules")
    rows = scratch.write(features(docs, key, text, host).withColumn("base_failed", base_failed()).withColumn("failed", base_failed() | soft_failed()), "features")
    hosts = host_verdicts(rows).select(F.col("_host").alias("_of"), "host_rate", "bad_host")
    rows = rows.join(hosts, F.col("_host").eqNullSafe(F.col("_of")), "left")
    kept = ~F.col("base_failed") & ~(F.coalesce("bad_host", F.lit(False)) & F.col("failed"))
    return rows.select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("host_rate", 6).alias("host_rate"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
r AS (SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
p AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM r) WHERE n > 1),
c AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words FROM p GROUP BY doc_id),
f AS (SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
g AS (SELECT *, base_failed OR n_symbols * 100 > n_words * 10 OR n_repeat_words * 100 > n_words * 10
  OR n_dup_lines * 100 > n_lines * 30 OR word_chars / greatest(n_words, 1) NOT BETWEEN 2.0 AND 20.0 AS failed FROM b),
h AS (SELECT source, count(*) AS n, sum(CAST(failed AS INT)) AS k FROM g GROUP BY source),
m AS (SELECT avg(k / n) AS m, var_pop(k / n) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 0 THEN greatest(1.0, m * (1 - m) / v - 1) ELSE 1.0 END AS s FROM m),
z AS (SELECT source, (k + m * s) / (n + s) AS host_rate FROM h, q)
SELECT g.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (host_rate > 0.5 AND failed) AS kept, round(host_rate, 6) AS host_rate
FROM g LEFT JOIN z ON g.source IS NOT DISTINCT FROM z.source
"""
