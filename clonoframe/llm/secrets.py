"""Secret scans, in DataFrame functions only.

Base patterns give assignments, access keys and long hexadecimal runs. Besides them, runs
of key-like characters are held against the Shannon entropy of a window that slides over
them, for each character class: the window's character counts and the sum of c log2 c are
carried from place to place and changed by the character that enters and the one that
leaves. A run whose best window is above its class's threshold is added unless an
allow-list knows it. Positions are code points, ends exclusive.

Defined cases: null or empty text has no spans (the digest is that of the empty string);
repeated rows give repeated results; an empty table gives no rows; extra columns are ignored.
Work is linear in a text's length, times the alphabet inside candidate runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, the least length (of the value, or the match), in the order that breaks ties.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
HEX_LEAST = 32
#: Runs of key-like characters with a digit; the class's alphabet; bits in a window of WINDOW characters that make a secret.
RUN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
CLASSES = {"entropy_hex": ("0123456789abcdef", 3.0), "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=", 3.9)}
#: Runs that are no secrets: UUIDs, digests in resource hashes, numbers and dates, paths of plain words, placeholders.
ALLOWED = "|".join((
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", r"^sha(1|256|384|512)[-=]", r"^[0-9+/_=-]+$",
    r"(?i)example|sample|placeholder|x{6,}|0123456789|abcdefghij",
))
#: Paths of plain words and short numbers have these characters and none of these sequences. (No pattern here repeats a group: such a loop takes a stack frame for each round.)
PATH, NO_PATH = r"^[A-Za-z0-9/_-]+$", r"^[0-9]|[A-Za-z][0-9]|[0-9][A-Za-z]|[0-9]{5}"

_ARRAY = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _nothing() -> Column:
    return F.array().cast(_ARRAY)


def spans(text: Column, pattern: str, kind: str, rank: int, least: int, group: int) -> Column:
    """Spans of the leftmost non-overlapping matches whose group has `least` characters.

    The matches and the gaps between them (the split) alternate; one pass over both sums
    their lengths. Finished blocks of 256 spans are set aside, so that long lists aren't
    copied for each match.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    steps = F.zip_with(F.zip_with(F.split(text, pattern, -1), whole, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("n"))), F.transform(value, F.char_length), lambda s, v: F.struct(s["gap"].alias("gap"), s["n"].alias("n"), v.alias("v")))
    start = F.struct(F.lit(0).alias("at"), _nothing().alias("some"), F.array().cast(f"array<{_ARRAY}>").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        at = acc["at"] + s["gap"]
        one = F.array(F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + F.coalesce(s["n"], F.lit(0))).alias("end"), F.lit(kind).alias("kind")))
        full = F.size(acc["some"]) >= 256
        found = s["v"] >= least  # null after the last gap
        some = F.when(found, F.when(full, one).otherwise(F.concat(acc["some"], one))).otherwise(acc["some"])
        done = F.when(found & full, F.concat(acc["done"], F.array(acc["some"]))).otherwise(acc["done"])
        return F.struct((at + F.coalesce(s["n"], F.lit(0))).alias("at"), some.alias("some"), done.alias("done"))

    return F.aggregate(steps, start, step, lambda acc: F.concat(F.flatten(acc["done"]), acc["some"]))


def _weight(c: Column) -> Column:
    """c log2 c from a table of the few counts that a window can have."""
    return F.element_at(F.array(*[F.lit(k * math.log2(k) if k else 0.0) for k in range(WINDOW + 1)]), c + 1)


def best_window(codes: Column, letters: int) -> Column:
    """The highest entropy, in bits, of a window sliding over an array of codes in 0..letters-1."""
    zero = F.array_repeat(F.lit(0), letters)
    state = F.struct(zero.alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def step(acc: Column, i: Column) -> Column:
        new = F.get(codes, i)
        old = F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(-1))
        grown, gone = F.get(acc["n"], new), F.when(old >= 0, F.get(acc["n"], F.greatest(old, F.lit(0)))).otherwise(F.lit(0))
        moved = acc["s"] + F.when(new == old, F.lit(0.0)).otherwise(_weight(grown + 1) - _weight(grown) + F.when(old >= 0, _weight(gone - 1) - _weight(gone)).otherwise(F.lit(0.0)))
        n = F.transform(acc["n"], lambda v, j: v + F.when(j == new, 1).otherwise(0) - F.when(j == old, 1).otherwise(0))
        bits = F.when(i >= WINDOW - 1, F.lit(math.log2(WINDOW)) - moved / WINDOW).otherwise(F.lit(0.0))
        return F.struct(n.alias("n"), moved.alias("s"), F.greatest(acc["best"], bits).alias("best"))

    return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), state, step, lambda acc: acc["best"])


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_assign, n_access, n_hex, base_sha256, spans, n_entropy. One map pass, no shuffle."""
    df = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    t = F.col("_t")
    df = df.select(
        "_key",
        F.when(t.rlike(ASSIGN), t).alias("_ta"), F.when(t.contains("AKIA"), t).alias("_tk"),
        F.when(t.rlike(f"[0-9a-f]{{{HEX_LEAST},}}"), t).alias("_th"), F.when(t.rlike(RUN), t).alias("_tr"),
    )
    none = lambda c: F.coalesce(c, _nothing())
    df = df.select(
        "_key", "_tr",
        none(spans(F.col("_ta"), ASSIGN, "assign", 0, 8, 1)).alias("_a"), none(spans(F.col("_tk"), ACCESS, "access", 1, 16, 0)).alias("_k"),
        none(spans(F.col("_th"), f"[0-9a-f]{{{HEX_LEAST},}}", "hex", 2, HEX_LEAST, 0)).alias("_h"),
        none(spans(F.col("_tr"), RUN, "run", 3, WINDOW, 0)).alias("_runs"), F.coalesce(F.regexp_extract_all("_tr", F.lit(RUN), F.lit(0)), F.array().cast("array<string>")).alias("_s"),
    )
    hexa = lambda s: s.rlike("^([0-9a-f]+|[0-9A-F]+)$")
    runs = F.zip_with("_runs", "_s", lambda r, s: F.struct(r["start"].alias("start"), r["end"].alias("end"), s.alias("s"), hexa(s).alias("hex")))
    runs = F.filter(runs, lambda r: ~(r["s"].rlike(ALLOWED) | r["s"].rlike(PATH) & ~r["s"].rlike(NO_PATH)))
    letters = {k: a for k, (a, _) in CLASSES.items()}
    coded = F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["hex"].alias("hex"), F.transform(
        F.split(F.when(r["hex"], F.lower(r["s"])).otherwise(r["s"]), ""),
        lambda ch: F.when(r["hex"], F.instr(F.lit(letters["entropy_hex"]), ch)).otherwise(F.instr(F.lit(letters["entropy_base64"]), ch)) - 1).alias("codes")))
    df = df.withColumn("_coded", coded)
    limit = lambda r: F.when(r["hex"], F.lit(CLASSES["entropy_hex"][1])).otherwise(F.lit(CLASSES["entropy_base64"][1]))
    hot = F.filter("_coded", lambda r: F.when(r["hex"], best_window(r["codes"], 16)).otherwise(best_window(r["codes"], len(letters["entropy_base64"]))) >= limit(r))
    added = F.transform(hot, lambda r: F.struct(r["start"].alias("start"), F.when(r["hex"], 3).otherwise(4).alias("rank"), r["end"].alias("end"), F.when(r["hex"], "entropy_hex").otherwise("entropy_base64").alias("kind")))
    df = df.withColumn("_base", F.array_sort(F.concat("_a", "_k", "_h"))).withColumn("_added", added.cast(_ARRAY))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return df.select(
        F.col("_key").alias(key), F.size("_a").cast("long").alias("n_assign"), F.size("_k").cast("long").alias("n_access"), F.size("_h").cast("long").alias("n_hex"),
        F.sha2(told(F.col("_base")), 256).alias("base_sha256"), told(F.array_sort(F.concat("_base", "_added"))).alias("spans"), F.size("_added").cast("long").alias("n_entropy"),
    )
