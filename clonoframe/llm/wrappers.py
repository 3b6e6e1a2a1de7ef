"""Main text of web pages by wrappers inferred for each host (union-free regular expressions).

A page is a stream of blocks, each with the path of its open elements. Repeated runs fold into
repeated groups. The streams of one host are aligned one after the other with the wrapper so
far: blocks that match keep their text if it is equal, or else become text slots; blocks that
only one side has become optional. Wrappers of parts of a host are aligned in the same way, so
they are built in each task and merged afterwards: a hot host costs one small row a task.

The wrapper tells the region that holds the text slots of the article; a page's blocks inside
it are its text, without subtrees that are navigation, notices, adverts, forms or comments,
and without blocks outside repeated groups, in the region or not, whose text is the same on
all pages that have them, if those are AGREE different pages or more (copies of a page count once).

Defined cases: null or empty html gives an empty text; a page without a usable host has a
wrapper of its own; a page that its wrapper doesn't fit is read by itself; unclosed and
stray tags are tolerated; repeated rows give repeated results; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import difflib
import hashlib
import html as _html
import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|textarea|select|iframe|title)\b[^>]*>.*?(?:</\1\s*>|$)|<![^>]*>|<\?[^>]*>|</?([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins del kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
BOILER = frozenset("nav header footer aside form button menu dialog fieldset head".split())
_NAMES = r"(?:ads?|advert\w*|adverti[sz]ement|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|comments?|replies|reply|disqus|respond|sidebar|side|widget\w*|menu\w*|nav\w*|breadcrumbs?|pager|pagination|toolbar|topbar|masthead|header|footer|foot|copyright|legal|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|skip|toc|complementary|navigation|contentinfo)"
#: Whole class, id or role tokens: one listed name or several (cookie-banner, side_menu2), but not has-sidebar or layout-nav.
_BOILER_NAME = re.compile(rf"{_NAMES}(?:[_-]{_NAMES})*[_\d-]*")
#: Elements that a start tag of the same kind closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Different pages that must agree before an equal text outside repeated groups counts as part of the template.
AGREE = 5
#: A wrapper with more blocks than this folds again, as a page does; nothing of it is cut.
LONG = 400
_BLOCK_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def blocks(page: str) -> list[tuple[tuple[str, ...], str, bool]]:
    """The text blocks of a page in order: path of open block elements (tag.class), text, and whether an element around it is boilerplate."""
    out: list = []
    stack: list[tuple[str, str, bool]] = []  # tag, label, boilerplate
    text: list[str] = []

    def flush():
        t = " ".join(_html.unescape("".join(text)).split())
        text.clear()
        if t:
            out.append((tuple(label for tag, label, _ in stack if tag not in INLINE), t, any(b for _, _, b in stack)))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        inline = tag in INLINE
        if m[0].startswith("</"):
            if not inline:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if inline and stack[i][0] not in INLINE:
                    break
            continue
        if tag == "br":
            text.append(" ")
            continue
        if not inline:
            flush()
            if tag in _BLOCK_ENDS_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] not in INLINE:
                        break
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES.get(tag, ()):
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        if tag in VOID or m[0].endswith("/>"):
            continue
        names = " ".join(v.strip("\"'").lower() for _, v in _ATTR.findall(m[3] or ""))
        inside = any(t == "article" for t, _, _ in stack)
        boiler = tag in BOILER and not (tag == "header" and inside) or any(map(_BOILER_NAME.fullmatch, names.split())) and tag not in ("body", "html", "main", "article")
        stack.append((tag, f"{tag}.{names.split()[0]}" if names else tag, boiler))
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def stream(page_blocks: list) -> list[list]:
    """The folded stream of a page: [path, text or None for a slot, repeated, optional, pages, characters outside boilerplate].

    Runs of one path, and of two or three alternating paths, fold into repeated groups. Pages
    are hashes of all blocks of a page, AGREE of them at most.
    """
    page = int.from_bytes(hashlib.blake2b(repr(page_blocks).encode("utf-8", "replace"), digest_size=6).digest(), "little")
    return fold([["/".join(p), t, False, False, [page], 0 if b else len(t)] for p, t, b in page_blocks])


def fold(items: list[list]) -> list[list]:
    for period in (1, 2, 3):
        out: list = []
        for x in items:
            out.append(x)
            while len(out) >= 2 * period and all(out[-i][0] == out[-i - period][0] for i in range(1, period + 1)):
                for i in range(period, 0, -1):
                    a, b = out[-i - period], out[-i]
                    a[4] = sorted({*a[4], *b[4]})[:AGREE]
                    a[5] += b[5]
                    a[1], a[2], a[3] = None, True, a[3] and b[3]
                del out[-period:]
        items = out
    return items


def align(wrapper: list[list], other: list[list]) -> list[list]:
    """Merges two wrappers (or a wrapper and a page's stream): equal blocks stay, unequal texts become slots, blocks of one side optional."""
    if not wrapper:
        return other
    out: list = []
    a, b = [x[0] for x in wrapper], [x[0] for x in other]
    for op, i, j, k, n in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            for x, y in zip(wrapper[i:j], other[k:n], strict=True):
                out.append([x[0], x[1] if x[1] == y[1] else None, x[2] or y[2], x[3] or y[3], sorted({*x[4], *y[4]})[:AGREE], x[5] + y[5]])
        else:
            out += [[*x[:3], True, *x[4:]] for x in (*wrapper[i:j], *other[k:n])]
    return fold(out) if len(out) > LONG else out


def constant(x: list) -> bool:
    """Whether a wrapper's block is part of the template: one text on enough different pages, outside repeated groups."""
    return x[1] is not None and not x[2] and len(x[4]) >= AGREE


def decided(wrapper: list[list]) -> tuple[str, set]:
    """What a wrapper says of its pages: the region, and the template's blocks (path, text)."""
    return region(wrapper), {(x[0], x[1]) for x in wrapper if constant(x)}


def region(wrapper: list[list]) -> str:
    """The path of the element that holds the article: an article or main element if it has most of the
    text slots' characters, or else the lowest element around all text slots (none: the empty path)."""
    slots = [(x[0].split("/"), x[5]) for x in wrapper if x[5] and not constant(x)]
    size: Counter = Counter()
    for parts, n in slots:
        for i, label in enumerate(parts):
            if label.split(".")[0] in ("article", "main"):
                size["/".join(parts[: i + 1])] += n
    total = sum(n for _, n in slots)
    if named := [p for p, n in size.items() if 2 * n >= total]:
        return max(named, key=lambda p: (size[p], p.count("/"), p))
    top = slots[0][0] if slots else []
    for parts, _ in slots:
        top = top[: next((i for i, (a, b) in enumerate(zip(top, parts)) if a != b), min(len(top), len(parts)))]
    return "/".join(top)


def extract(page: str, of: tuple[str, set] | None) -> str:
    """The main text of a page by what its wrapper decided (None: by the page itself)."""
    own = blocks(page)
    if not own:
        return ""
    for top, fixed in (of, decided(stream(own))) if of else (decided(stream(own)),):
        # Headers and asides inside the article's element are boilerplate as well; the article's own ones aren't above it.
        inside = [t for p, t, b in own if (not top or ("/".join(p) + "/").startswith(top + "/")) and not b and ("/".join(p), t) not in fixed]
        if inside:
            return "\n".join(inside)
    return ""


def _host(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: key, url, text, n_chars. Two passes over the pages.

    What the wrappers decided is joined by host: by broadcast while the optimizer finds its
    table small, or else by a shuffle of the pages, in which the adaptive join splits a hot host.
    """
    scratch = Scratch(pages.sparkSession, "wrappers")
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.lower(_host(F.col(url))).alias("_host"), F.col(html).alias("_html"))

    def infer(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if page and host:
                    held[host] = align(held.get(host, []), stream(blocks(page)))
                    if len(held) > 5000:
                        yield _rows(held)
                        held.clear()
        yield _rows(held)

    def _rows(held):
        return pa.RecordBatch.from_pydict({"_host": pa.array(list(held), pa.string()), "wrapper": pa.array([json.dumps(w) for w in held.values()], pa.string())})

    def merge(key, t):
        w: list = []
        for x in sorted(t.column("wrapper").to_pylist()):
            w = align(w, json.loads(x))
        top, fixed = decided(w)
        return pa.table({"_of": pa.array([key[0].as_py()]), "wrapper": pa.array([json.dumps([top, sorted(fixed)])])})

    found = rows.select("_host", "_html").mapInArrow(infer, "_host string, wrapper string").groupBy("_host").applyInArrow(merge, "_of string, wrapper string")
    found = scratch.write(found, "wrappers")

    def apply(batches):
        known: dict[str, list] = {}
        for batch in batches:
            for part in chunks(batch, "_html", 4 << 20):
                out = []
                for page, w in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if w is not None and w not in known:
                        if len(known) > 1000:
                            known.clear()
                        top, fixed = json.loads(w)
                        known[w] = top, {(p, t) for p, t in fixed}
                    out.append(extract(page or "", known.get(w)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["_key", "_url", "text", "n_chars"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    joined = rows.join(found, F.col("_host") == F.col("_of"), "left").select("_key", "_url", "_html", "wrapper")
    out = joined.mapInArrow(apply, f"_key {kind['_key']}, _url {kind['_url']}, text string, n_chars long")
    return out.select(F.col("_key").alias(key), F.col("_url").alias(url), "text", "n_chars")
