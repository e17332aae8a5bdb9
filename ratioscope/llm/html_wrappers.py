"""Main text by wrappers: union-free regular expressions inferred from the token streams of one host's pages.

A page is a stream of block tags and texts, nested by its tags.  A wrapper is an expression over such streams: items in
order, each required, optional ``?`` or repeated ``+`` (a repeated item may be a group of items), and texts that are constant or slots.
All pages of a host are folded (adjacent repeats become one repeated item) and aligned with a wrapper one after another; an
item that one side lacks becomes optional, texts that differ become a slot.  Wrappers of ``part_pages`` pages each are made by
many tasks and merged in a tree.

What a slot holds is told from the wrapper: text that all of at least ``const_pages`` different pages share is the site's,
not the article's; items whose tags or names mark menus, adverts, forms, comments and the like are left out; of what is left the
article (or main) item is taken, or else the smallest item with most of the running text.  A page is then read against
its host's wrapper; parts that the wrapper lacks follow the same marks.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .words import pieces

#: Attributes hold a ``<`` in quotes only, so that unclosed tags end at the next one and the scan stays linear.
_ATTRS = r"""(?:[^'"<>]++|"[^"]*+"|'[^']*+')*+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|button|iframe|svg|object|canvas|title)\b{_ATTRS}>.*?(?:</\1\s*>|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)({_ATTRS})>|[^<]++|<", re.S | re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("br hr img input link meta area base col embed source track param".split())
LEFT_OUT_TAGS = frozenset("head nav footer aside form menu dialog fieldset address".split())
#: Words in class, id or role that mark parts which are not the article.
LEFT_OUT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side navigation navbar nav menu breadcrumb breadcrumbs footer header masthead topbar comment comments disqus reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search related recommended share sharing social widget pagination pager toolbar tags complementary contentinfo form discussion respond".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Tags nested deeper open no level of their own (their texts stay, and marked parts are still left out).
DEEPEST = 100
#: So many levels up an end tag that HTML implies is looked for.
IMPLIED = 256
FENCE = frozenset("article section div main body table ul ol dl td th li blockquote".split())

# A node is [signature, children]; a text is a str.  A wrapper item is a dict: s (signature, "#" a text, "()" a group), c (items),
# opt, rep, n (pages that have it), t (its constant text, None for a slot), w (running words seen in it).


def parse(page: str) -> list:
    """Tree of block tags and texts.  Inline tags vanish, a line break parts texts, unclosed tags end where HTML ends them."""
    root: list = ["", []]
    stack: list[tuple[str, list, int]] = [("", root, 0)]  # tag, node, levels above that have a node
    open_: dict[str, int] = {}
    text: list[str] = []

    def flush() -> None:
        if text:
            t = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if t:
                stack[-1][1][1].append(t)

    def close(name: str) -> None:
        while True:
            top = stack.pop()[0]
            open_[top] -= 1
            if top == name:
                return

    for m in TOKEN.finditer(page):
        tag = m.group(3)
        if tag is None:
            if m.group(1) is None and m.group(0)[:2] not in ("<!", "<?"):
                text.append(m.group(0))
            continue
        tag = tag.lower()
        if tag in INLINE:
            continue
        flush()
        if m.group(2):
            if open_.get(tag):
                close(tag)
        elif tag not in VOID:
            ends = CLOSES.get(tag, {"p"})
            if any(open_.get(e) for e in ends):
                for i in range(len(stack) - 1, max(0, len(stack) - 1 - IMPLIED), -1):
                    name = stack[i][0]
                    if name in ends:
                        close(name)
                        break
                    if name in FENCE:
                        break
            marks = sorted({w for v in NAMES.findall(m.group(4)) for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower()) if w})
            node: list = [" ".join([tag, *marks]), []]
            _, above, level = stack[-1]
            if level >= DEEPEST and (level > DEEPEST or not marked(node[0])):
                node = above
            else:
                above[1].append(node)
                level += 1
            if not m.group(4).rstrip().endswith("/"):
                stack.append((tag, node, level))
                open_[tag] = open_.get(tag, 0) + 1
    flush()
    return root


def marked(signature: str) -> bool:
    """Whether a tag or its names say that it isn't part of an article."""
    tag, _, names = signature.partition(" ")
    return tag in LEFT_OUT_TAGS or (tag not in ("html", "body", "article", "main") and not LEFT_OUT_WORDS.isdisjoint(names.split()))


def name(text: str) -> str:
    """What stands for a text in a wrapper: itself, or a digest of a long one."""
    return text if len(text) <= 40 else hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest() + "..."


def item(node: Any) -> dict:
    if isinstance(node, str):
        return {"s": "#", "c": [], "n": 1, "t": name(node), "w": len(node.split())}
    kids = fold([item(x) for x in node[1]])
    return {"s": node[0], "c": kids, "n": 1, "w": sum(k["w"] for k in kids)}


def same(a: dict, b: dict) -> bool:
    return a["s"] == b["s"] and (a["s"] != "()" or [x["s"] for x in a["c"]] == [x["s"] for x in b["c"]])


def merge(a: dict, b: dict, pages: int = 0) -> dict:
    """One item that fits what either fits.  ``pages``: 1 where b is from other pages."""
    out = {"s": a["s"], "c": align(a["c"], b["c"], pages) if a["s"] not in ("#",) else [], "n": a["n"] + pages * b["n"], "w": a["w"] + b["w"]}
    if a["s"] == "#":
        out["t"] = a["t"] if a["t"] == b["t"] else None
    for k in ("opt", "rep"):
        if a.get(k) or b.get(k):
            out[k] = 1
    return out


def fold(items: list[dict], longest: int = 4) -> list[dict]:
    """Adjacent repeats of one item, or of a group of up to ``longest`` items, as one repeated item."""
    for size in range(1, longest + 1):
        out: list[dict] = []
        i = 0
        while i < len(items):
            n = 1
            while i + (n + 1) * size <= len(items) and all(same(items[i + j], items[i + n * size + j]) for j in range(size)):
                n += 1
            if n == 1 or (size == 1 and items[i]["s"] == "()"):
                out.append(items[i])
                i += 1
                continue
            group = items[i : i + size]
            for k in range(1, n):
                group = [merge(group[j], items[i + k * size + j]) for j in range(size)]
            one = group[0] if size == 1 else {"s": "()", "c": group, "n": 1, "w": sum(g["w"] for g in group)}
            out.append(one | {"rep": 1})
            i += n * size
        items = out
    return items


def _key(x: dict) -> tuple:
    return (x["s"], *(y["s"] for y in x["c"])) if x["s"] == "()" else (x["s"],)


def matches(a: list[tuple], b: list[tuple], most: int = 250_000) -> list[tuple[int, int]]:
    """Places of a common subsequence: the longest one, or for more than ``most`` combinations the longest one that pairs the
    n-th occurrence of a key with the n-th."""
    lo, la, lb = 0, len(a), len(b)
    while lo < la and lo < lb and a[lo] == b[lo]:
        lo += 1
    while la > lo and lb > lo and a[la - 1] == b[lb - 1]:
        la, lb = la - 1, lb - 1
    out = [(i, i) for i in range(lo)]
    tail = [(la + i, lb + i) for i in range(len(a) - la)]
    if (la - lo) * (lb - lo) <= most:
        best = [[0] * (lb - lo + 1) for _ in range(la - lo + 1)]
        for i in range(la - lo - 1, -1, -1):
            row, below = best[i], best[i + 1]
            for j in range(lb - lo - 1, -1, -1):
                row[j] = below[j + 1] + 1 if a[lo + i] == b[lo + j] else max(below[j], row[j + 1])
        i = j = 0
        while i < la - lo and j < lb - lo:
            if a[lo + i] == b[lo + j]:
                out.append((lo + i, lo + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
        return out + tail
    where: dict[tuple, list[int]] = {}
    for j in range(lb - 1, lo - 1, -1):
        where.setdefault(b[j], []).append(j)
    pairs = [(i, where[a[i]].pop()) for i in range(lo, la) if where.get(a[i])]
    # the longest rising subsequence
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        before.append(at[k - 1] if k else -1)
        ends[k : k + 1], at[k : k + 1] = [j], [n]
    n, middle = at[-1] if at else -1, []
    while n >= 0:
        middle.append(pairs[n])
        n = before[n]
    return out + middle[::-1] + tail


def align(a: list[dict], b: list[dict], pages: int) -> list[dict]:
    """Items of a common subsequence merged; all others become optional."""
    out, i, j = [], 0, 0
    for x, y in [*matches([_key(v) for v in a], [_key(v) for v in b]), (len(a), len(b))]:
        out += [v | {"opt": 1} for v in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append(merge(a[x], b[y], pages))
        i, j = x + 1, y + 1
    return out


def infer(pages: list[str]) -> dict:
    """Wrapper of a host's pages.  A page whose longest text another has too is its copy, whose texts would seem constant:
    it is passed over."""
    seen, out = set(), None
    for p in pages:
        tree = parse(p)
        key = longest(tree)
        if key in seen:
            continue
        seen.add(key)
        one = item(tree)
        out = one if out is None else merge(out, one, 1)
    return out or item(["", []])


def longest(tree: list) -> str:
    """A page's longest text, by which its copies are told."""
    return max(_texts(tree), key=len, default="")


def join(wrappers: list[dict]) -> dict:
    """One wrapper of wrappers of different pages."""
    out = wrappers[0]
    for w in wrappers[1:]:
        out = merge(out, w, 1)
    return out


def _texts(node: list) -> Iterator[str]:
    for x in node[1]:
        if isinstance(x, str):
            yield x
        else:
            yield from _texts(x)


def regex(w: dict) -> str:
    """The wrapper as text, for people."""
    body = ("#" if w["t"] is None else repr(w["t"])) if w["s"] == "#" else " ".join(map(regex, w["c"]))
    if w["s"] not in ("#", "()", ""):
        body = f"<{w['s']}>{body}</>"
    quant = "*" if w.get("opt") and w.get("rep") else "+" if w.get("rep") else "?" if w.get("opt") else ""
    return f"({body}){quant}" if quant else body


def _running(w: dict) -> int:
    """Words of an item outside marked parts."""
    return 0 if marked(w["s"]) else w["w"] if w["s"] == "#" else sum(map(_running, w["c"]))


def find_main(w: dict) -> list[str]:
    """Signatures, from the root, of the item that holds the article, where no article or main tag says so."""
    path, total = [], _running(w)
    while True:
        best = max(w["c"], key=_running, default=None)
        if best is None or best["s"] in ("#", "()") or best.get("rep") or _running(best) < 0.6 * total:
            return path
        path.append(best["s"])
        w = best


def _named(node: list, tags: tuple[str, ...]) -> Iterator[list]:
    """Outermost unmarked nodes of these tags."""
    for x in node[1]:
        if isinstance(x, list) and not marked(x[0]):
            if x[0].partition(" ")[0] in tags or ("main" in tags and "main" in x[0].split()[1:]):
                yield x
            else:
                yield from _named(x, tags)


def _blocks(node: list, w: dict | None, const_pages: int) -> Iterator[str]:
    """Texts of a node read against its wrapper item; texts equal to a constant of the site are left out."""
    kids = _flat(w["c"]) if w else []
    places: dict[str, list[int]] = {}
    for i, kid in enumerate(kids):
        places.setdefault(kid["s"], []).append(i)
    at = 0
    for x in node[1]:
        s = "#" if isinstance(x, str) else x[0]
        own, here = None, places.get(s)
        if here:  # the next item of this signature, or the first again where it repeats
            k = bisect_left(here, at)
            at = here[k] if k < len(here) else here[0]
            own = kids[at]
        if isinstance(x, str):
            if not (own and name(x) == own["t"] and own["n"] >= const_pages):
                yield x
        elif not marked(s):
            yield from _blocks(x, own, const_pages)


def _flat(items: list[dict]) -> list[dict]:
    """Items with the members of groups in their places."""
    out: list[dict] = []
    for i in items:
        out += _flat(i["c"]) if i["s"] == "()" else [i]
    return out


def _descend(w: dict | None, node: list, goal: list) -> dict | None:
    """Wrapper item that a node below the root is read against."""
    if node is goal:
        return w
    kids = {i["s"]: i for i in reversed(_flat(w["c"]))} if w else {}
    for x in node[1]:
        if isinstance(x, list) and (x is goal or any(y is goal for y in _walk(x))):
            return _descend(kids.get(x[0]), x, goal)
    return None


def _walk(node: list) -> Iterator[list]:
    for x in node[1]:
        if isinstance(x, list):
            yield x
            yield from _walk(x)


def extract(page: str, wrapper: dict | None, const_pages: int = 4) -> list[str]:
    """Blocks of the page's main text, in page order."""
    tree = parse(page)
    main = list(_named(tree, ("article",))) or list(_named(tree, ("main",)))
    if not main:
        node = tree
        for s in find_main(wrapper or item(tree)):
            node = next((x for x in node[1] if isinstance(x, list) and x[0] == s), None)
            if node is None:
                node = tree
                break
        main = [node]
    return [t for m in main for t in _blocks(m, _descend(wrapper, tree, m), const_pages)]


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", part_pages: int = 64, const_pages: int = 4) -> DataFrame:
    """One row an input row: page_id, url, text (empty if none), n_chars (code points).

    Null html is empty; a null URL, or one without a host, is of the host ''.  Ids may be null or repeated.  Whole pages are
    read, however long; other columns are not read; an empty table gives no rows.  A host's wrapper is inferred
    from all of its pages that have an id (of copies, told by their longest text, from the one of smallest id).
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "wrappers")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))

    def skeletons(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = pdf["html"].tolist()
            for s, e in pieces(texts):
                trees = [parse(t) for t in texts[s:e]]
                keys = [hashlib.md5(longest(t).encode("utf-8", "surrogatepass")).hexdigest() for t in trees]
                yield pd.DataFrame({"host": pdf["host"].iloc[s:e], "page_id": pdf["page_id"].iloc[s:e], "copy": keys, "w": [pack(item(t)) for t in trees]})

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("no")
        return pd.DataFrame({"host": [own["host"].iloc[0]], "part": [own["part"].iloc[0]], "w": [pack(join([unpack(w) for w in own["w"]]))]})

    pack = lambda w: zlib.compress(json.dumps(w, separators=(",", ":")).encode())
    unpack = lambda w: json.loads(zlib.decompress(w))
    made = rows.where("page_id is not null and html is not null").select("host", "page_id", "html").mapInPandas(skeletons, "host string, page_id long, copy string, w binary")
    single = scratch.write(made.groupBy("host", "copy").agg(F.min(F.struct("page_id", "w")).alias("x")).select("host", "copy", F.col("x.page_id").alias("no"), "x.w"), "pages")
    sizes = single.groupBy("host").agg(F.ceil(F.count("*") / part_pages).alias("parts"))
    most = sizes.agg(F.max("parts")).first()[0] or 1
    parts = single.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("copy"), F.col("parts"))).repartition("host", "part")  # else the join's deal by host would put a host's parts in one task
    wrappers = scratch.write(parts.groupBy("host", "part").applyInPandas(up, "host string, part long, w binary"), "wrappers")
    while most > 1:
        most = -(-most // 8)
        above = wrappers.withColumn("no", F.col("part")).withColumn("part", F.floor(F.col("part") / 8))
        wrappers = scratch.write(above.groupBy("host", "part").applyInPandas(up, "host string, part long, w binary"), "wrappers")
    wrappers = wrappers.select("host", F.col("w").alias("wrapper"))

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict] = {}
        for pdf in it:
            texts = pdf["html"].tolist()
            for s, e in pieces(texts):
                part, out = pdf.iloc[s:e], []
                for h, w, page in zip(part["host"], part["wrapper"], texts[s:e]):
                    if h not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[h] = unpack(w) if w else None
                    out.append(" ".join(extract(page, known[h], const_pages)) if page else "")
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": out, "n_chars": [len(t) for t in out]})

    joined = rows.join(wrappers, "host", "left")
    return joined.mapInPandas(read, "page_id long, url string, text string, n_chars long")


__all__ = ["extract", "extract_pages", "infer", "parse", "regex"]
