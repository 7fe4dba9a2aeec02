"""Main text of web pages by a site style tree.

Method. The pages of a host are merged into one tree: a node is an element with its normalised id, class and role,
under its parent's node. Of each node the tree keeps in how many pages it occurs (m), how often each presentation
(sequence of its children) occurs and in how many pages each content (text of a block directly in it) occurs. With
base-m logarithms, presentation importance is the entropy of the presentations; content importance is 1 minus the
mean entropy of the contents, which is 0 for a text that all pages repeat and 1 for texts of one page each. The
composite importance of a node weighs its presentations by 1 - 0.9^s (s of them) and the composite importance of
its children by the rest; nodes in fewer than ``LEAST_PAGES`` pages count as important. Branches below ``THRESHOLD`` are
removed from each page; a page of which nothing would be left keeps what markup does not declare. Equal pages of a host
count as one, so copies of a page say nothing about it. What markup declares is prior knowledge, because on a host with few
pages the tree cannot tell: menus, headers, footers, sidebars, notices, adverts, forms and comments go; inside an article or main
element a branch has the prior importance 1, worth ``PRIOR_PAGES`` pages, and what is outside such an element goes, but for
a title (h1) before it and what stands between, if the element has no title.

A branch is declared by its name if an id or class consists of words of ``NOISE_WORDS`` and of words that only tell place or form
(``site-footer``, ``cookie-bar``). Where other words stand beside it (``share-price``, ``social-history``) the tree
decides, and the branch goes without it only if more than half of its text is links. Markup that declares a form or names a branch is not
believed of a branch with more than half of the page's text. Words after ``no``, ``has``, ``with`` and the like say nothing.

Defined results: a null or empty page has the empty text; a page without a usable url belongs to the host ''; broken
markup is read as far as it goes (unclosed elements end with their parent; a ``<`` that begins no tag is text); pages may
have any length and depth; an empty table gives no row; extra columns are kept, but for
``text``, which is replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, slices
from .urls import host_of

THRESHOLD = 0.2
#: Nodes in fewer pages than this are kept: too little to tell.
LEAST_PAGES = 3
#: Pages for which the declaration of an article or main element counts against the tree.
PRIOR_PAGES = 8
#: Hashes of pages that a host has more than once are broadcast up to this number.
BROADCAST_COPIES = 1_000_000
#: The low branches of all hosts are broadcast up to this number of branches (8 bytes each), and joined by host beyond it.
BROADCAST_BRANCHES = 4_000_000
GAMMA = 0.9

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/<>]*)(?P<attrs>(?:[^<>"']|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/<>]*)(?P<attrs2>[^<>]*)>""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math".split())
FOREIGN = frozenset("svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body head html option optgroup caption legend summary tbody td tfoot th thead title tr".split())
ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "tbody thead tr td th", "tfoot": "tbody thead tr td th"}
#: An element does not end beyond these when another of its kind starts.
SCOPE = frozenset("ul ol dl table select article section div main body html nav aside button".split())
# Elements, roles and words in id or class that declare a branch not to be main text.
NOISE_TAGS = frozenset("nav footer aside form button select input dialog menu head object canvas audio video".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu menubar masthead footer sidebar aside ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored "
    "promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login form forms "
    "search searchbox comment comments commentlist disqus respond reply replies social share sharing sharebar related recommended recommendations "
    "breadcrumb breadcrumbs pagination pager toolbar widget widgets alert topbar".split()
)
# Words of an id or class that tell place, form or kind of an element only; so do a first word of up to three letters, a vendor's mark, and single letters.
PLACE_WORDS = frozenset(
    "site page global local main primary secondary tertiary upper lower left right center middle inner outer sticky fixed floating mobile desktop "
    "area bar block body box button buttons card cell col column container content desc drawer element field fields foot footer frame grid group head header heading "
    "holder icon icons inline item items label layer layout left link links list lists module panel part placeholder region row section slot strip tab tabs text title "
    "unit view wrap wrapper zone post posts article articles story stories entry user users social google facebook twitter email".split()
)
#: Elements that may hold a whole page, whatever they declare.
_WRAPPERS = frozenset("form div section body td table main article center dialog object span".split())
# Words that turn the next one round, and names of a single comment.
_NOT = frozenset("no not has have with without hide is show enable enabled disable".split())
_COMMENT = re.compile(r"(?:comment|reply)(?:[-_]?(?:item|body|\d+))?|comments|replies")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_MASK = (1 << 63) - 1


def _named_noise(named: str) -> tuple[bool, bool]:
    """Does an id or class declare noise, and does one have a word of noise beside others?"""
    declared = hinted = False
    for name in named.split():
        said = [w.lower() for w in _WORDS.findall(name)]
        said = [w for i, w in enumerate(said) if not i or said[i - 1] not in _NOT]
        if any(w in NOISE_WORDS for w in said):
            if all(w in NOISE_WORDS or w in PLACE_WORDS or len(w) <= (1 if i else 3) for i, w in enumerate(said)):
                declared = True
            else:
                hinted = True
    return declared, hinted


class Site:
    """Meaning of a start tag, remembered: (parent node, tag, attributes) -> (node, noise, main)."""

    def __init__(self):
        self.seen: dict = {}

    def node(self, parent: int, in_main: bool, tag: str, attrs: str) -> tuple[int, int, int]:
        key = (parent, in_main, tag, attrs)
        got = self.seen.get(key)
        if got is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            got = self.seen[key] = self._node(parent, in_main, tag, attrs)
        return got

    def _node(self, parent: int, in_main: bool, tag: str, attrs: str) -> tuple[int, int, int]:
        """Node, noise (1: unless it holds most of the page, 2: always, 3: if it is mostly links) and main (1: an article, 2: the main part)."""
        import xxhash

        a = {}
        for m in _ATTR.finditer(attrs):
            a.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        named = " ".join((a.get("id", ""), a.get("class", "")))
        role = a.get("role", "").strip().lower()
        style = re.sub(r"\s", "", a.get("style", "").lower())
        said = [w.lower() for w in _WORDS.findall(named)]
        header = any(w == "header" and (not i or said[i - 1] not in _NOT) for i, w in enumerate(said))
        declared, hinted = _named_noise(named)
        comment = any(_COMMENT.fullmatch(t) for t in named.lower().split())
        main = 2 if tag == "main" or role == "main" or a.get("itemprop", "").lower() == "articlebody" else int(tag == "article" or role == "article")
        if main and comment:
            main = 0
        if in_main:
            main = min(main, 1)
        noise = 0
        if tag not in ("html", "body") and (comment or ((not main or in_main) and declared)) or tag == "form":
            noise = 1 if tag in _WRAPPERS else 2
        elif tag not in ("html", "body") and hinted and not main:
            noise = 3
        if (
            tag in NOISE_TAGS - {"form", "dialog", "object"}
            or role in NOISE_ROLES
            or "hidden" in a
            or a.get("aria-hidden", "").lower() == "true"
            or "display:none" in style
            or "visibility:hidden" in style
            or (not in_main and not main and (tag == "header" or header))
        ):
            noise = 2
        elif tag in ("dialog", "object"):
            noise = noise if noise == 2 else 1
        shape = " ".join(sorted(re.sub(r"\d+", "0", named).split()))
        return xxhash.xxh3_64_intdigest(f"{tag}|{shape}|{role}".encode(), seed=parent) & _MASK, noise, main


def walk(page: str, site: Site):
    """Events of a page: ("in", node, parent, noise, main, tag), ("out",), ("text", raw) and ("block",)."""
    stack: list[tuple[str, int, bool]] = []  # tag, node, inside main
    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            if at < len(page):
                yield ("text", page[at:])
            break
        if m.start() > at:
            yield ("text", page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            yield ("text", html.escape(m["cdata"]))
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag == "br":
                yield ("text", " ")
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if k < 0 or (tag not in BLOCK and any(s[0] in BLOCK for s in stack[k + 1 :])):
                continue
            for name, *_ in reversed(stack[k:]):
                if name in BLOCK:
                    yield ("block",)
                yield ("out",)
            del stack[k:]
            continue
        if tag in RAW:
            if not (tag in FOREIGN and (m["attrs"] or m["attrs2"] or "").rstrip().endswith("/")):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|</{re.escape(tag)}\Z", re.I).search(page, at)
                at = end.end() if end else len(page)
            if tag in BLOCK:
                yield ("block",)
            continue
        if tag in VOID:
            yield ("block",) if tag == "hr" else ("text", " " if tag == "br" else "")
            continue
        ends = "p" if tag in CLOSES_P else ENDS.get(tag, "")
        if ends:
            ends = ends.split()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    for name, *_ in reversed(stack[i:]):
                        if name in BLOCK:
                            yield ("block",)
                        yield ("out",)
                    del stack[i:]
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                elif stack[i][0] in SCOPE:
                    break
        parent, in_main = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        node, noise, main = site.node(parent, in_main, tag, m["attrs"] or m["attrs2"] or "")
        if tag in BLOCK:
            yield ("block",)
        yield ("in", node, parent, noise, main, tag)
        stack.append((tag, node, in_main or bool(main)))
    for name, *_ in reversed(stack):
        if name in BLOCK:
            yield ("block",)
        yield ("out",)


def _clean(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def features(page: str, site: Site):
    """Of a page: {node: parent}, {(node, presentation)}, {(node, content)}."""
    import xxhash

    parents, shapes, contents = {}, set(), set()
    stack: list[list] = []  # node, hash of the children so far
    parts: list[str] = []
    owner = 0

    def flush():
        if parts:
            text = _clean(parts)
            parts.clear()
            if text:
                contents.add((owner, xxhash.xxh3_64_intdigest(text.encode()) & _MASK))

    for e in walk(page, site):
        if e[0] == "text":
            if not parts:
                owner = stack[-1][0] if stack else 0
            parts.append(e[1])
        elif e[0] == "block":
            flush()
        elif e[0] == "in":
            parents[e[1]] = e[2]
            if stack:
                last = stack[-1]
                if last[2] != e[1]:  # runs of like children are one presentation
                    last[1], last[2] = hash((last[1], e[1])) & _MASK, e[1]
            stack.append([e[1], 0, -1])
        else:
            node, shape, _ = stack.pop()
            if shape:
                shapes.add((node, shape))
    flush()
    return parents, shapes, contents


def _kept(events: list, spared: set[int], low: Callable[[int, bool], bool]) -> str:
    """The text of a page's events without noise (but for the branches in ``spared``) and low branches; of its main part if it declares one."""
    blocks: list[tuple[int, bool, str]] = []  # inside main, inside a title, text
    parts: list[str] = []
    stack: list[tuple[bool, int, bool]] = []
    dropped, in_main, in_title = False, 0, False

    def flush():
        if parts:
            text = _clean(parts)
            parts.clear()
            if text:
                blocks.append((in_main, in_title, text))

    for i, e in enumerate(events):
        if e[0] == "text":
            if not dropped:
                parts.append(e[1])
        elif e[0] == "block":
            if not dropped:  # blocks inside an inline element that goes do not part the text around it
                flush()
        elif e[0] == "in":
            _, node, _, noise, main, tag = e
            stack.append((dropped, in_main, in_title))
            now_main = in_main if dropped else max(in_main, main)
            if now_main != in_main:
                flush()
            in_main, in_title = now_main, in_title or tag == "h1"
            dropped = dropped or (noise > 0 and i not in spared) or low(node, now_main > 0)
        else:
            was = stack.pop()
            if was[1] != in_main:
                flush()
            dropped, in_main, in_title = was
    flush()
    # An article beside the main part is a teaser; without either all is main.
    most = max((m for m, _, _ in blocks), default=0)
    main = [i for i, (m, _, _) in enumerate(blocks) if m == most]
    titles = [i for i in range(main[0]) if blocks[i][1] and not blocks[i][0]] if main else []
    if titles and not any(blocks[i][1] for i in main):
        # The last title before the main part, and its other blocks if it has several.
        start = titles[-1]
        while start - 1 in titles:
            start -= 1
        main = [*(i for i in range(start, main[0]) if not blocks[i][0]), *main]
    return "\n\n".join(blocks[i][2] for i in main)


def _spared(events: list) -> set[int]:
    """The declared branches that stay, as indexes of their events: named ones with more than half of the page's text, hinted ones that are not mostly links."""
    opened, declared, total, links, in_link = [], [], 0, 0, 0
    for i, e in enumerate(events):
        if e[0] == "text":
            n = len(e[1]) if not e[1].isspace() else 0
            total += n
            links += n if in_link else 0
        elif e[0] == "in":
            opened.append((i, total, links))
            in_link += e[5] == "a"
        elif e[0] == "out":
            at, before, linked = opened.pop()
            in_link -= events[at][5] == "a"
            if events[at][3] in (1, 3):
                declared.append((at, total - before, links - linked))
    return {at for at, size, linked in declared if 2 * size > total or (events[at][3] == 3 and 2 * linked <= size)}


def main_text(page: str | None, low: Callable[[int, bool], bool] | frozenset, site: Site) -> str:
    """The text of ``page`` without noise and without low branches; of its main part if it declares one.

    ``low`` tells of a node, and of whether it is inside a main part, if its branch is low; a set has those that are.
    """
    if not page:
        return ""
    if isinstance(low, frozenset):
        nodes = low
        low = lambda node, in_main: node in nodes
    events = list(walk(page, site))
    spared = _spared(events) if any(e[0] == "in" and e[3] in (1, 3) for e in events) else set()
    return _kept(events, spared, low) or _kept(events, spared, lambda node, in_main: False)


def _importance(pdf):
    """Composite importance of the nodes of one host, bottom up."""
    import pandas as pd

    rows = {r.node: r for r in pdf.itertuples()}
    below: dict[int, list[int]] = {}
    for n, r in rows.items():
        if r.parent in rows and r.parent != n:
            below.setdefault(r.parent, []).append(n)
    order, todo = [], [n for n, r in rows.items() if r.parent not in rows or r.parent == n]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += below.get(n, [])
    imp: dict[int, float] = {}
    for n in reversed(order):
        r = rows[n]
        log_m = math.log(r.m) if r.m > 1 else 0.0
        parts = [(rows[c].m, imp[c]) for c in below.get(n, [])]
        if r.rare:
            parts.append((r.rare, 1.0))
        if r.contents:
            parts.append((r.m, 1 - min(1.0, r.content_logs / r.contents / log_m) if log_m else 1.0))
        inner = sum(w * x for w, x in parts) / sum(w for w, _ in parts) if parts else 0.0
        shape = min(1.0, (math.log(r.shape_n) - r.shape_logs / r.shape_n) / log_m) if log_m and r.shape_n else 1.0
        keep = GAMMA ** max(1, r.shapes)
        imp[n] = ((1 - keep) * shape + keep * inner) if below.get(n) or r.rare else inner
    return pd.DataFrame({"host": pdf["host"].iloc[0], "node": list(imp), "m": [rows[n].m for n in imp], "importance": list(imp.values())})


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, node, m, importance) of the site style tree of every host, for nodes in ``LEAST_PAGES`` pages or more.

    One task has these nodes of a host (some 100 bytes each), never its pages; rarer nodes are added up under their parents before.
    """
    src = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("html is not null").withColumn("page", F.xxhash64("html"))
    copies = keep(src.groupBy("host", "page").agg(F.count("*").alias("copies")).where("copies > 1"))
    many = copies.count()
    src = src.join(F.broadcast(copies) if many <= BROADCAST_COPIES else copies, ["host", "page"], "left") if many else src.withColumn("copies", F.lit(1))

    def run(batches):
        site = Site()
        for batch in slices(batches, "html"):
            counts: dict = {}
            for host, page, same in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                one = 1 / (same or 1)
                parents, shapes, contents = features(page, site)
                for n, p in parents.items():
                    k = (host, n, p, 0, 0)
                    counts[k] = counts.get(k, 0) + one
                for kind, found in ((1, shapes), (2, contents)):
                    for n, h in found:
                        k = (host, n, parents.get(n, 0), kind, h)
                        counts[k] = counts.get(k, 0) + one
            if counts:
                cols = list(zip(*counts, strict=True))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), pa.array(list(counts.values()), pa.float64())], names=["host", "node", "parent", "kind", "h", "k"])

    seen = src.select("host", "html", F.col("copies").cast("long")).mapInArrow(run, "host string, node long, parent long, kind int, h long, k double")
    # The shares of the copies of a page add up to one page.
    seen = seen.groupBy("host", "node", "parent", "kind", "h").agg(F.round(F.sum("k")).cast("long").alias("k"))
    nodes = seen.groupBy("host", "node", "parent").agg(
        F.expr("coalesce(sum(k) filter (where kind = 0), 1)").alias("m"),
        F.expr("count_if(kind = 1)").alias("shapes"),
        F.expr("coalesce(sum(k) filter (where kind = 1), 0)").alias("shape_n"),
        F.expr("coalesce(sum(k * ln(k)) filter (where kind = 1), 0d)").alias("shape_logs"),
        F.expr("count_if(kind = 2)").alias("contents"),
        F.expr("coalesce(sum(ln(k)) filter (where kind = 2), 0d)").alias("content_logs"),
    )
    nodes = keep(nodes)  # pages are read once
    rare = nodes.where(f"m < {LEAST_PAGES}").groupBy("host", F.col("parent").alias("node")).agg(F.sum("m").alias("rare"))
    nodes = nodes.where(f"m >= {LEAST_PAGES}").join(rare, ["host", "node"], "left").fillna(0, ["rare"])
    return nodes.groupBy("host").applyInPandas(_importance, "host string, node long, m long, importance double")


def low_branches(pages: DataFrame, url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """(host, node, main) of the branches to remove; ``main``: inside a declared article or main element, too."""
    tree = style_tree(pages, url_col, html_col).where(f"importance < {threshold}")
    return tree.select("host", "node", (F.col("m") * F.col("importance") + PRIOR_PAGES < threshold * (F.col("m") + PRIOR_PAGES)).alias("main"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with a column ``text``: the main text of every page."""
    from pyspark.sql.types import StringType, StructField, StructType

    low = keep(low_branches(pages, url_col, html_col, threshold))
    names = [c for c in pages.columns if c != "text"]
    kept = [c for c in names if c != html_col]
    src = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    few = low.count() <= BROADCAST_BRANCHES
    shared = None
    if few:  # as sorted hashes of host and node
        key = [_branch(r.host, r.node) for r in low.toLocalIterator()]
        main = [_branch(r.host, r.node) for r in low.where("main").toLocalIterator()]
        shared = pages.sparkSession.sparkContext.broadcast((frozenset(key), frozenset(main)))
        src = src.withColumns({"low": F.lit(None).cast("array<bigint>"), "sure": F.lit(None).cast("array<bigint>")})
    else:
        src = src.join(low.groupBy("host").agg(F.collect_set("node").alias("low"), F.collect_set(F.when(F.col("main"), F.col("node"))).alias("sure")), "host", "left")

    def run(batches):
        site = Site()
        for batch in slices(batches, "html"):
            at = {n: i for i, n in enumerate(batch.schema.names)}
            texts = []
            for host, low, sure, page in zip(*(batch.column(at[c]).to_pylist() for c in ("host", "low", "sure", "html")), strict=True):
                if few:
                    every, certain = shared.value
                    is_low = (lambda node, in_main, h=host: _branch(h, node) in (certain if in_main else every)) if every else (lambda node, in_main: False)
                else:
                    sets = (frozenset(low or ()), frozenset(sure or ()))
                    is_low = lambda node, in_main, s=sets: node in s[in_main]
                texts.append(main_text(page, is_low, site))
            row = batch.column(at["row"])
            yield pa.RecordBatch.from_arrays([*(row.field(i) for i in range(len(kept))), pa.array(texts, pa.string())], names=[*kept, "text"])

    schema = StructType([*(pages.schema[c] for c in kept), StructField("text", StringType())])
    return src.mapInArrow(run, schema)


def _branch(host: str, node: int) -> int:
    """Hash of a host's node."""
    import xxhash

    return xxhash.xxh3_64_intdigest(host.encode(), seed=node)


def op1(spark, pages: DataFrame) -> DataFrame:
    """The contract's columns of the extraction over ``pages``."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
