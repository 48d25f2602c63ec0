"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a list of text blocks with their place in the DOM.  A logistic
classifier over structure, class names, links, length and wording gives every
block its log odds of being content: the capacities to the two terminals.
Neighbouring blocks, and blocks with a common container, are tied by smoothness
capacities.  The minimum cut is the labelling of least total cost; blocks
on the source's side are content.

Weights and ties are fitted (``page_model``) on a fixed number of generated
pages with known labels, many of them without an article element or with
misleading class names.  Blocks whose terminal capacity outweighs all their
ties keep their label in some minimum cut, so they are settled first and
only the rest is left to the flow.

Defined results: null, empty or text-free pages give an empty text; broken
markup is read much as browsers do (unclosed elements, comments and
attributes end with the page, an unclosed control ends at once); rows are
independent, so nulls in other columns, ties and repeated rows need no rule; columns
named as outputs are replaced, others kept; an empty table gives no rows; a
page may be as long as a row can be and as deep as it likes.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import text_of

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|=|["'])*+)(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_UNSEEN = re.compile(r"(?<![\w-])(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_ENDS = re.compile(r"[.!?…。！？:;]['\"»”’)\]]*$")
#: What short blocks of boilerplate say.
_WORDING = (
    "©", "all rights reserved", "cookie", "newsletter", "subscribe", "sign up", "signing up", "log in", "login", "sign in", "privacy policy", "terms of", "advertise", "sponsored", "follow us",
    "share this", "share on", "read more", "skip to", "your email", "your e-mail", "your inbox",
)
SHORT = 200


def _boilerplate_wording(text: str) -> bool:
    if len(text) > SHORT:
        return False
    low = text.lower()
    return any(w in low for w in _WORDING)


def _names(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Element names of the HTML standard by the role they play here.
VOID = _names("area base br col embed hr img input link meta param source track wbr")
#: Their content is text to the parser, or never shown as text.
RAW = _names("script style title textarea noscript template iframe noembed noframes xmp annotation")
#: Controls and media: what they hold is not the article's; without an end tag they hold nothing.
HOLDERS = _names("button select datalist object audio video canvas map")
BLOCK = _names(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul"
)
LEAVES = _names("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre legend caption figcaption summary")
CONTROLS = _names("form input button select textarea")
AGAINST_TAGS = _names("nav footer aside form menu dialog search fieldset")
FOR_TAGS = _names("article main")
FOR_ROLES = _names("main article")
AGAINST_ROLES = _names("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar")
FOR_CLASSES = _names("article content post entry story main text body")
AGAINST_CLASSES = _names(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsors sponsored promo promos promotion banner banners "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer sidebar "
    "sidebars aside widget widgets cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay "
    "newsletter subscribe subscription signup login comment comments commentlist disqus reply replies respond discussion share sharing "
    "social related recommended recommendations teaser teasers copyright legal disclaimer form search tagcloud skip"
)
#: Words that say nothing beside one of the above.
PLAIN_PARTS = _names(
    "area bar block body bottom box button buttons center col column container content cta extra group home icon icons inline inner item items left link links "
    "list main mini mobile nav outer page panel post posts article articles right row section site slot small sticky story text title top unit web widget wrap wrapper"
)
_ABOUT = _names("has with no without is")
HEADINGS = _names("h1 h2 h3 h4 h5 h6")


def _class_votes(value: str, inside: bool) -> tuple[bool, bool, bool]:
    """(named as boilerplate, part of the name, named as content) from class or id names.

    A name counts wholly if all its parts are words of boilerplate or say
    nothing; inside an article, a header is its title's.
    """
    strong = weak = good = False
    for name in value.split():
        parts = [p.lower() for p in _PART.findall(name) if not p.isdigit()]
        if not parts or parts[0] in _ABOUT:
            continue
        against = [p in AGAINST_CLASSES and not (inside and p == "header") for p in parts]
        if any(against):
            if all(a or p in PLAIN_PARTS for a, p in zip(against, parts, strict=True)):
                strong = True
            else:
                weak = True
        elif any(p in FOR_CLASSES for p in parts):
            good = True
    return strong, weak, good


class Place:
    """What the elements around a text say about it."""

    __slots__ = ("against", "article", "good", "hidden", "weak")

    def __init__(self, article: bool = False, against: bool = False, weak: bool = False, good: bool = False, hidden: bool = False) -> None:
        self.article, self.against, self.weak, self.good, self.hidden = article, against, weak, good, hidden


class Block:
    __slots__ = ("linked", "parent", "place", "tag", "text")

    def __init__(self, text: str, linked: float, place: Place, parent: int, tag: str) -> None:
        self.text, self.linked, self.place, self.parent, self.tag = text, linked, place, parent, tag


def _hidden(found: dict[str, str]) -> bool:
    """Invisible by the attribute ``hidden``, to assistive software, or by its own style."""
    return "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or bool(_UNSEEN.search(found.get("style", "")))


def _placed(name: str, attrs: str, above: Place) -> Place:
    """The place inside an element."""
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if attrs and not attrs.isspace() else {}
    if not found and name not in AGAINST_TAGS and name not in FOR_TAGS and name != "header":
        return above
    role = found.get("role", "").lower()
    if name in ("html", "body"):
        return above
    hidden = above.hidden or (bool(found) and _hidden(found))
    if name in FOR_TAGS or role in FOR_ROLES:
        # A comment marked up as an article of its own stays a comment.
        return Place(True, above.against and above.article, False, False, hidden)
    slug = "" if name in HEADINGS else found.get("id", "")
    strong, weak, good = _class_votes(f"{found.get('class', '')} {slug}", above.article) if found else (False, False, False)
    against = above.against or strong or name in AGAINST_TAGS or role in AGAINST_ROLES or (name == "header" and not above.article)
    return Place(above.article, against, above.weak or weak, above.good or good, hidden)


def _skip(html: str, name: str, at: int) -> int:
    """Where the content of an element that holds no article text ends; ``at`` itself if a control is never closed."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>]|\Z)", re.I).finditer(html, at):
        if not m[1]:
            if name in HOLDERS:
                return at
            if name == "svg":
                depth += 1
            continue
        depth -= 1
        if not depth:
            end = html.find(">", m.end())
            return len(html) if end < 0 else end + 1
    return at if name in HOLDERS else len(html)


class Page:
    """The text blocks of a page in order, whether it marks a main part, and which containers hold controls."""

    def __init__(self, html: str) -> None:
        self.blocks: list[Block] = []
        self.main = False
        self.controls: set[int] = set()
        self._read(html)

    def _read(self, html: str) -> None:
        #: name, place, number of the nearest container
        stack: list[tuple[str, Place, int]] = [("", Place(), 0)]
        open_: Counter[str] = Counter()
        texts: list[str] = []
        linked = at = count = 0
        wide = {0}

        def flush() -> None:
            nonlocal linked
            if texts:
                place = stack[-1][1]
                text = "" if place.hidden else " ".join(unescape("".join(texts)).split())
                if text:
                    tag = next((s[0] for s in reversed(stack[-6:]) if s[0] in BLOCK), "")
                    self.blocks.append(Block(text, min(1.0, linked / max(1, len(text))), place, stack[-1][2], tag))
                texts.clear()
                linked = 0

        def cut(k: int) -> None:
            for s in stack[k:]:
                open_[s[0]] -= 1
            del stack[k:]

        size = len(html)
        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                lt = size
            if lt > at:
                if not (stack[-1][1].hidden and stack[-1][0] not in BLOCK):
                    texts.append(html[at:lt])
                    if open_["a"]:
                        linked += lt - at
            if lt == size:
                break
            m = _TOKEN.match(html, lt)
            if m is None:
                texts.append("<")
                at = lt + 1
                continue
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            name = name.lower()
            if m["end"]:
                if name in BLOCK:
                    flush()
                if open_[name] > 0:
                    inside = False
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == name:
                            if name in BLOCK or not inside:
                                cut(k)
                            break  # an inline end does not close the blocks in between
                        inside |= stack[k][0] in BLOCK
                continue
            if name in CONTROLS and stack[-1][2] not in wide:
                self.controls.add(stack[-1][2])
            if name in RAW or name in HOLDERS or name == "svg":
                if not (name == "svg" and m["attrs"].endswith("/")):
                    at = _skip(html, name, at)
                if name not in ("svg", "button") and texts:
                    texts.append(" ")
                continue
            if name in BLOCK:
                flush()
                _close_implied(stack, open_, name, cut)
            elif name == "br":
                texts.append(" ")
            if name in VOID or (m["attrs"].endswith("/") and name not in BLOCK):
                continue
            if name == "a" and open_["a"]:
                k = max(i for i, s in enumerate(stack) if s[0] == "a")
                if not any(s[0] in BLOCK for s in stack[k:]):
                    del stack[k]
                    open_["a"] -= 1
            above = stack[-1][1]
            place = _placed(name, m["attrs"], above) if m["attrs"] or name in BLOCK else above
            self.main |= place.article
            container = stack[-1][2]
            if name in BLOCK and name not in LEAVES:
                count += 1
                container = count
                if name in FOR_TAGS or name in ("html", "body"):
                    wide.add(count)
            stack.append((name, place, container))
            open_[name] += 1
        flush()


_SCOPES = _names("table td th caption button object template html body")
_SELF_CLOSING = {"li": _names("ul ol menu dir"), "dt": _names("dl"), "dd": _names("dl"), "option": _names("select"), "tr": _names("table"), "td": _names("tr table"), "th": _names("tr table")}
_ALIKE = {"dt": _names("dt dd"), "dd": _names("dt dd"), "td": _names("td th"), "th": _names("td th")}


def _close_implied(stack: list, open_: Counter[str], name: str, cut) -> None:
    """Close what a block start closes: an open p, or an item of the same list or row."""
    if name in _SELF_CLOSING:
        stop, alike = _SELF_CLOSING[name], _ALIKE.get(name, frozenset((name,)))
        if any(open_[a] > 0 for a in alike):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in alike:
                    cut(k)
                    break
                if stack[k][0] in stop:
                    break
    if open_["p"] > 0:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == "p":
                cut(k)
                return
            if stack[k][0] in _SCOPES:
                return


FEATURES = (
    "bias", "article", "beside_article", "against", "weak", "weak_in_article", "good", "linked", "words", "punctuated", "heading", "item", "wording", "control", "control_in_article",
    "words_outside", "linked_in_article", "wording_in_article", "punctuated_in_article", "bare",
)


def features(page: Page) -> np.ndarray:
    """One row of ``FEATURES`` for each block."""
    members = Counter(b.parent for b in page.blocks)
    bare = not (page.main or page.controls or any(b.linked > 0.5 or b.place.against for b in page.blocks))
    rows = []
    for b in page.blocks:
        p = b.place
        words = min(log1p(b.text.count(" ") + 1), 4.0)
        # A form in a small container is about what the container says.
        control = float(b.parent in page.controls and members[b.parent] <= 3)
        plain = 0.0 if p.article or page.main else 1.0
        rows.append((
            1.0, p.article, page.main and not p.article, p.against, p.weak and not p.article, p.weak and p.article, p.good, b.linked, words, (ends := bool(_ENDS.search(b.text))) and not p.article,
            b.tag in HEADINGS, b.tag in ("li", "dd", "dt"), (said := _boilerplate_wording(b.text)) and not p.article, control and not p.article, control and p.article, words * plain,
            b.linked * p.article, said and p.article, ends and p.article, bare,
        ))
    return np.array(rows, dtype=np.float64).reshape(-1, len(FEATURES))


class Model:
    """Weights of the classifier, the most a terminal can carry, and the capacities of the two kinds of ties."""

    def __init__(self, weights: np.ndarray, most: float, next_to: float, same_parent: float) -> None:
        self.weights, self.most, self.next_to, self.same_parent = weights, most, next_to, same_parent

    def odds(self, page: Page) -> list[float]:
        return np.clip(features(page) @ self.weights, -self.most, self.most).tolist()

    def ties(self, page: Page) -> list[tuple[int, int, float]]:
        out: list[tuple[int, int, float]] = []
        last: dict[int, int] = {}
        for i, b in enumerate(page.blocks):
            if i:
                out.append((i - 1, i, self.next_to))
            if b.parent in last:
                out.append((last[b.parent], i, self.same_parent))
            last[b.parent] = i
        return out

    def labels(self, page: Page) -> list[bool]:
        return min_cut(self.odds(page), self.ties(page)) if page.blocks else []


def min_cut(odds: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost; ``ties`` are (i, j, capacity)."""
    n = len(odds)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, c in ties:
        near[i].append((j, c))
        near[j].append((i, c))
    label: list[bool | None] = [None] * n
    weight = list(odds)
    todo = deque(range(n))
    # Settle what no choice of its neighbours can turn; their ties then add to the neighbours' odds.
    while todo:
        i = todo.popleft()
        if label[i] is not None:
            continue
        if abs(weight[i]) >= sum(c for j, c in near[i] if label[j] is None):
            label[i] = weight[i] > 0
            for j, c in near[i]:
                if label[j] is None:
                    weight[j] += c if label[i] else -c
                    todo.append(j)
    free = [i for i in range(n) if label[i] is None]
    if free:
        number = {i: k for k, i in enumerate(free)}
        edges = [(number[i], number[j], c) for i, j, c in ties if i in number and j in number]
        for i, side in zip(free, _flow([weight[i] for i in free], edges), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _flow(odds: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Dinic's algorithm; which nodes the source still reaches."""
    n = len(odds)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, w in enumerate(odds):
        edge(s, i, w, 0.0) if w > 0 else edge(i, t, -w, 0.0)
    for i, j, c in ties:
        edge(i, j, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                path, a = [], s
                continue
            while tried[a] < len(out[a]):
                e = out[a][tried[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                tried[a] += 1
            else:
                if a == s:
                    break
                e = path.pop()
                a = to[e ^ 1]
                tried[a] += 1


def extract(html: str, model: Model | None = None) -> str:
    """The content blocks of a page, one a line."""
    page = Page(html)
    if not page.blocks:
        return ""
    if model is None:
        from tidemark.llm.page_model import fitted

        model = fitted()
    return "\n".join(b.text for b, keep in zip(page.blocks, model.labels(page), strict=True) if keep)


def main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` without the html but with its main text and ``n_chars``."""
    from tidemark.llm.page_model import fitted

    model = fitted()
    keep = [c for c in pages.columns if c not in (html_col, out_col, "n_chars")]
    source = pages.select(*keep, text_of(html_col).alias("_td_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), model) for x in batch.column(batch.num_columns - 1)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), sizes], names=[*keep, out_col, "n_chars"])

    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField(out_col, T.StringType()), T.StructField("n_chars", T.LongType())])
    return source.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the main text of every row of ``pages``."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.col("html")))
