"""HTML extraction by composite text density.

A page becomes a tree of block nodes in page order; inline elements count as tags of their block. Scripts,
styles, form controls and hidden parts are no text and go first. Then densities decide:

1. Every node gets its link-adjusted characters per tag, times its weight. Names lower a weight, they cut
   nothing by themselves: an element or class that is called a menu, advert, sidebar, comment list, ... has the
   weight `STRONG`; a name in which such a word occurs only beside others loses weight by its share of
   link text. A node's weight holds for all below it.
2. Each node sums its children's densities; the node with the largest sum is the core. The least density on the
   path from the core up to the body is the threshold, the core's own density the threshold of named parts.
3. The core stays whole but for named parts under their threshold and bare link lists. Beside its path every subtree
   stays whose density reaches the threshold. An `article` (or else `main`) around the core is a prior: there a
   subtree needs no density, only not to be a named part or, in `main`, a link list. So do headings beside the path.

Pages are independent: one pass in Arrow batches, no shuffle; reading and deciding take linear time. Defined
results: null and empty pages and pages without text give ''; repeated rows give a row each; an empty table gives
no rows; a tag that never closes ends with its parent, a comment or script that never closes ends with the
page; an end tag that closes nothing counts for nothing; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed sets of element names.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
CUT_TAGS = frozenset("script style noscript iframe title head template svg canvas object embed button select option input textarea dialog audio video map noembed noframes datalist".split())
NAMED_TAGS = frozenset("nav footer aside form menu fieldset header".split())
NAMED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: What a start tag closes among open elements, and the elements that bound the search.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Words of class and id that as the last of a name say what it is: no part of an article.
STRONG_WORDS = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising banner promo sponsor sponsored sponsors dfp outbrain taboola "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar "
    "masthead header footer sidebar aside widget widgets recommendations cookie cookies consent gdpr notice notices notification popup modal overlay alert paywall "
    "comment comments commentlist disqus replies share sharing newsletter subscribe subscription signup login hidden".split()
)
#: Words that say so only together with links.
WEAK_WORDS = frozenset("promotion promoted side rail related recommended trending popular disclaimer respond reply discussion social search form copyright legal tabs skip".split())
#: Words behind which the one before is the last, and words before which a name says what is not there.
AFTER = frozenset("left right top bottom box wrap wrapper container list listing item items inner outer block section area bar body content text unit slot links link button buttons row col main primary secondary one two three first last".split())
WITHOUT = frozenset("no non has have with without hide".split())
#: Words beside which `header` names the article's own heading.
OWN_WORDS = frozenset("article post entry content story page".split())
#: Weight of a part whose name says that it is no article.
STRONG = 0.02

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)""", re.S)
PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def is_hidden(attrs: str) -> bool:
    return bool(attrs and HIDDEN.search(re.sub(r"""\b(?:class|id)\s*=\s*("[^"]*"|'[^']*')""", "", attrs)))


def named(tag: str, attrs: str, in_article: bool) -> int:
    """2 if an element's name says that it is no part of an article, 1 if it holds a word that may, else 0."""
    if tag in NAMED_TAGS and (tag != "header" or not in_article):
        return 2
    found = 0
    if not attrs or tag in ("html", "body"):
        return found
    for m in NAMES.finditer(attrs):
        for name in (m[2] or m[3] or m[4] or "").split():
            words = [w.lower() for w in PARTS.findall(name)]
            if m[1].lower() == "role":
                found = max(found, 2 * (name.lower() in NAMED_ROLES))
                continue
            if not words or words[0] in WITHOUT:
                continue
            while len(words) > 1 and words[-1] in AFTER:
                words.pop()
            if words[-1] == "header" and (in_article or OWN_WORDS & set(words)):
                continue
            if words[-1] in STRONG_WORDS:
                return 2
            if not (STRONG_WORDS | WEAK_WORDS).isdisjoint(words):
                found = max(found, 1)
    return found


class Page:
    """Nodes in page order, and the page's items: (node, text) or, at a block's edge, (node, None)."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.named = ["#page"], [-1], [0]
        self.tags, self.chars, self.link_tags, self.link_chars = [0], [0], [0], [0]
        self.items: list[tuple[int, str | None]] = []
        self._read(html)
        for n in range(len(self.tag) - 1, 0, -1):
            up = self.parent[n]
            self.tags[up] += self.tags[n] + 1
            self.chars[up] += self.chars[n]
            self.link_tags[up] += self.link_tags[n]
            self.link_chars[up] += self.link_chars[n]

    def _text(self, node: int, text: str, in_link: bool) -> None:
        text = unescape(text)
        self.items.append((node, text))
        n = len(" ".join(text.split()))
        self.chars[node] += n
        if in_link:
            self.link_chars[node] += n

    def _read(self, html: str) -> None:
        open_: list[tuple[str, int, bool, int, bool]] = []  # name of each open element, and what held outside it
        blocks: list[int] = []  # places of those that aren't inline
        count: dict[str, int] = {}
        node, links, cut, core, at = 0, 0, False, False, 0
        while at < len(html):
            lt = html.find("<", at)
            if lt < 0:
                lt = len(html)
            if lt > at and not cut:
                self._text(node, html[at:lt], links > 0)
            if lt == len(html):
                return
            m = TOKEN.match(html, lt) or PLAIN.match(html, lt)
            if not m:
                if not cut:
                    self._text(node, "<", links > 0)
                at = lt + 1
                continue
            at = m.end()
            if not m.lastindex or m[2] is None:
                continue
            tag = m[2].lower()
            until = len(open_)
            if m[1]:
                if not count.get(tag):
                    continue
                until = next(i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag)
            elif tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            elif tag not in INLINE:
                names, stops = CLOSES.get(tag, ((), ()))
                for k in reversed(blocks):
                    name = open_[k][0]
                    if name == "p" or name in names:
                        until = k
                    elif name in stops or name not in ("td", "th", "tr"):
                        break
            while len(open_) > until:
                name, node, cut, links, core = open_.pop()
                count[name] -= 1
                if name not in INLINE:
                    blocks.pop()
                    self.items.append((node, None))
            if m[1]:
                continue
            attrs = m[3]
            if tag in VOID:
                if not cut:
                    self.tags[node] += 1
                    self.items.append((node, " " if tag in INLINE else None))
                continue
            if tag not in INLINE:
                blocks.append(len(open_))
            open_.append((tag, node, cut, links, core))
            count[tag] = count.get(tag, 0) + 1
            cut = cut or tag in CUT_TAGS or is_hidden(attrs)
            if cut:
                if tag not in INLINE:
                    self.items.append((node, None))
                continue
            said = named(tag, attrs, core)
            core = core or tag in ("article", "main")
            if tag == "a":
                links += 1
                self.link_tags[node] += 1
            if tag in INLINE and said < 2:
                self.tags[node] += 1
                continue
            self.tag.append(tag)
            self.parent.append(node)
            self.named.append(said)
            for x in (self.tags, self.chars, self.link_tags, self.link_chars):
                x.append(0)
            node = len(self.tag) - 1
            if tag not in INLINE:
                self.items.append((node, None))

    def densities(self) -> list[float]:
        """Link-adjusted characters per tag of every node."""
        top = max((n for n in range(len(self.tag)) if self.tag[n] in ("body", "#page")), key=lambda n: self.tag[n] == "body")
        body = self.link_chars[top] / max(1, self.chars[top])
        out = []
        for c, t, lc, lt in zip(self.chars, self.tags, self.link_chars, self.link_tags, strict=True):
            t = max(1, t)
            inner = c / max(1, lc) * t / max(1, lt)
            if not c or inner <= 1:
                out.append(0.0)
                continue
            base = math.log(math.log(c / max(1, c - lc) * lc + body * c + math.e))
            out.append(c / t * math.log(inner) / max(1.0, base))
        return out

    def factor(self, n: int) -> float:
        """What a node's own name leaves of its weight."""
        if self.named[n] == 1:
            return max(STRONG, 1 - 2 * self.link_chars[n] / max(1, self.chars[n]))
        return STRONG if self.named[n] else 1.0

    def weighted(self) -> list[float]:
        """Every node's density times the weights of its own and its ancestors' names."""
        weight = [self.factor(0)]
        for n in range(1, len(self.tag)):
            weight.append(weight[self.parent[n]] * self.factor(n))
        return [d * w for d, w in zip(self.densities(), weight, strict=True)]

    def core(self, density: list[float]) -> int:
        """The node with the largest sum of its children's densities."""
        total = [0.0] * len(density)
        for n in range(1, len(density)):
            total[self.parent[n]] += density[n]
        return max(range(len(density)), key=lambda n: (total[n], density[n], -n))

    def link_list(self, n: int, share: float) -> bool:
        return self.link_tags[n] > 1 and self.link_chars[n] > share * self.chars[n]

    def kept(self) -> list[bool]:
        """Which nodes' own text belongs to the article."""
        density = self.weighted()
        core = self.core(density)
        path = [core]
        while self.parent[path[-1]] >= 0:
            path.append(self.parent[path[-1]])
        on_path, most = set(path), density[core]
        least = min((density[n] for n in path if self.tag[n] not in ("#page", "html")), default=0.0)
        prior = next((n for name in ("article", "main") for n in reversed(path) if self.tag[n] == name), -1)
        keep, whole, scope = [True], [core == 0], [False]  # whole: in the core or in a subtree that stays; scope: in the prior
        for n in range(1, len(self.tag)):  # parents come first
            up = self.parent[n]
            scope.append(scope[up] or n == prior)
            if n in on_path:
                keep.append(True)
                whole.append(whole[up] or n == core)
                continue
            out = not keep[up] or self.factor(n) < 1 and density[n] <= most
            if not out and not (scope[n] and self.tag[prior] == "article"):
                if whole[up] or scope[n]:
                    out = self.link_tags[n] > 2 and self.link_list(n, 0.8)
                else:
                    out = self.link_list(n, 0.5) or density[n] < least and self.tag[n] not in HEADINGS
            keep.append(not out)
            whole.append(not out)
        return keep

    def text(self) -> str:
        keep, blocks, now = self.kept(), [], []
        for node, text in [*self.items, (0, None)]:
            if text is None:
                if block := " ".join("".join(now).split()):
                    blocks.append(block)
                now = []
            elif keep[node]:
                now.append(text)
        return "\n".join(blocks)


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return given.mapInArrow(run, "page_id long, url string, text string, n_chars long")
