"""HTML extraction by maximum-scoring subsequence.

A page is read as a row of tokens: words, which score positive, and tags, which score negative.  The
weights are log-odds from labelled pages (those that mark their article), by kind of token: a word by
the block it stands in, a tag by its name, both by whether the page marks an article and they stand in
it.  One linear scan finds the contiguous region with the largest sum; the blocks it covers are the
main text.

Menus, adverts, notices, forms, comments and the like are told by weights, too: the log-odds of words
under a structural element, a role and a word of a class or an id.  Before any page is labelled they
have the values of PRIOR_OUT, which labelled pages then confirm or, for words of a class or an id,
overrule.  Words under an element whose weights speak against it score negative and are left out of the
region's text.  The largest
article (or main element) of a page, what it stands in, and body never count against their words.

Defined results: a null or empty page, or one without words, has an empty text; unclosed and stray
tags are tolerated; a tag that never ends is text; a page of any length is read whole, in linear time;
rows are extracted one by one, repeated ones and null ids too; of regions with equal sums the leftmost,
shortest counts; an empty table gives none.  Extra columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pages that the weights are taken from at most (in expectation).
LABELLED_PAGES = 400
#: Values in quotes may hold the sign that ends a tag; nothing here is tried twice.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
#: The same for what follows a tag that doesn't end: values in quotes end with the tag.
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
#: Elements whose content is not markup, and those that are no text at all.
RAW = frozenset(["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"])
NO_TEXT = frozenset(["script", "style", "noscript", "template", "head", "title", "textarea", "iframe", "svg", "canvas", "object", "button", "select", "option"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
INLINE = frozenset(["a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"])
#: Elements whose own weight counts; others are told by the kinds of their words and tags.
STRUCTURE = frozenset(["nav", "footer", "aside", "form", "menu", "dialog", "header"])
#: What speaks against main text before any page is labelled: elements, roles, words of a class or an id.
PRIOR_OUT = frozenset(
    [f"element:{x}" for x in STRUCTURE]
    + [f"role:{x}" for x in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "toolbar", "form")]
    + [f"attr:{x}" for x in ("ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "header", "footer", "cookie", "cookies", "consent", "notice", "notices", "popup", "modal", "newsletter", "subscribe", "subscription", "comment", "comments", "respond", "replies", "disqus", "related", "share", "sharing", "social", "toolbar", "masthead", "pagination", "pager", "skip", "login", "signup")]
)
#: Words that a feature is taken to have been seen with: inside and outside of articles.
SEEN, SEEN_PRIOR_OUT = (20, 20), (2, 20)
#: Weight of an element's features from which on its words are left out.
AGAINST = -1.0
#: Weights of kinds that no labelled page has, and of words that are left out.
DEFAULT = {"word": 1.0, "tag": -1.0}
LEFT_OUT = -0.3


def features(name: str, attributes: str, inside_main: bool) -> list[str] | None:
    """What may speak for or against an element's words; None if it holds no text to be read."""
    if name in NO_TEXT:
        return None
    found = [f"element:{name}"] if name in STRUCTURE and not (name == "header" and inside_main) else []
    if not attributes.strip():
        return found
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return None
        if key == "role":
            found.append(f"role:{value}")
        elif key in ("class", "id"):
            found += [f"attr:{w}" for w in value.split() if not (w == "header" and inside_main)]
    return found


def feature_weight(inside: int, outside: int, feature: str) -> float:
    """Log-odds of words with the feature to stand in an article."""
    a, b = SEEN_PRIOR_OUT if feature in PRIOR_OUT else SEEN
    # What an element or a role of this kind means is fixed, even where an article has one in it.
    return math.log(((0 if feature in PRIOR_OUT and not feature.startswith("attr:") else inside) + a) / (outside + b))


class Page:
    """Tokens and blocks of a page.

    A token is (kind, number of words or 0 for a tag, block, whether left out, features above it).  A page
    that marks its article is read twice: first to find the largest article and what it stands in.
    """

    def __init__(self, text: str, weight: dict[str, float] | None = None):
        self.weight = weight or {}
        self.main, self.around = -1, frozenset()
        self._read(text)
        if self.mains:
            # The article with most words, else the main element with most; the first of equals.
            self.main = max(self.mains, key=lambda k: (self.mains[k][0] == "article", self.mains[k][1], -k))
            self.around = frozenset(self.mains[self.main][2])
            self._read(text)

    def _read(self, text: str) -> None:
        self.tokens: list[tuple[str, int, int, bool, tuple[str, ...]]] = []
        self.blocks: list[list[tuple[str, bool]]] = [[]]
        #: Of each article or main element: name, words, numbers of the elements around it.
        self.mains: dict[int, list] = {}
        self.started = 0
        #: Open elements: name, block name, number, left out, in the article, features, open articles.
        self.open: list[tuple[str, str, int, bool, bool, tuple[str, ...], tuple[int, ...]]] = [("", "", -1, False, False, (), ())]
        self.count: Counter[str] = Counter()
        at, tag, end = 0, _TAG, len(text)
        while at < end:
            sign = text.find("<", at)
            if sign < 0:
                break
            after = text[sign + 1 : sign + 2]
            if after in ("!", "?") and after:
                m = _OTHER.match(text, sign)
                self._text(text[at:sign])
                at = m.end()
                continue
            m = None
            if after == "/" or after.isalpha() and after.isascii():
                m = tag.match(text, sign)
                if m is None and tag is _TAG and _PLAIN_TAG.match(text, sign, sign + 64) is None and text.find(">", sign) < 0:
                    break  # no tag ends any more
                if m is None and tag is _TAG and (after != "/" or text[sign + 2 : sign + 3].isalpha()):
                    tag = _PLAIN_TAG
                    m = tag.match(text, sign)
            if m is None:
                self._text(text[at : sign + 1])
                at = sign + 1
                continue
            self._text(text[at:sign])
            at = m.end()
            name = m[2].lower()
            self._tag(name, bool(m[1]), m[3])
            if name in RAW and not m[1] and not m[3].endswith("/"):
                close = re.compile(f"</{name}", re.I).search(text, at)
                at = close.start() if close else end
        self._text(text[at:])

    def _text(self, raw: str) -> None:
        if not raw:
            return
        _, block, _, out, inside, above, mains = self.open[-1]
        self.blocks[-1].append((html.unescape(raw), out))
        if n := len(raw.split()):
            self.tokens.append((f"word:{block}{self._side(inside)}", n, len(self.blocks) - 1, out, above))
            for k in mains:
                self.mains[k][1] += 0 if out else n

    def _side(self, inside: bool) -> str:
        """Where a token stands on a page that marks its article."""
        return "" if self.main < 0 else "@in" if inside else "@out"

    def _tag(self, name: str, closing: bool, attributes: str) -> None:
        if name == "br":
            self.blocks[-1].append((" ", False))
        elif name not in INLINE and self.blocks[-1]:
            self.blocks.append([])
        if closing:
            self._close(name)
        elif name in ("p", "li") and self.open[-1][1] == name:
            self._close(name)
        _, block, _, out, inside, above, mains = self.open[-1]
        self.tokens.append((f"tag:{name}{self._side(inside)}", 0, len(self.blocks) - 1, out, above))
        if closing or name in VOID or attributes.rstrip().endswith("/"):
            return
        number, self.started = self.started, self.started + 1
        if name in ("article", "main"):
            # Nested articles are rare and shallow; beyond some depth words count for the outer ones alone.
            self.mains[number] = [name, 0, [e[2] for e in self.open[-200:]]] if len(mains) < 8 else [name, 0, []]
            mains = (*mains, number) if len(mains) < 8 else mains
        if number == self.main:
            out, inside, above = False, True, ()
        elif number not in self.around and name not in ("body", "html"):
            own = features(name, attributes, inside)
            if own is None:
                out = True
            elif own:
                out = out or sum(self.weight[f] if f in self.weight else feature_weight(0, 0, f) for f in own) <= AGAINST
                above = (*above[-16:], *own)
        self.open.append((name, block if name in INLINE else name, number, out, inside, above, mains))
        self.count[name] += 1

    def _close(self, name: str) -> None:
        """Close the nearest open element of the name, and what is open in it; a stray end tag does nothing."""
        while self.count[name]:
            last = self.open.pop()[0]
            self.count[last] -= 1
            if last == name:
                return

    def content(self, first: int, last: int) -> str:
        """The text of blocks first..last but for what is left out, each with single spaces, an empty line between."""
        texts = (" ".join("".join(" " if out else text for text, out in self.blocks[b]).split()) for b in range(first, last + 1))
        return "\n\n".join(t for t in texts if t)


def kinds(page: Page) -> tuple[Counter, Counter]:
    """How often each kind of token and each feature stands inside and outside the marked article.

    Kinds count twice: with the side they stand on, and without, for pages that don't mark an article.
    What is left out for its features says nothing about kinds; for a feature the mark alone decides, so that
    evidence can overrule PRIOR_OUT.
    """
    inside, outside = Counter(), Counter()
    for kind, n, _, out, above in page.tokens:
        name, _, side = kind.partition("@")
        to = inside if side == "in" else outside
        if not out:
            to[kind] += n or 1
            to[name] += n or 1
        if n:
            for f in set(above):
                to[f] += n
    return inside, outside


def weights(inside: Counter, outside: Counter) -> dict[str, float]:
    """Log-odds of each kind of token and each feature; words never score below 0.05, tags never above -0.05."""
    out = {}
    total = [sum(n for k, n in c.items() if k.startswith(("word:", "tag:")) and "@" not in k) + 1 for c in (inside, outside)]
    for kind in {*inside, *outside}:
        if not kind.startswith(("word:", "tag:")):
            out[kind] = feature_weight(inside[kind], outside[kind], kind)
            continue
        odds = math.log((inside[kind] + 0.5) / total[0]) - math.log((outside[kind] + 0.5) / total[1])
        out[kind] = max(odds, 0.05) if kind.startswith("word:") else min(odds - 1, -0.05)
    return out


def token_score(kind: str, n: int, out: bool, weight: dict[str, float]) -> float:
    """Score of a run of words or of a tag; on a page that marks its article, words beside it count against."""
    if n and (out or kind.endswith("@out")):
        return LEFT_OUT * n
    name = kind.partition("@")[0]
    default = DEFAULT["word" if n else "tag"]
    each = weight.get(kind, weight.get(name, default))
    if kind.endswith("@in"):
        each = max(each, default) if n else max(each, -0.05)
    return each * (n or 1)


def best_run(scores: list[float]) -> tuple[int, int] | None:
    """(first, last) of the contiguous scores with the largest sum above 0; the leftmost, shortest of equals."""
    best, total, start, found = 0.0, 0.0, 0, None
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i)
    return found


def best_region(page: Page, weight: dict[str, float]) -> tuple[int, int] | None:
    """(first, last block) of the words in the best run of tokens."""
    found = best_run([token_score(kind, n, out, weight) for kind, n, _, out, _ in page.tokens])
    if found is None:
        return None
    at = [b for _, n, b, out, _ in page.tokens[found[0] : found[1] + 1] if n and not out]
    return (at[0], at[-1]) if at else None


def main_text(text: str, weight: dict[str, float]) -> str:
    page = Page(text, weight)
    region = best_region(page, weight)
    return page.content(*region) if region else ""


def learn(pages: DataFrame) -> dict[str, float]:
    """Weights from a bounded sample of the pages that mark their article."""
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    n = marked.count()
    if not n:
        return {}

    def count(batches):
        inside, outside = Counter(), Counter()
        for batch in batches:
            for text in batch.column("html").to_pylist():
                i, o = kinds(Page(text))
                inside.update(i)
                outside.update(o)
        names = sorted({*inside, *outside})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[k] for k in names], pa.int64()), pa.array([outside[k] for k in names], pa.int64())], ["kind", "inside", "outside"])

    sample = marked.where(common.by_hash("page_id", min(1.0, LABELLED_PAGES / n))).select("html")
    rows = sample.mapInArrow(count, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return weights(Counter({r["kind"]: r["inside"] for r in rows}), Counter({r["kind"]: r["outside"] for r in rows}))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    pages = pages.select("page_id", "url", "html")
    weight = learn(pages)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(t or "", weight) for t in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return common.map_texts(pages, work, "page_id long, url string, text string, n_chars long", text="html")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_html_extract over every page's whole html."""
    return extract(common.table(spark, sf_dir, "pages"))
