"""Main text of web pages: flat text blocks and a decision tree.

A page becomes a list of flat blocks, the texts between block-level tags.  A block has its
word count and link density, those of the blocks before and after it, and what the markup
says about its place.  Short articles beside much longer text are teasers and mark nothing.  Classes and ids of an element do not set it aside if it is the page,
a main element or an article, or holds a main element; if they set all articles of a page
aside, the outermost of them count for nothing.  A form around most of the words of a page
is a wrapper.  A heading like "Comments" sets the rest of its element aside.  A link goes on
until it is closed, whatever blocks it holds.  A decision tree grown on a small table of labelled blocks keeps or
drops each one.

Of a page without articles on which the tree keeps nothing, all that is neither set aside nor
a list of links stays.

Defined results: a null or empty page has an empty text; text without any tag is one
block; character references are decoded once; white space, the no-break space included,
is one blank inside a block; unclosed tags end with the element around them, a tag cut off
at the end of the page is dropped.  Very long pages pass in one piece; repeated rows have
equal results; an empty table gives an empty one.  Columns of ``pages`` stay, whatever their
names, but for those of the result.  Pages are independent of each other.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import fresh

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[a-z]+")

# Elements without text of the page.
SILENT = {
    "script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "head", "title",
    "select", "textarea", "button", "audio", "video", "math",
}
# Elements that end a block.
BREAKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
# Those of them that are remembered until they are closed.
NESTED = {
    "article", "aside", "blockquote", "body", "details", "dialog", "div", "dl", "fieldset", "figure",
    "footer", "form", "header", "main", "menu", "nav", "ol", "section", "table", "ul",
}
ASIDE = {"aside", "dialog", "footer", "menu", "nav"}
ASIDE_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "menu", "navigation", "search"}
# Words in classes and ids of what is not the article.
ASIDE_NAMES = {
    "ad", "ads", "advert", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "gdpr", "legal",
    "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pager",
    "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "respond",
    "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
# Those of them that a paragraph of the article may have as well.
TOPICS = {"copyright", "disclaimer", "legal", "related", "respond", "social"}
# Headings of reader comments: what follows in the same element belongs to them.
COMMENT_TITLE = re.compile(
    r"(?:\d+ )?(?:reader |user |leser)?(?:comments?|kommentare?|commentaires?|comentarios?)(?: \(?\d+\)?)?:?", re.I
)
# Beginnings of such words, for names written without a break.
ASIDE_STEMS = ("adsby", "advert", "breadcrumb", "comments", "commentlist", "cookie", "newsletter", "sidebar", "sponsor")
HEADERS = {"header", "masthead", "topbar"}
# Elements whose classes and ids speak of the whole page or article ("no-sidebar", "comments-open").
WHOLE = {"html", "body", "main", "article"}

FEATURES = [
    "words", "links", "words_before", "links_before", "words_after", "links_after",
    "in_article", "beside_article", "set_aside", "heading",
]
# Labelled blocks: the features in order, then 1 for main text.
LABELLED = [
    # articles marked as such: headings, paragraphs of all lengths, lists and quotes in them
    (6, 0.0, 12, 0.0, 60, 0.0, 1, 0, 0, 1, 1), (3, 0.0, 2, 1.0, 15, 0.0, 1, 0, 0, 1, 1),
    (1, 0.0, 40, 0.0, 80, 0.0, 1, 0, 0, 0, 1), (2, 0.0, 30, 0.0, 0, 0.0, 1, 0, 0, 0, 1),
    (14, 0.0, 6, 0.0, 70, 0.0, 1, 0, 0, 0, 1), (45, 0.1, 14, 0.0, 90, 0.0, 1, 0, 0, 0, 1),
    (120, 0.0, 45, 0.1, 20, 0.3, 1, 0, 0, 0, 1), (8, 0.6, 50, 0.0, 9, 0.5, 1, 0, 0, 0, 1),
    (4, 1.0, 70, 0.0, 60, 0.1, 1, 0, 0, 0, 1), (400, 0.02, 6, 0.0, 5, 0.0, 1, 0, 0, 0, 1),
    (2, 0.0, 1, 0.0, 1, 1.0, 1, 0, 0, 0, 1), (1, 1.0, 2, 1.0, 1, 1.0, 1, 0, 0, 0, 0),
    (5, 0.5, 3, 1.0, 4, 0.9, 1, 0, 0, 0, 1), (3, 0.0, 0, 0.0, 2, 1.0, 1, 0, 0, 1, 1),
    (9, 0.8, 1, 1.0, 1, 0.0, 1, 0, 0, 0, 0), (25, 0.7, 8, 0.6, 6, 1.0, 1, 0, 0, 0, 0),
    # inside articles, but set aside: notices, adverts, share bars, comments, forms
    (10, 0.0, 45, 0.0, 60, 0.0, 1, 0, 1, 0, 0), (4, 1.0, 80, 0.0, 4, 1.0, 1, 0, 1, 0, 0),
    (30, 0.0, 90, 0.0, 25, 0.0, 1, 0, 1, 0, 0), (75, 0.0, 3, 0.0, 40, 0.0, 1, 0, 1, 0, 0),
    (2, 0.0, 30, 0.0, 35, 0.0, 1, 0, 1, 1, 0), (5, 0.2, 60, 0.0, 0, 0.0, 1, 0, 1, 0, 0),
    # beside an article: menus, page headers and footers, adverts, sidebars, comments
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 1, 0, 0), (2, 1.0, 1, 1.0, 12, 0.0, 0, 1, 1, 0, 0),
    (12, 0.0, 2, 1.0, 7, 0.0, 0, 1, 1, 0, 0), (18, 0.0, 80, 0.0, 0, 0.0, 0, 1, 1, 0, 0),
    (5, 0.0, 0, 0.0, 1, 1.0, 0, 1, 0, 1, 0), (25, 0.0, 30, 0.0, 18, 0.0, 0, 1, 0, 0, 0),
    (60, 0.05, 25, 0.0, 5, 0.0, 0, 1, 0, 0, 0), (9, 0.9, 60, 0.0, 3, 1.0, 0, 1, 0, 0, 0),
    (3, 0.0, 110, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (140, 0.0, 90, 0.0, 3, 0.0, 0, 1, 1, 0, 0),
    # pages that mark no article: long text without links, and short blocks next to it
    (60, 0.0, 8, 0.0, 45, 0.0, 0, 0, 0, 0, 1), (35, 0.1, 60, 0.0, 20, 0.0, 0, 0, 0, 0, 1),
    (18, 0.0, 40, 0.1, 55, 0.0, 0, 0, 0, 0, 1), (15, 0.2, 30, 0.0, 6, 0.0, 0, 0, 0, 0, 1),
    (6, 0.0, 2, 1.0, 50, 0.0, 0, 0, 0, 1, 1), (4, 0.0, 45, 0.0, 38, 0.0, 0, 0, 0, 0, 1),
    (9, 0.0, 25, 0.0, 33, 0.05, 0, 0, 0, 0, 1), (90, 0.2, 12, 0.0, 4, 1.0, 0, 0, 0, 0, 1),
    (5, 0.0, 1, 1.0, 30, 0.0, 0, 0, 0, 1, 1), (4, 0.0, 2, 1.0, 27, 0.0, 0, 0, 0, 1, 1),
    (2, 0.0, 6, 0.5, 80, 0.0, 0, 0, 0, 1, 1), (8, 0.0, 3, 1.0, 22, 0.1, 0, 0, 0, 1, 1),
    (11, 0.0, 20, 0.0, 2, 1.0, 0, 0, 0, 0, 1), (3, 0.0, 28, 0.0, 24, 0.0, 0, 0, 0, 0, 1),
    (22, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    # pages that mark no article: link lists, short scraps, asides
    (1, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (3, 1.0, 2, 1.0, 40, 0.0, 0, 0, 0, 0, 0),
    (6, 0.9, 30, 0.0, 4, 1.0, 0, 0, 0, 0, 0), (14, 0.8, 5, 1.0, 6, 0.9, 0, 0, 0, 0, 0),
    (30, 0.7, 20, 0.6, 25, 0.8, 0, 0, 0, 0, 0), (2, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0, 0),
    (4, 0.0, 3, 0.0, 2, 0.0, 0, 0, 0, 0, 0), (7, 0.0, 50, 0.0, 0, 0.0, 0, 0, 1, 0, 0),
    (40, 0.0, 70, 0.0, 12, 0.0, 0, 0, 1, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 1, 0),
]
# Neighbours: none, a link and a paragraph.
_AROUND = [(*before, *after) for before in ((0, 0.0), (2, 1.0), (60, 0.0)) for after in ((0, 0.0), (2, 1.0), (60, 0.0))]
# blocks beside each of them: what is set aside, in articles, beside them, on pages without
LABELLED += [(w, d, *n, *at, 1, h, 0) for w in (2, 30, 120) for d, h in ((0.0, 0), (1.0, 0), (0.0, 1)) for n in _AROUND for at in ((1, 0), (0, 1), (0, 0))]
LABELLED += [(w, d, *n, 1, 0, 0, h, 1) for w in (1, 4, 12, 30, 120) for d, h in ((0.0, 0), (0.3, 0), (0.0, 1)) for n in _AROUND]
LABELLED += [(w, d, *n, 1, 0, 0, 0, int(1.0 not in n)) for w in (1, 4, 12, 30) for d in (0.8, 1.0) for n in _AROUND]
LABELLED += [(w, d, *n, 0, 1, 0, 0, 0) for w in (2, 12, 30, 120) for d in (0.0, 1.0) for n in _AROUND]
LABELLED += [(w, d, *n, 0, 0, 0, 0, 1) for w in (18, 30, 120) for d in (0.0, 0.2) for n in _AROUND]
LABELLED += [(w, d, *n, 0, 0, 0, 0, 0) for w in (1, 4, 12, 30) for d in (0.7, 0.9, 1.0) for n in _AROUND]
DEPTH = 6
# Articles with fewer words than this are teasers if there is twice as much long text beside them.
TEASER, LONG = 50, 15


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = DEPTH):
    """A CART tree by Gini impurity: (feature, threshold, low branch, high branch) or a label."""
    share = labels.mean()
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)
    best = None
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for threshold in (values[1:] + values[:-1]) / 2:
            low = rows[:, feature] < threshold
            a, b = labels[low].mean(), labels[~low].mean()
            impurity = low.sum() * a * (1 - a) + (~low).sum() * b * (1 - b)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, feature, float(threshold), low)
    if best is None:
        return int(share >= 0.5)
    _, feature, threshold, low = best
    return (feature, threshold, grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1))


def fitted_tree(labelled: list[tuple] = LABELLED):
    data = np.array(labelled, float)
    return grow(data[:, :-1], data[:, -1])


def is_main(tree, features: tuple) -> bool:
    while not isinstance(tree, int):
        feature, threshold, low, high = tree
        tree = low if features[feature] < threshold else high
    return bool(tree)


def _says_aside(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether element, role or hidden set it aside, and whether a class or id, or its being a
    form, hints at it."""
    if tag in ASIDE or (tag == "header" and not in_article):
        return True, False
    hint = tag == "form"
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, False
        if name == "role":
            if value in ASIDE_ROLES and not (value == "banner" and in_article):
                return True, False
            hint |= value == "form"
        elif name in ("class", "id") and tag not in WHOLE:
            words = set(NAME.findall(value))
            if "hoc" in words:
                words.discard("ad")
            if tag not in NESTED:
                words -= TOPICS
            hint |= bool(words & ASIDE_NAMES or (words & HEADERS and not in_article))
            hint |= any(word.startswith(ASIDE_STEMS) for word in words)
    return False, hint


class _Hint:
    """A class or id that sets an element aside, below the hints around it."""

    def __init__(self, around: _Hint | None, is_form: bool = False) -> None:
        self.around, self.is_form = around, is_form
        self.words, self.has_text = 0, False
        self.holds = self.void = False
        self.depth = 0


def _settle(hints: list[_Hint], mains: list[_Hint], articles: list[_Hint | None], total: int) -> None:
    """Void the hints around main elements, and the outermost around articles until one is not set aside."""
    for hint in hints:
        # a form around most of the page is a wrapper
        hint.void |= hint.is_form and hint.has_text and 2 * hint.words >= total
    for hint in mains:
        while hint and not hint.void:
            hint.void, hint = True, hint.around
    for hint in hints:  # outer ones come first
        hint.depth = (hint.around.depth if hint.around else 0) + (not hint.void)
    for hint in articles:
        while hint and not hint.holds:
            hint.holds, hint = True, hint.around
    least = min((a.depth if a else 0 for a in articles), default=0)
    for hint in hints:
        hint.void |= hint.holds and hint.depth <= least
        hint.depth = (hint.around.depth if hint.around else 0) + (not hint.void)


def flat_blocks(page: str) -> list[tuple[str, int, float, int, int, int]]:
    """(text, words, link density, number of the article or 0, set_aside, heading) in page order."""
    blocks: list[tuple] = []
    parts: list[str] = []
    linked = 0  # words of the block inside links
    link_depth = link_at = 0  # a link ends with the element it began in
    stack: list[tuple[str, int, bool, _Hint | None]] = []  # tag, article, set aside, by hint
    n_articles = 0
    hints: list[_Hint] = []
    mains: list[_Hint] = []
    articles: list[_Hint | None] = []
    own_aside = heading = False

    def end() -> None:
        nonlocal linked
        if parts:
            words = html.unescape("".join(parts)).split()
            parts.clear()
            if words:
                tag, article, aside, hint = stack[-1] if stack else ("", 0, False, None)
                density = min(1.0, linked / len(words))
                if heading and stack and len(words) < 5 and COMMENT_TITLE.fullmatch(" ".join(words)):
                    aside = True
                    stack[-1] = (tag, article, aside, hint)
                around = hint
                while around:
                    around.words += len(words)
                    around.has_text |= len(words) >= LONG and density < 0.5
                    around = around.around
                blocks.append((" ".join(words), len(words), density, article, (aside or own_aside, hint), int(heading)))
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if link_depth:
                linked += len(text.split())

    at, find = 0, TAG.search
    while True:
        tag = find(page, at)
        if tag is None:
            add(page[at:])
            break
        add(page[at : tag.start()])
        at = tag.end()
        closing = tag[1] if tag[2] else tag[4]
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        attributes = tag[3] or tag[6] or ""
        if name in SILENT:
            if not closing and not attributes.endswith("/"):
                gone = re.compile(f"</{re.escape(name)}(?=[\\s>/])[^>]*>", re.I).search(page, at)
                at = gone.end() if gone else (at if name in ("head", "title") else len(page))
            parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            link_depth, link_at = (0 if closing else 1), len(stack)
        elif name in BREAKS:
            end()
            if closing:
                own_aside = heading = False
                if name in NESTED and any(entry[0] == name for entry in stack):
                    while stack.pop()[0] != name:
                        pass
                    if len(stack) < link_at:
                        link_depth = 0
                continue
            _, article, aside, hint = stack[-1] if stack else ("", 0, False, None)
            if name in ("article", "main") and not article:
                article = n_articles = n_articles + 1
            says, hinted = _says_aside(name, attributes, article > 0)
            heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
            own_aside = (says or hinted) and name not in NESTED
            if name in NESTED:
                aside = aside or says
                if hinted:
                    hint = _Hint(hint, name == "form")
                    hints.append(hint)
                if name == "article" and not aside:
                    articles.append(hint)
                elif name == "main" and not aside and hint:
                    mains.append(hint)
                stack.append((name, article, aside, hint))
    end()
    _settle(hints, mains, articles, sum(b[1] for b in blocks))
    return [(*b[:4], int(b[4][0] or bool(b[4][1] and b[4][1].depth)), b[5]) for b in blocks]


def _only_teasers(blocks: list[tuple]) -> int:
    """How many articles there are if they are all teasers of other pages, else 0."""
    plain: dict[int, float] = {}
    beside = 0.0
    for _, words, density, article, aside, _ in blocks:
        if article:
            plain[article] = plain.get(article, 0.0) + (0 if aside else words * (1 - density))
        elif not aside and density < 0.5 and words >= LONG:
            beside += words * (1 - density)
    largest = max(plain.values(), default=0.0)
    return len(plain) if largest < TEASER and beside > 2 * largest else 0


def main_text(page: str | None, tree) -> tuple[str, int, int]:
    """The main text, how many blocks it has and how many the page has."""
    blocks = flat_blocks(page or "")
    marked = any(b[3] for b in blocks)
    teasers = _only_teasers(blocks)
    kept = []
    for i, (text, words, density, article, aside, heading) in enumerate(blocks):
        before = blocks[i - 1] if i else ("", 0, 0.0)
        after = blocks[i + 1] if i + 1 < len(blocks) else ("", 0, 0.0)
        features = (
            words, density, before[1], before[2], after[1], after[2],
            int(article > 0 and teasers < 2), int(marked and not article and not teasers), aside, heading,
        )
        if is_main(tree, features):
            kept.append(text)
    if not kept and not marked:
        # a short page: all that the markup does not set aside and that is no list of links
        kept = [b[0] for b in blocks if not b[4] and b[2] < 0.5]
    return "\n".join(kept), len(kept), len(blocks)


def extract(pages: DataFrame, html_col: str = "html", labelled: list[tuple] = LABELLED) -> DataFrame:
    """``pages`` without ``html_col``, with text, n_chars, n_blocks and n_kept."""
    tree = fitted_tree(labelled)

    @F.pandas_udf("text string, n_kept int, n_blocks int")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([main_text(p, tree) for p in batch], columns=["text", "n_kept", "n_blocks"])

    own, name = ["text", "n_chars", "n_blocks", "n_kept"], fresh(pages, "_found")
    kept = [c for c in pages.columns if c not in (html_col, *own)]
    found = pages.select(*kept, extracted(F.col(html_col).cast("string")).alias(name))
    return found.select(
        *kept,
        F.col(f"{name}.text").alias("text"),
        F.length(f"{name}.text").cast("long").alias("n_chars"),
        F.col(f"{name}.n_blocks").alias("n_blocks"),
        F.col(f"{name}.n_kept").alias("n_kept"),
    )
