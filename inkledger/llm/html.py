"""Main-text extraction from web pages by boosted trees over DOM nodes.

A page is parsed to a tree. Every element gets features of its tag, its attributes' words, its place, its siblings and its
subtree; boosted trees give the log odds that it belongs to the article, and further trees correct them by the odds of the
element's ancestors and children. Decoding is hierarchical: the set of kept elements of greatest total log
odds is chosen among those in which no kept element has a dropped ancestor.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import BATCH_MB, bounded_batches, portions

# Element names by role, and words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe template".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "tbody": ("tbody thead tfoot tr td th", ("table",)), "tfoot": ("tbody thead tr td th", ("table",)), "option": ("option", ("select",)), "body": ("head", ()),
}
GROUPS = {
    name: k
    for k, names in enumerate(
        "article main|nav menu|header|footer|aside|form fieldset search|p|h1 h2 h3 h4 h5 h6|li dt dd|ul ol dl|div center|section|table tbody thead tfoot tr td th caption|"
        "button input select label option textarea legend|blockquote pre figure figcaption code address|body html|a".split("|")
    )
    for name in names.split()
}
KINDS = max(GROUPS.values()) + 2
WORDS = {
    "edge": "nav navbar navigation menu header masthead topbar footer bottom sidebar side aside rail breadcrumb breadcrumbs toolbar pagination pager skip copyright colophon banner contentinfo complementary search login signin signup",
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay newsletter subscribe subscription paywall message announcement",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted commercial dfp adsense",
    "widget": "widget share sharing social related recommended recommendations popular trending tags tag form author-box meta",
    "comment": "comment comments commentlist disqus discussion reply replies respond feedback review reviews thread",
    "content": "article articles content main post entry story body text page copy single hentry document prose blog",
}
#: The list that speaks for main text is the last; groups of elements that speak against it.
KEEP = len(WORDS) - 1
DROPS = [GROUPS[name] for name in ("nav", "footer", "aside", "form")]
WORD_OF = {word: k for k, words in enumerate(WORDS.values()) for word in words.split()}
ATTRIBUTES = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|</(?![a-zA-Z])[^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)[^>]*+>?", re.S
)


class Page:
    """Elements in document order, and the text runs between tags, each with its element and its block."""

    __slots__ = ("tags", "parents", "ends", "attributes", "runs")

    def __init__(self, source: str):
        self.tags, self.parents, self.ends, self.attributes = ["#root"], [-1], [0], [""]
        self.runs: list[tuple[int, int, str]] = []
        stack, block, at, size = [0], 0, 0, len(source)
        tags, parents, ends, runs = self.tags, self.parents, self.ends, self.runs

        def shut(depth: int) -> None:
            while len(stack) > depth:
                ends[stack.pop()] = len(tags)

        while at < size:
            found = TOKEN.search(source, at)
            if found is None:
                runs.append((stack[-1], block, source[at:]))
                break
            if found.start() > at:
                runs.append((stack[-1], block, source[at : found.start()]))
            at = found.end()
            name = found[2]
            if name is None:
                continue
            name = name.lower()
            is_block = name in BLOCK
            block += is_block
            if found[1]:
                for depth in range(len(stack) - 1, 0, -1):
                    if tags[stack[depth]] == name:
                        shut(depth)
                        break
                    if tags[stack[depth]] in ("table", "td", "th") and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "td", "th", "div", "article", "main", "section"):
                        break
                continue
            if name in ("html", "body") and name in (tags[k] for k in stack):
                continue
            if is_block and "p" in [tags[k] for k in stack]:
                for depth in range(len(stack) - 1, 0, -1):
                    tag = tags[stack[depth]]
                    if tag == "p":
                        shut(depth)
                        break
                    if tag in BLOCK:
                        break
            if name in CLOSES:
                names, bounds = CLOSES[name]
                last = 0
                for depth in range(len(stack) - 1, 0, -1):
                    tag = tags[stack[depth]]
                    if tag in bounds:
                        break
                    if tag in names.split():
                        last = depth
                if last:
                    shut(last)
            if name == "br":
                runs.append((stack[-1], block, " "))
            tags.append(name)
            parents.append(stack[-1])
            ends.append(len(tags))
            self.attributes.append(found[3])
            if name in RAW and not found[3].endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = close.end() if close else size
            elif name not in VOID and not (found[3].endswith("/") and name not in BLOCK):
                stack.append(len(tags) - 1)
        shut(0)


@cache
def _words(value: str) -> tuple[int, ...]:
    counts = [0] * len(WORDS)
    for part in PARTS.findall(value):
        k = WORD_OF.get(part.lower())
        if k is not None:
            counts[k] += 1
    return tuple(counts)


def attribute_words(attributes: str) -> tuple[int, ...]:
    """How many words of each list the class, id and role attributes hold; the last number tells hidden elements."""
    if not attributes:
        return (0,) * (len(WORDS) + 1)
    values = " ".join(a or b or c for a, b, c in ATTRIBUTES.findall(attributes))
    counts = _words(values) if len(values) < 200 else _words.__wrapped__(values)
    return (*counts, int(HIDDEN.search(attributes) is not None))


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row per element of all pages in order; and each element's parent and the end of its subtree, as rows."""
    counts = np.array([len(p.tags) for p in pages])
    base = np.cumsum(counts) - counts
    n = int(counts.sum())
    first = np.repeat(base, counts)
    parent = np.concatenate([np.array(p.parents) for p in pages]) + first
    ends = np.concatenate([np.array(p.ends) for p in pages]) + first
    rows = np.arange(n)
    root = rows == first
    parent[root] = rows[root]
    kind = np.array([GROUPS.get(t, KINDS - 1) for p in pages for t in p.tags])
    words = np.array([attribute_words(a) for p in pages for a in p.attributes])
    own = np.zeros((n, 4))
    links = kind == GROUPS["a"]
    linked = np.zeros(n, dtype=bool)
    level = np.zeros(n, dtype=np.int64)
    # Ancestors first: what is above an element.
    above = np.zeros((n, len(WORDS) + 1 + KINDS), dtype=np.int64)
    at = np.concatenate((words, np.eye(KINDS, dtype=np.int64)[kind]), axis=1)
    for k in range(n):
        q = parent[k]
        if q != k:
            level[k] = level[q] + 1
            above[k] = above[q] + at[q]
            linked[k] = linked[q] or links[k]
    for p, b in zip(pages, base.tolist(), strict=True):
        for node, _, text in p.runs:
            size = len(text) - text.count(" ") - text.count("\n")
            if size:
                own[b + node, 0] += size
                own[b + node, 1] += size * linked[b + node]
                own[b + node, 2] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
                own[b + node, 3] += 1
    sums = np.zeros((n + 1, 7))
    extra = np.stack((kind == GROUPS["p"], links, kind == GROUPS["input"]), axis=1)
    np.cumsum(np.concatenate((own, extra), axis=1), axis=0, out=sums[1:])
    tree = sums[ends] - sums[rows]
    text = tree[:, 0]
    total = text[first]
    size = ends - rows
    children = np.bincount(parent[~root], minlength=n)
    family = np.maximum(children[parent], 1)
    order = np.zeros(n)
    seen: dict[int, int] = {}
    for k in range(n):
        order[k] = seen.get(parent[k], 0)
        seen[parent[k]] = order[k] + 1
    same = np.bincount(parent * KINDS + kind, minlength=n * KINDS)[parent * KINDS + kind]
    beside = np.bincount(parent[~root], weights=text[~root], minlength=n)
    before = sums[rows, 0] - sums[first, 0]
    numbers = [
        np.log1p(text), np.log1p(own[:, 0]), tree[:, 1] / np.maximum(text, 1), text / np.maximum(size, 1), level, np.log1p(children), order / family, same / family,
        np.log1p(beside[parent] / family), text / np.maximum(beside[parent], 1), tree[:, 2] / np.maximum(text, 1), text / np.maximum(total, 1), before / np.maximum(total, 1),
        np.log1p(tree[:, 4]), np.log1p(tree[:, 5]), tree[:, 6], np.log1p(size),
        # Words that speak for dropping and for keeping, of the element and of what is above it.
        words[:, :KEEP].sum(axis=1), above[:, :KEEP].sum(axis=1), words[:, KEEP], np.minimum(above[:, KEEP] + above[:, len(WORDS) + 1 + GROUPS["article"]], 3),
        above[:, len(WORDS) + 1 + np.array(DROPS)].sum(axis=1), [bool(a.strip()) for p in pages for a in p.attributes],
    ]
    x = np.concatenate((np.stack(numbers, axis=1), kind[:, None], np.eye(KINDS)[kind], words, np.minimum(above, 3)), axis=1)
    return x, parent, ends


#: The column of an element's depth.
LEVEL = 4


def context(level: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """The odds around each element, of rows in document order: its own, its parent's, the least above it, its children's mean."""
    n = len(odds)
    parent, least, at = np.arange(n), odds.copy(), {}
    for k, depth in enumerate(level.astype(np.int64).tolist()):
        if depth:
            q = parent[k] = at[depth - 1]
            least[k] = min(odds[q], least[q])
        at[depth] = k
    inner = parent != np.arange(n)
    sums, counts = np.bincount(parent[inner], odds[inner], n), np.bincount(parent[inner], minlength=n)
    return np.stack((odds, odds[parent], least, np.where(counts > 0, sums / np.maximum(counts, 1), odds)), axis=1)


class Layered:
    """Boosted trees over an element's features, and boosted trees over these and the first ones' odds around it."""

    def __init__(self, rounds: int):
        self.first, self.second = Boosted(rounds=rounds, share=0.2), Boosted(rounds=rounds, share=0.2, seed=2)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Layered":
        """The second trees learn from other pages than the first, so that they see odds as they will be."""
        page = np.cumsum(x[:, LEVEL] == 0) - 1
        inner, one = x[:, LEVEL] > 0, page <= page[-1] // 2
        self.first.fit(x[inner & one], y[inner & one])
        rest, more = ~one, inner[~one]
        self.second.fit(self._seen(x[rest])[more], y[rest][more])
        return self

    def _seen(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, context(x[:, LEVEL], np.clip(self.first.margins(x), -6, 6))), axis=1)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row; rows are whole pages in document order."""
        return self.second.margins(self._seen(x)) if len(x) else np.zeros(0)


def decoded(odds: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Kept elements: the greatest sum of log odds of which no kept element has a dropped parent. Parents come first in order."""
    best = odds.copy()
    for k in range(len(odds) - 1, -1, -1):
        q = parent[k]
        if q != k and best[k] > 0:
            best[q] += best[k]
    kept = best > 0
    for k in range(len(odds)):
        q = parent[k]
        if q != k and not kept[q]:
            kept[k] = False
    return kept


def main_texts(sources: list[str], model: Layered) -> list[str]:
    """The main text of each page."""
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    x, parent, _ = features(pages)
    odds = np.clip(model.margins(x), -6, 6)
    # A root is no element; it joins the rest and is always open.
    roots = np.flatnonzero(parent == np.arange(len(parent)))
    odds[roots] = 1.0
    kept, out = decoded(odds, parent), []
    for page, base in zip(pages, roots.tolist(), strict=True):
        blocks: dict[int, list[str]] = {}
        for node, block, text in page.runs:
            if kept[base + node]:
                blocks.setdefault(block, []).append(text)
        texts = ("".join(parts) for parts in blocks.values())
        lines = (" ".join((entities.unescape(t) if "&" in t else t).split()) for t in texts)
        out.append("\n".join(line for line in lines if line))
    return out


class _Maker:
    """Invents pages whose main text is known. A tag's data-k attribute tells its label and is removed afterwards."""

    def __init__(self, seed: int):
        r = self.r = random.Random(seed)
        parts = ("ka", "lo", "mi", "ren", "tu", "sol", "va", "per", "in", "de")
        self.plain = ["".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(4000)]
        # Some end a sentence or a clause.
        self.ended = [w + ("." if k % 100 < 8 else "," if k % 100 < 14 else "") for k, w in enumerate(self.plain)]

    def words(self, low: int, high: int, sentence: bool = True) -> str:
        r = self.r
        out = r.choices(self.ended if sentence else self.plain, k=r.randint(low, high))
        if sentence:
            return " ".join(out).capitalize() + ("." if r.random() < 0.9 else "")
        return " ".join(out)

    def attrs(self, words: str, hint: float = 0.75) -> str:
        r = self.r
        if r.random() > hint:
            return r.choice(("", f' class="{r.choice("abcxyz")}{r.randint(1, 99)}"', f' class="col-{r.randint(1, 12)} row"'))
        word = r.choice(words.split())
        word = r.choice((word, word, f"{word}-{r.choice(('box', 'wrap', 'inner', 'block', 'area'))}", f"site-{word}", f"{word} clearfix", f"js{word.capitalize()}"))
        return f' {r.choice(("class", "class", "id"))}="{word}"'

    def body_attrs(self, hint: float) -> str:
        """Attributes of what holds the article: often none, and now and then words that others have, as in blog-comment-policy."""
        r = self.r
        if r.random() < 0.22:
            some = [r.choice(r.choice(list(WORDS.values())).split()) for _ in range(r.choice((1, 1, 2)))] + [r.choice(("policy", "x", "blog", "story", "of", "area", "guide"))]
            r.shuffle(some)
            return f' {r.choice(("class", "class", "id"))}="{r.choice(("-", " ", "_")).join(some)}"'
        return self.attrs(WORDS["content"], hint)

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.words(1, 1, False)}">{self.words(low, high, False)}{self.r.choice(("", "", "", "", ".", ",", "!", "?"))}</a>'

    def links(self) -> str:
        r = self.r
        n = r.randint(2, 9)
        if r.random() < 0.75:
            return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>"
        return r.choice((" | ", " ", " &middot; ")).join(self.link() for _ in range(n))

    def paragraph(self) -> str:
        r = self.r
        text = self.words(1, 6) if r.random() < 0.12 else self.words(8, 90)
        if r.random() < 0.07:
            return f'<a href="/{self.words(1, 1, False)}">{text}</a>'
        if r.random() < 0.06:
            parts = text.split(" ")
            k = r.randrange(len(parts) + 1)
            return " ".join(parts[:k]) + r.choice((" <math><mi>{}</mi></math>", " <svg><text>{}</text></svg>", " <math><mrow><mi>{}</mi><mo>x</mo></mrow></math>", "<noscript>{}</noscript>")).format(" ".join(parts[k:]))
        if r.random() < 0.2:
            parts = text.split(" ")
            k = r.randrange(len(parts))
            parts[k] = r.choice(("<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<strong>{}</strong>", "<span>{}</span>", "<code>{}</code>")).format(parts[k])
            text = " ".join(parts)
        if r.random() < 0.08:
            text = "<b>" + text + "<br>"
        return text

    def article(self) -> str:
        r = self.r
        out = []
        if r.random() < 0.8:
            heading = f"<h1>{self.words(2, 10)}</h1>"
            draw = r.random()
            out.append(f"<header{self.attrs('header heading entry-header title', 0.4)}>{heading}</header>" if draw < 0.2 else f"<div>{heading}</div>" if draw < 0.25 else heading)
        for _ in range(r.choice((0, 0, 1, 1, 1, 2, 3, 4, 6, 8, 12))):
            draw = r.random()
            if draw < 0.52:
                own = self.body_attrs(0.5) if r.random() < 0.1 else ""
                out.append(f"<p{own}>{self.paragraph()}" + ("</p>" if r.random() < 0.9 else ""))
            elif draw < 0.7:
                tag = r.choice(("section", "div"))
                title = f"<h2>{self.words(1, 7, False)}</h2>" if r.random() < 0.4 else ""
                out.append(f"<{tag}{self.body_attrs(0.3) if r.random() < 0.5 else ''}>{title}" + "".join(f"<p>{self.words(1, 12) if r.random() < 0.4 else self.paragraph()}</p>" for _ in range(r.choice((1, 1, 1, 2, 3)))) + f"</{tag}>")
            elif draw < 0.78:
                out.append(f"<h2>{self.words(1, 7, False)}</h2>")
            elif draw < 0.84:
                out.append(f"<ul>{''.join(f'<li>{self.words(2, 25)}</li>' for _ in range(r.randint(2, 6)))}</ul>")
            elif draw < 0.88:
                out.append(f"<blockquote><p>{self.paragraph()}</p></blockquote>")
            elif draw < 0.91:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 4, False)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif draw < 0.93:
                out.append(f"<div>{self.paragraph()}</div>")
            elif draw < 0.95:
                out.append(f"<figure><figcaption>{self.words(3, 12)}</figcaption></figure>")
            else:
                out.append(self.drop(r.choice(("advert", "widget", "notice", "side", "form", "nav")), True))
        for _ in range(r.choice((0, 0, 0, 0, 1, 1, 2))):
            out.append(self.drop(r.choice(("comment", "footer", "footer", "widget", "form", "advert", "side")), True))
        return "".join(out)

    def drop(self, role: str, sure: bool = False) -> str:
        """Something that is no main text; if sure, its tag or its attributes say so, as inside an article they must."""
        r = self.r
        tag, hint, words, inner = "div", 0.85, WORDS[role if role in WORDS else "edge"], self.links()
        if role == "nav":
            tag, words = r.choice(("nav", "nav", "div", "ul")), "nav navbar navigation menu breadcrumb breadcrumbs"
            inner = "".join(f"<li>{self.link()}</li>" for _ in range(r.randint(2, 9))) if tag == "ul" else inner
        elif role == "header":
            tag, words = r.choice(("header", "div")), "header masthead topbar banner"
            inner = r.choice((self.link(), f"<p>{self.words(1, 8)}</p>", f"<span>{self.words(1, 4, False)}</span>", f"<h2>{self.words(1, 4, False)}</h2>")) + r.choice(("", self.links()))
        elif role == "footer":
            tag, words = r.choice(("footer", "footer", "div")), "footer bottom copyright colophon contentinfo"
            inner = r.choice(("&copy; " + self.words(2, 40), f"<p>&copy; {self.words(2, 30)}</p>", f"&copy; site &middot; {self.words(1, 40)}", self.links(), self.links() + f"<p>{self.words(3, 20)}</p>"))
        elif role == "side":
            tag, words = r.choice(("aside", "div", "section")), "sidebar side aside rail widget complementary"
            inner = r.choice((f"<h3>{self.words(1, 3, False)}</h3>" + self.links(), f"<p>{self.words(3, 40)}</p>", f"<h3>{self.words(1, 3, False)}</h3><p>{self.words(5, 40)}</p>" + self.links()))
        elif role == "form":
            tag, words = "form", "form search login signup subscribe"
            inner = f"<label>{self.words(1, 3, False)}</label><input type=text><button>{self.words(1, 2, False)}</button>" + r.choice(("", f"<p>{self.words(3, 15)}</p>"))
        elif role == "comment":
            tag, words = r.choice(("section", "div", "ol")), "comments commentlist disqus discussion replies respond reviews"
            hint = 0.95
            each = lambda: r.choice(("<li{0}><p>{1}</p></li>", "<div{0}><p>{1}</p></div>", "<article{0}><p>{1}</p></article>", "<div{0}><b>{2}</b><p>{1}</p></div>")).format(self.attrs("comment reply review", 0.9), self.words(3, 60), self.words(1, 2, False))
            inner = r.choice(("", f"<h3>{self.words(1, 3, False)}</h3>")) + "".join(each() for _ in range(r.randint(1, 6)))
        elif role == "notice":
            tag = r.choice(("div", "section", "p"))
            inner = r.choice((self.words(4, 30), f"<p>{self.words(4, 40)}</p><button>{self.words(1, 2, False)}</button>", self.words(4, 20) + self.link()))
            hint = 0.97
        elif role == "advert":
            tag = r.choice(("div", "div", "aside", "p", "section"))
            inner = r.choice((self.words(2, 30), f"<p>{self.words(2, 25)}</p>", self.link(2, 8), f"<h4>{self.words(1, 4)}</h4><p>{self.words(2, 20)}</p>", f"<span>{self.words(2, 12)}</span>"))
            hint = 0.97
        elif role == "widget":
            inner = r.choice((self.links(), f"<h3>{self.words(1, 3, False)}</h3>" + self.links(), self.link(), f"<span>{self.words(1, 3, False)}</span>"))
            hint = 0.97
        inner = inner if tag != "p" else re.sub(r"<[^>]*>", " ", inner)
        if r.random() < 0.08:
            # Such as post-comments or article-share.
            words = " ".join(f"{r.choice(WORDS['content'].split())}-{w}" for w in words.split())
        hint = 1.0 if sure and tag in ("div", "section", "p", "ul", "ol") else hint
        return f"<{tag} data-k=0{self.attrs(words, 0.5 if tag in ('nav', 'footer', 'aside', 'form', 'header') else hint)}>{inner}</{tag}>"

    def page(self) -> str:
        r = self.r
        tag = r.choice(("article", "article", "main", "div", "div", "section"))
        body = f"<{tag} data-k=1{self.body_attrs(0.4 if tag in ('article', 'main') else 0.6)}>{self.article()}</{tag}>"
        if r.random() < 0.2:
            body = re.sub(r"<(p|h1|h2|ul|blockquote|table|div|figure|section|header)\b(?! data-k)", r"<\1 data-k=1", self.article())
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            wrap = r.choice(("div", "div", "main", "section"))
            extra = "".join(self.drop(r.choice(("side", "widget", "advert", "comment", "notice"))) for _ in range(r.choice((0, 0, 1, 2))))
            body = f"<{wrap}{self.attrs('content main page wrapper container layout site', 0.6)}>{body}{extra}</{wrap}>"
        top = [self.drop(role) for role in ("header", "nav", "notice", "advert", "side", "form") if r.random() < 0.45]
        end = [self.drop(role) for role in ("comment", "side", "widget", "advert", "form", "nav", "notice", "footer") if r.random() < (0.7 if role == "footer" else 0.35)]
        r.shuffle(top)
        head = "<head><meta charset=utf-8><title>t</title><style>p{}</style></head>" if r.random() < 0.9 else ""
        if r.random() < 0.1:
            return f"{''.join(top)}{body}{''.join(end)}"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(top)}{body}{''.join(end)}" + ("</body></html>" if r.random() < 0.9 else "")


#: Invented pages that the model is fitted on.
TRAINING_PAGES, ROUNDS, SEED = 3000, 60, 20240
_MARK = re.compile(r" data-k=([01])")


def labelled_pages(count: int = TRAINING_PAGES, seed: int = SEED) -> tuple[list[Page], np.ndarray]:
    """Invented pages and the label of each element: inside the article and in nothing to drop, or holding the article."""
    maker, pages, labels = _Maker(seed), [], []
    for _ in range(count):
        page = Page(maker.page())
        mark = [_MARK.search(a) for a in page.attributes]
        state = np.full(len(mark), -1)
        for k in range(1, len(mark)):
            above = state[page.parents[k]]
            state[k] = int(mark[k][1]) if mark[k] and above != 0 else above
        holds = np.zeros(len(mark), dtype=bool)
        for k in np.flatnonzero(state == 1).tolist():
            while k >= 0 and not holds[k]:
                holds[k], k = True, page.parents[k]
        page.attributes = [_MARK.sub("", a) for a in page.attributes]
        pages.append(page)
        labels.append(holds)
    return pages, np.concatenate(labels)


@cache
def default_model() -> Layered:
    """The model fitted on invented pages, made once per process."""
    pages, labels = labelled_pages()
    return Layered(ROUNDS).fit(features(pages)[0], labels.astype(np.float64))


def extracted(pages: DataFrame, model: Layered | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page, from its whole source.

    Blocks are joined by \\n, white space inside a block is one space, character references are decoded; br is white space.
    Null and empty sources have the empty text, as have pages on which nothing is kept; null ids and urls stay null, repeated
    rows are pages of their own, and an empty table gives an empty table. Other columns are ignored. Nothing is
    shuffled; the workers get the fitted trees.
    """
    bounded_batches(pages.sparkSession)
    fitted = model or default_model()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def extract(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in portions(batches, 200, BATCH_MB):
            texts = main_texts(batch.column(2).to_pylist(), fitted)
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
