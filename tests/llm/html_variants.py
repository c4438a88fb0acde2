"""The pages of the smallest tables in other shapes, each with the main text it should give."""

import html as entities
import re

WRAP = "<article>(.*)</article>"


def expected(inner: str) -> str:
    blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|header|section|div)>", inner))
    return "\n".join(b for b in blocks if b)


def _around(open_: str, close: str):
    return lambda page, inner: (page.replace("<article>", open_).replace("</article>", close), expected(inner))


def _inside(extra: str, after: int):
    """Something to drop among the article's blocks."""

    def make(page: str, inner: str):
        at = [m.end() for m in re.finditer("</p>|</h1>", inner)]
        cut = at[min(after, len(at) - 1)]
        return page.replace(inner, inner[:cut] + extra + inner[cut:]), expected(inner)

    return make


def _first_paragraph(change):
    def make(page: str, inner: str):
        new = re.sub(r"<p>([^<]+)</p>", lambda m: change(m[1]), inner, count=1)
        return page.replace(inner, new), expected(inner)

    return make


def _no_container(page: str, inner: str):
    return page.replace("<article>", "").replace("</article>", ""), expected(inner)


def _header_heading(page: str, inner: str):
    new = re.sub("<h1>(.*?)</h1>", r"<header><h1>\1</h1></header>", inner)
    return page.replace(inner, new), expected(inner)


def _wrapped_paragraphs(page: str, inner: str):
    new = re.sub(r"(<p>[^<]+</p>)", r"<section>\1</section>", inner)
    return page.replace(inner, new), expected(inner)


def _outside(extra: str):
    return lambda page, inner: (page.replace("</article>", "</article>" + extra), expected(inner))


COMMENTS = "<section class=comments><h3>Comments</h3><div class=comment><b>Ann</b><p>What a fine piece, thanks for it.</p></div><div class=comment><b>Bo</b><p>I do not agree with the last part at all, sorry.</p></div></section>"
VARIANTS = {
    "as it is": _around("<article>", "</article>"),
    "div class post": _around('<div class="post">', "</div>"),
    "div": _around("<div>", "</div>"),
    "section": _around("<section>", "</section>"),
    "main": _around("<main>", "</main>"),
    "div id without a word": _around('<div id="c12">', "</div>"),
    "no container": _no_container,
    "two wrappers": _around('<div class="wrapper"><div class="row">', "</div></div>"),
    "words of comments": _around('<article class="blog-comment-policy">', "</article>"),
    "words of widgets": _around('<article class="share-widget-review">', "</article>"),
    "words of adverts": _around('<div class="content promoted-story">', "</div>"),
    "heading in a header": _header_heading,
    "paragraph of a link": _first_paragraph(lambda t: f'<p><a href="/x">{t}</a></p>'),
    "paragraphs in sections": _wrapped_paragraphs,
    "maths": _first_paragraph(lambda t: f"<p>{t.split(' ')[0]} <math><mi>{' '.join(t.split(' ')[1:])}</mi></math></p>"),
    "noscript": _first_paragraph(lambda t: f"<p>{t}<noscript><img src=x></noscript></p>"),
    "aside inside": _inside("<aside class=related><h3>More</h3><ul><li><a href=/a>one thing</a></li><li><a href=/b>another</a></li></ul></aside>", 1),
    "comments inside": _inside(COMMENTS, 99),
    "form inside": _inside('<form action="/s"><label>Mail</label><input type=text><button>Send</button></form>', 1),
    "footer inside": _inside('<footer>&copy; 2020 The site</footer>', 99),
    "advert inside": _inside('<div class="advert">Buy two of these now, only today.</div>', 1),
    "share inside": _inside('<div class="share"><a href="/f">Share</a> <a href="/t">Post</a></div>', 0),
    "comments after": _outside(COMMENTS),
    "sidebar after": _outside('<div class="sidebar"><h3>Latest</h3><p>A few words about the site and those who write it.</p><ul><li><a href=/q>first post</a></li><li><a href=/r>second post</a></li></ul></div>'),
    "cookie notice": lambda page, inner: (page.replace("<body>", '<body><div id="cookie-notice"><p>We use cookies to make this site better for you.</p><button>Fine</button></div>'), expected(inner)),
}


def made(page: str, name: str) -> tuple[str, str]:
    return VARIANTS[name](page, re.search(WRAP, page, re.S)[1])
