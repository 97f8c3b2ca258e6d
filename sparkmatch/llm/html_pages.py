"""Labelled pages for the extractor: made by rule, with every text leaf marked as main text or not.

The pages vary in how they hold the article (article, main, or div, section and table cells with and without telling
classes), in the furniture around and inside it (menus, headers, adverts, notices, forms, side columns, comments,
footers, or none of it), in the depth at which it all lies, and in their mistakes (tags left open, no end tags).  Words are made of random syllables, so the model
cannot learn a language; it learns structure, class names and the shape of texts.
"""

from __future__ import annotations

import random

#: First character of a leaf: main text or not.
MAIN, OTHER = "\ue000", "\ue001"

_SYLLABLES = "an be ci do er fu ga hi in jo ka le mi nu or pe qua ri so ta un ve wi xa yo zu th sch ion ment".split()


class _Page:
    def __init__(self, rng: random.Random):
        self.r = rng

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.r.choice("....!?") for _ in range(self.r.randint(low, high)))

    def leaf(self, mark: str, text: str) -> str:
        r = self.r
        if r.random() < 0.15:
            at = text.find(" ")
            if at > 0:
                text = f"<{(t := r.choice(['b', 'i', 'em', 'strong', 'span']))}>{text[:at]}</{t}>{text[at:]}"
        if r.random() < 0.1:
            text = text.replace(" ", "&nbsp;", 1)
        return mark + text

    def links(self, n: int, wrap: str = "ul") -> str:
        item = [f'<a href="/{i}">{self.leaf(OTHER, self.words(1, 3))}</a>' for i in range(n)]
        if wrap == "ul":
            return "<ul>" + "".join(f"<li>{x}</li>" if self.r.random() < 0.95 else f"<li>{x}" for x in item) + "</ul>"
        return "".join(f"<{wrap}>{x}</{wrap}>" for x in item)

    def menu(self) -> str:
        r = self.r
        body = self.links(r.randint(3, 9), r.choice(["ul", "ul", "div", "p"]))
        return r.choice(["<nav>{}</nav>", '<div class="menu">{}</div>', '<div id="nav">{}</div>', '<header><nav>{}</nav></header>', '<div class="navbar top-menu">{}</div>', '<div role="navigation">{}</div>', "<div>{}</div>", '<nav class="breadcrumb">{}</nav>']).format(body)

    def header(self) -> str:
        name = self.leaf(OTHER, self.words(1, 5).title())
        line = f"<p>{self.leaf(OTHER, self.words(3, 9))}</p>" if self.r.random() < 0.5 else ""
        return self.r.choice(["<header>{}{}</header>", '<div class="header">{}{}</div>', '<div id="masthead">{}{}</div>', '<header class="site-header"><div>{}{}</div></header>', '<div role="banner">{}{}</div>']).format(self.r.choice(["<h1>{}</h1>", "<div>{}</div>", '<a href="/">{}</a>']).format(name), line)

    def advert(self) -> str:
        text = self.leaf(OTHER, self.r.choice([self.sentences(1, 3), self.words(2, 12)]))
        return self.r.choice(['<div class="ad">{}</div>', '<div class="advert">{}</div>', '<aside class="promo"><p>{}</p></aside>', '<div id="ad-top"><p>{}</p></div>', '<div class="sponsored">{}</div>', '<ins class="adsbox">{}</ins><div></div>', '<div class="ads banner"><a href="/b">{}</a></div>', '<section class="advertisement"><p>{}</p></section>']).format(text)

    def notice(self) -> str:
        text = self.leaf(OTHER, self.sentences(1, 3))
        button = f"<button>{self.leaf(OTHER, self.words(1, 2))}</button>" if self.r.random() < 0.7 else ""
        return self.r.choice(['<div class="cookie-banner"><p>{}</p>{}</div>', '<div id="cookie-notice">{}{}</div>', '<div class="consent">{}{}</div>', '<div class="notice">{}{}</div>', '<div role="alert"><p>{}</p>{}</div>', '<div class="gdpr popup"><p>{}</p>{}</div>']).format(text, button)

    def form(self) -> str:
        r = self.r
        parts = [f"<label>{self.leaf(OTHER, self.words(1, 3))}</label><input>", f"<p>{self.leaf(OTHER, self.sentences(1, 2))}</p>", f"<button>{self.leaf(OTHER, self.words(1, 2))}</button>", f"<select><option>{self.leaf(OTHER, self.words(1, 2))}</option><option>{self.leaf(OTHER, self.words(1, 2))}</option></select>"]
        body = "".join(r.sample(parts, r.randint(1, len(parts))))
        return r.choice(["<form>{}</form>", '<form class="newsletter">{}</form>', '<div class="subscribe"><form>{}</form></div>', '<form id="search" action="/q">{}</form>', '<section class="signup"><form>{}</form></section>']).format(body)

    def side(self) -> str:
        r = self.r
        head = f"<h3>{self.leaf(OTHER, self.words(1, 4))}</h3>"
        body = r.choice([self.links(r.randint(2, 7)), "".join(f"<p>{self.leaf(OTHER, self.sentences(1, 2))}</p>" for _ in range(r.randint(1, 3)))])
        return r.choice(["<aside>{}{}</aside>", '<div class="sidebar">{}{}</div>', '<div id="sidebar"><div class="widget">{}{}</div></div>', '<div class="related">{}{}</div>', '<section class="related-posts">{}{}</section>', '<div role="complementary">{}{}</div>', '<aside class="side"><div>{}{}</div></aside>']).format(head, body)

    def comments(self) -> str:
        r = self.r
        one = r.choice(['<div class="comment"><span>{}</span><p>{}</p></div>', "<li><b>{}</b><p>{}</p></li>", '<article class="comment"><h4>{}</h4><p>{}</p></article>', '<div class="reply"><p>{}</p><p>{}</p></div>'])
        body = "".join(one.format(self.leaf(OTHER, self.words(1, 2).title()), self.leaf(OTHER, self.sentences(1, 5))) for _ in range(r.randint(1, 5)))
        head = f"<h2>{self.leaf(OTHER, self.words(1, 3))}</h2>" if r.random() < 0.7 else ""
        return r.choice(['<section id="comments">{}{}</section>', '<div class="comments">{}{}</div>', '<ol class="comment-list">{}{}</ol>', '<div id="disqus" class="comments-area">{}{}</div>', '<section class="reader-comments">{}{}</section>']).format(head, body)

    def footer(self) -> str:
        r = self.r
        text = r.choice(["&copy; {} {}", "{} &middot; {}", "{} {}"]).format(r.choice(["2024", "site.example", self.words(1, 2)]), r.choice([self.words(2, 6), self.sentences(1, 2)]))
        body = self.leaf(OTHER, text) if r.random() < 0.5 else f"<p>{self.leaf(OTHER, text)}</p>" + (self.links(r.randint(2, 5)) if r.random() < 0.5 else "")
        return r.choice(["<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer"><div>{}</div></div>', '<footer class="site-footer"><div>{}</div></footer>', '<div role="contentinfo">{}</div>']).format(body)

    def article(self) -> str:
        r = self.r
        out = []
        if r.random() < 0.85:
            title = self.leaf(MAIN, self.words(1, 10).capitalize())
            out.append(r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>", '<h1 class="title">{}</h1>']).format(title))
        for _ in range(r.choice([1, 2, 3, 4, 6, 8, 12, 20])):
            x = r.random()
            if x < 0.72:
                out.append(f"<p>{self.leaf(MAIN, self.sentences(1, 6))}" + ("</p>" if r.random() < 0.9 else ""))
            elif x < 0.77:
                out.append(f"<p><b>{MAIN}{self.sentences(1, 2)}<br>")
            elif x < 0.81:
                out.append(f"<h2>{self.leaf(MAIN, self.words(1, 7))}</h2>")
            elif x < 0.86:
                out.append("<ul>" + "".join(f"<li>{self.leaf(MAIN, r.choice([self.words(1, 8), self.sentences(1, 2)]))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.89:
                out.append(f"<blockquote>{self.leaf(MAIN, self.sentences(1, 3))}</blockquote>")
            elif x < 0.91:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.leaf(MAIN, self.words(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif x < 0.93:
                out.append(f"<pre>{self.leaf(MAIN, self.words(4, 20))}</pre>")
            elif x < 0.95:
                out.append(f"<p>{self.leaf(MAIN, self.words(1, 3).capitalize())}.</p>")
            elif x < 0.97:
                out.append(self.advert())
            elif x < 0.98:
                out.append('<div class="share social">' + self.links(r.randint(2, 4), "span") + "</div>")
            elif x < 0.99:
                out.append(self.side())
            else:
                out.append(self.form())
            if x < 0.9 and r.random() < 0.1:
                out[-1] = r.choice(["<div>{}</div>", "<section>{}</section>", '<div class="row"><div>{}</div></div>']).format(out[-1])
        return r.choice(["<article>{}</article>"] * 5 + ["<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="content"><div>{}</div></div>', '<div class="post entry">{}</div>', '<div class="article-body">{}</div>', '<section class="story">{}</section>', "<div>{}</div>", "<table><tr><td>{}</td></tr></table>", '<div role="main">{}</div>', '<div itemprop="articleBody">{}</div>', '<div class="page"><div class="text">{}</div></div>']).format("".join(out))

    def html(self) -> str:
        r = self.r
        some = lambda p, *makers: "".join(m() for m in makers if r.random() < p)
        before = some(0.5, self.notice) + some(0.35, self.header) + some(0.85, self.menu) + some(0.5, self.advert) + some(0.2, self.form) + some(0.2, self.side)
        after = some(0.3, self.side) + some(0.25, self.form) + some(0.4, self.comments) + some(0.3, self.advert) + some(0.85, self.footer) + some(0.1, self.notice)
        # some pages are the article alone, or begin or end with it
        body = before * (r.random() < 0.85) + self.article() + after * (r.random() < 0.8)
        if r.random() < 0.3:
            body = f'<div class="{r.choice(["wrapper", "container", "page", "site"])}">{body}</div>'
        if r.random() < 0.25:
            depth = r.randint(1, 8)
            body = "<div>" * depth + body + "</div>" * depth
        return "<!DOCTYPE html><html><head><title>x</title></head><body>" + body + r.choice(["</body></html>", ""])


def labelled_pages(n: int, seed: int = 1) -> list[str]:
    """Pages whose text leaves begin with MAIN or OTHER; the same for the same arguments."""
    rng = random.Random(seed)
    return [_Page(rng).html() for _ in range(n)]
