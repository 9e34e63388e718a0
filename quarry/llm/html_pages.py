"""Labelled pages for training the extractor: made from a seed, with many ways to build each part of a page.

Each text begins with a private-use character that tells its label; the trainer reads and strips it.
"""

from __future__ import annotations

import random

MAIN, OTHER = "", ""

_SYLLABLES = {
    "en": "the and ing ion er re in of th ea st ou at on nd ha es ly ti or".split(),
    "de": "der und sch ein ung ich keit ver zu ge be st ach au ü ö ä ß lich heit".split(),
    "fr": "le la que ment tion eau oi ai eux ou é è ê ç re pa vi ier aux elle".split(),
    "es": "el la que ción ado mente ar os as es ll rr ñ ó í ez ga ja co do".split(),
    "xx": "ба но ка ري لا 中 文 の た to ki ma ra su da".split(),
}
_NAMES = {
    "ad": "ad ads advert advertisement adsbygoogle ad-slot banner-ad sponsor sponsored promo promotion promoted dfp google-ads",
    "menu": "menu nav navbar navigation main-menu topnav breadcrumb breadcrumbs pagination pager tabs toolbar skip-links submenu",
    "header": "header site-header masthead topbar page-header branding logo banner top",
    "footer": "footer site-footer bottom copyright legal colophon foot credits imprint",
    "sidebar": "sidebar side rail right-col left-col widget widgets related recommended trending popular more-stories aside secondary",
    "notice": "notice cookie cookie-notice cookie-banner consent gdpr alert popup modal overlay message warning paywall privacy",
    "form": "form search search-box login signup subscribe newsletter contact-form register subscription",
    "share": "share social sharing social-links follow tags taglist meta-links toolbox",
    "comments": "comments comment comment-list replies reply discussion disqus respond responses user-comments reader-comments thread feedback reviews",
    "main": "content article post entry story article-body post-content entry-content main-content text body-text maincontent article-content single story-body prose page-content",
    "plain": "container wrapper row col inner block box group section-1 page site layout grid outer wrap clearfix item",
}
NAMES = {k: v.split() for k, v in _NAMES.items()}


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = _SYLLABLES[self.r.choice([*_SYLLABLES])]

    def word(self) -> str:
        w = "".join(self.r.choice(self.syllables) for _ in range(self.r.randint(1, 4)))
        return w + self.r.choice(["", "", "", "", ",", "&amp;", "***", "%"] if self.r.random() < 0.15 else [""])

    def text(self, label: str, low: int, high: int, stop: bool = True) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        words[0] = words[0][:1].upper() + words[0][1:]
        for k in range(4, len(words)):
            x = self.r.random()
            if x < 0.06:
                words[k - 1] += "."
                words[k] = words[k].capitalize()
            elif x < 0.09:
                tag = self.r.choice(["b", "i", "em", "strong", "a href='/x'", "span", "code"])
                words[k] = f"<{tag}>{words[k]}</{tag.split()[0]}>"
        return label + " ".join(words) + ("." if stop else "")

    def attrs(self, kind: str) -> str:
        if self.r.random() < 0.12:
            return ""
        name = self.r.choice(NAMES[kind])
        if self.r.random() < 0.3:
            name += " " + self.r.choice(NAMES["plain"])
        return f' {self.r.choice(["class", "class", "class", "id"])}="{name}"'

    def element(self, kind: str, tags: str, inner: str, bare: bool = True) -> str:
        tag = self.r.choice(tags.split())
        plain = tag in ("div", "section", "ul", "td")
        attrs = self.attrs(kind) if plain or not bare or self.r.random() < 0.5 else ""
        while plain and not attrs:
            attrs = self.attrs(kind)
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def links(self, low: int, high: int, words: int = 3) -> str:
        items = [f'<a href="/{k}">{self.text(OTHER, 1, words, False)}</a>' for k in range(self.r.randint(low, high))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return "".join(f"<div>{x}</div>" for x in items)

    def some(self, label: str, low: int, high: int) -> str:
        """Paragraphs of any length: length alone must not tell."""
        return "".join(f"<p>{self.text(label, 1, self.r.choice([3, 12, 40]))}</p>" for _ in range(self.r.randint(low, high)))

    def menu(self) -> str:
        return self.element("menu", "nav nav nav div ul", self.links(3, 9))

    def ad(self) -> str:
        inner = self.r.choice([self.text(OTHER, 2, 25), self.some(OTHER, 1, 2), f"<a href='/buy'>{self.text(OTHER, 2, 9)}</a>"])
        return ("<!-- ad -->" if self.r.random() < 0.3 else "") + self.element("ad", "div div div aside section ins", inner, False)

    def notice(self) -> str:
        inner = self.some(OTHER, 1, 2) if self.r.random() < 0.5 else self.text(OTHER, 3, 25)
        return self.element("notice", "div div section aside dialog", inner + (f"<button>{self.text(OTHER, 1, 2, False)}</button>" if self.r.random() < 0.6 else ""), False)

    def sidebar(self) -> str:
        return self.element("sidebar", "aside aside div section", f"<h3>{self.text(OTHER, 1, 4, False)}</h3>" + self.r.choice([self.links(2, 6, 8), self.some(OTHER, 1, 3), self.links(2, 4) + self.some(OTHER, 1, 2)]))

    def form(self) -> str:
        fields = "".join(f'<label>{self.text(OTHER, 1, 3, False)}</label><input name="q"> ' for _ in range(self.r.randint(1, 3)))
        inner = (f"<p>{self.text(OTHER, 3, 18)}</p>" if self.r.random() < 0.6 else "") + fields + f"<button>{self.text(OTHER, 1, 2, False)}</button>"
        return f"<form{self.attrs('form')}>{inner}</form>" if self.r.random() < 0.8 else self.element("form", "div section", inner, False)

    def share(self) -> str:
        return self.element("share", "div ul div", self.links(2, 5, 2), False)

    def comments(self) -> str:
        one = lambda: self.element("comments", "div li article", f"<span>{self.text(OTHER, 1, 2, False)}</span>" * (self.r.random() < 0.5) + self.some(OTHER, 1, 2), False)
        return self.element("comments", "section div div", f"<h3>{self.text(OTHER, 1, 3, False)}</h3>" + "".join(one() for _ in range(self.r.randint(1, 5))), False)

    def header(self) -> str:
        title = f"<{(h := self.r.choice(['h1', 'div', 'p', 'span', 'h2']))}>{self.text(OTHER, 1, 6, False)}</{h}>"
        return self.element("header", "header header div", title + (self.menu() if self.r.random() < 0.4 else "") + (self.form() if self.r.random() < 0.15 else ""))

    def footer(self) -> str:
        inner = [f"&copy; {self.text(OTHER, 1, 3, False)} &middot; {self.text('', 2, 14)}"] if self.r.random() < 0.6 else [self.some(OTHER, 1, 2)]
        inner += [self.links(2, 6)] * (self.r.random() < 0.4)
        return self.element("footer", "footer footer footer div", "".join(inner).replace("&copy; " + OTHER, OTHER + "&copy; "))

    def article(self) -> str:
        r = self.r
        head = f"<h1>{self.text(MAIN, 1, 12, False)}</h1>" if r.random() < 0.9 else ""
        if head and r.random() < 0.2:
            head = f"<header>{head}" + f"<p>{self.text(MAIN, 2, 12)}</p>" * (r.random() < 0.4) + "</header>"
        body = []
        for _ in range(r.choice([1, 2, 4, 8, 14])):
            x = r.random()
            if x < 0.7:
                p = self.text(MAIN, 1, r.choice([4, 30, 90]))
                body.append(r.choice([f"<p>{p}</p>", f"<p>{p}</p>", f"<p>{p}</p>", f"<p>{p}", f"<p><b>{p}<br><p>", f"<div>{p}</div>"]))
            elif x < 0.78:
                body.append(f"<h2>{self.text(MAIN, 1, 6, False)}</h2>")
            elif x < 0.84:
                body.append("<ul>" + "".join(f"<li>{self.text(MAIN, 1, 15)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif x < 0.88:
                body.append(f"<blockquote>{self.text(MAIN, 3, 30)}</blockquote>")
            elif x < 0.91:
                body.append(f"<figure><figcaption>{self.text(MAIN, 2, 12)}</figcaption></figure>")
            elif x < 0.94:
                body.append("<table>" + "".join(f"<tr><td>{self.text(MAIN, 1, 4, False)}</td><td>{self.text(MAIN, 1, 4, False)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>")
            else:
                body.append(r.choice([self.ad, self.share, self.notice, self.form, self.sidebar])())
        if r.random() < 0.25:
            body.append(r.choice([self.comments, self.share, self.form])())
        inner = head + "".join(body)
        x = r.random()
        if x < 0.5:
            return f"<article{self.attrs('main') if r.random() < 0.4 else ''}>{inner}</article>"
        if x < 0.65:
            return f"<main{self.attrs('main') if r.random() < 0.4 else ''}>{inner}</main>"
        if x < 0.95:
            return self.element("main", "div div section", inner, False)
        return f'<div class="{r.choice(NAMES["plain"])}">{inner}</div>'

    def html(self) -> str:
        r = self.r
        before = [f() for f, p in ((self.notice, 0.2), (self.header, 0.4), (self.menu, 0.7), (self.ad, 0.5), (self.form, 0.12), (self.share, 0.1)) if r.random() < p]
        after = [f() for f, p in ((self.share, 0.15), (self.comments, 0.35), (self.sidebar, 0.3), (self.ad, 0.25), (self.form, 0.15), (self.notice, 0.12), (self.menu, 0.1), (self.footer, 0.8)) if r.random() < p]
        if r.random() < 0.15:
            before.append(self.sidebar())
        inner = "".join([*before, self.article(), *after])
        if r.random() < 0.3:
            inner = f'<div class="{r.choice(NAMES["plain"])}">{inner}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.text(OTHER, 1, 8, False)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{inner}</body></html>"


def labelled_page(seed: int) -> str:
    return _Page(seed).html()
