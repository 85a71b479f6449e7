"""Labelled pages for training the extractor: made from page layouts, with the main blocks known.

Pages vary in containers, class names, nesting, block kinds, lengths and faults
of markup; texts are invented words, so that a model learns structure and
typography, not vocabulary.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba ke lo mi nu ra se ti vo wa en or is at ul dre ston ville que ión ung keit tion é ü ñ".split()
#: Class names that pages commonly use.
_MAIN = ["content", "article", "post", "entry-content", "main-content", "story", "article-body", "post-body", "text", "page", "node", ""]
_ADS = ["ad", "ads", "advert", "advertisement", "ad-banner", "sponsor", "sponsored", "promo", "banner", "google-ad"]
_SIDE = ["sidebar", "side", "widget", "related", "trending", "most-read", "recommended", "aside"]
_NOTICE = ["cookie", "cookie-banner", "notice", "consent", "gdpr", "alert", "notification", "paywall", "popup", "modal", "disclaimer"]
_COMMENTS = ["comments", "comment-list", "comment", "discussion", "replies", "responses", "reader-comments", "disqus"]
_SHARE = ["share", "social", "social-share", "tags", "byline-links", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar"]
_NAV = ["nav", "menu", "navbar", "navigation", "topnav", "main-menu"]
_HEAD, _FOOT = ["header", "masthead", "site-header", "top", "page-header"], ["footer", "site-footer", "bottom", "page-footer", "copyright"]
_PHRASES = {
    "notice": ["We use cookies to improve this site.", "Please accept our terms.", "Subscribe to read on.", "Sign up for our newsletter."],
    "foot": ["&copy; 2024 All rights reserved", "Copyright 2023", "Privacy policy", "Terms of use", "&copy; m.site.example"],
}


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        for i in range(len(out)):
            if r.random() < 0.06:
                out[i] += r.choice([",", ".", ";", "&amp;", "***", "%%%", "!!"])
        text = " ".join(out).capitalize()
        return text + r.choice([".", ".", ".", "", "?", "!"])

    def linked(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(n))

    def boxed(self, names: list[str], inside: str, tags=("div", "section", "aside")) -> str:
        tag, name = self.r.choice(tags), self.r.choice(names)
        return f'<{tag} {self.r.choice(["class", "class", "id"])}="{name}">{inside}</{tag}>'

    def off(self, kind: str) -> list[tuple[str, int]]:
        """Markup that is no part of the main text."""
        r = self.r
        if kind == "nav":
            items = f"<ul>{self.linked(r.randint(3, 8))}</ul>"
            return [(f"<nav>{items}</nav>" if r.random() < 0.6 else self.boxed(_NAV, items), 0)]
        if kind == "header":
            inside = r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 8)}</p>", f'<a href="/">{self.words(1, 3)}</a>', self.words(2, 6)])
            return [(f"<header>{inside}</header>" if r.random() < 0.6 else self.boxed(_HEAD, inside), 0)]
        if kind == "footer":
            inside = r.choice(_PHRASES["foot"]) + r.choice([" &middot; ", " | ", "<br>"]) + self.words(2, 14)
            inside = inside if r.random() < 0.5 else f"<p>{inside}</p>"
            return [(f"<footer>{inside}</footer>" if r.random() < 0.6 else self.boxed(_FOOT, inside), 0)]
        if kind == "ad":
            inside = self.words(3, 30)
            return [(self.boxed(_ADS, inside if r.random() < 0.5 else f"<p>{inside}</p>"), 0)]
        if kind == "side":
            inside = f"<h3>{self.words(1, 4)}</h3>" + (f"<ul>{self.linked(r.randint(2, 5))}</ul>" if r.random() < 0.6 else f"<p>{self.words(5, 40)}</p>")
            return [(f"<aside>{inside}</aside>" if r.random() < 0.5 else self.boxed(_SIDE, inside), 0)]
        if kind == "notice":
            inside = (r.choice(_PHRASES["notice"]) if r.random() < 0.5 else self.words(4, 25)) + r.choice(["", "<button>OK</button>"])
            return [(self.boxed(_NOTICE, inside if r.random() < 0.5 else f"<p>{inside}</p>", ("div", "section", "dialog")), 0)]
        if kind == "form":
            inside = f"<label>{self.words(1, 3)}</label><input type=text><button>{self.words(1, 2)}</button>" + r.choice(["", f"<p>{self.words(4, 14)}</p>", "<select><option>A</option><option>B</option></select>"])
            return [(f"<form action='/x'>{inside}</form>", 0)]
        if kind == "comments":
            n = r.randint(1, 5)
            one = lambda: r.choice(["<div class=\"comment\"><b>%s</b><p>%s</p></div>", "<li><cite>%s</cite><p>%s</p></li>", "<article class=\"comment\"><h4>%s</h4><p>%s</p></article>"]) % (self.words(1, 2), self.words(4, 40))
            head = r.choice(["", f"<h2>{self.words(1, 3)}</h2>", "<h3>Comments</h3>"])
            return [(self.boxed(_COMMENTS, head + "".join(one() for _ in range(n)), ("div", "section", "ul", "ol")), 0)]
        inside = r.choice([f"<ul>{self.linked(r.randint(2, 6))}</ul>", " ".join(f'<a href="#">{self.words(1, 2)}</a>' for _ in range(3))])
        return [(self.boxed(_SHARE, inside), 0)]

    def main(self) -> list[tuple[str, int]]:
        """Blocks of the main text, with things that are not in it between them."""
        r, out = self.r, []
        if r.random() < 0.8:
            head = f"<h1>{self.words(2, 12)}</h1>"
            out.append((f"<header>{head}</header>" if r.random() < 0.12 else head, 1))
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            draw, text = r.random(), self.words(1, 70)
            if r.random() < 0.07:  # such lines stand in articles as well
                text = r.choice([*_PHRASES["foot"], *_PHRASES["notice"], "All rights reserved.", "Released under the MIT License.", "Copyright (c) 2020 " + self.words(1, 3)])
            if r.random() < 0.2:
                text = text.replace(" ", f' <a href="/{r.randint(1, 9)}">{self.words(1, 2)}</a> ', 1)
            if draw < 0.62:
                out.append((f"<p>{text}</p>" if r.random() < 0.7 else f"<p>{text}" if r.random() < 0.5 else f"<p><b>{text}<br>", 1))
            elif draw < 0.7:
                out.append((f"<h{r.randint(2, 4)}>{self.words(1, 8)}</h2>", 1))
            elif draw < 0.78:
                out.append((f"<ul><li>{self.words(2, 20)}</li><li>{self.words(2, 20)}</li></ul>", 1))
            elif draw < 0.83:
                out.append((f"<blockquote>{text}</blockquote>", 1))
            elif draw < 0.87:
                out.append((f"<pre>{text}</pre>", 1))
            elif draw < 0.9:
                out.append((f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr></table>", 1))
            elif draw < 0.95:
                out.append((f"<div>{text}</div>", 1))
            else:
                out.append((f"<figure><img src=x><figcaption>{self.words(2, 12)}</figcaption></figure>", 1))
            if r.random() < 0.08:
                out += self.off(r.choice(["ad", "share", "side", "form", "notice"]))
        return out

    def page(self) -> list[tuple[str, int]]:
        r = self.r
        out: list[tuple[str, int]] = [(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>', 0)]
        for kind, share in (("notice", 0.25), ("header", 0.5), ("nav", 0.7), ("ad", 0.5), ("share", 0.25), ("side", 0.2), ("form", 0.1)):
            if r.random() < share:
                out += self.off(kind)
        name = r.choice(_MAIN)
        tag = r.choice(["article", "article", "main", "div", "section"])
        if tag in ("div", "section") and not name:
            name = "content"
        wrap = r.random() < 0.2
        out.append(((f"<main>" if wrap else "") + f"<{tag}" + (f' class="{name}"' if name and r.random() < 0.7 or tag in ("div", "section") else "") + ">", 0))
        out += self.main()
        if r.random() < 0.15:
            out += self.off(r.choice(["comments", "share", "ad", "form"]))
        out.append((f"</{tag}>" + ("</main>" if wrap else ""), 0))
        for kind, share in (("share", 0.2), ("comments", 0.35), ("side", 0.4), ("form", 0.25), ("ad", 0.2), ("nav", 0.15), ("notice", 0.15), ("footer", 0.8)):
            if r.random() < share:
                out += self.off(kind)
        out.append((r.choice(["</body></html>", ""]), 0))
        return out


def labelled_pages(n: int, seed: int = 11) -> list[list[tuple[str, int]]]:
    """n pages, each as runs of markup with 1 for main text."""
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]
