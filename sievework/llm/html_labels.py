"""Labelled pages that the extraction model is trained on.

Each page is put together from the parts that pages have, in several layouts.  An element whose text belongs to the article
carries the attribute ``data-keep``; the model does not see that attribute.
"""

from __future__ import annotations

import random

PAGES = 360
LAYOUTS = ("article", "named", "plain", "nested", "section", "bare")

_LETTERS = ["ka", "lo", "mi", "ren", "tas", "ul", "vo", "ner", "is", "ot"]


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(_LETTERS) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def tag(self, name: str, inner: str, classes: str = "", keep: bool = False, key: str = "") -> str:
        spare = self.r.choice(["", "", "", " row", " wrap", " col-8", " clearfix", " x1"])
        kind = f' class="{(classes + spare).strip()}"' if classes or spare else ""
        return f"<{name}{kind}{f' id={key}' if key else ''}{' data-keep=1' if keep else ''}>{inner}</{name}>"

    def links(self, n: int, wrap: str = "li") -> str:
        return "".join(f"<{wrap}><a href='/{i}'>{self.words(1, 3)}</a></{wrap}>" for i in range(n))

    def article_parts(self) -> str:
        """Title and body blocks, all kept, with a few intruders that are not."""
        r, out = self.r, []
        title = r.choice(["h1", "h1", "h2"])
        if r.random() < 0.2:  # a header is none of the text, inside the article too
            out.append(f"<header>{self.tag(title, self.words(3, 9))}{self.tag('p', self.words(2, 5), 'meta byline')}</header>")
        else:
            out.append(self.tag(title, self.words(3, 9), r.choice(["", "title", "headline"]), True))
        # some articles are many short paragraphs, some only a line or two
        short = r.random() < 0.3
        for _ in range(r.choice([1, 2, 6, 20, 40]) if short else r.randint(1, 9)):
            p = self.words(*((1, 4) if short and r.random() < 0.9 else r.choice([(1, 12), (8, 60), (40, 160), (1, 160)])))
            if r.random() < 0.3:
                p += f" <a href='/x'>{self.words(1, 3)}</a> {self.words(1, 9)}"
            kind = r.random()
            if kind < 0.68:
                out.append(f"<p data-keep=1>{p}</p>")
            elif kind < 0.73:
                out.append(f"<p data-keep=1><b>{p}<br>{self.words(3, 9)}</p>")
            elif kind < 0.79:
                out.append(self.tag(r.choice(["h2", "h3"]), self.words(2, 6), "", True))
            elif kind < 0.86:
                items = "".join(f"<li data-keep=1>{self.words(3, 14)}</li>" for _ in range(r.randint(2, 5)))
                out.append(f"<{(t := r.choice(['ul', 'ol']))} data-keep=1>{items}</{t}>")
            elif kind < 0.90:
                out.append(f"<blockquote data-keep=1><p data-keep=1>{p}</p></blockquote>")
            elif kind < 0.93:
                out.append(f"<pre data-keep=1>{self.words(5, 20)}</pre>")
            elif kind < 0.96:
                cells = "".join(f"<tr data-keep=1><td data-keep=1>{self.words(1, 4)}</td><td data-keep=1>{self.words(1, 4)}</td></tr>" for _ in range(3))
                out.append(f"<table data-keep=1>{cells}</table>")
            else:
                out.append(f"<figure data-keep=1><img src=x><figcaption data-keep=1>{self.words(3, 9)}</figcaption></figure>")
        if r.random() < 0.5:
            out.insert(r.randint(1, len(out)), self.intruder())
        return "".join(out)

    def intruder(self) -> str:
        r = self.r
        text = f"<p>{self.words(3, 40)}</p>" if r.random() < 0.6 else self.words(3, 30)
        return r.choice(
            [
                self.tag("div", text, r.choice(["ad", "ads", "advert", "advertisement", "sponsored", "ad-slot banner", "promo"])),
                self.tag("aside", text, r.choice(["", "related", "pullout"])),
                self.tag("form", f"{self.words(2, 9)}<input><button>{self.words(1, 2)}</button>", r.choice(["", "newsletter", "subscribe"])),
                self.tag("div", text, r.choice(["notice", "cookie-notice", "consent", "alert"])),
                self.tag("div", f"<ul>{self.links(3)}</ul>", r.choice(["share", "social", "related-posts", "tags"])),
                self.tag("nav", f"<ul>{self.links(4)}</ul>", r.choice(["", "toc", "pagination"])),
            ]
        )

    def menu(self) -> str:
        r, n = self.r, self.r.randint(3, 9)
        inner = f"<ul>{self.links(n)}</ul>" if r.random() < 0.7 else self.links(n, "span")
        return self.tag("nav", inner) if r.random() < 0.6 else self.tag("div", inner, r.choice(["menu", "nav", "navigation", "navbar", "breadcrumbs"]))

    def top(self) -> str:
        r = self.r
        inner = self.tag(r.choice(["div", "h1", "p", "span"]), self.words(1, 4), r.choice(["logo", "site-title", "brand"])) + (f"<p>{self.words(3, 12)}</p>" if r.random() < 0.4 else "")
        inner += self.menu() if r.random() < 0.4 else ""
        return self.tag("header", inner) if r.random() < 0.6 else self.tag("div", inner, r.choice(["header", "masthead", "topbar", "site-header"]))

    def bottom(self) -> str:
        r = self.r
        inner = r.choice([f"&copy; {self.words(2, 14)}", f"<p>{self.words(4, 40)}</p>", f"<ul>{self.links(4)}</ul><p>{self.words(2, 9)}</p>"])
        return self.tag("footer", inner) if r.random() < 0.65 else self.tag("div", inner, r.choice(["footer", "site-footer", "copyright", "colophon"]))

    def side(self) -> str:
        r = self.r
        box = "".join(self.tag(r.choice(["div", "section"]), f"<h3>{self.words(1, 3)}</h3>" + r.choice([f"<ul>{self.links(4)}</ul>", f"<p>{self.words(5, 60)}</p>"]), r.choice(["widget", "box", ""])) for _ in range(r.randint(1, 3)))
        return self.tag("aside", box, r.choice(["", "sidebar"])) if r.random() < 0.6 else self.tag("div", box, r.choice(["sidebar", "side", "rail", "widgets"]))

    def notice(self) -> str:
        r = self.r
        text = r.choice([f"<p>{self.words(6, 40)}</p>", self.words(6, 40)]) + (f"<button>{self.words(1, 2)}</button>" if r.random() < 0.6 else "")
        return self.tag(r.choice(["div", "div", "section", "aside"]), text, r.choice(["cookie", "cookie-banner", "consent", "notice", "gdpr", "alert", "popup", "modal", "message"]))

    def comments(self) -> str:
        r = self.r
        each = "".join(self.tag(r.choice(["li", "div", "article"]), f"<p>{self.words(4, 80)}</p>", r.choice(["comment", "reply", "comment-body"])) for _ in range(r.randint(1, 5)))
        head = f"<h2>{self.words(1, 3)}</h2>" if r.random() < 0.6 else ""
        return self.tag(r.choice(["section", "div", "ol"]), head + each, r.choice(["comments", "comment-list", "responses", "discussion"]))

    def framed(self, body: str, layout: str) -> str:
        """The article in the frame of a layout; ``plain`` ones say nothing by name, ``bare`` has none."""
        r = self.r
        if layout == "article":
            body = self.tag("article", body, r.choice(["", "", "post", "story"]), True)
        elif layout == "named":
            body = self.tag("div", body, r.choice(["content", "article", "post", "entry-content", "article-body", "story", "main-text", "text"]), True)
        elif layout != "bare":
            for _ in range({"plain": 1, "nested": r.randint(2, 4)}.get(layout, 1)):
                spare = r.choice(["", "", "", f"css-{r.randint(1, 9)}{self.words(1, 1)}", f"x-{r.randint(1, 99)}", f"{self.words(1, 1)}"])
                body = self.tag("section" if layout == "section" else r.choice(["div", "div", "section"]) if layout == "nested" else "div", body, spare, True)
        if layout in ("article", "named") and r.random() < 0.4:
            body = self.tag(r.choice(["main", "main", "section", "div"]), body, r.choice(["", "main", "container"]), True)
        return body

    def page(self, layout: str = "") -> str:
        r = self.r
        body = self.article_parts()
        body = self.framed(body, layout or r.choices(LAYOUTS, (5, 5, 3, 3, 2, 2))[0])
        before = [f() for f in (self.top, self.menu, self.notice, self.ad) if r.random() < 0.5]
        after = [f() for f in (self.side, self.comments, self.ad, self.form, self.bottom, self.notice) if r.random() < 0.45]
        r.shuffle(before)
        out = "".join(before) + body + "".join(after)
        if r.random() < 0.25:
            out = f"<div {r.choice(['class=page', 'class=wrapper', 'class=container', 'class=site', 'id=root', 'id=app', ''])}>{out}</div>"
        script = "<script>var t='</p>';</script>" if r.random() < 0.5 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title>{script}</head><body>{out}</body></html>"

    def ad(self) -> str:
        return self.tag("div", self.words(4, 30), self.r.choice(["ad", "ads", "advert", "banner-ad", "sponsored", "promo"]))

    def form(self) -> str:
        return self.tag("form", f"<label>{self.words(1, 3)}</label><input><p>{self.words(2, 20)}</p><button>{self.words(1, 2)}</button>", self.r.choice(["", "search", "newsletter"]))


def labelled_pages(first: int = 0, count: int = PAGES, layout: str = "") -> list[str]:
    """Pages of the labelled table, of all layouts or of one; other seeds give held-out ones."""
    return [_Writer(seed).page(layout) for seed in range(first, first + count)]
