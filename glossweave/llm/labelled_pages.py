"""Labelled pages for training the block tagger.

Pages are written from parts whose role is known: an article between menus, notices, adverts,
sidebars, forms, reader comments and footers, in several mark-up styles.  A page is a list of
``(html, main)`` parts; ``main`` tells whether the part's text belongs to the article.
"""

from __future__ import annotations

import random

SYLLABLES = "an be ca der en fo gi hel is jo ka lun mer no or pra qui ren so tu und ver wa xi yon ze".split()
PLACES = {
    "menu": ["nav", "div class=menu", "div id=navigation", "ul class=nav-menu", "div class=navbar", "div role=navigation",
             "div class=breadcrumb", "div class=pagination", "div class=toc", "td class=nav", "td class=menu"],
    "header": ["header", "div id=header", "div class=masthead", "div class=site-header", "div class=topbar"],
    "notice": ["div class=notice", "div class=cookie-banner", "div id=cookie-consent", "div class=alert", "div role=alert",
               "div class=announcement", "div class=popup", "div class=modal", "div class=disclaimer", "section class=gdpr"],
    "advert": ["div class=ad", "div class=ads", "div class=advert", "div class=advertisement", "aside class=sponsored",
               "div class=promo", "div id=banner-ad", "ins class=adsbygoogle", "div class=sponsor", "section class=promotion", "td class=ads"],
    "sidebar": ["aside", "div id=sidebar", "div class=side-bar", "div class=widget", "div class=related", "section class=related-posts",
                "div class=recommended", "div class=share-buttons", "div class=social", "aside class=sidebar", "div role=complementary",
                "td class=sidebar", "aside class=widget-area"],
    "form": ["form", "form class=search", "form class=newsletter", "div class=newsletter", "div class=newsletter-signup", "div class=subscribe", "div class=login", "form class=signup"],
    "comments": ["div class=comments", "section id=comments", "ol class=comment-list", "div class=comment", "div id=disqus",
                 "section class=discussion", "div class=replies", "ul class=responses", "section class=user-comments"],
    "footer": ["footer", "div id=footer", "div class=site-footer", "div class=copyright", "div class=legal", "div role=contentinfo"],
    "article": ["article", "main", "div class=content", "div id=content", "div class=article-body", "div class=post", "div class=entry-content",
                "section class=story", "div class=main-text", "div class=col-main", "td class=text", "div", "section", "div role=main", "body"],
}


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.parts: list[tuple[str, bool]] = []

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        return " ".join("".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4))) for _ in range(n))

    def sentences(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            s = self.words(3, 16).capitalize()
            out.append(s.replace(" ", ", ", self.r.randint(0, 1)) + self.r.choice("....!?"))
        return " ".join(out)

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.words(1, 1)}">{self.words(low, high)}</a>'

    def put(self, html: str, main: bool = False) -> None:
        self.parts.append((html, main))

    def inside(self, place: str, main: bool, write) -> None:
        tag = place.split()[0]
        self.put(f"<{place}>", main)
        write()
        if not main or self.r.random() < 0.9:
            self.put(f"</{tag}>", main)

    def menu(self) -> None:
        style = self.r.random()
        if style < 0.15:  # no links: scripts make the menu
            tag = self.r.choice(("li", "p", "div", "span"))
            items = (self.words(1, 3) if self.r.random() < 0.6 else self.sentences(1, 2) for _ in range(self.r.randint(1, 6)))
            self.put("".join(f"<{tag}>{x}</{tag}>" for x in items))
        elif style < 0.75:
            self.put("<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(self.r.randint(2, 9))) + "</ul>")
        else:
            self.put(self.r.choice((" | ", " ", " &gt; ", " &middot; ")).join(self.link() for _ in range(self.r.randint(2, 8))))

    def header(self) -> None:
        self.put(f"<{(t := self.r.choice(('div', 'p', 'h2', 'span', 'h1')))}>{self.words(1, 6)}</{t}>")
        if self.r.random() < 0.4:
            self.put(f"<p>{self.sentences(1, 3)}</p>")
        if self.r.random() < 0.4:
            self.menu()

    def short(self) -> None:
        """Text of notices, adverts and sidebars: a heading, some sentences, links."""
        if self.r.random() < 0.3:
            self.put(f"<h{self.r.randint(2, 4)}>{self.words(1, 5)}</h3>")
        for _ in range(self.r.randint(1, 3)):
            body = self.sentences(1, 4) if self.r.random() < 0.7 else self.link(1, 6)
            tag = self.r.choice(("p", "div", "", "", "span"))
            self.put(f"<{tag}>{body}</{tag}>" if tag else body)
        if self.r.random() < 0.3:
            self.menu()

    def form(self) -> None:
        self.put(f"<label>{self.words(1, 3)}</label><input name=q>")
        if self.r.random() < 0.5:
            self.put(f"<p>{self.sentences(1, 2)}</p>")
        if self.r.random() < 0.3:
            self.put("<select>" + "".join(f"<option>{self.words(1, 2)}</option>" for _ in range(3)) + "</select>")
        self.put(f"<button>{self.words(1, 2)}</button>")

    def comments(self) -> None:
        if self.r.random() < 0.5:
            self.put(f"<h3>{self.words(1, 2)}</h3>")
        for _ in range(self.r.randint(1, 5)):
            kind = self.r.choice(("li", "div class=comment", "p", "div class=comment-body", "article class=comment"))
            who = f"<b>{self.words(1, 2)}</b> " if self.r.random() < 0.5 else ""
            self.put(f"<{kind}>{who}<p>{self.sentences(1, 5)}</p></{kind.split()[0]}>")

    def footer(self) -> None:
        self.put(f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 2)}" if self.r.random() < 0.6 else f"<p>{self.sentences(1, 2)}</p>")
        if self.r.random() < 0.5:
            self.menu()

    def article(self) -> None:
        r = self.r
        boxes = r.random() < 0.15  # pages that use div for everything
        name = r.choice(("", " class=txt", " class=para", " class=text"))
        if r.random() < 0.85:
            title = r.choice(("div", "div class=headline", "div class=title", "h2")) if boxes else "h1"
            self.put(f"<{title}>{self.words(3, 10).capitalize()}</{title.split()[0]}>", True)
        terse = r.random() < 0.2  # verse, chat logs: many short paragraphs
        for _ in range(r.randint(4, 40) if terse else r.randint(1, 12)):
            kind = 0.0 if terse and r.random() < 0.9 else r.random()
            text = self.words(1, 4).capitalize() + r.choice(("", ".")) if terse else self.sentences(1, 9)
            if r.random() < 0.2:
                text = text.replace(" ", f" {self.link()} ", 1)
            if boxes and kind < 0.8:
                self.put(f"<div{name}>{text}</div>", True)
            elif kind < 0.62:
                end = "</p>" if r.random() < 0.85 else ""
                lead = f"<b>{self.words(2, 5)}</b> " if r.random() < 0.2 else ""
                self.put(f"<p>{lead}{text}{end}", True)
            elif kind < 0.70:
                self.put(f"<h{r.randint(2, 4)}>{self.words(2, 7)}</h3>", True)
            elif kind < 0.76:
                self.put("<ul>" + "".join(f"<li>{self.sentences(1, 2)}</li>" for _ in range(r.randint(2, 5))) + "</ul>", True)
            elif kind < 0.80:
                self.put(f"<blockquote>{text}</blockquote>", True)
            elif kind < 0.83:
                self.put("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(3)) + "</table>", True)
            elif kind < 0.86:
                self.put(f"<pre>{self.words(3, 20)}</pre>", True)
            elif kind < 0.89:
                self.put(f"<figure><img src=x><figcaption>{self.sentences(1, 1)}</figcaption></figure>", True)
            elif kind < 0.93:
                self.put(f"<div>{text}</div>", True)
            else:
                part = r.choice(("advert", "advert", "sidebar", "form", "notice", "menu"))
                self.inside(r.choice(PLACES[part]), False, {"form": self.form, "menu": self.menu}.get(part, self.short))

    def page(self) -> list[tuple[str, bool]]:
        r = self.r
        self.put(f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style></head><body>")
        for part, write, share in (
            ("header", self.header, 0.4), ("menu", self.menu, 0.8), ("notice", self.short, 0.3),
            ("advert", self.short, 0.5), ("sidebar", self.short, 0.2), ("form", self.form, 0.15),
        ):
            if r.random() < share:
                self.inside(r.choice(PLACES[part]), False, write)
        if r.random() < 0.5:
            self.put('<script>var t="</p><p>";</script><!-- part -->')
        self.inside(r.choice(PLACES["article"]), True, self.article)
        for part, write, share in (
            ("advert", self.short, 0.3), ("comments", self.comments, 0.45), ("form", self.form, 0.2),
            ("sidebar", self.short, 0.4), ("notice", self.short, 0.15), ("menu", self.menu, 0.2), ("footer", self.footer, 0.85),
        ):
            if r.random() < share:
                self.inside(r.choice(PLACES[part]), False, write)
        return self.parts


def labelled_pages(count: int, seed: int = 0) -> list[list[tuple[str, bool]]]:
    """``count`` pages of labelled parts; the same for the same seed."""
    return [_Writer(seed * 1_000_003 + k).page() for k in range(count)]
