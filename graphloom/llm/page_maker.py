"""Labelled pages for training: random layouts of articles among menus, adverts, notices, comments and the like.

Everything comes from rules and a seed; no page of a corpus is copied. A page's label is the list of source
spans that belong to the article."""

from __future__ import annotations

from random import Random

_SYLLABLES = "an be ci do er fu ga he in jo ka lu me no or pa qui re so ta un ve wi xa yo zu th st nd ing tion".split()


class PageMaker:
    def __init__(self, seed: int):
        self.r = Random(seed)
        self.heads = Random(f"heads {seed}")  # of their own, so that the layouts don't depend on it
        self.plain = False  # whether the page tells nothing by its names

    def one(self, *options):
        return options[self.r.randrange(len(options))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.randrange(1, 5)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randrange(low, high + 1)))

    def sentence(self, low: int = 1, high: int = 16) -> str:
        return self.words(low, high).capitalize() + self.one(".", ".", ".", "?", "!", "")

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randrange(low, high + 1)))

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.word()}">{self.words(low, high)}</a>'

    def named(self, tag: str, *names: str, inside: str, p: float = 1.0) -> str:
        """An element with one of the names as class, id or both with a suffix."""
        if not self.chance(p):
            return f"<{tag}>{inside}</{tag}>"
        if self.plain and tag in ("div", "section", "ul", "ol") and self.chance(0.5):  # a name that isn't known, or none
            return self.one(f"<{tag}>{inside}</{tag}>", f'<{tag} id="{self.word()}">{inside}</{tag}>', f'<{tag} class="{self.word()} {self.word()}">{inside}</{tag}>')
        name = self.one(*names) + self.one("", "", "", "-box", "-1", "_wrap", " " + self.word())
        return f'<{tag} {self.one("class", "class", "id")}="{name}">{inside}</{tag}>'

    # what isn't article

    def links(self) -> str:
        n = self.r.randrange(2, 9)
        return self.one("<ul>{}</ul>", "<ol>{}</ol>").format("".join(f"<li>{self.link()}</li>" for _ in range(n))) if self.chance(0.8) else " | ".join(self.link() for _ in range(n))

    def menu(self) -> str:
        return self.one(lambda: f"<nav>{self.links()}</nav>", lambda: self.named("div", "nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav", "toolbar", inside=self.links()), lambda: f'<div role="navigation">{self.links()}</div>')()

    def header(self) -> str:
        inside = self.one(f"<h1>{self.words(1, 4)}</h1>", f"<h2>{self.words(1, 4)}</h2>", f"<div>{self.words(1, 3)}</div>", f"<p>{self.sentence()}</p>", self.link(), self.prose(1, 2))
        return self.one(lambda: f"<header>{inside}{self.menu() if self.chance(0.4) else ''}</header>", lambda: self.named("div", "header", "masthead", "topbar", "site-header", "branding", "logo", inside=inside))()

    def plain_foot(self) -> str:
        """A foot that only its shortness and place tell."""
        inside = self.one(self.words(1, 3).capitalize(), f"&copy; {self.words(1, 3)}", self.link(1, 2), " | ".join(self.link(1, 2) for _ in range(self.r.randrange(2, 5))), f"{self.words(1, 2)} {self.link(1, 2)}", f"{self.r.randrange(1, 9)} {self.word()} 20{self.r.randrange(10, 30)}")
        return self.one(f'<div id="{self.word()}">{inside}</div>', f"<div>{inside}</div>", f"<small>{inside}</small>", f"<address>{inside}</address>", f'<div class="{self.word()}">{inside}</div>', f"<hr>{inside}")

    def footer(self) -> str:
        inside = self.one(f"&copy; {self.word()}.example &middot; {self.prose(1, 2)}", f"<p>&copy; 20{self.r.randrange(10, 30)} {self.words(2, 6)}</p>", self.links(), f"<p>{self.prose(1, 2)}</p>")
        return self.one(lambda: f"<footer>{inside}</footer>", lambda: self.named("div", "footer", "site-footer", "copyright", "legal", "bottom", inside=inside))()

    def advert(self) -> str:
        inside = self.one(self.prose(1, 2), f"<p>{self.prose(1, 3)}</p>", self.link(2, 6), f"<a href='x'><b>{self.sentence()}</b></a>", f"<h3>{self.words(2, 5)}</h3><p>{self.prose(1, 2)}</p>")
        return self.named(self.one("div", "div", "section", "aside", "p", "ins"), "ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "banner", "adsbox", inside=inside)

    def side(self) -> str:
        inside = self.one(f"<h3>{self.words(1, 4)}</h3>{self.links()}", f"<p>{self.prose(1, 4)}</p>", f"<h2>{self.words(1, 3)}</h2><p>{self.prose(1, 3)}</p><p>{self.link()}</p>", self.prose(1, 3))
        return self.one(lambda: f"<aside>{inside}</aside>", lambda: self.named(self.one("div", "section", "aside"), "sidebar", "related", "widget", "recommended", "trending", "popular", "more", "teaser", "author-bio", inside=inside), lambda: f'<div role="complementary">{inside}</div>')()

    def notice(self) -> str:
        inside = self.one(self.prose(1, 3), f"<p>{self.prose(1, 2)}</p><button>{self.word()}</button>", f"<p>{self.prose(1, 3)} {self.link()}</p>")
        return self.one(lambda: self.named(self.one("div", "section", "p", "aside"), "cookie", "cookies", "consent", "notice", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "paywall", "warning", "message", "privacy", inside=inside), lambda: f'<div role="{self.one("alert", "dialog", "alertdialog")}">{inside}</div>', lambda: f"<dialog open>{inside}</dialog>")()

    def form(self) -> str:
        return f'<form action="/{self.word()}"><label>{self.words(1, 3)}</label><input name="q">{self.one("", f"<p>{self.prose(1, 2)}</p>")}<button>{self.word()}</button></form>'

    def comments(self) -> str:
        n = self.r.randrange(1, 6)
        one = lambda: self.one(f"<p>{self.prose(1, 5)}</p>", f"<b>{self.word()}</b>: {self.prose(1, 3)}", f"<h4>{self.words(1, 2)}</h4><p>{self.prose(1, 4)}</p><p>{self.prose(1, 3)}</p>", f"<span>{self.word()}</span><div>{self.prose(1, 4)}</div>")
        kind = self.one(("ul", "li"), ("ol", "li"), ("div", "div"), ("section", "div"), ("section", "article"))
        inside = "".join(self.named(kind[1], "comment", "reply", "comment-body", inside=one(), p=0.6) for _ in range(n))
        return self.named(kind[0], "comments", "comment-list", "discussion", "replies", "responses", "respond", "disqus", inside=(f"<h3>{self.words(1, 3)}</h3>" if self.chance(0.5) else "") + inside)

    def share(self) -> str:
        return self.named("div", "share", "social", "tags", "pagination", "pager", "meta", "byline", inside=self.one(self.links(), self.words(1, 5)))

    def other(self) -> str:
        return self.one(self.menu, self.advert, self.side, self.notice, self.form, self.comments, self.share, self.advert)()

    # the article

    def inline(self, text: str) -> str:
        words = text.split(" ")
        for _ in range(self.one(0, 0, 0, 0, 1, 1, 2, 3, 4) if len(words) > 4 else 0):
            i = self.r.randrange(len(words) - 2)
            words[i] = self.one("<b>{}</b>", "<em>{}</em>", "<a href='/x'>{}</a>", "<span>{}</span>", "<code>{}</code>").format(words[i])
        return " ".join(words)

    def content(self) -> str:
        text = self.inline(self.one(self.prose(1, 8), self.prose(1, 3), self.sentence(), self.words(1, 12)))
        if self.chance(0.06):  # a list whose items link, or run on
            return self.one("<ul>{}</ul>", "<ol>{}</ol>").format("".join(f"<li>{self.one(self.inline(self.prose(1, 3)), self.link(1, 4) + ' ' + self.sentence(3, 12), self.sentence())}{self.one('', '</li>')}" for _ in range(self.r.randrange(2, 7))))
        return self.one(
            f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p>{text}<br></p>", f"<div>{text}</div>", f'<p class="{self.one("lead", "text", "intro", self.word())}">{text}</p>',
            f"<h{self.one(2, 3, 4)}>{self.words(1, 8)}</h{self.one(2, 3)}>", f"<blockquote>{self.one(f'<p>{text}</p>', text)}</blockquote>", self.one("<ul>{}</ul>", "<ol>{}</ol>").format("".join(f"<li>{self.inline(self.sentence())}</li>" for _ in range(self.r.randrange(1, 6)))),
            f"<pre>{self.words(3, 20)}</pre>", f"<table><tr><td>{self.words(1, 5)}</td><td>{self.words(1, 5)}</td></tr></table>", f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>",
        )

    def loose(self) -> list[tuple[str, bool]]:
        """An article without a container: paragraphs, lists or bare text straight in the body."""
        kind = self.r.randrange(6)
        if kind == 0:  # text without tags
            return [(self.prose(1, 12), True)]
        if kind == 1:  # lines
            return [(self.one("<br>", "<br><br>", "<p>", "\n").join(self.inline(self.prose(1, 5)) for _ in range(self.r.randrange(1, 8))), True)]
        if kind == 2:  # one or two paragraphs
            return [(f"<p>{self.inline(self.prose(1, 4))}{self.one('</p>', '')}", True) for _ in range(self.r.randrange(1, 3))]
        parts = [(f"<h{self.one(1, 1, 2)}>{self.words(1, 9)}</h1>", True)] if self.chance(0.4) else []
        return parts + [(self.one(lambda: f"<p>{self.inline(self.prose(1, 9))}</p>", lambda: f"<p>{self.inline(self.prose(1, 9))}</p>", self.content)(), True) for _ in range(self.r.randrange(1, 8))]

    def plain_page(self) -> tuple[str, list[tuple[int, int]]]:
        """A page without article or main, or with an article of one paragraph or of paragraphs and lists; its surroundings are few and often unnamed."""
        self.plain = True
        parts: list[tuple[str, bool]] = [(self.one("", "<html><body>", f"<!DOCTYPE html><title>{self.words(1, 4)}</title><body>", f"<html><head><title>{self.words(1, 4)}</title></head><body>"), False)]
        wrapped = self.chance(0.2)
        if wrapped:
            parts.append((f'<div id="{self.word()}">', False))
        for make in (self.header, self.menu, lambda: " ".join(self.link() for _ in range(self.r.randrange(2, 7))) + "<hr>", lambda: f'<div class="{self.word()}">{self.links()}</div>', self.notice):
            if self.chance(0.25):
                parts.append((make(), False))
        kind = self.r.randrange(4)
        if kind == 0:  # an article of a few blocks
            tag = self.one("article", "article", "main", 'div class="content"', "section")
            parts.append((f"<{tag}>", False))
            parts += [(self.one(f"<p>{self.inline(self.sentence(4, 20))}</p>", f"<p>{' '.join(self.one(self.link(1, 3), self.words(1, 5)) for _ in range(self.r.randrange(2, 7)))}.</p>", self.sentence(4, 20)), True)] if self.chance(0.4) else [(self.content(), True) for _ in range(self.r.randrange(1, 5))]
            parts.append((f"</{tag.split()[0]}>", False))
        elif kind == 1:  # boxes that tell nothing
            parts += [(f'<div id="{self.word()}">', False), *self.loose(), ("</div>", False)]
        else:
            loose = self.loose()
            if len(loose) > 2 and self.chance(0.25):
                loose.insert(self.r.randrange(1, len(loose)), (self.one(self.advert, self.side, self.form)(), False))
            parts += loose
        for make in (self.comments, self.side, self.advert, self.menu):
            if self.chance(0.12):
                parts.append((make(), False))
        if wrapped:
            parts.append(("</div>", False))
        if self.chance(0.6):
            parts.append((self.one(self.footer, self.plain_foot)(), False))
        if self.chance(0.5):
            parts.append(("</body></html>", False))
        self.plain = False
        return self._spans(parts)

    @staticmethod
    def _spans(parts: list[tuple[str, bool]]) -> tuple[str, list[tuple[int, int]]]:
        html, spans = "", []
        for text, main in parts:
            if main:
                spans.append((len(html), len(html) + len(text)))
            html += text
        return html, spans

    def page(self) -> tuple[str, list[tuple[int, int]]]:
        """(html, spans of the article)."""
        if self.chance(0.4):
            return self.plain_page()
        parts: list[tuple[str, bool]] = [(f'<!DOCTYPE html><html lang="xx"><head><title>{self.words(1, 9)}</title><style>b{{color:red}}</style><script>let k = 1 < 2, m = "</i>";</script>{"</head>" if self.heads.random() < 0.8 else ""}<body>', False)]
        add = lambda html, main=False: parts.append((html, main))
        for make in (self.notice, self.header, self.menu, self.advert, self.side, self.form, self.notice):
            if self.chance(0.4):
                add(make())
        if self.chance(0.3):
            add(f"<!-- {self.word()} -->")
        opens, closes = self.one(
            ("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div id="content">', "</div>"), ('<div class="post-body">', "</div>"), ('<div class="entry-content">', "</div>"),
            ('<section class="story">', "</section>"), ('<div class="article">', "</div>"), ('<div id="main">', "</div>"), ("<table><tr><td>", "</td></tr></table>"), ("<div>", "</div>"), ('<div class="container">', "</div>"), ("", ""), ('<div role="main">', "</div>"),
        )
        add(opens)
        if self.chance(0.8):
            title = f"<h1>{self.words(1, 12)}</h1>"
            add(f"<header>{title}</header>" if "article" in opens and self.chance(0.3) else title, True)
        if self.chance(0.15):
            add(self.share())
        for _ in range(self.r.randrange(1, 12)):
            add(self.content(), True)
            if self.chance(0.12):
                add(self.one(self.advert, self.side, self.notice, self.advert, self.form, self.menu)())
        if self.chance(0.2):
            add(self.one(self.comments, self.share, self.side, self.footer)())
        if not self.chance(0.03):
            add(closes)
        for make in (self.share, self.comments, self.side, self.advert, self.form, self.menu, self.notice, self.footer, self.footer):
            if self.chance(0.4):
                add(make())
        if not self.chance(0.1):
            add("</body></html>")
        return self._spans(parts)
