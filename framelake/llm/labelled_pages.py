"""Labelled pages for training: layouts in which it is known of each block whether it belongs to the article.

A page is put together from parts (menu, site header, advert, notice, article, related links,
comments, form, footer), each in several markups: with the elements made for it, or with plain
elements and a class or id. Texts are made of syllables, so that nothing is learned about words but those of page furniture.
"""

from __future__ import annotations

import random

# Syllables of filler text.
SYLLABLES = "ba con der en fi gra hin is jo ka lor men nis or pra qui res sta tum un ver wi xa yel zo the and ich que los mit sur".split()
# Short texts of page furniture.
MENU = ["Home", "News", "About", "Contact", "Sport", "Login", "Start", "Kontakt", "Accueil", "Inicio", "Archive", "Shop"]
FOOT = ["© 2023 Example. All rights reserved.", "Imprint", "Privacy policy", "Terms of use", "Impressum und Datenschutz", "Mentions légales", "Copyright notice"]
NOTICES = ["We use cookies to improve this site.", "This site uses cookies. Accept or read our privacy terms.", "Please subscribe to go on reading."]

# Class and id names that tell nothing.
NEUTRAL = ["col1", "col2", "top", "left", "right", "box", "wrap", "c1", "inner", "x", "row", "panel", "cell", "block-3", "area"]
ADVERTS = ["Advertisement", "Werbung", "Anzeige", "Publicité", "Publicidad", "Sponsored"]

Part = tuple[str, list[bool]]


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.plain = False

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 3)))

    def sentence(self, low: int = 2, high: int = 16) -> str:
        ws = [self.word() for _ in range(self.r.randint(low, high))]
        return " ".join(ws).capitalize() + self.r.choice([".", ".", ".", "!", "?"])

    def prose(self, most: int = 8) -> str:
        if self.r.random() < 0.12:  # a fragment: one to three words, no sentence end
            return " ".join(self.word() for _ in range(self.r.randint(1, 3)))
        text = " ".join(self.sentence() for _ in range(self.r.randint(1, most)))
        if self.r.random() < 0.2:
            text = f"<b>{self.word()}</b> {text}"
        if self.r.random() < 0.2:
            text += f' <a href="/x">{self.word()}</a> {self.sentence()}'
        return text

    def title(self) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(1, 7))).capitalize()

    def wrap(self, inner: str, element: str | None, names: list[str], neutral: bool = True) -> str:
        """inner in its own element, or in a div with a class or id, or both; on a plain page in a div that tells nothing, where that is allowed."""
        how = self.r.random()
        if self.plain and neutral:
            return f"<div {self.r.choice(['id', 'class'])}=\"{self.r.choice(NEUTRAL)}\">{inner}</div>" if how < 0.8 else f"<div>{inner}</div>"
        mark = self.r.choice(["class", "class", "id"])
        name = self.r.choice(names)
        name = self.r.choice([name, name, f"{name}-{self.word()}", f"{self.word()} {name}", f"site-{name}"])
        if element and how < 0.5:
            return f"<{element}>{inner}</{element}>"
        if element and how < 0.65:
            return f'<{element} {mark}="{name}">{inner}</{element}>'
        return f'<{self.r.choice(["div", "div", "section"])} {mark}="{name}">{inner}</{"div"}>'.replace("<section", "<div")

    def links(self, n: int, texts: list[str] | None = None) -> Part:
        items = [self.r.choice(texts) if texts and self.r.random() < 0.5 else self.word() if self.r.random() < 0.7 else self.title() for _ in range(n)]
        if self.r.random() < 0.25:  # links in a row
            return self.r.choice([" ", " | ", "<br>"]).join(f'<a href="/{self.word()}">{x}</a>' for x in items), [False]
        return "<ul>" + "".join(f'<li><a href="/{self.word()}">{x}</a></li>' for x in items) + "</ul>", [False] * n

    def menu(self) -> Part:
        html, labels = self.links(self.r.randint(3, 9), MENU)
        return self.wrap(html, "nav", ["nav", "menu", "navbar", "navigation", "breadcrumbs"]), labels

    def head(self) -> Part:
        parts = [(f"<{t}>{self.title()}</{t}>", [False]) for t in [self.r.choice(["h1", "h2", "div", "p"])]]
        if self.r.random() < 0.5:
            parts.append((f"<p>{self.sentence()}</p>", [False]))
        if self.r.random() < 0.5:
            parts.append(self.menu())
        return self.wrap("".join(p[0] for p in parts), "header", ["header", "masthead", "branding", "banner"], False), [x for p in parts for x in p[1]]

    def advert(self) -> Part:
        n = self.r.randint(1, 2)
        inner = "".join(f"<p>{self.prose(3)}</p>" for _ in range(n)) if n > 1 else self.r.choice([self.prose(3), self.sentence(), f'<a href="/b">{self.sentence()}</a>'])
        if self.r.random() < 0.2:  # an advert that says so
            return self.r.choice(["<aside>{}</aside>", "<div>{}</div>", "<p>{}</p>"]).format(f"{self.r.choice(ADVERTS)}: {self.sentence(2, 6)}"), [False]
        return self.wrap(inner, self.r.choice([None, None, "aside"]), ["ad", "ads", "advert", "advertisement", "sponsored", "promo"], False), [False] * n

    def notice(self) -> Part:
        n = self.r.randint(1, 2)
        inner = "".join(f"<p>{self.r.choice(NOTICES) if self.r.random() < 0.6 else self.prose(2)}</p>" for _ in range(n))
        return self.wrap(inner, None, ["cookie", "notice", "consent", "alert", "popup", "gdpr", "privacy"], False), [False] * n

    def side(self) -> Part:
        html, labels = self.links(self.r.randint(2, 6))
        if self.r.random() < 0.7:
            html, labels = f"<h3>{self.title()}</h3>{html}", [False, *labels]
        if self.r.random() < 0.5 and not self.plain:  # prose in a box that tells nothing is an article's
            html, labels = f"{html}<p>{self.prose(3)}</p>", [*labels, False]
        return self.wrap(html, "aside", ["sidebar", "related", "widget", "recommended", "popular"]), labels

    def form(self) -> Part:
        inner = f'<label>{self.title()}</label><input name="q"><button>{self.word()}</button>'
        labels = [False, False]
        if self.r.random() < 0.5:
            inner, labels = f"<p>{self.r.choice(['Subscribe to our newsletter', self.sentence()])}</p>{inner}", [False, *labels]
        return f"<form action='/s'>{inner}</form>" if self.r.random() < 0.7 else self.wrap(inner, None, ["form", "newsletter", "search", "signup"], False), labels

    def comments(self) -> Part:
        n = self.r.randint(1, 6)
        each = self.r.choice(["<p>{}</p>", "<li>{}</li>", "<div class='comment'>{}</div>", "<div class='comment'><p>{}</p></div>", "<li class='comment'><div class='comment-body'><p>{}</p></div></li>", "<div class='comment-text'>{}</div>", "<article class='reply'><p>{}</p></article>"])
        inner = "".join(each.format(self.prose(4)) for _ in range(n))
        inner = f"<{self.r.choice(['ul', 'ol'])}>{inner}".replace("<ol>", "<ul>") + "</ul>" if "<li" in each else inner
        labels = [False] * n
        if self.r.random() < 0.6:
            inner, labels = f"<h3>{self.title()}</h3>{inner}", [False, *labels]
        return self.wrap(inner, None, ["comments", "comment-list", "discussion", "replies", "responses", "disqus_thread", "commentlist comments"], False), labels

    def share(self) -> Part:
        html, labels = self.links(self.r.randint(2, 4))
        return self.wrap(html, None, ["share", "social", "follow"], False), labels

    def foot(self) -> Part:
        n = self.r.randint(1, 4)
        if self.plain:
            return self.wrap("".join(f"<p>{self.r.choice(FOOT)}</p>" for _ in range(n)) if n > 1 else self.r.choice(FOOT), None, ["footer"]), [False] * n
        inner = "".join(f"<p>{self.r.choice(FOOT) if self.r.random() < 0.6 else self.sentence()}</p>" for _ in range(n)) if n > 1 or self.r.random() < 0.5 else self.r.choice([self.sentence(), self.prose(2), self.r.choice(FOOT)])
        return self.wrap(inner, "footer", ["footer", "foot", "copyright", "colophon"]), [False] * n

    def article(self) -> Part:
        inner, labels = self.article_parts()
        return self.wrap(inner, self.r.choice(["article", "article", "main"]), ["article", "content", "post", "entry", "story", "main", "post-body"]), labels

    def article_parts(self) -> Part:
        parts: list[Part] = []
        if self.r.random() < 0.8:
            parts.append((f"<h1>{self.title()}</h1>", [True]))
        if self.r.random() < 0.1:
            parts.append((f"<p>{self.r.choice(['By', 'Von', 'Par', 'Por'])} {self.word().capitalize()} {self.word().capitalize()}</p>", [True]))
        for _ in range(self.r.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = self.r.random()
            if kind < 0.54:
                parts.append((f"<p>{self.prose()}</p>", [True]))
            elif kind < 0.62:
                parts.append((f"<div>{self.prose()}</div>", [True]))
            elif kind < 0.7:
                parts.append((f"<p><b>{self.sentence()}<br><p>{self.prose()}</p>", [True, True]))
            elif kind < 0.76:
                parts.append((f"<h2>{self.title()}</h2>", [True]))
            elif kind < 0.8:
                n = self.r.randint(2, 4)
                parts.append(("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(n)) + "</ul>", [True] * n))
            elif kind < 0.84:
                parts.append((f"<blockquote><p>{self.prose(3)}</p></blockquote>", [True]))
            elif kind < 0.87:
                parts.append((f"<table><tr><td>{self.word()}</td><td>{self.word()}</td></tr></table>", [True, True]))
            elif kind < 0.9:
                parts.append((f"<figure><figcaption>{self.sentence()}</figcaption></figure>", [True]))
            elif kind < 0.92:
                parts.append((f"<pre>{self.prose(2)}</pre>", [True]))
            elif kind < 0.95:
                parts.append(self.advert())
            elif kind < 0.97:
                parts.append(self.share())
            else:
                parts.append(self.r.choice([self.notice, self.side, self.form])())
        return "".join(p[0] for p in parts), [x for p in parts for x in p[1]]

    def table_page(self) -> Part:
        """A page laid out by tables: cells of links, of the article, and of other things."""
        before = [self.links(self.r.randint(2, 7), MENU)] if self.r.random() < 0.8 else []
        after = [make() for make, share in ((self.advert, 0.4), (self.side, 0.3)) if self.r.random() < share]
        cells = [*before, self.article_parts(), *after]
        bgcolor = self.r.choice(["", ' bgcolor="#eee"', ' width="120"', ' valign="top"'])
        rows, labels = "".join(f"<td{bgcolor}>{h}</td>" for h, _ in cells), [x for _, ls in cells for x in ls]
        foot, foot_labels = (self.r.choice(FOOT), [False]) if self.r.random() < 0.7 else ("", [])
        last = f"<tr><td colspan=3>{foot}</td></tr>" if foot else ""
        return f"<html><head><title>{self.title()}</title></head><body><table>{'<tr>' + rows + '</tr>'}{last}</table></body></html>", [*labels, *foot_labels]

    def page(self) -> Part:
        r = self.r.random
        self.plain = r() < 0.25
        if self.plain and r() < 0.4:
            return self.table_page()
        parts: list[Part] = []
        for make, share in ((self.notice, 0.25), (self.head, 0.4), (self.menu, 0.7), (self.advert, 0.5), (self.form, 0.15), (self.side, 0.2)):
            if r() < share:
                parts.append(make())
        parts.append(self.article())
        for make, share in ((self.share, 0.15), (self.advert, 0.3), (self.comments, 0.4), (self.side, 0.4), (self.form, 0.2), (self.notice, 0.15), (self.foot, 0.85)):
            if r() < share:
                parts.append(make())
        start = f"<!DOCTYPE html><html><head><title>{self.title()}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head><body>"
        inner = "".join(p[0] for p in parts)
        if self.plain and r() < 0.5:
            inner = f'<div class="{self.r.choice(NEUTRAL)}">{inner}</div>'
        return start + inner + "</body></html>", [x for p in parts for x in p[1]]


def training_pages(n: int, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """n pages with the label of each leaf block: True for the article's own."""
    made = _Maker(seed)
    return [made.page() for _ in range(n)]
