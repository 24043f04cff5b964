"""Labelled pages for the extraction model, composed by rule.

Every page is built from parts whose role is known: the article and its
headings, lists, tables and captions; menus, headers, footers, sidebars,
notices, adverts, forms and reader comments.  The rule varies what real pages
vary: which tags carry a role, whether class names tell anything, what stands
inside the article, how long its paragraphs are, and the script of the text.
"""

from __future__ import annotations

import html
import random

# Class and id words that sites use for each role.
ROLES = {
    "content": "article post entry content story body text blog single main hentry detail read prose lead".split(),
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs tabs pagination pager skip links sitenav".split(),
    "header": "header masthead top branding logo banner hero site".split(),
    "footer": "footer bottom copyright legal colophon foot imprint".split(),
    "sidebar": "sidebar aside widget related recommended trending popular rail secondary tags archive teaser".split(),
    "notice": "notice cookie cookies consent gdpr alert modal popup overlay paywall message toast".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense commercial partner".split(),
    "form": "form search login subscribe newsletter signup contact register".split(),
    "comments": "comments comment disqus replies reply respond discussion commentlist thread reactions".split(),
    "social": "share social follow sharing buttons meta byline".split(),
}
NEUTRAL = "wrapper container inner outer row col grid box block section panel clearfix page left right wide item unit area".split()
SCRIPTS = ["etaoinshrdlucmfwypvbgk", "аоеинтсрвлкмдпуяыьгзб", "αοιετσνηυρπκμλδγ", "eniasrtdhulcgmobwfkzäöüß", "的一是不了人我在有他这中大来上国"]
# The first is the usual one.
TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "notice": ["div", "aside", "dialog"],
        "ad": ["div", "div", "aside", "section"], "form": ["form", "div"], "comments": ["section", "div", "ul"], "social": ["div", "ul", "p"]}


class Composer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.letters = self.r.choice(SCRIPTS)
        self.told = self.r.random() < 0.7  # class names say something
        self.tagged = self.r.random() < 0.75  # sectioning elements are used
        self.main: list[str] = []

    def word(self) -> str:
        return "".join(self.r.choices(self.letters, k=self.r.randint(1, 9)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def prose(self) -> str:
        kind = self.r.random()
        if kind < 0.16:
            return self.words(1, 4).capitalize() + self.r.choice([".", "", ",", "!"])
        if kind < 0.22:
            return " | ".join(self.words(1, 2) for _ in range(self.r.randint(2, 15)))
        if kind < 0.26:
            return " ".join(str(self.r.randint(0, 10**self.r.randint(1, 9))) for _ in range(self.r.randint(1, 12)))
        if kind < 0.29:
            return f"{self.word()}@{self.word()}.com © {self.words(2, 6)} 2019 {self.words(0, 9)}"
        if kind < 0.32:
            return self.words(3, 12).upper() + "!!!"
        if kind < 0.35:
            return " ".join(["\n".join(self.words(1, 2) for _ in range(4)), "$ { } ; = 1"])
        sentences = [self.words(3, 25).capitalize() + self.r.choice([".", ".", ".", "?", "…"]) for _ in range(self.r.randint(1, 9))]
        return " ".join(s.replace(" ", ", ", 1) if self.r.random() < 0.4 else s for s in sentences)

    def inline(self, text: str, links: float) -> str:
        """The text with character references and inline markup."""
        out = []
        for w in text.split():
            w = html.escape(w, quote=self.r.random() < 0.5)
            x = self.r.random()
            if x < links:
                w = f'<a href="/{self.r.randint(1, 999)}?a=1&b=2">{w}</a>'
            elif x < links + 0.02:
                w = f"<{(t := self.r.choice(['b', 'em', 'code', 'span']))}>{w}</{t}>"
            out.append(w)
        return " ".join(out) if self.r.random() < 0.9 else "\n  ".join(out)

    def piece(self, tag: str, text: str, main: bool, links: float = 0.0) -> str:
        text = " ".join(text.split())
        if main and text:
            self.main.append(text)
        close = "" if tag in ("p", "li") and self.r.random() < 0.15 else f"</{tag}>"
        bold = "<b>" if tag == "p" and self.r.random() < 0.1 else ""
        return f"<{tag}>{bold}{self.inline(text, links)}{'<br>' if self.r.random() < 0.05 else ''}{close}"

    def attributes(self, role: str | None) -> str:
        tokens = self.r.sample(NEUTRAL, self.r.randint(0, 2))
        if role and self.told and self.r.random() < 0.85:
            tokens.insert(self.r.randint(0, len(tokens)), self.r.choice(ROLES[role]))
        if not tokens:
            return ""
        joined = self.r.choice([" ", "-", "_", " "]).join(tokens)
        return f' {self.r.choice(["class", "class", "id"])}="{joined}"'

    def within(self, tag: str, role: str | None, inner: str) -> str:
        return f"<{tag}{self.attributes(role)}>{inner}</{tag}>"

    def part(self, role: str) -> str:
        """A part that is no article text."""
        r = self.r
        tag = (TAGS[role][0] if r.random() < 0.6 else r.choice(TAGS[role])) if self.tagged else "div"
        if role == "nav":
            items = "".join(self.piece("li", self.words(1, 3).capitalize(), False, 1.0) for _ in range(r.randint(2, 9)))
            return self.within("ul", role, items) if tag == "ul" else self.within(tag, role, f"<ul>{items}</ul>")
        if role == "header":
            return self.within(tag, role, self.piece(r.choice(["div", "p", "h1", "h2"]), self.words(1, 5), False, 0.5) + (self.part("nav") if r.random() < 0.5 else ""))
        if role == "footer":
            text = f"© {r.randint(1998, 2030)} {self.words(1, 4)} · {self.words(2, 14)}." if r.random() < 0.4 else self.words(1, 3) + " · " + self.prose()
            return self.within(tag, role, self.piece(r.choice(["p", "div"]), text, False, 0.2) if r.random() < 0.6 else self.inline(text, 0.0))
        if role == "sidebar":
            inner = self.piece(r.choice(["h2", "h3", "h4"]), self.words(1, 3), False)
            inner += "".join(self.piece(r.choice(["li", "p", "li"]), self.words(2, 12) if r.random() < 0.7 else self.prose(), False, r.choice([0.0, 1.0])) for _ in range(r.randint(1, 6)))
            return self.within(tag, role, inner)
        if role in ("notice", "ad"):
            text = self.prose()
            inner = self.inline(text, r.choice([0.0, 0.1, 0.6])) if r.random() < 0.6 else self.piece("p", text, False, 0.1)
            return self.within(tag, role, inner + (self.piece("button", self.words(1, 2), False) if role == "notice" and r.random() < 0.6 else ""))
        if role == "form":
            inner = "".join(self.piece("label", self.words(1, 3), False) + '<input name="q">' for _ in range(r.randint(1, 3))) + self.piece("button", self.words(1, 2), False)
            return self.within(tag, role, inner if tag == "form" else f'<form action="/">{inner}</form>')
        if role == "comments":
            each = r.choice(["li", "div", "article"]) if self.tagged else "div"
            inner = self.piece(r.choice(["h2", "h3"]), self.words(1, 3), False)
            for _ in range(r.randint(1, 5)):
                inner += self.within(each, "comments", self.piece("div", f"{self.words(1, 2)} {r.randint(1, 28)}.{r.randint(1, 12)}.2021", False, 0.3) + self.piece("p", self.prose(), False))
            return self.within(tag, role, inner)
        items = "".join(self.piece("li" if tag == "ul" else "span", self.words(1, 2), False, 0.7) + " " for _ in range(r.randint(1, 4)))
        return self.within(tag, role, items)

    def article(self) -> str:
        r, out = self.r, []
        title = self.words(2, 12).capitalize()
        if r.random() < 0.85:
            heading = self.piece(r.choice(["h1", "h1", "h2"]), title, True)
            out.append(f"<header>{heading}</header>" if self.tagged and r.random() < 0.15 else heading)
        if r.random() < 0.3:
            out.append(self.part("social"))
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            x = r.random()
            if x < 0.68:
                out.append(self.piece(r.choice(["p", "p", "p", "p", "div"]), self.prose(), True, r.choice([0, 0, 0, 0.08])))
            elif x < 0.75:
                out.append(self.piece(r.choice(["h2", "h3", "h4"]), self.words(1, 8), True))
            elif x < 0.80:
                out.append("<ul>" + "".join(self.piece("li", self.words(1, 14), True, r.choice([0, 0, 0.2])) for _ in range(r.randint(1, 6))) + "</ul>")
            elif x < 0.83:
                out.append("<blockquote>" + self.piece("p", self.prose(), True) + "</blockquote>")
            elif x < 0.85:
                out.append("<table>" + "".join("<tr>" + "".join(self.piece("td", self.words(1, 3), True) for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.88:
                out.append('<figure><img src="a.png">' + self.piece("figcaption", self.words(2, 12), True) + "</figure>")
            elif x < 0.90:
                out.append(self.piece("pre", self.prose(), True))
            else:
                out.append(self.part(r.choice(["ad", "ad", "ad", "social", "sidebar", "notice", "form"])))
        inner = "".join(out)
        if self.tagged:
            inner = self.within(r.choice(["article", "article", "article", "main", "section"]), "content", inner)
        if not self.tagged or r.random() < 0.5:
            inner = self.within("div", "content", inner)
        return inner

    def page(self) -> str:
        r = self.r
        if r.random() < 0.05:  # a bare fragment
            return "".join(self.piece("p", self.prose(), True) for _ in range(r.randint(1, 6)))
        before = [self.part(x) for x in ("notice", "header", "nav", "ad", "form") if r.random() < 0.5]
        r.shuffle(before)
        body = "".join(before)
        if r.random() < 0.97:
            body += self.article()
        after = [self.part(x) for x in ("social", "sidebar", "comments", "form", "ad", "nav") if r.random() < 0.35]
        body += "".join(after) + (self.part("footer") if r.random() < 0.85 else "") + (self.part("notice") if r.random() < 0.2 else "")
        if r.random() < 0.4:
            body = self.within("div", r.choice([None, "content"]), body)  # wrappers are often named like the article
        head = f"<head><title>{html.escape(self.main[0][:60]) if self.main else ''}</title><style>p{{margin:0}}</style><script>var t='</p><p>x';</script></head>"
        end = "</body></html>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html lang=en>{head}<body>{body}<!-- {self.word()} -->{end}"


def labelled_pages(n: int, seed: int = 1) -> list[tuple[str, str]]:
    """``n`` pages and their main text, a block a line."""
    out = []
    for i in range(n):
        composer = Composer(seed * 1_000_003 + i)
        page = composer.page()
        out.append((page, "\n".join(composer.main)))
    return out
