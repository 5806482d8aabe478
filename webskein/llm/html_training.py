"""Generated pages of many layouts, with the label of every block, and the model trained on them.

Words are random syllables, the same inside and outside of articles, so that the labeller learns from structure, names
and context; part of the page furniture has its usual words.
"""

from __future__ import annotations

import functools
import random

from .html_blocks import Block, Labeller, blocks

PAGES = 1400
#: Marks article text in a generated page; no generated word has it.
_MARK = "⁣"

_SYLLABLES = "an be der en ing the tion re st al mo ra li ke do vo sch eau ción ment ß é ou x a i".split()
#: Common words, among them those of page furniture, so that no single word gives a block away.
_COMMON = "the and of to in all it was well then more read about home us we you our use log share reply next page back top popular follow search accept privacy policy rights sign posted by says that had they with for on at had from this new day time people year world story life work city house long".split()
_CONTAINERS = ["<article>", '<article class="post">', "<main>", '<main id="content"><article>', '<div class="content">', '<div id="content">', '<div class="post-content">', '<div class="entry-content">', '<div class="article-body">', '<section class="story">', '<div itemprop="articleBody" class="text">', '<div class="main-column"><div class="body">', "<div>", '<div role="main">', '<td class="main">']
_ADS = ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div id="banner-ad">', '<aside class="promo">', '<div class="sponsored">', '<ins class="adsbygoogle">', '<div class="ad-slot">', '<section class="sponsor">']
_SIDES = ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<aside class="widget">', '<div class="widget-area">', '<section class="related">', '<div class="related-posts">', '<div class="rail">', '<div class="trending">', '<div class="recommended">']
_COMMENTS = ['<div id="comments">', '<section class="comments">', '<ol class="commentlist">', '<div class="comment-thread">', '<ul class="comments-list">', '<div id="disqus_thread">', '<section id="responses">', '<div class="user-comments">']
_NOTICES = ['<div class="cookie-banner">', '<div id="cookie-notice">', '<div class="notice">', '<div class="gdpr-consent">', '<div class="alert">', '<div role="dialog" class="modal">', '<div class="disclaimer">', '<div class="popup">']
_HEADERS = ["<header>", '<div id="header">', '<div class="site-header">', '<div class="masthead">', '<header class="top">']
_FOOTERS = ["<footer>", '<div id="footer">', '<div class="footer">', '<footer class="site-footer">', '<div class="copyright">']
_MENUS = ["<nav>", '<div class="menu">', '<ul class="nav">', '<div id="navigation">', '<nav class="breadcrumbs">', '<div class="navbar">', '<div class="breadcrumb">', '<div class="pagination">', '<div class="toolbar">', '<div class="tags">', '<div class="share">', '<div class="social">']
_USUAL = ["Home", "About us", "Contact", "Log in", "Share this", "Read more", "Subscribe to our newsletter", "We use cookies to improve your experience.", "Accept all", "Related articles", "Advertisement", "Leave a reply", "All rights reserved.", "Privacy policy", "Terms of use", "Search", "Next page", "Posted in", "Follow us", "Sign up", "Reply", "says:", "Most popular", "Back to top"]


def _close(opening: str) -> str:
    names = [part.split(" ")[0].split(">")[0] for part in opening.split("<")[1:]]
    return "".join(f"</{n}>" for n in reversed(names))


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        if self.plain and self.r.random() < self.plain:
            return self.r.choice(_COMMON)
        w = "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randrange(1, 4)))
        return w.upper() + "!!" if self.shouts else w + self.noise if self.noise else w

    def prose(self, low: int, high: int) -> str:
        n = self.r.randrange(low, high)
        if high > 50 and self.r.random() < 0.05:
            n *= 15
        words = [self.word() for _ in range(n)]
        if self.repeats:
            words = [w for w in words[: 1 + n // 12] for _ in range(12)]
        words = [w + (self.r.choice(". , , ;".split()) if self.r.random() < 0.12 else "") for w in words]
        text = " ".join(words)
        return text[:1].upper() + text[1:] + ("." if self.r.random() < 0.8 else "")

    def mark(self, text: str, good: bool) -> str:
        if not good:
            return text
        pieces = text.split("<")
        return _MARK + text if len(pieces) == 1 else _MARK + text.replace(">", ">" + _MARK)

    def inline(self, text: str) -> str:
        words = text.split(" ")
        if len(words) > 4 and self.r.random() < 0.3:
            i = self.r.randrange(len(words) - 1)
            t = self.r.choice(['<a href="/x">', "<b>", "<em>", "<span>", "<strong>", "<code>"])
            words[i] = t + words[i] + _close(t)
        return " ".join(words)

    def furniture(self) -> str:
        return self.r.choice(_USUAL) if self.r.random() < 0.4 else self.prose(1, 9) if self.r.random() < 0.6 else self.prose(8, 40)

    def menu(self) -> str:
        t = self.r.choice(_MENUS)
        n = self.r.randrange(2, 12)
        link = lambda: f'<a href="/{self.word()}">{self.furniture() if self.r.random() < 0.2 else self.prose(1, 3)}</a>'
        style = self.r.randrange(3)
        inner = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>" if style == 0 else " | ".join(link() for _ in range(n)) if style == 1 else "".join(f"<div>{link()}</div>" for _ in range(n))
        return t + inner + _close(t)

    def boxed(self, kinds: list[str]) -> str:
        t = self.r.choice(kinds)
        n = self.r.choice((1, 1, 2, 3))
        style = self.r.randrange(4)
        if style == 0:
            inner = self.furniture()
        elif style == 1:
            inner = (h := self.r.choice(("h2", "h3", "h4"))) and f"<{h}>{self.furniture()}</{h}>" + "".join(f"<p>{self.furniture()}</p>" for _ in range(n))
        elif style == 2:
            inner = "<ul>" + "".join(f'<li><a href="#">{self.prose(2, 10)}</a></li>' for _ in range(n + 1)) + "</ul>"
        else:
            inner = "".join(f"<p>{self.prose(10, 60)}</p>" for _ in range(n))
        return t + inner + _close(t)

    def form(self) -> str:
        t = self.r.choice(["<form>", '<form class="search">', '<form id="newsletter">', '<form class="comment-form">'])
        options = "<select>" + "".join(f"<option>{self.prose(1, 3)}" for _ in range(3)) + "</select>"
        return f"{t}<label>{self.furniture()}</label><input name=q>{self.r.choice(['', options, '<textarea>' + self.prose(1, 5) + '</textarea>', '<p>' + self.furniture() + '</p>'])}<button>{self.furniture()}</button></form>"

    def comments(self) -> str:
        t = self.r.choice(_COMMENTS)
        item = self.r.choice(['<div class="comment">', "<li>", '<li class="comment"><div class="comment-body">', "<div>", '<article class="comment">'])
        head = lambda: self.r.choice([f"<h4>{self.prose(1, 3)}</h4>", f'<span class="author">{self.prose(1, 3)}</span> says:', f"<cite>{self.prose(1, 3)}</cite><br>", ""])
        body = lambda: "".join(f"<p>{self.prose(3, 60)}</p>" for _ in range(self.r.choice((1, 1, 2))))
        title = f"<h3>{self.r.randrange(1, 90)} {self.r.choice(['comments', 'responses', self.prose(1, 3)])}</h3>" if self.r.random() < 0.6 else ""
        return t + title + "".join(item + head() + body() + _close(item) for _ in range(self.r.randrange(1, 7))) + _close(t)

    def story(self) -> str:
        t = self.r.choice(_CONTAINERS)
        out = [t]
        if self.r.random() < 0.75:
            h = self.r.choice(("h1", "h1", "h1", "h2"))
            out.append(f"<{h}>{self.mark(self.prose(2, 12), True)}</{h}>")
        for k in range(self.r.choice((1, 1, 2, 3, 5, 8, 14, 25) * 4 + (60,))):
            x, text = self.r.random(), self.inline(self.prose(1, 12) if self.r.random() < 0.3 else self.prose(8, 110))
            good = self.mark(text, True)
            if x < 0.62 or k == 0:
                out.append(f"<p>{good}</p>" if self.r.random() < 0.8 else f"<p><b>{self.mark(self.prose(2, 60), True)}<br>")
            elif x < 0.68:
                h = self.r.choice(("h2", "h3", "h4"))
                out.append(f"<{h}>{self.mark(self.prose(1, 8), True)}</{h}>")
            elif x < 0.74:
                out.append("<ul>" + "".join(f"<li>{self.mark(self.prose(2, 20), True)}</li>" for _ in range(3)) + "</ul>")
            elif x < 0.78:
                out.append(f"<blockquote>{good}</blockquote>")
            elif x < 0.82:
                out.append(f"{good}<br>{self.mark(self.prose(5, 60), True)}<br><br>")
            elif x < 0.85:
                out.append(f"<div>{good}</div>")
            elif x < 0.88:
                out.append(f"<table><tr><td>{self.mark(self.prose(1, 5), True)}<td>{self.mark(self.prose(1, 5), True)}</table>")
            elif x < 0.90:
                out.append(f"<figure><img src=x><figcaption>{self.mark(self.prose(2, 15), True)}</figcaption></figure>")
            elif x < 0.95:
                out.append(self.boxed(_ADS))
            else:
                out.append(self.r.choice([self.menu, self.form, lambda: self.boxed(_SIDES)])())
        return "".join(out) + _close(t)

    def page(self) -> str:
        r = self.r
        self.plain = r.choice((0, 0, 0.3, 0.7))
        self.repeats = r.random() < 0.08
        self.shouts, self.noise = r.random() < 0.06, r.choice(("", "", "", "", "", "", "", "%%%", " |", "&amp;&amp;"))
        before = []
        for chance, part in ((0.5, lambda: self.boxed(_NOTICES)), (0.6, lambda: (t := r.choice(_HEADERS)) + r.choice([f"<h1>{self.prose(1, 4)}</h1>", f"<p>{self.furniture()}</p>", f"<a href=/>{self.prose(1, 3)}</a>"]) + r.choice(["", self.menu(), self.form()]) + _close(t)), (0.8, self.menu), (0.3, self.menu), (0.3, self.form), (0.4, lambda: self.boxed(_ADS)), (0.3, lambda: self.boxed(_SIDES))):
            if r.random() < chance:
                before.append(part())
        after = []
        for chance, part in ((0.3, self.menu), (0.4, lambda: self.boxed(_SIDES)), (0.45, self.comments), (0.25, self.form), (0.3, lambda: self.boxed(_ADS)), (0.2, lambda: self.boxed(_NOTICES))):
            if r.random() < chance:
                after.append(part())
        r.shuffle(after)
        if r.random() < 0.4:
            r.shuffle(before)
        if r.random() < 0.85:
            t = r.choice(_FOOTERS)
            after.append(t + r.choice([f"&copy; {self.word()}.example.com &middot; {self.prose(3, 25)}", f"<p>{self.furniture()}</p>", self.menu()]) + _close(t))
        body = "".join(before) + (self.story() if r.random() < 0.97 else "") + "".join(after)
        if r.random() < 0.3:
            t = r.choice(['<div class="wrapper">', '<div id="page"><div class="container">', "<center>", "<table><tr><td>"])
            body = t + body + _close(t)
        end = "" if r.random() < 0.1 else "</body></html>"
        return f"<!DOCTYPE html><html><head><title>{self.prose(2, 8)}</title><style>p{{margin:0}}</style></head><body>{body}{end}"


def generated(seed: int) -> tuple[list[Block], list[int]]:
    """The blocks of a generated page and their labels (1: article)."""
    found = blocks(_Writer(seed).page())
    labels = [int(_MARK in b.text) for b in found]
    return [Block(b.place, b.text.replace(_MARK, ""), b.links) for b in found], labels


@functools.cache
def trained(pages: int = PAGES, seed: int = 0) -> Labeller:
    """The labeller trained on generated pages; the same for the same arguments."""
    data = [x for x in (generated(seed * 1_000_003 + k) for k in range(pages)) if x[0]]
    model = Labeller.new(seed)
    model.train([b for b, _ in data], [y for _, y in data], seed=seed)
    return model
