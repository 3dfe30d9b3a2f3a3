"""Labelled training pages for the extraction model, written from a small grammar of layouts.

Every element that decides a label carries ``MARK`` = 1 (main text) or 0; a block takes the
label of its nearest marked ancestor. Layouts differ in the elements and class names that
hold the article and the furniture around and inside it (menus, headers, notices,
sidebars, adverts, forms, reader comments, footers).
"""

from __future__ import annotations

import random

MARK = "data-main"

MENUS = ['<nav{}>{}</nav>', '<div class="menu"{}>{}</div>', '<ul id="navigation"{}>{}</ul>', '<div class="nav navbar"{}>{}</div>',
         '<nav class="breadcrumb breadcrumbs"{}>{}</nav>', '<div role="navigation"{}>{}</div>']
HEADERS = ['<header{}>{}</header>', '<div id="header"{}>{}</div>', '<div class="site-header masthead"{}>{}</div>',
           '<div class="banner top"{}>{}</div>', '<div class="topbar"{}>{}</div>']
FOOTERS = ['<footer{}>{}</footer>', '<div id="footer"{}>{}</div>', '<div class="site-footer legal"{}>{}</div>', '<div class="copyright"{}>{}</div>']
SIDEBARS = ['<aside{}>{}</aside>', '<div class="sidebar"{}>{}</div>', '<div id="related" class="widget"{}>{}</div>',
            '<section class="recommended more"{}>{}</section>', '<div class="share social"{}>{}</div>', '<div class="tags author meta"{}>{}</div>']
ADVERTS = ['<div class="ad"{}>{}</div>', '<div class="ads advert"{}>{}</div>', '<div id="advertisement"{}>{}</div>',
           '<div class="sponsored promo"{}>{}</div>', '<ins class="adsbygoogle ad"{}>{}</ins>', '<div class="banner-ad"{}>{}</div>']
NOTICES = ['<div class="cookie notice"{}>{}</div>', '<div id="cookie-banner" class="consent"{}>{}</div>', '<div role="alert"{}>{}</div>',
           '<div class="notice popup"{}>{}</div>', '<div class="gdpr modal"{}>{}</div>', '<div class="alert message"{}>{}</div>',
           '<dialog{}>{}</dialog>', '<div class="newsletter subscribe"{}>{}</div>', '<div class="paywall"{}>{}</div>']
FORMS = ['<form{}>{}<label>Name</label><input><button>Send</button></form>', '<form class="search"{}>{}<button>Go</button></form>',
         '<form class="signup"{}>{}<select><option>One</option><option>Two</option></select><textarea></textarea></form>']
COMMENTS = ['<section class="comments"{}>{}</section>', '<div id="comments" class="discussion"{}>{}</div>',
            '<ol class="comment-list"{}>{}</ol>', '<div class="replies responses"{}>{}</div>', '<div class="comment reader"{}>{}</div>']
ARTICLES = ['<article{}>{}</article>', '<main{}>{}</main>', '<div class="content"{}>{}</div>', '<div class="post entry-content"{}>{}</div>',
            '<main><article{}>{}</article></main>', '<div id="main"><div class="article body"{}>{}</div></div>',
            '<div role="main"{}>{}</div>', '<section class="story text"{}>{}</section>', '<div{}>{}</div>']

SYLLABLES = "ka lo mi ren tas vo del shi nor pa gu sen ti ber fal ost ein que ja mon".split()


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 3)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        return self.words(1, 14).capitalize() + self.r.choices([".", "!", "?", ""], [20, 1, 1, 2])[0]

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def links(self) -> str:
        form = self.r.choice(['<li><a href="#">{}</a></li>', '<a href="#">{}</a> ', '<p><a href="#">{}</a></p>'])
        body = "".join(form.format(self.words(1, 3)) for _ in range(self.r.randint(2, 8)))
        return f"<ul>{body}</ul>" if form.startswith("<li>") else body

    def of(self, frames: list[str], inner: str, label: int) -> str:
        return self.r.choice(frames).format(f' {MARK}="{label}"', inner)

    def aside(self) -> str:
        """One piece of furniture."""
        r = self.r
        p = f"<p>{self.prose(1, 5) if r.random() < 0.9 else self.words(1, 60)}</p>"
        kind = r.randrange(7)
        if kind == 0:
            return self.of(SIDEBARS, r.choice([f"<h3>{self.words(1, 3)}</h3>", ""]) + r.choice([self.links(), p]), 0)
        if kind == 1:
            return self.of(FORMS, r.choice([p, ""]), 0)
        if kind == 2:
            return self.of(NOTICES, r.choice([p, self.prose(1, 3)]) + r.choice(["<button>OK</button>", ""]), 0)
        if kind == 3:
            body = "".join(f"<{t}><b>{self.word()}</b> {self.prose(1, 3)}</{t}>" for t in r.choices(["li", "p", "div"], k=r.randint(1, 4)))
            return self.of(COMMENTS, r.choice([f"<h2>{self.words(1, 3)}</h2>", ""]) + body, 0)
        return self.of(ADVERTS, r.choice([p, self.prose(1, 2), self.sentence()]), 0)

    def part(self) -> str:
        """One piece of the article."""
        r = self.r
        kind = r.randrange(14)
        if kind == 0:
            return f"<h{(n := r.randint(2, 4))}>{self.words(1, 6)}</h{n}>"
        if kind == 1:
            return "<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind == 2:
            return f"<blockquote><p>{self.prose(1, 2)}</p></blockquote>"
        if kind == 3:
            return "<table>" + "".join(f"<tr><td>{self.word()}</td><td>{r.randint(1, 999)}</td></tr>" for _ in range(3)) + "</table>"
        if kind == 4:
            return f"<pre><code>{self.words(2, 8)}</code></pre>"
        if kind == 5:
            return f"<figure><img><figcaption>{self.sentence()}</figcaption></figure>"
        if kind == 6:
            return f'<p>{self.prose(0, 2)} <a href="#">{self.words(1, 4)}</a> {self.prose(0, 2)}</p>'
        prose = self.words(1, 150) if kind == 7 else self.prose(1, 6)           # also text without any marks
        return r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>", "<div>{}</div>"]).format(prose)

    def page(self) -> str:
        r = self.r
        title = self.words(2, 8)
        inner = r.choices([f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", f"<h2>{title}</h2>", ""], [6, 1, 1, 1])[0]
        for _ in range(r.choice([1, 1, 2, 3, 5, 8])):
            inner += self.part() + (self.aside() if r.random() < 0.08 else "")
        if r.random() < 0.2:                                          # nothing but the article
            return f'<!DOCTYPE html><html><body>{self.of(ARTICLES[:-1], inner, 1)}</body></html>'
        out = [self.of(MENUS, self.links(), 0)] if r.random() < 0.8 else []
        if r.random() < 0.4:
            out.insert(r.randrange(len(out) + 1), self.of(HEADERS, r.choice([f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.words(2, 6)}</p>", self.links()]), 0))
        out += [self.aside() for _ in range(r.choice([0, 1, 1, 2]))]
        out.append(self.of(ARTICLES, inner, 1))
        out += [self.aside() for _ in range(r.choice([0, 0, 1, 2]))]
        if r.random() < 0.7:
            foot = r.choice([f"&copy; {self.word()}.example.com {r.randint(1990, 2030)}", f"<p>&copy; {self.words(1, 3)}</p>{self.links()}", self.words(2, 6)])
            out.append(self.of(FOOTERS, foot, 0))
        return f'<!DOCTYPE html><html><head><title>{title}</title></head><body {MARK}="0">{"".join(out)}</body></html>'


def labelled_pages(count: int, first: int = 0) -> list[str]:
    """``count`` pages, the same ones for the same ``first``."""
    return [Writer(seed).page() for seed in range(first, first + count)]
