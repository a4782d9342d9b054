"""Generated pages whose main text is known, from which the extractor (operator 9) learns.

Two families: pages with telling tags and names (generated_page), and pages that vary in words, markup
habits and names, many of them without any name that tells (varied_page).
"""

from __future__ import annotations

import random

#: Attribute tokens by kind.
KINDS = (
    frozenset("article articlebody content main post entry story text body page prose document".split()),
    frozenset("nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs topbar".split()),
    frozenset("header masthead head logo branding site title".split()),
    frozenset("footer foot copyright legal colophon bottom".split()),
    frozenset("sidebar side aside rail widget widgets secondary complementary".split()),
    frozenset("ad ads advert adverts advertisement sponsor sponsored promo promoted banner banners adslot".split()),
    frozenset("cookie cookies consent notice notices gdpr alert popup modal overlay privacy warning".split()),
    frozenset("comment comments reply replies discussion respond disqus feedback commentlist reader".split()),
    frozenset("form search login signup subscribe newsletter register contact".split()),
    frozenset("share social related recommended recommendations tags meta author byline trending popular".split()),
)


_SYLLABLES = "er on the an re ou ti st en ie la de ch ó é ment ing ge ba ko lu mi sa tor vel un ar qui no pra sche ß ñe ção ri fo gra ul ed ly ter com pa que ita wo da ka shi mo ne to ты ра ни ко сто ве на по".split()
_PLAIN = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years where much your way down should because long each just state those people too mr how little good world make very year still see own work men day get here old life both between being under three never know same last another while us might great go come since against right came take used himself few house use place during high without again home around small however found part school every".split()
_MARKS = ("!!", " |", "%%%", "###", "***", "&amp;", "$")
#: Words of furniture that articles use as well.
_SIGNS = ("All rights reserved.", "Copyright 2020 by the author.", "Subscribe to the paper.", "Comments were read aloud.", "Cookies are small files.", "Sponsored by the city.")
_MENU = "Home News Sport Business Culture Travel Weather Shop About Contact Help Archive Blog Login Search Topics Video Podcasts Jobs Events".split()


class _Style:
    """What the elements of one page have in common: words, markup habits, names of classes."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.syllables = rng.sample(_SYLLABLES, rng.randint(6, 20))
        self.plain = rng.random() < 0.4
        self.noise = rng.choice((0, 0, 0, 0.1, 0.4))
        self.semantic = rng.choice((0, 0, 0.5, 1))  # chance of nav, header, footer, aside, article
        self.named = rng.choice((0, 0, 0.3, 0.7, 1))  # chance of a telling class or id
        self.odd = rng.choice((0, 0.3, 1))  # chance of a class that tells nothing
        self.short = rng.random() < 0.25  # short paragraphs
        self.links = rng.choice((0, 0, 0.1, 0.4))  # chance of links in a paragraph

    def word(self) -> str:
        rng = self.rng
        w = rng.choice(_PLAIN) if self.plain else "".join(rng.choice(self.syllables) for _ in range(rng.randint(1, 4)))
        return w + rng.choice(_MARKS) if self.noise and rng.random() < self.noise else w

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def prose(self, low: int, high: int) -> str:
        rng, left, out = self.rng, self.rng.randint(low, high), []
        while left > 0:
            k = min(left, rng.randint(3, 25))
            own = [self.word() for _ in range(k)]
            if k > 6 and rng.random() < 0.6:
                own[rng.randrange(2, k - 2)] += ","
            out.append(" ".join(own).capitalize() + rng.choice((".", ".", ".", ".", "?", "")))
            left -= k
        return " ".join(out)

    def attrs(self, kind: int | None) -> str:
        rng = self.rng
        if kind is not None and rng.random() < self.named:
            token = rng.choice(sorted(KINDS[kind]))
            return rng.choice((f' class="{token}"', f' id="{token}"', f' class="{token} x{rng.randint(0, 9)}"', f' class="site-{token}"', f' class="{token}-box wide"', f" role='{token}'"))
        if rng.random() < self.odd:
            return rng.choice((f' class="c{rng.randint(0, 999)}"', f' id="q{rng.randint(0, 99)}"', ' class="row"', ' class="col-8 mt-2"', f' class="css-{rng.getrandbits(24):x}"', ' style="margin:0"', ' class="inner"', ' class="box"'))
        return ""

    def tag(self, name: str, inner: str, kind: int | None = None) -> str:
        return f"<{name}{self.attrs(kind)}>{inner}</{name}>"

    def wrap(self, semantic: str, kind: int, inner: str) -> str:
        name = semantic if self.rng.random() < self.semantic else self.rng.choice(("div", "div", "div", "section", "table"))
        if name == "table":
            return self.tag("table", f"<tr><td>{inner}</td></tr>", kind)
        out = self.tag(name, inner, kind)
        return self.tag("div", out) if self.rng.random() < 0.2 else out


def _paragraph(s: _Style, text: str) -> str:
    rng = s.rng
    if rng.random() < s.links:
        words = text.split(" ")
        at = rng.randrange(len(words))
        words[at] = f'<a href="/{rng.randint(0, 99)}">{words[at]}</a>'
        text = " ".join(words)
    if rng.random() < 0.1:
        text = f"<b>{text}</b>"
    return text


def _story(s: _Style) -> str:
    rng = s.rng
    lengths = ((1, 4), (3, 15), (8, 30), (8, 30)) if s.short else ((1, 4), (3, 30), (20, 90), (20, 90), (60, 200))
    first = s.prose(*rng.choice(lengths[rng.random() < 0.85 :]))  # rarely a story of a few words only
    text = lambda: _paragraph(s, s.prose(*rng.choice(lengths)))
    head = f"<h1{s.attrs(None)}>{s.words(1, 12).capitalize()}</h1>" if rng.random() < 0.85 else rng.choice(("", f"<h2>{s.words(2, 9)}</h2>"))
    if head and rng.random() < 0.15:
        head = s.tag(rng.choice(("div", "header", "div")), head + (s.tag("p", text()) if rng.random() < 0.3 else ""))
    form = rng.choice(("p", "p", "p", "p", "p", "open", "div", "br", "bold"))
    out = []
    for _ in range(rng.choice((1, 1, 2, 3, 4, 5, 6, 8, 12, 20))):
        r = rng.random()
        if r < 0.78 or not out:
            own = _paragraph(s, first) if not out else text() if rng.random() > 0.04 else rng.choice((rng.choice(_SIGNS), f"{text()} {rng.choice(_SIGNS)}"))
            out.append({"p": s.tag("p", own), "open": f"<p>{own}", "div": s.tag("div", own), "br": f"{own}<br><br>", "bold": rng.choice((f"<p><b>{own}<br>", f"<p>{own}</p>"))}[form])
        elif r < 0.86:
            out.append(f"<{(t := rng.choice(('h2', 'h3')))}>{s.words(1, 8)}</{t}>")
        elif r < 0.91:
            items = "".join(f"<li>{rng.choice((text(), s.words(1, 8)))}</li>" for _ in range(rng.randint(1, 6)))
            out.append(f"<{(t := rng.choice(('ul', 'ol')))}>{items}</{t}>")
        elif r < 0.94:
            out.append(f"<table>{''.join(f'<tr><td>{s.words(1, 4)}</td><td>{s.words(1, 4)}</td></tr>' for _ in range(rng.randint(1, 6)))}</table>")
        elif r < 0.97:
            out.append(rng.choice((f"<blockquote><p>{text()}</p></blockquote>", f"<blockquote>{text()}</blockquote>", f"<pre>{text()}</pre>")))
        else:
            out.append(f"<figure><img src='/i.png'><figcaption>{s.words(2, 12)}</figcaption></figure>")
    if len(out) > 3 and rng.random() < 0.25:  # in sections
        k = rng.randrange(1, len(out))
        name = rng.choice(("div", "section"))
        return head + s.tag(name, "".join(out[:k])) + s.tag(name, "".join(out[k:]))
    body = "".join(out)
    return head + (s.tag("div", body, 0) if rng.random() < 0.2 else body)


def _menu(s: _Style, low: int = 2, high: int = 9) -> str:
    rng = s.rng
    names = [rng.choice(_MENU) if rng.random() < 0.3 else s.words(1, 3) for _ in range(rng.randint(low, high))]
    links = [f'<a href="/{k}">{w}</a>' for k, w in enumerate(names)]
    return rng.choice((
        "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>", rng.choice((" | ", " ", " &middot; ", "")).join(links), "".join(s.tag("div", x) for x in links), "".join(f"<p>{x}</p>" for x in links),
        "<table><tr>" + "".join(f"<td>{x}</td>" for x in links) + "</tr></table>",
    ))


def _surrounding(s: _Style, where: str) -> str:
    """A piece of page furniture; `where` is before, after or inside the main text."""
    rng = s.rng
    line = lambda low=2, high=14: s.prose(low, high)
    text = lambda: s.prose(*rng.choice(((2, 8), (5, 30), (5, 30), (20, 80))))
    r = rng.random()
    if where == "before" and r < 0.45 or where == "after" and r < 0.1:
        return s.wrap("nav", 1, _menu(s))
    if where == "before" and r < 0.65:
        name = rng.choice((s.words(1, 3), "example.com", s.words(1, 2).title()))
        inner = rng.choice((f"<a href='/'>{name}</a>", f"<p>{name}</p><p>{s.words(2, 6)}</p>", f"{name}{_menu(s)}", f"<h2>{name}</h2>", f"<div>{name}</div>"))
        return s.wrap("header", 2, inner)
    if where == "after" and r < 0.55:
        sign = rng.choice(("&copy; ", "&copy; 2024 ", "Copyright 2023 ", "", ""))
        inner = rng.choice((f"{sign}{line()}", f"<p>{sign}{line()}</p>", f"{sign}example.com &middot; {line()}", f"{_menu(s, 2, 5)}<p>{sign}{line()}</p>", f"{sign}{s.words(1, 3)}. All rights reserved.", f"<div>{sign}{line()}</div><div>{_menu(s, 2, 5)}</div>"))
        return s.wrap("footer", 3, inner)
    kind = rng.choice((4, 4, 5, 5, 6, 7, 7, 8, 9, 9))
    few = lambda make: "".join(make() for _ in range(rng.randint(1, 6)))
    if kind == 4:
        return s.wrap("aside", 4, f"<h3>{s.words(1, 4)}</h3>" + rng.choice((_menu(s), f"{_menu(s)}<p>{text()}</p>", f"<p>{line()}</p>{_menu(s, 1, 3)}")) if s.semantic < 0.5 and not s.named else f"<h3>{s.words(1, 4)}</h3>{rng.choice((_menu(s), ''))}<p>{text()}</p>")
    if kind == 5:
        inner = rng.choice(("Advertisement", f"Sponsored: <a href='/b'>{line()}</a>", f"<a href='/b'>{line()}</a>", text(), f"<p>{text()}</p>", line()))
        return s.wrap("aside" if rng.random() < 0.3 else "div", 5, inner)
    if kind == 6:
        return s.wrap("div", 6, rng.choice((f"<p>{text()}</p><button>OK</button>", f"We use cookies. {line()}", f"This site uses cookies. {text()} <a href='/p'>{s.words(1, 2)}</a>", f"<p>{line()}</p><a href='/ok'>OK</a>", text())))
    if kind == 7:
        one = lambda: s.tag(rng.choice(("div", "li", "article")), rng.choice((f"<p>{text()}</p>", f"<b>{s.words(1, 2)}</b> <span>{rng.randint(1, 28)} May 2021</span><p>{text()}</p><a href='/r'>Reply</a>", f"<div>{s.words(1, 2)} wrote:</div><div>{text()}</div>")), 7)
        return s.wrap("section", 7, rng.choice((f"<h2>Comments</h2>{few(one)}", f"<h3>{rng.randint(2, 40)} comments</h3>{few(one)}", f"<h3>{s.words(1, 3)}</h3>{few(one)}") if s.named < 0.5 else (f"<h2>{s.words(1, 3)}</h2>{few(one)}", few(one))))
    if kind == 8:
        form = f'<form action="/s"{s.attrs(8)}><label>{s.words(1, 3)}</label><input name="q"><p>{line()}</p><button>Go</button><select><option>{s.word()}<option>{s.word()}</select></form>'
        return rng.choice((form, s.wrap("div", 8, form)))
    return s.wrap("div", 9, rng.choice((f"<h3>Related</h3>{_menu(s, 3, 8)}", f"<h4>{s.words(1, 4)}</h4>{_menu(s, 3, 8)}", _menu(s, 3, 6))))


def varied_page(rng: random.Random) -> tuple[str, str, str]:
    """What stands before the main text, the main text (furniture in it between \\x00 and \\x01), and what
    stands after it."""
    s = _Style(rng)
    inner = _story(s)
    if rng.random() < 0.25:  # furniture inside the main text, at its end; only its names tell it apart
        habit, s.named = s.named, 1
        inner += "\x00" + _surrounding(s, "inside") + "\x01"
        s.named = habit
    r = rng.random()
    if r < s.semantic:
        main = rng.choice((f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", s.tag("article", inner, 0)))
    elif rng.random() < 0.1:
        main = inner  # the body's own
    else:
        main = rng.choice((s.tag("div", inner, 0), s.tag("section", inner, 0), f"<div>{s.tag('div', inner, 0)}</div>", f"<div><div>{inner}</div></div>", s.tag("table", f"<tr><td>{inner}</td></tr>", 0), s.tag("div", inner)))
    before = "".join(_surrounding(s, "before") for _ in range(rng.randint(0, 4)))
    after = "".join(_surrounding(s, "after") for _ in range(rng.randint(0, 4)))
    if rng.random() < 0.3:
        before, after = f"{before}<div{s.attrs(None)}>", f"{after}</div>"
    elif rng.random() < 0.15:  # columns of a layout table
        before, after = f"<table><tr><td>{before or _menu(s)}</td><td>", f"</td></tr></table>{after}"
    return before, main, after


# --- pages with telling names ---


def _words(rng: random.Random, low: int, high: int) -> str:
    parts = ("er", "on", "the", "an", "re", "ou", "ti", "st", "en", "ie", "la", "de", "ch", "ó", "é", "ment", "ing", "ge")
    out = []
    for _ in range(rng.randint(low, high)):
        w = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
        out.append(rng.choice((w, w, w, w, w, w + ",", w + ".", w.upper() + "!!", w + " |", w + "%%%")) if rng.random() < 0.5 else w)
    return " ".join(out)


def _tagged(rng: random.Random, kind: int, tag: str, inner: str) -> str:
    token = rng.choice(sorted(KINDS[kind]))
    attr = rng.choice((f' class="{token}"', f' id="{token}"', f' class="{token} x{rng.randint(0, 9)}"', f' class="site-{token}"', f' class="{token}-box wide"'))
    return f"<{tag}{attr}>{inner}</{tag}>"


def _main(rng: random.Random) -> str:
    out = [f"<h1>{_words(rng, 1, 12)}</h1>"] if rng.random() < 0.8 else []
    for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 20))):
        r, text = rng.random(), _words(rng, *rng.choice(((1, 3), (3, 30), (20, 120), (100, 400))))
        if r < 0.7:
            out.append(rng.choice((f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text}", f"<p><a href='/x'>{_words(rng, 1, 3)}</a> {text}</p>")))
        elif r < 0.78:
            out.append(f"<h2>{_words(rng, 1, 8)}</h2>")
        elif r < 0.84:
            out.append(f"<ul>{''.join(f'<li>{_words(rng, 1, 20)}</li>' for _ in range(rng.randint(1, 6)))}</ul>")
        elif r < 0.88:
            out.append(f"<table>{''.join(f'<tr><td>{_words(rng, 1, 4)}</td><td>{_words(rng, 1, 4)}</td></tr>' for _ in range(rng.randint(1, 6)))}</table>")
        elif r < 0.92:
            out.append(f"<blockquote><p>{text}</p></blockquote>")
        elif r < 0.95:
            out.append(f"<pre>{text}</pre>")
        else:
            out.append(f"<div>{text}</div>")
    return "".join(out)


def _furniture(rng: random.Random) -> str:
    links = lambda: "<ul>" + "".join(f'<li><a href="/{k}">{_words(rng, 1, 3)}</a></li>' for k in range(rng.randint(2, 9))) + "</ul>"
    text = lambda: _words(rng, *rng.choice(((2, 8), (5, 30), (20, 120))))
    form = f'<form action="/s"><label>{_words(rng, 1, 3)}</label><input name="q"><p>{_words(rng, 1, 20)}</p></form>'
    comments = "".join(_tagged(rng, 7, rng.choice(("div", "li", "article")), f"<p>{text()}</p>") for _ in range(rng.randint(1, 6)))
    return rng.choice((
        f"<nav>{links()}</nav>", _tagged(rng, 1, "div", links()), f"<header><p>{_words(rng, 1, 8)}</p>{links()}</header>", _tagged(rng, 2, rng.choice(("div", "header")), f"<p>{_words(rng, 1, 10)}</p>"),
        f"<footer>{rng.choice(('', '&copy; '))}{text()}</footer>", _tagged(rng, 3, rng.choice(("div", "footer")), f"<p>{text()}</p>"), f"<aside><h3>{_words(rng, 1, 4)}</h3><p>{text()}</p></aside>",
        _tagged(rng, 4, rng.choice(("div", "aside", "section")), f"<h3>{_words(rng, 1, 4)}</h3>{links()}<p>{text()}</p>"), _tagged(rng, 5, "div", text()), _tagged(rng, 5, rng.choice(("div", "aside", "section")), f"<p>{text()}</p>"),
        _tagged(rng, 6, "div", f"<p>{text()}</p>"), _tagged(rng, 6, "div", text()), f'<section id="comments"><h2>{_words(rng, 1, 3)}</h2>{comments}</section>', _tagged(rng, 7, "div", comments),
        form, _tagged(rng, 8, "div", form), _tagged(rng, 9, "div", links()),
    ))


def generated_page(rng: random.Random) -> tuple[str, str, str]:
    """What stands before the main text, the main text (furniture in it between \\x00 and \\x01), and what
    stands after it."""
    inner = _main(rng)
    if rng.random() < 0.3:  # furniture inside the article, at its end
        inner += "\x00" + _furniture(rng) + "\x01"
    main = rng.choice((
        f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", _tagged(rng, 0, "div", inner),
        _tagged(rng, 0, "section", inner), f"<div>{_tagged(rng, 0, 'div', inner)}</div>", f"<div><div>{inner}</div></div>",
    ))
    before = "".join(_furniture(rng) for _ in range(rng.randint(0, 4)))
    after = "".join(_furniture(rng) for _ in range(rng.randint(0, 4)))
    if rng.random() < 0.3:
        before, after = f"{before}<div id='wrap'>", f"{after}</div>"
    return before, main, after
