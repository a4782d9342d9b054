"""Pages without article elements or telling class names, in ordinary words; not made by the generator that
trains the extractor."""

import random

WORDS = """river winter station market council bridge morning letter engine garden doctor village window captain harbour
weather teacher summer forest mountain island kitchen paper silver border minister hospital museum theatre captain road farmer
built opened closed reported carried followed crossed reached visited repaired painted measured collected travelled remained
slowly carefully often later early quietly nearly old new small large bright cold heavy public local northern""".split()
GLUE = "the a of in on at by with from and but while after before over under near".split()


def sentence(rng):
    n = rng.randint(5, 22)
    words = [rng.choice(GLUE) if rng.random() < 0.4 else rng.choice(WORDS) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def paragraph(rng):
    return " ".join(sentence(rng) for _ in range(rng.choice((1, 1, 2, 3, 5))))


def page(rng):
    """(html, blocks of the article in order, blocks of the furniture)."""
    title = " ".join(rng.choice(WORDS) for _ in range(rng.randint(2, 7))).capitalize()
    blocks = [title]
    menu = [rng.choice(WORDS).title() for _ in range(rng.randint(3, 8))]
    own = []
    cls = rng.choice(("", "", ' class="a1"', ' class="zz top9"', ' id="x3"'))
    for _ in range(rng.randint(3, 11)):
        r = rng.random()
        if r < 0.8:
            text = paragraph(rng)
            blocks.append(text)
            own.append(f"<p{cls}>{text}</p>" if rng.random() < 0.9 else f"<p>{text}")
        elif r < 0.9:
            text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(2, 5))).capitalize()
            blocks.append(text)
            own.append(f"<h2>{text}</h2>")
        else:
            items = [sentence(rng) for _ in range(rng.randint(2, 4))]
            blocks += items
            own.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
    links = [f'<a href="/{w.lower()}">{w}</a>' for w in menu]
    bar = rng.choice(("<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>", " | ".join(links), " ".join(links)))
    junk = [rng.choice((" ".join(menu), " | ".join(menu)))] if "<ul>" not in bar else list(menu)
    foot = rng.choice((f"© {rng.randint(1999, 2024)} The {rng.choice(WORDS).title()} Company", f"Copyright {rng.randint(1999, 2024)} {rng.choice(WORDS).title()} Press. All rights reserved.", f"The {rng.choice(WORDS).title()} Post, 12 {rng.choice(WORDS).title()} Street"))
    junk.append(foot)
    body = f"<h1>{title}</h1>{''.join(own)}"
    main = rng.choice((f"<div>{body}</div>", f"<div{cls}>{body}</div>", f"<div><div>{body}</div></div>", f"<table><tr><td>{body}</td></tr></table>"))
    out = f"<html><head><title>{title}</title></head><body><div>{bar}</div>{main}<div>{foot}</div></body></html>"
    return out, blocks, junk


def pages(n=240, seed=77):
    rng = random.Random(seed)
    return [page(rng) for _ in range(n)]
