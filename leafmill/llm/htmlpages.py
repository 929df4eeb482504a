"""Generated web pages with labelled main text, to train the extraction model on."""

from __future__ import annotations

import random

SYLLABLES = "an be ci do el fa go hi in ju ka le mo ne or pa qui re so tu un ve wa xi yo za th sh on er é ñ ü".split()


def words(rng: random.Random, low: int, high: int) -> str:
    out = []
    for _ in range(rng.randint(low, high)):
        out.append("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))))
        if rng.random() < 0.12:
            out[-1] += rng.choice([".", ",", ".", " |", "***", "!!"])
    return " ".join(out).capitalize() + rng.choice([".", ".", ".", ""])


def some_class(rng: random.Random, names: str, chance: float = 0.85) -> str:
    if rng.random() > chance:
        return rng.choice(["", f' class="c{rng.randint(1, 99)}"', f' id="b{rng.randint(1, 9)}"'])
    name = rng.choice(names.split())
    return f' {rng.choice(["class", "class", "id"])}="{rng.choice(["", "", "site-", "page-", "js-", "w-"])}{name}{rng.choice(["", "", "-inner", "-wrap", " box"])}"'


def links(rng: random.Random, low: int = 3, high: int = 10) -> str:
    return "<ul>" + "".join(f'<li><a href="/{i}">{words(rng, 1, 3)}</a></li>' for i in range(rng.randint(low, high))) + "</ul>"


def inline(rng: random.Random, text: str) -> str:
    if rng.random() < 0.3 and " " in text:
        a, b = text.split(" ", 1)
        tag = rng.choice(["b", "i", "em", "strong", "a", "span"])
        return f"<{tag}>{a}</{tag}> {b}"
    return text


def paragraph(rng: random.Random, mark: str) -> str:
    text = mark + inline(rng, words(rng, *rng.choice([(1, 3), (4, 15), (15, 60), (40, 160)])))
    style = rng.random()
    return f"<p>{text}" if style < 0.1 else f"<p><b>{text}<br>" if style < 0.2 else f"<p>{text}</p>"


def main_part(rng: random.Random) -> str:
    m = "\x01"
    out = [f"<h1>{m}{words(rng, 2, 12)}</h1>"] if rng.random() < 0.9 else []
    for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 14, 25])):
        kind = rng.random()
        if kind < 0.8:
            out.append(paragraph(rng, m))
        elif kind < 0.86:
            out.append(f"<{(h := rng.choice(['h2', 'h3', 'h4']))}>{m}{words(rng, 1, 8)}</{h}>")
        elif kind < 0.9:
            out.append("<ul>" + "".join(f"<li>{m}{words(rng, 2, 20)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
        elif kind < 0.93:
            out.append(f"<blockquote><p>{m}{words(rng, 8, 50)}</p></blockquote>")
        elif kind < 0.95:
            out.append(f"<pre>{m}{words(rng, 4, 30)}</pre>")
        elif kind < 0.97:
            out.append("<table>" + "".join(f"<tr><td>{m}{words(rng, 1, 4)}</td><td>{m}{words(rng, 1, 4)}</td></tr>" for _ in range(rng.randint(2, 5))) + "</table>")
        else:
            out.append(rng.choice([advert, related, share, notice, newsletter])(rng))
    if len(out) < 1:
        out.append(f"<p>{m}{words(rng, 3, 30)}</p>")
    return "".join(out)


def advert(rng: random.Random) -> str:
    return f"<div{some_class(rng, 'ad ads advert promo sponsor banner adsense', 0.95)}>{rng.choice(['', '<p>'])}{words(rng, 1, 25)}</div>"


def related(rng: random.Random) -> str:
    return f"<{(t := rng.choice(['div', 'section', 'aside']))}{some_class(rng, 'related recommend more-stories widget')}><h3>{words(rng, 1, 3)}</h3>{links(rng, 2, 6)}</{t}>"


def share(rng: random.Random) -> str:
    return f"<div{some_class(rng, 'share social toolbar')}><a href='#'>{words(rng, 1, 2)}</a> <a href='#'>{words(rng, 1, 2)}</a></div>"


def notice(rng: random.Random) -> str:
    return f"<{(t := rng.choice(['div', 'div', 'section']))}{some_class(rng, 'cookie consent notice alert gdpr popup modal', 0.95)}><p>{words(rng, 4, 35)}</p>{rng.choice(['', '<button>' + words(rng, 1, 2) + '</button>'])}</{t}>"


def newsletter(rng: random.Random) -> str:
    return f"<form{some_class(rng, 'subscribe newsletter search login', 0.7)}><label>{words(rng, 2, 10)}</label><input name=q><p>{words(rng, 2, 15)}</p><button>{words(rng, 1, 1)}</button></form>"


def comments(rng: random.Random) -> str:
    item = rng.choice(["div", "li", "article"])
    body = "".join(f"<{item}{some_class(rng, 'comment reply')}><p>{words(rng, 3, 50)}</p></{item}>" for _ in range(rng.randint(1, 6)))
    return f"<{(t := rng.choice(['div', 'section', 'div']))}{some_class(rng, 'comments discussion respond replies', 1)}><h3>{words(rng, 1, 3)}</h3>{'<ol>' + body + '</ol>' if item == 'li' else body}</{t}>"


def navigation(rng: random.Random) -> str:
    t = rng.choice(["nav", "nav", "div", "header"])
    inner = links(rng) if rng.random() < 0.7 else " | ".join(f'<a href="/{i}">{words(rng, 1, 2)}</a>' for i in range(rng.randint(2, 8)))
    return f"<{t}{some_class(rng, 'nav menu navbar breadcrumb', 0.9 if t == 'div' else 0.3)}>{inner}</{t}>"


def header(rng: random.Random) -> str:
    t = rng.choice(["header", "header", "div"])
    return f"<{t}{some_class(rng, 'header masthead banner top', 0.95 if t == 'div' else 0.3)}><{(h := rng.choice(['h1', 'h2', 'p', 'div']))}>{words(rng, 1, 6)}</{h}>{rng.choice(['', '<p>' + words(rng, 2, 12) + '</p>'])}</{t}>"


def sidebar(rng: random.Random) -> str:
    t = rng.choice(["aside", "aside", "div"])
    return f"<{t}{some_class(rng, 'sidebar side widget', 0.95 if t == 'div' else 0.4)}><h3>{words(rng, 1, 3)}</h3>{rng.choice([links(rng, 2, 8), '<p>' + words(rng, 5, 40) + '</p>'])}</{t}>"


def footer(rng: random.Random) -> str:
    t = rng.choice(["footer", "footer", "div"])
    return f"<{t}{some_class(rng, 'footer foot copyright legal', 0.95 if t == 'div' else 0.2)}>{rng.choice(['&copy; ', '', '<p>'])}{words(rng, 2, 30)}</{t}>"


#: Elements and class names around the main text: those of the pages to train on, and others to test on.
WRAPS = (("article", "post entry story"), ("article", "post entry story"), ("main", "content main"), ("div", "content article post entry story text main-content"), ("section", "content article post"), ("div", "content"))
HELD_OUT_WRAPS = (("div", "story-body prose article-text"), ("article", "hentry item"), ("main", "wrapper page"), ("section", "body entry-content"))


def head(rng: random.Random) -> str:
    code = rng.choice(["a < b && c > d", "document.write('<p>x</p>')", "f({k: 1})", "s = \"</div>\""])
    parts = [f"<title>{words(rng, 2, 8)}</title>", "<meta charset=utf-8>", "<link rel=stylesheet href=/s.css>", f"<style>.c{rng.randint(1, 9)} > li {{margin: 0}}</style>", f"<script>{code}</script>"]
    return "".join(x for x in parts if rng.random() < 0.7)


def page(rng: random.Random, held_out: bool = False) -> str:
    """A page; the runs of its main text start with U+0001.  ``held_out`` pages have layouts that the others lack."""
    wrap, names = rng.choice(HELD_OUT_WRAPS if held_out else WRAPS)
    title = "" if wrap == "div" and rng.random() < 0.1 else some_class(rng, names, 1 if wrap == "div" else 0.3 if rng.random() < 0.6 else 0)
    body = f"<{wrap}{title}>{main_part(rng)}{comments(rng) if rng.random() < 0.1 else ''}</{wrap}>"
    if held_out and rng.random() < 0.5:  # deeper, with a list of links beside and between
        body = f"<div><div><div>{navigation(rng)}</div>{body}</div><div>{related(rng)}{share(rng)}</div></div>"
    elif rng.random() < 0.25:
        body = f"<div{some_class(rng, 'container row wrapper page layout')}>{body}{sidebar(rng) if rng.random() < 0.6 else ''}</div>"
    if rng.random() < 0.1:
        body = f"<table><tr><td>{links(rng)}</td><td>{body}</td></tr></table>"
    before = [f for f in (header, navigation, notice, advert, newsletter, sidebar) if rng.random() < 0.45]
    if rng.random() < 0.3:
        rng.shuffle(before)
    after = [f for f in (comments, related, advert, sidebar, newsletter, notice, share, footer) if rng.random() < 0.4]
    remark = f"<!-- {words(rng, 1, 4)} -->" if rng.random() < 0.3 else ""
    tail = "</body></html>" if rng.random() < 0.9 else ""
    return f"<!DOCTYPE html><html><head>{head(rng)}</head><body>{''.join(f(rng) for f in before)}{remark}{body}{''.join(f(rng) for f in after)}{tail}"
