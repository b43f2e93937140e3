"""Main text of web pages: a conditional random field over DOM leaf blocks.

The field is trained on labelled pages that ``labelled_pages`` composes: articles in
many layouts, among menus, notices, adverts, forms, comments and the like, with every
block's label known from where it was put. It then labels the blocks of real pages
by Viterbi decoding.
"""

from __future__ import annotations

import random
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import crf
from tessera.llm.common import portions
from tessera.llm.dom import block_features, leaf_blocks

TRAINING_PAGES = 500
_OPEN, _SHUT = "\x01", "\x02"  # around article text in composed pages


def _words(r: random.Random, n: int) -> str:
    parts = ["".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n)]
    parts[0] = parts[0].capitalize()
    return " ".join(parts)


def _sentences(r: random.Random, n: int) -> str:
    return " ".join(_words(r, r.randint(1, 22)) + r.choice(["."] * 8 + ["?", "!"]) for _ in range(n))


def _links(r: random.Random, n: int) -> str:
    item = lambda: f'<a href="/{r.randint(0, 99)}">{_words(r, r.randint(1, 3))}</a>'
    return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>" if r.random() < 0.7 else " ".join(item() for _ in range(n))


def _boilerplate(r: random.Random, place: str) -> str:
    """One piece that is no article text; place: top, inside, after or bottom."""
    say = lambda n: _sentences(r, n)
    named = lambda words: f'<{(t := r.choice(["div", "div", "section", "aside", "p"]))} {r.choice(["class", "class", "id"])}="{r.choice(words.split())}">{say(r.randint(1, 3))}</{t}>'
    menu = lambda: r.choice([f"<nav>{_links(r, r.randint(2, 9))}</nav>", f'<div class="{r.choice("menu nav navbar breadcrumb breadcrumbs navigation topbar".split())}">{_links(r, r.randint(2, 8))}</div>'])
    advert = lambda: named("ad ads advert advertisement sponsored promo banner ad-slot sponsor ad-box")
    notice = lambda: named("cookie-notice notice cookie-banner consent gdpr alert popup modal paywall newsletter subscribe")
    side = lambda: r.choice([f"<aside>{_links(r, 4)}<p>{say(1)}</p></aside>", f'<div class="{r.choice("sidebar widget related side-column rail recommended trending".split())}"><h3>{_words(r, 2)}</h3>{_links(r, 5)}<p>{say(1)}</p></div>'])
    form = lambda: f'<form action="/s"><label>{_words(r, 2)}</label><input name="q"><p>{say(1)}</p><button>{_words(r, 1)}</button></form>'
    comments = lambda: f'<{(t := r.choice(["section", "div", "ol"]))} {r.choice(["class", "id"])}="{r.choice("comments comment-list discussion replies responses reader-comments disqus".split())}"><h3>{_words(r, 2)}</h3>' + "".join(f'<{(u := r.choice(["div", "article", "li"]))} class="comment"><b>{_words(r, 1)}</b><p>{say(r.randint(1, 4))}</p></{u}>' for _ in range(r.randint(1, 5))) + f"</{t}>"
    social = lambda: f'<div class="{r.choice("share social share-buttons tags byline-links".split())}">{_links(r, 3)}</div>'
    header = lambda: r.choice([f"<header><div>{_words(r, 3)}</div>{_links(r, 4)}</header>", f"<header><h2>{_words(r, 3)}</h2><p>{say(1)}</p></header>", f'<div id="{r.choice("header masthead site-header".split())}">{_words(r, 3)}<p>{say(1)}</p></div>'])
    footer = lambda: r.choice([f"<footer>&copy; {_words(r, 2)} &middot; {say(r.randint(1, 3))}</footer>", f"<footer><p>{say(2)}</p>{_links(r, 3)}</footer>", f'<div class="{r.choice("footer site-footer copyright bottom".split())}">&copy; {say(1)}</div>'])
    kinds = {"top": [menu, menu, advert, advert, notice, header, form], "inside": [advert, advert, social, side, notice, form], "after": [side, comments, comments, social, advert, form], "bottom": [footer, footer, footer, notice, menu]}
    return r.choice(kinds[place])()


def _article(r: random.Random) -> str:
    mark = lambda text: _OPEN + text + _SHUT
    out = []
    if r.random() < 0.85:
        head = f"<h1>{mark(_words(r, r.randint(1, 12)))}</h1>"
        out.append(f"<header>{head}</header>" if r.random() < 0.06 else head)
    for _ in range(r.randint(1, 14)):
        kind = r.random()
        text = _sentences(r, r.choice([1, 1, 2, 3, 5, 8]))
        if kind < 0.62:
            out.append(f"<p>{mark(text)}</p>")
        elif kind < 0.70:
            out.append(f"<p><b>{mark(text)}<br>")
        elif kind < 0.76:
            out.append(f"<h{(h := r.randint(2, 4))}>{mark(_words(r, r.randint(1, 8)))}</h{h}>")
        elif kind < 0.82:
            out.append("<ul>" + "".join(f"<li>{mark(_words(r, r.randint(1, 9)))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.86:
            out.append(f"<blockquote>{mark(text)}</blockquote>")
        elif kind < 0.89:
            out.append("<table>" + "".join(f"<tr><td>{mark(_words(r, 1))}</td><td>{mark(_words(r, 2))}</td></tr>" for _ in range(3)) + "</table>")
        elif kind < 0.93:
            out.append(f"<p>{_OPEN}{_words(r, 5)} <a href='/x'>{_words(r, 2)}</a> {text}{_SHUT}</p>")
        elif kind < 0.95:
            out.append(f"<pre>{mark(_words(r, 6))}</pre>")
        elif kind < 0.97:
            out.append(f"<figure><img src='a.png'><figcaption>{mark(text)}</figcaption></figure>")
        elif r.random() < 0.6:
            out.append(_boilerplate(r, "inside"))
        else:
            out.append(f"<div>{mark(text)}</div>")
    return "".join(out)


def labelled_page(r: random.Random) -> tuple[list[list[str]], list[int]]:
    """Block features of one composed page, and for each block 1 if it is article text."""
    tag, attribute = r.choice([
        ("article", ""), ("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' class="article-body"'),
        ("div", ' id="main-content"'), ("div", ' class="entry-content"'), ("section", ' class="story"'), ("div", ' class="post-body text"'), ("div", ' itemprop="articleBody"'),
    ])
    some = lambda place, most: "".join(_boilerplate(r, place) for _ in range(r.randint(0, most)))
    article = f"<{tag}{attribute}>{_article(r)}" + (some("inside", 1) if r.random() < 0.2 else "") + f"</{tag}>"
    for wrapper in ("main", 'div class="wrapper"', 'div id="page"'):
        if r.random() < 0.15:
            article = f"<{wrapper}>{article}</{wrapper.split()[0]}>"
    page = f"<!DOCTYPE html><html><head><title>{_words(r, 5)}</title></head><body>{some('top', 4)}{article}{some('after', 2)}{some('bottom', 2)}</body></html>"
    blocks = leaf_blocks(page)
    labels = [int(_OPEN in b.text) for b in blocks]
    for b in blocks:
        b.text = " ".join(b.text.replace(_OPEN, "").replace(_SHUT, "").split()) or "x"
    return block_features(blocks), labels


@lru_cache(1)
def trained(pages: int = TRAINING_PAGES) -> crf.LinearChain:
    r = random.Random(17)
    return crf.train([labelled_page(r) for _ in range(pages)])


def known_words(model: crf.LinearChain) -> frozenset:
    """The tags and names that the model has weights for."""
    return frozenset(f.split(" ", 1)[1] for f in model.weights if f.startswith(("in ", "name ")))


def main_text(page: str, model: crf.LinearChain, known: frozenset | None = None) -> str:
    blocks = leaf_blocks(page, known_words(model) if known is None else known)
    labels = model.decode(block_features(blocks))
    return "\n\n".join(b.text for b, label in zip(blocks, labels) if label)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple = ("url",), model: crf.LinearChain | None = None) -> DataFrame:
    """(page_id, url, text): the main text of every row's whole html, blocks joined by an empty line.

    Null and empty pages, and pages without article text, give an empty text.
    Repeated rows and null ids are kept; an empty table gives an empty result; columns
    other than the id, the html and ``keep`` are dropped. White space is what
    str.split takes for it, no-break spaces included.
    """
    model = model or trained()
    known = known_words(model)

    def run(batches):
        for batch in batches:
            for part in portions(batch, batch.num_columns - 1, 4_000_000):
                texts = [main_text(t or "", model, known) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.record_batch([*part.columns[:-1], pa.array(texts, pa.string())], names=[*part.schema.names[:-1], "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), *keep, F.col(html_col).cast("string").alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, schema + ", text string")
