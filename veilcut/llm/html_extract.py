"""Main text of web pages: a linear-chain CRF over DOM leaf blocks.

A page is cut into leaf blocks (text between borders of block elements).  Every block has features of its
ancestors (tags, words of their class, id and role) and of its text (length, links, marks, positions); a CRF
with the labels content and other, trained on labelled pages, scores the sequence and Viterbi decodes it.
Content blocks are joined by a newline.

Training pages are made by `labelled_pages` (templates with menus, notices, adverts, forms, comments and so on in
varying mark-up), PAGES of them, with a fixed seed: the sample is bounded by that parameter and fitting takes a
few seconds on the driver; the model (some hundred numbers) travels with the tasks.  Pages are scored where
they lie: no shuffle, no state between pages, whole pages whatever their length.

Defined cases: null or empty html gives an empty text; a null id or url stays; repeated rows each come out; other
columns are ignored; cut-off tags and comments at the end are mark-up.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal
from .crf import Chain, train
from .dom import Block, blocks

PAGES = 400
SEED = 7

#: Words of class, id and role that are features of their own.
MARKS = frozenset(
    "ad ads advert advertisement alert article aside author banner body breadcrumb breadcrumbs byline caption comment comments complementary consent "
    "content contentinfo cookie copyright credit date dialog discussion disqus entry footer form gdpr header hero login main masthead menu meta modal nav navbar "
    "navigation newsletter notice notification outbrain page pager pagination popup post privacy promo promotion rail recommended related reply respond "
    "responses search share sharing sidebar signup site skip social sponsor sponsored story subscribe tags teaser text toolbar topbar trending widget wrapper".split()
)
_WORD = re.compile(r"[a-z]+")
_SAYS = re.compile(r"(?i)(©|copyright|all rights reserved|cookies?\b|privacy|terms of|subscribe|newsletter|sign up|log ?in|share (?:this|on)|advertis|sponsored|related|read more|comments?\b|repl(?:y|ies)\b|posted by)")


@lru_cache(maxsize=20_000)
def path_features(path: tuple) -> tuple[str, ...]:
    out = []
    tags = [t for t, _ in path]
    for t in dict.fromkeys(tags):
        if t not in ("html", "body"):
            out.append(f"in:{t}")
    out.append(f"tag:{tags[-1] if tags else ''}")
    words = {w for _, marks in path for w in _WORD.findall(marks)} & MARKS
    out += [f"mark:{w}" for w in sorted(words)]
    if path and path[-1][1]:
        out += [f"own:{w}" for w in sorted(set(_WORD.findall(path[-1][1])) & MARKS)]
    return tuple(out)


def text_features(b: Block, place: float) -> list[str]:
    text = b.text
    n = text.count(" ") + 1
    share = b.links / max(1, len(text))
    out = [
        f"words:{0 if n <= 2 else 1 if n <= 5 else 2 if n <= 12 else 3 if n <= 25 else 4 if n <= 60 else 5}",
        f"links:{0 if share == 0 else 1 if share < 0.34 else 2 if share < 0.67 else 3}",
        f"place:{int(place * 4.999)}",
    ]
    if text[-1] in ".!?…:;\"”":
        out.append("ends")
    if n <= 40:  # what notices say; longer blocks are judged by their other features
        out += [f"says:{x.lower().split()[0]}" for x in dict.fromkeys(_SAYS.findall(text))]
    if " | " in text or " · " in text:
        out.append("bars")
    return out


def features(page: list[Block]) -> list[list[str]]:
    tags = {t for b in page for t, _ in b.path}
    root = "article" if "article" in tags else "main" if "main" in tags else None
    out = []
    for i, b in enumerate(page):
        own = [*path_features(b.path), *text_features(b, i / len(page))]
        if root:
            own.append(f"root:{'in' if any(t == root for t, _ in b.path) else 'out'}")
        if i and page[i - 1].path[:-1] == b.path[:-1]:
            own.append("sibling")
        out.append(own)
    return out


def _labelled_page(rng: random.Random) -> str:
    """A page in which content blocks start with the character U+E000."""
    pool = ["".join(rng.choice(("th", "er", "on", "an", "re", "in", "es", "la", "de", "que", "ung", "ción", "ou", "st", "en", "ti")) for _ in range(rng.randint(1, 4))) for _ in range(60)]

    def say(a: int, b: int, end: bool = True) -> str:
        w = [rng.choice(pool) for _ in range(rng.randint(a, b))]
        return " ".join(w).capitalize() + ("." if end and rng.random() < 0.9 else "")

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{say(1, 3, False)}</a></li>' for k in range(n))

    def tag(name: str, marks: list[str], inner: str) -> str:
        mark = rng.choice(marks) if marks else ""
        return f"<{name}{f' {rng.choice(("class", "class", "id"))}="{mark}"' if mark else ''}>{inner}</{name}>"

    box = lambda: rng.choice(("div", "section", "aside"))
    head = rng.choice(
        (
            lambda: tag("nav", ["", "menu", "navbar"], f"<ul>{links(rng.randint(3, 8))}</ul>"),
            lambda: tag("header", ["", "site-header", "masthead"], f"<div>{say(1, 4, False)}</div>" + tag("nav", [""], f"<ul>{links(5)}</ul>")),
            lambda: tag("div", ["header", "topbar", "navigation"], f"<p>{say(2, 6)}</p><ul>{links(4)}</ul>"),
        )
    )
    side = [
        lambda: tag(box(), ["ad", "ads", "advert", "sponsored", "promo banner", "advertisement"], rng.choice((f"{say(4, 25)}", f"<p>{say(5, 30)}</p>"))),
        lambda: tag("aside", ["", "sidebar", "related", "widget"], f"<h3>{say(1, 3, False)}</h3><ul>{links(rng.randint(2, 6))}</ul><p>{say(5, 30)}</p>"),
        lambda: tag("div", ["sidebar", "rail", "widget", "trending", "recommended"], f"<h4>{say(1, 4, False)}</h4><p>{say(5, 25)}</p>"),
        lambda: tag("div", ["cookie-notice", "notice", "consent", "gdpr", "alert", "popup", "modal"], f"<p>{rng.choice(('We use cookies. ', ''))}{say(5, 25)}</p><button>OK</button>"),
        lambda: tag("form", ["", "newsletter", "search", "login", "signup"], f"<label>{say(1, 4, False)}</label><p>{say(3, 15)}</p><button>{say(1, 2, False)}</button>"),
        lambda: tag("div", ["breadcrumb", "share", "social", "tags", "pagination", "meta"], f'<a href="/">{say(1, 2, False)}</a> · <a href="/x">{say(1, 3, False)}</a>'),
    ]
    comments = lambda: tag(rng.choice(("section", "div")), ["comments", "comment-list", "responses", "discussion", "disqus"], f"<h3>{rng.choice(('Comments', say(1, 2, False)))}</h3>" + "".join(tag(rng.choice(("div", "li", "article", "p")), ["comment", "reply", ""], f"<p>{say(4, 40)}</p>" if rng.random() < 0.7 else say(4, 40)) for _ in range(rng.randint(1, 4))))
    foot = rng.choice(
        (
            lambda: tag("footer", ["", "footer", "site-footer"], f"{rng.choice(('&copy; ', 'Copyright ', ''))}{say(2, 20)} &middot; {say(1, 12)}"),
            lambda: tag("div", ["footer", "copyright", "bottom footer"], f"<p>&copy; {say(2, 15)}</p>"),
            lambda: tag("footer", [""], f"<p>{say(3, 25)}</p><ul>{links(4)}</ul>"),
        )
    )

    def paragraph() -> str:
        words = rng.choice(((1, 3), (3, 12), (10, 40), (30, 120)))
        inner = "" + say(*words)
        if rng.random() < 0.2:
            inner += f' <a href="/y">{say(1, 3, False)}</a> {say(2, 10)}'
        if rng.random() < 0.1:
            inner = f"<b>{inner}<br>"
        kind = rng.random()
        if kind < 0.08:
            return "<ul>" + "".join(f"<li>{say(2, 15)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.12:
            return f"<blockquote><p>{inner}</p></blockquote>"
        if kind < 0.16:
            return f"<h{rng.randint(2, 3)}>{say(1, 6, False)}</h2>"
        if kind < 0.19:
            return f"<table><tr><td>{say(1, 4)}</td><td>{say(1, 4)}</td></tr></table>"
        if kind < 0.22:
            return f"<pre>{say(3, 30)}</pre>"
        return f"<p>{inner}</p>" if rng.random() < 0.8 else f"<p>{inner}"

    inside = [f"<h1>{say(2, 10, False)}</h1>" if rng.random() < 0.8 else ""]
    for _ in range(rng.randint(1, 14)):
        inside.append(paragraph())
        if rng.random() < 0.08:
            inside.append(rng.choice(side)())
    if rng.random() < 0.2:
        inside.append(comments())
    if rng.random() < 0.15:
        inside.append(tag("footer", [""], say(1, 8)))
    kind = rng.random()
    wrap = lambda x: tag("article", ["", "", "post", "story"], x)
    if kind > 0.65:
        wrap = lambda x: tag("main", ["", "content"], x)
    if kind > 0.8:
        wrap = lambda x: tag("div", ["content", "post-content", "entry", "article-body", "story text", "main"], x)
    if kind > 0.95:
        wrap = lambda x: f"<div>{x}</div>"
    extras = [f() for f in rng.sample(side, rng.randint(0, 4))]
    cut = rng.randint(0, len(extras))
    after = comments() if rng.random() < 0.35 else ""
    body = head() + "".join(extras[:cut]) + wrap("".join(inside)) + "".join(extras[cut:]) + after + (foot() if rng.random() < 0.9 else "")
    return f"<html><head><title>{say(1, 5)}</title></head><body>{body}</body></html>"


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[list[Block], list[int]]]:
    rng, out = random.Random(seed), []
    while len(out) < n:
        page = blocks(_labelled_page(rng))
        if page:
            out.append((page, [int("" in b.text) for b in page]))
            for b in page:
                b.text = b.text.replace("", "") or "x"
    return out


@lru_cache(maxsize=4)
def model(n: int = PAGES, seed: int = SEED) -> Chain:
    return train([(features(p), y) for p, y in labelled_pages(n, seed)])


def label_blocks(chain: Chain, page: list[Block]) -> list[int]:
    weight = chain.weight
    return chain.viterbi([sum(weight.get(f, 0.0) for f in own) for own in features(page)])


def main_text(chain: Chain, html: str | None) -> str:
    page = blocks(html or "")
    return "\n".join(b.text for b, y in zip(page, label_blocks(chain, page)) if y)


def extract(pages: DataFrame, n: int = PAGES, seed: int = SEED, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_blocks, n_content."""
    chain = model(n, seed)

    @frugal
    def run(batches):
        for b in batches:
            texts, sizes, kept = [], [], []
            for html in b.column(2):
                page = blocks(html.as_py() or "")
                own = [x.text for x, y in zip(page, label_blocks(chain, page)) if y]
                texts.append("\n".join(own))
                sizes.append(len(page))
                kept.append(len(own))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(kept, pa.int64())], ["page_id", "url", "text", "n_blocks", "n_content"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_blocks long, n_content long")


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
