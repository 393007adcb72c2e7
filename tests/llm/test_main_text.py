"""Pages with known articles, pages put together from parts, broken markup and very long pages."""

from __future__ import annotations

import random
import time
from html import escape

import pytest
from pyspark.sql import types as T

from marketframe.llm import queries
from marketframe.llm.main_text import main_text

LONG = "The harbour was quiet that morning and the boats lay still, although the wind had turned during the night and the keeper knew it."
MORE = "Nobody on the quay had seen the lamp go out; they spoke of it for years, and every telling of it was a little different from the last."

PAGES = {
    "plain": (f"<html><body><nav><a href=/>Home</a></nav><article><h1>Lamp</h1><p>{LONG}</p></article><footer>&copy; 2020</footer></body></html>", ["Lamp", LONG]),
    "no_semantics": (f"<div><a href=x>Home</a> <a href=y>News</a></div><div><h1>Lamp</h1><p>{LONG}</p><p>Short.</p><p>{MORE}</p></div><div>Copyright 2020</div>", ["Lamp", LONG, "Short.", MORE]),
    "wrappers": (
        f"<div class='page has-sidebar'><div class='site-header'><h1>The Daily</h1></div><div class=content><h2>Lamp</h2><div><p>{LONG}</p><p>{MORE}</p></div></div>"
        f"<div class=sidebar><p>{LONG}</p></div><div id=comments><p>{MORE} {MORE}</p></div></div>",
        ["Lamp", LONG, MORE],
    ),
    "two_sections": (f"<main><section><p>{LONG}</p><p>{MORE}</p><p>{LONG}</p></section><section><h3>Later</h3><p>{MORE}</p></section></main>", [LONG, MORE, LONG, "Later", MORE]),
    "inside_article": (
        f"<article><header><h1>Lamp</h1><p>By K.</p></header><p>{LONG}</p><aside>See also</aside><div class='ad-slot'>Buy</div><form><input><button>Send</button></form><div class=post-comments><h3>2 comments</h3>"
        "<article class=comment><p>Nice!</p></article></div><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></article>",
        ["Lamp", "By K.", LONG],
    ),
    "cookie": (f"<div role=alertdialog>We use cookies</div><div class='cookie-notice'>{LONG}</div><div class=story><p>{MORE}</p><p>{LONG}</p></div>", [MORE, LONG]),
    "broken": (f"<body><article><h1>Lamp &amp; co<p><b>{LONG}<br><p>{MORE}</i></span><ul><li>a<li>b &lt;c&gt;</ul>tail <i>it</i>al&nbsp;x", ["Lamp & co", LONG, MORE, "a", "b <c>", "tail ital x"]),
    "scripts": (f"<title>no</title><style>p{{}}</style><script>var t='<p>no</p>';</script><p>{LONG}</p><noscript>no</noscript><!-- <p>no</p> --><p>{MORE}", [LONG, MORE]),
    "table": (f"<article><table><tr><td>{LONG}<td>{MORE}<tr><td>3</table></article>", [LONG, MORE, "3"]),
    "quotes": (f"<article><p title='a > b' data-x=\"</p>\">{LONG}</p><p hidden>no</p><p style='display:none'>no</p></article>", [LONG]),
    "layout": (f"<div class='container sidebar-right'><h1>Lamp</h1><p>{LONG}</p></div>", ["Lamp", LONG]),
    "text_only": ("just\n\n some   text &#8212; here", ["just some text — here"]),
    "empty": ("", []),
    "null": (None, []),
    "only_menu": ("<nav><a href=/>Home</a></nav>", []),
    "comment_open": (f"<p>{LONG}</p><!-- {MORE}", [LONG]),
}


@pytest.mark.parametrize("name", PAGES)
def test_known_pages(name):
    page, blocks = PAGES[name]
    assert main_text(page) == "\n\n".join(blocks)


def built_page(rnd: random.Random):
    """A page from parts, and its article's blocks."""
    words = lambda n: " ".join("".join(rnd.choice("aeioulnrst&<é") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    blocks, body = [], []
    for _ in range(rnd.randint(2, 9)):
        text, tag = words(rnd.randint(12, 60)), rnd.choice(["p", "p", "p", "blockquote", "h2"])
        blocks.append(text)
        inner = escape(text).replace(" ", rnd.choice([" ", "\n\t", " <!-- x --> ", "<br>", " <b></b>"]), 1)
        body.append(f"<{tag}>{inner}" + ("" if tag == "p" and rnd.random() < 0.2 else f"</{tag}>"))
    junk = [
        f"<nav><ul><li><a href=/>{escape(words(2))}</a></ul></nav>", f"<div class='{rnd.choice(['ad', 'Banner', 'cookie-notice', 'x sidebar', 'commentList'])}'>{escape(words(25))}</div>", f"<footer><p>{escape(words(20))}</p></footer>",
        f"<script>{words(9)}</script>", f"<form><label>{escape(words(3))}</label><textarea>{escape(words(20))}</textarea></form>", "<div>" + "".join(f"<a href=/{i}>{escape(words(2))}</a> " for i in range(5)) + "</div>",
    ]
    rnd.shuffle(junk)
    wrap = rnd.choice([("<article>", "</article>"), ("<div class=entry>", "</div>"), ("<main>", "</main>"), ("<div><div id=c1>", "</div></div>")])
    return f"<html><head><title>{escape(words(3))}</title></head><body>{''.join(junk[:3])}{wrap[0]}{''.join(body)}{wrap[1]}{''.join(junk[3:])}</body></html>", blocks


def test_built_pages():
    rnd = random.Random(5)
    for _ in range(300):
        page, blocks = built_page(rnd)
        assert main_text(page) == "\n\n".join(blocks), page


@pytest.mark.parametrize("page", ["<" * 100_000, "<!--" * 50_000, "<a " * 100_000, "<b>" * 50_000 + "x" + "</i>" * 50_000, "<p>x</b>" * 30_000, "<div>" * 50_000 + "x", '<a href="' * 30_000, "&" * 100_000])
def test_long_pages_take_linear_time(page):
    began = time.time()
    main_text(page)
    assert time.time() - began < 10


def test_query(spark, tmp_path):
    """Repeated rows, nulls and columns with clashing names; one row per page row."""
    rows = [(i, f"http://x/{i}", page, "clash", 3) for i, (page, _) in enumerate(PAGES.values())]
    rows += [rows[0], (None, None, rows[0][2], None, None)]
    schema = T.StructType([T.StructField("page_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("url", "html", "text")], T.StructField("n_chars", T.LongType())])
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id if r.page_id is not None else -1, r.url or "", r.text, r.n_chars) for r in queries.op11_main_text(spark, str(tmp_path)).collect())
    texts = ["\n\n".join(b) for _, b in PAGES.values()]
    want = [(i, f"http://x/{i}", t, len(t)) for i, t in enumerate(texts)]
    assert got == sorted(want + [want[0], (-1, "", texts[0], len(texts[0]))])
