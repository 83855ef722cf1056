import random
import time

import pytest

from quantgap.llm import html_text as h
from tests.llm.helpers import rows

LONG = "Words that say something, and then some more of it, go on here for a while, as articles do."


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}<style>p{{x:1}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


def test_article_without_what_surrounds_it():
    body = f"""<header><p>Site name, {LONG}</p></header><nav><ul><li><a href=/>Menu</a></ul></nav><div class="ad">Buy, buy, {LONG}</div>
      <div id=content><h1>A &amp; B</h1><p>{LONG}</p><p>Second   line\n{LONG}<p>Third, unclosed <b>bold &eacute;&#233; text<br>{LONG}<form><input>Name</form>
      <ul><li>one item<li>two</ul><aside>{LONG}</aside></div><div class="comments"><p>{LONG} I say, no.</p></div><footer><p>Copyright, {LONG}</p></footer>"""
    got = h.main_text(page(body)).split("\n")
    assert got == ["A & B", LONG, "Second line " + LONG, "Third, unclosed bold éé text " + LONG, "one item", "two"]


def test_siblings_of_the_best_container_are_kept():
    body = f"<div id=wrap><div><p>{LONG}</p><p>{LONG} More, of, it.</p></div><p>Loose but telling.</p><div class=x><a href=1>link one</a> <a href=2>link two</a></div></div>"
    got = h.main_text(page(f"{body}<div class=related><p>{LONG}</p></div>"))
    assert got.split("\n") == [LONG, LONG + " More, of, it.", "Loose but telling."]


def test_short_cut_and_empty_pages():
    assert h.main_text(None) == h.main_text("") == h.main_text("<p></p>") == ""
    assert h.main_text("just text") == "just text"
    assert h.main_text("<article><h1>T</h1><p>Short.</p></article><footer>no</footer>") == "T\nShort."
    assert h.main_text(f"<article><p>{LONG}</p><p>cut off he") == LONG + "\ncut off he"
    assert h.main_text("<article><p>a &am") == "a &am" and h.main_text("<article><p>x<p") == "x"
    assert h.main_text("<p>" + "<div>" * 5000 + "deep") == "deep"
    assert h.main_text("</p></div><article><p>" + LONG) == LONG


def test_names_count_as_whole_tokens():
    article = f"<h1>Title</h1><p>{LONG}</p><p>{LONG} More, of, it.</p>"
    want = ["Title", LONG, LONG + " More, of, it."]
    harmless = ["layout has-sidebar", "content-area no-sidebar", "wrapper menu-open", "meta", "side", "hidden md:block", "comments-open"]
    for name in [*harmless, "post type-post hentry category-news tag-politics tags"]:
        for inner in (article, f"<article>{article}</article>"):
            got = h.main_text(page(f'<div class="{name}">{inner}</div><div class="sidebar"><p>{LONG} Aside.</p></div>'))
            assert got.split("\n") == want, name
    for name in ["ad", "x ad-slot", "sidebar widget-area", "site-footer", "cookie-banner", "comments-area", "comment-12", "related-posts"]:
        got = h.main_text(page(f"<div class=text>{article}<div class='{name}'><p>{LONG}</p></div></div>"))
        assert got.split("\n") == want, name


def test_names_do_not_take_the_article():
    article = f"<h1>Title</h1><p>{LONG}</p><p>{LONG} More, of, it.</p>"
    want = ["Title", LONG, LONG + " More, of, it."]
    comments = "<div id=comments>" + f"<article><p>{LONG} I say.</p></article>" * 9 + "</div>"
    for inner in (article, f"<article>{article}</article>", f"<main>{article}</main>"):
        for rest in ("", comments):
            assert h.main_text(page(f"<div class=sidebar>{inner}</div>{rest}")).split("\n") == want
    short = "<article><h1>T</h1><p>Short, but the article of the page.</p></article>"
    assert h.main_text(page(short + comments)) == "T\nShort, but the article of the page."
    assert h.main_text(page("".join(f"<div class=widget><p>{LONG} {i}</p></div>" for i in range(4)))).split("\n") == [f"{LONG} {i}" for i in range(4)]
    assert h.main_text(page(f"<div class=ad><p>{LONG}</p></div>")) == LONG


def test_short_sections_beside_a_long_one_are_kept():
    long = "".join(f"<p>{LONG} Part, the long one, {i}.</p>" for i in range(9))
    short = f"<section><h2>Second</h2><p>{LONG} Short.</p></section><ul><li>one<li>two</ul>"
    tail = "<table><tr><td>cell<td>7</table><div>Last.</div>beside<section><h2>Third</h2><p>Few words.</p></section>"
    links = "<div><a href=1>first link of a list</a> <a href=2>second link</a></div>"
    want = [f"{LONG} Part, the long one, {i}." for i in range(9)]
    after = ["Second", f"{LONG} Short.", "one", "two", "cell", "7", "Last.", "beside", "Third", "Few words."]
    got = h.main_text(page(f"<div id=x><section><h2>First</h2>{long}</section>{short}{tail}{links}</div>"))
    assert got.split("\n") == ["First", *want, *after]
    parts = "".join(f"<div class=row><div class=col><section>{x}</section></div></div>" for x in (long, f"<h2>S</h2><p>{LONG}</p>"))
    assert h.main_text(page(f"<div id=x>{parts}<div>Company, address, phone</div></div>")).split("\n") == [*want, "S", LONG]


NOISE = """commentlist comment-thread comments-title comment-respond fb-comments dsq-thread livefyre discussion responses adsbygoogle
    google-ad dfp-ad banner-ad taboola cookie-law-info side-nav navbar-nav top-bar left-column rail sideNav AdSlot""".split()


@pytest.mark.parametrize("name", NOISE)
def test_noise_by_parts_of_names(name):
    article = f"<h1>Title</h1><p>{LONG}</p><p>{LONG} More, of, it.</p>"
    for noise in ("ZZZ", f"ZZZ, {LONG}"):
        inner = f"<div class='{name}'><p>{noise}</p></div>"
        for body in (f"<div class=text>{article}</div>{inner}", f"<div class=text>{article}{inner}</div>", f"<article>{article}</article>{inner}"):
            assert h.main_text(page(body)).split("\n") == ["Title", LONG, LONG + " More, of, it."]


def test_parts_of_names_that_say_nothing():
    for name in ["no-comments", "post-with-sidebar", "is-ad-free", "leads", "header-admin", "readable", "thread-count", "commented", "navy-blue", "railway"]:
        assert h.judge_name(name) == 0, name
    assert h.judge_name("discussion", is_class=False) == 0  # a section of a paper
    body = f"<div><h2>Results</h2><p>{LONG}</p><section id=discussion><h2>Discussion</h2><p>{LONG} Two.</p></section></div>"
    assert h.main_text(page(body)).split("\n") == ["Results", LONG, "Discussion", LONG + " Two."]


def test_signed_and_dated_neighbours_are_a_thread():
    article = f"<div class=text><h1>Title</h1>{f'<p>{LONG}</p>' * 12}</div>"
    posts = "".join(f"<div class=row><b class=username>u{i}</b> <time>today</time><p>{LONG} I say {i}.</p></div>" for i in range(3))
    assert h.main_text(page(article + posts)).split("\n") == ["Title"] + [LONG] * 12
    assert h.main_text(page(posts)).count("I say") == 3  # a page of posts is a text of posts


def test_generated_pages_give_their_article():
    rng = random.Random(5)
    phrase = lambda k: f"Sentence {k}, with so many words, as a paragraph of an article has {rng.randint(1, 10**9)}."
    for _ in range(150):
        want, body = [], []
        for _ in range(rng.randint(4, 15)):
            kind = rng.choice(["p", "p", "p", "h2", "li", "blockquote"])
            text = phrase(rng.randint(0, 99))
            want.append(text.replace("paragraph", "par & graph"))
            marked = want[-1].replace("&", "&amp;").replace("many", rng.choice(["many", "<b>many</b>", "<span>many</span>"])).replace(" as ", rng.choice([" as ", "\n  as\t"]))
            body.append(f"<ul><li>{marked}</ul>" if kind == "li" else f"<{kind}>{marked}</{kind}>")
        noise = lambda: rng.choice(["", f"<div class={rng.choice(NOISE)}><p>ZZZ {phrase(7)}</p></div>", "<script>ZZZ</script>", "<nav><a href=/>ZZZ</a></nav>", f"<aside>ZZZ {phrase(1)}</aside>"])
        inside = "".join(block + (noise() if rng.random() < 0.2 else "") for block in body)
        holder = rng.choice(["<article>{}</article>", "<div class=text>{}</div>", "<main><div>{}</div></main>", "<div id=content class='no-sidebar'>{}</div>"])
        got = h.main_text(page(noise() + holder.format(inside) + noise() + noise()))
        assert got.split("\n") == want


def test_long_pages_of_stray_tags_are_linear():
    for piece in ("<div>x", "<div>x</b></i>", "<header>x", "<li>a<p>b", "<h1>b", "<a '", "<span>y"):
        long = "<p>a<div>" + piece * 30_000
        began = time.monotonic()
        h.main_text(long)
        assert time.monotonic() - began < 20, piece  # quadratic work would take minutes


def test_query_shape(spark):
    table = spark.createDataFrame([(1, "u", f"<article><p>{LONG}</p>"), (1, "u", None), (None, None, "")], "page_id bigint, url string, html string")
    assert sorted(rows(h.extract(table), "page_id", "url", "text", "n_chars"), key=str) == [(1, "u", "", 0), (1, "u", LONG, len(LONG)), (None, None, "", 0)]
    assert h.extract(table.limit(0)).count() == 0
