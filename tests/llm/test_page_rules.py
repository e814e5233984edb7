"""Small pages and the text that has to come out of them."""

import time

import pytest

from inkgrid.llm import html_blocks

PARA = "The river is wide and the boat that we have is small but it is good for the trip to the sea and back again."
NEXT = "In the morning they had a look at the old map which was on the table and it was as good as new for us all."
RUSSIAN = "Река широка, а лодка, которая у нас есть, мала, но она хороша для поездки к морю и обратно, если погода тихая."
CHINESE = "这条河很宽，我们的船虽然很小，但是用来去海边再回来还是很好的，只要天气平静就可以出发了。"
ART = f"<article><h1>Title</h1><p>{PARA}</p></article>"
TEXT = f"Title\n{PARA}"
CASES = {
    "wrapper with a layout name": (f'<div class="layout has-sidebar">{ART}<div class="sidebar"><p>{NEXT}</p></div></div>', TEXT),
    "main named after its sidebar": (f'<main class="with-sidebar">{ART}</main>', TEXT),
    "wrapper that bears a plain name": (f'<div class="menu"><div id="page">{ART}</div></div>', TEXT),
    "form around the page": (f'<form method="post" action="/x"><input type="hidden" value="1">{ART}</form>', TEXT),
    "form around a page without article": (f"<form><div><p>{PARA}</p><p>{NEXT}</p></div></form>", f"{PARA}\n{NEXT}"),
    "form in the article": (f"<article><p>{PARA}</p><form><label>Your mail</label><input><button>Send it to the editor of the page</button></form></article>", PARA),
    "sidebar never closed": (f'<div class="sidebar"><p>{NEXT}</p><article><p>{PARA}</p></article>', PARA),
    "sidebar never closed, no article": (f'<div class="sidebar"><p>{NEXT}</p><p>{PARA}</p>', f"{NEXT}\n{PARA}"),
    "aside never closed": (f"<aside><p>Look here</p><article><p>{PARA}</p><p>{NEXT}</p></article>", f"{PARA}\n{NEXT}"),
    "article header": (f'<article><div class="article-header"><h1>Title</h1></div><p>{PARA}</p></article>', TEXT),
    "header element in the article": (f"<header><p>{NEXT}</p></header><article><header><h1>Title</h1></header><p>{PARA}</p></article>", TEXT),
    "title after a breadcrumb": (f"<main><div class=breadcrumb><a href=/>Home</a> <a href=/a>News</a></div><h1>Title</h1><p>{PARA}</p></main>", TEXT),
    "title after links without a name": (f"<main><div><a href=/>Home</a> <a href=/a>News</a></div><h1>Title</h1><p>{PARA}</p></main>", TEXT),
    "closing lines before links": (f"<article><p>{PARA}</p><p>One more.</p><p>The end.</p><div><a href=/s>Tell others</a></div></article>", f"{PARA}\nOne more.\nThe end."),
    "notice in p": (f'<article><p class="cookie-notice">{NEXT}</p><p>{PARA}</p></article>', PARA),
    "advert in p": (f'<article><p>{PARA}</p><p class="advert">{NEXT}</p></article>', PARA),
    "comment in li": (f'<article><p>{PARA}</p><ul><li class="comment">{NEXT}</li><li>The first of the points that it has.</li></ul></article>', f"{PARA}\nThe first of the points that it has."),
    "sidebar in td": (f'<table><tr><td class="sidebar">{NEXT}<td><p>{PARA}</p></td></tr></table>', PARA),
    "comments as articles": (f'<article><p>{PARA}</p></article><section class="comments"><article class="comment"><p>{NEXT}</p></article><article><p>{NEXT}</p></article></section>', PARA),
    "long comments": (f'<article><p>{PARA}</p></article><div id="comments">' + f"<div><p>{NEXT}</p></div>" * 9 + "</div>", PARA),
    "related teasers": (f'<article><p>{PARA}</p></article><div class="related-posts"><article><h2>Other</h2><p>{NEXT}</p></article></div>', PARA),
    "hidden by style": (f'<article><p style="color:red; display: none">{NEXT}</p><p>{PARA}</p></article>', PARA),
    "hidden by attribute": (f"<article><div hidden><p>{NEXT}</p></div><p>{PARA}</p></article>", PARA),
    "title attribute that says hidden": (f'<article title="the hidden class=menu gem"><p>{PARA}</p></article>', PARA),
    "aria-hidden icon": (f'<article><p><span aria-hidden="true">icon</span>{PARA}</p></article>', PARA),
    "inline advert": (f'<article><p>{PARA} <span class="ad">buy <b>now</b></span>And so on.</p></article>', f"{PARA} And so on."),
    "Russian without article": (f"<div class=menu><a href=/>Дом</a></div><div><h1>Река</h1><p>{RUSSIAN}</p><p>Конец.</p></div><div class=footer>{RUSSIAN}</div>", f"Река\n{RUSSIAN}\nКонец."),
    "Chinese without article": (f"<nav><a href=/>首页</a></nav><div><h1>河</h1><p>{CHINESE}</p></div>", f"河\n{CHINESE}"),
    "names among stop words": (f"<article><p>{PARA}</p><p>{'Anna Berta Carla Dora Emil Fritz Gustav Hans ' * 6}.</p></article>", f"{PARA}\n{'Anna Berta Carla Dora Emil Fritz Gustav Hans ' * 6}."),
    "loose text beside an article": (f"<div><p>{NEXT}</p></div>{ART}", TEXT),
    "loose text, article of a few words": (f"<div><p>{PARA}</p></div><article><p>A few words</p></article>", f"{PARA}\nA few words"),
    "menu and list of links": (f"<ul><li><a href=/a>First link of all</a><li><a href=/b>Second link of all</a></ul><p>{PARA}</p><p>{NEXT}</p>", f"{PARA}\n{NEXT}"),
    "body named after a menu": (f'<body class="menu-open sidebar"><p>{PARA}</p></body>', PARA),
    "unclosed p and li": (f"<article><p>{PARA}<p>{NEXT}<ul><li>One of the two<li>Two of the two</ul></article>", f"{PARA}\n{NEXT}\nOne of the two\nTwo of the two"),
    "unclosed video": (f"<article><video src=x><p>{PARA}</p></article>", PARA),
    "table, figure and pre": (f"<article><p>{PARA}</p><table><tr><td>A</td><td>B</td></tr></table><figure><img><figcaption>View of it</figcaption></figure><pre>a\n  b</pre></article>", f"{PARA}\nA\nB\nView of it\na b"),
    "references": (f"<article><p>Caf&eacute; &lt;b&gt; &#x4e2d; {PARA}</p></article>", f"Café <b> 中 {PARA}"),
    "script that holds markup": (f"<article><script>var a = '<p>{NEXT}</p>';</script><p>{PARA}</p><style>p::after {{ content: '<p>'; }}</style></article>", PARA),
    "nothing": ("<div></div>", ""),
    "text alone": ("just words", "just words"),
}


@pytest.mark.parametrize("name", list(CASES))
def test_page(name):
    source, want = CASES[name]
    assert html_blocks.main_text(source) == want


@pytest.mark.parametrize(("name", "kind"), [("sidebar", 1), ("with-sidebar", 0), ("no-sidebar", 0), ("sidebar-layout", 0), ("left-sidebar", 1), ("siteFooter", 1), ("article-header", 0), ("page-header", 1), ("comment-list", 2), ("adventure", 0),
                                           ("header_1", 1), ("shared", 0), ("js-menu", 0), ("content-sidebar-wrap", 0), ("", 0), ("--", 0)])
def test_names(name, kind):
    assert html_blocks.name_kind(name) == kind


def test_long_pages_take_time_in_proportion():
    def seconds(pairs):
        page = "<div>" + "".join(f"<p>Short {k}</p><p>{PARA}</p>" for k in range(pairs)) + "</div>"
        best = min(_timed(page) for _ in range(2))
        return best, len(html_blocks.main_text(page).split("\n"))

    (small, a), (large, b) = seconds(2000), seconds(16_000)
    assert (a, b) == (4000, 32_000) and large < 20 * small
    for broken in ("<div>" * 20_000 + "</section>" * 20_000, "<ul>" + "<div>" * 20_000 + "<li>x" * 20_000, "<span class=ad>" * 20_000, "<p class='x'>" * 20_000, "<video>" * 20_000, "<!--" * 20_000):
        assert _timed(broken) < 10


def _timed(page):
    start = time.perf_counter()
    html_blocks.main_text(page)
    return time.perf_counter() - start
