"""Main text of pages of many moulds, each with the text that must come out."""

import time

import pytest

from quillmatch.llm import html

A = "The first paragraph says enough to be the text of an article, with commas, and more than one clause."
B = "A second one follows it and is about as long, so that nobody would take it for a caption or a menu."
C = "The third closes the matter; it has a few words less, but still a whole sentence."
P = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
T = f"{A}\n{B}\n{C}"
NAV = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"
FOOT = "<footer>&copy; 2024 The makers of this page, all rights reserved</footer>"

MOULDS = {
    "article": (f"<body>{NAV}<article><h1>Head</h1>{P}</article>{FOOT}", f"Head\n{T}"),
    "main": (f"<body>{NAV}<main><h1>Head</h1>{P}</main>{FOOT}", f"Head\n{T}"),
    "content has-sidebar": (f"<body><div class='content has-sidebar'><h1>Head</h1>{P}</div><div class=sidebar><p>{B}</p></div>", f"Head\n{T}"),
    "wrapper header-fixed": (f"<body><div id=page class=header-fixed>{NAV}<article><h1>Head</h1>{P}</article>{FOOT}</div>", f"Head\n{T}"),
    "body class with marks": (f"<body class='nav-open has-sidebar comments'>{NAV}<article>{P}</article>", T),
    "two articles": (f"<body>{NAV}<article><h2>One</h2>{P}</article><article><h2>Two</h2>{P}</article>{FOOT}", f"One\n{T}\nTwo\n{T}"),
    "articles in main": (f"<main><h1>All</h1><article>{P}</article><article>{P}</article></main>", f"All\n{T}\n{T}"),
    "body only": (f"<body><h1>Head</h1>{P}<p>ok</p><p>fine.</p></body>", f"Head\n{T}\nok\nfine."),
    "body only with menu div": (f"<body><div><a href=1>Home</a> <a href=2>News</a></div><h1>Head</h1>{P}<p>fine.</p><div>&copy; 2024 us</div></body>", f"Head\n{T}\nfine."),
    "div soup": (f"<div><div><div><a href=1>Home</a></div><div><h1>Head</h1><div>{A}</div><div>{B}</div><div>{C}</div></div></div><div><a href=2>Terms</a></div></div>", f"Head\n{T}"),
    "heading named search": (f"<article><h2 class=search>How to search</h2>{P}</article>", f"How to search\n{T}"),
    "paragraph no-comment": (f"<article><p class=no-comment>{A}</p><p>{B}</p></article>", f"{A}\n{B}"),
    "span named notice": (f"<article><p>{A} <span class=notice>Mind this.</span> {B}</p></article>", f"{A} Mind this. {B}"),
    "advert div": (f"<article><h1>Head</h1><p>{A}</p><div class=ad>Buy now</div><p>{B}</p></article>", f"Head\n{A}\n{B}"),
    "advert paragraph": (f"<article><p>{A}</p><p class='ad'>Buy now, pay later</p><p>{B}</p></article>", f"{A}\n{B}"),
    "advert span": (f"<article><p>{A} <span class=ad>Buy now</span></p><p>{B}</p></article>", f"{A}\n{B}"),
    "comments section": (f"<article>{P}</article><section id=comments><h3>Comments</h3><p>{A}</p><p>{B}</p></section>", T),
    "comments as articles": (f"<main><h1>Head</h1>{P}<ol class=comment-list><li><article class=comment-body><p>{A}</p><p>{B}</p></article></li></ol></main>", f"Head\n{T}"),
    "many comments": (f"<div id=content><h1>Head</h1>{P}</div><div class=comments-area>" + f"<div class=comment><p>{B}</p></div>" * 8 + "</div>", f"Head\n{T}"),
    "own header": (f"<article><header><h1>Head</h1><p>By somebody</p></header>{P}<footer>Posted in things</footer></article>", f"Head\nBy somebody\n{T}"),
    "header in a content div": (f"<header>Site name</header><div class=post><header><h1>Head</h1></header>{P}</div>", f"Head\n{T}"),
    "site header by name": (f"<div class=site-header><p>The name of the site</p></div><div id=main>{P}</div>", T),
    "post header": (f"<article><div class=post-header><h1>Head</h1></div>{P}</article>", f"Head\n{T}"),
    "camel case": (f"<div class=siteFooter>Made by us</div><div class=articleBody>{P}</div><div class=cookieBanner>We use cookies on this site</div>", T),
    "cookie notice": (f"<div class='cookie-notice' role=alert>{B}</div><main>{P}</main>", T),
    "form and controls": (f"<main>{P}<form><label>Mail</label><input><button>Send</button></form><select><option>One</select></main>", T),
    "scripts and styles": (f"<main><script>if (a < b) document.write('<p>no</p>')</script><style>p > a {{}}</style><!-- <p>no</p> -->{P}<noscript>No script</noscript></main>", T),
    "character references": ("<article><p>Fish &amp; chips &lt;now&gt; &eacute;t&eacute; &#8212; &#x41;&nbsp;and so on, for a while longer.</p></article>", "Fish & chips <now> été — A and so on, for a while longer."),
    "white space and breaks": ("<article><p>One\n\t two<br>three  <b>four</b>five,\r\nand the rest of it goes on.</p></article>", "One two three fourfive, and the rest of it goes on."),
    "lists and tables": (f"<article><p>{A}</p><ul><li>One item</li><li>Two <a href=x>items</a></li></ul><table><tr><td>cell</td><td>next</td></tr></table><p>{B}</p></article>", f"{A}\nOne item\nTwo items\ncell\nnext\n{B}"),
    "links in an article": (f"<article><p>{A}</p><ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li></ul></article>", f"{A}\nFirst source\nSecond source"),
    "quote and code": (f"<article><p>{A}</p><blockquote><p>{B}</p></blockquote><pre>x = 1\ny = 2</pre></article>", f"{A}\n{B}\nx = 1 y = 2"),
    "figure": (f"<article><p>{A}</p><figure><img src=x alt=y><figcaption>What it shows</figcaption></figure><p>{B}</p></article>", f"{A}\nWhat it shows\n{B}"),
    "related articles": (f"<main>{P}</main><div class=related><article><h3>Other</h3><p>{A}</p></article></div>", T),
    "aside": (f"<article><p>{A}</p><aside><p>{C}</p></aside><p>{B}</p></article>", f"{A}\n{B}"),
    "sidebar wrapper": (f"<div class=sidebar-layout><div class=sidebar><p>{C}</p></div><article><h1>Head</h1>{P}</article></div>", f"Head\n{T}"),
    "sidebar on the left": (f"<div class='main sidebar-left'><h1>Head</h1>{P}</div>", f"Head\n{T}"),
    "social bar": (f"<article><h1>Head</h1><ul class=social-share><li><a href=1>Tweet</a></ul>{P}</article>", f"Head\n{T}"),
    "hidden": (f"<main>{P}<div hidden><p>{B}</p></div></main>", T),
    "never closed": (f"<nav><ul><li><a href=1>Home<article><h1>Head<p>{A}<p>{B}<footer>Foot", f"Head\n{A}\n{B}"),
    "cut off": (f"<body><main><p>{A}</p><p>{B[:40]}", f"{A}\n{B[:40].strip()}"),
    "upper case": (f"<BODY><NAV><A HREF=x>Home</A></NAV><ARTICLE CLASS='Post'><H1>Head</H1><P>{A}</P></ARTICLE>", f"Head\n{A}"),
    "layout table": (f"<table><tr><td><a href=1>Home</a><br><a href=2>News</a><td><h1>Head</h1>{P}<td>Seen <a href=3>elsewhere</a></table>", f"Head\n{T}"),
    "comment items": (f"<main>{P}<ol><li class=comment><p>{A}</p><p>{B}</p></li></ol></main>", T),
    "list items with blocks": (f"<article><p>{A}</p><ul><li><p>One</p><p>two</p><li><p>Three</p></ul><p>{B}</p></article>", f"{A}\nOne\ntwo\nThree\n{B}"),
    "nested lists": (f"<article><p>{A}</p><ul><li>One<ul><li>Two<li>Three</ul><li>Four</ul><p>{B}</p></article>", f"{A}\nOne\nTwo\nThree\nFour\n{B}"),
    "list at the end of a div": (f"<body><div class=entry>{P}<ul><li>ok</li><li>fine</li></ul></div><div class=tail><a href=1>Next</a></div>", f"{T}\nok\nfine"),
    "list at the end of the body": (f"<body>{P}<ul><li>ok</li><li>fine</li></ul><ul><li><a href=1>Next</a></li></ul>", f"{T}\nok\nfine"),
    "definitions": (f"<article><dl><dt>Term<dd>{A}<dt>Other<dd>{B}</dl></article>", f"Term\n{A}\nOther\n{B}"),
    "google adverts": (f"<main><p>{A}</p><ins class=adsbygoogle>Buy</ins><p>{B}</p></main>", f"{A}\n{B}"),
    "short article": ("<nav><a href=x>Home</a></nav><article><p>Short.</p></article>", "Short."),
    "text alone": ("no markup at all", "no markup at all"),
    "menu alone": (NAV, ""),
    "nothing": ("", ""),
}


@pytest.mark.parametrize("name", MOULDS)
def test_mould(name):
    page, text = MOULDS[name]
    assert html.main_text(page) == text


def test_time_is_linear_in_nesting():
    def least(page):
        times = []
        for _ in range(3):
            began = time.process_time()
            html.main_text(page)
            times.append(time.process_time() - began)
        return min(times)

    for tag in ("div", "article", "section", "b", "nav", "li", "td", "ul><li", "li><div", "span class=ad", "p class=ad"):
        small, large = (least(f"<{tag}>" * n + "<p>deep</p>") for n in (5_000, 40_000))
        assert large < 3 * 8 * small, tag  # in proportion it is 8 times, by squares 64
    assert html.main_text("<div>" * 100_000 + "<p>deep</p>" + "</div>" * 100_000) == "deep"


def test_repeated_and_odd_rows(spark, corpus):
    page, text = MOULDS["article"]
    rows = [(1, "u", page), (1, "u", page), (2, None, page), (None, "v", None), (3, "w", ""), (4, "x", "<p>" + "long words " * 100_000)]
    out = sorted((tuple(r) for r in html.op10_html(spark, corpus([], pages=rows)).collect()), key=repr)
    want = [(1, "u", text, len(text))] * 2 + [(2, None, text, len(text)), (None, "v", "", 0), (3, "w", "", 0)]
    long_ = ("long words " * 100_000).strip()
    assert out == sorted([*want, (4, "x", long_, len(long_))], key=repr)
