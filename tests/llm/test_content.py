from __future__ import annotations

from pyspark.sql import functions as F

from recollect.llm import content

PAGE = """<!DOCTYPE html><html><head><title>Title words here</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>The site of many words in a header</h2></header><nav><ul><li><a href="/a">Home and more</a></li><li><a>News</a></li></ul></nav>
<div class="cookie-notice">We use cookies to do things you know</div><aside class="sidebar">Popular posts of this week are listed here</aside>
<!-- ad 1 --><div class="ad">Buy this now and be happy with it</div>
<article><h1>A   heading</h1><p><b>Bold</b>ly &amp; <i>so</i> on.<br><p>Second para&shy;graph\n of text.<aside>An aside of some length in the middle of it all</aside>
<form><button>Send me the letter</button></form><ul><li>One<li>Two</ul><div hidden>not seen at all</div><p>Third &lt;tag&gt; here.</p>
<section id="comments"><p>First! A reader says many words of no use.</p></section></article>
<footer>&copy; someone &middot; with a very long footer of words that goes on and on and on</footer></body></html>"""
WANT = "A heading Boldly & so on. Second para\u00adgraph of text. One Two Third <tag> here."


def pages(spark, *html):
    return spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(html)], "page_id bigint, url string, html string")


def test_the_article_and_nothing_else(spark):
    short = "<html><body><nav><a>Many words of a menu to choose from</a></nav><article>Word</article><footer>Ten words in a footer are more than one</footer></body></html>"
    plain = "<body><div class='content'><p>Text without an article element.</p><p>More.</p></div><div class='comments'>Reader words</div></body>"
    df = pages(spark, PAGE, short, plain, None, "", "<nav>only a menu</nav>", "no markup at all", "a < b and <article>x & y", PAGE)
    got = {r["page_id"]: r["text"] for r in content.main_text(df).collect()}
    assert got[0] == WANT == got[8]
    assert got[1] == "Word"
    assert got[2] == "Text without an article element. More."
    assert (got[3], got[4], got[5]) == ("", "", "")
    assert got[6] == "no markup at all" and got[7].endswith("x & y")


def test_prior_weights_long_pages_and_odd_tables(spark):
    many = "<body><nav>menu words</nav><main>" + "<p>word and word.</p>" * 20_000 + "</main></body>"
    df = pages(spark, many, "<p>" * 3000 + "deep", "<a title='x>y' href=\"z>w\">link</a> text", "<p class='unclosed>text").withColumn("text", F.lit(1))
    got = {r["page_id"]: r["text"] for r in content.main_text(df, weights=content.PRIOR).collect()}
    assert got[0] == " ".join(["word and word."] * 20_000)
    assert got[1] == "deep" and got[2] == "link text"
    assert content.main_text(df.limit(0)).count() == 0
    assert content.learned(df.limit(0)) == {**content.PRIOR}


def test_wrappers_and_headings_named_like_furniture(spark):
    """Classes of what holds most of the page exclude nothing; headings inside the article stay."""
    words = "<p>" + " ".join(f"word{k}" for k in range(40)) + "</p>"
    want = " ".join(f"word{k}" for k in range(40))
    rest = "<nav><a>Home and more words</a></nav>{}<footer>of many words that end the page</footer>"
    df = pages(
        spark,
        f"<body class='has-sidebar'>{rest.format('<article>' + words + '</article>')}</body>",
        f"<body>{rest.format('<main class=overflow-hidden>' + words + '</main>')}</body>",
        f"<body>{rest.format('<article class=' + chr(34) + 'post no-ads' + chr(34) + '>' + words + '</article>')}</body>",
        f"<body>{rest.format('<div class=search-body><article>' + words + '</article></div>')}</body>",
        f"<body>{rest.format('<div class=search><div>' + words + '</div></div>')}</body>",
        f"<body class='comments ad sidebar hidden'><form>{rest.format('<article>' + words + '</article>')}</form></body>",
        f"<body>{rest.format('<article><header><h1 class=post-title>The title</h1></header>' + words + '</article>')}</body>",
        f"<body>{rest.format('<article>' + words + '<div class=' + chr(34) + 'x sidebar' + chr(34) + '>not this</div><div class=comments>nor that</div></article>')}</body>",
    )
    got = {r["page_id"]: r["text"] for r in content.main_text(df, weights=content.PRIOR).collect()}
    assert [got[k] for k in range(8)] == [want] * 6 + ["The title " + want, want]


def test_learned_weights_win_over_the_prior():
    page = "<body><nav>menu words here</nav><article><div class='comment'>" + "word " * 30 + "</div><p>more</p></article><div class='box'>out of it</div></body>"
    weights = {**content.PRIOR, "comment": 1.5, "box": -5.0}
    assert content.extract(page, weights) == " ".join(["word"] * 30 + ["more"])


def test_malformed_pages_take_time_and_memory_in_proportion():
    import time
    import tracemalloc

    for unit in ("<a ", "<", "<a \"", "<a '\"", "<!--", "<p class='x y'>", "</div>", "<div><p>", "<script>", "<b title=\"a>b\">"):
        page = unit * (1_000_000 // len(unit))
        began = time.process_time()
        content.extract(page, content.PRIOR)
        assert time.process_time() - began < 12, unit
    nested = "".join(f"<div class='c{k} d{k}'>w " for k in range(20_000))
    tracemalloc.start()
    content.extract(nested, content.PRIOR)
    assert tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()


def test_the_scan_finds_the_best_run():
    """The region against all regions tried one by one."""
    weights = {**content.PRIOR, "<x": -3.0, "</x": -3.0, "<p": -0.1, "</p": -0.1}
    page = "a b <x> c </x> d e f g <p> h </p> i <x></x><x></x> j k"
    seen = list(content.tokens(page))
    score = [weights.get("<" + v, content.TAG) if kind == "tag" else float(len(v.split())) for kind, v, _, _ in seen]
    _, i, j = max((sum(score[i:j]), -i, -j) for i in range(len(score)) for j in range(i + 1, len(score) + 1))
    want = " ".join(" ".join(v.split()) for kind, v, _, _ in seen[-i:-j] if kind == "text" and v.strip())
    got = content.extract(page, weights)
    assert got == want == "d e f g h i"
