"""The page parser's hard cases, and the style tree against plain Python."""

import math
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tributary.llm import html

SCHEMA = "page_id long, url string, html string"


def test_many_child_styles(spark):
    odd = "".join(f"<p id=p{k}>odd {k}</p>" for k in range(40))
    rows = [(i, f"http://h.example/{i}", f"<body><div class=box>Always</div><div class=main>{odd if i == 0 else f'<p>Own words {i}</p>'}</div></body>") for i in range(100)]
    rows += [(1000 + i, f"http://a.example/{i}", f"<body><article><p>H<sub>2</sub>O of {i} <q>said</q></p></article></body>") for i in range(100)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == f"Own words {i}" for i in range(1, 100)) and got[0].startswith("odd 0 odd 1 ")
    assert all(got[1000 + i] == f"H2O of {i} said" for i in range(100))


def entropy_by_hand(pages):
    """{(host, path): (pages, content)} of lists of html by host, copies of a page once."""
    out = {}
    for host, texts in pages.items():
        where = defaultdict(lambda: defaultdict(Counter))
        n = Counter()
        for k, t in enumerate(dict.fromkeys(texts)):
            for path, kind, value, c in html.style_nodes(t):
                if kind == 0:
                    n[path] += 1
                else:
                    where[path][value][k] += c
        for path, m in n.items():
            if m == 1:
                out[host, path] = (1, 1.0)
                continue
            mass = spread = 0
            for counts in where[path].values():
                total = sum(counts.values())
                spread += total * -sum(c / total * math.log(c / total, m) for c in counts.values())
                mass += total
            out[host, path] = (m, 1 - m / (m + html.PRIOR_PAGES) * (spread / mass if mass else 1))
    return out


def test_importance_by_hand(spark):
    """Hosts with boilerplate that is fixed, that varies in some words, and that varies as a whole."""
    pages = {
        "fixed.example": [f"<div class=top><a href=/x>Home</a> Site</div><div class=c><p>Own {i}. And {i * i}, more.</p></div><div class=low>All rights. Reserved</div>" for i in range(30)],
        "mixed.example": [f"<div class=low>Printed on day {i % 5}. All rights. Reserved. By us. In Rome</div><p>Text {i}</p>" for i in range(40)],
        "varied.example": [f"<div class=low>Number {i}</div><p>Text {i}</p><p>Again {i}</p>" for i in range(12)] + ["<div class=low>Number 1</div><p>x</p>"] * 9,
        "one.example": ["<div class=low>Alone</div>"],
    }
    rows = [(i, f"http://{h}/{i}", t) for h, ts in pages.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.host, r.path): (r.pages, r.content) for r in html.importances(df).collect()}
    want = entropy_by_hand(pages)
    assert set(got) == set(want)
    for k, (m, content) in want.items():
        assert got[k][0] == pytest.approx(m) and got[k][1] == pytest.approx(content, abs=1e-6)
    text = {(r.url.split("/")[2], r.page_id): r.text for r in html.extract(df).collect()}
    assert text["fixed.example", 3] == "Own 3. And 9, more."
    assert text["mixed.example", 7] == "Text 7"  # one word in twelve differs
    assert text["varied.example", 3] == "Number 3 Text 3 Again 3" and text["one.example", 0] == "Alone"


def test_nothing_is_lost_or_leaks():
    long = "İ" * 50  # longer in lower case
    assert html.main_text(f"<article><p>{long}</p><SCRIPT>var a='</p>'</Script><p>after</p><p>end</p></article>") == f"{long} after end"
    for depth in (20, 190, 250, 3000, 100_000):
        deep = "<div>" * depth
        assert html.main_text(f"<body>{deep}<nav>menu</nav><ul class=menu><li>item</ul><p>kept</p>{'</div>' * depth}<p>also</p></body>") == "kept also"
    assert html.main_text("<body><div class=ad data-u=/x/>BUY</div><p>kept</p></body>") == "kept"
    assert html.main_text("<article><section class='related-work'><p>Earlier</p></section><p class=legal>Law</p><div class='ad-slot'>Buy</div><div id=related>See also</div></article>") == "Earlier Law"
    for name in ("cookie-banner", "site-footer", "adSlot top", "social_share", "post-comments", "sidebar-left", "x newsletter-box", "breadcrumbs", "legal notice", "search-bar"):
        assert html.main_text(f"<body><div class='{name}'>noise</div><p>kept</p></body>") == "kept", name
    for name in ("adapter", "shareholders", "navy-blue", "related-work", "notice-period", "footnote", "story", "content main"):
        assert html.main_text(f"<body><div class='{name}'>more</div><p>kept</p></body>") == "more kept", name
    for name, gone in (("notice", True), ("comments", True), ("legal", False), ("discussion", False), ("search", False), ("related-posts", True)):
        assert html.main_text(f"<article><p>kept</p><div class={name}>inner</div></article>") == ("kept" if gone else "kept inner"), name
    assert html.main_text("<body><nav><h1>Site</h1></nav><h1>Title</h1><div>x</div><article><p>Body</p></article></body>") == "Title Body"
    assert html.main_text("<body><h1>Site</h1><article><h1>Title</h1><p>Body</p></article></body>") == "Title Body"
    assert html.main_text("<!--><p>kept</p><!-- <p>gone</p> --><ul><li><p>one<li>two</ul>") == "kept one two"
    assert html.main_text("<p>a &amp;lt; b&nbsp;&nbsp;c &#x41;</p><p>A<b>B</b>C</p>") == "a &lt; b c A ABC"


def test_hard_pages_take_linear_time():
    began = time.perf_counter()
    html.main_text("<b>" * 100_000 + "</x></i>" * 100_000 + "<p>" * 100_000)
    html.main_text("<ul>" + "<li><p>x" * 100_000)
    html.style_nodes("<div>" * 100_000 + "word " * 200_000)
    assert time.perf_counter() - began < 30


def test_odd_rows(spark):
    rows = [(1, None, None, "c"), (1, None, None, "c"), (None, "http://h/", "<p>x", "d"), (2, "http://h/", "<article>" + "<p>long text here. " * 30_000, "e"), (3, "nonsense", "", "f")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumns({"host": F.lit("clash"), "low": F.lit(1), "n_chars": F.lit("x")})
    out = html.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r.page_id, r.text, r.n_chars) for r in out.collect()), key=repr)
    assert [(1, "", 0)] * 2 == got[:2] and (None, "x", 1) in got and (3, "", 0) in got
    assert next(r for r in got if r[0] == 2)[2] == 30_000 * 16 - 1
    assert html.extract(df.limit(0)).count() == 0
