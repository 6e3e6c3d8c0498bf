"""Main text of pages: planted pages, the site style tree, and awkward markup."""

import math
import time
from collections import Counter

from pyspark.sql import functions as F

from rasterloom.llm import site_style as S

from .conftest import SF, by_id


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(spark, *sources, url="http://a.example/"):
    found = by_id(S.extract(frame(spark, [(i, url, h) for i, h in enumerate(sources)])).withColumnRenamed("page_id", "doc_id"))
    return [found[i].text for i in range(len(sources))]


def test_markup(spark):
    assert texts(
        spark,
        "<p>One &amp; two&nbsp;three<p>four <b>bo</b>ld<br>x",
        "<article><h1>Title</h1><p>Body\n  text.</p><aside>no</aside></article><p>outside</p>",
        "<nav>menu</nav><header>top</header><div>kept</div><footer>foot</footer><script>var x = '<p>no</p>';</script><style>p{}</style>",
        "<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>",
        "<!-- no --><div class='cookie-notice'>no</div><form>no<input></form><div hidden>no</div>yes",
        "plain text &lt;b&gt; &#233; &#x1F642; &unknown;",
        "<div>unclosed <span>inner</div><p>next",
        "",
        None,
        "<",
        "<div class=comments><p>reader</p></div><main><p>said</p></main>",
        '<p>Hello <span class="ad">BUY</span> world</p>',
        "<p>one <svg/>two <svg><path d='x'/><text>no</text></svg>three<script>no()</script> four</p><math/>five",
        "<p>a<noscript><p>no</p></noscript>b</p>",
        "<article><p class=byline>By me</p><div class=recommended-dose>Two a day</div><p>See <a class=tags>tags</a>, <i class=privacy>privacy</i>.</p></article>",
        "<div class='ad-slot top'>no</div><div class=adHoc>yes</div><div id=ad-12>no</div><p>end<button>no</button>",
    ) == [
        "One & two three\nfour bold x",
        "Title\nBody text.",
        "kept",
        "one\ntwo\na\nb\nc",
        "yes",
        "plain text <b> é 🙂 &unknown;",
        "unclosed inner\nnext",
        "",
        "",
        "<",
        "said",
        "Hello world",
        "one two three four\nfive",
        "a\nb",
        "By me\nTwo a day\nSee tags, privacy.",
        "yes\nend",
    ]


def entropy(values):
    """By the definition, with logarithms to the base of the number of pages."""
    m = len(values)
    return 1.0 if m == 1 else -sum(values.count(v) / m * math.log(values.count(v) / m, m) for v in set(values))


def test_importance_by_hand(spark):
    """A small site: each node's presentation and content over the distinct pages."""
    sites = []
    for i in range(8):
        items = "".join(f"<li>go {k}</li>" for k in range(1 + i % 3))
        sites.append((f"<ul>{items}</ul><div class=k>same</div><div class=v><p>text {i}</p></div><div class=p>{i % 2}</div>", [f"go {k}" for k in range(1 + i % 3)], str(i), str(i % 2)))
    pages = [(i, "http://h.example/x", h) for i, (h, *_) in enumerate(sites)] + [(99, "http://h.example/y", sites[0][0])]  # a copy counts once
    found = Counter((r.pages, r.once, round(r.presentation, 6), round(r.content, 6)) for r in S.importance(frame(spark, pages)).collect())
    lists = [" ".join(x) for _, x, *_ in sites]
    varied, twos = [v for *_, v, _ in sites], [w for *_, w in sites]
    expected = [
        (entropy(lists), entropy([*zip(lists, varied, twos, strict=True)]), True),  # the root
        (entropy(lists), entropy(lists), True),  # ul
        (entropy(lists), entropy(lists), False),  # li: one to three on a page
        (0.0, 0.0, True),
        (0.0, entropy(varied), True),
        (0.0, entropy(varied), True),
        (0.0, entropy(twos), True),
    ]
    assert found == Counter((8, once, round(p, 6) + 0.0, round(c, 6) + 0.0) for p, c, once in expected)


def test_low_importance_branches_go(spark):
    """What all pages of a host say alike goes, where no name gives it away; on few pages nothing is known."""
    page = "<div class=q><section><p>Always the same words</p><p>and more</p></section></div><div class=r>Text number {}</div>"
    many = texts(spark, *(page.format(i) for i in range(6)))
    assert many == [f"Text number {i}" for i in range(6)]
    few = texts(spark, *(page.format(i) for i in range(3)))
    assert few == [f"Always the same words\nand more\nText number {i}" for i in range(3)]
    nowhere = texts(spark, *(page.format(i) for i in range(6)), url=None)
    assert nowhere == [f"Always the same words\nand more\nText number {i}" for i in range(6)]


def test_entropy_decides_inside_articles_and_copies_stay(spark):
    page = "<article><h1>Title {0}</h1><p>Body {0}</p><div class=x><p>Read our best stories</p></div></article>"
    assert texts(spark, *(page.format(i) for i in range(8))) == [f"Title {i}\nBody {i}" for i in range(8)]
    # the same place with words that differ has importance
    other = [page.format(i).replace("best stories", f"{'story book poem film'.split()[i % 4]} {i}") for i in range(8)]
    assert texts(spark, *other) == [f"Title {i}\nBody {i}\nRead our {'story book poem film'.split()[i % 4]} {i}" for i in range(8)]
    # copies of one article are one page, and nothing is known from one page
    assert texts(spark, *[page.format(7)] * 9) == ["Title 7\nBody 7\nRead our best stories"] * 9


def varied(i, tag):
    """A page whose frame no name tells: everything differs on each page, but only one branch is built differently."""
    body = "".join(f"<p>Paragraph {k} of {i}.</p>" + "<ul><li>x</ul>" * (k % 3 == i % 3) for k in range(1 + i % 7))
    links = "".join(f"<li><a>Link {i} {k}</a></li>" for k in range(5))
    return f"<body><div><ul>{links}</ul></div><div class=z>Sold {i} today</div><{tag}><h2>Head {i}</h2>{body}</{tag}><div class=w>Rights {i}</div></body>"


def test_the_frame_is_found_by_presentation(spark):
    with_name = texts(spark, *(varied(i, "article") for i in range(21)))
    assert all("Link" not in t and "Sold" not in t and f"Head {i}" in t for i, t in enumerate(with_name))
    assert texts(spark, *(varied(i, "section") for i in range(21))) == with_name
    few = texts(spark, *(varied(i, "section") for i in range(3)))
    assert all("Link" in t and "Sold" in t for t in few)


def test_real_pages_are_decided_by_the_tree(spark):
    """With the article elements renamed to plain ones, hosts of many pages keep their texts."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    tree = S.importance(pages)
    hosts = {r.host for r in S.decisions(tree).where("size(carrying) > 0").collect()}
    assert hosts and tree.where("path != 0 and pages > 5").count() > 50
    renamed = pages.withColumn("html", F.regexp_replace("html", "(</?)article", "$1section"))
    one, two = (by_id(S.hosts(S.extract(p)).withColumnRenamed("page_id", "doc_id")) for p in (pages, renamed))
    known = [i for i, r in one.items() if r.host in hosts]
    assert len(known) > 40 and all(one[i].text == two[i].text for i in known)


def test_long_pages(spark):
    """Pages above one slice."""
    page = "<nav>no</nav><article>" + "<p>Word after word after word.</p>" * 60_000 + "</article>"
    assert texts(spark, page, "<p>x</p>")[0].count("\n") == 59_999


def test_a_hot_host_and_repeated_rows(spark):
    page = "<div class=q>Always the same words</div><article><p>Copied article</p></article>"
    found = S.extract(frame(spark, [(i % 5, "http://a.example/", page) for i in range(300)]))
    assert found.count() == 300 and {(r.text, r.n_chars) for r in found.collect()} == {("Copied article", 14)}


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = by_id(S.extract(pages).withColumnRenamed("page_id", "doc_id"))
    assert len(found) == pages.count()
    for p in pages.collect():
        r = found[p.page_id]
        assert r.n_chars == len(r.text) and r.url == p.url
        lines = r.text.split("\n")
        assert all(x == " ".join(x.split()) for x in lines)
        assert p.html is None or not p.html.strip() or r.text


def test_empty_and_clashing(spark):
    pages = frame(spark, [(1, "http://a.example/", "<p>x</p>"), (None, None, None)])
    assert S.extract(pages.where("false")).count() == 0
    clashing = pages.selectExpr("*", "'h' as host", "1 as path", "'t' as text", "array(1) as low", "2 as n_chars")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in S.extract(clashing).collect()) == [(0, "", 0), (1, "x", 1)]


def test_names_spare_articles():
    text = lambda source: S.Page(source).text()
    assert text('<article class="long-form"><p>one</p></article>') == "one"
    assert text('<div class="layout has-sidebar banner"><article>one</article></div><div class=sidebar>no</div>') == "one"
    assert text('<p class="comment-on-policy">a</p><section id="notice-of-meeting">b</section>') == "a\nb"
    assert text("<article>said</article><div id=comments><article class=comment-body>no</article></div>") == "said"
    assert text('<article class="post comment">only</article>') == "only"
    assert text("<footer><article>no</article></footer><p>yes</p>") == "yes"


def test_broken_tags_and_deep_pages_end():
    """A megabyte of unclosed quotes and 100,000 nested blocks are read in time that grows with them."""
    began = time.perf_counter()
    assert S.Page('<p title="x>y</p><p>z</p>').text() == "y\nz"
    for source in ("<a '" * 250_000, "<a<b" * 200_000, "<div>x" * 100_000, "<div>" * 50_000 + "</p>" * 50_000, "<b>" * 50_000 + "</i>" * 50_000 + "<p>end"):
        page = S.Page(source)
        page.tree()
        page.text(frozenset([1]))
    assert time.perf_counter() - began < 60


def test_subtree_hashes_follow_structure_and_text():
    one = S.Page("<div><p>a</p><ul><li>b</ul></div><div><p>a</p><ul><li>b</ul></div>")
    own, tree = one.tree()
    assert own == S.Page("<div><p>a</p><ul><li>b</ul></div><div><p>a</p><ul><li>b</ul></div>").tree()[0]
    sub = lambda source: S.Page(source).tree()[1]
    path = S.Page("<div></div>").nodes[1][1]
    assert sub("<div><p>a</p><p>b</p></div>")[path][0] == sub("<div><p>c</p><p>d</p></div>")[path][0] != sub("<div><p>c</p><ul>d</ul></div>")[path][0]
    assert sub("<div><p>a</p><p>b</p></div>")[path][1] == sub("<div><p>a</p><b>b</b></div>")[path][1] != sub("<div><p>a</p><p>c</p></div>")[path][1]
    assert sub("<div><p>a<ul>b</ul></div>")[path][0] != sub("<div><p>a<ul><p>b</ul></div>")[path][0]
    assert tree[path][2] is False
