"""Operator 12: round trips of generated pages, votes by brute force, and odd pages."""

import random
from collections import Counter
from html import escape

import pytest
from pyspark.sql import functions as F

from pairlab.llm import extraction
from pairlab.llm.pagetext import Page

PROSE = "The committee met on Tuesday and agreed, after some debate, that the bridge should be rebuilt in stone."
LINKS = "".join(f'<li><a href="/t{i}">Topic number {i}</a></li>' for i in range(8))


def page(body, n=1, title="A title", wrap=("<div class='post post-{n} entry'>", "</div>"), noise=1, comments=0):
    """A page of one template: everything but `body` is boilerplate."""
    said = "".join(f"<div class='c'><p>Reader {i}: I do not agree with a word of this, and my long reasons follow here.</p></div>" for i in range(comments))
    return f"""<!DOCTYPE html><html><head><title>{title}</title><style>p > a {{}}</style><script>if (a < b) document.write("</p><article>");</script></head>
<body class="single no-sidebar"><header class="site"><h1>The Site</h1></header><nav><ul>{LINKS}</ul></nav><!-- <article>old</article> -->
<div class="cookieNotice">We use cookies, and by reading on you agree to all of them, always.</div>
<div id="wrap"><div class="ad-slot">Buy now, while the offer lasts, and never pay for it again.</div>
{wrap[0].format(n=n)}{body}{wrap[1]}
<div class="sidebar-right"><p>{"About us: we write long sentences, so that you read them. " * noise}</p></div>
<div id="c{n}">{said}</div><form><label>Your name, please, and your address</label><input name="q"></form></div>
<noscript>Please switch on scripts, which this page needs to be read.</noscript><footer>&copy; The Site</footer></body></html>"""


def texts(spark, rows):
    got = extraction.extract(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = {r["page_id"]: r for r in got.collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    return {k: r["text"] for k, r in out.items()}


def test_articles_come_back_whole(spark):
    """Random blocks in three templates: what was put in comes out, to the character."""
    r = random.Random(12)
    wraps = [("<article>", "</article>"), ("<div class='post post-{n} entry'>", "</div>"), ("<main><section id=s{n}>", "</section></main>")]
    words = ["alpha", "beta & co", "<gamma>", "δέλτα", "“quoted”", "a b", "x < y", "R&D", "&amp;", "🙂", "it's"]
    rows, want = [], {}
    for k in range(60):
        blocks = [" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 9))]
        marked = []
        for b in blocks:
            shown = escape(b).replace(" ", r.choice([" ", "\n  ", "\t", "<br>", " <b>", "</b> "]))
            marked.append(r.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<ul><li>{}</ul>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>"]).format(shown))
        rows.append((k, f"http://h{k % 3}.example.org/{k}", page("\n".join(marked), k, wrap=wraps[k % 3])))
        want[k] = "\n".join(" ".join(b.split()) for b in blocks)
    assert texts(spark, rows) == want


def test_pages_of_a_host_overrule_a_page(spark):
    """A short article under a long sidebar is found by the template of its host, and not on a host of its own."""
    wrap = ("<div class='x y{n}'>", "</div>")
    long, short = f"<p>{PROSE}</p>" * 6, "<p>Short news.</p>"
    rows = [(k, "https://U@News.Example.com:8080/a", page(long, k, wrap=wrap)) for k in range(5)]
    rows += [(9, "http://news.example.com/b", page(short, 9, wrap=wrap, comments=9)), (10, "http://other.example.com/", page(short, 9, wrap=wrap, comments=9))]
    got = texts(spark, rows)
    assert got[0] == "\n".join([PROSE] * 6) and got[9] == "Short news."
    assert got[10] != "Short news."


def test_votes_and_winners_by_brute_force(spark):
    r = random.Random(5)
    rows = [(f"h{k % 4}", page(f"<p>{PROSE}</p>" * r.randint(1, 3), k, wrap=(f"<div class='t{r.choice('abc')}{k}'>", "</div>"), noise=0)) for k in range(40)]
    want = Counter((h, *Page(x).best()) for h, x in rows)
    cast = extraction.votes(spark.createDataFrame(rows, "host string, html string").repartition(5))
    assert {(x["host"], x["path"], x["depth"]): x["n"] for x in cast.collect()} == want
    winners = {x["host"]: x["paths"] for x in extraction.consensus(cast, 2).collect()}
    for h in winners:
        assert winners[h] == [p for p, d, n in sorted(((p, d, n) for (host, p, d), n in want.items() if host == h), key=lambda x: (-x[2], -x[1], x[0]))][:2]


def test_many_templates_fall_back_to_the_page(spark):
    """More templates than a host's list holds: each page is still read by its own best container."""
    tags = "abcdefghijklmnop"
    rows = [(k, "http://one.example.org/", page(f"<p>{PROSE} {t}</p>", k, wrap=(f"<div class='{t * 3}'>", "</div>"))) for k, t in enumerate(tags)]
    assert len(tags) > extraction.PATHS and texts(spark, rows) == {k: f"{PROSE} {t}" for k, t in enumerate(tags)}


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        ("plain text only", "plain text only"),
        ("<p>one<p>two<div>three", "one\ntwo\nthree"),
        ("<p>5 < 6 and 7 > 3 &lt;b&gt; &#8364;&nbsp;9 &eacute;", "5 < 6 and 7 > 3 <b> € 9 é"),
        ("<article><header><h1>Title</h1><p>by someone</p></header><p>Body.</p><div class='comments'><p>Nice.</p></div></article>", "Title\nBody."),
        ("<form action='/'><main><p>All of the page stands in a form.</p></main><input></form>", "All of the page stands in a form."),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<article><p>x</p><script>never ends <p>y</p>", "x"),
        ("<article><p>x</p><!-- never ends <p>y</p>", "x"),
        ('<article><p title="a > b">x <a href=/a?b=c>link</a> y</p></article>', "x link y"),
        ("</div></p><article></b><p>x</p></span></article>", "x"),
        ("<div role=navigation>menu</div><div itemprop=articleBody><p>x</p></div>", "x"),
        ("<article><p>x <span class='advert'>buy</span> y</p><figure><img alt=z><figcaption>seen</figcaption></figure></article>", "x y\nseen"),
        ("<article class='comment'><p>me too</p></article><article><p>x</p></article>", "x"),
        ("<ARTICLE><P>x</P></ARTICLE><FOOTER>y</FOOTER>", "x"),
    ],
)
def test_markup(html, want):
    assert Page(html).text([]) == want


def test_deep_and_long_pages_are_linear():
    deep = "<div>" * 20000 + "x" + "</div>" * 20000
    assert Page(deep).text([]) == "x"
    many = "<article>" + "<p>word</p>" * 30000 + "</article>"
    assert Page(many).text([]).count("\n") == 29999
    assert Page("<p a='" * 3000 + "x").text([]) is not None


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (None, "not a url", "<p>x"), (4, "http://h.example.org/", "<nav>only a menu</nav>"), (5, "http://h.example.org/", "<article>a</article>"), (5, "http://h.example.org/", "<article>a</article>")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").selectExpr("*", "'q' AS host", "1 AS path", "2 AS paths", "3 AS text", "4 AS n", "5 AS n_chars")
    got = sorted((tuple(r) for r in extraction.extract(df).collect()), key=repr)
    assert got == sorted([(1, None, "", 0), (2, "", "", 0), (None, "not a url", "x", 1), (4, rows[3][1], "", 0)] + [(5, rows[4][1], "a", 1)] * 2, key=repr)
    assert extraction.extract(df.limit(0)).count() == 0


def test_hosts(spark):
    urls = ["http://A.b.C/x", "https://u:p@h:80/", "//h/x", "h.org", "", None, "ftp://h?q", "http://h#x"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(extraction.host_of(F.col("u"))).collect()]
    assert got == ["a.b.c", "h", "", "", "", "", "h", "h"]
