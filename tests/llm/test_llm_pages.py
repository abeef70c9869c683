"""Page operators on small hand-made tables."""

import html
import re

from steadypace.llm.pages import host_wrappers, main_text
from steadypace.llm.urls import judge_urls
from steadypace.llm.wrappers import align, combine, extract, is_aside, own_text, parse, region, wrapper_of
from steadypace.llm.queries import ORACLE, URL_RULES, op10_urls
from pyspark.sql import functions as F

PAGE = ('<html><head><title>t</title><script>if (a<b) "</p>"</script></head><body><header>Site</header><nav><ul><li>'
        '<a>m</a></li><li><a>n</a></li></ul></nav><div class="{box}"><h1>Head {i}</h1><p>Some <b>bold</b>ness {i} &amp; '
        'more&nbsp;text<br>here<p>second {i}<div class="ad-box">buy</div>{extra}</div>'
        '<section id="comments"><p>nice {i}</p></section><footer>&copy;</footer></body></html>')


def test_urls_by_rule(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    urls = ["http://A.net/x", "https://b.example.net/en/1?q", "https://example.net/en", "ftp://example.com/de/",
            "http://xexample.com/de/", "http://x.org/fr/#a", "http://x.org/fr", None, "nothing", "http://", "a://b://c/d",
            "http://net/", "http://net?x://y/", "http://a.net/x"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)],
                                  "page_id long, url string, html string, rule string")
    found = {r["page_id"]: tuple(r)[1:] for r in judge_urls(pages, rules).collect()}
    assert found[0] == ("a.net", "/x", "net/", "block")
    assert found[1] == ("b.example.net", "/en/1", "example.net/en/", "allow")
    assert found[2] == ("example.net", "/en", "net/", "block")
    assert found[3] == ("example.com", "/de/", "example.com/de/", "block")
    assert found[4] == ("xexample.com", "/de/", None, "allow")
    assert found[5] == ("x.org", "/fr/", "org/fr/", "allow")
    assert found[6] == ("x.org", "/fr", None, "allow")
    assert found[7] == found[8] == found[9] == ("", "", None, "allow")
    assert found[10] == ("b:", "//c/d", None, "allow")
    assert found[11] == ("net", "/", "net/", "block")
    assert found[12] == ("net", "", None, "allow")
    assert found[13] == found[0]
    assert judge_urls(pages.where("false"), rules).count() == 0
    assert judge_urls(pages, rules.where("false")).where("verdict = 'allow'").count() == len(urls)


def test_alignment_finds_slots_options_and_repeats():
    a, b = (wrapper_of(parse(x)) for x in ("<div><p>x</p><p>y</p><h2>same</h2></div>",
                                            "<div><p>x</p><h2>same</h2><table><tr><td>1</table></div>"))
    div = align(a[2], b[2])[0]
    assert [(c[0], c[1]) for c in div[2]] == [("p", "+"), ("h2", "1"), ("table", "?")]
    assert div[2][0][2][0][2] is None and div[2][1][2][0][2] is not None
    assert region([2, ["", "1", [div], 9, 2]])[0] in ([], ["div"])


def test_main_text_without_frame(spark):
    rows = [(i, f"http://h.org/{i}", PAGE.format(box="content", i=i, extra="<p>third</p>" if i % 2 else ""))
            for i in range(40)]
    rows += [(100, "http://h.org/x", None), (101, "http://h.org/y", ""), (102, None, "<p>only &lt;this"),
             (103, "http://h.org/z", "<body><article>odd one</article><aside>no</aside></body>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(40)
    found = {r["page_id"]: r["text"] for r in main_text(pages.withColumn("text", F.lit("clash"))).collect()}
    for i in range(40):
        assert found[i] == f"Head {i} Some boldness {i} & more text here second {i}" + " third" * (i % 2)
    assert found[100] == found[101] == "" and found[102] == "only <this" and found[103] == "odd one"
    assert host_wrappers(pages.withColumn("host", F.lit("h"))).count() == 1
    assert main_text(pages.where("false")).count() == 0


def test_generated_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    expected = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        body = re.sub(r"<br>|</?p>|</?h1>", " ", body).replace("<b>", "").replace("</b>", "")
        expected[r["page_id"]] = " ".join(html.unescape(body).split())
    assert {r["page_id"]: r["text"] for r in main_text(pages).collect()} == expected


def test_urls_equal_sql(spark, folder, tmp_path):
    import duckdb

    odd = ["http://A.net/x", "https://b.example.net/en/1?q", "ftp://EXAMPLE.com/de/", "http://xexample.com/de/",
           "http://x.org/fr/#a", "http://x.org/fr", None, "nothing", "http://", "http://net?x://y/", "http://.net/",
           "http://a.example.net/en/\n/é"]
    spark.createDataFrame(list(enumerate(odd)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    for place, files in ((folder, "pages.parquet"), (str(tmp_path), "pages.parquet/*.parquet")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{place}/{files}'")
        expected = con.execute(ORACLE["op10_urls"]).fetchall()
        found = op10_urls(spark, place).select("page_id", "host", "path", "rule", "verdict").collect()
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def texts_of(spark, pages):
    """Main texts of pages of one host, in their order."""
    rows = [(i, f"http://h.org/{i}", page) for i, page in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return [r["text"] for r in sorted(main_text(frame).collect(), key=lambda r: r["page_id"])]


def test_template_text_of_articles_stays(spark):
    copy = "<body><nav><a>m</a></nav><article><h1>T</h1><p>body</p></article></body>"
    assert texts_of(spark, [copy] * 100) == ["T body"] * 100
    shared = "<body><article><h1>Series</h1><h2>Summary</h2><p>body {}</p></article></body>"
    for n in (19, 20, 60):
        assert texts_of(spark, [shared.format(i) for i in range(n)]) == [f"Series Summary body {i}" for i in range(n)]


def texts_by_wrapper(pages):
    """Texts by the region of the pages' wrapper, without Spark."""
    trees = [parse(page) for page in pages]
    total = None
    for tree in trees:
        new = [1, wrapper_of(tree)]
        total = new if total is None else combine(total, new)
    place = region(total)
    return [extract(tree, *place) for tree in trees]


def test_the_region_holds_all_of_the_article():
    frame = "<html><body><header>Site</header><nav>m</nav><div class=brand>Name</div>{}<footer>f</footer></body></html>"
    two = ("<main><h1>Title {i}</h1><p>lead {i}</p><article class=a><p>" + "long {i} " * 9 + "</p></article>"
           "<article class=b><p>rest {i}</p></article></main>")
    lead = ("<h1>Title {i}</h1><div class=lead>lead {i}</div><div class=content><p>one {i}</p><aside>no</aside>"
            "<p>two {i}</p></div>")
    for n in (1, 3, 30):
        pages = [frame.format(two.format(i=i)) for i in range(n)]
        expected = [f"Title {i} lead {i} " + f"long {i} " * 9 + f"rest {i}" for i in range(n)]
        assert [t.removeprefix("Name ") for t in texts_by_wrapper(pages)] == expected
        assert texts_by_wrapper(["<body>" + lead.format(i=i) + "</body>" for i in range(n)]) == [
            f"Title {i} lead {i} one {i} two {i}" for i in range(n)]
    assert not any(t.startswith("Name") for t in texts_by_wrapper([frame.format(two.format(i=i)) for i in range(3)]))
    beside = "<body><article><p>a {i}</p></article><section><h2>b {i}</h2><div>c {i}</div></section></body>"
    assert texts_by_wrapper([beside.format(i=i) for i in range(3)]) == [f"a {i} b {i} c {i}" for i in range(3)]


def test_names_that_are_no_asides():
    for label in ("body has-sidebar", "body no-sidebar", "html menu", "main with-menu", "article comments-open post",
                  "div ad-free content", "p notice-date", "div no-comments", "div content", "article comment"):
        assert not is_aside(label), label
    assert is_aside(parse("<div id=comments class=x>t</div>")[1][0][0])
    for label in ("div ad-box", "div sidebar", "div sidebar-left", "section comments", "div site-footer", "div main-menu",
                  "div ad-", "ul comment-list", "div cookie-banner", "div post-comments", "nav x", "article @hidden"):
        assert is_aside(label), label
    page = ("<html><body class='has-sidebar'><main class='with-menu'><article class='post comments-open'><h1>T {i}</h1>"
            "<div class='ad-free content'>one</div><p class='notice-date'>two</p><div class='ad'>no</div></article></main>"
            "<div class='sidebar'>no</div></body></html>")
    assert texts_by_wrapper([page.format(i=i) for i in range(3)]) == [f"T {i} one two" for i in range(3)]
    assert own_text(parse("<body><div class=notice>only this</div><nav>no</nav></body>")) == "only this"
    assert own_text(parse("<body><nav>no</nav></body>")) == ""


def test_wrappers_do_not_grow_with_the_pages_of_a_host(spark):
    def slug(i):
        return "".join(chr(97 + int(c)) for c in str(7919 * i + 10**6))

    def page(i):
        blocks = "".join(f"<{t} class='c{slug(i)}'>{t} {i}</{t}>" for t in ("p", "ul", "h2", "pre")[i % 3:] * (1 + i % 30))
        return (f"<body><div class='top'>Name</div><article id='{slug(i)}' class='post x-{slug(i)}'><h1>T {i}</h1>{blocks}"
                "</article></body>")

    def pages(n):
        return spark.createDataFrame([(i, f"http://h.org/{i}", page(i)) for i in range(n)],
                                     "page_id long, url string, html string").repartition(4)

    for n in (500, 5000):
        assert len(host_wrappers(pages(n).withColumn("host", F.lit("h"))).first()["wrapper"]) < 6_000
    for r in main_text(pages(5000)).collect():
        i = r["page_id"]
        rest = [f"{t} {i}" for t in ("p", "ul", "h2", "pre")[i % 3:] * (1 + i % 30)]
        assert r["text"] == " ".join([f"T {i}", *rest])


def test_very_deep_pages(spark):
    n = 100_000
    deep = "<div>" * n + "<h1>Deep</h1><p>first<p>second <b>bold</b>ness<aside>no</aside>" + "</div>" * n + "<p>last</p>"
    mixed = "".join(f"<div class=d{i % 3}>a{i} " for i in range(3000)) + "<nav>no</nav>end"
    closers = "<section>" * 5000 + "x" + "</b></i></section>" * 5000
    rows = [(1, "http://d.org/1", f"<body>{deep}</body>"), (2, "http://e.org/2", mixed), (3, "http://f.org/3", closers),
            (4, "http://d.org/4", "<body><div><p>short</p></div></body>"), (5, None, "<b>" * n + "bold")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    assert found[1] == "Deep first second boldness last"
    assert found[2] == " ".join(f"a{i}" for i in range(3000)) + " end"
    assert found[3] == "x" and found[4] == "short" and found[5] == "bold"


def test_formulas_fallbacks_and_quotes():
    text = lambda page: own_text(parse(page))
    assert text("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> here") == (
        "Energy is E=mc2 here")
    assert text("<p>a <math><semantics><mi>x</mi><annotation encoding='tex'>\\x</annotation></semantics></math> b") == "a x b"
    assert text("<p>a</p><object data=x>the fallback</object><p>b</p>") == "a the fallback b"
    assert text("<p>a</p><svg><title>t</title><path d=m><text>drawn</text></svg><p>b</p>") == "a drawn b"
    assert text("<p title=don't>Hello</p> <p title='a>b' x=\"c>d\">there</p>") == "Hello there"
    assert text("<p data-x=\"open>Hello <i a='b'>x</i></p>") in ("Hello x", "x")
    assert text("<a href=http://x.org/it's>link</a> <p class = \"k\">y") == "link y"
