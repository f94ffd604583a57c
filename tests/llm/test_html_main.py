"""Main text: the given pages by a plain reading of their article, and other templates."""

import html as html_lib
import re
import time

from plumbline.llm import html_main
from plumbline.llm.queries import op10_html_extraction
from plumbline.sources.tables import load


def plain(page):
    """For pages whose article element holds headings and paragraphs only."""
    body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    parts = re.split(r"</?(?:p|h1)\b[^>]*>", body[1]) if body else []
    texts = [" ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_given_pages(spark, sf_dir):
    html = {r.page_id: r.html for r in load(spark, sf_dir, "pages").collect()}
    rows = op10_html_extraction(spark, sf_dir).collect()
    assert len(rows) == len(html)
    for r in rows:
        assert r.text == plain(html[r.page_id]) and r.n_chars == len(r.text)


def alone(page):
    return html_main.extract(page)


TEXT = "A sentence of the article that has some length. "


def test_what_is_beside_the_article_goes():
    page = f"""<!doctype html><head><title>t</title><script>if (a<b) "<p>no</p>"</script></head>
    <body class="home"><header><h2>Site</h2></header><div class="cookie-notice"><p>We use cookies</p></div>
    <nav><ul><li><a href=/>Home</a></ul></nav><div id=sidebar><p>{TEXT * 9}</div>
    <div class="content"><h1>Title &amp; more</h1><p>{TEXT}<a href="x">link</a> end<p>Two&nbsp;parts<br>here &#233;
    <ul><li>one<li>two <b>bold</b></ul><div class="advert">Buy</div><!-- <p>hidden</p> -->
    <blockquote>quoted</blockquote><table><tr><td>x<td>y</table><form><p>field</p></form></div>
    <section id="comments"><h3>Replies</h3><div class="comment"><p>{TEXT * 30}</p></div></section>
    <div hidden>gone</div><footer>foot</footer><aside>more</aside>"""
    assert alone(page) == "\n".join(
        ["Title & more", f"{TEXT}link end", "Two parts here é", "one", "two bold", "quoted", "x", "y"]
    )


def test_header_inside_the_article_stays():
    page = f"<main><article><header class='entry-header'><h1>Head</h1></header><p>{TEXT}</p></article></main>"
    assert alone(page) == f"Head\n{TEXT.strip()}"


def test_headline_beside_the_body_stays():
    inner = f"<h1>Head</h1><div class='body'><p>{TEXT * 3}</p><p>End</p></div>"
    text = f"Head\n{(TEXT * 3).strip()}\nEnd"
    assert alone(f"<main><article class='x'>{inner}</article><p>other</p></main>") == text
    assert alone(f"<body><div class='content'>{inner}</div><div class='extra'><p>no</p></div>") == text


def test_sections_without_an_article_stay_together(spark):
    one, two, three = (f"{name} " + TEXT * n for name, n in (("One", 12), ("Two", 5), ("Three", 3)))
    parts = [f"<section class='{c}'><p>{t}</p></section>" for c, t in zip(("intro", "more", "end"), (one, two, three))]
    whole = "\n".join(t.strip() for t in (one, two, three))
    side = "<nav><ul><li>Home</ul></nav>", "<div class='extra'><p>no</p></div><footer>foot</footer>"
    post = f"<body>{side[0]}<div class='post'>{''.join(parts)}</div>{side[1]}"
    wrapped = f"<body>{side[0]}<div class='post'>{''.join(f'<div><div>{p}</div></div>' for p in parts)}</div>{side[1]}"
    lead = f"<div class='lead'><p>{two}</p></div><div class='text'><p>{one}</p></div>"
    led = f"{two.strip()}\n{one.strip()}"
    for page in (post, wrapped, post.replace("<body>", "")):
        assert alone(page) == whole, page
    for page in (f"<body>{side[0]}{lead}<footer>f</footer>", lead, f"<body><div class='a'>{lead}</div>{side[1]}"):
        assert alone(page) == led, page
    assert alone(f"<body><main>{lead}</main><div class='x'><p>{three}</p></div>") == led
    pages = spark.createDataFrame([(k, f"http://h/{k}", post) for k in range(4)], "page_id bigint, url string, html string")
    assert {r.text for r in html_main.main_text(pages).collect()} == {whole}


def test_cut_and_odd_pages():
    assert alone("") == "" and alone("   ") == ""
    assert alone("only text") == "only text"
    assert alone(f"<article><p>{TEXT}<!-- cut") == TEXT.strip()
    assert alone(f"<article><p>{TEXT}<a href='x") == TEXT.strip()
    assert alone("a < b &amp;amp; c > d &lt;p&gt;") == "a < b &amp; c > d <p>"
    assert alone("</p></div><p>x</b></p>") == "x"
    assert alone("<nav>only a menu</nav>") == ""
    assert len(alone("<article>" + f"<p>{TEXT}</p>" * 20_000).split("\n")) == 20_000
    assert alone("<div>" * 3000 + "deep") == "deep"


def test_names_that_tell_about_side_parts():
    """Class words are no reason to leave out an element that holds the article."""
    post, text = f"<h1>Head</h1><p>{TEXT * 3}</p>", f"Head\n{(TEXT * 3).strip()}"
    side = f"<div class='sidebar'><p>{TEXT * 2}</p></div><footer>foot</footer>"
    for page in (
        f"<body><div class='site has-sidebar'><div class='post'>{post}</div>{side}</div>",
        f"<body><div class='no-sidebar'><article>{post}</article></div>{side}",
        f"<body><div class='post share-enabled'>{post}</div>{side}",
        f"<body><div class='legal-text'>{post}</div>{side}",
        f"<body><main><div class='ad-free'>{post}</div></main>{side}",
        f"<body><div class='layout-sidebar'><main>{post}</main>{side}</div>",
        f"<body><div class='modal-content'><article>{post}</article>{side}</div>",
        f"<body><form id='aspnetForm'><div class='post'>{post}</div>{side}</form>",
        f"<body><div class='widget w-1/2'><div class='post'>{post}</div></div>{side}",
        f"<body class='menu sidebar'><article class='comments ad'>{post}</article>{side}",
    ):
        assert alone(page) == text, page


def test_side_parts_by_name():
    post, text = f"<h1>Head</h1><p>{TEXT * 3}</p>", f"Head\n{(TEXT * 3).strip()}"
    for name in (
        "ad", "ad-slot", "siteFooter", "site-footer", "sidebar-left", "primary-menu", "cookieNotice",
        "nav-bar", "related-posts", "social-links", "top x ad", "ads_300", "footer-2",
    ):
        for article in (f"<article>{post}</article>", f"<div class='post'>{post}</div>"):
            page = f"<body>{article}<div class='{name}'><p>Beside</p></div>"
            assert alone(page) == text, page
            assert alone(page.replace("class='" + name, "id='" + name)) == text, page
    # Reader comments go, also in articles of their own and with more text than the article.
    replies = f"<div id='comments'><ol class='comment-list'><li><article class='comment-body'><p>{TEXT * 40}</p></article></ol></div>"
    for article in (f"<article>{post}</article>", f"<div class='post'>{post}</div>"):
        assert alone(f"<body>{article}{replies}") == text
        assert alone(f"<body>{article}<div class='related-posts'><article><p>{TEXT}</p></article></div>") == text
    assert alone(f"<body><p>{TEXT}Its <math><mi>x</mi></math> counts<span class='ad'>no</span>.</p>") == f"{TEXT}Its x counts."


def test_deeply_nested_pages_take_linear_time():
    def seconds(n):
        page = "<div>" * n + "<p>deep</p>" + "</section></div>" * n
        began = time.perf_counter()
        assert alone(page) == "deep"
        return time.perf_counter() - began

    seconds(100)
    assert min(seconds(16_000) for _ in range(3)) < 1


def test_hosts_agree_on_a_path(spark):
    """A page whose own best container is another one follows its host."""
    usual = "<body><div class='story s{0}'><p>" + TEXT * 3 + "</p></div><div class='extra'><p>short {0}</p></div>"
    odd = "<body><div class='story s99'><p>Brief.</p></div><div class='extra'><p>" + TEXT * 9 + "</p></div>"
    rows = [(k, f"http://h.net/{k}", usual.format(k)) for k in range(8)] + [(90, "http://H.net/odd", odd)]
    rows += [(91, "http://other.net/", odd), (92, None, None), (93, None, "<p>x</p>"), (94, "http://h.net/", "<article><p>Own way</p></article>")]
    rows += [(None, "http://h.net/n", usual.format(1))] * 2
    pages = spark.createDataFrame([(*r, "a", "b") for r in rows], "page_id bigint, url string, html string, host string, path string")
    got = html_main.main_text(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[0].text == (TEXT * 3).strip() and by[90].text == "Brief."
    assert by[91].text == (TEXT * 9).strip() and by[94].text == "Own way"
    assert by[92].text == "" and by[92].n_chars == 0 and by[93].text == "x"


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_main.main_text(pages).count() == 0
