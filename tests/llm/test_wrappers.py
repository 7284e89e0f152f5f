import html
import random

from tidewater.llm import wrappers

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href="/x">Menu</a></ul></nav><div class="ad">Buy</div><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>First  <b>bold</b>\n line<br>two<p>Second &lt;b&gt; x&#233;<aside>side</aside><ul><li>one<li>two</ul>
<form>Name <input></form><div class="comments"><p>Great post</p></div><p><b>Open<br><p>Last</article><footer>&copy; me</footer></body></html>"""
TEXT = "Title & more\nFirst bold line two\nSecond <b> xé\none\ntwo\nOpen\nLast"


def text_of(pages, which=0):
    found = wrappers.Wrapper(wrappers._fold(("h", wrappers.template(wrappers.parse(p))) for p in pages)["h"])
    path = found.path()
    return wrappers.main_text(wrappers.parse(pages[which]), path, set(found.dropped(path)))


def test_article_without_the_rest():
    assert text_of([PAGE]) == TEXT


def page(body, n):
    return f"<html><body><div class='top'>Welcome to our site, dear reader of these pages</div><div id='box'>{body}</div><div class='sidebar'>Ads {n}</div></body></html>"


def test_wrapper_finds_the_box_of_a_host_without_article():
    bodies = ["<p>" + f"Long text number {i} that fills the page. " * 5 + "</p>" + "<p>more</p>" * (i % 3) + ("<h2>x</h2>" if i % 2 else "") for i in range(6)]
    records = wrappers._fold(("h", wrappers.template(wrappers.parse(page(b, i)))) for i, b in enumerate(bodies))["h"]
    found = wrappers.Wrapper(records)
    assert [records[x][1] for x in found.path()] == ["#", "html", "body", "div.box"]
    order = records[found.path()[-1]][5]
    assert [["p"], 0] in order and [["h2"], 1] in order


def test_constants_of_a_host_go_and_slots_stay():
    """No names help here: the notice and the heading are the host's own because all pages have them."""
    body = lambda i: f"<div><p>Please accept all our biscuits before reading on, dear guest</p></div><h4>Read this</h4><section><p>Story {i} " + f"with words {i * i} " * 9 + f"</p><p>End {i}</p></section>"
    pages = [page(body(i), i) for i in range(4)]
    assert text_of(pages, 2) == "Story 2 " + "with words 4 " * 8 + "with words 4\nEnd 2"


def test_equal_pages_are_no_template():
    pages = [page("<p>The very same story at four places of a host</p>", 1)] * 4
    assert "very same story" in text_of(pages)


def test_names_of_outer_elements_do_not_drop_the_page():
    inner = "".join(f"<p>Sentence {i} of the story.</p>" for i in range(9))
    for outer in ("<body class='single no-sidebar'>{}</body>", "<body><div class='content has-sidebar with-comments'>{}</div></body>", "<body><div class='page-header-fixed'><article>{}</article></div></body>"):
        got = text_of([outer.format(inner.replace("story", f"story {k}")) + "<footer>f</footer>" for k in range(3)], 1)
        assert got == "\n".join(f"Sentence {i} of the story 1." for i in range(9))


def test_brute_force_on_generated_pages():
    """Pages whose blocks are known, from templates that differ by host in tags, names and order."""
    rng = random.Random(9)
    for host in range(30):
        wrap = rng.choice(["<article>{}</article>", "<main class='x{h}'>{}</main>", "<div id='c{h}'>{}</div>", "<div class='outer'><div class='entry'>{}</div></div>"]).replace("{h}", str(host))
        around = [f"<nav><ul><li>Home {host}</ul></nav>", "<aside>Side</aside>", "<div class='cookie-bar'>Cookies</div>", f"<div class='u{host}'>All rights of host {host} are kept by the host</div>", "<footer>Foot</footer>"]
        rng.shuffle(around)
        cut = rng.randrange(len(around) + 1)
        pages, wants = [], []
        for k in range(4):
            blocks = [f"Block {host} {k} {i} " + "ab & <c> é " * rng.randrange(1, 6) for i in range(rng.randrange(3, 9))]
            tags = [rng.choice(["p", "p", "h2", "blockquote", "pre"]) for _ in blocks]
            inner = "".join(f"<{t}>{html.escape(b)}</{t}>\n" for t, b in zip(tags, blocks, strict=True))
            if k % 2:
                inner += "<div class='comments'><p>Nice one, by a reader</p></div><form>Reply</form><script>var a='<p>no</p>';</script>"
            pages.append(f"<html><head><title>t{k}</title></head><body>{''.join(around[:cut])}{wrap.format(inner)}{''.join(around[cut:])}</body></html>")
            wants.append("\n".join(" ".join(b.split()) for b in blocks))
        for k in range(4):
            assert text_of(pages, k) == wants[k], (host, k)


def test_squash_and_merge():
    assert wrappers.squash(list("aabcbcd")) == [("a",), ("b", "c"), ("d",)]


def test_rows(spark):
    rows = [(1, "http://a.example/x", PAGE, 1), (1, "http://a.example/x", PAGE, 1), (2, None, None, 2), (3, "http://[bad", "", 3), (4, "http://b.example", "plain <", 4)]
    rows += [(5, "http://c.example/", "<p>" * 3000 + "deep" + "<a <b " * 2000, 5), (6, "http://d.example/", "<div>" * 5000 + "nested" + "</div>" * 4000, 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int").selectExpr("*", "'x' AS _host", "1 AS _path", "2 AS _c0")
    got = sorted((r.page_id, r.text) for r in wrappers.extract(pages).collect())
    assert got[:5] == [(1, TEXT), (1, TEXT), (2, ""), (3, ""), (4, "plain <")] and got[5][1].startswith("deep")
    assert got[6] == (6, "nested") and wrappers.extract(pages).columns == ["page_id", "url", "html", "_host", "_path", "_c0", "text"]
    assert wrappers.extract(pages.limit(0)).count() == 0
