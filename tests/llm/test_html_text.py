"""Main text of pages: markup cases, host-wide repeats against brute force, odd rows."""

from mintweave.llm import html_text as H


def test_markup():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><header><h1>The &amp; title</h1><span>By me</span></header><p><b>One&nbsp;two <i>three</i>.<br><p>Second
      line &lt;b&gt;</p><ul><li>item one<li>item two</ul><div class="ad">Buy</div><form>Search <input></form>
      <div>text <div>inner</div> tail</div><table><tr><td>a<td>b<tr><td>c</table><section id="comments"><p>First!</p></section></article>
    <aside>Side</aside><footer>&copy; x</footer></body></html>"""
    found = [t for r, t in H.blocks_of(page) if r == H.CONTENT]
    assert found == ["The & title", "One two three.", "Second line <b>", "item one", "item two", "text", "inner", "tail", "a", "b", "c"]
    assert H.blocks_of(None) == H.blocks_of("") == []
    assert H.blocks_of("plain &eacute; text < 5") == [(H.REST, "plain é text < 5")]


def brute(pages):
    parsed = {i: H.blocks_of(h) for i, _, h in pages}
    out = {}
    streams = {i: [w for r, t in b if r != H.CONTENT for w in t.split()] for i, b in parsed.items()}
    host = {i: (u or "").split("//")[-1].split("/")[0] for i, u, _ in pages}
    whole = {i: [t for _, t in b] for i, b in parsed.items()}
    for i, b in parsed.items():
        if any(r == H.CONTENT for r, _ in b):
            out[i] = "\n".join(t for r, t in b if r == H.CONTENT)
            continue
        other = {tuple(streams[j][k:k + H.RUN]) for j in parsed if host[j] == host[i] and whole[j] != whole[i] for k in range(len(streams[j]) - H.RUN + 1)}
        hit = {k + d for k in range(len(streams[i]) - H.RUN + 1) if tuple(streams[i][k:k + H.RUN]) in other for d in range(H.RUN)}
        at, kept = 0, []
        for r, t in b:
            words = t.split()
            own = [w for k, w in enumerate(words, at) if k not in hit]
            at += len(words)
            if r == H.REST and own:
                kept.append(" ".join(own))
        out[i] = "\n".join(kept)
    return out


def check(spark, pages):
    table = spark.createDataFrame([(i, u, h, "x", [1]) for i, u, h in pages], "page_id long, url string, html string, host string, roles array<int>")
    got = {r["id"]: r for r in H.main_text(table).collect()}
    want = brute(pages)
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    return want


def test_repeats(spark):
    menu = "<div>Home About us Our products and services Contact the team today</div>"
    page = lambda k: f"<body>{menu}<div>u{k}a u{k}b u{k}c words u{k}d u{k}e u{k}f</div><div>All rights reserved by the owner of site</div></body>"
    pages = [(k, f"https://a.org/{k}", page(k)) for k in range(5)] + [(9, "https://a.org/copy", page(1)), (10, "https://b.org/1", page(1)), (11, None, None), (12, "https://a.org/e", ""), (13, "https://a.org/z", f"<article><p>Kept {menu}</article>"), (14, "https://a.org/s", "<p>one</p>" * 3000)]
    want = check(spark, pages)
    assert want[2] == "u2a u2b u2c words u2d u2e u2f"
    assert want[10].startswith("Home About")


def test_test_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()
    want = check(spark, [tuple(r) for r in rows])
    assert sum(bool(t) for t in want.values()) > 0.99 * len(want)


def test_empty(spark):
    assert H.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def content(page):
    return [t for r, t in H.blocks_of(page) if r == H.CONTENT]


def test_odd_declarations_lose_nothing():
    assert [t for _, t in H.blocks_of("<p>a</p><![foo[bar]]><p>b</p>")] == ["a", "b"]
    assert [t for _, t in H.blocks_of("<![ if x]><p>b</p>")] == ["b"]
    assert [t for _, t in H.blocks_of("<p>a</p><![CDATA[x]]><p>b</p><![endif")][:2] == ["a", "b"]


def test_wrappers_do_not_swallow_the_article():
    assert content('<div class="layout has-sidebar"><article><p>x</p></article></div>') == ["x"]
    assert content('<form id="aspnetForm"><nav>menu</nav><main><p>x</p></main></form>') == ["x"]
    assert content('<article><div class="post-banner-free"><p>x</p></div></article>') == ["x"]
    assert content('<article><div class="article-header"><h1>Title</h1><span>by me</span></div><p>x</p></article>') == ["Title", "x"]
    assert content('<article><div class="left-sidebar"><p>no</p></div><section class="comments-area"><article><p>no</p></article></section><p>x</p></article>') == ["x"]
    assert content('<article><p>x</p></article><div class="related-posts"><article><p>no</p></article></div><aside><article>no</article></aside>') == ["x"]
