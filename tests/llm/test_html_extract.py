"""Main text of pages whose articles are known."""

from glossweave.llm.html_extract import extracted, main_text

LONG = "Some text, with commas. And more of it; yes, more."


def test_article():
    page = f"<html><head><title>T</title><script>var a='</p>'</script></head><body><nav><a>Menu</a></nav><div class='ad'>{LONG} {LONG}</div><article><h1>Head</h1><p>{LONG}<br>a &amp; b<p>x</article><footer>{LONG}</footer>"
    assert main_text(page) == f"Head\n{LONG} a & b\nx"


def test_no_article_element():
    page = f"<body><header>Site, name.</header><div id=main><div class=text><p>{LONG}</p><p>{LONG}</p><p>Hi</p></div></div><div class=sidebar>{LONG}</div><ul id=comments><li>{LONG}</ul><form>Name</form></body>"
    assert main_text(page) == f"{LONG}\n{LONG}\nHi"


def test_odd_pages():
    assert main_text("") == main_text("<p></p>") == main_text("<!-- x") == main_text("<script>alert(1)") == ""
    assert main_text("plain &lt;text&gt;\n  here") == "plain <text> here"
    assert main_text("<div>" * 5000 + "deep") == "deep"


def test_spark(spark):
    rows = [(1, "u", None, "x"), (2, None, "<p>a  b</p>", "y"), (2, None, "<p>a  b</p>", "y"), (None, "v", "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")
    got = extracted(pages).select("page_id", "main_text").collect()
    assert sorted(x.main_text for x in got) == ["", "", "a b", "a b"]
    assert extracted(pages.limit(0)).count() == 0


def test_text_beside_the_body():
    body = f"<p>{LONG}</p>" * 30
    page = f"<body><div class=top><h1>Head</h1></div><div class=lead>{LONG}</div><div class=story>{body}</div><div class=last><h2>End</h2><p>{LONG}</p></div><div class=x1>Go</div></body>"
    assert main_text(page) == "\n".join(["Head", *[LONG] * 31, "End", LONG])


def test_story_beside_teasers():
    teasers = "<article><h3>Teaser</h3><a href=/x>More on it</a></article>" * 4
    story = f"<p>{LONG} {LONG}</p>" * 5
    got = main_text(f"<body><div class=story>{story}</div><div>{teasers}</div></body>")
    assert got.startswith("\n".join([f"{LONG} {LONG}"] * 5))


def test_attributes_are_pairs():
    for a in ('style="overflow:hidden"', 'title="the hidden valley"', "data-role=menu data-id=nav", 'data-x="class=ad"'):
        assert main_text(f"<div {a}><p>{LONG}</p></div>") == LONG, a
    for a in ("hidden", "aria-hidden=true", "role='menu'", 'class="ad"', 'id="nav"'):
        assert main_text(f"<p>{LONG}</p><div {a}><p>{LONG}</p></div>") == LONG, a


def test_wrapper_with_a_noisy_name():
    story = f"<p>{LONG}</p>" * 5
    page = f"<div class='page with-sidebar'>{story}<div class=sidebar>{LONG}</div></div><div class=foot>x</div>"
    assert main_text(page) == "\n".join([LONG] * 5)


def test_paths_choose_in_articles():
    story = f"<p>{LONG} {LONG} {LONG}</p>" * 8
    more = "<div class=x7>Read more</div>" * 6
    points = "<ul><li>one<li>two</ul>"
    links = "<h3>Also</h3><ul><li><a>Its way</a><li><a>By day</a></ul>"
    got = main_text(f"<article><h1>Head</h1>{story}{points}{more}{links}</article>")
    assert got == "\n".join(["Head", *[f"{LONG} {LONG} {LONG}"] * 8, "one", "two"])
    assert main_text("<article><h1>Head</h1></article>") == "Head"


def test_names_in_articles():
    story = f"<p>{LONG} {LONG}</p>" * 6
    page = f"<article><div class='entry-header'><h1>Head</h1></div><section class='social-history'>{story}</section><div class='comment-list'>{story}</div></article>"
    assert main_text(page) == "\n".join(["Head", *[f"{LONG} {LONG}"] * 6])
    assert main_text(f"<div class='search-results'>{story}</div><div class='search-box'>{LONG}</div>") == "\n".join([f"{LONG} {LONG}"] * 6)
    assert main_text(f"<div class='site-header'>{LONG}</div>{story}") == "\n".join([f"{LONG} {LONG}"] * 6)


def test_ratios_are_plain_means():
    from glossweave.llm.html_extract import PRIOR, SMOOTH, nodes, ratios

    page = f"<article><p>{LONG}</p><p>Short</p><div class=x>{LONG} {LONG}</div><p>a, b</p></article><p>{LONG}"
    full = [(e, t) for e, _, t in nodes(page)]
    by_path = {}
    for e, t in full:
        by_path.setdefault(e.path, []).append((len(t), sum(t.count(c) for c in ".,;:!?")))
    raw = [[sum(x[j] for x in by_path[e.path]) / len(by_path[e.path]) for j in (0, 1)] for e, _ in full]
    fused = {}
    for i, (e, _) in enumerate(full):
        near = [raw[min(max(i + d, 0), len(raw) - 1)] for d in (-2, -1, 0, 1, 2)]
        length, marks = (max(raw[i][j], sum(w * x[j] for w, x in zip(SMOOTH, near, strict=True))) for j in (0, 1))
        fused.setdefault(e.path, []).append(length * (marks + 0.1))
    assert len(fused) == 3 and PRIOR > 1
    assert all(abs(ratios(full)[p] - sum(v) / len(v)) < 1e-9 for p, v in fused.items())


def test_deep_pages():
    import time
    import tracemalloc

    def peak(n):
        tracemalloc.start()
        assert main_text("<div class='ad-x main'>" * n + f"<p>{LONG}</p><p>{LONG}</p>" * 50) == "\n".join([LONG] * 100)
        out = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out

    assert peak(20_000) < 16 * peak(2_000)
    began = time.time()
    assert main_text("<span>" * 50_000 + "<hr></b>" * 50_000 + "x") == "x"
    assert time.time() - began < 20


def test_very_long_page():
    story = f"<p>{LONG}</p>" * 40_000
    assert main_text(f"<nav>Menu</nav><article>{story}</article>") == "\n".join([LONG] * 40_000)
