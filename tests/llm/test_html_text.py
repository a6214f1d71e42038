import html
import math
import random
import re
from collections import defaultdict
from pathlib import Path

import pyarrow as pa

from parley.llm import html_text, scratch


def text(page):
    return html_text.main_text(page, set())


def test_parts():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header>Top</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad">Buy</div>
    <article><header><h1>A &lt;title&gt;</h1><p>by me</p></header><p>One <b>bold</b>
    two&nbsp;three<br>four<p>Five &copy; &#233;<ul><li>x<li>y</ul><aside>side</aside><form>f</form>
    <section id="comments"><article><p>reader</p></article></section><div class="cookie-notice">no</div></article>
    <footer>Foot</footer></body></html>"""
    assert text(page) == "A <title>\nby me\nOne bold two three four\nFive © é\nx\ny"


def test_unmarked_and_broken():
    assert text("") == "" and text("just words") == "just words"
    assert text("<p>a<p>b <i>c") == "a\nb c"
    assert text("<body><div>x<nav>m</nav>y</div>") == "x\ny"
    assert text("<p>cut &am") == "cut &am"
    assert text('<body class="has-sidebar"><p>a</p><div class="sidebar">b</div>') == "a"
    assert text("<p>cut <b") == "cut"
    assert text("<article><p>a</b></i></p>b</article>c") == "a\nb"
    assert text("<div " + "a='" * 2000 + ">x") is not None


def test_attributes_are_read_as_such():
    assert text('<article><p title="a > b" class=x>one</p><img alt="<p>no</p>">two</article>') == "one\ntwo"
    assert text('<div style="overflow:hidden"><p data-id="menu" data-note="class=ad">kept</p></div><p hidden>gone</p>') == "kept"
    assert text("<p title='5 > 4'>a</p><p title=\"open>b</p><p class='ad'>c</p>") == "a\nb"
    assert text("<script data-x='>'>var a</script><p>t</p>") == "t"
    assert text("<a " + '="' * 200_000) == "" and text("<p " + "= " * 200_000 + ">x") == "x"


def test_marks_drop_no_article():
    for name in ("post category-social", "post tag-search", "entry comments-open", "ad", "post notice"):
        assert text(f'<article class="{name}"><p>story</p></article>') == "story", name
        assert text(f'<article><p>one</p></article><article class="{name}"><p>two</p></article>') == "one\ntwo", name
    for name in ("container has-sidebar", "site-content no-sidebar", "sidebar", "widget comments", "overlay"):
        assert text(f'<div class="{name}"><div><article><p>story</p></article></div></div>') == "story", name
        assert text(f'<div class="{name}"><main><p>story</p><p class="ad">buy</p></main></div>') == "story", name
    assert text('<article><p>story</p><p class="site-footer">f</p><ul class="x share-buttons"><li>s</ul><p id="ad-box">b</p></article>') == "story"
    assert text('<article><p>story</p></article><section id="comments"><article class="comment"><p>reader</p></article></section>') == "story"


def test_class_words_that_may_name_a_part_of_a_story():
    for inner in (
        '<h2 class="section-header">a</h2>', '<section class="related-work">a</section>', '<p class="share-price">a</p>', '<p class="alert">a</p>', '<h2 class="related">a</h2>',
        '<header><h1>a</h1></header>', '<header><p class="standfirst">a</p></header>', '<div class="search">a</div>', '<section class="social">a</section>',
    ):
        assert text(f"<header>top</header><article>{inner}<p>story</p></article>") == "a\nstory", inner
        assert text(f"<main>{inner}<p>story</p></main><footer>x</footer>") == "a\nstory", inner
    for inner in ('<div class="ad">x</div>', '<ul class="share-buttons"><li>x</ul>', "<nav>x</nav>", '<header><h1>story</h1><nav>x</nav></header>', '<aside>x</aside>', '<div class="comments"><h3>x</h3></div>', '<p class="cookie-notice">x</p>'):
        assert "x" not in text(f"<article><p>story</p>{inner}</article>"), inner


def test_marks_leave_something():
    assert text('<div class="widget"><p>all there is</p></div>') == "all there is"
    assert text('<p>site</p><article><div class="social"><p>story</p></div></article>') == "story"
    assert text('<nav>menu</nav><div class="banner">headline</div>') == "headline" and text("<nav>menu</nav>") == ""


def test_articles_beside_the_main_text():
    assert text('<main><h1>Title</h1><p>long body</p><article class="card">teaser</article></main>') == "Title\nlong body\nteaser"
    assert text('<main><p>body</p></main><div><article class="card">teaser</article></div>') == "body\nteaser"
    assert text("<h1>Title</h1><p>a body much longer than the teaser</p><article>teaser</article>") == "Title\na body much longer than the teaser\nteaser"
    assert text("<p>site</p><article>a story longer than the rest</article>") == "a story longer than the rest"


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in html_text.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*(>|$)", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        wanted = "\n".join(b for b in blocks if b)
        assert got[r.page_id].text == wanted and got[r.page_id].n_chars == len(wanted) and got[r.page_id].url == r.url


def test_style_tree_drops_what_repeats(spark):
    pages = [
        (k, "http://site.com/x", f"<body><div class='top'>Same words everywhere</div><div class='story'><p>Story number {k} is its own</p></div></body>", 1)
        for k in range(12)
    ]
    pages += [(50, None, "<div>alone</div>", 1), (51, "odd url", None, 1), (52, "http://site.com/y", "<div class='top'>Same words everywhere</div>", 1)]
    pages += [(0, pages[0][1], pages[0][2], 1)]
    got = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text int"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == len(pages)
    by = {r.page_id: r.text for r in rows}
    assert all(by[k] == f"Story number {k} is its own" for k in range(12))
    assert by[50] == "alone" and by[51] == "" and by[52] == "Same words everywhere"


def test_style_tree_judges_articles(spark):
    def page(story, box):
        return f"<body><article><p>{story} told at some length</p><div>{box}</div><p>and it goes on: {story}</p></article></body>"

    pages = [(k, "http://a.com/x", page(f"Story {k}", "By A. Writer")) for k in range(12)]
    pages += [(k, "http://a.com/x", page(f"Story {k}", "its own box")) for k in (12,)]
    pages += [(k, "http://copies.com/x", page("One story", "By A. Writer")) for k in range(20, 32)]
    pages += [(k, "http://near.com/x", f"<article><h1>Title {k}</h1><p>A long text that all the near copies of it share</p></article>") for k in range(40, 52)]
    pages += [(60, "http://lone.com/x", page("Story 60", "By A. Writer"))]
    by = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(by[k] == f"Story {k} told at some length\nand it goes on: Story {k}" for k in range(12))
    assert "its own box" in by[12]
    assert all("By A. Writer" in by[k] and by[k].startswith("One story told") for k in range(20, 32))  # copies of one article
    assert all(by[k] == f"Title {k}\nA long text that all the near copies of it share" for k in range(40, 52))
    assert "By A. Writer" in by[60]


def test_many_verdicts_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(html_text, "FEW", 3)
    test_style_tree_drops_what_repeats(spark)
    test_style_tree_judges_articles(spark)


def test_few_pages_prove_nothing(spark):
    pages = [(k, "http://s.com/", f"<div>Same words</div><div><p>Story {k}</p></div>") for k in range(4)]
    assert {r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()} == {f"Same words\nStory {k}" for k in range(4)}


def brute_site(pages):
    """(page, html) of one host -> texts, with the style tree merged in plain dictionaries."""
    parsed = {k: html_text.parse(p) for k, p in pages}
    mains, seen = {}, defaultdict(lambda: {"all": defaultdict(set), "copies": defaultdict(set)})
    for k, (blocks, styles) in parsed.items():
        inner = html_text._unmarked(blocks)
        mains[k] = "\n".join(b.text for b in [b for b in inner if b.main] or inner)
        for b in blocks:
            seen[b.path]["all"]["c", b.text].add(k), seen[b.path]["copies"]["c", b.text].add(mains[k])
        for path, style in styles:
            seen[path]["all"]["s", style].add(k), seen[path]["copies"]["s", style].add(mains[k])

    def low(path, of):
        sets = seen[path][of]
        n = len(set().union(*sets.values()))
        sizes = {kind: [len(v) for (c, _), v in sets.items() if c == kind] for kind in "cs"}
        if n < html_text.MIN_PAGES or not sizes["c"]:
            return False
        style = -sum(x / sum(sizes["s"]) * math.log(x / sum(sizes["s"]), n) for x in sizes["s"])
        content = 1 - sum(x * math.log(x, n) for x in sizes["c"]) / sum(sizes["c"])
        return (1 - html_text.GAMMA) * style + html_text.GAMMA * content < html_text.LOW - 1e-9

    holders = defaultdict(set)
    for k, (blocks, _) in parsed.items():
        for b in html_text._unmarked(blocks):
            if b.main:
                holders[b.path, b.text].add(mains[k])
    out = {}
    for k, page in pages:
        paths = {html_text._hash(b.path) for b in parsed[k][0] if low(b.path, "all")}
        repeated = {html_text._feature(b) for b in parsed[k][0] if b.main and len(holders[b.path, b.text]) > 1 and low(b.path, "copies")}
        out[k] = html_text.main_text(page, paths, repeated)
    return out


def test_tree_against_brute_force(spark):
    rng = random.Random(6)
    box = lambda tag, n, kinds: f"<{tag}>{rng.choice(kinds)}</{tag}>" if rng.random() < 0.8 else ""
    pages, wanted = [], {}
    for host in range(6):
        site = []
        for k in range(rng.choice((3, 12, 30))):
            story = f"<p>Story {rng.randrange(40)} of {host}, told once</p><p>Second part {rng.randrange(60)}</p>"
            inside = box("div class='box'", 1, ["By one author", "By another"]) + story + box("section", 1, ["The same line", "Rare line " + str(k)])
            whole = rng.choice(("<article>{}</article>", "<main>{}</main>", "<div>{}</div>")).format(inside)
            site.append((host * 100 + k, f"<body><div class='top'>{rng.choice(['Welcome', 'Welcome', f'Day {k}'])}</div>{whole}<ul><li>one<li>two</ul></body>"))
        wanted |= brute_site(site)
        pages += [(k, f"https://h{host}.org/{k}", p) for k, p in site]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == wanted
    assert any(t != html_text.main_text(p, set()) for (k, _, p), t in zip(pages, wanted.values()))


def test_empty(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_counts_are_not_written(spark):
    """Each written file costs an executor a few processes, so tables between stages hold what decides and no count of every block."""
    pages = [(k, f"http://s{k % 40}.com/{k}", f"<div>Same words</div><div><p>Story {k}</p></div>") for k in range(160)]  # too few a host to tell
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.page_id: r.text for r in got} == {k: f"Same words\nStory {k}" for k in range(160)}
    folder = Path(scratch._made[-1][1].removeprefix("file:"))
    assert len(list(folder.rglob("part-*.parquet"))) < 32


def test_batches_are_passed_on_in_pieces(monkeypatch):
    pages = [f"<article><p>Story {k}</p><p>told in two parts</p></article>" for k in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([7] * 200), pa.array(pages)], ["page", "host", "html"])
    whole = pa.Table.from_batches(html_text._merge(iter([batch])))
    most = max(whole.column("page").to_pylist().count(k) for k in range(200))
    monkeypatch.setattr(html_text, "PIECE", 50, raising=False)
    pieces = list(html_text._merge(iter([batch])))
    assert max(p.num_rows for p in pieces) < 50 + most
    rows = lambda table: sorted(zip(*(c.to_pylist() for c in table.columns)))
    assert rows(pa.Table.from_batches(pieces)) == rows(whole)
