import random

import numpy as np
import pytest

from textloom.llm import ann
from textloom.llm.html_extract import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body>
<header><h1>Site name</h1><nav><a href="/">Home</a></nav></header><div class="cookie-notice"><p>We use cookies, accept them, all of them, right now please.</p></div>
<div id="page"><aside class="sidebar"><p>Popular stories, read more, of everything, by everyone here.</p></aside>
<div class="post"><h2>The &lt;title&gt;</h2><p>First   paragraph, with a <b>bold</b> word &amp; a comma,
and enough text to count.<p>Second paragraph, not closed, with <a href="x">one link</a>, and more text.<br>Next line.
<ul><li>One</li><li>Two</li></ul><div class="ad">Buy now, really, it is cheap, and good for you too.</div><p>Short.</p></div>
<form><p>Leave your mail, we will write, often, and at length, promise.</p></form>
<section id="comments"><p>Great article, thanks, I liked it, and so did my friends.</p></section></div>
<footer><p>Copyright, terms, privacy, imprint, and all the other things.</p></footer></body></html>"""


def test_article_and_nothing_else():
    assert main_text(PAGE).split("\n") == [
        "The <title>", "First paragraph, with a bold word & a comma, and enough text to count.",
        "Second paragraph, not closed, with one link, and more text. Next line.", "One", "Two", "Short."]


def test_broken_pages():
    assert main_text(None) == main_text("") == ""
    assert main_text("<p>cut <b>of") == "cut of"
    assert main_text("plain &eacute; text") == "plain é text"
    assert main_text("<article><h1>A</h1><p>B</p></article><footer>x</footer>") == "A\nB"
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert main_text("<!-- <p>no</p> --><p>yes</p><script>no</script>") == "yes"


def test_siblings_of_the_best_container_stay():
    prose = "A long paragraph, with commas, and many words, that scores well, and goes on, and on, for some time."
    rest = "<h2>Second part</h2><ul><li>An item</li></ul><p>no full stop</p><pre>code  here</pre><div>Short</div>bare words"
    for around in ("main", "article", "div"):
        page = f"<body><nav>Menu</nav><{around}><h1>Title</h1><div><p>{prose}</p><p>{prose}</p></div>{rest}<ul><li><a href=/a>Link one</a></li></ul></{around}><footer>End</footer></body>"
        assert main_text(page).split("\n") == ["Title", prose, prose, "Second part", "An item", "no full stop", "code here", "Short", "bare words"], around
    teasers = f"<body><div>Site slogan</div><article><p>{prose}</p><p>{prose}</p><p>{prose}</p></article><div><a href=x>More</a></div></body>"
    assert main_text(teasers) == "\n".join([prose] * 3)
    assert main_text(f"<article><p>{prose}</p><p>See <a href=http://x/>this link</a> now.</p></article>").endswith("See this link now.")


def test_names_of_layouts_drop_nothing():
    prose = "A long paragraph, with commas, and many words, that scores well, and goes on, and on, for some time."
    for name in ("content has-sidebar", "no-sidebar", "page-with-comments", "reader"):
        page = f'<body><div class="{name}"><p>{prose}</p><p>{prose}</p></div><div class="sidebar"><p>Popular things, of all kinds, and so on.</p></div></body>'
        assert main_text(page) == f"{prose}\n{prose}", name


PROSE = "A long paragraph, with commas, and many words, that scores well, and goes on, and on, for some time."


def test_names_inside_an_article_drop_no_text():
    for inside in (
        '<section id="legal-background"><h2>Background</h2><p>The act of 1801.</p></section>', '<p id="share-prices">Prices rose.</p>', '<p class="alert">Mind the gap.</p>', "<blockquote class='comment'>He said so.</blockquote>",
        '<table class="search"><tr><td>Depth</td><td>12 m</td></tr></table>', '<section id="discussion"><p>What we found.</p></section>', '<div class="notice"><p>Of 1 May.</p></div>', '<h2 id="related">Related work</h2>',
        '<p class="byline">By A. Writer</p>', '<div class="searching-for-gold"><p>Gold.</p></div>', '<header><h2>Title</h2><p>Lead</p></header>', "<header><p>Lead</p></header>", '<div class="entry-header"><h3>Part</h3></div>',
    ):
        found = main_text(f"<body><nav>Menu</nav><article><h1>Head</h1><p>{PROSE}</p>{inside}<p>{PROSE}</p></article></body>").split("\n")
        assert found[:2] == ["Head", PROSE] and found[-1] == PROSE and len(found) > 3, inside


def test_what_is_no_text_goes_from_an_article_too():
    for inside in (
        '<div class="share-buttons"><a href=x>Tell</a></div>', '<div class="ad">Buy</div>', '<p class="ad">Buy</p>', '<section id="comments"><p>Great, thanks.</p></section>', '<div class="cookie-notice"><p>Cookies.</p></div>',
        '<ul class="related"><li><a href=x>Other</a></li></ul>', "<ul><li><a href=x>Other</a></li><li><a href=y>More</a> 12</li></ul>", '<div class="newsletter signup"><p>Your mail, please.</p></div>', "<header><span>12 May</span></header>",
        '<div role="navigation"><p>Home</p></div>', '<p hidden>No</p>', '<div style="display: none"><p>No</p></div>', "<aside><p>By the way.</p></aside>", '<div class="commentList-item-3"><p>Me too.</p></div>', "<div><a href=x>Next page</a></div>",
    ):
        assert main_text(f"<body><article><h1>Head</h1><p>{PROSE}</p>{inside}<p>{PROSE}</p></article></body>") == f"Head\n{PROSE}\n{PROSE}", inside


def test_sources_and_links_in_prose_stay():
    sources = "<ul><li><a href=a>A history of the old mills of the valley</a>, Oxford</li><li><a href=b>The river and its many tributaries</a>, 2nd ed.</li></ul>"
    linked = "<div><p>See <a href=c>the report of the committee on mills, rivers and bridges in full</a></p></div><p><a href=d>The data</a></p>"
    for around in ("article", "main", "div"):
        found = main_text(f"<body><{around}><p>{PROSE}</p><p>{PROSE}</p>{sources}{linked}</{around}><footer>End</footer></body>").split("\n")
        assert found[2:] == ["A history of the old mills of the valley, Oxford", "The river and its many tributaries, 2nd ed.", "See the report of the committee on mills, rivers and bridges in full", "The data"], around


def test_the_score_decides_between_containers(monkeypatch):
    from textloom.llm import html_extract

    teaser, whole = "<p>A short teaser, of one sentence.</p>", f"<p>{PROSE}</p>" * 4
    text = "\n".join([PROSE] * 4)
    assert main_text(f"<body><article>{teaser}</article><article>{whole}</article><article>{teaser}</article></body>") == text
    assert main_text(f"<body><article>{teaser}</article><div>{whole}</div></body>") == text  # the tag is a bonus, no verdict
    assert main_text(f"<body><div>{teaser}</div><article>{whole}</article></body>") == text
    links = "".join(f"<p><a href=x>{PROSE}</a></p>" for _ in range(9))
    assert main_text(f"<body><div>{links}</div><div><p>{PROSE}</p>{whole}</div></body>") == f"{PROSE}\n{text}"  # by density
    page = f"<body><div><p>{PROSE.replace(',', '')}</p></div><section><div>{whole}</div></section></body>"
    assert main_text(page) == text  # by commas and length
    assert main_text(f"<body><div>{whole}</div><div>{whole}</div><div>{teaser}</div></body>") == f"{text}\n{text}"
    monkeypatch.setattr(html_extract, "_score", lambda order: None)
    assert main_text(page) != text


def test_deep_and_unbalanced_pages_take_linear_time():
    import time

    start = time.time()
    deep = "<div>" * 8000
    assert main_text("<article><header>" + deep + "<h1>T</h1>" + "</div>" * 8000 + "</header><p>Text, of some length, for the score.</p></article>").startswith("T")
    assert main_text(deep + "</span>" * 8000 + "x") == "x"
    assert main_text("<b>" * 8000 + "<hr>" * 8000 + "x") == "x"
    assert main_text("".join(f"<div><p>Paragraph number {i}, with a comma.</p>" for i in range(8000))).startswith("Paragraph number")
    assert time.time() - start < 10


def plain_extract(page):
    """A second scorer, on the standard library's parser and for well-formed pages: points, density, best container."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.root = self.here = {"tag": "root", "kids": [], "up": None, "score": 0.0}

        def handle_starttag(self, tag, attrs):
            node = {"tag": tag, "kids": [], "up": self.here, "score": 0.0, "class": dict(attrs).get("class", "")}
            self.here["kids"].append(node)
            if tag not in ("br", "meta"):
                self.here = node

        def handle_endtag(self, tag):
            self.here = self.here["up"]

        def handle_data(self, data):
            self.here["kids"].append(data)

    t = Tree()
    t.feed(page)
    dropped = lambda n: n["tag"] in ("head", "nav", "footer", "aside", "form", "script", "style") or n.get("class") in ("ad", "sidebar", "comments")
    text = lambda n: n if isinstance(n, str) else " " if n["tag"] == "br" else "" if dropped(n) else "".join(map(text, n["kids"]))
    linked = lambda n: "" if isinstance(n, str) or dropped(n) else text(n) if n["tag"] == "a" else "".join(map(linked, n["kids"]))
    every = []

    def walk(n):
        if not isinstance(n, str) and not dropped(n):
            every.append(n)
            for k in n["kids"]:
                walk(k)

    walk(t.root)
    for n in every:
        if n["tag"] == "p" and len(words := " ".join(text(n).split())) >= 25:
            up, share = n["up"], 1.0
            while up["up"]:
                up["score"] += (1 + words.count(",") + min(len(words) / 100, 3)) * share
                up, share = up["up"], share / 2
    best = max(every, key=lambda n: n["score"] * (1 - len(linked(n)) / max(len(text(n)), 1)))
    return [line for n in every if n["tag"] in ("p", "h1", "h2", "li") and best in _ups(n) and (line := " ".join(text(n).split())) and not linked(n) == text(n)]


def _ups(n):
    while n := n["up"]:
        yield n


def test_extraction_equals_a_plain_scorer():
    draw = random.Random(21)
    word = lambda: draw.choice(["stone", "river,", "quiet", "&amp;", "mill", "and", "old,", "caf&eacute;", "town"])
    line = lambda a, b: " ".join(word() for _ in range(draw.randint(a, b)))
    for _ in range(60):
        body = "".join(draw.choice([f"<p>{line(20, 90)}</p>", f"<p>{line(2, 4)} <b>{line(9, 30)}</b><br>{line(9, 9)}</p>", f"<h2>{line(2, 5)}</h2>", f"<ul><li>{line(1, 3)}</li><li>{line(4, 8)}</li></ul>"]) for _ in range(draw.randint(4, 12)))
        links = "".join(f"<li><a href='/{i}'>{line(1, 3)}</a></li>" for i in range(6))
        around = draw.choice(["article", "div", "section"])
        page = (
            f"<html><head><meta charset='utf-8'><title>{line(3, 5)}</title><style>p{{}}</style></head><body><nav><ul>{links}</ul></nav><div class='ad'><p>{line(30, 40)}</p></div>"
            f"<{around}><h1>{line(2, 6)}</h1><p>{line(30, 60)}</p>{body}</{around}><aside><p>{line(20, 40)}</p></aside><div class='comments'><p>{line(20, 40)}</p></div><footer><p>{line(20, 30)}</p></footer></body></html>"
        )
        assert main_text(page).split("\n") == plain_extract(page)


def test_every_page_of_the_table(spark, sf):
    got = extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert len(got) == 50 and all(r["n_chars"] == len(r["text"]) for r in got)
    rows = spark.createDataFrame([(1, None, None, 0), (None, "u", "<p>x", 1), (None, "u", "<p>x", 1)], "page_id long, url string, html string, text int")
    assert [r["text"] for r in extract(rows).orderBy("page_id", "n_chars").collect()] == ["x", "x", ""]
    assert extract(rows.limit(0)).count() == 0


def exact(v, ids, every, k):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = v @ v[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [int(ids[i]) for i in order]
    return out


def frame(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in row], "x") for i, row in enumerate(v)], "vec_id long, embedding array<float>, score string")


def test_every_list_probed_is_exact_and_ties_go_to_smaller_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "DEVIATIONS", 1e9)  # no test ever rejects
    v = np.random.default_rng(1).standard_normal((300, 16)).astype(np.float32)
    v[50:120] = v[7]
    got = ann.search(frame(spark, v), every=10, k=20, recall=1.0).toPandas().sort_values(["query_id", "rank"])
    want = exact(v.astype(float), np.arange(300), 10, 20)
    assert {q: g["vec_id"].tolist() for q, g in got.groupby("query_id")} == want
    assert all(abs(r.score - float(v[r.query_id].astype(float) @ v[r.vec_id].astype(float))) < 1e-12 for r in got.itertuples())


def test_recall_over_lists_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(ann, "TILE_ROWS", 64)
    monkeypatch.setattr(ann, "TILE_QUERIES", 16)
    draws = np.random.default_rng(2)
    v = (draws.standard_normal((40, 24))[draws.integers(0, 40, 3000)] + 0.4 * draws.standard_normal((3000, 24))) * draws.uniform(0.5, 2, (3000, 1))
    v[1000:1900] = v[3]
    got = ann.search(frame(spark, v.astype(np.float32)), k=20).toPandas()
    v = v.astype(np.float32).astype(float)
    best = {q: sorted((v[x] @ v[q] for x in ids), reverse=True) for q, ids in exact(v, np.arange(3000), 20, 20).items()}
    hits = [np.sum(np.array(sorted(g["score"], reverse=True)) >= best[q][-1] - 1e-9) / 20 for q, g in got.groupby("query_id")]
    assert len(hits) == 150 and np.mean(hits) >= 0.9 and (got.groupby("query_id").size() == 20).all()


def test_recall_at_several_sizes(spark):
    for path, least in (("sf0.001", 0.95), ("sf0.1", 0.95)):
        table = spark.read.parquet(f"/root/testdata/{path}/embeddings.parquet")
        rows = table.toPandas().sort_values("vec_id")
        v, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
        got = {q: set(g["vec_id"]) for q, g in ann.search(table).toPandas().groupby("query_id")}
        want = exact(v, ids, 20, 20)
        assert set(got) == set(want) and np.mean([len(got[q] & set(want[q])) / 20 for q in want]) >= least


def recall_of(spark, v, k=20):
    got = ann.search(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), k=k).toPandas()
    want = exact(v, np.arange(len(v)), 20, k)
    sizes = got.groupby("query_id").size()
    assert set(sizes.index) == set(want) and (sizes == k).all()  # no query is short of a row
    return {q: len(set(g["vec_id"]) & set(want[q])) / k for q, g in got.groupby("query_id")}


@pytest.mark.parametrize("kind", ["longer by 10", "longer by 1000", "longer by 100000", "log-normal", "two lengths", "a far query"])
def test_lengths_of_all_kinds(spark, kind):
    draws = np.random.default_rng(12)
    v = draws.standard_normal((40, 32))[draws.integers(0, 40, 5000)] + 0.5 * draws.standard_normal((5000, 32))
    if kind.startswith("longer"):
        v[1234] *= float(kind.split()[-1])
    elif kind == "log-normal":
        v *= draws.lognormal(0, 1, (5000, 1))
    elif kind == "two lengths":
        v[::7] *= 1e6
    else:
        v[[20, 40, 60]] = [[1e3] + [0] * 31, [0] * 31 + [-1e-9], [1.0, -1.0] * 16]
    recall = recall_of(spark, v)
    assert np.mean(list(recall.values())) >= 0.9 and min(recall.values()) > 0
    if kind == "a far query":
        assert min(recall[q] for q in (20, 40, 60)) >= 0.5


def test_extreme_lengths(spark):
    v = np.random.default_rng(13).standard_normal((300, 8))
    for scale in (1e-150, 1e150):
        assert np.mean(list(recall_of(spark, v * scale).values())) >= 0.9


def test_queries_that_tests_leave_short_are_scanned_again(spark, monkeypatch):
    monkeypatch.setattr(ann.Space, "bound", lambda self, queries, *_: np.full(len(queries), -1.0))  # every candidate is rejected
    v = np.random.default_rng(14).standard_normal((2000, 16))
    assert np.mean(list(recall_of(spark, v).values())) >= 0.9


def test_the_scan_abandons_early_and_loses_nothing():
    draws = np.random.default_rng(6)
    v = draws.standard_normal((30, 64))[draws.integers(0, 30, 4000)] + 0.5 * draws.standard_normal((4000, 64))
    space = ann.Space.fit(v, float(np.linalg.norm(v, axis=1).max()), 20)
    space.trial(v, 20, 0.97)
    rows, asked = space.rows(v), space.queries(v[:100])
    q, r, work = ann.scan(rows, asked, 21, space.bound(asked, 21))
    found = set(zip(q.tolist(), r.tolist()))
    want = {(i, int(j)) for i in range(100) for j in np.argsort(-(v @ v[i]))[:20]}
    assert len(want & found) >= 0.99 * len(want) and work < 0.5 * 100 * 4000 * 65


def test_rows_from_the_lists_do_not_grow_with_the_square(spark):
    """Rows that the lists give for each query: with five times the rows it isn't five times as many."""
    store = spark._jsparkSession.sharedState().statusStore()
    made = []
    for n in (4_000, 20_000):
        first, total = store.executionsCount(), 0
        table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.random.default_rng(8).standard_normal((n, 32)))], "vec_id long, embedding array<double>")
        assert ann.search(table).count() == n // 20 * 20
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        ran = store.executionsList()
        for at in range(first, ran.size()):
            run = ran.apply(at).executionId()
            values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
            for node in (nodes.apply(k) for k in range(nodes.size())):
                for metric in (node.metrics().apply(k) for k in range(node.metrics().size())):
                    if "CoGroups" in node.name() and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        total += int(values.apply(metric.accumulatorId()).replace(",", ""))
        made.append(total / (n // 20))
    assert made[0] >= 20 and made[1] < 2 * made[0]


def test_no_queries(spark):
    assert ann.search(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(1, 9)], "vec_id long, embedding array<float>")).collect() == []


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, [3.0, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == {(0, 1, 6, 5.0), (0, 2, 20, 1.0), (20, 1, 6, 3.0), (20, 2, 0, 1.0)}
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert ann.search(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0
