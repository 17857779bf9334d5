from __future__ import annotations

import html as entities
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from towerlens.llm import html_main as op

from conftest import DATA

SCHEMA = "page_id long, url string, html string, key string, text string, host string, part int"


def run(spark, tmp_path, rows):
    path = str(tmp_path / "sf")
    spark.createDataFrame([(*r, "k", "t", "h", 3) for r in rows], SCHEMA).write.parquet(f"{path}/pages.parquet")
    got = op.query(spark, path).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return [(r.page_id, r.text) for r in got]


def texts(page):
    return op.main_texts([page])[0]


@pytest.mark.parametrize(("page", "want"), [
    ("", ""), ("  \n ", ""), ("plain  text &amp; more", "plain text & more"),
    ("<p>one<p>two <b>bold\n text</b><br>end</p>", "one\ntwo bold text end"),
    ("<nav><p>menu</p></nav><article><h1>T</h1><p>a &lt; b</article><footer>f</footer>", "T\na < b"),
    ("<header><h1>Site</h1></header><main><p>text</p><aside>side</aside></main>", "text"),
    ("<article><header><h1>Title</h1><p>by me</p></header><p>body</p><footer>meta</footer></article>", "Title\nbody"),
    ("<article><p>a</p><form><p>mail</p></form><script>var x = '</p>';</script><style>p{}</style><p>b</article>", "a\nb"),
    ("<article><p>a</p></article><section id='comments'><article class='comment'><p>nice</p></article></section>", "a"),
    ("<article><p>a</p><div class=\"ad-slot\">buy</div><div class='cookie-notice'>ok?</div><p>b</p></article>", "a\nb"),
    ("<div class='sidebar'>x</div><div class='post-content'><p>body</p><div class='share'>tweet</div></div><div>rest</div>", "body"),
    ("<body class='has-sidebar'><div>kept</div><div hidden>no</div><div style='display: none'>no</div></body>", "kept"),
    ("<article><p>1 < 2 and 3 > 2</p><p title='a > b'>q</p><!-- <p>no</p> --><p>&eacute;&#233;&#xe9;&nbsp;x</p>", "1 < 2 and 3 > 2\nq\nééé x"),
    ("<ARTICLE><P>Upper</P><UL><LI>i<LI>j</UL><table><tr><td>1<td>2<tr><td>3</table></ARTICLE>", "Upper\ni\nj\n1 2\n3"),
    ("<article><p>open <div>x</div> tail <script>never closed", "open\nx\ntail"),
    ("<article><p>a</p><!-- never closed <p>b</p>", "a"),
    ("<article>loose <b>text</b><p>p</p>more</article>", "loose text\np\nmore"),
    ("<head><title>T</title></head><body><noscript>no</noscript><p>y</p></body>", "y"),
    ("<article><p>x</p></article><div>outside</div><article><p>y</p></article>", "x\ny"),
    ("<p class='ad'>buy<p>keep", "keep"),
    ("<div id='comments'><article><p>nice</p></article></div><article><p>a</p></article>", "a"),
    ("<div class='content-sidebar-wrap'><article><div class='entry-header'><h1>T</h1><span>by me</span></div><p>a</p></article></div>", "T\na"),
    ("<div class='site-header'><p>Name</p></div><div><p>a</p></div><div class='relatedPosts'><article>b</article></div>", "a"),
    ("<article class='post'><p>a</p><ol class='commentlist'><li><p>r</p></li></ol><div role='alert'>n</div><p>b</p></article>", "a\nb"),
    ("<p>before <span class='ad'>buy</span> after</p>", "before after"),
])
def test_markup(page, want):
    assert texts(page) == want


def test_article_of_every_given_page(spark):
    rows = op.query(spark, DATA).collect()
    given = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    assert len(rows) == len(given)
    for r in rows:
        inner = given[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = inner.replace("<br>", " ").replace("</p>", "<p>").replace("</h1>", "<p>").replace("<h1>", "<p>").replace("<b>", "").replace("</b>", "").split("<p>")
        want = [" ".join(entities.unescape(p).split()) for p in parts]
        assert r.text == "\n".join(w for w in want if w)


def naive_repeats(streams, length):
    """Pages of the most widespread window over each token, by a dictionary of windows."""
    on = defaultdict(set)
    for p, s in enumerate(streams):
        for i in range(len(s) - length + 1):
            on[tuple(s[i:i + length])].add(p)
    return [[max((len(on[tuple(s[i:i + length])]) for i in range(max(0, t - length + 1), min(t, len(s) - length) + 1) if len(on[tuple(s[i:i + length])]) > 1), default=0) for t in range(len(s))] for s in streams]


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_against_windows(seed):
    rng = random.Random(seed)
    common = [[rng.randrange(9) for _ in range(rng.randrange(1, 30))] for _ in range(4)]
    streams = []
    for _ in range(12):
        parts = [rng.choice(common) if rng.random() < 0.6 else [rng.randrange(9) for _ in range(rng.randrange(12))] for _ in range(4)]
        streams.append([t for p in parts for t in p])
    ids, page = [], []
    for p, s in enumerate(streams):
        ids += [*s, 100 + p]
        page += [p] * (len(s) + 1)
    got = op.repeats(np.array(ids), np.array(page), 8).tolist()
    want = [x for s in naive_repeats(streams, 8) for x in [*s, 0]]
    assert got == want


def test_repeated_runs_of_a_host(spark, tmp_path):
    """Unmarked template blocks go, unique runs and an article's own repeats stay."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    template = "This site uses many small files to remember who you are today"
    notice = "Please subscribe to our weekly letter for more such nice stories now"
    shared = " ".join(word() for _ in range(60))
    rows, want = [], []
    for i in range(700):  # one large host, cut into parts
        body = " ".join(word() for _ in range(30))
        rows.append((i, f"https://Big.example.org:80/{i}", f"<div>{template}</div><div>{body}</div><div>{'' if i % 50 else shared}</div>"))
        want.append((i, body + ("" if i % 50 else "\n" + shared)))
    for i in range(700, 720):  # an article that repeats a passage, and a notice on all pages
        body = " ".join(word() for _ in range(30))
        rows.append((i, f"https://art.example.org/{i}", f"<article><p>{body}</p><p>{shared if i % 2 else ''}</p><p>{notice}</p></article>"))
        want.append((i, body + ("\n" + shared if i % 2 else "")))
    rows += [(i, f"https://copy.example.org/{i}", f"<div>{shared}</div>") for i in range(800, 830)]  # copies only
    want += [(i, shared) for i in range(800, 830)]
    rows += [(900, None, f"<p>{template}</p>"), (901, "no address", None), (None, "", ""), (902, "https://one.example.org", "<p>x</p>"), (902, "https://one.example.org", "<p>x</p>")]
    want += [(900, template), (901, ""), (None, ""), (902, "x"), (902, "x")]
    rows.append((903, "https://long.example.org/", "<article>" + "<p>wörd &amp; more</p>" * 40_000))
    want.append((903, "\n".join(["wörd & more"] * 40_000)))
    got = run(spark, tmp_path, rows)
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("part_pages", [7, 40, 1_000])
def test_parts_change_no_result(spark, tmp_path, monkeypatch, part_pages):
    """A host cut into many parts gives what the whole host gives, shares near the limits included."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = [" ".join(word() for _ in range(12)) for _ in range(24)]
    pages = []
    for i in range(200):  # passage k is on k in 24 pages, outside and inside of articles
        body = "".join(f"<p>{s}</p>" for k, s in enumerate(shared) if rng.random() < (k + 1) / 26) + f"<p>{' '.join(word() for _ in range(20))}</p>"
        pages.append(f"<article>{body}</article>" if i % 2 else body)
    pages += pages[:30] + [pages[0]] * 60 + ["", "<p>short</p>"]  # copies count once
    want = op.main_texts(pages)
    assert len(set(want)) > 150 and sum(s in t for s in shared for t in want) < sum(s in p for s in shared for p in pages)
    monkeypatch.setattr(op, "PART_PAGES", part_pages)
    got = run(spark, tmp_path, [(i, "http://a.org/", p) for i, p in enumerate(pages)])
    assert [t for _, t in sorted(got)] == want


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_host(spark):
    urls = ["https://A.b.org/x", "http://u:p@a.org:8080?q", "ftp://a.org#f", "//a.org", "a.org/x", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(op.host(F.col("url"))).collect()] == ["a.b.org", "a.org", "a.org", "", "", "", ""]
