"""Wrappers, archives and vectors against brute force and exact round trips."""

import base64
import gzip
import hashlib
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import plain
from tidemark.llm import common, epsilon_grid, queries, warc, wrappers


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, sf, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert plain(got, columns) == plain(want, columns)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="no-sidebar"><header class="site-header"><a href="/">Home</a></header><nav><ul><li><a>x</a></li></ul></nav>
<div id="cookie-notice">We use cookies</div><div class="wrap"><div class="content">%s</div><aside>side</aside></div><!-- <p>no</p> --><footer>&copy; foot</footer></body></html>"""


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ("<article><h1>A &amp; B</h1><p>one <b>two</b>,\n three<p>four&nbsp;five<br>six</article>", "A & B one two, three four five six"),
        ("<main><h1>A</h1><p>one</p><form>mail <input></form><div class='comments'><p>first!</p></div></main>", "A one"),
        ("<h1>A</h1><p>a paragraph with enough words to be the article</p><section class='ad-banner'>buy</section>", "A a paragraph with enough words to be the article"),
        ("<article><p>x &lt;b&gt; &#x41;&#66; &bogus; y</p><noscript>n</noscript><textarea>t</textarea></article>", "x <b> AB &bogus; y"),
        ("<article><p>cut <b>here", "cut here"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"),
    ],
)
def test_extract(inner, want):
    assert wrappers.extract(wrappers.parse(PAGE % inner), None) == want


@pytest.mark.parametrize("page", ["", "<", "<a", "<p", "</p></b>", "<!--", "<script>", "<div " * 300 + ">", "<b>" * 2000 + "deep", "a < b > c", "<p class='x>y</p>"])
def test_broken_markup_never_fails(page):
    assert isinstance(wrappers.extract(wrappers.parse(page), None), str)


def test_wrapper_resolves_mismatches():
    pages = ["<ul><li>a</li><li>b</li></ul><p>same</p><p>x</p>", "<ul><li>c</li></ul><img><p>same</p><p>y</p>", "<dl><dt>1</dt><dd>2</dd><dt>3</dt><dd>4</dd></dl>"]
    w = None
    for p in pages[:2]:
        n = wrappers.fold(wrappers.parse(p))
        w = n if w is None else wrappers.merge(w, n)
    assert wrappers.shape(w) == "<><ul>(<li>#SLOT)+(<img>)?(<p>#SLOT)+"
    assert wrappers.shape(wrappers.fold(wrappers.parse(pages[2]))) == "<><dl>(<dt>#SLOT)+(<dd>#SLOT)+"
    assert wrappers.shape(wrappers.Node.load(w.dump())) == wrappers.shape(w)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p>one <svg class="i"/> two three</p><p>four five</p>', "one two three four five"),
        ("<svg-icon></svg-icon><p>two three</p>", "two three"),
        ("<p class=" + "x" * 20_000 + ">long</p><p>b</p>", "long b"),
        ('<article><div class="side-by-side">a b</div><div id="search-results">c</div><div class="reply-quote">d</div><ol class="comment-list"><li>no</ol></article>', "a b c d"),
        ("<p>a<p>b <math><mi>x</mi></math> c<svg><text>no</text></svg> d</p>", "a b x c d"),
        ("<div>" * 300 + "deep" + "</div>" * 300 + "<p>after</p>", "deep after"),
        ('<p data-hidden="1">seen</p><p hidden>not</p>', "seen"),
        ("wo<my-part>rd</my-part>", "word"),
        ("<!-->shown<!-- no --!>yes", "shownyes"),
        ('<p>x</p><SCRIPT>var a="</scripty>";</SCRIPT ><p>y</p>', "x y"),
        ('<body class="sidebar-right"><div class="sidebar-left"><article><p>in</p></article></div></body>', "in"),
        ('<p title="a>b">x</p>', "x"),
        ("<title>no</title>" + "<p>" + "word " * 300_000 + "end</p>", "word " * 300_000 + "end"),
        ("İ" * 50 + "<style>p{}</style>after", "İ" * 50 + "after"),
    ],
)
def test_no_text_is_lost(page, want):
    assert wrappers.extract(wrappers.parse(page), None) == want


@pytest.mark.parametrize("page", ['<a "' * 100_000, "<" * 300_000, "<a " * 100_000, "<!--" * 100_000, "<script>" * 50_000, "<a b='" * 50_000 + ">", "</p>" * 100_000, "<p>x " * 20_000])
def test_odd_pages_take_no_long(page):
    began = time.monotonic()
    wrappers.extract(wrappers.parse(page), None)
    assert time.monotonic() - began < 10


def random_words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_the_wrapper_decides(spark):
    """Articles without article or main elements, with misleading class names, on hosts of 1 to 1,000 pages; the pages alone would not do."""
    rng = random.Random(1)
    rows, want = [], {}

    def add(host, html, text):
        want[len(rows)] = text
        rows.append((len(rows), f"https://{host}/{len(rows)}", html))

    for n, host in ((1000, "many.example"), (8, "few.example")):
        for i in range(n):
            # one page in four has hardly any text, less than what is around it; strings that open or close the region on all pages are no article
            title, first, second = random_words(rng, 3), random_words(rng, 1 if i % 4 == 0 else 60), random_words(rng, 5)
            around = f'<div class="x{i}"><a href="/">{random_words(rng, 4)}</a></div>'
            add(host, f'<body class=b>{around}<div class="wrap sidebar-right"><div class="col"><p>Share this page</p><h1>{title}</h1><p>{first}</p><h2>Notes</h2><p>{second}</p><p>Subscribe now</p></div></div><div class="f">Written in {2000 + i % 3}</div></body>', f"{title} {first} Notes {second}")
    for i in range(3):  # near copies: what they share is no template
        body = "same words again and again " * 20
        add("copies.example", f"<div class=k><p>{body}</p><p>{i}</p></div>", f"{body.strip()} {i}")
    add("one.example", "<div class=k><h1>only</h1><p>one page</p></div>", "only one page")
    got = {r["page_id"]: r["text"] for r in wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    alone = [d for d in want if wrappers.extract(wrappers.parse(rows[d][2]), None) != want[d]]
    assert len(alone) > 900


@pytest.mark.parametrize("n", [3, 40])
def test_bare_parts_are_told_apart_by_what_they_hold(spark, n):
    """Nothing but divs without names: menu, notice (on some pages), article, cards, footer; lists in some articles."""
    rng = random.Random(n)
    rows, want = [], {}
    for i in range(n):
        title, first, second = (random_words(rng, k) for k in (4, 40, 60))
        listed = ["one", "two"] if i % 3 == 0 else []
        inner = f"<h1>{title}</h1><p>{first}</p>" + (f"<ul>{''.join(f'<li>{x}</li>' for x in listed)}</ul>" if listed else "") + f"<p>{second}</p>"
        menu = "<div><ul><li><a>home</a></li><li><a>news</a></li></ul></div>"
        notice = "<div>buy now</div>" if i % 2 else ""
        cards = "<div><ul>" + "".join(f"<li><a>{random_words(rng, 3)}</a></li>" for _ in range(4)) + "</ul></div>"
        rows.append((i, "https://bare.example/a", f"<body>{menu}{notice}<div>{inner}</div>{cards}<div>&copy; all of us</div></body>"))
        want[i] = " ".join([title, first, *listed, second])
    assert {r["page_id"]: r["text"] for r in wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == want


def test_bare_parts_that_hold_the_same_are_one_group():
    same = wrappers.fold(wrappers.parse("<div><p>a</p></div><div><p>b <b>c</b></p></div><div><h1>x</h1><p>y</p><p>z</p></div>"))
    assert wrappers.shape(same) == "<>(<div><p>#SLOT(<b>c)?)+<div><h1>x(<p>#SLOT)+"


@pytest.mark.parametrize("n", [1, 2, 10, 1000])
def test_strings_that_only_repeat_stay(spark, n):
    """Lines of the author and of the desk, on hosts of any size, with the title around them or not."""
    rng = random.Random(n)
    rows, want = [], {}
    for i in range(n):
        title, body = random_words(rng, 4), random_words(rng, 60)
        inner = f"<p>By Anna Smith, staff writer</p><h1>{title}</h1><p>{body}</p><p>Reporting by the Harbour Desk.</p>"
        rows.append((i, "https://desk.example/a", f'<body><div class="top"><a href="/">Home</a></div><div class="story">{inner}</div><div class="foot"><a>About</a></div></body>'))
        want[i] = f"By Anna Smith, staff writer {title} {body} Reporting by the Harbour Desk."
    assert {r["page_id"]: r["text"] for r in wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == want


def test_pages_of_links_have_no_article(spark):
    rng = random.Random(9)
    rows = [(i, "https://h.example/x", f'<body><div class="story"><h1>{random_words(rng, 3)}</h1><p>{random_words(rng, 50)}</p></div></body>') for i in range(9)]
    index = '<body><div class="list"><p><a>one story</a></p><p><a>two story</a></p></div><p>contact us</p></body>'
    rows += [(100, "https://h.example/", index), (101, "https://alone.example/", index)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[100] == got[101] == "" and all(got[i] for i in range(9))


def test_wrappers_stay_small():
    """Generated class names and ever new structure don't grow a wrapper without end."""
    rng = random.Random(2)
    wrapper = None
    for _ in range(300):
        page = "".join(f'<div class="{random_words(rng, 1)}"><p>{random_words(rng, 3)}</p></div>' for _ in range(6))
        new = wrappers.fold(wrappers.parse(f"<body>{page}</body>"))
        wrapper = new if wrapper is None else wrappers.merge(wrapper, new)
    assert len(json.dumps(wrapper.dump())) < 100_000


def test_hosts_and_odd_rows(spark):
    page = lambda i: f"<body><div class=main><p>{'story ' * 30}{i}</p></div><div class=x>short {i}</div></body>"
    rows = [(i, "http://h/x", page(i)) for i in range(8)] + [(99, None, None), (None, "x", ""), (5, "http://other", "<article>one</article>"), (5, "http://other", "<article>one</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit(2)).withColumn("wrapper", F.lit(3))
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in wrappers.extract_pages(df).collect())
    assert len(got) == len(rows)
    assert all(t == "" for d, t, _ in got if d in ("99", "None"))
    assert [t for d, t, _ in got if d == "5"].count("one") == 2
    assert all(n == len(t) for _, t, n in got)
    assert wrappers.extract_pages(df.limit(0)).count() == 0


def test_wrappers_by_join(spark, sf, monkeypatch):
    pages = common.read_table(spark, sf, "pages")
    want = sorted(map(str, wrappers.extract_pages(pages).collect()))
    monkeypatch.setattr(wrappers, "MOST_BROADCAST", -1)
    assert sorted(map(str, wrappers.extract_pages(pages).collect())) == want


def test_pages_of_the_table(spark, sf):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in common.read_table(spark, sf, "pages").collect()}
    for r in queries.QUERIES["op1_wrapper_extraction"](spark, sf).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|br|h\d|div|li|ul)\b[^>]*>", " ", inner))
        assert r["text"] == " ".join(html.unescape(inner).split())


BIG = "<p>" + "payload " * 40 + "</p>"


def test_transactions(spark):
    rows = [(1, "http://a/x", BIG), (2, "http://a/y\r\nInjected: 1", BIG), (3, None, None), (4, "u", "small"), (5, "u", "small"), (6, "http://é/WARC", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9), (None, "n", BIG), (7, "d", BIG + "!"), (7, "d", BIG + "!"), (8, "d", BIG + "!")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    folder = common.fresh_path(spark, "w")
    files = warc.write_archives(df, folder)
    captures = warc.assemble(warc.read_records(files, folder)).collect()
    assert len(captures) == len(rows)
    got = sorted((str(c["metadata"]["page_id"]), c["main"]["record_type"], c["metadata"]["target_uri"]) for c in captures)
    want = [("1", "response", rows[0][1]), ("2", "revisit", rows[1][1]), ("3", "response", None), ("4", "response", "u"), ("5", "response", "u"), ("6", "response", rows[5][1]), ("7", "response", "d"), ("7", "response", "d"), ("8", "revisit", "d"), ("None", "revisit", "n")]
    assert got == want
    for c in captures:
        assert c["request"]["record_id"]
        if c["main"]["record_type"] == "response":
            html = next(h or "" for p, _, h in rows if p == c["metadata"]["page_id"])
            assert bytes(c["main"]["payload"]).decode() == html
            assert c["main"]["payload_digest"] == hashlib.sha256(html.encode()).hexdigest()
    folder = common.fresh_path(spark, "w")
    assert warc.assemble(warc.read_records(warc.write_archives(df.limit(0), folder), folder)).count() == 0


def test_archives_are_read_in_any_packing():
    members = [m for i in range(3) for m in warc.capture_records(i, "u", b"body%d" % i, hashlib.sha256(b"x").hexdigest(), None)]
    flat = b"".join(map(gzip.decompress, members))
    want = [(dict(h)["warc-record-id"], b) for h, b in warc.records(b"".join(members))]
    assert len(want) == 9
    assert [(dict(h)["warc-record-id"], b) for h, b in warc.records(flat)] == want
    assert [(dict(h)["warc-record-id"], b) for h, b in warc.records(gzip.compress(flat))] == want
    for bad in (b"".join(members)[:-3], flat[:-9]):
        with pytest.raises(ValueError, match="ends within"):
            list(warc.records(bad))
    assert base64.b32decode(dict(next(warc.records(members[1]))[0])["warc-payload-digest"][7:]).hex() == hashlib.sha256(b"x").hexdigest()


def brute_vectors(rows):
    ok = lambda v, g: g is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if ok(v, g) else None for _, v, g in rows]
    near = [[i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98 for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in range(n) if near[i][j])]) for i in range(n)]
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least[label[i]] = min(least.get(label[i], d), d)
    return sorted((d, sum(near[i]), least[label[i]], d == least[label[i]]) for i, (d, _, _) in enumerate(rows))


@pytest.mark.parametrize("block", [4, 1024])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(epsilon_grid, "BLOCK", block)
    monkeypatch.setattr(epsilon_grid, "LEAF", max(2, block // 8))
    rng = np.random.default_rng(7)
    rows, i = [], 0
    for g in range(12):
        centre = rng.normal(size=6)
        for _ in range(rng.integers(1, 9)):
            rows.append((i, (centre + rng.normal(size=6) * rng.choice([0, 0.05, 0.15])).astype(np.float32).tolist(), g % 3))
            i += 1
    rows += [(900, None, 1), (901, [0.0] * 6, 1), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (903, [float("nan")] * 6, 1), (904, [float("inf")] * 6, 1), (905, rows[0][1], None), (906, [], 1), (907, [1.0, 0.0], 1), (908, [2.0, 0.0], 1), (909, rows[0][1], 0), (909, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(1)).withColumn("key", F.lit(1))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in epsilon_grid.near_vectors(df).collect())
    assert got == brute_vectors(rows)
    assert epsilon_grid.near_vectors(df.limit(0)).count() == 0


def test_distant_intervals_are_skipped():
    """On clustered vectors most pairs are never compared, and no link is lost."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(64, 32))
    x = epsilon_grid._unit(np.repeat(centres, 32, axis=0) + 0.03 * rng.normal(size=(2048, 32)))
    values, vectors = np.linalg.eigh(np.cov(x.T))
    axes = vectors[:, np.argsort(-values)[: epsilon_grid.BOUND_DIMS]]
    eps = np.sqrt(2 - 2 * 0.98)
    x = x[np.lexsort(np.floor(x @ axes[:, : epsilon_grid.GRID_DIMS] / eps).T[::-1])]
    tree, found = epsilon_grid._tree(epsilon_grid.coordinates(x, axes)), []
    compared = epsilon_grid._descend(x, x, tree, tree, (0, len(x)), (0, len(x)), 0.98, True, found)
    assert sum(len(p) for p, _ in found) == (np.triu(x @ x.T >= 0.98, 1)).sum()
    assert compared < 0.5 * len(x) ** 2 / 2
