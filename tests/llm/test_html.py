"""Main text of pages."""

import re
from functools import cache
from html import unescape

from gleanbox.llm import html

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    got = html.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    return {r["page_id"]: r["text"] for r in got}


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in html.extract_main_text(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        want = " ".join(x for x in blocks if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_structure(spark):
    body = """<header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <main><h1>Title &amp;  more</h1><p>One<br>two <b>three</b>four<p>Five &lt;six&gt; &#233;<aside>Side</aside>
    <form><input><button>Go</button></form><div class="ad">Buy</div><blockquote>Quote</blockquote></main>
    <section id="comments"><p>Reader says</p></section><footer>&copy; foot</footer>"""
    assert texts(spark, [(1, "http://h/a", page(body))])[1] == "Title & more One two threefour Five <six> é Quote"


def test_remarks_in_article_form_and_broken_tags(spark):
    body = '<article class="post header"><p>Text</p></article><article class="comment odd"><p>Remark</p></article>'
    assert texts(spark, [(1, "http://h/a", page(body))])[1] == "Text"
    assert len(html.page_lines("<a " * 60_000 + "<p>end</p>")) >= 1
    assert html.page_lines('<p title="a > b">x < y</p>') == [("x < y", False, False)]


def test_differencing_without_a_content_element(spark):
    shared = "<div>Welcome to the example house of news</div><p>Today and every day</p>"
    rows = [(k, f"http://h/a/{k}", page(f"{shared}<p>{f'Own words number {k} stand here. ' * 9}</p><div>Call us any time</div>")) for k in range(5)]
    got = texts(spark, rows)
    assert got == {k: " ".join([f"Own words number {k} stand here."] * 9) for k in range(5)}


def test_copies_keep_their_text(spark):
    same = page("<p>" + "The whole page is a copy of its neighbour. " * 5 + "</p>")
    got = texts(spark, [(1, "http://h/a", same), (2, "http://h/b", same), (3, "http://other/a", same)])
    assert set(got.values()) == {("The whole page is a copy of its neighbour. " * 5).strip()}


def test_shared_article_lines_stay(spark):
    rows = [(k, f"http://h/{k}", page(f"<article><p>Quoted in both articles, word for word.</p><p>{f'own {k} ' * 20}</p></article>")) for k in (1, 2)]
    assert all(t.startswith("Quoted in both") for t in texts(spark, rows).values())


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://h", ""), (3, "x", "no markup"), (4, "x", "<p>open <b>bold<p>next"), (5, None, "<div><!-- c --><p>a</div>b"), (5, None, "<div><!-- c --><p>a</div>b"), (None, "x", "<p>q</p>"), (6, "x", "<p" + " a" * 50_000), (7, "x", "<script>never closed")]
    got = html.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    found = {(r["page_id"], r["text"]) for r in got}
    assert {(1, ""), (2, ""), (3, "no markup"), (4, "open bold next"), (5, "a b"), (None, "q"), (7, "")} <= found
    assert html.extract_main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shared_places_is_a_longest_common_subsequence():
    import random

    for seed in range(60):
        r = random.Random(seed)
        a, b = [r.randrange(5) for _ in range(r.randrange(9))], [r.randrange(5) for _ in range(r.randrange(9))]

        @cache
        def longest(i, j, a=tuple(a), b=tuple(b)):
            if i == len(a) or j == len(b):
                return 0
            return max(longest(i + 1, j), longest(i, j + 1), (1 + longest(i + 1, j + 1)) if a[i] == b[j] else 0)

        got = html.shared_places(a, b)
        assert len(got) == longest(0, 0) and got == sorted(set(got))
        rest = iter(b)
        assert all(a[i] in rest for i in got)


def test_neighbours_across_partitions(spark):
    rows = [(k, "h", f"p{k:03d}", [k], [5], 100) for k in range(50)]
    pages = spark.createDataFrame(rows, html._PAGE)
    got = {r["page_key"]: (r["before"] and r["before"]["page_key"], r["after"] and r["after"]["page_key"]) for r in html.with_neighbours(pages).collect()}
    assert got == {k: (k - 1 if k else None, k + 1 if k < 49 else None) for k in range(50)}


def test_differencing_decides_inside_a_content_element_too(spark):
    body = lambda k: f"<p>Lead paragraph {k}.</p><article><p>{f'Own words number {k} stand here. ' * 9}</p><p>Subscribers read more.</p></article><p>Call us any time</p>"
    got = texts(spark, [(k, f"http://h/a/{k}", page(body(k))) for k in range(4)])
    assert got == {k: f"Lead paragraph {k}. " + " ".join([f"Own words number {k} stand here."] * 9) for k in range(4)}


def test_shared_half_with_other_rest_is_no_copy(spark):
    shared = "<p>" + "The house of news greets every reader of these pages. " * 3 + "</p>"
    own = {0: "Rain fell in the north.", 1: "Two ships came into port at noon."}
    assert texts(spark, [(k, f"http://h/{k}", page(f"{shared}<p>{w}</p>")) for k, w in own.items()]) == own


def test_neighbour_but_one_at_the_ends_of_a_host(spark):
    rows = [(k, f"h{k // 25}", f"p{k:03d}", [k], [5], 100) for k in range(50)]
    got = {r["page_key"]: r["second"] and r["second"]["page_key"] for r in html.with_neighbours(spark.createDataFrame(rows, html._PAGE)).collect()}
    assert {k: v for k, v in got.items() if v is not None} == {0: 2, 24: 22, 25: 27, 49: 47}


def test_differencing_alone(spark, monkeypatch, prose):
    """Without any list of names, elements or roles, what pages share goes and their prose stays."""
    import numpy as np

    for name in ("AWAY", "ROLES", "CONTENT"):
        monkeypatch.setattr(html, name, set())
    monkeypatch.setattr(html, "_BOILER", re.compile("(?!)"))
    monkeypatch.setattr(html, "MENU_CHARS", 0)
    own = {k: [prose(100 * k + j, 40).replace("\n", " ") for j in range(3)] for k in range(6)}
    body = lambda k: "<nav><a>Home</a><p>All sections</p></nav><div class=ad>Buy two boats today</div><article>" + "".join(f"<p>{x}</p>" for x in own[k]) + "</article><footer>Call us any time</footer>"
    rows = [(k, f"http://h/a/{k}", page(body(k))) for k in range(6)]
    pages = {k: (k, *html.host_and_path(u), *html.line_columns(h)) for k, u, h in rows}
    for k in range(1, 5):
        gone, _ = html.deletions(pages[k], pages[k - 1], pages[k + 1])
        lines = [t for t, _, _ in html.page_lines(rows[k][2])]
        assert [t for n, t in enumerate(lines) if n not in gone] == own[k] and len(gone) == 4
    assert np.array_equal(html.last_row(np.array([1, 2]), np.array([2, 1, 2])), [0, 1, 1, 2])


def test_names_within_content_need_to_say_so():
    for name in ("ad-free", "search-results", "social-history", "widget-guide", "comment-policy-history"):
        assert html.page_lines(f'<main><div class="post {name}"><p>Prose</p></div></main>') == [("Prose", True, False)]
    for name in ("ad", "ad-box", "cookie-notice", "comments-list", "ad_3", "share-buttons", "newsletter"):
        assert html.page_lines(f'<main><div class="{name}"><p>Buy</p></div></main>')[0][2]


def test_hard_pages_take_linear_time_and_memory():
    import time
    import tracemalloc

    start = time.perf_counter()
    assert len(html.page_lines("<div>x" * 100_000)) == 100_000
    assert len(html.page_lines("<b>x<p>" * 50_000 + "</i></a>" * 50_000)) == 50_000
    assert time.perf_counter() - start < 20
    a = list(range(6_000))
    tracemalloc.start()
    assert len(html.shared_places(a, [x for k in range(0, 6_000, 2) for x in (k + 1, k)])) == 3_000
    assert tracemalloc.get_traced_memory()[1] < 10_000_000
    tracemalloc.stop()


def test_ends_of_raw_elements_and_references_across_tags():
    text = lambda page: html.main_text(page)[0]
    after = "<p>Hello world after</p></div>"
    for raw in ("<script>x</script foo>", "<script>x</script/>", "<style>x</style\n>", "<script src=x/>", "<iframe src=x/>", "<iframe src=x>", "<script>a </scripty> b</script>"):
        assert text(f"<div>{raw}{after}") == "Hello world after", raw
    assert text("<p>before</p><script>x <p>never</p>") == "before"
    assert text("<p>&am<b>p;</b> &amp; &lt;b&gt;</p>") == "&amp; & <b>"
    # many that nobody closes are passed in linear time
    assert text("<iframe>" * 20_000 + "<p>end</p>") == "end"


def test_empty_and_repeated_pages(spark):
    schema = "page_id long, url string, html string"
    assert html.extract_main_text(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "http://a/x", "<article><p>one page</p></article>")] * 3 + [(None, None, None)] * 2
    got = [tuple(r)[:4] for r in html.extract_main_text(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=repr) == sorted([(1, "http://a/x", "one page", 8)] * 3 + [(None, None, "", 0)] * 2, key=repr)


def test_lines_inside_content_go_only_if_they_recur(spark):
    """A quotation that three neighbours have stays; a line of nearly all pages of a section goes."""
    body = lambda k, more: f"<article><p>{f'Own words number {k} stand here. ' * 9}</p>{more}</article>"
    quoted, template = "<p>As the mayor said on Monday.</p>", "<p>Subscribers of this section read more.</p>"
    rows = [(k, f"http://h/news/{k:02d}", page(body(k, quoted if k in (3, 4, 5) else ""))) for k in range(10)]
    rows += [(k, f"http://h/sport/{k:02d}", page(body(k, template if k != 14 else ""))) for k in range(10, 20)]
    rows += [(k, f"http://few/{k}", page(body(k, template))) for k in (20, 21)]
    got = texts(spark, rows)
    own = {k: " ".join([f"Own words number {k} stand here."] * 9) for k in got}
    # pages 13, 14 and 15 have neighbours that don't share the line
    assert all(got[k] == own[k] for k in range(10) if k not in (3, 4, 5))
    assert all(got[k] == own[k] + " As the mayor said on Monday." for k in (3, 4, 5))
    assert all(got[k] == own[k] + " Subscribers of this section read more." for k in (20, 21))
    want = own_lines(rows)
    assert got == want


def own_lines(rows):
    """Pairing, deletion and extraction by plain loops: every page against all others of its host."""
    pages = {k: (*html.host_and_path(u), html.page_lines(h)) for k, u, h in rows}
    shared, repeated, of_page = {}, {}, {}
    for k, (host, path, lines) in pages.items():
        others = sorted((p, j) for j, (h, p, _) in pages.items() if h == host)
        at = others.index((path, k))
        near = [others[j][1] for j in (at - 1, at + 1) if 0 <= j < len(others)]
        near += [others[j][1] for j in (at - 2, at + 2) if len(near) == 1 and 0 <= j < len(others)]
        near.sort(key=lambda j: -html.shared_start(path, pages[j][1]))
        held = [{t for t, _, _ in pages[j][2]} for j in near]
        shared[k] = [bool(held) and t in held[0] for t, _, _ in lines]
        repeated[k] = {t for t, inside, _ in lines if inside and len(held) > 1 and t in held[0] and t in held[1]}
        of_page[k] = [(host, ""), (host, path.split("/")[0] + "/")][: 2 if "/" in path else 1]
    out = {}
    for k, (_, _, lines) in pages.items():
        gone = set()
        for level in of_page[k]:
            there = [j for j in pages if level in of_page[j]]
            for t in repeated[k]:
                n = sum(t in repeated[j] for j in there)
                gone |= {t} if n >= 3 and n >= 0.8 * len(there) else set()
        out[k] = " ".join(t for (t, inside, marked), both in zip(lines, shared[k], strict=True) if not marked and not (t in gone if inside else both))
    return out


def test_pairing_deletion_and_extraction_by_brute_force(spark):
    """Random pages of several hosts and sections, against plain loops over all pages."""
    import random

    r = random.Random(7)
    rows = []
    for k in range(160):
        host, section = f"h{r.randrange(3)}", r.choice(["", "a/", "b/", "c/"])
        own = [f"<p>{f'{host} {k} {j} own words. ' * 12}</p>" for j in range(2)]
        shared = [f"<p>Line {n} of {host}{section}</p>" for n in range(4) if r.random() < (0.95, 0.9, 0.3, 0.1)[n]]
        outside = f"<div>Call {host} any time</div>" if r.random() < 0.8 else ""
        rows.append((k, f"http://{host}/{section}{k:04d}", page(f"{outside}<article>{own[0]}{''.join(shared)}{own[1]}</article>")))
    got = texts(spark, rows)
    want = own_lines(rows)
    assert got == want
    assert any("Line 2" in t for t in got.values()) and not all("Line 0" in t for t in got.values())
