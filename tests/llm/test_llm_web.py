"""WARC round trips and main text extraction."""

import base64
import hashlib
import random

import numpy as np
import pytest
import zstandard as zstd

from gridcut.llm.html_text import blocks_of, main_text, repeated
from gridcut.llm.warc import BundleReader, archive_folder, fetch, parse, read_archives, write_archives

SCHEMA = "page_id long, url string, html string, digest string"


def pages():
    rnd = random.Random(2)
    out = [(k, f"http://h/{k}", f"<p>{rnd.randrange(40)}</p>", "x") for k in range(300)]
    out += [(400 + k, None, None, None) for k in range(3)] + [(500, "http://h/a b\r\nX: y", "", "x")]
    out += [(600, "u", "é\r\n\r\nWARC/1.1 " * 200_000, "x"), (601, "u", "é\r\n\r\nWARC/1.1 " * 200_000, "x")]
    out += [(7, "http://h/7", out[7][2], "x"), (None, "n", "<p>1</p>", "x"), (None, "n", "alone", "x"), (None, "m", "alone", "x")]
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="module")
def index(spark):
    return write_archives(spark.createDataFrame(pages(), SCHEMA).repartition(3), archive_folder(spark))


def test_records_come_back(index):
    got = read_archives(index, payloads=True).collect()
    rows = pages()
    assert len(got) == len(rows)
    least = {}
    for i, _, h, _ in rows:
        if i is not None:
            least[h or ""] = min(least.get(h or "", 1 << 60), i)
    want = sorted((i or -1, h or "") for i, _, h, _ in rows)
    bodies = {least.get(h): h for h in least}
    seen = []
    for r in got:
        if r.record_type == "response":
            body = r.payload.decode()
            assert r.refers_to is None
        else:
            body = bodies[r.refers_to] if r.refers_to is not None else "alone"
            assert r.payload is None
        data = body.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        seen.append((r.page_id or -1, body))
    assert sorted(seen) == want
    assert sorted(r.page_id for r in got if r.record_type == "response" and r.page_id) == sorted(v for v in least.values() if v)
    assert sum(r.record_type == "response" for r in got) == len({h or "" for _, _, h, _ in rows})


def test_index_leads_to_records(spark, index):
    rows = index.collect()
    some = rows[:: len(rows) // 20]
    for r in some:
        fields, _, _, end = parse(BundleReader(r.bundle).frame(r.frame), r.offset)
        assert fields["WARC-Record-ID"] == f"<{r.record_id}>" and end == r.offset + r.length
    wanted = spark.createDataFrame([(3,), (600,), (600,), (99999,)], "page_id long")
    got = {r.page_id: bytes(r.payload) for r in fetch(index, wanted).collect()}
    assert set(got) == {3, 600} and got[600].decode() == "é\r\n\r\nWARC/1.1 " * 200_000


def test_bundles_are_plain_zstandard(index):
    path = index.first().bundle
    reader = BundleReader(path)
    with open(path.removeprefix("file:"), "rb") as f, zstd.ZstdDecompressor().stream_reader(f, read_across_frames=True) as plain:
        assert plain.read() == b"".join(reader.frame(k) for k in range(len(reader.frames)))


def test_small_payloads_and_no_pages(spark):
    rows = [(1, "u", "ab", "x"), (2, "u", "ab", "x"), (3, "u", "abcd", "x"), (4, "u", "abcd", "x")]
    got = read_archives(write_archives(spark.createDataFrame(rows, SCHEMA), archive_folder(spark), least_revisit_bytes=3))
    assert sorted((r.page_id, r.record_type) for r in got.collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    none = write_archives(spark.createDataFrame([], SCHEMA), archive_folder(spark))
    assert none.count() == 0 and read_archives(none).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use</div>
<!-- <p>no</p> --><article><header><h1>A &amp; B&nbsp;c</h1><span>by me</span></header><p>One <b>bold</b>
 two<br>three &lt;x&gt; &copy</p><aside>Side</aside><div class="ad slot"><div>Buy</div> now</div><p>Four<p>Five
<form><input><p>mail</p></form><figure><img src=a><figcaption>Cap</figcaption></figure><div id='comments'><p>Nice!</div></article>
<section class="comments"><p>First!</section><footer>F</footer></body></html>"""


def test_article_text(spark):
    rows = [(1, "http://h/1", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", PAGE, "x"), (1, "http://h/1", PAGE, "x")]
    rows += [(4, "http://h/4", PAGE[: PAGE.index("Four") + 2], "x"), (5, "http://h/5", "<article><p>" + "w " * 200_000, "x")]
    got = sorted(main_text(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: (r.page_id or 99))
    text = "A & B c\nOne bold two three <x> ©\nFour\nFive\nCap"
    assert [r.text for r in got] == [text, text, "", "", "A & B c\nOne bold two three <x> ©\nFo", ("w " * 200_000).strip(), text]
    assert all(r.n_chars == len(r.text) for r in got)
    assert main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pages_without_article_lose_what_their_host_repeats(spark):
    rnd = random.Random(3)
    own = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(40)) for _ in range(12)]
    shared = "this line of twelve words stands on every page of the host"
    page = "<html><body><div>{0}</div><div>{1}</div><nav>x</nav><div>s{2} {0} e{2}</div><p>short one</p></body></html>"
    rows = [(k, f"https://Host.example/{k}", page.format(shared, t, k), "x") for k, t in enumerate(own)]
    rows += [(100 + k, f"https://other.example/{k}", page.format(shared, t, k), "x") for k, t in enumerate(own[:2])]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, t in enumerate(own):
        assert got[k] == f"{t}\ns{k} e{k}\nshort one"
    assert got[100] == f"{shared}\n{own[0]}\ns0 {shared} e0\nshort one"


def test_repeated_runs_equal_brute_force():
    rnd = random.Random(4)
    for _ in range(40):
        streams = [[rnd.randrange(3) for _ in range(rnd.randint(0, 25))] for _ in range(8)]
        pages_of = [k // 2 for k in range(8)]
        for n, least in ((1, 2), (3, 2), (5, 3), (8, 2)):
            marks = [np.zeros(len(s), bool) for s in streams]
            held = {}
            for s, p in zip(streams, pages_of, strict=True):
                for i in range(len(s) - n + 1):
                    held.setdefault(tuple(s[i : i + n]), set()).add(p)
            for s, m in zip(streams, marks, strict=True):
                for i in range(len(s) - n + 1):
                    if len(held[tuple(s[i : i + n])]) >= least:
                        m[i : i + n] = True
            got = repeated(streams, pages_of, n, least)
            assert all((a == b).all() for a, b in zip(got, marks, strict=True))


def test_tags_cut_off_anywhere():
    for k in range(len(PAGE)):
        blocks_of(PAGE[:k])


@pytest.mark.parametrize(
    "page",
    [
        "<article>{0}<p class='ad'>Buy<p>{1}</article>{2}",
        "<article>{0}<ul><li class='menu'>Buy<li>{1}</ul></article>{2}",
        "<article>{0}<table><tr><td class='sidebar'>Buy<td>{1}<tr><td>{3}</table></article>{2}",
        "<article>{0}<dl><dt class='ad'>Buy<dd>{1}</dl></article>{2}",
        "<article>{0}<section><div class='ad'>Buy<p>Now</section><p>{1}</article>{2}",
        "<div class='ad'>Buy<article>{0}<p>{1}</article>{2}",
        "<html><head><meta charset=utf-8><title>T</title><body><article>{0}<p>{1}</article>{2}",
        "<nav><ul><li>Menu<li>More<article>{0}<p>{1}</article>{2}",
        "<article>{0}<datalist><option class='ad'>Buy<option>{1}</datalist></article>{2}",
    ],
)
def test_dropped_elements_end_without_an_end_tag(page):
    found = blocks_of(page.format("First words", "second words", "<p>after it</p>", "third words"))
    kept = [b.text for b in found if b.article and not b.dropped]
    assert kept[:2] == ["First words", "second words"] and "Buy" not in kept
    assert [b.text for b in found if not b.article][-1] == "after it"


def test_tags_are_read_in_linear_time():
    import time

    for page in ("<div class=ad><p>" * 30_000, "<i><div>" + "<b>" * 60_000 + "</i>" * 60_000, "<aside><article>" * 30_000):
        start = time.monotonic()
        blocks_of(page)
        assert time.monotonic() - start < 5


@pytest.mark.parametrize(
    ("open_", "close"),
    [
        ("<article class='post has-sidebar'>", "</article>"),
        ("<main class='with-sidebar'>", "</main>"),
        ("<article class='comment'>", "</article>"),
        ("<div class='site-content comments-open'><article>", "</article></div>"),
        ("<div class='page no-header'><article>", "</article></div>"),
        ("<div id='sidebar'><main>", "</main></div>"),
        ("<article><section class='related-work'>", "</section></article>"),
        ("<article><div data-role='banner'>", "</div></article>"),
        ("<form class='search'><article>", "</article></form>"),
    ],
)
def test_names_do_not_drop_an_article(open_, close):
    found = blocks_of(f"<body>{open_}<h1>Head</h1><p>Words</p>{close}</body>")
    assert [(b.text, b.article, b.dropped) for b in found] == [("Head", True, False), ("Words", True, False)]


def test_names_that_drop():
    for name in "ad ad-slot ad-slot-2 site-header main_nav sidebar-left cookie-notice comments-area related-posts widget".split():
        assert [b.dropped for b in blocks_of(f"<article><div class='x {name}'>Buy</div></article>")] == [True]


def test_host_judges_what_stands_outside_of_articles(spark):
    rnd = random.Random(5)
    own = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(30)) for _ in range(8)]
    teaser = "the same teaser card with more than eight words in it on every page"
    menu = "".join(f"<div>{w}</div>" for w in "Home Products About News Contact Imprint Terms Privacy Jobs Press".split())
    page = "<body>{0}<article class='card'><p>{1}</p></article><div class='text'><p>{2}</p></div></body>"
    rows = [(k, f"http://h/{k}", page.format(menu, teaser, t), "x") for k, t in enumerate(own)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: f"{teaser}\n{t}" for k, t in enumerate(own)}


def test_runs_count_over_the_whole_host(spark, monkeypatch):
    """Whether a host is one group or one for about each page, the same runs go."""
    from gridcut.llm import html_text

    rnd = random.Random(6)
    own = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(30)) for _ in range(900)]
    menu = "".join(f"<div>{w}</div>" for w in "Home Products About News Contact Imprint Terms Privacy Jobs Press".split())
    thrice, twice = "a run of nine words that stands on three", "another run of nine words that is on two"
    rows = [(k, f"http://h/{k}", f"<body>{menu}<p>{t}</p></body>", "x") for k, t in enumerate(own[:60])]
    rows += [(k, f"http://h/{k}", f"<body><p>{t}</p></body>", "x") for k, t in enumerate(own) if k >= 60]
    for at, run in ((100, thrice), (101, thrice), (700, thrice), (200, twice), (800, twice)):
        rows[at] = (at, "http://h/x", f"<body><p>{own[at]}</p><p>{run}</p></body>", "x")
    want = {k: t + (f"\n{twice}" if k in (200, 800) else "") for k, t in enumerate(own)}
    for size in (8 << 20, 4000):
        monkeypatch.setattr(html_text, "GROUP_BYTES", size)
        got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == want


def test_bundles_are_read_in_tasks_of_their_own(spark, monkeypatch):
    import gridcut.llm.warc as module

    monkeypatch.setattr(module, "BUNDLE_BYTES", 1)
    rows = [(k, f"u{k}", f"page {k} " * 50) for k in range(60)]
    index = write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), archive_folder(spark))
    bundles = index.select("bundle").distinct().count()
    read = read_archives(index)
    assert bundles >= 40 and read.rdd.getNumPartitions() >= bundles // 2 and read.count() == 60
    got = fetch(index, spark.range(50).selectExpr("id AS page_id"))
    assert got.rdd.getNumPartitions() >= 20 and got.count() == 50


@pytest.mark.parametrize(
    "page,kept",
    [
        ("<article><p>main</p></article><div id='comments'><ol><li class='comment'><article class='comment-body'><p>x</p></article></li></ol></div>", "main"),
        ("<article><p>main</p><section class='comments'><article><p>x</p></article></section></article>", "main"),
        ("<main><p>main</p><article class='comment'><p>x</p></article><p>more</p></main>", "main\nmore"),
        ("<article><p>main</p></article><div class='sidebar'><article class='teaser'><p>x</p></article></div>", "main"),
        ("<div class='related-posts'><article><p>x</p></article></div><article><p>main</p></article>", "main"),
        ("<div class='ad'><article><p>x</p></article></div><article><p>main</p></article><article class='card'>y</article>", "main"),
        ("<article><h2 id='search'>Search</h2><p>a</p><h2 id='navigation'>Nav</h2><h3 id='social'>Soc</h3></article>", "Search\na\nNav\nSoc"),
        ("<article><p hidden>x</p><p>main</p><p style='color:red; display : none'>y</p><p class='hidden-gem'>gem</p></article>", "main\ngem"),
        ("<article><p data-hidden='1' title='hidden none'>main</p><div hidden><article>x</article></div></article>", "main"),
        ("<div class='sidebar'><article><p>only</p></article></div>", "only"),
        ("<article class='teaser'><p>only</p></article>", "only"),
        ("<div class='comments'><main><p>only</p></main></div>", "only"),
        ("<article class='post-card-list'><p>main</p></article>", "main"),
    ],
)
def test_articles_beside_the_main_text_and_hidden_parts_go(page, kept):
    assert "\n".join(b.text for b in blocks_of(page) if not b.dropped) == kept
