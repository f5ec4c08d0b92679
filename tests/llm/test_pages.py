"""URL filter, archives and page extraction."""

import base64
import hashlib
import itertools
import random
import struct
import time

import pytest
import zstandard

from cellgrid.llm import html_extract, url_filter, warc

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LISTED = ("bad.com", "worse.org", "x.net")
URLS = [
    None, "", "nothing", "http://bad.com", "http://www.BAD.com/a?b#c", "http://notbad.com/", "https://x.example.net/en/1", "https://x.example.net/enough", "http://a.net", "http://a.net/", "ftp://worse.org/fr/1",
    "http://worse.org/de/", "http://example.com/de/x", "http://sub.example.com/de/", "http://example.com?/de/", "http://example.com#/de/", "://x/y", "http:///path", "http://org/fr/", "http://com", "a://b://c/d",
]


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:].split("?")[0].split("#")[0]
    best = max(((len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    bad = any(host == b or host.endswith("." + b) for b in LISTED)
    return host, path, best[1] if best else None, best[2] if best else "block" if bad else "allow"


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_urls(spark, limit):
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    listed = spark.createDataFrame([(b.upper(),) for b in LISTED] + [(None,)], "key string")
    got = url_filter.judge(pages, listed, RULES, ["page_id"], broadcast_bytes=limit).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: expected(u) for i, u in enumerate(URLS)}


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_odd_urls_and_columns(spark, limit):
    """Repeated pages, a very long url, a list beyond ASCII, and kept columns whose names need quotes."""
    long = "http://" + "a." * 500 + "bad.com/" + "x" * 200_000
    rows = [(1, "http://\u00c4X.example/", "p"), (1, "http://\u00c4X.example/", "p"), (2, "http://\u00e4x.example/", "q"), (3, long, "r"), (4, "http://fine.com/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, `a b` string")
    listed = spark.createDataFrame([("\u00c4X.Example",), ("BAD.com",)], "key string")
    got = url_filter.judge(pages, listed, (), ["page_id", "a b"], broadcast_bytes=limit)
    assert got.columns == ["page_id", "a b", "host", "path", "rule", "verdict"]
    assert sorted((r.page_id, r["a b"] or "", r.verdict) for r in got.collect()) == [(1, "p", "block"), (1, "p", "block"), (2, "q", "allow"), (3, "r", "block"), (4, "", "allow")]
    assert got.where("page_id = 3").selectExpr("length(path)").first()[0] == 200_001


def test_no_pages_and_no_list(spark):
    pages, listed = spark.createDataFrame([(1, "http://bad.com")], "page_id long, url string"), spark.createDataFrame([], "key string")
    assert url_filter.judge(pages, listed, (), ["page_id"]).first().verdict == "allow"
    assert url_filter.judge(pages.where("false"), listed, RULES, ["page_id"]).count() == 0


def test_cascade_is_exact_on_its_universe(spark, monkeypatch):
    rng = random.Random(1)
    keys = [f"k{i}.{rng.randrange(9)}" for i in range(6000)]
    listed, others = keys[:700], keys[700:]
    levels = url_filter.build(listed, others)
    assert len(levels) > 2
    assert all(url_filter.holds(levels, k) for k in listed) and not any(url_filter.holds(levels, k) for k in others)
    monkeypatch.setattr(url_filter, "SHARD_KEYS", 50)
    hosts = [f"h{i}.example" for i in range(300)]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(hosts)], "page_id long, url string")
    bad = set(hosts[::3])
    got = url_filter.judge(pages, spark.createDataFrame([(h,) for h in bad], "key string"), (), ["page_id"])
    assert {r.host for r in got.where("verdict = 'block'").collect()} == bad


PAYLOADS = ["<p>same</p>", "<p>same</p>", "", None, "", "unique é", "<p>same</p>", "x" * 300_000]


def expected_records(rows, least=0):
    first = {}
    for page, html in rows:
        body = (html or "").encode()
        if page is not None:
            first[body] = min(first.get(body, page), page)
    out = []
    for page, html in rows:
        body = (html or "").encode()
        again = len(body) >= least and body in first and page != first[body]
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, tmp_path, monkeypatch, least):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 40)
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 3000)
    rows = [(i + 5, p) for i, p in enumerate(PAYLOADS)] + [(None, "<p>same</p>"), (5, "<p>same</p>")] + [(100 + i, f"<html><body><p>page {i} of many with like words</p></body></html>") for i in range(200)]
    pages = spark.createDataFrame([(i, f"http://é.example/{i}\r\nx", h, "c") for i, h in rows], "page_id long, url string, html string, digest string")
    made = warc.write_archives(pages, f"file://{tmp_path}/warc", least)
    got = warc.read_archives(spark, made).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected_records(rows, least)
    names = [r.name for r in made.collect()]
    assert made.groupBy().sum("records").first()[0] == len(rows) and sorted(p.name for p in (tmp_path / "warc").iterdir()) == sorted(names)


def test_archive_is_standard(tmp_path):
    out = (tmp_path / "a").open("wb")
    w = warc.Writer(out)
    raws = [warc.record(i, "http://a/", f"<p>text number {i} and some more words that repeat</p>".encode() * 3, None if i else 7) for i in range(60)]
    for r in raws:
        w.add(r)
    w.close()
    out.close()
    data = (tmp_path / "a").read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and size > 0
    known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    rest, got = data[8 + size :], []
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
        got.append(one.decompress(rest))
        rest = one.unused_data
    assert got == raws, "each record is a frame of its own, in terms of the leading dictionary"
    assert list(warc.records((tmp_path / "a").open("rb"))) == raws
    assert raws[0].startswith(b"WARC/1.1\r\nWARC-Type: revisit") and b"WARC-Refers-To: <urn:page:7>" in raws[0]


def test_dictionary_makes_archives_smaller():
    import io

    raws = [warc.record(i, f"http://h{i % 9}.example/{i}", f"<html><head><title>Page {i}</title></head><body><nav>home news about</nav><p>{' '.join(f'w{(i * j) % 997}' for j in range(60))}</p></body></html>".encode(), None) for i in range(600)]
    out = io.BytesIO()
    w = warc.Writer(out)
    for r in raws:
        w.add(r)
    w.close()
    plain = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in raws)
    assert list(warc.records(io.BytesIO(out.getvalue()))) == raws and len(out.getvalue()) < 0.8 * plain


def test_attempt_that_fails_leaves_no_file(tmp_path, monkeypatch):
    import pyarrow as pa

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    def batches():
        yield pa.RecordBatch.from_pydict({"page_id": [1, 2], "url": ["http://a/", None], "html": ["<p>x</p>", None], "first": pa.array([None, None], pa.int64())})
        raise RuntimeError("lost")

    monkeypatch.setattr(warc, "TaskContext", Task)
    with pytest.raises(RuntimeError):
        list(warc._write(f"file://{tmp_path}/w")(batches()))
    assert list((tmp_path / "w").iterdir()) == []


def test_no_pages(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.write_archives(empty, f"file://{tmp_path}/w")).count() == 0


@pytest.fixture(scope="module")
def weights():
    return html_extract.fit()


def test_min_cut_is_least(weights):
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 9)
        gain = [rng.randrange(-9, 10) for _ in range(n)]
        links = [(a, b, rng.randrange(1, 8)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda keep: sum(abs(g) for g, k in zip(gain, keep) if (g > 0) != k and g) + sum(c for a, b, c in links if keep[a] != keep[b])
        assert cost(html_extract.min_cut(gain, links)) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_labelled_pages_are_cut_as_labelled(weights):
    wrong = total = 0
    for page in html_extract.LABELLED:
        signs = [b.text[0] == "+" for b in html_extract.parse(page)]
        bare = page.replace(">+", ">").replace(">-", ">")
        text = html_extract.main_text(bare, weights)
        want = [b.text for b, s in zip(html_extract.parse(bare), signs) if s]
        total += len(signs)
        wrong += len(set(want) ^ set(text.split("\n\n")))
    assert wrong <= 0.03 * total


def text(page, weights):
    return html_extract.main_text(page, weights)


def test_extraction(weights):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>gone</p> -->
    <div class="ad">Buy this fine thing at once.</div><article><h1>A &amp; B&nbsp;C</h1><p><b>First  line
    goes on.<br>after a break<p>Second &lt;p&gt; &#8364; &amp line.</p>loose text<p></p><p>Yes.</article><aside><p>Some related words that stand aside.</p></aside><footer>&copy; us</footer></body></html>"""
    assert text(page, weights) == "A & B C\n\nFirst line goes on. after a break\n\nSecond <p> € & line.\n\nloose text\n\nYes."
    assert text("<body><article><p>Real text of the page, which is long enough.</p><div id='comments'><p>I was here first, and I am glad of it.</p></div></article></body>", weights) == "Real text of the page, which is long enough."


def test_layout_classes_and_nested_boilerplate(weights):
    page = """<html class="no-ads"><body class="has-sidebar search-on"><header class="site-header"><h1>My site</h1><p>All the news that there is, each day.</p></header><div id="wrap" class="sidebar-right">
    <article class="post tag-ad category-news"><header><h1>Title</h1></header><p>One line of text, and then some more of it.</p><aside class="ad-slot">Buy this, it is good.</aside><div class="promo-box"><p>Our offer of the week, do not miss it at all.</p></div>
    <p>Short.</p><figure><img src=x><figcaption>A caption of the picture.</figcaption></figure><ul><li>first point</li><li>second point</li></ul><form><p>Subscribe for more of this.</p><input></form><p>Last one.</p>
    <div class="comments-area"><h3>2 comments</h3><ol class="comment-list"><li><p>I do not agree with this at all, sorry.</p></li></ol></div></article>
    <div class="widget-area sidebar"><h2>Popular</h2><p>The most read story of the week, with many words in it.</p></div></div><div class="cookie-consent"><p>We use cookies, as everyone does these days.</p></div><footer><p>Imprint and so on, for the law.</p></footer></body></html>"""
    want = ["Title", "One line of text, and then some more of it.", "Short.", "A caption of the picture.", "first point", "second point", "Last one."]
    assert text(page, weights).split("\n\n") == want
    page = """<body><div class="header"><p>Site of the town, since 1900.</p></div><div class="nav"><a href=a>Home</a></div><div class="elementor-widget"><h1>Plain</h1><p>No article element here, but text it is, in a number of words.</p><p>Yes.</p></div>
    <div class="comment"><p>What a fine page this is, I like it.</p></div><div class="footer">Contact</div></body>"""
    assert text(page, weights).split("\n\n") == ["Plain", "No article element here, but text it is, in a number of words.", "Yes."]


def test_odd_pages(weights, spark):
    for page in (None, "", "   ", "<p>", "<!-- never closed <p>x", "<script>while(1)", "<<<>>><", "<a href='", "</p></p></div>"):
        assert isinstance(text(page, weights), str)
    assert text("<!-- open <p>x</p>", weights) == "" and text("<script>x", weights) == ""
    long = "<article>" + "".join(f"<p>Paragraph {i} has some words in it.</p>" for i in range(5000)) + "</article>"
    assert text(long, weights).count("\n\n") == 4999
    deep = "<article>" + "<div>" * 3000 + "<p>Deep down there is a line of text.</p>"
    assert text(deep, weights) == "Deep down there is a line of text."
    rows = [(1, "u", None, 5), (2, None, "<article><p>Same text here.</p></article>", 5), (2, None, "<article><p>Same text here.</p></article>", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted(((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df, weights).collect())) == [(1, "", 0), (2, "Same text here.", 15), (2, "Same text here.", 15)]
    assert html_extract.extract(df.where("false"), weights).count() == 0


def test_svg_object_and_template_end_with_their_own_tag():
    from cellgrid.llm.html_extract import parse

    told = lambda page: [b.text for b in parse(page)]
    for hidden in ('<svg width="1"/>', "<svg />", "<object data=x>", "<template>", "<svg><path d='M0'/>", "<object/>", "<svg><svg/><text>no</text></svg>", "<svg><title/><style/></svg>", "<svg><svg>no</svg>no</svg>", "<template><div>no</div></template>", "<SVG><!-- </svg> -->no</SVG>", "<svg><style>a</svg></style>no</svg>"):
        for after in ("", "<svg><text>no</text></svg>", "<object></object><template>no</template>"):
            assert told(f"<div>{hidden}</div><p>The article.</p>{after}<p>More.</p>") == ["The article.", "More."], hidden + after
    assert told("<svg-icon></svg-icon><p>The article.</p>") == ["The article."]
    for page in ("<svg>" * 100_000, "<template>" * 50_000 + "</template>" * 50_000, "<svg><style>" * 50_000, "<template><!--" * 50_000):
        assert told(page) == []


def test_object_and_noscript_are_judged_as_text_where_they_stand(weights):
    page = "<article><p>The first line of the article, which is long enough.</p><object data=a.swf><p>What the film shows, told in words for those without.</p></object><p>The last line of the article.</p></article><noscript><p>Please switch on scripts.</p></noscript>"
    assert text(page, weights).split("\n\n") == ["The first line of the article, which is long enough.", "What the film shows, told in words for those without.", "The last line of the article."]
    assert text("<form><textarea>type here</textarea></form><p>One line of text, of ten words or a few more.</p>", weights) == "One line of text, of ten words or a few more."


@pytest.mark.parametrize("page", ["<div>some text here " * 50_000, "<div><b>x</b> text" * 30_000 + "</p>" * 1000, "<li>x<ul>" * 60_000, "<div class=ad>x<p>y." * 40_000, "<p>word" * 100_000])
def test_nested_pages_take_linear_time(weights, page):
    began = time.time()
    text(page, weights)
    assert time.time() - began < 30


def layouts(rng):
    """Pages of layouts that the labelled pages lack, each with its main text."""
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    body = [line(rng.randint(8, 40)) for _ in range(rng.randint(3, 9))]
    title = line(4)[:-1]
    links = "".join(f'<li><a href="/{word()}">{word().title()}</a></li>' for _ in range(6))
    paras = "".join(f"<p>{p}</p>" for p in body)
    want = "\n\n".join([title, *body])
    yield f'<body><table><tr><td class="nav"><ul>{links}</ul></td><td class="content"><h1>{title}</h1>{paras}</td></tr><tr><td class="footer">{line(5)}</td></tr></table></body>', want
    yield f'<body><div id="page"><div id="masthead">{line(6)}</div><div id="main"><section><h2>{title}</h2>{paras}</section></div><div class="related"><h4>More</h4><ul>{links}</ul></div></div></body>', want
    yield f"<body><nav><ol>{links}</ol></nav><main><div><div><h1>{title}</h1><div>{paras}</div></div></div></main><aside><p>{line(12)}</p></aside><footer><p>{line(9)}</p></footer></body>", want
    yield f'<body><main><h1>{title}</h1>{"".join(f"<blockquote><p>{p}</p></blockquote>" for p in body)}</main><section class="comments"><article><p>{line(14)}</p></article><article><p>{line(5)}</p></article></section></body>', want
    yield f'<body><div class="breadcrumb"><a href=/>{word()}</a> / <a href=/x>{word()}</a></div><article><h1>{title}</h1><dl>{"".join(f"<dd>{p}</dd>" for p in body)}</dl><div class="share"><a href=/s>{word()}</a></div></article><div class="cookie-banner"><p>{line(13)}</p></div></body>', want


def test_made_layouts_come_out_whole(weights):
    rng = random.Random(11)
    wrong = [(page, want) for _ in range(40) for page, want in layouts(rng) if text(page, weights) != want]
    assert len(wrong) <= 4, wrong[:2]
