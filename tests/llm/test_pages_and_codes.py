"""op3, op4, op10 against brute force."""

import gzip
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import warc
from larkspur.llm.code_search import MultiIndex, search_vectors, sign_codes, top_k
from larkspur.llm.html_text import extract, host_paths, main_text
from larkspur.llm.warc import archive_pages, read_archives, write_archives


def pages(spark, rows):
    return spark.createDataFrame([(u, h, i, "clash") for i, u, h in rows], "url string, html string, page_id bigint, digest string")


BIG = "<p>" + "é" * 80 + "</p>"
ROWS = [(1, "http://a/1", BIG), (2, "http://a/2", "short"), (3, "http://a/3", BIG), (4, "http://b/ x\r\ny", "short"), (5, None, None), (6, "http://c", ""), (1, "http://a/1", BIG), (None, "http://n", BIG), (7, "http://c", "x" * 200_000)]


def test_archive_round_trip(spark):
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    want = []
    for i, _, h in ROWS:
        revisit = h == BIG and i not in (1, None)
        want.append((i, len((h or "").encode()), digest(h), "revisit" if revisit else "response", 1 if revisit else None))
    got = archive_pages(pages(spark, ROWS)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert archive_pages(pages(spark, [])).collect() == []


def test_selected_records_and_format(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/warc"
    index = write_archives(pages(spark, ROWS).coalesce(1), folder)
    back = read_archives(index.where("page_id in ('2', '7')"), folder, with_payload=True).collect()
    assert {r.page_id: bytes(r.payload) for r in back} == {"2": b"short", "7": b"x" * 200_000}
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "warc").iterdir())
    assert raw.count(b"WARC/1.1\r\n") == len(ROWS) and b"WARC-Target-URI: http://b/%20x%0D%0Ay\r\n" in raw
    monkeypatch.setattr(warc, "READ_BYTES", 10)
    assert read_archives(index, folder).count() == len(ROWS)


def test_page_ids_with_line_breaks(spark):
    rows = [("a\r\nWARC-Type: x", "http://a/", BIG), ("b %41\t", "http://b/", BIG), (" ", "u", ""), ("", "u", "")]
    got = archive_pages(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    first = min(rows[0][0], rows[1][0])
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == sorted((i, "revisit" if h == BIG and i != first else "response", first if h == BIG and i != first else None) for i, _, h in rows)


def test_damage_is_an_error(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    index = write_archives(pages(spark, ROWS), folder)
    with pytest.raises(Exception, match="digest"):
        read_archives(index.withColumn("digest", F.lit("0")), folder).collect()


# --- codes ---------------------------------------------------------------------------------------


def brute(codes, queries, k):
    out = []
    for q, c in queries:
        near = sorted(((c ^ x) & (1 << 64) - 1).bit_count() * 10**9 + i for i, x in codes)[:k]
        out += [(q, v % 10**9, v // 10**9, r + 1) for r, v in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "clustered", "equal", "few"])
def test_top_k(spark, kind):
    rnd = random.Random(kind)
    base = [rnd.getrandbits(63) for _ in range(5)]
    make = {"random": lambda: rnd.getrandbits(63), "clustered": lambda: rnd.choice(base) ^ (1 << rnd.randrange(63)), "equal": lambda: base[0], "few": lambda: rnd.getrandbits(63)}[kind]
    codes = [(i, make()) for i in range(4 if kind == "few" else 400)]
    df = spark.createDataFrame(codes, "id long, code long")
    queries = [c for c in codes if c[0] % 50 == 0]
    got = top_k(df.where("id % 50 = 0"), df, k=10, index_rows=90).collect()
    assert sorted((r.query_id, r.neighbor_id, r.distance, r["rank"]) for r in got) == brute(codes, queries, 10)


def test_search_stops_early():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, 20_000)
    near = codes[7] ^ np.int64(3)
    index = MultiIndex(np.arange(20_000), codes)
    rows, distances = index.search(np.uint64(near), 1)
    assert rows.tolist() == [7] and distances.tolist() == [2]


def test_vectors(spark):
    rows = [(0, [1.0, -1.0]), (50, [0.0, 2.0]), (3, None), (None, [1.0]), (4, []), (0, [1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((r.id, r.code) for r in sign_codes(df).collect()) == [(0, 1), (0, 1), (4, 0), (50, 2)]
    assert search_vectors(df, k=2).count() == 2 * 2
    assert search_vectors(df.limit(0)).collect() == []
    odd = spark.createDataFrame([(0, [float("nan"), None, float("inf"), float("-inf")])], "vec_id long, embedding array<float>")
    assert [r.code for r in sign_codes(odd).collect()] == [0b101]
    with pytest.raises(Exception, match="more than 64 elements"):
        sign_codes(spark.createDataFrame([(0, [1.0] * 65)], "vec_id long, embedding array<float>")).collect()


def test_long_codes(spark):
    rnd = random.Random(5)
    base = [rnd.choice([-1.0, 1.0]) for _ in range(100)]
    vectors = {i: [-x if rnd.random() < 0.1 * (i % 4) else x for x in base] for i in range(300)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    got = search_vectors(df, bits=100, k=4).collect()
    want = []
    for q in range(0, 300, 50):
        near = sorted((sum(a != b for a, b in zip(vectors[q], vectors[i], strict=True)), i) for i in vectors)[:4]
        want += [(q, i, d, r + 1) for r, (d, i) in enumerate(near)]
    assert sorted((r.query_id, r.neighbor_id, r.distance, r["rank"]) for r in got) == sorted(want)


def test_blocks_spread_over_the_cores(spark):
    codes = spark.range(20_000).select("id", F.xxhash64("id").alias("code"))
    few = codes.where("id % 500 = 0")
    one, many = (top_k(few, codes, k=5, spread_rows=s) for s in (1_000_000, 2000))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


# --- pages -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "html, want",
    [
        ("<nav>menu</nav><article><h1>T</h1><p>a &amp; b<br>c <b>d<p>e</article><footer>f</footer>", "T\na & b c d\ne"),
        ("<article><p>one<script>var x='</p>';</script> two<style>p{}</style></p><!-- no --></article>", "one two"),
        ("<div class='post'><p>text text text<ul><li>x<li>y</ul><div class='comments'><p>bad</div></div><aside>no</aside>", "text text text\nx\ny"),
        ("<main><table><tr><td>1<td>2</table><p>after the table</main>", "1\n2\nafter the table"),
        ("plain words only", "plain words only"),
        ("", ""),
        ("<p>a&nbsp;b&#233;&lt;i&gt;</p>", "a bé<i>"),
        ("<body><form><p>f</form><div id='cookie-notice'>c</div><article>" + "<p>body text</p>" * 2 + "</article>", "body text\nbody text"),
        ("<article><p title=\"a > b\">quoted</p><div class='ad-slot'>buy</div></article", "quoted"),
    ],
)
def test_extract(html, want):
    assert extract(html, None) == want


@pytest.mark.parametrize("mark", ["class='reader-comments'", "class='user-comments'", "id='disqus_thread'", "class='cookie-banner-text'", "class='commentList'", "id='article_comments_v2'"])
def test_comments_and_notices(mark):
    assert extract(f"<main><h1>Head</h1>{STORY}<div {mark}><p>bad one</p><p>bad two</p></div></main>", None) == "Head\nfirst words of the story\nand more of it"


def test_deep_pages_are_read_once():
    import time

    began = time.time()
    for page in ("<div>" * 60_000 + "x", "<ul><li>" + "<center>" * 20_000 + "<li>x</li>" * 20_000, "<div class=a1>" * 20_000 + "<p>x</p>" + "</div>" * 20_000):
        assert "x" in extract(page, ["/body/div"])
    assert time.time() - began < 20


STORY = "<p>first words of the story</p><p>and more of it</p>"


@pytest.mark.parametrize(
    "html",
    [
        f"<html class='no-notice'><body class='has-sidebar'><article>{STORY}</article><div class='sidebar'><p>bad</p></div></body></html>",
        f"<body><main class='with-header'>{STORY}</main><div class='site-footer'><p>bad</p></div></body>",
        f"<body><article class='post comments-open' id='share'>{STORY}<div class='comments'><p>bad</p></div></article></body>",
        f"<body><div class='nav-fixed'><div class='menu banner'><p>bad</p></div>{STORY}</div></body>",
        f"<body><div class='sidebar'><article>{STORY}</article></div><div class='cookieBanner'><p>bad</p></div></body>",
        f"<body><article>{STORY}</article><div class='comments'><p>{'bad ' * 50}</p></div></body>",
    ],
)
def test_layout_classes_do_not_empty_a_page(html):
    assert extract(html, None) == "first words of the story\nand more of it"


@pytest.mark.parametrize(
    "html, want",
    [
        ("<article><p>one</p>" + "İ" * 40 + "<script>x</script><p>two</p><p>three</p></article>", "one\n" + "İ" * 40 + "\ntwo\nthree"),
        ("<article><p>energy <math><mi>E</mi><annotation>tex</annotation></math> is <object>shown</object></p></article>", "energy E is shown"),
        ("<article><header><h1>Headline</h1></header><p class='social-history'>text of it</p><header class=share>bad</header></article>", "Headline\ntext of it"),
        ("<article><p>a < b and 1 <2</p><SCRIPT>x</Script ><p>after</p></article>", "a < b and 1 <2\nafter"),
        ("<div>" * 700 + "<p>deep</p>" + "</div>" * 700, "deep"),
        ("<div>" * 600 + "<nav><p>Home</p></nav><p>deep</p><aside>Buy this thing</aside><div class='menu'>Contact</div><p>end</p>" + "</div>" * 600, "deep\nend"),
        ("<article><blockquote><p>said</p><footer>a source</footer></blockquote></article>", "said\na source"),
        ("<article><p>kept</p><p title='cut off", "kept"),
    ],
)
def test_nothing_of_the_article_is_lost(html, want):
    assert extract(html, None) == want
    assert extract(html, ["/body/div.a.b.c.d.e-main", "/none"]) == want


def test_paths_tell_all_classes_apart():
    html = "<body><div class='a b c d e/main'><p>good words</p></div><div class='a b c d f-rel'><p>bad words</p></div></body>"
    assert extract(html, ["/none", "/body/div.a.b.c.d.e/main"]) == "good words"


@pytest.mark.parametrize("part", ['<p title="', "<a ", "<div>", "<p a='>", "<svg>", "</sv", "<", "<!-", "<ul><li>", "<p class='x y'>z", "<x y= "])
def test_malformed_pages_are_read_once(part):
    """A megabyte of it takes seconds; four times as much takes about four times as long, not sixteen."""

    def seconds(size):
        began = time.process_time()
        extract("<p>text</p>" + part * (size // len(part)), ["/body/div"])
        return time.process_time() - began

    seconds(1000)
    small, large = seconds(250_000), seconds(1_000_000)
    assert large < 10 * small + 1 and large < 12


LEAD, BODY, LATER = "a lead of some words " * 7, "the body of the article " * 80, "a later section of it " * 40


@pytest.mark.parametrize(
    "html",
    [
        "<article><h1>{h}</h1><div class=lead>{l}</div><div class=body>{b}</div></article>",
        "<main><h1>{h}</h1><article><div class=lead><p>{l}</p></div><div class=body><p>{b}</p></div></article></main>",
        "<body><div class=page><div class=top><h1>{h}</h1></div><div class=lead><p>{l}</p></div><section class=s1><p>{b}</p></section></div><footer>no</footer></body>",
        "<body><nav>no</nav><div class=post><h2>{h}</h2><p>{l}</p><div class=s1><p>{b}</p></div></div></body>",
    ],
)
def test_whole_article_of_nested_containers(spark, html):
    page = html.format(h="A heading", l=LEAD, b=BODY)
    want = "\n".join(["A heading", LEAD.strip(), BODY.strip()])
    assert extract(page, None) == want
    assert {r.text for r in main_text(pages(spark, [(i, "http://n/", page) for i in range(3)])).collect()} == {want}


def test_unequal_sections_and_several_templates(spark):
    """A host with two templates: each page's text is taken by its own template's path."""
    one = f"<body><div class=story><div class=s1><p>{BODY}</p></div><div class=s2><p>{LATER}</p></div></div></body>"
    two = f"<body><div class=story><p>a teaser</p></div><div class=report><p>{BODY}</p><p>{LATER}</p></div></body>"
    rows = [(i, "http://t/", one if i < 6 else two) for i in range(10)]
    got = {r.page_id: r.text for r in main_text(pages(spark, rows)).collect()}
    assert set(got.values()) == {f"{BODY.strip()}\n{LATER.strip()}"}


def test_whole_sample_matches_its_articles(spark):
    sf = "/root/testdata/sf0.001"
    import html as entities

    rows = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in main_text(rows).collect()}
    for r in rows.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_host_consensus(spark):
    """Most pages of the host have their text in div.story; one page has a longer block elsewhere."""
    page = lambda s, e: f"<body><div class='story'><p>{s}</p></div><div class='extra'><p>{e}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", page("long story text " * 5, "x")) for i in range(5)] + [(9, "HTTP://H.example/9", page("short story", "an odd block " * 20)), (10, None, None), (11, "http://z/", "<p>alone</p>")]
    got = {r.page_id: (r.text, r.n_chars) for r in main_text(pages(spark, rows)).collect()}
    assert got[9] == ("short story", 11) and got[10] == ("", 0) and got[11] == ("alone", 5)
    assert {r.host: r.path for r in host_paths(pages(spark, rows)).collect()}["h.example"] == "/body/div.story"
    assert main_text(pages(spark, [])).collect() == []
