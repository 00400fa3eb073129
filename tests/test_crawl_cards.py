"""Page planning, page walks, card rules of each site, and article selection."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.functions import text
from tidewatch.operators import cards, crawl
from tidewatch.plans import jobs

DAY = "2025-06-03"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_seed_pages(spark):
    seeds = spark.createDataFrame([(" Kairos", "k.onion"), ("PLAY", "p.onion"), (None, "n.onion"), ("x y", None)], schemas.SEED)
    got = {(r.group, r.page): (r.url, r.file_name) for r in crawl.seed_pages(seeds, DAY).collect()}
    assert len(got) == 15
    assert got["kairos", 1] == ("http://k.onion/", "kairos_20250603_page1.html")
    assert got["kairos", 2][0] == "http://k.onion/?PAGEN_1=2"
    assert got["play", 5][0] == "http://p.onion/index.php?page=5"
    assert got["unknown_group", 3] == ("http://n.onion/?page=3", "unknown_group_20250603_page3.html")


def test_page_walk_stops(spark):
    log = spark.createDataFrame(
        [("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, False), ("c", 1, True), ("c", 2, True)], schemas.FETCH_LOG
    )
    before = crawl.page_walk(log, ["fqdn"], ~F.col("ok"), keep_stop=False)
    assert rows(before, "fqdn", "page") == [("a", 1), ("c", 1), ("c", 2)]
    upto = crawl.page_walk(log, ["fqdn"], ~F.col("ok"), keep_stop=True, limit=1)
    assert rows(upto, "fqdn", "page") == [("a", 1), ("b", 1), ("c", 1)]


def test_expand_seed_pages(spark):
    seeds = spark.createDataFrame([("g", "a.onion"), ("h", "b.onion")], schemas.SEED)
    log = spark.createDataFrame([("a.onion", 1, True), ("a.onion", 2, True), ("a.onion", 3, False), ("a.onion", 4, True)], schemas.FETCH_LOG)
    assert rows(jobs.expand_seed_pages(seeds, log, DAY), "fqdn", "page") == [("a.onion", 1), ("a.onion", 2)]


def test_listing_pages(spark):
    listings = spark.createDataFrame(
        [("http://b/list.asp?a=1", "page_arg"), ("http://b/list", "page_arg"), ("http://s/", "main_query"), ("http://s/c", "path"), ("http://t/", "single")],
        "listing string, style string",
    )
    assert rows(crawl.listing_pages(listings, 2), "url") == sorted([
        ("http://b/list.asp?a=1&Page=1",), ("http://b/list.asp?a=1&Page=2",), ("http://b/list?Page=1",), ("http://b/list?Page=2",),
        ("http://s/",), ("http://s/?page=2#latest_news_section",), ("http://s/c",), ("http://s/c/page/2",), ("http://t/",),
    ])


def test_category_links(spark):
    menu = ('<a href="https://www.boannews.com/media/view.asp?idx=9">article</a><ul class="m" id="main_menu_hash"><ul><li></ul>'
            '<a class="m" href="https://www.boannews.com/media/list.asp?a=1&amp;b=2">A</a><a href=\'https://x.com/media/\'>x</a>'
            '<A HREF="/search/list.asp">S</A></ul><a href="/media/x.asp">after</a>')
    df = spark.createDataFrame([(menu,)], "html string")
    assert df.select(crawl.category_links(F.col("html"))).first()[0] == [
        "https://www.boannews.com/media/list.asp?a=1&b=2", "https://www.boannews.com/search/list.asp",
    ]


LISTINGS = {
    "boannews": """<html><div class="news_list"><a href="/media/view.asp?idx=1&amp;k=2"><span class="news_txt">제목 하나</span></a>
      <a class="news_content" href="/media/view.asp?idx=1">요약 하나</a><span class="news_writer">홍길동 | 2025년 06월 03일 10:00</span></div>
      <div class="news_main x"><a href="/media/view.asp?idx=2"><div class="news_main_title">Second</div></a>
      <div class="news_main_txt">sum</div>2025년 6월 2일</div><div class="news_list"><span class="news_txt">no link</span></div></html>""",
    "securityweek": """<article class="zox-art-wrap a"><a href="https://sw/1" rel="bookmark"><div class="img-ratio"><img src="https://sw/1.jpg"></div></a>
      <h2 class="zox-s-title2">One &amp; only</h2><meta itemprop="dateModified" content="2025-06-03"><p class="zox-s-graph">Sum  one</p></article>
      <article class="zox-art-wrap"><a rel="bookmark" href="https://sw/2"></a><h2 class="zox-s-title2">Old</h2><meta content="2025-06-02" itemprop="dateModified"/></article>""",
    "gbhackers": "".join(
        f'<div class="td_module_10 td td-module-container"><h3 class="entry-title td"><a href="https://gb/{i}">G{i}</a></h3></div>' for i in range(1, 8)
    ),
    "security_affairs": """<div class="banner-content"><p class="date">June 03, 2025</p><h1><a href="https://sa/1">Banner</a></h1></div>
      <div class="sngl-article"><h6><a href="https://sa/2">Single</a></h6><div class="post-time"><span>June 02, 2025</span></div></div>
      <div class="news-card-cont"><div class="post-time"><span>Pierluigi</span><span>June 03, 2025</span></div><h5><a href="https://sa/3">Card</a></h5></div>""",
    "thehackernews": "".join(
        f'<div class="body-post clear"><a class="story-link" href="https://th/{i}"><div class="img-ratio"><img src="https://th/{i}.png"></div>'
        f'<h2 class="home-title">H{i}</h2></a></div>' for i in range(1, 7)
    ),
    "bleeping_computer": """<ul><li><div class="bc_latest_news_img"><img src="x"></div><h4><a href="https://www.bleepingcomputer.com/news/security/a/">B one</a></h4>
      <p>Sum b</p><ul><li class="bc_news_date">Jun 03, 2025</li></ul></li><li><h4><a href="https://sponsor.com/">Ad</a></h4><ul><li class="bc_news_date">Jun 03, 2025</li></ul></li></ul>""",
}


@pytest.fixture(scope="module")
def found(spark):
    listing = spark.createDataFrame(
        [(site, "main", 0, 1, html) for site, html in LISTINGS.items()],
        "site string, category string, category_rank int, page int, html string",
    )
    return [r for r in cards.extract_cards(listing).orderBy("site", "position").collect()]


def of_site(found, site):
    return [(r.position, r.title, r.url, str(r.date) if r.date else None, r.summary) for r in found if r.site == site]


def test_cards_of_each_site(found):
    assert of_site(found, "boannews") == [
        (1, "제목 하나", "https://www.boannews.com/media/view.asp?idx=1&k=2", DAY, "요약 하나"),
        (2, "Second", "https://www.boannews.com/media/view.asp?idx=2", "2025-06-02", "sum"),
    ]
    assert of_site(found, "securityweek") == [
        (1, "One & only", "https://sw/1", DAY, "Sum one"), (2, "Old", "https://sw/2", "2025-06-02", ""),
    ]
    assert [r[2] for r in of_site(found, "gbhackers")] == [f"https://gb/{i}" for i in range(1, 8)]
    assert [(r[1], r[3]) for r in of_site(found, "security_affairs")] == [
        ("Banner", DAY), ("Single", "2025-06-02"), ("Card", DAY),
    ]
    assert of_site(found, "thehackernews")[0] == (1, "H1", "https://th/1", None, "")
    assert of_site(found, "bleeping_computer") == [
        (1, "B one", "https://www.bleepingcomputer.com/news/security/a/", DAY, "Sum b"),
    ]
    images = {(r.site, r.position): r.image for r in found}
    assert images["securityweek", 1] == "https://sw/1.jpg" and images["thehackernews", 2] == "https://th/2.png"


def articles():
    shown = {"gbhackers": '<time class="entry-date" datetime="x">June 3, 2025</time>', "thehackernews": '<div class="postmeta"><span class="author">Jun 03, 2025</span></div>'}
    body = {
        "boannews": '<div id="news_content">본문<br>둘째 줄</div>', "securityweek": '<div class="zox-post-body"><p>One</p><p> </p><p>Two <b>b</b></p></div>',
        "gbhackers": '<div class="td-post-content"><p>G</p><img src="x.png" data-src="https://i/g.png"></div>',
        "security_affairs": '<div class="article-details-block"><p>S</p><img src="https://i/s.svg"><img src="https://i/s.jpg"></div>',
        "thehackernews": '<div class="articlebody"><p>T</p></div>', "bleeping_computer": '<div class="articleBody"><p>B</p></div>',
    }
    urls = {
        "boannews": ["https://www.boannews.com/media/view.asp?idx=1&k=2"], "securityweek": ["https://sw/1", "https://sw/2"],
        "gbhackers": [f"https://gb/{i}" for i in range(1, 8)], "security_affairs": [f"https://sa/{i}" for i in (1, 2, 3)],
        "thehackernews": [f"https://th/{i}" for i in range(1, 7)], "bleeping_computer": ["https://www.bleepingcomputer.com/news/security/a/"],
    }
    out = []
    for site, addresses in urls.items():
        for url in addresses:
            page = shown.get(site, "") + body[site]
            if url == "https://gb/2":
                page = page.replace("June 3", "June 2")
            if url == "https://th/1":
                page = shown[site] + '<div class="articlebody"><p> </p></div>'
            out.append((site, url, f"<html><body>{page}</body></html>"))
    return out


def test_select_articles(spark):
    listing = spark.createDataFrame(
        [(site, "main", 0, 1, html) for site, html in LISTINGS.items()]
        + [("gbhackers", "apt", 1, 1, LISTINGS["gbhackers"])],
        "site string, category string, category_rank int, page int, html string",
    )
    pages = spark.createDataFrame(articles(), "site string, url string, html string")
    got = {(r.site, r.url): r for r in jobs.select_articles(listing, pages, DAY).collect()}
    urls = sorted(key for key in got)
    assert urls == sorted(
        [("boannews", "https://www.boannews.com/media/view.asp?idx=1&k=2"), ("securityweek", "https://sw/1"),
         ("security_affairs", "https://sa/1"), ("security_affairs", "https://sa/3"),
         ("bleeping_computer", "https://www.bleepingcomputer.com/news/security/a/")]
        # The main listing takes five whatever their date; the category's cards were seen before.
        + [("gbhackers", f"https://gb/{i}") for i in range(1, 6)]
        # Four cards per listing, and the first has no paragraph.
        + [("thehackernews", f"https://th/{i}") for i in (2, 3, 4)]
    )
    assert got["securityweek", "https://sw/1"].body == "One\n\nTwo b"
    assert got["boannews", "https://www.boannews.com/media/view.asp?idx=1&k=2"].body == "본문\n둘째 줄"
    assert got["gbhackers", "https://gb/1"].images == ["https://i/g.png"]
    assert got["security_affairs", "https://sa/1"].images == ["https://i/s.jpg"]
    assert got["security_affairs", "https://sa/3"].seq == 2
    assert got["security_affairs", "https://sa/3"].path == "security_affairs/June 03, 2025/main_2_card/article.txt"
    assert got["thehackernews", "https://th/4"].path == f"thehackernews/{DAY}/main_4_h4/article.txt"
    assert got["bleeping_computer", "https://www.bleepingcomputer.com/news/security/a/"].path == "bleeping_computer/Jun 03, 2025/1_b_one/article.txt"
    assert got["boannews", "https://www.boannews.com/media/view.asp?idx=1&k=2"].path == f"boannews/{DAY}/1_제목_하나/article.txt"
    assert got["gbhackers", "https://gb/1"].text == "제목: G1\nURL: https://gb/1\n\nG"
    assert got["securityweek", "https://sw/1"].text == (
        f"제목: One & only\nURL: https://sw/1\n날짜: {DAY}\n\n요약: Sum one\n\n본문:\nOne\n\nTwo b"
    )


@pytest.mark.parametrize("sizes", [{}, {"pages_per_block": 2, "rows_per_bucket": 2}])
def test_numbers_run_over_pages(spark, sizes):
    cards_ = [("s", c, p, o) for c, p, o in [("c", 1, 1), ("c", 1, 3), ("c", 1, 4), ("c", 2, 1), ("c", 5, 2), ("c", 5, 9), ("d", 2, 5), ("d", 3, 1)]]
    df = spark.createDataFrame(cards_, "site string, category string, page int, position int")
    numbered = crawl.number_in_listing(df, ["site", "category"], "page", "position", **sizes)
    got = rows(numbered, "category", "page", "position", "seq")
    assert got == [
        ("c", 1, 1, 1), ("c", 1, 3, 2), ("c", 1, 4, 3), ("c", 2, 1, 4), ("c", 5, 2, 5), ("c", 5, 9, 6), ("d", 2, 5, 1), ("d", 3, 1, 2),
    ]


def test_element_ends_at_its_own_tag(spark):
    pages = [
        '<div id="a">one<div>two</div>three<p>four</p></div>five', '<DIV ID="a"><divider></divider>x</DIV>y',
        '<div id="a">open <div>inner</div> to the end', "<p>none</p>", None, '<div id="a"></div>',
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    found = df.orderBy("i").select(text.element(F.col("html"), r'(?i)<div\b[^>]*id="a"[^>]*>', "div")).collect()
    assert [r[0] for r in found] == [
        "one<div>two</div>three<p>four</p>", "<divider></divider>x", "open <div>inner</div> to the end", None, None, "",
    ]


def test_images_by_site(spark):
    tags = '<img src="https://a/1.jpg" data-src="https://a/2.svg"><img src="https://a/3.svg">'
    df = spark.createDataFrame([(tags,)], "html string")
    row = df.select(
        cards.image_links(F.col("html"), True, True), cards.image_links(F.col("html"), False, False)
    ).first()
    assert row[0] == ["https://a/2.svg", "https://a/3.svg"] and row[1] == ["https://a/1.jpg"]


def test_repeated_article_pages_count_once(spark):
    listing = spark.createDataFrame(
        [("boannews", "main", 0, 1, LISTINGS["boannews"])],
        "site string, category string, category_rank int, page int, html string",
    )
    url = "https://www.boannews.com/media/view.asp?idx=1&k=2"
    pages = spark.createDataFrame(
        [("boannews", url, f'<div id="news_content">copy {n}</div>', n) for n in (1, 3, 2)],
        "site string, url string, html string, saved int",
    )
    (got,) = jobs.select_articles(listing, pages, DAY, newest_by="saved").collect()
    assert got.body == "copy 3"
