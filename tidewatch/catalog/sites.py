"""Each watched site's listing and article pages, built around all given pages, through the news job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog.pages import BODY_SQL, sql_inner
from tidewatch.catalog.registry import query, table
from tidewatch.operators import cards
from tidewatch.plans import jobs

AS_OF = "2024-03-05"
_OLD = "2024-03-04"

# Paragraphs of the whole page; what is not an article in it has none.
_PARAGRAPHS = BODY_SQL
_TITLE = sql_inner("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")


def _expected(
    site: str, url: str, text: str, name: str, body: str, keep: str = "page_id % 3 <> 0", images: str = "''"
) -> str:
    """What the job stores for each page with a title: of two thirds the card is of the day."""
    slug = (
        "substr(regexp_replace(regexp_replace(title, '[^a-zA-Z0-9가-힣]', '_', 'g'), '_+', '_', 'g'), 1, 80)"
        if site == "boannews"
        else "lower(regexp_replace(title, '[^a-zA-Z0-9]', '_', 'g'))"
    )
    return f"""
WITH p AS (SELECT page_id, {_TITLE} AS title, {body} AS body FROM pages),
n AS (
  SELECT *, {url} AS url, 'c' || page_id % 4 AS category, row_number() OVER (PARTITION BY page_id % 4 ORDER BY page_id) AS seq
  FROM p WHERE title <> '' AND {keep}
)
SELECT page_id, url, md5({text}) AS text_md5, '{site}/' || {name} || '_' || {slug} || '/article.txt' AS path, {images} AS images
FROM n
"""


def _text(*lines: str) -> str:
    return " || chr(10) || ".join(["'제목: ' || title", "'URL: ' || url", *lines])


def _stored(
    spark: SparkSession, sf_dir: str, site: str, listing: Callable[[Column, Column, Column], Column], article: Column, url: Column
) -> DataFrame:
    """``listing(title, key, today)`` is a page's listing; the job reads it and the article pages of the site."""
    pages = table(spark, sf_dir, "pages")
    key = F.col("page_id").cast("string")
    title = F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)
    listings = pages.select(
        F.lit(site).alias("site"),
        F.concat(F.lit("c"), (F.col("page_id") % 4).cast("string")).alias("category"),
        (F.col("page_id") % 4).alias("category_rank"),
        F.col("page_id").alias("page"),
        listing(title, key, F.col("page_id") % 3 != 0).alias("html"),
    )
    articles = pages.select(F.lit(site).alias("site"), url.alias("url"), article.alias("html"))
    rules = [r for r in cards.SITE_RULES if r.site == site]
    found = jobs.select_articles(listings, articles, AS_OF, rules)
    return found.select(
        F.col("page").alias("page_id"), "url", F.md5("text").alias("text_md5"), "path",
        F.array_join("images", ";").alias("images"),
    )


def _html(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _page_title() -> Column:
    return F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)


def _key() -> Column:
    return F.col("page_id").cast("string")


@query(
    _expected(
        "boannews",
        "'https://www.boannews.com/media/view.asp?idx=' || page_id",
        _text(f"'날짜: {AS_OF}'", "''", "'요약: about ' || page_id", "''", "'본문:'", "body || chr(10) || 'end ' || page_id"),
        f"'{AS_OF}/' || seq",
        _TITLE,
    )
)
def site_boannews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of cards by turns; the writer's line has the date, and the summary another one."""

    def listing(title: Column, key: Column, today: Column) -> Column:
        day = F.when(today, "2024년 03월 05일").otherwise("2024년 03월 04일")
        link = _html('<a href="/media/view.asp?idx=', key, '">')
        plain = _html(
            '<div class="news_list">', link, '<span class="news_txt">', title, '</span></a><a class="news_content">about ', key,
            '</a><span class="news_writer">Kim 2020 | ', day, " 10:00</span></div>",
        )
        main = _html(
            '<div class="a news_main">', link, '<div class="news_main_title">', title,
            '</div></a><div class="news_main_txt"><i>about</i> ', key, "</div>", day, "</div>",
        )
        return _html('<div class="news_list"><span class="news_txt">no link</span></div>', F.when(F.col("page_id") % 2 == 0, plain).otherwise(main))

    article = _html('<div>before</div><div id="news_content">', _page_title(), "<div>end ", _key(), "</div></div>after")
    return _stored(spark, sf_dir, "boannews", listing, article, _html("https://www.boannews.com/media/view.asp?idx=", _key()))


@query(
    _expected(
        "securityweek",
        "'https://sw/' || page_id || '/'",
        _text(
            f"'날짜: {AS_OF}'", "''", "'요약: sum ' || page_id", "''", "'본문:'",
            "CASE WHEN body = '' THEN '(본문 없음)' ELSE body END",
        ),
        f"'{AS_OF}/' || seq",
        _PARAGRAPHS,
    )
)
def site_securityweek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date stands in a meta element beside others; the body is all paragraphs of the given page."""

    def listing(title: Column, key: Column, today: Column) -> Column:
        return _html(
            '<article class="zox-art-wrap zox"><a href="/other">x</a><a rel="bookmark" href="https://sw/', key, '/"><div></div></a>'
            '<h2 class="zox-s-title2">', title, '</h2><meta itemprop="datePublished" content="1999-01-01">'
            '<meta content="', F.when(today, AS_OF).otherwise(_OLD), '" itemprop="dateModified"/><p class="zox-s-graph">sum ', key,
            '</p></article><article><a rel="bookmark" href="https://sw/x">no card</a></article>',
        )

    article = _html("<p>before</p><div class='zox-post-body x'>", F.col("html"), "</div><p>after</p>")
    return _stored(spark, sf_dir, "securityweek", listing, article, _html("https://sw/", _key(), "/"))


@query(
    _expected(
        "gbhackers",
        "'https://gb/' || page_id",
        _text("''", "body || chr(10) || 'end'"),
        f"'{AS_OF}/' || category || '_2'",
        _TITLE,
        images="'https://i/' || page_id || '.svg'",
    )
)
def site_gbhackers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of four links, of which three count; the article shows the date, and its images load late."""

    def listing(title: Column, key: Column, today: Column) -> Column:
        def card(name: str, link: Column, text: Column | str) -> Column:
            return _html(f'<div class="{name} x"><h3 class="entry-title td"><a href="', link, '">', text, "</a></h3></div>")

        box = "td-module-container"
        return _html(
            card("td_module_10", F.lit("https://gb/main"), "main only"), card(box, F.lit("https://gb/gone"), "no page"),
            card(box, _html("https://gb/", key), title), card(box, F.lit("https://gb/gone2"), "no page"),
            card(box, _html("https://gb/", (F.col("page_id") + 1_000_000_007).cast("string")), "a fourth"),
        )

    day = F.when(F.col("page_id") % 3 != 0, "March 5, 2024").otherwise("March 4, 2024")
    article = _html(
        '<time class="entry-date">', day, '</time><img src="https://i/out.png"><div class="td-post-content"><div>', _page_title(),
        '</div>end<img src="x.png" data-src="https://i/', _key(), '.svg"><img src="/relative.png"></div>',
    )
    return _stored(spark, sf_dir, "gbhackers", listing, article, _html("https://gb/", _key()))


@query(
    _expected(
        "security_affairs",
        "'https://sa/' || page_id",
        _text("''", "body || chr(10) || 'end'"),
        "'March 05, 2024/' || category || '_' || seq",
        _TITLE,
        images="'https://i/' || page_id || '.png'",
    )
)
def site_security_affairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of cards by turns; one of them shows the date in the second of its spans."""

    def listing(title: Column, key: Column, today: Column) -> Column:
        day = F.when(today, "March 05, 2024").otherwise("March 04, 2024")
        link = _html('<a href="https://sa/', key, '">', title, "</a>")
        kind = F.col("page_id") % 5
        return (
            F.when(kind == 0, _html('<div class="banner-content"><p class="date">', day, "</p><h1>", link, "</h1></div>"))
            .when(kind == 1, _html('<div class="sngl-article"><h6>', link, '</h6><p class="post-time"><span>', day, "</span></p></div>"))
            .otherwise(
                _html('<div class="news-card-cont"><div class="post-time"><span>by May</span><span>', day, "</span></div><h5>", link, "</h5></div>")
            )
        )

    article = _html(
        '<div class="article-details-block"><div>', _page_title(), '</div>end<img src="https://i/', _key(),
        '.png" data-src="https://i/late.png"><img src="https://i/v.svg"></div>',
    )
    return _stored(spark, sf_dir, "security_affairs", listing, article, _html("https://sa/", _key()))


@query(
    _expected(
        "thehackernews",
        "'https://th/' || page_id || '.html'",
        _text("'날짜: Mar 05, 2024'", "''", "'본문:'", "body"),
        f"'{AS_OF}/' || category || '_1'",
        _PARAGRAPHS,
        keep="page_id % 3 <> 0 AND body <> ''",
    )
)
def site_thehackernews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four cards count, and of these the ones with a title are numbered; articles keep the page's own date text."""

    def listing(title: Column, key: Column, today: Column) -> Column:
        def card(link: Column, text: Column | str) -> Column:
            return _html('<div class="body-post clear"><a class="story-link" href="', link, '"><h2 class="home-title">', text, "</h2></a></div>")

        other = _html("https://th/", (F.col("page_id") + 1).cast("string"), ".html")
        return _html(
            card(F.lit("https://th/none"), ""), '<div class="body-post">no card</div>', card(_html("https://th/", key, ".html"), title),
            card(F.lit("https://th/none"), ""), card(F.lit("https://th/none"), ""), card(other, "the fifth"),
        )

    day = F.when(F.col("page_id") % 3 != 0, "Mar 05, 2024").otherwise("Mar 04, 2024")
    article = _html(
        '<div class="postmeta"><i class="author">x</i><span class="author">', day, '</span></div><div class="articlebody">',
        F.col("html"), "</div>",
    )
    return _stored(spark, sf_dir, "thehackernews", listing, article, _html("https://th/", _key(), ".html"))


@query(
    _expected(
        "bleeping_computer",
        "'https://www.bleepingcomputer.com/news/security/' || page_id || '/'",
        _text("'날짜: Mar 05, 2024'", "''", "'요약: sum ' || page_id", "''", "'본문:'", "body"),
        "'Mar 05, 2024/' || seq",
        _PARAGRAPHS,
    )
)
def site_bleeping_computer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card is a list entry with entries of its own; those that lead off the site are left out."""

    def listing(title: Column, key: Column, today: Column) -> Column:
        def entry(link: Column, text: Column | str) -> Column:
            return _html(
                '<li><h4><a href="', link, '">', text, "</a></h4><p>sum ", key, '</p><p>more</p><ul><li class="bc_news_author">A</li>'
                '<li class="bc_news_date">', F.when(today, "Mar 05, 2024").otherwise("Mar 04, 2024"), "</li></ul></li>",
            )

        own = _html("https://www.bleepingcomputer.com/news/security/", key, "/")
        return _html("<ul>", entry(F.lit("https://sponsor.example/"), "Ad"), entry(own, title), "</ul>")

    article = _html('<p>before</p><div class="articleBody">', F.col("html"), "</div>")
    url = _html("https://www.bleepingcomputer.com/news/security/", _key(), "/")
    return _stored(spark, sf_dir, "bleeping_computer", listing, article, url)
