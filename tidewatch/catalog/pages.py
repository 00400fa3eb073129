"""Saved pages: text, URLs, domains, cards, article bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog.registry import query, table
from tidewatch.functions import text
from tidewatch.functions.nodes import pick
from tidewatch.operators import cards, crawl, dedupe
from tidewatch.plans import jobs
from tidewatch.sources import files

AS_OF = "2024-03-01"


def sql_text(html: str) -> str:
    """Visible text of a page in SQL; the character references are those the pages use."""
    for pattern in (
        r"(?s)<!--.*?-->",
        r"(?is)<script\b[^>]*>.*?</script\s*>",
        r"(?is)<style\b[^>]*>.*?</style\s*>",
        r"""</?[a-zA-Z](?:[^>"'']+|"[^"]*"|''[^'']*'')*>|<[!?][^>]*>""",
    ):
        html = f"regexp_replace({html}, '{pattern}', ' ', 'g')"
    for name, char in (("quot", '"'), ("middot", "·"), ("copy", "©"), ("lt", "<"), ("gt", ">")):
        html = f"replace({html}, '&{name};', '{char}')"
    return f"replace({html}, '&amp;', '&')"


def sql_inner(html: str) -> str:
    return rf"trim(regexp_replace({sql_text(html)}, '\s+', ' ', 'g'))"


URLS_SQL = rf"""
WITH texts AS (
  SELECT page_id, {sql_text("html")} AS t FROM pages WHERE length(html) >= 50
), found AS (
  SELECT page_id, unnest(list_distinct(list_filter(
    regexp_extract_all(t, '(?i){text.URL_PATTERN}'),
    lambda u: length(u) >= 7 AND NOT contains(u, '.onion')))) AS url
  FROM texts
), urls AS (
  SELECT page_id, url, split_part(split_part(trim(regexp_replace(
    regexp_replace(url, '(?i)https?://', '', 'g'), '(?i)^www\.', '')), '/', 1), ':', 1) AS domain
  FROM found
)
"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as saved files: every seventh lies in the root folder."""
    name = F.concat(F.col("page_id").cast("string"), F.lit(".html"))
    folder = F.concat(F.lit("g"), (F.col("page_id") % 5).cast("string"), F.lit("/"))
    path = F.when(F.col("page_id") % 7 == 0, name).otherwise(F.concat(folder, name))
    saved = table(spark, sf_dir, "pages").select(path.alias("path"), F.col("html").alias("value"))
    return files.page_rows(saved)


@query(
    rf"""
WITH t AS (SELECT page_id, {sql_text("html")} AS t FROM pages)
SELECT page_id, length(t) AS chars, md5(t) AS text_md5 FROM t
"""
)
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", text.visible_text(F.col("html")).alias("t")
    ).select("page_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("text_md5"))


@query(
    URLS_SQL
    + """
SELECT page_id || '.html' AS html_file,
  CASE WHEN page_id % 7 = 0 THEN 'unknown_group_at_root' ELSE 'g' || page_id % 5 END AS "group", url, domain
FROM urls WHERE domain <> ''
"""
)
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.url_rows(_pages(spark, sf_dir))


def _dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two answers per page host: an alias, then an address; some hosts fail or have none."""
    host = text.domain_of(F.col("url"))
    key = F.length(host)
    octets = [F.lit("10"), F.lit("1"), key.cast("string"), (key % 7).cast("string")]
    address = F.when(key % 4 == 1, F.concat(F.lit("alias."), host)).otherwise(
        F.concat_ws(".", *octets)
    )
    return table(spark, sf_dir, "pages").filter(key % 4 != 0).select(
        host.alias("domain"),
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("seq"), F.concat(F.lit("cname."), host).alias("answer")),
                F.struct(F.lit(2).alias("seq"), address.alias("answer")),
            )
        ).alias("a"),
        F.when(key % 8 == 1, "DIG_TIMEOUT").alias("failure"),
    ).select("domain", "a.seq", "a.answer", "failure")


@query(
    URLS_SQL
    + r"""
, dns AS (
  SELECT DISTINCT split_part(split_part(regexp_replace(regexp_replace(url, '(?i)https?://', '', 'g'),
    '(?i)^www\.', ''), '/', 1), ':', 1) AS domain FROM pages
), known AS (SELECT domain, length(domain) AS k FROM dns WHERE length(domain) % 4 <> 0)
SELECT page_id || '.html' AS html_file, url, domain,
  COALESCE(CASE WHEN k % 4 <> 1 THEN '10.1.' || k || '.' || k % 7 END, 'none') AS ip_address,
  CASE WHEN k % 4 <> 1 THEN 'OK' WHEN k % 8 = 1 THEN 'DIG_TIMEOUT' ELSE 'NO_IP_FOUND' END AS ip_status
FROM urls LEFT JOIN known USING (domain) WHERE domain <> ''
"""
)
def page_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.extract_indicators(_pages(spark, sf_dir), _dns(spark, sf_dir))
    return found.select(
        "html_file", "url", "domain", F.coalesce("ip_address", F.lit("none")).alias("ip_address"), "ip_status"
    )


@query(
    r"""
SELECT page_id, CASE WHEN url LIKE '%/' THEN 'main' ELSE COALESCE(nullif(
    list_filter(string_split(url, '/'), lambda s: s <> '')[-1], ''), 'main') END AS category
FROM pages WHERE url NOT LIKE '%/'
UNION ALL
SELECT page_id, list_filter(string_split(url, '/'), lambda s: s <> '')[-1] FROM pages WHERE url LIKE '%/'
"""
)
def page_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", text.last_segment(F.col("url")).alias("category")
    )


MENU_RULE = cards.SiteRule(
    site="menu",
    cards=(cards.CardRule(card=(pick("li"),), title=(pick("a"),), url=(pick("a"),)),),
    base="http://menu",
    paragraphs=(pick("p", inside=pick("article")),),
    labels=("date",),
)


@query(
    rf"""
WITH fragments AS (
  SELECT page_id, unnest(string_split(html, '<li>')[2:]) AS f,
    generate_subscripts(string_split(html, '<li>')[2:], 1) AS position FROM pages
), fields AS (
  SELECT page_id, position, {sql_inner("regexp_extract(f, '(?s)<a[^>]*>(.*?)</a>', 1)")} AS title,
    regexp_extract(f, '<a href="([^"]*)"', 1) AS href FROM fragments
)
SELECT page_id, CAST(position AS BIGINT) AS position, title, 'http://menu' || replace(href, '&amp;', '&') AS url
FROM fields WHERE title <> '' AND href <> '' AND position <= 3
"""
)
def article_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menu entries play cards: the first three of each page."""
    listing = table(spark, sf_dir, "pages").select(F.lit("menu").alias("site"), "page_id", "html")
    found = cards.extract_cards(listing, [MENU_RULE])
    return crawl.first_cards(found, F.lit(3)).select(
        "page_id", F.col("position").cast("long").alias("position"), "title", "url"
    )


@query(
    r"""
WITH links AS (
  SELECT page_id, unnest(list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1),
    lambda u: contains(u, '/th') OR contains(u, '/an'))) AS link FROM pages
)
SELECT page_id, CASE WHEN starts_with(link, '/') THEN 'http://menu' ELSE '' END || link AS link, count(*) AS n
FROM links GROUP BY page_id, link
"""
)
def category_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page stands inside a menu with blocks of its own, between links that are not in the menu."""
    framed = F.concat(
        F.lit('<a href="/the">out</a><div id="main_menu_hash"><div class="row"></div><div>'),
        F.col("html"),
        F.lit('</div></div><div><a href="/and">out</a></div>'),
    )
    links = crawl.category_links(framed, ("/th", "/an"), "http://menu")
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", F.explode(links).alias("link"))
        .groupBy("page_id", "link")
        .agg(F.count("*").alias("n"))
    )


BODY_SQL = rf"""
array_to_string(list_filter(list_transform(
    -- A paragraph also ends where the next one begins.
    regexp_extract_all(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1),
                         '(?i)<p([\s>])', '</p><p\1', 'g') || '</p>',
                       '(?is)<p\b[^>]*>(.*?)</p\s*>', 1),
    lambda p: {sql_inner("p")}), lambda p: p <> ''), chr(10) || chr(10))
"""


@query(
    f"""
WITH b AS (SELECT page_id, {BODY_SQL} AS body FROM pages)
SELECT page_id, md5(CASE WHEN body = '' THEN '(본문 없음)' ELSE body END) AS body_md5 FROM b
"""
)
def article_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("menu").alias("site"), "html")
    bodies = cards.article_bodies(pages, [MENU_RULE])
    return bodies.select("page_id", F.md5("body").alias("body_md5"))


@query(
    r"""
SELECT page_id, 'http://i/' || page_id || '.jpg;http://i/lazy.png' AS links FROM pages
"""
)
def image_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image tags put in front of each page, which has none: lazy, relative and vector ones too."""
    key = F.col("page_id").cast("string")
    tags = F.concat(
        F.lit('<img class="a" src="http://i/'), key, F.lit('.jpg"><img src="/rel.png">'),
        F.lit('<IMG src="data:x" data-src="http://i/lazy.png"/><img src="https://i/v.svg">'),
        F.col("html"),
    )
    return table(spark, sf_dir, "pages").select(
        "page_id", F.array_join(cards.image_links(tags), ";").alias("links")
    )


NEWS_RULE = cards.SiteRule(
    site="news",
    cards=(cards.CardRule(card=(pick("li"),), title=(pick("a"),), url=(pick("a"),), date=(pick("i"),)),),
    url_prefix="http",
    paragraphs=(pick("p", inside=pick("article")),),
    labels=("date",),
    category_in_name=True,
    once_per_url=True,
)


@query(
    rf"""
WITH first AS (
  SELECT *, {sql_inner("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS title,
    page_id % 3 AS category_rank FROM pages
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1
), b AS (
  SELECT page_id, 'c' || category_rank AS category, title, url, {BODY_SQL} AS body FROM first
  WHERE page_id % 2 = 0 AND title <> ''
), n AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY page_id) AS seq FROM b
)
SELECT page_id, CAST(seq AS BIGINT) AS seq,
  md5('제목: ' || title || chr(10) || 'URL: ' || url || chr(10) || '날짜: {AS_OF}' || chr(10) || chr(10)
    || '본문:' || chr(10) || CASE WHEN body = '' THEN '(본문 없음)' ELSE body END) AS text_md5,
  'news/{AS_OF}/' || category || '_' || seq || '_' || lower(regexp_replace(title, '[^a-zA-Z0-9]', '_', 'g'))
    || '/article.txt' AS path
FROM n
"""
)
def selected_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each url is listed once, half of them today; of its saved copies the newest is read."""
    saved = table(spark, sf_dir, "pages")
    pages = dedupe.keep_first(saved, ["url"], [F.desc("page_id")])
    day = F.when(F.col("page_id") % 2 == 0, AS_OF).otherwise("2024-02-29")
    card = F.concat(
        F.lit('<ul><li><a href="'), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit('">'),
        F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1), F.lit("</a><i>"), day, F.lit("</i></li>"),
        F.lit('<li><a href="/elsewhere">off site</a><i>'), day, F.lit("</i></li></ul>"),
    )
    rank = F.col("page_id") % 3
    listing = pages.select(
        F.lit("news").alias("site"),
        F.concat(F.lit("c"), rank.cast("string")).alias("category"),
        rank.alias("category_rank"),
        F.col("page_id").alias("page"),
        card.alias("html"),
    )
    # A copy saved before has another text, so taking it would show.
    older = saved.select("url", F.concat(F.lit("<article><p>old</p></article>"), "html").alias("html"), F.lit(-1).alias("page_id"))
    every = saved.select("url", "html", "page_id").unionByName(older)
    articles = every.select(F.lit("news").alias("site"), "url", "html", "page_id")
    chosen = jobs.select_articles(listing, articles, AS_OF, [NEWS_RULE], newest_by="page_id")
    return chosen.select(
        F.col("page").alias("page_id"),
        F.col("seq").cast("long").alias("seq"),
        F.md5("text").alias("text_md5"),
        "path",
    )


@query(
    """
SELECT page_id, 'first' || chr(10) || 'cap ' || page_id || chr(10) || 'second' || chr(10) || 'third' AS body FROM pages
"""
)
def nested_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with blocks inside, each in front of its page, whose text must stay out."""
    key = F.col("page_id").cast("string")
    html = F.concat(
        F.lit('<div>before</div><div class="x" id="news_content">first<div>cap '), key,
        F.lit("</div>second<p>third</p></div><div>RELATED POSTS</div>"), F.col("html"),
    )
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("boannews").alias("site"), html.alias("html"))
    return cards.article_bodies(pages).select("page_id", "body")


@query(
    """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 2 END AS position, 'Title ' || page_id AS title,
  'https://gb/' || page_id AS url, '1998-03-01' AS shown
FROM pages
UNION ALL
SELECT page_id, 1, 'News ' || page_id, 'https://www.boannews.com/media/view.asp?idx=' || page_id, '1998-03-01' FROM pages
"""
)
def site_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of two sites built around all pages: two kinds of blocks, and two dates in a card."""
    key = F.col("page_id").cast("string")
    main = F.col("page_id") % 2 == 0
    link = F.concat(F.lit('<h3 class="entry-title"><a href="https://gb/'), key, F.lit('">Title '), key, F.lit("</a></h3></div>"))
    other = F.lit('<h3 class="entry-title"><a href="https://gb/x">Other</a></h3></div>')
    ten, container = F.lit('<div class="td_module_10 a">'), F.lit('<div class="td-module-container b">')
    # The main page shows both kinds; a card without a title does not count.
    gb = F.when(main, F.concat(container, other, ten, F.lit("</div>"), ten, link, F.col("html"))).otherwise(
        F.concat(ten, other, container, other, container, link, F.col("html"))
    )
    boan = F.concat(
        F.lit('<div class="news_list"><a href="/media/view.asp?idx='), key, F.lit('"><span class="news_txt">News '), key,
        F.lit('</span></a><p class="news_content">2024년 1월 2일 events</p><span class="news_writer">Kim | 1998년 03월 01일</span></div>'),
        F.col("html"),
    )
    pages = table(spark, sf_dir, "pages")
    category = F.when(main, "main").otherwise("apt")
    listing = pages.select("page_id", F.lit("gbhackers").alias("site"), category.alias("category"), gb.alias("html")).unionByName(
        pages.select("page_id", F.lit("boannews").alias("site"), F.lit("main").alias("category"), boan.alias("html"))
    )
    found = cards.extract_cards(listing).filter(F.col("url") != "https://gb/x")
    return found.select(
        "page_id", "position", "title", "url",
        F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("1998-03-01")).alias("shown"),
    )
