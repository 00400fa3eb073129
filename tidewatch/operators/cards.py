"""Article cards and bodies from saved listing and article pages, by per-site rules.

A rule is data: which elements are cards, and which elements of a card or an article page hold its fields. The
rules are a map looked up by site, so every site is read by the same expression, and
a page is cut into its elements once.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import dates, nodes, text
from tidewatch.functions.nodes import PICKS, pick
from tidewatch.operators import crawl, dedupe, filters
from tidewatch.session import written

Picks = tuple[tuple, ...]


@dataclass(frozen=True)
class CardRule:
    """Which elements are cards, and which in a card hold its fields.

    Without a pick for title or address the card itself has them. The date is the text, or ``date_attr``, of the
    first element picked, or with ``date_scan`` of the first that shows a date; with ``date_anywhere`` a card
    without such an element shows it anywhere. ``where`` limits the rule to the main listing or to the others.
    """

    card: Picks
    title: Picks = ()
    url: Picks = ()
    date: Picks = ()
    date_attr: str = ""
    date_scan: bool = False
    date_anywhere: bool = False
    summary: Picks = ()
    image: Picks = ()
    where: str = ""


@dataclass(frozen=True)
class SiteRule:
    """A site's cards, in the order of their rules, its article pages and the way its articles are stored."""

    site: str
    cards: tuple[CardRule, ...]
    # Only cards with a title and an address are counted by ``position``.
    count_titled: bool = False
    date_kind: str = "iso"
    base: str = ""
    url_prefix: str = ""
    max_cards: int | None = None
    main_max_cards: int | None = None
    main_exempt_from_date: bool = False
    # Article page: the first such element is the body, or all such paragraphs are.
    body: Picks = ()
    paragraphs: Picks = ()
    article_date: Picks = ()
    # Images of the body; whether ``data-src`` goes before ``src``, and svg files count.
    images: Picks = ()
    lazy_images: bool = True
    vector_images: bool = False
    no_body: str | None = "(본문 없음)"
    once_per_url: bool = False
    # Stored article: labelled lines, the label's date notation (empty: as the article page shows it),
    # folder date notation, and what the folder name starts with.
    labels: tuple[str, ...] = ("date", "summary")
    label_date: str = "yyyy-MM-dd"
    folder_date: str = "yyyy-MM-dd"
    category_in_name: bool = False
    number_is_position: bool = False


# Rules of the watched sites (fixed values).
SITE_RULES = (
    SiteRule(
        site="boannews",
        cards=(
            CardRule(
                card=(pick("div", "news_list"), pick("div", "news_main")),
                title=(pick("", "news_txt"), pick("", "news_main_title")),
                url=(pick("a", attr="href", value="/media/view.asp"),),
                date=(pick("", "news_writer"),),
                date_anywhere=True,
                summary=(pick("", "news_content"), pick("", "news_main_txt")),
            ),
        ),
        date_kind="korean",
        base="https://www.boannews.com",
        body=(pick("", id="news_content"),),
    ),
    SiteRule(
        site="securityweek",
        cards=(
            CardRule(
                card=(pick("article", "zox-art-wrap"),),
                title=(pick("h2", "zox-s-title2"),),
                url=(pick("a", attr="rel", value="bookmark", exact=True),),
                date=(pick("meta", attr="itemprop", value="dateModified", exact=True),),
                date_attr="content",
                summary=(pick("p", "zox-s-graph"),),
                image=(pick("img", inside=pick("div", "img-ratio")),),
            ),
        ),
        paragraphs=(pick("p", inside=pick("div", "zox-post-body")),),
    ),
    SiteRule(
        site="gbhackers",
        cards=(
            CardRule(
                card=(pick("a", inside=pick("h3", "entry-title"), child=True, around=pick("div", "td_module_10")),),
                where="main",
            ),
            CardRule(
                card=(pick("a", inside=pick("h3", "entry-title"), child=True, around=pick("div", "td-module-container")),),
                where="other",
            ),
        ),
        max_cards=3,
        main_max_cards=5,
        main_exempt_from_date=True,
        body=(pick("div", "td-post-content"),),
        article_date=(pick("time", "entry-date"),),
        images=(pick("img", inside=pick("div", "td-post-content")),),
        vector_images=True,
        no_body="(본문을 찾을 수 없음)",
        once_per_url=True,
        labels=(),
        category_in_name=True,
        number_is_position=True,
    ),
    SiteRule(
        site="security_affairs",
        cards=(
            CardRule(
                card=(pick("div", "banner-content"),),
                title=(pick("a", inside=pick("h1")),),
                url=(pick("a", inside=pick("h1")),),
                date=(pick("p", "date"),),
            ),
            CardRule(
                card=(pick("div", "sngl-article"),),
                title=(pick("a", inside=pick("h6"), child=True),),
                url=(pick("a", inside=pick("h6"), child=True),),
                date=(pick("span", inside=pick("", "post-time")),),
            ),
            CardRule(
                card=(pick("div", "news-card-cont"),),
                title=(pick("a", inside=pick("h5")),),
                url=(pick("a", inside=pick("h5")),),
                date=(pick("span", inside=pick("", "post-time")),),
                date_scan=True,
            ),
        ),
        date_kind="display",
        body=(pick("div", "article-details-block"),),
        images=(pick("img", inside=pick("div", "article-details-block")),),
        lazy_images=False,
        labels=(),
        folder_date="MMMM dd, yyyy",
        category_in_name=True,
    ),
    SiteRule(
        site="thehackernews",
        cards=(
            CardRule(
                card=(pick("div", "body-post", "clear"),),
                title=(pick("h2", "home-title"),),
                url=(pick("a", "story-link"),),
                image=(pick("img", inside=pick("", "img-ratio")),),
            ),
        ),
        count_titled=True,
        max_cards=4,
        main_max_cards=4,
        paragraphs=(pick("p", inside=pick("div", "articlebody")),),
        article_date=(pick("span", "author", inside=pick("div", "postmeta")),),
        no_body=None,
        labels=("date",),
        label_date="",
        category_in_name=True,
        number_is_position=True,
    ),
    SiteRule(
        site="bleeping_computer",
        cards=(
            CardRule(
                card=(pick("li"),),
                title=(pick("a", inside=pick("h4")),),
                url=(pick("a", inside=pick("h4")),),
                date=(pick("li", "bc_news_date"),),
                summary=(pick("p"),),
                image=(pick("img", inside=pick("", "bc_latest_news_img")),),
            ),
        ),
        date_kind="display",
        url_prefix="https://www.bleepingcomputer.com/news/security/",
        paragraphs=(pick("p", inside=pick("", "articleBody")),),
        no_body="",
        label_date="MMM dd, yyyy",
        folder_date="MMM dd, yyyy",
    ),
)

_CARD = (
    f"struct<card:{PICKS},title:{PICKS},url:{PICKS},date:{PICKS},date_attr:string,date_scan:boolean,"
    f"date_anywhere:boolean,summary:{PICKS},image:{PICKS},`where`:string>"
)
_RULE = (
    f"struct<cards:array<{_CARD}>,count_titled:boolean,date_kind:string,base:string,"
    f"url_prefix:string,max_cards:int,main_max_cards:int,main_exempt_from_date:boolean,body:{PICKS},"
    f"paragraphs:{PICKS},article_date:{PICKS},images:{PICKS},lazy_images:boolean,vector_images:boolean,"
    "no_body:string,once_per_url:boolean,labels:array<string>,label_date:string,folder_date:string,"
    "category_in_name:boolean,number_is_position:boolean>"
)


def with_rules(rows: DataFrame, rules: Sequence[SiteRule]) -> DataFrame:
    """``rows`` of the rules' sites with ``_rule``; rows without a site have none.

    The rules are one constant of the plan, a map by site, which Spark reads once: no join, also where all rows are of
    one site.
    """

    def fields(rule: CardRule | SiteRule) -> dict:
        found = {f.name: getattr(rule, f.name) for f in dataclasses.fields(rule)}
        return found | {f.name: nodes.named(found[f.name]) for f in dataclasses.fields(rule) if f.type == "Picks"}

    table = {r.site: fields(r) | {"cards": [fields(c) for c in r.cards]} for r in rules}
    by_site = F.from_json(F.lit(json.dumps(table)), f"map<string,{_RULE}>")
    return rows.withColumn("_rule", F.try_element_at(by_site, F.col("site"))).where("_rule IS NOT NULL")


def _rule(name: str) -> Column:
    return F.col("_rule")[name]


def _date(found: Column, kind: Column) -> Column:
    return nodes.with_value(
        text.inner_text(found),
        lambda value: F.when(kind == "korean", dates.korean_date(value))
        .when(kind == "display", dates.display_date(value))
        .otherwise(F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd")),
    )


def absolute(url: Column, base: Column) -> Column:
    """Address with the site's base in front of a root-relative path."""
    return F.when(url.startswith("/"), F.concat(base, url)).otherwise(url)


def _attribute(node: Column, name: Column | str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name) if isinstance(name, str) else name)


def _cards(page: Column) -> Column:
    """``array<struct<rule, node, inner>>``: the cards of a page with the elements inside each."""
    main = F.coalesce(F.col("category") == "main", F.lit(True))

    def of_rule(rule: Column) -> Column:
        wanted = (rule["where"] == "") | ((rule["where"] == "main") == main)
        cards = F.transform(
            nodes.chosen(page, rule["card"]),
            lambda n: F.struct(rule.alias("rule"), n.alias("node"), nodes.inside(page, n).alias("inner")),
        )
        return F.when(wanted, cards)

    found = F.transform(_rule("cards"), of_rule)
    return F.flatten(F.filter(found, lambda x: x.isNotNull()))


def _fields(card: Column, html: Column) -> Column:
    """A card's fields; the title and address are empty where it has none."""
    rule, inner = card["rule"], card["inner"]

    def shown(node: Column) -> Column:
        return F.coalesce(nodes.content(html, node), F.lit(""))

    def own(picks: Column) -> Column:
        return F.when(F.size(picks) == 0, card["node"]).otherwise(nodes.first(nodes.chosen(inner, picks)))

    def dated(node: Column) -> Column:
        return F.when(rule["date_attr"] == "", shown(node)).otherwise(
            F.coalesce(_attribute(node, rule["date_attr"]), F.lit(""))
        )

    days = nodes.with_value(
        nodes.chosen(inner, rule["date"]),
        lambda found: F.transform(
            F.when(F.size(found) == 0, F.when(rule["date_anywhere"], F.array(shown(card["node"]))))
            .when(rule["date_scan"], F.transform(found, dated))
            .otherwise(F.array(dated(nodes.first(found)))),
            lambda x: _date(x, _rule("date_kind")),
        ),
    )
    return F.struct(
        text.inner_text(shown(own(rule["title"]))).alias("title"),
        F.trim(text.unescape(F.coalesce(_attribute(own(rule["url"]), "href"), F.lit("")))).alias("url"),
        nodes.first(F.filter(days, lambda d: d.isNotNull())).alias("date"),
        text.inner_text(shown(nodes.first(nodes.chosen(inner, rule["summary"])))).alias("summary"),
        F.coalesce(_attribute(nodes.first(nodes.chosen(inner, rule["image"])), "src"), F.lit("")).alias("image"),
    )


def extract_cards(pages: DataFrame, rules: Sequence[SiteRule] = SITE_RULES) -> DataFrame:
    """One row per card of each listing page ``(site, ..., html)``.

    Adds ``place, position, title, url, date, summary, image``. Cards without a title or an address are dropped.
    ``place`` is that among all cards; so is ``position``, but on sites that number only cards with
    both. Without a ``category`` column all pages are main listings.
    """
    kept = [c for c in pages.columns if c != "html"]
    if "category" not in pages.columns:
        pages = pages.withColumn("category", F.lit("main"))
    # Cut where it is read: one step for the elements, one for the cards.
    cut = with_rules(pages.withColumn("_nodes", nodes.elements(F.col("html"))), rules)
    found = cut.withColumn("_cards", _cards(F.col("_nodes"))).drop("_nodes")
    fields = found.withColumn("_fields", F.transform("_cards", lambda c: _fields(c, F.col("html")))).select(
        *kept, "_rule", F.posexplode("_fields").alias("_at", "_card"), "_fields"
    )
    ok = (F.col("_card.title") != "") & (F.col("_card.url") != "")
    before = F.filter(
        F.slice("_fields", F.lit(1), F.col("_at") + 1), lambda c: (c["title"] != "") & (c["url"] != "")
    )
    position = F.when(_rule("count_titled"), F.size(before)).otherwise(F.col("_at") + 1)
    placed = fields.where(ok).select(
        *kept, (F.col("_at") + 1).alias("place"), position.alias("position"), "_card.title",
        absolute(F.col("_card.url"), _rule("base")).alias("url"), "_card.date", "_card.summary", "_card.image", "_rule",
    )
    return placed.where(F.col("url").startswith(_rule("url_prefix"))).drop("_rule")


def _body(page: Column, html: Column) -> Column:
    """Body text; paragraphs are trimmed, blanks dropped, joined by an empty line."""
    paragraphs = F.transform(
        nodes.chosen(page, _rule("paragraphs")), lambda p: text.inner_text(nodes.content(html, p))
    )
    joined = F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n")
    whole = text.block_text(nodes.content(html, nodes.first(nodes.chosen(page, _rule("body")))))
    return F.when(F.size(_rule("paragraphs")) > 0, joined).otherwise(whole)


def _images(page: Column) -> Column:
    return image_addresses(
        nodes.chosen(page, _rule("images")), _rule("lazy_images"), _rule("vector_images")
    )


def image_addresses(images: Column, lazy: Column, vectors: Column) -> Column:
    """Addresses of image elements, http only: ``data-src`` first if ``lazy``, svg files if ``vectors``."""

    def link(node: Column) -> Column:
        plain = F.coalesce(_attribute(node, "src"), F.lit(""))
        return F.when(lazy, F.coalesce(F.nullif(_attribute(node, "data-src"), F.lit("")), plain)).otherwise(plain)

    return F.filter(F.transform(images, link), lambda a: a.startswith("http") & (vectors | ~a.endswith(".svg")))


def image_links(html: Column, lazy: bool = True, vectors: bool = False) -> Column:
    """Image addresses of a fragment, by the rule of ``image_addresses``."""
    images = F.filter(nodes.elements(html), lambda n: n["tag"] == "img")
    return image_addresses(images, F.lit(lazy), F.lit(vectors))


def article_bodies(pages: DataFrame, rules: Sequence[SiteRule] = SITE_RULES) -> DataFrame:
    """``body`` in the place of ``html``: an empty one is the site's placeholder, or null where
    the site drops such articles. Pages of sites without a rule are left out.
    """
    cut = with_rules(pages.withColumn("_nodes", nodes.elements(F.col("html"))), rules)
    body = F.coalesce(F.nullif(_body(F.col("_nodes"), F.col("html")), F.lit("")), _rule("no_body"))
    return cut.withColumn("body", body).drop("_nodes", "_rule", "html")


def read_articles(
    cards: DataFrame,
    article_pages: DataFrame,
    rules: Sequence[SiteRule] = SITE_RULES,
    newest_by: str | None = None,
) -> DataFrame:
    """Cards joined to their article pages ``(url, html)``: body, date and image links.

    The page's own date stands in where the listing shows none; ``shown`` is its text. Only pages of the cards'
    addresses are cut, before the join, so markup is not shuffled with the cards. Of several
    saved copies of a page the one with the largest ``newest_by`` counts.
    """
    order = F.col(newest_by) if newest_by else F.lit(0)
    pages = article_pages.select("site", "url", "html", order.alias("_order"))
    wanted = pages.join(cards.select("site", "url").distinct(), ["site", "url"], "left_semi")
    cut = with_rules(wanted.withColumn("_nodes", nodes.elements(F.col("html"))), rules)
    page, html = F.col("_nodes"), F.col("html")
    shown = nodes.content(html, nodes.first(nodes.chosen(page, _rule("article_date"))))
    parsed = cut.select(
        "site", "url", "_order",
        F.coalesce(F.nullif(_body(page, html), F.lit("")), _rule("no_body")).alias("body"),
        _images(page).alias("images"), text.inner_text(F.coalesce(shown, F.lit(""))).alias("shown"),
    )
    one = dedupe.keep_first(
        parsed, ["site", "url"], [F.desc_nulls_last("_order"), F.col("body"), F.col("images")]
    ).drop("_order")
    return (
        cards.join(one, ["site", "url"])
        .withColumn("date", F.coalesce("date", dates.display_date(F.col("shown"))))
        .filter(F.col("body").isNotNull())
    )


def select_articles(
    listing_pages: DataFrame,
    article_pages: DataFrame,
    as_of: date | str,
    rules: Sequence[SiteRule] = SITE_RULES,
    newest_by: str | None = None,
) -> DataFrame:
    """Today's articles of every site, numbered per listing, with their text and path.

    ``listing_pages`` holds ``site, category, category_rank, page, html`` and
    ``article_pages`` holds ``site, url, html`` and may hold a column to tell the newest copy by.
    """
    listing_pages = listing_pages.fillna("main", subset=["category"])
    is_main = F.col("category") == "main"
    found = with_rules(extract_cards(listing_pages, rules), rules)
    # A site's limit is one of places, before cards without a title are left out.
    limit = F.when(is_main, _rule("main_max_cards")).otherwise(_rule("max_cards"))
    exempt = _rule("main_exempt_from_date") & is_main
    # A listing that shows dates is cut to today before the article pages are joined.
    cards = found.where(limit.isNull() | (F.col("place") <= limit)).where(
        F.col("date").isNull() | exempt | filters.on_day(F.col("date"), as_of)
    )
    # Few next to the pages, and read for their addresses first.
    early = written(cards.drop("_rule"))
    today = with_rules(read_articles(early, article_pages, rules, newest_by), rules).filter(
        exempt | filters.on_day(F.col("date"), as_of)
    )
    # Today's articles are few next to the pages, and each branch below needs them.
    today = written(today)
    once = _rule("once_per_url")
    kept = crawl.once_per_url(today.filter(once)).unionByName(today.filter(~once))
    numbered = crawl.number_in_listing(written(kept), ["site", "category"], "page", "position")
    return numbered.withColumns({"text": article_text(), "path": article_path(as_of)}).drop("_rule", "place", "shown")


def article_text() -> Column:
    """The stored article, labelled as its site's rule says, with the date in the site's own notation."""
    notation = _rule("label_date")
    day = F.when(notation == "", F.col("shown")).otherwise(F.call_function("date_format", F.col("date"), notation))
    day = F.coalesce(day, F.lit(""))

    def rendered(with_date: bool, with_summary: bool) -> Column:
        return text.render_article(
            F.col("title"), F.col("url"), F.col("body"), day if with_date else None, F.col("summary") if with_summary else None
        )

    dated, summed = (F.array_contains(_rule("labels"), n) for n in ("date", "summary"))
    return (
        F.when(dated & summed, rendered(True, True)).when(dated, rendered(True, False)).otherwise(rendered(False, False))
    )


def article_path(as_of: date | str) -> Column:
    """``site/date/number_title/article.txt``, as the article source expects it."""
    day = F.lit(str(as_of)).cast("date")
    safe = F.when(F.col("site") == "boannews", text.slug_hangul(F.col("title"))).otherwise(text.slug(F.col("title")))
    number = F.when(_rule("number_is_position"), F.col("position")).otherwise(F.col("seq"))
    named = F.concat_ws("_", F.when(_rule("category_in_name"), F.col("category")), number.cast("string"), safe)
    return F.concat_ws("/", F.col("site"), F.call_function("date_format", day, _rule("folder_date")), named, F.lit("article.txt"))
