"""Crawl planning over tables: page addresses, page walks, numbering of listed cards."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.operators import dedupe

MAX_PAGES = 5

# Query templates of the groups that number their pages differently (fixed values).
PAGE_QUERIES = {
    "kairos": "/?PAGEN_1=%d",
    "play": "/index.php?page=%d",
    "blacksuit": "/index.php?page=%d",
}
DEFAULT_PAGE_QUERY = "/?page=%d"


def seed_pages(seeds: DataFrame, as_of: date | str, pages: int = MAX_PAGES) -> DataFrame:
    """``group, fqdn, page, url, file_name`` for every page to visit; page 1 is the root."""
    group = text.group_name(F.col("group"))
    page = F.col("page")
    template = F.lit(DEFAULT_PAGE_QUERY)
    for name, query in PAGE_QUERIES.items():
        template = F.when(F.col("group") == name, query).otherwise(template)
    number = page.cast("string")
    path = F.when(page == 1, "/").otherwise(F.replace(template, F.lit("%d"), number))
    day = str(as_of).replace("-", "")
    return (
        seeds.filter(F.coalesce(F.col("fqdn"), F.lit("")) != "")
        .select(group.alias("group"), "fqdn")
        .withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(pages))))
        .select(
            "group",
            "fqdn",
            "page",
            F.concat(F.lit("http://"), F.col("fqdn"), path).alias("url"),
            F.concat(F.col("group"), F.lit(f"_{day}_page"), number, F.lit(".html")).alias(
                "file_name"
            ),
        )
    )


def page_walk(
    log: DataFrame, keys: Sequence[str], stop: Column, keep_stop: bool, limit: int | None = None
) -> DataFrame:
    """Pages visited before a walk ends at the first page where ``stop`` holds.

    ``keep_stop`` keeps the stopping page itself; ``limit`` is the last page a walk may reach.
    """
    ends = (
        log.filter(stop)
        .groupBy(*keys)
        .agg(F.min("page").alias("_end"))
        .select(*[F.col(k).alias(f"_{k}") for k in keys], "_end")
    )
    same = [log[k].eqNullSafe(ends[f"_{k}"]) for k in keys]
    walked = log.join(ends, same, "left")
    before = (F.col("page") <= F.col("_end")) if keep_stop else (F.col("page") < F.col("_end"))
    kept = walked.filter(F.col("_end").isNull() | before)
    if limit is not None:
        kept = kept.filter(F.col("page") <= limit)
    return kept.select(*log.columns)


def listing_pages(listings: DataFrame, pages: int) -> DataFrame:
    """Addresses of the pages of each listing; ``style`` names how the site numbers them.

    ``page_arg``: ``?Page=n`` or ``&Page=n`` on every page. ``main_query``:
    ``?page=n#latest_news_section`` after page 1. ``path``: ``/page/n`` after page 1.
    ``single``: one page only.
    """
    base, style, page = F.col("listing"), F.col("style"), F.col("page")
    number = page.cast("string")
    glue = F.when(F.contains(base, F.lit("?")), "&").otherwise("?")
    url = (
        F.when(style == "page_arg", F.concat(base, glue, F.lit("Page="), number))
        .when((page == 1) | (style == "single"), base)
        .when(style == "main_query", F.concat(base, F.lit("?page="), number, F.lit("#latest_news_section")))
        .otherwise(F.concat(base, F.lit("/page/"), number))
    )
    return (
        listings.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(pages))))
        .filter((style != "single") | (page == 1))
        .withColumn("url", url)
    )


def _resolved(link: Column, base: str) -> Column:
    """A link of a page at the site's root as an absolute address."""
    scheme = base.split(":", 1)[0]
    return (
        F.when(link.rlike("(?i)^[a-z][a-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.lit(scheme + ":"), link))
        .when(link.startswith("/"), F.concat(F.lit(base), link))
        .otherwise(F.concat(F.lit(base + "/"), link))
    )


# Path parts that mark a menu link as a category (fixed values).
CATEGORY_PATHS = ("boannews.com/media/", "boannews.com/search/")

_HREF = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""


# The menu of the home page, by the tags it may be made of (fixed value).
_MENU = r"""(?i)<{tag}\b[^>]*?\bid\s*=\s*["']main_menu_hash["'][^>]*>"""
MENU_TAGS = ("div", "ul", "nav")


def category_links(
    html: Column, paths: Sequence[str] = CATEGORY_PATHS, base: str = "https://www.boannews.com"
) -> Column:
    """Addresses in the page's menu that contain one of ``paths``, made absolute, in page order."""
    menu = F.coalesce(*[text.element(html, _MENU.format(tag=t), t) for t in MENU_TAGS])
    found = F.coalesce(menu, F.lit(""))
    links = F.transform(
        F.regexp_extract_all(found, F.lit(_HREF), F.lit(1)),
        lambda x: _resolved(F.trim(text.unescape(x)), base),
    )

    def wanted(link: Column) -> Column:
        found = F.lit(False)
        for path in paths:
            found = found | F.contains(link, F.lit(path))
        return found

    return F.filter(links, wanted)


def number_in_listing(
    cards: DataFrame,
    keys: Sequence[str],
    page: str,
    order: str,
    pages_per_block: int = 4_096,
    rows_per_bucket: int = 65_536,
) -> DataFrame:
    """Running number ``seq`` of each card within its listing, pages in order.

    ``page`` and ``order`` are integers and keys are not null. Cards are ranked
    inside buckets of a page; counts of the buckets before them, in their block of
    pages and in the blocks before it, shift them into place. So neither a long
    listing nor a long page is sorted in one task. ``cards`` is read twice.
    """
    bucketed = cards.withColumn("_bucket", F.floor(F.col(order) / F.lit(rows_per_bucket)))
    unit = [*keys, page, "_bucket"]
    counts = (
        bucketed.groupBy(*unit)
        .agg(F.count("*").alias("_n"))
        .withColumn("_block", F.floor(F.col(page) / F.lit(pages_per_block)))
    )
    earlier = (Window.unboundedPreceding, -1)
    in_block = Window.partitionBy(*keys, "_block").orderBy(page, "_bucket").rowsBetween(*earlier)
    in_listing = Window.partitionBy(*keys).orderBy("_block").rowsBetween(*earlier)
    blocks = (
        counts.groupBy(*keys, "_block")
        .agg(F.sum("_n").alias("_n"))
        .select(*keys, "_block", F.coalesce(F.sum("_n").over(in_listing), F.lit(0)).alias("_before"))
    )
    shift = (
        counts.withColumn("_inside", F.coalesce(F.sum("_n").over(in_block), F.lit(0)))
        .join(blocks, [*keys, "_block"])
        .select(*unit, (F.col("_inside") + F.col("_before")).alias("_shift"))
    )
    inside = Window.partitionBy(*unit).orderBy(order)
    return (
        bucketed.withColumn("_row", F.row_number().over(inside))
        .join(shift, unit)
        .select(*cards.columns, (F.col("_shift") + F.col("_row")).alias("seq"))
    )


def first_cards(cards: DataFrame, limit: Column) -> DataFrame:
    """The first cards of each listing page, up to the site's own number of cards.

    ``position`` is the place on the page, from 1; no sort is needed.
    """
    return cards.filter(limit.isNull() | (F.col("position") <= limit))


def once_per_url(cards: DataFrame) -> DataFrame:
    """One card per site and address: the first category, then the first place, wins."""
    order = [F.col("category_rank"), F.col("page"), F.col("position")]
    return dedupe.keep_first(cards, ["site", "url"], order)
