"""Batch jobs: the public calls that chain the operators into one lazy plan each."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import dates, lists, text
from tidewatch.operators import (
    aggregates,
    cards,
    cluster,
    crawl,
    dedupe,
    features,
    filters,
    joins,
    match,
    neighbours,
    subwords,
)
from tidewatch.session import written
from tidewatch.sources import files, sinks, snapshots


def url_rows(pages: DataFrame) -> DataFrame:
    """``html_file, group, url, domain``: each distinct URL of each page, in the page's order."""
    page = F.col("_text")
    marked = (
        pages.select("html_file", "group", text.visible_text(F.col("html")).alias("_text"))
        .withColumn("_long", text.has_long_run(page))
    )
    # Generated, so that only the found URLs and the rare long text meet the Python
    # step; a plain projection would carry every page's text past it.
    found = F.struct(
        text.jvm_urls(page, F.col("_long")).alias("urls"), F.when(F.col("_long"), page).alias("rest")
    )
    tokens = F.coalesce(F.col("found.urls"), text.python_urls(F.col("found.rest")))
    kept = F.array_distinct(F.filter(tokens, text.keep_url))
    return (
        marked.select("html_file", "group", F.explode(F.array(found)).alias("found"))
        .select("html_file", "group", F.explode(kept).alias("url"))
        .withColumn("domain", text.domain_of(F.col("url")))
        .filter(F.col("domain") != "")
    )


def extract_indicators(pages: DataFrame, dns: DataFrame) -> DataFrame:
    """URL rows of saved pages with the address of their domain."""
    return joins.resolve_domains(url_rows(pages), dns)


def merge_hosts(base: DataFrame, *new: DataFrame) -> DataFrame:
    """New URL rows after the existing host rows, one per url."""
    return dedupe.merge_keep_first(base, new)


def enrich_hosts(
    hosts: DataFrame, scan_documents: DataFrame, newest_by: str | None = None
) -> DataFrame:
    """Host rows with the features of their scan document ``(ip, json)``.

    Only documents of addresses that need enrichment are parsed. Of several
    documents of an address the one with the largest ``newest_by`` counts.
    """
    order = F.desc(newest_by) if newest_by else F.col("json")
    wanted = scan_documents.join(joins.wanted_addresses(hosts), "ip", "left_semi")
    documents = dedupe.keep_first(wanted, ["ip"], [order]).select("ip", "json")
    return joins.enrich_hosts(hosts, snapshots.host_scans(documents))


def derive_cves(hosts: DataFrame) -> DataFrame:
    """Host rows with ``cve_list`` from ``vulns`` and, where present, ``shodan_vulns``."""
    listed = F.col("shodan_vulns") if "shodan_vulns" in hosts.columns else F.lit(None).cast("string")
    return hosts.withColumn("cve_list", lists.combine_cves(F.col("vulns"), listed))


def refresh_cve_table(pairs: DataFrame, cves: DataFrame, detail_documents: DataFrame) -> DataFrame:
    """The CVE table, then new CVEs of the hosts that have a detail document ``(cve_id, json)``.

    Only documents of new CVEs are parsed. A CVE without one stays new and is
    looked up again on the next run.
    """
    wanted = detail_documents.join(joins.new_cves(pairs, cves), "cve_id", "left_semi")
    found = snapshots.cve_details(wanted).filter(F.col("error").isNull())
    return dedupe.union_aligned([cves, found])


def match_techniques(
    texts: DataFrame,
    techniques: DataFrame,
    text_col: str,
    match_on: str = "technique_name",
    broadcast_postings: int = match.BROADCAST_POSTINGS,
) -> DataFrame:
    """``texts`` with ``mitre_match``: the most similar technique of each text, row by row.

    Articles match technique names, CVE summaries match descriptions
    (``match_on="description"``). Every word of the techniques counts. Techniques without
    text have no part; those without an ``ordinal`` are numbered as they come.
    """
    usable = files.match_texts(techniques, match_on).filter(~text.is_blank(F.col("text")))
    if "ordinal" not in usable.columns:
        usable = usable.withColumn("ordinal", F.monotonically_increasing_id())
    return match.with_match(texts, text_col, written(usable), broadcast_postings)


def match_unmatched(cves: DataFrame, techniques: DataFrame) -> DataFrame:
    """CVE rows with a match for each that lacks one; matched rows pass by."""
    if "mitre_match" not in cves.columns:
        return match_techniques(cves, techniques, "summary", "description")
    open_rows = cves.filter(F.col("mitre_match").isNull()).drop("mitre_match")
    matched = match_techniques(open_rows, techniques, "summary", "description")
    return cves.filter(F.col("mitre_match").isNotNull()).unionByName(matched)


def add_coordinates(hosts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    return joins.add_coordinates(hosts, gazetteer)


def build_news(
    article_files: DataFrame,
    techniques: DataFrame,
    translated_source: str | None = None,
    translate: features.ModelFn | None = None,
) -> DataFrame:
    """Articles of ``(path, value)`` files with summary and technique match, ready to append."""
    articles = files.parse_articles(article_files)
    if translated_source and translate:
        articles = features.transform_source(articles, translated_source, translate)
        # A model is costly and need not repeat itself, so its output is written once.
        articles = written(articles)
    summed = articles.withColumn("summary", features.summary(F.col("content")))
    return match_techniques(summed, techniques, "content").select(
        "title",
        "content",
        dates.date_text(F.col("date")).alias("date"),
        "source",
        "summary",
        "mitre_match",
    )


@dataclass(frozen=True)
class GroupProfile:
    hosts: DataFrame
    center: DataFrame
    regions: DataFrame
    techniques: DataFrame


def group_profile(
    hosts: DataFrame, pairs: DataFrame, cves: DataFrame, techniques: DataFrame, group: str
) -> GroupProfile:
    """What the group page shows: labelled hosts, map centre, servers per region, techniques.

    ``hosts`` holds ``host_id, group, domain, country_code, region_code, latitude,
    longitude``; ``pairs`` holds distinct ``host_id, cve_id``; ``cves`` has flat
    ``technique_id`` and ``cvss``.
    """
    known = aggregates.usable_techniques(techniques)
    usable = aggregates.usable_cves(cves)
    mine = hosts.dropna(subset=["latitude", "longitude"]).filter(F.col("group") == group)
    own_pairs = pairs.join(mine.select("host_id"), "host_id", "left_semi")
    summaries = aggregates.host_summaries(own_pairs, usable, known)
    labelled = (
        mine.join(summaries, "host_id", "left")
        .fillna("", subset=["cve_summary", "ttp_summary"])
        .withColumns(
            {
                "region_full": lists.region_label(F.col("country_code"), F.col("region_code")),
                "tooltip_info": lists.tooltip(
                    F.col("group"), F.col("domain"), F.col("cve_summary"), F.col("ttp_summary")
                ),
            }
        )
    )
    named = aggregates.group_cves(own_pairs, mine, usable, group).join(known, "technique_id")
    counts = named.groupBy("technique_id", "technique_name", "description").agg(
        F.count("*").alias("count")
    )
    region = mine.withColumn(
        "region_full", lists.region_label(F.col("country_code"), F.col("region_code"))
    )
    return GroupProfile(
        labelled,
        aggregates.mean_position(mine),
        aggregates.value_counts(region, "region_full", "server_count"),
        counts,
    )


@dataclass(frozen=True)
class ClusterProfile:
    sweep: cluster.Sweep
    labels: DataFrame
    positions: DataFrame
    technique_counts: DataFrame
    top: DataFrame
    prompts: DataFrame
    radar: DataFrame
    catalogue: DataFrame
    vectors: DataFrame

    def layout(self) -> DataFrame:
        """``group, x, y``: positions that keep similar groups together, also where no plane does."""
        return neighbours.spectral_layout(self.vectors, "group")


def technique_matrix(pairs: DataFrame, hosts: DataFrame, cves: DataFrame) -> DataFrame:
    """The written group x technique counts, in long form: a pair without a row is 0."""
    return written(aggregates.key_technique_counts(pairs, hosts, cves))


def cluster_profile(
    hosts: DataFrame,
    pairs: DataFrame,
    cves: DataFrame,
    techniques: DataFrame,
    selected: Sequence[int] | None = None,
) -> ClusterProfile:
    """What the cluster page shows; ``selected`` limits the technique tables to some clusters."""
    known = aggregates.usable_techniques(techniques)
    usable = aggregates.usable_cves(cves)
    placed = hosts.dropna(subset=["latitude", "longitude"])
    scaled, dims = cluster.scaled_vectors(technique_matrix(pairs, placed, usable), "group")
    vectors = written(scaled)
    sweep = cluster.sweep_k(vectors, "group", vectors.count(), dims)
    labels = written(cluster.assign(vectors, "group", sweep.model))
    members = placed.select("host_id", "group").join(labels, "group", "left")
    if selected is not None:
        members = members.filter(F.col("cluster").isin(list(selected)))
    counts = written(
        aggregates.describe_techniques(
            aggregates.key_technique_counts(pairs, members, usable, "cluster"), known
        )
    )
    top = aggregates.top_techniques(counts)
    prompts = aggregates.technique_text(top).withColumn(
        "prompt", aggregates.prompt_text(F.col("cluster"), F.col("description_text"))
    )
    return ClusterProfile(
        sweep,
        labels,
        cluster.project_2d(vectors, "group"),
        counts,
        top,
        prompts,
        aggregates.radar_counts(counts),
        aggregates.technique_catalogue(known),
        vectors,
    )


def news_calendar(news: DataFrame, item: str = "title", order: str = "ordinal") -> DataFrame:
    """News with their place in the day and the neighbouring articles and days.

    ``date`` is ``yyyy-MM-dd`` text and ``order`` a unique integer; undated rows
    have no place.
    """
    dated = news.withColumn(
        "date_str", F.date_format(F.try_to_date("date", "yyyy-MM-dd"), "yyyy-MM-dd")
    ).filter(F.col("date_str").isNotNull())
    placed = aggregates.neighbours(dated, "date_str", item, order)
    return placed.join(aggregates.neighbour_dates(dated, "date_str"), "date_str")


def refresh_seeds(
    posts: DataFrame, feed: DataFrame, seeds: DataFrame, as_of: date | str
) -> DataFrame:
    """Seeds after today's leak posts: the newest usable address of each group named today."""
    today = posts.filter(filters.on_day(F.col("date"), as_of)).select("group").distinct()
    newest = joins.latest_locations(files.explode_feed(feed))
    current = today.join(newest, F.col("group") == F.col("name")).select("group", "fqdn")
    return joins.upsert_seeds(seeds, current)


def expand_seed_pages(
    seeds: DataFrame, fetch_log: DataFrame, as_of: date | str
) -> DataFrame:
    """Seed pages that were fetched before each host's first failure.

    ``fetch_log`` holds ``fqdn, page, ok``; a page without an entry was not fetched.
    """
    planned = crawl.seed_pages(seeds, as_of)
    # A log may hold many rows for each row of its file, which Spark's estimate of its size leaves out: never sent whole.
    log = planned.join(fetch_log.hint("merge"), ["fqdn", "page"], "left")
    failed = ~F.coalesce(F.col("ok"), F.lit(False))
    return crawl.page_walk(log, ["fqdn"], failed, keep_stop=False).drop("ok")


def select_articles(
    listing_pages: DataFrame,
    article_pages: DataFrame,
    as_of: date | str,
    rules: Sequence[cards.SiteRule] = cards.SITE_RULES,
    newest_by: str | None = None,
) -> DataFrame:
    return cards.select_articles(listing_pages, article_pages, as_of, rules, newest_by)


def refresh_holdout(new: DataFrame, train: DataFrame, holdout: DataFrame) -> DataFrame:
    return dedupe.refresh_holdout(new, train, holdout)


def search_documents(article_files: DataFrame, as_of: date | str, source: str) -> DataFrame:
    return sinks.search_documents(article_files, as_of, source)


def retain(table: DataFrame, as_of: date | str, column: str = "date") -> DataFrame:
    return sinks.retain(table, as_of, column)


def embed_long_texts(
    texts: DataFrame, id_col: str, text_col: str, vocabulary: DataFrame | None = None
) -> DataFrame:
    """``id, word, weight`` of texts of any length, with word weights from the texts themselves.

    With the ``vocabulary`` (``piece``) of a model its tokens are counted and weighed in place of words.
    """
    if vocabulary is not None:
        cut = subwords.with_tokens(texts.select(id_col, text_col), text_col, vocabulary, to="_tokens")
        # Tokens are read for the weights and for the vectors, and cut once.
        texts = written(cut.select(id_col, F.col("_tokens").alias(text_col)))
    weights = features.word_weights(texts, text_col)
    return features.embed_long_texts(texts, weights, id_col, text_col)
