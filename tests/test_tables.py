"""Joins, merges, dedupe and aggregates on literal frames with the edge rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.operators import aggregates, dedupe, filters, joins
from tidewatch.plans import jobs


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def test_resolve_domains(spark):
    urls = spark.createDataFrame([("a.com",), ("a.com",), ("b.com",), ("c.com",), ("d.com",)], "domain string")
    dns = spark.createDataFrame(
        [
            ("a.com", 2, " 1.1.1.2 ", None), ("a.com", 1, "alias.a.com", None), ("a.com", 3, "1.1.1.3", None),
            ("b.com", 1, "alias", None), ("c.com", 1, None, "DIG_TIMEOUT"),
        ],
        schemas.DNS,
    )
    assert rows(joins.resolve_domains(urls, dns), "domain", "ip_address", "ip_status") == [
        ("a.com", "1.1.1.2", "OK"), ("a.com", "1.1.1.2", "OK"), ("b.com", None, "NO_IP_FOUND"),
        ("c.com", None, "DIG_TIMEOUT"), ("d.com", None, "NO_IP_FOUND"),
    ]


def test_enrich_hosts_only_fills_rows_that_need_it(spark):
    hosts = spark.createDataFrame(
        [
            ("u1", "1.1.1.1", None, "nan", " "), ("u2", "1.1.1.1", "AS9", None, None),
            ("u3", "NO_IP_FOUND", None, None, None), ("u4", None, None, None, None), ("u5", "9.9.9.9", None, None, None),
        ],
        "url string, ip_address string, asn string, product string, vulns string",
    )
    scans = spark.createDataFrame(
        [("1.1.1.1", "AS1", None, "org")], "ip string, asn string, product string, org string"
    )
    scans = dedupe.add_missing(scans, schemas.HOST_FEATURES)
    got = {r.url: r for r in joins.enrich_hosts(hosts, scans).collect()}
    assert len(got) == 5
    assert (got["u1"].asn, got["u1"].product, got["u1"].org) == ("AS1", None, "org")
    assert (got["u2"].asn, got["u2"].org) == ("AS9", None)
    assert got["u3"].asn is None and got["u4"].asn is None and got["u5"].asn is None


def test_cve_refresh_keeps_unmatched_ones_wanted(spark):
    pairs = spark.createDataFrame([(1, "CVE-1"), (1, "CVE-2"), (2, "CVE-3"), (2, "CVE-2")], "host_id int, cve_id string")
    cves = spark.createDataFrame([("CVE-1", "old"), (None, "x")], "cve_id string, summary string")
    wanted = joins.new_cves(pairs, cves)
    assert [r[0] for r in wanted.collect()] == ["CVE-2", "CVE-3"]
    details = spark.createDataFrame(
        [("CVE-2", '{"cve_id": "CVE-2", "summary": "new", "cvss": 5.0}'), ("CVE-1", '{"cve_id": "CVE-1"}'), ("CVE-3", None)],
        "cve_id string, json string",
    )
    refreshed = jobs.refresh_cve_table(pairs, cves, details)
    assert rows(refreshed, "cve_id", "summary", "cvss") == [
        ("CVE-1", "old", None), ("CVE-2", "new", 5.0), (None, "x", None),
    ]


def test_newest_scan_document_counts(spark):
    hosts = spark.createDataFrame([("u1", "1.1.1.1"), ("u2", "1.1.1.1")], "url string, ip_address string")
    scans = spark.createDataFrame(
        [("1.1.1.1", '{"asn": "old"}', 1), ("1.1.1.1", '{"asn": "new"}', 2), ("2.2.2.2", "{", 1)], "ip string, json string, at int"
    )
    assert rows(jobs.enrich_hosts(hosts, scans, "at"), "url", "asn") == [("u1", "new"), ("u2", "new")]


def test_merge_keeps_base_rows_and_aligns_columns(spark):
    base = spark.createDataFrame(
        [("u1", "base1", "f0", 0), ("u1", "base2", "f0", 1), (None, "base3", "f0", 2)],
        "url string, a string, file string, ordinal int",
    )
    new = spark.createDataFrame(
        [("u1", "new1", 1, "f2", 0), ("u2", "new2", 2, "f2", 1), (None, "new3", 3, "f2", 2), ("u2", "new4", 4, "f1", 9)],
        "url string, a string, b int, file string, ordinal int",
    )
    merged = dedupe.merge_keep_first(base, [new])
    assert merged.columns == ["url", "a", "b"]
    assert rows(merged) == [("u1", "base1", None), ("u2", "new4", 4), (None, "base3", None)]
    counted_merge, counted = dedupe.observed_merge(base, [new])
    assert rows(counted_merge) == rows(merged)
    assert counted.get == {"base_rows": 2, "merged_rows": 3, "added_rows": 1}


def test_holdout_matches_null_to_null(spark):
    new = spark.createDataFrame([("a", "f", 1), ("b", "f", 2), (None, "f", 3)], "extracted_url string, file string, ordinal int")
    train = spark.createDataFrame([("a",), (None,)], "url string")
    hold = spark.createDataFrame([("c", "f", 1), ("c", "f", 2)], "url string, file string, ordinal int")
    assert rows(dedupe.refresh_holdout(new, train, hold)) == [("b",), ("c",)]
    kept, before, after = dedupe.observed_holdout(new, train, hold)
    assert rows(kept) == [("b",), ("c",)]
    assert before.get | after.get == {"left_rows": 1, "merged_rows": 3, "final_rows": 2}


def test_add_coordinates(spark):
    hosts = spark.createDataFrame(
        [
            ("full", "11", "KR", 1.0, 2.0), ("half", "11", "KR", 1.0, None), ("none", "11", "KR", None, None),
            ("nokey", None, "KR", None, 5.0), ("unknown", "99", "KR", None, None),
        ],
        "id string, region_code string, country_code string, latitude double, longitude double",
    )
    places = spark.createDataFrame([("11", "KR", 37.5, 127.0), ("11", "KR", 40.0, 0.0)], schemas.GAZETTEER)
    assert rows(joins.add_coordinates(hosts, places), "id", "latitude", "longitude") == [
        ("full", 1.0, 2.0), ("half", 37.5, 127.0), ("nokey", None, None), ("none", 37.5, 127.0),
        ("unknown", None, None),
    ]


def test_seed_upsert(spark):
    day = dt.datetime(2025, 1, 1)
    later = dt.datetime(2025, 1, 2)
    locations = spark.createDataFrame(
        [
            ("g1", 0, "old.onion", True, day), ("g1", 1, "new.onion", True, later), ("g1", 2, "tie.onion", True, later),
            ("g2", 0, "off.onion", False, later), ("g3", 0, "web.com", True, later), ("g4", 0, "x.onion", True, None),
        ],
        "name string, ordinal int, fqdn string, enabled boolean, updated timestamp",
    )
    newest = joins.latest_locations(locations)
    assert rows(newest) == [("g1", "new.onion"), ("g4", "x.onion")]
    seeds = spark.createDataFrame([("g1", "old.onion"), ("g4", "x.onion"), ("g5", "keep.onion")], schemas.SEED)
    current = newest.withColumnRenamed("name", "group").unionByName(
        spark.createDataFrame([("g6", "ins.onion")], "`group` string, fqdn string")
    )
    assert rows(joins.upsert_seeds(seeds, current)) == [
        ("g1", "new.onion", "update"), ("g4", "x.onion", "keep"), ("g5", "keep.onion", "keep"),
        ("g6", "ins.onion", "insert"),
    ]


def test_needs_enrichment_and_missing_text(spark):
    df = spark.createDataFrame([(None,), ("",), (" ",), ("NaN",), ("x",)], "v string")
    assert [r[0] for r in df.select(filters.is_missing(F.col("v"))).collect()] == [True, True, True, True, False]


def test_technique_counts_with_edges(spark):
    hosts = spark.createDataFrame([(1, "g1"), (2, "g1"), (3, "g2"), (4, None)], "host_id int, `group` string")
    lists_ = spark.createDataFrame([(1, ["C1", "C2"]), (2, ["C1", None]), (3, []), (4, ["C1"])], "host_id int, cve_list array<string>")
    cves = spark.createDataFrame([("C1", 1.0, "T1"), ("C2", 2.0, "T2"), ("C9", None, "T9")], "cve_id string, cvss double, technique_id string")
    pairs = aggregates.explode_cves(lists_)
    counts = aggregates.key_technique_counts(pairs, hosts, aggregates.usable_cves(cves))
    assert rows(counts) == [("g1", "T1", 2), ("g1", "T2", 1)]
    wide = aggregates.pivot_counts(counts, "group", ["T1", "T2", "T3"])
    assert rows(wide) == [("g1", 2, 1, 0)]


def test_top_techniques_and_radar_keep_ids_with_values(spark):
    counts = spark.createDataFrame(
        [("c1", f"T{i}", 10 - i % 3) for i in range(9)] + [("c2", "T8", 100), ("c3", "T0", 0)],
        "cluster string, technique_id string, count long",
    )
    top = aggregates.top_techniques(counts, k=2)
    assert rows(top.filter("cluster = 'c1'"), "technique_id", "rank") == [("T0", 1), ("T3", 2)]
    radar = {(r.cluster, r.technique_id): r["count"] for r in aggregates.radar_counts(counts, k=2).collect()}
    assert radar == {("c1", "T0"): 10, ("c1", "T8"): 8, ("c2", "T0"): 0, ("c2", "T8"): 100, ("c3", "T0"): 0, ("c3", "T8"): 0}


def test_neighbours_cross_buckets_and_wrap(spark):
    df = spark.createDataFrame([("d1", i) for i in (1, 5, 12, 13, 40)] + [("d2", 7)], "day string, n int")
    got = {(r.day, r.n): (r.position, r["of"], r.previous_item, r.next_item) for r in
           aggregates.neighbours(df, "day", "n", "n", bucket_rows=10).collect()}
    assert got == {
        ("d1", 1): (1, 5, 40, 5), ("d1", 5): (2, 5, 1, 12), ("d1", 12): (3, 5, 5, 13),
        ("d1", 13): (4, 5, 12, 40), ("d1", 40): (5, 5, 13, 1), ("d2", 7): (1, 1, 7, 7),
    }
    days = aggregates.neighbour_dates(df, "day")
    assert rows(days) == [("d1", "d1", "d2"), ("d2", "d1", "d2")]


def test_technique_table_is_unique_and_complete(spark):
    techniques = spark.createDataFrame(
        [("T1", "b", "d"), ("T1", "a", "d"), ("T2", None, "d"), (None, "x", "d")], schemas.TECHNIQUE
    )
    assert rows(aggregates.usable_techniques(techniques)) == [("T1", "a", "d")]
