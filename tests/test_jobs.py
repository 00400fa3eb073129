"""The composite jobs end to end on small tables."""

from __future__ import annotations

import datetime as dt
import json
import re

from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.plans import jobs
from tidewatch.sources import files, sinks

PAGE = "<html><body><p>{}</p>" + "x" * 60 + "</body></html>"


def test_indicator_flow(spark):
    pages = spark.createDataFrame(
        [
            ("p1.html", "play", PAGE.format("leak of http://www.victim.com/a and victim.com, bad.onion")),
            ("p2.html", "play", PAGE.format("victim.com again; other.org")),
            ("p3.html", "akira", PAGE.format("nowhere.net")),
        ],
        "html_file string, `group` string, html string",
    )
    dns = spark.createDataFrame(
        [("victim.com", 1, "1.1.1.1", None), ("other.org", 1, "2.2.2.2", None)], schemas.DNS
    )
    urls = jobs.extract_indicators(pages, dns)
    assert sorted((r.html_file, r.url, r.ip_address or "") for r in urls.collect()) == [
        ("p1.html", "http://www.victim.com/a", "1.1.1.1"), ("p1.html", "victim.com", "1.1.1.1"),
        ("p2.html", "other.org", "2.2.2.2"), ("p2.html", "victim.com", "1.1.1.1"), ("p3.html", "nowhere.net", ""),
    ]
    new = urls.withColumns({"file": F.col("html_file"), "ordinal": F.lit(0)})
    base = spark.createDataFrame([("other.org", "old", "f", 0)], "url string, `group` string, file string, ordinal int")
    hosts = jobs.merge_hosts(base, new)
    by_url = {r.url: r for r in hosts.collect()}
    assert set(by_url) == {"http://www.victim.com/a", "victim.com", "other.org", "nowhere.net"}
    assert by_url["other.org"].group == "old" and by_url["victim.com"].html_file == "p1.html"

    scans = spark.createDataFrame(
        [("1.1.1.1", json.dumps({"data": [{"vulns": {"CVE-2024-1": {}, "CVE-2024-2": {}}}], "asn": "AS1", "country_code": "KR", "region_code": "11"}))],
        "ip string, json string",
    )
    enriched = jobs.derive_cves(jobs.enrich_hosts(hosts, scans))
    listed = {r.url: r.cve_list for r in enriched.collect()}
    assert listed["victim.com"] == ["CVE-2024-1", "CVE-2024-2"] and listed["nowhere.net"] == []

    pairs = enriched.select(F.col("url").alias("host_id"), F.explode("cve_list").alias("cve_id"))
    cves = spark.createDataFrame([("CVE-2024-1", "mail phishing")], "cve_id string, summary string")
    details = spark.createDataFrame(
        [("CVE-2024-2", json.dumps({"cve_id": "CVE-2024-2", "summary": "scan of networks", "cvss": 5.0}))], "cve_id string, json string"
    )
    table = jobs.refresh_cve_table(pairs, cves, details)
    techniques = spark.createDataFrame(
        [("T1", "Phishing", "phishing by mail"), ("T2", "Discovery", "scan networks")], schemas.TECHNIQUE
    )
    matched = {r.cve_id: r.mitre_match for r in jobs.match_unmatched(table, techniques).collect()}
    assert {c: (m.id, m.name) for c, m in matched.items()} == {"CVE-2024-1": ("T1", "Phishing"), "CVE-2024-2": ("T2", "Discovery")}

    places = spark.createDataFrame([("11", "KR", 37.5, 127.0)], schemas.GAZETTEER)
    located = {r.url: (r.latitude, r.longitude) for r in jobs.add_coordinates(enriched, places).collect()}
    assert located["victim.com"] == (37.5, 127.0) and located["nowhere.net"] == (None, None)


def article(title, body):
    return f"제목: {title}\nURL: http://u/{title}\n{body}"


def test_news_flow(spark, tmp_path):
    texts = spark.createDataFrame(
        [
            ("boannews/2025-06-03/1_a/article.txt", article("가", "피싱 메일 공격.")),
            ("thn/June 03, 2025/2_b/article.txt", article("b", "Attackers scan the network. They scan hosts again.")),
            ("thn/2025-06-02/3_c/article.txt", article("c", " ")),
            ("thn/2025-06-02/4_d/article.txt", "no title"),
        ],
        "path string, value string",
    )
    techniques = spark.createDataFrame(
        [("T1", "Phishing Mail", "x"), ("T2", "Network Scan", "y")], schemas.TECHNIQUE
    )

    def translate(batches):
        for batch in batches:
            yield batch.assign(content=batch["content"].str.replace("피싱 메일 공격", "phishing mail attack"))

    news = jobs.build_news(texts, techniques, "boannews", translate)
    got = {r.title: r for r in news.collect()}
    assert set(got) == {"가", "b", "c"}
    assert got["가"].content == "phishing mail attack." and got["가"].mitre_match.id == "T1"
    assert got["b"].mitre_match.name == "Network Scan" and got["b"].date == "2025-06-03"
    assert got["c"].mitre_match is None and got["c"].summary == ""
    assert got["b"].summary == "Attackers scan the network. They scan hosts again."

    sinks.append_news(news, str(tmp_path / "store"))
    stored = spark.read.schema(schemas.NEWS).json(str(tmp_path / "store"))
    placed = jobs.news_calendar(stored.withColumn("ordinal", F.ascii("title")))
    rows = {r.title: (r.date_str, r.position, r["of"], r.previous_item, r.next_item, r.previous_date, r.next_date) for r in placed.collect()}
    assert rows["c"] == ("2025-06-02", 1, 1, "c", "c", "2025-06-02", "2025-06-03")
    assert rows["b"] == ("2025-06-03", 1, 2, "가", "가", "2025-06-02", "2025-06-03")


def tables(spark):
    hosts = spark.createDataFrame(
        [
            (1, "g1", "a.com", "KR", "11", 10.0, 20.0), (2, "g1", "b.com", "KR", "11", 30.0, 40.0), (3, "g1", "c.com", "KR", None, 20.0, 30.0),
            (4, "g1", "d.com", "KR", "11", None, 1.0), (5, "g2", "e.com", "US", "CA", 1.0, 1.0), (6, "g3", "f.com", "US", "CA", 1.0, 1.0),
        ],
        "host_id int, `group` string, domain string, country_code string, region_code string, latitude double, longitude double",
    )
    pairs = spark.createDataFrame(
        [(1, "C1"), (1, "C2"), (1, "C3"), (1, "C4"), (2, "C1"), (4, "C5"), (5, "C2"), (6, "C1"), (6, "C9")], "host_id int, cve_id string"
    )
    cves = spark.createDataFrame(
        [("C1", 1.0, "T1"), ("C2", 1.0, "T2"), ("C3", 1.0, "T1"), ("C4", None, "T2"), ("C5", 1.0, "T2")], "cve_id string, cvss double, technique_id string"
    )
    techniques = spark.createDataFrame([("T1", "Phish", "p"), ("T2", "Scan", "s"), ("T3", "Other", None)], schemas.TECHNIQUE)
    return hosts, pairs, cves, techniques


def test_group_profile(spark):
    profile = jobs.group_profile(*tables(spark), "g1")
    tips = {r.host_id: r.tooltip_info for r in profile.hosts.collect()}
    assert tips == {
        1: "Group: g1\nDomain: a.com\nCVE: C1, C2, C3...\nTTP: Phish, Scan", 2: "Group: g1\nDomain: b.com\nCVE: C1\nTTP: Phish",
        3: "Group: g1\nDomain: c.com\nCVE: \nTTP: ",
    }
    assert [tuple(r) for r in profile.center.collect()] == [("g1", 20.0, 30.0)]
    assert [tuple(r) for r in profile.regions.collect()] == [("KR - 11", 2)]
    assert sorted(tuple(r) for r in profile.techniques.collect()) == [("T1", "Phish", "p", 2), ("T2", "Scan", "s", 1)]


def test_cluster_profile(spark):
    profile = jobs.cluster_profile(*tables(spark))
    labels = {r.group: r.cluster for r in profile.labels.collect()}
    assert set(labels) == {"g1", "g2", "g3"} and len(set(labels.values())) == profile.sweep.best_k == 2
    counts = {(r.cluster, r.technique_id): r["count"] for r in profile.technique_counts.collect()}
    assert sum(counts.values()) == 6
    assert {r.cluster for r in profile.prompts.collect()} == set(labels.values())
    assert all("MITRE ATT&CK" in r.prompt and r.description_text in r.prompt for r in profile.prompts.collect())
    assert profile.radar.count() == 4 and profile.positions.count() == 3
    assert [r.technique_id for r in profile.catalogue.collect()] == ["T1", "T2"]
    one = labels["g1"]
    only = jobs.cluster_profile(*tables(spark), selected=[one])
    assert {r.cluster for r in only.technique_counts.collect()} == {one}


def test_refresh_seeds(spark):
    posts = spark.createDataFrame(
        [(dt.date(2025, 6, 3), "t", "g1"), (dt.date(2025, 6, 3), "u", "g1"), (dt.date(2025, 6, 2), "v", "g2"), (dt.date(2025, 6, 3), "w", "g3")],
        schemas.LEAK_POST,
    )
    day = dt.datetime(2025, 1, 1)
    feed = spark.createDataFrame(
        [("g1", [("n.onion", True, day), ("o.onion", True, dt.datetime(2024, 1, 1))]), ("g2", [("x.onion", True, day)]), ("g3", [("y.com", True, day)])],
        schemas.GROUP_FEED,
    )
    seeds = spark.createDataFrame([("g1", "o.onion"), ("g2", "old.onion")], schemas.SEED)
    got = sorted(tuple(r) for r in jobs.refresh_seeds(posts, feed, seeds, "2025-06-03").collect())
    assert got == [("g1", "n.onion", "update"), ("g2", "old.onion", "keep")]


def test_search_and_retention_jobs(spark):
    texts = spark.createDataFrame([("a/article.txt", article("T", "\nbody"))], "path string, value string")
    (doc,) = jobs.search_documents(texts, "2025-06-03", "S").collect()
    assert (doc.title, doc.content) == ("T", "body")
    kept = jobs.retain(spark.createDataFrame([("June 3, 2025",), ("2025-06-04",)], "date string"), "2025-06-03")
    assert kept.count() == 1


def test_embed_long_texts_job(spark):
    texts = spark.createDataFrame([(1, "a b c"), (2, ""), (3, "c d")], "id int, t string")
    found = jobs.embed_long_texts(texts, "id", "t").collect()
    # A word of every text weighs nothing.
    assert sorted((r.id, r.word) for r in found) == [(1, "a"), (1, "b"), (3, "d")]
    assert files.match_texts(spark.createDataFrame([("T", None)], "technique_id string, technique_name string")).first().text == ""


def test_a_log_made_of_few_rows_is_not_sent_whole(spark, tmp_path):
    hosts = spark.range(1000).select(F.col("id").cast("string").alias("group"), F.concat(F.lit("h"), "id").alias("fqdn"))
    hosts.write.parquet(f"{tmp_path}/hosts")
    seeds = spark.read.parquet(f"{tmp_path}/hosts")
    log = seeds.select("fqdn", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("page"))
    fetched = jobs.expand_seed_pages(seeds, log.withColumn("ok", F.col("page") < 3), "2024-03-05")
    text = fetched._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[fqdn#\d+, page#\d+\]", text)
    assert fetched.groupBy("page").count().orderBy("page").collect() == [(1, 1000), (2, 1000)]
