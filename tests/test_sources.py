"""File sources and sinks on small folders."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.functions import text
from tidewatch.operators import dedupe
from tidewatch.sources import files, sinks, tables

ARTICLE = "제목: First title\nURL: http://a/1\n날짜: 2025-06-03\n\n요약: short\n\n본문:\nline one\n\nline two\n"


def put(root, path, content):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(content, encoding="utf-8")


def test_article_source(spark, tmp_path):
    put(tmp_path, "boannews/2025-06-03/1_한글 이름/article.txt", ARTICLE)
    put(tmp_path, "gbhackers/June 03, 2025/2_a+b%20c/article.txt", "제목: Second\nskipped\nbody")
    put(tmp_path, "bleeping_computer/Jun 03, 2025/3_x/article.txt", "x\n제목: Third\nURL: u\n")
    put(tmp_path, "thn/2025-06-03/4_y/article.txt", "no title here")
    put(tmp_path, "thn/2025-06-03/4_y/other.txt", ARTICLE)
    put(tmp_path, "article.txt", "제목: Root\nURL: u\nroot body")
    got = {r.title: r for r in files.parse_articles(files.read_article_files(spark, str(tmp_path))).collect()}
    assert set(got) == {"First title", "Second", "Third", "Root"}
    first = got["First title"]
    assert first.content == "날짜: 2025-06-03\n\n요약: short\n\n본문:\nline one\n\nline two"
    assert (first.source, str(first.date)) == ("boannews", "2025-06-03")
    assert (got["Second"].content, str(got["Second"].date)) == ("body", "2025-06-03")
    assert got["Second"].path == "gbhackers/June 03, 2025/2_a+b%20c/article.txt"
    # A short month in a folder name is unreadable by default and readable on request.
    assert got["Third"].date is None and got["Third"].content == ""
    more = (*files.dates.DIRECTORY_FORMATS, "MMM d, yyyy")
    third = files.parse_articles(files.read_article_files(spark, str(tmp_path)), more).filter("title = 'Third'").first()
    assert str(third.date) == "2025-06-03"
    assert (got["Root"].source, got["Root"].date) == (".", None)


def test_page_source(spark, tmp_path):
    long = "<p>" + "x" * 60 + "</p>"
    put(tmp_path, "play/play_20250603_page1.html", long)
    put(tmp_path, "a/b/deep.html", long)
    put(tmp_path, "root.html", long)
    put(tmp_path, "play/short.html", "<p>short</p>")
    put(tmp_path, "play/note.txt", long)
    got = {(r.group, r.html_file) for r in files.read_pages(spark, str(tmp_path)).collect()}
    assert got == {("play", "play_20250603_page1.html"), ("b", "deep.html"), ("unknown_group_at_root", "root.html")}


def test_csv_folder_merge(spark, tmp_path):
    put(tmp_path, "shodan_data.csv", "html_file,group,url,domain,ip_address,product\nf,g,u1,d,1.1.1.1,nginx\n")
    put(tmp_path, "20250602.csv", "\ufeffhtml_file,group,url,domain,ip_address\nf2,g,u1,d,2.2.2.2\nf2,g,u2,d,2.2.2.2\n")
    put(tmp_path, "20250603.csv", "html_file,group,url,domain,ip_address\nf3,\"a, \"\"b\"\"\",u2,d,3.3.3.3\nf3,g,u3,d,3.3.3.3\n")
    base = files.read_csv_table(spark, str(tmp_path / "shodan_data.csv"), schemas.URL_ROW + ", product string")
    new = files.read_csv_folder(spark, str(tmp_path), schemas.URL_ROW)
    put(tmp_path, "20250604.csv", "url,note\nu4,\"two\nlines\"\n")
    new = files.read_csv_folder(spark, str(tmp_path), schemas.URL_ROW)
    assert new.count() == 5
    merged = {r.url: r for r in dedupe.merge_keep_first(base, [new]).collect()}
    assert {u: (r.html_file, r.product) for u, r in merged.items()} == {
        "u1": ("f", "nginx"), "u2": ("f2", None), "u3": ("f3", None), "u4": (None, None),
    }
    assert merged["u4"].note == "two\nlines" and merged["u3"].group == "g" and merged["u2"].group == "g"


def test_csv_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a, \"q\"\nx", ["CVE-1", "CVE-2"])], "t string, cve_list array<string>")
    sinks.write_table(df, str(tmp_path / "out"), "csv")
    back = files.read_csv_table(spark, str(tmp_path / "out"), "t string, cve_list string").first()
    assert (back.t, json.loads(back.cve_list)) == ("a, \"q\"\nx", ["CVE-1", "CVE-2"])
    sinks.write_table(df, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).first().cve_list == ["CVE-1", "CVE-2"]


def test_techniques(spark, tmp_path):
    put(tmp_path, "t.csv", "ID , Name,Description,url\nT1,Phishing,\"Mail, that\nlies\",x\nT2,Scan,,y\n")
    table = files.read_techniques(spark, str(tmp_path / "t.csv"))
    assert table.columns[:3] == ["technique_id", "technique_name", "description"]
    names = [tuple(r) for r in files.match_texts(table).collect()]
    assert names == [("T1", "Phishing", "Phishing"), ("T2", "Scan", "Scan")]
    texts = [tuple(r) for r in files.match_texts(table, "description").collect()]
    assert texts == [("T1", "Phishing", "Mail, that\nlies"), ("T2", "Scan", "")]
    # Without a name column the description stands in.
    assert [tuple(r) for r in files.match_texts(table.drop("technique_name")).collect()][1] == ("T2", None, "")


def test_json_sources(spark, tmp_path):
    feed = [{"name": "g", "locations": [
        {"fqdn": "a.onion", "enabled": True, "updated": "2025-01-01 00:00:00", "extra": 1}, {"fqdn": "b.com", "enabled": False}]},
        {"name": "empty", "locations": []}]
    put(tmp_path, "feed.json", json.dumps(feed))
    got = [(r.name, r.ordinal, r.fqdn, r.enabled) for r in files.read_group_feed(spark, str(tmp_path / "feed.json")).collect()]
    assert got == [("g", 0, "a.onion", True), ("g", 1, "b.com", False)]
    put(tmp_path, "seeds.json", json.dumps([{"group": "g", "fqdn": "a.onion"}]))
    assert [tuple(r) for r in files.read_json_array(spark, str(tmp_path / "seeds.json"), schemas.SEED).collect()] == [("g", "a.onion")]


def test_news_store_appends(spark, tmp_path):
    news = spark.sql("SELECT 't' title, 'c' content, date'2025-06-03' date, 's' source, '' summary, "
                     "named_struct('id', 'T1', 'name', 'n', 'score', 0.5D) mitre_match "
                     "UNION ALL SELECT 'u', 'c', null, 's', '', null")
    for _ in range(2):
        sinks.append_news(news, str(tmp_path / "news"))
    back = spark.read.schema(schemas.NEWS).json(str(tmp_path / "news"))
    assert sorted((r.title, r.date, r.mitre_match and r.mitre_match.id) for r in back.collect()) == [
        ("t", "2025-06-03", "T1"), ("t", "2025-06-03", "T1"), ("u", "", None), ("u", "", None),
    ]


def test_search_documents(spark, tmp_path):
    put(tmp_path, "a/1/article.txt", "제목: T\nURL: http://u\n\n" + "x" * 400 + "\nend\n")
    put(tmp_path, "a/2/article.txt", "제목: \nURL: http://u\n\nbody")
    put(tmp_path, "a/3/article.txt", "제목: only")
    docs = sinks.search_documents(files.read_article_texts(spark, str(tmp_path)), "2025-06-03", "Site")
    (doc,) = docs.collect()
    assert (doc.title, doc.url, doc.published_at, doc.source, doc.tags) == ("T", "http://u", "2025-06-03", "Site", [])
    assert doc.content == "x" * 400 + "\nend" and doc.summary == "x" * 300
    sinks.write_search_documents(docs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().title == "T"


def test_retention(spark):
    df = spark.createDataFrame([("June 3, 2025",), ("2025-06-03",), ("2025-06-02",), ("Jun 03, 2025",), ("play_20250603_page2.html",), ("play_20250602_page2.html",), (None,)], "date string")
    assert sorted(r.date for r in sinks.retain(df, "2025-06-03").collect()) == [
        "2025-06-03", "Jun 03, 2025", "June 3, 2025", "play_20250603_page2.html",
    ]


def test_rendered_article_reads_back(spark, tmp_path):
    df = spark.createDataFrame([("T", "http://u", "b1\n\nb2", "2025-06-03", "s")], "t string, u string, b string, d string, s string")
    full = text.render_article(F.col("t"), F.col("u"), F.col("b"), F.col("d"), F.col("s"))
    short = text.render_article(F.col("t"), F.col("u"), F.col("b"))
    row = df.select(full.alias("full"), short.alias("short")).first()
    assert row.full == "제목: T\nURL: http://u\n날짜: 2025-06-03\n\n요약: s\n\n본문:\nb1\n\nb2"
    assert row.short == "제목: T\nURL: http://u\n\nb1\n\nb2"


def test_repeated_and_unreadable_headers(spark, tmp_path):
    put(tmp_path, "a.csv", "url,url,Group,group\nu1,u2,g1,g2\n")
    put(tmp_path, "b.csv", 'url,"broken\nu9,x\n')
    put(tmp_path, "c.csv", "url,group\nu3,g3\n")
    put(tmp_path, "d.csv", "")
    got = files.read_csv_folder(spark, str(tmp_path))
    assert sorted(tuple(r[c] for c in ("url", "url.1", "Group", "group.1")) for r in got.collect()) == [
        ("u1", "u2", "g1", "g2"), ("u3", None, "g3", None),
    ]


def test_keyed_table_grows_by_new_keys_only(spark, tmp_path):
    path, schema = str(tmp_path / "hosts"), "url string, a string, file string, ordinal int"
    base = spark.createDataFrame([("u1", "base"), (None, "base"), ("", "base"), ("null", "base")], "url string, a string")
    tables.create_keyed(base, "keyed_hosts", path, buckets=4)
    new = spark.createDataFrame(
        [("u1", "x", "f", 1), (None, "x", "f", 2), ("u2", "second", "f", 4), ("u2", "first", "f", 3), ("null", "x", "f", 5)], schema
    )
    before = {f.name for f in (tmp_path / "hosts").iterdir()}
    assert tables.merge_keyed(spark, "keyed_hosts", path, new.withColumn("more", F.lit(1)), buckets=4) == {"added_rows": 1}
    assert tables.merge_keyed(spark, "keyed_hosts", path, new.drop("a"), buckets=4) == {"added_rows": 0}
    # What the table had was not written again.
    assert before <= {f.name for f in (tmp_path / "hosts").iterdir()}
    got = {(r.url, r.a) for r in tables.read_keyed(spark, "keyed_hosts").collect()}
    assert got == {("u1", "base"), (None, "base"), ("", "base"), ("null", "base"), ("u2", "first")}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = tables.new_rows(spark.table("keyed_hosts"), new)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    base_side = plan[: plan.index("FileScan")].rsplit("Join", 1)[1].rsplit("+-", 2)
    assert "Bucketed: true" in plan and "Exchange" not in "".join(base_side[-2:])
    spark.sql("DROP TABLE keyed_hosts")


def test_days_are_replaced_and_read_alone(spark, tmp_path):
    path = str(tmp_path / "days")
    first = [("June 3, 2025", 1), ("2025-06-03", 2), ("2025-06-02", 3), ("no day", 4), (None, 5)]
    tables.write_days(spark.createDataFrame(first, "date string, n int"), path)
    tables.write_days(spark.createDataFrame([("Jun 03, 2025", 6)], "date string, n int"), path)
    assert [tuple(r) for r in tables.read_day(spark, path, "2025-06-03").collect()] == [("Jun 03, 2025", 6)]
    assert [r.n for r in tables.read_day(spark, path, "2025-06-02").collect()] == [3]
    assert tables.read_day(spark, path, "2024-01-01").count() == 0
    plan = tables.read_day(spark, path, "2025-06-03")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_day" in plan and "PushedFilters: []" in plan
    assert spark.read.parquet(path).count() == 4
