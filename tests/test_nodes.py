"""Elements of a page: where they start and stop, what ends them, and the choice among them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import nodes
from tidewatch.functions.nodes import PICKS, pick


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ('<div id=a class="x y">1<div>2</div>3<p>4<p>5</div>6', [("div", 0, 3, "1<div>2</div>3<p>4<p>5"), ("div", 1, 0, "2"), ("p", 1, 0, "4"), ("p", 1, 0, "5")]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", [
            ("ul", 0, 5, "<li>a<li>b<ul><li>c</ul><li>d"), ("li", 1, 0, "a"), ("li", 1, 2, "b<ul><li>c</ul>"), ("ul", 2, 1, "<li>c"), ("li", 3, 0, "c"), ("li", 1, 0, "d"),
        ]),
        ('<script>if (a<b) "</p><p>"</script><!-- <p> --><br><A HREF="x>y">é</A>', [("script", 0, 0, 'if (a<b) "</p><p>"'), ("br", 0, 0, ""), ("a", 0, 0, "é")]),
        ("<b><p>x</b>y</p>z", [("b", 0, 1, "<p>x</b>y</p>z"), ("p", 1, 0, "x</b>y")]),
        ("<table><tr><td>1<td>2<tr><td>3</table></div>", [
            ("table", 0, 5, "<tr><td>1<td>2<tr><td>3"), ("tr", 1, 2, "<td>1<td>2"), ("td", 2, 0, "1"), ("td", 2, 0, "2"), ("tr", 1, 1, "<td>3"), ("td", 2, 0, "3"),
        ]),
        ('a < b <c <a title="x> never closed', []),
        ("", []),
        (None, []),
    ],
)
def test_elements(page, expected):
    assert [(n[0], n[4], n[5], page[n[6] : n[7]]) for n in nodes._elements(page)] == expected


def test_attributes():
    ((tag, name, classes, attrs, *_),) = nodes._elements("""<IMG ID='i' class="a  b" src=x SRC="y" data-src='z"' checked>""")
    assert (tag, name, classes) == ("img", "i", ["a", "b"])
    assert dict(attrs) == {"id": "i", "class": "a  b", "src": "x", "data-src": 'z"', "checked": ""}


def test_long_pages_without_tags_are_quick():
    assert nodes._elements("<" * 300_000) == [] and nodes._elements('<a "' * 100_000) == []
    deep = nodes._elements("<div>" * 20_000)
    assert len(deep) == 20_000 and deep[0][5] == 19_999


PAGE = """<div class="card clear"><h3 class="t"><a href="/one" rel="bookmark">1</a></h3><span class="d"><a href="/x">x</a></span></div>
<div class="card"><div><h3 class="t"><b><a href="/two">2</a></b></h3></div></div><h3 class="t"><a href="/out">3</a></h3>"""


@pytest.mark.parametrize(
    ("picks", "expected"),
    [
        ((pick("a"),), ["1", "x", "2", "3"]),
        ((pick("a", inside=pick("h3", "t")),), ["1", "2", "3"]),
        ((pick("a", inside=pick("h3", "t"), child=True),), ["1", "3"]),
        ((pick("a", inside=pick("h3"), around=pick("div", "card")),), ["1", "2"]),
        ((pick("a", inside=pick("", "clear")),), ["1", "x"]),
        ((pick("a", attr="rel", value="bookmark", exact=True), pick("a", attr="href", value="/o")), ["1", "3"]),
        ((pick("a", attr="rel", value="book", exact=True),), []),
        ((), []),
    ],
)
def test_choice(spark, picks, expected):
    frame = spark.createDataFrame([(PAGE, list(picks))], f"html string, picks {PICKS}")
    found = nodes.chosen(F.col("nodes"), F.col("picks"))
    row = frame.withColumn("nodes", nodes.elements(F.col("html"))).select(F.transform(found, lambda n: nodes.content(F.col("html"), n))).first()
    assert row[0] == expected
