"""A page as its elements, numbered once, and the choice of elements by what they are and where they stand.

An element knows where its content starts and stops, so one stands inside another exactly if its interval does, and
the elements inside it are the next ``size`` ones. What is looked for is data too (``PICK``), so one expression
serves every kind of page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import batches

# ``start`` to ``stop`` is the content, in code points from the page's start; ``size`` counts the elements inside.
NODE = (
    "struct<tag:string,id:string,classes:array<string>,attrs:map<string,string>,"
    "depth:int,size:int,start:int,stop:int>"
)
_NODE = pa.struct(
    [
        ("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())),
        ("attrs", pa.map_(pa.string(), pa.string())), ("depth", pa.int32()), ("size", pa.int32()),
        ("start", pa.int32()), ("stop", pa.int32()),
    ]
)
# An element that is looked for: empty texts stand for anything; an attribute holds ``value`` or, if ``exact``, is it.
STEP = "struct<tag:string,id:string,classes:array<string>,attr:string,value:string,exact:boolean>"
# One that stands inside another, or right below it, and has a third anywhere above it.
PICK = f"struct<step:{STEP},outer:{STEP},child:boolean,around:{STEP}>"
PICKS = f"array<{PICK}>"

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Elements without content, those whose content is no markup, and those that a block's start ends (fixed values).
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title".split())
_BLOCK = frozenset(
    "address article aside blockquote body div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header html main nav "
    "ol p pre section table ul".split()
)
# A start that ends an open element of these names, unless one of the others stands between (fixed values).
_ENDS = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}


def _elements(page: str | None) -> list[tuple]:
    """Elements of a page in the order of their starts; open ones end with their parent."""
    found: list[list] = []
    opened: list[int] = []
    # How many of each name are open, so that ends without a start cost nothing.
    names_open: Counter = Counter()
    page = page or ""

    def close(to: int, at: int) -> None:
        while len(opened) > to:
            node = found[opened.pop()]
            names_open[node[0]] -= 1
            node[5], node[7] = len(found) - 1 - node[8], at

    def last(names, before) -> int:
        if not any(names_open[n] for n in names):
            return -1
        for k in reversed(range(len(opened))):
            if found[opened[k]][0] in names:
                return k
            if found[opened[k]][0] in before:
                return -1
        return -1

    # Nothing is a tag after the last sign that can end one.
    at, end_of_tags = 0, page.rfind(">") + 1
    while token := _TOKEN.search(page, at, end_of_tags):
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        if token[1]:
            # The end of a phrase does not end a block that began inside it.
            k = last((name,), () if name in _BLOCK or name in _ENDS else _BLOCK)
            if k >= 0:
                close(k, token.start())
            continue
        if name in _BLOCK and (k := last(("p",), ("table", "td"))) >= 0:
            close(k, token.start())
        if name in _ENDS and (k := last(*_ENDS[name])) >= 0:
            close(k, token.start())
        attrs = {a.lower(): b or c or d for a, b, c, d in reversed(_ATTRIBUTE.findall(token[3]))}
        node = [
            name, attrs.get("id", ""), attrs.get("class", "").split(), list(attrs.items()), len(opened), 0, at, at, len(found)
        ]
        found.append(node)
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            node[7], at = (end.start(), end.end()) if end else (len(page), len(page))
        elif name not in _VOID:
            opened.append(len(found) - 1)
            names_open[name] += 1
    close(0, len(page))
    return [tuple(n[:8]) for n in found]


def elements(page: Column) -> Column:
    """``array<NODE>`` of a page; a null page has none."""
    names = [f.name for f in _NODE]

    def work(pages: list[str | None]) -> list[list[dict]]:
        return [[dict(zip(names, n)) for n in _elements(p)] for p in pages]

    return batches.by_parts(lambda: work, f"array<{NODE}>", pa.list_(_NODE), page)


def _is(node: Column, step: Column) -> Column:
    value = F.coalesce(F.try_element_at(node["attrs"], step["attr"]), F.lit(""))
    return (
        ((step["tag"] == "") | (node["tag"] == step["tag"]))
        & ((step["id"] == "") | (node["id"] == step["id"]))
        & F.forall(step["classes"], lambda c: F.array_contains(node["classes"], c))
        & (
            (step["attr"] == "")
            | F.when(step["exact"], value == step["value"]).otherwise(F.contains(value, step["value"]))
        )
    )


def chosen(nodes: Column, picks: Column) -> Column:
    """The elements among ``nodes`` that any of the picks describes, in order."""

    def described(node: Column, pick: Column) -> Column:
        def above(outer: Column) -> Column:
            inside = (outer["start"] <= node["start"]) & (node["stop"] <= outer["stop"])
            return (outer["depth"] < node["depth"]) & inside

        near = F.when(pick["child"], node["depth"] - 1)
        return (
            _is(node, pick["step"])
            & (
                pick["outer"].isNull()
                | F.exists(nodes, lambda o: above(o) & (o["depth"] == F.coalesce(near, o["depth"])) & _is(o, pick["outer"]))
            )
            & (pick["around"].isNull() | F.exists(nodes, lambda o: above(o) & _is(o, pick["around"])))
        )

    return F.filter(nodes, lambda node: F.exists(picks, lambda pick: described(node, pick)))


def inside(nodes: Column, node: Column) -> Column:
    """The elements inside one of a page's elements: a slice, found by where they begin and end."""
    return F.filter(nodes, lambda n: (node["depth"] < n["depth"]) & (node["start"] <= n["start"]) & (n["stop"] <= node["stop"]))


def with_value(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` worked out and planned once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def content(page: Column, node: Column) -> Column:
    """The markup inside an element; null for none."""
    return with_value(node, lambda n: F.substring(page, n["start"] + 1, n["stop"] - n["start"]))


def first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def pick(
    tag: str = "",
    *classes: str,
    id: str = "",
    attr: str = "",
    value: str = "",
    exact: bool = False,
    inside: tuple | None = None,
    child: bool = False,
    around: tuple | None = None,
) -> tuple:
    """A row of ``PICK``: an element of a tag and classes, perhaps inside another pick's element, or right below it."""
    step = (tag, id, list(classes), attr, value, exact)
    return (step, inside[0] if inside else None, child, around[0] if around else None)


def named(picks: tuple) -> list[dict]:
    """Picks with their fields' names, as JSON has them."""

    def step(of: tuple | None) -> dict | None:
        return of and dict(zip(("tag", "id", "classes", "attr", "value", "exact"), of, strict=True))

    return [
        {"step": step(of), "outer": step(outer), "child": child, "around": step(around)}
        for of, outer, child, around in picks
    ]
