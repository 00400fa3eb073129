"""Column functions over page and article text.

Everything here is a Catalyst expression; the one Python function is the exact
fallback for dotted runs too long for the JVM regex engine's stack.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Named character references of code points 160-255, in code point order (fixed values).
LATIN_ENTITIES = (
    "nbsp iexcl cent pound curren yen brvbar sect uml copy ordf laquo not shy reg macr "
    "deg plusmn sup2 sup3 acute micro para middot cedil sup1 ordm raquo frac14 frac12 "
    "frac34 iquest Agrave Aacute Acirc Atilde Auml Aring AElig Ccedil Egrave Eacute "
    "Ecirc Euml Igrave Iacute Icirc Iuml ETH Ntilde Ograve Oacute Ocirc Otilde Ouml "
    "times Oslash Ugrave Uacute Ucirc Uuml Yacute THORN szlig agrave aacute acirc "
    "atilde auml aring aelig ccedil egrave eacute ecirc euml igrave iacute icirc iuml "
    "eth ntilde ograve oacute ocirc otilde ouml divide oslash ugrave uacute ucirc uuml "
    "yacute thorn yuml"
).split()

# Further named character references (fixed values).
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'",
    "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "bull": "•", "euro": "€", "trade": "™",
    **{name: chr(160 + i) for i, name in enumerate(LATIN_ENTITIES)},
}

# The URL-like token pattern (fixed value).
URL_PATTERN = (
    r"\b(?:https?://|s?ftps?://)?(?:www\.)?"
    r"(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+"
    r"[a-zA-Z]{2,24}(?:[/?#]\S*)?\b"
)

# Java's regex engine recurses once per dotted label; beyond this many labels in
# one run the text goes to Python's engine, which does not.
SAFE_LABELS = 100
_LONG_RUN = r"(?iU)(?<![a-zA-Z0-9-])(?:[a-zA-Z0-9-]++\.){%d}+" % SAFE_LABELS

# White space that counts as blank at the ends of a text (fixed value).
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

_COMMENT = r"(?s)<!--.*?-->"
_SCRIPT = r"(?is)<script\b[^>]*>.*?</script\s*>"
_STYLE = r"(?is)<style\b[^>]*>.*?</style\s*>"
_TAG = r"""</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[!?][^>]*>"""


def unescape(text: Column) -> Column:
    """Resolve character references in one left-to-right pass (``&amp;lt;`` gives ``&lt;``)."""
    names = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")

    def resolve(part: Column) -> Column:
        name = F.regexp_extract(
            part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});", 1
        )
        code = F.when(
            name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10).cast("long")
        ).otherwise(F.substring(name, 2, 7).try_cast("long"))
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.when(
            name.startswith("#"),
            F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")),
        ).when(name != "", F.try_element_at(names, name))
        rest = F.substr(part, F.length(name) + F.lit(2))
        return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), part))

    # One reference to ``text``, which may be a costly expression.
    pieces = F.transform(
        F.split(text, "&"), lambda part, i: F.when(i == 0, part).otherwise(resolve(part))
    )
    return F.array_join(pieces, "")


def strip_tags(html: Column) -> Column:
    """Markup to blanks, without resolving character references."""
    text = html
    for pattern in (_COMMENT, _SCRIPT, _STYLE, _TAG):
        text = F.regexp_replace(text, pattern, " ")
    return text


def visible_text(html: Column) -> Column:
    """Text nodes of a page joined by a blank; attributes, script, style and comments are not text."""
    return unescape(strip_tags(html))


def inner_text(html: Column) -> Column:
    """Visible text of a fragment with blanks squeezed and trimmed."""
    return F.trim(F.regexp_replace(visible_text(html), r"(?U)\s+", " "))


_BLOCK_EDGES = r"(?i)(?:\s*</?(?:p|div|li|ul|ol|tr|table|blockquote|section|article|h[1-6])(?=[\s>/])[^>]*>\s*)++"
_LINE_BREAK = r"(?i)\s*<br\s*/?>\s*"


def block_text(html: Column) -> Column:
    """Visible text of a fragment with a line end before and after each block, as a browser shows it."""
    flat = F.regexp_replace(html, r"\s+", " ")
    edged = F.regexp_replace(F.regexp_replace(flat, _BLOCK_EDGES, "\n"), _LINE_BREAK, "\n")
    lines = visible_text(edged)
    tidy = F.regexp_replace(F.regexp_replace(lines, r"[ \xa0]+", " "), r" ?\n ?", "\n")
    return trim_blank(F.regexp_replace(tidy, r"\n{3,}", "\n\n"))


def trim_blank(text: Column) -> Column:
    """Strip white space, line breaks included, from both ends."""
    return F.trim(text, F.lit(BLANKS))


@F.pandas_udf(T.ArrayType(T.StringType()))
def python_urls(text: pd.Series) -> pd.Series:
    """URL-like tokens by Python's regex engine; null stays null."""
    pattern = re.compile(URL_PATTERN, re.IGNORECASE)
    return text.map(lambda t: None if t is None else pattern.findall(t))


def has_long_run(text: Column) -> Column:
    return text.rlike(_LONG_RUN)


def jvm_urls(text: Column, long_run: Column) -> Column:
    """All URL-like tokens of ``text``, bare domains included, in order; null if ``long_run``."""
    found = F.regexp_extract_all(text, F.lit("(?iU)" + URL_PATTERN), F.lit(0))
    return F.when(~long_run, found)


def url_tokens(text: Column) -> Column:
    """URL-like tokens of any text: only one with an over-long dotted run travels to Python."""
    long_run = has_long_run(text)
    return F.coalesce(jvm_urls(text, long_run), python_urls(F.when(long_run, text)))


def element(html: Column, start: str, tag: str) -> Column:
    """Content of the first ``tag`` element whose start tag matches ``start``; null if there is none.

    The element ends where its own end tag stands, found by counting the tags of its
    name inside; without one it reaches to the end.
    """
    after = F.try_element_at(F.split(html, start, 2), F.lit(2))
    own = rf"(?is)</?{tag}(?=[\s>/])[^>]*>"
    cut = F.struct(
        F.split(after, own, -1).alias("between"),
        F.regexp_extract_all(after, F.lit(own), F.lit(0)).alias("tags"),
    )

    def inside(found: Column) -> Column:
        count = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("tags"))

        def step(state: Column, tag_: Column) -> Column:
            depth = state["depth"] + F.when(tag_.startswith("</"), -1).otherwise(1)
            on = F.struct(depth.alias("depth"), (state["tags"] + 1).alias("tags"))
            return F.when(state["depth"] == 0, state).otherwise(on)

        end = F.aggregate(found["tags"], count, step)
        # Of n tags the last is the element's own end; without one all belong to it.
        kept = F.when(end["depth"] == 0, end["tags"] - 1).otherwise(end["tags"])
        return F.transform(
            F.array(kept),
            lambda n: F.array_join(
                F.zip_with(
                    F.slice(found["between"], F.lit(1), n + 1),
                    F.slice(found["tags"], F.lit(1), n),
                    lambda text, t: F.concat(text, F.coalesce(t, F.lit(""))),
                ),
                "",
            ),
        )[0]

    # The one-element array binds the pieces, so the page is cut once.
    return F.when(after.isNotNull(), F.transform(F.array(cut), inside)[0])


def keep_url(url: Column) -> Column:
    """A dot, seven characters or more, and no onion address."""
    return F.contains(url, F.lit(".")) & (F.length(url) >= 7) & ~F.contains(url, F.lit(".onion"))


def domain_of(url: Column) -> Column:
    """Host part: every http(s) scheme and a leading ``www.`` dropped, cut at ``/`` then ``:``."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?i)https?://", ""), r"(?i)^www\.", "")
    host = F.substring_index(F.trim(bare), "/", 1)
    return F.substring_index(host, ":", 1)


def slug(text: Column) -> Column:
    """ASCII letters and digits kept, the rest ``_``, lower case."""
    return F.lower(F.regexp_replace(text, r"[^a-zA-Z0-9]", "_"))


def slug_hangul(text: Column, limit: int = 80) -> Column:
    """Variant that keeps Hangul and case, squeezes ``_`` and cuts at ``limit`` characters."""
    safe = F.regexp_replace(text, r"[^a-zA-Z0-9가-힣]", "_")
    return F.substring(F.regexp_replace(safe, r"_+", "_"), 1, limit)


def slug_file(text: Column) -> Column:
    """Variant for file names: word characters, ``-`` and ``.`` kept, case kept."""
    return F.regexp_replace(text, r"(?U)[^\w\-.]", "_")


def group_name(group: Column) -> Column:
    """Trimmed, lower-case file-safe group name; blank gives ``unknown_group``."""
    name = F.lower(F.trim(F.coalesce(group, F.lit(""))))
    return slug_file(F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown_group")))


def last_segment(url: Column) -> Column:
    """Last non-empty path segment of a listing address, else ``main``."""
    segments = F.filter(F.split(url, "/"), lambda s: s != "")
    return F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit("main"))


def is_blank(text: Column) -> Column:
    return text.isNull() | (trim_blank(text) == "")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


# Labels of an article file (fixed values).
TITLE_LABEL = "제목: "
URL_LABEL = "URL: "
DATE_LABEL = "날짜: "
SUMMARY_LABEL = "요약: "
BODY_LABEL = "본문:"


def article_lines(text: Column) -> Column:
    return F.split(trim_blank(text), r"\r\n|\r|\n")


def first_with(lines: Column, label: str) -> Column:
    """The first line that starts with ``label``, as a list of one or none."""
    return F.slice(F.filter(lines, lambda x: x.startswith(label)), 1, 1)


def render_article(
    title: Column,
    url: Column,
    body: Column,
    date: Column | None = None,
    summary: Column | None = None,
) -> Column:
    """Labelled article text; the date and summary lines appear only when the site has them."""
    head = [F.concat(F.lit(TITLE_LABEL), title), F.concat(F.lit(URL_LABEL), url)]
    if date is not None:
        head.append(F.concat(F.lit(DATE_LABEL), date))
    parts = [F.concat_ws("\n", *head)]
    if summary is not None:
        parts.append(F.concat(F.lit(SUMMARY_LABEL), summary))
    parts.append(body if date is None else F.concat(F.lit(BODY_LABEL + "\n"), body))
    return F.concat_ws("\n\n", *parts)
