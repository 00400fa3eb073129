"""Date parsing and formatting of the sites' several notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Notations of an article directory (fixed values).
DIRECTORY_FORMATS = ("MMMM d, yyyy", "yyyy-M-d")
# Notations of the sites' displayed dates (fixed values).
DISPLAY_FORMATS = ("MMM dd, yyyy", "MMMM dd, yyyy", "MMMM d, yyyy", "MMM d, yyyy")


def parse_date(text: Column, formats: tuple[str, ...] = DIRECTORY_FORMATS) -> Column:
    """First format that reads the text; null when none does."""
    trimmed = F.trim(text)
    return F.coalesce(*[F.try_to_date(trimmed, fmt) for fmt in formats])


def display_date(text: Column) -> Column:
    return parse_date(text, DISPLAY_FORMATS)


def stored_day(text: Column) -> Column:
    """Day of a folder in any notation, or of a saved page named ``group_yyyymmdd_pageN.html``."""
    in_name = F.regexp_extract(text, r"_(\d{8})_page\d+\.html$", 1)
    folder = parse_date(text, DIRECTORY_FORMATS + DISPLAY_FORMATS)
    return F.coalesce(folder, F.try_to_date(in_name, "yyyyMMdd"))


def korean_date(text: Column) -> Column:
    """Year, month and day marks, blanks allowed between them, to a date."""
    pattern = r"(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일"
    found = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
    return F.try_to_date(F.concat_ws("-", *found), "yyyy-M-d")


def date_text(date: Column) -> Column:
    """``yyyy-MM-dd``, or an empty text for a missing date."""
    return F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit(""))
