"""Entries of directory listings that web servers make as HTML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How servers write an entry, and one that is a directory; group 1 is its name.
STYLES = {
    "iis": (r"(?:&lt;dir&gt;|\d)[^<]*<A HREF=\"[^\"]*\">([^<\[]+)</A>", r"&lt;dir&gt;[^<]*<A HREF=\"[^\"]*\">([^<\[]+)</A>"),
    "apache": (r"alt=\"\[(?: *|DIR|[A-Z0-9]{3})\]\"[^\n]*?<a href=\"[^\"]*\">([^<]+)</a>", r"alt=\"\[DIR\]\"[^\n]*?<a href=\"[^\"]*\">([^<]+)</a>"),
    "python": (r"<li><a href=\"[^\"]+\">([^<]+)</a>", r"<li><a href=\"[^\"]+/\">([^<]+)/</a>"),
}


def entries(html: Column, style: str, directories: bool = False) -> Column:
    """Names in a listing of one style."""
    return F.regexp_extract_all(html, F.lit(STYLES[style][directories]), 1)


def any_entries(html: Column, directories: bool = False, styles: Sequence[str] = ("iis", "apache", "python")) -> Column:
    """Names by the first style that finds more than one, else by the last of the styles."""
    out = entries(html, styles[-1], directories)
    for style in reversed(styles[:-1]):
        found = entries(html, style, directories)
        out = F.when(F.size(found) > 1, found).otherwise(out)
    return out


def typed_entries(html: Column, style: str) -> Column:
    """Names in a listing of one style, each with whether its own entry is that of a directory: one pass, however
    long the listing. Of a directory's name the closing slash is left out."""
    entry, directory = STYLES[style]
    name = lambda found: F.regexp_replace(F.regexp_extract(found, entry, 1), "/$", "")
    return F.transform(F.regexp_extract_all(html, F.lit(entry), 0), lambda found: F.struct(name(found).alias("entry"), found.rlike(directory).alias("is_group")))
