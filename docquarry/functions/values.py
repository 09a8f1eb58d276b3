"""Tagged values: what of them is searched, and how they are shown; and rewriting of URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import xml_escape

#: The tags that a value may have.
EXPANDED, UNEXPANDED, UNINDEXED, IMAGE, LINK = "ExpandedURL", "UnExpandedURL", "UnIndexedURL", "ImageURL", "InternalLink"


def tagged(flag: str, text: Column) -> Column:
    return F.struct(F.lit(flag).alias("flag"), text.alias("text"))


def searchable(value: Column, fetched: Column) -> Column:
    """The text to search: that behind a URL (``fetched``, from a join), nothing, or the value itself."""
    return F.when(value["flag"].isin(EXPANDED, UNEXPANDED), fetched).when(value["flag"].isin(UNINDEXED, IMAGE, LINK), F.lit("")).otherwise(value["text"])


def shown(value: Column, fetched: Column, link=None) -> Column:
    """The value as HTML; ``link`` makes an internal link's HTML from its escaped text."""
    text = xml_escape(value["text"])
    anchor = F.concat(F.lit('<a href="'), text, F.lit('">'), text, F.lit("</a>"))
    inner = link(text) if link else F.concat(F.lit("<b> INTERNAL LINK TO "), text, F.lit(" </b>"))
    return (
        F.when(value["flag"] == EXPANDED, xml_escape(fetched))
        .when(value["flag"].isin(UNEXPANDED, UNINDEXED), anchor)
        .when(value["flag"] == IMAGE, F.concat(F.lit('<img src="'), text, F.lit('">')))
        .when(value["flag"] == LINK, inner)
        .otherwise(text)
    )


def in_xml(value: Column, field: str) -> Column:
    """The value as a field of an entry's XML, with its flag."""
    return F.concat(F.lit(f'<fld n="{field}" special="'), value["flag"], F.lit('">'), xml_escape(value["text"]), F.lit("</fld>"))


def link_target(value: Column) -> Column:
    """Where an internal link, written ATTRIBUTE::IDENTITY, leads: struct<attr, id>; null for other values."""
    at = F.instr(value["text"], "::")
    text = value["text"]
    target = F.struct(F.when(at > 0, F.substring(text, 1, at - 1)).alias("attr"), F.when(at > 0, F.substring(text, at + 2, F.length(text))).otherwise(text).alias("id"))
    return F.when(value["flag"] == LINK, target)


def fetched(df: DataFrame, url: str, pages: DataFrame, prefixes: dict[str, str] | None = None, content: str = "html", name: str = "fetched", also: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with what is behind its URLs: a left join with stored pages (url, content; one row a URL) by the URL,
    rewritten first. Addresses without a page, and values without an address, get null.

    Of an address that is stored several times (a page of each crawl), columns that both have in common, ``also``, say
    which one is meant: there is one row for each URL and their values, of which null is one."""
    own = pages.select(F.col("url").alias("__url"), F.col(content).alias(name), *(F.col(c).alias(f"__{c}") for c in also))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in also), rewritten(F.col(url), prefixes or {}) == F.col("__url"))
    return df.join(own, same, "left").drop("__url", *(f"__{c}" for c in also))


def rewritten(url: Column, prefixes: dict[str, str]) -> Column:
    """The URL with its longest known prefix replaced."""
    longest_first = sorted(prefixes.items(), key=lambda p: (-len(p[0]), p[0]))
    case = lambda out, p: F.when(F.startswith(url, F.lit(p[0])), F.concat(F.lit(p[1]), F.substring(url, len(p[0]) + 1, 1 << 30))).otherwise(out)
    return reduce(case, reversed(longest_first), url)
