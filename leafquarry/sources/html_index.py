"""Rows from index pages of several layouts, and links of scanned documents (S04, S11-S18), as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafquarry.functions import dates, refs
from leafquarry.functions.text import collapse, unescaped

LINK = r"""(?is)<a\b[^>]*href=["']?([^"'\s>]+)[^>]*>(.*?)</a\s*>"""
# Fixed value: the endings of images.
IMAGE = r"(?i)\.(?:gif|jpe?g|png|tiff?|bmp)$"


def plain(c: Column) -> Column:
    """A fragment's text."""
    return collapse(unescaped(F.regexp_replace(c, "<[^>]+>", " ")))


def absolute(base: Column, href: Column) -> Column:
    """An address within a page as a full one."""
    root, folder = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1), F.regexp_extract(base, r"^([^?#]*/)", 1)
    return (
        F.when(href.rlike(r"^[a-zA-Z][\w+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(folder, F.regexp_replace(href, r"^\./", "")))
    )


def index_urls(base: Column, year: Column) -> Column:
    """Addresses that may hold a year's index, without repeats."""
    y, short = year.cast("string"), F.substring(year.cast("string"), 3, 2)

    def at(tail: Column, extension: str) -> Column:
        return F.concat(base, F.lit("/"), y, F.lit("/indcir"), tail, F.lit(extension))

    usual = F.array(at(y, ".htm"), at(y, ".html"))
    return F.array_distinct(F.when(year < 2000, F.concat(usual, F.array(at(short, ".htm"), at(short, ".html")))).otherwise(usual))


def links(page: Column, base: Column) -> Column:
    """address, text of each link."""
    hrefs, texts = F.regexp_extract_all(page, F.lit(LINK), 1), F.regexp_extract_all(page, F.lit(LINK), 2)
    return F.zip_with(hrefs, texts, lambda h, t: F.struct(h.alias("href"), absolute(base, h).alias("url"), plain(t).alias("text")))


def _item(number: Column, title: Column, text: Column, day: Column, url: Column) -> Column:
    pdf = url.rlike(r"(?i)\.pdf(?:$|\?)")
    return F.struct(
        number.alias("numero"), title.alias("titulo"), text.alias("descripcion"), day.alias("fecha"), F.when(pdf, url).alias("url_pdf"), F.when(~pdf, url).alias("url_detalle")
    )


def modern_index(page: Column, base: Column, year: Column) -> Column:
    """A heading with a link, described by the paragraph after it."""
    block = r"(?is)<h5\b[^>]*>(.*?)</h5\s*>(?:\s*<p\b[^>]*>(.*?)</p\s*>)?"
    heads, texts = F.regexp_extract_all(page, F.lit(block), 1), F.regexp_extract_all(page, F.lit(block), 2)

    def row(h: Column, t: Column) -> Column:
        href, title = F.regexp_extract(h, LINK, 1), plain(F.regexp_extract(h, LINK, 2))
        return _item(refs.circular_number(title, href), title, plain(t), dates.circular_date(plain(h), year), F.when(href != "", absolute(base, href)))

    return F.filter(F.zip_with(heads, texts, row), lambda x: x["numero"].isNotNull())


def legacy_index(page: Column, base: Column, year: Column) -> Column:
    """Links whose text names a circular, described by what follows up to the next link."""
    block = r"""(?is)<a\b[^>]*href=["']?([^"'\s>]+)[^>]*>(.*?)</a\s*>(.*?)(?=<a\b|$)"""
    hrefs, titles, after = (F.regexp_extract_all(page, F.lit(block), k) for k in (1, 2, 3))
    rows = F.transform(
        F.arrays_zip(hrefs.alias("h"), titles.alias("t"), after.alias("a")),
        lambda x: _item(refs.circular_number(plain(x["t"]), x["h"]), plain(x["t"]), F.substring(plain(x["a"]), 1, 1000), dates.circular_date(plain(x["t"]), year), absolute(base, x["h"])),
    )
    return F.filter(rows, lambda x: x["titulo"].rlike(r"(?i)circular\s*n(?:\D{0,2})\s*\d+") & x["numero"].isNotNull())


def index_rows(page: Column, base: Column, year: Column) -> Column:
    """By the year's usual layout; by the other one if that finds nothing."""
    old, new = legacy_index(page, base, year), modern_index(page, base, year)
    first, second = F.when(year <= 2012, old).otherwise(new), F.when(year <= 2012, new).otherwise(old)
    return F.when(F.size(first) > 0, first).otherwise(second)


def resolution_numbers(page: Column) -> Column:
    """S14."""
    return F.regexp_extract_all(page, F.lit(r"(?i)href=[\"']?[^\"'\s>]*reso(\d+)\.pdf"), 1)


def detail_pdf(page: Column, base: Column) -> Column:
    """A page's PDF: by a tag's attribute, else any quoted address."""
    tag = F.regexp_extract(page, r"""(?is)<(?:a|iframe|embed|object)\b[^>]*(?:href|src|data)=["']?([^"'\s>]+\.pdf(?:\?[^"'\s>]*)?)["'\s>]""", 1)
    any_ = F.regexp_extract(page, r"""(?i)["']([^"']+\.pdf(?:\?[^"']*)?)["']""", 1)
    found = F.coalesce(F.nullif(tag, F.lit("")), F.nullif(any_, F.lit("")))
    return F.when(found.isNotNull(), absolute(base, found))


def stem(url: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1), r"\.[^.]*$", "")


def root_of(base: Column) -> Column:
    """A name up to its last digits, without the page's letter."""
    return F.coalesce(F.nullif(F.regexp_extract(base, r"(?i)^(.*?\d+)[a-z]?$", 1), F.lit("")), base)


def prefixes(base: Column) -> Column:
    """The names under which a document's pages may stand."""
    root = F.lower(root_of(base))
    bare, number = F.regexp_replace(root, "^circu0*", ""), F.regexp_replace(root, "^circu", "")
    short = F.coalesce(F.nullif(F.ltrim(number, F.lit("0")), F.lit("")), number)
    return F.array_sort(F.array_distinct(F.filter(F.array(root, bare, F.coalesce(F.nullif(F.ltrim(bare, F.lit("0")), F.lit("")), bare), number, short), lambda x: x != "")))


def scanned_pages(page: Column, url: Column) -> Column:
    """The page itself and those linked pages that go by one of its names, the plain name first."""
    own, root = prefixes(stem(url)), F.lower(root_of(stem(url)))
    found = F.filter(F.transform(links(page, url), lambda x: x["url"]), lambda u: F.lower(u).rlike(r"\.html?(?:[?#].*)?$") & F.exists(own, lambda p: F.rlike(F.lower(stem(u)), F.concat(F.lit(r"^\Q"), p, F.lit(r"\E[a-z]?$")))))
    suffix = F.transform(
        F.array_distinct(F.concat(F.array(url), found)),
        lambda u: F.struct(F.when(F.lower(stem(u)).startswith(root), F.substr(F.lower(stem(u)), F.length(root) + 1)).otherwise("").alias("k"), u.alias("u")),
    )
    return F.transform(F.array_sort(suffix), lambda x: x["u"])


def page_images(page: Column, url: Column) -> Column:
    """A page's images that go by its names, else those of 120 pixels and more."""
    tags = F.regexp_extract_all(page, F.lit(r"(?is)(<img\b[^>]*>)"), 1)

    def size(t: Column, name: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(t, rf"(?i)\b{name}=[\"']?(\d+)", 1), F.lit("")).cast("int"), F.lit(0))

    rows = F.filter(
        F.transform(tags, lambda t: F.struct(absolute(url, F.regexp_extract(t, r"""(?i)\bsrc=["']?([^"'\s>]+)""", 1)).alias("u"), ((size(t, "width") >= 120) | (size(t, "height") >= 120)).alias("big"))),
        lambda x: F.regexp_replace(x["u"], r"[?#].*$", "").rlike(IMAGE),
    )
    own = prefixes(stem(url))
    named = F.array_distinct(F.transform(F.filter(rows, lambda x: F.exists(own, lambda p: F.lower(stem(x["u"])).startswith(p))), lambda x: x["u"]))
    return F.when(F.size(named) > 0, named).otherwise(F.array_distinct(F.transform(F.filter(rows, lambda x: x["big"]), lambda x: x["u"])))


def looks_like_scan_page(page: Column, url: Column, text: Column) -> Column:
    """P17 for raw pages: images of the document and little text."""
    t = collapse(text)
    few = (F.length(t) < 1800) | (F.size(F.regexp_extract_all(t, F.lit("[A-Za-z0-9]{4,}"), 0)) < 180)
    return (F.size(page_images(page, url)) > 0) & few
