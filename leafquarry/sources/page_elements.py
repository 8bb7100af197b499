"""Links, headings and images of pages by one walk over their tags (S11-S18), as a table function for lateral joins.

A page without end tags, with attributes that hold ">", with nested tables or comments is read as a browser's simplest tree would
have it: an end tag closes what stands open above its start tag and is ignored where there is none; void tags hold nothing; scripts,
styles and templates aren't text. The walk takes time in proportion to the page; what a row says of its surroundings is cut
where the rows of an index cut it, except the whole text around a link to a resolution.

Defined cases: null and empty pages have no rows; a repeated attribute counts once, the last one; attributes without a value are
empty; unclosed elements end with the page.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafquarry.functions import dates, refs
from leafquarry.functions.text import collapse
from leafquarry.sources.html_index import absolute

VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
SILENT = frozenset(("script", "style", "template"))
SILENCE = {tag: re.compile(rf"</{tag}\b[^>]*+>?", re.IGNORECASE) for tag in SILENT}
TOLD = frozenset(("a", "h5", "img", "iframe", "embed", "object"))
BLOCKS, LIST_BLOCKS = frozenset(("p", "li", "td", "div")), frozenset(("li", "p", "td", "h5"))
#: Characters after which no further sibling is read; of a description.
ENOUGH, DESCRIPTION = 600, 1000
ROW = (
    "n int, tag string, href string, src string, data string, width string, height string, text string, first_href string, first_text string, paragraph string, after string,"
    " block string, item string"
)


class Element:
    """heading, block, item: the nearest element above that is one."""

    __slots__ = ("tag", "attrs", "parent", "place", "children", "start", "end", "heading", "block", "item", "link")

    def __init__(self, tag: str, attrs: dict, parent: Element | None, start: int):
        self.tag, self.attrs, self.parent, self.start, self.end = tag, attrs, parent, start, start
        self.children: list[Element | int] = []  # elements, and places of text
        self.place = len(parent.children) if parent else 0
        self.link: Element | None = None  # the first within
        if parent is None:
            self.heading = self.block = self.item = None
        else:
            self.heading = parent if parent.tag == "h5" else parent.heading
            self.block = parent if parent.tag in BLOCKS else parent.block
            self.item = parent if parent.tag in LIST_BLOCKS else parent.item


#: A comment, a declaration, an end tag, a start tag with its attributes (the second form where quotes don't match).
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</(?P<end>[a-z][^\s/>]*+)[^>]*+>"
    r"|<(?P<tag>[a-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<tag2>[a-z][^\s/>]*+)(?P<rest2>[^>]*+)>",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>][^\s=/>]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")


class Tree:
    """The elements in page order, and the page's texts; an element has the texts from its start to its end."""

    def __init__(self, page: str):
        self.root = Element("", {}, None, 0)
        self.open, self.count, self.elements, self.texts, self.said = [self.root], {}, [], [], []
        last, upto = 0, page.rfind(">") + 1  # no tag ends after that
        while m := TOKEN.search(page, last, upto):
            self.said.append(page[last : m.start()])
            last = m.end()
            self._text()
            if m["end"]:
                self._close(m["end"].lower())
            elif tag := (m["tag"] or m["tag2"] or "").lower():
                rest = m["rest"] or m["rest2"] or ""
                self._start(tag, rest)
                if rest.endswith("/"):
                    self._close(tag)
                elif tag in SILENT:
                    silent = SILENCE[tag].search(page, last)
                    last = silent.end() if silent else len(page)
                    self._close(tag)
        self.said.append(page[last:])
        self._text()
        while len(self.open) > 1:
            self._pop()
        self.root.end = len(self.texts)

    def _text(self) -> None:
        said = "".join(self.said)
        if said:
            self.open[-1].children.append(len(self.texts))
            self.texts.append(unescape(said))
        self.said = []

    def _pop(self) -> str:
        e = self.open.pop()
        e.end = len(self.texts)
        self.count[e.tag] -= 1
        return e.tag

    def _start(self, tag: str, rest: str) -> None:
        attrs = {}
        if tag in TOLD:
            attrs = {k.lower(): unescape(x or y or z) for k, x, y, z in ATTRIBUTE.findall(rest)}
        e = Element(tag, attrs, self.open[-1], len(self.texts))
        e.parent.children.append(e)
        self.elements.append(e)
        if tag not in VOID:
            self.open.append(e)
            self.count[tag] = self.count.get(tag, 0) + 1

    def _close(self, tag: str) -> None:
        if self.count.get(tag):
            while self._pop() != tag:
                pass

    def text(self, e: Element, between: str = " ", most: int | None = None) -> str:
        """The element's texts without white space around; with ``most`` at least so many characters (white space as one), if it has them."""
        out, n = [], 0
        for k in range(e.start, e.end):
            if t := self.texts[k].strip():
                out.append(t)
                if most is not None and (n := n + len(squeezed(t))) > most:
                    break
        return between.join(out)


def squeezed(text: str) -> str:
    return " ".join(text.split())


def told(page: str | None):
    """The rows of ROW."""
    tree = Tree(page or "")
    for e in tree.elements:
        if e.tag == "a":
            up = e.heading
            while up is not None and up.link is None:
                up.link, up = e, up.heading

    def after(e: Element) -> str:
        parts, n = [], 0
        for k in range(e.place + 1, len(e.parent.children)):
            x = e.parent.children[k]
            if isinstance(x, Element) and x.tag == "a":
                break
            if t := squeezed(tree.text(x, most=DESCRIPTION) if isinstance(x, Element) else tree.texts[x]):
                parts.append(t)
                n += len(t) + 1
            if n > ENOUGH:
                break
        return " ".join(parts)[:DESCRIPTION]

    for n, e in enumerate(x for x in tree.elements if x.tag in TOLD):
        get = e.attrs.get
        row = [n, e.tag, get("href"), get("src"), get("data"), get("width"), get("height"), tree.text(e), None, None, None, None, None, None]
        if e.tag == "h5":
            if e.link is not None:
                row[8], row[9] = e.link.attrs.get("href"), tree.text(e.link)
            at = e.place + 1
            while at < len(e.parent.children) and not isinstance(e.parent.children[at], Element):
                at += 1
            following = e.parent.children[at] if at < len(e.parent.children) else None
            row[10] = tree.text(following, "") if following is not None and following.tag == "p" else ""
        elif e.tag == "a":
            row[11] = after(e)
            if not row[11] and (block := e.block) is not None:
                title, own = squeezed(row[7]), squeezed(tree.text(block, most=len(row[7]) + 2 * DESCRIPTION))
                row[12] = squeezed(own[len(title) :] if title and own.startswith(title) else own)[:DESCRIPTION]
            if re.search(r"reso\d+\.pdf", get("href") or "", re.IGNORECASE):
                row[13] = tree.text(e.item if e.item is not None else e, "")
        yield tuple(row)


@F.udtf(returnType=ROW, useArrow=True)
class PageElements:
    def eval(self, page: str):
        yield from told(page)


def elements(pages: DataFrame, page: str = "html") -> DataFrame:
    """pages with a row for each told element; pages without any have none."""
    return pages.lateralJoin(PageElements(F.col(page).outer()))


def _rows(found: DataFrame, number: Column, title: Column, text: Column, day: Column, href: Column, base: Column) -> DataFrame:
    pdf = href.rlike(r"(?i)\.pdf(?:$|\?)")
    url = F.when(href != "", absolute(base, href))
    made = found.withColumns({"numero": number, "titulo": title, "descripcion": text, "fecha": day, "url_pdf": F.when(pdf, url), "url_detalle": F.when(~pdf, url)})
    return made.where("numero IS NOT NULL")


def modern_rows(found: DataFrame, base: Column, year: Column) -> DataFrame:
    """Headings with a link, described by the paragraph that follows at once."""
    heads = found.where("tag = 'h5' AND first_text IS NOT NULL")
    title, href = collapse(F.col("first_text")), F.coalesce(F.col("first_href"), F.lit(""))
    return _rows(heads, refs.circular_number(title, href), title, collapse(F.col("paragraph")), dates.circular_date(collapse(F.col("text")), year), href, base)


def legacy_rows(found: DataFrame, base: Column, year: Column) -> DataFrame:
    """Links whose text names a circular, described by what follows up to the next link, else by what holds them."""
    links = found.where("tag = 'a' AND href IS NOT NULL")
    title, href = collapse(F.col("text")), F.trim("href")
    links = links.where(title.rlike(r"(?i)circular\s*n(?:\D{0,2})\s*\d+"))
    return _rows(links, refs.circular_number(title, href), title, F.coalesce(F.nullif(F.col("after"), F.lit("")), F.col("block"), F.lit("")), dates.circular_date(title, year), href, base)


def resolution_rows(found: DataFrame, year: Column) -> DataFrame:
    """S14."""
    number = F.regexp_extract(F.col("href"), r"(?i)reso(\d+)\.pdf", 1)
    made = found.where("tag = 'a' AND item IS NOT NULL")
    return made.withColumns({"numero": number, "titulo": F.col("text"), "descripcion": F.col("item"), "fecha": F.concat(year.cast("string"), F.lit("-01-01"))})


def detail_pdfs(found: DataFrame, base: Column, keys: list[str]) -> DataFrame:
    """Of each page the first tag's address of a PDF."""
    address = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("href", "src", "data")])
    named = found.where(F.col("tag").isin("a", "iframe", "embed", "object") & address.rlike(r"(?i)\.pdf(?:$|\?)"))
    return named.groupBy(*keys).agg(F.min_by(absolute(base, address), "n").alias("url_pdf"))
