"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. The first pass decides each block from its share of link text, its length
and its share of function words; short blocks and unclear ones stay undecided, and the second pass gives them the
label of the nearest decided block. What menus, footers, asides, notices, adverts, reader comments and the like hold
(by tag, or by the words of their class, id or role) is left out before. Inside <article> or <main> a block needs no
function words, a class is a sign only if all its parts are ("share-buttons", not "share-price"), and link text counts against it only in a run of such blocks. If the text inside is no less than
what the passes keep beside it, the text beside it goes; else (a teaser, say) both count alike.

What only a weak sign excludes (a form, a class such as "search" or "banner") is rescued by an <article> or <main> within
it, and as a whole where the page has no other text.

Defined cases: null and empty html give the empty text; unclosed tags end with what holds them; null ids and urls stay
null; very long pages take time in proportion; repeated rows stay; an empty table gives an empty result; columns beyond
those named are ignored. Nothing else is dropped or cut.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.llm.common import bound_batches, pick
from leafquarry.llm.languages import EVERY_STOPWORD

RAW = r"script|style|textarea|title|xmp"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<[!?][^>]*+>|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*+)(?P<rest2>[^>]*+)>",
    re.IGNORECASE | re.DOTALL,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input label".split())
#: Tags whose contents are never text of the article, those of them that a block-level tag inside ends, and weak ones.
OUTSIDE = frozenset("nav footer aside head button dialog menu noscript template iframe object canvas audio video svg math select".split())
BROKEN_OUT_OF = frozenset("svg math select".split())
BLOCK_TAGS = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
WEAK_TAGS = frozenset(["form"])
#: Words that name what isn't the article: as a whole class or id, or as its first or last part.
STRONG = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsors sponsored promo promos cookie cookies consent gdpr newsletter sidebar sidenav nav navbar navigation"
    " menu submenu breadcrumb breadcrumbs pagination pager toolbar topbar masthead footer comment comments commentlist disqus replies respond share sharing related recommended"
    " recommendations popup modal login signup subscribe subscription copyright widget widgets".split()
)
#: Parts that a class inside an article may have besides, to be such a sign.
BOXES = frozenset(
    "box block bar area container wrapper wrap list lists links button buttons section slot unit inner outer content top bottom left right form signup email inline posts stories"
    " articles icons text title heading header footer row panel group module nav count".split()
)
#: Words that do so only as a whole class, and not for what holds an article; and those of them that inside one speak only against what isn't prose.
DOUBTFUL = frozenset("legal discussion side social".split())
WEAK = frozenset("search searchform notice notices alert alerts banner overlay legal disclaimer discussion side social header reply skip".split())
COMMENT = frozenset("comment comments commentlist disqus replies".split())
#: First and last parts of a class that speaks of the layout, not of the element.
FIRST_NEUTRAL = frozenset("no has have with without is not hide show layout body col grid row js".split())
LAST_NEUTRAL = frozenset("page layout results article post entry story template enabled disabled free".split())
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
LETTERS = re.compile(r"[^\W\d_]+")

#: Code points below which a block is short, and from which it is long; shares of link text and of function words.
SHORT, LONG = 70, 200
MOST_LINKS, FEW_LINKS = 0.35, 0.15
FEW_STOPWORDS, SOME_STOPWORDS = 0.05, 0.12
#: Blocks of link text in a row that make a list of links inside an article.
LIST = 3
#: Tags whose text has few function words.
UNJUDGED = frozenset("pre table ul ol dl address figure".split())
#: Ends of sentences; letters of words that are written without spaces, each of which counts as several.
STOP = re.compile(r"[.!?…。！？।۔](?:[\s\"'”’»)\]]|$)|[。！？]")
DENSE, DENSE_WORTH = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff]"), 3
LATIN = re.compile("[a-z\u00df-\u024f\u1e00-\u1eff]")


@lru_cache(maxsize=1 << 14)
def sign(name: str, inside: bool = False) -> int:
    """What one class or id says of its element, inside an article or not: 2 surely outside, 1 perhaps, -1 outside unless it is prose, 0 nothing."""
    parts = [x for x in CAMEL.sub("-", name).lower().replace("_", "-").split("--")[0].split("-") if x]
    if not parts or len(parts) > 1 and (parts[0] in FIRST_NEUTRAL or parts[-1] in LAST_NEUTRAL):
        return 0
    if inside and len(parts) > 1:
        return 2 if all(x in STRONG or x in BOXES for x in parts) and not STRONG.isdisjoint(parts) else 0
    if inside and parts[0] in DOUBTFUL:
        return -1
    if parts[0] in STRONG or parts[-1] in STRONG or not COMMENT.isdisjoint(parts) or parts[-2:] in (["site", "header"], ["page", "header"]):
        return 2
    return 1 if len(parts) == 1 and parts[0] in WEAK else 0


def signs(rest: str, inside: bool = False) -> int:
    """The strongest sign of a tag's attributes."""
    most = 0
    if not rest:
        return most
    for name, value in ATTRIBUTE.findall(rest):
        words = value.strip("\"'").split()
        if name.lower() == "role":
            most = max(most, 2 * any(w.lower() in ROLES for w in words))
        else:
            most = max([most, *(sign(w, inside) for w in words)], key=abs)
    return most


@dataclass
class Block:
    """outside: 2 surely, 1 by a weak sign, -1 unless it is prose. unjudged: in code, a table or a list."""

    text: str
    links: int
    inside: bool
    outside: int
    unjudged: bool = False

    @cached_property
    def length(self) -> int:
        return len(self.text) + (DENSE_WORTH - 1) * len(DENSE.findall(self.text))

    @cached_property
    def words(self) -> tuple[int, int]:
        """Words, and function words among them; (0, 0) where most letters aren't Latin."""
        text = self.text.lower()
        found = LETTERS.findall(text)
        if 2 * len(LATIN.findall(text)) < sum(map(len, found)):
            return 0, 0
        return len(found), sum(w in EVERY_STOPWORD for w in found)

    @property
    def is_prose(self) -> bool:
        return self.length >= SHORT and self.links <= FEW_LINKS * len(self.text) and STOP.search(self.text) is not None


def blocks_of(page: str) -> list[Block]:
    """The blocks with text, in page order, in one walk over the tags."""
    out: list[Block] = []
    parts: list[str] = []
    link_parts: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # tag, inside an article, outside of the text
    depth: defaultdict[str, int] = defaultdict(int)  # of each open tag
    broken = unjudged = 0  # how many open tags a block-level tag would end; and are of UNJUDGED
    opened: tuple[bool, int, bool] | None = None  # where the block's first text stands

    def close() -> None:
        nonlocal opened
        if opened is not None:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, len(" ".join(html.unescape("".join(link_parts)).split())), *opened))
        opened = None
        parts.clear()
        link_parts.clear()

    def pop() -> str:
        nonlocal broken, unjudged
        tag = stack.pop()[0]
        depth[tag] -= 1
        if tag in BROKEN_OUT_OF:
            broken -= 1
        elif tag in UNJUDGED:
            unjudged -= 1
        return tag

    def say(text: str) -> None:
        nonlocal opened
        if opened is None and text.strip():
            opened = (*(stack[-1][1:] if stack else (False, 0)), unjudged > 0)
        parts.append(text)
        if depth["a"]:
            link_parts.append(text)

    last, upto = 0, page.rfind(">") + 1  # no tag ends after that
    for m in TOKEN.finditer(page, 0, upto):
        if m.start() > last:
            say(page[last : m.start()])
        last = m.end()
        if last == upto and page.startswith("<!--", m.start()) and not m[0].endswith("-->"):
            last = len(page)  # an unclosed comment
        if m["raw"] and m["raw"].lower() in ("textarea", "xmp"):
            close()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            close()
        if tag == "br":
            parts.append(" ")
        if m["end"] or m["end2"]:
            if depth[tag] > 0:
                while pop() != tag:
                    pass
            continue
        rest = m["rest"] or m["rest2"] or ""
        if tag in VOID or rest.endswith("/"):
            continue
        if tag not in INLINE:
            while stack and (stack[-1][0] in INLINE or stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                pop()
            if broken and tag in BLOCK_TAGS and tag not in OUTSIDE:
                while broken:
                    pop()
        inside, outside = stack[-1][1:] if stack else (False, 0)
        if tag in ("article", "main"):
            inside, outside = True, 0 if outside in (1, -1) else outside
            outside = max(outside, 2 * (signs(rest) == 2))
        elif tag in OUTSIDE or tag == "header" and not inside:
            outside = 2
        elif outside < 2 and tag not in ("html", "body"):
            outside = max(outside, signs(rest, inside), int(tag in WEAK_TAGS), key=abs)
        stack.append((tag, inside, outside))
        depth[tag] += 1
        if tag in BROKEN_OUT_OF:
            broken += 1
        elif tag in UNJUDGED:
            unjudged += 1
    if last < len(page):
        say(page[last:])
    close()
    return out


def first_pass(b: Block, listed: bool = True) -> bool | None:
    """Kept, dropped or (None) undecided. listed: the page shows a language whose function words are known."""
    n = len(b.text)
    if b.links > MOST_LINKS * n:
        return None if b.inside else False
    if b.length < SHORT:
        return None
    if b.inside:
        return True
    words, function_words = b.words
    if b.unjudged or not words and not listed:
        return True if b.is_prose and not listed else None
    if function_words >= SOME_STOPWORDS * max(1, words):
        return True if n >= LONG or b.links <= FEW_LINKS * n else None
    if not listed or not words:
        return True if b.is_prose else None
    if function_words < FEW_STOPWORDS * words:
        return False
    return None


def shows_listed_language(blocks: list[Block]) -> bool:
    """Whether the page's long blocks, as a whole, have the function words of a listed language."""
    long = [b.words for b in blocks if b.length >= SHORT and b.links <= MOST_LINKS * len(b.text) and not b.unjudged]
    return sum(f for _, f in long) >= FEW_STOPWORDS * sum(w for w, _ in long) and any(w for w, _ in long)


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Undecided blocks get the label of the nearest decided one (of two equally near, kept if either is)."""
    decided = [k for k, label in enumerate(labels) if label is not None]
    final, at = [], 0
    for k, label in enumerate(labels):
        if label is None:
            while at < len(decided) and decided[at] < k:
                at += 1
            near = [d for d in decided[max(0, at - 1) : at + 1]]
            least = min((abs(d - k) for d in near), default=0)
            label = any(labels[d] for d in near if abs(d - k) == least) if near else blocks[k].inside
        final.append(label)
    return final


def chosen(blocks: list[Block]) -> list[Block]:
    """The blocks to keep among those that their place doesn't exclude."""
    blocks = [b for b in blocks if b.outside >= 0 or b.is_prose]
    listed = shows_listed_language(blocks)
    labels, run = [first_pass(b, listed) for b in blocks], 0
    for k, b in enumerate(blocks):
        run = run + 1 if b.links > MOST_LINKS * len(b.text) else 0
        if run >= LIST:
            labels[k - LIST + 1 : k + 1] = [False] * LIST
    if not any(labels):
        labels = [label if label is not None or b.links > MOST_LINKS * len(b.text) else True for b, label in zip(blocks, labels, strict=True)]
    kept = [b for b, label in zip(blocks, second_pass(blocks, labels), strict=True) if label]
    within = [b for b in kept if b.inside]
    if within and 2 * sum(len(b.text) for b in within) >= sum(len(b.text) for b in kept):
        return within
    return kept


def main_text(page: str | None) -> str:
    blocks = [b for b in blocks_of(page or "") if b.outside < 2]
    kept = chosen([b for b in blocks if b.outside <= 0])
    if not kept:
        kept = chosen(blocks)
    return "\n".join(b.text for b in kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    thin = pick(pages, page_id="page_id", url="url", html="html").withColumn("page_id", F.col("page_id").cast("bigint"))
    return thin.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
