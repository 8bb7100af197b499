"""Article references with their laws (E03): each mention takes the nearest law after it, else the last one before it.

A text is cut into segments at line ends, semicolons and colons. Within a segment one expression finds articles, laws
and connectors in order; an article takes the next law if that comes before the next article and a connector ("de",
"del") stands between, else the last law before it in the segment, else it is ambiguous. A law's name and an article's
may run across a line end; such a mention belongs to the segment where it starts (the line end inside is masked before the
cut). All of it works on arrays within a row, in time linear in the text: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafquarry.functions import refs
from leafquarry.functions.text import bound

#: Stands for a line end inside a mention while texts are cut.
MASK = "\u0001"
SPACE = rf"[\s{MASK}]"


def _masked(pattern: str) -> str:
    return pattern.replace(r"\s", SPACE)


# Longer names first, as "ley sobre impuesto territorial" holds "impuesto territorial".
LAW = "|".join(sorted((p for ps in refs.MENTIONS.values() for p in ps), key=len, reverse=True))
TOKEN = rf"(?iU)({_masked(refs.ARTICLE_WORD + refs.ARTICLE)}|{_masked(LAW)}|\bde(?:l)?\b)"
IS_ARTICLE = rf"(?iU)^{_masked(refs.ARTICLE_WORD)}\d"
INNER_BREAK = rf"(?iU)(?:{refs.ARTICLE_WORD}{refs.ARTICLE}|{LAW})"


def _mask(text: Column) -> Column:
    """Line ends inside mentions masked: texts without such mentions, nearly all, are left as they are."""
    spans = F.regexp_extract_all(text, F.lit(INNER_BREAK), 0)
    masked = F.transform(spans, lambda m: F.replace(m, F.lit("\n"), F.lit(MASK)))
    between = F.split(text, INNER_BREAK, -1)
    whole = F.array_join(F.flatten(F.zip_with(between, F.concat(masked, F.array(F.lit(""))), lambda t, m: F.array(t, m))), "")
    return F.when(F.exists(spans, lambda m: F.contains(m, F.lit("\n"))), whole).otherwise(text)


#: A segment's tokens as letters: an article, one broken by a line end, a law and its code's place, a broken one, a connector.
ARTICLE, BROKEN_ARTICLE, LAW_, BROKEN_LAW, LINK = "ABLMD"


def _refs_of(segment: Column) -> Column:
    """article, law of each mention. Tokens become a string of letters, in which expressions look ahead for the law that follows and pieces
    that begin with a law tell the one before; a fold over them would copy all that it has found at each step."""
    tokens = F.transform(
        F.regexp_extract_all(segment, F.lit(TOKEN), 1),
        lambda t: F.struct(
            F.when(t.rlike(IS_ARTICLE), F.replace(t, F.lit(MASK), F.lit(" "))).alias("article"),
            F.when(~t.rlike(IS_ARTICLE), F.get(refs.law_codes(F.replace(t, F.lit(MASK), F.lit(" "))), 0)).alias("law"),
            F.contains(t, F.lit(MASK)).alias("broken"),
        ),
    )
    places = F.create_map(*[F.lit(x) for pair in zip(refs.CODES, "123456789", strict=True) for x in pair])
    codes = F.create_map(*[F.lit(x) for pair in zip("123456789", refs.CODES, strict=True) for x in pair])

    def letters(t: Column) -> Column:
        article = F.when(t["broken"], BROKEN_ARTICLE).otherwise(ARTICLE)
        law = F.concat(F.when(t["broken"], BROKEN_LAW).otherwise(LAW_), F.element_at(places, t["law"]))
        return F.when(t["article"].isNotNull(), article).when(t["law"].isNotNull(), law).otherwise(LINK)

    def pairs(found: Column) -> Column:
        spelled = F.array_join(F.transform(found, letters), "")
        # a whole article takes the first law after it if only connectors stand between, and one at least
        after = F.regexp_extract_all(spelled, F.lit(rf"[{ARTICLE}{BROKEN_ARTICLE}](?:(?<={ARTICLE})(?={LINK}+[{LAW_}{BROKEN_LAW}](.)))?"), 1)
        pieces = F.split(spelled, f"(?={LAW_})", -1)
        before = F.flatten(
            F.transform(pieces, lambda p: F.transform(F.regexp_extract_all(p, F.lit(f"[{ARTICLE}{BROKEN_ARTICLE}]"), 0), lambda _: F.when(p.startswith(LAW_), F.substring(p, 2, 1))))
        )
        laws = F.zip_with(after, before, lambda x, y: F.element_at(codes, F.coalesce(F.nullif(x, F.lit("")), y)))
        articles = F.transform(F.filter(found, lambda t: t["article"].isNotNull()), lambda t: t["article"])
        return F.zip_with(articles, laws, lambda x, y: F.struct(x.alias("article"), y.alias("law")))

    # bound by an array of one, so that the tokens are found once
    return F.flatten(F.transform(F.array(tokens), pairs))


def references(text: Column) -> Column:
    """The distinct references of a text, in its order; a null text has none."""
    # no mention holds a semicolon or colon, so what stands between them and names no article is passed over unread
    stretches = F.filter(F.split(F.coalesce(text, F.lit("")), "[;:]"), lambda x: x.rlike(refs.MENTION))
    segments = F.filter(F.flatten(F.transform(stretches, lambda x: F.split(_mask(x), "\n"))), lambda x: x.rlike(_masked(refs.MENTION)))
    pairs = F.flatten(F.transform(segments, _refs_of))
    return refs.distinct_refs(F.transform(pairs, lambda p: refs.reference(p["law"], p["article"], p["law"].isNull())))


def resolved(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, refs."""
    return docs.select(key, references(F.col(text)).alias("refs"))


def index_rows(docs: DataFrame, key: str, laws: str, found: str, most: int = 20) -> DataFrame:
    """doc_id, ley, articulo: the first exact references, and each law without one with a null article."""

    def listed(chosen: Column) -> Column:
        alone = F.array_except(F.filter(F.col(laws), lambda x: x != ""), F.transform(chosen, lambda r: r["cuerpo"]))
        none = F.lit(None).cast("string")
        exact = F.transform(chosen, lambda r: F.struct(r["cuerpo"].alias("ley"), r["articulo"].alias("articulo"), F.lit(False).alias("bare")))
        return F.concat(exact, F.transform(alone, lambda x: F.struct(x.alias("ley"), none.alias("articulo"), F.lit(True).alias("bare"))))

    # one explode, and an outer one: for others Spark would infer a filter that finds the references of each text once more
    rows = docs.select(F.col(key).alias("doc_id"), F.explode_outer(bound(F.slice(refs.exact(F.col(found)), 1, most), listed)).alias("r")).where("r IS NOT NULL")
    rows = rows.select("doc_id", "r.ley", "r.articulo", F.when(F.col("r.bare"), F.monotonically_increasing_id()).alias("own"))
    return rows.dropDuplicates().drop("own")  # bare laws have a number of their own each
