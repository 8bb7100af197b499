"""Law codes, article references and numbers in texts as Column functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafquarry.functions.text import FOLDED, collapse, first_of_each, folded, slug, strip, unique_list

# The law codes in their order, what stands for them in texts, their names, and other spellings of codes.
CODES = ("CT", "LIR", "LIVS", "ITE", "LHD", "LIT", "FT", "OCN", "CI")
MENTIONS = {
    "CT": (r"c[oó]digo\s+tributario", r"\bct\b", r"d\.?\s*l\.?\s*830\b"),
    "LIR": (r"ley\s+sobre\s+impuesto\s+a\s+la\s+renta", r"\blir\b", r"d\.?\s*l\.?\s*824\b"),
    "LIVS": (r"ley\s+sobre\s+impuesto\s+a\s+las\s+ventas\s+y\s+servicios", r"\blivs\b", r"d\.?\s*l\.?\s*825\b"),
    "ITE": (r"ley\s+sobre\s+impuesto\s+de\s+timbres\s+y\s+estampillas", r"\bite\b", r"decreto\s+ley\s+n?[°ºo]?\s*3\.?475\b", r"d\.?\s*l\.?\s*3\.?475\b"),
    "LHD": (r"ley\s+sobre\s+impuesto\s+a\s+las?\s+herencias(?:,\s*asignaciones\s+y\s+donaciones)?", r"\blhd\b", r"ley\s+n?[°ºo]?\s*16\.?271\b"),
    "LIT": (r"ley\s+sobre\s+impuesto\s+territorial", r"\blit\b", r"impuesto\s+territorial"),
    "FT": (r"franquicias\s+tributarias", r"\bft\b"),
    "OCN": (r"otros?\s+cuerpos?\s+normativos", r"\bocn\b", r"otras?\s+normas"),
    "CI": (r"convenios?\s+internacionales", r"\bci\b", r"convenio\s+para\s+evitar"),
}
NAMES = {
    "CT": "Codigo Tributario",
    "LIR": "Ley sobre Impuesto a la Renta",
    "LIVS": "Ley sobre Impuesto a las Ventas y Servicios",
    "ITE": "Ley sobre Impuesto de Timbres y Estampillas",
    "LHD": "Ley sobre Impuesto a las Herencias, Asignaciones y Donaciones",
    "LIT": "Ley sobre Impuesto Territorial",
    "FT": "Franquicias Tributarias",
    "OCN": "Otros Cuerpos Normativos",
    "CI": "Convenios Internacionales",
}
ALIASES = {"LTE": "ITE", "LH": "LHD", "LMT": "OCN", "LRT": "OCN", "OTRAS": "OCN", "OTROS": "OCN"}
# The patterns of an article's number and of the word before it.
ARTICLE = (
    r"\d{1,3}(?:\s*(?:bis|ter|quater|qu[aá]ter))?(?:\s+inciso\s+(?:primero|segundo|tercero|cuarto|quinto|sexto|final))?"
    r"(?:\s+letra\s+[a-z])?(?:\s+n[°ºo]?\s*\d+)?"
)
ARTICLE_WORD = r"(?:art(?:[ií]culo)?s?\.?)\s*"
MENTION = rf"(?iU){ARTICLE_WORD}({ARTICLE})"



#: What stands for a code alone, between word boundaries; the longer patterns of each code with a run of letters or digits that any match has.
ALONE = {p[2:-2]: code for code, ps in MENTIONS.items() for p in ps if p.startswith(r"\b")}


def _surely(pattern: str) -> str:
    """The longest run of letters or digits in a pattern that isn't optional."""
    plain = re.sub(r"\(\?:.*?\)\?|\[[^\]]*\]\??|\\[a-z]|\\?.\?", " ", pattern)
    return max(re.findall(r"[a-z0-9]+", plain), key=lambda x: (len(x), x.isdigit()))


PHRASES = [(code, p, _surely(p)) for code, ps in MENTIONS.items() for p in ps if not p.startswith(r"\b")]


def law_codes(text: Column) -> Column:
    """The codes that a text mentions, in their order. One scan finds what stands for codes alone; a longer pattern is tried only
    where the text has its surest part, which is found without regular expressions."""
    lower = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ſ"), F.lit("s"))
    alone = rf"(?U)\b({'|'.join(ALONE)})\b"

    def found(t: Column) -> Column:
        return F.transform(F.array(F.regexp_extract_all(t, F.lit(alone), 1)), lambda names: F.array_compact(F.array(*[F.when(mentioned(t, names, code), F.lit(code)) for code in CODES])))

    def mentioned(t: Column, names: Column, code: str) -> Column:
        short = [F.array_contains(names, name) for name, c in ALONE.items() if c == code]
        long = [F.contains(t, F.lit(sure)) & t.rlike("(?U)" + p) for c, p, sure in PHRASES if c == code]
        return reduce(lambda x, y: x | y, short + long)

    # bound by arrays of one, so that the text is lowered and scanned once
    return F.flatten(F.flatten(F.transform(F.array(lower), found)))


def law_code(c: Column) -> Column:
    """A code, also by another spelling; null for anything else."""
    c = F.upper(strip(c))
    c = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), c), c)
    return F.when(c.isin(*CODES), c)


def laws_in_order(values: Column) -> Column:
    """Distinct codes in the order of the codes."""
    have = F.transform(values, law_code)
    return F.filter(F.array(*map(F.lit, CODES)), lambda x: F.array_contains(have, x))


def laws_as_given(values: Column) -> Column:
    """Distinct codes in the order of the list."""
    return F.array_distinct(F.array_compact(F.transform(values, law_code)))


def article(c: Column) -> Column:
    """An article's number in its usual spelling."""
    c = F.lower(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "(?iU)^" + ARTICLE_WORD, ""))
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"\s+n[°ºo]?\s*", " N° ")
    c = F.regexp_replace(c, r"\s+(inciso|letra)\s+", " $1 ")
    return F.trim(F.regexp_replace(c, r"\s+", " "), F.lit(" ,;:."))


def mentions(text: Column) -> Column:
    """The articles that a text mentions, as written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MENTION), 1)


def reference(law: Column, number: Column, ambiguous: Column | bool = False) -> Column:
    """An article of a law, or an ambiguous one."""
    law, number = law_code(law), article(number)
    unclear = law.isNull() | (ambiguous if isinstance(ambiguous, Column) else F.lit(ambiguous))
    none = F.lit(None).cast("string")
    return F.struct(
        F.when(~unclear, law).alias("cuerpo"),
        number.alias("articulo"),
        F.when(~unclear, F.concat(law, F.lit(":"), number)).otherwise(none).alias("clave"),
        F.when(~unclear, F.concat(F.lit("Art. "), number, F.lit(" "), law))
        .when(number != "", F.concat(F.lit("Art. "), number, F.lit(" (ambiguo)")))
        .otherwise("Articulo ambiguo")
        .alias("label"),
        F.when(~unclear, F.concat(F.lower(law), F.lit("-art-"), slug(number)))
        .otherwise(F.concat(F.lit("art-"), slug(F.when(number == "", "ambiguo").otherwise(number))))
        .alias("slug"),
        unclear.alias("ambigua"),
    )


def key_of(ref: Column) -> Column:
    return F.coalesce(ref["clave"], F.concat(F.lit("AMB:"), ref["articulo"]))


def distinct_refs(refs: Column) -> Column:
    """The first of each key."""
    return first_of_each(refs, key_of)


def exact(refs: Column) -> Column:
    """E04."""
    return F.filter(refs, lambda x: ~x["ambigua"])


def ambiguous(refs: Column) -> Column:
    return F.filter(refs, lambda x: x["ambigua"])


def parsed(value: Column, with_ambiguous: bool = True) -> Column:
    """References from a JSON array of objects or texts, or from one plain text; distinct by key."""
    items = F.coalesce(F.from_json(value, "array<string>"), F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(value)))

    def build(x: Column) -> Column:
        o = F.from_json(x, "struct<cuerpo:string,articulo:string,ambigua:boolean>")
        is_object = x.startswith("{")
        return reference(F.when(is_object, o["cuerpo"]), F.when(is_object, o["articulo"]).otherwise(x), F.when(is_object, F.coalesce(o["ambigua"], F.lit(False))).otherwise(True))

    refs = distinct_refs(F.transform(items, build))
    return refs if with_ambiguous else exact(refs)


def serialised(refs: Column) -> Column:
    """JSON with null fields kept."""
    return F.to_json(refs, {"ignoreNullFields": "false"})


def labels(refs: Column) -> Column:
    return F.transform(refs, lambda x: x["label"])


def chip(ref: Column) -> Column:
    """What a page shows for a reference."""
    return F.when(ref["ambigua"], F.trim(F.concat(F.lit("Art. "), ref["articulo"], F.lit(" ambiguo")))).otherwise(F.coalesce(ref["label"], F.lit("")))


def article_blob(c: Column) -> Column:
    """Numbers of "31, 33 y 41": the leading one, explicit ones, then plain lists."""
    blob = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "), F.lit(" ,;:."))
    lead = article(F.regexp_extract(blob, rf"(?iU)^\s*({ARTICLE})", 1))
    explicit = F.transform(mentions(blob), article)
    parts = F.filter(F.transform(F.split(blob, r"(?<![\p{L}\p{N}_])(?:y|e)(?![\p{L}\p{N}_])|,|;"), lambda x: F.trim(x)), lambda x: x != "")
    plain = F.when((F.size(parts) > 0) & F.forall(parts, lambda x: x.rlike(r"^\d{1,3}$")), parts).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(F.array(lead), explicit, plain), lambda x: x != ""))


# How a circular's number stands in titles and addresses.
CIRCULAR_NUMBERS = (r"(?i)circular\s*n(?:\D{0,2})\s*0*(\d+)", r"(?i)circu(?:lar)?0*(\d+)\.(?:pdf|htm|html)")


def circular_number(title: Column, href: Column) -> Column:
    """From the title, else from the address; null without one."""
    tries = [
        F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit(""))
        for c in (title, href)
        for p in CIRCULAR_NUMBERS
    ]
    return F.coalesce(*tries)


def file_number(c: Column) -> Column:
    """As audits of files compare numbers."""
    n = folded(c)
    whole, letter = F.regexp_replace(n, "^0+(?=.)", ""), F.regexp_extract(n, r"^0*(\d+[a-z])$", 1)
    return F.when(n.rlike("^[0-9]+$"), whole).when(letter != "", letter).otherwise(n)


# What a number may be introduced by, in order.
NUMBER_WORDS = ("n.", "n ", "n°", "nº", "nro.", "numero")


def plain_number(c: Column) -> Column:
    """As audits of historical circulars compare numbers."""
    raw = F.lower(strip(F.coalesce(c, F.lit(""))))
    v = strip(reduce(lambda x, w: F.replace(x, F.lit(w), F.lit("")), NUMBER_WORDS, raw))
    return F.when(raw == "", "").otherwise(F.coalesce(F.nullif(strip(F.regexp_replace(v, r"^0+(?=\d)", "")), F.lit("")), v))


def file_key(tipo: Column, year: Column, number: Column) -> Column:
    """E14, J17."""
    return F.concat_ws("|", tipo, F.coalesce(year, F.lit(0)).cast("string"), file_number(number))


# Fixed values.
SUFFIXES = ("_original", "_limpio", "_clean", "_raw", "_ocr", "_scan", "_html")


def stem_keys(stem: Column) -> Column:
    """The keys under which an auxiliary file is found: its stem, then without each suffix, page and kind."""
    n = folded(stem)
    tail = "(?:" + "|".join(SUFFIXES) + ")"
    suffixes = F.regexp_extract_all(F.regexp_extract(n, rf"((?:{tail})+)$", 1), F.lit(f"({tail})"), 1)
    cut = F.transform(F.sequence(F.lit(0), F.size(suffixes)), lambda k: F.length(F.array_join(F.slice(suffixes, F.size(suffixes) - k + 1, k), "")))
    stems = F.transform(cut, lambda k: F.substr(n, F.lit(1), F.length(n) - k))
    work = F.element_at(stems, -1)
    year, rest = F.regexp_extract(work, r"^(\d{4})_circu(.+)$", 1), file_number(F.regexp_extract(work, r"^(\d{4})_circu(.+)$", 2))
    year2, rest2 = F.regexp_extract(work, r"^(\d{4})_(\d+[a-z]?)$", 1), file_number(F.regexp_extract(work, r"^(\d{4})_(\d+[a-z]?)$", 2))
    none = F.array().cast("array<string>")
    more = [
        F.array(F.regexp_extract(work, r"^(.+)_\d{1,3}$", 1)),
        F.when(year != "", F.array(F.concat(year, F.lit("_"), rest), F.concat(F.lit("circu"), rest), rest)).otherwise(none),
        F.when(year2 != "", F.array(F.concat(year2, F.lit("_"), rest2), rest2)).otherwise(none),
    ]
    return F.array_sort(F.array_distinct(F.filter(F.concat(stems, *more), lambda x: x != "")))


def title_tokens(c: Column) -> Column:
    """The first five tokens of four letters and more."""
    # as in folded, but only the tokens that are taken are rid of their marks
    tokens = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"[a-z0-9{FOLDED[0]}]{{4,}}"), 0)
    return F.transform(F.slice(tokens, 1, 5), lambda x: F.translate(x, *FOLDED))


def blob_id(url: Column) -> Column:
    """E17."""
    return F.nullif(F.regexp_extract(url, "id=([^&]+)", 1), F.lit(""))


# The courts by what their instance's name holds, in order.
COURTS = (
    ("corte suprema", "Corte Suprema"),
    ("tribunal constitucional", "Tribunal Constitucional"),
    ("corte de apelaciones", "Corte de Apelaciones"),
    ("tribunal tributario y aduanero", "Tribunal Tributario y Aduanero"),
    ("tribunal oral.*penal|penal.*tribunal oral", "Tribunal Oral en lo Penal"),
    ("juzgado de garant[ií]a", "Juzgado de Garantia"),
)


def court(instance: Column, by_group: Column | None = None) -> Column:
    """By group where that is known, else by the instance's name."""
    name = F.lower(collapse(instance))
    found = F.coalesce(*[F.when(name.rlike(p), v) for p, v in COURTS], F.lit("Otros"))
    return found if by_group is None else F.coalesce(by_group, found)


def office_category(kind: Column, api_key: Column, subject: Column) -> Column:
    """The branch's folder."""
    key, s = F.upper(strip(F.coalesce(api_key, F.lit("")))), F.upper(F.coalesce(subject, F.lit("")))
    return (
        F.when((kind == "oficio_lir") | (key == "RENTA"), "lir")
        .when((kind == "oficio_iva") | (key == "IVA"), "iva")
        .when((kind == "oficio_otras") | key.isin("OTRAS", "OTROS"), "otras_normas")
        .when(F.contains(s, F.lit("VENTAS")) | F.contains(s, F.lit("IVA")), "iva")
        .when(F.contains(s, F.lit("RENTA")) | F.contains(s, F.lit("LIR")), "lir")
        .otherwise("otras_normas")
    )


def office_prefix(kind: Column, api_key: Column) -> Column:
    key = F.upper(strip(F.coalesce(api_key, F.lit(""))))
    return F.when((kind == "oficio_lir") | (key == "RENTA"), "RENTA").when((kind == "oficio_iva") | (key == "IVA"), "IVA").otherwise("OTRAS")


def keywords(values: Column, most: int = 2000) -> Column:
    """Distinct words between bars; null without any."""
    return F.nullif(F.substring(F.array_join(unique_list(values), " | "), 1, most), F.lit(""))
