"""Text scalars as Column functions (T01-T33, P17-P20, M01-M02): no Python runs on the executors."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from html import unescape
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and what is left of them without marks; fixed values, in natural order.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


#: Unicode's white space, as (?U)\s has it.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null as empty."""
    # single blanks, nearly all, stay
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it: within lambdas Spark would evaluate each use again."""
    return F.get(F.transform(F.array(value), f), 0)


def unmarked(c: Column) -> Column:
    return F.translate(c, MARKED, PLAIN)


def lines_joined(c: Column) -> Column:
    """Blanks as one, none around line ends, at most one empty line in a row."""
    c = F.regexp_replace(c, r"[ \t]{2,}|\t", " ")  # single blanks stay
    c = F.regexp_replace(c, r" *\n *", "\n")
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


# Corrections of what is shown.
CORRECTIONS = ((r"\bley\s+sombre\b", "Ley sobre"), (r"\bresoluciónes\b", "Resoluciones"), (r"\bresoluciones ex\.\b", "Resoluciones Ex."))


def corrected(c: Column) -> Column:
    """Only texts that hold a part of every match, in letters that have no third case, are searched."""

    def put_right(x: Column) -> Column:
        maybe = F.contains(F.lower(x), F.lit("ombre")) | F.contains(F.lower(x), F.lit("oluc"))
        return F.when(maybe, reduce(lambda y, r: F.regexp_replace(y, "(?iu)" + r[0], r[1]), CORRECTIONS, x)).otherwise(x)

    return bound(F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit("\n")), put_right)


def display(c: Column) -> Column:
    """T02."""
    return strip(lines_joined(corrected(c)))


def fingerprint(c: Column) -> Column:
    """Of what is displayed; blanks needn't be joined first, as none stays."""
    plain = bound(corrected(c), lambda x: F.when(F.length(x) == F.octet_length(x), x).otherwise(unmarked(x)))
    return F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "")


# Damaged encodings and their repair, in order.
REPAIRS = (
    ("\u00c3\u00a1", "á"), ("\u00c3\u00a9", "é"), ("\u00c3\u00ad", "í"), ("\u00c3\u00b3", "ó"), ("\u00c3\u00ba", "ú"),
    ("\u00c3\u0081", "Á"), ("\u00c3\u0089", "É"), ("\u00c3\u008d", "Í"), ("\u00c3\u201c", "Ó"), ("\u00c3\u0161", "Ú"),
    ("\u00c3\u00b1", "ñ"), ("\u00c3\u2018", "Ñ"), ("&nbsp;", " "), ("&#160;", " "),
    ("\x92", "'"), ("\x93", '"'), ("\x94", '"'), ("\x96", "-"), ("\x97", "-"),
    ("APLICACI?N", "APLICACION"), ("ART?CULO", "ARTICULO"), ("OBLIGACI?N", "OBLIGACION"),
)


def repaired(c: Column) -> Column:
    """T10."""
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), REPAIRS, c)


def comparable(c: Column) -> Column:
    """Lower case without marks, only digits, letters and colons."""
    c = F.translate(unmarked(repaired(F.coalesce(c, F.lit("")))), "º°ª", "ooa")
    return F.lower(F.trim(F.regexp_replace(c, "[^0-9A-Za-z:]+", " ")))


#: What an identifier's tokens may hold besides letters and digits, and what stands for it.
FOLDED = "áéíóúüñº°№", "aeiouunoon"


def folded(c: Column) -> Column:
    """Tokens of an identifier joined by underscores."""
    c = F.translate(F.lower(strip(F.coalesce(c, F.lit("")))), *FOLDED)
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", "_"), F.lit("_"))


def slug(c: Column) -> Column:
    """For addresses."""
    c = F.regexp_replace(unmarked(F.translate(F.coalesce(c, F.lit("")), "ºª", "oa")), r"[^\x00-\x7F]", "")
    c = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("sin-slug"))


def safe_name(c: Column) -> Column:
    """T05, for files."""
    c = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9A-Za-z._-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("sin_nombre"))


def safe_slug(c: Column, default: str | Column = "sin_codigo", most: int = 90) -> Column:
    """T05, for codes."""
    c = F.trim(F.regexp_replace(collapse(c), "[^0-9A-Za-z._-]+", "_"), F.lit("._-"))
    return F.substring(F.coalesce(F.nullif(c, F.lit("")), default if isinstance(default, Column) else F.lit(default)), 1, most)


def safe_segment(c: Column) -> Column:
    """T05, for folders."""
    c = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9A-Za-z._-]+", "_"), F.lit("._-"))
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("sin_valor"))


#: Character references by name (and the numbers that stand for other characters), from the standard library's tables.
REFERENCES = {n: chr(p) for n, p in name2codepoint.items()} | {"apos": "'"} | {f"#{n}": unescape(f"&#{n};") for n in range(128, 160)}
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"


def unescaped(c: Column) -> Column:
    """Character references by name, decimal and hexadecimal number; what isn't one stays. Texts without an ampersand pass."""
    known = F.from_json(F.lit(json.dumps(REFERENCES)), "map<string,string>")

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, REFERENCE, 1)
        digits = F.regexp_extract(name, r"^#([0-9]+)$", 1)
        code = F.coalesce(F.nullif(digits, F.lit("")).cast("bigint"), F.conv(F.nullif(F.regexp_extract(name, r"^#[xX](.+)$", 1), F.lit("")), 16, 10).cast("bigint"))
        valid = F.when((code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF), code)
        usual = F.decode(F.unhex(F.lpad(F.hex(valid), 8, "0")), "UTF-32")
        numbered = F.coalesce(F.element_at(known, F.concat(F.lit("#"), code.cast("string"))), usual, F.lit("\ufffd"))
        found = F.when(code.isNotNull(), numbered).otherwise(F.element_at(known, name))
        return F.when(found.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(found, F.substr(piece, F.length(name) + 2)))

    pieces = F.split(c, "&")
    whole = F.concat(F.get(pieces, 0), F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), decoded), ""))
    return F.when(F.contains(c, F.lit("&")), whole).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Breaks and paragraph ends as line ends, other tags as blanks."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "<br ?/?>", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)</p\s*>", "\n\n"), "<[^>]+>", " ")
    c = F.regexp_replace(F.translate(unescaped(c), " ", " "), r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def readable_html(c: Column) -> Column:
    """Without scripts and styles; table rows as cells between bars; from the first "circular n" on."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)</t[dh]\s*>\s*<t[dh][^>]*>", " | "), r"(?i)<br[^>]*>|</(p|div|li|tr|h[1-6])\s*>", "\n")
    c = lines_joined(unescaped(F.regexp_replace(c, "<[^>]+>", " ")))
    at = F.regexp_instr(F.lower(c), F.lit(r"circular\s+n"))
    return strip(F.when(at > 0, F.substr(c, at)).otherwise(c))


def html_title(c: Column) -> Column:
    """T09."""
    return collapse(repaired(unescaped(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?is)<title[^>]*>(.*?)</title", 1))))


def html_description(c: Column) -> Column:
    """The description's content without the leading word."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"""(?is)<meta[^>]*name=["']?description["']?[^>]*content=["']([^"']*)""", 1)
    return collapse(F.regexp_replace(collapse(repaired(unescaped(found))), "(?i)^MATERIA:", ""))


def is_noise(c: Column) -> Column:
    """P18."""
    c = collapse(c)
    return (
        c.isin("", "Home", "|", "Inicio") | c.startswith("Home |") | c.rlike(r"^(?:\[\d+\],?\s*)+$") | c.rlike(r"(?i)^circulares\s+\d{4}$")
    )


def without_repeats(lines: Column) -> Column:
    """No empty lines, and none like the one before."""

    def kept(full: Column) -> Column:
        # paired with the line before by place, as a lambda that indexed the array would evaluate it for each line
        pairs = F.zip_with(full, F.concat(F.array(F.lit(None).cast("string")), full), lambda x, before: F.struct(x.alias("x"), before.alias("before")))
        return F.transform(F.filter(pairs, lambda p: p["x"].isNotNull() & ~p["x"].eqNullSafe(p["before"])), lambda p: p["x"])

    return bound(F.filter(lines, lambda x: x.isNotNull() & (x != "")), kept)


def first_of_each(items: Column, key: Callable[[Column], Column]) -> Column:
    """The first item of each key, in order. Items are evaluated once, sorted by key, and what begins a key is sorted back by place."""

    def firsts(placed: Column) -> Column:
        # paired with the one before by place, as a lambda that indexed the array would evaluate it for each item
        before = F.concat(F.array(F.lit(None).cast("struct<key:string>")), F.transform(placed, lambda p: F.struct(p["key"].alias("key"))))
        pairs = F.zip_with(placed, before, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        begins = F.filter(pairs, lambda y: y["p"].isNotNull() & (y["q"].isNull() | ~y["p"]["key"].eqNullSafe(y["q"]["key"])))
        return F.transform(F.sort_array(F.transform(begins, lambda y: F.struct(y["p"]["n"].alias("n"), y["p"]["x"].alias("x")))), lambda y: y["x"])

    return bound(F.sort_array(F.transform(items, lambda x, n: F.struct(key(x).alias("key"), n.alias("n"), x.alias("x")))), firsts)


def html_body(c: Column, title: Column, subject: Column) -> Column:
    """The page's lines without noise, repeats of each other and of the title and subject."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<!--.*?-->|<head\b.*?</head\s*>|<(script|style)\b.*?</\1\s*>|<(meta|link)\b[^>]*>", "\n")
    # nothing is read of a blank line, and none is kept
    full = F.filter(F.split(bound(F.regexp_replace(c, "<[^>]+>", "\n"), unescaped), "\n"), lambda x: F.trim(x) != "")
    lines = F.transform(full, lambda x: collapse(ocr_text(x)))

    def wanted(lines: Column, names: Column) -> Column:
        t, s = names["title"], names["subject"]

        def of_names(k: Column) -> Column:
            of_title = (t != "") & ((k == t) | (k.startswith("circular") & F.contains(k, t)))
            return of_title | (s != "") & ((k == s) | (k.startswith("materia") & F.contains(k, s)))

        return F.filter(lines, lambda line: ~is_noise(line) & ~bound(comparable(line), of_names))

    names = F.struct(comparable(ocr_text(title)).alias("title"), comparable(ocr_text(subject)).alias("subject"))
    return F.array_join(without_repeats(bound(names, lambda n: wanted(lines, n))), "\n")


# Readings that are put right, in order.
READINGS = (
    ("N? ", "Nº "), ("N¯ ", "Nº "), ("N° ", "Nº "), ("A—O", "AÑO"), ("A?O", "AÑO"), ("ARTëCULO", "ARTÍCULO"), ("ARTICULO", "ARTÍCULO"),
    ("RESOLUCION", "RESOLUCIÓN"), ("RESOLUCION Nº", "RESOLUCIÓN Nº"), ("OBLIGACION", "OBLIGACIÓN"), ("RETENCION", "RETENCIÓN"),
)


def ocr_text(c: Column) -> Column:
    """T12."""
    c = F.translate(repaired(F.coalesce(c, F.lit(""))), "\r\f", "\n\n")
    c = lines_joined(F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2"))
    c = reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), READINGS, c)
    c = F.regexp_replace(c, r"(?U)\bN[?¯°º]\s*", "Nº ")
    return strip(F.regexp_replace(c, "(?i)AN[~—?]O", "AÑO"))


def ocr_score(c: Column) -> Column:
    """Words of three and more count 4 each, the text 1, question marks and lost characters against it."""
    c = collapse(c)
    words = F.size(F.regexp_extract_all(c, F.lit("[A-Za-zÀ-ſ0-9]{3,}"), 0))
    lost = F.length(c) - F.length(F.replace(c, F.lit("�"), F.lit("")))
    asked = F.length(c) - F.length(F.replace(c, F.lit("?"), F.lit("")))
    return F.when(c == "", 0).otherwise(words * 4 + 1 - asked * 2 - lost * 4)


#: The score from which no further variant is looked at.
ENOUGH = 350


def best_variant(variants: Column, enough: int = ENOUGH) -> Column:
    """Variante (place from 0), puntaje, texto of the best of several readings of a page: the first that scores ``enough``, else the
    best, of equal ones the first. Once one is good enough the others aren't scored. Null without any variant."""

    def step(best: Column, v: Column) -> Column:
        # the score is let into the fold as an array of one, so that it is computed once
        scored = F.transform(F.array(v["text"]), lambda t: F.struct(v["n"].alias("n"), ocr_score(F.coalesce(t, F.lit(""))).cast("int").alias("score"), t.alias("text")))
        better = F.element_at(scored, 1)
        return F.when(best["score"] >= enough, best).otherwise(F.element_at(F.transform(scored, lambda x: F.when(best["score"].isNull() | (x["score"] > best["score"]), x).otherwise(best)), 1))

    none = F.lit(None).cast("struct<n:int,score:int,text:string>")
    numbered = F.transform(variants, lambda t, n: F.struct(n.alias("n"), t.alias("text")))
    found = F.aggregate(numbered, none, step)
    return F.when(found.isNotNull(), F.struct(found["n"].alias("variante"), found["score"].alias("puntaje"), found["text"].alias("texto")))


# What Windows-1252 has in the places 128 to 159; unused places are lost characters.
HIGH = "€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž��‘’“”•–—˜™š›œ�žŸ"


def from_1252(content: Column) -> Column:
    """Bytes of Windows-1252 as text; they are those of Latin-1 but for 32 places."""
    return F.translate(F.decode(content, "iso-8859-1"), "".join(map(chr, range(128, 160))), HIGH)


SUSPECT, USUAL = "�µþ¦¯ÆḞĶċĘ", "áéíóúÁÉÍÓÚñÑ°º"


def best_decoding(content: Column) -> Column:
    """Of three encodings the one with the lowest penalty, the first of equal ones, repaired."""

    def count(t: Column, chars: str) -> Column:
        return F.length(t) - F.length(F.translate(t, chars, ""))

    tries = [from_1252(content), F.decode(content, "iso-8859-1"), F.make_valid_utf8(content.cast("string"))]
    scored = [F.struct((count(t, SUSPECT) * 100 - count(t, USUAL) * 2).alias("score"), F.lit(k).alias("k"), t.alias("text")) for k, t in enumerate(tries)]
    return repaired(F.array_min(F.array(*scored))["text"])


def upper_share(c: Column) -> Column:
    """Of the letters; null without letters."""
    return F.length(F.regexp_replace(c, r"[^\p{Lu}]", "")) / F.nullif(F.length(F.regexp_replace(c, r"[^\p{L}]", "")), F.lit(0))


def is_heading(c: Column) -> Column:
    """P19, for previews."""
    return (F.coalesce(upper_share(c), F.lit(0.0)) >= 0.82) & (F.length(strip(c)) >= 24)


def is_capital_line(c: Column) -> Column:
    """P19, for scanned headers."""
    return F.coalesce(upper_share(c), F.lit(0.0)) >= 0.65


def is_redundant(line: Column, *others: Column) -> Column:
    """P20: no letters, a known header, or a part or whole of one of the others (fingerprints)."""
    return _redundant(line, *map(fingerprint, others))


def _redundant(line: Column, *prints: Column) -> Column:
    """is_redundant for others whose fingerprints are known."""

    def found(f: Column) -> Column:
        out = (f == "") | f.startswith("home") | f.startswith("resultadodestacado") | F.contains(f, F.lit("ingresountermino"))
        for o in prints:
            out = out | ((o != "") & (F.contains(o, f) | F.contains(f, o)))
        return out

    return bound(fingerprint(line), found)


NUMBERED = r"(?iu)^\(?(ord\.|oficio ordinario|resoluci[oó]n ex)"


def preview(content: Column, title: Column, reference: Column) -> Column:
    """From the first line that is neither redundant, an office number nor a heading."""
    return bound(F.struct(fingerprint(title).alias("title"), fingerprint(reference).alias("reference")), lambda p: _preview(content, p["title"], p["reference"]))


def _preview(content: Column, title: Column, reference: Column) -> Column:
    """preview by the fingerprints of title and reference."""

    def start(x: Column) -> Column:
        return (x != "") & ~x.rlike(NUMBERED) & ~is_heading(x) & ~_redundant(x, title, reference)

    def rest(lines: Column) -> Column:
        # the place of the first start, 0 or less while none is found: then it counts the lines that were passed
        first = F.aggregate(lines, F.lit(0), lambda at, x: F.when(at > 0, at).when(start(x), 1 - at).otherwise(at - 1))
        return bound(first, lambda at: F.when(at > 0, F.array_join(F.slice(lines, F.greatest(at, F.lit(1)), F.size(lines)), "\n")).otherwise(""))

    def shown(text: Column) -> Column:
        body = display(bound(F.transform(F.split(text, "\n"), strip), rest))
        return bound(body, lambda x: F.when(x != "", x).otherwise(text))

    return bound(display(content), shown)


def display_subject(title: Column, reference: Column) -> Column:
    """T17."""
    return F.when(fingerprint(title) == fingerprint(reference), "").otherwise(display(title))


def display_summary(summary: Column, content: Column, title: Column, reference: Column) -> Column:
    """The summary, or the preview where there is none or it starts with the title, without redundant lines."""

    def chosen(p: Column) -> Column:
        own, head = p["own"], F.substring(p["title"], 1, 90)
        use = (own != "") & ~((head != "") & bound(fingerprint(own), lambda f: (f != "") & f.startswith(head)))
        return F.when(use, own).otherwise(_preview(content, p["title"], p["reference"]))

    def without(text: Column, p: Column) -> Column:
        lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: (x != "") & ~x.rlike(NUMBERED) & ~_redundant(x, p["title"], p["reference"]))
        return bound(display(F.array_join(lines, " ")), lambda x: F.when(x != "", x).otherwise(text))

    given = F.struct(display(summary).alias("own"), fingerprint(title).alias("title"), fingerprint(reference).alias("reference"))
    return bound(given, lambda p: bound(chosen(p), lambda text: without(text, p)))


def summary(c: Column, most: int = 800) -> Column:
    """The first five lines of over 40 characters."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: F.length(x) > 40)
    return F.substring(F.array_join(F.slice(lines, 1, 5), " "), 1, most)


def highlighted(c: Column, question: str) -> Column:
    """Each word of over two letters, one after the other on the growing text."""
    words = [w for w in question.split() if len(w) > 2]
    return reduce(lambda x, w: F.regexp_replace(x, rf"(?iu)(\Q{w}\E)", "<mark>$1</mark>"), words, c)


def truncated(c: Column, most: int = 700) -> Column:
    """T19."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def formal_type(c: Column) -> Column:
    """T20."""
    names = {"circular": "Circular", "oficio": "Oficio", "resolucion": "Resolucion Exenta", "judicial": "Jurisprudencia Judicial"}
    other = F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))
    return F.coalesce(*[F.when(c == k, v) for k, v in names.items()], other)


def citations(doc: dict[str, Column]) -> dict[str, Column]:
    """The four citations of a document. doc: tipo, numero, anio, fecha, materia, referencia, resumen, contenido, url."""
    name, number, year = formal_type(doc["tipo"]), F.coalesce(doc["numero"], F.lit("None")), F.coalesce(doc["anio"].cast("string"), F.lit("None"))
    quote = F.substring(F.coalesce(F.nullif(doc["resumen"], F.lit("")), doc["contenido"], F.lit("")), 1, 400)
    when = F.coalesce(F.nullif(doc["fecha"], F.lit("")), year)
    subject = F.coalesce(F.nullif(doc["materia"], F.lit("")), F.lit("normativa tributaria"))
    ref, url = F.coalesce(F.nullif(doc["referencia"], F.lit("")), F.concat(name, F.lit(" "), number)), F.coalesce(doc["url"], F.lit("None"))
    court = doc["tipo"] == "judicial"

    def text(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    return {
        "cita_corta": F.when(court, ref).otherwise(text(name, " N", number, " de ", year, " del SII")),
        "cita_media": F.when(court, text("Conforme a lo resuelto en ", ref)).otherwise(
            text("Conforme a lo señalado por el SII en ", name, " N", number, " de ", year, ", en materia de ", subject)
        ),
        "cita_larga": F.when(court, text("En ", ref, ", de fecha ", when, ', se sostuvo que: "', quote, '..."')).otherwise(
            text("En virtud de lo establecido en ", name, " N", number, " de fecha ", when, ", emanada del Servicio de Impuestos Internos, en materia de ", subject, ', dicho organismo ha señalado que: "', quote, '..."')
        ),
        "cita_escrito": F.when(
            court,
            text("En apoyo de lo expuesto, cabe citar ", ref, ', donde se razona que: "', quote, '...". El texto integro y su respaldo documental se encuentran disponibles en ', url, ". "),
        ).otherwise(
            text("En este contexto, cabe traer a colación lo señalado por el SII en su ", name, " N", number, " de ", year, " (ref. ", F.coalesce(doc["referencia"], F.lit("None")), '), donde se establece que: "', quote, '...". Dicha instruccion administrativa se encuentra disponible en ', url, ". ")
        ),
    }


def clean_paragraphs(c: Column) -> Column:
    """No blanks before line ends, at most one empty line."""
    return strip(F.regexp_replace(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?U)\s+\n", "\n"), r"\n{3,}", "\n\n"))


def evidence(c: Column, most: int = 3) -> Column:
    """The first paragraphs of 120 characters and more, distinct by their first 160, cut at 500, labelled."""
    text = clean_paragraphs(c)
    parts = F.filter(F.transform(F.split(text, r"\n{2,}"), collapse), lambda x: F.length(x) >= 120)
    first = first_of_each(parts, lambda x: F.substring(x, 1, 160))
    return F.transform(F.slice(first, 1, most), lambda x, i: F.struct(F.concat(F.lit("Cita "), (i + 1).cast("string")).alias("label"), F.substring(x, 1, 500).alias("excerpt")))


def first_object(c: Column) -> Column:
    """From the first opening to the last closing brace, if that is JSON; else null."""
    return F.try_parse_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")))


def json_list(c: Column) -> Column:
    """An array of texts; empty where the text is no JSON array."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def unique_list(values: Column) -> Column:
    """White space collapsed, no empty ones, the first of each regardless of case."""
    return first_of_each(F.filter(F.transform(values, collapse), lambda x: x != ""), F.lower)


def slashes(c: Column) -> Column:
    """T30."""
    return F.replace(c, F.lit("\\"), F.lit("/"))


def api_summary(c: Column, most: int = 180) -> Column:
    """T31."""
    return F.substring(collapse(F.regexp_replace(F.coalesce(c, F.lit("")), "<br ?/?>|</?p>", " ")), 1, most)


def pages_estimate(c: Column) -> Column:
    """M01."""
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / 2800))).cast("int")


def relevance(rank: Column) -> Column:
    """M02, as the reference has it: the better the (negative) rank, the lower."""
    return F.round(1 / (1 + F.abs(F.coalesce(rank, F.lit(0.0)))), 4)


def looks_scanned(text: Column, images: Column) -> Column:
    """Images, and little text."""
    t = collapse(text)
    return (images > 0) & ((F.length(t) < 700) | (F.size(F.regexp_extract_all(t, F.lit("[A-Za-z0-9]{4,}"), 0)) < 90))


def type_folder(tipo: Column) -> Column:
    """T32."""
    t = F.lower(strip(F.coalesce(tipo, F.lit(""))))
    return (
        F.when(t.isin("circular", "circulares", "circular_historica", "circulares_historicas"), "circular")
        .when(t.isin("oficio", "oficios", "oficio_iva", "oficio_lir", "oficio_otras"), "oficio")
        .when(t.isin("resolucion", "resoluciones"), "resolucion")
        .when(t.isin("judicial", "jurisprudencia_judicial"), "judicial")
        .otherwise(safe_segment(F.coalesce(F.nullif(t, F.lit("")), F.lit("otros"))))
    )


def category_folder(tipo: Column, category: Column) -> Column:
    """Null but for offices of a known branch."""
    t, c = F.lower(strip(F.coalesce(tipo, F.lit("")))), F.lower(strip(F.coalesce(category, F.lit(""))))
    return F.when(
        type_folder(tipo) == "oficio",
        F.when(c.isin("oficio_lir", "lir", "renta") | (t == "oficio_lir"), "lir")
        .when(c.isin("oficio_iva", "iva") | (t == "oficio_iva"), "iva")
        .when(c.isin("oficio_otras", "otras", "otras_normas", "otras normas") | (t == "oficio_otras"), "otras_normas"),
    )


def file_path(tipo: Column, year: Column, name: Column, category: Column) -> Column:
    """T32."""
    return F.concat_ws("/", F.lit("pdfs"), type_folder(tipo), category_folder(tipo, category), year.cast("string"), name)
