"""Records of court decisions, circulars and offices assembled from their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafquarry.functions import dates, refs
from leafquarry.functions.text import collapse, formal_type, pages_estimate, repaired, safe_slug, strip, summary


def _given(c: Column) -> Column:
    """White space collapsed, null for nothing."""
    return F.nullif(collapse(c), F.lit(""))


def first_line(c: Column) -> Column:
    return F.nullif(F.element_at(F.split(c, "\n"), 1), F.lit(""))


def court_title(d: dict[str, Column]) -> Column:
    """From the code, its kind and the parties, else the summary's or extract's first line. d: tipo_codigo, codigo, partes,
    instancia, resumen, extracto, id."""
    kind, code, sides, court = (_given(d[k]) for k in ("tipo_codigo", "codigo", "partes", "instancia"))
    named = F.concat(kind, F.lit(" "), code)
    tries = [F.concat(named, F.lit(" - "), sides), named, F.concat(F.lit("Rol "), code, F.lit(" - "), court), first_line(d["resumen"]), first_line(d["extracto"])]
    return F.substring(F.coalesce(*tries, F.concat(F.lit("Jurisprudencia Judicial SII "), d["id"].cast("string"))), 1, 500)


def court_reference(d: dict[str, Column]) -> Column:
    """T22. d: instancia, tipo_pronunciamiento, tipo_codigo, codigo, fecha, partes."""
    kind, code = _given(d["tipo_codigo"]), _given(d["codigo"])
    number = F.coalesce(F.concat(kind, F.lit(" "), code), F.concat(F.lit("Rol "), code))
    return F.substring(F.concat_ws(" | ", F.lit("Jurisprudencia Judicial SII"), _given(d["instancia"]), _given(d["tipo_pronunciamiento"]), number, _given(d["fecha"]), _given(d["partes"])), 1, 500)


#: Labels of a decision's head and the parts they show; fixed values.
HEAD = (
    ("Tipo Codigo", "tipo_codigo"), ("Codigo/Rol", "codigo"), ("Fecha", "fecha"), ("Instancia", "instancia"), ("Tipo de pronunciamiento", "tipo_pronunciamiento"),
    ("Partes", "partes"), ("RUC", "ruc"), ("Resultado", "resultado"), ("Decision", "decision"),
)


def court_content(d: dict[str, Column]) -> Column:
    """Labelled blocks, "Sin dato" where nothing is given. d: id, url, the parts of HEAD, leyes, articulos (arrays),
    extracto, resumen, sentencia."""
    none = F.lit("Sin dato")

    def or_none(c: Column) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), none)

    head = [F.concat(F.lit(f"{label}: "), F.coalesce(_given(d[k]), none)) for label, k in HEAD]
    blocks = [
        F.lit("JURISPRUDENCIA JUDICIAL SII\n"),
        F.concat(F.lit("ID SII: "), d["id"].cast("string")),
        *head,
        F.concat(F.lit("Fuente SII: "), d["url"]),
        F.lit("\nLEYES CITADAS"),
        or_none(F.array_join(d["leyes"], ", ")),
        F.lit("\nARTICULOS"),
        F.coalesce(F.nullif(F.array_join(F.transform(d["articulos"], lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("")), F.lit("- Sin articulos asociados")),
        F.lit("\nEXTRACTO"),
        or_none(d["extracto"]),
        F.lit("\nDESCRIPTORES"),
        or_none(d["resumen"]),
        F.lit("\nPRONUNCIAMIENTO COMPLETO"),
        F.coalesce(*[F.nullif(d[k], F.lit("")) for k in ("sentencia", "extracto", "resumen")], none),
    ]
    return strip(F.concat_ws("\n", *blocks))


def court_stem(d: dict[str, Column], year: Column) -> Column:
    """T33."""
    key = d["id"].cast("string")
    return F.concat(F.lit("judicial_"), year.cast("string"), F.lit("_"), safe_slug(d["tipo_codigo"], "DOC"), F.lit("_"), safe_slug(d["codigo"], key), F.lit("_id"), key)


def court_relations(details: DataFrame, key: str, items: str) -> DataFrame:
    """Law, article, note of each decision, the first spelling of each regardless of case. items: array of
    struct(nota, articulo struct(nombre, tituloBO struct(cuerpoNormativo struct(nombre))))."""
    rows = details.select(key, F.posexplode(items).alias("n", "x")).select(
        key, "n", collapse(F.col("x.articulo.tituloBO.cuerpoNormativo.nombre")).alias("cuerpo_normativo"), collapse(F.col("x.articulo.nombre")).alias("articulo"), collapse(F.col("x.nota")).alias("nota")
    )
    names = ["cuerpo_normativo", "articulo", "nota"]
    rows = rows.filter(F.concat(*names) != "")
    return rows.groupBy(key, *[F.lower(x).alias(f"k_{x}") for x in names]).agg(F.min(F.struct("n", *names)).alias("f")).select(key, "f.cuerpo_normativo", "f.articulo", "f.nota")


def discovered(links: DataFrame) -> DataFrame:
    """A year's documents by file name: their extensions, the longest title and description (the first of equal ones).

    links: anio, seq, href, titulo, descripcion."""
    name = F.element_at(F.split(F.regexp_replace("href", r"[?#].*$", ""), "/"), -1)
    rows = links.withColumns({"base": F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), "ext": F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))})
    rows = rows.filter(F.col("base").rlike(r"^(?:circu)?\d+[a-z]?$") & F.col("ext").isin("htm", "html", "pdf", "doc", "zip"))

    def longest(c: str) -> Column:
        return F.max_by(c, F.struct(F.length(F.coalesce(c, F.lit(""))), -F.col("seq"))).alias(c)

    return rows.groupBy("anio", "base").agg(F.array_join(F.array_sort(F.collect_set("ext")), ",").alias("extensiones"), longest("titulo"), longest("descripcion"))


def resolution_title(text: Column, number: Column) -> Column:
    """The first line in capitals of 21 to 199 characters among the first twenty."""
    lines = F.slice(F.transform(F.split(text, "\n"), strip), 1, 20)
    found = F.filter(lines, lambda x: F.length(x).between(21, 199) & (F.upper(x) == x) & x.rlike(r"\p{L}"))
    return F.coalesce(F.get(found, 0), F.concat(F.lit("Resolucion Exenta N"), number))


def modern_record(d: dict[str, Column]) -> dict[str, Column]:
    """What is kept of a downloaded document. d: tipo, numero, anio, titulo, fecha, texto, prefijo."""
    name = formal_type(F.element_at(F.split(d["tipo"], "_"), 1))
    return {
        "titulo": F.coalesce(_given(repaired(d["titulo"])), F.concat(name, F.lit(" N"), d["numero"])),
        "referencia": F.concat(name, F.lit(" N"), d["numero"], F.lit(" de "), d["anio"].cast("string")),
        "subtema": F.concat_ws(" - ", F.nullif(d["prefijo"], F.lit("")), _given(d["titulo"])),
        "fecha": dates.document_date(d["tipo"], d["fecha"], d["texto"], d["numero"], d["anio"]),
        "resumen": summary(d["texto"]),
        "leyes": refs.law_codes(d["texto"]),
    }


def historical_record(d: dict[str, Column]) -> dict[str, Column]:
    """A historical circular, read as text or from a scan. d: anio, numero, titulo, materia, texto, escaneado."""
    scanned = d["escaneado"]
    return {
        "titulo": F.coalesce(_given(d["titulo"]), F.concat(F.lit("Circular N"), d["numero"], F.lit(" de "), d["anio"].cast("string"))),
        "referencia": F.concat(F.lit("Circular N"), d["numero"], F.lit(" de "), d["anio"].cast("string")),
        "palabras_clave": F.concat_ws(" | ", _given(d["materia"]), F.lit("circular historica"), F.when(scanned, "ocr")),
        "resumen": F.coalesce(F.nullif(summary(d["texto"]), F.lit("")), _given(d["materia"])),
    }


def manual_record(d: dict[str, Column]) -> dict[str, Column]:
    """K14. d: titulo, contenido, referencia, leyes (JSON)."""
    given = refs.laws_in_order(F.coalesce(F.from_json(d["leyes"], "array<string>"), F.array().cast("array<string>")))
    return {
        "referencia": F.coalesce(F.nullif(d["referencia"], F.lit("")), F.concat(F.lit("Manual - "), d["titulo"])),
        "paginas": pages_estimate(d["contenido"]),
        "leyes": F.when(F.size(given) > 0, given).otherwise(refs.law_codes(d["contenido"])),
    }


def file_folder(name: Column) -> Column:
    """Where a file of that name belongs; null for names of no known kind."""
    year = F.regexp_extract(name, r"(?i)^(?:circular(?:_historica)?|oficio|resolucion|judicial)_(\d{4})_", 1)
    kind = F.lower(F.regexp_extract(name, r"(?i)^(circular|oficio|resolucion|judicial)", 1))
    return F.when(year != "", F.concat(F.lit("pdfs/"), kind, F.lit("/"), year))


def item_state(d: dict[str, Column]) -> Column:
    """The state of a historical item. d: encontrado, texto, formato, escaneado, guardado."""
    return (
        F.when(~d["encontrado"], "no_encontrado")
        .when(d["escaneado"] & (F.length(d["texto"]) < 250), "ocr_pendiente")
        .when(~d["escaneado"] & (d["formato"] == "doc") & (F.length(d["texto"]) < 120), "doc_pendiente")
        .when(F.length(d["texto"]) < 120, "procesamiento_fallido")
        .when(~d["guardado"], "error_bd")
        .when(d["escaneado"], F.concat(F.lit("ok_scan_"), d["formato"]))
        .otherwise(F.concat(F.lit("ok_"), d["formato"]))
    )


def report_line(year: Column, missing: Column, extra: Column) -> Column:
    """A year's line with at most twenty samples of each."""

    def some(c: Column) -> Column:
        return F.coalesce(F.nullif(F.array_join(F.slice(F.array_sort(c), 1, 20), ", "), F.lit("")), F.lit("-"))

    return F.concat(year.cast("string"), F.lit(": faltan "), some(missing), F.lit("; sobran "), some(extra))


def has_marker(c: Column, marker: str = "reso") -> Column:
    """The marker among the first 5000 characters, regardless of case."""
    return F.contains(F.lower(F.substring(F.coalesce(c, F.lit("")), 1, 5000)), F.lit(marker))


