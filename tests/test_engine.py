from leafquarry.engine import Engine
from leafquarry.operators.catalog import Search
from leafquarry.plans.domain import Tables


def test_engine_surface(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    e = Engine(spark, t.docs, t.articulos_idx, t.judicial_docs, t.judicial_relaciones, log=t.scraper_log, cases=t.casos, notes=t.caso_notas)
    s = Search(text="thing LIR", ley="LIR")
    scanned = [(r.id, round(r.rank, 9)) for r in e.matches(s).collect()]
    e.use_postings(str(tmp_path), rebuild=True)
    assert sorted(scanned) == sorted((r.id, round(r.rank, 9)) for r in e.matches(s).collect()) != []
    assert e.total(s).first().total >= e.search(s).count() > 0
    assert e.record(Search(fuente="src1")) is None and e.record(s).first().termino == "thing LIR"
    page = e.document(7)
    assert page["doc"].count() == 1 and page["related"].count() <= 8 and page["history"].filter("id = 7").count() == 0
    assert {r.id for r in e.by_article("lir", "Art. 13").collect()} >= {12}
    assert e.cite(3).first().cita_corta.startswith("Ref ")
    answer = e.ask("thing pathetic")
    assert answer.first().confianza == "media" and e.ask("zzzzqqqq").first().confianza == "baja"
    told = e.ask("thing pathetic", model=lambda question, context: f"{question}: {context[:13]}").first()
    assert (told.respuesta, told.confianza) == ("thing pathetic: --- DOCUMENTO", "alta")
    failed = e.ask("thing pathetic", model=lambda question, context: 1 / 0).first()
    assert failed.confianza == "media" and "ZeroDivisionError" in failed.nota and failed.fuentes > 0
    parts = e.dashboard("2024-01-15")
    assert parts["totals"].first().total == 200 and all(d.count() >= 0 for d in parts.values())
