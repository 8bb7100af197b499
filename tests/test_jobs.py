"""Sources by key and year, upserts by partition, the judicial loop, progress and stop, windows with late rows."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from leafquarry.operators import ingest
from leafquarry.plans.domain import Tables
from leafquarry.plans.ingest import base, batch
from leafquarry.sources import api_source
from leafquarry.streaming import judicial, progress, windows

BODIES = {
    ("IVA", 2020): '[{"a": 1}, {"a": "ñ"}]', ("IVA", 2021): '{"metaData": {"errors": [{"c": 5}, "no"]}, "data": [1]}', ("IVA", 2022): '{"metaData": {}, "data": {"x": 1}}',
    ("RENTA", 2020): "[broken", ("RENTA", 2021): "", ("RENTA", 2022): '{"data": null}', ("OTROS", 2020): b'{"metaData": {"errors": "one"}, "data": []}',
}
WANTED = [
    ("IVA", 2020, 0, '{"a":1}', None), ("IVA", 2020, 1, '{"a":"ñ"}', None), ("IVA", 2021, None, None, '{"c":5}'), ("IVA", 2021, None, None, "no"), ("IVA", 2022, 0, '{"x":1}', None),
    ("RENTA", 2020, None, None, "no es JSON"), ("OTROS", 2020, None, None, "one"),
]


def answer(key, year):
    if (key, year) not in BODIES:
        raise TimeoutError("no answer")
    return BODIES[key, year]


def test_api_source(spark):
    spark.dataSource.register(api_source.ApiSource)
    read = spark.read.format("office_api").options(keys="IVA, RENTA,OTROS", years="2020-2022", transport="tests.test_jobs:answer").load()
    assert read.rdd.getNumPartitions() == 9
    failed = [("OTROS", y, None, None, "TimeoutError: no answer") for y in (2021, 2022)]
    assert sorted(map(str, map(tuple, read.collect()))) == sorted(map(str, WANTED + failed))


def test_landed_answers_are_unpacked_alike(spark):
    rows = [(k, y, b.decode() if isinstance(b, bytes) else b) for (k, y), b in BODIES.items()] + [("x", 1, None)]
    got = api_source.landed(spark.createDataFrame(rows, "key string, year int, body string"), "body", "key", "year").collect()

    def plain(r):
        return (r[0], r[1], r[2], r[3] if r[3] is None else json.dumps(json.loads(r[3])), r[4] if r[4] is None or r[4][0] != "{" else json.dumps(json.loads(r[4])))

    assert sorted(str(plain(r)) for r in got) == sorted(str(plain(r)) for r in WANTED)


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "docs")
    current = base(t).drop("id")
    current.write.partitionBy("tipo", "anio").parquet(path)

    def files():
        return {p.relative_to(path).parent.as_posix(): sorted(f.name for f in p.parent.glob("*.parquet")) for p in (tmp_path / "docs").rglob("*.parquet")}

    def state(d):
        return sorted(str(tuple(r)) for r in d.select("hash_md5", "tipo", "numero", "anio", "contenido", "pdf_local", "paginas", "fuente").collect())

    few = batch(t).filter("anio IN (2000, 2001) OR anio IS NULL")
    before, wanted = files(), state(ingest.upserted(current, few))
    told = ingest.upsert_into(spark, path, few)
    after = files()
    assert state(spark.read.parquet(path)) == wanted and told["changed"] + told["new"] > 0
    moved = {p for p in before | after if before.get(p) != after.get(p)}
    assert len(moved) == told["partitions"] and all("anio=2000" in p or "anio=2001" in p or "HIVE_DEFAULT" in p for p in moved)
    assert ingest.upsert_into(spark, path, few)["new"] == 0 and state(spark.read.parquet(path)) == wanted
    assert ingest.upsert_into(spark, path, few.limit(0)) == {"changed": 0, "new": 0, "partitions": 0}


def detail(k, text="<p>Sentencia</p>", law="Ley A", **others):
    parts = {"nota": None, "articulo": {"nombre": f"Art {k}", "tituloBO": {"cuerpoNormativo": {"nombre": law}}}}
    return {"id": k, "fecha": "2020-05-06T00:00", "codigoPronunciamiento": f"R-{k}", "contenido": {"sentenciaRaw": text, "resumenInternet": None}, "articulos": [parts, parts], **others}


@pytest.mark.parametrize("sink", judicial.SINKS)
def test_judicial_loop_after_a_failure(spark, tmp_path, sink):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "1.json").write_text("\n".join(json.dumps(x) for x in (detail(1), detail(2), detail(2), detail(3, text=" "), detail(4, fecha="x"))))
    args = (str(landing), str(tmp_path / "out"), str(tmp_path / "cp"))

    def run(**options):
        query = judicial.start_judicial(spark, *args, **options)
        try:
            query.awaitTermination(120)
        except Exception as e:
            assert "after" in str(e)
        return {s: sorted(str(tuple(r)) for r in judicial.latest(spark, args[1], s).collect()) for s in judicial.SINKS if (tmp_path / "out" / s).exists()}

    run(fail_after=sink)
    state = run()
    assert [len(state[s]) for s in judicial.SINKS] == [3, 3, 3, 4]
    assert sorted(tuple(r) for r in judicial.report(spark, args[1]).collect()) == [(1900, 1, 1, 0), (2020, 3, 2, 1)]
    if sink == "documentos":
        (landing / "2.json").write_text(json.dumps(detail(2, text="<b>otra</b>", law="Ley B")))
        state = run()
        assert [len(state[s]) for s in judicial.SINKS] == [3, 3, 3, 4] and "Ley B" in "".join(state["judicial_relaciones"]) and "otra" in "".join(state["documentos"])


def test_progress_buffer():
    p = progress.Progress()
    for k in range(700):
        p.push(f"{('OK', 'WARN', 'Nuevo', 'x')[k % 4]} {k}", total=9)
    told = p.drained()
    # cut to the last 300 at the 501st message; 199 follow
    assert (told["nuevos"], told["errores"], told["procesados"], told["total"]) == (350, 175, 700, 9)
    assert [m["msg"].split()[1] for m in told["messages"]] == [str(k) for k in range(201, 700)]
    assert p.drained()["messages"] == [] and p.drained()["procesados"] == 700


def test_job_obeys_stop(spark):
    told = progress.Progress()
    listener = progress.ProgressListener(told, "rates")
    spark.streams.addListener(listener)
    seen, job = [], progress.Job(spark, told)

    def work(j):
        query = spark.readStream.format("rate").option("rowsPerSecond", 5).load().writeStream.queryName("rates").foreachBatch(lambda d, n: seen.append(n)).start()
        assert j.follow(query) is False

    assert job.start(work) and not job.start(work)
    until = time.time() + 60
    while not seen and time.time() < until:
        time.sleep(0.2)
    assert job.status()["running"]
    job.stop()
    assert job.wait(60) and not any(q.name == "rates" for q in spark.streams.active) and not job.status()["running"]
    assert job.start(lambda j: 1 / 0) and job.wait(10)
    assert job.status()["messages"][-1]["msg"].startswith("Error")
    spark.streams.removeListener(listener)


def test_sessions_of_a_stream_count_late_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, rows in enumerate([[("a", "10:00"), ("a", "10:05"), ("b", "10:00")], [("a", "14:00"), ("c", "13:30")], [("d", "14:01")], [("a", "10:01"), ("c", "13:35")], [("z", "20:00")], [("z", "20:01")]]):
        file = tmp_path / "in" / f"{k}.json"
        file.write_text("\n".join(json.dumps({"k": x, "ts": f"2024-01-01 {at}:00"}) for x, at in rows))
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))
    query = windows.start_sessions(spark, str(tmp_path / "in"), "k string, ts timestamp", str(tmp_path / "out"), str(tmp_path / "cp"), "ts", ["k"], "10 minutes", "1 hour")
    query.awaitTermination(120)
    assert query.exception() is None and windows.late_rows(query) == 1
    got = sorted((r.k, r.start.strftime("%H:%M"), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "10:00", 2), ("a", "14:00", 1), ("b", "10:00", 1), ("c", "13:30", 2), ("d", "14:01", 1)]


def test_best_variant_stops(spark):
    from leafquarry.functions.text import best_variant

    rows = [(["a b", "palabra " * 9, "palabra " * 100, "palabra " * 200],), (["??", "abc", "abd"],), ([],), (None,), ([None, ""],)]
    got = [r.b for r in spark.createDataFrame(rows, "v array<string>").select(best_variant(F.col("v")).alias("b")).collect()]
    assert [(b.variante, b.puntaje) if b else None for b in got] == [(2, 401), (1, 5), None, None, (0, 0)]
