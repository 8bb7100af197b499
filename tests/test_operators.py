import io
import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from leafquarry.functions import refs
from leafquarry.operators import catalog, ingest, retrieval
from leafquarry.operators.resolver import resolved
from leafquarry.sources import external, tables
from leafquarry.streaming import incremental

CASES = [
    ("Según el artículo 31 de la LIR, procede.", ["LIR:31"]),
    ("LIR: artículo 14 letra a y artículo 21", ["AMB:14 letra a", "AMB:21"]),
    ("Código Tributario, artículos 53 y 97 N° 2", ["CT:53"]),
    ("El artículo 2 del Código Tributario y el artículo 3 de la LIVS", ["CT:2", "LIVS:3"]),
    ("artículo 5 LIR", ["AMB:5"]),
    ("artículo 7 de la LIR; artículo 8", ["LIR:7", "AMB:8"]),
    ("artículo 31 de la LIR y artículo 31 de la LIR", ["LIR:31"]),
    ("artículo 2 de la Ley sobre Impuesto Territorial", ["LIT:2"]),
    ("artículo 97 N° 2 del D.L. 830", ["CT:97 N° 2"]),
    ("el artículo\n31 de la LIR", ["AMB:31"]),
    ("", []),
    (None, []),
]


def keys(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return {r.id: r.k for r in resolved(df, "id", "t").select("id", F.transform("refs", refs.key_of).alias("k")).collect()}


def test_resolver_cases(spark):
    got = keys(spark, [t for t, _ in CASES])
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]


def plain_resolver(text):
    """A straightforward version for texts of the words below."""
    out, laws = [], {"LIR": "LIR", "código tributario": "CT", "LIVS": "LIVS"}
    for segment in re.split("[\n;:]", text):
        tokens = [(m.start(), m[0]) for m in re.finditer(r"artículo \d+|LIR|LIVS|código tributario|\bdel?\b", segment)]
        for n, (_, t) in enumerate(tokens):
            if not t.startswith("artículo"):
                continue
            law, linked = None, False
            for _, x in tokens[n + 1 :]:
                if x.startswith("artículo"):
                    break
                if x in laws:
                    law = laws[x] if linked else None
                    break
                linked = True
            if law is None:
                law = next((laws[x] for _, x in reversed(tokens[:n]) if x in laws), None)
            key = f"{law or 'AMB'}:{t.split()[1]}"
            if key not in out:
                out.append(key)
    return out


def test_resolver_on_generated_sentences(spark):
    rng = random.Random(5)
    words = ["artículo 31", "artículo 8", "artículo 97", "LIR", "LIVS", "código tributario", "de la", "del", "y", "según", ";", ":", "\n", ","]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 18))) for _ in range(300)]
    got = keys(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == plain_resolver(t), t


def test_upsert_twice_changes_nothing(spark):
    schema = "hash_md5 string, tipo string, numero string, anio int, contenido string, pdf_local string, paginas int, chars_texto bigint, fuente string"
    rows = [(f"h{i}", "circular" if i % 2 else "oficio", str(i), 2000, "texto", "p", 1, 5, "x") for i in range(6)]
    now = spark.createDataFrame(rows[:3], schema)
    batch = spark.createDataFrame([(*r, n) for n, r in enumerate([*rows, ("new", "circular", "1", 2000, "otro", "p", 2, 4, "x"), (None, "circular", "9", 2000, "t", "p", 1, 1, "x")])], schema + ", seq int")
    once = ingest.upserted(now, batch)
    assert sorted(r.hash_md5 for r in once.collect()) == ["h0", "h2", "h3", "h4", "h5", "new"]
    assert sorted(map(str, ingest.upserted(once, batch).collect())) == sorted(map(str, once.collect()))
    assert ingest.upserted(now.limit(0), batch.limit(0)).count() == 0


def test_match_syntax():
    assert retrieval.parse("IVA servicios").phrases == (("iva",), ("servicios",))
    assert not retrieval.parse("a OR b").valid and not retrieval.parse("a-b").valid and not retrieval.parse('"iva servicio').valid
    assert retrieval.parse("N° gasto-norma").phrases == (("n",), ("gasto", "norma"))


def test_empty_question(spark):
    empty = spark.createDataFrame([], "place int, bloque string")
    assert retrieval.answer(empty, "").first().nota == "Debes ingresar una pregunta."


def test_related_equals_join(spark):
    rng = random.Random(2)
    index = spark.createDataFrame([(d, rng.choice(["A", "B"]), str(rng.randint(1, 3))) for d in range(60) for _ in range(2)], "doc_id bigint, ley string, articulo string")
    docs = spark.createDataFrame([(d, 2000 + d % 7) for d in range(60)], "id bigint, anio int")
    got = {}
    for r in catalog.related(docs, index).collect():
        got.setdefault(r.doc_id, []).append((r.place, r.other_id))
    pairs = {}
    for r in index.collect():
        pairs.setdefault(r.doc_id, set()).add((r.ley, r.articulo))
    for d, own in pairs.items():
        others = sorted((o for o, theirs in pairs.items() if o != d and own & theirs), key=lambda o: (-(2000 + o % 7), -o))[:8]
        assert [o for _, o in sorted(got.get(d, []))] == others


def test_zip_members(spark):
    def archive(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, n)
        return out.getvalue()

    rows = [("a", archive("x.htm", "b.doc", "c.PDF")), ("b", archive("x.txt")), ("c", b"no"), ("d", None)]
    got = {r.path: r.name for r in external.zip_members(spark.createDataFrame([(p, bytearray(c) if c else None) for p, c in rows], "path string, content binary")).collect()}
    assert got == {"a": "c.PDF", "b": None, "c": None, "d": None}


def test_fetch_with_retries(spark):
    def get(url):
        if url == "gone":
            return 404, b""
        if url == "bad":
            raise OSError
        return 200, url.encode() * 3

    urls = spark.createDataFrame([("ok",), ("gone",), ("bad",), ("",)], "url string")
    got = {r.url: (r.status, r.content) for r in external.fetched(urls, get, least=1, delay=0).collect()}
    assert got["ok"][0] == 200 and bytes(got["ok"][1]) == b"okokok" and got["gone"] == (404, None) and got["bad"] == (0, None) and got[""] == (200, None)


def test_files_and_reports(spark, tmp_path):
    (tmp_path / "tree/a").mkdir(parents=True)
    (tmp_path / "tree/a/circular_2001_7.PDF").write_bytes(b"%PDF-1.4")
    (tmp_path / "tree/t.txt").write_bytes("señal".encode("cp1252"))
    listed = {r.name: (r.extension, r.length) for r in tables.file_listing(spark, str(tmp_path / "tree")).collect()}
    assert listed == {"circular_2001_7.PDF": (".pdf", 8), "t.txt": (".txt", 5)}
    read = spark.read.format("binaryFile").load(str(tmp_path / "tree/t.txt")).select(tables.decoded_text(F.col("content")).alias("t"))
    assert read.first().t == "señal"
    df = spark.createDataFrame([(1, None)], "id int, nota string")
    external.write_csv(df, str(tmp_path / "csv"))
    assert tables.read_candidates(spark, str(tmp_path / "csv")).columns == ["id", "nota"]
    external.write_report(df, str(tmp_path / "json"))
    assert json.loads(next((tmp_path / "json").glob("part-*")).read_text()) == {"id": 1, "nota": None}
    external.append_log(df, str(tmp_path / "log"))
    external.append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    made = tables.empty_tables(spark, {"x": "id int", "y": "id int"}, {"x": df})
    assert made["x"].count() == 1 and made["y"].columns == ["id"]


def test_stream_ingests_once(spark, tmp_path):
    """Outcomes of three landings are those of a sequential reading; a run reads what landed and what the last one stored."""
    schema = "seq int, hash_md5 string, tipo string, numero string, anio int, url_sii string"
    names = [x.split()[0] for x in schema.split(", ")]
    landing, target, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    landing.mkdir()

    def land(file, rows):
        if file:
            (landing / file).write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))
        query = incremental.start_ingest(spark, str(landing), schema, target, str(tmp_path / "cp"), log)
        query.awaitTermination(120)
        assert query.exception() is None and incremental.status(query)["active"] is False
        said = {r.seq: r.outcome for r in spark.read.parquet(log).collect()} if (tmp_path / "log").exists() else {}
        return sorted(r.seq for r in spark.read.parquet(target).collect()), said, sum(p["numInputRows"] for p in query.recentProgress)

    assert land("1.json", [(1, "a", "c", "1", 2000, "u1"), (2, "a", "c", "2", 2000, "u2"), (3, "b", "c", "3", 2000, "u3")])[:2] == ([1, 3], {1: "nuevo", 2: "repetido", 3: "nuevo"})
    have, said, _ = land("2.json", [(4, "z", "c", "1", 2000, "u9"), (5, "y", "o", None, None, "u3"), (6, "b", "o", None, None, "u8"), (7, "n", "o", None, None, "u7")])
    assert have == [1, 3, 7] and [said[k] for k in (4, 5, 6, 7)] == ["identidad", "url", "hash", "nuevo"]
    # what was turned away left no key behind: z, u9 and the identity of 2 are free
    have, said, read = land("3.json", [(8, "z", "c", "8", 2000, "u9"), (9, "w", "c", "2", 2000, "u2"), (10, None, "o", None, None, None)])
    assert have == [1, 3, 7, 8, 9, 10] and said[8] == said[9] == said[10] == "nuevo"
    assert read <= 3 + 1  # the landing and what the second run stored
    assert land(None, [])[0] == have
    for k in range(40):
        (landing / f"more{k}.json").write_text(json.dumps(dict(zip(names, (100 + k, f"h{k}", "o", None, None, f"v{k}"), strict=True))))
    assert len(land(None, [])[0]) == len(have) + 40
    assert land("last.json", [(200, "h3", "o", None, None, "x")])[1:] == ({**said, **{100 + k: "nuevo" for k in range(40)}, 200: "hash"}, 1 + 40)


def test_stream_batch_again(spark, tmp_path, monkeypatch):
    """A batch that failed after it had stored its rows is run again and adds nothing twice."""
    schema = "seq int, hash_md5 string, tipo string, numero string, anio int, url_sii string"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"seq": 1, "hash_md5": "a", "tipo": "o", "url_sii": "u1"}\n{"seq": 2, "hash_md5": "b", "tipo": "o", "url_sii": "u2"}')
    args = (str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    incremental.start_ingest(spark, *args).awaitTermination(120)
    commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"))
    for f in commits:
        f.unlink()
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    again = incremental.start_ingest(spark, *args)
    again.awaitTermination(120)
    assert again.exception() is None and sorted(r.seq for r in spark.read.parquet(args[2]).collect()) == [1, 2]


def test_stream_daily_counts(spark, tmp_path):
    log = spark.sql("SELECT timestamp_ntz'2024-01-01 10:00:00' + make_interval(0, 0, 0, cast(id as int)) AS fecha, 'ok' AS estado FROM range(6)")
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    incremental.start_daily_counts(spark, str(tmp_path / "log"), "fecha timestamp_ntz, estado string", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted((str(r.day), r.cnt) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[:3] == [("2024-01-01", 1), ("2024-01-02", 1), ("2024-01-03", 1)]


@pytest.mark.parametrize("fields", [{"fuente": "x"}, {"fuente": "x", "text": "q"}])
def test_recorded_searches(fields):
    assert catalog.Search(**fields).recorded() == ("text" in fields)
