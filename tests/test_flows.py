"""Whole runs on small cases: what a second run, a broken source and another order of days change."""

import datetime
import hashlib

import pytest
from pliegos.functions import text
from pliegos.operators import postings
from pliegos.plans import catalogue, daily, dataflow, enrichment, flows
from pliegos.sources import gazette, notices
from pyspark.sql import functions as F


def day(d):
    return datetime.date(2026, 1, d)


def kept(spark, df):
    return spark.createDataFrame(df.collect(), df.schema)


def test_a_second_run_reads_only_days_that_could_not_be_read(spark, sf_dir):
    payloads, texts = catalogue._run_fixture(catalogue.Tables(spark, sf_dir))
    payloads = payloads.unionByName(spark.createDataFrame([(day(20), 0, "{broken"), (day(21), 0, None)], "fecha date, parte long, payload string"))
    shape = dataflow.candidates(gazette.flatten_summary(payloads.limit(0)), texts.limit(0))
    first = flows.run_days(payloads, texts, spark.createDataFrame([], shape.schema), spark.createDataFrame([], flows.RUN))
    documents, runs = kept(spark, first.documents), kept(spark, first.runs)
    assert {r.fecha: (r.status, r.errors) for r in runs.where("errors > 0").collect()} == {day(20): ("failed", 1), day(21): ("failed", 1)} and documents.count() > 0
    second = flows.run_days(payloads, texts, documents, runs)
    assert second.documents.count() == documents.count() and second.skipped.count() == 10
    assert {r.fecha for r in second.runs.collect()[runs.count() :]} == {day(20), day(21)}
    forced = flows.run_days(payloads, texts, documents, runs, force=True)
    assert forced.documents.count() == documents.count() and forced.runs.count() == 2 * runs.count()


def test_a_text_that_was_missing_is_filled(spark):
    payload = '{"data":{"sumario":{"diario":{"seccion":{"codigo":"3","departamento":{"epigrafe":{"item":{"identificador":"A","titulo":"Diligencia de embargo"}}}}}}}}'
    payloads = spark.createDataFrame([(day(1), payload)], "fecha date, payload string")
    texts = spark.createDataFrame([("A", "")], "identificador string, texto string")
    shape = dataflow.candidates(gazette.flatten_summary(payloads.limit(0)), texts.limit(0))
    first = flows.run_days(payloads, texts, spark.createDataFrame([], shape.schema), spark.createDataFrame([], flows.RUN))
    documents = kept(spark, first.documents)
    assert [(r.texto_plano, r.hash_texto) for r in documents.collect()] == [("", None)]
    told = spark.createDataFrame([("A", "NIF 12345678Z")], "identificador string, texto string")
    second = flows.run_days(payloads, told, documents, kept(spark, first.runs), force=True)
    want = hashlib.sha256(b"NIF 12345678Z").hexdigest()
    assert [(r.texto_plano, r.hash_texto, r.extracto) for r in second.documents.collect()] == [("NIF 12345678Z", want, "NIF 12345678Z")]
    index = kept(spark, dataflow.indexed(documents))
    merged = dataflow.into_index(index, dataflow.indexed(second.documents)).collect()
    assert [(r.extracto, r.hash_texto, r.identificadores) for r in merged] == [("NIF 12345678Z", want, ["12345678Z"])]


def summary(*ids):
    items = ",".join(f'{{"identificador":"{i}","titulo":"Diligencia de embargo"}}' for i in ids)
    return f'{{"data":{{"sumario":{{"diario":{{"seccion":{{"codigo":"3","departamento":{{"epigrafe":{{"item":[{items}]}}}}}}}}}}}}}}'


def test_a_backfill_stops_within_a_day_and_goes_on_with_the_day_before(spark):
    rows = [(day(3), summary("C1", "C2")), (day(2), "{broken"), (day(1), summary("A1", "C1", "A2"))]
    payloads = spark.createDataFrame(rows, "fecha date, payload string")
    texts = spark.createDataFrame([], "identificador string, texto string")
    shape = dataflow.indexed(dataflow.candidates(gazette.flatten_summary(payloads.limit(0)), texts, "backfill"))
    index, runs = spark.createDataFrame([], shape.schema), spark.createDataFrame([], flows.RUN)
    wanted = [({"C1"}, 1, False, 1), ({"C1", "A1"}, 1, True, 1)]
    for have, indexed, finished, seen in wanted:
        run = flows.run_backfill(payloads, texts, index, runs, "2026-01-01", "2026-01-03", 5, most_documents=1)
        index, runs = kept(spark, run.index), kept(spark, run.runs)
        assert ({r.doc_id for r in index.collect()}, run.indexed, run.finished, run.seen) == (have, indexed, finished, seen)
    assert {r.fecha: (r.status, r.errors) for r in runs.collect()} == {day(3): ("completed", 0), day(2): ("completed", 1), day(1): ("completed", 0)}
    assert flows.run_backfill(payloads, texts, index, runs, "2026-01-01", "2026-01-03", 5).finished


def test_a_branch_that_fails_leaves_the_others(spark, monkeypatch):
    payloads = spark.createDataFrame([(day(1), summary("A", "B"))], "fecha date, payload string")
    texts = spark.createDataFrame([("A", "NIF 12345678Z"), ("B", "nada")], "identificador string, texto string")
    none = spark.createDataFrame([], "fecha date, html string")
    clients = spark.createDataFrame([(1, None, "12345678z", None, "Ana", "activo")], "cliente_id long, cif_nif string, dni_nie string, matriculas array<string>, nombre string, estado string")
    links = spark.createDataFrame([], "vinculo_id long, cliente_id long, identificador string, tipo_persona string, nombre string, rol string")

    def broken(documents):
        return documents.select("doc_id", F.raise_error(F.lit("no service")).cast("string").alias("identificador"))

    def run(state, extractor):
        return daily.run(state, payloads, texts, none, texts.limit(0), clients, links, extractor, 5, force=True)

    first = run(daily.empty_state(spark), broken)
    assert [(r.source, r.fecha) for r in first["quarantine"].collect()] == [("extraction", None)]
    assert first["documents"].count() == 2 and first["cases"].count() == 0 and [r.status for r in first["runs"].collect()] == ["completed"]
    assert [(r.tipo, r.cliente_id, r.titulo) for r in first["notifications"].collect()] == [("nueva_sancion_cliente", 1, "Nueva sanción de cliente: Ana")]

    def named(documents):
        return documents.select("doc_id", F.lit("12345678-Z").alias("identificador"), F.lit("Ana").alias("nombre"), F.lit(1234.5).alias("importe_multa"), F.lit("E1").alias("expediente"))

    second = run(first, named)
    third = run(second, named)
    for name in ("documents", "index", "cases", "activities", "notifications", "results"):
        assert third[name].count() == second[name].count(), name
    assert sorted((r.codigo, r.cliente_id, r.estado) for r in third["cases"].collect()) == [("OP-2026-000001", 1, "cliente"), ("OP-2026-000002", 1, "cliente")]
    notes = [r for r in second["notifications"].collect() if r.tipo == "nueva_sancion"]
    assert [(r.titulo, r.mensaje) for r in notes] == [("Nueva sanción: Ana", "Multa: 1,234.50 EUR | Expediente: E1")] * 2
    assert {r.extraction_status for r in third["documents"].collect()} == {"completed"}


def test_stored_postings(spark, tmp_path):
    index = postings.Postings(spark, f"file://{tmp_path}/p", buckets=8)
    rows = [("a", ["x", "y", "x"], ["k1"]), ("b", ["y"], None), ("c", [], ["k1", "k2"])]
    docs = spark.createDataFrame(rows, "doc_id string, tokens array<string>, ids array<string>")
    fields = {"name": "tokens", "key": "ids"}
    assert index.add(docs, fields) == 3 and index.add(docs, fields) == 0 and index.segments() == [0]
    changed = spark.createDataFrame([("b", ["z", "x"], ["k2"]), ("d", ["x"], None)], docs.schema)
    assert index.add(changed.unionByName(docs.where("doc_id = 'a'")), fields) == 2 and index.segments() == [0, 1]

    def held(index, *asked):
        return sorted((r.field, r.token, r.doc_id, list(r.at)) for r in index.lookup(spark.createDataFrame(list(asked), "field string, token string")).collect())

    again = postings.Postings(spark, f"file://{tmp_path}/p", buckets=99)
    assert again.buckets == 8
    for i in (index, again):
        assert held(i, ("name", "x"), ("name", "y"), ("key", "x")) == [("name", "x", "a", [0, 2]), ("name", "x", "b", [1]), ("name", "x", "d", [0]), ("name", "y", "a", [1])]
    keys = spark.createDataFrame([(1, "k1"), (2, "k2"), (3, "zz")], "subject long, key string")
    assert sorted((r.subject, r.doc_id) for r in index.containing(keys, "key").collect()) == [(1, "a"), (1, "c"), (2, "b"), (2, "c")]
    assert {(r.token, r.docs) for r in index.frequencies(spark.createDataFrame([("name", "y")], "field string, token string")).collect()} == {("y", 2)}
    plan = index.lookup(spark.createDataFrame([("name", "x")], "field string, token string"))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]


def test_notice_index(spark):
    page = (
        '<li class="notif"><p>Antes</p> <a href="/a/not.php?id=BOE-N-2026-1">x</a></li><h5>Dep <i>uno</i></h5><li  class="notif">\n<p>Deuda <b>A</b></p><a href="https://h/not.php?id=BOE-N-2026-2">'
        '</li><h5>Dep dos</h5><li class="notif"><p>B</p><a href="/not.php?id=BOE-N-2026-3"></li><li class="notif"><p>otra vez</p><a href="/not.php?id=BOE-N-2026-2"></li>'
    )
    rows = notices.index_entries(spark.createDataFrame([(day(1), page), (day(2), None), (day(3), "")], "fecha date, html string")).collect()
    found = {r.identificador: (r.titulo, r.departamento_nombre, r.url_pdf) for r in rows}
    assert found == {
        "BOE-N-2026-1": ("Antes", "", "/a/not.php?id=BOE-N-2026-1"), "BOE-N-2026-2": ("Deuda A", "Dep uno", "https://h/not.php?id=BOE-N-2026-2"), "BOE-N-2026-3": ("B", "Dep dos", "/not.php?id=BOE-N-2026-3"),
    }


def test_fixture_search_keeps_to_its_days(spark):
    rows = spark.createDataFrame([("K", "1", "t", day(1)), ("K", "2", "t", day(5)), ("L", "3", "t", day(3))], "key string, identificador string, titulo string, fecha_publicacion date")
    found = notices.FixtureSearch(rows).search(spark.createDataFrame([(7, "K")], "subject_id long, key string"), "2026-01-01", "2026-01-04").collect()
    assert [(r.subject_id, r.identificador) for r in found] == [(7, "1")]


def test_summaries_with_null_members_and_single_objects(spark):
    one = '{"data":{"sumario":{"diario":{"numero":"1","seccion":{"codigo":"3","departamento":[{"epigrafe":{"item":{"identificador":"A","titulo":"t"}}},{"epigrafe":{"item":null}},{"epigrafe":null}]}}}}}'
    rows = gazette.flatten_summary(spark.createDataFrame([(day(1), one), (day(2), "null"), (day(3), None)], "fecha date, payload string")).collect()
    assert [(r.identificador, r.seccion_codigo) for r in rows] == [("A", "3")]


def test_broken_xml_is_read_leniently_and_pages_by_their_container(spark):
    xml = ["<d><texto>uno <b>dos</b></texto><otro>x</otro><texto>tres</texto></d>", "<d><a>uno</a></d>", "<d><texto>uno &amp; <b>dos</texto><x>", "no xml <", None]
    out = spark.createDataFrame(list(enumerate(xml)), "k int, x string").select("k", gazette.xml_text("x").alias("t")).orderBy("k").collect()
    assert [r.t for r in out] == ["uno dos tres", "uno", "uno & dos", "no xml", ""]
    html = ['<nav>menu</nav><main>m<p>uno</p></main><div class="a content">c</div>', '<main>m</main><div id="texto">dos<script>x</script><br>tres</div>', "<main> </main><p>todo</p>", "<p>sin", None]
    out = spark.createDataFrame(list(enumerate(html)), "k int, x string").select("k", gazette.html_text("x").alias("t")).orderBy("k").collect()
    assert [r.t for r in out] == ["m uno", "dos tres", "todo", "sin", ""]


PARTY = "case_id long, nombre string, identificador string, localidad string, provincia string, contacto_estado string"


def test_queries_of_parties(spark):
    rows = [(1, "ACME SL", "B1", "Vigo", "P", None), (2, "B12345674", "B12345674", None, None, None), (3, "b12345674", "B12345674", None, "Lugo", None), (4, "X", None, None, None, "manual"), (5, " ", None, None, "", None)]
    out = enrichment.queries(spark.createDataFrame(rows, PARTY)).orderBy("case_id").collect()
    assert [(r.query, r.status) for r in out] == [("ACME SL Vigo", None), ("B12345674", "sin_datos"), ("B12345674 Lugo", None), ("X", "omitido"), ("", "no_encontrado")]


def test_only_pages_with_evidence_give_contacts_and_foreign_sites_give_none(spark):
    asked = spark.createDataFrame([(1, "Acme SL", "B12345674", "q")], "case_id long, nombre string, identificador string, query string")
    candidates = spark.createDataFrame(
        [("q", 1, "https://ocu.org/acme", "Acme SL", "tel 911111111"), ("q", 2, "https://www.infoempresa.com/acme", "Acme SL", "932203858 a@acme.es"), ("q", 3, "https://acme.es/?utm_x=1", "", ""), ("q", 4, "https://otra.es/", "Otra", "600000000")],
        "query string, ord int, url string, title string, snippet string",
    )
    pages = spark.createDataFrame([("https://acme.es/", "ACME, S.L. no; acme sl 933333333 https://x.com/acme"), ("https://otra.es/", "944444444")], "url string, html string")
    found = {r.field: (r.value, r.confidence) for r in enrichment.found_fields(asked, candidates, pages).collect()}
    assert found == {"telefono": ("933333333", 0.6), "email": ("a@acme.es", 0.6), "web": ("https://acme.es", 0.6), "twitter_url": ("https://x.com/acme", 0.6)}


def test_a_run_writes_only_the_fields_it_owns(spark):
    detail = "map<string, struct<value: string, url: string, confidence: double>>"
    columns = ", ".join(f"{f} string" for f in enrichment.FIELDS)
    old = [(1, "encontrado", {"telefono": ("1", "u", 0.6), "web": ("w", "u", 0.6)}, "1", None, "hand", "w", None, None, None, None), (2, "manual", None, "9", *[None] * 7)]
    parties = spark.createDataFrame(old, f"case_id long, contacto_estado string, contacto_detalle {detail}, {columns}")
    tried = spark.createDataFrame([(1, "encontrado"), (2, "omitido")], "case_id long, status string")
    fields = spark.createDataFrame([(1, "telefono", "2", "v", 0.9), (1, "email", "new", "v", 0.9), (1, "linkedin_url", "l", "v", 0.9)], "case_id long, field string, value string, url string, confidence double")
    rows = {r.case_id: r for r in enrichment.applied(parties, tried, fields).collect()}
    assert (rows[1].telefono, rows[1].email, rows[1].web, rows[1].linkedin_url) == ("2", "hand", None, "l")
    assert set(rows[1].contacto_detalle) == {"telefono", "linkedin_url"} and rows[1].contacto_detalle["telefono"].value == "2"
    assert (rows[2].telefono, rows[2].contacto_estado, rows[2].contacto_detalle) == ("9", "manual", None)


def test_checklist_and_bounds(spark):
    c = F.lit(None).cast("string")
    out = spark.range(1).select(enrichment.missing_fields("contrato", {}, F.lit(None).cast("boolean"), c, c, F.lit(0.0), c).alias("x")).first().x
    assert out == ["plantilla", "EMISOR_NOMBRE", "EMISOR_CIF", "EMISOR_DIRECCION", "cliente.cif_nif", "cliente.direccion_fiscal", "precio"]
    from pliegos.operators import relational

    with pytest.raises(ValueError):
        relational.between(F.col("x"), 2, 1)
    with pytest.raises(ValueError):
        flows.run_backfill(spark.range(0), spark.range(0), spark.range(0), spark.range(0), "2026-01-02", "2026-01-01", 1)
    assert spark.range(1).select(text.host(F.lit("x")).alias("h")).first().h == ""
