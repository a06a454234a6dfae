"""Desk operations and the prototype's scan on small cases."""

import datetime

from pliegos.operators import desk
from pliegos.plans import flows
from pliegos.sources import legacy
from pyspark.sql import functions as F


def test_contact_data_is_trimmed_and_checked(spark):
    cases = [(desk.PHONE, " +34 (91) 1.2/3 ", True), (desk.PHONE, "91a", False), (desk.PHONE, "1" * 51, False), (desk.EMAIL, "a@b.es", True), (desk.EMAIL, "a@b", False), (desk.URL, "ftp://x", False), (desk.URL, "  ", True), (desk.URL, None, True)]
    for form, value, valid in cases:
        r = spark.range(1).select(desk.checked(F.lit(value), form).alias("x")).first().x
        assert (r.valid, r.value) == (valid, (value or "").strip() or None)


def test_cases_without_data_are_left_out(spark):
    rows = [(1, None, "", "  ", None, None), (2, None, None, None, None, "x"), (3, "n", None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, nombre string, identificador string, expediente string, matricula_coche string, razon_sancion string")
    assert [r.id for r in desk.substantive(df).collect()] == [2, 3]


def test_extraction_is_capped_skips_what_is_done_and_bears_silence(spark):
    chosen = spark.createDataFrame([(k, k / 10, "t" * 40_000) for k in range(6)], "doc_id long, score double, texto string")
    done = spark.createDataFrame([(5,), (5,)], "doc_id long")
    out = {r.doc_id: r.facts for r in desk.extraction(chosen, done, lambda d: d.where("doc_id <> 4").select("doc_id", F.array(F.length("texto").cast("string")).alias("facts")), 3).collect()}
    assert out == {4: [], 3: ["30000"], 2: ["30000"]}
    assert {r.doc_id for r in desk.extraction(chosen, done, desk.nothing_extracted, 2, force=True).collect()} == {5, 4}


def test_backfill_plan(spark):
    d = datetime.date
    r = flows.backfill_plan(spark.createDataFrame([(d(2026, 1, 1), d(2026, 1, 11))], "first date, last date"), 5).first()
    assert (r.days, r.documents, r.candidates, r.runs) == (11, 3850, 440, 3)


def test_prototype_scan(spark):
    xml = "<s><titulo>S</titulo><sec><titulo>Uno</titulo><item><titulo>Multa a X</titulo><urlHtml>u1</urlHtml><organismo>O</organismo></item><item><titulo> </titulo></item></sec><item><titulo>Otra</titulo><departamento>D</departamento></item></s>"
    day = datetime.date(2026, 2, 4)
    items = legacy.scanned(spark.createDataFrame([(day, xml), (day, xml), (day, "<broken"), (day, None)], "fecha date, xml string"))
    assert sorted({(r.titulo, r.url_html, r.organismo, r.seccion) for r in items.collect()}) == [("Multa a X", "u1", "O", "S > Uno"), ("Otra", "", "D", "S")]
    texts = spark.createDataFrame([("u1", "por infracción: 12345678Z y b12345678"), ("", "multa 12345678Z")], "url string, texto string")
    assert [(r.record_key, r.ids) for r in legacy.kept(items.where("titulo <> 'x'").dropDuplicates(["titulo"]), texts).collect()] == [("20260204|u1|Multa a X", "B12345678, 12345678Z")]
    records = spark.createDataFrame([(1, "20260204"), (2, "20260204"), (3, "20260205")], "id long, yyyymmdd string")
    assert [r.id for r in legacy.of_day(spark, records, "20260204").collect()] == [2, 1]
    t, s = legacy.best_text(F.lit(None).cast("string"), F.lit("x"), F.lit("p"))
    assert tuple(spark.range(1).select(t, s).first()) == ("x", "xml")
    assert spark.range(1).select(legacy.compact_day(F.lit(" 4/2/2026")), legacy.compact_day(F.lit("4-2-2026"))).first()[:] == ("20260204", None)


def test_the_prototype_keeps_what_has_a_keyword_in_its_text_an_address_and_an_identifier(spark):
    day = datetime.date(2026, 2, 4)
    items = [(day, 0, "Multa", "h0", ""), (day, 1, "Multa", "", "x1"), (day, 2, "Multa", "", ""), (day, 3, "Otra", "h3", "x3"), (day, 4, "Otra", "h4", ""), (day, 5, "Otra", "h5", ""), (day, 6, "Otra", "h3", "x3")]
    texts = [("h0", "sin palabra 12345678Z"), ("x1", "una multa a 12345678Z"), ("h3", "sanción a B12345678"), ("h4", "multa sin nadie"), ("h5", "multa a 12345678Z")]
    df = spark.createDataFrame(items, "fecha date, orden int, titulo string, url_html string, url_xml string")
    found = legacy.kept(df, spark.createDataFrame(texts, "url string, texto string"), most=5).collect()
    assert sorted((r.record_key, r.orden) for r in found) == [("20260204|h3|Otra", 3), ("20260204|x1|Multa", 1)]
    assert legacy.kept(df, spark.createDataFrame(texts, "url string, texto string")).count() == 3
