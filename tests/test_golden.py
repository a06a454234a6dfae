"""Small cases with known results."""

from pliegos.functions import identifiers, rules
from pliegos.plans import dataflow
from pyspark.sql import functions as F


def test_keys_of_short_texts(spark):
    cases = [
        ("DNI 12345678Z, NIE X1234567L y CIF B12345674", {"12345678Z", "X1234567L", "B12345674"}),
        ("12345678A B12345679", set()),
        ("expediente 12345678Z", set()),
    ]
    rows = spark.createDataFrame([(t,) for t, _ in cases], "t string").select(identifiers.identifiers(F.col("t")).alias("ids")).collect()
    assert [set(r.ids) for r in rows] == [want for _, want in cases]


def test_masks_and_plates(spark):
    r = spark.createDataFrame([("12345678Z", "***4567**", "1234 BCD 1234 ABC")], "a string, m string, p string").select(
        identifiers.fits_mask(F.col("a"), F.col("m")).alias("yes"), identifiers.fits_mask(F.lit("12395678Z"), F.col("m")).alias("no"), identifiers.plates(F.col("p")).alias("plates")
    ).first()
    assert (r.yes, r.no, r.plates) == (True, False, ["1234BCD"])


def test_family_takes_the_first_rule_that_fits(spark):
    assert spark.range(1).select(rules.family(F.lit("4"), F.lit("iv. justicia"))).first()[0] == "anuncio_expediente"


def test_radar_alerts_once_for_a_strong_match(spark):
    index = spark.createDataFrame(
        [("d1", ["B12345674"], ["1234BCD"], ["***4567**"], ["ana", "lopez"])],
        "doc_id string, identificadores array<string>, matriculas array<string>, digitos_parciales array<string>, tokens array<string>",
    )
    clients = spark.createDataFrame(
        [(1, "b-1234567-4", None, ["1234-bcd"], "Otra", "activo"), (2, None, "12345678Z", None, "Ana López", "activo"), (3, "B12345674", None, None, "X", "inactivo")],
        "cliente_id long, cif_nif string, dni_nie string, matriculas array<string>, nombre string, estado string",
    )
    links = spark.createDataFrame([], "vinculo_id long, cliente_id long, identificador string, tipo_persona string, nombre string")
    none = spark.createDataFrame([], "subject_id long, doc_id string, link_id long, via string, score double, vias array<string>")
    results, alerts = dataflow.radar(index, clients, links, none)
    found = {(r.subject_id, r.via, r.score) for r in results.collect()}
    assert found == {(1, "cif", 1.0), (2, "nombre_dni_parcial", 0.85)}
    assert [(r.subject_id, r.doc_id) for r in alerts.collect()] == [(1, "d1")]
    again, more = dataflow.radar(index, clients, links, spark.createDataFrame(results.collect(), results.schema))
    assert more.count() == 0 and again.count() == 2


def test_linked_persons_are_found_by_their_own_dni_name_and_mask(spark):
    index = spark.createDataFrame(
        [("d1", ["22222222J"], [], [], []), ("d2", [], [], ["***2222**"], ["rosa", "gil"]), ("d3", [], [], ["***1111**"], ["rosa", "gil"]), ("d4", ["B22222228"], [], [], ["x"])],
        "doc_id string, identificadores array<string>, matriculas array<string>, digitos_parciales array<string>, tokens array<string>",
    )
    clients = spark.createDataFrame([(1, None, "11111111H", None, "Molino", "activo")], "cliente_id long, cif_nif string, dni_nie string, matriculas array<string>, nombre string, estado string")
    links = spark.createDataFrame([(7, 1, "22222222-J", None, "Rosa Gil"), (8, 1, "B22222228", "juridica", "")], "vinculo_id long, cliente_id long, identificador string, tipo_persona string, nombre string")
    found = dataflow.history_search(index, dataflow.subject_keys(clients, links)).collect()
    assert {(r.doc_id, r.link_id, r.via, round(r.score, 2)) for r in found} == {("d1", 7, "dni", 1.0), ("d2", 7, "nombre_dni_parcial", 0.85), ("d3", 7, "nombre", 0.7), ("d4", 8, "cif", 1.0)}


def test_a_name_hit_of_low_rank_is_found_by_its_mask(spark):
    """Of 250 documents with a name the last shows the mask, so that it is the best; the search returns them all."""
    rows = [(f"d{k:03d}", [], [], ["***4567**"] if k == 249 else [], ["ana", "lopez"], "boe", None, "t", "", "diario") for k in range(250)]
    index = spark.createDataFrame(
        rows,
        "doc_id string, identificadores array<string>, matriculas array<string>, digitos_parciales array<string>, tokens array<string>, fuente string, fecha_publicacion date, titulo string, nombres_norm string, origen_indexado string",
    )
    asked = spark.createDataFrame([(1, None, "12345678Z", None, "Ana López")], "consult_id long, cif string, dni string, matricula string, nombre string").withColumn("today", F.lit("2026-01-01").cast("date"))
    best = dataflow.consult(index, asked, 3).orderBy("rank").collect()
    assert [(r.doc_id, r.via, round(r.score, 2)) for r in best] == [("d249", "nombre_dni_parcial", 0.85), ("d000", "nombre", 0.7), ("d001", "nombre", 0.7)]
    keys = spark.createDataFrame([(1, None, "nombre", "ANA LOPEZ")], "subject_id long, link_id long, kind string, key string")
    assert {r.doc_id for r in dataflow.history_search(index, keys).collect()} == {r[0] for r in rows}


def test_the_radar_reads_its_clients_once(spark):
    """The search behind results and alerts is made once, whichever of them is read."""
    read = spark.sparkContext.accumulator(0)

    def seen(name):
        read.add(1)
        return name

    rows = [(k, None, f"{k:08d}A", [f"{k:04d}BCD"], f"Ana {k}", "activo") for k in range(20)]
    clients = spark.createDataFrame(rows, "cliente_id long, cif_nif string, dni_nie string, matriculas array<string>, nombre string, estado string")
    clients = clients.withColumn("nombre", F.udf(seen, "string").asNondeterministic()("nombre"))
    index = spark.createDataFrame(
        [("d1", ["00000003A"], [], [], ["ana", "4"]), ("d2", [], ["0005BCD"], [], [])],
        "doc_id string, identificadores array<string>, matriculas array<string>, digitos_parciales array<string>, tokens array<string>",
    )
    links = spark.createDataFrame([], "vinculo_id long, cliente_id long, identificador string, tipo_persona string, nombre string")
    none = spark.createDataFrame([], "subject_id long, doc_id string, link_id long, via string, score double, vias array<string>")
    results, alerts = dataflow.radar(index, clients, links, none)
    assert {(r.subject_id, r.doc_id, r.via) for r in results.collect()} == {(3, "d1", "dni"), (4, "d1", "nombre"), (5, "d2", "matricula")}
    assert {(r.subject_id, r.doc_id) for r in alerts.collect()} == {(3, "d1"), (5, "d2")}
    assert read.value == len(rows)


def test_keys_of_clients_and_links(spark):
    clients = spark.createDataFrame(
        [(1, "b-1234567-4", "12345678z", ["1234-bcd", "1234 BCD", None], "Ana  López"), (2, "12345678Z", "12345678-Z", None, None), (3, None, None, [], "")],
        "cliente_id long, cif_nif string, dni_nie string, matriculas array<string>, nombre string",
    )
    links = spark.createDataFrame(
        [(7, 1, "22222222-J", None, "Rosa Gil"), (8, 2, "B22222228", "juridica", ""), (9, 2, None, "fisica", None)],
        "vinculo_id long, cliente_id long, identificador string, tipo_persona string, nombre string",
    )
    assert {tuple(r) for r in dataflow.subject_keys(clients, links).collect()} == {
        (1, None, "cif", "B12345674"), (1, None, "dni", "12345678Z"), (1, None, "matricula", "1234BCD"), (1, None, "nombre", "ANA LOPEZ"), (2, None, "dni", "12345678Z"),
        (1, 7, "dni", "22222222J"), (1, 7, "nombre", "ROSA GIL"), (2, 8, "cif", "B22222228"),
    }
