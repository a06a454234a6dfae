"""One run of the daily ingest as a graph: what is judged once feeds documents, index, cases, assignment, radar and the runs table.

A run reads a state, a dictionary of snapshots, and gives the next one; it is the caller that commits it. Each output is merged by key, so that a run
over the same rows changes nothing. A day with a payload that cannot be read is quarantined and stays open: it fails as a whole, and
the next run reads it again. The notice board, the assignment and the radar are branches: one that fails leaves its snapshots as
they were and a row in the quarantine, and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import identifiers, rules, text
from ..operators import desk, merge, relational
from ..sources import gazette, notices
from . import dataflow
from .scratch import staged

State = dict[str, DataFrame]
#: documents -> rows of persons and companies that their texts name (CASE_FACTS), doc_id first
Extractor = Callable[[DataFrame], DataFrame]

RUN = "fecha date, tipo string, status string, total_docs long, scanned long, candidates long, created long, extracted long, assigned long, errors long"
QUARANTINE = "fecha date, source string, reason string, raw string"
CASE_FACTS = ["identificador", "nombre", "expediente", "matricula_coche", "tipo_procedimiento", "razon_sancion", "organismo_emisor", "tipo_infraccion"]
CASE = f"caso_id string, codigo string, doc_id string, fecha date, {', '.join(f'{c} string' for c in CASE_FACTS)}, importe_multa decimal(14,2), cliente_id long, vinculo_id long, estado string"
ACTIVITY = "caso_id string, cliente_id long, vinculo_id long, tipo string, titulo string, detalle string"
NOTIFICATION = "clave string, tipo string, cliente_id long, titulo string, mensaje string"
RESULT = "subject_id long, doc_id string, link_id long, via string, score double, vias array<string>"
# The notice board's entries a day, and what its documents are marked with.
MOST_NOTICES, NOTICE_FAMILY, NOTICE_CONFIDENCE, NOTICE_RULE = 200, "notificacion_teu", 0.80, "teu_title_match"
NO_DETAIL = "Se ha detectado una nueva sanción en el BOE."
RAW = 500


def empty_state(spark: SparkSession) -> State:
    none = spark.createDataFrame([], "fecha date, payload string")
    documents = dataflow.candidates(gazette.flatten_summary(none), spark.createDataFrame([], "identificador string, texto string"))
    shapes = {"cases": CASE, "activities": ACTIVITY, "notifications": NOTIFICATION, "results": RESULT, "runs": RUN, "quarantine": QUARANTINE}
    state = {name: spark.createDataFrame([], shape) for name, shape in shapes.items()}
    marked = documents.withColumn("extraction_status", F.lit("pending"))
    return state | {"documents": spark.createDataFrame([], marked.schema), "index": spark.createDataFrame([], dataflow.indexed(documents).schema)}


def quarantined(payloads: DataFrame, source: str = "summary", col: str = "payload") -> DataFrame:
    """Payloads that cannot be read, with the reason and how they begin."""
    reason = F.when(F.coalesce(F.trim(col), F.lit("")) == "", "no payload").when(F.try_parse_json(col).isNull(), "no JSON")
    return payloads.withColumn("reason", reason).where("reason is not null").select("fecha", F.lit(source).alias("source"), "reason", F.substring(col, 1, RAW).alias("raw"))


def pending_days(days: DataFrame, runs: DataFrame, kind: str, force: bool) -> DataFrame:
    done = runs.where((F.col("tipo") == kind) & (F.col("status") == "completed")).select("fecha").distinct()
    return days if force else days.join(done, "fecha", "left_anti")


def _notices(boards: DataFrame, board_texts: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of the boards that are wanted, and documents of the first of each day that are new and have a text."""
    entries = staged(notices.wanted(notices.index_entries(boards)), "board-entries")
    first = relational.first_of(entries, ["fecha_publicacion"], [F.col("parte"), F.col("place"), F.col("identificador")], MOST_NOTICES)
    once = relational.first_of(first, ["identificador"], [F.col("fecha_publicacion"), F.col("parte"), F.col("place")])
    new = once.join(documents.select("identificador"), "identificador", "left_anti").join(board_texts.where("trim(texto) <> ''"), "identificador")
    keys = dataflow.text_columns(F.col("texto"), F.col("titulo"))
    constant = {"confidence": F.lit(NOTICE_CONFIDENCE).cast("decimal(3,2)"), "match_rules": F.array(F.lit(NOTICE_RULE)), "familia": F.lit(NOTICE_FAMILY), "fuente": F.lit("teu"), "orden": F.array(F.lit(1), "parte", "place")}
    return entries, new.withColumns(keys | constant)


def _message(row: dict[str, Column]) -> Column:
    amount = F.concat(F.lit("Multa: "), F.format_number(row["importe_multa"], 2), F.lit(" EUR"))
    parts = [F.concat(F.lit(f"{label}: "), F.nullif(row[c], F.lit(""))) for label, c in (("Organismo", "organismo_emisor"), ("Tipo", "tipo_infraccion"))]
    parts += [F.when(row["importe_multa"] != 0, amount), F.concat(F.lit("Expediente: "), F.nullif(row["expediente"], F.lit("")))]
    return F.coalesce(F.nullif(text.joined_present(" | ", *parts), F.lit("")), F.lit(NO_DETAIL))


def _extracted(found: DataFrame, documents: DataFrame, cases: DataFrame, extractor: Extractor, most: int, force: bool) -> tuple[DataFrame, DataFrame]:
    """New cases of at most ``most`` documents of each day, in the order of the day, and the documents that were tried."""
    status = documents.select("identificador", "extraction_status")
    todo = found.where("trim(texto_plano) <> ''").join(status, "identificador", "left")
    todo = todo if force else todo.where(F.coalesce("extraction_status", F.lit("pending")) != "completed")
    taken = staged(relational.first_of(todo, ["fecha_publicacion"], [F.col("orden"), F.col("identificador")], most), "to-extract")
    asked = taken.select(F.col("identificador").alias("doc_id"), "titulo", F.substring("texto_plano", 1, desk.EXTRACTED_TEXT).alias("texto"))
    facts = extractor(asked)
    for c in [*CASE_FACTS, "importe_multa"]:
        if c not in facts.columns:
            facts = facts.withColumn(c, F.lit(None).cast("string"))
    facts = desk.substantive(facts)
    key = text.natural_key(*[F.col(c) for c in ("doc_id", "identificador", "nombre", "expediente", "matricula_coche", "tipo_procedimiento")])
    day = taken.select(F.col("identificador").alias("doc_id"), F.col("fecha_publicacion").alias("fecha"))
    keyed = facts.withColumn("caso_id", key).join(day, "doc_id").dropDuplicates(["caso_id"]).join(cases.select("caso_id"), "caso_id", "left_anti")
    last = cases.groupBy(F.year("fecha").alias("year")).agg(F.max(F.substring_index("codigo", "-", -1).cast("long")).alias("last"))
    coded = relational.numbered(keyed, F.year("fecha"), [F.col("fecha"), F.col("doc_id"), F.col("caso_id")], start=last)
    rows = coded.select(
        "caso_id", text.code("OP", F.col("year"), F.col("number"), 6).alias("codigo"), "doc_id", "fecha", *CASE_FACTS, F.col("importe_multa").cast("decimal(14,2)").alias("importe_multa"),
        F.lit(None).cast("long").alias("cliente_id"), F.lit(None).cast("long").alias("vinculo_id"), F.lit("nueva").alias("estado"),
    )
    return rows, taken.select("identificador")


def _assigned(new: DataFrame, clients: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``new`` cases with the client of their identifier, the activities, and a notice for each."""
    asked = new.select(identifiers.normal_identifier(F.col("identificador")).alias("identifier"))
    met = staged(dataflow.assigned(new, dataflow.identifier_owners(clients, links, asked)), "assigned")
    hit = F.col("cliente_id").isNotNull()
    cases = met.withColumn("estado", F.when(hit, "cliente").otherwise(F.col("estado")))
    party = links.select(F.col("vinculo_id"), F.nullif("nombre", F.lit("")).alias("_party"), F.nullif("rol", F.lit("")).alias("_role"))
    told = cases.where(hit).join(party, "vinculo_id", "left")
    named = F.coalesce(F.concat(F.lit(" ("), "_party", F.lit(")")), F.lit(""))
    activities = told.select(
        "caso_id", "cliente_id", "vinculo_id", F.lit("sistema").alias("tipo"), F.concat(F.lit("Nueva sanción detectada"), named).alias("titulo"),
        F.concat(F.lit("Sanción "), "codigo", F.lit(" asignada automáticamente por coincidencia de identificador.")).alias("detalle"),
    )
    who = F.coalesce("_party", F.nullif("nombre", F.lit("")), F.lit("Desconocido"))
    role = F.coalesce(F.concat(F.lit(" ("), "_role", F.lit(")")), F.lit(""))
    title = F.concat(F.lit("Nueva sanción de cliente: "), who, role)
    notes = told.select(F.concat(F.lit("caso:"), "caso_id", F.lit(":cliente")).alias("clave"), F.lit("nueva_sancion_cliente").alias("tipo"), "cliente_id", title.alias("titulo"), _message({c: F.col(c) for c in told.columns}).alias("mensaje"))
    return cases, activities, notes


def _case_notes(new: DataFrame) -> DataFrame:
    title = F.concat(F.lit("Nueva sanción: "), F.coalesce(F.nullif("nombre", F.lit("")), F.lit("Desconocido")))
    return new.select(F.concat(F.lit("caso:"), "caso_id").alias("clave"), F.lit("nueva_sancion").alias("tipo"), F.lit(None).cast("long").alias("cliente_id"), title.alias("titulo"), _message({c: F.col(c) for c in new.columns}).alias("mensaje"))


def alert_notes(alerts: DataFrame, index: DataFrame, clients: DataFrame, links: DataFrame) -> DataFrame:
    """A notice for each alert of the radar: of whom, and which document."""
    docs = index.select("doc_id", F.col("titulo").alias("_title"), "fecha_publicacion", "fuente")
    own = clients.select(F.col("cliente_id").alias("subject_id"), F.col("nombre").alias("_client"))
    party = links.select(F.col("vinculo_id").alias("link_id"), F.nullif("nombre", F.lit("")).alias("_party"), F.nullif("rol", F.lit("")).alias("_role"))
    met = alerts.join(docs, "doc_id").join(own, "subject_id").join(party, "link_id", "left")
    role = F.coalesce(F.concat(F.lit(" ("), "_role", F.lit(")")), F.lit(""))
    title = F.concat(F.lit("Nueva sanción de cliente: "), F.coalesce("_party", "_client", F.lit("")), role)
    message = F.concat_ws(" · ", "_title", F.date_format("fecha_publicacion", "yyyy-MM-dd"), F.upper("fuente"), F.concat(F.lit("vía "), "via"))
    return met.select(F.concat_ws(":", F.lit("radar"), "subject_id", "doc_id").alias("clave"), F.lit("nueva_sancion_cliente").alias("tipo"), F.col("subject_id").alias("cliente_id"), title.alias("titulo"), message.alias("mensaje"))


def run(
    state: State, payloads: DataFrame, texts: DataFrame, boards: DataFrame, board_texts: DataFrame, clients: DataFrame, links: DataFrame,
    extractor: Extractor | None = None, most_extracted: int = 0, force: bool = False,
) -> State:
    """The next state after the days of ``payloads`` (fecha, payload, and parte where a day has several).

    ``texts`` and ``board_texts``: identificador, texto. ``boards``: fecha, html (and parte). ``clients``: cliente_id, cif_nif, dni_nie, matriculas, nombre,
    estado; ``links``: vinculo_id, cliente_id, identificador, tipo_persona, nombre, rol. Texts are extracted only with an ``extractor``, of at most
    ``most_extracted`` documents of a day. A document that is listed twice in one run is taken at its first place.
    """
    spark, failed = payloads.sparkSession, []

    def branch(name: str, outputs: Callable[[], tuple[DataFrame, ...]], instead: tuple[DataFrame, ...]) -> tuple[DataFrame, ...]:
        try:
            return tuple(staged(df, name) for df in outputs())
        except Exception as error:  # noqa: BLE001 one branch must not end the run
            if isinstance(error, (AnalysisException, KeyError, TypeError)):
                raise  # a fault of the call, not of its rows
            failed.append((None, name, f"{type(error).__name__}: {error}"[:RAW], None))
            return instead

    if "parte" not in payloads.columns:
        payloads = payloads.withColumn("parte", F.lit(0))
    days = staged(pending_days(payloads.select("fecha").distinct(), state["runs"], "daily", force), "days")
    todo = payloads.join(F.broadcast(days), "fecha", "left_semi")
    broken = staged(quarantined(todo), "broken")
    good = staged(days.join(broken.select("fecha").distinct(), "fecha", "left_anti"), "good-days")

    listed = gazette.flatten_summary(todo.join(good, "fecha", "left_semi"), carry=["parte"]).where(F.coalesce("identificador", F.lit("")) != "")
    items = staged(listed.withColumn("orden", F.concat(F.array(F.lit(0), F.col("parte").cast("int")), "orden")).drop("raw_item", "parte"), "items")
    judged = dataflow.candidates(items, texts, "daily", carry=["orden"])
    found = staged(relational.first_of(judged, ["identificador"], [F.col("fecha_publicacion"), F.col("orden")]), "judged")

    no_entries = spark.createDataFrame([], "fecha_publicacion date")
    open_boards = boards.join(good, "fecha", "left_semi")
    entries, noticed = branch("notices", lambda: _notices(open_boards, board_texts, state["documents"]), (no_entries, found.limit(0)))
    found = found.unionByName(noticed.select(*found.columns))

    columns = [c for c in state["documents"].columns if c != "extraction_status"]
    known = state["documents"].select("identificador")
    created = staged(found.join(known, "identificador", "left_anti").select("identificador", "fecha_publicacion", "fuente"), "created")
    documents = merge.fill_group(state["documents"], found.select(*columns), ["identificador"], "texto_plano", ["texto_plano", "hash_texto", "extracto", "claves"])
    documents = staged(merge.insert_new(documents, found.select(*columns).withColumn("extraction_status", F.lit("pending")), ["identificador"]), "documents")
    index = staged(dataflow.into_index(state["index"], dataflow.indexed(found, "diario").select(*state["index"].columns)), "index")

    cases, activities, notifications = state["cases"], state["activities"], state["notifications"]
    no_cases = spark.createDataFrame([], CASE)
    new_cases = assigned = no_cases
    if extractor and most_extracted > 0:
        none = (no_cases, known.limit(0))
        new_cases, tried = branch("extraction", lambda: _extracted(found, state["documents"], state["cases"], extractor, most_extracted, force), none)
        documents = staged(documents.join(tried.withColumn("_tried", F.lit(True)), "identificador", "left").withColumn("extraction_status", F.when(F.col("_tried"), "completed").otherwise(F.col("extraction_status"))).drop("_tried"), "documents")
        told = _case_notes(new_cases)
        none = (new_cases, spark.createDataFrame([], ACTIVITY), spark.createDataFrame([], NOTIFICATION))
        assigned, acts, notes = branch("assignment", lambda: _assigned(new_cases, clients, links), none)
        cases = cases.unionByName(assigned.select(*cases.columns))
        activities = merge.insert_new(activities, acts, ["caso_id"])
        notifications = merge.insert_new(notifications, told.unionByName(notes), ["clave"])

    def radar() -> tuple[DataFrame, DataFrame]:
        results, alerts = dataflow.radar(index, clients, links, state["results"])
        return results, alert_notes(alerts, index, clients, links)

    results, alerts = branch("radar", radar, (state["results"], spark.createDataFrame([], NOTIFICATION)))
    notifications = merge.insert_new(notifications, alerts, ["clave"])

    counts = {
        "total_docs": items.select("fecha_publicacion").unionByName(entries.select("fecha_publicacion")), "scanned": items.where(~rules.skipped_section(F.col("seccion_codigo"))),
        "candidates": found, "created": created, "extracted": new_cases.withColumn("fecha_publicacion", F.col("fecha")),
        "assigned": assigned.where("cliente_id is not null").withColumn("fecha_publicacion", F.col("fecha")), "errors": broken.withColumn("fecha_publicacion", F.col("fecha")),
    }
    stats = days
    for name, rows in counts.items():
        stats = stats.join(rows.groupBy(F.col("fecha_publicacion").alias("fecha")).agg(F.count(F.lit(1)).alias(name)), "fecha", "left")
    status = F.when(F.coalesce("errors", F.lit(0)) > 0, "failed").otherwise("completed")
    runs = state["runs"].unionByName(stats.select("fecha", F.lit("daily").alias("tipo"), status.alias("status"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts]))
    quarantine = state["quarantine"].unionByName(broken).unionByName(spark.createDataFrame(failed, QUARANTINE))
    return {
        "documents": documents, "index": index, "cases": staged(cases, "cases"), "activities": staged(activities, "activities"), "notifications": staged(notifications, "notifications"),
        "results": results, "runs": staged(runs, "runs"), "quarantine": staged(quarantine, "quarantine"),
    }


#: Results that one request extracts at most.
MOST_RESULTS = 3


def extract_results(
    results: DataFrame, chosen: DataFrame, documents: DataFrame, extractor: Callable[[DataFrame], DataFrame], runs: DataFrame, today: Column, most: int = MOST_RESULTS, force: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts of chosen results of the history search: the next results, the activities, and the next runs with a row of the kind historico_cliente.

    ``results``: subject_id, doc_id, extraido, datos, error and any others; ``chosen``: subject_id, doc_id, ord; ``documents``: doc_id, titulo, texto. Chosen results are taken in
    their order, at most ``most``; unknown ones, and those that are done unless forced, do not count. ``extractor`` gives doc_id, datos and error
    (null where it went well); a document that it does not answer is an error.
    """
    key = ["subject_id", "doc_id"]
    known = results.select(*key, F.coalesce("extraido", F.lit(False)).alias("_done"))
    todo = chosen.dropDuplicates(key).join(known, key)
    taken = (todo if force else todo.where(~F.col("_done"))).orderBy("ord", *key).limit(most)
    asked = staged(taken.select(*key).join(documents, "doc_id", "left").withColumn("texto", F.substring(F.coalesce("texto", F.lit("")), 1, desk.EXTRACTED_TEXT)), "results-asked")
    answers = extractor(asked.select("doc_id", "titulo", "texto").dropDuplicates(["doc_id"])).select("doc_id", F.col("datos").alias("_datos"), F.col("error").alias("_error"))
    found = staged(asked.join(answers, "doc_id", "left").withColumn("_error", F.when(F.col("_datos").isNull(), F.substring(F.coalesce("_error", F.lit("no answer")), 1, 2000))), "results-extracted")
    told = found.select(*key, F.lit(True).alias("_asked"), "_datos", "_error")
    good = F.col("_asked").isNotNull() & F.col("_datos").isNotNull()
    met = results.join(told, key, "left").withColumns({
        "extraido": F.coalesce(F.when(good, True), F.col("extraido"), F.lit(False)), "datos": F.when(good, F.col("_datos")).otherwise(F.col("datos")),
        "error": F.when(good, F.lit(None).cast("string")).when(F.col("_asked").isNotNull(), F.col("_error")).otherwise(F.col("error")),
    })
    title = F.concat(F.lit("Extracción histórica: "), F.substring(F.coalesce("titulo", F.lit("")), 1, 200))
    activities = found.where("_datos is not null").select(F.col("subject_id").alias("cliente_id"), "doc_id", F.lit("sistema").alias("tipo"), title.alias("titulo"))
    zero = F.lit(0).cast("long")
    row = found.agg(F.count(F.lit(1)).alias("candidates"), F.count("_datos").alias("extracted"), F.count("_error").alias("errors")).select(
        today.alias("fecha"), F.lit("historico_cliente").alias("tipo"), F.lit("completed").alias("status"), zero.alias("total_docs"), zero.alias("scanned"), "candidates", zero.alias("created"), "extracted", zero.alias("assigned"), "errors"
    )
    return met.select(*results.columns), activities, runs.unionByName(row)
