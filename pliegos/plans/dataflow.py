"""Composite dataflows: ingest, backfill, history search, alerts, assignment, evidence, conversion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers, rules, text
from ..operators import merge, relational, search
from .scratch import staged

STORED_TEXT, STORED_EXTRACT, ALERT_SCORE, PLATE_SCORE = 50_000, 4_000, 0.90, 0.90


def classified(items: DataFrame) -> DataFrame:
    """Items of sections that may hold cases, with the class of their title. Sections are dropped before any text is read."""
    kept = items.where(~rules.skipped_section(F.col("seccion_codigo")))
    return kept.withColumn("title_class", rules.title_class(F.col("titulo"), F.col("seccion_codigo"), F.col("seccion_nombre")))


def text_columns(body: Column, title: Column) -> dict[str, Column]:
    """What is kept of a document's text: a missing text has no hash."""
    return {
        "texto_plano": F.substring(body, 1, STORED_TEXT), "hash_texto": F.sha2(F.nullif(body, F.lit("")), 256), "extracto": F.substring(body, 1, STORED_EXTRACT),
        "claves": identifiers.keys(body, title),
    }


def candidates(items: DataFrame, texts: DataFrame, mode: str = "daily", carry: Sequence[str] = ()) -> DataFrame:
    """Candidate documents of a batch, with the columns of ``carry`` as they are.

    ``daily``: the title or the body speaks for a case. ``backfill``: the title does, and the body, if there is one; confidence is the title's.
    """
    if mode not in ("daily", "backfill"):
        raise ValueError("mode is 'daily' or 'backfill'")
    rows = classified(items).join(texts.select("identificador", "texto"), "identificador", "left")
    rows = rows.withColumn("body", rules.body_score(F.col("texto")))
    by_title, by_body = F.col("title_class.candidate"), F.col("body.confirmed")
    no_text = F.coalesce(F.trim("texto"), F.lit("")) == ""
    kept = rows.where((by_title | by_body) if mode == "daily" else (by_title & (no_text | by_body)))
    confidence, found = rules.combined(F.col("title_class.confidence"), F.col("title_class.rules"), F.col("body.labels"), by_body)
    if mode == "backfill":
        confidence = F.col("title_class.confidence")
    family = F.coalesce(F.nullif("title_class.family", F.lit("")), rules.family_of_section(F.col("seccion_codigo")))
    return kept.select(
        "identificador", "fecha_publicacion", "titulo", *[c.alias(n) for n, c in text_columns(F.col("texto"), F.col("titulo")).items()],
        confidence.cast("decimal(3,2)").alias("confidence"), found.alias("match_rules"), family.alias("familia"), F.lit("boe").alias("fuente"),
        "seccion_codigo", "seccion_nombre", "departamento_nombre", "url_html", "url_xml", "url_pdf", *carry,
    )


#: Columns of an index row that say where a document came from; blank ones are filled by a later run.
PROVENANCE = ["seccion_codigo", "departamento_nombre", "url_html", "url_xml", "url_pdf"]


def indexed(documents: DataFrame, origin: str = "backfill") -> DataFrame:
    """Rows of the index from candidate documents; ``origin`` says which run wrote them first."""
    return documents.select(
        F.col("identificador").alias("doc_id"), "fuente", F.lit(origin).alias("origen_indexado"), *PROVENANCE, "fecha_publicacion", "titulo", "extracto", "hash_texto", "familia", "confidence",
        "claves.identificadores", "claves.matriculas", "claves.nombres", "claves.digitos_parciales", "claves.nombres_norm",
        search.tokens(F.col("claves.nombres_norm")).alias("tokens"),
    )


def into_index(index: DataFrame, new: DataFrame) -> DataFrame:
    arrays = ["identificadores", "matriculas", "nombres", "digitos_parciales"]
    merged = merge.union_merge(index, new, ["doc_id"], arrays, "nombres_norm", identifiers.NAME_SEPARATOR, ["extracto", "hash_texto", *PROVENANCE])
    return merged.withColumn("tokens", search.tokens(F.col("nombres_norm")))


def subject_keys(clients: DataFrame, links: DataFrame) -> DataFrame:
    """subject_id, link_id, kind, key of clients (cif, dni, plate, name) and of persons and companies linked with them.

    A linked party is a person unless ``tipo_persona`` is juridica.
    """

    def rows(df: DataFrame, link: Column, kind: str, key: Column) -> DataFrame:
        return df.select(F.col("cliente_id").alias("subject_id"), link.cast("long").alias("link_id"), F.lit(kind).alias("kind"), key.alias("key"))

    none = F.lit(None)
    cif, dni, own = (identifiers.normal_identifier(F.col(c)) for c in ("cif_nif", "dni_nie", "identificador"))
    company = F.coalesce(F.col("tipo_persona") == "juridica", F.lit(False))
    parts = [
        rows(clients.where(cif != dni), none, "cif", cif),  # one identifier in both places is a person's
        rows(clients, none, "dni", dni),
        rows(clients.withColumn("m", F.explode(F.coalesce("matriculas", F.array().cast("array<string>")))), none, "matricula", identifiers.normal_identifier(F.col("m"))),
        rows(clients, none, "nombre", text.normal_name(F.col("nombre"))),
        rows(links.where(company), F.col("vinculo_id"), "cif", own),
        rows(links.where(~company), F.col("vinculo_id"), "dni", own),
        rows(links, F.col("vinculo_id"), "nombre", text.normal_name(F.col("nombre"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("key <> ''").distinct()


VIAS = ["cif", "dni", "matricula", "nombre_dni_parcial", "nombre", "teu_publico"]
#: The score of an entry of the public notice board, and how long it is shown there.
BOARD_SCORE, BOARD_DAYS = 0.95, 90


def board_windows(dates: DataFrame) -> DataFrame:
    """The days of the notice board that count for each subject (subject_id, today): subject_id, first, last."""
    return dates.select("subject_id", F.date_sub("today", BOARD_DAYS).alias("first"), F.col("today").alias("last"))


def board_matches(keys: DataFrame, entries: DataFrame, windows: DataFrame) -> DataFrame:
    """Entries of the notice board for subjects' own identifiers on days that count: subject_id and the entry.

    ``entries``: key, identificador, titulo, fecha_publicacion, departamento_nombre, url_pdf; those without an identifier are left out.
    """
    own = keys.where("link_id is null and kind in ('cif', 'dni')").select("subject_id", "key").distinct()
    met = entries.where("identificador <> ''").join(own, "key")
    return relational.within(met, windows, ["subject_id"], "fecha_publicacion", width=BOARD_DAYS).drop("key", "first", "last").dropDuplicates(["subject_id", "identificador"])


def board_documents(entries: DataFrame, index: DataFrame) -> DataFrame:
    """Rows for the index from entries of the notice board that were found."""
    given = {"doc_id": "identificador", "titulo": "titulo", "fecha_publicacion": "fecha_publicacion", "departamento_nombre": "departamento_nombre", "url_pdf": "url_pdf"}
    spots = identifiers.keys(F.lit(""), F.col("titulo"))
    once = relational.first_of(entries, ["identificador"], [F.col("fecha_publicacion"), F.col("titulo")]).withColumn("claves", spots)
    made = {"fuente": F.lit("teu"), "origen_indexado": F.lit("teu_publico"), "tokens": search.tokens(F.col("claves.nombres_norm"))}
    made |= {c: F.col(f"claves.{c}") for c in ("identificadores", "matriculas", "nombres", "digitos_parciales", "nombres_norm")}
    columns = [F.col(given[c]).cast(t).alias(c) if c in given else made.get(c, F.lit(None)).cast(t).alias(c) for c, t in index.dtypes]
    return once.select(*columns)


def history_search(index: DataFrame, keys: DataFrame, board: DataFrame | None = None) -> DataFrame:
    """All matches of subjects in the index: the best one of each document; subject_id, doc_id, link_id, via, score.

    ``board`` are matches of the notice board (``board_matches``). All subjects at once: exact keys and plates by equi-joins, names by their rarest token. A name hit whose
    document shows a mask that fits the DNI of the party with that name counts as more, so that no hit is dropped before its mask is read. The keys, the names' tokens and the name hits are each made once and written.
    """
    own = staged(keys, "subject-keys").withColumn("owner", F.struct("subject_id", "link_id"))

    def exact(kind: str, column: str, score: float) -> DataFrame:
        posted = index.select("doc_id", F.explode(F.array_distinct(column)).alias("key"))
        return own.where(F.col("kind") == kind).join(posted, "key").select("subject_id", "link_id", "doc_id", F.lit(kind).alias("via"), F.lit(score).alias("score"))

    names = own.where("kind = 'nombre'").select(F.to_json("owner").alias("name_id"), "subject_id", "link_id", F.col("key").alias("name"))
    queries = staged(names.select(F.concat_ws("|", "name_id", "name").alias("name_id"), search.tokens(F.col("name")).alias("query"), "subject_id", "link_id").distinct(), "asked-names")
    found = search.name_matches(index.select("doc_id", "tokens"), queries.select("name_id", "query"), most=None)
    named = staged(found.join(queries.select("name_id", "subject_id", "link_id"), "name_id").select("subject_id", "link_id", "doc_id", F.lit("nombre").alias("via"), "score"), "named")
    masks = named.select("subject_id", "link_id", "doc_id", "score").join(index.select("doc_id", "digitos_parciales"), "doc_id")
    dni = own.where("kind = 'dni'").select(F.col("subject_id").alias("dni_subject"), F.col("link_id").alias("dni_link"), F.col("key").alias("dni"))
    same = (F.col("subject_id") == F.col("dni_subject")) & F.col("link_id").eqNullSafe(F.col("dni_link"))
    fits = F.exists("digitos_parciales", lambda m: identifiers.fits_mask(F.col("dni"), m))
    masked = (
        masks.join(dni, same).where(fits)
        .select("subject_id", "link_id", "doc_id", F.lit("nombre_dni_parcial").alias("via"), F.greatest("score", F.lit(search.MASK_SCORE)).alias("score"))
    )
    branches = exact("cif", "identificadores", 1.0).unionByName(exact("dni", "identificadores", 1.0)).unionByName(exact("matricula", "matriculas", PLATE_SCORE))
    rows = branches.unionByName(named).unionByName(masked)
    if board is not None:
        rows = rows.unionByName(board.select("subject_id", F.lit(None).cast("long").alias("link_id"), F.col("identificador").alias("doc_id"), F.lit("teu_publico").alias("via"), F.lit(BOARD_SCORE).alias("score")))
    # own keys before those of links, then by branch, the notice board last: of equal scores the first stays
    place = F.create_map(*[F.lit(x) for k, v in enumerate(VIAS) for x in (v, k)])[F.col("via")]
    rows = rows.withColumn("ord", F.struct(F.col("via") == "teu_publico", F.col("link_id").isNotNull(), F.coalesce("link_id", F.lit(0)), place))
    return relational.best_of(rows, ["subject_id", "doc_id"], F.col("score"), F.col("ord")).drop("ord")


def consult(index: DataFrame, asked: DataFrame, most: int = 200, board_entries: DataFrame | None = None) -> DataFrame:
    """Ad-hoc questions, each answered by the ``most`` best of all documents that match: consult_id, rank, doc_id, via, score, fuente, fecha_publicacion, titulo, outside_window.

    ``asked``: consult_id, cif, dni, matricula, nombre (any of them null) and today. Nothing is stored. Equal scores stand in the order of the branches, then of
    the documents. Documents of the notice board that were published more than BOARD_DAYS before today are outside its window.
    """
    subjects = asked.select(
        F.col("consult_id").alias("cliente_id"), F.col("cif").alias("cif_nif"), F.col("dni").alias("dni_nie"), F.array_compact(F.array("matricula")).alias("matriculas"), "nombre",
    )
    links = asked.sparkSession.createDataFrame([], "vinculo_id long, cliente_id long, identificador string, tipo_persona string, nombre string")
    keys = subject_keys(subjects, links)
    dates = asked.select(F.col("consult_id").alias("subject_id"), "today")
    board = None if board_entries is None else board_matches(keys, board_entries, board_windows(dates))
    found = history_search(index, keys, board).drop("link_id")
    shown = ["doc_id", "fuente", "fecha_publicacion", "titulo"]
    docs = index.select(*shown)
    if board is not None:
        docs = docs.unionByName(board_documents(board.drop("subject_id"), index).select(*shown).join(index.select("doc_id"), "doc_id", "left_anti"))
    met = found.join(docs, "doc_id").join(dates, "subject_id").withColumn("outside_window", rules.outside_window(F.col("fuente"), F.col("fecha_publicacion"), F.col("today")))
    place = F.array_position(F.array(*[F.lit(v) for v in VIAS]), F.col("via"))
    first = Window.partitionBy("subject_id").orderBy(F.desc("score"), place, "doc_id")
    ranked = met.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)
    return ranked.select(F.col("subject_id").alias("consult_id"), "rank", "doc_id", "via", "score", "fuente", "fecha_publicacion", "titulo", "outside_window")


def radar(index: DataFrame, clients: DataFrame, links: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next snapshot of results, and alerts: new matches of active clients at 0.90 or more.

    ``results``: subject_id, doc_id, link_id, via, score, vias. Both come from one search, which is written.
    """
    active = clients.where("estado = 'activo'")
    found = history_search(index, subject_keys(active, links.join(active.select("cliente_id"), "cliente_id", "left_semi")))
    new = found.select("subject_id", "doc_id", "link_id", "via", "score", F.array("via").alias("vias"))
    merged = staged(merge.max_merge(results, new, ["subject_id", "doc_id"], "score", ["link_id", "via"], "vias"), "radar-results")
    alerts = merged.where(F.col("created") & (F.col("score") >= ALERT_SCORE)).select("subject_id", "doc_id", "link_id", "via", "score")
    return merged.drop("created"), alerts


def identifier_owners(clients: DataFrame, links: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """identifier, cliente_id, vinculo_id: a link beats a client, a later row an earlier one, a client's DNI its CIF. With ``among`` (identifier) only of these."""
    empty = F.lit(None).cast("long")

    def order(kind: int, row: str, key: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(row).cast("long").alias("row"), F.lit(key).alias("key")).alias("o")

    rows = (
        clients.select(identifiers.normal_identifier(F.col("cif_nif")).alias("identifier"), "cliente_id", empty.alias("vinculo_id"), order(0, "cliente_id", 0))
        .unionByName(clients.select(identifiers.normal_identifier(F.col("dni_nie")).alias("identifier"), "cliente_id", empty.alias("vinculo_id"), order(0, "cliente_id", 1)))
        .unionByName(links.select(identifiers.normal_identifier(F.col("identificador")).alias("identifier"), "cliente_id", F.col("vinculo_id").cast("long"), order(1, "vinculo_id", 0)))
    )
    rows = rows if among is None else rows.join(among.select("identifier").distinct(), "identifier", "left_semi")
    return relational.last_wins(rows, "identifier", [F.col("o").desc()]).drop("o")


def assigned(cases: DataFrame, owners: DataFrame) -> DataFrame:
    """Cases without a client get that of their identifier; a case keeps the client it has."""
    found = owners.select(F.col("identifier").alias("_id"), F.col("cliente_id").alias("_client"), F.col("vinculo_id").alias("_link"))
    joined = cases.join(found, identifiers.normal_identifier(F.col("identificador")) == F.col("_id"), "left")
    free = F.col("cliente_id").isNull()
    return joined.withColumn("vinculo_id", F.when(free, F.col("_link")).otherwise(F.col("vinculo_id"))).withColumn("cliente_id", F.coalesce("cliente_id", "_client")).drop("_id", "_client", "_link")


def best_fields(found: DataFrame) -> DataFrame:
    """The best value of each field of a case: higher confidence, then the case's own site before a directory, then the first.

    ``found``: case_id, field, value, confidence, directory (boolean), ord.
    """
    return relational.first_of(found, ["case_id", "field"], [F.col("confidence").desc(), F.col("directory"), F.col("ord")])


def converted(cases: DataFrame, clients: DataFrame, year: int, last: int) -> DataFrame:
    """New clients from cases marked for conversion that no client came from yet, with codes after the year's ``last`` number."""
    new = cases.where("convert").join(clients.select(F.col("origen_id").alias("case_id")), "case_id", "left_anti")
    ids = identifiers.normal_identifier(F.col("identificador"))
    is_cif = ids.rlike("^[A-W][0-9]{7}[0-9A-J]$") & ~ids.rlike("^[XYZ]")
    rows = new.select(F.col("case_id").alias("origen_id"), "nombre", F.when(is_cif, ids).alias("cif_nif"), F.when(~is_cif, F.nullif(ids, F.lit(""))).alias("dni_nie"))
    placed = relational.numbered_in(rows.withColumn("_all", F.lit(0)), ["_all"], ["origen_id"]).drop("_all")
    return placed.withColumn("codigo", text.code("CLI", F.lit(year), F.col("number") + last, 8)).drop("number")
