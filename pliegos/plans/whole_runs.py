"""Registered queries of whole runs over several increments: the daily run with all its outputs, the stored index, budgets, changes, state and windows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers, text
from ..operators import desk, merge
from ..operators.postings import Postings
from ..sources import gazette
from ..streaming import cache
from . import catalogue, daily, dataflow, enrichment, flows, scratch
from .registry import Tables, query

# The daily run

_LETTER = "substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(({}) % 23 + 1 AS INT), 1)"
_MOST_EXTRACTED = 2


def _date(days: Column) -> Column:
    return F.date_add(F.lit("2026-01-01").cast("date"), days.cast("int"))


def _daily_fixture(t: Tables) -> dict[str, DataFrame]:
    """Documents as items of ten days, of four kinds of interest; suppliers as notices; customers as clients, a third of them with a linked person.

    A seventh of the items stands in a section that is skipped, a seventh has no text at first, and half of these are listed again on the ninth day.
    """
    many = t.customer.count()
    d, kind = F.col("doc_id"), F.col("doc_id") % 6
    party = d % many
    own = F.concat(F.lpad((party * 7919 % 100_000_000).cast("string"), 8, "0"), F.lit("-"), identifiers.dni_letter((party * 7919 % 100_000_000).cast("string")))
    linked = F.concat(F.lit("X"), F.lpad((party * 7907 % 10_000_000).cast("string"), 7, "0"), F.lit("-"), identifiers.dni_letter((party * 7907 % 10_000_000).cast("string")))
    saying = F.lit("Se hace saber a quien tenga NIF ")
    body = (
        F.when(kind == 0, F.concat(saying, own, F.lit("."))).when(kind == 1, F.concat(saying, linked, F.lit("."))).when(kind == 2, "Diligencia de embargo contra bienes.")
        .when(kind == 3, "Plan de formación con deuda y embargo.").otherwise("Sin asunto.")
    )
    title = F.concat(
        F.when(kind == 0, "Notificación de expediente sancionador a D").when(kind == 1, "Resolución de multa a D").when(kind == 5, "Ley 3/2020, del régimen sancionador y expediente sancionador a D").otherwise("Nombramiento de D"),
        d.cast("string"),
    )
    key = F.concat(F.lit("BOE-A-"), d.cast("string"))
    rows = t.documents.select(
        d, (d % 10).alias("day"), F.floor(d / (10 * catalogue.MOST_ITEMS)).cast("long").alias("parte"), F.when(d % 7 == 1, "1").otherwise("5A").alias("codigo"), d.alias("ord"),
        F.struct(key.alias("identificador"), title.alias("titulo"), F.concat(F.lit("https://x/"), key).alias("url_html")).alias("item"),
    )
    again = rows.where((d % 14 == 0) & (F.col("day") != 8)).withColumn("day", F.lit(8).cast("long")).withColumn("parte", F.floor(d / (14 * catalogue.MOST_ITEMS)).cast("long") + 1_000_000)
    texts = t.documents.select(key.alias("identificador"), body.alias("texto"), (d % 7 == 0).alias("late"))

    s = F.col("s_suppkey")
    entry = F.concat(
        F.lit('<li class="notif"> <p>'), F.when(s % 3 == 0, "Notaria de S").otherwise("Diligencia de <b>embargo</b> a S"), s.cast("string"), F.lit('</p><a href="/x/not.php?id=BOE-N-2026-'), s.cast("string"), F.lit('">PDF</a></li>'),
    )
    boards = t.supplier.groupBy(_date(s % 10).alias("fecha"), F.floor(s / (10 * catalogue.MOST_ITEMS)).alias("parte")).agg(
        F.concat(F.lit("<h5>Tesorería</h5><ul>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(s.alias("s"), entry.alias("e")))), lambda x: x["e"]), ""), F.lit("</ul>")).alias("html")
    )
    board_texts = t.supplier.select(F.concat(F.lit("BOE-N-2026-"), s.cast("string")).alias("identificador"), F.when(s % 4 != 3, "Se notifica.").alias("texto"))

    c = F.col("c_custkey")
    number, other = (c * 7919 % 100_000_000).cast("string"), (c * 7907 % 10_000_000).cast("string")
    clients = t.customer.select(
        c.alias("cliente_id"), F.lit(None).cast("string").alias("cif_nif"), F.concat(F.lpad(number, 8, "0"), identifiers.dni_letter(number)).alias("dni_nie"), F.array().cast("array<string>").alias("matriculas"),
        F.concat(F.lit("Cliente "), c.cast("string")).alias("nombre"), F.when(c % 5 != 0, "activo").otherwise("baja").alias("estado"),
    )
    links = t.customer.where(c % 3 == 0).select(
        c.alias("vinculo_id"), c.alias("cliente_id"), F.concat(F.lit("X"), F.lpad(other, 7, "0"), identifiers.dni_letter(other)).alias("identificador"), F.lit("fisica").alias("tipo_persona"),
        F.concat(F.lit("Persona "), c.cast("string")).alias("nombre"), F.when(c % 2 == 0, "administrador").otherwise("").alias("rol"),
    )
    payloads = catalogue._payloads(rows.unionByName(again).withColumn("fecha", _date(F.col("day"))))
    return {"payloads": payloads, "texts": texts, "boards": boards, "board_texts": board_texts, "clients": clients, "links": links}


def _first_identifier(documents: DataFrame) -> DataFrame:
    """An extractor: the first identifier of a text, as the affected party."""
    return documents.select("doc_id", F.get(identifiers.identifiers(F.col("texto")), 0).alias("identificador"), F.lit("Org").alias("organismo_emisor"))


def _daily_state(t: Tables) -> daily.State:
    """Two runs: six days of which one cannot be read, then all ten, and an eleventh that never can."""
    f = {name: scratch.staged(df, name) for name, df in _daily_fixture(t).items()}
    day, part = F.col("fecha"), F.col("parte")
    unread = t.spark.createDataFrame([("2026-01-11", 0, None)], "fecha string, parte long, payload string").withColumn("fecha", day.cast("date")).select("fecha", "parte", "payload")
    first = f["payloads"].where(day <= "2026-01-06").withColumn("payload", F.when((day == "2026-01-04") & (part == 0), "{broken").otherwise(F.col("payload")))
    runs = [(first.unionByName(unread), f["texts"].withColumn("texto", F.when(~F.col("late"), F.col("texto")))), (f["payloads"].unionByName(unread), f["texts"])]
    state = daily.empty_state(t.spark)
    for payloads, texts in runs:
        state = daily.run(state, payloads, texts.select("identificador", "texto"), f["boards"], f["board_texts"], f["clients"], f["links"], _first_identifier, _MOST_EXTRACTED)
    return state


_DAILY_SQL = f"""WITH n AS (SELECT count(*) AS many FROM customer),
    p AS (SELECT doc_id AS d, doc_id % 10 AS day, doc_id % 6 AS k, doc_id % many AS c, CASE WHEN doc_id % 10 IN (0, 1, 2, 4, 5) THEN 1 ELSE 2 END AS run, doc_id % 7 = 1 AS skipped FROM documents, n),
    b AS (SELECT *, CASE k WHEN 0 THEN lpad(CAST(c * 7919 % 100000000 AS VARCHAR), 8, '0') || '-' || {_LETTER.format("c * 7919 % 100000000")}
                           WHEN 1 THEN 'X' || lpad(CAST(c * 7907 % 10000000 AS VARCHAR), 7, '0') || '-' || {_LETTER.format("c * 7907 % 10000000")} END AS ident FROM p),
    x AS (SELECT *, 'BOE-A-' || d AS id, CASE WHEN k <= 1 THEN 'Se hace saber a quien tenga NIF ' || ident || '.' WHEN k = 2 THEN 'Diligencia de embargo contra bienes.' ELSE '' END AS body FROM b),
    l AS (SELECT *, 0 AS again, run = 2 OR d % 7 <> 0 AS told FROM x UNION ALL SELECT * REPLACE (8 AS day, 2 AS run), 1, true FROM x WHERE d % 14 = 0 AND day <> 8),
    j AS (SELECT *, NOT skipped AND (k <= 1 OR (k = 2 AND told)) AS candidate FROM l),
    f AS (SELECT * FROM j WHERE candidate QUALIFY row_number() OVER (PARTITION BY d, run ORDER BY day, again) = 1),
    s AS (SELECT s_suppkey AS s, s_suppkey % 10 AS day, CASE WHEN s_suppkey % 10 IN (0, 1, 2, 4, 5) THEN 1 ELSE 2 END AS run FROM supplier WHERE s_suppkey % 3 <> 0),
    t AS (SELECT *, 'BOE-N-2026-' || s AS id FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY s) AS r FROM s) WHERE r <= 200 AND s % 4 <> 3),
    made AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY run) = 1 AS created FROM f),
    doc AS (SELECT id, min(day) FILTER (created) AS day, any_value(k) AS k, any_value(c) AS c, any_value(ident) AS ident, any_value(body) AS body, bool_or(told) AS told FROM made GROUP BY id),
    o AS (SELECT run, day, id, 0 AS side, again, d AS pos, k, c, ident FROM f WHERE told UNION ALL SELECT run, day, id, 1, 0, s, 9, 0, NULL FROM t),
    e AS (SELECT *, replace(ident, '-', '') AS found FROM (SELECT *, row_number() OVER (PARTITION BY run, day ORDER BY side, again, pos) AS r FROM o) WHERE r <= {_MOST_EXTRACTED} AND k <= 1),
    cases AS (SELECT *, CASE WHEN k = 0 OR c % 3 = 0 THEN c END AS client, CASE WHEN k = 1 AND c % 3 = 0 THEN c END AS link, 'OP-2026-' || lpad(CAST(row_number() OVER (ORDER BY run, day, id) AS VARCHAR), 6, '0') AS code FROM e),
    hits AS (SELECT c, id, day, k, CASE WHEN k = 1 THEN c END AS link, CASE WHEN k = 0 THEN 'Notificación de expediente sancionador a D' ELSE 'Resolución de multa a D' END || substr(id, 7) AS title
             FROM doc WHERE told AND c % 5 <> 0 AND (k = 0 OR (k = 1 AND c % 3 = 0))),
    who AS (SELECT c, CASE WHEN k = 1 THEN 'Persona ' || c || CASE WHEN c % 2 = 0 THEN ' (administrador)' ELSE '' END ELSE 'Cliente ' || c END AS name FROM (SELECT DISTINCT c, k FROM hits)),
    counts AS (
        SELECT run, day, 'total' AS what FROM j UNION ALL SELECT run, day, 'total' FROM s UNION ALL SELECT run, day, 'scanned' FROM j WHERE NOT skipped
        UNION ALL SELECT run, day, 'candidates' FROM f UNION ALL SELECT run, day, 'candidates' FROM t UNION ALL SELECT run, day, 'created' FROM made WHERE created UNION ALL SELECT run, day, 'created' FROM t
        UNION ALL SELECT run, day, 'extracted' FROM cases UNION ALL SELECT run, day, 'assigned' FROM cases WHERE client IS NOT NULL)
    SELECT 'document' AS output, id AS key, concat_ws('|', DATE '2026-01-01' + CAST(day AS INT), 'anuncio_expediente', CASE k WHEN 0 THEN '0.95' WHEN 1 THEN '0.70' ELSE '0.65' END, CASE WHEN told THEN sha256(body) END) AS value FROM doc
    UNION ALL SELECT 'document', id, concat_ws('|', DATE '2026-01-01' + CAST(day AS INT), 'notificacion_teu', '0.80', sha256('Se notifica.')) FROM t
    UNION ALL SELECT 'index', id, concat_ws('|', 'boe', 'diario', 'https://x/' || id, CASE WHEN told THEN replace(ident, '-', '') END) FROM doc
    UNION ALL SELECT 'index', id, 'teu|diario' FROM t
    UNION ALL SELECT 'case', id, concat_ws('|', code, found, client, link, CASE WHEN client IS NULL THEN 'nueva' ELSE 'cliente' END) FROM cases
    UNION ALL SELECT 'activity', CAST(client AS VARCHAR), 'Nueva sanción detectada' || CASE WHEN link IS NULL THEN '' ELSE ' (Persona ' || link || ')' END || '|Sanción ' || code || ' asignada automáticamente por coincidencia de identificador.' FROM cases WHERE client IS NOT NULL
    UNION ALL SELECT 'notification', '', 'Nueva sanción: Desconocido|Organismo: Org' FROM cases
    UNION ALL SELECT 'notification', CAST(client AS VARCHAR), 'Nueva sanción de cliente: ' || CASE WHEN link IS NULL THEN 'Desconocido' ELSE 'Persona ' || link || CASE WHEN link % 2 = 0 THEN ' (administrador)' ELSE '' END END || '|Organismo: Org' FROM cases WHERE client IS NOT NULL
    UNION ALL SELECT 'notification', CAST(c AS VARCHAR), 'Nueva sanción de cliente: ' || CASE WHEN link IS NULL THEN 'Cliente ' || c ELSE 'Persona ' || c || CASE WHEN c % 2 = 0 THEN ' (administrador)' ELSE '' END END
        || '|' || title || ' · ' || (DATE '2026-01-01' + CAST(day AS INT)) || ' · BOE · vía dni' FROM hits
    UNION ALL SELECT 'result', c || ':' || id, concat_ws('|', link, 'dni', '1.0') FROM hits
    UNION ALL SELECT 'run', CAST(DATE '2026-01-01' + CAST(day AS INT) AS VARCHAR), concat_ws('|', 'completed', count(*) FILTER (what = 'total'), count(*) FILTER (what = 'scanned'), count(*) FILTER (what = 'candidates'),
        count(*) FILTER (what = 'created'), count(*) FILTER (what = 'extracted'), count(*) FILTER (what = 'assigned'), 0) FROM counts GROUP BY run, day
    UNION ALL SELECT 'run', u.day, 'failed|0|0|0|0|0|0|1' FROM (VALUES ('2026-01-04'), ('2026-01-11'), ('2026-01-11')) u(day)
    UNION ALL SELECT 'quarantine', u.day, u.what FROM (VALUES ('2026-01-04', 'summary|no JSON|{{broken'), ('2026-01-11', 'summary|no payload'), ('2026-01-11', 'summary|no payload')) u(day, what)""".replace("{{", "{")


@query(_DAILY_SQL)
def daily_outputs(t: Tables) -> DataFrame:
    """All outputs of two daily runs as rows of output, key and value."""
    state = _daily_state(t)
    shown = {
        "document": ("documents", F.col("identificador"), ["fecha_publicacion", "familia", "confidence", "hash_texto"]),
        "index": ("index", F.col("doc_id"), ["fuente", "origen_indexado", "url_html", F.nullif(F.array_join("identificadores", ","), F.lit(""))]),
        "case": ("cases", F.col("doc_id"), ["codigo", "identificador", "cliente_id", "vinculo_id", "estado"]),
        "activity": ("activities", F.col("cliente_id"), ["titulo", "detalle"]),
        "notification": ("notifications", F.coalesce(F.col("cliente_id").cast("string"), F.lit("")), ["titulo", "mensaje"]),
        "result": ("results", F.concat_ws(":", "subject_id", "doc_id"), ["link_id", "via", "score"]),
        "run": ("runs", F.col("fecha"), ["status", "total_docs", "scanned", "candidates", "created", "extracted", "assigned", "errors"]),
        "quarantine": ("quarantine", F.col("fecha"), ["source", "reason", "raw"]),
    }
    rows = [state[table].select(F.lit(name).alias("output"), key.cast("string").alias("key"), F.concat_ws("|", *values).alias("value")) for name, (table, key, values) in shown.items()]
    return functools.reduce(DataFrame.unionByName, rows)


# The stored index


def _stored_index(t: Tables) -> Postings:
    """All documents in two increments: those with even ids, then all of them, of which the first are known."""
    index = Postings(t.spark, scratch.new_path(t.spark, "postings"), buckets=16, doc_type="long")
    docs, _ = catalogue._token_tables(t)
    for rows in (docs.where("doc_id % 2 = 0"), docs):
        index.add(rows, {"text": "tokens"})
    return index


def _same_names(name: str):
    def add(f):
        return query(catalogue.ORACLE_SQL[name])(f)

    return add


@_same_names("phrase_search")
def indexed_phrase_search(t: Tables) -> DataFrame:
    return _stored_index(t).name_hits(catalogue._token_tables(t)[1], "text").where("phrase").select("name_id", "doc_id")


@_same_names("bag_search")
def indexed_bag_search(t: Tables) -> DataFrame:
    return _stored_index(t).name_hits(catalogue._token_tables(t)[1], "text").select("name_id", "doc_id")


@_same_names("name_scores")
def indexed_name_scores(t: Tables) -> DataFrame:
    found = _stored_index(t).name_matches(catalogue._token_tables(t)[1], "text")
    return found.select("name_id", "doc_id", "phrase", F.round("score", 6).alias("score"))


# Budgets


@query(f"""WITH i AS ({catalogue._RUN_ITEMS}), j AS ({catalogue._RUN_JUDGED}), k AS (SELECT *, NOT skipped AND by_title AND (blank OR by_body) AS taken FROM j),
    n AS (SELECT *, count(*) FILTER (taken) OVER (ORDER BY fecha DESC, skipped DESC, doc_id) AS so_far FROM k),
    a AS (SELECT CAST(floor(count(*) FILTER (taken) / 3.0) AS BIGINT) + 1 AS budget FROM k), r AS (SELECT n.*, budget, so_far <= budget - CASE WHEN taken THEN 0 ELSE 1 END AS seen FROM n, a)
    SELECT fecha, count(*) FILTER (seen) AS total_docs, count(*) FILTER (seen AND NOT skipped) AS scanned, count(*) FILTER (seen AND NOT skipped AND by_title) AS candidates, count(*) FILTER (seen AND taken) AS created, 0 AS errors
    FROM r GROUP BY fecha HAVING bool_or(seen)""")
def backfill_budget(t: Tables) -> DataFrame:
    """The first run of a backfill whose budget of documents ends within a day: a third of all documents, and one more."""
    payloads, texts = catalogue._run_fixture(t)
    shape = dataflow.indexed(dataflow.candidates(gazette.flatten_summary(payloads.limit(0)), texts.limit(0), "backfill"))
    index, runs = t.spark.createDataFrame([], shape.schema), t.spark.createDataFrame([], flows.RUN)
    payloads = scratch.staged(payloads, "payloads")
    all_ = flows.run_backfill(payloads, texts, index, runs, "2026-01-01", "2026-01-10", 10)
    run = flows.run_backfill(payloads, texts, index, runs, "2026-01-01", "2026-01-10", 10, most_documents=all_.indexed // 3 + 1)
    return run.runs.drop("tipo", "status")


# Changes of snapshots, and counts that follow them

_SIDES = """o AS (SELECT user_id, count(*) AS n, min(event_type) AS kind, CASE WHEN user_id % 3 > 0 THEN max(event_id) END AS last FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id),
    w AS (SELECT user_id, count(*) AS n, min(event_type) AS kind, CASE WHEN user_id % 3 > 1 THEN max(event_id) END AS last FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY user_id)"""


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    def side(rows: DataFrame, above: int) -> DataFrame:
        return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_type").alias("kind"), F.max("event_id").alias("last")).withColumn("last", F.when(F.col("user_id") % 3 > above, F.col("last")))

    return side(t.events.where("ts < timestamp'2024-01-16'"), 0), side(t.events.where("ts >= timestamp'2024-01-16'"), 1)


@query(f"""WITH {_SIDES}, m AS (SELECT user_id, o.user_id AS had, w.user_id AS has, o.n AS n1, w.n AS n2, o.kind AS k1, w.kind AS k2, o.last AS l1, w.last AS l2 FROM o FULL JOIN w USING (user_id))
    SELECT user_id, CASE WHEN had IS NULL THEN 'inserted' WHEN has IS NULL THEN 'removed' ELSE 'changed' END AS kind, n1 AS n_before, n2 AS n_after,
           CASE WHEN had IS NULL OR has IS NULL THEN '' ELSE concat_ws(',', CASE WHEN n1 <> n2 THEN 'n' END, CASE WHEN k1 <> k2 THEN 'kind' END, CASE WHEN l1 IS DISTINCT FROM l2 THEN 'last' END) END AS columns
    FROM m WHERE had IS NULL OR has IS NULL OR n1 <> n2 OR k1 <> k2 OR l1 IS DISTINCT FROM l2""")
def change_feed(t: Tables) -> DataFrame:
    """What differs between users of the first and of the second half of the events."""
    found = merge.changes(*_sides(t), ["user_id"])
    return found.select("user_id", "kind", F.col("before.n").alias("n_before"), F.col("after.n").alias("n_after"), F.array_join("columns", ",").alias("columns"))


@query(f"""WITH {_SIDES}, m AS (SELECT user_id, o.user_id AS had, w.user_id AS has, o.n AS n1, w.n AS n2, o.kind AS k1, w.kind AS k2, o.last AS l1, w.last AS l2 FROM o FULL JOIN w USING (user_id)),
    c AS (SELECT * FROM m WHERE had IS NULL OR has IS NULL OR n1 <> n2 OR k1 <> k2 OR l1 IS DISTINCT FROM l2)
    SELECT CASE WHEN had IS NULL THEN 'inserted' WHEN has IS NULL THEN 'removed' ELSE 'changed' END AS kind, CAST(user_id AS VARCHAR) AS user, n1 AS n_before, n2 AS n_after FROM c""")
def audit_trail(t: Tables) -> DataFrame:
    """The audit rows of one pair of snapshots that is compared three times."""
    old, new = _sides(t)
    audit = t.spark.createDataFrame([], merge.AUDIT)
    for _ in range(3):
        audit = scratch.staged(merge.audited(audit, merge.changes(old, new, ["user_id"]), ["user_id"]), "audit")
    number = lambda c: F.get_json_object(c, "$.n").cast("long")
    return audit.select("kind", F.get_json_object("key", "$.user_id").alias("user"), number("before").alias("n_before"), number("after").alias("n_after"))


@query(catalogue.ORACLE_SQL["dashboard_counts"])
def maintained_dashboard(t: Tables) -> DataFrame:
    """Counts by day and status that follow the changes between three snapshots of cases: none, those before 1997 of which a quarter has another status, and all."""
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus")
    early = rows.where("o_orderdate < timestamp'1997-01-01'").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4 == 0, "O").otherwise(F.col("o_orderstatus")))
    counts, before = t.spark.createDataFrame([], "day date, status string, n long"), rows.limit(0)
    for after in (early, rows):
        counts = scratch.staged(merge.counted(counts, merge.changes(before, after, ["o_orderkey"]), {"day": "to_date(o_orderdate)", "status": "o_orderstatus"}), "counts")
        before = after
    today = counts.agg(F.max("day").alias("today"))
    met = counts.crossJoin(F.broadcast(today))  # one row
    zero = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return met.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), zero(F.col("day") == F.col("today")).alias("on_day"), zero(F.col("day") >= F.date_sub("today", 7)).alias("last_week"), zero(F.col("status") == "O").alias("open_cases"),
    )


@query(catalogue.ORACLE_SQL["coverage_by_source"])
def maintained_coverage(t: Tables) -> DataFrame:
    """Counts by day and source after two increments, of which each reads its own days only."""
    rows = t.events.select("event_id", "event_type", "ts")
    counts = t.spark.createDataFrame([], "event_type string, day date, n long")
    for days in ("ts < timestamp'2024-01-16'", "ts >= timestamp'2024-01-16'"):
        came = rows.where(days).select(F.struct("event_type", "ts").alias("after"))
        counts = scratch.staged(merge.counted(counts, came.withColumn("before", F.lit(None).cast(came.schema["after"].dataType)), {"event_type": "event_type", "day": "to_date(ts)"}), "counts")
    return counts.groupBy("event_type").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("day").alias("days"), F.sum("n").alias("total"))


# The notice board's window, and ad-hoc questions


def _board_entries(t: Tables) -> DataFrame:
    """Orders as entries of the notice board under their client's DNI."""
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        F.concat(F.lit("1"), F.lpad(k.cast("string"), 7, "0"), F.lit("A")).alias("key"), F.when(o % 11 != 0, F.concat(F.lit("T"), o.cast("string"))).otherwise("").alias("identificador"), F.lit("Embargo").alias("titulo"),
        F.to_date("o_orderdate").alias("fecha_publicacion"), F.lit("Dep").alias("departamento_nombre"), F.lit("u").alias("url_pdf"),
    )


_OWN_DAYS = "w AS (SELECT o_custkey AS c, max(CAST(o_orderdate AS DATE)) - CAST(o_custkey % 40 AS INT) AS today FROM orders GROUP BY o_custkey)"


def _own_days(t: Tables) -> DataFrame:
    """Each client's own day: up to forty days before its last order."""
    return t.orders.groupBy(F.col("o_custkey").alias("subject_id")).agg(F.max(F.to_date("o_orderdate")).alias("d")).select("subject_id", F.date_sub("d", (F.col("subject_id") % 40).cast("int")).alias("today"))


@query(f"""WITH {_OWN_DAYS} SELECT c AS subject_id, 'T' || o_orderkey AS doc_id, 'teu_publico' AS via, 0.95::DOUBLE AS score, CAST(o_orderdate AS DATE) AS day
    FROM orders JOIN w ON c = o_custkey WHERE o_orderkey % 11 <> 0 AND CAST(o_orderdate AS DATE) BETWEEN today - 90 AND today""")
def history_board(t: Tables) -> DataFrame:
    """The fifth branch of the search alone: entries of the notice board within ninety days before each client's own day, and stored."""
    index, clients, links = catalogue._history_fixture(t)
    keys = dataflow.subject_keys(clients, links).where("kind in ('cif', 'dni')")
    board = scratch.staged(dataflow.board_matches(keys, _board_entries(t), dataflow.board_windows(_own_days(t))), "board")
    found = dataflow.history_search(index.limit(0), keys, board=board)
    shape = "doc_id string, fuente string, origen_indexado string, fecha_publicacion date, titulo string, nombres_norm string"
    stored = dataflow.board_documents(board, t.spark.createDataFrame([], shape)).where("fuente = 'teu' and origen_indexado = 'teu_publico'")
    return found.join(stored.select("doc_id", F.col("fecha_publicacion").alias("day")), "doc_id").select("subject_id", "doc_id", "via", "score", "day")


@query(f"""WITH {_OWN_DAYS}, c AS (SELECT o_custkey AS c, o_orderkey AS o, CAST(o_orderdate AS DATE) AS day, today FROM orders JOIN customer ON c_custkey = o_custkey JOIN w ON w.c = o_custkey),
    g AS (
        SELECT c, o, day, today, CASE WHEN c % 10 = 0 THEN 2 ELSE 1 END AS place, CASE WHEN c % 10 = 0 THEN 'dni' ELSE 'cif' END AS via, 1.0 AS score FROM c WHERE o % 4 = 0 AND c % 2 = 0
        UNION ALL SELECT c, o, day, today, 3, 'matricula', 0.9 FROM c WHERE o % 8 = 3
        UNION ALL SELECT c, o, day, today, CASE WHEN o % 3 = 0 THEN 4 ELSE 5 END, CASE WHEN o % 3 = 0 THEN 'nombre_dni_parcial' ELSE 'nombre' END, CASE WHEN o % 3 = 0 THEN 0.85 ELSE 0.7 END FROM c WHERE o % 4 = 2),
    b AS (SELECT c, 'D' || o AS id, place, via, score, CASE WHEN o % 2 = 0 THEN 'teu' ELSE 'boe' END AS fuente, day, today FROM g
          UNION ALL SELECT c, 'T' || o, 6, 'teu_publico', 0.95, 'teu', day, today FROM c WHERE o % 11 <> 0 AND day BETWEEN today - 90 AND today)
    SELECT c AS consult_id, CAST(row_number() OVER (PARTITION BY c ORDER BY score DESC, place, id) AS INTEGER) AS rank, id AS doc_id, via, CAST(score AS DOUBLE) AS score, fuente = 'teu' AND day < today - 90 AS outside_window
    FROM b QUALIFY row_number() OVER (PARTITION BY c ORDER BY score DESC, place, id) <= 3""")
def history_consult(t: Tables) -> DataFrame:
    """Each client as an ad-hoc question with its three best documents, the notice board among them."""
    index, clients, _ = catalogue._history_fixture(t)
    order = t.orders.select(F.concat(F.lit("D"), F.col("o_orderkey").cast("string")).alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, "teu").otherwise("boe").alias("fuente"), F.to_date("o_orderdate").alias("fecha_publicacion"))
    index = scratch.staged(index.join(order, "doc_id").withColumns({"titulo": F.lit("t"), "nombres_norm": F.lit(""), "origen_indexado": F.lit("diario")}), "index")
    asked = clients.join(_own_days(t), F.col("cliente_id") == F.col("subject_id")).select(F.col("cliente_id").alias("consult_id"), F.col("cif_nif").alias("cif"), F.col("dni_nie").alias("dni"), F.col("matriculas")[0].alias("matricula"), "nombre", "today")
    return dataflow.consult(index, asked, 3, _board_entries(t)).select("consult_id", "rank", "doc_id", "via", F.round("score", 6).alias("score"), "outside_window")


# Keyed state


@query("""WITH a AS (SELECT event_id, user_id, ts, ts + INTERVAL 2 DAY AS until, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS again FROM events WHERE event_type = 'purchase'),
    q AS (SELECT event_id, user_id, ts, (SELECT max((a.ts, a.event_id, a.until)) FROM a WHERE a.user_id = e.user_id AND (a.ts, a.event_id) < (e.ts, e.event_id)) AS held FROM events e WHERE event_type <> 'purchase'),
    w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS mark FROM events)
    SELECT event_id, CASE WHEN ts <= held[3] THEN 'hit' ELSE 'miss' END AS outcome, CASE WHEN ts <= held[3] THEN CAST(held[2] AS VARCHAR) END AS answer FROM q
    UNION ALL SELECT event_id, 'expired', CAST(event_id AS VARCHAR) FROM a, w WHERE again > until OR (again IS NULL AND until < mark)""")
def cached_answers(t: Tables) -> DataFrame:
    """Purchases as answers that hold for two days, all other events as questions of their user; a second run finds nothing new."""
    path = scratch.new_path(t.spark, "cache")
    rows = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parquet*").select(
        F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "purchase", F.col("event_id").cast("string")).alias("answer")
    )
    for _ in range(2):
        found = cache.run_available(cache.outcomes(rows, 2), path)
    return found.select(F.col("ord").alias("event_id"), "outcome", "answer")


# Contact data as runs


_PARTY_SQL = """WITH s AS (SELECT s_suppkey AS s, s_suppkey % 8 AS k FROM supplier),
    p AS (SELECT s, CASE k WHEN 0 THEN 'omitido' WHEN 1 THEN 'sin_datos' WHEN 2 THEN 'no_encontrado' WHEN 3 THEN 'omitido' WHEN 4 THEN 'error' WHEN 5 THEN 'no_encontrado' ELSE 'encontrado' END AS status, k FROM s)"""


def _contact_fixture(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers as parties of eight kinds: set by hand, without a name, and six ways that a search can end."""
    s, k = F.col("s_suppkey"), F.col("s_suppkey") % 8
    text_ = s.cast("string")
    ident = F.concat(F.lit("B"), F.lpad(text_, 8, "0"))
    none = F.lit(None).cast("string")
    name = F.concat(F.lit("Molino "), F.lpad(text_, 6, "0"))
    state = F.when(k == 0, "manual")
    parties = t.supplier.select(
        s.alias("case_id"), F.when(k == 1, ident).otherwise(name).alias("nombre"), ident.alias("identificador"), none.alias("localidad"), F.when(k != 1, "Lugo").alias("provincia"), state.alias("contacto_estado"),
        F.lit(None).cast("map<string, struct<value: string, url: string, confidence: double>>").alias("contacto_detalle"), *[none.alias(f) for f in enrichment.FIELDS],
    )
    site = F.concat(F.lit("https://m"), text_, F.lit(".es/"))
    numbers = F.when(k == 2, F.array().cast("array<int>")).when(k.isin(3, 4, 6), F.array(F.lit(0))).when(k == 5, F.array(F.lit(0), F.lit(1))).otherwise(F.sequence(F.lit(0), F.lit(6)))
    candidates = t.supplier.withColumn("n", F.explode(numbers)).select(
        F.concat(name, F.lit(" Lugo")).alias("query"), F.col("n").alias("ord"), F.concat(site, F.col("n").cast("string")).alias("url"), F.lit("Ficha").alias("title"),
        F.when(k == 6, F.concat(name, F.lit(" tel 955 012 299"))).otherwise("").alias("snippet"),
    )
    # of seven candidates of the last kind the first five count: the second holds the name and a mail, the sixth the identifier and a phone
    html = F.when((k == 7) & (F.col("n") == 1), F.concat(name, F.lit(" info@m"), text_, F.lit(".es"))).when((k == 7) & (F.col("n") == 5), F.concat(ident, F.lit(" 955012299"))).when(k == 7, "nada")
    pages = t.supplier.withColumn("n", F.explode(numbers)).select(F.concat(site, F.col("n").cast("string")).alias("url"), html.alias("html"), F.when(k.isin(3, 6) | ((k == 5) & (F.col("n") == 0)), False).alias("allowed"))
    return parties, candidates, pages


@query(f"""{_PARTY_SQL}, r AS (SELECT * FROM (VALUES ('a', 1), ('b', 0), ('c', 1)) r(run, asked))
    SELECT run, 'attempt' AS what, s AS case_id, status || CASE WHEN k > 1 THEN '|0.0' ELSE '' END AS value FROM p, r
    UNION ALL SELECT run, 'asked', s, 'Molino ' || lpad(CAST(s AS VARCHAR), 6, '0') || ' Lugo' FROM p, r WHERE asked = 1 AND k > 1
    UNION ALL SELECT 'end', 'party', s, concat_ws('|', CASE k WHEN 0 THEN 'manual' WHEN 1 THEN 'sin_datos' WHEN 2 THEN 'no_encontrado' WHEN 5 THEN 'no_encontrado' WHEN 6 THEN 'encontrado' WHEN 7 THEN 'encontrado' END,
        CASE WHEN k = 6 THEN '955 012 299' END, CASE WHEN k = 7 THEN 'info@m' || s || '.es' END, CASE WHEN k IN (6, 7) THEN 'https://m' || s || '.es' END) FROM p""")
def contact_runs(t: Tables) -> DataFrame:
    """Three runs over all parties: the second asks the connector nothing, the third comes when the cache has expired."""
    f = [scratch.staged(df, "contacts") for df in _contact_fixture(t)]
    parties, pages = f[0], f[2]
    cache, attempts = t.spark.createDataFrame([], enrichment.CACHE), t.spark.createDataFrame([], enrichment.ATTEMPT)
    rows = []
    for name, day in (("a", "2026-01-01"), ("b", "2026-01-20"), ("c", "2026-03-01")):
        known = attempts
        out = enrichment.run(parties, cache, attempts, gazette.FixtureConnector(f[1]), pages, F.lit(day).cast("timestamp"), name)
        parties, cache, attempts, asked = (scratch.staged(out[k], k) for k in ("parties", "cache", "attempts", "asked"))
        new = attempts.join(known.select("attempt_id"), "attempt_id", "left_anti")
        rows.append(new.select(F.lit(name).alias("run"), F.lit("attempt").alias("what"), "case_id", F.concat_ws("|", "status", "cost").alias("value")))
        rows.append(asked.select(F.lit(name).alias("run"), F.lit("asked").alias("what"), F.regexp_extract("query", "[0-9]+", 0).cast("long").alias("case_id"), F.col("query").alias("value")))
    rows.append(parties.select(F.lit("end").alias("run"), F.lit("party").alias("what"), "case_id", F.concat_ws("|", "contacto_estado", "telefono", "email", "web").alias("value")))
    return functools.reduce(DataFrame.unionByName, rows)


# Smaller projections


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'https://h/' || doc_id WHEN 1 THEN 'https://www.boe.es/h/' || doc_id WHEN 2 THEN 'https://www.boe.es/p/' || doc_id WHEN 3 THEN 'https://www.boe.es/boe_n/dias/'
    || strftime(DATE '2026-01-05' + CAST(doc_id % 40 AS INT), '%Y/%m/%d') || '/not.php?id=BOE-N-' || doc_id ELSE 'https://www.boe.es/diario_boe/txt.php?id=BOE-A-' || doc_id END AS url FROM documents""")
def document_addresses(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    key = d.cast("string")
    html = F.when(d % 5 == 0, F.concat(F.lit("https://h/"), key)).when(d % 5 == 1, F.concat(F.lit("/h/"), key)).otherwise("")
    pdf = F.when(d % 5 == 1, "x").when(d % 5 == 2, F.concat(F.lit("/p/"), key))
    day = F.date_add(F.lit("2026-01-05").cast("date"), (d % 40).cast("int"))
    return t.documents.select("doc_id", gazette.document_url(html, pdf, F.concat(F.when(d % 5 == 3, "BOE-N-").otherwise("BOE-A-"), key), day).alias("url"))


@query("""SELECT doc_id, length(CASE WHEN trim(x) <> '' THEN trim(x) WHEN doc_id % 3 = 1 THEN 'pagina' WHEN doc_id % 3 = 2 THEN 'pdf' ELSE '' END) AS n,
    CASE WHEN trim(x) <> '' THEN 'xml' WHEN doc_id % 3 = 1 THEN 'html' WHEN doc_id % 3 = 2 THEN 'pdf' ELSE 'none' END AS origin FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE '' END AS x FROM documents)""")
def text_cascade(t: Tables) -> DataFrame:
    """The text of a document from its XML, else its page, else its PDF."""
    d = F.col("doc_id")
    xml = F.when(d % 2 == 0, F.col("text"))
    body, origin = gazette.best_text(xml, F.when(d % 3 == 1, " pagina ").otherwise(" "), F.when(d % 3 > 0, "pdf"))
    return t.documents.select("doc_id", F.length(body).cast("long").alias("n"), origin.alias("origin"))


@query("""SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(l_discount AS DECIMAL(4,2)) * CAST(0.5 AS DECIMAL(2,1)), 2) AS DECIMAL(14,2)) AS amount FROM lineitem""")
def money_rounding(t: Tables) -> DataFrame:
    half = F.col("l_extendedprice").cast("decimal(14,2)") * F.col("l_discount").cast("decimal(4,2)") * F.lit(0.5).cast("decimal(2,1)")
    return t.lineitem.select("l_orderkey", "l_linenumber", text.money(half).alias("amount"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderstatus || ',' END || 'clave' AS given FROM orders""")
def record_values(t: Tables) -> DataFrame:
    """Dates as written, of which half are none, and records without their blank entries."""
    k = F.col("o_orderkey")
    written = F.when(k % 4 < 2, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 4 == 2, "31/12/2026").otherwise("")
    record = F.create_map(F.lit("estado"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).otherwise(""), F.lit("nota"), F.lit(None).cast("string"), F.lit("fuente"), F.lit("clave"))
    return t.orders.select("o_orderkey", text.iso_date(written).alias("day"), F.array_join(F.map_values(text.given(record)), ",").alias("given"))


@query("""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN '1' END AS tel, CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey % 4 END AS what FROM orders),
    p AS (SELECT k, what, CASE what WHEN 0 THEN '9' WHEN 1 THEN NULL ELSE tel END AS tel FROM o)
    SELECT k AS o_orderkey, tel AS telefono, CASE WHEN what IS NULL THEN 'encontrado' WHEN tel IS NULL THEN 'pendiente' ELSE 'manual' END AS state, CASE WHEN what IS NULL THEN 'web' WHEN tel IS NOT NULL THEN 'manual' END AS source,
           CASE WHEN what IS NULL OR tel IS NOT NULL THEN 'u' END AS url, CASE WHEN what IS NULL THEN 0.6::DOUBLE WHEN tel IS NOT NULL THEN 1.0::DOUBLE END AS confidence FROM p""")
def manual_contacts(t: Tables) -> DataFrame:
    """Edits by hand that give a phone, clear both ways, name another contact field, or none."""
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    rows = t.orders.select(
        k, F.when(k % 3 == 0, "1").alias("telefono"), none.alias("email"), none.alias("web"), F.lit("encontrado").alias("contacto_estado"), F.lit("web").alias("contacto_fuente"), F.lit("u").alias("contacto_url"),
        F.lit(0.6).alias("contacto_confidence"), F.lit(None).cast("timestamp").alias("contacto_actualizado_at"), F.lit("").alias("nota"),
    )
    given = (
        F.when(k % 4 == 0, F.create_map(F.lit("telefono"), F.lit("9"))).when(k % 4 == 1, F.create_map(F.lit("telefono"), none, F.lit("email"), none))
        .when(k % 4 == 2, F.create_map(F.lit("web"), F.lit("w"))).otherwise(F.create_map(F.lit("nota"), F.lit("x")))
    )
    done = desk.edited(rows, t.orders.select(k, given.alias("changes")), ["o_orderkey"], F.lit("2026-01-01").cast("timestamp"))
    return done.select("o_orderkey", "telefono", F.col("contacto_estado").alias("state"), F.col("contacto_fuente").alias("source"), F.col("contacto_url").alias("url"), F.col("contacto_confidence").alias("confidence"))


_OLD_CASES = """c AS (SELECT o_orderkey AS id, DATE '2020-01-01' + CAST(c_custkey % 1500 AS INT) AS day, sha256(concat_ws(chr(31), 'D' || o_custkey, o_orderstatus, '', '', '')) AS key FROM orders JOIN customer ON c_custkey = o_custkey),
    n AS (SELECT *, row_number() OVER (PARTITION BY year(day) ORDER BY day, id) AS number, row_number() OVER (PARTITION BY key ORDER BY day, id) AS again FROM c)"""


def _old_cases(t: Tables) -> tuple[DataFrame, DataFrame]:
    none = F.lit(None).cast("string")
    doc = lambda c: F.concat(F.lit("D"), F.col(c).cast("string"))
    cases = t.orders.select(F.col("o_orderkey").alias("id"), doc("o_custkey").alias("doc_id"), F.concat(F.lit(" "), F.lower("o_orderstatus")).alias("identificador"), none.alias("nombre"), none.alias("expediente"), none.alias("matricula_coche"))
    return cases, t.customer.select(doc("c_custkey").alias("doc_id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 1500).cast("int")).alias("fecha"))


@query(f"""WITH {_OLD_CASES} SELECT id, 'OP-' || year(day) || '-' || lpad(CAST(number AS VARCHAR), CAST(greatest(6, length(CAST(number AS VARCHAR))) AS INT), '0') AS codigo, CASE WHEN again = 1 THEN key ELSE substr(key, 1, 56) || lpad(lower(to_hex(id)), 8, '0') END AS key FROM n""")
def migrated_cases(t: Tables) -> DataFrame:
    """Orders as cases of the time before codes, customers as their documents: cases are numbered by year, and keys that repeat told apart."""
    return desk.migrated(*_old_cases(t))[0].select("id", "codigo", F.col("origen_clave").alias("key"))


@query("SELECT 'D' || c_custkey AS doc_id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'completed' ELSE 'pending' END AS status FROM customer")
def migrated_documents(t: Tables) -> DataFrame:
    return desk.migrated(*_old_cases(t))[1].select("doc_id", F.col("extraction_status").alias("status"))


@query("""(SELECT 'all' AS what, o_orderkey AS case_id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 30)
    UNION ALL (SELECT 'since', o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1997-01-01' ORDER BY o_orderkey LIMIT 20)
    UNION ALL (SELECT 'between', o_orderkey FROM orders WHERE o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' ORDER BY o_orderkey LIMIT 20)""")
def pending_parties(t: Tables) -> DataFrame:
    """What a batch would take next: of all, from a day on, and between two days."""
    key = F.col("o_orderkey")
    parties = t.orders.select(key.alias("case_id"), key.alias("doc_id"), F.when(F.col("o_orderstatus") == "O", "pendiente").otherwise("manual").alias("contacto_estado"))
    documents = t.orders.select(key.alias("doc_id"), F.to_date("o_orderdate").alias("fecha_publicacion"))
    date = lambda x: F.lit(x).cast("date")
    picks = {"all": (30, None, None), "since": (20, date("1997-01-01"), None), "between": (20, date("1995-01-01"), date("1995-12-31"))}
    return functools.reduce(DataFrame.unionByName, [enrichment.pending(parties, documents, n, a, b).select(F.lit(what).alias("what"), "case_id") for what, (n, a, b) in picks.items()])


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'Sin titular' ELSE o_orderstatus END AS holder FROM orders),
    f AS (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey, holder) AS first FROM o)
    SELECT o_custkey, holder, dense_rank() OVER (PARTITION BY o_custkey ORDER BY first) AS holder_place, row_number() OVER (PARTITION BY o_custkey, holder ORDER BY o_orderkey) AS item_place, o_orderkey FROM f""")
def grouped_by_holder(t: Tables) -> DataFrame:
    items = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("holder"))
    return desk.by_holder(items, "o_custkey", "holder", ["o_orderkey"]).select("o_custkey", "holder", "holder_place", "item_place", "o_orderkey")


@query("SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_size DESC, p_partkey) AS BIGINT) AS place FROM part")
def listed_versions(t: Tables) -> DataFrame:
    """Documents of a client by kind, of each kind the latest version first."""
    rows = t.part.select("p_brand", "p_type", (-F.col("p_size")).alias("back"), "p_partkey")
    return catalogue.relational.numbered_in(rows, ["p_brand"], ["p_type", "back", "p_partkey"], "place").select("p_brand", "p_partkey", F.col("place").cast("long").alias("place"))


@query("""SELECT o_orderkey, 'BOE-A-' || o_orderkey AS boe_id, strftime(o_orderdate, '%Y-%m-%d') AS fecha_publicacion, c_name AS titulo_documento, 'https://www.boe.es/diario_boe/txt.php?id=BOE-A-' || o_orderkey AS url_documento, CAST(o_totalprice AS DECIMAL(14,2)) AS importe
    FROM orders JOIN customer ON c_custkey = o_custkey""")
def case_records(t: Tables) -> DataFrame:
    """Cases with what a reader of the list gets of their documents."""
    key = F.concat(F.lit("BOE-A-"), F.col("o_orderkey").cast("string"))
    none = F.lit(None).cast("string")
    met = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return met.select(
        "o_orderkey", key.alias("boe_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("fecha_publicacion"), F.col("c_name").alias("titulo_documento"),
        gazette.document_url(none, none, key, F.to_date("o_orderdate")).alias("url_documento"), F.col("o_totalprice").cast("decimal(14,2)").alias("importe"),
    )


_CHOSEN = """r AS (SELECT o_custkey AS c, o_orderkey AS o, o_orderkey % 2 = 0 AS done FROM orders), h AS (SELECT *, o_orderstatus = 'P' AS wanted FROM r JOIN orders ON o_orderkey = o),
    a AS (SELECT c, o FROM h WHERE wanted AND NOT done ORDER BY o DESC LIMIT 5), b AS (SELECT c, o FROM h WHERE wanted AND (NOT done AND NOT (o IN (SELECT o FROM a WHERE o % 3 > 0))) ORDER BY o DESC LIMIT 5)"""


@query(f"""WITH {_CHOSEN} SELECT 'result' AS what, o AS key, concat_ws('|', done OR (o % 3 > 0 AND (o IN (SELECT o FROM a) OR o IN (SELECT o FROM b))),
        CASE WHEN o % 3 > 0 AND (o IN (SELECT o FROM a) OR o IN (SELECT o FROM b)) THEN 'n' || o END, CASE WHEN o % 3 = 0 AND (o IN (SELECT o FROM a) OR o IN (SELECT o FROM b)) THEN 'no answer' END) AS value FROM r
    UNION ALL SELECT 'activity', o, 'Extracción histórica: D' || o FROM (FROM a UNION ALL FROM b) WHERE o % 3 > 0
    UNION ALL SELECT 'run', 0, concat_ws('|', count(*), count(*) FILTER (o % 3 > 0), count(*) FILTER (o % 3 = 0)) FROM a UNION ALL SELECT 'run', 0, concat_ws('|', count(*), count(*) FILTER (o % 3 > 0), count(*) FILTER (o % 3 = 0)) FROM b""")
def extracted_results(t: Tables) -> DataFrame:
    """Two requests for the same results, newest first: the second goes on where the first ended; every third document gets no answer."""
    o = F.col("o_orderkey")
    doc = F.concat(F.lit("D"), o.cast("string"))
    results = t.orders.select(F.col("o_custkey").alias("subject_id"), doc.alias("doc_id"), (o % 2 == 0).alias("extraido"), F.lit(None).cast("string").alias("datos"), F.lit(None).cast("string").alias("error"))
    chosen = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("subject_id"), doc.alias("doc_id"), (-o).alias("ord"))
    documents = t.orders.select(doc.alias("doc_id"), doc.alias("titulo"), o.cast("string").alias("texto"))

    def answered(asked: DataFrame) -> DataFrame:
        return asked.where("cast(texto as long) % 3 > 0").select("doc_id", F.concat(F.lit("n"), "texto").alias("datos"), F.lit(None).cast("string").alias("error"))

    runs, acts = t.spark.createDataFrame([], daily.RUN), []
    for _ in range(2):
        results, activities, runs = daily.extract_results(results, chosen, documents, answered, runs, F.lit("2026-01-01").cast("date"), most=5)
        results, runs = scratch.staged(results, "results"), scratch.staged(runs, "runs")
        acts.append(scratch.staged(activities, "activities"))
    number = F.substring("doc_id", 2, 20).cast("long").alias("key")
    rows = [results.select(F.lit("result").alias("what"), number, F.concat_ws("|", F.col("extraido").cast("string"), "datos", "error").alias("value"))]
    rows += [a.select(F.lit("activity").alias("what"), number, F.col("titulo").alias("value")) for a in acts]
    rows.append(runs.select(F.lit("run").alias("what"), F.lit(0).cast("long").alias("key"), F.concat_ws("|", "candidates", "extracted", "errors").alias("value")))
    return functools.reduce(DataFrame.unionByName, rows)
