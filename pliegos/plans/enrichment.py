"""Contact data of parties: queries, candidates from a connector, evidence on their pages, and the best value of each field with its source.

Nothing is fetched here: candidates and pages are rows. A text counts only as far as it holds the party's identifier or name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import merge, relational, search
from .scratch import staged

FIELDS = ["telefono", "telefono_secundario", "email", "web", "linkedin_url", "facebook_url", "instagram_url", "twitter_url"]
SOCIAL_FIELDS = FIELDS[4:]
LEAST_CONFIDENCE, LEGAL_PAGES, CACHE_DAYS = 0.6, 3, 30


def pending(parties: DataFrame, documents: DataFrame, most: int, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """The first ``most`` parties that are pending, by case_id; documents (doc_id, fecha_publicacion) are read only where a bound of their day is given."""
    rows = parties.where("contacto_estado = 'pendiente'")
    if first is not None or last is not None:
        day = F.col("fecha_publicacion")
        within = relational.all_of(None if first is None else day >= first, None if last is None else day <= last)
        rows = rows.join(documents.select("doc_id", "fecha_publicacion").where(within), "doc_id", "left_semi")
    return rows.orderBy("case_id").limit(most)


def is_identifier(name: Column) -> Column:
    """Whether a name is a fiscal identifier and no name."""
    return F.coalesce(F.upper(F.trim(name)).rlike("^[0-9A-Z]{8,9}$"), F.lit(False))


def query(name: Column, identifier: Column, town: Column, province: Column) -> Column:
    """What to search for: the name, or the identifier where the name is one, and the place."""
    blank = lambda c: F.nullif(c, F.lit(""))
    subject = F.when(is_identifier(name), F.coalesce(blank(identifier), name)).otherwise(name)
    return F.trim(F.concat_ws(" ", blank(subject), F.coalesce(blank(town), blank(province))))


def queries(parties: DataFrame) -> DataFrame:
    """``parties`` with query and status: omitido (set by hand), sin_datos, no_encontrado (nothing to ask for) or null, which is to be searched."""
    q = query(F.col("nombre"), F.col("identificador"), F.col("localidad"), F.col("provincia"))
    nowhere = F.coalesce(F.nullif("localidad", F.lit("")), F.nullif("provincia", F.lit(""))).isNull()
    status = (
        F.when(F.col("contacto_estado") == "manual", "omitido")
        .when(is_identifier(F.col("nombre")) & nowhere, "sin_datos")
        .when(q == "", "no_encontrado")
    )
    return parties.withColumn("query", q).withColumn("status", status)


CACHE = "key string, payload string, expires_at timestamp"
ATTEMPT = "attempt_id string, case_id long, provider string, query string, status string, url string, confidence double, cost double"
CANDIDATES = "struct<candidates: array<struct<url: string, title: string, snippet: string>>>"


def unexpired(cache: DataFrame, now: Column) -> DataFrame:
    """Rows of a cache that have not expired; an expired row is a miss."""
    return cache.where(F.col("expires_at") >= now)


def cached(cache: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """The next snapshot of a cache (key, payload, expires_at): new answers replace old ones, and live CACHE_DAYS."""
    new = answers.select("key", "payload", F.timestamp_add("DAY", F.lit(CACHE_DAYS), now).alias("expires_at"))
    return cache.join(new.select("key"), "key", "left_anti").unionByName(new.select(*cache.columns))


def _texts(asked: DataFrame, candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """case_id, nombre, identificador, url, body and ord of the snippet of each candidate, its page, and the legal pages that this links to."""
    met = asked.join(candidates, "query").withColumn("url", text.normal_url(F.col("url")))
    keys = ["case_id", "nombre", "identificador"]
    snippet = F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif("snippet", F.lit("")))
    own = met.select(*keys, "url", snippet.alias("body"), F.struct("ord", F.lit(0).alias("kind"), F.lit(0).alias("link")).alias("ord")).where("body <> ''")
    fetched = met.join(pages, "url")
    page = fetched.select(*keys, "url", F.col("html").alias("body"), F.struct("ord", F.lit(1).alias("kind"), F.lit(0).alias("link")).alias("ord"))
    links = fetched.select(*keys, "ord", F.posexplode(text.legal_links(F.col("url"), F.col("html"), LEGAL_PAGES)).alias("link", "url"))
    legal = links.join(pages, "url").select(*keys, "url", F.col("html").alias("body"), F.struct("ord", F.lit(2).alias("kind"), "link").alias("ord"))
    return own.unionByName(page).unionByName(legal)


def found_fields(asked: DataFrame, candidates: DataFrame, pages: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """case_id, field, value, url, confidence: the best value of each field.

    ``asked``: case_id, nombre, identificador, query; ``candidates``: query, ord, url, title, snippet; ``pages``: url, html of pages that were fetched.
    """
    texts = _texts(asked, candidates, pages)
    confidence = search.evidence(text.evidence_form(F.col("body"), text.without_accents_long), text.evidence_form(F.col("identificador")), text.evidence_form(F.col("nombre")))
    texts = texts.withColumn("confidence", confidence).where(F.col("confidence") >= least)
    site = text.host(F.col("url"))
    texts = texts.withColumns({"directory": text.is_directory(site), "foreign": text.is_foreign_site(site), "phones": text.phones(F.col("body")), "mails": text.emails(F.col("body"))})
    own, other = ~F.col("foreign"), F.lit(None).cast("string")
    of_url, of_page = text.social_profiles(F.col("url")), text.social_profiles(F.col("body"))
    root = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    values = {
        "telefono": F.when(own, F.get("phones", 0)), "telefono_secundario": F.when(own, F.get("phones", 1)), "email": F.when(own, F.get("mails", 0)),
        "web": F.when(own & ~F.col("directory"), root),
    }
    for f in SOCIAL_FIELDS:
        values[f] = F.coalesce(F.get(of_url[f], 0), F.when(own & ~F.col("directory"), F.get(of_page[f], 0)).otherwise(other))
    rows = texts.select("case_id", "url", "confidence", "directory", "ord", F.explode(F.create_map(*[x for f, v in values.items() for x in (F.lit(f), v)])).alias("field", "value"))
    best = relational.first_of(rows.where("value is not null"), ["case_id", "field"], [F.col("confidence").desc(), F.col("directory"), F.col("ord"), F.col("url")])
    return best.select("case_id", "field", "value", "url", "confidence")


def _searched(queries_: DataFrame, cache: DataFrame, connector, provider: str, now: Column, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cache after asking for the queries without a live answer, the queries that were asked, and the candidates of all: query, ord, url, title, snippet.

    A query without candidates is an answer as well.
    """
    keyed = queries_.select("query").distinct().withColumn("key", text.cache_key(F.lit(provider), F.col("query")))
    asked = staged(keyed.join(unexpired(cache, now).select("key"), "key", "left_anti"), "asked-queries")
    found = connector.search(asked.select("query"), most)
    listed = found.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "url", "title", "snippet"))), lambda c: F.struct(c["url"].alias("url"), c["title"].alias("title"), c["snippet"].alias("snippet"))).alias("candidates"))
    none = F.from_json(F.lit('{"candidates": []}'), CANDIDATES)["candidates"]
    answers = asked.join(listed, "query", "left").select("key", F.to_json(F.struct(F.coalesce("candidates", none).alias("candidates"))).alias("payload"))
    cache = staged(cached(cache, answers.dropDuplicates(["key"]), now), "cache")
    held = keyed.join(cache.select("key", F.from_json("payload", CANDIDATES).alias("p")), "key")
    return cache, asked, held.select("query", F.posexplode("p.candidates").alias("ord", "c")).select("query", "ord", "c.*")


def run(parties: DataFrame, cache: DataFrame, attempts: DataFrame, connector, pages: DataFrame, now: Column, run_id: str, most: int = 5, least: float = LEAST_CONFIDENCE) -> dict[str, DataFrame]:
    """One run over parties: the next parties, cache and attempts, and which queries the connector was asked (asked).

    ``connector`` has name, cost and search(queries, most); it is asked only for queries without a live answer in the cache, and at most ``most`` of its candidates count.
    ``pages``: url, html (null: could not be read), allowed (false: the site forbids it; null counts as true). A candidate whose page is missing
    could not be read. Each party gets one attempt, told by ``run_id``: a run that is repeated adds none.
    """
    todo = staged(queries(parties), "parties-asked")
    open_ = todo.where("status is null")
    cache, asked, found = _searched(open_, cache, connector, connector.name, now, most)
    candidates = staged(found.withColumn("url", text.normal_url(F.col("url"))), "candidates")
    readable = pages.where("html is not null").select("url", "html").dropDuplicates(["url"])
    forbidden = pages.where("allowed = false").select("url").distinct().withColumn("forbidden", F.lit(True))
    met = candidates.join(forbidden, "url", "left").join(readable.select("url").withColumn("there", F.lit(True)), "url", "left")
    # the page of a candidate is read only where its site allows that, and its legal pages only after it
    open_pages = candidates.select("url").distinct().join(forbidden, "url", "left_anti")
    own = candidates.select("url").distinct().join(open_pages, "url", "left_anti")
    fields = staged(found_fields(open_.select("case_id", "nombre", "identificador", "query"), candidates, readable.join(own, "url", "left_anti"), least), "fields")
    outcome = met.groupBy("query").agg(
        F.count(F.lit(1)).alias("many"), F.count_if(F.col("forbidden")).alias("blocked"), F.count_if(F.col("forbidden").isNull() & F.col("there").isNull()).alias("failed")
    )
    best = relational.first_of(fields, ["case_id"], [F.col("confidence").desc(), F.col("field")]).select("case_id", "url", "confidence")
    judged = todo.join(best, "case_id", "left").join(outcome, "query", "left")
    status = F.coalesce(
        "status", F.when(F.col("url").isNotNull(), "encontrado").when(F.col("blocked") == F.col("many"), "omitido").when(F.col("failed") == F.col("many"), "error"), F.lit("no_encontrado")
    )
    cost = F.when(F.col("status").isNull(), F.lit(float(connector.cost)))
    key = F.sha2(F.concat_ws("|", F.lit(run_id), "case_id"), 256)
    tried = staged(judged.select(key.alias("attempt_id"), F.col("case_id").cast("long").alias("case_id"), F.lit(connector.name).alias("provider"), "query", status.alias("status"), "url", "confidence", cost.alias("cost")), "attempts")
    return {"parties": applied(parties, tried, fields), "cache": cache, "attempts": merge.insert_new(attempts, tried, ["attempt_id"]), "asked": asked.select("query")}


def applied(parties: DataFrame, tried: DataFrame, fields: DataFrame) -> DataFrame:
    """``parties`` with the fields that this run owns: blank ones are filled, ones an earlier run filled are replaced or cleared, others stay.

    ``parties`` has FIELDS, contacto_estado and contacto_detalle (map from field to the value and the source that a run wrote).
    """
    new = fields.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("value", "url", "confidence")))).alias("new"))
    rows = parties.join(tried.select("case_id", "status"), "case_id", "left").join(new, "case_id", "left")
    run = F.col("status") == "encontrado"
    value, kept, auto = {}, [], {}
    for f in FIELDS:
        auto[f] = F.coalesce(F.col("contacto_detalle")[f]["value"] == F.col(f), F.lit(False))
        fresh = F.col("new")[f]["value"]
        writes = fresh.isNotNull() & (F.coalesce(F.col(f), F.lit("")).eqNullSafe("") | auto[f])
        value[f] = F.when(run & writes, fresh).when(run & auto[f], F.lit(None)).otherwise(F.col(f))
        kept.append(F.struct(F.lit(f).alias("key"), F.when(writes, F.col("new")[f]).alias("value")))
    detail = F.map_from_entries(F.filter(F.array(*kept), lambda e: e["value"].isNotNull()))
    state = F.when(F.col("status").isin("encontrado", "sin_datos", "no_encontrado"), F.col("status")).otherwise(F.col("contacto_estado"))
    return rows.select(
        *[value[c].alias(c) if c in value else state.alias(c) if c == "contacto_estado" else F.when(run, F.when(F.size(detail) > 0, detail)).otherwise(F.col(c)).alias(c) if c == "contacto_detalle" else F.col(c) for c in parties.columns]
    )


def missing_fields(kind: str, issuer: dict[str, str | None], active_template: Column, client_id: Column, address: Column, amount: Column, concept: Column) -> Column:
    """What a contract or an invoice still lacks, in the order of the checklist; ``active_template``: whether there is one of the kind."""
    if kind not in ("contrato", "factura"):
        raise ValueError("kind is 'contrato' or 'factura'")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    checks = [(~F.coalesce(active_template, F.lit(False)), "plantilla")]
    checks += [(F.lit(not issuer.get(k)), k) for k in ["EMISOR_NOMBRE", "EMISOR_CIF", "EMISOR_DIRECCION", *(["FACTURA_SERIE"] if kind == "factura" else [])]]
    checks += [(blank(client_id), "cliente.cif_nif"), (blank(address), "cliente.direccion_fiscal")]
    checks.append((~F.coalesce(amount > 0, F.lit(False)), "precio" if kind == "contrato" else "cuantia"))
    if kind == "factura":
        checks.append((blank(concept), "concepto"))
    return F.filter(F.array(*[F.when(lacks, F.lit(name)) for lacks, name in checks]), lambda x: x.isNotNull())
