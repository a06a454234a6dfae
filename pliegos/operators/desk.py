"""What a desk does with cases, clients and notices: validation, marks, names to show, and the capped extraction of facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import merge
from .relational import numbered, numbered_in, present

# Fields one of which makes a case worth keeping, and the form of contact data.
SUBSTANTIVE = ["nombre", "identificador", "expediente", "matricula_coche", "razon_sancion"]
PHONE, EMAIL, URL = r"^[0-9+()./ -]+$", r"^[^\s@]+@[^\s@]+\.[^\s@]+$", r"^https?://"
LONGEST = {PHONE: 50, EMAIL: 200, URL: 500}
EXTRACTED_TEXT = 30_000


def substantive(df: DataFrame) -> DataFrame:
    """Cases with at least one field that is not blank."""
    return df.where(F.greatest(*[F.coalesce(present(F.col(c)), F.lit(False)) for c in SUBSTANTIVE]))


def checked(value: Column, form: str) -> Column:
    """Struct of value (trimmed, blank as null) and valid."""
    own = F.nullif(F.trim(value), F.lit(""))
    return F.struct(own.alias("value"), (own.isNull() | (own.rlike(form) & (F.length(own) <= LONGEST[form]))).alias("valid"))


def split_identifier(identifier: Column, kind: Column, person: Column) -> Column:
    """Struct of cif_nif and dni_nie: by the kind of the identifier, else by that of the person."""
    own, kind = F.nullif(identifier, F.lit("")), F.upper(F.coalesce(kind, F.lit("")))
    company = F.when(kind == "CIF", True).when(kind.isin("NIF", "NIE", "DNI"), False).otherwise(F.coalesce(person == "juridica", F.lit(False)))
    return F.struct(F.when(company, own).alias("cif_nif"), F.when(~company, own).alias("dni_nie"))


def marked(rows: DataFrame, ids: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with ``column`` true where the key is among ``ids``; others as they are, unknown ids are ignored."""
    chosen = ids.select(F.col(key).alias("_id")).distinct()
    return rows.join(chosen, F.col(key) == F.col("_id"), "left").withColumn(column, F.col("_id").isNotNull() | F.col(column)).drop("_id")


def marks_changed(before: DataFrame, column: str) -> DataFrame:
    """How many rows a mark of all rows changes: changed."""
    return before.agg(F.count_if(~F.coalesce(F.col(column), F.lit(False))).alias("changed"))


def shown_as(results: DataFrame, links: DataFrame, clients: DataFrame) -> DataFrame:
    """``results`` (subject_id, link_id) with shown: the linked party's name, or the client's with the party's role, or the client's."""
    own = clients.select(F.col("cliente_id").alias("subject_id"), F.col("nombre").alias("_client"))
    party = links.select(F.col("vinculo_id").alias("link_id"), F.nullif("nombre", F.lit("")).alias("_party"), F.nullif("rol", F.lit("")).alias("_role"))
    met = results.join(own, "subject_id", "left").join(party, "link_id", "left")
    by_role = F.when(F.col("_role").isNotNull(), F.concat("_client", F.lit(" ("), "_role", F.lit(")")))
    return met.withColumn("shown", F.coalesce("_party", by_role, "_client")).drop("_client", "_party", "_role")


def existing_clients(cases: DataFrame, clients: DataFrame) -> DataFrame:
    """case_id and cliente_id: the client a case points to if there is one, else the one that points to the case, or null."""
    direct = clients.select(F.col("cliente_id").alias("_direct"))
    back = clients.where("origen_id is not null").groupBy(F.col("origen_id").alias("case_id")).agg(F.min("cliente_id").alias("_back"))
    met = cases.select("case_id", "cliente_id").join(direct, F.col("cliente_id") == F.col("_direct"), "left").join(back, "case_id", "left")
    return met.select("case_id", F.coalesce("_direct", "_back").alias("cliente_id"))


Extractor = Callable[[DataFrame], DataFrame]


def nothing_extracted(documents: DataFrame) -> DataFrame:
    """The extractor without a service: doc_id and no facts."""
    return documents.select("doc_id", F.array().cast("array<string>").alias("facts"))


def extraction(chosen: DataFrame, done: DataFrame, extractor: Extractor, most: int, force: bool = False) -> DataFrame:
    """Facts of at most ``most`` chosen documents, the best scores first; those in ``done`` are left out unless forced.

    ``chosen``: doc_id, score, texto. A document that the extractor does not answer has no facts.
    """
    if most < 0:
        raise ValueError("most is 0 or more")
    todo = chosen if force else chosen.join(done.select("doc_id").distinct(), "doc_id", "left_anti")
    taken = todo.orderBy(F.desc("score"), "doc_id").limit(most).withColumn("texto", F.substring("texto", 1, EXTRACTED_TEXT))
    return taken.select("doc_id").join(extractor(taken), "doc_id", "left").withColumn("facts", F.coalesce("facts", F.array().cast("array<string>")))


# Fields of which a change by hand settles the contact.
CONTACT_FIELDS = ["telefono", "email", "web", "linkedin_url", "telefono_secundario", "facebook_url", "instagram_url", "twitter_url"]


def edited(rows: DataFrame, patches: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """``rows`` after partial updates by hand (``merge.patched``). One that names a contact field settles the contact: as manual while a phone or a mail
    is there, else as pending again, without its source."""
    touched = patches.where(F.arrays_overlap(F.map_keys("changes"), F.array(*[F.lit(c) for c in CONTACT_FIELDS]))).select(*keys, F.lit(True).alias("_touched")).dropDuplicates(keys)
    met = merge.patched(rows, patches, keys).join(touched, keys, "left")
    touched, there = F.col("_touched").isNotNull(), present(F.col("telefono")) | present(F.col("email"))
    derived = {"contacto_estado": ("manual", "pendiente"), "contacto_fuente": ("manual", None), "contacto_confidence": (1.0, None), "contacto_actualizado_at": (now, None)}
    for name, (known, unknown) in derived.items():
        kind = dict(rows.dtypes)[name]
        met = met.withColumn(name, F.when(touched & there, F.lit(known).cast(kind)).when(touched, F.lit(unknown).cast(kind)).otherwise(F.col(name)))
    return met.withColumn("contacto_url", F.when(~touched | there, F.col("contacto_url"))).select(*rows.columns)


def by_holder(items: DataFrame, client: str, holder: str, order: list[str], nobody: str = "Sin titular") -> DataFrame:
    """``items`` of each client grouped by holder: the holders in the order in which they are first seen (holder_place), and each one's items (item_place), from 1."""
    named = items.withColumn(holder, F.coalesce(F.nullif(holder, F.lit("")), F.lit(nobody)))
    placed = numbered_in(numbered_in(named, [client], order, "_seen"), [client, holder], order, "item_place")
    first = placed.groupBy(client, holder).agg(F.min("_seen").alias("_first"))
    return placed.join(numbered_in(first, [client], ["_first"], "holder_place").drop("_first"), [client, holder]).drop("_seen")


def migrated(cases: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases of the time before codes and keys, and their documents.

    ``cases``: id, doc_id, identificador, nombre, expediente, matricula_coche; ``documents``: doc_id, fecha. Cases get codigo, numbered in each year by day and id, origen_clave and
    estado; a key that an earlier case has ends in the case's id. Documents get extraction_status: whether any case came from them.
    """
    key = text.natural_key(*[F.col(c) for c in ("doc_id", "identificador", "nombre", "expediente", "matricula_coche")])
    dated = cases.join(documents.select("doc_id", "fecha"), "doc_id").withColumn("_key", key)
    coded = numbered(dated, F.year("fecha"), [F.col("fecha"), F.col("id")])
    placed = numbered_in(coded, ["_key"], ["fecha", "id"], "_occurrence")
    ending = F.lower(F.hex("id"))
    own = F.concat(F.substring("_key", 1, 56), F.when(F.length(ending) < 8, F.lpad(ending, 8, "0")).otherwise(ending))
    rows = placed.select(*cases.columns, text.code("OP", F.col("year"), F.col("number"), 6).alias("codigo"), F.when(F.col("_occurrence") == 1, F.col("_key")).otherwise(own).alias("origen_clave"), F.lit("nueva").alias("estado"))
    held = cases.select("doc_id").distinct().withColumn("_held", F.lit(True))
    return rows, documents.join(held, "doc_id", "left").withColumn("extraction_status", F.when(F.col("_held"), "completed").otherwise("pending")).drop("_held")
