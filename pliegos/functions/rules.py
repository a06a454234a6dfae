"""Rule tables and the column expressions made from them."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normal_lower

# What a title, a section and a body say. Patterns match lower-case text.
TITLE_STRONG = [
    r"\bexpediente(?:s)?\s+sancionador(?:es)?\b", r"\bprocedimiento(?:s)?\s+sancionador(?:es)?\b", r"\bpropuesta de resolución\b",
    r"\bnotificación de resolución\b", r"\bpublican las sanciones\b", r"\bsanciones por infracciones\b", r"\bsanción por infracción\b",
    r"\bnotifica(?:r|ción)?\b.*\bsancionador\b", r"\brevocación de procedimientos sancionadores\b", r"\bembargo\b",
    r"\bdiligencia de embargo\b", r"\bapremio\b", r"\bvía de apremio\b", r"\brequerimiento de pago\b", r"\bdeuda(?:s)?\b.*\bnotifica\b",
    r"\bliquidaci[oó]n\b.*\bdeuda\b", r"\bprovidencia de apremio\b", r"\bcobro\s+(?:de\s+)?deudas?\b",
]
TITLE_MEDIUM = [
    r"\bsanción(?:es)?\b", r"\bmulta(?:s)?\b", r"\binfracci[oó]n(?:es)?\b", r"\bexpediente\b", r"\bnotificaci[oó]n\b",
    r"\bresoluci[oó]n\b", r"\bincoad[oa]\b", r"\bembargo\b", r"\bdeuda\b", r"\bapremio\b", r"\bejecuci[oó]n\b",
]
NORMATIVE_PREFIXES, NORMATIVE_TOPIC = ["ley ", "real decreto ", "real decreto-ley ", "orden "], "régimen sancionador"
SKIPPED_SECTIONS, SANCTION_SECTIONS = ["1", "2A", "2B"], ["3", "4", "5", "5A", "5B", "5C"]
BODY = [
    (r"\bexpediente\s+sancionador\b", "body:expediente_sancionador", 3), (r"\bprocedimiento\s+sancionador\b", "body:procedimiento_sancionador", 3),
    (r"\bresoluci[oó]n\s+sancionadora\b", "body:resolucion_sancionadora", 3), (r"\bdiligencia\s+de\s+embargo\b", "body:diligencia_embargo", 3),
    (r"\bprovidencia\s+de\s+apremio\b", "body:providencia_apremio", 3), (r"\brequerimiento\s+de\s+pago\b", "body:requerimiento_pago", 3),
    (r"\bvía\s+de\s+apremio\b", "body:via_apremio", 3), (r"\bpago\s+voluntario\b", "body:pago_voluntario", 2),
    (r"\binfracci[oó]n(?:es)?\s+(?:grave|muy\s+grave|leve)\b", "body:tipo_infraccion", 3), (r"\bsanción\s+(?:de|por)\b", "body:sancion_de", 2),
    (r"\bsancionad[oa]\b", "body:sancionado", 3), (r"\bembarg[oa](?:do|da|r|mos)?\b", "body:embargo", 2), (r"\bdeud(?:a|or|ora)(?:s)?\b", "body:deuda", 1),
    (r"\bmulta\s+de\s+\d", "body:multa_importe", 3), (r"\breducci[oó]n\s+de\s+la\s+sanci[oó]n\b", "body:reduccion_sancion", 2),
    (r"\bpotestad\s+sancionadora\b", "body:potestad_sancionadora", 2), (r"\bmulta(?:s|do)?\b", "body:multa", 1),
    (r"\binfracci[oó]n(?:es)?\b", "body:infraccion", 1), (r"\bsanci[oó]n(?:es)?\b", "body:sancion", 1), (r"\bapremio\b", "body:apremio", 1),
    (r"\bresponsable\b", "body:responsable", 1), (r"\bimpago\b", "body:impago", 1), (r"\bmoroso\b", "body:moroso", 2),
    (r"\bcr[eé]dito\s+incobrable\b", "body:credito_incobrable", 2), (r"\bresolvi[oó]\s+(?:declarar|sancionar|imponer)\b", "body:resolvio_sancionar", 3),
]
BODY_DISQUALIFIERS = [
    (r"\bestancias?\s+formativas?\b", "disq:estancia_formativa"), (r"\bplan\s+de\s+formaci[oó]n\b", "disq:plan_formacion"),
    (r"\btutor(?:a)?\s+dual\b", "disq:tutor_dual"), (r"\bconvenio\b.*\bformaci[oó]n\s+profesional\b", "disq:convenio_fp"),
    (r"\bciclos?\s+(?:de\s+)?grado\b", "disq:ciclo_grado"), (r"\bcomisi[oó]n\s+de\s+seguimiento\b.*\bempresa\b", "disq:comision_empresa_fp"),
]
LEAST_BODY_SCORE = 3
# Words that a notice's title or department must, and must not, hold; without accents.
INCLUDED = [
    "sancion", "sanciones", "sancionador", "sancionadora", "sancionadores", "expediente sancionador", "expedientes sancionadores",
    "resolucion sancionadora", "embargo", "embargos", "embargado", "diligencia de embargo", "apremio", "providencia de apremio",
    "via de apremio", "procedimiento de apremio", "deuda", "deudas", "deudor", "deudores", "deuda tributaria", "deudas tributarias",
    "multa", "multas", "infraccion", "infracciones", "acta de infraccion", "actas de infraccion", "requerimiento de pago",
    "liquidacion", "liquidaciones", "impago", "moroso", "morosos", "penalidad", "penalidades", "ejecucion forzosa",
    "ejecucion subsidiaria", "recaudacion ejecutiva", "titulo ejecutivo", "baja cautelar", "propuesta de resolucion", "reclamacion de deuda",
]
EXCLUDED = [
    "expropiacion forzosa", "renta garantizada", "discapacidad", "prestacion por desempleo", "subvencion", "concesion de aguas",
    "estadistica", "encuesta", "informacion publica", "plan urbanistico", "plan parcial", "plan general", "acta de requerimiento",
    "notaria de ", "notaria ", "registro de la propiedad",
]


def _any(columns: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, columns)


def _matches(text: Column, pattern: str) -> Column:
    # the text is in lower case; only a line feed ends a line
    return text.rlike("(?Ud)" + pattern)


def skipped_section(code: Column) -> Column:
    return F.upper(F.coalesce(code, F.lit(""))).isin(SKIPPED_SECTIONS)


def family(code: Column, name: Column) -> Column:
    """The first rule that fits decides; 'v.' also stands in 'iv.', and comes first."""
    code, name = F.upper(F.coalesce(code, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(code.startswith("5") | F.contains(name, F.lit("v.")), "anuncio_expediente")
        .when((code == "3") | F.contains(name, F.lit("iii.")), "sancion_firme")
        .when((code == "4") | F.contains(name, F.lit("iv.")), "administracion_justicia")
        .otherwise("otro")
    )


def family_of_section(code: Column) -> Column:
    """The family of a document that its title does not give, by the section's code alone."""
    code = F.coalesce(code, F.lit(""))
    return F.when(code.startswith("5"), "anuncio_expediente").when(code == "3", "sancion_firme").when(code == "4", "administracion_justicia").otherwise("otro")


def _literal(pattern: str) -> str:
    """A run of letters that stands in whatever the pattern matches: the longest one outside of choices and options."""
    plain = re.sub(r"\(\?:[^)]*\)\??|\[[^]]*\]\??|\\.|\.\*|.\?", " ", pattern)
    return max(re.findall("[a-zñáéíóúü]+", plain), key=len)


def _hit_numbers(text: Column, patterns: list[str]) -> Column:
    """The numbers of the patterns that match, in the order of the table; a pattern is tried only where its letters stand, which is a plain search of bytes."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(_literal(p))) & _matches(text, p), F.lit(k)) for k, p in enumerate(patterns)]))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` reads it."""
    return F.transform(F.array(value), use)[0]


def _named(labels: list[str], numbers: Column) -> Column:
    table = F.array(*[F.lit(x) for x in labels])
    return F.transform(numbers, lambda k: table[k])


def title_class(title: Column, section_code: Column, section_name: Column) -> Column:
    """Struct of candidate, rules, confidence and family by the title alone."""
    code, name = F.upper(F.coalesce(section_code, F.lit(""))), F.lower(F.coalesce(section_name, F.lit("")))
    section = code.isin(SANCTION_SECTIONS) | _any([F.contains(name, F.lit(s)) for s in ("iii.", "iv.", "v.")])
    own_family, none = family(section_code, section_name), F.array().cast("array<int>")

    def judged(text: Column) -> Column:
        veto = _any([text.startswith(p) for p in NORMATIVE_PREFIXES]) & F.contains(text, F.lit(NORMATIVE_TOPIC))
        strong = F.when(veto, none).otherwise(_hit_numbers(text, TITLE_STRONG))
        return _once(F.struct(veto.alias("veto"), strong.alias("strong"), F.when(veto, none).otherwise(_hit_numbers(text, TITLE_MEDIUM)).alias("medium")), classed)

    def classed(h: Column) -> Column:
        by_strong, by_medium = F.size(h["strong"]) > 0, (F.size(h["medium"]) >= 2) & section
        return F.struct(
            (by_strong | by_medium).alias("candidate"),
            F.when(h["veto"], F.array(F.lit("likely_normative_false_positive")))
            .when(by_strong, _named([f"strong:{p}" for p in TITLE_STRONG], h["strong"]))
            .when(by_medium, _named([f"medium:{p}" for p in TITLE_MEDIUM], h["medium"]))
            .otherwise(F.array().cast("array<string>")).alias("rules"),
            F.when(by_strong, 0.95).when(by_medium, 0.70).otherwise(0.0).alias("confidence"),
            F.when(by_strong | by_medium, own_family).otherwise("").alias("family"),
        )

    return _once(F.lower(F.coalesce(title, F.lit(""))), judged)


def body_score(text: Column) -> Column:
    """Struct of confirmed, labels and score of a document's body; a disqualified body is not scored."""
    outs, hits_of = [p for p, _ in BODY_DISQUALIFIERS], [p for p, _, _ in BODY]
    weights = F.array(*[F.lit(w) for _, _, w in BODY])
    none = F.array().cast("array<int>")

    def judged(lower: Column) -> Column:
        return _once(_hit_numbers(lower, outs), lambda out: _once(F.when(F.size(out) > 0, none).otherwise(_hit_numbers(lower, hits_of)), lambda hits: scored(out, hits)))

    def scored(out: Column, hits: Column) -> Column:
        score = F.aggregate(hits, F.lit(0), lambda total, k: total + weights[k])
        labels = F.when(F.size(out) > 0, F.slice(_named([x for _, x in BODY_DISQUALIFIERS], out), 1, 1)).otherwise(_named([x for _, x, _ in BODY], hits))
        return F.struct((score >= LEAST_BODY_SCORE).alias("confirmed"), labels.alias("labels"), score.alias("score"))

    return _once(F.lower(F.coalesce(text, F.lit(""))), judged)


def combined(title_confidence: Column, title_rules: Column, body_labels: Column, body_confirmed: Column) -> tuple[Column, Column]:
    """Confidence and rules of a document from its title and its body."""
    by_body = F.when(body_confirmed, F.when(F.size(body_labels) >= 3, 0.85).otherwise(0.65)).otherwise(0.0)
    return F.greatest(title_confidence, by_body), F.concat(title_rules, body_labels)


def wanted_notice(title: Column, department: Column) -> Column:
    """Whether title and department hold an included word and no excluded one."""
    text = normal_lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(department, F.lit(""))))
    return text.rlike("|".join(INCLUDED)) & ~text.rlike("|".join(EXCLUDED))


# Ages in days from which a notice counts as of another tier.
URGENT_DAYS, NEXT_DAYS, ARCHIVE_DAYS, OLD_DAYS, VISIBLE_DAYS = 75, 60, 1460, 180, 90


def age_tier(source: Column, days: Column) -> Column:
    return (
        F.when((source == "teu") & (days >= URGENT_DAYS), "urgente")
        .when((source == "teu") & (days >= NEXT_DAYS), "proximo")
        .when(source == "teu", "reciente")
        .when(days > ARCHIVE_DAYS, "archivado")
        .when(days > OLD_DAYS, "proximo")
        .otherwise("reciente")
    )


def outside_window(source: Column, published: Column, today: Column) -> Column:
    return (source == "teu") & (published < F.date_sub(today, VISIBLE_DAYS))
