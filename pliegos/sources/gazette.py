"""Readers of gazette summaries and documents, and the fixture connector."""

from __future__ import annotations

import re
from collections.abc import Sequence
from html import unescape
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM_COLUMNS = [
    "fecha_publicacion", "diario_numero", "seccion_codigo", "seccion_nombre", "departamento_codigo", "departamento_nombre",
    "epigrafe_nombre", "identificador", "titulo", "url_html", "url_xml", "url_pdf", "raw_item", "orden",
]


def _each(path: str, source: str) -> str:
    """A member that may be one object or a list of them, as a list; nothing when it is absent."""
    child = f"variant_get({source}, '$.{path}')"
    return f"case when {child} is null or is_variant_null({child}) then array() when schema_of_variant({child}) like 'ARRAY%' then cast({child} as array<variant>) else array({child}) end"


def flatten_summary(payloads: DataFrame, json_col: str = "payload", day_col: str = "fecha", carry: Sequence[str] = ()) -> DataFrame:
    """A row for each item below a heading of a daily summary in JSON; each level may be an object or a list.

    ``orden`` is the item's place at each level: items stand in the summary in its order. ``carry`` names further columns of ``payloads`` to keep.
    """
    levels = [("data.sumario.diario", "v", "diario"), ("seccion", "diario", "seccion"), ("departamento", "seccion", "departamento"), ("epigrafe", "departamento", "epigrafe"), ("item", "epigrafe", "item")]
    rows = payloads.select(F.col(day_col).alias("fecha_publicacion"), *carry, F.try_parse_json(json_col).alias("v")).where("v is not null")
    carried = ["fecha_publicacion", *carry, "v"]
    for path, source, name in levels:
        rows = rows.select(*carried, F.posexplode(F.expr(_each(path, source))).alias(f"{name}_at", name))
        carried += [f"{name}_at", name]

    def text(source: str, path: str) -> Column:
        return F.expr(f"try_variant_get({source}, '$.{path}', 'string')")

    pdf = F.coalesce(text("item", "url_pdf.texto"), F.when(F.expr("schema_of_variant(variant_get(item, '$.url_pdf')) = 'STRING'"), text("item", "url_pdf")))
    return rows.select(
        "fecha_publicacion",
        F.expr("try_cast(try_variant_get(diario, '$.numero', 'string') as int)").alias("diario_numero"),
        text("seccion", "codigo").alias("seccion_codigo"),
        text("seccion", "nombre").alias("seccion_nombre"),
        text("departamento", "codigo").alias("departamento_codigo"),
        text("departamento", "nombre").alias("departamento_nombre"),
        text("epigrafe", "nombre").alias("epigrafe_nombre"),
        text("item", "identificador").alias("identificador"),
        F.coalesce(text("item", "titulo"), F.lit("")).alias("titulo"),
        F.coalesce(text("item", "url_html"), F.lit("")).alias("url_html"),
        F.coalesce(text("item", "url_xml"), F.lit("")).alias("url_xml"),
        F.coalesce(pdf, F.lit("")).alias("url_pdf"),
        F.to_json("item").alias("raw_item"),
        F.array(*[f"{name}_at" for _, _, name in levels]).alias("orden"),
        *carry,
    )


# Where a page holds its text, the best place first: element, attribute, value.
CONTAINERS = [
    ("div", "class", "documento-texto"), ("div", "id", "textoxslt"), ("div", "id", "texto"), ("article", None, None), ("div", "id", "contenido"), ("main", None, None),
    ("div", "class", "content"),
]
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})


class _Text(HTMLParser):
    """Visible text of the page and of the first element of each kind of container; what stands in HIDDEN elements is left out."""

    HIDDEN = frozenset({"script", "style", "noscript", "nav", "header", "footer"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int | None]] = []
        self.hidden, self.parts = 0, []
        self.within: dict[int, int] = {}
        self.found: dict[int, list[str]] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        own, kind = dict(attrs), None
        for k, (element, attribute, value) in enumerate(CONTAINERS):
            held = own.get(attribute) or "" if attribute else ""
            if tag == element and k not in self.found and (attribute is None or value in (held.split() if attribute == "class" else [held])):
                self.found[k], kind = [], k
                self.within[k] = len(self.open)
                break
        self.open.append((tag, kind))
        self.hidden += tag in self.HIDDEN

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            t, kind = self.open.pop()
            self.hidden -= t in self.HIDDEN
            self.within.pop(kind, None)
            if t == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            for k in self.within:
                self.found[k].append(data)


def _visible(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    texts = [" ".join(" ".join(parser.found[k]).split()) for k in sorted(parser.found)]
    return next((t for t in texts if t), " ".join(" ".join(parser.parts).split()))


@F.pandas_udf(T.StringType())
def html_text(pages: pd.Series) -> pd.Series:
    return pages.map(_visible)


def _strings(root: ElementTree.Element) -> list[str]:
    return [t.strip() for t in root.itertext() if t.strip()]


def _of_xml(xml: str | None) -> str:
    try:
        root = ElementTree.fromstring(xml or "<x/>")
    except (ElementTree.ParseError, ValueError):
        return _of_broken_xml(xml)
    bodies = list(root.iter("texto"))
    return " ".join(s for b in bodies or [root] for s in _strings(b))


def _of_broken_xml(xml: str) -> str:
    """Text of what is no well-formed XML: of its first ``texto``, else of all of it, without tags."""
    body = re.search(r"(?s)<texto\b[^>]*>(.*?)(?:</texto>|$)", xml)
    return " ".join(unescape(re.sub(r"<[^>]*>?", " ", body[1] if body else xml)).split())


@F.pandas_udf(T.StringType())
def xml_text(xml: pd.Series) -> pd.Series:
    """The text below all ``texto`` elements, else of the whole tree; broken XML is read leniently, and null is empty."""
    return xml.map(_of_xml)


def best_text(xml: Column, html: Column, pdf: Column) -> tuple[Column, Column]:
    """The first text that is not blank, and where it came from."""
    options = [("xml", xml), ("html", html), ("pdf", pdf)]
    text = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for _, c in options], F.lit(""))
    source = F.coalesce(*[F.when(F.trim(c) != "", F.lit(n)) for n, c in options], F.lit("none"))
    return text, source


# The site's address, and where it shows a notice and a document.
SITE, NOTICE_PREFIX, NOTICE_PLACE, DOCUMENT_PLACE = "https://www.boe.es", "BOE-N-", "/boe_n/dias/", "/diario_boe/txt.php?id="


def document_url(html: Column, pdf: Column, identifier: Column, published: Column, site: str = SITE) -> Column:
    """Where a document is shown: its page, else its PDF, else a place made from its identifier and date; addresses without a host get the site's."""

    def absolute(url: Column) -> Column:
        url = F.nullif(url, F.lit(""))
        return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit(site), url))

    notice = F.concat(F.lit(site + NOTICE_PLACE), F.date_format(published, "yyyy/MM/dd"), F.lit("/not.php?id="), identifier)
    return F.coalesce(absolute(html), absolute(pdf), F.when(identifier.startswith(NOTICE_PREFIX), notice), F.concat(F.lit(site + DOCUMENT_PLACE), identifier))


class FixtureConnector:
    """A search connector that answers from rows: query, ord, url, title, snippet. Network connectors share its interface."""

    name, cost = "fixture", 0.0

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def search(self, queries: DataFrame, most: int = 5) -> DataFrame:
        """The first ``most`` candidates of each query."""
        from ..operators.relational import first_of

        return first_of(queries.join(self.rows, "query"), ["query"], [F.col("ord")], most)


CONNECTORS: dict[str, type] = {"fixture": FixtureConnector}


def available(name: str | None, enabled: bool = True) -> tuple[bool, str]:
    """Whether a connector can be used, and why not."""
    if not enabled:
        return False, "search is switched off"
    if not name:
        return False, "no connector is chosen"
    return (True, "") if name in CONNECTORS else (False, f"there is no connector {name}")
