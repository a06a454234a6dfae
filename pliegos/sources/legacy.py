"""The first prototype's way through a day's summary in XML: flat items, keywords, identifiers by form only."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import relational

# Keywords, accents as written, and the forms of identifiers.
KEYWORDS = ["sanción", "sanciones", "multa", "expediente sancionador", "procedimiento sancionador", "resolución sancionadora", "infracción", "sancionador"]
NIF, CIF = r"(?iU)\b(\d{8}[A-Z])\b", r"(?iU)\b([ABCDEFGHJNPQRSUVW]\d{7}[0-9A-J])\b"
MOST_TITLES = 4
ITEM = ["titulo", "url_html", "url_xml", "url_pdf", "organismo", "seccion"]


def _text(node: ElementTree.Element, child: str) -> str:
    found = node.find(child)
    return "" if found is None else "".join(found.itertext()).strip()


def _items(xml: str | None) -> list[tuple[str, ...]]:
    try:
        root = ElementTree.fromstring(xml or "<x/>")
    except (ElementTree.ParseError, ValueError):
        return []
    out = []

    def walk(node: ElementTree.Element, titles: tuple[str, ...]) -> None:
        if node.tag == "item" and (title := _text(node, "titulo")):
            out.append((title, _text(node, "urlHtml"), _text(node, "urlXml"), _text(node, "urlPdf"), _text(node, "departamento") or _text(node, "organismo"), " > ".join(titles[:MOST_TITLES])))
        own = _text(node, "titulo")
        for child in node:
            walk(child, (*titles, own) if own else titles)

    walk(root, ())
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ITEM])))
def summary_items(xml: pd.Series) -> pd.Series:
    """The titled items of a summary, with the titles above them; broken XML has none."""
    return xml.map(_items)


def scanned(payloads: DataFrame) -> DataFrame:
    """A row for each titled item of the summaries (fecha, xml), numbered in its summary."""
    return payloads.select("fecha", F.posexplode(summary_items("xml")).alias("orden", "i")).select("fecha", "orden", "i.*")


def has_keyword(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(KEYWORDS))


def identifier_list(text: Column) -> Column:
    """CIFs, then NIFs, each sorted, joined; no check characters are tested."""
    def found(pattern: str) -> Column:
        return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1), F.upper)))

    return F.array_join(F.concat(found(CIF), found(NIF)), ", ")


def compact_day(day: Column) -> Column:
    """dd/mm/yyyy as yyyymmdd; null where there are not three parts."""
    parts = F.split(F.trim(day), "/")
    return F.when(F.size(parts) == 3, F.concat(parts[2], *[F.when(F.length(parts[k]) < 2, F.lpad(parts[k], 2, "0")).otherwise(parts[k]) for k in (1, 0)]))


def record_key(day: Column, url: Column, title: Column) -> Column:
    return F.concat_ws("|", day, F.coalesce(url, F.lit("")), title)


def best_text(html: Column, xml: Column, pdf: Column) -> tuple[Column, Column]:
    """The first text there is and where it came from: the page before the XML, unlike the daily run."""
    options = [("html", html), ("xml", xml), ("pdf", pdf)]
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in options], F.lit("none"))
    return F.coalesce(html, xml, pdf, F.lit("")), source


def of_day(spark: SparkSession, records: DataFrame, day: str, most: int = 500) -> DataFrame:
    """The newest records of a day."""
    return spark.sql("SELECT * FROM {records} WHERE yyyymmdd = :day ORDER BY id DESC LIMIT :most", args={"day": day, "most": most}, records=records)


def kept(items: DataFrame, texts: DataFrame, most: int = 300) -> DataFrame:
    """Of the first ``most`` items of each day those with an address, a keyword in their text and an identifier there, each record key once.

    ``texts``: url, texto. An item's address is its page, else its XML.
    """
    url = F.coalesce(F.nullif("url_html", F.lit("")), F.nullif("url_xml", F.lit("")))
    first = relational.first_of(items.withColumn("url", url), ["fecha"], [F.col("orden")], most).where("url is not null")
    rows = first.join(texts.select("url", "texto"), "url").where(has_keyword(F.col("texto"))).withColumn("ids", identifier_list(F.col("texto"))).where("ids <> ''")
    keyed = rows.withColumn("record_key", record_key(F.date_format("fecha", "yyyyMMdd"), F.col("url"), F.col("titulo")))
    return relational.first_of(keyed, ["record_key"], [F.col("orden")])
