"""The notice board: its daily index in HTML, and the fixture of its public search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import places, rules
from ..operators import relational
from ..plans.scratch import staged

# The patterns of the index's headings and entries.
HEADING = r"(?s)<h5[^>]*>(.*?)</h5>"
ENTRY = r'(?s)<li\s+class="notif">\s*<p>(.*?)</p>.*?href="([^"]*?/not\.php\?id=(BOE-N-\d+-\d+))"'
SECTION, SECTION_NAME = "TEU", "Tablón Edictal Único - Suplemento de Notificaciones"
PUBLIC_DAYS = rules.VISIBLE_DAYS


_spots = places.places({"entry": ENTRY, "heading": HEADING})


def _plain(html):
    return F.trim(F.regexp_replace(html, "<[^>]+>", ""))


def index_entries(pages: DataFrame, html_col: str = "html", day_col: str = "fecha") -> DataFrame:
    """The entries of index pages, each under the last heading before it; an identifier that occurs again on a day is left out.

    A day of several pages numbers them in ``parte``. A null or blank page has no entries; an entry before any heading of its page has the
    department ''. ``place`` is where an entry stands in its page.
    """
    part = F.col("parte").cast("int") if "parte" in pages.columns else F.lit(0)
    rows = staged(pages.select(F.col(day_col).alias("fecha_publicacion"), part.alias("parte"), _spots(html_col).alias("s")), "board-places")
    day = ["fecha_publicacion", "parte"]
    entries = rows.select(*day, F.explode("s.entry").alias("e")).select(
        *day, F.col("e.start").alias("place"), _plain(F.col("e.groups")[0]).alias("titulo"), F.col("e.groups")[1].alias("url_pdf"), F.col("e.groups")[2].alias("identificador")
    )
    entries = relational.first_of(entries, ["fecha_publicacion", "identificador"], [F.col("parte"), F.col("place")])
    headings = rows.select(*day, F.explode("s.heading").alias("h")).select(*day, F.col("h.start").alias("place"), _plain(F.col("h.groups")[0]).alias("departamento_nombre"))
    found = relational.as_of(entries, headings, day, "place", ["departamento_nombre"])
    return found.select(
        "identificador", "titulo", F.coalesce("departamento_nombre", F.lit("")).alias("departamento_nombre"), "fecha_publicacion",
        F.lit(SECTION).alias("seccion_codigo"), F.lit(SECTION_NAME).alias("seccion_nombre"), "url_pdf", F.lit("teu").alias("source"), "parte", "place",
        *[F.lit(None).cast("string").alias(c) for c in ("url_html", "url_xml")],
    )


def wanted(entries: DataFrame) -> DataFrame:
    """The entries whose title and department speak of a sanction or a debt."""
    return entries.where(rules.wanted_notice(F.col("titulo"), F.col("departamento_nombre")))


class FixtureSearch:
    """The public search, answered from rows: key, identificador, titulo, fecha_publicacion."""

    name = "fixture"

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def search(self, keys: DataFrame, first: str, last: str) -> DataFrame:
        """Entries of each key (subject_id, key) published between two days, both included."""
        days = F.col("fecha_publicacion").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
        return keys.join(self.rows.where(days), "key")
