"""Scalar text functions as column expressions."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "\u001f"


def _folding() -> tuple[str, str, dict[str, str]]:
    """Signs of the Latin blocks that NFKD takes apart: those that become one sign, the same without accents, and those that become several."""
    accented, plain, longer = "", "", {}
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2150), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if base == chr(code) or not base:
            continue
        if len(base) == 1:
            accented, plain = accented + chr(code), plain + base
        else:
            longer[chr(code)] = base
    return accented, plain, longer


ACCENTED, PLAIN, LONGER = _folding()
_LONGER_ANY, _LONGER_JSON = "[" + "".join(LONGER) + "]", json.dumps(LONGER)


def without_accents(text: Column) -> Column:
    """NFKD of Latin text without combining marks, with built-in functions; ª, º and ligatures become letters."""
    folded = F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{M}+", "")
    longer = F.from_json(F.lit(_LONGER_JSON), "map<string, string>")
    spelled = F.array_join(F.transform(F.regexp_extract_all(folded, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(longer[c], c)), "")
    # few texts hold a sign that becomes several, and names and identifiers mostly none with accents
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.when(folded.rlike(_LONGER_ANY), spelled).otherwise(folded)).otherwise(text)


_FOLDED = dict(zip(ACCENTED, PLAIN, strict=True)) | LONGER | {c: "" for c in map(chr, range(0x300, 0x110000)) if unicodedata.category(c)[0] == "M"}
_NOT_ASCII = re.compile(r"[^\x00-\x7F]")


@F.pandas_udf(T.StringType())
def without_accents_long(texts: pd.Series) -> pd.Series:
    """As ``without_accents``, in one Arrow pass: for long texts, outside lambdas."""
    return texts.map(lambda s: s if s is None or s.isascii() else _NOT_ASCII.sub(lambda m: _FOLDED.get(m[0], m[0]), s))


def squeezed(text: Column) -> Column:
    """White space collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normal_name(name: Column) -> Column:
    """Without accents, upper case, no full stops or commas, single blanks; null gives ''."""
    return squeezed(F.translate(F.upper(without_accents(F.coalesce(name, F.lit("")))), ".,", ""))


def normal_lower(text: Column) -> Column:
    return without_accents(F.lower(F.coalesce(text, F.lit(""))))


def evidence_form(text: Column, plain: Callable[[Column], Column] = without_accents) -> Column:
    """Upper case ASCII, other characters dropped, and all separators; ``plain`` takes the accents off."""
    return F.upper(F.regexp_replace(plain(F.coalesce(text, F.lit(""))), r"[^\x00-\x7F]|[\s.\-]", ""))


def normal_key(text: Column) -> Column:
    return F.upper(squeezed(F.coalesce(text, F.lit(""))))


def natural_key(*parts: Column) -> Column:
    """SHA-256 of the normalised parts, each after a unit separator but the first."""
    return F.sha2(F.concat_ws(SEPARATOR, *[normal_key(p.cast("string")) for p in parts]), 256)


def cache_key(provider: Column, query: Column) -> Column:
    return F.sha2(F.concat(provider, F.lit(":"), F.upper(F.trim(query))), 256)


def confirmation_token(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 16)


def code(prefix: str, year: Column, number: Column, digits: int) -> Column:
    """Like OP-2026-000001."""
    return F.format_string(f"{prefix}-%d-%0{digits}d", year, number)


def money(amount: Column) -> Column:
    """Two places, half up, of a decimal."""
    return F.round(amount, 2).cast("decimal(14,2)")


def vat(base: Column, percent: Column) -> Column:
    return F.round(base.cast("decimal(14,2)") * percent.cast("decimal(5,2)") / F.lit(100).cast("decimal(3,0)"), 2).cast("decimal(14,2)")


def spanish_number(amount: Column) -> Column:
    """1.234,56"""
    return F.translate(F.format_number(amount, 2), ",.", ".,")


def iso_date(written: Column) -> Column:
    """A date as yyyy-mm-dd; null for anything else."""
    return F.when(F.trim(written).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.trim(written).try_cast("date"))


def given(record: Column) -> Column:
    """A map of texts without null and blank entries."""
    return F.map_filter(record, lambda _, v: F.coalesce(v, F.lit("")) != "")


def joined_present(separator: str, *parts: Column) -> Column:
    """The parts that are not null, joined."""
    return F.concat_ws(separator, *parts)


# Parameters that track visits.
TRACKING = ["srsltid", "gclid", "fbclid", "mc_cid", "mc_eid"]


def normal_url(url: Column) -> Column:
    """Without fragment, tracking parameters and up to two leading English locales."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.substring_index(bare, "?", 1)
    for _ in range(2):
        head = F.regexp_replace(head, r"(?i)^([a-z][a-z0-9+.-]*://[^/]*)/en(?:-[a-z]{2})?/", "$1/")
    query = F.when(F.instr(bare, "?") > 0, F.regexp_replace(bare, r"^[^?]*\?", ""))
    kept = F.array_join(
        F.filter(F.split(query, "&"), lambda p: ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING) & ~F.lower(p).startswith("utm_") & (p != "")), "&"
    )
    return F.concat(head, F.when(F.coalesce(kept, F.lit("")) != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


# The pattern of addresses, endings of asset names and domains of placeholders.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
EMAIL_JUNK_ENDINGS = ["png", "jpg", "jpeg", "gif", "svg", "webp", "css", "js", "ico", "woff", "woff2", "ttf", "eot"]
EMAIL_JUNK_DOMAINS = ["example.com", "example.org", "example.net", "domain.com", "email.com", "yourdomain.com", "empresa.com", "tudominio.com"]


def emails(text: Column) -> Column:
    """Addresses as they stand, in order of first occurrence, without assets and placeholders."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EMAIL), 0))
    domain = lambda e: F.lower(F.substring_index(e, "@", -1))
    return F.filter(found, lambda e: ~F.substring_index(domain(e), ".", -1).isin(EMAIL_JUNK_ENDINGS) & ~domain(e).isin(EMAIL_JUNK_DOMAINS))


# Fixed value: the pattern of Spanish phone numbers.
PHONE = r"(?U)(?<!\d)(?:\+34|0034)?(?:[\s.-]?[6789])(?:[\s.-]?\d){8}(?!\d)"
# The same for an engine without look-around: its group 1. The signs around a number go with it, so that the next one needs a sign of its own before it; blanks and digits are those of ASCII.
PHONE_BETWEEN = r"(?:\A|[^0-9])((?:\+34|0034)?[\t\n\f\r .-]?[6789](?:[\t\n\f\r .-]?[0-9]){8})(?:[^0-9]|\z)"


def phone_score(phone: Column) -> Column:
    """Numbers with a country prefix before those with separators."""
    return F.when(phone.rlike(r"^(\+34|0034)"), 2).otherwise(0) + F.when(phone.rlike(r"[ .-]"), 1).otherwise(0)


def phones(text: Column) -> Column:
    """Spanish numbers, those with a country prefix first, then those with separators, then by occurrence."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PHONE), 0), lambda p: F.regexp_replace(p, r"(?U)^\s+", "")))
    ranked = F.transform(found, lambda p, i: F.struct((-phone_score(p)).alias("score"), i.alias("at"), p.alias("phone")))
    return F.transform(F.array_sort(ranked), lambda r: r["phone"])


# Patterns of profile addresses, and last segments that are no profiles.
SOCIAL = {
    "linkedin_url": r"https?://(?:[a-z]{2,3}\.)?linkedin\.com/(?:in|company)/[A-Za-z0-9][A-Za-z0-9\-_%]*",
    "facebook_url": r"https?://(?:www\.)?facebook\.com/[A-Za-z0-9][A-Za-z0-9.\-_]*",
    "instagram_url": r"https?://(?:www\.)?instagram\.com/[A-Za-z0-9][A-Za-z0-9._]*",
    "twitter_url": r"https?://(?:www\.)?(?:twitter\.com|x\.com)/[A-Za-z0-9][A-Za-z0-9_]*",
}
SOCIAL_JUNK = ["share", "sharer", "sharer.php", "intent", "home", "login", "signup", "explore", "p", "stories", "plugins", "dialog", "hashtag", "search"]


def social_profiles(text: Column) -> Column:
    """Map from network to profile addresses, without shares and logins."""
    pairs = []
    for network, pattern in SOCIAL.items():
        found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0))
        pairs += [F.lit(network), F.filter(found, lambda u: ~F.lower(F.substring_index(u, "/", -1)).isin(SOCIAL_JUNK))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: F.size(v) > 0)


# Domains of directories. The first publish a company's own contact data, the second only data of their own.
DATA_DOMAINS = [
    "dnb.com", "verif.com", "infoempresa.com", "eleconomista.es", "einforma.com", "axesor.es", "datoscif.es", "paginasamarillas.es", "elpais.com",
    "interempresas.net", "nextdoor.com", "empresia.es", "infocif.es", "registro-mercantil.com",
]
FOREIGN_DOMAINS = ["ocu.org", "facebook.com", "linkedin.com", "instagram.com", "twitter.com", "x.com", "boe.es", "significadode.org", "wordmeaning.org", "abebooks.com"]


def host(url: Column) -> Column:
    """The host of an address in lower case, without user, port and a leading www."""
    own = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(own, r"^www\.", "")


def _within(domain: Column, domains: list[str]) -> Column:
    return domain.rlike(r"(^|\.)(" + "|".join(d.replace(".", r"\.") for d in domains) + ")$")


def is_directory(domain: Column) -> Column:
    return _within(domain, DATA_DOMAINS + FOREIGN_DOMAINS)


def is_foreign_site(domain: Column) -> Column:
    """Whether nothing on a site's pages is contact data of the party that is looked for."""
    return _within(domain, FOREIGN_DOMAINS)


# What hints at a page with legal or contact data.
LEGAL_HINTS = ["aviso-legal", "aviso_legal", "aviso legal", "legal", "contacto", "contact", "quienes-somos", "quienes somos", "sobre-nosotros"]
ANCHOR = r'(?is)<a\b[^>]*?href\s*=\s*["\']([^"\']+)["\'][^>]*>(.*?)</a>'


def anchors(html: Column) -> Column:
    """Array of (href, label) in document order."""
    html = F.coalesce(html, F.lit(""))
    hrefs, labels = (F.regexp_extract_all(html, F.lit(ANCHOR), k) for k in (1, 2))
    return F.zip_with(hrefs, labels, lambda h, x: F.struct(h.alias("href"), squeezed(F.regexp_replace(x, "<[^>]*>", " ")).alias("label")))


def _without_dots(path: Column) -> Column:
    """A path with its . and .. segments resolved; .. at the root stays there."""
    last = F.element_at(F.split(path, "/"), -1)
    closed = F.when(last.isin(".", ".."), F.concat(path, F.lit("/"))).otherwise(path)
    kept = F.aggregate(
        F.slice(F.split(closed, "/"), 2, 10_000), F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def absolute_url(base: Column, href: Column) -> Column:
    """A reference resolved against the address of its page."""
    scheme = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0)
    root = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    own_path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    without_fragment, own_page = F.regexp_replace(base, "#.*$", ""), F.regexp_replace(base, "[?#].*$", "")
    path, tail = F.regexp_extract(href, "^[^?#]*", 0), F.regexp_extract(href, "[?#].*$", 0)
    folder = F.when(own_path == "", "/").otherwise(F.regexp_replace(own_path, "[^/]*$", ""))
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, _without_dots(path), tail))
        .when(href.startswith("?"), F.concat(own_page, href))
        .when(href.startswith("#"), F.concat(without_fragment, href))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, path)), tail))
    )


def legal_links(base: Column, html: Column, most: int = 3) -> Column:
    """The first anchors that hint at legal or contact pages, absolute."""
    hint = "|".join(LEGAL_HINTS)
    chosen = F.filter(anchors(html), lambda a: F.lower(a["href"]).rlike(hint) | F.lower(a["label"]).rlike(hint))
    return F.slice(F.transform(chosen, lambda a: absolute_url(base, a["href"])), 1, most)
