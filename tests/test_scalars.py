"""Small cases of the scalar functions, with plain Python as the other side where it has the same function."""

import unicodedata
from urllib.parse import urljoin

import pytest
from pliegos.functions import identifiers, rules, text
from pliegos.operators import search
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def over(spark):
    def run(f, values):
        rows = spark.createDataFrame(list(enumerate(values)), "k long, v string").select("k", f(F.col("v")).alias("r")).collect()
        return [r.r for r in sorted(rows)]

    return run


def test_phones_come_by_prefix_then_separators_then_place(over):
    line = "ref 712004519 y fax 0034 955-01-22-33; mov. 688.10.20.30; ofi 955012299, +34699000111, 12688102030"
    assert over(text.phones, [line, None, ""]) == [["0034 955-01-22-33", "+34699000111", "688.10.20.30", "712004519", "955012299"], [], []]


def test_phones_may_hold_no_break_spaces(over):
    assert over(text.phones, ["955\u00a0012\u00a0299 y +34\u00a0699\u2009000 111"]) == [["+34\u00a0699\u2009000 111", "955\u00a0012\u00a0299"]]


def test_addresses_of_mail_stand_as_written_without_assets_and_placeholders(over):
    line = "Escriba a Ventas@Molino-Viejo.es o VENTAS@molino-viejo.es (fondo@3x.webp, hoja@a.CSS, nadie@tudominio.com, x@example.org) Ventas@Molino-Viejo.es"
    assert over(text.emails, [line]) == [["Ventas@Molino-Viejo.es", "VENTAS@molino-viejo.es"]]


def test_profiles_are_kept_and_shares_and_logins_are_not(over):
    links = [
        "http://linkedin.com/in/rosa-gil-7", "https://pt.linkedin.com/company/molino_viejo", "https://www.linkedin.com/feed/x", "https://facebook.com/molino.viejo/fotos", "https://www.facebook.com/login",
        "http://instagram.com/molino_v", "https://www.instagram.com/explore", "https://twitter.com/molino_v", "https://x.com/intent",
    ]
    want = {
        "linkedin_url": ["http://linkedin.com/in/rosa-gil-7", "https://pt.linkedin.com/company/molino_viejo"], "facebook_url": ["https://facebook.com/molino.viejo"],
        "instagram_url": ["http://instagram.com/molino_v"], "twitter_url": ["https://twitter.com/molino_v"],
    }
    assert over(text.social_profiles, [" ".join(f"<i>{u}</i>" for u in links)]) == [want]


def test_addresses_lose_tracking_and_english_locales(over):
    cases = {
        "http://molino.test/en-gb/tienda?gclid=7&utm_medium=y&talla=3": "http://molino.test/tienda?talla=3",
        "https://molino.test/en/en-us/nosotros/": "https://molino.test/nosotros/",
        "https://molino.test/es/nosotros?p=2&q=3": "https://molino.test/es/nosotros?p=2&q=3",
        "https://molino.test/EN/x?MC_CID=1&b=&mc_eid=2&msclkid=3#top": "https://molino.test/x?b=&msclkid=3",
        "https://molino.test/en?x=1": "https://molino.test/en?x=1",
        "https://molino.test/en": "https://molino.test/en",
        "https://molino.test/english/en/x": "https://molino.test/english/en/x",
    }
    assert over(text.normal_url, list(cases)) == list(cases.values())


@pytest.mark.parametrize("base", ["https://x.es/a/b?q=1#f", "https://x.es", "https://x.es/", "http://x.es:80/a/b/c/"])
def test_references_resolve_as_in_the_standard_library(over, base):
    hrefs = ["/aviso-legal", "legal.html", "../legal", "../../../legal?x=1", "./a/./b/../c", "//host.es/x", "https://o.es/c", "mailto:a@b.es", "?z=2", "#top", "", "..", "a/.."]
    assert over(lambda h: text.absolute_url(F.lit(base), h), hrefs) == [urljoin(base, h) for h in hrefs]


def test_legal_links(over):
    page = '<a href="tienda">Tienda</a> <a title="t" href="../legal/">Condiciones</a> <a href="//otra.test/q"><b>Quienes</b> somos</a> <a href="/c?d=1">CONTACTO</a><a href="/legal">4</a>'
    assert over(lambda h: text.legal_links(F.lit("https://molino.test/a/b"), h), [page]) == [["https://molino.test/legal/", "https://otra.test/q", "https://molino.test/c?d=1"]]


def test_directories(over):
    sites = ["http://fichas.axesor.es/1", "https://infocif.es?x", "http://WWW.x.com:443/a", "https://molino.test", "https://noteinforma.com/", "https://user@instagram.com/"]
    assert over(lambda u: text.is_directory(text.host(u)), sites) == [True, True, True, False, False, True]
    assert over(lambda u: text.is_foreign_site(text.host(u)), sites) == [False, False, True, False, False, True]


def test_folding_equals_decomposition(over):
    signs = ["Mª del Mar", "Nº 3 y 1.º", "Łukasz Čech", "ﬁn ½ Ĳssel", "José́", "Ａｃｍｅ ２", "Ǆ ŉ", "c…d №5"]
    plain = ["".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in signs]
    assert over(text.without_accents, signs) == plain
    assert over(text.normal_name, ["Mª José, S.L."]) == ["MA JOSE SL"]
    assert over(text.evidence_form, ["Mª Nº1"]) == ["MANO1"]


def test_disqualifiers_reach_over_all_line_breaks_but_the_line_feed(over):
    body = "expediente sancionador, convenio de{}formación profesional"
    out = over(lambda t: rules.body_score(t)["labels"], [body.format(c) for c in (" ", "\u0085", "\r", " ", "\n")])
    assert [x == ["disq:convenio_fp"] for x in out] == [True, True, True, True, False]


def test_scores_and_labels_of_bodies(over):
    out = over(rules.body_score, ["PROVIDENCIA de apremio y embargo", "nada", None, "multa e infracción del moroso"])
    assert [(r.confirmed, r.score) for r in out] == [(True, 6), (False, 0), (False, 0), (True, 4)]
    assert out[0].labels == ["body:providencia_apremio", "body:embargo", "body:apremio"]


def test_title_veto(over):
    out = over(lambda t: rules.title_class(t, F.lit("5A"), F.lit("V. Anuncios")), ["Ley 3/2020 del régimen sancionador", "Resolución de expediente sancionador", "Notificación de multa", "Ley 3"])
    assert [(r.candidate, r.confidence) for r in out] == [(False, 0.0), (True, 0.95), (True, 0.7), (False, 0.0)]
    assert out[0].rules == ["likely_normative_false_positive"] and out[3].rules == []


def test_a_vehicle_word_counts_up_to_eighty_signs_away(over):
    near, far = "M 1234 AB" + "x" * 70 + " turismo", "M 1234 AB" + "x" * 110 + " turismo"
    assert over(identifiers.plates, [near, far, "turismo" + " " * 70 + "M-1234-AB", "turismo" + " " * 95 + "M-1234-AB"]) == [["M1234AB"], [], ["M1234AB"], []]


def test_names_stay_as_they_stand(over):
    body = "contra ACME Y CÍA, S.L. y PÉREZ GÓMEZ JOSÉ, con DNI 12345678Z; ANA - 12345678Z; AYUNTAMIENTO DE X, S.A. "
    assert over(identifiers.names, [body]) == [["ACME Y CÍA S.L", "PÉREZ GÓMEZ JOSÉ"]]
    k = over(lambda t: identifiers.keys(t, F.lit("")), [body])[0]
    assert k.nombres_norm == "ACME Y CIA SL zzsep PEREZ GOMEZ JOSE"


def test_masks_take_only_stars_as_open_places(spark):
    rows = [("12345678Z", "***4567**", True), ("1234567_Z", "***4567_*", True), ("12345678Z", "***4567_*", False), ("12345678Z", "___45678_", False), ("12345678Z", "****5678z", True), ("1234%678Z", "****%****", True), ("12345678Z", "****", False)]
    out = spark.createDataFrame(rows, "i string, m string, want boolean").select(identifiers.fits_mask(F.col("i"), F.col("m")).alias("got"), "want").collect()
    assert [r.got for r in out] == [r.want for r in out]


def test_tokens_keep_letters_of_all_alphabets(over):
    assert over(search.tokens, ["Łukasz Čech, Αθήνα-2 x_y", None]) == [["łukasz", "čech", "αθήνα", "2", "x", "y"], []]


def test_masks_leave_out_stars_of_other_runs_and_are_cut(over, monkeypatch):
    body = "***4567** y ***4567** 123456789 12345678Z 1234567*z X***4567** *2345678Z"
    assert over(identifiers.masked_identifiers, [body, None]) == [["***4567**", "*2345678Z"], []]
    monkeypatch.setattr(identifiers, "MOST_IDS", 1)
    assert over(identifiers.masked_identifiers, [body]) == [["***4567**"]]


def test_a_company_form_ends_with_its_word(over):
    assert over(identifiers.names, ["contra PEDRO SAÚL y contra MOLINO VIEJO SA."]) == [["MOLINO VIEJO SA"]]


def test_keys_of_a_long_text_take_linear_time(over):
    import time

    letters = identifiers.DNI_LETTERS
    found = [f"{n:08d}{letters[n % 23]}" for n in range(10_000_000, 10_020_000)]
    began = time.perf_counter()
    k = over(lambda t: identifiers.keys(t, F.lit("")), [" y ".join(found)])[0]
    assert k.identificadores == found[: identifiers.MOST_IDS] and time.perf_counter() - began < 20
