"""Spanish identifiers: normal forms, check characters, masks, and their extraction from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import places
from .text import normal_name

# Fixed values of the public check algorithms.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CIF_LETTERS = "JABCDEFGHI"
CIF_DIGIT_ONLY, CIF_LETTER_ONLY = ["A", "B", "E", "H"], ["P", "Q", "R", "S", "N", "W"]
# Province prefixes of plates before 2000.
PROVINCES = [
    "A", "AB", "AL", "AV", "B", "BA", "BI", "BU", "C", "CA", "CC", "CE", "CO", "CR", "CS", "CU", "GC", "GE", "GI", "GR", "GU", "H", "HU", "IB", "J", "L", "LE", "LO", "LU", "M",
    "MA", "ML", "MU", "NA", "O", "OR", "OU", "P", "PM", "PO", "S", "SA", "SE", "SG", "SO", "SS", "T", "TE", "TF", "TO", "V", "VA", "VI", "Z", "ZA",
]
# Bodies whose names are no parties.
AUTHORITIES = [
    "BOLETIN OFICIAL", "MINISTERIO", "DIRECCION GENERAL", "SUBDELEGACION", "DELEGACION", "AYUNTAMIENTO", "JEFATURA", "CONSEJERIA",
    "TESORERIA", "AGENCIA ESTATAL", "SEGURIDAD SOCIAL", "JUZGADO", "TRIBUNAL", "RESOLUCION", "EXPEDIENTE", "ANEXO", "ARTICULO",
    "DISPOSICION", "REAL DECRETO", "ANUNCIO", "EDICTO", "NOTIFICACION",
]
# Patterns of identifiers and plates, of Python's ``re``.
DNI = r"(?i)(?<![A-Z0-9*])(\d{8})[ .\-]?([A-HJ-NP-TV-Z])(?![A-Z0-9])"
NIE = r"(?i)(?<![A-Z0-9*])([XYZ])[ .\-]?(\d{7})[ .\-]?([A-HJ-NP-TV-Z])(?![A-Z0-9])"
CIF = r"(?i)(?<![A-Z0-9*])([ABCDEFGHJNPQRSUVW])[ .\-]?(\d{7})[ .\-]?([0-9A-J])(?![A-Z0-9])"
MASKED = r"(?<![\w*])([0-9*]{8}[0-9A-Z*])(?![\w*])"
PLATE = r"(?i)(?<![A-Z0-9\-])(\d{4})[ \-]?([BCDFGHJKLMNPRSTVWXYZ]{3})(?![A-Z0-9\-])"
OLD_PLATE = r"(?<![A-Z0-9\-])([A-Z]{1,2})[ \-]?(\d{4})[ \-]?([A-Z]{1,2})(?![A-Z0-9\-])"
# Patterns of contexts and names, of Spark's functions.
VEHICLE = r"(?iU)matr[ií]cula|veh[ií]culo|turismo|remolque|ciclomotor|placa"
FORBIDDEN = (
    r"(?iU)\b(expediente|expte|referencia|csv|iban|numero|n[uú]m|factura|cuenta|art[ií]culo|disposici[oó]n|resoluci[oó]n|orden)\b"
    r"|n[º°]|n\.º|art\.|r\.d\."
)
COMPANY = (
    r"([A-ZÑÁÉÍÓÚÜ0-9][A-ZÑÁÉÍÓÚÜ0-9&.,'’\- ]{2,88}?)[ ,]+"
    r"(S\.?\s?L\.?U?|S\.?\s?A\.?U?|S\.?\s?COOP|S\.?\s?L\.?\s?L|C\.?\s?B|S\.?\s?C|A\.?I\.?E|U\.?T\.?E)(?U:\b)\.?"
)
PERSON = (
    r"([A-ZÑÁÉÍÓÚÜ][A-ZÑÁÉÍÓÚÜ'’\- ]{5,70})[ ,;:]*(?:con\s+)?"
    r"(?:D\.?N\.?I\.?|N\.?I\.?F\.?|N\.?I\.?E\.?|C\.?I\.?F\.?|documento)?[ .:nºNº\-]*(?=[0-9*XYZ])"
)
NAME_SEPARATOR = " zzsep "
MOST_TEXT, MOST_IDS, MOST_NAMES, MOST_PLATES = 400_000, 2_000, 1_000, 1_000


def normal_identifier(text: Column) -> Column:
    """Upper case without blanks, full stops and hyphens; null gives ''."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s.\-]", ""))


def dni_letter(number: Column) -> Column:
    return F.substring(F.lit(DNI_LETTERS), (number.cast("long") % 23 + 1).cast("int"), F.lit(1))


def valid_dni(number: Column, letter: Column) -> Column:
    return F.coalesce((F.length(number) == 8) & number.rlike("^[0-9]+$") & (dni_letter(number.try_cast("long")) == F.upper(letter)), F.lit(False))


def valid_nie(prefix: Column, number: Column, letter: Column) -> Column:
    return valid_dni(F.concat(F.translate(F.upper(prefix), "XYZ", "012"), number), letter)


def valid_cif(letter: Column, digits: Column, control: Column) -> Column:
    """Odd places are doubled and their digits added; the control is a digit, a letter, or either, by the first letter."""
    digit = [F.substring(digits, i, 1).try_cast("int") for i in range(1, 8)]
    total = sum((digit[i] for i in (1, 3, 5)), F.lit(0))
    for i in (0, 2, 4, 6):
        twice = digit[i] * 2
        total = total + F.floor(twice / 10).cast("int") + twice % 10
    check = (10 - total % 10) % 10
    letter, control = F.upper(letter), F.upper(control)
    as_digit, as_letter = control == check.cast("string"), control == F.substring(F.lit(CIF_LETTERS), check + 1, F.lit(1))
    fits = F.when(letter.isin(CIF_DIGIT_ONLY), as_digit).when(letter.isin(CIF_LETTER_ONLY), as_letter).otherwise(as_digit | as_letter)
    return F.coalesce((F.length(digits) == 7) & fits, F.lit(False))


def fits_mask(identifier: Column, mask: Column) -> Column:
    """Whether an identifier agrees with a mask such as ***4567** in length and at each place that is no star."""
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.upper(mask), r"([^A-Z0-9*])", r"\\$1"), r"\*", "."), F.lit("$"))
    return F.rlike(F.upper(identifier), pattern)


_spots = places.places({"dni": DNI, "nie": NIE, "cif": CIF, "masked": MASKED, "plate": PLATE, "old_plate": OLD_PLATE}, before=24, around=80)


def _kept(found: Column, keep) -> Column:
    """The matches that do not follow a reference word and that ``keep`` accepts, given a match and its normal form; in normal form."""
    normal = F.transform(found, lambda m: F.struct(m.alias("m"), normal_identifier(m["match"]).alias("id")))
    return F.transform(F.filter(normal, lambda x: ~x["m"]["before"].rlike(FORBIDDEN) & keep(x["m"], x["id"])), lambda x: x["id"])


def _part(text: Column, first: int, length: int) -> Column:
    return F.substring(text, first, length)


def _identifiers(spots: Column) -> Column:
    dni = _kept(spots["dni"], lambda _, x: valid_dni(_part(x, 1, 8), _part(x, 9, 1)))
    nie = _kept(spots["nie"], lambda _, x: valid_nie(_part(x, 1, 1), _part(x, 2, 7), _part(x, 9, 1)))
    cif = _kept(spots["cif"], lambda _, x: valid_cif(_part(x, 1, 1), _part(x, 2, 7), _part(x, 9, 1)))
    return F.array_distinct(F.concat(dni, nie, cif))


def _masks(spots: Column, found: Column) -> Column:
    shown = F.transform(spots["masked"], lambda m: F.upper(m["match"]))
    return F.slice(F.array_except(F.filter(shown, lambda m: F.contains(m, F.lit("*"))), found), 1, MOST_IDS)


def _plates(spots: Column) -> Column:
    new = _kept(spots["plate"], lambda m, x: F.lit(True))
    old = _kept(spots["old_plate"], lambda m, x: m["around"].rlike(VEHICLE) & F.regexp_extract(x, "^[A-Z]{1,2}", 0).isin(PROVINCES))
    return F.slice(F.array_distinct(F.concat(new, old)), 1, MOST_PLATES)


def identifiers(body: Column) -> Column:
    """Valid DNI, NIE and CIF of a text that do not follow a reference word, each once."""
    return F.slice(_identifiers(_spots(body)), 1, MOST_IDS)


def masked_identifiers(body: Column) -> Column:
    """Identifiers of which some signs are stars, each once; a run that is also an identifier is none."""
    return _masks(_spots(body), _identifiers(_spots(body)))


def plates(body: Column) -> Column:
    """Plates of today's form, and provincial ones with a known prefix and a vehicle word near by."""
    return _plates(_spots(body))


def names(body: Column) -> Column:
    """Companies with their legal form, and upper-case runs of six signs or more right before an identifier, as they stand."""

    def party(name: Column) -> Column:
        return ~normal_name(name).rlike("|".join(AUTHORITIES))

    companies = F.zip_with(
        F.regexp_extract_all(body, F.lit(COMPANY), 1), F.regexp_extract_all(body, F.lit(COMPANY), 2), lambda n, s: F.concat_ws(" ", F.trim(n), F.trim(s))
    )
    persons = F.transform(F.regexp_extract_all(body, F.lit(PERSON), 1), lambda n: F.regexp_replace(n, r"^[ ,;:\-'’]+|[ ,;:\-'’]+$", ""))
    found = F.concat(companies, F.filter(persons, lambda n: F.length(n) >= 6))
    return F.slice(F.array_distinct(F.filter(found, party)), 1, MOST_NAMES)


def keys(text: Column, title: Column) -> Column:
    """Struct of identificadores, matriculas, nombres, digitos_parciales and nombres_norm of a document."""
    body = F.substring(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))), 1, MOST_TEXT)
    found, spots = names(body), _spots(body)
    return F.struct(
        F.slice(_identifiers(spots), 1, MOST_IDS).alias("identificadores"),
        _plates(spots).alias("matriculas"),
        found.alias("nombres"),
        _masks(spots, _identifiers(spots)).alias("digitos_parciales"),
        F.array_join(F.transform(found, normal_name), NAME_SEPARATOR).alias("nombres_norm"),
    )
